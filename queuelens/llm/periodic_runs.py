"""Periodic runs of words, by string synchronising sets.

A run is a stretch of consecutive words with smallest period q (words q apart are
identical), at least ``least_words`` and ``least_powers`` * q long, that no neighbouring
word extends.  Texts are independent: each batch of texts is one array of word numbers,
with a word of its own after every text, so that no run crosses from one into the next.

Method, for every dyadic scale t, which looks for periods from t to 2 t - 1
---------------------------------------------------------------------------
* Synchronising set: position i belongs to it if the least of the hashes of the t-word
  windows at i, ..., i + t stands at i or at i + t.  This looks at 2 t words only, so equal
  contexts are selected alike, and any t consecutive positions hold a member.
* Highly periodic regions: members whose 2 t words have a period of t / 3 or less are left
  out, so that the set stays sparse.  Such words lie in a run of that period, which an
  earlier scale has found: that run supplies the omitted period.  Periods 1 to 3, below
  the first scale, are found by comparing words directly.
* Members with equal 2 t words, next to each other among those, propose their distance.
  A run of period q in [t, 2 t) holds such a pair at distance q exactly: were they closer,
  the two periods would imply a smaller one (Fine and Wilf), and four periods are long
  enough to hold a member that is not left out, and its copy q words on.
* A proposal is extended to both sides by comparing words; what is too short is no run.

The cost is O(n log n) for n words, whatever they are.

Defined results: null and empty texts have no words and no runs; a null id changes
nothing; repeated rows give repeated results; an empty table gives an empty result.  Only
the id and the text are read, so other columns cannot clash.  A text is held in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import small_batches
from queuelens.llm.tokens import mix, split_words

#: Periods below the first scale, compared directly.
FIRST_SCALE = 4
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTOR = np.uint64(0x9FB21C651E98DF25)

RUN_SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
RUN_FIELDS = pa.schema(
    [(n, pa.string() if n.endswith("sha256") else pa.int64())
     for n in (part.split()[0] for part in RUN_SCHEMA.split(", "))]
)
SPAN_SCHEMA = "doc_id long, start long, length long, period long"


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of windows, from the hashes of their two halves."""
    return mix(mix(left) * _FACTOR + right)


def _window_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` + 1 consecutive values; ``width`` is a power of two."""
    out, reach = values, 1
    while reach < width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[:-1], values[width:])


def synchronising_set(windows: np.ndarray, scale: int) -> np.ndarray:
    """Positions whose hash, or that ``scale`` further on, is the least of those between."""
    least = _window_minimum(windows, scale)
    n = len(least)
    return np.flatnonzero((windows[:n] == least) | (windows[scale : scale + n] == least))


def _match_length(a: np.ndarray, b: np.ndarray) -> int:
    """Number of first values that agree, looked at in stretches that double."""
    at, size, n = 0, 16, min(len(a), len(b))
    while at < n:
        differ = a[at : min(n, at + size)] != b[at : min(n, at + size)]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return n


class _Found:
    """Runs of one array of words: (start, end, period), and where short periods rule."""

    def __init__(self, words: np.ndarray, least_words: int, least_powers: int):
        self.words, self.least_words, self.least_powers = words, least_words, least_powers
        self.spans: list[tuple[int, int, int]] = []

    def add(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.least_words, self.least_powers * period):
            self.spans.append((start, end, period))

    def direct(self, period: int) -> None:
        """Runs of a short period; a stretch of a smaller one is that one's run already."""
        known = sorted(s for s in self.spans if period % s[2] == 0)
        starts = np.array([s[0] for s in known], np.int64)
        reach = np.maximum.accumulate(np.array([0, *(s[1] for s in known)], np.int64))
        same = np.concatenate(([0], self.words[:-period] == self.words[period:], [0]))
        edges = np.flatnonzero(np.diff(same))
        start, end = edges[::2], edges[1::2] + period
        new = reach[np.searchsorted(starts, start, side="right")] < end
        for s, e in zip(start[new].tolist(), end[new].tolist()):
            self.add(s, e, period)

    def extend(self, at: np.ndarray, period: np.ndarray) -> None:
        """Runs around proposed pairs; a run's other pairs are passed over."""
        order = np.lexsort((at, period))
        last = (-1, -1)  # period and end of the latest stretch
        for i, q in zip(at[order].tolist(), period[order].tolist()):
            if last[0] == q and i + q < last[1]:
                continue
            end = i + q + _match_length(self.words[i:], self.words[i + q :])
            before, after = self.words[:i][::-1], self.words[: i + q][::-1]
            start = i - _match_length(before, after)
            last = (q, end)
            self.add(start, end, q)

    def ruled(self, longest_period: int, width: int) -> np.ndarray:
        """For each position, whether ``width`` words from there have so short a period."""
        steps = np.zeros(len(self.words) + 1, np.int32)
        for start, end, period in self.spans:
            if period <= longest_period and end - start >= width:
                steps[start] += 1
                steps[end - width + 1] -= 1
        return np.cumsum(steps)[:-1] > 0


def find_runs(
    words: np.ndarray, longest: int | None = None, least_words: int = 6, least_powers: int = 4
) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of an array of word numbers, by start, then period.

    ``longest`` bounds the length of a run, where it is known to be less than the array's.
    ``least_powers`` under 4 would leave the reasoning above without ground.
    """
    if least_powers < 4:
        raise ValueError(f"least_powers is at least 4, not {least_powers}")
    words = np.asarray(words, np.int64)
    longest = len(words) if longest is None else longest
    found = _Found(words, least_words, least_powers)
    for period in range(1, FIRST_SCALE):
        if len(words) > period:
            found.direct(period)
    windows, scale = mix(words.astype(np.uint64)), 1
    while least_powers * scale <= longest:
        if len(windows) <= scale:
            break
        double = _joined(windows[:-scale], windows[scale:])
        if scale >= FIRST_SCALE:
            members = synchronising_set(windows, scale)
            members = members[members < len(double)]
            members = members[~found.ruled(scale // 3, 2 * scale)[members]]
            context = double[members]
            order = np.argsort(context, kind="stable")
            here, follows = members[order[:-1]], members[order[1:]]
            apart = follows - here
            ok = (context[order[:-1]] == context[order[1:]]) & (apart >= scale)
            ok &= apart < 2 * scale
            found.extend(here[ok], apart[ok])
        windows, scale = double, 2 * scale
    return sorted(found.spans, key=lambda s: (s[0], s[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    steps = np.zeros(n + 1, np.int32)
    for start, end, period in runs:
        steps[start + period] += 1
        steps[end] -= 1
    return np.cumsum(steps)[:-1] == 0


def _texts_with_runs(texts: list[str | None], least_words: int, least_powers: int):
    """(words, runs) of each text."""
    words = [split_words(t) if t else [] for t in texts]
    numbers: dict[bytes, int] = {}
    ids = np.empty(sum(map(len, words)) + len(words), np.int64)
    ends, at = [], 0
    for k, own in enumerate(words):
        ids[at : at + len(own)] = [numbers.setdefault(w, len(numbers)) for w in own]
        at += len(own)
        ids[at] = -1 - k
        at += 1
        ends.append(at)
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    longest = max(map(len, words), default=0)
    found = find_runs(ids, longest, least_words, least_powers)
    which = np.searchsorted(ends, [s for s, _, _ in found], side="right")
    for k, (start, end, period) in zip(which.tolist(), found):
        first = ends[k - 1] if k else 0
        runs[k].append((start - first, end - first, period))
    return zip(words, runs)


def _rows(docs: DataFrame, id_col: str, text_col: str | Column) -> DataFrame:
    text = F.col(text_col) if isinstance(text_col, str) else text_col
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text.cast("string").alias("text")
    )


def run_spans(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str | Column = "text",
    least_words: int = 6,
    least_powers: int = 4,
) -> DataFrame:
    """(doc_id, start, length, period) of every run, in words."""

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in (0, 1))
            found = _texts_with_runs(texts, least_words, least_powers)
            rows = [(i, s, e - s, q) for i, (_, runs) in zip(ids, found) for s, e, q in runs]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                names=["doc_id", "start", "length", "period"],
            )

    return _rows(docs, id_col, text_col).mapInArrow(spans, SPAN_SCHEMA)


def collapse_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str | Column = "text",
    least_words: int = 6,
    least_powers: int = 4,
    digest: bool = False,
) -> DataFrame:
    """Per row: doc_id, the number of runs, the longest run, and what is left of the text.

    The longest run has the smallest start, then period, among equals.  What is left is
    ``collapsed``, each run cut to its first period and words joined by one space, or with
    ``digest`` the SHA-256 of that and of the list of runs.
    """

    def result(doc_id, words, runs) -> tuple:
        top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
        named = (None,) * 4
        if top:
            start, length, period = top[0], top[1] - top[0], top[2]
            named = (start, length, period, 1000 * length // period)
        if runs:
            stay = kept_words(len(words), runs)
            words = [w for w, k in zip(words, stay.tolist()) if k]
        left = b" ".join(words)
        if not digest:
            return doc_id, len(runs), *named, left.decode("utf-8", "surrogatepass")
        listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in runs).encode()
        return (doc_id, len(runs), *named,
                hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest())

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = (batch.column(c).to_pylist() for c in (0, 1))
            found = _texts_with_runs(texts, least_words, least_powers)
            rows = [result(i, *f) for i, f in zip(ids, found)]
            columns = list(zip(*rows)) or [()] * len(fields)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields
            )

    fields, schema = RUN_FIELDS, RUN_SCHEMA
    if not digest:
        fields = pa.schema([*list(RUN_FIELDS)[:6], ("collapsed", pa.string())])
        schema = RUN_SCHEMA.split(", runs_sha256")[0] + ", collapsed string"
    return _rows(docs, id_col, text_col).mapInArrow(collapse, schema)


def with_planted_period(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """The text, for one document in ten with its tail made periodic from some word on.

    With h = crc32 of the id as text and g = floor(h / 10): if h % 10 = 0, word i >= a of n
    becomes word a + (i - a) % p, where a = g % n and p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text_col), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")

    def periodic(parts: Column) -> Column:
        own, a = parts["words"], parts["a"]
        p = 1 + F.floor((parts["n"] - a) / (3 + g % 8))
        first = F.slice(own, F.lit(1), a.cast("int"))
        unit = F.slice(own, (a + 1).cast("int"), p.cast("int"))
        times = F.ceil((parts["n"] - a) / p).cast("int")
        tail = F.slice(
            F.flatten(F.array_repeat(unit, times)), F.lit(1), (parts["n"] - a).cast("int")
        )
        return F.array_join(F.concat(first, tail), " ")

    # a one-element array binds the words once, so that they are split only once
    once = F.transform(
        F.array(words), lambda w: F.struct(w.alias("words"), F.size(w).cast("long").alias("n"))
    )
    bound = F.transform(
        once, lambda s: F.struct(s["words"], s["n"], (g % F.greatest(s["n"], F.lit(1))).alias("a"))
    )
    made = F.transform(bound, lambda s: F.when(s["n"] > 0, periodic(s)))[0]
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(F.col(text_col))
