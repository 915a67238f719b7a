"""Secret scan: fixed patterns, and values in credential contexts that are hard to guess.

The base patterns find assignments to credential names, access key ids and long hexadecimal
runs.  Beyond them, whatever stands where a credential would (after one of many
names and a separator) is judged by how many guesses it takes: a dynamic program
segments the value at the least total cost into common words, dates, repeated units,
keyboard walks and brute-force characters.  Placeholders and plain words cost few guesses;
values of ``10 ** least_guesses`` or more are reported with the kind ``guess``.

Plan
----
One scan with no shuffle: every text is searched where it is read, whole.

Defined results: null counts as empty, which has no spans; overlapping spans of different
kinds are all reported; offsets are code points, end exclusive; rows are
independent of each other; an empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log10

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import small_batches, text_or_empty

KINDS = ("assign", "access", "hex", "guess")
LEAST_GUESSES = 10.0

# The base patterns of the result's contract.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Where a credential may stand: a name, an optional quote, a separator, an optional quote.
CONTEXT = re.compile(
    r"""(?i:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key"""
    r"""|credentials?|auth(?:orization)?|bearer)["']?\s{0,8}(?:[:=]|=>|:=)\s{0,8}["']?([^\s"'<>,;(){}\[\]]{6,})""",
    re.ASCII,
)

# Words common in passwords and placeholders, the likelier ones first.
COMMON_WORDS = (
    "password", "secret", "token", "admin", "example", "test", "user", "default", "changeme",
    "welcome", "login", "letmein", "master", "dragon", "monkey", "love", "sunshine", "princess",
    "football", "baseball", "shadow", "hello", "freedom", "whatever", "trustno", "superman",
    "batman", "summer", "winter", "spring", "autumn", "flower", "cookie", "ginger", "pepper",
    "dummy", "sample", "placeholder", "insert", "replace", "your", "here", "string", "value",
    "null", "none", "true", "false", "key", "api", "access", "private", "public", "auth", "bearer",
    "redacted", "hidden", "demo", "foo", "bar", "baz", "pass", "root", "guest", "system", "server",
    "service", "client", "local", "host", "database", "config", "environment", "production",
    "development", "staging", "account", "email", "name", "code", "the", "and", "for", "you",
    "this", "that", "with", "not", "change", "enter", "required", "optional", "unknown",
)

# Rows of keys and sequences along which walks go.
WALKS = (
    "qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qwertzuiop", "azertyuiop",
    "0123456789", "abcdefghijklmnopqrstuvwxyz",
)

# Look-alikes of letters.
LOOK_ALIKE = str.maketrans("013457@$", "oleastas")

_RANK = {w: k + 1 for k, w in enumerate(COMMON_WORDS)}
_LONGEST_WORD = max(map(len, COMMON_WORDS))
_STEPS = {a + b for row in WALKS for a, b in zip(row, row[1:])}
_STEPS |= {b + a for a, b in _STEPS}
_DATE = re.compile(
    r"(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d"
)
_YEAR = re.compile(r"(?:19|20)\d\d")
#: Guesses for a date are days of a hundred years; separators double them.
_DATE_COST, _YEAR_COST = log10(36525 * 2), log10(200)
#: An easy value of up to this length is searched for a name of its own.
LONGEST_NAME = 256
#: Units longer than this are not looked for again.
LONGEST_UNIT = 16


def _character(c: str) -> float:
    if c.isdigit():
        return 1.0
    if c in "_-. ":
        return log10(4)
    return log10(26) if c.isalpha() else log10(33)


def _matches(value: str, costs: list[float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of all words, dates, repeats and walks; ``costs`` are those of
    single characters."""
    low = value.lower()
    plain = low.translate(LOOK_ALIKE)
    for start in range(len(value)):
        for end in range(start + 3, min(len(value), start + _LONGEST_WORD) + 1):
            rank = _RANK.get(plain[start:end])
            if rank:
                changed = (low[start:end] != plain[start:end]) + (low[start:end] != value[start:end])
                yield start, end, log10(rank + 1) + changed * log10(4)
        date = _DATE.match(value, start)
        if date:
            yield start, date.end(), _DATE_COST
        elif _YEAR.match(value, start):
            yield start, start + 4, _YEAR_COST
    start = 0
    while start < len(value):
        end = start + 1
        while end < len(value) and low[end - 1] + low[end] in _STEPS:
            end += 1
        if end - start >= 3:
            yield start, end, log10(40 * 2 * (end - start))
        start = max(end - 1, start + 1)
    for unit in range(1, min(LONGEST_UNIT, len(value) // 2) + 1):
        start = 0
        while start + 2 * unit <= len(value):
            end = start + unit
            while end < len(value) and value[end] == value[end - unit]:
                end += 1
            times = (end - start) // unit
            if times >= 2:
                yield start, start + times * unit, sum(costs[start : start + unit]) + log10(times)
                start += max(1, (times - 1) * unit)
            else:
                start += 1


def guess_cost(value: str) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes."""
    costs = [_character(c) for c in value]
    ending: dict[int, list[tuple[int, float]]] = {}
    for start, end, cost in _matches(value, costs):
        ending.setdefault(end, []).append((start, cost))
    best = [0.0]
    for end in range(1, len(value) + 1):
        cost = best[-1] + costs[end - 1]
        for start, own in ending.get(end, ()):
            cost = min(cost, best[start] + own)
        best.append(cost)
    return best[-1]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, by start and then by kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def hard_values(text: str, least_guesses: float) -> list[tuple[int, int, float]]:
    """(start, end, cost) of hard to guess values in credential contexts."""
    found = []
    at = 0
    while m := CONTEXT.search(text, at):
        cost = guess_cost(m[1])
        if cost >= least_guesses:
            found.append((m.start(1), m.end(1), cost))
            at = m.end()
        else:
            # what looks like a value may itself be a name
            at = m.start(1) if m.end() - m.start(1) <= LONGEST_NAME else m.end()
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT_SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
    "n_guess long, most_guesses double"
)


def find_secrets(
    docs: DataFrame,
    least_guesses: float = LEAST_GUESSES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per document: numbers of base spans by kind, the SHA-256 of their list, all spans, the
    number of values that are hard to guess and the largest log10 of guesses among them."""

    small_batches(docs.sparkSession)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py()
                base = base_spans(text)
                hard = hard_values(text, least_guesses)
                kinds = [k for _, k, _ in base]
                rows.append(
                    (
                        doc_id,
                        *(kinds.count(k) for k in range(3)),
                        hashlib.sha256(_joined(base).encode()).hexdigest(),
                        _joined(sorted(base + [(s, 3, e) for s, e, _ in hard])),
                        len(hard),
                        max((c for _, _, c in hard), default=0.0),
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=[x.split()[0] for x in RESULT_SCHEMA.split(", ")],
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(of_partition, RESULT_SCHEMA)
