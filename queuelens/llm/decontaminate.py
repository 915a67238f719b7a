"""Benchmark decontamination: BM25 over test items, searched by block-max WAND.

The test items are the index, the training passages are the queries.  Each document is
cut into passages of twice the longest item that overlap by half, so every copy of an
item lies whole in one of them.  BM25 impacts are divided by the score that an item has
against itself; a passage retrieves every item that reaches ``least_score`` of that.
A retrieved item counts as leaked if the passage also covers enough of its question and
of its answer: word trigrams of all but the last sentence, and of the last.

Plan
----
The index is built from all items and broadcast; items beyond ``index_bytes`` of text
make several indexes, each with a scan of its own, so a broadcast never exceeds that
size.  Documents are read in place; only hits leave the scan, so nothing is shuffled.
Within a task, the largest impacts of its terms in blocks of items bound what a passage can
reach; only passages that may reach the threshold enter the search.

Defined results: null or empty texts and items match nothing; an item without sentence
end is question and answer at once; of passages that show the same item, the best one
counts, the earliest of equals; items that share an id are searched for one by one;
rows of documents are independent; empty tables give an empty result.  Other columns
are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import Stages, small_batches, text_or_empty
from queuelens.llm.tokens import word_hashes

K1, B = 1.2, 0.75
BLOCK = 64
SCREEN_BLOCKS = 16
ASIDE = 0.7
LEAST_SCORE = 0.7
LEAST_OVERLAP = 0.5

_WORD = re.compile(r"\w+")
_SENTENCE_END = re.compile(r"[.!?\n]+\s*")

HIT_SCHEMA = (
    "doc_id long, item_id long, start long, score double, question_overlap double, "
    "answer_overlap double"
)


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    sentences = [s for s in map(terms, _SENTENCE_END.split(text)) if s]
    if len(sentences) < 2:
        return terms(text), terms(text)
    return [w for s in sentences[:-1] for w in s], sentences[-1]


def grams(words: list[str], n: int = 3) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def overlap(part: list[str], passage: list[str]) -> float:
    wanted = grams(part)
    if not wanted:
        return 0.0
    n = len(next(iter(wanted)))
    there = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
    return len(wanted & there) / len(wanted)


@dataclass(frozen=True)
class Statistics:
    """What scores and passages depend on, over all items, however they are split."""

    items: int
    average: float
    longest: int
    #: number of items that hold a term; at least those of the index at hand
    holders: Mapping[str, int]

    @staticmethod
    def of(words: list[list[str]]) -> Statistics:
        average = sum(map(len, words)) / max(1, len(words)) or 1.0
        holders = Counter(w for ws in words for w in set(ws))
        return Statistics(len(words), average, max(map(len, words), default=0), holders)


class Index:
    """Inverted index of items with normalised BM25 impacts in blocks.

    ``known`` has the statistics of all items where these are only some of them.
    """

    def __init__(self, items: list[tuple[int, str]], known: Statistics | None = None):
        self.ids = [i for i, _ in items]
        self.parts = [question_and_answer(text) for _, text in items]
        words = [terms(text) for _, text in items]
        known = known or Statistics.of(words)
        self.longest, average, holders = known.longest, known.average, known.holders
        postings: dict[str, list[tuple[int, float]]] = {}
        for number, ws in enumerate(words):
            weights = {}
            for w, tf in Counter(ws).items():
                idf = np.log1p((known.items - holders[w] + 0.5) / (holders[w] + 0.5))
                weights[w] = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ws) / average))
            own = sum(weights.values())
            for w, x in weights.items():
                postings.setdefault(w, []).append((number, float(x / own)))
        self.postings = {
            w: (
                [n for n, _ in p],
                [x for _, x in p],
                [max(x for _, x in p[i : i + BLOCK]) for i in range(0, len(p), BLOCK)],
                max(x for _, x in p),
            )
            for w, p in postings.items()
        }
        self._screens: dict[float, Screen] = {}

    def screen(self, least: float) -> "Screen":
        if least not in self._screens:
            self._screens[least] = Screen(self, least)
        return self._screens[least]

    def search(self, query: set[str], least: float) -> list[tuple[int, float]]:
        """Every item with a score of ``least`` or more, by block-max WAND."""
        lists = [self.postings[w] for w in sorted(query) if w in self.postings]
        at = [0] * len(lists)
        found = []
        slack = 1e-9
        while True:
            live = sorted((lists[k][0][at[k]], k) for k in range(len(lists)) if at[k] < len(lists[k][0]))
            reach, pivot = 0.0, None
            for place, (number, k) in enumerate(live):
                reach += lists[k][3]
                if reach >= least - slack:
                    pivot = place
                    break
            if pivot is None:
                return found
            item = live[pivot][0]
            while pivot + 1 < len(live) and live[pivot + 1][0] == item:
                pivot += 1
            # what the blocks that hold the pivot item can reach
            block_reach, block_end = 0.0, None
            for _, k in live[: pivot + 1]:
                docs, _, maxima, _ = lists[k]
                block = bisect_left(docs, item, at[k]) // BLOCK
                if block < len(maxima):
                    block_reach += maxima[block]
                    end = docs[min((block + 1) * BLOCK, len(docs)) - 1]
                    block_end = end if block_end is None else min(block_end, end)
            if block_reach < least - slack:
                # no item up to the end of the shortest block can make it
                beyond = item + 1 if block_end is None else max(item, block_end) + 1
                if pivot + 1 < len(live):
                    beyond = max(item + 1, min(beyond, live[pivot + 1][0]))
                for _, k in live[: pivot + 1]:
                    at[k] = bisect_left(lists[k][0], beyond, at[k])
                continue
            score = 0.0
            for _, k in live[: pivot + 1]:
                docs, impacts, _, _ = lists[k]
                at[k] = bisect_left(docs, item, at[k])
                if at[k] < len(docs) and docs[at[k]] == item:
                    score += impacts[at[k]]
                    at[k] += 1
            if score >= least - slack:
                found.append((item, score))


class Screen:
    """Bounds on what a passage can reach, for blocks of items.

    In every block, the commonest terms are set aside as long as no item of it has more than
    ``ASIDE`` of the threshold from all of them together; the other terms of a passage, each
    with its largest impact in the block, must bring in the rest.  Items rich in common
    terms stand together, so that they weaken the bound of few blocks.
    """

    def __init__(self, index: Index, least: float):
        words = sorted(index.postings, key=lambda w: (-len(index.postings[w][0]), w))
        hashes = word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        row = np.empty(len(words), np.int64)
        row[order] = np.arange(len(words))
        count = len(index.ids)
        rich = np.zeros(count)
        for w in words:
            numbers, impacts = index.postings[w][:2]
            if len(numbers) * 50 >= count:
                rich[numbers] += impacts
        blocks = np.array_split(np.argsort(rich, kind="stable"), min(SCREEN_BLOCKS, max(1, count)))
        block_of = np.empty(count, np.int64)
        for k, members in enumerate(blocks):
            block_of[members] = k
        self.bounds = np.zeros((len(words), len(blocks)), np.float32)
        mass = np.zeros(count)
        closed = np.zeros(len(blocks), bool)
        for k, w in enumerate(words):
            numbers, impacts = (np.array(x) for x in index.postings[w][:2])
            own = block_of[numbers]
            top = np.zeros(len(blocks))
            np.maximum.at(top, own, impacts)
            reach = np.zeros(len(blocks))
            np.maximum.at(reach, own, mass[numbers] + impacts)
            closed |= reach > ASIDE * least
            mass[numbers] += np.where(closed[own], 0, impacts)
            self.bounds[row[k]] = np.where(closed, top, 0)
        most = np.zeros(len(blocks))
        np.maximum.at(most, block_of, mass)
        self.need = (least - most - 1e-5).astype(np.float32)

    def passages(self, hashes: np.ndarray, step: int) -> np.ndarray:
        """Numbers of the passages, ``step`` words apart and twice as long, that may reach
        the threshold with some item."""
        chunks = -(-len(hashes) // step)
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        known = np.flatnonzero(self.hashes[at] == hashes)
        sums = np.zeros((chunks + 1, len(self.need)), np.float32)
        if len(known):
            # each term once in a chunk
            keys = np.unique(known // step * len(self.hashes) + at[known])
            chunk, term = np.divmod(keys, len(self.hashes))
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            sums[chunk[starts]] = np.add.reduceat(self.bounds[term], starts, axis=0)
        reach = sums[:-1] + sums[1:]
        last = max(1, chunks - 1)
        return np.flatnonzero((reach[:last] >= self.need).any(axis=1))


def leaks_of(text: str, index: Index, least_score: float, least_overlap: float) -> list[tuple]:
    """(item number, start, score, question overlap, answer overlap) of one document."""
    words = terms(text)
    if not words or not index.postings:
        return []
    step = index.longest
    hashes = word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
    best: dict[int, tuple] = {}
    for start in index.screen(least_score).passages(hashes, step) * step:
        passage = words[start : start + 2 * step]
        for item, score in index.search(set(passage), least_score):
            question, answer = index.parts[item]
            shown = overlap(question, passage), overlap(answer, passage)
            if min(shown) >= least_overlap:
                row = (item, int(start), score, *shown)
                if item not in best or (sum(shown), score) > (sum(best[item][3:]), best[item][2]):
                    best[item] = row
    return [best[item] for item in sorted(best)]


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    least_score: float = LEAST_SCORE,
    least_overlap: float = LEAST_OVERLAP,
    index_bytes: int = 32 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """One row for each document and leaked item: doc_id, item_id, start (word offset of the
    passage), score (share of the item's own BM25 score), question_overlap, answer_overlap."""
    small_batches(docs.sparkSession)
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    hits = [
        texts.mapInArrow(_scan(index, least_score, least_overlap), HIT_SCHEMA)
        for index in _indexes(items, index_bytes, item_col)
    ]
    return reduce(DataFrame.union, hits)


def _indexes(items: DataFrame, index_bytes: int, item_col: str) -> list:
    """Broadcast indexes of all items, each of about ``index_bytes`` of text or less.

    More than one share the statistics of all items, so that a score or the border of a
    passage does not depend on how items are split.
    """
    spark = items.sparkSession
    wanted = items.select(
        F.col(item_col).cast("long").alias("item_id"), text_or_empty().alias("text")
    )
    size = wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-size // index_bytes))
    piece = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    if count > 1:
        stages = Stages(spark, "decontaminate")
        split = wanted.withColumn("piece", piece).select("piece", "text")
        split = stages.write(split.mapInArrow(_item_terms, "piece long, words array<string>"), "terms")
        n, total, longest = split.agg(
            F.count(F.lit(1)), F.sum(F.size("words")), F.max(F.size("words"))
        ).first()
        held = split.select("piece", F.explode(F.array_distinct("words")).alias("word"))
        holders = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
        holders = stages.write(held.distinct().join(holders, "word"), "holders")
    out = []
    for k in range(count):
        rows = wanted.where(piece == k).orderBy("item_id", "text").collect()
        known = None
        if count > 1:  # terms of one piece are bounded by its text
            own = {r["word"]: r["n"] for r in holders.where(F.col("piece") == k).collect()}
            known = Statistics(n, total / n or 1.0, longest, own)
        index = Index([(r["item_id"], r["text"]) for r in rows], known)
        out.append(spark.sparkContext.broadcast(index))
    return out


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [terms(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("piece"), pa.array(words, pa.list_(pa.string()))], ["piece", "words"]
        )


def _scan(shared, least_score: float, least_overlap: float):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                for item, *rest in leaks_of(text.as_py(), index, least_score, least_overlap):
                    rows.append((doc_id, index.ids[item], *rest))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 3 + [pa.float64()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "item_id", "start", "score", "question_overlap", "answer_overlap"],
            )

    return of_partition


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    least_score: float = LEAST_SCORE,
    least_overlap: float = LEAST_OVERLAP,
    index_bytes: int = 32 << 20,
    text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """Rows of ``docs`` in which no test item is found, as they were; nothing is shuffled."""
    small_batches(docs.sparkSession)
    for index in _indexes(items, index_bytes, item_col):
        docs = docs.mapInArrow(_clean(index, text_col, least_score, least_overlap), docs.schema)
    return docs


def _clean(shared, text_col: str, least_score: float, least_overlap: float):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(text_col))
            keep = [not leaks_of(t, shared.value, least_score, least_overlap) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return of_partition
