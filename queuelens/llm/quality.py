"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text becomes a sparse vector: hashed one-grams and two-grams of its tokens (runs of
letters and digits, and runs of other printable characters), with the square root of
their counts and unit length.  A token that comes again directly, or after one other, gives
the same feature whatever the token is.  The model is fitted with FTRL-proximal updates, one
per labelled text, which keep weights of features that prove nothing at exactly zero.
A score is a sparse dot product through the logistic function.

Labels are all that a fit sees besides texts: ids and other columns are no features.

Plan
----
Training takes at most ``max_train`` labelled texts (a documented bound, the first by hash
of the id; their ids are broadcast to the scan that fetches the texts).  They are dealt into a fixed number of shards, each fitted in a task of its own;
the mean of the shards' weights is the model.  It has a fixed size, is broadcast, and
all texts are scored in one scan without a shuffle.

Defined results: null and empty texts have no features and get the score of the
intercept; labels other than 0 and 1 are left out; without labels of both kinds the
score is 0.5 for all; of ids with several labels the smallest counts; an empty table gives
an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import small_batches, text_or_empty
from queuelens.llm.tokens import mix, word_hashes

_TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+")


#: Stand for any token that follows itself, directly and after one other.
_SAME = mix(np.array([1, 2], np.uint64))


@dataclass(frozen=True)
class FtrlSettings:
    """``bits``: log2 of the number of features; the others are FTRL-proximal's own."""

    bits: int = 18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.1
    passes: int = 20
    shards: int = 2
    max_train: int = 20_000


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct feature numbers and their values."""
    tokens = word_hashes(_TOKEN.findall(text.encode("utf-8", "surrogatepass")))
    if not len(tokens):
        return np.empty(0, np.int64), np.empty(0)
    pairs = mix(tokens[:-1] * np.uint64(3) + tokens[1:])
    pairs[tokens[:-1] == tokens[1:]] = _SAME[0]
    again = np.repeat(_SAME[1:], np.count_nonzero(tokens[:-2] == tokens[2:]))
    numbers = (np.concatenate([tokens, pairs, again]) >> np.uint64(64 - bits)).astype(np.int64)
    numbers, counts = np.unique(numbers, return_counts=True)
    values = np.sqrt(counts)
    return numbers, values / np.linalg.norm(values)


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], settings: FtrlSettings) -> np.ndarray:
    """Weights of all features, and last the intercept, fitted in the order of ``rows``."""
    size = (1 << settings.bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        shrunk = np.sign(zi) * np.maximum(0, np.abs(zi) - settings.l1)
        return -shrunk / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2)

    # both labels weigh the same in total, however rare one is
    ones = sum(label for _, _, label in rows)
    share = [len(rows) / (2 * max(1, k)) for k in (len(rows) - ones, ones)]
    for _ in range(settings.passes):
        for numbers, values, label in rows:
            at, x = np.append(numbers, size - 1), np.append(values, 1.0)
            w = weights(at)
            g = share[label] * (_sigmoid(float(w @ x)) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def _fit_shard(settings: FtrlSettings):
    def fit(key: tuple, table: pa.Table) -> pa.Table:
        # the order of updates depends on the rows alone, not on how they arrive
        rows = sorted(zip(table.column("place").to_pylist(), table.column("text").to_pylist(),
                          table.column("label").to_pylist()))
        fitted = ftrl([(*features(t, settings.bits), y) for _, t, y in rows], settings)
        used = np.flatnonzero(fitted)
        return pa.table({"feature": pa.array(used), "weight": pa.array(fitted[used])})

    return fit


def train(labelled: DataFrame, settings: FtrlSettings = FtrlSettings()) -> np.ndarray:
    """Weights from at most ``max_train`` rows (place, text, label) with label 0 or 1, fitted
    in the order of ``place``; the last weight is the intercept."""
    size = (1 << settings.bits) + 1
    mean = np.zeros(size)
    if labelled.select("label").distinct().count() < 2:
        return mean
    shards = labelled.withColumn("shard", F.pmod(F.xxhash64("place"), F.lit(settings.shards)))
    fitted = shards.groupBy("shard").applyInArrow(
        _fit_shard(settings), "feature long, weight double"
    )
    # at most one row per feature
    total = fitted.groupBy("feature").agg((F.sum("weight") / settings.shards).alias("w")).toPandas()
    mean[total["feature"].to_numpy()] = total["w"].to_numpy()
    return mean


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels no fit may see: crc32 of the id as text leaves 1 when divided by 3."""
    remainder = F.crc32(F.col(id_col).cast("string").cast("binary")) % 3
    return F.coalesce(remainder == 1, F.lit(False))


def train_on(
    docs: DataFrame,
    labels: DataFrame,
    settings: FtrlSettings = FtrlSettings(),
    label_col: str = "quality",
) -> np.ndarray:
    """Weights from the labels of documents that are not held out."""
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
        .withColumn("place", F.xxhash64(F.lit("order"), "doc_id"))
        .orderBy("place")
        .limit(settings.max_train)
    )
    # max_train ids are some 100 kB, so texts stay where they are read
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    sample = texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "place", "label")
    return train(sample.agg(F.min("text").alias("text")), settings)


def score(
    docs: DataFrame,
    weights: np.ndarray,
    bits: int = FtrlSettings.bits,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            scores = []
            for text in batch.column("text"):
                numbers, values = features(text.as_py(), bits)
                scores.append(_sigmoid(float(w[numbers] @ values + w[-1])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"]
            )

    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    ).mapInArrow(of_partition, "doc_id long, score double")


def accepted(
    docs: DataFrame,
    weights: np.ndarray,
    bits: int = FtrlSettings.bits,
    least: float = 0.5,
    text_col: str = "text",
) -> DataFrame:
    """Rows of ``docs`` with a score of ``least`` or more, as they were; nothing is shuffled."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for batch in batches:
            keep = []
            for text in batch.column(text_col):
                numbers, values = features(text.as_py() or "", bits)
                keep.append(_sigmoid(float(w[numbers] @ values + w[-1])) >= least)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(of_partition, docs.schema)
