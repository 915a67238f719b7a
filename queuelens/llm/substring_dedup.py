"""Substring de-duplication: repeated windows of words, merged into removal intervals.

Every window of ``window`` consecutive words gets a Rabin-Karp hash.  A window
whose word sequence also starts earlier (in a document with a smaller id, or
earlier in the same document) is repeated; overlapping repeated windows merge
into maximal intervals, and the words inside go.

Plan
----
1. Documents are dealt into parts of consecutive ids (bounds are percentiles of the id
   column, and beyond 4,096 parts even pieces between them), so "earlier part" means
   "earlier document".
2. Each part sends its distinct window hashes, in one sorted binary run per
   bucket of the hash domain.  Copies within a part meet there, so a window that
   stands in a third of all documents adds one entry per part.
3. Each bucket counts its runs: an entry is repeated if an earlier part has it
   too.  The answer is one bit per entry, in the order of the run.
4. Parts meet their answers, merge repeated windows into intervals and cut.

A window is identified by its 64-bit hash and the bucket, which comes from the
leading bits of a second, independent hash; the number of buckets grows with the
data, and the identity with it.

Defined results: null text has no words; texts under ``window`` words keep all;
a null id counts as the largest; rows that share an id are taken in the order
of their texts, each with a row of its own; an empty table gives an empty result.
Other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.llm.stages import power_of_two, shuffle_width, small_batches, text_or_empty
from queuelens.llm.tokens import BASE_A, BASE_B, rolling_hash, split_words, word_hashes

WINDOW = 20

#: Ranges of ids of about equally many documents; more parts than these cut them evenly.
RANGES = 4096

RUN_SCHEMA = "bucket int, part int, run binary"
ANSWER_SCHEMA = "bucket int, part int, bits binary"
RESULT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("intervals", T.ArrayType(T.ArrayType(T.IntegerType()))),
        T.StructField("kept_text", T.StringType()),
    ]
)


def _part_windows(table: pa.Table, window: int, bucket_bits: int):
    """Windows of a part: its documents in order, and for each window its hash,
    bucket and rank.  Windows are numbered through the part."""
    ids = table.column("doc_id").to_pylist()
    texts = table.column("text").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    docs, first, second = [], [], []
    at = 0
    for i in order:
        words = split_words(texts[i])
        hashes = word_hashes(words)
        a = rolling_hash(hashes, window, BASE_A)
        docs.append((ids[i], words, at, at + len(a)))
        at += len(a)
        if len(a):
            first.append(a)
            b = rolling_hash(hashes, window, BASE_B)
            second.append((b >> np.uint64(64 - bucket_bits)).astype(np.int32))
    a = np.concatenate(first) if first else np.empty(0, np.uint64)
    b = np.concatenate(second) if second else np.empty(0, np.int32)
    return docs, a, b


def _distinct(a: np.ndarray, b: np.ndarray):
    """Positions of windows sorted by (bucket, hash, position); where a distinct
    window begins; and where a bucket begins among the distinct windows."""
    order = np.argsort(a, kind="stable")
    order = order[np.argsort(b[order].astype(np.uint16) if b.size and b.max() < 65536 else b[order], kind="stable")]
    sa, sb = a[order], b[order]
    new = np.ones(len(order), bool)
    new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
    heads = np.flatnonzero(new)
    head_bucket = sb[heads]
    cuts = np.flatnonzero(np.r_[True, head_bucket[1:] != head_bucket[:-1]]) if len(heads) else heads
    return order, heads, head_bucket, cuts


def _runs(window: int, bucket_bits: int):
    def of_part(key: tuple, table: pa.Table) -> pa.Table:
        _, a, b = _part_windows(table, window, bucket_bits)
        order, heads, head_bucket, cuts = _distinct(a, b)
        values = a[order[heads]]
        ends = np.r_[cuts[1:], len(heads)] if len(cuts) else cuts
        return pa.table(
            {
                "bucket": pa.array(head_bucket[cuts], pa.int32()),
                "part": pa.array(np.full(len(cuts), key[0].as_py(), np.int32)),
                "run": pa.array([values[s:e].tobytes() for s, e in zip(cuts, ends)], pa.binary()),
            }
        )

    return of_part


def _earlier_elsewhere(key: tuple, table: pa.Table) -> pa.Table:
    """For each run of a bucket, a bit per entry: an earlier part has it too."""
    parts = table.column("part").to_numpy()
    by_part = np.argsort(parts, kind="stable")
    runs = table.column("run").to_pylist()
    arrays = [np.frombuffer(runs[i], np.uint64) for i in by_part]
    sizes = np.array([len(x) for x in arrays])
    values = np.concatenate(arrays)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    repeated = np.zeros(len(values), bool)
    repeated[order[1:][ranked[1:] == ranked[:-1]]] = True
    ends = np.cumsum(sizes)
    bits = [np.packbits(repeated[e - n : e]).tobytes() for e, n in zip(ends, sizes)]
    return pa.table(
        {
            "bucket": pa.array(np.full(len(bits), key[0].as_py(), np.int32)),
            "part": pa.array(parts[by_part].astype(np.int32)),
            "bits": pa.array(bits, pa.binary()),
        }
    )


def merge_windows(repeated: np.ndarray, window: int) -> list[list[int]]:
    """Start offsets of repeated windows as maximal [start, end) word intervals."""
    starts = np.flatnonzero(repeated)
    if not len(starts):
        return []
    gaps = np.flatnonzero(np.diff(starts) > window)
    lo = starts[np.r_[0, gaps + 1]]
    hi = starts[np.r_[gaps, len(starts) - 1]] + window
    return [[int(s), int(e)] for s, e in zip(lo, hi)]


def _cut(window: int, bucket_bits: int):
    def of_part(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        docs, a, b = _part_windows(table, window, bucket_bits)
        order, heads, head_bucket, cuts = _distinct(a, b)
        ends = np.r_[cuts[1:], len(heads)] if len(cuts) else cuts
        # later occurrences within the part are repeated whatever other parts hold
        repeated = np.ones(len(a), bool)
        elsewhere = np.zeros(len(heads), bool)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        for s, e in zip(cuts, ends):
            packed = np.frombuffer(bits[int(head_bucket[s])], np.uint8)
            elsewhere[s:e] = np.unpackbits(packed, count=e - s).astype(bool)
        repeated[order[heads]] = elsewhere
        rows: dict[str, list] = {name: [] for name in RESULT_SCHEMA.fieldNames()}
        for doc_id, words, lo, hi in docs:
            intervals = merge_windows(repeated[lo:hi], window)
            kept, at, removed = [], 0, 0
            for s, e in intervals:
                kept += words[at:s]
                removed += e - s
                at = e
            kept += words[at:]
            rows["doc_id"].append(doc_id)
            rows["n_words"].append(len(words))
            rows["n_removed"].append(removed)
            rows["intervals"].append(intervals)
            rows["kept_text"].append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        return pa.table(
            {
                "doc_id": pa.array(rows["doc_id"], pa.int64()),
                "n_words": pa.array(rows["n_words"], pa.int64()),
                "n_removed": pa.array(rows["n_removed"], pa.int64()),
                "intervals": pa.array(rows["intervals"], pa.list_(pa.list_(pa.int32()))),
                "kept_text": pa.array(rows["kept_text"], pa.string()),
            }
        )

    return of_part


def part_numbers(ids: np.ndarray, bounds: list[int], low: int, high: int, split: int) -> np.ndarray:
    """Parts in the order of ids: ranges up to each of ``bounds``, each cut into ``split``
    equally wide pieces."""
    ends = np.array([*bounds, high], np.int64)
    starts = np.array([low, *(b + 1 for b in bounds)], np.int64)
    place = np.searchsorted(ends[:-1], ids, "left")
    width = np.maximum(1.0, (ends - starts).astype(float) + 1)
    piece = np.floor((ids - starts[place]).astype(float) / width[place] * split)
    return place * split + np.clip(piece, 0, split - 1).astype(np.int64)


def _number_parts(bounds: list[int], low: int, high: int, split: int):
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.fill_null(high).to_numpy(zero_copy_only=False)
            part = part_numbers(known, bounds, low, high, split)
            # rows without id come last
            last = (len(bounds) + 1) * split - 1
            part = np.where(ids.is_null().to_numpy(zero_copy_only=False), last, part)
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column("text"), pa.array(part.astype(np.int32))],
                names=["doc_id", "text", "part"],
            )

    return number


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_bytes: int = 8 << 20,
) -> DataFrame:
    """Texts without their repeated windows.

    Returns per document doc_id, n_words, n_removed, intervals (of word offsets,
    end exclusive) and kept_text (kept words joined by one space).  ``part_bytes``
    is the text that a task holds at a time; one document is never split.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width = shuffle_width(spark)
    n_parts = max(width, -(-total // part_bytes))
    # every part sends a run to every bucket, so buckets hold more than parts
    bucket_bits = power_of_two(max(2, width, total // (4 * part_bytes))).bit_length() - 1
    ranges = min(n_parts, RANGES)
    quantiles = [i / ranges for i in range(1, ranges)] or [1.0]
    bounds, low, high = base.agg(
        F.percentile_approx("doc_id", quantiles, 10 * ranges), F.min("doc_id"), F.max("doc_id")
    ).first()
    inner = sorted(b for b in set(bounds or ()) if b < high)
    parted = base.mapInArrow(
        _number_parts(inner, low or 0, high or 0, -(-n_parts // ranges)),
        "doc_id long, text string, part int",
    )
    runs = parted.groupBy("part").applyInArrow(_runs(window, bucket_bits), RUN_SCHEMA)
    answers = runs.groupBy("bucket").applyInArrow(_earlier_elsewhere, ANSWER_SCHEMA)
    return (
        parted.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(_cut(window, bucket_bits), RESULT_SCHEMA)
    )


def digest_rows(result: DataFrame) -> DataFrame:
    return result.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )
