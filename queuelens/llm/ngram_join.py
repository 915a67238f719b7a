"""Exact n-gram Jaccard self-join by PartEnum signatures.

Documents are sets of word n-grams; two link when 100 * |A and B| >= percent *
|A or B|.  The result names the connected components of all links.

Signatures
----------
Sets are banded by size, so that two linkable sets meet in at least one band.
In a band, the domain of n-gram hashes is cut into equally wide parts.  A signature
is the hash of a set's members in one part, empty parts left out.  Linked sets
differ in few members, and each differing member spoils one part, so of its N
signatures a set of n members lacks at most ``n * (100 - percent) / percent`` in any
linked set.  It may therefore skip its most frequent signatures, as many as leave one
more than that number, and still meet every linked set: both skip by the same order,
by frequency among all documents.  Signatures of passages that stand in many documents
are skipped this way, those that nobody shares need not be looked at again, and what is
left joins hardly any sets that do not link.  The rare set whose members crowd into too
few parts skips none and also gives every member as a signature of its own.

Plan
----
1. One scan: size, digest and number of signatures to skip of every set.
2. One scan: all signatures, packed by bucket of their domain; equal sets of a block of
   documents give theirs once.  Buckets return those that repeat, with their frequency.
3. Each document skips its most frequent ones; the others link it to the smallest id with
   the same signature (a star, not pairs).  Components of these candidates bound which
   documents can link at all.  Copies are represented by one document.
4. Sets of a candidate component are compared in a task by an inverted index.
   A component too large for one task is cut into chunks that share a few leaders;
   documents outside the largest group found so are then compared, in blocks,
   with every chunk.

Defined results: texts with fewer than n words are one n-gram of the whole
sequence; null or blank texts link with nothing; rows that share an id count as
one document per distinct text, which all carry the id; rows without id are
left out; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from queuelens.llm.graph import components
from queuelens.llm.stages import (
    Stages,
    power_of_two,
    shuffle_width,
    small_batches,
    text_or_empty,
    without_ids,
)
from queuelens.llm.tokens import mix, rolling_hash, word_hashes

WORDS = 5
PERCENT = 75
#: Ratio between the largest and smallest set that a band is made for.
BAND = 3
#: Parts of the domain for each member of the largest set in a band.
PARTS_PER_MEMBER = 0.75
BLOCK_BYTES = 4 << 20


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; A-Z count as a-z."""
    found = word_hashes(split_words_lower(text))
    if 0 < len(found) < words:
        return mix(rolling_hash(found, len(found)) + np.uint64(len(found)))
    return np.unique(rolling_hash(found, words))


def split_words_lower(text: str) -> list[bytes]:
    # bytes.lower changes A to Z only
    return text.encode("utf-8", "surrogatepass").lower().split()


def allowed_difference(size: int, percent: int) -> int:
    """The most signatures that a linked set of any size can lack."""
    return size * (100 - percent) // percent


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, parts) in which a set of ``size`` takes part: the band of its own
    size, and the one below if a smaller set there can still link with it."""
    low, number = 1, 0
    while size >= low * BAND:
        low *= BAND
        number += 1
    out = [(number, _parts(low * BAND - 1, percent))]
    if number and size <= (low - 1) * 100 // percent:
        out.append((number - 1, _parts(low - 1, percent)))
    return out


def _parts(largest: int, percent: int) -> int:
    return max(1, int(PARTS_PER_MEMBER * (largest * 100 // percent)) + 1)


def signatures(members: np.ndarray, band: int, parts: int) -> np.ndarray:
    """Signatures of one set in one band; ``members`` are sorted and distinct."""
    # high part of the product: the part's number grows with the member
    top = members >> np.uint64(32)
    part = (top * np.uint64(parts)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    sums = np.add.reduceat(mix(members), starts)
    return mix(sums + mix(part[starts] + np.uint64(band << 40)))


def member_signatures(members: np.ndarray, band: int) -> np.ndarray:
    """One signature for each member, apart from those of the parts."""
    return mix(members + mix(np.array([(band << 40) + (1 << 39)], np.uint64)))


#: Packed columns are compressed before they are shuffled, which the shuffle does not do as well.
_CODEC = "zstd"


def _packed(planes: np.ndarray) -> bytes:
    """Rows of bytes, compressed; the first four bytes tell how many there were."""
    raw = planes.tobytes()
    return len(raw).to_bytes(4, "little") + pa.compress(raw, codec=_CODEC, asbytes=True)


def _unpacked(packed: bytes, rows: int) -> np.ndarray:
    size = int.from_bytes(packed[:4], "little")
    raw = pa.decompress(packed[4:], size, codec=_CODEC, asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(rows, -1)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bytes of equal weight together, one row for each."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T


def _from_planes(planes: np.ndarray, dtype) -> np.ndarray:
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def _blocks(batches: Iterator[pa.RecordBatch], words: int):
    """Lists of (doc_id, set) with about BLOCK_BYTES of text."""
    block, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            text = text.as_py()
            block.append((doc_id, shingle_set(text, words)))
            size += len(text)
            if size >= BLOCK_BYTES:
                yield block
                block, size = [], 0
    if block:
        yield block
    pa.default_memory_pool().release_unused()


def _digest(members: np.ndarray) -> bytes:
    return xxh3_128_digest(members.tobytes())


def _distinct_sets(block):
    """Of equal sets of a block, the one with the smallest id; empty ones are left out."""
    first: dict[bytes, tuple[int, np.ndarray]] = {}
    for doc_id, members in block:
        if len(members):
            key = _digest(members)
            if key not in first or doc_id < first[key][0]:
                first[key] = (doc_id, members)
    return list(first.values())


def skipped(size: int, found: int, percent: int) -> int:
    """How many of its ``found`` signatures in a band a set may skip."""
    return max(0, found - allowed_difference(size, percent) - 1)


def _describe(words: int, percent: int):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, words):
            skips = []
            for _, members in block:
                found = [
                    skipped(len(members), len(signatures(members, band, parts)), percent)
                    for band, parts in (bands(len(members), percent) if len(members) else ())
                ]
                skips.append(found + [0] * (2 - len(found)))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for d, _ in block], pa.int64()),
                    pa.array([len(m) for _, m in block], pa.int64()),
                    pa.array([_digest(m) for _, m in block], pa.binary()),
                    pa.array([x for x, _ in skips], pa.int32()),
                    pa.array([x for _, x in skips], pa.int32()),
                ],
                names=["doc_id", "size", "digest", "skip_own", "skip_below"],
            )

    return of_partition


def _emit(words: int, percent: int, bucket_bits: int):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, words):
            sigs, ids, below = [], [], []
            for doc_id, members in _distinct_sets(block):
                for place, (band, parts) in enumerate(bands(len(members), percent)):
                    found = signatures(members, band, parts)
                    if len(found) <= allowed_difference(len(members), percent):
                        found = np.concatenate([found, member_signatures(members, band)])
                    sigs.append(found)
                    ids.append(np.full(len(found), doc_id, np.int64))
                    below.append(np.full(len(found), place, np.uint8))
            if not sigs:
                continue
            sig = np.concatenate(sigs)
            order = np.argsort(sig)
            sig, doc, low = sig[order], np.concatenate(ids)[order], np.concatenate(below)[order]
            bucket = (sig >> np.uint64(64 - bucket_bits)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            spans = list(zip(cuts, np.r_[cuts[1:], len(sig)]))
            # 32 more bits tell signatures apart; a false match costs a comparison, no more
            short = (sig >> np.uint64(32 - bucket_bits)).astype(np.uint32)
            # they are sorted, so that steps between them are small; ids of a block are alike too
            planes = np.concatenate([_planes(doc), low[None]])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(bucket[cuts].astype(np.int32)),
                    pa.array([_packed(_planes(np.diff(short[s:e], prepend=np.uint32(0)))) for s, e in spans], pa.binary()),
                    pa.array([_packed(planes[:, s:e]) for s, e in spans], pa.binary()),
                ],
                names=["bucket", "sigs", "docs"],
            )

    return of_partition


def _repeated(key: tuple, table: pa.Table) -> pa.Table:
    """Signatures of a bucket that more than one document has, with their frequency."""
    steps = (_from_planes(_unpacked(x.as_py(), 4), np.uint32) for x in table.column("sigs"))
    sig = np.concatenate([np.cumsum(x, dtype=np.uint32) for x in steps])
    planes = np.concatenate([_unpacked(x.as_py(), 9) for x in table.column("docs")], axis=1)
    order = np.argsort(sig, kind="stable")
    sig = sig[order]
    new = np.r_[True, sig[1:] != sig[:-1]]
    count = np.diff(np.r_[np.flatnonzero(new), len(sig)])[np.cumsum(new) - 1]
    often = count > 1
    order = order[often]
    doc = _from_planes(planes[:8, order], np.int64)
    return pa.table(
        {
            "doc_id": pa.array(doc, pa.int64()),
            "below": pa.array(planes[8, order].astype(bool)),
            "signature": pa.array((np.int64(key[0].as_py()) << 32) + sig[often].astype(np.int64)),
            "documents": pa.array(count[often].astype(np.int32)),
        }
    )


class SetIndex:
    """Inverted index over the sets of one task."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        values, at = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(at, kind="stable")
        self.values = values
        self.owner = owner[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(at, minlength=len(values)))]

    def linked(self, members: np.ndarray) -> np.ndarray:
        """Numbers of the sets that link with ``members``."""
        at = np.searchsorted(self.values, members)
        at[at == len(self.values)] = 0
        at = at[self.values[at] == members]
        if not len(at):
            return at
        lo, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        offset = np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
        shared = np.bincount(self.owner[offset + np.arange(n.sum())], minlength=len(self.sizes))
        union = self.sizes + len(members) - shared
        return np.flatnonzero((100 * shared >= self.percent * union) & (shared > 0))


def link_groups(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """The smallest number linked, directly or not, with each set."""
    index = SetIndex(sets, percent)
    label = np.full(len(sets), -1)
    waiting = set(range(len(sets)))
    for root in range(len(sets)):
        if label[root] >= 0:
            continue
        label[root] = root
        waiting.discard(root)
        front = [root]
        while front and waiting:
            if len(front) <= len(waiting):
                found = [int(x) for x in index.linked(sets[front.pop()]) if label[x] < 0]
            else:
                # fewer sets wait than could reach them: look from their side
                found = [x for x in waiting if (label[index.linked(sets[x])] == root).any()]
                front = []
            for x in found:
                label[x] = root
                waiting.discard(x)
            front += found
    return label


def _compare(words: int, percent: int):
    def in_task(key: tuple, table: pa.Table) -> pa.Table:
        ids = np.array(table.column("doc_id").to_pylist(), np.int64)
        cluster = np.array(table.column("cluster").to_pylist(), np.int64)
        texts = table.column("text")
        a, b = [], []
        order = np.lexsort((ids, cluster))
        cuts = np.flatnonzero(np.r_[True, cluster[order][1:] != cluster[order][:-1]])
        for s, e in zip(cuts, np.r_[cuts[1:], len(order)]):
            own = order[s:e]
            label = link_groups([shingle_set(texts[int(i)].as_py(), words) for i in own], percent)
            child = np.flatnonzero(label != np.arange(len(own)))
            a.append(ids[own[child]])
            b.append(ids[own[label[child]]])
        return pa.table(
            {
                "a": pa.array(np.concatenate(a) if a else [], pa.int64()),
                "b": pa.array(np.concatenate(b) if b else [], pa.int64()),
            }
        )

    return in_task


def _compare_rest(words: int, percent: int):
    def in_task(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        chunk = [r for r in rows if not r["rest"]]
        rest = [r for r in rows if r["rest"]]
        a, b = [], []
        if chunk and rest:
            index = SetIndex([shingle_set(r["text"], words) for r in chunk], percent)
            for r in rest:
                groups: dict[int, int] = {}
                for x in index.linked(shingle_set(r["text"], words)):
                    groups.setdefault(chunk[x]["group"], chunk[x]["doc_id"])
                groups.pop(r["group"], None)
                a += [r["doc_id"]] * len(groups)
                b += groups.values()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return in_task


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    percent: int = PERCENT,
    id_col: str = "doc_id",
    text_col: str = "text",
    task_members: int = 1 << 20,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every document.

    ``task_members`` is the number of set members compared in one task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stages = Stages(spark, "ngram-join")
    width = shuffle_width(spark)
    base = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")
    )
    sizes = stages.write(
        base.mapInArrow(
            _describe(words, percent),
            "doc_id long, size long, digest binary, skip_own int, skip_below int",
        ),
        "sizes",
    )
    members = sizes.agg(F.sum("size")).first()[0] or 0
    bucket_bits = power_of_two(max(64, width, members // (1 << 20)), 1 << 31).bit_length() - 1
    repeated = (
        base.mapInArrow(
            _emit(words, percent, bucket_bits), "bucket int, sigs binary, docs binary"
        )
        .groupBy("bucket")
        .applyInArrow(_repeated, "doc_id long, below boolean, signature long, documents int")
    )
    skips = sizes.groupBy("doc_id").agg(
        F.min("skip_own").alias("skip_own"), F.min("skip_below").alias("skip_below")
    )
    # a set has no more signatures than members, so these windows are as large as a text; dealt
    # by document, they need no shuffle after that of the join
    most_frequent = Window.partitionBy("doc_id", "below").orderBy(F.desc("documents"), "signature")
    leading = (
        repeated.repartition("doc_id")
        .withColumn("place", F.row_number().over(most_frequent))
        .join(skips, "doc_id")
        .where(F.col("place") > F.when(F.col("below"), F.col("skip_below")).otherwise(F.col("skip_own")))
        .select("signature", "doc_id")
    )
    leading = stages.write(leading, "leading")
    # written, so that the joins below deal both sides anew and can split a hot key
    smallest = stages.write(
        leading.groupBy("signature").agg(F.min("doc_id").alias("b")), "smallest"
    )
    candidates = leading.join(smallest, "signature").where("doc_id <> b").select(
        F.col("doc_id").alias("a"), "b"
    )

    # copies hang on the smallest id with the same set
    copies = stages.write(
        sizes.where("size > 0")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .drop("n"),
        "repeated-sets",
    )
    copy_links = stages.write(
        sizes.where("size > 0").join(copies, "digest").where("doc_id <> b").select(
            F.col("doc_id").alias("a"), "b"
        ),
        "copies",
    )
    clusters = components(candidates.union(copy_links), stages, "candidates")
    # one document for each distinct set stands for its copies; a document with several rows
    # stands aside only if each of its sets has such a document
    aside = (
        sizes.where("size > 0")
        .join(copies, "digest", "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce(F.col("doc_id") != F.col("b"), F.lit(False))).alias("all_copies"))
        .where("all_copies")
    )
    standing = stages.write(
        clusters.withColumnRenamed("id", "doc_id")
        .join(aside, "doc_id", "left_anti")
        .join(sizes.groupBy("doc_id").agg(F.max("size").alias("size")), "doc_id")
        .withColumnRenamed("component", "cluster"),
        "standing",
    )
    for table in (leading, smallest, copies):
        stages.remove(table)
    loads = standing.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("members")
    )
    loads = stages.write(loads.where("docs > 1"), "loads")
    in_small = F.col("members") <= task_members
    compared = standing.join(loads, "cluster")
    bins = max(width, -(-members // task_members))
    small = compared.where(in_small).select(
        "doc_id", "cluster", F.pmod(F.xxhash64("cluster"), F.lit(bins)).alias("task"), F.lit(0).alias("chunk")
    )
    chunks = F.ceil(F.col("members") / task_members).cast("long")
    large = compared.where(~in_small).select(
        "doc_id",
        "cluster",
        F.col("cluster").alias("task"),
        F.pmod(F.xxhash64("doc_id"), chunks).alias("chunk"),
        chunks.alias("chunks"),
        (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("docs")) < 8).alias("leads"),
    )
    n_large = loads.where(~in_small).count()
    first = small.withColumn("kind", F.lit(0))
    if n_large:
        # a few leaders stand in every chunk of their cluster
        spread = large.select(
            "doc_id",
            "cluster",
            "task",
            F.explode(
                F.when(F.col("leads"), F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).otherwise(
                    F.array("chunk")
                )
            ).alias("chunk"),
        )
        first = first.union(spread.withColumn("kind", F.lit(1)))
    texts = base.join(first, "doc_id")
    links = stages.write(
        texts.groupBy("kind", "task", "chunk").applyInArrow(_compare(words, percent), "a long, b long"),
        "links",
    )
    found = links
    if n_large:
        found = found.union(
            _rest_links(base, large, links, stages, words, percent, task_members)
        )
    final = components(found.union(copy_links), stages, "components")
    return (
        sizes.join(final.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id",
            F.col("size").alias("n_shingles"),
            F.coalesce("component", "doc_id").alias("component_id"),
        )
    )


def _rest_links(base, large, links, stages, words, percent, task_members) -> DataFrame:
    """Links of the documents outside the largest group of a large cluster with
    every document of the cluster."""
    groups = components(links, stages, "groups").withColumnRenamed("id", "doc_id")
    placed = stages.write(
        large.join(groups, "doc_id", "left").select(
            "doc_id", "cluster", "chunk", "chunks", F.coalesce("component", "doc_id").alias("group")
        ),
        "placed",
    )
    counted = placed.groupBy("cluster", "group").agg(F.count(F.lit(1)).alias("n"))
    main = counted.groupBy("cluster").agg(F.max_by("group", F.struct("n", "group")).alias("main"))
    with_main = placed.join(main, "cluster")
    rest = with_main.where("group <> main")
    per_block = rest.groupBy("cluster").agg(F.count(F.lit(1)).alias("rest"))
    # as many blocks of the rest as their share of the cluster's chunks
    totals = placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("all"))
    blocks = per_block.join(totals, "cluster")
    both = with_main.join(blocks, "cluster").withColumn(
        "blocks", F.ceil(F.col("rest") * F.col("chunks") / F.col("all")).cast("long")
    )
    zero = F.lit(0).cast("long")
    chunk_side = both.select(
        "doc_id", "group", F.lit(False).alias("rest"), "cluster", "chunk",
        F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"),
    )
    rest_side = both.where("group <> main").select(
        "doc_id", "group", F.lit(True).alias("rest"), "cluster",
        F.explode(F.sequence(zero, F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("blocks")).alias("block"),
    )
    return stages.write(
        base.join(chunk_side.union(rest_side), "doc_id")
        .groupBy("cluster", "chunk", "block")
        .applyInArrow(_compare_rest(words, percent), "a long, b long"),
        "rest-links",
    )


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """Rows of ``docs`` without those that link, directly or not, to a smaller id."""
    groups = jaccard_components(docs, id_col=id_col, text_col=text_col, **options)
    return without_ids(docs, groups.where("component_id <> doc_id").select("doc_id"), id_col)
