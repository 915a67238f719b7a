"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Index
-----
1. Equal vectors are one node, named by their smallest id; its copies come back at the end, so
   that a vector that a third of all rows share is one node like any other.
2. A bounded sample of ``sample`` nodes, the first by hash, gives split points of random
   projections (and, later, the places where searches enter).  Its size does not grow.
3. First graph: ``trees`` times, nodes fall into groups by the sides of random projections on
   which they lie; groups that turn out large are cut by hash.  In each group every node takes
   its nearest few.
4. Rounds of NN-descent: each node u gathers its neighbours and up to ``reverse`` of the nodes
   that have it as neighbour (a sample by hash, as the method has it, which keeps hubs
   bounded).  Pairs of those, at least one of them new to u, are neighbours of neighbours:
   each is offered the nearest of the others that improve its list.  Nodes near each other by
   projections share a block, and a block gets a vector once however many of its nodes
   gather it, so the shuffle carries blocks times distinct members, not every pair.
   There are ``rounds`` of them, fewer if lists stop changing.

Search
------
A query enters at the nearest nodes of the sample, and at its own node if it is a row of the
index, and keeps the ``beam`` nearest nodes seen.  Every round follows the edges, of either
direction, of the best ones not yet followed; what they lead to is collected per query and
block and measured where the block's vectors are, in double precision on original values.
It ends when all of every beam has been followed.  No graph and no vector passes the driver.

Defined results: rows with a null id or vector, with a component that is null or not finite,
empty and zero vectors take no part, neither as queries nor as candidates.  Shorter vectors
are continued with zeros.  Of rows that share an id, the one with the smallest vector takes
part.  A query without candidates gives no row; an empty table gives no row.  Other columns
are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.stages import Stages


@dataclass(frozen=True)
class GraphSettings:
    neighbours: int = 32
    reverse: int = 32
    trees: int = 8
    group: int = 1_024
    block: int = 2_048
    sample: int = 2_048
    rounds: int = 6
    #: rounds end when at most this share of all list entries is new
    least_change: float = 0.0
    beam: int = 160
    starts: int = 8
    #: nodes of a beam that are followed in a round
    width: int = 40
    seed: int = 7


@dataclass
class Index:
    """Written tables of an index, and its bounded sample."""

    stages: Stages
    settings: GraphSettings
    dim: int
    nodes: DataFrame  # node, block, vec
    graph: DataFrame  # node, near: array of (id, block)
    copies: DataFrame  # id, node, of nodes with several ids
    sample_ids: np.ndarray
    sample: np.ndarray


def usable(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of the rows that take part, one per id."""
    kind = rows.select(vec_col).schema[0].dataType.elementType.simpleString()
    element = kind if kind in ("float", "double") else "double"
    some = rows.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{element}>").alias("vec")
    ).where(
        F.col("id").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0)
    )
    return some.groupBy("id").agg(F.min("vec").alias("vec"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int, kind=np.float64) -> np.ndarray:
    """A list column as a matrix, with zeros after short rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets)
    if len(flat) == len(sizes) * dim:
        return flat.reshape(len(sizes), dim).astype(kind)
    out = np.zeros((len(sizes), dim), kind)
    out[np.arange(dim)[None, :] < sizes[:, None]] = flat
    return out


def _bits(n: int, size: int) -> int:
    return max(0, ceil(np.log2(max(1, n / size))))


def _with_codes(nodes: DataFrame, dim: int, planes: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """Nodes with, per tree, the number of their group: a bit for each projection's side."""
    weights = 1 << np.arange(planes.shape[1], dtype=np.int64)[::-1]

    def coded(batches):
        for batch in batches:
            vecs = _matrix(batch.column("vec"), dim)
            sides = np.einsum("nd,tbd->ntb", vecs, planes) > cuts
            codes = sides.astype(np.int64) @ weights
            lists = pa.ListArray.from_arrays(
                np.arange(0, codes.size + 1, planes.shape[0], dtype=np.int32), codes.ravel()
            )
            columns = [batch.column("node"), batch.column("vec"), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "vec", "codes"])

    kind = dict(nodes.dtypes)["vec"]
    return nodes.select("node", "vec").mapInArrow(coded, f"node long, vec {kind}, codes array<long>")


def _cut(df: DataFrame, by: list[str], size: int, name: str) -> DataFrame:
    """``name``: a number that cuts groups of more than ``size`` rows by hash of the node."""
    counts = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    part = F.pmod(F.xxhash64("node", *by), F.col("_parts")).alias(name)
    return df.join(counts, by).select(*df.columns, part)


def _nearest_in_groups(members: DataFrame, dim: int, k: int) -> DataFrame:
    """(node, ids, dists): the nearest k of each node's group, per group."""

    def nearest(table: pa.Table) -> pa.Table:
        ids, vecs = table.column("node").to_numpy(), _matrix(table.column("vec"), dim)
        vecs = vecs - vecs.mean(axis=0)
        norms = np.einsum("ij,ij->i", vecs, vecs)
        most = min(k, len(ids) - 1)
        names, dists = [], []
        for at in range(0, len(ids), 1024):
            part = slice(at, at + 1024)
            d = norms[part, None] + norms[None] - 2 * (vecs[part] @ vecs.T)
            d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
            top = np.argpartition(d, most - 1, axis=1)[:, :most] if most else np.empty((len(d), 0), int)
            names.append(ids[top])
            dists.append(np.take_along_axis(d, top, axis=1))
        return _lists(ids, np.concatenate(names), np.concatenate(dists))

    return members.groupBy("tree", "code", "part").applyInArrow(
        nearest, "node long, ids array<long>, dists array<double>"
    )


def _lists(nodes: np.ndarray, ids: np.ndarray, dists: np.ndarray) -> pa.Table:
    offsets = np.arange(0, ids.size + 1, ids.shape[1], dtype=np.int32) if ids.shape[1] else np.zeros(
        len(nodes) + 1, np.int32
    )
    return pa.table({
        "node": nodes, "ids": pa.ListArray.from_arrays(offsets, pa.array(ids.ravel(), pa.int64())),
        "dists": pa.ListArray.from_arrays(offsets, pa.array(dists.ravel(), pa.float64())),
    })


def _ranks(groups: np.ndarray) -> np.ndarray:
    """Of sorted groups, each entry's number in its group."""
    first = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    sizes = np.diff([*first, len(groups)])
    return np.arange(len(groups)) - np.repeat(first, sizes)


def _best(node: np.ndarray, other: np.ndarray, dist: np.ndarray, old: np.ndarray, k: int):
    """The first k distinct others of each node by (distance, id); an old entry stays old."""
    order = np.lexsort((~old, other, node))
    node, other, dist, old = node[order], other[order], dist[order], old[order]
    new = np.concatenate(([True], (node[1:] != node[:-1]) | (other[1:] != other[:-1])))[: len(node)]
    node, other, dist, old = node[new], other[new], dist[new], old[new]
    order = np.lexsort((other, dist, node))
    node, other, dist, old = node[order], other[order], dist[order], old[order]
    ok = _ranks(node) < k if len(node) else np.empty(0, bool)
    return node[ok], other[ok], dist[ok], old[ok]


LIST_SCHEMA = (
    "node long, block long, ids array<long>, dists array<double>, olds array<boolean>, kth double, "
    "n_new long"
)


def _packed(lists: DataFrame, old: bool) -> DataFrame:
    """Rows of one node each as rows of ``_merged``'s input."""
    return lists.select(
        "block",
        F.array("node").alias("nodes"),
        F.array(F.size("ids")).alias("sizes"),
        "ids",
        "dists",
        F.lit(old).alias("old"),
    )


OFFER_SCHEMA = "block long, nodes array<long>, sizes array<int>, ids array<long>, dists array<double>"


def _merged(offers: DataFrame, k: int) -> DataFrame:
    """One list per node, the best of all its lists and offers.

    Rows are (block, nodes, sizes, ids, dists, old): lists of several nodes of a block, one
    after the other, each as long as ``sizes`` says.
    """

    def merge(table: pa.Table) -> pa.Table:
        flat = {
            c: table.column(c).combine_chunks().flatten().to_numpy()
            for c in ("nodes", "sizes", "ids", "dists")
        }
        entries = np.diff(table.column("ids").combine_chunks().offsets)
        olds = np.repeat(table.column("old").to_numpy(zero_copy_only=False).astype(bool), entries)
        node, other, dist, old = _best(
            np.repeat(flat["nodes"], flat["sizes"]), flat["ids"], flat["dists"], olds, k
        )
        names = np.unique(flat["nodes"])
        ends = np.searchsorted(node, names, side="right").astype(np.int32)
        offsets = np.concatenate(([0], ends)).astype(np.int32)
        full = np.diff(offsets) >= k
        kth = np.where(full, dist[np.maximum(ends - 1, 0)] if len(dist) else np.inf, np.inf)
        fresh = np.concatenate(([0], np.cumsum(~old)))
        return pa.table({
            "node": names, "block": np.full(len(names), table.column("block")[0].as_py()),
            "ids": pa.ListArray.from_arrays(offsets, pa.array(other, pa.int64())),
            "dists": pa.ListArray.from_arrays(offsets, pa.array(dist, pa.float64())),
            "olds": pa.ListArray.from_arrays(offsets, pa.array(old)),
            "kth": kth, "n_new": fresh[offsets[1:]] - fresh[offsets[:-1]],
        })

    return offers.groupBy("block").applyInArrow(merge, LIST_SCHEMA)


def _edges(lists: DataFrame, blocks: DataFrame, reverse: int, turn: int) -> DataFrame:
    """(block, node, member, old): what each node gathers, both directions."""
    pair = F.explode(F.arrays_zip("ids", "olds")).alias("e")
    forward = lists.select("node", "block", pair)
    forward = forward.select(
        "block", "node", F.col("e.ids").alias("member"), F.col("e.olds").alias("old")
    )
    some = Window.partitionBy("member").orderBy(F.xxhash64("node", "member", F.lit(turn)), "node")
    back = forward.withColumn("_r", F.row_number().over(some)).where(F.col("_r") <= reverse)
    back = back.select(F.col("member").alias("node"), F.col("node").alias("member"), "old")
    back = back.join(blocks, "node").select("block", "node", "member", "old")
    return forward.union(back)


def _needed(edges: DataFrame, nodes: DataFrame, lists: DataFrame, dim: int) -> DataFrame:
    """What blocks gather: (at_block, block, ids, kths, vecs), a row for each pair of blocks.

    A member is one row until it is packed, with all the blocks that gather it.
    """
    element = dict(nodes.dtypes)["vec"]

    def pack(table: pa.Table) -> pa.Table:
        ids, kth = table.column("node").to_numpy(), table.column("kth").to_numpy()
        vecs = _matrix(table.column("vec"), dim)
        wanted = table.column("at_blocks").combine_chunks()
        row = np.repeat(np.arange(len(ids)), np.diff(wanted.offsets))
        block = wanted.flatten().to_numpy()
        order = np.argsort(block, kind="stable")
        to, starts = np.unique(block[order], return_index=True)
        rows = [row[part] for part in np.split(order, starts[1:])]
        return pa.table({
            "at_block": pa.array(to, pa.int64()),
            "block": np.full(len(to), table.column("block")[0].as_py()),
            "ids": pa.array([ids[r] for r in rows], pa.list_(pa.int64())),
            "kths": pa.array([kth[r] for r in rows], pa.list_(pa.float64())),
            "vecs": pa.array([vecs[r].ravel() for r in rows], pa.list_(pa.float64())).cast(
                pa.list_(pa.float32() if "float" in element else pa.float64())
            ),
        })

    members = edges.groupBy("member").agg(F.collect_set("block").alias("at_blocks"))
    kth = lists.select(F.col("node").alias("of"), "kth")
    rows = members.join(nodes, F.col("member") == F.col("node")).join(kth, F.col("member") == F.col("of"))
    return (
        rows.select("node", "block", "vec", "kth", "at_blocks")
        .groupBy("block")
        .applyInArrow(
            pack, f"at_block long, block long, ids array<long>, kths array<double>, vecs {element}"
        )
    )


def _offers(edges: DataFrame, needed: DataFrame, dim: int, k: int) -> DataFrame:
    """Nearer neighbours found among neighbours of neighbours, packed by the block they go to."""

    def local_join(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([
            ("block", pa.int64()), ("nodes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())),
            ("ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64())),
        ])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        packed = {c: right.column(c).combine_chunks() for c in ("ids", "kths", "vecs")}
        homes = np.repeat(right.column("block").to_numpy(), np.diff(packed["ids"].offsets))
        ids, kth, vecs = (packed[c].flatten().to_numpy() for c in ("ids", "kths", "vecs"))
        vecs = vecs.reshape(len(ids), dim).astype(np.float64)
        order = np.argsort(ids)
        ids, home, vecs, kth = ids[order], homes[order], vecs[order], kth[order]
        node, member = left.column("node").to_numpy(), left.column("member").to_numpy()
        old = left.column("old").to_numpy(zero_copy_only=False).astype(bool)
        node, member, _, old = _best(node, member, np.zeros(len(node)), old, len(node))
        at = np.searchsorted(ids, member)
        rank = _ranks(node)
        row = np.cumsum(rank == 0) - 1
        width = int(rank.max()) + 1
        table = np.full((row[-1] + 1, width), -1)
        table[row, rank] = at
        new = np.zeros(table.shape, bool)
        new[row, rank] = ~old
        keep = new.any(axis=1)
        table, new = table[keep], new[keep]
        found: list[tuple[np.ndarray, ...]] = []
        step = max(1, (4 << 20) // (width * max(width, dim)))
        for s in range(0, len(table), step):
            some, fresh = table[s : s + step], new[s : s + step]
            there = some >= 0
            v = vecs[some]
            v -= (v * there[..., None]).sum(1, keepdims=True) / there.sum(1)[:, None, None]
            norms = np.einsum("umd,umd->um", v, v)
            d = norms[:, :, None] + norms[:, None, :] - 2 * (v @ v.transpose(0, 2, 1))
            ok = there[:, :, None] & there[:, None, :] & (fresh[:, :, None] | fresh[:, None, :])
            ok &= ~np.eye(width, dtype=bool)
            ok &= d < kth[some][:, :, None]
            u, a, b = np.nonzero(ok)
            found.append((some[u, a], some[u, b], np.maximum(d[u, a, b], 0)))
            if sum(len(f[0]) for f in found) > 1 << 21:
                found = [_kept(found, k)]
        first, second, dist = _kept(found, k) if found else (np.empty(0, int),) * 3
        order = np.argsort(home[first], kind="stable")  # by block, and by node in it
        first, second, dist = first[order], second[order], dist[order]
        blocks, starts = np.unique(home[first], return_index=True)
        rows = []
        for to, start, end in zip(blocks.tolist(), starts, [*starts[1:], len(first)]):
            names, sizes = np.unique(first[start:end], return_counts=True)
            rows.append({
                "block": to, "nodes": ids[names], "sizes": sizes,
                "ids": ids[second[start:end]], "dists": dist[start:end],
            })
        return pa.Table.from_pylist(rows, schema)

    return (
        edges.groupBy("block")
        .cogroup(needed.groupBy("at_block"))
        .applyInArrow(local_join, OFFER_SCHEMA)
    )


def _kept(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    first, second, dist = (np.concatenate(part) for part in zip(*found))
    return _best(first, second, dist, np.zeros(len(first), bool), k)[:3]


def build_index(
    rows: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    settings: GraphSettings = GraphSettings(),
) -> Index:
    """The neighbour graph over all rows that take part."""
    s, spark = settings, rows.sparkSession
    stages = Stages(spark, "nn-descent")
    ready = stages.write(usable(rows, id_col, vec_col), "rows")
    distinct = ready.groupBy("vec").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n"))
    distinct = stages.write(distinct, "distinct")
    shared = distinct.where("n > 1").select("vec", "node")
    copies = stages.write(ready.join(shared, "vec").select("id", "node"), "copies")
    n, dim = distinct.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    dim = dim or 1
    taken = distinct.orderBy(F.xxhash64("node"), "node").select("node", "vec").limit(s.sample)
    taken = taken.toArrow()
    sample_ids, sample = taken.column("node").to_numpy(), _matrix(taken.column("vec"), dim)
    bits, block_bits = _bits(n, s.group), _bits(n, s.block)
    rng = np.random.default_rng(s.seed)
    planes = rng.standard_normal((s.trees, bits, dim))
    cuts = np.median(np.einsum("nd,tbd->ntb", sample, planes), axis=0) if len(sample) else 0.0
    coded = _with_codes(distinct, dim, planes, np.asarray(cuts))
    coded = coded.withColumn(
        "code", F.shiftright(F.col("codes")[0], bits - block_bits)
    )
    coded = stages.write(_cut(coded, ["code"], s.block, "part"), "codes")
    # a block is a group of the first projections, cut where it is large
    block = F.pmod(F.xxhash64("code", "part"), F.lit(2**62)).alias("block")
    nodes = stages.write(coded.select("node", block, "vec"), "nodes")
    blocks = nodes.select("node", "block")
    trees = coded.select("node", "vec", F.posexplode("codes").alias("tree", "code"))
    groups = _cut(trees, ["tree", "code"], s.group, "part")
    first = _nearest_in_groups(groups, dim, max(2, s.neighbours // 2)).join(blocks, "node")
    lists = stages.write(_merged(_packed(first, old=False), s.neighbours), "lists")
    for turn in range(s.rounds):
        edges = stages.write(_edges(lists, blocks, s.reverse, turn), "edges")
        needed = _needed(edges, nodes, lists, dim)
        offers = _offers(edges, needed, dim, s.neighbours).withColumn("old", F.lit(False))
        both = _packed(lists, old=True).unionByName(offers)
        following = stages.write(_merged(both, s.neighbours), "lists")
        stages.remove(lists)
        stages.remove(edges)
        lists = following
        changed = lists.agg(F.sum("n_new")).first()[0] or 0
        if changed <= s.least_change * n * s.neighbours:
            break
    both = _edges(lists, blocks, s.reverse, s.rounds).select("node", F.col("member").alias("id"))
    homes = blocks.withColumnRenamed("node", "id")
    both = both.distinct().join(homes, "id").groupBy("node")
    graph = stages.write(both.agg(F.collect_list(F.struct("id", "block")).alias("near")), "graph")
    for table in (lists, coded, distinct):
        stages.remove(table)
    return Index(stages, s, dim, nodes, graph, copies, sample_ids, sample)


def _entries(queries: DataFrame, index: Index) -> DataFrame:
    """(query, node) of the sample's nodes nearest to each query."""
    ids, sample, dim, starts = index.sample_ids, index.sample, index.dim, index.settings.starts

    def nearest(batches):
        for batch in batches:
            vecs, own = _matrix(batch.column("vec"), dim), batch.column("query").to_numpy()
            most = min(starts, len(ids))
            if not len(own) or not most:
                continue
            d = (sample**2).sum(1)[None] - 2 * (vecs @ sample.T)
            top = np.argpartition(d, most - 1, axis=1)[:, :most]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(own, most)), pa.array(ids[top].ravel())], ["query", "node"]
            )

    return queries.select("query", "vec").mapInArrow(nearest, "query long, node long")


def _measured(asked: DataFrame, queries: DataFrame, index: Index) -> DataFrame:
    """(query, node, dist) of candidates (query, node, block): Euclidean, in double precision."""
    dim = index.dim

    def measure(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            ids = right.column("node").to_numpy()
            order = np.argsort(ids)
            ids, vecs = ids[order], _matrix(right.column("vec"), dim)[order]
            points = _matrix(left.column("vec"), dim)
            for q, point, wanted in zip(
                left.column("query").to_pylist(), points, left.column("wanted").to_numpy()
            ):
                at = np.searchsorted(ids, wanted)
                dist = np.sqrt(((vecs[at] - point) ** 2).sum(axis=1))
                out.append((np.full(len(at), q), wanted, dist))
        parts = [np.concatenate(p) for p in zip(*out)] if out else [[], [], []]
        return pa.table({
            "query": pa.array(parts[0], pa.int64()), "node": pa.array(parts[1], pa.int64()),
            "dist": pa.array(parts[2], pa.float64()),
        })

    tasks = asked.groupBy("query", "block").agg(F.collect_set("node").alias("wanted"))
    tasks = tasks.join(queries, "query").select("query", "block", "wanted", "vec")
    homes = index.nodes.select(F.col("block").alias("at_block"), "node", "vec")
    return (
        tasks.groupBy("block")
        .cogroup(homes.groupBy("at_block"))
        .applyInArrow(measure, "query long, node long, dist double")
    )


def search(
    index: Index,
    rows: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row."""
    s, stages = index.settings, index.stages
    width = max(s.beam, k + 1)
    queries = usable(rows, id_col, vec_col).withColumnRenamed("id", "query")
    queries = stages.write(queries, "queries")
    blocks = index.nodes.select("node", "block")
    own = queries.join(index.copies, F.col("query") == F.col("id"), "left").select(
        "query", F.coalesce("node", "query").alias("node")
    )
    starts = _entries(queries, index).union(own).distinct().join(blocks, "node")
    by_distance = Window.partitionBy("query").orderBy("dist", "node")
    first = _measured(starts, queries, index).withColumn("open", F.lit(True))
    ranked = first.withColumn("rank", F.row_number().over(by_distance))
    beam = stages.write(ranked.where(F.col("rank") <= width), "beam")
    openings = Window.partitionBy("query", "open").orderBy("dist", "node")
    while not beam.where("open").isEmpty():
        turn = F.col("open") & (F.row_number().over(openings) <= s.width)
        marked = stages.write(beam.withColumn("turn", turn), "turn")
        near = marked.where("turn").join(index.graph, "node")
        near = near.select("query", F.explode("near").alias("e"))
        near = near.select("query", F.col("e.id").alias("node"), F.col("e.block").alias("block"))
        asked = near.distinct().join(marked.select("query", "node"), ["query", "node"], "left_anti")
        met = _measured(asked, queries, index).withColumn("open", F.lit(True))
        stay = marked.select("query", "node", "dist", (F.col("open") & ~F.col("turn")).alias("open"))
        ranked = stay.unionByName(met).withColumn("rank", F.row_number().over(by_distance))
        following = stages.write(ranked.where(F.col("rank") <= width), "beam")
        stages.remove(beam)
        stages.remove(marked)
        beam = following
    smallest = Window.partitionBy("node").orderBy("id")
    several = index.copies.withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1)
    found = beam.join(several.select("node", "id"), "node", "left")
    found = found.select("query", F.coalesce("id", "node").alias("vec_id"), "dist")
    order = Window.partitionBy("query").orderBy("dist", "vec_id")
    found = found.where(F.col("vec_id") != F.col("query"))
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select(
        F.col("query").alias("query_id"), "rank", "vec_id", F.col("dist").alias("score")
    )


def nearest(
    rows: DataFrame,
    queries: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    settings: GraphSettings = GraphSettings(),
) -> DataFrame:
    """The k nearest other rows of those rows that ``queries`` selects, among all rows."""
    index = build_index(rows, id_col, vec_col, settings)
    return search(index, rows.where(queries), k, id_col, vec_col)
