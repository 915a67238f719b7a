"""Hard negatives for anchors, by best-first search in an STR-packed R-tree.

The score of a row for an anchor is the inner product of their integer vectors; higher
scores come first, ties by smaller id.  An anchor's positives are its first other rows of
the same label; for each positive, the negatives are the first rows of other labels whose
score lies in a window below the positive's.

Tree
----
* Rows are range-partitioned by (label, first coordinate, id) into slabs of about
  ``slab_rows``; the id splits what is equal in all else, so a label, or a vector, that a
  third of all rows share fills many slabs evenly.
* In a slab, sort-tile-recursive packing: sort by a coordinate, cut into equal slices, go
  on with the next coordinate in each, down to pages of ``page_rows``.  The label comes
  first, then coordinates by falling spread; those without spread are left out.  Pages
  in this order make up nodes of ``fanout`` children up to a root.
* A box holds the least and the largest of every coordinate, of the label and the least id.

Search
------
Anchors in blocks meet the slabs they have to search, by equi-joins: for positives, the
slabs that hold their label; for negatives, all.  The product of an anchor with a box lies
between sums over coordinates of the lesser and of the larger of its two products.  A queue
takes the box with the highest upper bound first; boxes outside the window, without a fitting
label, or strictly below the kth result (equal, but with larger ids only) are pruned.  The few
rows that every slab returns are ranked in Spark.  Nothing depends on luck: results are exact.

In high dimensions boxes overlap most windows, so that an anchor looks at most pages; the
cost is then anchors times rows, in tasks of bounded size.

Defined results: rows with a null id, label or vector, or with a component that is null or
not finite, take no part, nor do empty vectors.  Of rows that share an id, the one with the
smallest label, then vector, takes part.  Shorter vectors are continued with zeros.  Components
are held to a size (2**28 for 64 coordinates) at which no score leaves 64 bits.  Anchors without
a positive, and positives without a negative, give no row; an empty table gives no row.
Other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from queuelens.llm.stages import Stages


@dataclass(frozen=True)
class TreeSettings:
    slab_rows: int = 16_384
    page_rows: int = 256
    fanout: int = 16
    #: anchors that search a slab in one task
    anchor_block: int = 512


SLAB_SCHEMA = (
    "slab int, n int, ids binary, labels binary, vectors binary, starts binary, "
    "own_labels array<long>"
)
SLAB_FIELDS = pa.schema([
    ("slab", pa.int32()), ("n", pa.int32()), ("ids", pa.binary()), ("labels", pa.binary()),
    ("vectors", pa.binary()), ("starts", pa.binary()), ("own_labels", pa.list_(pa.int64())),
])
FOUND_SCHEMA = "anchor_id long, positive_id long, positive_score long, found_id long, found_score long"
FOUND_FIELDS = pa.schema([(p.split()[0], pa.int64()) for p in FOUND_SCHEMA.split(", ")])


def scaled(vector: str | Column, factor: float = 256.0) -> Column:
    """floor(factor * x) of every component x, taken as double."""
    col = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(col, lambda x: F.floor(x.cast("double") * F.lit(factor)).cast("long"))


def _prepared(rows: DataFrame, id_col: str, label: Column, vector: Column) -> DataFrame:
    """(id, label, vector) of the rows that take part, one per id."""
    finite = F.forall(
        "raw", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    some = rows.select(
        F.col(id_col).cast("long").alias("id"),
        label.cast("long").alias("label"),
        vector.cast("array<double>").alias("raw"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("raw") > 0) & finite)
    one = some.groupBy("id").agg(F.min(F.struct("label", "raw")).alias("row"))
    return one.select("id", "row.label", F.col("row.raw").alias("raw"))


def _held(vector: Column, dim: int) -> Column:
    """Components held to +-limit and continued with zeros to ``dim``."""
    limit = F.lit(isqrt(2**62 // max(dim, 1)))
    held = F.transform(vector, lambda x: F.least(F.greatest(x, -limit), limit))
    return F.concat(held, F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size(held)))


def str_pages(
    ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, page_rows: int
) -> tuple[np.ndarray, list[int]]:
    """The packed order of rows, and where each page starts in it."""
    spread = vectors.astype(np.float64).var(axis=0)
    coordinates = [vectors[:, c] for c in np.argsort(-spread, kind="stable") if spread[c] > 0]
    if len(labels) and labels.min() < labels.max():
        coordinates.insert(0, labels)
    order: list[np.ndarray] = []

    def tile(rows: np.ndarray, k: int) -> None:
        pages = ceil(len(rows) / page_rows)
        if pages <= 1:
            order.append(rows[np.argsort(ids[rows], kind="stable")])
            return
        left = len(coordinates) - k
        if left > 0:
            rows = rows[np.lexsort((ids[rows], coordinates[k][rows]))]
            slices = max(2, ceil(pages ** (1 / left))) if left > 1 else pages
        else:
            rows, slices = rows[np.argsort(ids[rows], kind="stable")], pages
        size = ceil(pages / slices) * page_rows
        for at in range(0, len(rows), size):
            tile(rows[at : at + size], k + 1)

    if len(ids):
        tile(np.arange(len(ids)), 0)
    starts = np.cumsum([0, *map(len, order)])[:-1].tolist()
    return (np.concatenate(order) if order else np.empty(0, np.int64)), starts


class Tree:
    """Pages of rows, and boxes of pages, nodes and the root, numbered from the root down."""

    def __init__(self, ids, labels, vectors, starts, fanout: int):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.starts = [*starts, len(ids)]
        box = [
            np.minimum.reduceat(vectors, starts), np.maximum.reduceat(vectors, starts),
            np.minimum.reduceat(labels, starts), np.maximum.reduceat(labels, starts),
            np.minimum.reduceat(ids, starts),
        ]
        levels = [box]
        while len(levels[0][0]) > 1:
            cuts = np.arange(0, len(levels[0][0]), fanout)
            lo, hi, first, last, least = levels[0]
            levels.insert(0, [
                np.minimum.reduceat(lo, cuts), np.maximum.reduceat(hi, cuts),
                np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts),
                np.minimum.reduceat(least, cuts),
            ])
        self.lo, self.hi, first, last, least = (np.concatenate(part) for part in zip(*levels))
        self.first_label, self.last_label = first.tolist(), last.tolist()
        self.least_id = least.tolist()
        sizes = [len(level[0]) for level in levels]
        offsets = np.cumsum([0, *sizes]).tolist()
        self.first_page = offsets[-2]
        self.children: list[range] = []
        for depth, size in enumerate(sizes[:-1]):
            below, n = offsets[depth + 1], sizes[depth + 1]
            for k in range(size):
                at = k * fanout
                self.children.append(range(below + at, below + min(n, at + fanout)))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest possible product of each anchor with a row of each box."""
        up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
        lo, hi = self.lo.T, self.hi.T
        return (
            exact_product(up, lo) + exact_product(down, hi),
            exact_product(up, hi) + exact_product(down, lo),
        )

    def page_rows(self, page: int) -> slice:
        k = page - self.first_page
        return slice(self.starts[k], self.starts[k + 1])


def exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Matrix product of integers, in floating point where every sum is exact there."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[-1]
    if largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


class Search:
    """The searches of one anchor in one tree; pages are scored once for all of them."""

    def __init__(self, tree: Tree, anchor_id: int, label: int, vector, lows, highs, same: bool):
        self.tree, self.anchor_id, self.label, self.same = tree, anchor_id, label, same
        self.vector, self.lows, self.highs = vector, lows.tolist(), highs.tolist()
        self.scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _fits(self, node: int) -> bool:
        first, last = self.tree.first_label[node], self.tree.last_label[node]
        return first <= self.label <= last if self.same else not first == self.label == last

    def _page(self, page: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores, highest first, and ids of a page's rows with a fitting label."""
        if page not in self.scored:
            rows = self.tree.page_rows(page)
            ids, labels = self.tree.ids[rows], self.tree.labels[rows]
            ok = (labels == self.label) if self.same else (labels != self.label)
            ok &= ids != self.anchor_id
            score, ids = exact_product(self.tree.vectors[rows], self.vector)[ok], ids[ok]
            order = np.lexsort((ids, -score))
            self.scored[page] = score[order], ids[order]
        return self.scored[page]

    def first(self, k: int, low: int | None, high: int | None) -> list[tuple[int, int]]:
        """(score, id) of the first k rows with low <= score <= high."""
        best: list[tuple[int, int]] = []  # a heap: the kth result, as (score, -id), on top
        queue: list[tuple[int, int, int]] = []

        def enter(node: int) -> None:
            top = self.highs[node]
            if (low is None or top >= low) and self._fits(node):
                if high is not None:
                    if self.lows[node] > high:
                        return
                    top = min(top, high)
                heapq.heappush(queue, (-top, self.tree.least_id[node], node))

        enter(0)
        while queue:
            top, least_id, node = heapq.heappop(queue)
            if len(best) == k and (-top, -least_id) <= best[0]:
                break
            if node < self.tree.first_page:
                for child in self.tree.children[node]:
                    enter(child)
                continue
            scores, ids = self._page(node)
            at = 0 if high is None else int(np.searchsorted(-scores, -high))
            for score, row in zip(scores[at : at + k].tolist(), ids[at : at + k].tolist()):
                if low is not None and score < low:
                    break
                if len(best) < k:
                    heapq.heappush(best, (score, -row))
                elif (score, -row) > best[0]:
                    heapq.heapreplace(best, (score, -row))
                else:
                    break
        return [(score, -row) for score, row in best]


def build_tree(rows: DataFrame, dim: int, n: int, settings: TreeSettings) -> DataFrame:
    """The packed slabs of (id, label, vector), one row each."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if not own:
            return
        table = pa.Table.from_batches(own)
        ids, labels = table.column("id").to_numpy(), table.column("label").to_numpy()
        flat = table.column("vector").combine_chunks().flatten().to_numpy()
        vectors = flat.reshape(len(ids), dim)
        order, starts = str_pages(ids, labels, vectors, settings.page_rows)
        yield pa.RecordBatch.from_pylist([{
            "slab": TaskContext.get().partitionId(), "n": len(ids),
            "ids": ids[order].tobytes(), "labels": labels[order].tobytes(),
            "vectors": vectors[order].tobytes(), "starts": np.array(starts, np.int64).tobytes(),
            "own_labels": np.unique(labels).tolist(),
        }], SLAB_FIELDS)

    slabs = max(1, ceil(n / settings.slab_rows))
    return (
        rows.select("id", "label", "vector")
        .repartitionByRange(slabs, "label", F.col("vector")[0], "id")
        .mapInArrow(packed, SLAB_SCHEMA)
    )


def _tree_of(row: dict, dim: int, fanout: int) -> Tree:
    ids, labels, vectors, starts = (
        np.frombuffer(row[c], np.int64) for c in ("ids", "labels", "vectors", "starts")
    )
    return Tree(ids, labels, vectors.reshape(len(ids), dim), starts.tolist(), fanout)


def _searched(slabs: DataFrame, asks: DataFrame, dim: int, settings: TreeSettings, k: int,
              same: bool) -> DataFrame:
    """What each slab finds for the anchors that ask it.

    ``asks`` has (slab, block, id, label, vector, wanted), where wanted is a list of
    (positive_id, positive_score, low, high); for positives it is a single empty window.
    """

    def cell(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            tree = _tree_of(left.to_pylist()[0], dim, settings.fanout)
            vectors = right.column("vector").combine_chunks().flatten().to_numpy()
            vectors = vectors.reshape(right.num_rows, dim)
            lows, highs = tree.bounds(vectors)
            for j, row in enumerate(right.select(["id", "label", "wanted"]).to_pylist()):
                search = Search(tree, row["id"], row["label"], vectors[j], lows[j], highs[j], same)
                known: dict[tuple, list[tuple[int, int]]] = {}
                for w in row["wanted"]:
                    window = w["low"], w["high"]
                    if window not in known:
                        known[window] = search.first(k, *window)
                    found += [
                        (row["id"], w["positive_id"], w["positive_score"], other, score)
                        for score, other in known[window]
                    ]
        columns = list(zip(*found)) or [()] * len(FOUND_FIELDS)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.Table.from_arrays(arrays, schema=FOUND_FIELDS)

    wanted = asks.select(F.col("block").alias("by"), F.col("slab").alias("of")).distinct()
    sides = slabs.join(wanted, F.col("slab") == F.col("of"))
    sides = sides.select("by", "of", "ids", "labels", "vectors", "starts")
    return (
        sides.groupBy("by", "of")
        .cogroup(asks.groupBy("block", "slab"))
        .applyInArrow(cell, FOUND_SCHEMA)
    )


def _first(found: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("found_score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame,
    anchors: Column,
    label: Column | str = "label",
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    factor: float = 256.0,
    settings: TreeSettings = TreeSettings(),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` tells by ``id`` which rows are anchors; ``window`` is the range of a
    negative's score in percent of the positive's.
    """
    stages = Stages(rows.sparkSession, "hard-negatives")
    label = F.col(label) if isinstance(label, str) else label
    ready = _prepared(rows, id_col, label, F.col(vec_col))
    ready = stages.write(ready.select("id", "label", scaled("raw", factor).alias("raw")), "rows")
    n, dim = ready.agg(F.count(F.lit(1)), F.max(F.size("raw"))).first()
    dim = dim or 1
    ready = ready.select("id", "label", _held(F.col("raw"), dim).alias("vector"))
    slabs = stages.write(build_tree(ready, dim, n, settings), "slabs")
    asking = ready.where(anchors)
    count, last_slab = asking.count(), slabs.agg(F.max("slab")).first()[0] or 0
    blocks = max(1, ceil(count / settings.anchor_block))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    none, no_id = F.lit(None).cast("long"), F.lit(None).cast("long")
    everything = F.array(F.struct(
        no_id.alias("positive_id"), none.alias("positive_score"), none.alias("low"), none.alias("high")
    ))
    holders = slabs.select("slab", F.explode("own_labels").alias("label"))
    asks = asking.withColumn("wanted", everything).join(holders, "label")
    same = _searched(slabs, asks, dim, settings, positives, same=True)
    first = _first(same, positives, "anchor_id").select(
        "anchor_id", F.col("found_id").alias("positive_id"), F.col("found_score").alias("score")
    )
    low, high = (F.col("score").cast("decimal(25,0)") * F.lit(w) for w in window)
    windows = stages.write(first, "positives").select(
        F.col("anchor_id").alias("id"),
        F.struct(
            "positive_id",
            F.col("score").alias("positive_score"),
            F.ceil(low / 100).cast("long").alias("low"),
            F.floor(high / 100).cast("long").alias("high"),
        ).alias("w"),
    )
    windows = windows.where("w.low <= w.high").groupBy("id").agg(F.collect_list("w").alias("wanted"))
    every = F.explode(F.sequence(F.lit(0), F.lit(last_slab))).alias("slab")
    asks = asking.join(windows, "id").select("*", every)
    other = _searched(slabs, asks, dim, settings, negatives, same=False)
    return _first(other, negatives, "anchor_id", "positive_id").select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("found_id").alias("negative_id"),
        "positive_score",
        F.col("found_score").alias("negative_score"),
    )
