"""Hard negatives against scores of all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import hard_negatives as hn
from queuelens.llm.registry import op12_hard_negative_mining

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, slab int, block string"
SMALL = hn.TreeSettings(slab_rows=64, page_rows=8, fanout=4, anchor_block=7)


def plain(rows, every=100, positives=5, negatives=10, move=True):
    """All result rows for (vec_id, vector, label) rows with distinct ids."""
    ready = {}
    for i, v, label in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ints = [math.floor(256 * float(np.float32(x))) for x in v]
        ready[i] = ((label + 1) % 10 if move and i % 7 == 0 else label, ints)
    out = []
    for a, (label, v) in ready.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w)) for i, (_, w) in ready.items() if i != a}
        same = sorted((-score[i], i) for i in score if ready[i][0] == label)[:positives]
        other = sorted((-score[i], i) for i in score if ready[i][0] != label)
        for s, p in same:
            fits = [(t, i) for t, i in other if -30 * s <= -100 * t <= -90 * s][:negatives]
            out += [(a, p, k, i, -s, -t) for k, (t, i) in enumerate(fits, 1)]
    return sorted(out)


def mined(df, every=100, settings=SMALL, **more):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hn.hard_negatives(df, F.col("id") % every == 0, label, settings=settings, **more)
    assert out.columns[:4] == ["anchor_id", "positive_id", "rank", "negative_id"]
    return sorted(map(tuple, out.collect()))


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def vectors(seed, n, dim, spread=1.0, labels=4):
    rng = random.Random(seed)
    return [
        (i, [rng.gauss(0.2, spread) for _ in range(dim)], rng.randrange(labels)) for i in range(n)
    ]


@pytest.mark.parametrize("dim, spread", [(1, 1.0), (2, 0.02), (6, 0.3), (40, 0.1)])
def test_against_all_rows(spark, dim, spread):
    rows = vectors(dim, 700, dim, spread)
    expected = plain(rows, 20)
    assert expected and mined(frame(spark, rows), 20) == expected


def test_ties_and_copies(spark):
    """A third of all rows are one vector; scores tie everywhere."""
    rng = random.Random(5)
    rows = [(i, [0.5, 0.25], 1) for i in range(0, 300)]
    rows += [(i, [rng.choice([0.0, 0.25, 0.5]), 0.25], rng.randrange(3)) for i in range(300, 900)]
    rng.shuffle(rows)
    assert mined(frame(spark, rows), 50) == plain(rows, 50)


def test_rows_that_take_no_part(spark):
    rows = vectors(9, 60, 3, 0.3)
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (201, [0.1, None, 0.2], 1), (202, [nan, 1.0, 1.0], 1), (203, [], 2),
             (204, [inf, 0.0, 0.0], 1), (205, [0.5, 0.5, 0.5], None), (None, [0.5, 0.5, 0.5], 1)]
    got = mined(frame(spark, rows + rows[:20]), 5)
    assert got == plain(rows, 5) and got


def test_vectors_of_other_lengths_and_sizes(spark):
    rows = vectors(3, 40, 3, 0.5) + [(100, [0.5], 1), (105, [1.0, 1.0, 1.0, 1.0], 2)]
    assert mined(frame(spark, rows), 5) == plain(rows, 5)
    huge = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [1e38, 1.0], 2), (3, [4.0, 1.0], 2)]
    assert all(abs(x) < 2**63 for r in mined(frame(spark, huge), 5, window=(0, 100)) for x in r)


def test_large_components_stay_exact(spark):
    rows = [(i, [v * 100_000.0 for v in vec], label) for i, vec, label in vectors(8, 120, 4)]
    assert mined(frame(spark, rows), 10) == plain(rows, 10)


def test_empty_and_single(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(0, [1.0], 1)])) == []
    assert mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 1)])) == []


def test_pages_hold_every_row_once():
    rng = np.random.default_rng(2)
    for n in (1, 7, 8, 9, 500):
        ids, labels = rng.permutation(n), rng.integers(0, 3, n)
        vecs = rng.integers(-3, 4, (n, 5))
        order, starts = hn.str_pages(ids, labels, vecs, 8)
        assert sorted(order.tolist()) == list(range(n))
        assert all(b - a <= 8 for a, b in zip(starts, [*starts[1:], n]))


def test_boxes_bound_their_rows_and_prune():
    rng = np.random.default_rng(4)
    n = 2000
    vecs = rng.integers(-100, 100, (n, 3))
    ids, labels = np.arange(n), rng.integers(0, 3, n)
    order, starts = hn.str_pages(ids, labels, vecs, 16)
    tree = hn.Tree(ids[order], labels[order], vecs[order], starts, 4)
    anchor = np.array([5, -7, 2])
    lows, highs = tree.bounds(anchor[None])
    for page in range(tree.first_page, len(tree.lo)):
        score = tree.vectors[tree.page_rows(page)] @ anchor
        assert lows[0, page] <= score.min() and score.max() <= highs[0, page]
    search = hn.Search(tree, -1, 1, anchor, lows[0], highs[0], same=True)
    found = search.first(5, None, 400)
    score = vecs @ anchor
    ok = sorted((-s, i) for i, s in enumerate(score.tolist()) if labels[i] == 1 and s <= 400)[:5]
    assert sorted((-s, i) for s, i in found) == ok
    assert len(search.scored) < len(starts) / 2  # most pages are never looked at


def test_query_against_all_rows(spark, tables):
    rows = [
        (r["vec_id"], r["embedding"], r["label"])
        for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()
    ]
    got = sorted(map(tuple, op12_hard_negative_mining(spark, tables).collect()))
    assert got == plain(rows) and got
