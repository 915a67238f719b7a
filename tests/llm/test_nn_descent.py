"""Graph search against distances to all rows."""

import dataclasses
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from queuelens.llm import nn_descent as nd
from queuelens.llm.registry import op13_approximate_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node int, block string, rank int"
#: small groups and blocks, so that the first graph is poor and the rounds have work
SMALL = dataclasses.replace(
    nd.GraphSettings(), neighbours=12, reverse=12, trees=3, group=24, block=100, sample=64, beam=40
)


def plain(rows, every=100, k=10):
    """{query: [(distance, id)]}, all others by distance and id, cut after k."""
    ready = {}
    for i, v, *_ in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        own = [float(np.float32(x)) for x in v]
        ready[i] = min(ready.get(i, own), own)
    dim = max(map(len, ready.values()), default=0)
    ids = sorted(ready)
    matrix = np.array([ready[i] + [0.0] * (dim - len(ready[i])) for i in ids])
    out = {}
    for at, q in enumerate(ids):
        if q % every == 0:
            d = np.sqrt(((matrix - matrix[at]) ** 2).sum(axis=1))
            out[q] = sorted((x, i) for x, i in zip(d.tolist(), ids) if i != q)[:k]
    return {q: r for q, r in out.items() if r}


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        own = out.setdefault(r["query_id"], [])
        assert r["rank"] == len(own) + 1
        own.append((r["score"], r["vec_id"]))
    return out


def run(spark, rows, every=100, k=10, settings=SMALL):
    return found(nd.nearest(frame(spark, rows), F.col("vec_id") % every == 0, k, settings=settings))


def recall(got, expected):
    hits = sum(len({i for _, i in got.get(q, [])} & {i for _, i in r}) for q, r in expected.items())
    return hits / sum(map(len, expected.values()))


def same(got, expected):
    assert got.keys() == expected.keys()
    for q, r in expected.items():
        assert [i for _, i in got[q]] == [i for _, i in r]
        assert np.allclose([d for d, _ in got[q]], [d for d, _ in r], rtol=1e-12, atol=0)


def vectors(seed, n, dim):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("dim", [2, 8, 24])
def test_recall_on_unrelated_vectors(spark, dim):
    rows = vectors(dim, 1500, dim)
    expected = plain(rows, 20)
    got = run(spark, rows, 20)
    assert {q: len(r) for q, r in got.items()} == {q: 10 for q in expected}
    assert recall(got, expected) >= 0.9
    assert all(r == sorted(r) for r in got.values())


def test_rounds_improve_the_graph(spark):
    rows = frame(spark, vectors(5, 1200, 16))
    matrix = np.array([r["embedding"] for r in rows.orderBy("vec_id").collect()])
    order = np.argsort(((matrix[:, None] - matrix[None]) ** 2).sum(-1), axis=1)[:, 1:9]

    def hits(rounds):
        settings = dataclasses.replace(SMALL, rounds=rounds)
        graph = nd.build_index(rows, settings=settings).graph.collect()
        assert len(graph) == 1200
        near = {r["node"]: {e["id"] for e in r["near"]} for r in graph}
        return sum(len(near[i] & set(order[i].tolist())) for i in range(1200)) / order.size

    poor, good = hits(0), hits(6)
    assert good > 0.9 and good > poor + 0.1, (poor, good)


def test_tight_clusters_far_apart(spark):
    """Clusters larger than a list, whose members differ in the sixth digit."""
    rng = random.Random(2)
    rows = []
    for c in range(6):
        centre = [rng.gauss(0, 1000) for _ in range(5)]
        rows += [
            (len(rows) + j, [x + rng.gauss(0, 0.01) for x in centre]) for j in range(150)
        ]
    expected = plain(rows, 10)
    assert recall(run(spark, rows, 10), expected) >= 0.9


def test_copies_of_one_vector(spark):
    """Half of all rows are one vector; ties go to the smaller id."""
    rows = vectors(7, 300, 4) + [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(300)]
    rows += [(2000, [-0.0, 1.0, 0.0, 0.0]), (2001, [0.0, 1.0, -0.0, 0.0])]
    random.Random(1).shuffle(rows)
    same(run(spark, rows, 50), plain(rows, 50))


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(3, 40, 3)
    odd = [(100, None), (105, [0.0, 0.0, 0.0]), (110, [nan, 1.0, 1.0]), (115, [1.0, None, 1.0]),
           (120, [inf, 0.0, 0.0]), (125, []), (None, [1.0, 1.0, 1.0]), (130, [2.0]), (0, [9.0, 9.0, 9.0]),
           (135, [3e38, -3e38, 1.0])]
    same(run(spark, rows + odd + rows[:10], 5), plain(rows + odd, 5))


def test_empty_and_few(spark):
    assert run(spark, []) == {}
    assert run(spark, [(0, [1.0])]) == {}
    same(run(spark, [(0, [1.0]), (1, [1.0])]), {0: [(0.0, 1)]})
    same(run(spark, [(0, [1.0]), (100, [3.0]), (1, [2.0])]), plain([(0, [1.0]), (100, [3.0]), (1, [2.0])]))


def test_queries_that_are_no_rows_of_the_index(spark):
    rows = vectors(4, 600, 6)
    index = nd.build_index(frame(spark, rows), settings=SMALL)
    other = vectors(99, 20, 6)
    got = found(nd.search(index, frame(spark, [(10_000 + i, v) for i, v in other])))
    matrix = np.array([v for _, v in rows], np.float32).astype(float)
    for i, v in other:
        d = np.sqrt(((matrix - np.array(v, np.float32).astype(float)) ** 2).sum(axis=1))
        assert len({j for _, j in got[10_000 + i]} & set(np.argsort(d)[:10].tolist())) >= 8


def test_query_recall(spark, tables):
    rows = [
        (r["vec_id"], r["embedding"])
        for r in spark.read.parquet(f"{tables}/embeddings.parquet").collect()
    ]
    got = found(op13_approximate_nearest_neighbours(spark, tables))
    expected = plain(rows)
    assert got.keys() == expected.keys() and recall(got, expected) >= 0.9
