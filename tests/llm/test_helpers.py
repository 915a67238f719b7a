"""Stages, batches, words and components."""

import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from queuelens.llm import stages as s
from queuelens.llm import tokens
from queuelens.llm.graph import components


def test_stages_are_written_read_and_removed(spark):
    made = s.Stages(spark, "test")
    df = made.write(spark.range(5), "numbers")
    assert df.count() == 5 and df.stage_path.startswith(made.folder)
    assert os.path.exists(df.stage_path)
    made.remove(df)
    assert not os.path.exists(df.stage_path)


def test_batches_only_get_smaller(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for setting, after in (("64m", str(s.BATCH_BYTES)), ("1000", "1000")):
            spark.conf.set(name, setting)
            s.small_batches(spark)
            assert re.sub(r"\D", "", spark.conf.get(name)) == after
    finally:
        spark.conf.set(name, before)


def test_row_batches_keep_all_rows():
    out = s.RowBatches({"a": pa.int64(), "b": pa.string()}, rows=3)
    rows = [(k, str(k)) for k in range(8)]
    batches = [b for r in rows for b in out.add(r)] + list(out.rest())
    assert [b.num_rows for b in batches] == [3, 3, 2]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows


def test_names_that_are_taken(spark):
    df = spark.createDataFrame([(1, 2)], "_GONE int, x int")
    assert s.free_name(df, "_gone") == "__gone" and s.free_name(df, "y") == "y"


@given(st.text())
def test_words(text):
    expected = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert [w.decode("utf-8", "surrogatepass") for w in tokens.split_words(text)] == expected


@given(st.lists(st.integers(0, 2**64 - 1), max_size=30), st.integers(1, 6))
def test_rolling_hash_is_the_polynomial(values, window):
    got = tokens.rolling_hash(np.array(values, np.uint64), window)
    base = int(tokens.BASE_A)
    for i in range(len(values) - window + 1):
        h = 0
        for v in values[i : i + window]:
            h = (h * base + v) % 2**64
        assert int(got[i]) == h
    assert len(got) == max(0, len(values) - window + 1)


@pytest.mark.parametrize("shape", ["random", "path", "star", "empty"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "path": [(k + 1, k) for k in range(60)],
        "star": [(0, k) for k in range(100)] + [(7, 7)],
        "empty": [],
    }[shape]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, s.Stages(spark, "graph")).collect()}
    alone = {v for v in root if all(a == b for a, b in edges if v in (a, b))}
    assert got == {v: find(v) for v in root if v not in alone}
