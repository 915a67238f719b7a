"""Every stage of the pipeline against what it should do to its own input."""

import os

import duckdb

import __spark_entry__ as entry_points
import corpus_pipeline
from queuelens.llm import decontaminate, line_dedup, quality, registry
from queuelens.session import shared_dir

from . import brute
from .test_scans import check_pieces


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_one_by_one(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    done = {}
    for name, stage in corpus_pipeline.STAGES:
        done[name] = (docs, stage(spark, docs, tables))
        docs = done[name][1]
        if name != "packing":
            assert docs.columns == columns
    before, after = done["quality_classifier"]
    weights = quality.train_on(before, spark.read.parquet(f"{tables}/labels.parquet"))
    good = {r["doc_id"] for r in quality.score(before, weights).collect() if r["score"] >= 0.5}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] in good)

    before, after = done["line_dedup"]
    kept = brute.kept_lines([r[:2] for r in rows(before)], line_dedup.masked, verbatim=True)
    expected = {}
    for r in rows(before):
        text = kept[r[0], r[1]]
        if text.strip() or text == r[1]:
            expected[r[0]] = (r[0], text, *r[2:4], len(text) if text != r[1] else r[4])
    assert {r[0]: r for r in rows(after)} == expected

    before, after = done["ngram_jaccard_join"]
    groups = brute.jaccard_groups([r[:2] for r in rows(before)])
    assert sorted(rows(after)) == sorted(r for r in rows(before) if groups[r[0]][1] == r[0])

    before, after = done["benchmark_decontamination"]
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    leaked = {r["doc_id"] for r in decontaminate.find_leaks(before, items).collect()}
    assert sorted(rows(after)) == sorted(r for r in rows(before) if r[0] not in leaked)

    before, after = done["packing"]
    check_pieces([r[:2] for r in rows(before)], after.collect())


def test_stages_on_edges(spark, edge_docs, no_docs, tables):
    for docs in (edge_docs, edge_docs.limit(0)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, tables)
            assert docs.columns == columns
            docs.count()


def test_run_leaves_only_its_result(spark, tables):
    folder = shared_dir(spark)
    before = set(os.listdir(folder)) if os.path.exists(folder) else set()
    assert corpus_pipeline.run(spark, tables).count() > 0
    (left,) = set(os.listdir(folder)) - before
    assert left.startswith("pipeline-")
    assert [name[4:] for name in os.listdir(f"{folder}/{left}")] == ["packing"]


def test_registered_with_the_entry_points():
    names = list(entry_points.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


def test_oracles(spark):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, folder)
        found = con.execute(sql)
        assert [c[0] for c in found.description] == df.columns
        assert sorted(found.fetchall()) == sorted(rows(df))
