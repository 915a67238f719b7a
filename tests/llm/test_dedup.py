"""Exact, substring, line and n-gram de-duplication against plain versions."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queuelens.llm import exact_dedup, line_dedup, ngram_join, registry, substring_dedup

from . import brute


def pairs(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def mutated_docs(spark, seed=3, groups=40):
    """Groups of near copies with a common passage and shared lines."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(40)]
    rows, next_id = [], 0
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([3, 6, 30, 90, 200]))]
        if rng.random() < 0.5:
            base[len(base) // 2 : len(base) // 2] = passage
        for _ in range(rng.choice([1, 1, 2, 5, 9])):
            words = list(base)
            for _ in range(rng.randrange(1 + len(words) // 25)):
                words[rng.randrange(len(words))] = word()
            rows.append((next_id, " ".join(words)))
            next_id += 1
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(edge_docs, keep):
    got = exact_dedup.exact_groups(edge_docs, keep=keep).collect()
    rows = pairs(edge_docs)
    assert len(got) == len(rows)
    pick = max if keep == "largest" else min
    for r in got:
        same = [d for d, t in rows if brute.sha(t or "") == r["text_sha256"]]
        assert r["group_size"] == len(same)
        assert r["keep_id"] == pick((d for d in same if d is not None), default=None)
    kept = [r["text_sha256"] for r in got if r["kept"]]
    assert sorted(kept) == sorted({r["text_sha256"] for r in got})


def test_exact_rounds_do_not_change_the_result(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    one = exact_dedup.exact_groups(docs, team_bits=1).collect()
    assert sorted(one) == sorted(exact_dedup.exact_groups(docs, team_bits=3).collect())


def test_exact_normalises(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "A"), (2, "a")], "doc_id long, text string")
    got = exact_dedup.exact_groups(docs, normalise=F.lower).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in got} == {(1, 2, False), (2, 2, True)}


def test_exact_plan_has_no_python(spark, tables):
    plan = registry.QUERIES["op3_exact_dedup"](spark, tables)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_substrings(spark, edge_docs, tables):
    for docs in (edge_docs, spark.read.parquet(f"{tables}/documents.parquet"), mutated_docs(spark)):
        got = substring_dedup.digest_rows(substring_dedup.remove_repeats(docs)).collect()
        assert sorted(map(tuple, got), key=str) == brute.substrings(pairs(docs))


def test_substrings_in_small_parts(spark, monkeypatch):
    docs = mutated_docs(spark)
    monkeypatch.setattr(substring_dedup, "RANGES", 5)
    small = substring_dedup.remove_repeats(docs, window=7, part_bytes=500)
    got = substring_dedup.digest_rows(small).collect()
    assert sorted(map(tuple, got), key=str) == brute.substrings(pairs(docs), 7)


@given(
    st.lists(st.integers(-(2**62), 2**62), min_size=1, max_size=40), st.integers(1, 5), st.data()
)
def test_parts_follow_the_order_of_ids(ids, split, data):
    ids = np.sort(np.array(ids))
    inner = sorted(set(data.draw(st.lists(st.sampled_from(ids.tolist()), max_size=4))) - {ids[-1]})
    parts = substring_dedup.part_numbers(ids, inner, int(ids[0]), int(ids[-1]), split)
    assert (np.diff(parts) >= 0).all() and 0 <= parts[0] and parts[-1] < (len(inner) + 1) * split


@given(st.lists(st.booleans(), max_size=60), st.integers(1, 8))
def test_merged_windows_cover_what_the_windows_cover(starts, window):
    covered = {i + j for i, s in enumerate(starts) if s for j in range(window)}
    merged = substring_dedup.merge_windows(np.array(starts, bool), window)
    assert covered == {i for s, e in merged for i in range(s, e)}
    assert all(a[1] < b[0] for a, b in zip(merged, merged[1:]))


@pytest.mark.parametrize("task_members", [1 << 20, 300])
def test_jaccard_groups(spark, tables, task_members):
    for docs in (mutated_docs(spark), spark.read.parquet(f"{tables}/documents.parquet")):
        got = ngram_join.jaccard_components(docs, task_members=task_members).collect()
        found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}
        assert found == brute.jaccard_groups(pairs(docs))


def test_rows_that_share_an_id_keep_all_their_links(spark):
    """Document 2 has a copy of document 1 and another text; 3 is near to that other one."""
    words = [f"w{k}" for k in range(60)]
    other = [f"v{k}" for k in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(other)),
            (3, " ".join(other[:-1] + ["end"])), (4, "something else altogether in five words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.jaccard_components(docs).select("doc_id", "component_id").distinct().collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 1), (4, 4)]


def test_jaccard_edges(edge_docs):
    got = ngram_join.jaccard_components(edge_docs).collect()
    expected = brute.jaccard_groups(pairs(edge_docs))
    assert len(got) == sum(d is not None for d, _ in pairs(edge_docs))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    kept = ngram_join.one_of_each(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(ids, key=brute.id_order) == [1, 2, 3, 4, 5, 5, 6, 7, 8, 9, 11, 13, None]


@settings(deadline=None, max_examples=200)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 2**32))
def test_linked_sets_share_a_signature(size, changes, seed):
    """Whatever the two skip, a pair at or over the threshold has a signature in common."""
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 2**64, size, np.uint64))
    b = np.unique(np.r_[a[min(changes, len(a) - 1) :], rng.integers(0, 2**64, changes // 2, np.uint64)])
    shared = len(np.intersect1d(a, b))
    if 100 * shared < 75 * (len(a) + len(b) - shared):
        return
    order = rng.permutation(1 << 16)

    def leading(members):
        out = set()
        for band, parts in ngram_join.bands(len(members), 75):
            found = ngram_join.signatures(members, band, parts)
            skip = ngram_join.skipped(len(members), len(found), 75)
            ranked = sorted(found.tolist(), key=lambda s: (order[s & 0xFFFF], s))
            out |= set(ranked[skip:])
            if len(found) <= ngram_join.allowed_difference(len(members), 75):
                out |= set(ngram_join.member_signatures(members, band).tolist())
        return out

    assert leading(a) & leading(b)


def test_lines(spark, edge_docs, tables):
    for docs in (edge_docs, spark.read.parquet(f"{tables}/documents.parquet")):
        expected = brute.kept_lines(pairs(docs), line_dedup.masked)
        cut = line_dedup.drop_lines(docs.withColumnRenamed("text", "body"), text_col="body")
        got = [(r["doc_id"], r["body"] or "") for r in cut.select("doc_id", "body").collect()]
        assert sorted(got, key=str) == sorted(
            ((d, expected[d, t or ""]) for d, t in pairs(docs)), key=str
        )


def test_lines_with_variable_fields(spark):
    texts = [
        f"own words of text {w}\nLogin seen at 10:0{k} from home by {w} on phone"
        for k, w in enumerate("abcd")
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.drop_lines(docs).collect()}
    assert got[0]["text"] == texts[0] and got[0]["n_dropped"] == 0
    assert [got[k]["n_dropped"] for k in (1, 2, 3)] == [2, 2, 2]


def test_lines_of_numbers_are_compared_as_written(spark):
    texts = [f"text {w} has its own line\n{k} 7.{k} 2024-01-0{k} 88{k}\n1 2 3 4" for k, w in enumerate("abcd")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"].split("\n") for r in line_dedup.drop_lines(docs).collect()}
    for k in range(4):
        assert f"{k} 7.{k} 2024-01-0{k} 88{k}" in got[k]
        assert ("1 2 3 4" in got[k]) == (k == 0)
    assert line_dedup.masked("Seen at 10:00 by us all") == ["Seen", "at", "<*>", "by", "us", "all"]


def holders(docs):
    out = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if line.split():
                out[tuple(line.split())].add((doc_id, text if doc_id is None else None))
    return out


def test_verbatim_lines(spark, tables, no_docs):
    table = spark.read.parquet(f"{tables}/documents.parquet")
    before = holders(pairs(table))
    gone = [x for x, d in before.items() if len(d) >= (3 if len(x) < 50 else 2)]
    assert any(len(x) < 4 for x in gone) and any(len(x) >= 50 and len(before[x]) == 2 for x in gone)
    after = holders(pairs(line_dedup.drop_lines(table, verbatim=True)))
    assert all(len(after[x]) <= 1 for x in gone)
    # a short line stays in its first document; only templates can take the others
    assert all(min(before[x]) in after[x] for x in gone if len(x) < 4)
    assert all(after[x] == d for x, d in before.items() if len(x) < 4 and len(d) < 3)
    long = " ".join(f"w{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}" for k in range(50))
    rows = [(k, f"{long if k < 2 else long[:-3]}\nAnd {'abc'[k]}.\nLes.\n{'' if k else 'Two.'}") for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.drop_lines(docs, verbatim=True).collect()}
    assert got[0] == rows[0][1] and got[1] == "And b.\n" and got[2].endswith("And c.\n")
    assert line_dedup.drop_lines(no_docs, verbatim=True).count() == 0


def test_line_query_against_plain_version(spark, tables, edge_docs):
    """The rule as registered, templates and verbatim lines, over whole texts."""
    for docs in (edge_docs.where("doc_id is not null"), spark.read.parquet(f"{tables}/documents.parquet")):
        expected = brute.kept_lines(pairs(docs), line_dedup.masked, verbatim=True)
        cut = line_dedup.drop_lines(docs, verbatim=True).select("doc_id", "text").collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in cut) == sorted(
            (d, expected[d, t or ""]) for d, t in pairs(docs)
        )
    got = registry.QUERIES["op10_line_dedup"](spark, tables).collect()
    assert {r["doc_id"]: r["kept_sha256"] for r in got} == {
        d: brute.sha(kept) for (d, _), kept in expected.items()
    }
    assert sum(r["n_dropped"] for r in got) > 0


def test_empty_tables(no_docs):
    assert exact_dedup.exact_groups(no_docs).count() == 0
    assert substring_dedup.remove_repeats(no_docs).count() == 0
    assert ngram_join.jaccard_components(no_docs).count() == 0
    assert line_dedup.drop_lines(no_docs).count() == 0


def test_signatures_are_shuffled_in_few_bytes():
    """Half of the 13 bytes of a signature and its document, whether a bucket gets many or few."""
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 300)) for _ in range(800)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(70_000, 70_800)), "text": texts})
    (out,) = ngram_join._emit(5, 75, 6)(iter([batch]))
    sent = sum(len(x.as_py()) for name in ("sigs", "docs") for x in out.column(name))
    of_buckets = [
        ngram_join._from_planes(ngram_join._unpacked(x.as_py(), 4), np.uint32) for x in out.column("sigs")
    ]
    assert sent < 6.5 * sum(map(len, of_buckets))
    # steps between sorted signatures: the sums are what was taken
    members = [ngram_join.shingle_set(t) for t in texts]
    taken = np.concatenate(
        [ngram_join.signatures(m, *of) for m in members for of in ngram_join.bands(len(m), 75)]
    )
    got = [
        (np.uint64(bucket) << np.uint64(32)) + np.cumsum(x, dtype=np.uint32).astype(np.uint64)
        for bucket, x in zip(out.column("bucket").to_pylist(), of_buckets)
    ]
    assert (np.concatenate(got) == np.sort(taken) >> np.uint64(26)).all()


def test_signatures_of_a_document_are_dealt_once(spark, tables, monkeypatch):
    """The ranking and the join behind it share the shuffle by document."""
    plans = {}
    write = ngram_join.Stages.write

    def seen(self, df, name):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name)

    monkeypatch.setattr(ngram_join.Stages, "write", seen)
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        ngram_join.jaccard_components(spark.read.parquet(f"{tables}/documents.parquet"))
    finally:
        spark.conf.set(key, before)
    # by bucket, by document, and the documents' own numbers to skip
    assert plans["leading"].count("Exchange hashpartitioning") == 3
