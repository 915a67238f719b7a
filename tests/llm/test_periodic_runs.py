"""Periodic runs against a plain scan of all periods."""

import binascii
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queuelens.llm import periodic_runs as pr
from tests.llm import brute


def plain_runs(words, least_words=6, least_powers=4):
    """(start, end, period) of all runs: every period, every stretch; smallest periods only."""
    found = []
    for q in range(1, len(words) // least_powers + 1):
        same = [words[i] == words[i + q] for i in range(len(words) - q)] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                end = i + q
                if end - start >= max(least_words, least_powers * q):
                    if not any(a <= start and end <= b for a, b, _ in found):
                        found.append((start, end, q))
                start = None
    return sorted(found, key=lambda r: (r[0], r[2]))


def planted(doc_id, text):
    words = brute.WORD.findall(text or "")
    if doc_id is None or not words:
        return words
    h = binascii.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = planted(doc_id, text)
    runs = plain_runs(words)
    gone = {i for s, e, q in runs for i in range(s + q, e)}
    top = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    named = (None,) * 4
    if top:
        n, q = top[1] - top[0], top[2]
        named = (top[0], n, q, 1000 * n // q)
    return (
        doc_id, len(runs), *named,
        brute.sha("".join(f"{s},{e - s},{q}\n" for s, e, q in runs)),
        brute.sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def query(docs):
    text = pr.with_planted_period()
    return pr.collapse_runs(docs, text_col=text, digest=True)


pieces = st.lists(
    st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=12), st.integers(1, 9)),
    max_size=8,
)


@settings(max_examples=300, deadline=None)
@given(pieces)
def test_runs_of_few_letters(parts):
    words = [w for unit, times in parts for w in unit * times]
    assert pr.find_runs(np.array(words, np.int64)) == plain_runs(words)


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_nested_periods(seed):
    """Powers of words that hold powers themselves, with cut ends, at all scales."""
    rng = random.Random(seed)
    words = []
    for _ in range(rng.randrange(1, 5)):
        unit = [rng.randrange(3) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.randrange(3)):
            unit = unit * rng.randrange(1, 8) + [rng.randrange(4) for _ in range(rng.randrange(4))]
        whole = unit * rng.randrange(1, 7)
        words += whole[rng.randrange(len(unit)) : len(whole) - rng.randrange(len(unit))]
    words = words[:1500]
    assert pr.find_runs(np.array(words, np.int64)) == plain_runs(words)


@pytest.mark.parametrize("q", [1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 32, 33, 63, 64, 100])
@pytest.mark.parametrize("length", [4, 4.5])
def test_every_period_and_just_too_short(q, length):
    rng = random.Random(q)
    unit = [rng.randrange(10**6) for _ in range(q)]
    n = max(6, int(length * q))
    text = [-1] + (unit * 7)[:n] + [-2]
    assert pr.find_runs(np.array(text)) == [(1, 1 + n, q)]
    assert pr.find_runs(np.array([-1] + (unit * 7)[: max(6, 4 * q) - 1] + [-2])) == []


def test_synchronising_set_is_consistent_and_dense():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 5, 400)
    words = np.concatenate([part, rng.integers(0, 5, 300), part]).astype(np.int64)
    windows, scale = pr.mix(words.astype(np.uint64)), 1
    while scale <= 64:
        members = set(pr.synchronising_set(windows, scale).tolist())
        inside = range(len(part) - 2 * scale)
        assert {i in members for i in inside} <= {True, False}
        assert [i in members for i in inside] == [i + 700 in members for i in inside]
        last = len(words) - 3 * scale
        assert all(any(i + k in members for k in range(scale + 1)) for i in range(last))
        windows, scale = pr._joined(windows[:-scale], windows[scale:]), 2 * scale


def test_query_against_plain_version(spark, tables):
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for k in range(300)]
    rows += [(k, "\t ".join(f"w{rng.randrange(9)}" for _ in range(60))) for k in range(300, 420)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, query(docs).collect()))
    assert got == sorted(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 30


def test_query_over_documents(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("n_chars < 6000")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, query(docs).collect())) == sorted(plain_row(*r) for r in rows)


def test_texts_of_any_kind(spark, edge_docs, no_docs):
    got = {tuple(r) for r in query(edge_docs).collect()}
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    assert got == {plain_row(*r) for r in rows if len(r[1] or "") < 5000} | {
        r for r in got if r[0] in (9, 10)
    }
    assert query(edge_docs).count() == len(rows)
    assert query(no_docs).count() == 0
    assert query(no_docs).columns == [f.name for f in pr.RUN_FIELDS]
    assert pr.run_spans(no_docs).count() == 0


def test_one_word_repeated_for_long(spark):
    text = "again " * 200_000 + "and a b c " * 20_000
    docs = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert [tuple(r) for r in pr.run_spans(docs).orderBy("start").collect()] == [
        (1, 0, 200_000, 1), (1, 0, 200_000, 1), (1, 200_000, 80_000, 4), (1, 200_000, 80_000, 4)
    ]
    left = pr.collapse_runs(docs).select("n_runs", "collapsed").first()
    assert tuple(left) == (2, "again and a b c")


def test_too_few_powers_are_refused():
    with pytest.raises(ValueError):
        pr.find_runs(np.arange(5), least_powers=3)
