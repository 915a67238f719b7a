"""Classifier, license, secret and benchmark scans, sharding and packing."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from queuelens.llm import decontaminate, licenses, packing, quality, registry, secrets, sharding

SF = "/root/testdata/sf0.01"


def test_quality_separates_held_out_labels(spark):
    scored = registry.QUERIES["op1_quality_classifier"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert len(scored) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [zlib.crc32(str(d).encode()) % 3 == 1 for d in scored["doc_id"]]
    assert scored["held_out"].tolist() == held
    both = scored[scored["held_out"]].merge(labels, on="doc_id")
    good, bad = both[both.quality == 1]["score"], both[both.quality == 0]["score"]
    assert np.mean([(good > b).mean() for b in bad]) > 0.99
    assert (both["predicted"] == both["quality"]).mean() > 0.95


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    flipped = labels.selectExpr(
        "doc_id", "if(crc32(cast(doc_id as string)) % 3 = 1, 1 - quality, quality) as quality"
    )
    assert np.array_equal(quality.train_on(docs, labels), quality.train_on(docs, flipped))


def test_quality_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(4, 1), (5, 0), (None, 1), (9, None), (7, 2)], "doc_id long, quality int")
    weights = quality.train_on(edge_docs, labels)
    got = quality.score(edge_docs, weights).collect()
    assert len(got) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (1, 2, 3)}) == 1
    assert quality.score(no_docs, weights).count() == 0
    assert not quality.train_on(no_docs, labels).any()
    assert quality.accepted(edge_docs, weights * 0).count() == edge_docs.count()


def test_ftrl_keeps_useless_features_at_zero():
    rows = [(np.array([k % 2, 2 + k % 7]), np.array([1.0, 1e-6]), k % 2) for k in range(200)]
    weights = quality.ftrl(rows, quality.FtrlSettings(bits=4))
    assert weights[0] < 0 < weights[1] and not weights[2:9].any()


# the contract's patterns, as they are written there
BASE = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            size = len(m[2]) if kind == "assign" else len(m[0])
            if size >= {"assign": 8, "access": 16, "hex": 32}[kind]:
                out.append((m.start(), order, m.end()))
    return sorted(out)


@settings(max_examples=300)
@given(
    st.lists(
        st.sampled_from(
            ["token", "API_KEY", "passwd", "=", ": ", '"', "'", " ", "AKIA", "Z9", "deadbeef", "short", "é", "\n", "x" * 9]
        ),
        max_size=25,
    ).map("".join)
)
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_spans(text)


def test_secret_rows(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        texts = {(d, t or "") for d, t in ((r["doc_id"], r["text"]) for r in docs.collect())}
        got = secrets.find_secrets(docs).collect()
        assert len(got) == docs.count()
        by_id = defaultdict(list)
        for r in got:
            by_id[r["doc_id"]].append(r)
        for doc_id, text in texts:
            spans = plain_spans(text)
            joined = ",".join(f"{list(BASE)[k]}:{s}:{e}" for s, k, e in spans)
            for r in by_id[doc_id]:
                assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(
                    sum(k == n for _, k, _ in spans) for n in range(3)
                )
                assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
                assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
    assert secrets.find_secrets(no_docs).count() == 0


def test_guess_costs():
    easy = ["password", "P4ssw0rd", "qwertyuiop", "abababababab", "1987-03-21", "changeme2024", "aaaaaaaaaaaaaaaa"]
    hard = ["x7Kq9vLm2Rt", "9f86d081884c7d659a2f", "mJ+uTz/4kQ=="]
    assert max(map(secrets.guess_cost, easy)) < secrets.LEAST_GUESSES < min(map(secrets.guess_cost, hard))
    assert secrets.guess_cost("") == 0


def test_guess_adds_what_the_base_misses():
    text = "pwd => 'x7Kq9vLm2Rt!' and passphrase: password123"
    assert secrets.base_spans(text) == []
    assert [(text[s:e]) for s, e, _ in secrets.hard_values(text, 10)] == ["x7Kq9vLm2Rt!"]


def plain_segmentation(value):
    """The cheapest segmentation by trying every one."""
    costs = [secrets._character(c) for c in value]
    known = {}
    for s, e, c in secrets._matches(value, costs):
        known[s, e] = min(c, known.get((s, e), c))

    def cheapest(at):
        if at == len(value):
            return 0.0
        found = [costs[at] + cheapest(at + 1)]
        return min(found + [c + cheapest(e) for (s, e), c in known.items() if s == at])

    return cheapest(0)


@settings(max_examples=100, deadline=None)
@given(st.text("pasword12qe-", max_size=9))
def test_segmentation_is_cheapest(value):
    assert secrets.guess_cost(value) == pytest.approx(plain_segmentation(value))


def test_leaks_against_every_pair(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, items).collect()}
    squeezed = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in docs.collect()]
    for item in items.collect():
        text = " ".join(item["text"].split())
        for doc_id, body in squeezed:
            if text in body:
                assert (doc_id, item["item_id"]) in got
    assert len(got) < 0.05 * docs.count()
    split = decontaminate.find_leaks(docs, items, index_bytes=2000)
    assert {(r["doc_id"], r["item_id"]) for r in split.collect()} >= got


def test_search_finds_every_item_above_the_threshold():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) % 300) for _ in range(300)]
    index = decontaminate.Index(list(enumerate(texts)))
    for _ in range(60):
        query = {f"w{int(x)}" for x in rng.zipf(1.3, 40) % 300}
        for least in (0.1, 0.3, 0.5):
            scores = Counter()
            for w in query & set(index.postings):
                for number, impact in zip(*index.postings[w][:2]):
                    scores[number] += impact
            expected = {n for n, x in scores.items() if x >= least - 1e-9}
            assert {n for n, _ in index.search(query, least)} == expected


def test_screen_loses_no_passage():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, 25) % 200) for _ in range(60)]
    index = decontaminate.Index(list(enumerate(texts)))
    step = index.longest
    for k in range(40):
        words = [f"w{int(x)}" for x in rng.zipf(1.4, 180) % 200]
        words[40:40] = texts[k].split()
        hashes = decontaminate.word_hashes([w.encode() for w in words])
        found = set(index.screen(0.7).passages(hashes, step))
        for n, start in enumerate(range(0, max(1, len(words) - step), step)):
            if index.search(set(words[start : start + 2 * step]), 0.7):
                assert n in found


def test_leak_edges(spark, edge_docs, no_docs):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (3, "one two three"), (3, "A text. Without an id"), (None, "one")],
        "item_id long, text string",
    )
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(edge_docs, items).collect()}
    assert {(5, 3), (12, 3), (None, 3), (4, None)} <= got
    assert not {d for d, _ in got} & {1, 2, 3, 6, 7, 8}
    assert decontaminate.find_leaks(no_docs, items).count() == 0
    assert decontaminate.find_leaks(edge_docs, items.limit(0)).count() == 0
    clean = decontaminate.without_leaks(edge_docs, items)
    assert clean.columns == edge_docs.columns
    assert {r["doc_id"] for r in clean.collect()}.isdisjoint({5, 12, None, 4})


def check_pieces(docs, pieces, window=packing.WINDOW):
    vocabulary = packing.default_vocabulary()
    full = packing._full_encoder(vocabulary)
    expected, found = Counter(), Counter()
    for text in docs:
        ids = np.array([*full.encode(text[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), window):
            part = ids[s : s + window]
            expected[text[0], s, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    ends = defaultdict(list)
    for p in pieces:
        found[p["doc_id"], p["start"], p["length"], p["ids_crc32"], p["doc_tokens"]] += 1
        ends[p["sequence_id"]].append((p["offset"], p["length"]))
    assert found == expected
    for places in ends.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= window
    return len(ends)


def test_packing(spark, edge_docs, no_docs):
    for docs in (edge_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        pieces = packing.pack(docs).collect()
        sequences = check_pieces(rows, pieces)
        least = -(-sum(p["length"] for p in pieces) // packing.WINDOW)
        assert sequences <= 1.05 * least + 1
    assert packing.pack(no_docs).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_both_tokenizers_agree(text):
    vocabulary = packing.default_vocabulary()
    full = packing._full_encoder(vocabulary).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text, vocabulary).tolist() == full


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=300))
def test_plan_uses_every_piece_once(lengths):
    histogram = np.bincount(lengths, minlength=33)
    plan = packing.plan_sequences(histogram, 32)
    used = Counter()
    for need, times in plan:
        assert sum(need) <= 32 and times > 0
        for n in need:
            used[n] += times
    assert used == Counter(lengths)
    taken = Counter()
    for length, lo, hi, _, _ in packing.rank_intervals(plan):
        assert lo == taken[length]
        taken[length] = hi
    assert taken == used


def members(combo):
    first, times, *others = combo.tolist()
    return [first] * times + [n for n in others if n]


def test_fit_reaches_a_histogram_that_combinations_can_make():
    combos = packing.combinations(np.arange(1, 65), 64)
    rng = np.random.default_rng(0)
    target = np.zeros(65)
    for i in rng.integers(0, len(combos), 40):
        np.add.at(target, members(combos[i]), rng.integers(1, 50))
    x = packing.fit_repeats(combos, target, rounds=500)
    made = packing._used(combos, x, 65)
    assert (x >= 0).all() and np.abs(made - target).sum() < 0.02 * target.sum()
    some, y = packing.fit_all(combos, target)
    assert np.abs(packing._used(some, y, 65) - target).sum() < 0.05 * target.sum()


def test_all_shallow_combinations_are_there():
    lengths = np.array([3, 5, 6, 7, 11, 12, 20, 26, 32])
    found = {tuple(sorted(members(c))) for c in packing.combinations(lengths, 32)}
    assert all(sum(c) == 32 and set(c) <= set(lengths.tolist()) for c in found)
    shallow = {
        c for n in (1, 2, 3) for c in itertools.combinations_with_replacement(lengths.tolist(), n)
        if sum(c) == 32
    }
    assert shallow and shallow <= found
    # lengths under a third of the window: the longest repeats
    assert (5, 5, 5, 5, 6, 6) not in found and (5, 7, 7, 7, 6) not in found
    assert tuple(sorted((7, 7, 7, 6, 5))) in found and tuple(sorted((6, 6, 6, 6, 5, 3))) in found


@pytest.mark.parametrize("longest", [40, 600, 2047])
def test_short_lengths_are_fitted_too(longest, monkeypatch):
    """Also where no length is a third of the window, most pieces are placed by the fit."""
    rng = np.random.default_rng(longest)
    lengths = np.minimum(rng.exponential(longest / 3, 60_000).astype(int) + 1, longest)
    histogram = np.bincount(lengths, minlength=2049)
    fitted = []
    fit = packing.fit_all
    monkeypatch.setattr(packing, "fit_all", lambda *a: fitted.append(fit(*a)) or fitted[0])
    plan = packing.plan_sequences(histogram, 2048)
    (combos, x), = fitted
    assert packing._used(combos, x, 2049).sum() > 0.8 * len(lengths)
    used, sequences = Counter(), sum(times for _, times in plan)
    for need, times in plan:
        for n in need:
            used[n] += times
    assert used == Counter(lengths.tolist())
    assert sequences <= 1.002 * -(-int(lengths.sum()) // 2048) + 1


def plain_leaks(docs, items, least_score=decontaminate.LEAST_SCORE, least_overlap=decontaminate.LEAST_OVERLAP):
    """{(doc_id, item_id)}: BM25 of every passage and item, from the formula, without an index."""
    words = [decontaminate.terms(t) for _, t in items]
    n, average = len(words), sum(map(len, words)) / len(words)
    step = max(map(len, words))
    held = Counter(w for ws in words for w in set(ws))
    weights = []
    for ws in words:
        k = decontaminate.K1 * (1 - decontaminate.B + decontaminate.B * len(ws) / average)
        weights.append({
            w: np.log1p((n - held[w] + 0.5) / (held[w] + 0.5)) * tf * (decontaminate.K1 + 1) / (tf + k)
            for w, tf in Counter(ws).items()
        })
    out = set()
    for doc_id, text in docs:
        own = decontaminate.terms(text or "")
        for start in range(0, max(1, len(own) - step), step):
            passage = own[start : start + 2 * step]
            there = set(passage)
            for (item_id, item), weight in zip(items, weights):
                total = sum(weight.values())
                score = sum(x for w, x in weight.items() if w in there) / total if total else 0
                if score >= least_score:
                    parts = decontaminate.question_and_answer(item)
                    if min(decontaminate.overlap(part, passage) for part in parts) >= least_overlap:
                        out.add((doc_id, item_id))
    return out


def test_leaks_against_every_passage_and_item(spark, tables):
    items = [tuple(r) for r in spark.read.parquet(f"{tables}/benchmark.parquet").select("item_id", "text").collect()]
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    expected = plain_leaks([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    got = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected and expected


def test_leaks_do_not_depend_on_how_items_are_split(spark, tables):
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    whole = {r[:2]: r[2:] for r in map(tuple, decontaminate.find_leaks(docs, items).collect())}
    for index_bytes in (3000, 9000):
        split = decontaminate.find_leaks(docs, items, index_bytes=index_bytes).collect()
        found = {r[:2]: r[2:] for r in map(tuple, split)}
        assert found.keys() == whole.keys() and whole
        for key, row in whole.items():
            assert found[key][0] == row[0] and found[key][1:] == pytest.approx(row[1:], rel=1e-12)


def test_lookup_table_is_even_and_steady():
    names = [f"s{k}" for k in range(20)]
    table = sharding.lookup_table(names, 5003)
    counts = np.bincount(table, minlength=20)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(names[:-1], 5003)
    kept = table != 19
    assert (table[kept] == fewer[kept]).mean() > 0.85
    assert np.array_equal(np.array(names)[table], np.array(names[::-1])[sharding.lookup_table(names[::-1], 5003)])
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 5000)


def test_placement(spark, edge_docs, no_docs):
    names = [f"shard-{k:03d}" for k in range(256)]
    table = sharding.lookup_table(names)
    for docs in (edge_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        got = sharding.place(docs, names).collect()
        assert len(got) == docs.count()
        for r in got:
            key = "" if r["doc_id"] is None else str(r["doc_id"])
            slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
            assert (r["slot"], r["shard"]) == (slot, names[table[slot]])
    assert sharding.place(no_docs, names).count() == 0


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id")
    placed = sharding.place(docs, ["a", "b", "c"])
    sharding.write_shards(placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"]: r["shard"] for r in back.collect()} == {
        r["doc_id"]: r["shard"] for r in placed.collect()
    }
    assert sum(r["rows"] for r in sharding.manifest(placed).collect()) == docs.count()


FILES = [
    (1, "LICENSE", "Released under the MIT License."),
    (2, "a.txt", "plain text"),
    (3, "lib/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
    (4, "lib/x/y/code.txt", "no notice"),
    (5, "lib/x/own.txt", "code\nAll rights reserved."),
    (6, "library/z.txt", None),
    (7, None, ""),
    (8, "lib/x/COPYING", "licence talk without a match of any kind whatsoever here"),
    (4, "lib/x/y/code.txt", "no notice"),
]


def test_licenses(spark):
    files = spark.createDataFrame(FILES, "file_id long, path string, text string")
    got = defaultdict(list)
    for r in licenses.scan_licenses(files).collect():
        got[r["file_id"]].append((r["license"], r["basis"], r["declared_in"]))
    assert got == {
        1: [("MIT", "header", None)],
        2: [("MIT", "directory", "")],
        3: [("Apache-2.0", "header", None)],
        4: [("Apache-2.0", "directory", "lib")] * 2,
        5: [("Proprietary", "header", None)],
        6: [("MIT", "directory", "")],
        7: [("MIT", "directory", "")],
        8: [("Apache-2.0", "directory", "lib")],
    }
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_license_query_against_plain_inheritance(spark):
    rows = registry.QUERIES["op2_license_scans"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    declared = {}
    for r in rows:
        name = r["path"].rpartition("/")[2]
        if name.startswith("LICENSE") and r["own_license"]:
            place = r["path"].rpartition("/")[0]
            declared[place] = min(declared.get(place, (9, "")), (-r["cosine"], r["path"], r["own_license"]))
    for r in rows:
        expected = r["own_license"]
        place = r["path"]
        while not expected and place:
            place = place.rpartition("/")[0]
            expected = declared[place][2] if place in declared else None
        assert r["license"] == expected


def test_notices_are_found_in_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in registry.QUERIES["op2_license_scans"](spark, SF).collect():
        for words, name in (
            ("Apache License, Version 2.0", "Apache-2.0"),
            ("MIT License", "MIT"),
            ("GNU General Public License, version 3", "GPL-3.0"),
        ):
            if words in texts[r["doc_id"]]:
                assert r["own_license"] == name


@pytest.mark.parametrize(
    "text, names, line",
    [
        (
            "code\n# This program is free software; you can redistribute it and/or modify\n# it under the terms of "
            "the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of "
            "the License, or\n# (at your option) any later version.",
            ["GPL-2.0"],
            1,
        ),
        (
            " * modify it under the terms of the GNU Lesser General Public\n * License as published by the Free "
            "Software Foundation; either\n * version 2.1 of the License, or (at your option) any later version.",
            ["LGPL-2.1"],
            0,
        ),
        (
            "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and "
            "associated documentation files (the Software), to deal\nin the Software without restriction",
            ["MIT"],
            0,
        ),
        (f"{'words ' * 15} Licensed under the Apache License, Version 2.0 {'more ' * 15}", ["Apache-2.0"], 0),
        ("x\nMIT License\ny\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"], 1),
        ("Copyright X. All rights reserved.\nReleased under the\nMIT License.", ["MIT", "Proprietary"], 1),
        ("all the rights of a license, and the general public", [], None),
    ],
)
def test_notices_across_lines_and_inside_them(text, names, line):
    found = licenses.Templates().notices(text, licenses.LEAST_COSINE)
    assert [n for _, n, _ in found] == names
    assert (licenses._line_of(text, found[0][2]) if found else None) == line


def test_all_licenses_of_a_file_are_returned(spark):
    rows = [(1, "a", "MIT License\nx\nLicensed under the Apache License, Version 2.0."), (2, "b", None)]
    files = spark.createDataFrame(rows, "file_id long, path string, text string")
    got = {r["file_id"]: r["own_licenses"] for r in licenses.scan_licenses(files).collect()}
    assert got == {1: ["MIT", "Apache-2.0"], 2: []}


#: every notice line of the given tables
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
}


def test_every_notice_line_of_the_tables_is_found(spark):
    notices = re.compile(r"licen[cs]e|rights reserved|copyright|public domain|spdx", re.I)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_license_scans"](spark, SF).collect()}
    for doc_id, text in texts.items():
        lines = [x for x in (text or "").split("\n") if notices.search(x)]
        assert set(got[doc_id]["own_licenses"]) == {LINES[x] for x in lines}


@pytest.mark.parametrize("parts", ["BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND"])
@pytest.mark.parametrize("version", ["4.0", "3.0", "2.5", "2.0", "1.0"])
def test_creative_commons(parts, version):
    words = {"BY": "Attribution", "SA": "ShareAlike", "NC": "NonCommercial", "ND": "NoDerivatives"}
    spoken = "-".join(words[p] for p in parts.split("-"))
    for text in (
        f"Licensed under CC {parts} {version}.",
        f"SPDX-License-Identifier: CC-{parts}-{version}",
        f"This work is licensed under a Creative Commons {spoken} {version} International License.",
        f"https://creativecommons.org/licenses/{parts.lower()}/{version}/",
    ):
        found = licenses.Templates().notices(text, licenses.LEAST_COSINE)
        assert [n for _, n, _ in found] == [f"CC-{parts}-{version}"]


@pytest.mark.parametrize(
    "name", [*licenses.TEMPLATES, "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "EUPL-1.2", "CC0-1.0"]
)
def test_spdx_identifiers(name):
    if name != "Proprietary":
        found = licenses.Templates().notices(f"// SPDX-License-Identifier: {name}", licenses.LEAST_COSINE)
        assert [n for _, n, _ in found] == [name]


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "ü 漢字 <|endoftext|>\n<|endoftext|>x", "a <|endoftext b"])
def test_added_tokens_have_the_ids_of_a_fresh_tokenizer(spark, text):
    from tokenizers import Tokenizer

    vocabulary = packing.default_vocabulary()
    ids = Tokenizer.from_file(vocabulary).encode(text, add_special_tokens=False).ids
    assert packing.token_ids(text, vocabulary).tolist() == ids
    (piece,) = packing.pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    crc = zlib.crc32(np.array([*ids, packing.END], "<u4").tobytes())
    assert (piece["doc_tokens"], piece["ids_crc32"]) == (len(ids) + 1, crc)
