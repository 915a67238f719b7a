"""Mixture model and significance tests against brute force on small inputs."""

import itertools
import math
import random

import pytest
from helpers import clean_rows, scored
from pyspark.mllib.linalg import Matrices, Vectors
from pyspark.mllib.stat import Statistics

from queuelens.operators import inference as i
from queuelens.operators import mixture as x
from queuelens.profile import TicketProfile

PROFILE = TicketProfile()


def test_mixture_recovers_its_groups(spark):
    # 100 per score on the short scale, 20 per score on the long one
    tickets = scored(spark, {s: 120 if s <= 5 else 20 for s in range(1, 11)})
    split = x.scale_population_split(tickets, PROFILE).first()
    assert (split["scored"], split["n_1_10_scale"], split["n_1_5_scale"]) == (700, 200.0, 500.0)
    assert split["predicted_low_score_percentage"] == split["observed_low_score_percentage"] == 34.3
    rows = x.scale_deconvolution(tickets, PROFILE).collect()
    assert {r["from_1_5_scale"] for r in rows} == {100.0, None}
    for test in (i.gof_upper_scores, i.gof_lower_scores, i.gof_full_mixture):
        out = test(tickets, PROFILE).first()
        assert (out["chi2"], out["p_value"]) == (0.0, 1.0)


def test_absent_scores_count_as_zero(spark):
    tickets = scored(spark, {1: 30, 2: 30, 3: 30, 4: 30, 5: 30, 6: 5, 8: 5, 10: 5})
    assert x.score_counts(tickets, PROFILE).first()["observed"] == [30] * 5 + [5, 0, 5, 0, 5]
    out = i.gof_upper_scores(tickets, PROFILE).first()
    assert out["chi2"] == pytest.approx(sum((o - 3) ** 2 / 3 for o in (5, 0, 5, 0, 5)), abs=1e-4)


def test_gof_agrees_with_mllib(spark):
    counts = dict(zip(range(1, 11), (31, 44, 29, 38, 35, 12, 9, 15, 7, 11)))
    out = i.gof_upper_scores(scored(spark, counts), PROFILE).first()
    want = Statistics.chiSqTest(Vectors.dense([counts[s] for s in range(6, 11)]))
    assert out["chi2"] == pytest.approx(want.statistic, abs=1e-4)
    assert out["p_value"] == pytest.approx(want.pValue, abs=1e-4)
    assert out["dof"] == want.degreesOfFreedom


def test_independence_agrees_with_mllib(spark):
    table = {"email": (10, 40), "phone": (22, 31), "chat": (5, 17)}
    rows = [
        {"channel": c, "satisfaction_score": s, "has_satisfaction": True, "is_bottom_box": s == 1}
        for c, (low, rest) in table.items()
        for s in [1] * low + [5] * rest
    ]
    tests = {
        r["dimension"]: r
        for r in i.chi2_low_score_by_dim(clean_rows(spark, *rows), PROFILE).collect()
    }
    low, rest = zip(*table.values())
    want = Statistics.chiSqTest(Matrices.dense(3, 2, list(low) + list(rest)))
    assert tests["channel"]["chi2"] == pytest.approx(want.statistic, abs=1e-4)
    assert tests["channel"]["p_value"] == pytest.approx(want.pValue, abs=1e-4)
    # one brand only: nothing to test
    assert (tests["brand"]["dof"], tests["brand"]["p_value"]) == (0, None)


def test_two_by_two_is_continuity_corrected(spark):
    observed = {"email": (12, 30), "chat": (20, 18)}
    rows = [
        {"channel": c, "satisfaction_score": s, "has_satisfaction": True, "is_bottom_box": s == 1}
        for c, (low, rest) in observed.items()
        for s in [1] * low + [5] * rest
    ]
    total = 80
    want = 0.0
    for c, (low, rest) in observed.items():
        for seen, column in ((low, 32), (rest, 48)):
            expected = (low + rest) * column / total
            want += max(abs(seen - expected) - 0.5, 0) ** 2 / expected
    tests = i.chi2_low_score_by_dim(clean_rows(spark, *rows), PROFILE)
    got = tests.filter("dimension = 'channel'").first()
    assert got["chi2"] == pytest.approx(want, abs=1e-4) and got["dof"] == 1


def brute_kruskal(groups):
    everything = sorted(v for g in groups for v in g)
    n = len(everything)
    rank = {}
    for value, run in itertools.groupby(enumerate(everything, 1), key=lambda p: p[1]):
        places = [p for p, _ in run]
        rank[value] = (sum(places) / len(places), len(places))
    h = 12 / (n * (n + 1)) * sum(sum(rank[v][0] for v in g) ** 2 / len(g) for g in groups)
    h -= 3 * (n + 1)
    return h / (1 - sum(t**3 - t for _, t in rank.values()) / (n**3 - n))


@pytest.mark.parametrize("width", [0.5, 7, 1000])
def test_kruskal_is_exact_for_any_bucket_width(spark, width):
    rng = random.Random(3)
    groups = {g: [float(rng.randint(0, 40 + 5 * k)) for _ in range(60)] for k, g in enumerate("abc")}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double")
    out = i.kruskal_wallis(df, "v", "g", width).first()
    assert out["chi2"] == pytest.approx(brute_kruskal(groups.values()), rel=1e-9)
    assert (out["n"], out["groups"], out["dof"]) == (180, 3, 2)


def test_kruskal_of_equal_values_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("b", 1.0)], "g string, v double")
    assert i.kruskal_wallis(df, "v", "g", 24).first()["chi2"] is None


def test_cell_against_total(spark):
    rows = [
        {"category": k, "channel": "chat", "satisfaction_score": s, "has_satisfaction": True, "is_bottom_box": s == 1}
        for k, scores in {"Billing": [1] * 30 + [5] * 20, "Cancellation": [1] * 20 + [5] * 80}.items()
        for s in scores
    ]
    out = i.two_prop_z_cells(clean_rows(spark, *rows), PROFILE).collect()
    pooled = (30 + 50) / (50 + 150)
    z = (30 / 50 - 50 / 150) / math.sqrt(pooled * (1 - pooled) * (1 / 50 + 1 / 150))
    worst = out[0]
    assert (worst["category"], worst["cell_percentage"]) == ("Billing", 60.0)
    assert worst["z"] == pytest.approx(z, abs=1e-4)
    assert worst["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), abs=1e-4)
    assert worst["bonferroni_threshold"] == 0.025 and worst["survives_correction"] is True


@pytest.mark.parametrize("width", [0.5, 24.0, 1e9])
def test_selected_quantiles_are_exact(spark, width):
    """Against the built-in percentile, with ties, gaps, negatives, NULL and few values."""
    import random

    from queuelens.plans.shapes import select_quantiles, weighted_quantile

    rng = random.Random(6)
    cases = [[(None, 3)], [(5.0, 1)], [(5.0, 1), (7.0, 1)], []]
    cases += [
        [(rng.choice([None, rng.randrange(-90, 900) / 7, 3.0]), rng.randrange(1, 9)) for _ in range(n)]
        for n in (3, 40, 300)
    ]
    qs = {"low": 0.0, "a": 0.1, "half": 0.5, "b": 0.75, "high": 1.0}
    for rows in cases:
        df = spark.createDataFrame(rows, "v double, n long")
        got = select_quantiles(df, "v", qs, width).first()
        expected = df.agg(*[weighted_quantile("v", q).alias(name) for name, q in qs.items()]).first()
        assert got.asDict() == expected.asDict()
