"""Mixed rating scales and significance tests."""

from oracle import values
from oracle.base import chi2_tail, erfc, n_if, on_clean, pct

# ten rows, absent scores as 0; h = height of the long scale, t = all scored
SCORES = """scores AS (
  SELECT s, (SELECT count(*) FROM tix WHERE satisfaction_score = s) AS n
  FROM (SELECT unnest(range(1, 11)) AS s)),
model AS (
  SELECT sum(CASE WHEN s > 5 THEN n ELSE 0 END)::DOUBLE / 5 AS h, sum(n)::DOUBLE AS t FROM scores)"""

# The variants, their descriptions and the verdict texts below are fixed values.
SWING = """swing AS (
  SELECT variant, approach, round(value, 1) AS satisfaction_percentage FROM (
    SELECT avg(x) * 10 AS a, avg(x) * 20 AS b, avg(x - 1) * 100 / 9 AS c, avg(x - 1) * 25 AS d,
           avg(CASE WHEN x > 5 THEN (x - 1) / 9.0::DOUBLE ELSE (x - 1) / 4.0::DOUBLE END) * 100 AS e,
           100.0::DOUBLE * count(CASE WHEN x IN (4, 5, 8, 9, 10) THEN 1 END) / count(*) AS f,
           100.0::DOUBLE * count(CASE WHEN x >= 4 THEN 1 END) / count(*) AS g,
           100 - 100.0::DOUBLE * count(CASE WHEN x <= 2 THEN 1 END) / count(*) AS hh,
           100 - 100.0::DOUBLE * count(CASE WHEN x <= 3 THEN 1 END) / count(*) AS i
    FROM (SELECT satisfaction_score AS x FROM tix WHERE has_satisfaction)
  ), LATERAL (VALUES
    ('A', 'Naive mean, reported as "out of 10"', a),
    ('B', 'Naive mean, reported as "out of 5"', b),
    ('C', 'Normalise everything as 1-10: (x-1)/9', c),
    ('D', 'Normalise everything as 1-5: (x-1)/4', d),
    ('E', 'Rule: score >5 came from 1-10, else 1-5', e),
    ('F', 'Top-box, scale-aware (4-5 or 8-10)', f),
    ('G', 'Top-box, naive (>=4)', g),
    ('H', '100 - bottom-box(1-2)  [the old instrument]', hh),
    ('I', '100 - bottom(1-3)', i),
    ('J', 'Mixture model: the defensible answer', 50.0::DOUBLE)
  ) AS v(variant, approach, value))"""


def _verdict(p: str, quiet: str, loud: str) -> str:
    return f"CASE WHEN {p} > 0.05 THEN '{quiet}' WHEN {p} IS NOT NULL THEN '{loud}' END AS verdict"


def _independence(hit: str, dims: tuple[str, ...], keep: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, {d} AS segment, {hit} AS hit FROM tix"
        f" WHERE has_satisfaction AND {keep.format(d)}"
        for d in dims
    )
    cells = f"""obs AS ({rows}),
segs AS (SELECT DISTINCT dimension, segment FROM obs),
cells AS (
  SELECT g.dimension, g.segment, o.hit AS hit,
         (SELECT count(*) FROM obs x WHERE x.dimension = g.dimension
            AND x.segment IS NOT DISTINCT FROM g.segment AND x.hit = o.hit)::DOUBLE AS seen,
         (SELECT count(*) FROM obs x WHERE x.dimension = g.dimension
            AND x.segment IS NOT DISTINCT FROM g.segment)::DOUBLE
         * (SELECT count(*) FROM obs x WHERE x.dimension = g.dimension AND x.hit = o.hit)
         / (SELECT count(*) FROM obs x WHERE x.dimension = g.dimension) AS wanted,
         (SELECT count(*) FROM segs s WHERE s.dimension = g.dimension) AS k
  FROM segs g, (VALUES (TRUE), (FALSE)) o(hit)),
tests AS (
  SELECT dimension, max(k) - 1 AS dof,
         sum(pow(CASE WHEN k = 2 THEN greatest(abs(seen - wanted) - 0.5, 0)
                      ELSE abs(seen - wanted) END, 2) / wanted) AS x2
  FROM cells GROUP BY dimension),
judged AS (SELECT *, {chi2_tail('x2', 'dof')} AS p FROM tests)"""
    return on_clean(
        f"""SELECT dimension, round(x2, 4) AS chi2, dof, round(p, 4) AS p_value,
                   {_verdict('p', 'NOT significant (within noise)', 'SIGNIFICANT')} FROM judged""",
        cells,
    )


def _gof(terms: str, dof: int, quiet: str, loud: str, source: str) -> str:
    return on_clean(
        f"""SELECT round(x2, 4) AS chi2, {dof}::BIGINT AS dof, round(p, 4) AS p_value,
                   {_verdict('p', quiet, loud)}
            FROM (SELECT x2, {chi2_tail('x2', str(dof))} AS p
                  FROM (SELECT sum({terms}) AS x2 FROM {source}))""",
        SCORES,
    )


STATISTICS = {
    "scale_deconvolution": on_clean(
        """SELECT CAST(s AS INTEGER) AS score, n AS observed, round(h, 1) AS from_1_10_scale,
                  CASE WHEN s <= 5 THEN round(n - h, 1) END AS from_1_5_scale,
                  round(CASE WHEN s <= 5 THEN t / 5 - h ELSE h END, 1) AS expected_if_random
           FROM scores, model WHERE n > 0""",
        SCORES,
    ),
    "scale_population_split": on_clean(
        f"""SELECT CAST(t AS BIGINT) AS scored, round(10 * h, 0) AS n_1_10_scale,
                   {pct('10 * h', 't')} AS pct_1_10_scale, round(t - 10 * h, 0) AS n_1_5_scale,
                   {pct('t - 10 * h', 't')} AS pct_1_5_scale,
                   {pct('(t - 10 * h) * 0.4 + 10 * h * 0.2', 't')} AS predicted_low_score_percentage,
                   {pct('(SELECT sum(n) FROM scores WHERE s <= 2)', 't')}
                     AS observed_low_score_percentage
            FROM model""",
        SCORES,
    ),
    "methodology_swing": on_clean("SELECT * FROM swing", SWING),
    "methodology_gap": on_clean(
        """SELECT round(least(b, c), 1) AS lowest, round(greatest(b, c), 1) AS highest,
                  round(abs(b - c), 1) AS swing_points
           FROM (SELECT avg(satisfaction_score) * 20 AS b,
                        avg(satisfaction_score - 1) * 100 / 9 AS c FROM tix)"""
    ),
    "scale_detector_by_dimension": on_clean(
        """SELECT dimension, segment, n, k, round(100 * k::DOUBLE / nullif(n, 0), 4) AS score_above_5_percentage,
                  round(100 * 1.96 * sqrt((k::DOUBLE / nullif(n, 0)) * (1 - k::DOUBLE / nullif(n, 0)) / nullif(n, 0)), 4)
                    AS ci95_half_width
           FROM ("""
        + " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {c} AS segment, {n_if('has_satisfaction')} AS n,"
            f" {n_if('satisfaction_score > 5')} AS k FROM tix WHERE {c} IS NOT NULL GROUP BY 2"
            for d, c in (
                ("ALL", "'ALL'"),
                ("brand", "brand"),
                ("channel", "channel"),
                ("team", "team"),
                ("location", "location"),
            )
        )
        + ")"
    ),
    "mart_swing_ranked": on_clean(
        """SELECT *, variant = 'J' AS is_highlighted,
                  (SELECT count(*) FROM swing) AS methods,
                  (SELECT min(satisfaction_percentage) FROM swing) AS lowest,
                  (SELECT max(satisfaction_percentage) FROM swing) AS highest,
                  round((SELECT max(satisfaction_percentage) - min(satisfaction_percentage)
                         FROM swing), 1) AS range_points
           FROM swing""",
        SWING,
    ),
    "chi2_low_score_by_dim": _independence(
        "is_bottom_box", ("category", "channel", "brand", "priority"), "TRUE"
    ),
    "chi2_scale_by_dim": _independence(
        "satisfaction_score > 5", ("brand", "channel", "team", "location"), "{} IS NOT NULL"
    ),
    "kruskal_resolution_by_priority": on_clean(
        f"""SELECT n, groups, round(h, 4) AS h_statistic, groups - 1 AS dof,
                   round(p, 4) AS p_value,
                   {_verdict('p', 'NOT significant (priority does not change speed)', 'SIGNIFICANT')}
            FROM (SELECT *, {chi2_tail('h', 'groups - 1')} AS p FROM (
              SELECT any_value(total) AS n, count(*) AS groups,
                     (12.0::DOUBLE / (any_value(total) * (any_value(total) + 1.0::DOUBLE)) * sum(r * r / size)
                      - 3 * (any_value(total) + 1))
                     / (1 - (SELECT sum(t * t * t - t) FROM (SELECT count(*)::DOUBLE AS t FROM ranked GROUP BY resolution_hours))
                            / (pow(any_value(total), 3) - any_value(total))) AS h
              FROM (SELECT priority, count(*)::DOUBLE AS size, sum(rk) AS r,
                           (SELECT count(*) FROM ranked) AS total FROM ranked GROUP BY priority)))""",
        f"""ranked AS (
             SELECT priority, resolution_hours,
                    rank() OVER (ORDER BY resolution_hours)
                      + (count(*) OVER (PARTITION BY resolution_hours) - 1) / 2.0::DOUBLE AS rk
             FROM tix WHERE v AND resolution_hours IS NOT NULL
               AND priority IN {values.listed(values.PRIORITIES)})""",
    ),
    "two_prop_z_cells": on_clean(
        f"""SELECT category, channel, cell_n, round(100 * r, 1) AS cell_percentage,
                   round(100 * q, 1) AS overall_percentage, round(z, 4) + 0.0 AS z,
                   round(p, 4) AS p_value, p < 0.05 AS below_plain_threshold,
                   round(0.05::DOUBLE / cells, 6) AS bonferroni_threshold,
                   p < 0.05::DOUBLE / cells AS survives_correction
            FROM (SELECT *, {erfc('abs(z) / sqrt(2)')} AS p FROM (
              SELECT *, (r - q) / sqrt(m * (1 - m) * (1.0::DOUBLE / nullif(cell_n, 0) + 1.0::DOUBLE / all_n)) AS z
              FROM (SELECT *, bad::DOUBLE / nullif(cell_n, 0) AS r, all_bad::DOUBLE / all_n AS q,
                           (bad + all_bad)::DOUBLE / (cell_n + all_n) AS m,
                           (SELECT count(*) FROM cells) AS cells
                    FROM cells, (SELECT {n_if('has_satisfaction')} AS all_n,
                                        {n_if('is_bottom_box')} AS all_bad FROM tix))))""",
        f"""cells AS (SELECT category, channel, {n_if('has_satisfaction')} AS cell_n,
                             {n_if('is_bottom_box')} AS bad FROM tix GROUP BY 1, 2)""",
    ),
    "gof_upper_scores": _gof(
        "pow(n - h, 2) / h", 4, "yes, flat", "no", "scores, model WHERE s > 5"
    ),
    "gof_lower_scores": _gof(
        "pow((n - h) - (SELECT avg(n - h) FROM scores, model WHERE s <= 5), 2)"
        " / (SELECT avg(n - h) FROM scores, model WHERE s <= 5)",
        4,
        "yes, flat",
        "no",
        "scores, model WHERE s <= 5",
    ),
    "gof_full_mixture": _gof(
        "CASE WHEN s <= 5 THEN pow(n - (t / 5 - h), 2) / (t / 5 - h) ELSE pow(n - h, 2) / h END",
        7,
        "MODEL FITS",
        "model rejected",
        "scores, model",
    ),
}
