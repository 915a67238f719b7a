"""SQL counterparts of the queries, for checking results in a second engine.

Written against the given tables only and without any of the package's code:
plain, single-pass-be-damned SQL whose one aim is to be obviously right.
"""

from oracle.cleaning import CLEANING
from oracle.metrics import METRICS
from oracle.statistics import STATISTICS
from oracle.values import REPORTS

ORACLE_SQL: dict[str, str] = {**CLEANING, **METRICS, **STATISTICS}


def _cells(cut: str, query: str) -> str:
    """Filled cells of one report; a row is named by its cells that are no numbers."""
    return f"""(
WITH numbered AS (SELECT row_number() OVER () AS rn, * FROM ({query})),
cells AS (UNPIVOT (SELECT rn, COLUMNS(* EXCLUDE (rn))::VARCHAR FROM numbered)
          ON COLUMNS(* EXCLUDE (rn)) INTO NAME "column" VALUE cell),
filled AS (SELECT rn, "column", cell, TRY_CAST(cell AS DOUBLE) AS number FROM cells
           WHERE cell <> ''),
keys AS (SELECT rn, string_agg(cell, '|' ORDER BY "column") AS row FROM filled
         WHERE number IS NULL GROUP BY rn)
SELECT '{cut}' AS cut, coalesce(keys.row, '') AS row, "column",
       CASE WHEN number IS NULL THEN cell END AS value, number
FROM filled LEFT JOIN keys ON keys.rn = filled.rn)"""


ORACLE_SQL["write_cuts"] = " UNION ALL ".join(
    f"SELECT * FROM {_cells(cut, ORACLE_SQL[query])}" for cut, query in REPORTS.items()
)
