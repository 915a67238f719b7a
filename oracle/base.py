"""Common table expressions and small SQL snippets."""

from oracle import values

# raw: the ticket feed derived from orders and customer, blanks as NULL.  Its spellings,
# moduli and texts are fixed values of the feed.
FEED = """
raw AS (
  WITH placed AS (
    SELECT o_orderkey AS k, o_custkey % 6 AS cat_no, c_mktsegment AS brand,
           o_orderpriority AS priority,
           o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS opened
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  ), closed AS (
    SELECT *,
           CASE WHEN k % 13 = 0 THEN NULL
                WHEN k % 350 = 1 THEN opened - to_seconds(7200)
                WHEN k % 400 = 2 THEN opened + to_seconds(13800000)
                ELSE opened + to_seconds((k * 6007) % 172800) END AS shut,
           ['Bill', 'billing', 'BOOKING CHANGE', 'Technical Issue', ' cancellation',
            'General Query'][cat_no + 1] AS spelled
    FROM placed
  ), copies AS (
    SELECT *, spelled AS category FROM closed
    UNION ALL SELECT *, spelled FROM closed WHERE k % 85 = 0
    UNION ALL SELECT *, 'General Query' FROM closed WHERE k % 970 = 1
  )
  SELECT CASE WHEN k % 505 <> 12 THEN CAST(k AS VARCHAR) END AS ticket_id,
         brand,
         CASE WHEN k % 223 = 6 THEN ' Carrier "pigeon", e-mailed'
              ELSE ['Email', 'e-mail', 'PHONE ', 'chat', ' Social', 'email'][k % 6 + 1]
         END AS channel,
         CASE WHEN k % 211 = 5 THEN 'Refund request, "urgent" ' ELSE category END AS category,
         CASE WHEN k % 509 = 13 THEN 'Critical' ELSE priority END AS priority,
         CASE WHEN k % 401 = 10 THEN 'not a date'
              WHEN k % 331 = 11 THEN replace(opened_text, ' ', '  ') || chr(9)
              ELSE opened_text END AS created_at,
         CASE WHEN k % 331 = 11 THEN replace(shut_text, ' ', '  ') || chr(9)
              ELSE shut_text END AS resolved_at,
         CASE WHEN k % 250 = 3 THEN '  '
              WHEN k % 301 = 7 THEN 'A999'
              WHEN k % 125 <> 3 THEN 'A' || CAST((k * 31) % 59 AS VARCHAR) END AS agent_id,
         CASE WHEN k % 307 = 8 THEN '7.5'
              WHEN k % 311 = 9 THEN 'n/a'
              WHEN (k * 7907) % 11 >= 3 THEN CAST(
           CASE WHEN (k * 7901) % 7 < 2 THEN (k * 7883) % 10 + 1
                ELSE (k * 7883) % 5 + 1 END AS VARCHAR) END AS satisfaction_score
  FROM (SELECT *,
               CASE WHEN k % 5 = 0 THEN strftime(opened, '%d/%m/%Y %H:%M')
                    ELSE strftime(opened, '%Y-%m-%d %H:%M:%S') END AS opened_text,
               CASE WHEN k % 5 = 0 THEN strftime(shut, '%d/%m/%Y %H:%M')
                    ELSE strftime(shut, '%Y-%m-%d %H:%M:%S') END AS shut_text
        FROM copies)
),
agents AS (
  SELECT 'A' || CAST(no AS VARCHAR) AS agent_id,
         ['Tier 1', 'Tier 2', 'Specialist'][no % 3 + 1] AS team,
         DATE '1994-06-01' + CAST((no * 97) % 2000 AS INTEGER) AS hire_date,
         ['Bucharest', 'Lisbon', 'Manila', 'Remote'][no % 4 + 1] AS location
  FROM (SELECT DISTINCT (o_orderkey * 31) % 59 AS no FROM orders)
)"""

# typed: one row per distinct raw row, labels folded and text turned into values
_FORMATS = "[" + ", ".join(f"'{f}'" for f in values.TIMESTAMP_FORMATS) + "]"
_LABELS = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in values.CATEGORY_LABELS.items()) + "}"
TYPED = f""",
uniq AS (SELECT ticket_id, brand, channel, category, priority, created_at, resolved_at, agent_id,
                satisfaction_score FROM raw GROUP BY ALL),
typed AS (
  SELECT ticket_id, brand,
         CASE WHEN lower(trim(channel)) = 'e-mail' THEN 'email'
              ELSE lower(trim(channel)) END AS channel,
         coalesce({_LABELS}[lower(trim(category))], trim(category)) AS category,
         priority,
         try_strptime(created_at, {_FORMATS}) AS created_at,
         try_strptime(resolved_at, {_FORMATS}) AS resolved_at,
         nullif(trim(agent_id), '') AS agent_id,
         TRY_CAST(satisfaction_score AS INTEGER) AS satisfaction_score
  FROM uniq
)"""

# clean: the 24-column ticket table; v = valid resolution
CLEAN = f""",
clean AS (
  SELECT t.ticket_id, brand, channel, category, priority, created_at, resolved_at, t.agent_id,
         satisfaction_score, team, hire_date, location,
         resolved_at IS NOT NULL AS is_resolved,
         date_diff('minute', created_at, resolved_at) / 60.0::DOUBLE AS resolution_hours,
         coalesce(resolved_at < created_at, FALSE) AS is_negative_duration,
         coalesce(date_diff('day', created_at, resolved_at) > 30, FALSE) AS is_extreme_duration,
         coalesce(resolved_at >= {values.FUTURE_CUTOFF}, FALSE) AS is_future_resolution,
         CASE WHEN resolved_at IS NULL
              THEN date_diff('day', created_at, {values.EXTRACT_DATE}) END AS open_age_days,
         coalesce(created_at < hire_date, FALSE) AS created_before_hire,
         t.agent_id IS NULL AS missing_agent,
         satisfaction_score IS NOT NULL AS has_satisfaction,
         satisfaction_score BETWEEN 1 AND 2 AS is_bottom_box,
         date_trunc('month', created_at) = {values.PARTIAL_MONTH} AS is_partial_month,
         CASE WHEN t.ticket_id IS NOT NULL
              THEN count(*) OVER (PARTITION BY t.ticket_id) > 1 END AS is_id_conflict
  FROM typed t LEFT JOIN agents a ON a.agent_id = t.agent_id
),
tix AS (SELECT *, is_resolved AND NOT is_negative_duration AS v FROM clean)"""


def on_raw(body: str) -> str:
    return f"WITH {FEED.strip()}\n{body.strip()}"


def on_typed(body: str) -> str:
    return f"WITH {FEED.strip()}{TYPED}\n{body.strip()}"


def on_clean(body: str, *extra_ctes: str) -> str:
    extra = "".join(f",\n{cte.strip()}" for cte in extra_ctes)
    return f"WITH {FEED.strip()}{TYPED}{CLEAN}{extra}\n{body.strip()}"


def n_if(condition: str) -> str:
    return f"count(CASE WHEN {condition} THEN 1 END)"


def pct(part: str, whole: str, places: int = 1) -> str:
    return f"round(100.0::DOUBLE * ({part}) / nullif({whole}, 0), {places})"


def quant(value: str, q: float, places: int, condition: str = "TRUE") -> str:
    return f"round(quantile_cont(CASE WHEN {condition} THEN {value} END, {q}), {places})"


def bins(value: str, edges: list[tuple[float, str]], last: str) -> str:
    arms = " ".join(f"WHEN {value} < {edge} THEN '{label}'" for edge, label in edges)
    return f"CASE {arms} ELSE '{last}' END"


def erfc(z: str) -> str:
    t = f"(1 / (1 + 0.5 * ({z})))"
    powers = [
        "-1.26551223",
        f"1.00002368 * {t}",
        f"0.37409196 * pow({t}, 2)",
        f"0.09678418 * pow({t}, 3)",
        f"-0.18628806 * pow({t}, 4)",
        f"0.27886807 * pow({t}, 5)",
        f"-1.13520398 * pow({t}, 6)",
        f"1.48851587 * pow({t}, 7)",
        f"-0.82215223 * pow({t}, 8)",
        f"0.17087277 * pow({t}, 9)",
    ]
    return f"{t} * exp(-pow({z}, 2) + {' + '.join(powers)})"


def chi2_tail(x: str, dof: str) -> str:
    h = f"(({x}) / 2.0::DOUBLE)"
    whole = f"list_sum([pow({h}, i) / gamma(i + 1) FOR i IN range(0, ({dof}) // 2)])"
    halves = f"list_sum([pow({h}, i - 0.5) / gamma(i - 0.5 + 1) FOR i IN range(1, ({dof}) // 2 + 1)])"
    return (
        f"CASE WHEN ({dof}) % 2 = 0 THEN exp(-{h}) * {whole} "
        f"ELSE {erfc(f'sqrt({h})')} + exp(-{h}) * coalesce({halves}, 0) END"
    )
