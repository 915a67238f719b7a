"""Plan shape: what must not appear at any size, and what must be shared."""

import re

import pytest

from queuelens.plans.registry import QUERIES

SIDE_EFFECTS = {"write_clean", "write_cuts"}
LAZY = [name for name in QUERIES if name not in SIDE_EFFECTS]


def executed_plan(df) -> str:
    """Plan before adaptive changes; joins are planned as if nothing could be broadcast."""
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_forced_broadcast(ws, no_broadcast, name):
    plan = executed_plan(QUERIES[name](ws))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert bad not in plan
    assert "Python" not in plan and "MapIn" not in plan


@pytest.mark.parametrize("name", LAZY)
def test_no_single_partition_over_rows(ws, name):
    """Whatever meets in one partition has been aggregated before."""
    lines = executed_plan(QUERIES[name](ws)).splitlines()
    for number, line in enumerate(lines):
        if "SinglePartition" in line:
            below = re.sub(r"^[\s:|+-]+", "", lines[number + 1])
            while below.startswith(("Project", "Filter", "*")) and "Aggregate" not in below:
                number += 1
                below = re.sub(r"^[\s:|+-]+", "", lines[number + 1])
            assert re.match(r"(\*\(\d+\) )?(Object|Sort)?(Hash)?Aggregate|Union|Window", below), below


def test_segments_scan_once_and_prune(ws):
    plan = executed_plan(QUERIES["segment_metrics"](ws))
    assert plan.count("FileScan parquet") == 1 and "Expand" in plan and "Generate" not in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "created_at" not in schema and "ticket_id" not in schema


def test_filters_reach_the_scan(ws):
    plan = executed_plan(QUERIES["resolution_distribution"](ws))
    assert "PushedFilters: [IsNotNull(is_resolved), IsNotNull(is_negative_duration), EqualTo(" in plan


def test_branches_share_the_wide_shuffle(ws, no_broadcast):
    for name in (
        "clean_tickets",
        "kruskal_resolution_by_priority",
        "mat_date_rows_dropped",
        "two_prop_z_cells",
        "scale_deconvolution",
    ):
        df = QUERIES[name](ws)
        df.collect()
        final = executed_plan(df).split("Initial Plan")[0]
        assert "ReusedExchange" in final, name


def test_salted_conflict_join_spreads_a_hot_id(spark, no_broadcast):
    from helpers import agents, raw_tickets

    from queuelens.operators.clean import clean_tickets
    from queuelens.profile import TicketProfile

    hot = [{"ticket_id": "hot", "agent_id": f"X{i}"} for i in range(400)]
    cold = [{"ticket_id": f"t{i}"} for i in range(800)]
    raw = raw_tickets(spark, *hot, *cold)
    out = clean_tickets(raw, agents(spark, ("A1", "Tier 1", "2024-06-01", "Lisbon")), TicketProfile())
    assert "_salt" in executed_plan(out)
    rows = out.groupBy("is_id_conflict").count().collect()
    assert {r["is_id_conflict"]: r["count"] for r in rows} == {True: 400, False: 800}


def test_agent_join_spreads_hot_and_missing_agents(spark, no_broadcast, monkeypatch):
    """Half of the rows without agent, a third under one: no partition gets much more than its share."""
    from helpers import agents, raw_tickets
    from pyspark.sql import functions as F

    from queuelens.operators import clean as c

    monkeypatch.setattr(c, "ROWS_PER_SLOT", 10)
    rows = [{"ticket_id": f"n{i}", "agent_id": None} for i in range(1200)]
    rows += [{"ticket_id": f"h{i}", "agent_id": "HOT"} for i in range(800)]
    rows += [{"ticket_id": f"t{i}", "agent_id": f"A{i}"} for i in range(400)]
    staff = [(f"A{i}", "Tier 1", "2024-06-01", "Lisbon") for i in range(300)]
    staff.append(("HOT", "Tier 2", "2024-06-01", "Manila"))
    out = c.enrich_agents(raw_tickets(spark, *rows), agents(spark, *staff))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sum(sizes) == 2400 and max(sizes) < 0.25 * 2400
    teams = {r["team"]: r["count"] for r in out.groupBy("team").count().collect()}
    assert teams == {None: 1300, "Tier 2": 800, "Tier 1": 300}


def test_only_heavy_keys_are_copied(spark):
    """100,000 ids of two rows beside one of fifty million: the conflict side hardly grows."""
    from pyspark.sql import functions as F

    from queuelens.operators import clean as c

    light = spark.range(100_000).select(
        F.concat(F.lit("t"), "id").alias("ticket_id"), F.lit(2).cast("long").alias("id_rows")
    )
    heavy = spark.createDataFrame([("hot", 50_000_000), (None, 7_000_000)], "ticket_id string, id_rows long")
    loads = light.union(heavy)
    table = c.spread_table(loads, "ticket_id", "id_rows")
    slots = table.first()["slots"]
    assert len(slots) == c.SPREAD_BUCKETS and sorted(slots)[-3:] == [1, 7, 50]
    spread = c.in_all_slots(loads, "ticket_id", table.scalar())
    of = {r["ticket_id"]: r["count"] for r in spread.groupBy("ticket_id").count().collect()}
    assert of["hot"] == 50 and 100_057 <= sum(of.values()) < 100_057 + 500
    every = spread.groupBy("ticket_id").agg(F.countDistinct("_slot").alias("n"), F.max("_slot").alias("m"))
    assert every.where("n <> m + 1").isEmpty()


def test_heavy_keys_change_no_result(spark, no_broadcast, monkeypatch):
    """Slots so small that many ids and agents are spread: the rows stay what they were."""
    from helpers import agents, raw_tickets

    from queuelens.operators import clean as c
    from queuelens.profile import TicketProfile

    rows = [{"ticket_id": f"t{i % 23 if i % 3 else i}", "agent_id": f"A{i * i % 7}", "priority": f"{i}"}
            for i in range(500)]
    rows += [{"ticket_id": None, "agent_id": " ", "priority": f"n{i}"} for i in range(50)]
    staff = agents(spark, *[(f"A{i}", f"Tier {i}", "2024-06-01", "Lisbon") for i in range(5)])

    def cleaned():
        return sorted(map(str, c.clean_tickets(raw_tickets(spark, *rows), staff, TicketProfile()).collect()))

    before = cleaned()
    monkeypatch.setattr(c, "ROWS_PER_SLOT", 3)
    assert cleaned() == before and len(before) == 550


def test_agents_are_joined_on_three_columns(ws, no_broadcast):
    plan = executed_plan(QUERIES["enrich_agents"](ws))
    read = [r for r in re.findall(r"ReadSchema: struct<([^>]*)", plan) if "ticket_id" in r]
    assert read and all("created_at" not in r and "brand" not in r for r in read)
    assert "try_to_timestamp(created_at" not in plan


def test_building_the_clean_plan_runs_no_job(ws):
    ws.clean_plan()  # its stages are written now
    tracker = ws.spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None))
    ws.clean_plan()
    assert max(tracker.getJobIdsForGroup(None)) == before


def test_chi2_scans_tickets_once(ws):
    """The plan that ran, subqueries included: what shows a scan again is the same stage."""
    for name in ("chi2_low_score_by_dim", "chi2_scale_by_dim"):
        df = QUERIES[name](ws)
        df.collect()
        final = executed_plan(df).split("== Initial Plan ==")[0]
        stages = re.findall(r"Exchange hashpartitioning\(_by_0.*plan_id=(\d+)\]", final)
        assert final.count("FileScan parquet") == len(stages) and len(set(stages)) == 1


def test_labels_before_and_after_scan_each_table_once(ws):
    for name in ("qa_distinct_before_after", "mat_not_normalised"):
        assert executed_plan(QUERIES[name](ws)).count("FileScan parquet") == 2


GLOBAL_QUANTILES = ("headline_kpis", "backlog_age_summary", "qa_resolution_summary",
                    "qa_open_age_summary", "mat_date_misparsed", "mat_mean_vs_median",
                    "mat_survivorship", "agent_low_score_spread")


@pytest.mark.parametrize("name", GLOBAL_QUANTILES)
def test_quantiles_of_all_rows_gather_no_values(ws, name):
    """Ranks are found in buckets of values; there is no percentile buffer."""
    plan = executed_plan(QUERIES[name](ws))
    assert "percentile" not in plan and "Window" in plan


def test_labels_are_counted_in_two_levels(ws):
    for name in ("qa_distinct_before_after", "mat_not_normalised"):
        plan = executed_plan(QUERIES[name](ws))
        assert "distinct" not in plan.replace("count(distinct", "") and "count(distinct" not in plan
        assert plan.count("Expand") == 2, name


def test_cuts_are_read_back_without_a_look_at_each_file(ws):
    """Writing takes jobs; the plan over the 24 files takes none."""
    from queuelens.plans.registry import cuts
    from queuelens.sources.files import cells, slug, write_cuts

    plans = {title: plan for title, plan in cuts(ws).items() if title.startswith("By ")}
    written = write_cuts(plans, f"{ws.folder}/some")
    tracker = ws.spark.sparkContext.statusTracker()
    before = max(tracker.getJobIdsForGroup(None))
    names = {slug(t): p.columns for t, p in plans.items()}
    df = cells(ws.spark, {slug(t): path for t, path in written.items()}, names)
    assert max(tracker.getJobIdsForGroup(None)) == before and df.count() > 0


def test_slices_read_the_segment_table(ws):
    for name in ("by_category", "by_channel", "by_brand", "by_priority", "by_team", "uniformity_spread"):
        (file,) = {f.rsplit("/", 1)[0] for f in QUERIES[name](ws).inputFiles()}
        assert file.endswith("stages/segments.parquet")


def test_reports_share_the_counted_period(ws):
    """Of all queries on clean tickets, a good third read counts of them instead."""
    sources = {}
    for name in LAZY:
        files = QUERIES[name](ws).inputFiles()
        sources[name] = {f.split("/stages/")[1].split("/")[0] for f in files if "/stages/" in f}
    counted = [name for name, used in sources.items() if "period_counts.parquet" in used]
    assert len(counted) == 17
    assert all(sources[name] == {"period_counts.parquet"} for name in counted)
    # the others need more columns of the clean table, or its rows
    assert sum("clean.parquet" in used for used in sources.values()) <= 36


def test_reports_by_calendar_share_the_month_cube(ws):
    for name in ("monthly_trend", "backlog_by_creation_month", "arrivals_by_weekday",
                 "scale_evidence_monthly", "response_rate_by_month", "activity_on_both_clocks",
                 "mart_trend_labels", "mart_scale_cutover"):
        df = QUERIES[name](ws)
        (file,) = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        assert file.endswith("stages/month_cube.parquet"), name
        assert executed_plan(df).count("FileScan") == 1, name


def test_the_month_cube_takes_one_scan(ws):
    from queuelens.operators.months import month_cube

    plan = executed_plan(month_cube(ws.tickets, ws.profile))
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange hashpartitioning") == 1
    schema = re.search(r"ReadSchema: struct<([^>]*)", plan).group(1)
    assert "ticket_id" not in schema and "agent_id" not in schema


def test_reports_share_the_segment_table(ws):
    from queuelens.plans.registry import cuts

    plans = cuts(ws)
    for title in ("By category", "By channel", "By brand", "By priority", "By team"):
        assert "stages/segments.parquet" in plans[title].inputFiles()[0]
    slices = {r["segment"]: r["volume"] for r in plans["By team"].collect()}
    direct = {r["segment"]: r["volume"] for r in QUERIES["by_team"](ws).collect()}
    assert slices == direct


def test_staged_cleaning_shuffles_no_rows(ws):
    """Over the written stages, cleaning is a scan with two small broadcasts."""
    assert "hashpartitioning" not in executed_plan(ws.clean_plan())


def test_export_is_read_once(ws):
    """Checks and materiality read the counted copies, not the text files."""
    for name in ("qa_row_counts", "check_reconciliation", "mat_duplicates", "mat_not_normalised",
                 "mat_date_misparsed", "mat_date_rows_dropped", "mat_bill_billing"):
        assert "FileScan csv" not in executed_plan(QUERIES[name](ws)), name


def test_free_form_labels_never_share_a_task(ws):
    """Tests over open-ended labels attach totals without windows or joins."""
    for name in ("chi2_low_score_by_dim", "chi2_scale_by_dim", "two_prop_z_cells"):
        plan = executed_plan(QUERIES[name](ws))
        assert "Window" not in plan and "Join" not in plan, name


def method_sizes(df) -> list[int]:
    """Bytes of the largest method that each piece of generated code has."""
    text = df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    )
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]


def test_rows_are_cleaned_by_compiled_code(ws):
    """Java interprets methods of more than 8,000 bytes for good, at many times the cost."""
    from queuelens.operators.materiality import month_first_counts
    from queuelens.sources.star_schema import ticket_feed

    orders, customer = (ws.spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("orders", "customer"))
    key = "spark.sql.adaptive.enabled"  # adaptive plans are compiled as they run
    before = ws.spark.conf.get(key)
    clean, raw = ws.clean_plan(), ws.distinct_rows
    ws.spark.conf.set(key, "false")
    try:
        for df in (clean, month_first_counts(raw, ws.profile), ticket_feed(orders, customer)):
            sizes = method_sizes(df.select("*"))
            assert sizes and max(sizes) <= 8000
    finally:
        ws.spark.conf.set(key, before)


def test_misparsed_times_are_parsed_for_their_counts_only(ws):
    df = QUERIES["mat_date_misparsed"](ws)
    assert "to_timestamp" not in executed_plan(df)
    assert {f.split("/stages/")[1].split("/")[0] for f in df.inputFiles()} == {
        "month_first_counts.parquet", "clean.parquet"
    }


def test_the_feed_is_dealt_over_all_tasks(spark, tmp_path):
    """A table of one row group is one task's to read, not one task's to spell out."""
    from pyspark.sql import functions as F

    from queuelens.sources.star_schema import ticket_feed

    day = F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'")
    orders = spark.range(0, 300_000, 1, 1).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 9).alias("o_custkey"),
        day.alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority"),
    )
    customer = spark.range(9).select(F.col("id").alias("c_custkey"), F.lit("AUTO").alias("c_mktsegment"))
    feed = ticket_feed(orders, customer)
    sizes = [r["count"] for r in feed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.75 * sum(sizes)


def test_the_feed_is_dealt_unsorted_and_copied_by_compiled_code(spark):
    """Dealing in turn sorts all rows of a task; a generator takes rows out of compiled code."""
    from pyspark.sql import functions as F

    from queuelens.sources.star_schema import ticket_feed

    day = F.expr("TIMESTAMP_NTZ'1995-01-01 00:00:00'")
    keys = [(85, 0), (85, None), (971, 0), (971, None), (216, None), (None, 0), (None, None)]
    orders = spark.createDataFrame(keys, "o_orderkey long, o_custkey long").select(
        "*", day.alias("o_orderdate"), F.lit("2-HIGH").alias("o_orderpriority")
    )
    customer = spark.createDataFrame([(0, "AUTO")], "c_custkey long, c_mktsegment string")
    feed = ticket_feed(orders, customer)
    plan = executed_plan(feed)
    assert "RoundRobinPartitioning" not in plan and "Generate" not in plan
    # without customer there is no category, and only copies that have one are written
    got = sorted((r.ticket_id or "", r.brand or "", r.category) for r in feed.collect())
    assert got == [
        ("", "AUTO", "Bill"),
        ("216", "", 'Refund request, "urgent" '),
        ("85", "AUTO", "Bill"), ("85", "AUTO", "Bill"),
        ("971", "", "General Query"),
        ("971", "AUTO", "Bill"), ("971", "AUTO", "General Query"),
    ]
