"""Cleaning: every rule on hand-made rows, and the defects planted in the derived feed."""

import datetime as dt

import pytest
from helpers import agents, raw_tickets
from pyspark.sql import functions as F

from queuelens.operators import clean as c
from queuelens.profile import RAW_TICKET_COLUMNS, TicketProfile
from queuelens.sources.files import (
    CLEAN_SCHEMA,
    export_lines,
    read_clean_csv,
    read_clean_tickets,
    read_raw_tickets,
    slug,
    write_clean,
    write_cuts,
    write_text_csv,
)

PROFILE = TicketProfile()
ts = dt.datetime


@pytest.fixture(scope="module")
def cleaned(spark):
    raw = raw_tickets(
        spark,
        {"ticket_id": "plain"},
        {"ticket_id": "copy"},
        {"ticket_id": "copy"},
        {"ticket_id": "clash", "category": "Bill"},
        {"ticket_id": "clash", "category": "refund "},
        {"ticket_id": None, "priority": "High"},
        {"ticket_id": None, "priority": "Urgent"},
        {"ticket_id": "open", "resolved_at": None, "satisfaction_score": None, "agent_id": "  "},
        {"ticket_id": "early", "created_at": "2024-01-01 00:00:00", "resolved_at": "01/01/2024 09:05"},
        {"ticket_id": "backwards", "resolved_at": "2025-01-10 09:00:00"},
        {"ticket_id": "boundary30", "resolved_at": "2025-02-09 23:59:59"},
        {"ticket_id": "boundary31", "resolved_at": "2025-02-10 00:00:00"},
        {"ticket_id": "last_day", "resolved_at": "2025-06-02 23:59:59"},
        {"ticket_id": "future", "resolved_at": "03/06/2025 00:00"},
        {"ticket_id": "june", "created_at": "2025-06-01 00:00:00", "resolved_at": None},
        {"ticket_id": "undated", "created_at": "31/02/2025 10:00", "channel": " E-MAIL "},
        {"ticket_id": "low", "satisfaction_score": "2", "channel": "PHONE"},
    )
    staff = agents(spark, ("A1", "Tier 1", "2024-06-01", "Lisbon"))
    out = c.clean_tickets(raw, staff, PROFILE)
    assert out.schema.simpleString() == CLEAN_SCHEMA.simpleString()
    return out.collect()


def one(rows, ticket_id):
    (row,) = [r for r in rows if r["ticket_id"] == ticket_id]
    return row


def test_copies_go_and_conflicts_stay(cleaned):
    assert len([r for r in cleaned if r["ticket_id"] == "copy"]) == 1
    clash = [r for r in cleaned if r["ticket_id"] == "clash"]
    assert sorted(r["category"] for r in clash) == ["Billing", "refund"]
    assert all(r["is_id_conflict"] for r in clash)
    assert one(cleaned, "plain")["is_id_conflict"] is False


def test_rows_without_id_stay_and_are_not_judged(cleaned):
    nameless = [r for r in cleaned if r["ticket_id"] is None]
    assert len(nameless) == 2
    assert all(r["is_id_conflict"] is None for r in nameless)


def test_agent_and_survey(cleaned):
    plain, waiting = one(cleaned, "plain"), one(cleaned, "open")
    assert (plain["team"], plain["location"], plain["missing_agent"]) == ("Tier 1", "Lisbon", False)
    assert (waiting["agent_id"], waiting["team"], waiting["missing_agent"]) == (None, None, True)
    assert waiting["has_satisfaction"] is False and waiting["is_bottom_box"] is None
    assert plain["is_bottom_box"] is False and one(cleaned, "low")["is_bottom_box"] is True
    assert one(cleaned, "early")["created_before_hire"] is True
    assert plain["created_before_hire"] is False


def test_durations(cleaned):
    assert one(cleaned, "plain")["resolution_hours"] == 2.0
    back = one(cleaned, "backwards")
    assert back["resolution_hours"] == -1.0 and back["is_negative_duration"] is True
    assert one(cleaned, "boundary30")["is_extreme_duration"] is False
    assert one(cleaned, "boundary31")["is_extreme_duration"] is True
    assert one(cleaned, "last_day")["is_future_resolution"] is False
    assert one(cleaned, "future")["is_future_resolution"] is True
    waiting = one(cleaned, "open")
    assert waiting["is_resolved"] is False and waiting["resolution_hours"] is None
    assert waiting["open_age_days"] == (dt.date(2025, 6, 2) - dt.date(2025, 1, 10)).days
    assert one(cleaned, "plain")["open_age_days"] is None


def test_months_and_unparsed_dates(cleaned):
    assert one(cleaned, "june")["is_partial_month"] is True
    undated = one(cleaned, "undated")
    assert undated["created_at"] is None and undated["channel"] == "email"
    assert undated["is_partial_month"] is None and undated["resolution_hours"] is None
    assert undated["is_negative_duration"] is False and undated["created_before_hire"] is False
    assert one(cleaned, "early")["resolved_at"] == ts(2024, 1, 1, 9, 5)


def test_planted_defects(ws):
    tickets = ws.tickets
    flags = {
        "rows": F.count("*"),
        "ids": F.countDistinct("ticket_id"),
        "conflicts": F.count_if("is_id_conflict"),
        "open": F.count_if(~F.col("is_resolved")),
        "negative": F.count_if("is_negative_duration"),
        "extreme": F.count_if("is_extreme_duration"),
        "future": F.count_if("is_future_resolution"),
        "blank agent": F.count_if("missing_agent"),
        "unscored": F.count_if(~F.col("has_satisfaction")),
        "before hire": F.count_if("created_before_hire"),
        "partial month": F.count_if("is_partial_month"),
        "unparsed": F.count_if(F.col("created_at").isNull()),
    }
    row = tickets.agg(*[v.alias(k) for k, v in flags.items()]).first().asDict()
    assert row == {
        "rows": 1502,
        "ids": 1497,
        "conflicts": 4,
        "open": 116,
        "negative": 5,
        "extreme": 4,
        "future": 2,
        "blank agent": 12,
        "unscored": 412,
        "before hire": 456,
        "partial month": 1,
        "unparsed": 4,
    }
    assert ws.raw.count() == 1520
    assert c.dedup_exact(ws.raw).filter(F.contains("created_at", F.lit("/"))).count() == 299


def test_row_steps_apply_to_a_stream(spark, ws):
    stream = spark.readStream.schema(ws.raw.schema).option("header", True).csv(ws.raw_path)
    out = c.add_open_age(c.add_resolution_time(c.type_rows(stream, ws.profile), ws.profile), ws.profile)
    assert out.isStreaming


HEADER = ",".join(RAW_TICKET_COLUMNS)


def standard_csv(path, *lines, header=HEADER):
    """A file as other programs write it."""
    path.mkdir()
    (path / "tickets.csv").write_text("\r\n".join([header, *lines]) + "\r\n")
    return str(path)


def test_standard_quoting_is_read_whole(spark, tmp_path):
    path = standard_csv(
        tmp_path / "raw",
        'T1,KAYAK,chat,"say ""hi"", now",Low,2025-01-01 10:00:00,,A1,4',
        r'T2,KAYAK,chat,"c:\x\",High,2025-01-01 10:00:00,2025-01-02 10:00:00,A2,5',
        "T3, KAYAK ,\"\", x ,Low,2025-01-01 10:00:00,,,",
    )
    rows = {r["ticket_id"]: r for r in read_raw_tickets(spark, path).collect()}
    assert rows["T1"]["category"] == 'say "hi", now' and rows["T1"]["satisfaction_score"] == "4"
    assert rows["T2"]["category"] == "c:\\x\\" and rows["T2"]["resolved_at"] == "2025-01-02 10:00:00"
    assert rows["T3"]["brand"] == " KAYAK " and rows["T3"]["channel"] is None
    assert all(r["broken_record"] is None for r in rows.values())


def test_broken_lines_are_kept_counted_and_fail_the_check(spark, tmp_path):
    from queuelens.operators.quality import control_totals, qa_row_counts
    from queuelens.operators.validation import check_reconciliation

    path = standard_csv(
        tmp_path / "raw",
        "T1,KAYAK,chat,Bill,Low,2025-01-01 10:00:00,,A1,4",
        "T2,KAYAK,chat,Bill,Low,2025-01-01 10:00:00",
        "T2,KAYAK,chat,Bill,Low,2025-01-01 10:00:00",
        "T3,KAYAK,chat,Bill,Low,2025-01-01 10:00:00,,A1,4,surplus",
        'T4,KAYAK,chat,"two\nlines",Low,2025-01-01 10:00:00,,A1,4',
    )
    raw = read_raw_tickets(spark, path)
    copies = c.count_copies(raw)
    cleaned = c.clean_tickets(raw, agents(spark, ("A1", "Tier 1", "2024-06-01", "Lisbon")), PROFILE)
    counts = qa_row_counts(copies, cleaned).first()
    assert (counts["raw_rows"], counts["raw_distinct"], counts["broken_rows"]) == (6, 5, 5)
    control = control_totals(export_lines(spark, path), raw)
    assert check_reconciliation(copies, cleaned, control).first()["reconciliation"] == "FAIL"
    whole = read_raw_tickets(spark, path, multi_line=True).filter("ticket_id = 'T4'").first()
    assert whole["category"] == "two\nlines" and whole["broken_record"] is None


def reconciled(spark, path, read=None, count=None, clean=None):
    """The check, with one of the steps before it replaced by a faulty one."""
    from queuelens.operators.quality import control_totals
    from queuelens.operators.validation import check_reconciliation

    raw = read_raw_tickets(spark, path)
    kept = read(raw) if read else raw
    copies = c.count_copies(kept)
    copies = count(copies) if count else copies
    staff = agents(spark, ("A1", "Tier 1", "2024-06-01", "Lisbon"))
    rows = c.clean_tickets(copies.drop("copies"), staff, PROFILE)
    control = control_totals(export_lines(spark, path), kept)
    return check_reconciliation(copies, clean(rows) if clean else rows, control).first()


def test_faults_fail_the_reconciliation(spark, tmp_path):
    lines = [f"T{i % 5},KAYAK,chat,Bill,Low,2025-01-0{i % 3 + 1} 10:00:00,,A1,4" for i in range(40)]
    path = standard_csv(tmp_path / "raw", *lines, "", "   ")
    (tmp_path / "raw" / "more.csv").write_text("\n".join([HEADER, lines[0], lines[1]]) + "\n")
    first = F.col("ticket_id") == "T1"
    good = reconciled(spark, path)
    assert (good["export_lines"], good["raw_rows"], good["raw_distinct"]) == (42, 42, 15)
    assert good["reconciliation"] == "PASS" and good["same_rows"]
    other = F.when(first, F.lit("T2")).otherwise(F.col("ticket_id"))
    faults = {
        "the reader drops a row": {"read": lambda raw: raw.limit(41)},
        "the reader splits rows": {"read": lambda raw: raw.union(raw.limit(1))},
        "a count is too high": {"count": lambda x: x.withColumn("copies", F.col("copies") + first.cast("int"))},
        "a cell is changed": {"count": lambda x: x.withColumn("priority", F.when(~first, F.col("priority")))},
        "an id is lost": {"clean": lambda rows: rows.where(~first)},
        "an id is changed": {"clean": lambda rows: rows.withColumn("ticket_id", other)},
    }
    for what, step in faults.items():
        assert reconciled(spark, path, **step)["reconciliation"] == "FAIL", what
    empty = standard_csv(tmp_path / "empty")
    assert reconciled(spark, empty)["reconciliation"] == "PASS"


def test_written_csv_is_standard(spark, tmp_path):
    import csv

    row = ("T1", 'a "b", c\\', " x ", None)
    df = spark.createDataFrame([row], "id string, text string, spaced string, none string")
    df = df.withColumn("at", F.expr("timestamp_ntz'2025-01-01 10:00:00'"))
    write_text_csv(df.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*")
    with part.open(newline="") as f:
        rows = list(csv.reader(f))
    assert rows == [["id", "text", "spaced", "none", "at"], ["T1", row[1], " x ", "", "2025-01-01 10:00:00"]]


def test_header_decides_the_columns(spark, tmp_path):
    header = ",".join([*RAW_TICKET_COLUMNS[:0:-1], "ticket_id", "region"])
    lines = [
        "4,A1,,2025-01-01 10:00:00,Low,Bill,chat,KAYAK,T1,north",
        "4,A1,,2025-01-01 10:00:00,Low,Bill,chat,KAYAK,T1,south",
        "4,A1,,2025-01-01 10:00:00,Low,Bill,chat,KAYAK,T1,south",
    ]
    raw = read_raw_tickets(spark, standard_csv(tmp_path / "raw", *lines, header=header))
    assert raw.columns == [*RAW_TICKET_COLUMNS, "region", "broken_record"]
    assert c.dedup_exact(raw).count() == 2
    first = raw.first()
    assert (first["ticket_id"], first["satisfaction_score"], first["agent_id"]) == ("T1", "4", "A1")
    with pytest.raises(ValueError, match="brand"):
        read_raw_tickets(spark, standard_csv(tmp_path / "odd", "T1", header="ticket_id"))


def test_written_clean_table_reads_back(spark, ws, tmp_path):
    written = write_clean(ws.tickets, str(tmp_path))
    back = read_clean_tickets(spark, written["parquet"])
    assert back.exceptAll(ws.tickets).count() == 0 and back.count() == ws.tickets.count()
    as_text = read_clean_csv(spark, written["csv"])
    assert as_text.exceptAll(ws.tickets).count() == 0 and as_text.count() == back.count()


def test_clean_table_is_laid_out_by_month(spark, ws, tmp_path):
    """A read bounded by month opens the folders of those months; a hot month is split."""
    hot = ws.tickets.where("created_at is not null").limit(1).crossJoin(spark.range(20_000)).drop("id")
    hot = hot.withColumn("ticket_id", F.uuid())
    rows = ws.tickets.union(hot)
    advisory = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(advisory)
    spark.conf.set(advisory, "200k")
    try:
        path = write_clean(rows, str(tmp_path))["parquet"]
    finally:
        spark.conf.set(advisory, before)
    hot_month = hot.select(F.date_format("created_at", "yyyy-MM")).first()[0]
    folders = {p.name.split("=")[1]: len(list(p.glob("*.parquet"))) for p in (tmp_path / "tickets_clean.parquet").glob("created_month=*")}
    assert "__HIVE_DEFAULT_PARTITION__" in folders and folders[hot_month] > 1
    assert sum(n for m, n in folders.items() if m != hot_month) <= 2 * len(folders)
    months = sorted(m for m in folders if m[0] != "_")
    some = read_clean_tickets(spark, path, months[3], months[4])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_month" in plan
    bounds = F.date_format("created_at", "yyyy-MM").between(months[3], months[4])
    assert some.count() == rows.where(bounds).count() > 0 and some.columns == CLEAN_SCHEMA.fieldNames()
    assert read_clean_tickets(spark, path).count() == rows.count()


def test_cuts_are_named_after_their_titles(spark, tmp_path):
    assert slug("Agent low-score spread") == "agent_low_score_spread"
    frame = spark.range(3)
    written = write_cuts({"By team": frame, "Mean vs median": frame}, str(tmp_path))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["by_team.csv", "mean_vs_median.csv"]
    assert spark.read.option("header", True).csv(written["By team"]).count() == 3
