"""The whole job over a small export in the default format."""

import csv
import datetime as dt
import glob
import random

from queuelens.__main__ import STEPS, analyse, profile_at
from queuelens.plans.registry import CUT_TITLES, GROUPS
from queuelens.profile import RAW_AGENT_COLUMNS, RAW_TICKET_COLUMNS, TicketProfile
from queuelens.sources.files import slug


def write(path, header, rows):
    with open(path, "w", newline="") as f:
        out = csv.writer(f, lineterminator="\r\n")
        out.writerow(header)
        out.writerows(rows)


def export(folder):
    rng = random.Random(5)
    rows = []
    for n in range(400):
        created = dt.datetime(2024, 6, 2) + dt.timedelta(minutes=rng.randrange(364 * 1440))
        resolved = created + dt.timedelta(minutes=rng.randrange(3000))
        fmt = "%d/%m/%Y %H:%M" if n % 5 == 0 else "%Y-%m-%d %H:%M:%S"
        rows.append(
            (
                f"T{n:05d}",
                rng.choice(("agoda", "Booking.com", "priceline", "KAYAK")),
                rng.choice(("Email", "e-mail", "PHONE ", "chat", " social")),
                rng.choice(("Bill", "billing", "Booking Change", "technical issue", "Cancellation", "General Query ")),
                rng.choice(("Low", "Medium", "High", "Urgent")),
                created.strftime(fmt),
                "" if n % 9 == 0 else resolved.strftime(fmt),
                "" if n % 50 == 0 else f"A{n % 7:04d}",
                "" if n % 3 == 0 else rng.randint(1, 5) if n % 4 else rng.randint(1, 10),
            )
        )
    write(f"{folder}/tickets.csv", RAW_TICKET_COLUMNS, rows + rows[:6])
    staff = [(f"A{n:04d}", f"Tier {n % 2 + 1}", "2023-01-15", "Remote") for n in range(7)]
    write(f"{folder}/agents.csv", RAW_AGENT_COLUMNS, staff)


def only_row(spark, path):
    (row,) = spark.read.option("header", True).csv(path).collect()
    return row


def test_job(spark, tmp_path):
    export(tmp_path)
    out = f"{tmp_path}/out"
    analyse(spark, TicketProfile(), f"{tmp_path}/tickets.csv", f"{tmp_path}/agents.csv", out)
    tables = {p.rsplit("/", 1)[1] for p in glob.glob(f"{out}/tables/*.csv")}
    assert tables == {f"{slug(title)}.csv" for title in CUT_TITLES}
    for step in STEPS:
        assert {p.rsplit("/", 1)[1] for p in glob.glob(f"{out}/{step}/*.csv")} == {
            f"{name}.csv" for name in GROUPS[step]
        }
    check = only_row(spark, f"{out}/checks/check_reconciliation.csv")
    assert (check["raw_rows"], check["clean_rows"], check["reconciliation"]) == ("406", "400", "PASS")
    assert only_row(spark, f"{out}/checks/check_domains.csv")["domain_checks"] == "PASS"
    labels = only_row(spark, f"{out}/report/qa_distinct_before_after.csv")
    assert (labels["channel_after"], labels["category_after"]) == ("4", "5")
    kpis = only_row(spark, f"{out}/metrics/headline_kpis.csv")
    assert (kpis["total_tickets"], kpis["open_tickets"]) == ("400", "45")
    clean = spark.read.option("header", True).csv(f"{out}/clean/tickets_clean.csv")
    assert clean.count() == 400 and len(clean.columns) == 24


def test_profile_of_another_extract():
    profile = profile_at(dt.date(2026, 2, 28))
    assert profile.future_cutoff == dt.date(2026, 3, 1)
    assert profile.partial_month == dt.date(2026, 2, 1)
