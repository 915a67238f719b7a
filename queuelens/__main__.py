"""Run a whole analysis over a ticket export.

    spark-submit --py-files queuelens.zip queuelens/__main__.py --tickets ... --out ...
    python -m queuelens --tickets T.csv --agents A.csv --out FOLDER \\
        --extract-date 2025-06-02 [--master local[8]]

Writes below FOLDER: ``clean/`` (the ticket table as Parquet and CSV),
``tables/`` (the titled reports) and one folder of CSV tables per step:
``report``, ``metrics``, ``segments``, ``checks``, ``materiality``, ``mixture``,
``inference`` and ``figures``.
"""

from __future__ import annotations

import argparse
from dataclasses import replace
from datetime import date, timedelta

from pyspark.sql import SparkSession

from queuelens.plans.registry import CUT_TITLES, GROUPS
from queuelens.plans.workspace import Workspace
from queuelens.profile import TicketProfile
from queuelens.session import build_session
from queuelens.sources.files import CLEAN_SCHEMA, read_text_csv, write_clean, write_cuts

STEPS = (
    "report",
    "metrics",
    "segments",
    "checks",
    "materiality",
    "mixture",
    "inference",
    "figures",
)


def analyse(
    spark: SparkSession, profile: TicketProfile, tickets: str, agents: str, out: str
) -> Workspace:
    """Clean once, then write every table of every step."""
    ws = Workspace(spark, profile, out, tickets, agents)
    written = write_clean(ws.clean_plan(), f"{out}/clean")
    ws.use_written("clean", written["parquet"], CLEAN_SCHEMA)
    tables: dict[str, str] = {}
    for step in STEPS:
        tables |= write_cuts(
            {name: query(ws) for name, query in GROUPS[step].items()}, f"{out}/{step}"
        )
    # the titled reports are some of these tables, so their files are read, not their queries run
    saved = {title: read_text_csv(spark, tables[name]) for title, name in CUT_TITLES.items()}
    write_cuts(saved, f"{out}/tables")
    ws.close()
    return ws


def profile_at(extract_date: date) -> TicketProfile:
    """The default profile for an extract of another day.

    Resolutions count as future from the day after; the month of the extract is
    the partial one.
    """
    return replace(
        TicketProfile(),
        extract_date=extract_date,
        future_cutoff=extract_date + timedelta(days=1),
        partial_month=extract_date.replace(day=1),
    )


def main() -> None:
    parser = argparse.ArgumentParser(prog="queuelens", description=__doc__.splitlines()[0])
    parser.add_argument("--tickets", required=True, help="ticket CSV file or folder")
    parser.add_argument("--agents", required=True, help="agent CSV file or folder")
    parser.add_argument("--out", required=True, help="folder shared by all executors")
    parser.add_argument("--extract-date", type=date.fromisoformat)
    parser.add_argument("--master")
    args = parser.parse_args()
    profile = profile_at(args.extract_date) if args.extract_date else TicketProfile()
    spark = build_session(master=args.master)
    analyse(spark, profile, args.tickets, args.agents, args.out)
    spark.stop()


if __name__ == "__main__":
    main()
