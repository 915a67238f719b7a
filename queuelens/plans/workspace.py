"""Written stages between the steps of an analysis.

A ticket analysis receives an export, counts its copies, cleans it once and
then reads the clean table many times.  The hand-over between these steps is a
written table in the shared folder, so lineage is cut there, a lost executor
costs a task rather than the chain, the export is read once, and every query
scans only the columns it needs.
"""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.types import StructType

from queuelens.operators.clean import (
    agent_loads,
    clean_distinct_rows,
    count_copies,
    id_conflicts,
    spread_table,
)
from queuelens.operators.materiality import month_first_counts
from queuelens.operators.metrics import period_counts
from queuelens.operators.months import month_cube
from queuelens.operators.quality import control_totals
from queuelens.operators.segments import segment_metrics
from queuelens.profile import TicketProfile, star_schema_profile
from queuelens.session import remove_path, shared_dir
from queuelens.sources.files import export_lines, files_state, read_agents, read_raw_tickets, write_text_csv
from queuelens.sources.star_schema import agent_feed, ticket_feed


class Workspace:
    """Raw export, agents and clean tickets of one feed, each read back from files."""

    def __init__(
        self,
        spark: SparkSession,
        profile: TicketProfile,
        folder: str,
        raw_path: str | None = None,
        agents_path: str | None = None,
    ):
        self.spark = spark
        self.profile = profile
        self.folder = folder
        self.raw_path = raw_path or f"{folder}/raw/support_tickets.csv"
        self.agents_path = agents_path or f"{folder}/raw/agents.csv"
        self._lock = threading.RLock()
        self._written: dict[str, tuple[str, StructType]] = {}

    @cached_property
    def raw(self) -> DataFrame:
        return read_raw_tickets(self.spark, self.raw_path)

    @cached_property
    def agents(self) -> DataFrame:
        return read_agents(self.spark, self.agents_path, self.profile)

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The result of ``build`` as a written table; the first use writes it."""
        with self._lock:
            if name not in self._written:
                path = f"{self.folder}/stages/{name}.parquet"
                plan = build()
                plan.write.mode("overwrite").parquet(path)
                self.use_written(name, path, plan.schema)
            path, schema = self._written[name]
        # a table laid out in folders has a column of its own for them
        return self.spark.read.schema(schema).parquet(path).select(*schema.fieldNames())

    def close(self) -> None:
        """Remove the written stages; results read from them are no longer usable."""
        with self._lock:
            self._written.clear()
            remove_path(self.spark, f"{self.folder}/stages")

    def use_written(self, name: str, path: str, schema: StructType) -> None:
        """Take an already written table for stage ``name``."""
        self._written[name] = (path, schema)

    @property
    def copies(self) -> DataFrame:
        """Distinct raw rows and how often each occurs: the one row-sized shuffle."""
        return self.stage("copies", lambda: count_copies(self.raw))

    @property
    def distinct_rows(self) -> DataFrame:
        return self.copies.drop("copies")

    @property
    def conflicts(self) -> DataFrame:
        """Conflicting ids.  Written, its true size is known, which lets Spark decide
        on a broadcast before it shuffles the other side."""
        return self.stage("conflicts", lambda: id_conflicts(self.distinct_rows))

    @property
    def conflict_slots(self) -> Column:
        """Over how many join keys the rows of conflicting ids are spread."""
        build = lambda: spread_table(self.conflicts, "ticket_id", "id_rows")
        return self.stage("conflict_slots", build).scalar()

    @property
    def agent_loads(self) -> DataFrame:
        """Distinct raw rows per agent."""
        return self.stage("agent_loads", lambda: agent_loads(self.distinct_rows))

    @property
    def agent_slots(self) -> Column:
        """Over how many join keys the rows of agents are spread."""
        build = lambda: spread_table(self.agent_loads, "agent_id", "rows")
        return self.stage("agent_slots", build).scalar()

    def clean_plan(self) -> DataFrame:
        """The cleaning step over the written stages, not yet run.

        Their counts say beforehand how far the rows of one id or agent must be spread.
        """
        return clean_distinct_rows(
            self.distinct_rows,
            self.conflicts,
            self.agents,
            self.profile,
            self.conflict_slots,
            self.agent_slots,
        )

    @property
    def tickets(self) -> DataFrame:
        """The clean table."""
        return self.stage("clean", self.clean_plan)

    @property
    def period_counts(self) -> DataFrame:
        """Tickets counted by what reports on the whole period or on priorities read."""
        return self.stage("period_counts", lambda: period_counts(self.tickets))

    @property
    def month_first_counts(self) -> DataFrame:
        """Raw rows counted by how their times read month-first."""
        build = lambda: month_first_counts(self.distinct_rows, self.profile)
        return self.stage("month_first_counts", build)

    @property
    def month_cube(self) -> DataFrame:
        """Tickets counted by month and by weekday, for the reports by calendar."""
        return self.stage("month_cube", lambda: month_cube(self.tickets, self.profile))

    @property
    def control_totals(self) -> DataFrame:
        """Lines and fingerprint of the export, taken from its files once more."""
        return self.stage(
            "control_totals",
            lambda: control_totals(export_lines(self.spark, self.raw_path), self.raw),
        )

    @property
    def segments(self) -> DataFrame:
        """Metrics of every (dimension, segment): a few dozen rows that many reports share."""
        return self.stage("segments", lambda: segment_metrics(self.tickets, self.profile))


_open: dict[tuple[str, str], tuple[str, Workspace]] = {}
_open_lock = threading.Lock()


def star_schema_workspace(spark: SparkSession, table_dir: str) -> Workspace:
    """Workspace over the feed derived from ``orders`` and ``customer`` in ``table_dir``.

    The export is written on first use and shared by later calls of the same
    application, as long as the files of these tables stay the same.
    """
    key = (spark.sparkContext.applicationId, table_dir)
    paths = [f"{table_dir}/{name}.parquet" for name in ("orders", "customer")]
    state = files_state(spark, *paths)
    with _open_lock:
        if key not in _open or _open[key][0] != state:
            if key in _open:
                _remove(_open.pop(key)[1])
            tag = hashlib.sha256(f"{table_dir}\n{state}".encode()).hexdigest()[:12]
            ws = Workspace(spark, star_schema_profile(), f"{shared_dir(spark)}/feed-{tag}")
            orders, customer = (spark.read.parquet(path) for path in paths)
            write_text_csv(ticket_feed(orders, customer), ws.raw_path)
            write_text_csv(agent_feed(orders), ws.agents_path)
            _open[key] = state, ws
        return _open[key][1]


def _remove(ws: Workspace) -> None:
    ws.close()
    remove_path(ws.spark, ws.folder)


def close_workspaces(spark: SparkSession) -> None:
    """Remove what the workspaces of this application have written."""
    with _open_lock:
        for key in [k for k in _open if k[0] == spark.sparkContext.applicationId]:
            _remove(_open.pop(key)[1])
