"""CSV and Parquet readers and writers."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.functions.timecols import parse_date
from queuelens.profile import RAW_AGENT_COLUMNS, RAW_TICKET_COLUMNS, TicketProfile

CONCURRENT_WRITES = 12

CLEAN_SCHEMA = T.StructType(
    [
        T.StructField("ticket_id", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("channel", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("priority", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("resolved_at", T.TimestampNTZType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("satisfaction_score", T.IntegerType()),
        T.StructField("team", T.StringType()),
        T.StructField("hire_date", T.DateType()),
        T.StructField("location", T.StringType()),
        T.StructField("is_resolved", T.BooleanType()),
        T.StructField("resolution_hours", T.DoubleType()),
        T.StructField("is_negative_duration", T.BooleanType()),
        T.StructField("is_extreme_duration", T.BooleanType()),
        T.StructField("is_future_resolution", T.BooleanType()),
        T.StructField("open_age_days", T.LongType()),
        T.StructField("created_before_hire", T.BooleanType()),
        T.StructField("missing_agent", T.BooleanType()),
        T.StructField("has_satisfaction", T.BooleanType()),
        T.StructField("is_bottom_box", T.BooleanType()),
        T.StructField("is_partial_month", T.BooleanType()),
        T.StructField("is_id_conflict", T.BooleanType()),
    ]
)


# The text of a line whose number of cells is not that of the header.
BROKEN_COLUMN = "broken_record"


def _text_csv(
    spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool = False
) -> DataFrame:
    """Header CSV with every column as text; blank cells are NULL, inner spaces are kept.

    Names and order come from the header, which every file must share; ``columns``
    must be among them and come first in the result, any others follow.  Quotes are
    doubled inside quoted cells.  A line with too few or too many cells keeps what could
    be read of it, and its text in ``broken_record``.

    Files stay splittable, so a line break inside quotes ends the line, and both halves are
    broken records.  ``multi_line`` reads such cells whole, one task per file.
    """
    reader = (
        spark.read.option("header", True)
        .option("escape", '"')
        .option("multiLine", multi_line)
        .option("enforceSchema", False)
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", BROKEN_COLUMN)
    )
    header = reader.csv(path).columns
    missing = [name for name in columns if name not in header]
    if missing:
        raise ValueError(f"{path}: the header has no {', '.join(missing)}")
    fields = [T.StructField(name, T.StringType()) for name in [*header, BROKEN_COLUMN]]
    rows = reader.schema(T.StructType(fields)).csv(path)
    others = [name for name in header if name not in columns]
    cells = [F.nullif(F.col(f"`{name}`"), F.lit("")).alias(name) for name in [*columns, *others]]
    return rows.select(*cells, BROKEN_COLUMN)


def read_raw_tickets(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] = RAW_TICKET_COLUMNS,
    multi_line: bool = False,
) -> DataFrame:
    """The raw ticket export, untyped: ``columns``, any others, and ``broken_record``."""
    return _text_csv(spark, path, columns, multi_line)


def export_lines(spark: SparkSession, path: str) -> DataFrame:
    """The filled lines of the files at ``path`` as plain text, without those that are the header.

    All files share one header, so the first line of any of them tells it; nothing is parsed.
    """
    lines = spark.read.text(path)
    header = lines.limit(1).agg(F.max("value")).scalar()
    return lines.filter(F.col("value").rlike(r"[^\x00-\x20]") & (F.col("value") != header))


def read_agents(spark: SparkSession, path: str, profile: TicketProfile) -> DataFrame:
    """The agent dimension with a parsed hire date."""
    agents = _text_csv(spark, path, RAW_AGENT_COLUMNS).select(*RAW_AGENT_COLUMNS)
    return agents.withColumn("hire_date", parse_date(F.col("hire_date"), profile.date_format))


# Month of creation as yyyy-MM, by which the clean table is laid out; NULL where undated.
MONTH_COLUMN = "created_month"


def read_clean_tickets(
    spark: SparkSession, path: str, first: str | None = None, last: str | None = None
) -> DataFrame:
    """The clean table; ``first`` and ``last`` (yyyy-MM, inclusive) bound the month of creation.

    A bound leaves out whole folders, and undated tickets with them.
    """
    schema = T.StructType([*CLEAN_SCHEMA.fields, T.StructField(MONTH_COLUMN, T.StringType())])
    rows = spark.read.schema(schema).parquet(path)
    if first is not None:
        rows = rows.filter(F.col(MONTH_COLUMN) >= first)
    if last is not None:
        rows = rows.filter(F.col(MONTH_COLUMN) <= last)
    return rows.select(*CLEAN_SCHEMA.fieldNames())


def read_text_csv(spark: SparkSession, path: str, columns: Sequence[str] = ()) -> DataFrame:
    """What ``write_text_csv`` wrote, every cell as text; known ``columns`` save a look at it."""
    reader = spark.read
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return (
        reader.option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def read_clean_csv(spark: SparkSession, path: str) -> DataFrame:
    """The clean table from its CSV export, in its types."""
    return (
        spark.read.schema(CLEAN_SCHEMA)
        .option("header", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def write_text_csv(df: DataFrame, path: str) -> None:
    """Standard CSV that reads back cell for cell: quotes are doubled, outer spaces stay."""
    (
        df.write.mode("overwrite")
        .option("header", True)
        .option("escape", '"')
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_clean(clean: DataFrame, path: str) -> dict[str, str]:
    """C14: the clean table as Parquet and CSV folders below ``path``.

    The Parquet is laid out by month of creation.  Rows are rebalanced by month, so that a month
    is in few files, while adaptive execution splits one that would overfill a task.  The CSV is written from the Parquet just produced, so the cleaning plan runs
    once.
    """
    targets = {"parquet": f"{path}/tickets_clean.parquet", "csv": f"{path}/tickets_clean.csv"}
    month = F.date_format("created_at", "yyyy-MM")
    laid = clean.withColumn(MONTH_COLUMN, month).hint("rebalance", F.col(MONTH_COLUMN))
    laid.write.mode("overwrite").partitionBy(MONTH_COLUMN).parquet(targets["parquet"])
    write_text_csv(read_clean_tickets(clean.sparkSession, targets["parquet"]), targets["csv"])
    return targets


def slug(title: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_")


def write_cuts(
    cuts: Mapping[str, DataFrame], path: str, at_once: int = CONCURRENT_WRITES
) -> dict[str, str]:
    """S3: each titled cut as one CSV folder named after its title.

    A cut may have a row for every free-form label, so nothing is gathered: adaptive
    execution leaves small ones in one file by itself.  ``at_once`` of the independent
    jobs are submitted side by side.
    """
    targets = {title: f"{path}/{slug(title)}.csv" for title in cuts}

    def write(title: str) -> None:
        write_text_csv(cuts[title], targets[title])

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(write, cuts))
    return targets


def cells(
    spark: SparkSession, targets: Mapping[str, str], columns: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Written CSV folders as (cut, row, column, value, number), one row per filled cell.

    ``columns`` are those of each cut, so that its file is not opened to find them.

    ``row`` names the row by its cells that are no numbers, in the order of their columns'
    names; a cell that is a number is in ``number`` and not in ``value``.
    """
    frames = []
    for cut, path in targets.items():
        table = read_text_csv(spark, path, columns[cut])
        names = sorted(table.columns)
        text = {c: F.when(F.col(f"`{c}`").try_cast("double").isNull(), F.col(f"`{c}`")) for c in names}
        entries = F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    text[c].alias("value"),
                    F.col(f"`{c}`").try_cast("double").alias("number"),
                )
                for c in names
            ]
        )
        row = F.concat_ws("|", *text.values())
        frames.append(table.select(F.lit(cut).alias("cut"), row.alias("row"), F.inline(entries)))
    filled = F.coalesce(F.col("value"), F.col("number").cast("string")).isNotNull()
    return reduce(DataFrame.union, frames).where(filled)


def files_state(spark: SparkSession, *paths: str) -> str:
    """Names, sizes and times of the files at ``paths``: changes when a table is replaced."""
    found = []
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target)
        found += [f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files]
    return "\n".join(sorted(found))
