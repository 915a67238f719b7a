"""Exact de-duplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Every text gets a SHA-256 digest, its byte length and a second, unrelated hash;
equal texts are rows that agree in all three, which every merge checks anew.

Plan
----
1. One scan writes (row, id, run, digest): the run is the input split.
2. Partitions exchange runs in binomial rounds.  In round r, the runs whose
   numbers differ only in the r-th group of bits form a team; each member takes
   the digests that carry its own bits there, merges what the others send and
   keeps one row per digest: the id that stays and the number of rows.  After the
   last round a run holds all digests that end in its number.  A text that makes up
   a third of all rows is one row in every run, so no merge is larger than another.
3. Answers for repeated digests go back the way they came, round by round, down to
   the rows of each split.

The multiway merge of what a team's members send is Spark's aggregate, which meets them behind a
shuffle and sorts or hashes them by digest itself; round tables are written sorted, for
Parquet's sake, but no merge relies on it.  A lost executor repeats one round at most.

Defined results: null text counts as empty; empty texts equal each other; rows
without id lose against rows with one; of rows that share id and text one is
kept; an empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.stages import Stages, power_of_two, shuffle_width, text_or_empty

IDENTITY = ["digest", "bytes", "witness"]


def _first_rank(keep: str) -> tuple[Column, Callable[[Column], Column]]:
    """What to compare rows by, and the aggregate that picks the one that stays."""
    if keep == "largest":
        return F.struct("doc_id", "row"), F.max
    if keep == "smallest":
        return F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "row"), F.min
    raise ValueError(f"keep is 'largest' or 'smallest', not {keep!r}")


def exact_groups(
    docs: DataFrame,
    keep: str = "largest",
    normalise: Callable[[Column], Column] | None = None,
    team_bits: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row.

    ``normalise`` changes texts before they are compared; ``team_bits`` is the
    binary logarithm of the number of runs merged at a time.
    """
    spark = docs.sparkSession
    stages = Stages(spark, "exact-dedup")
    text = text_or_empty(text_col)
    if normalise:
        text = normalise(text)
    runs = power_of_two(shuffle_width(spark))
    bits = runs.bit_length() - 1
    rank, pick = _first_rank(keep)
    rows = stages.write(
        docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select(
            "doc_id",
            F.monotonically_increasing_id().alias("row"),
            F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
            F.unhex(F.sha2("text", 256)).alias("digest"),
            F.octet_length("text").alias("bytes"),
            F.xxhash64("text").alias("witness"),
        ),
        "rows",
    )
    # the tail of the digest, as a number of as many bits as runs have
    tail = F.conv(F.right(F.hex("digest"), F.lit(8)), 16, 10).cast("long").bitwiseAND(runs - 1)
    level = rows.groupBy("run", *IDENTITY).agg(
        pick(rank).alias("stays"), F.count(F.lit(1)).alias("size")
    )
    levels, teams = [stages.write(level, "run-0")], []
    for low in range(0, bits, team_bits):
        mask = ((1 << min(team_bits, bits - low)) - 1) << low
        to = (
            F.col("run").bitwiseAND(runs - 1 - mask).bitwiseOR(tail.bitwiseAND(mask)).cast("int")
        )
        merged = (
            levels[-1]
            .withColumn("run", to)
            .repartitionById(runs, F.col("run"))
            .groupBy("run", *IDENTITY)
            .agg(pick("stays").alias("stays"), F.sum("size").alias("size"))
            .sortWithinPartitions("run", *IDENTITY)
        )
        levels.append(stages.write(merged, f"run-{low + team_bits}"))
        teams.append(to)
    answers = levels[-1].where("size > 1")
    for level, to in zip(levels[-2::-1], teams[::-1]):
        below = level.select("run", *IDENTITY, to.alias("team"))
        above = answers.withColumnRenamed("run", "team")
        answers = stages.write(below.join(above, ["team", *IDENTITY]).drop("team"), "answers")
    for level in levels[: -1 if len(levels) > 1 else 0]:
        stages.remove(level)
    return rows.join(answers, ["run", *IDENTITY], "left").select(
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("doc_id"))
        .otherwise(F.col("stays.doc_id"))
        .alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
