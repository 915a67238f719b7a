"""Intermediate tables, written to the shared folder and removed when no longer read.

A written table cuts lineage: whatever executor is lost later, its tasks start
again from files that all executors see.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.session import remove_path, shared_dir


_begun: list[Stages] = []


class Stages:
    """The written tables of one run of an operator.

    Those that a returned DataFrame reads stay until someone closes the run: whoever has
    written or collected the result, as :func:`closed_after` does.
    """

    def __init__(self, spark: SparkSession, operator: str):
        _begun.append(self)
        self.spark = spark
        self.folder = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"
        self._count = 0

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` read back from Parquet."""
        self._count += 1
        path = f"{self.folder}/{self._count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    def remove(self, df: DataFrame) -> None:
        """Remove a table of ``write`` that nothing will read again."""
        remove_path(self.spark, df.stage_path)


    def close(self) -> None:
        """Remove all tables of the run; what reads them is no longer usable."""
        remove_path(self.spark, self.folder)
        _begun.remove(self)


@contextmanager
def closed_after() -> Iterator[None]:
    """Closes the runs that begin inside; their results have to be written or collected there."""
    before = set(map(id, _begun))
    try:
        yield
    finally:
        for run in [r for r in _begun if id(r) not in before]:
            run.close()


#: Texts that a task exchanges with its Python worker at a time.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to a size that holds for long texts too.

    A batch stands in memory on both sides, and up to 10,000 texts are a lot.  A
    setting that is smaller already stays.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(\d+)([kmgtp]?)", spark.conf.get(name).lower()).groups()
    now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}[unit]
    if now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


class RowBatches:
    """Rows gathered into Arrow batches of bounded size."""

    def __init__(self, fields: dict[str, pa.DataType], rows: int = 20_000):
        self.fields = fields
        self.rows = rows
        self.pending: list[tuple] = []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.pending.append(row)
        if len(self.pending) >= self.rows:
            yield self._batch()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.pending:
            yield self._batch()
        pa.default_memory_pool().release_unused()

    def _batch(self) -> pa.RecordBatch:
        columns = zip(*self.pending)
        arrays = [pa.array(c, t) for c, t in zip(columns, self.fields.values())]
        self.pending = []
        return pa.RecordBatch.from_arrays(arrays, names=list(self.fields))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def power_of_two(least: float, most: int = 1 << 30) -> int:
    """The smallest power of two that is not under ``least``."""
    n = 1
    while n < least and n < most:
        n *= 2
    return n


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or a longer name if the table has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``docs`` whose id is not among the ids of the one column of ``gone``."""
    name = free_name(docs, "_gone")
    ids = gone.distinct().toDF(name)
    return docs.join(ids, F.col(id_col).cast("long") == F.col(name), "left_anti")
