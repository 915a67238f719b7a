"""Line de-duplication by a log-template tree of fixed depth.

A line is parsed as a log parser would: by its number of tokens, then by its leading
``depth`` tokens, to a leaf.  Tokens with a digit, an at sign or a scheme are variable fields
from the start, unless less than ``least_fixed`` of the line would be left: such lines are
compared as they are written.  Within a leaf, a token that fewer than ``least_docs`` documents have at its
place is a variable field too.  What remains is the template of the line.  Templates of
``least_tokens`` tokens or more, at least ``least_fixed`` of them fixed, that stand in
``least_docs`` or more documents are recurring; their lines are dropped from all documents but
the first, the one with the smallest id.

With ``verbatim``, lines that recur as they are need less: those under ``least_tokens``
tokens go from ``least_docs`` documents on, those of ``long_tokens`` or more from two.  The
minimum of tokens then holds for templates alone.

The tree is not grown line by line: leaves and supports are counted by Spark, so templates
do not depend on an order, and no leaf has to fit in one task.

Plan
----
1. One scan writes a row of hashes for each line, with the rank of its document.  Documents
   per line come from distinct (hash, document) pairs, so a line that stands in a third of
   all documents is counted in many tasks; leaves are summed up from these counts.
2. Only leaves that can recur and hold lines which do not recur as they are need their tokens:
   those lines, and one line for each recurring one, are read again.
3. Documents meet their dropped line numbers; the texts are shuffled once for this.

Defined results: lines end at line feeds; blank lines stay, and without
``verbatim`` lines under ``least_tokens`` tokens; null and empty texts have no lines and stay as they are; a null id counts as the
largest; rows equal in id and text are one document and lose the same lines; a document left
without any line has an empty text; an empty table gives an empty result.  Other columns of
the input are passed on untouched by ``drop_lines``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from queuelens.llm.stages import RowBatches, Stages, free_name, small_batches, text_or_empty

DEPTH = 3
LEAST_DOCS = 3
LEAST_TOKENS = 4
LEAST_FIXED = 0.7
#: For ``verbatim``: lines of so many tokens go from two documents on.
LONG_TOKENS = 50
VARIABLE = "<*>"


_EVIDENT = re.compile(r"\d|@|://")


def masked(line: str, least_fixed: float = LEAST_FIXED) -> list[str]:
    """Tokens of a line, the evident variable fields as ``<*>``; all tokens as they are where
    less than ``least_fixed`` of them would stay."""
    tokens = line.split()
    if _EVIDENT.search(line):
        found = [VARIABLE if _EVIDENT.search(t) else t for t in tokens]
        if len(found) - found.count(VARIABLE) >= least_fixed * len(found):
            return found
    return tokens


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(tokens: list[str], *more: int) -> int:
    joined = "\x1f".join([*map(str, more), *tokens])
    return _signed(xxh3_64_intdigest(joined.encode("utf-8", "surrogatepass")))


def leaf(tokens: list[str], depth: int) -> int:
    return _hash(tokens[:depth], len(tokens))


def _lines(depth: int, least_tokens: int, least_fixed: float, long_tokens: int | None):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = RowBatches(
            {"row": pa.int64(), "rank": pa.int64(), "line": pa.int32(), "leaf": pa.int64()}
            | {"form": pa.int64(), "same": pa.int64()}
        )
        for batch in batches:
            rows, ranks = (batch.column(c).to_pylist() for c in ("row", "rank"))
            for row, rank, text in zip(rows, ranks, batch.column("text")):
                for number, line in enumerate(text.as_py().split("\n")):
                    tokens = masked(line, least_fixed)
                    short = len(tokens) < least_tokens
                    same = None
                    if tokens and long_tokens is not None and (short or len(tokens) >= long_tokens):
                        same = _hash(line.split())
                    if not short:
                        own = leaf(tokens, depth)
                        yield from out.add((row, rank, number, own, _hash(tokens), same))
                    elif same is not None:
                        yield from out.add((row, rank, number, None, None, same))
        yield from out.rest()

    return of_partition


def _tokens(depth: int, least_fixed: float):
    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = RowBatches(
            {
                "row": pa.int64(),
                "rank": pa.int64(),
                "line": pa.int32(),
                "leaf": pa.int64(),
                "length": pa.int32(),
                "place": pa.int32(),
                "token": pa.int64(),
                "stands": pa.bool_(),
            }
        )
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("row", "rank", "lines"))
            for row, rank, lines, text in zip(*columns, batch.column("text")):
                split = text.as_py().split("\n")
                for number, stands in ((x["line"], x["stands"]) for x in lines):
                    tokens = masked(split[number], least_fixed)
                    own = leaf(tokens, depth)
                    for place, token in enumerate(tokens):
                        if token != VARIABLE:
                            at = _hash([token], place)
                            yield from out.add(
                                (row, rank, number, own, len(tokens), place, at, stands)
                            )
        yield from out.rest()

    return of_partition


def _in_documents(rows: DataFrame, *key: str) -> DataFrame:
    """Number of documents that have each key."""
    pairs = rows.groupBy(*key, "row").agg(F.lit(1).alias("x"))
    return pairs.groupBy(*key).agg(F.count(F.lit(1)).alias("docs"))


def _identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with a key for its id and text, which stands for the document."""
    text = text_or_empty(text_col)
    return docs.select(
        F.xxhash64(F.col(id_col).cast("long"), text).alias("row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("rank"),
        text.alias("text"),
    )


def recurring_lines(
    docs: DataFrame,
    depth: int = DEPTH,
    least_docs: int = LEAST_DOCS,
    least_tokens: int = LEAST_TOKENS,
    least_fixed: float = LEAST_FIXED,
    verbatim: bool = False,
    long_tokens: int = LONG_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(row, line) to drop; ``row`` is the key of id and text, ``line`` counts from 0."""
    small_batches(docs.sparkSession)
    stages = Stages(docs.sparkSession, "line-dedup")
    base = _identified(docs, id_col, text_col)
    written = stages.write(
        base.mapInArrow(
            _lines(depth, least_tokens, least_fixed, long_tokens if verbatim else None),
            "row long, rank long, line int, leaf long, form long, same long",
        ),
        "lines",
    )
    lines = written.where("leaf is not null").select("row", "rank", "line", "leaf", "form")
    forms = stages.write(_in_documents(lines, "leaf", "form"), "forms")
    # leaves that hold lines which do not recur as they are, and lines enough to recur: documents
    # are counted once per form here, so no leaf with enough documents is missed
    open_leaf = stages.write(
        forms.groupBy("leaf")
        .agg(F.sum("docs").alias("holders"), F.min("docs").alias("rarest"))
        .where((F.col("holders") >= least_docs) & (F.col("rarest") < least_docs))
        .select("leaf"),
        "open-leaves",
    )
    in_open = lines.join(open_leaf, "leaf", "left_semi").join(forms, ["leaf", "form"])
    single = in_open.where(F.col("docs") < least_docs).select(
        "row", "line", F.lit(False).alias("stands")
    )
    # of a recurring line, one stands for all: its tokens have support enough
    one_of_many = (
        in_open.where(F.col("docs") >= least_docs)
        .groupBy("leaf", "form")
        .agg(F.min(F.struct("row", "line")).alias("at"))
        .select("at.row", "at.line", F.lit(True).alias("stands"))
    )
    wanted = (
        single.union(one_of_many)
        .groupBy("row", "line")
        .agg(F.max("stands").alias("stands"))
        .groupBy("row")
        .agg(F.collect_list(F.struct("line", "stands")).alias("lines"))
    )
    # hashing the line numbers spares sorting the texts
    tokens = stages.write(
        base.join(wanted.hint("shuffle_hash"), "row").mapInArrow(
            _tokens(depth, least_fixed),
            "row long, rank long, line int, leaf long, length int, place int, token long, stands boolean",
        ),
        "tokens",
    )
    at = ["leaf", "place", "token"]
    supported = (
        tokens.groupBy(*at, "row")
        .agg(F.max("stands").alias("stands"))
        .groupBy(*at)
        .agg(F.count(F.lit(1)).alias("docs"), F.max("stands").alias("stands"))
        .where((F.col("docs") >= least_docs) | F.col("stands"))
        .select(*at)
    )
    general = (
        tokens.where(~F.col("stands"))
        .join(supported, at, "left_semi")
        .groupBy("row", "rank", "line", "leaf", "length")
        # a set: equal rows of the table give the same tokens
        .agg(F.sort_array(F.collect_set(F.struct("place", "token"))).alias("fixed"))
        .where(F.size("fixed") >= F.col("length") * F.lit(least_fixed))
        .select("row", "rank", "line", "leaf", F.xxhash64("fixed").alias("template"))
    )
    exact = lines.join(
        forms.where(F.col("docs") >= least_docs).select("leaf", "form"), ["leaf", "form"]
    ).select("row", "rank", "line", "leaf", F.col("form").alias("template"))
    found = exact.withColumn("kind", F.lit(0)).union(general.withColumn("kind", F.lit(1)))
    # kind 2: short lines as they are; kind 3: long ones
    least = F.when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(least_docs))
    if verbatim:
        as_is = written.where("same is not null").select(
            "row", "rank", "line", "same", F.when(F.col("leaf").isNull(), 2).otherwise(3).alias("kind")
        )
        repeated = stages.write(
            _in_documents(as_is, "kind", "same").where(F.col("docs") >= least).select("kind", "same"),
            "repeated",
        )
        found = found.union(
            as_is.join(repeated, ["kind", "same"]).select(
                "row", "rank", "line", F.lit(0).cast("long"), "same", "kind"
            )
        )
    matched = stages.write(found, "matched")
    template = ["kind", "leaf", "template"]
    for table in (written, forms, open_leaf, tokens):
        stages.remove(table)
    # written, so that the join deals both sides anew and can split a hot template
    first = stages.write(
        matched.groupBy(*template, "rank", "row")
        .agg(F.lit(1).alias("x"))
        .groupBy(*template)
        .agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct("rank", "row")).alias("first"))
        .where(F.col("docs") >= least)
        .select(*template, F.col("first.row").alias("first")),
        "first",
    )
    return matched.join(first, template).where("row <> first").select("row", "line").distinct()


def drop_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """``docs`` with recurring lines dropped from the text, and the numbers of lines before and
    of lines dropped as columns n_lines and n_dropped; columns of these names are replaced."""
    return _without_dropped(docs, id_col, text_col, "n_lines", "n_dropped", options)


def _without_dropped(
    docs: DataFrame, id_col: str, text_col: str, n_lines: str, n_dropped: str, options: dict
) -> DataFrame:
    dropped = recurring_lines(docs, id_col=id_col, text_col=text_col, **options)
    row, key, gone = (free_name(docs, c) for c in ("_row", "_key", "_lines"))
    per_row = dropped.groupBy(F.col("row").alias(row)).agg(F.collect_list("line").alias(gone))
    text = text_or_empty(text_col)
    keyed = docs.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), text))
    joined = keyed.join(per_row.hint("shuffle_hash"), F.col(key) == F.col(row), "left")
    split = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    cut = F.array_join(F.transform(kept, lambda i: F.element_at(split, i + 1)), "\n")
    # a line feed is one byte, and bytes are known without counting characters
    feeds = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    count = F.when(text == "", F.lit(0)).otherwise(feeds + 1).cast("long")
    found = F.when(F.col(gone).isNull(), F.lit(0)).otherwise(F.size(gone)).cast("long")
    return joined.withColumns(
        {
            n_lines: count,
            n_dropped: found,
            text_col: F.when(F.col(gone).isNotNull(), cut).otherwise(F.col(text_col)),
        }
    ).drop(key, row, gone)


def without_recurring_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    **options,
) -> DataFrame:
    """``docs`` in its own columns, with recurring lines dropped, without the documents that
    lose all their text this way; a column ``length_col`` follows the text."""
    n_lines, n_dropped = (free_name(docs, c) for c in ("n_lines", "n_dropped"))
    cut = _without_dropped(docs, id_col, text_col, n_lines, n_dropped, options)
    some = F.col(n_dropped) > 0
    if length_col in docs.columns:
        length = F.when(some, F.length(text_col)).otherwise(F.col(length_col))
        cut = cut.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return cut.where(~(some & (F.trim(text_col) == ""))).select(*docs.columns)
