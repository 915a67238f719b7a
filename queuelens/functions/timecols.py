"""Time arithmetic on ``timestamp_ntz`` columns.

Differences count calendar boundaries (10:00:59 to 10:01:01 is one minute),
not elapsed time.  Neither they nor parsing depend on the session time zone.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

_MINUTES_PER_DAY = 1440


def parse_first(col: Column, formats: Sequence[str]) -> Column:
    """The first format that parses wins; NULL when none does.

    White space of any kind and length separates like one space and is trimmed.  A year
    has one to four digits and no sign.  A format is tried only on text holding
    its separator, which spares most rows all but the one parse that can succeed.

    Text with all digits written, as nearly all of it is, is cut up by position instead; the
    pattern parser, which costs many times as much, sees the rest.  Every mention of an
    expression is code of its own, and Java does not compile a method of more than 8,000 bytes,
    so conditions look at ``col`` itself and the cleaned text is mentioned once per format.
    """
    text = F.trim(F.regexp_replace(col, r"\s+", " "))
    parsed = F.coalesce(
        *[
            F.when(F.contains(col, F.lit(_separator(fmt))), _parse_wall_clock(text, fmt))
            for fmt in formats
        ]
    )
    out = F.when(~col.rlike(r"^\s*[-+]|[-/\s][-+]|\d{5}"), parsed)
    literals = [_literals(fmt) for fmt in formats]
    # the first format, taken for the commonest, is looked at first
    for fmt, own in reversed([*zip(formats, literals)]):
        # text that another pattern may read as well is left to the order of the patterns
        padded = _padded(fmt) if literals.count(own) == 1 else None
        if padded is not None:
            shape, starts = padded
            # a cast reads ISO text as it stands
            iso = col if padded == _padded("y-M-d H:m:s") else _as_iso(col, starts)
            # a month that is none is told here: the cast would raise and catch an exception
            known = F.substring(col, starts["M"], 2) <= "12"
            cut = F.when(known, iso.try_cast("timestamp_ntz"))
            out = F.when(col.rlike(shape), cut).otherwise(out)
    return out


# Digits of each field of a pattern where all of them are written.
_DIGITS = {"y": 4, "M": 2, "d": 2, "H": 2, "m": 2, "s": 2}


def _literals(fmt: str) -> str:
    """What stands between the fields of a pattern."""
    return re.sub(r"[A-Za-z]+", "x", fmt)


def _padded(fmt: str) -> tuple[str, dict[str, int]] | None:
    """Regular expression of text with all digits written, and where each field starts.

    None for patterns with other fields than a date, hours and minutes, and perhaps seconds.
    """
    shape, starts, at = "", {}, 1
    for run in re.finditer(r"([A-Za-z])\1*|.", fmt):
        letter = run.group(1)
        if letter is None:
            shape, at = shape + re.escape(run.group()), at + 1
        elif letter in starts or len(run.group()) not in (1, _DIGITS.get(letter)):
            return None
        else:
            shape += rf"\d{{{_DIGITS[letter]}}}" if letter in _DIGITS else ""
            starts[letter], at = at, at + _DIGITS.get(letter, 0)
    if set(starts) | {"s"} != set(_DIGITS) or "'" in fmt:
        return None
    return rf"\A{shape}\z", starts


def _as_iso(text: Column, starts: dict[str, int]) -> Column:
    """Text of the shape of :func:`_padded` put in ISO order."""

    def field(letter: str) -> Column:
        if letter not in starts:
            return F.lit("00")
        return F.substring(text, starts[letter], _DIGITS[letter])

    parts = [field("y"), "-", field("M"), "-", field("d"), " ", field("H"), ":", field("m"), ":", field("s")]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _parse_wall_clock(text: Column, fmt: str) -> Column:
    """Text as ``timestamp_ntz``.

    Spark's non-failing parser yields an instant.  Reading the text as UTC and
    counting seconds from the epoch gives the wall clock back untouched, where a
    session zone would move hours that its daylight saving skips.
    """
    instant = F.try_to_timestamp(F.concat(text, F.lit("+00:00")), F.lit(f"{fmt}xxx"))
    epoch = F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'")
    return epoch + F.unix_seconds(instant) * F.expr("INTERVAL '1' SECOND")


def _separator(fmt: str) -> str:
    """First character of the pattern that stands for itself."""
    return next((c for c in fmt if not c.isalpha() and not c.isspace()), "")


def parse_date(col: Column, fmt: str) -> Column:
    return F.try_to_timestamp(F.trim(col), F.lit(fmt)).cast("date")


def date_lit(value: date) -> Column:
    return F.lit(value)


def timestamp_lit(value: date) -> Column:
    """Midnight of ``value``."""
    return F.lit(value).cast("timestamp_ntz")


def days_between(start: Column, end: Column) -> Column:
    """Day boundaries crossed from ``start`` to ``end``, signed."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")


def _minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def minutes_between(start: Column, end: Column) -> Column:
    """Minute boundaries crossed from ``start`` to ``end``, signed."""
    return (
        days_between(start, end) * _MINUTES_PER_DAY + _minute_of_day(end) - _minute_of_day(start)
    )


def month_start(ts: Column) -> Column:
    """Midnight on the first of the month."""
    return F.trunc(ts.cast("date"), "month").cast("timestamp_ntz")


def weekday_number(ts: Column) -> Column:
    """Sunday is 0."""
    return (F.dayofweek(ts) - 1).cast("bigint")


def weekday_name(ts: Column) -> Column:
    return F.date_format(ts, "EEEE")
