"""Column expressions with the engine's semantics where Spark's defaults differ."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quern.functions.types import SPARK, Kind

INT_TEXT = r"^[+-]?[0-9]+$"
FLOAT_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the length of a block."""
    before = {k: spark.conf.get(k, None) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def wrapping(spark: SparkSession):
    """Sums built in this block wrap around at 64 bits; Spark fixes the mode when it analyses a sum, so later settings don't matter."""
    return settings(spark, {"spark.sql.ansi.enabled": "false"})


def compare(column: Column, op: str, literal: Column) -> Column:
    return {"=": column == literal, "<": column < literal, ">": column > literal}[op]


def predicate(column: Column, kind: Kind, op: str, value: int | float | str) -> Column:
    """column <op> literal: exact between integers, in doubles as soon as either is one, by bytes between strings. NaN matches nothing (Spark's would be the largest)."""
    if kind is Kind.UTF8:
        return compare(column, op, F.lit(value))
    if kind is Kind.INT64 and isinstance(value, int):
        return compare(column.cast("long"), op, F.lit(value).cast("long"))
    wide = column.cast("double")
    test = compare(wide, op, F.lit(float(value)))
    return test & ~F.isnan(wide) if kind is Kind.FLOAT64 and op == ">" else test


def as_kind(column: Column, kind: Kind) -> Column:
    return column.cast(SPARK[kind])


def trimmed(text: Column) -> Column:
    """Without Unicode white space at its ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def parse_int(text: Column) -> Column:
    """A 64-bit integer, or null if the text is none."""
    t = trimmed(text)
    return F.when(t.rlike(INT_TEXT), t.try_cast("long"))


def parse_float(text: Column) -> Column:
    """A finite double, or null if the text is none (inf and NaN are words, not numbers)."""
    t = trimmed(text)
    x = F.when(t.rlike(FLOAT_TEXT), t.try_cast("double"))
    return F.when(F.abs(x) < float("inf"), x)
