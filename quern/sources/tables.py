"""Tables made in the program, and accessors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import ColumnLengthMismatch, UnknownColumn
from quern.functions.types import SPARK, Kind, kind_of


def table(spark: SparkSession, columns: dict[str, list], kinds: dict[str, Kind] | None = None) -> DataFrame:
    """A DataFrame from columns of equal length; types from the values (none: Utf8) unless given."""
    rows = len(next(iter(columns.values()), []))
    for name, values in columns.items():
        if len(values) != rows:
            raise ColumnLengthMismatch(name, rows, len(values))
    given = kinds or {}
    found = {n: given.get(n) or (Kind.UTF8 if not v or isinstance(v[0], str) else Kind.FLOAT64 if any(isinstance(x, float) for x in v) else Kind.INT64) for n, v in columns.items()}
    schema = T.StructType([T.StructField(n, SPARK[found[n]], False) for n in columns])
    return spark.createDataFrame([tuple(float(x) if found[n] is Kind.FLOAT64 else x for n, x in zip(columns, row, strict=True)) for row in zip(*columns.values(), strict=True)], schema)


def kind(df: DataFrame, column: str) -> Kind | None:
    """The model's type of a column."""
    if column not in df.columns:
        raise UnknownColumn(column, df.columns)
    return kind_of(df.schema.fields[df.columns.index(column)].dataType)


def typed(df: DataFrame, column: str, wanted: Kind) -> DataFrame | None:
    """The column alone, in the model's type, or None where it is of another one."""
    return df.select(F.col(f"`{column}`").cast(SPARK[wanted]).alias(column)) if kind(df, column) is wanted else None


def as_int64(df: DataFrame, column: str) -> DataFrame | None:
    return typed(df, column, Kind.INT64)


def as_float64(df: DataFrame, column: str) -> DataFrame | None:
    return typed(df, column, Kind.FLOAT64)


def as_utf8(df: DataFrame, column: str) -> DataFrame | None:
    return typed(df, column, Kind.UTF8)


def length(df: DataFrame) -> int:
    return df.count()


def is_empty(df: DataFrame) -> bool:
    return df.isEmpty()
