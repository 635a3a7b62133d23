"""The three types of the data model, and how Spark's types map to them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Kind(Enum):
    INT64 = "Int64"
    FLOAT64 = "Float64"
    UTF8 = "Utf8"


SPARK = {Kind.INT64: T.LongType(), Kind.FLOAT64: T.DoubleType(), Kind.UTF8: T.StringType()}


def kind_of(spark_type: T.DataType) -> Kind | None:
    """The model's type of a Spark type (narrower numbers widen), or None outside the model."""
    if isinstance(spark_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return Kind.INT64
    if isinstance(spark_type, (T.FloatType, T.DoubleType)):
        return Kind.FLOAT64
    return Kind.UTF8 if isinstance(spark_type, T.StringType) else None
