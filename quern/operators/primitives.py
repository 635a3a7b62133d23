"""The operators below the query: scan, project, filter, masks, dictionary codes, ungrouped sums, phases of the group-by."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.errors import UnknownColumn
from quern.functions.expressions import wrapping


def scan(df: DataFrame, columns: list[str]) -> DataFrame:
    """The named columns only, each once; a Parquet scan below reads no others."""
    for c in columns:
        if c not in df.columns:
            raise UnknownColumn(c, df.columns)
    return df.select(*dict.fromkeys(columns))


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    return scan(df, columns)


def filter_rows(df: DataFrame, condition: Column, columns: list[str]) -> DataFrame:
    """Rows that pass, with the columns that go on."""
    return df.where(condition).select(*columns)


def mask(df: DataFrame, condition: Column, name: str = "mask") -> DataFrame:
    """All rows, with whether each passes."""
    return df.withColumn(name, condition)


def count_ones(df: DataFrame, condition: Column) -> DataFrame:
    """One row: ones, size."""
    return df.agg(F.count_if(condition).alias("ones"), F.count("*").alias("size"))


def packed_bitset(df: DataFrame, position: str, condition: Column) -> DataFrame:
    """Rows (bucket, bits): the passing positions (from 0) as bitmaps of 32,768 bits."""
    at = F.col(position) + 1
    return df.where(condition).groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))


def ones(df: DataFrame, position: str, condition: Column) -> DataFrame:
    """The passing positions."""
    return df.where(condition).select(position)


def dictionary(df: DataFrame, column: str, order: str) -> DataFrame:
    """Rows (value, code): codes from 0 in the order in which values are first seen by ``order``.

    A value's code is the number of values seen before it, so the values (not the rows) are numbered in one
    place; a column with very many values has no use for codes.
    """
    firsts = df.groupBy(F.col(column).alias("value")).agg(F.min(order).alias("first"))
    return firsts.selectExpr("value", "row_number() OVER (ORDER BY first, value) - 1 AS code")


def dense_sum(df: DataFrame, column: str, name: str = "sum") -> DataFrame:
    """One row: the ungrouped sum, wrapping for integers; zero for no rows."""
    with wrapping(df.sparkSession):
        total = df.agg(F.sum(F.col(column)).alias("s"))
    kind = dict(total.dtypes)["s"]
    return total.select(F.coalesce("s", F.lit(0).cast(kind)).alias(name))


def group_index(rows: DataFrame) -> DataFrame:
    """Phase one of the hash group-by alone: the distinct keys k."""
    return rows.select("k").distinct()


def scatter_accumulate(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Phase two alone: sums s of v by the numbers (code) that ``index`` (k, code) gives the keys k."""
    with wrapping(rows.sparkSession):
        return rows.join(index, "k").groupBy("code").agg(F.sum("v").alias("s"))
