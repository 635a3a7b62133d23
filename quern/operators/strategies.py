"""Interchangeable ways to answer a bound plan. All give the same rows, in no order.

HASH is the one for large data: partial sums combine before the shuffle. The others exist to be compared
with it: SORT and SORT_RADIX deal out all filtered rows by key, sort them and add up runs of equal keys; NAIVE
and ROWS go row by row in Python, over column batches and over row objects.

A strategy is part of the logical plan, not of the session's settings, so it stays what it is when the result
is joined, written or planned again: the runs are reduced by an operator that the optimizer can't swap for a
hash aggregation, and the order that the sort asks for says how it is done (``sorted_pairs``).
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from enum import Enum

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expressions import wrapping
from quern.functions.types import SPARK, Kind
from quern.plans.logical import LogicalPlan
from quern.plans.parser import parse
from quern.plans.planner import Bound, bind
from quern.shipping import ship


class Strategy(Enum):
    HASH = "hash"
    SORT = "sort"
    SORT_RADIX = "sort-radix"
    NAIVE = "naive"
    ROWS = "rows"


def wrap(x: int) -> int:
    """A sum of 64-bit integers in two's complement."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def summed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """k and the wrapping (integers) or plain (doubles) sum s of v."""
    with wrapping(spark):
        return rows.groupBy("k").agg(F.sum("v").alias("s"))


def _hash(b: Bound) -> DataFrame:
    return b.named(summed(b.rows.sparkSession, b.filtered))


def collected_pairs(b: Bound) -> DataFrame:
    """The first phase of a sort: k and v of the rows that pass, dealt out by key."""
    return b.filtered.repartition(int(b.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k")


def sorted_pairs(b: Bound, radix: bool) -> DataFrame:
    """The second phase: pairs in key order inside each partition.

    Spark sorts one column of integers by radix; on a struct of it, and on strings, it compares.
    """
    return collected_pairs(b).sortWithinPartitions("k" if radix else F.struct("k"))


def reduced_runs(pairs: DataFrame) -> DataFrame:
    """The third phase: k and the sum s of v, for pairs with equal keys next to each other in one partition."""
    ship(pairs.sparkSession)
    key, value = (pairs.schema[c].dataType.simpleString() for c in "kv")
    whole = value == "bigint"

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the run that may go on in the next batch: key, sum, numbers in it
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, v = pc.run_end_encode(batch.column("k")), batch.column("v")
            starts = np.concatenate([[0], runs.run_ends.to_numpy()[:-1]])
            there = np.add.reduceat(pc.is_valid(v).to_numpy(zero_copy_only=False).astype(np.int64), starts)
            sums = np.add.reduceat(v.fill_null(0).to_numpy(zero_copy_only=False), starts)
            keys, sums, there = runs.values.to_pylist(), sums.tolist(), there.tolist()
            if held and held[0] == keys[0]:
                total = held[1] + sums[0]
                sums[0], there[0] = wrap(total) if whole else total, held[2] + there[0]
            elif held:
                keys, sums, there = [held[0], *keys], [held[1], *sums], [held[2], *there]
            held = keys.pop(), sums.pop(), there.pop()
            if keys:
                yield run_sums(keys, sums, there)
        if held:
            yield run_sums(*([x] for x in held))

    def run_sums(keys: list, sums: list, there: list) -> pa.RecordBatch:
        kinds = pa.int64() if key == "bigint" else pa.string(), pa.int64() if whole else pa.float64()
        return pa.RecordBatch.from_arrays([pa.array(keys, kinds[0]), pa.array([x if n else None for x, n in zip(sums, there, strict=True)], kinds[1])], ["k", "s"])

    return pairs.mapInArrow(reduce, f"k {key}, s {value}")


def buffered_rows(b: Bound) -> int:
    """How many rows the sort strategies hold before they reduce them."""
    return b.filtered.count()


def _sort(b: Bound, radix: bool) -> DataFrame:
    return b.named(reduced_runs(sorted_pairs(b, radix)))


def _naive(b: Bound) -> DataFrame:
    """A loop over the rows of column batches; each task's sums are added up by Spark."""
    op = {"=": operator.eq, "<": operator.lt, ">": operator.gt}[b.plan.op]
    literal, whole = b.plan.literal, b.value_kind is Kind.INT64
    double = b.filter_kind is Kind.INT64 and isinstance(literal, float)

    def loop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = {}
        for batch in batches:
            for k, v, f in zip(batch["k"].tolist(), batch["v"].tolist(), batch["f"].tolist(), strict=True):
                if op(float(f) if double else f, literal):
                    s = sums.get(k, 0) + v
                    sums[k] = wrap(s) if whole else s
        if sums:
            yield pd.DataFrame({"k": list(sums), "v": list(sums.values())})

    spark = b.rows.sparkSession
    ship(spark)
    typed = b.rows.select(F.col("k").cast(SPARK[b.group_kind]).alias("k"), F.col("v").cast(SPARK[b.value_kind]).alias("v"), F.col("f").cast(SPARK[b.filter_kind]).alias("f"))
    parts = typed.mapInPandas(loop, f"k {SPARK[b.group_kind].simpleString()}, v {SPARK[b.value_kind].simpleString()}")
    return b.named(summed(spark, parts))


class RowStore:
    """Row objects of a plan's three columns, one at a time in Python. build() makes and keeps them, so that run() can be measured alone."""

    def __init__(self, b: Bound):
        self.bound, self.spark = b, b.rows.sparkSession
        ship(self.spark)
        typed = b.rows.select(F.col("k").cast(SPARK[b.group_kind]).alias("k"), F.col("v").cast(SPARK[b.value_kind]).alias("v"), F.col("f").cast(SPARK[b.filter_kind]).alias("f"))
        self.objects: RDD = typed.rdd

    def build(self) -> int:
        """Rows in the store."""
        self.objects = self.objects.persist(StorageLevel.MEMORY_AND_DISK)
        return self.objects.count()

    def drop(self) -> None:
        self.objects.unpersist()

    def run(self) -> DataFrame:
        b = self.bound
        op = {"=": operator.eq, "<": operator.lt, ">": operator.gt}[b.plan.op]
        literal, whole = b.plan.literal, b.value_kind is Kind.INT64
        double = b.filter_kind is Kind.INT64 and isinstance(literal, float)
        add = (lambda x, y: wrap(x + y)) if whole else operator.add
        pairs = self.objects.filter(lambda r: op(float(r.f) if double else r.f, literal)).map(lambda r: (r.k, r.v)).reduceByKey(add)
        return b.named(self.spark.createDataFrame(pairs, f"k {SPARK[b.group_kind].simpleString()}, s {SPARK[b.value_kind].simpleString()}"))


def row_store(df: DataFrame, sql: str) -> RowStore:
    """A store for one query over ``df``, not built yet."""
    return RowStore(bind(df, parse(sql)))


def execute(df: DataFrame, plan: LogicalPlan, strategy: Strategy = Strategy.HASH) -> DataFrame:
    """The answer to a plan over ``df``; the plan's table name isn't looked up. Errors are raised here, not later."""
    b = bind(df, plan)
    if strategy is Strategy.HASH:
        return _hash(b)
    if strategy in (Strategy.SORT, Strategy.SORT_RADIX):
        return _sort(b, strategy is Strategy.SORT_RADIX)
    return _naive(b) if strategy is Strategy.NAIVE else RowStore(b).run()


def query(df: DataFrame, sql: str, strategy: Strategy = Strategy.HASH) -> DataFrame:
    """Parse and execute over ``df``."""
    return execute(df, parse(sql), strategy)


def query_catalog(spark: SparkSession, sql: str, strategy: Strategy = Strategy.HASH) -> DataFrame:
    """As query(), with the FROM name looked up in the session's catalog."""
    plan = parse(sql)
    return execute(spark.table(f"`{plan.table.replace('`', '``')}`"), plan, strategy)
