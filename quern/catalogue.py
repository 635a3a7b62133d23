"""Named queries over the test tables, and SQL that must agree with them.

Double sums are compared rounded: their last bits depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.expressions import predicate
from quern.functions.types import Kind
from quern.operators import primitives
from quern.operators.strategies import Strategy, buffered_rows, collected_pairs, query, reduced_runs, sorted_pairs
from quern.plans.parser import parse
from quern.plans.planner import bind
from quern.sources.csv import read_csv
from quern.sources.shared import shared_folder

Query = Callable[[SparkSession, str], DataFrame]

#: name: table, key, summed column, filter
CORES = {
    "sum_int_by_str_gt": ("lineitem", "l_returnflag", "l_partkey", "l_quantity > 25"),
    "sum_float_by_str_gt": ("lineitem", "l_returnflag", "l_extendedprice", "l_quantity > 25"),
    "sum_int_by_str_lt": ("lineitem", "l_returnflag", "l_partkey", "l_quantity < 10"),
    "sum_int_by_str_eq": ("lineitem", "l_returnflag", "l_partkey", "l_linenumber = 3"),
    "sum_int_by_int": ("lineitem", "l_suppkey", "l_partkey", "l_partkey < 1000"),
    "sum_float_by_int": ("lineitem", "l_suppkey", "l_extendedprice", "l_partkey < 1000"),
    "filter_on_group_key": ("lineitem", "l_linenumber", "l_partkey", "l_linenumber > 3"),
    "filter_on_sum_col": ("lineitem", "l_returnflag", "l_partkey", "l_partkey > 1000"),
    "group_and_sum_same_col": ("lineitem", "l_linenumber", "l_linenumber", "l_quantity > 25"),
    "int_col_vs_float_lit": ("lineitem", "l_returnflag", "l_partkey", "l_partkey > 1000.5"),
    "float_col_vs_int_lit": ("lineitem", "l_returnflag", "l_partkey", "l_quantity < 3"),
    "str_eq": ("part", "p_type", "p_size", "p_type = 'PROMO'"),
    "str_gt": ("part", "p_type", "p_size", "p_type > 'MEDIUM'"),
    "str_lt": ("part", "p_type", "p_size", "p_type < 'MEDIUM'"),
    "str_eq_absent": ("part", "p_type", "p_size", "p_type = 'NOPE'"),
    "match_nothing": ("lineitem", "l_returnflag", "l_partkey", "l_partkey > 100000000"),
    "match_everything": ("lineitem", "l_returnflag", "l_partkey", "l_partkey > -1"),
    "high_cardinality": ("lineitem", "l_orderkey", "l_partkey", "l_quantity > 25"),
    "unique_keys": ("orders", "o_orderkey", "o_custkey", "o_custkey > 10"),
    "single_group": ("events", "event_type", "user_id", "event_type = 'click'"),
}
STRATEGIES = {"agg_sort": Strategy.SORT, "agg_sort_radix": Strategy.SORT_RADIX, "agg_naive_rows": Strategy.NAIVE, "agg_row_store": Strategy.ROWS}
FLOAT_SUMS = ("l_extendedprice",)
INT_KEYS = ("l_linenumber",)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sql_of(core: tuple[str, str, str, str]) -> str:
    source, key, value, condition = core
    return f"SELECT {key}, SUM({value}) FROM {source} WHERE {condition} GROUP BY {key}"


def run(core: tuple[str, str, str, str], strategy: Strategy, spark: SparkSession, folder: str) -> DataFrame:
    out = query(table(spark, folder, core[0]), sql_of(core), strategy)
    name = f"SUM({core[2]})"
    return out.withColumn(name, F.round(F.col(f"`{name}`"), 2)) if core[2] in FLOAT_SUMS else out


def oracle(core: tuple[str, str, str, str]) -> str:
    source, key, value, condition = core
    shown = f"CAST({key} AS BIGINT) AS {key}" if key in INT_KEYS else key
    total = f"round(SUM({value}), 2)" if value in FLOAT_SUMS else f"CAST(SUM({value}) AS BIGINT)"
    return f'SELECT {shown}, {total} AS "SUM({value})" FROM {source} WHERE {condition} GROUP BY {key}'


def _line(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem")


def _passes():
    return predicate(F.col("l_quantity"), Kind.FLOAT64, ">", 25)


def _wrapping(spark: SparkSession, folder: str) -> DataFrame:
    rows = _line(spark, folder).select("l_returnflag", (F.col("l_partkey") % 20_000 * 400_000_000_000_000).alias("v"), "l_quantity")
    return query(rows, "SELECT l_returnflag, SUM(v) FROM t WHERE l_quantity > 25 GROUP BY l_returnflag")


def _codes(spark: SparkSession, folder: str) -> DataFrame:
    return primitives.dictionary(table(spark, folder, "events"), "event_type", "event_id").withColumn("code", F.col("code").cast("long"))


def _bits(spark: SparkSession, folder: str) -> DataFrame:
    rows = primitives.packed_bitset(table(spark, folder, "events"), "event_id", predicate(F.col("event_type"), Kind.UTF8, "=", "click"))
    return rows.select("bucket", F.bitmap_count("bits").alias("ones"))


def _csv(spark: SparkSession, folder: str) -> DataFrame:
    """nation as CSV text in a folder that all machines share, loaded with inference, and queried."""
    path = f"{shared_folder(spark)}/quern-csv/{spark.sparkContext.applicationId}"
    table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1).write.mode("overwrite").csv(path, header=True)
    return query(read_csv(spark, path), "SELECT n_regionkey, SUM(n_nationkey) FROM nation WHERE n_name > 'B' GROUP BY n_regionkey")


def _index(spark: SparkSession, folder: str) -> DataFrame:
    b = bind(_line(spark, folder), parse(sql_of(CORES["high_cardinality"])))
    return primitives.group_index(b.filtered).withColumnRenamed("k", "l_orderkey")


def _bound(spark: SparkSession, folder: str, name: str = "high_cardinality"):
    return bind(_line(spark, folder), parse(sql_of(CORES[name])))


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("k").alias("l_orderkey"), F.col("v").alias("l_partkey"))


def _buffered(spark: SparkSession, folder: str) -> DataFrame:
    return spark.range(1).select(F.lit(buffered_rows(_bound(spark, folder))).cast("long").alias("rows"))


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    return reduced_runs(sorted_pairs(_bound(spark, folder), True)).select(F.col("k").alias("l_orderkey"), F.col("s").alias("SUM(l_partkey)"))


def _scatter(spark: SparkSession, folder: str) -> DataFrame:
    rows = _bound(spark, folder, "sum_int_by_str_gt").filtered
    index = primitives.dictionary(rows, "k", "k").withColumnRenamed("value", "k")
    return primitives.scatter_accumulate(rows, index).select(F.col("code").cast("long").alias("code"), F.col("s").alias("SUM(l_partkey)"))


QUERIES: dict[str, Query] = {
    **{name: partial(run, core, Strategy.HASH) for name, core in CORES.items()},
    **{name: partial(run, CORES["sum_int_by_str_gt"], strategy) for name, strategy in STRATEGIES.items()},
    "scan_project": lambda s, d: primitives.project(primitives.scan(_line(s, d), ["l_orderkey", "l_quantity", "l_partkey"]), ["l_orderkey", "l_partkey"]),
    "filter_compact": lambda s, d: primitives.filter_rows(_line(s, d), _passes(), ["l_orderkey", "l_partkey"]),
    "filter_mask": lambda s, d: primitives.mask(_line(s, d).select("l_orderkey", "l_linenumber", "l_quantity"), _passes()).select("l_orderkey", "l_linenumber", "mask"),
    "filter_mask_popcount": lambda s, d: primitives.count_ones(_line(s, d), _passes()),
    "bitset_packed": _bits,
    "bitset_ones": lambda s, d: primitives.ones(table(s, d, "events"), "event_id", predicate(F.col("event_type"), Kind.UTF8, "=", "click")),
    "dense_sum_int": lambda s, d: primitives.dense_sum(_line(s, d), "l_partkey"),
    "dense_sum_float": lambda s, d: primitives.dense_sum(_line(s, d), "l_extendedprice").withColumn("sum", F.round("sum", 2)),
    "group_index_phase": _index,
    "collect_pairs_phase": lambda s, d: _named(collected_pairs(_bound(s, d))),
    "sort_pairs_phase": lambda s, d: _named(sorted_pairs(_bound(s, d), True)),
    "reduce_runs_phase": _runs,
    "scatter_accumulate_phase": _scatter,
    "buffered_rows": _buffered,
    "dict_encode_first_seen": _codes,
    "sum_int_wrapping": _wrapping,
    "csv_roundtrip_query": _csv,
}

ORACLE_SQL: dict[str, str] = {
    **{name: oracle(core) for name, core in CORES.items()},
    **{name: oracle(CORES["sum_int_by_str_gt"]) for name in STRATEGIES},
    "scan_project": "SELECT l_orderkey, l_partkey FROM lineitem",
    "filter_compact": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25",
    "filter_mask": "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS mask FROM lineitem",
    "filter_mask_popcount": "SELECT count(*) FILTER (WHERE l_quantity > 25) AS ones, count(*) AS size FROM lineitem",
    "bitset_packed": "SELECT event_id // 32768 + 1 AS bucket, count(*) AS ones FROM events WHERE event_type = 'click' GROUP BY 1",
    "bitset_ones": "SELECT event_id FROM events WHERE event_type = 'click'",
    "dense_sum_int": "SELECT CAST(SUM(l_partkey) AS BIGINT) AS sum FROM lineitem",
    "dense_sum_float": "SELECT round(SUM(l_extendedprice), 2) AS sum FROM lineitem",
    "group_index_phase": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25",
    "collect_pairs_phase": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25",
    "sort_pairs_phase": "SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25",
    "reduce_runs_phase": oracle(CORES["high_cardinality"]),
    "scatter_accumulate_phase": """SELECT row_number() OVER (ORDER BY l_returnflag) - 1 AS code, CAST(SUM(l_partkey) AS BIGINT) AS "SUM(l_partkey)" FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag""",
    "buffered_rows": "SELECT count(*) AS rows FROM lineitem WHERE l_quantity > 25",
    "dict_encode_first_seen": "SELECT event_type AS value, row_number() OVER (ORDER BY min(event_id), event_type) - 1 AS code FROM events GROUP BY event_type",
    "sum_int_wrapping": """SELECT l_returnflag, CAST(CASE WHEN m >= 9223372036854775808 THEN m - 18446744073709551616 ELSE m END AS BIGINT) AS "SUM(v)" FROM (
        SELECT l_returnflag, SUM(CAST(l_partkey % 20000 AS HUGEINT) * 400000000000000) % 18446744073709551616 AS m FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag)""",
    "csv_roundtrip_query": 'SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(SUM(n_nationkey) AS BIGINT) AS "SUM(n_nationkey)" FROM nation WHERE n_name > \'B\' GROUP BY n_regionkey',
}
