"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line, seconds as the minimum of alternated rounds.

Only the query is timed: tables are read into memory before, and queries are parsed, checked and bound before. The
JSON also has ``scaled``: the strategies over generated tables where the work exceeds the cost of a job, and
``phases`` of the group-bys there. BENCH_SCALE sets those rows (0: none).

BENCH_SWEEP=1 runs the full sweep to stderr: row counts, selectivities, cardinalities, both keys, kernels, and the
same arm twice as a control.
"""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from quern.catalogue import CORES, QUERIES, table
from quern.measure import KERNELS, Arm, alternate, amdahl, canary, checksum, environment, kernel, noop, phases, report
from quern.operators.strategies import Strategy, query, row_store
from quern.sources.generator import amount_threshold, generate

HEADLINE = ["sum_int_by_str_gt", "sum_float_by_str_gt", "sum_int_by_int", "sum_float_by_int", "int_col_vs_float_lit", "str_eq", "str_gt", "match_nothing", "match_everything", "high_cardinality", "unique_keys", "agg_sort", "agg_sort_radix", "filter_mask_popcount", "dense_sum_int", "dense_sum_float", "dict_encode_first_seen", "sum_int_wrapping"]
ROWS, SELECTIVITY, CARDINALITY = (250_000, 1_000_000, 2_000_000, 4_000_000, 8_000_000), (0.0, 0.01, 0.1, 0.5, 0.9, 1.0), (8, 128, 2048, 32_768, 250_000)


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.ui.retainedExecutions", "10").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def loaded(df: DataFrame) -> DataFrame:
    """In memory, in Spark's columnar form."""
    df.persist().count()
    return df


def sql(key: str, value: str, fraction: float) -> str:
    return f"SELECT {key}, SUM({value}) FROM t WHERE amount > {amount_threshold(fraction)} GROUP BY {key}"


def point(spark: SparkSession, rows: int, cardinality: int, fraction: float, strategies: list[Strategy], key: str = "region", samples: int = 3) -> dict[str, float]:
    """Seconds by strategy over one generated table."""
    df = loaded(generate(spark, rows, cardinality))
    built = {s.value: query(df, sql(key, "amount", fraction), s) for s in strategies}
    out = {m.name: round(m.min, 4) for m in alternate([Arm(n, lambda q=q: noop(q)) for n, q in built.items()], samples)}
    df.unpersist()
    return out


def sweep(spark: SparkSession) -> None:
    say = lambda *x: print(*x, file=sys.stderr, flush=True)
    say(environment(spark))
    say("generated table", canary(lambda: generate(spark, 1_000_000, 128)))
    arms = [Strategy.HASH, Strategy.SORT, Strategy.SORT_RADIX, Strategy.NAIVE]
    for rows in ROWS:
        say("rows", rows, point(spark, rows, 128, 0.5, arms))
    for fraction in SELECTIVITY:
        say("selectivity", fraction, point(spark, 1_000_000, 128, fraction, arms))
    for cardinality in CARDINALITY:
        for key in ("region", "bucket"):
            say("cardinality", cardinality, key, point(spark, 1_000_000, cardinality, 0.5, arms[:3], key))
    df = loaded(generate(spark, 1_000_000, 128))
    store = row_store(df, sql("region", "amount", 0.5))
    say("row store of", store.build(), "rows, then queried:", round(alternate([Arm("rows", lambda: noop(store.run()))], 3)[0].min, 4))
    store.drop()
    q = query(df, sql("region", "amount", 0.5))
    say("the same arm twice\n" + report(alternate([Arm(n, lambda: checksum(q)) for n in ("hash", "hash again")], 5)))
    for name in KERNELS:
        with kernel(spark, name):
            again = query(df, sql("region", "amount", 0.5))
            say("kernel", name, round(alternate([Arm(name, lambda again=again: noop(again))], 3)[0].min, 4))
    for cardinality in (128, 250_000):
        parts = phases(loaded(generate(spark, 1_000_000, cardinality)), sql("region", "amount", 0.5))
        for whole in ("hash query", "sort query"):
            say("Amdahl", cardinality, whole, round(parts[whole], 4), {p: f"{100 * s:.1f} %, at most {b:.3f} x" for p, (s, b) in amdahl(parts, whole).items()})


def main() -> None:
    spark = session()
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    for name in dict.fromkeys(["lineitem", "part", "orders", "events", *(c[0] for c in CORES.values())]):
        loaded(table(spark, folder, name))
    built = {n: QUERIES[n](spark, folder) for n in HEADLINE}
    seconds = {m.name: round(m.min, 4) for m in alternate([Arm(n, lambda q=q: noop(q)) for n, q in built.items()], samples=5, warmup=2)}
    spark.catalog.clearCache()
    scale = int(os.environ.get("BENCH_SCALE", "8000000"))
    scaled = {f"{cardinality} keys": point(spark, scale, cardinality, 0.5, [Strategy.HASH, Strategy.SORT_RADIX]) for cardinality in (128, 250_000)} if scale else {}
    if os.environ.get("BENCH_SWEEP"):
        sweep(spark)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "scaled": scaled, "scaled_rows": scale}))


if __name__ == "__main__":
    main()
