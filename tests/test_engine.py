import random

import pytest
from pyspark.sql import functions as F

from quern import errors, measure
from quern.functions.types import Kind
from quern.operators import primitives
from quern.operators.strategies import Strategy, buffered_rows, collected_pairs, query, query_catalog, reduced_runs, row_store, wrap
from quern.plans.parser import parse
from quern.plans.planner import bind
from quern.sources import generator
from quern.sources.shared import shared_folder
from quern.sources.tables import as_float64, as_int64, as_utf8, is_empty, kind, length, table

ALL = list(Strategy)


def got(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def sales(spark):
    return table(spark, {"region": ["north", "south", "north", "east", "north"], "amount": [10, -20, 30, 40, 50], "price": [1.5, 2.25, 3.0, 4.75, 5.5]}).cache()


GOLDEN = [
    ("SUM(amount)", "price > 2", {("east", 40), ("north", 80), ("south", -20)}), ("SUM(price)", "amount > 0", {("east", 4.75), ("north", 10.0)}), ("SUM(amount)", "region = 'north'", {("north", 90)}),
    ("SUM(amount)", "region > 'north'", {("south", -20)}), ("SUM(amount)", "region = 'west'", set()), ("SUM(amount)", "amount > 1000", set()), ("SUM(amount)", "amount > 25.5", {("east", 40), ("north", 80)}),
    ("SUM(amount)", "price < 3", {("north", 10), ("south", -20)}), ("SUM(amount)", "amount > 30", {("east", 40), ("north", 50)}), ("SUM(amount)", "amount < 30", {("north", 10), ("south", -20)}), ("SUM(amount)", "amount = 30", {("north", 30)}),
]


@pytest.mark.parametrize("strategy", ALL)
@pytest.mark.parametrize(("aggregate", "condition", "rows"), GOLDEN)
def test_golden(sales, aggregate, condition, rows, strategy):
    out = query(sales, f"SELECT region, {aggregate} FROM anything WHERE {condition} GROUP BY region", strategy)
    assert out.columns == ["region", aggregate]
    assert out.dtypes[1][1] == ("double" if "price" in aggregate else "bigint")
    assert got(out) == rows


@pytest.mark.parametrize("strategy", ALL)
def test_integer_sums_wrap(spark, strategy):
    big = table(spark, {"k": [1, 1], "v": [2**63 - 1, 1]})
    assert got(query(big, "SELECT k, SUM(v) FROM t WHERE k > 0 GROUP BY k", strategy)) == {(1, -(2**63))}
    assert wrap(2**63) == -(2**63)


@pytest.mark.parametrize("strategy", ALL)
def test_negative_keys_and_one_column_in_all_roles(spark, strategy):
    rows = table(spark, {"k": [-1, 2, -1, 2], "v": [10, 20, 30, 40]})
    assert got(query(rows, "SELECT k, SUM(v) FROM t WHERE v > 0 GROUP BY k", strategy)) == {(-1, 40), (2, 60)}
    assert got(query(rows, "SELECT k, SUM(k) FROM t WHERE k < 3 GROUP BY k", strategy)) == {(-1, -2), (2, 4)}


@pytest.mark.parametrize("strategy", ALL)
def test_integer_column_against_float_literal_widens(spark, strategy):
    rows = table(spark, {"k": [1], "v": [2**53 + 1]})
    assert got(query(rows, "SELECT k, SUM(v) FROM t WHERE v > 9007199254740992.5 GROUP BY k", strategy)) == set()
    assert got(query(rows, "SELECT k, SUM(v) FROM t WHERE v > 9007199254740992 GROUP BY k", strategy)) == {(1, 2**53 + 1)}


@pytest.mark.parametrize("strategy", ALL)
def test_nan_matches_nothing(spark, strategy):
    rows = table(spark, {"k": [1, 2], "v": [1, 1], "f": [float("nan"), 5.0]})
    for condition, keys in (("f > 1", {2}), ("f < 1", set()), ("f = 1", set())):
        assert {k for k, _ in got(query(rows, f"SELECT k, SUM(v) FROM t WHERE {condition} GROUP BY k", strategy))} == keys


def test_names_are_case_sensitive_whatever_the_session_says(spark):
    rows = spark.createDataFrame([(1, 2, 3)], "a long, A long, `x.y` long")
    assert got(query(rows, 'SELECT A, SUM("x.y") FROM t WHERE a > 0 GROUP BY A')) == {(2, 3)}


def refusal(group, value, column, literal):
    """What is wrong first with a query over sales: the group column, then the filter, then the value."""
    kinds = {"region": str, "amount": int, "price": float}
    for role, name in (("group", group), ("filter", column), ("value", value)):
        if name not in kinds:
            return errors.UnknownColumn, name
        wrong = {"group": kinds[name] is float, "filter": (kinds[name] is str) != isinstance(literal, str), "value": kinds[name] is str}[role]
        if wrong:
            return errors.QueryTypeError, name
    return None


@pytest.mark.parametrize("literal", [3, 2.5, "east"])
@pytest.mark.parametrize("group", ["region", "amount", "price", "Region"])
def test_every_strategy_refuses_alike(sales, group, literal):
    names = ["region", "amount", "price", "lost"]
    for value, column in ((v, c) for v in names for c in names):
        shown = f"'{literal}'" if isinstance(literal, str) else literal
        sql = f"SELECT {group}, SUM({value}) FROM t WHERE {column} < {shown} GROUP BY {group}"
        wrong = refusal(group, value, column, literal)
        if wrong is None:
            assert query(sales, sql).columns == [group, f"SUM({value})"]
            continue
        texts = set()
        for strategy in ALL:
            with pytest.raises(wrong[0], match=wrong[1]) as e:
                query(sales, sql, strategy)
            texts.add(str(e.value))
        assert len(texts) == 1


@pytest.mark.parametrize("rows", [0, 1, 2, 1025, 5000])
def test_parity(spark, rows):
    r = random.Random(rows)
    data = {"region": [f"r{r.randrange(7)}" for _ in range(rows)], "bucket": [r.randint(-3, 3) for _ in range(rows)], "amount": [r.randint(-1000, 999) for _ in range(rows)], "price": [r.randrange(100_000) / 100 - 500 for _ in range(rows)]}
    kinds = {"region": Kind.UTF8, "bucket": Kind.INT64, "amount": Kind.INT64, "price": Kind.FLOAT64}
    df = table(spark, data, kinds).cache()
    ops = {"=": lambda a, b: a == b, "<": lambda a, b: a < b, ">": lambda a, b: a > b}
    for key, value, test, op, literal in [("region", "amount", "price", ">", 0.0), ("bucket", "price", "amount", "<", 100), ("bucket", "bucket", "region", "=", "r3"), ("region", "price", "region", ">", "r2"), ("region", "amount", "amount", "=", 7)]:
        want: dict = {}
        for k, v, f in zip(data[key], data[value], data[test], strict=True):
            if ops[op](f, literal):
                want[k] = want.get(k, 0) + v
        shown = f"'{literal}'" if isinstance(literal, str) else literal
        for strategy in ALL:
            have = dict(got(query(df, f"SELECT {key}, SUM({value}) FROM t WHERE {test} {op} {shown} GROUP BY {key}", strategy)))
            assert have.keys() == want.keys()
            assert all(have[k] == pytest.approx(want[k], rel=1e-12, abs=1e-9) for k in want)


def test_plans(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s")).withColumn("unused", F.lit(1))
    plan = lambda s: query(df, "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region", s)._jdf.queryExecution().executedPlan().toString()
    text = plan(Strategy.HASH)
    assert "HashAggregate" in text and "partial_sum" in text and text.count("Exchange") == 1
    assert "GreaterThan(price,2.0)" in text and "unused" not in text.split("ReadSchema")[1]
    # a strategy is still itself where the result goes on: composed with others and planned anew
    for s, order in ((Strategy.SORT, "Sort [struct(k"), (Strategy.SORT_RADIX, "Sort [k#")):
        out = query(df, "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region", s)
        for again in (out, out.where("`SUM(amount)` > 0").withColumn("x", F.lit(1)), out.join(out.select(F.col("region").alias("r")), F.col("region") == F.col("r"))):
            text = again._jdf.queryExecution().executedPlan().toString()
            assert "MapInArrow" in text and order in text and "HashAggregate" not in text and "GreaterThan(price,2.0)" in text
        assert plan(s).count("Exchange") == 1
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def executed(spark, action):
    """The physical plans that an action ran. Spark forgets old ones, so they are told apart by their ids."""
    store = spark._jsparkSession.sharedState().statusStore()

    def known():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        rows = store.executionsList()
        return {rows.apply(i).executionId(): rows.apply(i).physicalPlanDescription() for i in range(rows.size())}

    before = max(known(), default=-1)
    action()
    return [p for i, p in known().items() if i > before]


def test_a_written_sort_is_a_sort(spark, sales, tmp_path):
    sales.write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    for s in (Strategy.SORT, Strategy.SORT_RADIX):
        out = query(df, "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region", s)
        plans = executed(spark, lambda out=out: measure.noop(out))
        assert plans and all("MapInArrow" in p and "Sort" in p and "HashAggregate" not in p for p in plans)


def test_runs_over_many_batches(spark):
    """A run that goes on over batches, null keys and null values, wrapping sums."""
    rows = [(None if i % 7 == 0 else f"k{i % 3}", None if i % 5 == 0 else 2**62) for i in range(3000)] + [("void", None)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        pairs = spark.createDataFrame(rows, "k string, v long").repartition(2, "k").sortWithinPartitions("k")
        got = {r.k: r.s for r in reduced_runs(pairs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want: dict = {}
    for k, v in rows:
        want[k] = want.get(k) if v is None else wrap((want.get(k) or 0) + v)
    assert got == want


def test_row_store_is_built_once(sales):
    store = row_store(sales, "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region")
    assert store.build() == 5 and store.objects.is_cached
    assert got(store.run()) == got(store.run()) == {("east", 40), ("north", 80), ("south", -20)}
    store.drop()
    assert not store.objects.is_cached


def test_phases(spark, sales):
    b = bind(sales, parse("SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region"))
    assert buffered_rows(b) == 4 and collected_pairs(b).count() == 4
    index = primitives.dictionary(b.filtered, "k", "k").withColumnRenamed("value", "k")
    assert got(primitives.scatter_accumulate(b.filtered, index)) == {(0, 40), (1, 80), (2, -20)}
    parts = measure.phases(sales, "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region", samples=1)
    assert parts["hash query"] > 0 and all(x >= 0 for x in parts.values())
    for whole in ("hash query", "sort query"):
        assert all(0 <= share < 1 and bound >= 1 for share, bound in measure.amdahl(parts, whole).values())


def test_kernels(spark, sales):
    q = "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region"
    with measure.kernel(spark, "interpreted"):
        assert measure.active_kernel(spark) == "interpreted"
        one = measure.checksum(query(sales, q))
    with measure.kernel(spark, "generated"):
        assert measure.active_kernel(spark) == "generated" and measure.checksum(query(sales, q)) == one


def test_checksums(spark):
    rows = [("a", 1, 0.1 + 0.2), (None, None, None), ("é", -5, 1e300)]
    df = spark.createDataFrame(rows, "k string, n long, x double")
    same = spark.createDataFrame([("é", -5, 1e300), ("a", 1, 0.3), (None, None, None)], df.schema).repartition(3)
    assert measure.checksum(df) == measure.checksum(same) != measure.checksum(df.where("n = 1"))
    assert measure.checksum(df) != measure.checksum(df.withColumn("n", F.col("n") + 1))


def test_canary(spark):
    assert measure.canary(lambda: generator.generate(spark, 2000, 8)) == measure.checksum(generator.generate(spark, 2000, 8, chunk=100))
    seeds = iter((1, 2))
    with pytest.raises(RuntimeError, match="second time"):
        measure.canary(lambda: spark.range(next(seeds)))


def test_catalog(spark, sales):
    sales.createOrReplaceTempView("sales")
    assert len(got(query_catalog(spark, "SELECT region, SUM(amount) FROM sales WHERE price > 2 GROUP BY region"))) == 3


def test_primitives(spark, sales):
    assert primitives.scan(sales, ["amount", "region", "amount"]).columns == ["amount", "region"]
    with pytest.raises(errors.UnknownColumn):
        primitives.scan(sales, ["nope"])
    over = F.col("amount") > 20
    assert primitives.count_ones(sales, over).first() == (3, 5)
    assert [r.mask for r in primitives.mask(sales, over).collect()] == [False, False, True, True, True]
    numbered = table(spark, {"n": list(range(130))})
    bits = primitives.packed_bitset(numbered, "n", F.col("n") < 70)
    assert bits.select(F.sum(F.bitmap_count("bits"))).first()[0] == 70
    assert len(primitives.ones(numbered, "n", F.col("n") < 70).collect()) == 70
    ordered = table(spark, {"r": ["north", "south", "north", "east"], "i": [0, 1, 2, 3]})
    assert got(primitives.dictionary(ordered, "r", "i")) == {("north", 0), ("south", 1), ("east", 2)}
    assert primitives.dense_sum(sales, "amount").first()[0] == 110
    assert primitives.dense_sum(sales.where("false"), "price").first()[0] == 0.0


def test_tables(spark, sales):
    with pytest.raises(errors.ColumnLengthMismatch):
        table(spark, {"a": [1], "b": [1, 2]})
    assert [kind(sales, c) for c in sales.columns] == [Kind.UTF8, Kind.INT64, Kind.FLOAT64]
    with pytest.raises(errors.UnknownColumn):
        kind(sales, "x")
    assert [x[0] for x in as_int64(sales, "amount").collect()] == [10, -20, 30, 40, 50] and as_int64(sales, "price") is None
    assert as_float64(sales, "price").count() == 5 and as_float64(sales, "amount") is None
    assert as_utf8(sales, "region").first()[0] == "north" and as_utf8(sales, "amount") is None
    with pytest.raises(errors.UnknownColumn):
        as_utf8(sales, "x")
    assert length(sales) == 5 and not is_empty(sales) and is_empty(sales.where("false"))


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Context:
        master, getConf, getCheckpointDir = "spark://host:7077", spark.sparkContext.getConf, staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    monkeypatch.setattr(Context, "getConf", lambda: {}, raising=False)
    with pytest.raises(ValueError, match="share"):
        shared_folder(Session)


def sequential(seed, n):
    x, out = seed or generator.ZERO_SEED, []
    for _ in range(n):
        x ^= x >> 12
        x ^= x << 25 & (1 << 64) - 1
        x ^= x >> 27
        out.append(x * generator.MULTIPLIER & (1 << 64) - 1)
    return out


@pytest.mark.parametrize(("seed", "first", "count"), [(1, 0, 5), (0, 7, 20), (generator.SEED, 5000, 9000)])
def test_generator_jumps(seed, first, count):
    assert generator.draws(seed, first, count).tolist() == sequential(seed, first + count)[first:]


def test_generator_is_one_stream(spark):
    d = sequential(generator.SEED, 3000)
    want = [(f"r{d[3 * i] % 8}", d[3 * i] % 8, d[3 * i + 1] % 1_000_000, d[3 * i + 2] % 100_000 / 100 - 500) for i in range(1000)]
    for chunk in (64, 1 << 17):
        assert sorted(tuple(r) for r in generator.generate(spark, 1000, 8, chunk=chunk).collect()) == sorted(want)
    assert generator.amount_threshold(0.1) == 900_000
    with pytest.raises(ValueError):
        generator.amount_threshold(2)


def test_measure(sales, tmp_path):
    q = "SELECT region, SUM(amount) FROM t WHERE price > 2 GROUP BY region"
    a, b = measure.alternate([measure.Arm(s.value, lambda s=s: measure.checksum(query(sales, q, s))) for s in (Strategy.HASH, Strategy.SORT)], samples=2)
    assert a.checksum == b.checksum and len(a.seconds) == 2 and a.min <= a.median <= a.max
    assert "hash" in measure.report([a, b])
    measure.write_csv(str(tmp_path / "x.csv"), [a, b])
    assert len((tmp_path / "x.csv").read_text().splitlines()) == 5
    n = iter(range(9))
    with pytest.raises(RuntimeError):
        measure.alternate([measure.Arm("odd", lambda: next(n))], samples=2)
    assert "spark" in measure.environment(sales.sparkSession)
