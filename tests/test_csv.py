import pytest

from quern import errors
from quern.functions.types import Kind
from quern.operators.strategies import query
from quern.sources.csv import infer_schema, read_csv

I, D, S = Kind.INT64, Kind.FLOAT64, Kind.UTF8


@pytest.fixture
def put(tmp_path):
    def write(text):
        p = tmp_path / "x.csv"
        p.write_text(text, encoding="utf-8", newline="")
        return str(p)

    return write


@pytest.mark.parametrize(
    ("text", "kinds", "rows"),
    [
        ("a\n1\n2\n3.5\n", [D], [(1.0,), (2.0,), (3.5,)]), ("a\n1\n2\nN/A\n", [S], [("1",), ("2",), ("N/A",)]), ("a,b\n1,x\n,y\n3,z\n", [S, S], [("1", "x"), ("", "y"), ("3", "z")]), ("a\n1\n\n3\n", [I], [(1,), (3,)]),
        ("a\n1.5\ninf\n", [S], [("1.5",), ("inf",)]), ("a\n1.5\nNaN\n", [S], [("1.5",), ("NaN",)]), ("a,b\n 1 , 2.5 \n", [I, D], [(1, 2.5)]), ("a\n x \ny\n", [S], [(" x ",), ("y",)]), ("a,b\n", [S, S], []),
        ("a\n1d\n2\n", [S], [("1d",), ("2",)]), ("a\n1e400\n", [S], [("1e400",)]), ("a\n9223372036854775808\n", [D], [(9223372036854775808.0,)]), ("a\n+5\n-6\n", [I], [(5,), (-6,)]), ("a\n.5\n1.\n", [D], [(0.5,), (1.0,)]),
        ('a,b\n"x,1","say ""hi"""\n', [S, S], [("x,1", 'say "hi"')]), ('a,b\n"two\nlines",2\n', [S, I], [("two\nlines", 2)]), ("A,a\n1,x\n", [I, S], [(1, "x")]), ("a.b\n1\n", [I], [(1,)]),
    ],
)
def test_inference(spark, put, text, kinds, rows):
    path = put(text)
    assert list(infer_schema(spark, path).values()) == kinds
    assert [tuple(r) for r in read_csv(spark, path).collect()] == rows


def test_duplicate_header(spark, put):
    with pytest.raises(errors.DuplicateColumn, match='"a"'):
        read_csv(spark, put("a,a\n1,2\n"))


@pytest.mark.parametrize("schema", [None, {"a": I}, {}])
@pytest.mark.parametrize("text", ["a,b\n1,2\n3\n", "a,b\n1,2\n3,4,5\n"])
def test_ragged(spark, put, text, schema):
    with pytest.raises(errors.CsvError):
        read_csv(spark, put(text), schema)


@pytest.mark.parametrize("text", ["a\n1\noops\n", "a\n1\n\n\noops\n"])
def test_bad_value(spark, put, text):
    with pytest.raises(errors.ParseError) as e:
        read_csv(spark, put(text), {"a": I})
    assert (e.value.column, e.value.line, e.value.value, e.value.expected) == ("a", 3, "oops", "Int64")


def test_partial_schema_and_empty_table(spark, put):
    assert [t for _, t in read_csv(spark, put("a,b\n1,2\n"), {"b": I}).dtypes] == ["string", "bigint"]
    empty = read_csv(spark, put("region,amount\n"), {"amount": I})
    out = query(empty, "SELECT region, SUM(amount) FROM t WHERE amount > 1 GROUP BY region")
    assert out.collect() == [] and out.columns == ["region", "SUM(amount)"]
    with pytest.raises(errors.QueryTypeError):
        query(read_csv(spark, put("region,amount\n")), "SELECT region, SUM(amount) FROM t WHERE region = 'x' GROUP BY region")


def test_missing_file(spark):
    with pytest.raises(errors.IoError):
        read_csv(spark, "/nowhere/x.csv")
