"""Strict CSV: every record has the header's fields, types hold for the whole file, an empty field is the empty string.

Everything is read as strings by Spark's reader and typed by this module's rules. Inference is one
aggregation over the file; loading with an explicit schema runs one check, so a bad value is an error of
the loader and not of a later query. With ``multi_line`` (the default) quoted fields may hold line breaks
and a file is one task; without it large files split, and errors carry no line.
"""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import CsvError, DuplicateColumn, IoError, ParseError, QuernError
from quern.functions.expressions import parse_float, parse_int
from quern.functions.types import Kind

Schema = dict[str, Kind]
#: Errors of Spark's reader come as either.
FAILURES = (PySparkException, Py4JJavaError)
PARSERS = {Kind.INT64: parse_int, Kind.FLOAT64: parse_float}


def _translate(e: Exception) -> QuernError:
    text = str(e)
    if "PATH_NOT_FOUND" in text or "FileNotFound" in text or "does not exist" in text:
        return IoError(text.splitlines()[0])
    lines = [x for x in text.splitlines() if "MALFORMED" in x] or text.splitlines()
    return CsvError(f"csv error: {lines[-1].strip()}")


def _reader(spark: SparkSession, multi_line: bool):
    return spark.read.options(quote='"', escape='"', multiLine=str(multi_line).lower(), mode="FAILFAST", nullValue="\0", emptyValue="", ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false", maxColumns="100000")


def header(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    """Column names; a name that occurs twice is an error."""
    try:
        row = _reader(spark, multi_line).csv(path, header=False, inferSchema=False).first()
    except FAILURES as e:
        raise _translate(e) from e
    if row is None:
        return []
    names = ["" if x is None else x for x in row]
    for i, n in enumerate(names):
        if n in names[:i]:
            raise DuplicateColumn(n)
    return names


def _strings(spark: SparkSession, path: str, n: int, multi_line: bool) -> DataFrame:
    """All records as strings c0, c1, ... and their line."""
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(n)])
    rows = _reader(spark, multi_line).schema(schema).csv(path, header=True, enforceSchema=True)
    return rows.select(*(F.coalesce(f"c{i}", F.lit("")).alias(f"c{i}") for i in range(n)), (F.monotonically_increasing_id() + 2).alias("line"))


def infer_schema(spark: SparkSession, path: str, multi_line: bool = True) -> Schema:
    """Int64 if every value of the file is an integer, else Float64 if every one is a finite number, else Utf8; Utf8 without rows."""
    names = header(spark, path, multi_line)
    if not names:
        return {}
    rows = _strings(spark, path, len(names), multi_line)
    tests = [F.bool_and(parse(F.col(f"c{i}")).isNotNull()).alias(f"{k}{i}") for i in range(len(names)) for k, parse in (("i", parse_int), ("f", parse_float))]
    try:
        got = rows.agg(F.count("*").alias("n"), *tests).first()
    except FAILURES as e:
        raise _translate(e) from e
    return {name: Kind.UTF8 if not got.n else Kind.INT64 if got[f"i{i}"] else Kind.FLOAT64 if got[f"f{i}"] else Kind.UTF8 for i, name in enumerate(names)}


def read_csv(spark: SparkSession, path: str, schema: Schema | None = None, multi_line: bool = True) -> DataFrame:
    """A typed DataFrame. schema: kinds by name, columns it doesn't mention are Utf8; None: inferred from the whole file."""
    explicit = schema is not None
    kinds = infer_schema(spark, path, multi_line) if schema is None else schema
    names = header(spark, path, multi_line)
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    rows = _strings(spark, path, len(names), multi_line)
    typed = [(i, n, kinds.get(n, Kind.UTF8)) for i, n in enumerate(names)]
    if explicit:
        bad = [F.when(PARSERS[k](F.col(f"c{i}")).isNull(), F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("value"))) for i, _, k in typed if k in PARSERS]
        first = F.min(F.struct("line", F.coalesce(*bad).alias("x"))) if bad else F.lit(None)
        try:
            # without typed columns this still reads every record, so ragged ones are found
            found = (rows.where(F.coalesce(*bad).isNotNull()) if bad else rows).agg(first.alias("bad"), F.count("*").alias("n")).first()
        except FAILURES as e:
            raise _translate(e) from e
        if bad and found.bad is not None:
            _, name, kind = typed[found.bad.x.i]
            raise ParseError(name, found.bad.line if multi_line else None, found.bad.x.value, kind.value)
    return rows.select(*((PARSERS[k](F.col(f"c{i}")) if k in PARSERS else F.col(f"c{i}")).alias(n) for i, n, k in typed))
