"""Intermediate tables in the folder that a cluster's machines share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.shared import shared_folder


def write_table(df: DataFrame, name: str, by: str | None = None, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: its lineage ends here.

    A lost executor takes nothing with it that a later step needs. The shuffle files of the finished
    step have no reader any more; the collection lets Spark's cleaner remove them. by: a column that the
    files are parted by, so that drop_table() can delete one part.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quern-tables/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    spark.sparkContext._jvm.System.gc()
    return out


def drop_table(df: DataFrame, part: str = "") -> None:
    """Delete a table of write_table(), or one part (column=value) of it, once nothing reads it."""
    path = getattr(df, "_quern_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/{part}" if part else path)
        p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def apart(df: DataFrame, *keys: str) -> DataFrame:
    """``df``, which an aggregation has just dealt out by ``keys``, for a join with a side that may be skewed.

    The keys are made anew (x ^ 0), so the planner doesn't reuse the aggregation's partitioning and both
    sides of the join get a shuffle of their own; only such a join can be split by adaptive execution.
    The additional shuffle has one row per key.
    """
    return df.withColumns({k: F.col(k).bitwiseXOR(F.lit(0).cast("long")) for k in keys})
