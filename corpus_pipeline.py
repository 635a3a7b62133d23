"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again.

ORACLE_SQL is None: language ID and mixing are learnt and the fingerprints need XXH64, which SQL can't
express. tests/llm compares each stage with a brute-force version, and the final rows of run() with the known
truth of made documents (toxic ones and copies go).

Defined results, for every stage: a null text is an empty one; it has no letters, so the language stage drops it,
and each later stage alone takes it. Rows are told apart by their place in the table they are read from, so
null and repeated ids and repeated rows are rows like others: of repeated rows one stays (exact dedup). Ties: of
equal texts the largest id stays, of near copies the smallest, a null id only where there is no other, and of
equal ids the first by place. Texts are read whole, of any length. An empty table gives an empty one. Columns of
any name go through unchanged, also names that the stages or Spark use themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import bpe, exact_dedup, language_id, mixing, simhash
from quern.llm.queries import vocabulary
from quern.llm.storage import write_table


def unused(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """These names, changed where ``docs`` has columns of theirs."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return tuple(out)


def placed(docs: DataFrame) -> tuple[DataFrame, tuple[str, str]]:
    """Documents with their places, and the names of those columns: they tell rows apart whatever their ids.

    ``docs`` is read from Parquet files, which give a row the same place every time.
    """
    at = docs.metadataColumn("_metadata")
    file, row = unused(docs, "quern_at_file", "quern_at_row")
    return docs.withColumn(file, at["file_path"]).withColumn(row, at["row_index"]), (file, row)


def own(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``docs`` only."""
    return rows.select(*(F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told stay; those without a letter (und) go. All stay where there is nothing to learn from."""
    prototypes = language_id.fit(docs.where(~language_id.held_out("doc_id")))
    if not prototypes:
        return docs
    lang, score = unused(docs, "quern_lang", "quern_score")
    told = language_id.predict(docs, prototypes, names=(lang, score))
    return own(told.where(F.col(lang) != language_id.UNDETERMINED), docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    rows, place = placed(docs)
    kept = exact_dedup.exact_dedup(rows, keep="largest", carry=place).where("kept").select(*place)
    return own(rows.join(kept, [*place], "left_semi"), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that a Jaccard similarity of 0.8 or more of five-word shingles links the document with the smallest id stays.

    Self-joins of binary tries of SimHash fingerprints propose the links.
    """
    rows, place = placed(docs)
    groups = simhash.near_copies(rows, place, shingle=5, similarity=0.8).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *place)).alias("x"))
    return own(rows.join(groups.select(*(f"x.{c}" for c in place)), [*place], "left_semi"), docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Targets: no expected tokens of the toxic domain, all of the others. A document stays once if its rate is a half or more; clean ones have a rate of 1."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, place = placed(docs)
    rates = mixing.mix_to_targets(rows, labels, {"high": 1.0, "low": 1.0, "toxic": 0.0}, relative=True, most=1.0, keep=place)
    return own(rows.join(rates.where("rate >= 0.5").select(*place), [*place], "left_semi"), docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and what they decode to, as digests."""
    return bpe.digests(bpe.encode(docs, *vocabulary()))


STAGES = [("language ID", language), ("exact dedup", exact), ("SimHash near-dedup", near), ("mixing to target weights", mixed), ("byte-level BPE", tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return write_table(STAGES[-1][1](spark, docs, sf_dir), "tokens")
