"""Exact dedup as a log-structured merge index, in DataFrame operations only.

Texts are equal if they are equal after lower-casing A-Z. One pass over the texts makes their digests. Rows
arrive in memtables, which flush in one job as runs of (digest, rank, rows) entries sorted by digest; each run
has a Bloom filter of its digests. Compaction looks an entry up in the other runs' filters: one that none of
them may hold goes straight into the compacted run, and only the others are merged, where the smallest rank of a
digest stays. A rank is the id, or its bitwise complement where the largest id is to stay, so "smallest
identifier" serves both.

A digest alone proves nothing: hits receive byte verification. The digests of more than one row, and the quick
hashes of their texts, make two more filters. The texts are read a second time through the quick one, so only
texts that may be hits get a second digest, move, join the hits and are compared with the text of the row that
stays. Rows that the digest filter rules out are their own answer without a join. Where a digest's rows differ
in their quick hash or in a byte, they are regrouped by the whole SHA-256, a second hash and the length. The
digest groups combine before the shuffle, and joins have one row per digest on one side, so Spark may split the
other: a third of all rows may be one text.

Filters are sized by what they hold (8 bits each, two set) up to ``MOST_WORDS`` 64-bit words, 2 MB, the bound of
what is broadcast. Beyond some millions of entries they pass more, then all rows; the merge and the joins then do
the same work without their help, and no result changes.

Defined results: null text: as empty. Null ids: lose to any id; if all are null, one row is kept by
position. Repeated ids with one text: one row stays. One result row per input row; empty table: empty. Texts of
any length are digested whole. Extra columns are ignored, whatever their names, except those of ``carry``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_WORDS = 1 << 18


def normalised(text: Column) -> Column:
    """Text with A-Z in lower case (null: empty). lower() does the same where all characters are ASCII, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def filter_words(entries: int) -> int:
    """64-bit words of a filter for so many entries: a power of two, 8 bits an entry, MOST_WORDS at most."""
    return min(MOST_WORDS, 1 << max(6, (entries // 8).bit_length()))


def bits_of(value: Column, words: int) -> list[Column]:
    """The two bits of a value."""
    return [F.pmod(h, F.lit(words * 64)) for h in (F.xxhash64(value), F.xxhash64(F.lit(7), value))]


def bloom(values: DataFrame, words: int) -> DataFrame:
    """One row (bits: that many longs): a Bloom filter of the only column."""
    each = values.select(F.explode(F.array(*bits_of(F.col(values.columns[0]), words))).alias("p"))
    set_bits = each.groupBy((F.col("p") / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("b"))
    every = values.sparkSession.range(words).select(F.col("id").cast("int").alias("w")).join(set_bits, "w", "left")
    return every.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0).cast("long")).alias("b")))), lambda x: x["b"]).alias("bits"))


def may_hold(filter_row: DataFrame, value: Column, words: int) -> Column:
    """Whether the filter's set may hold the value."""
    found = [F.call_function("shiftright", F.element_at(filter_row.scalar(), (p / 64).cast("int") + 1), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1 for p in bits_of(value, words)]
    return found[0] & found[1]


def flush(rows: DataFrame, memtables: int) -> DataFrame:
    """Rows (digest, quick, rank, place) to one sorted run per memtable: entries (run, digest, least, rows, lo, hi)."""
    entries = rows.withColumn("run", F.pmod(F.hash("place"), F.lit(memtables))).groupBy("run", "digest").agg(
        F.min(F.struct(F.col("rank").isNull().alias("none"), "rank", "place")).alias("least"), F.count("*").alias("rows"), F.min("quick").alias("lo"), F.max("quick").alias("hi")
    )
    return write_table(entries.sortWithinPartitions("run", "digest"), "runs", by="run")


def run_filters(runs: DataFrame, memtables: int, words: int) -> list[DataFrame]:
    """A filter of each run's digests."""
    return [write_table(bloom(runs.where(F.col("run") == i).select("digest"), words), "filters") for i in range(memtables)]


def elsewhere(filters: list[DataFrame], words: int) -> Column:
    """Whether another run than the entry's own may hold its digest."""
    held = [may_hold(f, F.col("digest"), words) for f in filters]
    out = F.lit(False)
    for i in range(len(filters)):
        others = F.lit(False)
        for j, h in enumerate(held):
            others = others | h if j != i else others
        out = F.when(F.col("run") == i, others).otherwise(out)
    return out


def compact(runs: DataFrame, filters: list[DataFrame], words: int) -> DataFrame:
    """Runs to one run: the smallest rank of each digest, and its rows. Only entries that another run may hold are merged."""
    marked = runs.withColumn("meets", elsewhere(filters, words))
    alone = marked.where(~F.col("meets")).select("digest", "least", "rows", "lo", "hi")
    merged = marked.where("meets").groupBy("digest").agg(F.min("least").alias("least"), F.sum("rows").alias("rows"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return write_table(alone.unionByName(merged).sortWithinPartitions("digest"), "compacted")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", memtables: int = 4, digest_bits: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, and the columns ``carry``.

    digest_bits: the index's digests may be shorter than SHA-256 (tests make them collide); results don't change.
    """
    turned = keep == "largest"
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("t"), *carry)
    rank = F.bitwise_not("doc_id") if turned else F.col("doc_id")
    digest = F.substring("sha", 1, digest_bits // 8).alias("digest")
    # a row's place tells rows of one id apart; it is written, so it stays as it is
    keyed = source.select(*carry, "doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("quick"), F.octet_length("t").alias("size"), F.monotonically_increasing_id().alias("place"))
    rows = write_table(keyed.select("*", digest, rank.alias("rank")), "digests")
    per_run = filter_words(rows.count() // memtables)
    runs = flush(rows, memtables)
    filters = run_filters(runs, memtables, per_run)
    hits = write_table(compact(runs, filters, per_run).where("rows > 1"), "hits")
    words = filter_words(hits.count())
    quick, hit = (write_table(bloom(hits.select(c), words), "filters") for c in ("lo", "digest"))
    # texts are read again through the filter; the digest is made of those that pass
    same = hits.where("lo = hi").select("digest", F.col("least.rank").alias("first"))
    passing = source.where(may_hold(quick, F.xxhash64("t"), words)).select("t", rank.alias("rank"), F.unhex(F.sha2("t", 256)).alias("sha")).select("t", "rank", digest)
    verify = write_table(passing.join(same, "digest"), "verify")
    first = verify.where(F.col("rank").eqNullSafe(F.col("first"))).groupBy("digest").agg(F.min("t").alias("stays"))
    # keys made anew: the join shares no shuffle with the aggregations around it, so a hot digest's rows can be split
    anew = F.concat("digest", F.lit(b"")).alias("digest")
    compared = verify.join(first.select(anew, "stays"), "digest").where("t <> stays")
    collided = write_table(compared.select(anew).union(hits.where("lo <> hi").select("digest")).distinct(), "collided")
    own = F.struct(F.col("rank").isNull().alias("none"), "rank", "place")
    alone = rows.where(~may_hold(hit, F.col("digest"), words)).withColumn("least", own).withColumn("rows", F.lit(1).cast("long"))
    found = rows.where(may_hold(hit, F.col("digest"), words)).join(hits.select("digest", F.col("least").alias("of"), F.col("rows").alias("all")), "digest", "left")
    found = found.withColumn("least", F.coalesce("of", own)).withColumn("rows", F.coalesce("all", F.lit(1).cast("long"))).drop("of", "all")
    if collided.isEmpty():
        return _result(alone, turned, carry).unionByName(_result(found, turned, carry))
    whole = rows.join(collided, "digest", "left_semi")
    again = whole.groupBy("digest", "sha", "quick", "size").agg(F.min(own).alias("least"), F.count("*").alias("rows"))
    parts = [alone, found.join(collided, "digest", "left_anti"), whole.join(again, ["digest", "sha", "quick", "size"])]
    return reduce(DataFrame.unionByName, [_result(p, turned, carry) for p in parts])


def _result(rows: DataFrame, turned: bool, carry: tuple[str, ...]) -> DataFrame:
    return rows.select("doc_id", (F.bitwise_not("least.rank") if turned else F.col("least.rank")).alias("keep_id"), F.col("rows").alias("group_size"), (F.col("place") == F.col("least.place")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), *carry)
