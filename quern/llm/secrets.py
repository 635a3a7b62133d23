"""Secret scan with corpus-wide ownership frequency.

Three kinds of base spans come from patterns: ``assign`` (a password-like name and its value), ``access``
(access-key ids) and ``hex`` (long runs of hex digits). Beside them every long token that holds a letter and
a digit, outside the base spans, is a ``generic`` candidate; its looks decide nothing more. Every value is
hashed (the value itself never leaves its text) and the hashes are counted over the corpus: in how many
distinct repositories, and of how many distinct owners, each occurs. A value of ``example_owners`` owners or
more, or of ``example_repos`` repositories or more, is a widely copied example; others are owner-specific
and look live. Base spans are always reported; generic candidates are reported where they look live.

The counts group by (hash, owner, repository), then (hash, owner), then hash. Each step combines before
its shuffle, so an example key in a third of all texts is one row per task and repository; the way back
to the texts is a join whose large side Spark may split.

Defined results: null text: empty, no spans. Null owner or repository: counts as one owner or repository
of its own. Extra columns are ignored, whatever their names. Texts are scanned whole. One result row per input row, also for repeated or null ids. Empty table: empty result.
Offsets are code points of the whole text, ends exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import write_table
from quern.llm.words import parts
from quern.shipping import ship

KINDS = ("assign", "access", "hex", "generic")
#: pattern, group that holds the secret, its least length in characters (of the whole match where the group is 0)
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    # runs are maximal, so asking for 24 at once gives the same spans as filtering runs
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
GENERIC = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
DIGIT, LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SCANNED = "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, base string, found array<struct<kind:int,start:int,end:int,value:string>>"


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, value) of base spans and generic candidates, by start, then kind."""
    out = []
    for k, kind in enumerate(KINDS[:3]):
        pattern, group, least = BASE[kind]
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), k, m.group(group)))
    taken = sorted((s, e) for s, e, _, _ in out)
    at = 0
    for m in GENERIC.finditer(text):
        value = m.group()
        while at < len(taken) and taken[at][1] <= m.start():
            at += 1
        if at < len(taken) and taken[at][0] < m.end():
            continue
        if DIGIT.search(value) and LETTER.search(value):
            out.append((m.start(), m.end(), 3, value))
    out.sort(key=lambda x: (x[0], x[2]))
    return [(k, s, e, hashlib.sha256(v.encode()).hexdigest()[:32]) for s, e, k, v in out]


def listed(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    struct = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
    for batch in parts(batches, "text"):
        spans = [find(t or "") for t in batch.column("text").to_pylist()]
        base = [[x for x in s if x[0] < 3] for s in spans]
        lists = [listed(b) for b in base]
        counts = [pa.array([sum(x[0] == k for x in b) for b in base], pa.int64()) for k in range(3)]
        found = pa.array([[dict(zip(("kind", "start", "end", "value"), x, strict=True)) for x in s] for s in spans], struct)
        digests = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in lists])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "owner", "repo")), *counts, digests, pa.array(lists, pa.string()), found], ["doc_id", "owner", "repo", "n_assign", "n_access", "n_hex", "base_sha256", "base", "found"])


def ownership(found: DataFrame) -> DataFrame:
    """Rows (value, owner, repo) to (value, n_owners, n_repos)."""
    each = found.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    owned = each.groupBy("value", "owner").agg(F.count("one").alias("repos"))
    return owned.groupBy("value").agg(F.count("repos").alias("n_owners"), F.sum("repos").alias("n_repos"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id", example_owners: int = 3, example_repos: int = 100) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live, max_owners, max_repos.

    owner_col and repo_col: who owns the place a text comes from, and the place; where a corpus has no
    repositories, each document is one.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.col(text_col).alias("text"))
    rows = write_table(source.mapInArrow(_scan, SCANNED).withColumn("row", F.monotonically_increasing_id()), "secrets")
    each = rows.where(F.size("found") > 0).select("row", "owner", "repo", F.explode("found").alias("x")).select("row", "owner", "repo", "x.*")
    seen = each.select("row", "kind", "start", "end", "value").join(ownership(each.select("value", "owner", "repo")).withColumn("value", F.concat("value", F.lit(""))), "value")
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    reported = (F.col("kind") < 3) | ~example
    span = F.struct("start", "kind", F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), "start", "end").alias("s"))
    named = seen.groupBy("row").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(reported, span))), lambda x: x["s"]), ",").alias("spans"),
        F.count_if(example).alias("n_example"), F.count_if(~example).alias("n_live"), F.max("n_owners").alias("max_owners"), F.max("n_repos").alias("max_repos"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(named, "row", "left").select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_example", zero).alias("n_example"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("max_owners", zero).alias("max_owners"), F.coalesce("max_repos", zero).alias("max_repos"))
