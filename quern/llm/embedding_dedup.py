"""Embedding near-dedup by Euclidean p-stable hashing.

Vectors are normalised in double precision; each of several hash tables quantises Gaussian projections,
floor((x . g + b) / width), and vectors of equal label that share a bucket are compared by exact cosine.
``plan`` sets how many projections a table has and how many tables there are: projections grow with the
logarithm of the largest label's number of vectors, so that about ``MATES`` unrelated vectors share a bucket at
any size, and tables grow so that two vectors at the threshold share one with probability ``recall`` (six
projections and 29 tables up to some 3,000 vectors of a label, about N^0.24 tables beyond).

Equal vectors of one label are one class with a count. What is dealt out by buckets are small rows: key, class,
and a sketch of 64 signs of further projections. Inside a bucket sketches are compared first, and only classes
that have a mate within ``SKETCH_BITS`` signs go on (at a cosine of 0.93 eight signs differ on average, for
unrelated vectors 32; one in some hundred thousand links at the threshold is lost by it). Their vectors move once
for each such bucket. There the cosines are block matrix products; a task returns a number per class and a
spanning forest, never pairs. A pair that shares several tables counts in the first of them only, which each task
decides from the vectors themselves: vectors within the sketch's budget meet in every table they share. A bucket
of more than ``split_at`` classes is dealt out as pairs of its blocks, so all of its pairs are still compared.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and rows with
a null label, link with nothing: n_links 0, component_id vec_id. Vectors of different lengths link never.
Equal vectors with one label link (cosine 1), repeated vec_ids included: each row counts. One result row
per input row; empty table: empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.components import Forest, components
from quern.llm.simhash import grouped
from quern.llm.storage import apart, write_table
from quern.llm.words import mix
from quern.shipping import ship


#: Unrelated vectors that share a bucket on average; signs of a sketch that may differ.
MATES, SKETCH_BITS = 8, 21


def same_cell(distance: float, width: float) -> float:
    """The probability that one projection puts two vectors at this distance into one cell (Datar et al., 2004)."""
    c = width / distance
    return math.erf(c / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * c) * (1 - math.exp(-c * c / 2))


def plan(vectors: int, threshold: float, width: float, recall: float) -> tuple[int, int]:
    """Tables, and projections of a table, for the largest label's number of vectors."""
    projections = max(6, math.ceil(math.log(max(vectors, 1) / MATES) / -math.log(same_cell(math.sqrt(2), width)))) if vectors > MATES else 6
    near = same_cell(math.sqrt(2 - 2 * threshold), width) ** projections
    return math.ceil(math.log(1 - recall) / math.log(1 - near)), projections


class Hasher:
    """The tables' keys and the sketches of unit vectors, the same in every task."""

    def __init__(self, tables: int, projections: int, width: float, seed: int):
        self.shape, self.width, self.seed = (tables, projections), width, seed
        self.made: dict[int, tuple[np.ndarray, ...]] = {}

    def drawn(self, d: int) -> tuple[np.ndarray, ...]:
        if d not in self.made:
            t, p = self.shape
            rng = np.random.default_rng([self.seed, d])
            self.made[d] = rng.standard_normal((d, t * p)), rng.random(t * p) * self.width, rng.integers(1, 1 << 63, (1, t, p), dtype=np.int64).view(np.uint64) | np.uint64(1), rng.standard_normal((d, 64))
        return self.made[d]

    def keys(self, units: np.ndarray) -> np.ndarray:
        g, b, odd, _ = self.drawn(units.shape[1])
        cell = np.floor((units @ g + b) / self.width).astype(np.int64).view(np.uint64).reshape(-1, *self.shape)
        return mix((mix(cell * odd) * odd).sum(axis=2, dtype=np.uint64)).view(np.int64)

    def sketches(self, units: np.ndarray) -> np.ndarray:
        return np.packbits(units @ self.drawn(units.shape[1])[3] > 0, axis=1).view(np.int64).ravel()


def has_mate(group: np.ndarray, own: np.ndarray, p: np.ndarray, q: np.ndarray, sketch: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Whether another row of its group (numbers, ascending) is within so many signs; where p <> q only rows of the two blocks meet."""
    out = np.zeros(len(group), bool)
    sketch = sketch.view(np.uint64)  # of signed numbers numpy counts the absolute value's bits
    cut = np.concatenate([np.flatnonzero(np.diff(group, prepend=-1)), [len(group)]])
    size = np.diff(cut)
    small = np.flatnonzero(np.repeat((size > 1) & (size <= 64), size))
    off = 1
    while len(i := small[:-off]) and len(small) > off:
        j = small[off:]
        same = group[i] == group[j]
        if not same.any():
            break
        i, j = i[same], j[same]
        near = (np.bitwise_count(sketch[i] ^ sketch[j]) <= bits) & ((p[i] == q[i]) | (own[i] != own[j]))
        out[i[near]] = out[j[near]] = True
        off += 1
    for lo, hi in zip(cut[:-1][size > 64].tolist(), cut[1:][size > 64].tolist(), strict=True):
        left, right = (lo + np.flatnonzero(own[lo:hi] == x) for x in (p[lo], q[lo]))
        for a in range(0, len(left), 512):
            for b in range(a if p[lo] == q[lo] else 0, len(right), 2048):
                x, y = left[a : a + 512], right[b : b + 2048]
                near = (np.bitwise_count(sketch[x][:, None] ^ sketch[y]) <= bits) & (x[:, None] != y)
                out[x[near.any(axis=1)]] = out[y[near.any(axis=0)]] = True
    return out


def matrix(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per vector length: the rows of that length and their unit vectors in double precision."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begins = np.cumsum(lengths) - lengths
    out = []
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        x = flat[begins[rows][:, None] + np.arange(d)]
        x = x / np.abs(x).max(axis=1, keepdims=True)
        out.append((rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))))
    return out


def dealt_rows(classes: DataFrame, hasher: Hasher, split_at: int) -> DataFrame:
    """Small rows (node, t, key, sketch, own, p, q) of classes (node, label, v): one for each table, and of a large bucket one for each pair of its blocks that the row's own block is in."""
    kind = classes.schema["label"].dataType.simpleString()

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, units in matrix(batch.column("v")) if batch.num_rows else []:
                places, sketch = hasher.keys(units), pa.array(hasher.sketches(units))
                some = batch.select(["node", "label"]).take(pa.array(rows))
                for t in range(hasher.shape[0]):
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(rows), t, np.int32)), pa.array(places[:, t]), sketch], ["node", "label", "t", "bucket", "sketch"])

    keyed = classes.select("node", "label", "v").mapInArrow(bucket, f"node long, label {kind}, t int, bucket long, sketch long").select("node", "t", F.xxhash64("label", "t", "bucket").alias("key"), "sketch")
    # as many rows as there are large buckets; small enough ones are broadcast by their size, others deal out both sides
    large = keyed.groupBy("t", "key").agg(F.count("*").alias("m")).where(F.col("m") > split_at).select("t", "key", F.ceil(F.col("m") / split_at).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    keyed = keyed.join(apart(large, "key"), ["t", "key"], "left").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.least("own", o).alias("p"), F.greatest("own", o).alias("q")))
    return keyed.withColumn("pair", F.explode(pairs)).select("node", "t", "key", "sketch", "own", "pair.p", "pair.q")


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.93, recall: float = 0.9995, width: float = 1.4, seed: int = 7, split_at: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    spark = vectors.sparkSession
    v = F.col("v")
    usable = F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label")).withColumn("usable", F.coalesce(usable, F.lit(False)))
    # zeros of either sign are equal
    rows = rows.withColumn("v", F.when(F.col("usable"), F.transform(v, lambda x: x + F.lit(0.0).cast("float"))).otherwise(v))
    classes = write_table(rows.where("usable").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    largest = classes.groupBy("label").agg(F.count("*").alias("m")).agg(F.max("m")).first()[0] or 0
    tables, projections = plan(largest, threshold, width, recall)
    hasher = Hasher(tables, projections, width, seed)
    parallel = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["t", "key", "p", "q"]
    dealt = dealt_rows(classes, hasher, split_at).repartition(parallel, *keys).sortWithinPartitions(*keys)

    def mates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in grouped(batches, keys):
            own, p, q, sketch = (table.column(c).to_numpy() for c in ("own", "p", "q", "sketch"))
            alive = has_mate(np.repeat(np.arange(len(groups) - 1), np.diff(groups)), own, p, q, sketch)
            if alive.any():
                yield from table.filter(pa.array(alive)).drop_columns(["sketch"]).combine_chunks().to_batches()

    alive = dealt.mapInArrow(mates, "node long, t int, key long, own int, p int, q int")
    met = alive.join(classes.select("node", "label", "n", "v"), "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in grouped(batches, keys, 1 << 14):
            node, n, t, own, p, q = (table.column(c).to_numpy() for c in ("node", "n", "t", "own", "p", "q"))
            label = table.column("label").combine_chunks().dictionary_encode()
            label = (label.combine_chunks() if isinstance(label, pa.ChunkedArray) else label).indices.to_numpy()
            links, forest = np.zeros(len(node), np.int64), Forest(len(node))
            for rows, units in matrix(table.column("v").combine_chunks() if isinstance(table.column("v"), pa.ChunkedArray) else table.column("v")):
                places = hasher.keys(units)
                # rows keep their order, so groups stay together
                cut = np.searchsorted(rows, groups)
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if hi - lo < 2:
                        continue
                    r = rows[lo]
                    mine = np.arange(lo, hi)
                    left, right = mine[own[rows[mine]] == p[r]], mine[own[rows[mine]] == q[r]]
                    for a in range(0, len(left), 1024):
                        for b in range(a if p[r] == q[r] else 0, len(right), 1024):
                            x, y = left[a : a + 1024], right[b : b + 1024]
                            i, j = np.nonzero(units[x] @ units[y].T >= threshold)
                            i, j = x[i], y[j]
                            if (label[rows[i]] != label[rows[j]]).any():  # two labels of one 64-bit key
                                i, j = (z[label[rows[i]] == label[rows[j]]] for z in (i, j))
                            if p[r] == q[r]:
                                i, j = (z[i < j] for z in (i, j)) if a == b else (i, j)
                            for c in range(0, len(i), 1 << 16):
                                u, w = i[c : c + (1 << 16)], j[c : c + (1 << 16)]
                                first = ~(places[u, : t[r]] == places[w, : t[r]]).any(axis=1)
                                u, w = rows[u[first]], rows[w[first]]
                                np.add.at(links, u, n[w])
                                np.add.at(links, w, n[u])
                                forest.union(u, w)
            child, parent = forest.edges()
            some = np.flatnonzero(links)
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(node[some]), pa.array(node[child])]), pa.concat_arrays([pa.array(links[some]), pa.nulls(len(child), pa.int64())]), pa.concat_arrays([none, pa.array(node[parent])])], ["node", "links", "other"])

    found = write_table(met.repartition(parallel, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "node long, links long, other long"), "links")
    counts = found.where("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = classes.join(linked, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "component").join(counts, "node", "left").select("node", "component_id", "links")
    result = classes.join(named, "node").select("label", "v", "n", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    good = rows.where("usable").join(result, ["label", "v"]).select("vec_id", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    bad = rows.where("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(bad).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
