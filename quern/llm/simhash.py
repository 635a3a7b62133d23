"""SimHash near-dedup with a binary-trie self-join of the fingerprints.

Fingerprints are made from all word shingles of a whole text. Equal fingerprints become one node. Two
fingerprints that differ in at most ``budget`` bits agree on at least one of ``budget + 1`` blocks, so each
block deals the fingerprints out by its bits; a link is found under one key at least. Inside a key the
sorted fingerprints are a binary trie, and links come from its self-join alone: node pairs are traversed
together from the root, breadth first in array form; a pair's errors grow where the two branches differ, and
it is pruned when they exceed the budget. Two nodes of one fingerprint each are leaves; what is left of
their paths is added at once. A task returns a spanning forest of the links it found, at most one edge per
fingerprint, and never the pairs.

A key of more than ``split_at`` fingerprints is cut into parts that tasks walk apart. Its cut bits are those
that divide its own fingerprints best (sums of bits, combined before the shuffle), more of them the larger it
is; they make nodes. A fingerprint goes to its own node; to the pair of nodes that differ in one cut bit, for
each cut bit (there the walk starts from the two nodes); and to the fingerprints that agree outside the cut
bits, which holds every link of two differing cut bits. With c cut bits these are c + 2 copies.

Defined results: null or empty text, or no words: fingerprint zero, linked like any other. One or two
words: the whole sequence is the one shingle. One result row per input row, also for repeated or null
ids (a null id never becomes a component_id unless the component has no other). Empty table: empty
result. Other columns are ignored.

``near_copies`` is for a stage that asks for a similarity of the texts. Fingerprints propose there; the Jaccard
similarity of the sets of shingles (64-bit hashes) decides. Texts of equal sets are one node. At similarity 0.8
each bit differs with a chance of 0.15, so no block of useful width is free of errors in every pair, and one trie
with a budget for all of it prunes nothing. A set therefore has several fingerprints of 128 bits, each sorted into
a trie of its own: cut from a string of bits at steps of ``STEP``. Each trie is walked with itself in pairs of
nodes; a pair of nodes goes on while its paths agree in the bits that deal the trie out to tasks (more of them the
larger the table is, so that about ``TRIE`` fingerprints share them), differ in at most ``EARLY`` of the next ones,
and in at most ``BOTH`` in all. The number of tries follows from the chance that a pair at the similarity passes
one of them, and leaves ``MISSED`` of such pairs. Sets too small to be similar to any other are nodes of their own.
What is proposed makes groups; inside a group every pair is checked by its sets (pairs that differ in more than
``FAR`` of 128 bits can't be similar), unless other checked links connect it already. Subtries and groups that are
too large are dealt out in tiles, and a task returns a forest of its links.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quern.llm.components import Forest, components
from quern.llm.exact_dedup import bloom, filter_words, may_hold
from quern.llm.storage import apart, write_table
from quern.llm.words import LOWER, SPACE, mix, parts, split, string_bytes
from quern.shipping import ship

#: Cut bits of a large key at most; and marks of its parts (0 to 63: a pair of nodes that differ in that bit).
CUT_BITS, WHOLE, NODE, OUTSIDE = 16, -2, -1, 64
SIGN = np.uint64(1 << 63)
#: Of near_copies: errors allowed in the first bits of a subtrie, bits that may differ in 128, and in a check of sets.
EARLY, BOTH, FAR = (2, 15), 32, 44
#: Fingerprints of a subtrie; bits from one trie's fingerprint to the next one's; pairs at the similarity that no trie proposes.
TRIE, STEP, MISSED = 1 << 15, 21, 1e-5
#: Hash minima of a set.
MINIMA = 6


def shingle_hashes(column: pa.Array, shingle: int = 3, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles of a string column, and how many each text has."""
    data, offsets = string_bytes(column)
    data = LOWER[data]
    starts, ends, words = split(data, offsets)
    n = np.diff(words)
    have = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
    if not have.sum():
        return np.zeros(0, np.uint64), have
    # one space between words: keep the bytes of words and the first byte after each
    keep = ~SPACE[data]
    after = ends[ends < len(data)]
    after = after[SPACE[data[after]]]
    keep[after] = True
    data[after] = 32
    at = np.cumsum(keep) - keep
    joined = data[keep].tobytes()
    text = np.repeat(np.arange(len(n)), have)
    first = np.arange(len(text)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(words[:-1], have)
    last = np.minimum(first + shingle, words[1:][text]) - 1
    s, e = at[starts[first]].tolist(), (at[ends[last] - 1] + 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], seed) for i, j in zip(s, e, strict=True)), np.uint64, len(s)), have


def prints_of(hashes: np.ndarray, have: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of texts from the hashes of their shingles; zero where there is none."""
    out = np.zeros(len(have), np.uint64)
    full = np.flatnonzero(have)
    if not len(full):
        return out
    begins = (np.cumsum(have) - have)[full]
    ones = np.empty((len(full), 64), np.int64)
    for lo in range(0, len(full), 256):
        a, b = begins[lo], begins[lo + 256] if lo + 256 < len(full) else len(hashes)
        bits = np.unpackbits(hashes[a:b].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[lo : lo + 256] = np.add.reduceat(bits, begins[lo : lo + 256] - a, axis=0, dtype=np.int32)
    most = 2 * ones > have[full][:, None]
    out[full] = np.packbits(most, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint_texts(column: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """64-bit fingerprints of a string column."""
    return prints_of(*shingle_hashes(column, shingle, seed))


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int, frontier: int = 1 << 18, tally: Counter | None = None, early: tuple[int, int] = (0, 0)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Position pairs that differ in at most ``budget`` bits, by walking pairs of trie nodes.

    A node is a range of sorted, distinct values; a row of ``values`` has 64 bits of each. starts: rows a0, a1, b0, b1 of
    the node pairs to start from, a range twice for the pairs inside it. At most about ``frontier`` node pairs are expanded
    at once; the others wait on a stack. tally: counts the node pairs met and the leaves among them. early: a depth, and
    the errors that a pair may have down to it; with none all pairs are found.
    """
    values = np.atleast_2d(values)
    ones: dict[int, np.ndarray] = {}

    def middle(depth: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        if depth not in ones:
            if len(ones) > 16:
                ones.clear()
            ones[depth] = np.concatenate([[0], np.cumsum((values[depth >> 6] >> np.uint64(63 - depth % 64)) & np.uint64(1), dtype=np.int32)])
        return hi - (ones[depth][hi] - ones[depth][lo])

    stack = [(0, np.concatenate([starts, np.zeros((1, starts.shape[1]), np.int64)]))]
    while stack:
        depth, pairs = stack.pop()
        a0, a1, b0, b1, errors = pairs
        same = a0 == b0
        size = (a1 - a0) * (b1 - b0)
        alive = (size > 0) & ~(same & (size == 1))
        leaf = alive & (size == 1)
        if tally is not None:
            tally.update(pairs=int(alive.sum()), leaves=int(leaf.sum()))
        if leaf.any():
            i, j = a0[leaf], b0[leaf]
            near = sum(np.bitwise_count(word[i] ^ word[j]) for word in values) <= budget
            if near.any():
                yield i[near], j[near]
        pairs = pairs[:, alive & ~leaf]
        if not pairs.shape[1]:
            continue
        if pairs.shape[1] > frontier:
            stack += [(depth, pairs[:, : pairs.shape[1] // 2]), (depth, pairs[:, pairs.shape[1] // 2 :])]
            continue
        a0, a1, b0, b1, errors = pairs
        am, bm = middle(depth, a0, a1), middle(depth, b0, b1)
        cross = errors < (early[1] if depth < early[0] else budget)
        other = (a0 != b0) & cross
        stack.append((depth + 1, np.concatenate([
            np.stack([a0, am, b0, bm, errors]),
            np.stack([am, a1, bm, b1, errors]),
            np.stack([a0, am, bm, b1, errors + 1])[:, cross],
            np.stack([am, a1, b0, bm, errors + 1])[:, other],
        ], axis=1)))


def start_pairs(values: np.ndarray, groups: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the walk of each group of two values or more begins: with its root, or with the two nodes that its bit (``kind``) parts."""
    lo, hi = groups[:-1], groups[1:]
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    bit = kind[lo]
    cut = (bit >= 0) & (bit < OUTSIDE)
    one = (values >> np.clip(kind, 0, 63).astype(np.uint64)) & np.uint64(1)
    total = np.concatenate([[0], np.cumsum(one, dtype=np.int64)])
    mid = hi - (total[hi] - total[lo])
    return np.stack([lo, np.where(cut, mid, hi), np.where(cut, mid, lo), hi])


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 1 << 16) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Chunks of whole groups of rows sorted by ``keys``, each chunk of ``least`` rows or more, with the groups' begins and the end."""
    held: list[pa.RecordBatch] = []
    n = 0

    def begins(table: pa.Table) -> np.ndarray:
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            v = table.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= least:
            table = pa.Table.from_batches(held).combine_chunks()
            at = begins(table)
            if at[-1]:
                yield table.slice(0, at[-1]), at
                held = table.slice(at[-1]).to_batches()
                n = sum(x.num_rows for x in held)
    if n:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.concatenate([begins(table), [n]])


def block_keys(budget: int, value: str) -> list[Column]:
    """Per block of the budget+1 blocks of a 64-bit value: its number and its bits (the rest zero)."""
    blocks = budget + 1
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return [F.struct(F.lit(i).alias("t"), F.col(value).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for i, m in enumerate(masks)]


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def cut_bits(rows: DataFrame, split_at: int) -> DataFrame:
    """Of each key (t, key) with more than ``split_at`` rows the bits that divide it best: columns t, key, bits."""
    hot = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > split_at)
    sums = rows.join(apart(hot.select("key", "t", "n"), "key"), ["t", "key"]).groupBy("t", "key").agg(F.first("n").alias("n"), *(F.sum(F.call_function("shiftright", F.col("fp"), F.lit(i)).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)))
    uneven = F.array(*(F.struct(F.abs(2 * F.col(f"s{i}") - F.col("n")).alias("d"), F.lit(i).alias("i")) for i in range(64)))
    many = F.least(F.lit(CUT_BITS), F.ceil(F.log2(F.col("n") / split_at)) + 1).cast("int")
    return sums.select("t", "key", F.transform(F.slice(F.sort_array(uneven), F.lit(1), many), lambda x: x["i"]).alias("bits"))


def link_forest(prints: DataFrame, budget: int = 2, split_at: int = 8192) -> DataFrame:
    """Unique fingerprints (fp long) to edges (a, b) that connect what links of at most ``budget`` bits connect. Parts of a large key serve budgets of 2 or less."""
    rows = prints.select("fp", F.explode(F.array(*block_keys(budget, "fp"))).alias("x")).select("fp", "x.t", "x.key")
    if budget <= 2:
        dealt = rows.join(apart(cut_bits(rows, split_at), "key"), ["t", "key"], "left")
    else:
        dealt = rows.withColumn("bits", F.lit(None).cast("array<int>"))
    mask = F.aggregate("bits", F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(bit(i)))
    part = lambda kind, value: F.struct(kind.cast("int").alias("kind"), value.alias("part"))
    node = F.col("fp").bitwiseAND(F.col("mask"))
    ways = F.concat(F.array(part(F.lit(NODE), node), part(F.lit(OUTSIDE), F.col("fp").bitwiseAND(F.bitwise_not("mask")))), F.transform("bits", lambda i: part(i, node.bitwiseOR(bit(i)))))
    dealt = dealt.withColumn("mask", mask).withColumn("way", F.explode(F.when(F.col("bits").isNull(), F.array(part(F.lit(WHOLE), F.lit(0).cast("long")))).otherwise(ways)))
    dealt = dealt.select("fp", "t", "key", "way.kind", "way.part").withColumn("side", F.when(F.col("kind").between(0, 63), F.call_function("shiftright", F.col("fp"), F.col("kind")).bitwiseAND(F.lit(1))).otherwise(0))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, groups in grouped(batches, ["t", "key", "kind", "part"]):
            fp = table.column("fp").to_numpy()
            forest = Forest(len(fp))
            starts = start_pairs(fp.view(np.uint64), groups, table.column("kind").to_numpy())
            for i, j in trie_links(fp.view(np.uint64) ^ SIGN, starts, budget):
                forest.union(i, j)
            child, parent = forest.edges()
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[parent])], ["a", "b"])

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("t", "key", "kind", "part")
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys, "side", "fp").mapInArrow(join, "a long, b long")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, budget: int = 2, seed: int = 42, split_at: int = 8192, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component (the group's number, never null), and the columns ``carry``."""

    ship(docs.sparkSession)
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            fp = fingerprint_texts(batch.column("text"), shingle, seed)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *carry)), pa.array(fp.view(np.int64))], ["doc_id", *carry, "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *carry, F.col(text_col).alias("text"))
    schema = StructType([f for f in source.schema.fields if f.name != "text"] + [StructField("fp", LongType())])
    rows = write_table(source.mapInArrow(prints, schema), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(link_forest(rows.select("fp").distinct(), budget, split_at)).withColumnRenamed("node", "fp")
    of = write_table(classes.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "classes")
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = of.join(ids, "component").select("fp", "component", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component", *carry)


def sets_of(column: pa.Array, shingle: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, and how many each has."""
    hashes, have = shingle_hashes(column, shingle, seed)
    of = np.repeat(np.arange(len(have)), have)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    new = np.ones(len(of), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[new], np.bincount(of[new], minlength=len(have))


def words_of(hashes: np.ndarray, n: np.ndarray, many: int) -> list[np.ndarray]:
    """The first words of 64 bits of each set's fingerprints."""
    return [prints_of(mix(hashes + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64))), n) for i in range(many)]


def tries(nodes: int, similarity: float) -> tuple[int, int]:
    """Bits that deal a trie of so many fingerprints out, and how many tries leave ``MISSED`` of the pairs at the similarity."""
    errors, bits = EARLY
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = lambda n, most: sum(math.comb(n, k) * apart**k * (1 - apart) ** (n - k) for k in range(most + 1))
    dealt = min(max(0, math.ceil(math.log2(max(nodes, 1) / TRIE))), 64 - bits)
    found = chance(dealt, 0) * chance(bits, errors) * chance(128, BOTH)
    return dealt, 1 if found >= 1 else math.ceil(math.log(MISSED) / math.log(1 - found))


def minima(hashes: np.ndarray, n: np.ndarray, many: int = MINIMA) -> list[np.ndarray]:
    """Per text the smallest of its hashes under each of several random orders; all ones where it has none."""
    out = [np.full(len(n), np.uint64((1 << 64) - 1)) for _ in range(many)]
    full = np.flatnonzero(n)
    if len(full):
        begins = (np.cumsum(n) - n)[full]
        for i in range(many):
            out[i][full] = np.minimum.reduceat(mix(hashes + np.uint64((i + 1) * 0xA0761D6478BD642F % (1 << 64))), begins)
    return out


def block_links(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray] | None, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions in x and in y (None: x itself, each pair once) that differ in at most ``most`` of 128 bits, and their distances."""
    other = x if y is None else y
    for r in range(0, len(x[0]), 256):
        for c in range(r if y is None else 0, len(other[0]), 2048):
            bits = sum(np.bitwise_count(u[r : r + 256, None] ^ v[c : c + 2048]) for u, v in zip(x, other, strict=True))
            i, j = np.nonzero(bits <= most)
            bits, i, j = bits[i, j], i + r, j + c
            if y is None:
                bits, i, j = bits[i < j], i[i < j], j[i < j]
            yield i, j, bits


def tile_pairs(part: np.ndarray, fp: np.ndarray, fp2: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a tile to check, nearest first: between its two parts, or inside its only one."""
    home, away = np.flatnonzero(part == 0), np.flatnonzero(part)
    x, y = (fp[home], fp2[home]), (fp[away], fp2[away]) if len(away) else None
    out = [(home[i], (home if y is None else away)[j], bits) for i, j, bits in block_links(x, y, most)]
    if not out:
        return (np.zeros(0, np.int64),) * 3
    i, j, bits = map(np.concatenate, zip(*out, strict=True))
    order = np.argsort(bits, kind="stable")
    return i[order], j[order], bits[order]


def in_tiles(df: DataFrame, node: str, columns: list[str]) -> DataFrame:
    """Each row, one of ``sides`` parts of its key, under every tile that its part stands in: columns lo, hi and part (0 or 1)."""
    q = F.col("q")
    spread = df.withColumn("mine", F.pmod(F.xxhash64(node, F.lit(7)), F.col("sides")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    return spread.select(*columns, F.least("mine", q).alias("lo"), F.greatest("mine", q).alias("hi"), (F.col("mine") > q).cast("int").alias("part"))


def tiles(df: DataFrame, key: str, node: str, side: Column) -> DataFrame:
    """Each row under every tile of its key that its part stands in. side: parts of the key. Rows alone under their key go."""
    sizes = df.groupBy(key).agg(F.count("*").alias("m")).where("m > 1").select(key, F.greatest(F.lit(1), side).cast("int").alias("sides"))
    # the key is made anew: the join shares no shuffle with the aggregation, so a large key's rows can be split
    sizes = sizes.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))
    return in_tiles(df.join(sizes, key), node, df.columns)


def proposed(nodes: DataFrame, count: int, similarity: float, both: int = BOTH, trie: int = TRIE) -> DataFrame:
    """Nodes (node long, words array<long>), about ``count`` of them, to edges (a, b) that connect what the tries' self-joins link."""
    dealt, many = tries(count, similarity)
    size, step = F.size("words"), F.col("i") % 3 * STEP
    turned = lambda w: F.call_function("shiftleft", w, step).bitwiseOR(F.call_function("shiftrightunsigned", w, 64 - step))
    first, second = (F.element_at("words", (F.floor(F.col("i") / 3).cast("int") + k) % size + 1) for k in (0, 1))
    rows = nodes.select("node", "words", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("i")).select("node", "i", turned(first).alias("v"), turned(second).alias("w"))
    subtrie = F.call_function("shiftrightunsigned", F.col("v"), F.lit(64 - dealt)) if dealt else F.lit(0).cast("long")
    rows = rows.select("node", "v", "w", (F.col("i").cast("long") * (1 << dealt) + subtrie).alias("key"))
    early = (dealt + EARLY[1], EARLY[0])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, ["key", "lo", "hi"]):
            node, part, v, w, lo, hi = (table.column(c).to_numpy() for c in ("node", "part", "v", "w", "lo", "hi"))
            # nodes of one fingerprint are one leaf
            new = np.ones(len(node), bool)
            new[1:] = (v[1:] != v[:-1]) | (w[1:] != w[:-1]) | (part[1:] != part[:-1])
            new[at[:-1]] = True
            leaf, to = np.flatnonzero(new), np.concatenate([[0], np.cumsum(new)])
            forest = Forest(len(node))
            forest.union(leaf[to[1:] - 1][~new], np.flatnonzero(~new))
            begin, end = to[at[:-1]], to[at[1:]]
            cross = lo[at[:-1]] != hi[at[:-1]]
            mid = end - np.add.reduceat(part[leaf], begin)
            starts = np.stack([begin, np.where(cross, mid, end), np.where(cross, mid, begin), end])
            values = np.stack([v[leaf], w[leaf]]).view(np.uint64) ^ SIGN
            for i, j in trie_links(values, starts, both, 1 << 16, early=early):
                forest.union(leaf[i], leaf[j])
            child, parent = forest.edges()
            if len(child):
                yield pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[parent])], ["a", "b"])

    # the few subtries that are too large go to every task; their parts meet in tiles
    large = rows.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > 2 * trie).select("key", F.ceil(F.col("m") / trie).cast("int").alias("sides"))
    spread = rows.join(F.broadcast(large), "key", "left").withColumn("sides", F.coalesce("sides", F.lit(1)))
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("key", "lo", "hi")
    return in_tiles(spread, "node", rows.columns).repartition(n, *keys).sortWithinPartitions(*keys, "part", "v", "w").mapInArrow(join, "a long, b long")


def checked(texts: DataFrame, shingle: int, similarity: float, seed: int) -> DataFrame:
    """Rows (component, node, text) to edges (a, b) that connect what pairs of the similarity in a component connect."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            hashes, n = sets_of(batch.column("text"), shingle, seed)
            fp, fp2 = words_of(hashes, n, 2)
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("node"), pa.array(fp.view(np.int64)), pa.array(fp2.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(hashes.view(np.int64)))], ["component", "node", "fp", "fp2", "s"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in grouped(batches, ["component", "lo", "hi"], 1 << 10):
            node, part, fp, fp2 = (table.column(c).to_numpy() for c in ("node", "part", "fp", "fp2"))
            lists = table.column("s").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
            size = np.diff(offsets)
            for a, b in zip(at[:-1], at[1:], strict=True):
                i, j, _ = tile_pairs(part[a:b], fp[a:b].view(np.uint64), fp2[a:b].view(np.uint64), FAR)
                i, j = i + a, j + a
                fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
                root, links = list(range(b - a)), []

                def find(x: int, root: list[int] = root) -> int:
                    while root[x] != x:
                        root[x] = x = root[root[x]]
                    return x

                for x, y in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                    p, q = find(x - a), find(y - a)
                    if p == q:
                        continue
                    s, t = values[offsets[x] : offsets[x + 1]], values[offsets[y] : offsets[y + 1]]
                    same = int((s.take(np.searchsorted(s, t), mode="clip") == t).sum()) if len(s) else 0
                    if same >= similarity * (len(s) + len(t) - same):
                        root[p] = q
                        links.append((x, y))
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(node[[x for x, _ in links]]), pa.array(node[[y for _, y in links]])], ["a", "b"])

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ("component", "lo", "hi")
    rows = write_table(texts.mapInArrow(sets, "component long, node long, fp long, fp2 long, s array<long>"), "sets")
    dealt = tiles(rows, "component", "node", F.when(F.col("m") <= 256, 1).otherwise(F.ceil(F.sqrt("m") / 4)))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(join, "a long, b long")


def near_copies(docs: DataFrame, place: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, both: int = BOTH, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, component (the group's number, never null), and the columns ``place``, which tell rows apart."""

    ship(docs.sparkSession)
    count = docs.count()
    many = tries(count, similarity)[1]
    words = max(2, -(-many // 3))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            hashes, n = sets_of(batch.column("text"), shingle, seed)
            ends = np.cumsum(n)
            node = np.fromiter((xxhash.xxh3_64_intdigest(hashes[b - k : b].tobytes()) for b, k in zip(ends.tolist(), n.tolist(), strict=True)), np.uint64, len(n))
            bits = np.stack(words_of(hashes, n, words), axis=1).ravel().view(np.int64)
            bits = pa.FixedSizeListArray.from_arrays(pa.array(bits), words).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *place)), pa.array(node.view(np.int64)), pa.array(n, pa.int32()), bits], ["doc_id", *place, "node", "n", "words"])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), *place, F.col(text_col).alias("text"))
    new = [StructField(c, t) for c, t in (("node", LongType()), ("n", IntegerType()), ("words", ArrayType(LongType())))]
    rows = write_table(source.mapInArrow(prints, StructType([f for f in source.schema.fields if f.name != "text"] + new)), "fingerprints")
    # a set of n can only be similar to another one if n of n + 1 are enough
    nodes = write_table(rows.where(F.col("n") >= F.lit(similarity) * (F.col("n") + 1)).groupBy("node").agg(F.min("words").alias("words")), "nodes")
    groups = components(proposed(nodes, count, similarity, both))
    # of each proposed node one text is read
    one = rows.join(groups, "node").groupBy("node").agg(F.min(F.struct(*place)).alias("x"), F.min("component").alias("component"))
    digest = F.concat_ws(" ", *place).alias("digest")
    one = write_table(one.select("node", "component", "x.*").select("node", "component", digest), "proposed")
    filters = filter_words(one.count())
    texts = source.select(digest, "text").where(may_hold(write_table(bloom(one.select("digest"), filters), "filters"), F.col("digest"), filters)).join(one, "digest").select("component", "node", "text")
    found = components(checked(texts, shingle, similarity, seed))
    return rows.join(found, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"), *place)
