"""Byte-level BPE with a two-tier lookup.

A text is split by the tokenizer's pattern. Tier one asks a minimal perfect hash (hash and displace) over
the vocabulary whether the whole pre-token is a token: one hash, one displacement, one comparison of
bytes. Tier two merges the rest: the bytes are a linked list, a heap holds the ranks of neighbouring
pairs, and stale heap entries are skipped when they come up; n bytes take O(n log n).

Texts stay whole, so a pre-token is never cut, however long. Each worker remembers the ids of pre-tokens in two
generations of up to ``remember`` bytes each, beside those of the slice of texts at hand; forgetting costs time
only.

Defined results: null text: as empty, no ids. One result row per input row, also for null and repeated ids and
repeated rows; empty table: empty result. Extra columns are ignored, whatever their names. Of pairs of equal rank
the leftmost is merged first. Ids are little-endian unsigned 32-bit integers in one
binary value per text; the decoded bytes come from the ids alone.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from pathlib import Path
from sys import getsizeof

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.words import mix, parts
from quern.shipping import ship

ODD = 0x9E3779B97F4A7C15
#: Bytes of an entry of a dictionary beside its key and value, about.
ENTRY = 100


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 tokens and ranks."""
    pairs = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    out = [b""] * len(pairs)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


class PerfectHash:
    """A minimal perfect hash of distinct byte strings: each has a slot of its own in 0 .. n-1."""

    def __init__(self, keys: list[bytes], per_bucket: int = 2):
        n = self.n = len(keys)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, n)
        self.buckets = max(1, n // per_bucket)
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        #: Displacement of a bucket; -1 - slot where it has one key.
        self.shift = np.zeros(self.buckets, np.int64)
        self.key_at = np.full(n, -1, np.int64)
        order = np.argsort(bucket, kind="stable")
        cut = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(cut)
        free = None
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[cut[b] : cut[b + 1]]
            if not len(own):
                break
            if len(own) == 1:
                free = iter(np.flatnonzero(self.key_at < 0).tolist()) if free is None else free
                slot = next(free)
                self.shift[b], self.key_at[slot] = -1 - slot, own[0]
                continue
            h, d, step = hashes[own], 0, 32
            while True:
                tries = np.arange(d, d + step, dtype=np.uint64) * np.uint64(ODD)
                slots = (mix(h[None, :] + tries[:, None]) % np.uint64(n)).astype(np.int64)
                ok = np.flatnonzero((self.key_at[slots] < 0).all(axis=1))
                ok = [i for i in ok.tolist() if len(set(slots[i].tolist())) == len(own)][:1]
                if ok:
                    d, slots = d + ok[0], slots[ok[0]]
                    break
                d, step = d + step, min(4096, 2 * step)
            self.shift[b], self.key_at[slots] = d, own

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of the only key that each word can be; the caller compares the bytes."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        moved = mix(h + shift.astype(np.uint64) * np.uint64(ODD)) % np.uint64(self.n)
        return self.key_at[np.where(shift < 0, -1 - shift, moved.astype(np.int64))]


class Tokenizer:
    """Encodes by ranks; built once on the driver and sent to the executors (about 2 MB for 50,000 tokens)."""

    def __init__(self, tokens: list[bytes], pattern: str, remember: int = 80 << 20):
        self.tokens, self.pattern, self.remember = tokens, pattern, remember
        self.whole = PerfectHash(tokens)

    def start(self) -> None:
        """In a worker, once."""
        self.rank = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(self.pattern).findall
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held = 0  # bytes of the young

    def merge(self, word: bytes) -> list[int]:
        """Ranks of a word's tokens: the pair of lowest rank first, the leftmost of equals."""
        n, rank = len(word), self.rank
        if n == 1:
            return [rank[word]]
        after, before, piece = list(range(1, n + 1)), list(range(-1, n - 1)), [word[i : i + 1] for i in range(n)]
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            left = piece[i]
            if left is None or (j := after[i]) >= n or len(left) + len(piece[j]) != size:
                continue
            piece[i], piece[j] = left + piece[j], None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(both := piece[i] + piece[k])) is not None:
                    heappush(heap, (r, i, len(both)))
            if (p := before[i]) >= 0 and (r := rank.get(both := piece[p] + piece[i])) is not None:
                heappush(heap, (r, p, len(both)))
        return [rank[x] for x in piece if x is not None]

    def learn(self, words: set[str]) -> None:
        """Both tiers for words that aren't remembered."""
        new = [w for w in words if w not in self.young]
        known = [w for w in new if w in self.old]
        new = [w for w in new if w not in self.old]
        if self.held > self.remember:
            self.old, self.young, self.held = self.young, {}, 0
            known = [w for w in words if w in self.old]
            new = [w for w in words if w not in self.old]
        for w in known:
            self.keep(w, self.old[w])
        if new:
            raw = [w.encode() for w in new]
            ids = np.empty(1, "<u4")
            for w, b, i in zip(new, raw, self.whole.find(raw).tolist(), strict=True):
                if self.tokens[i] == b:
                    ids[0] = i
                    self.keep(w, ids.tobytes())
                else:
                    self.keep(w, np.asarray(self.merge(b), "<u4").tobytes())

    def keep(self, word: str, ids: bytes) -> None:
        self.young[word] = ids
        self.held += getsizeof(word) + getsizeof(ids) + ENTRY

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [self.split(t or "") for t in texts]
        self.learn(set().union(*words))
        ids = self.young
        return [b"".join([ids[w] for w in ws]) for ws in words]

    def decode(self, ids: bytes) -> bytes:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True, remember: int = 80 << 20) -> DataFrame:
    """One row per document: doc_id, ids (binary), n_tokens, and decoded (binary; made from the ids) if asked for.

    vocabulary: a file of base64 tokens and ranks that the driver reads.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(read_ranks(vocabulary), pattern, remember))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared.value
        if not hasattr(tokenizer, "rank"):
            tokenizer.start()
        for batch in parts(batches, "text", 1 << 19):
            ids = tokenizer.encode(batch.column("text").to_pylist())
            out = [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if decode:
                out.append(pa.array([tokenizer.decode(x) for x in ids], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "n_tokens", "decoded"][: len(out)])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, n_tokens long" + ", decoded binary" * decode)


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
