"""Substring dedup by level-wise doubling.

A window of ``window`` words can repeat only if every shorter window inside it repeats. The levels
double from ``base`` words up to ``window`` (9, 18, 35 for 35: the last doubling stops at the window
asked for). At each level below the last, every surviving 35-word window names one sub-window of the
level's length, the one with the smallest hash: a choice by content alone, so equal windows name equal
sub-windows, and about 2 in 27 of all positions are shuffled instead of all. Windows whose named
sub-window occurs at one place only are dropped; the others are extended to twice the length. The hashes
of these levels only choose candidates: two different words or sequences of one hash let a window live
for another level. At the last level a surviving window stands for itself: its identity is 128 bits of the
SHA-256 of its own bytes (its words joined by one space), so no weakness of a fast hash can make different
windows equal.

What repeats is found by ``groupBy(hash)`` with the smallest and largest place: both combine before the
shuffle, so a passage in a third of all texts costs one row per task, and the way back is a semi join
whose large side Spark may split. Texts that are equal byte by byte share one key; they count once as a
place and are removed whole (if they have a window) by their number.

Defined results: null text: no words. Texts under ``window`` words: nothing removed. Null or repeated
``doc_id`` and repeated rows: one result row per input row (places are keyed by text, not by id).
An empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import apart, drop_table, write_table
from quern.llm.words import SPACE, U64, WORD_BASE, parts, spans_hash, split, string_bytes, words_hash
from quern.shipping import ship

ROW = "id long, k long, k2 long, n_words long, n_removed long, kept string, done boolean, emits boolean, text string, runs array<int>, moves boolean"
PLACES = "h long, h2 long, k long, k2 long, p int"


def levels(window: int, base: int) -> list[int]:
    """Lengths that double up to ``window``: each is at least half of the next, the first at most ``base``."""
    out = [window]
    while out[0] > max(base, 1) or len(out) == 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Text:
    """Word hashes of one slice of texts, and what the levels ask about its windows."""

    def __init__(self, column: pa.Array, window: int):
        self.window = window
        self.data, self.offsets = string_bytes(column)
        self.starts, self.ends, self.words = split(self.data, self.offsets)
        self.hashes = words_hash(self.data, self.starts, self.ends)
        self.smallest: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        n = np.diff(self.words)
        # windows: where in self.hashes each starts, and of which text
        have = np.maximum(n - window + 1, 0)
        self.of = np.repeat(np.arange(len(n)), have)
        self.at = np.arange(len(self.of)) - np.repeat(np.cumsum(have) - have, have) + np.repeat(self.words[:-1], have)
        self.first = np.concatenate([[0], np.cumsum(have)])

    def sequence_hash(self, at: np.ndarray, length: int) -> np.ndarray:
        return spans_hash(self.hashes, at, at + length, WORD_BASE)

    def identity(self, at: np.ndarray) -> np.ndarray:
        """Two 64-bit numbers for each window (start ``at``): of the SHA-256 of its words joined by one space."""
        if not len(at):
            return np.zeros((0, 2), U64)
        # the words, each with one space after it
        keep = ~SPACE[self.data]
        sizes = self.ends - self.starts
        ends = np.cumsum(sizes + 1)
        joined = np.full(int(ends[-1]), 32, np.uint8)
        place = np.ones(len(joined), bool)
        place[ends - 1] = False
        joined[place] = self.data[keep]
        raw, begins = joined.tobytes(), (ends - sizes - 1)
        digest = hashlib.sha256
        return np.frombuffer(b"".join([digest(raw[i:j]).digest()[:16] for i, j in zip(begins[at].tolist(), (ends[at + self.window - 1] - 1).tolist(), strict=True)]), "<u8").reshape(-1, 2)

    def named(self, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each window (start ``at``): the place and hash of its smallest sub-window of ``length`` words, the first one of equals."""
        if not len(at):
            return at, np.zeros(0, U64)
        if length not in self.smallest:
            h = self.sequence_hash(np.arange(len(self.hashes) - length + 1), length)
            self.smallest[length] = h, np.lib.stride_tricks.sliding_window_view(h, self.window - length + 1)
        h, view = self.smallest[length]
        place = np.empty(len(at), np.int64)
        for i in range(0, len(at), 1 << 16):
            some = at[i : i + (1 << 16)]
            place[i : i + len(some)] = some + view[some].argmin(axis=1)
        return place, h[place]

    def digest(self, text: int, keep: np.ndarray | None = None) -> str:
        """SHA-256 of the text's words (those of ``keep``), joined by one space."""
        data = self.data[self.offsets[text] : self.offsets[text + 1]].tobytes()
        if keep is None:
            return hashlib.sha256(b" ".join(data.split())).hexdigest()
        own = slice(self.words[text], self.words[text + 1])
        s, e = ((x[own][keep] - self.offsets[text]).tolist() for x in (self.starts, self.ends))
        return hashlib.sha256(b" ".join([data[i:j] for i, j in zip(s, e, strict=True)])).hexdigest()


def from_runs(runs: list | None, base: int) -> np.ndarray:
    """Window numbers of [start, end) pairs."""
    pairs = np.asarray(runs or [], np.int64).reshape(-1, 2)
    return np.concatenate([np.arange(a, b) for a, b in pairs] or [np.zeros(0, np.int64)]) + base


def to_runs(kept: np.ndarray) -> list[int]:
    """[start, end) pairs, flat, of sorted numbers."""
    if not len(kept):
        return []
    cut = np.flatnonzero(np.diff(kept) > 1)
    return np.stack([kept[np.concatenate([[0], cut + 1])], kept[np.concatenate([cut, [len(kept) - 1]])] + 1], axis=1).ravel().tolist()


def _rows(out: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    names = ["h", "h2", "k", "k2", "p"]
    cols = [np.concatenate([x[i] for x in out]) for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32) if n == "p" else c.view(np.int64)) for n, c in zip(names, cols, strict=True)], names)


def places(window: int, length: int):
    """mapInArrow: the places that the surviving windows name at this level (column runs; absent: all windows)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            t = Text(batch.column("text"), window)
            k, k2 = (np.asarray(batch.column(c), dtype=np.int64) for c in ("k", "k2"))
            if "runs" in batch.schema.names:
                alive = np.concatenate([from_runs(r, t.first[i]) for i, r in enumerate(batch.column("runs").to_pylist())])
            else:
                alive = np.arange(len(t.at))
            if not len(alive):
                continue
            if length == window:
                at, of = t.at[alive], t.of[alive]
                h, h2 = t.identity(at).T
            else:
                at, h = t.named(length, t.at[alive])
                at, one = np.unique(at, return_index=True)
                h, of = h[one], t.of[alive][one]
                h2 = np.zeros(len(h), U64)
            yield _rows([(h, h2, k[of], k2[of], at - t.words[of])])

    return emit


def narrow(window: int, length: int, final: bool):
    """mapInArrow over rows with ``text``, ``runs`` (absent: all windows) and the repeated places ``found``.

    Below the last level it keeps the windows whose named place is found; at the last level it removes
    the words of the found windows. A text with none is done. A done text is a row with its result; one
    that goes on (as a place of others, if it is done itself) is a row with its text and windows.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, "text"):
            t = Text(batch.column("text"), window)
            col = {c: batch.column(c).to_pylist() for c in batch.schema.names if c in ("id", "k", "k2", "found", "runs", "copies", "emits", "done")}
            out = []
            for i in range(batch.num_rows):
                n = int(t.words[i + 1] - t.words[i])
                copies, found = (col["copies"][i] or 1) if "copies" in col else 1, col["found"][i]
                emits, removed, kept, runs = col["emits"][i], 0, None, None
                known = done = bool(col["done"][i]) if "done" in col else False
                if copies > 1 and n >= window:
                    done, removed, kept = True, n, hashlib.sha256(b"").hexdigest()
                if found:
                    if final:
                        mark = np.zeros(n + 1, np.int64)
                        f = np.asarray(found)
                        np.add.at(mark, f, 1)
                        np.add.at(mark, f + window, -1)
                        covered = np.cumsum(mark)[:n] > 0
                        done, removed, kept = True, int(covered.sum()), t.digest(i, ~covered)
                    else:
                        windows = np.arange(t.first[i], t.first[i + 1]) if "runs" not in col else from_runs(col["runs"][i], t.first[i])
                        place, _ = t.named(length, t.at[windows])
                        runs = to_runs(windows[np.isin(place - t.words[i], np.asarray(found))] - t.first[i])
                if not runs and not done:
                    done, removed, kept = True, 0, t.digest(i)
                key = (col["id"][i], col["k"][i], col["k2"][i], n)
                if done and not known:
                    out.append((*key, removed, kept, True, False, None, None, False))
                if runs and (emits or not done):
                    out.append((*key, 0, None, done, bool(emits), batch.column("text")[i].as_py(), runs, True))
            if not out:
                continue
            kinds = [pa.int64()] * 5 + [pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.list_(pa.int32()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in ROW.split(", ")])

    return step


def _repeated(rows: DataFrame) -> DataFrame:
    """Per text key, the places whose hash has another place too."""
    place = F.xxhash64("k", "k2", "p")
    hashes = rows.groupBy("h", "h2").agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where("lo < hi").select("h", "h2")
    return rows.join(apart(hashes, "h", "h2"), ["h", "h2"], "left_semi").groupBy("k", "k2").agg(F.collect_set("p").alias("found"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, base: int = 9) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; see the module's text."""
    ship(docs.sparkSession)
    steps = levels(window, base)
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("k2"))
    narrow_text = source.select("text", "k", "k2")
    found = _repeated(narrow_text.mapInArrow(places(window, steps[0]), PLACES))
    classes = source.groupBy("k", "k2").agg(F.count("*").alias("copies"), F.min("id").alias("one"))
    info = classes.join(found, ["k", "k2"], "left").where("copies > 1 or found is not null")
    # one text may be in a third of all rows: the join shares no shuffle with the aggregation, so its rows can be split
    joined = source.join(apart(info, "k", "k2"), ["k", "k2"], "left").select("id", "text", "k", "k2", "copies", "found", (F.col("id").eqNullSafe(F.col("one")) | F.col("one").isNull()).alias("emits"))
    tables = [write_table(joined.mapInArrow(narrow(window, steps[0], False), ROW), f"substrings-{steps[0]}", by="moves")]
    for length in steps[1:]:
        last = tables[-1]
        alive = last.where("moves")
        rows = alive.select("text", "k", "k2", "runs").mapInArrow(places(window, length), PLACES)
        found = _repeated(rows)
        joined = alive.join(apart(found, "k", "k2"), ["k", "k2"], "left").select("id", "text", "k", "k2", "emits", "found", "runs", "done")
        final = length == window
        # texts that are removed whole went on only as places of others
        tables.append(write_table((joined.where("not done") if final else joined).mapInArrow(narrow(window, length, final), ROW), f"substrings-{length}", by="moves"))
        drop_table(last, "moves=true")
    rows = [t.where("not moves").select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256")) for t in tables]
    return reduce(DataFrame.unionByName, rows)
