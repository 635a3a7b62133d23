"""Language ID by hyperdimensional profiles.

Each letter (code point) has a random vector of +1/-1 drawn from a seed; an n-gram's vector binds its
letters' vectors, each rotated by its position, by multiplication. A text's vector is the bundle (sum) of
all its n-grams' vectors; a language's prototype is the bundle of its training texts' unit vectors, less
the mean over languages (what all languages share says nothing). The prediction is the language whose
prototype has the largest cosine with the text's vector; ties go to the smaller name.

Letters are what str.isalpha says, in lower case; runs of anything else count as one space, and n-grams
run over the text's edges as if a space stood there. The texts of a slice share one table of their
n-grams' vectors, so the bundles are matrix products: counts times vectors. Slices are bounded in bytes and in
rows, and the counts in texts and n-grams, so memory doesn't follow how short the texts are.

Training reads texts and non-null languages of the rows the caller marks, at most about ``train_rows`` of
them (a row joins by a hash of its id; everything is used where there are fewer). Per task it returns one
vector per language, which Spark sums; the driver gets languages x dimension numbers.

Defined results: null text or one without letters: ``und``, score 0. No training rows: ``und`` for all,
score 0. Score: the cosine, negative values as 0. Texts are read whole. One result row per input row, also for
null and repeated ids; empty table: empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.words import mix, parts
from quern.shipping import ship

UNDETERMINED = "und"


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def letter_vectors(codes: np.ndarray, dimension: int, seed: int) -> np.ndarray:
    """Rows of +1/-1, each a function of the code point and the seed alone."""
    lanes = np.arange(-(-dimension // 64), dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64)[:, None] + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))) + lanes * np.uint64(0xD6E8FEB86659FD93))
    flat = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8), axis=1)[:, :dimension]
    return flat.astype(np.int8) * 2 - 1


def bundles(texts: list[str | None], n: int, dimension: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of texts (rows; zero where a text has no letter) and whether each has a letter."""
    lower = [(t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lower), np.int64, len(lower))
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(lower)), sizes)
    is_letter = letter_table()[codes]
    has = np.bincount(of[is_letter], minlength=len(lower)) > 0
    # a space before each text and one after: boundaries between texts are not letters
    symbols = np.full(len(codes) + 2 * len(lower), 32, np.uint32)
    place = np.arange(len(codes)) + 2 * of + 1
    symbols[place] = np.where(is_letter, codes, 32)
    of = np.repeat(np.arange(len(lower)), sizes + 2)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 32) | (symbols[:-1] != 32) | (of[1:] != of[:-1])
    symbols, of = symbols[keep], of[keep]
    seen = np.zeros(0x110000, bool)
    seen[symbols] = True
    alphabet = np.flatnonzero(seen)
    number = np.zeros(0x110000, np.int64)
    number[alphabet] = np.arange(len(alphabet))
    s = number[symbols]
    grams = np.zeros(max(len(s) - n + 1, 0), np.int64)
    for i in range(n):
        grams = grams * len(alphabet) + s[i : i + len(grams)]
    inside = of[: len(grams)] == of[n - 1 :] if len(grams) else np.zeros(0, bool)
    grams, of = grams[inside], of[: len(inside)][inside]
    out = np.zeros((len(texts), dimension), np.float32)
    if not len(grams):
        return out, has
    letters = letter_vectors(alphabet, dimension, seed)
    vocabulary, gram = np.unique(grams, return_inverse=True)
    for lo in range(0, len(vocabulary), 4096):
        v = vocabulary[lo : lo + 4096]
        bound = np.ones((len(v), dimension), np.int8)
        for i in range(n):
            bound *= np.roll(letters[v // len(alphabet) ** (n - 1 - i) % len(alphabet)], i, axis=1)
        some = (gram >= lo) & (gram < lo + len(v))
        mine, which, vectors = of[some], gram[some] - lo, bound.astype(np.float32)
        # texts by the block: the counts are a table of texts times n-grams
        for a in range(0, len(texts), 256):
            i, j = np.searchsorted(mine, [a, a + 256])
            if i < j:
                rows = min(256, len(texts) - a)
                counts = np.bincount((mine[i:j] - a) * len(v) + which[i:j], minlength=rows * len(v)).reshape(rows, len(v))
                out[a : a + rows] += counts.astype(np.float32) @ vectors
    out[~has] = 0
    return out, has


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=-1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", n: int = 3, dimension: int = 1024, seed: int = 11, train_rows: int = 20_000) -> dict[str, np.ndarray]:
    """Centred unit prototypes by language."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    total = rows.count()
    if not total:
        return {}
    share = min(1.0, train_rows / total)
    if share < 1:
        rows = rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in parts(batches, "text", 1 << 19, 2048):
            vectors, _ = bundles(batch.column("text").to_pylist(), n, dimension, seed)
            langs = np.asarray(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(langs)):
                total[lang] = total.get(lang, 0) + unit(vectors)[langs == lang].sum(axis=0)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    each = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(sums, "lang string, v array<double>")
    # rounded, so that the order of addition can't show in a prediction
    summed = each.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum(F.col("col").cast("decimal(24,9)")).alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x")))).alias("v")).collect()
    prototypes = {r.lang: unit(np.asarray([x.x for x in r.v])) for r in sorted(summed)}
    if len(prototypes) > 1:
        mean = np.mean(list(prototypes.values()), axis=0)
        prototypes = {k: unit(v - mean) for k, v in prototypes.items()}
    return prototypes


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text", n: int = 3, dimension: int = 1024, seed: int = 11, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the prediction and its score under ``names``."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    ship(docs.sparkSession)
    known = np.asarray(sorted(prototypes), object)
    model = np.stack([prototypes[k] for k in known]).astype(np.float64) if len(known) else None
    schema = StructType([*docs.schema.fields, StructField(names[0], StringType()), StructField(names[1], DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, text_col, 1 << 19, 2048):
            vectors, has = bundles(batch.column(text_col).to_pylist(), n, dimension, seed)
            best, value = np.full(len(has), UNDETERMINED, object), np.zeros(len(has))
            if model is not None:
                cosines = unit(vectors) @ model.T
                at = cosines.argmax(axis=1)
                best[has] = known[at[has]]
                value[has] = np.clip(cosines[np.arange(len(has)), at][has], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.tolist(), pa.string()), pa.array(value)], [*batch.schema.names, *names])

    return docs.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> Column:
    """Rows of one fold by the CRC-32 of the id as text; a null id is held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(True))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how: int) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learnt from the rows that are not held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).withColumn("held_out", held_out())
    prototypes = fit(rows.where(~F.col("held_out")), **how)
    how.pop("train_rows", None)
    return predict(rows.select("doc_id", "held_out", "text"), prototypes, **how).drop("text")
