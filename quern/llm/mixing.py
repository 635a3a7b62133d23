"""Soft-membership mixing to target weights, in DataFrame functions only.

A classifier learnt from a labelled table gives each document a posterior over domains; a document's rate
(expected copies) is fitted so that the expected tokens of every domain, the sum of rate x tokens x
posterior, match the targets.

Classifier: Bernoulli naive Bayes over the distinct tokens of a text (runs of letters in lower case, of digits,
and of other signs; 64-bit hashes; absence counts too). Frequencies are smoothed towards the overall ones.
No token is shut out by a threshold; its log ratios are shrunk by how sure they are: z^4 / (z^4 + c^4), where z is
how far its counts are from what the domains' shares predict and c is ``SURE`` (more where there are more than
``SURE_ROWS`` training rows, since more tokens then stand out by chance), times r^8 / (r^8 + RATIO^8), where r is
the largest ratio of its frequency in a domain to the overall one (what a language brings along is not a
domain's). Of more than ``features`` tokens those of the largest shrunk z are used. It is learnt from at most about
``train_rows`` labelled rows (by a hash of the id; all where there are fewer); copies of a text count once.
The weights are one constant of bounded size.

Fit: projected gradient descent on half the squared error of the domain totals, measured in the inverse Gram
matrix of the posteriors, in the metric in which a document weighs its tokens (there the step size 1 is right),
projected on 0 <= rate <= ``most``. A document's rate is a function of its posterior and of the steps, so the
fit adds up documents by cells of their posteriors first (``CELLS`` to an axis, each with its tokens and its
tokens per domain: a table of bounded size whatever the input's), and an iteration is one pass over the cells.
The best step is kept. Rates then come from each document's own posterior, and one pass over all documents adds
up what they give: the result has expected less target tokens per domain (miss_high, miss_low, miss_toxic, the
same in every row), and misses beyond ``tolerance`` are logged as a warning. Rates have no upper bound unless
the caller sets one.

Copies: the whole part of the rate, and one more with the fraction's probability by a hash of the id.

Defined results: null text: no tokens, the prior as posterior. Labels that are null, or whose document is
missing: unused; several labels of one document: the worst (toxic, then low). No labels: the posterior is
uniform. Targets that no rates of 0 to ``most`` meet (of a domain without tokens, or smaller than what
documents of mixed posteriors bring along): the nearest rates found, and the misses. Null or repeated ids:
a row each. Empty table: empty result. Extra columns are ignored, whatever their names; texts are read whole.
"""

from __future__ import annotations

import json
import logging
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.storage import write_table

DOMAINS = ("high", "low", "toxic")
SLOTS, FEATURES, SURE, SURE_ROWS, RATIO, SMOOTHING, CELLS = 1 << 12, 4096, 6.0, 2500, 3.0, 1.0, 256
#: Stands in every training text, so its counts are the numbers of texts.
MARK = "\0"


def domain_of(quality: Column, toxic: Column) -> Column:
    """The number of the domain that a label row stands for; larger is worse."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def tokens(text: Column) -> Column:
    """The distinct tokens of a text: runs of letters, of digits, of other signs."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+|\p{N}+|[^\p{L}\p{N}\x09-\x0D\x20]+"), F.lit(0)))


def said(table: Column, word: Column) -> Column:
    """The weights of a word, or null."""
    h = F.xxhash64(word)
    return F.get(F.filter(F.get(table, F.pmod(h, F.lit(SLOTS)).cast("int")), lambda e: e["h"] == h), F.lit(0))


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, train_rows: int, features: int = FEATURES) -> tuple[Column, dict[str, float]]:
    """The weights of tokens as a constant, and the scores of a text without any of them; the driver gets ``features`` rows at most."""
    known = labels.select(F.col("doc_id").alias("id"), domain_of(F.col("quality"), F.col("toxic")).alias("domain")).where("id is not null and domain is not null").groupBy("id").agg(F.max("domain").alias("domain"))
    total = known.count()
    share = min(1.0, train_rows / max(total, 1))
    if share < 1:
        known = known.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about train_rows rows of 12 bytes, whatever the input's size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")
    # copies of one text are one witness
    rows = rows.groupBy("domain", F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))).agg(F.min(F.struct("id", "text")).alias("x")).select("domain", "x.text")
    each = rows.select("domain", F.explode(F.array_append(tokens(F.col("text")), MARK)).alias("w")).select("domain", F.xxhash64("w").alias("h"))
    counts = write_table(each.groupBy("h").agg(*(F.count_if(F.col("domain") == k).alias(f"c{k}") for k in range(len(DOMAINS)))), "words")
    n = counts.where(F.col("h") == F.xxhash64(F.lit(MARK))).first() or [0, 0, 0, 0]
    n = np.asarray([n[f"c{k}"] if hasattr(n, "h") else 0 for k in range(len(DOMAINS))], float)
    everything, prior = max(n.sum(), 1.0), np.log((n + 1) / (n.sum() + len(DOMAINS)))
    here = sum((F.col(f"c{k}") for k in range(len(DOMAINS))), F.lit(0))
    overall = F.least(F.lit(0.999), here / float(everything))
    far, often, logs = [], [], []
    for k in range(len(DOMAINS)):
        expected = here * float(n[k] / everything)
        far.append(F.abs(F.col(f"c{k}") - expected) / F.sqrt(expected + 1))
        p = F.least(F.lit(0.999), (F.col(f"c{k}") + SMOOTHING * overall) / float(n[k] + SMOOTHING))
        often.append(p / overall)
        logs.append(F.struct((F.log(p / overall) * F.col("sure")).alias("there"), (F.log((1 - p) / (1 - overall)) * F.col("sure")).alias("absent")).alias(DOMAINS[k]))
    c = SURE * max(1.0, float(everything / SURE_ROWS) ** (1 / 3))
    z, r = F.pow(F.greatest(*far), 4.0), F.pow(F.greatest(*often), 8.0)
    sure = z / (z + c**4) * r / (r + RATIO**8)
    chosen = counts.where(F.col("h") != F.xxhash64(F.lit(MARK))).withColumn("sure", sure).withColumn("z", F.greatest(*far) * F.col("sure")).where("z > 0").orderBy(F.desc("z"), "h").limit(features)
    base = {d: float(x) for d, x in zip(DOMAINS, prior, strict=True)}
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for r in chosen.select("h", *logs).collect():
        slots[r.h % SLOTS].append({"h": r.h} | {d: r[d].there - r[d].absent for d in DOMAINS})
        for d in DOMAINS:
            base[d] += r[d].absent
    return F.from_json(F.lit(json.dumps(slots)), f"array<array<struct<h:bigint,{','.join(f'{d}:double' for d in DOMAINS)}>>>"), base


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = 20_000, keep: tuple[str, ...] = (), features: int = FEATURES) -> DataFrame:
    """doc_id, n_tokens, p (one posterior per domain, in the order of DOMAINS) and the columns ``keep``."""
    table, base = learn(docs, labels, id_col, text_col, train_rows, features)
    heard = F.filter(F.transform("tokens", lambda w: said(table, w)), lambda x: x.isNotNull())
    zero = F.struct(*(F.lit(base[d]).alias(d) for d in DOMAINS))
    total = F.aggregate(heard, zero, lambda a, w: F.struct(*((a[d] + w[d]).alias(d) for d in DOMAINS)))
    rows = docs.select(F.col(id_col).alias("doc_id"), n_words(F.col(text_col)).alias("n_tokens"), tokens(F.col(text_col)).alias("tokens"), *keep).select("doc_id", "n_tokens", total.alias("s"), *keep)
    top = F.greatest(*(F.col("s")[d] for d in DOMAINS))
    raised = [F.exp(F.col("s")[d] - top) for d in DOMAINS]
    rows = rows.select("doc_id", "n_tokens", F.array(*raised).alias("e"), *keep)
    return rows.select("doc_id", "n_tokens", F.transform("e", lambda x: x / sum((F.get("e", F.lit(k)) for k in range(len(DOMAINS))), F.lit(0.0))).alias("p"), *keep)


def cells(rows: DataFrame) -> DataFrame:
    """Documents added up by cells of their posteriors: n_tokens and p (the tokens' mean posterior). At most about CELLS**2 / 2 rows."""
    some = range(len(DOMAINS))
    cell = [F.round(F.get("p", F.lit(k)) * CELLS).cast("int").alias(f"cell{k}") for k in some]
    sums = rows.groupBy(*cell).agg(F.sum("n_tokens").alias("n_tokens"), *(F.sum(F.col("n_tokens") * F.get("p", F.lit(k))).alias(f"m{k}") for k in some)).where("n_tokens > 0")
    return sums.select("n_tokens", F.array(*(F.col(f"m{k}") / F.col("n_tokens") for k in some)).alias("p"))


def expected_totals(rows: DataFrame, rate: Column | float = 1.0) -> list[float]:
    """Expected tokens per domain at these rates."""
    rate = rate if isinstance(rate, Column) else F.lit(rate)
    out = rows.agg(*(F.coalesce(F.sum(rate * F.col("n_tokens") * F.get("p", F.lit(k))), F.lit(0.0)).alias(d) for k, d in enumerate(DOMAINS))).first()
    return [float(x) for x in out]


def rate_of(steps: list[list[float]], most: float) -> Column:
    """The rate after these steps from 1: each subtracts posterior . step and projects on [0, most]."""
    moves = F.array(*(F.array(*map(F.lit, s)) for s in steps)) if steps else F.array().cast("array<array<double>>")
    dot = lambda s: sum((F.get("p", F.lit(k)) * F.get(s, F.lit(k)) for k in range(len(DOMAINS))), F.lit(0.0))
    return F.aggregate(moves, F.lit(1.0), lambda r, s: F.least(F.lit(float(most)), F.greatest(F.lit(0.0), r - dot(s))))


def fit(rows: DataFrame, targets: list[float], most: float = math.inf, iterations: int = 24, tolerance: float = 1e-4) -> list[list[float]]:
    """Steps of the projected gradient for the targets (tokens per domain), up to the best one."""
    k = len(DOMAINS)
    gram = rows.agg(*(F.coalesce(F.sum(F.col("n_tokens") * F.get("p", F.lit(i)) * F.get("p", F.lit(j))), F.lit(0.0)).alias(f"g{i}{j}") for i in range(k) for j in range(k))).first()
    inverse = np.linalg.pinv(np.asarray([float(x) for x in gram]).reshape(k, k), rcond=1e-9, hermitian=True)
    target, steps, best, kept = np.asarray(targets, float), [], np.inf, 0
    for done in range(iterations + 1):
        error = np.asarray(expected_totals(rows, rate_of(steps, most))) - target
        size = float(np.abs(error).max()) / max(float(np.abs(target).max()), 1.0)
        if size < 0.99 * best:
            best, kept = size, done
        if size <= tolerance or done - kept >= 4:
            break
        steps.append((inverse @ error).tolist())
    return steps[:kept]


def copies_of(rate: Column, id_col: str = "doc_id", seed: int = 3) -> Column:
    """Whole copies: the whole part of the rate, and one more with the probability of its fraction."""
    u = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate) + F.when(u < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix_to_targets(docs: DataFrame, labels: DataFrame, weights: dict[str, float], budget: float = 1.0, relative: bool = False, most: float = math.inf, train_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), tolerance: float = 1e-3) -> DataFrame:
    """One row per document: doc_id, n_tokens, p_high, p_low, p_toxic, rate, miss_high, miss_low, miss_toxic, copies (and ``keep``).

    weights: share of each domain in ``budget`` x all tokens; if relative, factors of the domains' present totals.
    """
    rows = write_table(posteriors(docs, labels, id_col, text_col, train_rows, keep), "posteriors")
    grouped = write_table(cells(rows), "cells")
    now = expected_totals(rows)
    share = np.asarray([weights.get(d, 0.0) for d in DOMAINS])
    targets = share * now if relative else share / share.sum() * budget * sum(now)
    rate = rate_of(fit(grouped, targets.tolist(), most), most)
    miss = np.asarray(expected_totals(rows, rate)) - targets
    if np.abs(miss).max() > tolerance * max(float(np.abs(targets).max()), 1.0):
        left = ", ".join(f"{d} {e:+.1f} of {t:.1f}" for d, e, t in zip(DOMAINS, miss, targets, strict=True))
        logging.getLogger(__name__).warning("targets not met; expected tokens less the target: %s", left)
    missed = [F.lit(float(m)).alias(f"miss_{d}") for d, m in zip(DOMAINS, miss, strict=True)]
    out = rows.select("doc_id", "n_tokens", *(F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(DOMAINS)), rate.alias("rate"), *missed, *keep)
    return out.withColumn("copies", copies_of(F.col("rate")))
