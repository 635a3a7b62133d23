"""op5's targets where a domain is rare."""

import logging
import random

import pytest

from quern.llm import mixing, queries

WEIGHTS = {"high": 0.8, "low": 0.18, "toxic": 0.02}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """5 % of the tokens are of the domain high: 0.8 x 0.9 of all tokens takes rates of 14."""
    r, out = random.Random(4), tmp_path_factory.mktemp("rare")
    names = {0: "calm bright river garden music", 1: "click buy offer cheap deal", 2: "vile awful nasty hateful cruel"}
    of = [0 if i % 20 == 0 else 2 if i % 20 < 4 else 1 for i in range(1000)]
    docs = [(i, " ".join([*r.sample(names[d].split(), 4), *(f"w{r.randrange(40)}" for _ in range(16))])) for i, d in enumerate(of)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{out}/documents.parquet")
    labels = [(i, int(d == 0), int(d == 2)) for i, d in enumerate(of)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_rare_domains_reach_their_targets(spark, folder):
    got = queries.QUERIES["op5_mixing"](spark, folder).collect()
    tokens = sum(r.n_tokens for r in got)
    for d, share in WEIGHTS.items():
        assert sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in got) == pytest.approx(share * 0.9 * tokens, abs=2e-4 * tokens)
    assert max(r.rate for r in got) > 8 and all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)


def test_unmet_targets_are_told(spark, folder, caplog):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    with caplog.at_level(logging.WARNING, "quern.llm.mixing"):
        mixing.mix_to_targets(docs, labels, WEIGHTS, budget=0.9, most=8.0)
    assert "high -" in caplog.text
    caplog.clear()
    with caplog.at_level(logging.WARNING, "quern.llm.mixing"):
        mixing.mix_to_targets(docs, labels, WEIGHTS, budget=0.9)
    assert not caplog.text
