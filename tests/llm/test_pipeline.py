"""The pipeline's stages against brute force on rows that an own generator makes."""

import random
import re

import pytest

import corpus_pipeline

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def written(spark, folder, rows, name="documents", schema=DOCS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shingles(text, k=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))}


def near_kept(texts):
    """Positions that stay, from (id, text): of each component of pairs of Jaccard >= 0.8 the smallest id."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, s in enumerate(sets):
        for b, t in enumerate(sets[:a]):
            small, large = sorted((len(s), len(t)))
            if find(a) != find(b) and 5 * small >= 4 * large and (s == t or 5 * (same := len(s & t)) >= 4 * (len(s) + len(t) - same)):
                root[find(a)] = find(b)
    least: dict = {}
    for a, (i, _) in enumerate(texts):
        least.setdefault(find(a), []).append((i is None, i or 0, a))
    return sorted(min(x)[2] for x in least.values())


def near_texts():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))

    def edited(words, n):
        out = list(words)
        for at in r.sample(range(len(out)), n):
            out[at] = word()
        return out

    out = []
    for _ in range(40):  # 1 to 9 edits of 200 words: similarities from 0.95 down to 0.6
        base = [word() for _ in range(200)]
        out += [base, *(edited(base, n) for n in r.sample(range(1, 10), 2))]
    chain = [word() for _ in range(300)]
    for _ in range(6):
        out.append(chain := edited(chain, 4))
    crowd = [word() for _ in range(120)]
    out += [edited(crowd, r.randint(1, 4)) for _ in range(300)]  # one large group, dealt out in tiles
    out += [[word() for _ in range(130)] for _ in range(400)]
    out += [base[:170], base[:120], base + base[:20], [word()], ["one", "two"], ["one", "two"], ["ONE", "two"]]
    texts = [" ".join(w) for w in out] + [" ".join(out[0]).replace(" ", "\n  "), " ".join(out[3]).upper()]
    ids = r.sample(range(5000), len(texts))
    ids[1] = ids[4] = None
    return list(zip(ids, texts, strict=True))


def test_near_stage_against_all_pairs(spark, tmp_path):
    texts = near_texts()
    docs = written(spark, tmp_path, [(i, t, "en", "s", len(t)) for i, t in texts])
    got = corpus_pipeline.near(spark, docs, str(tmp_path)).collect()
    kept = near_kept(texts)
    assert len(kept) < len(texts) - 100
    assert sorted(r.text for r in got) == sorted(texts[a][1] for a in kept)


def test_language_stage_without_training_rows(spark, tmp_path):
    docs = written(spark, tmp_path, [(i, f"a text {i}", None, "s", 8) for i in range(9)])
    assert corpus_pipeline.language(spark, docs, str(tmp_path)).count() == 9


def test_final_rows_of_run(spark, tmp_path):
    """Known truth: toxic documents, exact and near copies and texts without letters go, all others stay."""
    r = random.Random(4)
    marks = ["good fine clear".split(), "SPAM!! junk|| zz".split(), "vile nasty".split()]
    of = [[0, 0, 0, 1, 2][i % 5] for i in range(600)]
    texts = [" ".join(f"w{r.randrange(3000)}" for _ in range(r.randint(40, 80))) + " " + " ".join(r.sample(marks[d], 2)) for d in of]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    labels = [(i, int(d != 1), int(d == 2)) for i, d in enumerate(of) if i % 2]
    rows += [(1000 + i, texts[i].upper(), "en", "s", 1) for i in range(0, 50, 5)]  # the largest id of equal texts stays
    rows += [(2000 + i, texts[i] + " end", "en", "s", 1) for i in range(1, 51, 5)]  # the smallest of near copies
    rows += [(3000, "12 34", "en", "s", 5)]
    written(spark, tmp_path, rows)
    written(spark, tmp_path, labels, "labels", "doc_id long, quality int, toxic int")
    got = sorted(x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = {i for i, d in enumerate(of) if d != 2} - set(range(0, 50, 5)) | {1000 + i for i in range(0, 50, 5)}
    assert got == sorted(want)


def test_stages_of_an_empty_table(spark, tmp_path):
    written(spark, tmp_path, [])
    written(spark, tmp_path, [], "labels", "doc_id long, quality int, toxic int")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_hash_minima():
    """Sets of similarity s share each minimum with probability s; texts without shingles have none."""
    import numpy as np

    from quern.llm import simhash

    rng = np.random.default_rng(3)
    agree = []
    for _ in range(200):
        common, own = rng.integers(0, 1 << 63, 80, dtype=np.uint64), rng.integers(0, 1 << 63, 20, dtype=np.uint64)
        hashes = np.concatenate([common, own[:10], common, own[10:]])
        got = np.stack(simhash.minima(hashes, np.array([90, 0, 90])), axis=1)
        assert (got[1] == (1 << 64) - 1).all()
        agree.append((got[0] == got[2]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.05 and min(agree) > 0


def test_the_walk_of_long_fingerprints():
    """128 bits: with errors limited in the first bits, each link within that limit is found once, and nothing beyond the budget."""
    from collections import Counter

    import numpy as np

    from quern.llm import simhash

    r = random.Random(5)
    values = set()
    for _ in range(60):
        base = r.getrandbits(128)
        values |= {base} | {base ^ sum(1 << x for x in r.sample(range(128), r.randint(1, 25))) for _ in range(6)}
    values = sorted(values)
    n, words, tally = len(values), np.array([[v >> 64 for v in values], [v & ((1 << 64) - 1) for v in values]], np.uint64), Counter()
    got = [p for i, j in simhash.trie_links(words, np.array([[0], [n], [0], [n]]), 32, 100, tally, (15, 2)) for p in zip(i.tolist(), j.tolist(), strict=True)]
    far = lambda i, j, bits=128: ((values[i] ^ values[j]) >> (128 - bits)).bit_count()
    want = {(i, j) for i in range(n) for j in range(i + 1, n) if far(i, j) <= 32 and far(i, j, 15) <= 2}
    assert len(got) == len(set(got)) and want <= set(got) and all(far(i, j) <= 32 for i, j in got)
    assert len(want) > 500 and tally["leaves"] < 0.2 * n * (n - 1) / 2


@pytest.mark.parametrize("trie", [1 << 15, 40])
def test_near_pairs_come_from_tries_of_fingerprints(spark, trie):
    """Pairs at exactly 0.8 are proposed from their fingerprints alone, also the smallest sets and in tiles; others hardly ever."""
    import numpy as np

    from quern.llm import simhash

    rng = np.random.default_rng(11)
    many = max(2, -(-simhash.tries(800, 0.8)[1] // 3))
    rows = []
    for k in range(400):
        common = rng.integers(0, 1 << 63, 4 if k % 2 else 80, dtype=np.uint64)
        extra = rng.integers(0, 1 << 63, 1 if k % 2 else 20, dtype=np.uint64)
        sets = [common, np.concatenate([common, extra])] if k % 2 else [np.concatenate([common, extra[:10]]), np.concatenate([common, extra[10:]])]
        for side, s in enumerate(sets):
            words = np.array(simhash.words_of(s, np.array([len(s)]), many)).ravel().view(np.int64)
            rows.append((2 * k + side, [int(x) for x in words]))
    nodes = spark.createDataFrame(rows, "node long, words array<long>")
    of = {x.node: x.component for x in simhash.components(simhash.proposed(nodes, len(rows), 0.8, trie=trie)).collect()}
    assert sum(of.get(2 * k) is None or of.get(2 * k) != of.get(2 * k + 1) for k in range(400)) <= 1
    assert len(set(of.values())) >= 395
