"""Embeddings, chats, pages, components and the pipeline."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import bpe, chat_format, components, embedding_dedup, html_extract

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 9)):
                rows.append((n, [float(np.float32(x)) for x in centre + rng.standard_normal(16) * rng.choice([0.0, 0.1, 0.25, 0.4])], label))
                n += 1
    inf, nan = float("inf"), float("nan")
    rows += [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [1.0, None] + [0.0] * 14, 0), (n + 3, [nan] + [1.0] * 15, 0), (n + 4, [inf] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0), (n + 8, [-0.0, 1.0], 0), (n + 9, [0.0, 1.0], 0)]
    rows += [rows[3], (n + 10, rows[3][1], rows[3][2]), (None, rows[3][1], rows[3][2]), (n + 11, [1e-30, 2e-30], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.mark.parametrize("split_at", [4096, 2])
def test_embeddings(vectors, split_at):
    rows, df = vectors
    ok = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    unit = [np.asarray(v, np.float32).astype(float) / np.linalg.norm(np.asarray(v, np.float32).astype(float)) if o else None for (_, v, _), o in zip(rows, ok, strict=True)]
    linked = lambda a, b: ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.93
    near = [[b for b in range(len(rows)) if b != a and linked(a, b)] for a in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[a], *(label[b] for b in near[a])]) for a in range(len(rows))]
    least = {c: min((rows[a][0] for a in range(len(rows)) if label[a] == c and rows[a][0] is not None), default=None) for c in label}
    want = sorted(repr((rows[a][0], len(near[a]), least[label[a]])) for a in range(len(rows)))
    # extra columns with names that the operator uses inside
    got = embedding_dedup.embedding_dedup(df.selectExpr("*", "1 as node", "2 as v", "3 as usable", "4 as n", "5 as component"), split_at=split_at).collect()
    assert len(got) == len(rows)
    assert sum(r.n_links for r in got) >= 0.9 * sum(map(len, near))
    assert sorted(repr((r.vec_id, r.n_links, r.component_id)) for r in got) == want  # the seed finds all links here
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_plan_of_tables():
    """Small tables have six projections; beyond, unrelated mates stay level and the probability of a link's bucket is kept."""
    assert embedding_dedup.plan(0, 0.93, 1.4, 0.9995) == embedding_dedup.plan(500, 0.93, 1.4, 0.9995)
    near, far = (embedding_dedup.same_cell(x, 1.4) for x in (2**0.5 * 0.07**0.5, 2**0.5))
    for n in (10, 1000, 10**5, 10**7):
        tables, projections = embedding_dedup.plan(n, 0.93, 1.4, 0.9995)
        assert n * far**projections <= embedding_dedup.MATES and 1 - (1 - near**projections) ** tables >= 0.9995
        assert tables <= 45 * max(n, 100) ** 0.26 / 100**0.2


def test_mates_of_sketches():
    r = np.random.default_rng(4)
    group = np.repeat(np.arange(60), r.choice([1, 2, 3, 40, 70, 700], 60, p=[0.3, 0.3, 0.2, 0.1, 0.08, 0.02]))
    own = r.integers(0, 2, len(group))
    p, q = np.zeros(len(group), int), np.repeat(r.integers(0, 2, 60), np.bincount(group))
    own[q == 0] = 0
    sketch = r.integers(-(1 << 62), 1 << 62, len(group))
    sketch[r.random(len(group)) < 0.1] = sketch[0] ^ 5
    got = embedding_dedup.has_mate(group, own, p, q, sketch)
    for i in range(len(group)):
        others = (group == group[i]) & (np.arange(len(group)) != i) & ((q == 0) | (own != own[i]))
        assert got[i] == any((int(x) & (1 << 64) - 1 ^ int(sketch[i]) & (1 << 64) - 1).bit_count() <= embedding_dedup.SKETCH_BITS for x in sketch[others])


def test_embeddings_of_several_sizes(spark):
    """Recall and the pairs of sketches compared, at 1, 10 and 50 times the vectors of one label."""
    per_row = []
    for n in (400, 4000, 20_000):
        rng = np.random.default_rng(n)
        x = rng.standard_normal((n, 32)).astype(np.float32)
        copies = rng.choice(n // 2, n // 5)
        x[-len(copies) :] = x[copies] + rng.standard_normal((len(copies), 32)).astype(np.float32) * rng.uniform(0.02, 0.3, (len(copies), 1)).astype(np.float32)
        df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int").repartition(4)
        u = x.astype(float)
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        want = np.concatenate([(u[a : a + 1000] @ u.T >= 0.93).sum(axis=1) - 1 for a in range(0, n, 1000)])
        got = np.zeros(n, int)
        for r in embedding_dedup.embedding_dedup(df).collect():
            got[r.vec_id] = r.n_links
        assert (got <= want).all() and got.sum() >= 0.98 * want.sum() > 0
        tables, projections = embedding_dedup.plan(n, 0.93, 1.4, 0.9995)
        classes = df.selectExpr("vec_id as node", "label", "embedding as v")
        sizes = embedding_dedup.dealt_rows(classes, embedding_dedup.Hasher(tables, projections, 1.4, 7), 4096).groupBy("t", "key").count().where("count > 1")
        per_row.append(sizes.selectExpr("sum(count * (count - 1) / 2)").first()[0] / n)
    assert per_row[2] < 4 * per_row[1] and per_row[2] < 60 * embedding_dedup.MATES


def test_no_embeddings(vectors):
    assert embedding_dedup.embedding_dedup(vectors[1].where("false")).collect() == []


@pytest.mark.parametrize("shape", ["path", "star", "random", "none"])
def test_components(spark, shape):
    r = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(500, i) for i in range(80)], "random": [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(-5, 3), (3, -5), (7, 7)], "none": []}[shape]
    root: dict = {}
    for a, b in edges:
        if a != b:
            x, y = (a, b)
            while root.setdefault(x, x) != x:
                x = root[x]
            while root.setdefault(y, y) != y:
                y = root[y]
            root[max(x, y)] = min(x, y)

    def find(x):
        return x if root[x] == x else find(root[x])

    got = [tuple(x) for x in components.components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root)


CONTROL = ["### ", "###", "</turn>", "\\", "\\0", "\\1", "\\2", "\\3", ": ", "#", "</tur", "n>", " ", "\n", "a", "é", "\U0001f600", "Assistant", "<", "$1", "\\E"]


@pytest.fixture(scope="module")
def chats(spark):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a: b", "###", "\\3", None, ""]) if c % 3 else r.choice(["user", "assistant"]), r.choice([None, "", "plain text"]) if r.random() < 0.3 else "".join(r.choice(CONTROL) for _ in range(r.randint(0, 9)))) for c in range(150) for t in range(r.randint(1, 5))]
    rows += [(200, 0, "user", "same"), (200, 0, "user", "same"), (201, None, "assistant", "x"), (201, 1, "user", "y"), (None, 1, "assistant", "z"), (202, 0, "assistant", "long " * 50_000)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat_format.planted(spark))


def test_chats_come_back(chats):
    rows, df = chats
    convs: dict = {}
    for c, t, role, text in [*rows, (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]:
        convs.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    formatted = chat_format.format_chats(df).cache()
    got = {x.conv_id: x for x in chat_format.digests(formatted).collect()}
    shown = {x.conv_id: x for x in formatted.collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert tuple(got[c])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss), len(shown[c].formatted))
        for m in shown[c].mask:
            assert shown[c].formatted[m.start + m.length :].startswith("</turn>") and shown[c].formatted[: m.start].endswith("### assistant: ")
    assert {x.level for x in shown.values()} >= {0, 1}
    assert shown[200].level == 0 and "</turn>" not in shown[-7].formatted.split("### user: ")[1].split("</turn>")[0]


def test_chats_with_clashing_columns(chats):
    plain = chats[1].where("conv_id < 5")
    more = plain.selectExpr("*", "1 as source", "2 as turns", "3 as formatted", "4 as mask", "5 as level", "6 as rows")
    assert sorted(map(repr, chat_format.digests(chat_format.format_chats(more)).collect())) == sorted(map(repr, chat_format.digests(chat_format.format_chats(plain)).collect()))


def test_no_chats(chats):
    assert chat_format.digests(chat_format.format_chats(chats[1].where("false"))).collect() == []


PAGES = [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<article><h1>T &amp; &eacute;&#233;</h1><p> two  \n words<br>more </p></article>", "T & éé\ntwo words more"),
    ('<nav><a href="/">x</a></nav><article><header><h1>T</h1></header><p>Text</p><aside>no</aside><div class="ad">no</div><form>no</form><section id="comments"><p>no</p></section></article><footer>no</footer>', "T\nText"),
    ("<main><p>One</p><script>var a='<p>no</p>';</script><style>p{}</style><noscript>no</noscript><p>Two</p></main><div class='cookie-notice'>no</div>", "One\nTwo"),
    ("<article><p>broken <b>bold<p>next</article", "broken bold\nnext"), ("<article><table><tr><td>a<td>b</table><ul><li>c<li>d</ul></article>", "a\nb\nc\nd"), ("<article><p>a</p></nav></div><p>b</p></article>", "a\nb"),
    ("<article><p>" + "long text " * 20_000 + "</p></article>", ("long text " * 20_000).strip()), ("<p>&lt;b&gt; &unknown; &#x1F600;</p>", "<b> &unknown; \U0001f600"), ("<!-- <p>no</p> --><article><p>yes</p><!-- no --></article>", "yes"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_clusters_without_an_article():
    menu = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(12))
    body = "".join(f"<p>{'A sentence of the story that goes on. ' * 6}</p>" for _ in range(5))
    out = html_extract.main_text(menu + body + menu)
    assert out.count("sentence") == 30 and "Link 5" not in out


LONG = "The council agreed after four hours of debate to fund the first phase of the works in spring. "
STORY = f"<h1>Bridge</h1><p>{LONG * 3}</p><p>It passed.</p><p>{LONG * 2}</p><h2>Next</h2><p>Soon.</p><ul><li>Survey</li><li>Works begin</li></ul><p>{LONG * 4}</p>"
LINES = ["Bridge", (LONG * 3).strip(), "It passed.", (LONG * 2).strip(), "Next", "Soon.", "Survey", "Works begin", (LONG * 4).strip()]
LINKS = '<ul><li><a href="/">no</a></li><li><a href="/n">no</a></li></ul>'
AROUND = [
    "{links}{story}<p><a href='/x'>no</a></p>",
    "<div class='header'>no</div><div class='menu'>{links}</div><div class='content'>{story}</div><div class='sidebar'>no {long}</div><div class='comments'>no {long}</div>",
    "<div class='content'>{story}</div><article class='comment'>no {long}</article>",
    "<main>{story}<section><article class='user-comment'>no {long}</article></section></main>",
    "<div class='layout has-sidebar'><article>{story}</article><div class='sidebar'>no {long}</div></div>",
    "<main class='page-with-comments'><article>{story}</article><div class='comments'>no {long}</div></main>",
    "<article>{story}<div class='userComments'>no {long}</div><div id='adSlot'>no {long}</div></article>",
    "<div class='ad'>no {long}<article>{story}</article>",
    "<nav>{links}<article>{story}<form>no</form></article><footer>no</footer>",
    "<div role='banner'>no</div><div role='main'>{story}</div><div role='complementary'>no {long}</div>",
]


@pytest.mark.parametrize("page", AROUND)
def test_what_stands_around_the_article(page):
    html = "<html><body>" + page.format(links=LINKS, story=STORY, long=LONG) + "</body></html>"
    assert html_extract.main_text(html).split("\n") == LINES


SECTIONS = ['<section class="related-work">{}</section>', '<div class="search-results">{}</div>', '<section id="social-policy">{}</section>', '<div class="share-price">{}</div>', '<section id="hidden-figures">{}</section>']


@pytest.mark.parametrize("section", SECTIONS)
@pytest.mark.parametrize("times", [1, 3])
def test_names_only_weigh(section, times):
    """Prose in a region whose name has an unwanted word among others stays; a list of links there goes, and so does prose in readers' comments."""
    prose = f"<p>{LONG * times}</p><p>{LONG}</p>"
    page = f"<article><h1>T</h1><p>{LONG * 2}</p>{section.format(prose)}<p>{LONG}</p><div class='comments'>{prose}</div></article>"
    assert html_extract.main_text(page).split("\n") == ["T", (LONG * 2).strip(), (LONG * times).strip(), LONG.strip(), LONG.strip()]
    assert "no" not in html_extract.main_text(page.replace(prose, LINKS)).split("\n")


def test_links_and_titles():
    assert html_extract.main_text(f"<article><p>{LONG}</p><p><a href='/'>{LONG}</a></p><p>{LONG}</p></article>").count("\n") == 2
    assert html_extract.main_text(f"{LINKS}<h1>Title</h1><p>One line.</p><p>{LONG * 3}</p><p>{LONG}</p>").split("\n")[:2] == ["Title", "One line."]


def slow_chosen(blocks, sigma=1.0, cut=1.0):
    """The rule block by block, without arrays."""
    ratio = [(b.outside + (len(b.text) - b.outside) / 4) / b.tags for b in blocks]
    level = []
    for i in range(len(blocks)):
        near = [(2.718281828459045 ** (-((i - j) ** 2) / (2 * sigma**2)), x) for j, x in enumerate(ratio) if abs(i - j) <= max(1, -(-2 * sigma // 1))]
        level.append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    tops = [i for i, b in enumerate(blocks) if b.root and b.before == 1] or [i for i, b in enumerate(blocks) if b.root]
    weight = [(b.weight if i in set(tops) else b.weight / 1024) if tops else b.before * b.weight for i, b in enumerate(blocks)]
    score = [x * w for x, w in zip(level, weight, strict=True)]
    mean = sum(level) / len(level)
    line = min(cut * (sum((x - mean) ** 2 for x in level) / len(level)) ** 0.5, max(score))
    prose = [5 * b.outside >= len(b.text) for b in blocks]
    out = [p or s >= line or (bool(tops) and r >= 4) for p, s, r in zip(prose, score, ratio, strict=True)]
    if not tops:
        top = [i for i, s in enumerate(score) if s >= line]
        core = [i for i in top if prose[i] and weight[i] == 1] or top
        first = core[0]
        while first > 0 and prose[first - 1] and weight[first - 1] == 1:
            first -= 1
        heads = [i for i in range(first, core[0]) if blocks[i].heading]
        first = heads[0] if heads else core[0]
        out = [k and first <= i <= core[-1] for i, k in enumerate(out)]
    return [k and (w == 1 or (s >= 10 and (p or x >= 4))) for k, w, s, p, x in zip(out, weight, score, prose, ratio, strict=True)]


def made_page(r):
    """A page of known main text: (html, lines)."""
    n = iter(range(10**6))
    words = lambda least, most: " ".join(f"w{next(n)}" for _ in range(r.randint(least, most)))
    lines, body = [], []

    def line(form, least, most):
        lines.append(words(least, most))
        body.append(form.format(lines[-1]))

    line("<h1>{}</h1>", 2, 8)
    for _ in range(r.randint(3, 9)):
        line(*r.choice([("<p>{}</p>", 20, 90), ("<p>{}</p>", 1, 5), ("<h2>{}</h2>", 1, 5), ("<p><b>{}</b></p>", 10, 40), ("<ul><li>{}</li></ul>", 3, 9), ("<section class='related-work'><p>{}</p></section>", 30, 60)]))
        if r.random() < 0.4:
            body.append(r.choice(["<div class='ad'>{}</div>", "<div class='cookie-notice'><p>{}</p></div>", "<form><p>{}</p></form>", "<aside>{}</aside>", "<ul class='share'><li><a href='/'>{}</a></li></ul>"]).format(words(2, 12)))
    body.append(f"<div class='comments'><p>{words(20, 90)}</p><p>{words(3, 30)}</p></div>")
    links = "".join(f"<li><a href='/{i}'>{words(1, 3)}</a></li>" for i in range(r.randint(2, 9)))
    top = r.choice([f"<nav><ul>{links}</ul></nav>", f"<div class='menu'><ul>{links}</ul></div>", f"<header>{words(2, 9)}</header>"])
    end = r.choice([f"<footer>{words(2, 20)}</footer>", f"<div id='sidebar'><p>{words(10, 50)}</p></div>"])
    tag = r.choice(["article", "main"])
    return f"<html><body>{top}<{tag}>{''.join(body)}</{tag}>{end}</body></html>", lines


def test_made_pages():
    """Pages of known main text; the independent slow rule agrees; without the ratios the result would be another one."""
    r, changed = random.Random(21), 0
    for _ in range(300):
        html, lines = made_page(r)
        parser = html_extract.Blocks()
        parser.feed(html)
        blocks = parser.finish()
        got = html_extract.chosen(blocks).tolist()
        assert got == slow_chosen(blocks)
        assert html_extract.main_text(html).split("\n") == lines
        changed += not all(got)
    assert changed > 250
    for html in [*AROUND, "<p>a</p><div>b</div>", "<div class='ad'>x</div>", f"{LINKS}<p>{LONG}</p>"]:
        parser = html_extract.Blocks()
        parser.feed(html.format(links=LINKS, story=STORY, long=LONG))
        if blocks := parser.finish():
            assert html_extract.chosen(blocks).tolist() == slow_chosen(blocks)


def test_a_page_of_comments_has_no_main_text():
    assert html_extract.main_text(f"<form><p>Login</p></form><article class='comment'>no {LONG}</article>") == ""


def test_smoothing_keeps_a_constant():
    assert html_extract.smooth(np.full(7, 3.0), 1.0) == pytest.approx(np.full(7, 3.0))


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, (h, _) in enumerate(PAGES)] + [(0, None, "<p>again", "x"), (None, "u", "<p>n", "x")], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id) == sorted((i, t, len(t)) for i, (_, t) in enumerate(PAGES) if i)
    assert len(got) == len(PAGES) + 2 and html_extract.extract(df.where("false")).collect() == []


def slow_rates(docs, labels):
    """Rates of the mixing stage: slow posteriors, and a long fit over single documents."""
    from test_text_operators import slow_posteriors

    p = np.array([x[1:] for x in slow_posteriors(docs, labels)])
    n = np.array([len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t in docs], float)
    target, x = (p.T @ n) * [1, 1, 0], np.ones(len(n))
    metric = np.linalg.pinv((p * n[:, None]).T @ p)
    best = (np.inf, x)
    for _ in range(25):
        size = np.abs(p.T @ (n * x) - target).max()
        if size < 0.99 * best[0]:
            best = (size, x)
        x = np.clip(x - p @ (metric @ (p.T @ (n * x) - target)), 0, 1)
    return best[1]


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from test_pipeline import near_kept

    from quern.llm import exact_dedup, language_id

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    source = spark.read.parquet(f"{folder}/documents.parquet")
    extra = source.limit(3).union(spark.createDataFrame([(None, "the text of no id", "en", "s", 3), (None, None, None, None, None), (999_999, "123", "en", "s", 3), (999_998, "", "en", "s", 0)], source.schema))
    source.union(extra).withColumn("score", source.doc_id).withColumn("_metadata", F.lit("x")).withColumn("quern_at_row", F.lit(0)).withColumn("quern_lang", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = docs.collect()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out{k}"))
        before, docs = docs, spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == before.columns
            rows = docs.collect()
        if k == 0:
            assert sorted(map(repr, rows)) == sorted(repr(r) for r in texts if any(c.isalpha() for c in r.text or ""))
        elif k == 1:
            best: dict = {}
            for r in before.collect():
                key = (r.text or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
                best[key] = max(best.get(key, -1), -1 if r.doc_id is None else r.doc_id)
            assert sorted(best.values()) == sorted(-1 if r.doc_id is None else r.doc_id for r in rows)
        elif k == 2:
            given = before.collect()
            kept = near_kept([(r.doc_id, r.text) for r in given])
            assert sorted((r.text or "") for r in rows) == sorted((given[a].text or "") for a in kept)
        elif k == 3:
            given = before.collect()
            rate = slow_rates([(r.doc_id, r.text) for r in given], [tuple(r) for r in spark.read.parquet(str(tmp_path / "labels.parquet")).collect()])
            sure, some = ([r.text or "" for r, x in zip(given, rate, strict=True) if x >= least] for least in (0.52, 0.48))
            got = Counter(r.text or "" for r in rows)
            assert not Counter(sure) - got and not got - Counter(some) and len(some) - len(sure) < 0.05 * len(given)
        else:
            tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
            ranks = {b: i for i, b in enumerate(bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
            encoding = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            want = []
            for r in before.collect():
                ids = encoding.encode_ordinary(r.text or "")
                want.append((r.doc_id, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), sha(r.text or "")))
            assert sorted(repr(tuple(r)) for r in docs.collect()) == sorted(map(repr, want))
    assert language_id.UNDETERMINED == "und"
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
