"""Sharding, page text, language-model scores, the pipeline and the registered queries."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from fieldsieve.llm import html_extract as H, lm_scoring as L, sharding as B
from fieldsieve.llm.queries import ORACLE_SQL, QUERIES

from .conftest import frame, prose


def check_shards(df, shards=8):
    rows = B.assigned(df, shards).collect()
    sizes = collections.Counter(r["shard"] for r in rows)
    assert len(rows) == df.count()
    if rows:
        counts = [sizes.get(s, 0) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    return rows


def test_shards(spark, odd, empty):
    rng = random.Random(1)
    texts = [prose(rng, 5 + i % 7) + str(i) for i in range(200)]
    texts += [texts[i] for i in range(40) for _ in range(3)] + ["hot"] * 190 + [texts[190]]
    rows = check_shards(frame(spark, texts))
    shards = collections.defaultdict(collections.Counter)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        shards[texts[r["doc_id"]]][r["shard"]] += 1
    copies = {t: c for t, c in shards.items() if sum(c.values()) > 1 and t != "hot"}
    assert sum(len(c) == 1 for c in copies.values()) >= 0.7 * len(copies)
    assert len(shards["hot"]) <= 5  # 190 rows of 511 need three shards of 64
    rows = check_shards(odd)
    assert {r["size"] for r in rows if r["doc_id"] == 0} == {1}
    check_shards(empty)
    check_shards(frame(spark, ["same"] * 20))
    check_shards(frame(spark, ["a", "b", "c"]))
    plan = B.assigned(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", range(2))
def test_propagation_cuts_fewer_edges_each_round(spark, seed):
    """Against the least cut that quotas allow, over all ways to deal out the groups' members."""
    import itertools

    rng = random.Random(seed)
    sizes = [rng.randint(2, 6) for _ in range(6)]
    total = sum(sizes) + 6  # and six rows without links
    quota = B._quotas(total, 2)
    cells = []
    for g, n in enumerate(sizes):
        m = n // 2 + g % 2 * (n % 2)
        cells += [(f"g{g}", s, k) for s, k in ((0, m), (1, n - m)) if k]
    trace = []
    out = B.propagated(spark.createDataFrame(cells, "group string, shard int, m long"), quota, trace)
    rows = [tuple(r) for r in out.collect()]
    assert {g: sum(m for x, _, m in rows if x == g) for g, _, _ in rows} == {f"g{g}": n for g, n in enumerate(sizes)}
    assert all(sum(m for _, s, m in rows if s == t) <= quota[t] for t in range(2))
    assert all(b <= a for a, b in zip(trace, trace[1:])) and trace[-1] == B.cut_edges(out)
    ways = itertools.product(*[range(n + 1) for n in sizes])
    best = min(sum(k * (n - k) for k, n in zip(w, sizes, strict=True)) for w in ways if sum(w) <= quota[0] and sum(sizes) - sum(w) <= quota[1])
    assert trace[0] > 0 and trace[-1] <= best + max(0.35 * trace[0], 6)


def test_hashed_start_leaves_the_work_to_propagation(spark):
    cells = [(f"g{g}", s, m) for g in range(200) for s, m in collections.Counter(random.Random(g).choices(range(8), k=2 + g % 9)).items()]
    total = sum(m for *_, m in cells)
    trace = []
    B.propagated(spark.createDataFrame(cells, "group string, shard int, m long"), B._quotas(total + 200, 8), trace)
    assert trace[0] > 4 * max(1, trace[-1]) and len(trace) > 3 and all(b <= a for a, b in zip(trace, trace[1:]))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<header><a href="/">Site</a> Slogan of the site.</header><nav class='menu'><ul><li><a href="/a>b">Home</a><li><a>News</a></ul></nav>
<div class="cookie-notice">We use cookies on this site. Accept them all, please, now.</div><!-- <p>hidden words</p> -->
<div id="content"><article><h1>A&nbsp;title &amp; more</h1><p>First   paragraph with <b>bold</b> and <i>it</i>alic<br>text, &lt;kept&gt; &#233;&#x2014; as it is.
<p>Short.</p><div class="ad">Buy now! The best offers of the year are here today.</div><ul><li>An item of the list.</li></ul>
<form><input value="x"><button>Send</button> Your name, please.</form><p>The last paragraph of the article, with some words.</p></article>
<aside>Related: <a>One</a> <a>Two</a></aside><section id="comments"><p>I like this article very much, thank you for it.</p></section></div>
<footer>&copy; All rights reserved. Contact us by post or phone.</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE).split("\n") == ["A title & more", "First paragraph with bold and italic text, <kept> é— as it is.", "Short.", "An item of the list.", "The last paragraph of the article, with some words."]
    assert H.main_text(None) == H.main_text("") == H.main_text("<script>x") == H.main_text("<p><a href='x") == ""
    assert H.main_text("<article><p>A whole sentence of some words &amp") == "A whole sentence of some words &"
    plain = "<div><p>" + "word " * 60 + "end.</p><p>" + "more " * 50 + "end.</p></div><ul><li><a>x</a></li><li><a>y</a></li></ul>"
    assert len(H.main_text(plain).split("\n")) == 2
    assert H.main_text("<p>a < b and 3 > 2 hold for all the numbers that we know.</p>").startswith("a < b and 3 > 2")
    assert len(H.main_text("<article>" + "<p>One more line of text here.</p>" * 5000 + "</article>").split("\n")) == 5000


WHOLE = "<article><p>A whole sentence of the article with a number of words.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<script>for(i=0;i<a.length;i++){x();}</script>",
        "<script>s = '<!-- no end';</script>",
        "<SCRIPT>s = \"<style>\"; t = '<\"';</Script >",
        "<html><head><title>T</title><meta charset=utf-8><body>",
        "<head><title>T</title>",
        "<style>a::before{content:'<b'}</style><select><option>x<option>y</select>",
    ],
)
def test_text_after_skipped_elements(before):
    assert H.main_text(before + WHOLE) == "A whole sentence of the article with a number of words."


@pytest.mark.parametrize("inner", ["<p class=advert>{}</p>", "<p class=advert>{}", "<ul><li id='share'>{}</li></ul>", "<table><tr><td class=promo><p>{}</p></td></tr></table>"])
def test_names_of_all_blocks(inner):
    one, two = "The first sentence of the article has a number of words.", "And the second one has about as many words as that."
    advert = inner.format("Buy our many products now and get some more for less.")
    assert H.main_text(f"<article><p>{one}</p>{advert}<p>{two}</p></article>").split("\n") == [one, two]



TEXT = "The first sentence of the article has a number of words. And the second one has about as many."


@pytest.mark.parametrize(
    ("page", "lines"),
    [
        (f"<main class='content has-sidebar'><p>{TEXT}</p></main>", [TEXT]),
        (f"<article id='search-engines-explained'><p>{TEXT}</p></article>", [TEXT]),
        (f"<div class='article' id='cookies-recipe'><p>{TEXT}</p></div>", [TEXT]),
        (f"<article><header class='entry-header'><h1>A heading</h1></header><p>{TEXT}</p></article>", ["A heading", TEXT]),
        (f"<article><div class='post-header'><h2>A heading</h2></div><p>{TEXT}</p></article>", ["A heading", TEXT]),
        (f"<article><p>{TEXT}</p><ul><li><a href=x>The linked item</a></li><li><a href=y>Another one</a></li></ul><p>{TEXT}</p></article>", [TEXT, "The linked item", "Another one", TEXT]),
        (f"<html><head><title>T</title><meta charset=utf-8><body><article><p>{TEXT}</p></article>", [TEXT]),
        (f"<header><h1>Site</h1></header><div class='sidebar content'><a>x</a></div><article><p>{TEXT}</p><div class='comments-body'><p>I like it a lot, thank you very much.</p></div></article>", [TEXT]),
        ("<article>" + "<div>" * 3000 + f"<p>{TEXT}</p>" + "</div>" * 3000 + "</article>", [TEXT]),
    ],
)
def test_names_are_a_weak_sign(page, lines):
    assert H.main_text(page).split("\n") == lines


def lines_of(page, weights=H.WEIGHTS):
    text = H.main_text(page, weights)
    return text.split("\n") if text else []


@pytest.fixture(scope="module")
def pages(spark):
    return [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").orderBy("page_id").collect() if r["html"]]


@pytest.fixture(scope="module")
def learned(pages):
    """Weights fitted on half of the pages."""
    return H.fitted([(*k, n) for k, n in collections.Counter(x for p in pages[::2] for x in H.labelled(p)).items()])


IN_ARTICLE = ["<div class='copyright-law'>{}</div>", "<section class='related-work'>{}</section>", "<section id='comments-on-method'>{}</section>", "<p id='form'>{}</p>", "<h2 id='comments'>{}</h2>", "<div class='cookies-recipe'>{}</div>", "<section aria-label='Comments on the method'>{}</section>"]
BESIDE = ["<div class='cc-window'>{}</div>", "<div class='adbox'>{}</div>", "<ol class='commentlist'><li>{}</li></ol>", "<div class='responses'>{}</div>", "<div class='user-comments-list'>{}</div>", "<div id='site-footer'>{}</div>", "<section aria-label='Related articles'>{}</section>", "<div class='sponsored-content'>{}</div>", "<div role='complementary'>{}</div>", "<div role='contentinfo'>{}</div>"]


@pytest.mark.parametrize("fit", [False, True])
@pytest.mark.parametrize("inner", IN_ARTICLE)
def test_names_of_parts_of_an_article(inner, fit, learned):
    weights = learned if fit else H.WEIGHTS
    assert lines_of("<article>" + inner.format(TEXT) + "</article>", weights) == [TEXT]
    assert lines_of(f"<article><p>{TEXT}</p>" + inner.format("Short one.") + f"<p>{TEXT}</p></article>", weights) == [TEXT, "Short one.", TEXT]


@pytest.mark.parametrize("fit", [False, True])
@pytest.mark.parametrize("inner", BESIDE)
def test_names_of_what_stands_beside(inner, fit, learned):
    weights = learned if fit else H.WEIGHTS
    beside = inner.format("I like this article very much, thank you for it. " * 3)
    assert lines_of(f"<article><p>{TEXT}</p>{beside}<p>{TEXT}</p></article>{beside}", weights) == [TEXT, TEXT]


def test_long_names_are_judged_alike():
    tail = " ".join(f"x{i}" for i in range(200))
    for name in ("sidebar", "related-work"):
        assert H._named(f" class='{name} {tail}'", True, False)[1:] == H._named(f" class='{name}'", True, False)[1:]
    assert H._named(" data-id='ads' style='x'", False, False) == (False, False, False)


def test_links_in_an_article_with_fitted_weights(learned):
    links = "<ul><li><a href=x>The linked item</a></li><li><a href=y>Another one</a></li></ul>"
    assert lines_of(f"<nav>{links}</nav><article><p>{TEXT}</p>{links}<p>{TEXT}</p>{links}</article>", learned) == [TEXT, "The linked item", "Another one"] + [TEXT, "The linked item", "Another one"]


def bare(page):
    """A page whose elements and names say nothing any more."""
    for name in ("article", "nav", "footer"):
        page = page.replace(f"<{name}>", "<div>").replace(f"</{name}>", "</div>")
    return page.replace(' class="ad"', "")


def test_fitted_weights_tell_blocks_without_marks(pages, learned):
    """On pages held out of the fit, whose marks were taken away: fewer wrong blocks than with weights not fitted, none right without a text's weights."""
    wrong = collections.Counter()
    n = 0
    for page in pages[1::2]:
        truth = collections.Counter(x.text for x in H.blocks_of(page) if x.marks.article)
        n += sum(truth.values())
        for name, w in (("learned", learned), ("standing", H.WEIGHTS), ("without text", (0.0,) * H.TEXT_FEATURES + learned[H.TEXT_FEATURES :])):
            got = collections.Counter(lines_of(bare(page), w))
            wrong[name] += sum((got - truth).values()) + sum((truth - got).values())
    assert learned != H.WEIGHTS
    assert wrong["learned"] < 0.75 * wrong["standing"] and wrong["learned"] < 0.2 * n <= n <= wrong["without text"], (wrong, n)


def test_too_few_blocks_leave_the_standing_weights(pages):
    assert H.fitted([]) == H.WEIGHTS
    assert H.fitted([(*x, 1) for x in H.labelled(pages[0])]) == H.WEIGHTS
    assert H.labelled(None) == H.labelled("") == H.labelled(bare(pages[0])) == []


def test_pages_of_the_table(spark, sf):
    """The text of every page is that of its article."""
    rows = H.op8_html_extract(spark, sf).collect()
    truth = {r["page_id"]: "\n".join(x.text for x in H.blocks_of(r["html"]) if x.marks.article) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(truth) and all(r["text"] and r["text"] == truth[r["page_id"]] for r in rows)


@pytest.mark.parametrize("seed", range(25))
def test_minimum_cut(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.choice([-3, -2, -1, -0.5, 0.5, 1, 2, 3]) + rng.random() / 100 for _ in range(n)]
    edges = [(i, i + 1, rng.random()) for i in range(n - 1)] + [(i, j, rng.random()) for i in range(n) for j in range(i + 2, n) if rng.random() < 0.2]

    def cost(labels):
        return sum(max(z, 0) if not x else max(-z, 0) for z, x in zip(odds, labels, strict=True)) + sum(c for i, j, c in edges if labels[i] != labels[j])

    best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
    assert cost(H.cut_labels(odds, edges)) == pytest.approx(best)


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "v", "", "y")], "page_id long, url string, html string, text string")
    rows = H.extracted(df).collect()
    assert len(rows) == 4 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert H.extracted(df.where("false")).count() == 0


def brute_scores(rows):
    """Base scores, and the model's from counts in dictionaries under given weights."""
    docs = [(i, (t or "").encode().lower().split() + ["</s>"]) for i, t in rows]
    train = [w for i, w in docs if L.fold_of(i) != L.HELD_OUT]
    one = collections.Counter(x for w in train for x in w)
    two = collections.Counter(p for w in train for p in zip(["<s>", *w], w))
    return docs, one, two, sum(one.values()), len(one), len(train)


def test_scores(spark, odd, empty, monkeypatch):
    seen = {}
    learn = L.weights_of
    monkeypatch.setattr(L, "weights_of", lambda cells, distinct: seen.setdefault("w", learn(cells, distinct)))
    df = odd.unionByName(frame(spark, [prose(random.Random(i), 60) for i in range(80)], 100))
    rows = L.scored(df).collect()
    docs, one, two, n, v, documents = brute_scores([(r["doc_id"], r["text"]) for r in df.collect()])
    expected = []
    for i, w in docs:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        score = 0.0
        for h, x in zip(["<s>", *w], w):
            c = documents if h == "<s>" else one[h]
            l = seen["w"][0 if c == 0 else 1 + min(int(math.log2(c)), L.BUCKETS - 2)]
            score += math.log10(l[0] / (v + 1) + l[1] * one[x] / n + (l[2] * two[h, x] / c if c else 0))
        expected.append((str(i), L.fold_of(i) == 2, len(w), sum(one[x] > 0 for x in w), n, round(base, 6), round(score, 6)))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows]
    assert sorted(got) == sorted(expected)
    assert L.scored(empty).count() == 0


def test_weights_follow_the_cells():
    cells = [(3, 8, 0, 1000), (3, 8, -1, 10), (5, 4, -1, 1000)]
    w = L.weights_of(cells, 10_000)
    assert np.allclose(w.sum(axis=1), 1) and w[3, 2] > 0.9 and w[5, 1] > 0.9 and w[0, 2] == 0


def test_model_beats_base_on_held_out(spark, sf):
    rows = [r for r in L.op9_lm_scoring(spark, sf).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_pipeline(spark, sf):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_dedup", "substring_dedup", "decontamination", "packing"]
    docs = first = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == first.columns, name
        before = docs.count()
        docs = spark.createDataFrame(out.toPandas(), first.schema)
        assert 0 < docs.count() <= before
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    assert clean
    rows = C.run(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_pipeline_on_odd_tables(spark, odd, rows, tmp_path):
    """An empty table gives no rows; odd rows go through all stages, and the kept ones are whole."""
    import corpus_pipeline

    df = odd.where("false") if rows == "none" else odd
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    if rows == "none":
        assert not out
    else:
        kept = {r["doc_id"] for r in out}
        assert 6 in kept and not kept & {0, 1, 2, 3, 7, 8}  # without words, base rules, copies
        whole = {}
        for r in out:
            whole[r["doc_id"], r["doc_tokens"]] = whole.get((r["doc_id"], r["doc_tokens"]), 0) + r["length"]
        assert all(n % tokens == 0 for (_, tokens), n in whole.items())


def test_registered():
    numbers = sorted(int(n.split("_")[0][2:]) for n in QUERIES)
    assert numbers == list(range(1, 11)) and set(ORACLE_SQL) <= set(QUERIES)
