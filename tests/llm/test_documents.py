from __future__ import annotations

import collections
import re
import time

import numpy as np
import pytest
import regex

from crewlytics.llm import decontamination, html_templates, quality_trees
from crewlytics.llm.html_templates import Page

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text: str | None) -> tuple:
    text = text or ""
    words, seen, dup = WORDS.findall(text), set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    runs = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    repeat = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
    n = len(words)
    failed = n < 20 or 100 * len(repeat) > 30 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeat), failed


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_quality_query(run, rows):
    found = {r["doc_id"]: r for r in run("op10_quality_trees")}
    for d in rows("documents"):
        assert tuple(found[d["doc_id"]][n] for n in NAMES) == base(d["text"])
        assert not (found[d["doc_id"]]["kept"] and found[d["doc_id"]]["base_failed"])
    good = [r["doc_id"] for r in rows("labels") if r["quality"] == 1]
    clean = [i for i in good if not found[i]["base_failed"]]
    assert np.mean([found[i]["kept"] for i in clean]) > 0.98


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    features, low = quality_trees.labelled(docs, labels)
    held = np.arange(len(low)) % 3 == 0
    rising = [quality_trees.FEATURES.index(f) for f in quality_trees.RISING]
    trees = quality_trees.fit(features[~held], low[~held], rising)
    score = trees.score(features[held])
    assert ((score > 0.5) == low[held]).mean() > 0.97
    for f in rising:  # the score never falls as the statistic rises
        rows = np.repeat(features[:40], 50, axis=0)
        rows[:, f] = np.tile(np.linspace(0, 1, 50), 40)
        assert (np.diff(trees.score(rows).reshape(40, 50), axis=1) >= -1e-12).all()


def test_flat_trees_against_walking_each():
    pick = np.random.default_rng(1)
    x = pick.random((300, 4))
    y = ((x[:, 0] > 0.4) ^ (x[:, 1] > 0.7)).astype(float)
    trees = quality_trees.fit(x, y, [2], trees=20)

    def walk(row, node):
        while trees.left[node] != node:
            node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
        return trees.value[node]

    raw = np.array([trees.base + sum(walk(r, n) for n in trees.root) for r in x])
    assert np.allclose(trees.score(x), 1 / (1 + np.exp(-raw)))
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95


def test_quality_of_odd_rows(spark, odd, none):
    rows = quality_trees.judge(odd, None).collect()
    assert [tuple(r[n] for n in NAMES) for r in rows] == [base(r["text"]) for r in odd.collect()]
    kept = quality_trees.keep_good(odd, None)
    assert kept.schema == odd.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(
        str(r["doc_id"]) for r in odd.collect() if not base(r["text"])[-1]
    )
    empty = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert quality_trees.train(odd, empty) is None
    assert quality_trees.judge(none, None).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body class="has-sidebar">
<nav>menu</nav><div class="ad">buy</div>{before}<article><h1>A &amp; B</h1><p>one <b>t</b>wo
&nbsp;three<br>four<p>f<i>i</i>ve<ul><li>a<li>b</ul><!-- no <p>no</p> --><aside>no</aside><div class="cookie-notice">no</div>
<form>no</form><section id="comments"><article class="comment"><p>no</p></article></section></article>
<footer>&copy; no</footer>"""


def test_one_page():
    assert Page(PAGE.format(before="<p>outside</p>")).text(set()) == "A & B one two three four five a b"
    assert Page("plain &lt;text&gt; <p>with <b>bold").text(set()) == "plain <text> with bold"
    assert Page("").text(set()) == Page("<div></div>").text(set()) == ""
    assert Page("<b>" * 3000 + "deep" + "<div>" * 3000 + "er").text(set()) == "deep er"
    assert Page('<main><p>in</p></main><p>out</p><div hidden>x</div>').text(set()) == "in"
    assert Page('<p title="a > b">x</p><p title="open>y</p>').text(set()) == "x y"


def test_page_query(run, rows):
    import html

    found = {r["page_id"]: r for r in run("op1_html_templates")}
    for r in rows("pages"):
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h1|br)>", re.sub(r"</?b>", "", article))
        text = " ".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())
        assert found[r["page_id"]]["text"] == text and found[r["page_id"]]["n_chars"] == len(text)
        assert found[r["page_id"]]["url"] == r["url"]


def test_templates_of_a_site(spark):
    """A box without telling names goes where it recurs on a host, and stays elsewhere."""
    box = "<div><p>Read our other pages</p></div>"

    def page(i, host, body):
        return (i, f"https://{host}/{i}", f"<body>{box}<p>own text number {i} " + f"of page {i} " * 9 + f"</p>{body}</body>", "x")

    pages = [page(i, "a.example", "") for i in range(12)] + [page(20, "b.example", "")]
    same = [(30 + i, "https://c.example/", f"<body>{box}<p>the same page every time, copied</p></body>", "x") for i in range(20)]
    odd = [(60, None, None, "x"), (61, "x", "", None), (None, None, "<p>no id", None), (61, "x", "", None)]
    df = spark.createDataFrame(pages + same + odd, "page_id long, url string, html string, subtree string")
    rows = html_templates.extract_text(df).collect()
    assert len(rows) == df.count()
    text = {(r["page_id"], r["url"]): r["text"] for r in rows}
    assert all("Read our" not in text[i, f"https://a.example/{i}"] for i in range(12))
    assert all("own text" in text[i, f"https://a.example/{i}"] for i in range(12))
    assert sum("Read our" in t for t in text.values()) == 20 + 1
    assert text[60, None] == text[61, "x"] == "" and text[None, None] == "no id"
    assert html_templates.extract_text(df.limit(0)).count() == 0


def test_template_of_a_small_part_of_a_host(spark):
    """A box on 10 pages goes on a host of 1,500 pages as on one of 20; one on 9 pages stays."""

    def page(i, host, text):
        body = f"<body><p>own text number {i} " + f"of page {i} " * 9 + f"</p><div><p>{text}</p></div></body>"
        return (i, f"https://{host}/{i}", body)

    boxes = ["a section"] * 10 + ["a rare one"] * 9
    pages = [page(i, host, (boxes + [f"only {i}"] * n)[i]) for host, n in (("big", 1481), ("small", 1)) for i in range(19 + n)]
    rows = html_templates.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert len(rows) == 1520 and all("own text" in r["text"] for r in rows)
    left = [t for r in rows for t in ("a section", "a rare one", "only") if t in r["text"]]
    assert {t: left.count(t) for t in set(left)} == {"a rare one": 18, "only": 1482}


def test_template_in_an_article(spark):
    """Recurring quotes, figures and preformatted text in an article go; rare ones, paragraphs and headings stay."""
    again = "<h2>Again</h2><p>Same line</p><blockquote>Quoted</blockquote><figure><figcaption>Shown</figcaption></figure><pre>Typed</pre>"
    rare = "<blockquote>Seldom quoted</blockquote>"

    def page(i):
        return f"<article><p>own text number {i} " + f"of page {i} " * 9 + f"</p>{again}{rare * (i < 9)}</article>"

    pages = spark.createDataFrame([(i, "https://a/", page(i)) for i in range(10)], "page_id long, url string, html string")
    for r in html_templates.extract_text(pages).collect():
        tail = " Seldom quoted" * (r["page_id"] < 9)
        assert r["text"].endswith(f"of page {r['page_id']} Again Same line{tail}") and r["text"].startswith("own text")


def words(text):
    return regex.findall(r"[\p{L}\p{N}]+", (text or "").lower())


def shingles(w):
    k = min(5, len(w))
    return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def alike(docs: list[tuple], items: list[tuple], least: float) -> dict:
    out = {}
    for i, text in docs:
        w = words(text)
        for j, item in items:
            m = len(words(item))
            own, k = shingles(words(item)), min(5, m)
            best = 0.0
            for s in range(max(1, len(w) - m + 1) if m and w else 0):
                part = w[s : s + m]
                win = collections.Counter(tuple(part[x : x + k]) for x in range(len(part) - k + 1))
                both = (own & win).total()
                best = max(best, both / ((own + win).total() - both))
            if best >= least:
                out[i, j] = round(best, 9)
    return out


def test_decontamination_query(run, rows):
    items = [(r["item_id"], r["text"]) for r in rows("benchmark")]
    seen = set().union(*(shingles(words(t)) for _, t in items))
    docs = [(r["doc_id"], r["text"]) for r in rows("documents") if seen & set(shingles(words(r["text"])))]
    found = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in run("op5_decontamination")}
    assert found == alike(docs, items, 0.8)


def test_decontamination_of_repeated_shingles(spark):
    """Items of few repeated shingles: windows right at the limit are found, one below is not."""
    items, docs = [], []
    for i in range(60):
        beat = f"one{i} two{i} " * 6
        items.append((i, f"{beat}last{i}"))
        docs += [(2 * i, f"{beat}other{i}"), (2 * i + 1, f"before it {beat}other{i} behind" if i % 2 else beat[: len(beat) // 2])]
    found = decontamination.contaminated(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    expected = alike(docs, items, 0.8)
    assert set(expected) >= {(2 * i, i) for i in range(60)} and len(expected) == 90
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found.collect()} == expected


def test_decontamination_of_edited_passages(spark):
    pick = np.random.default_rng(7)

    def text(n):
        return [f"v{x}" for x in pick.integers(0, 60, n)]

    items = [(i, text(int(n))) for i, n in enumerate(pick.integers(1, 60, 25))]
    docs = []
    for d in range(120):
        item = list(items[d % 25][1])
        for _ in range(int(pick.integers(0, 3))):  # edits at random places and at the ends
            at = int(pick.choice([0, len(item) - 1, pick.integers(0, len(item))]))
            item[at : at + 1] = text(int(pick.integers(0, 3)))
            item = item or ["gone"]
        parts = [text(int(pick.integers(0, 30))), item, text(int(pick.integers(0, 30)))]
        docs.append((d, ", ".join(sum(parts, [])).upper()))
    items = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, " .,"), (92, "ha " * 20)]
    docs += [(200, "Ha! " * 33), (201, None), (202, ""), (203, "..."), (None, items[3][1]), (200, "Ha! " * 33)]
    docs_df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string")
    items_df = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, word string")
    found = decontamination.contaminated(docs_df, items_df)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in found.collect()}
    assert got == alike(docs, items, 0.8)
    left = decontamination.drop_contaminated(docs_df, found)
    assert left.columns == docs_df.columns
    bad = {i for i, _ in got}
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(i) for i, _ in docs if i not in bad)
    assert decontamination.contaminated(docs_df.limit(0), items_df).count() == 0
    assert decontamination.contaminated(docs_df, items_df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op5_decontamination", "op8_url_reputation", "op9_preference_chat"])
def test_native_queries_run_no_python(spark, name):
    from crewlytics.llm.queries import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian", plan)


def test_training_beside_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "word " * (20 + i)) for i in range(30)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, quality long")
    plain = quality_trees.labelled(docs, labels)
    clashing = quality_trees.labelled(docs.selectExpr("*", "1 as _id", "2 as _label", "3 as id", "4 as quality"), labels)
    assert all((a == b).all() for a, b in zip(plain, clashing, strict=True))


def test_class_words_do_not_drop_the_article():
    text = lambda page: Page(page).text(set())
    body = "<p>Some body text of the article</p>"
    assert text(f'<div class="content with-sidebar"><article>{body}</article></div>') == "Some body text of the article"
    page = f'<div id="page" class="right-sidebar"><div class="menu">Home</div><h1>Title</h1>{body}</div><div class="footer">f</div>'
    assert text(page) == "Title Some body text of the article"
    long = "a long comment of a reader " * 9
    assert text(f'<article>{body}</article><div class="comments"><article>{long}</article></div>') == "Some body text of the article"
    assert text(f'<h1>T</h1>{body}<div class="comments"><p>{long}</p></div>') == "T Some body text of the article"
    nested = f'<div class="sidebar-layout"><div class="widget-area"><main>{body}</main></div></div>'
    assert text(nested) == "Some body text of the article"


def test_attributes_as_the_standard_reads_them():
    text = lambda page: Page(page).text(set())
    assert text("<p title=it's>Hello don't stop</p><p>more</p>") == "Hello don't stop more"
    assert text('<p title="a > b" class=x>one</p>') == "one"
    assert text("<p a='b' / hidden>gone</p><p ='x'>two</p>") == "two"
    assert text('x <a href="y>z</a> w') == "x z w"
    assert text("a < b and <b>c</b> <i") == "a < b and c <i"


@pytest.mark.parametrize(
    "page",
    ['<a "' * 250_000, "<ul>" + "<b>" * 20_000 + "<li>x" * 20_000, "<div>" * 100_000 + "x", "<a href='" * 100_000,
     '<div class="ad"><h1>x' * 20_000, "<p>" * 200_000, "<!--" * 200_000, "</p " * 200_000],
)
def test_hostile_pages_take_linear_time(page):
    start = time.perf_counter()
    Page(page)
    assert time.perf_counter() - start < 10
