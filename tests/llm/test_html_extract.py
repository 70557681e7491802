import html
import itertools
import random
import re
import time

import numpy as np
import pytest

from siftmill.llm import boosted_trees, html_extract
from siftmill.llm.html_dom import Dom

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").collect()
    return [r["html"] for r in rows]


@pytest.fixture(scope="module")
def model(pages):
    return html_extract.fit_pages(pages[:50])


def article_text(source):
    """Main text of the given pages, whose articles hold little markup."""
    inner = re.search(r"<article>(.*)</article>", source, re.S)[1]
    inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1)>", "\x01", inner).replace("<br>", " "))
    assert "<" not in inner
    return " ".join(x for x in (" ".join(html.unescape(part).split()) for part in inner.split("\x01")) if x)


def test_given_pages_exactly(pages, model):
    assert html_extract.extract(pages, model) == [article_text(p) for p in pages]


def test_unseen_layouts(pages, model):
    """Variants of pages that were not used for fitting: nearly all pages without any wrong text node."""
    right = total = 0
    for i, source in enumerate(pages[100:150]):
        for page in html_extract.variants(source, pages[99 + i], 5000 + i)[1:]:
            dom = Dom(page, keep="data-side")
            truth = html_extract.truth(dom)
            chosen = html_extract.choose([dom], model)[0]
            shown = [j for j, tag in enumerate(dom.tags) if tag == "#text" and dom.texts[j].strip()]
            right += all(bool(truth[j]) == chosen[j] for j in shown)
            total += 1
    assert right >= 0.95 * total


def test_other_page(model):
    source = (
        '<html><body><div class="menu"><a href=x>Home</a></div><div class="content"><h1>Ti&amp;tle</h1><p>Hello wo<b>rld</b>, this is a '
        "long\n\n  paragraph of the text, with words.<p>Second one&nbsp;here, it is also long and has words in it.<ul><li>one item of the "
        "list<li>two items of it</ul></div><div id=comments><p>I disagree with all of this, really.</p></div>"
        "<script>if(a<b){}</script><footer>(c) 2020</footer>"
    )
    assert html_extract.extract([source], model) == [
        "Ti&tle Hello world, this is a long paragraph of the text, with words. Second one here, it is also long and has words in it. "
        "one item of the list two items of it"
    ]


def test_decoding_against_all_choices():
    rng = random.Random(4)
    for _ in range(200):
        n = rng.randint(1, 9)
        parents = [-1] + [rng.randrange(i) for i in range(1, n)]
        scores = np.array([rng.uniform(-2, 2) for _ in range(n)])
        chosen = html_extract.decode(parents, scores)
        assert all(chosen[p] or not chosen[i] for i, p in enumerate(parents) if p >= 0)
        best = max(
            sum(scores[i] for i in range(n) if pick[i])
            for pick in itertools.product([False, True], repeat=n)
            if pick[0] and all(pick[p] or not pick[i] for i, p in enumerate(parents) if p >= 0)
        )
        assert abs(best - sum(scores[i] for i in range(n) if chosen[i])) < 1e-9


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, (4000, 3))
    y = ((x[:, 0] > 0.2) != (x[:, 1] > -0.3)).astype(float)
    model = boosted_trees.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) > 0) == y[3000:]).mean() > 0.97


def test_broken_markup(model):
    for source in ["", "<", "<<<>>>", "<p", "<a href='x", "<!-- x", "</p></div>", "<script>x", "<div " * 3, "&amp;&#x41;&bogus;", "a<b", "<p>" * 2000, "<div>" * 3000 + "deep"]:
        assert isinstance(html_extract.extract([source], model)[0], str)


def test_table(spark, pages):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, pages[0]), (4, None, pages[1]), (5, "v", pages[2] + " " * 100_000)]
    frame = spark.createDataFrame(rows + [(10 + i, "u", p) for i, p in enumerate(pages[3:30])], "page_id bigint, url string, html string")
    from pyspark.sql import functions as F

    found = html_extract.extract_pages(frame.withColumn("text", F.lit("clash")).withColumn("id", F.lit(1))).collect()
    assert len(found) == len(rows) + 27
    assert [r["text"] for r in found if r["page_id"] in (1, 2)] == [""] * 3
    assert [r["text"] for r in found if r["page_id"] in (None, 4)] == [article_text(pages[0]), article_text(pages[1])]
    assert html_extract.extract_pages(frame.limit(0)).collect() == []


def long_page(pages):
    body = "".join(re.search(r"<article>(.*)</article>", p, re.S)[1] for p in pages)
    return re.sub(r"<article>.*</article>", lambda _: f"<article>{body}</article>", pages[0], flags=re.S)


@pytest.mark.parametrize("short", [[], ["<html><body></body></html>", "<nav><a href=x>Home</a></nav>"]])
def test_pages_longer_than_those_fitted_on(spark, pages, short):
    page = long_page(pages)
    assert len(page) > html_extract.SAMPLE_CHARS
    frame = spark.createDataFrame([(1, "u", page)] + [(2, "u", p) for p in short], "page_id bigint, url string, html string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(frame).collect()}
    assert found[1] == article_text(page)
    assert set(found) == ({1, 2} if short else {1})


def test_one_id_on_all_rows(spark, pages):
    """No hash share that takes few pages loses the text of all."""
    frame = spark.createDataFrame([(7, "u", p) for p in pages[:60]], "page_id bigint, url string, html string")
    for sample_pages in (1, 20):
        found = html_extract.extract_pages(frame, sample_pages=sample_pages).collect()
        assert sorted(r["text"] for r in found) == sorted(article_text(p) for p in pages[:60])


@pytest.mark.parametrize("tag", ["<svg class='icon'/>", "<math/>", "<svg>", "<object data=x>", "<select>", "<script src=x />", "<iframe src='x'/>", "<title/>"])
@pytest.mark.parametrize("later", ["", "<svg><path d='M0'/></svg><math><mi>x</mi></math>", "<script>var x;</script>"])
def test_text_after_a_tag_without_end(pages, model, tag, later):
    for source in pages[:5]:
        cut = source.index("<article>") + len("<article>")
        page = (source[:cut] + tag + source[cut:]).replace("</article>", f"</article>{later}")
        assert html_extract.extract([page], model)[0].removesuffix(" x") == article_text(source)


def test_visible_text_of_formulas_and_objects(model):
    text = "This is a long paragraph of the article, with many words, and another part of it follows here. " * 3
    source = (
        f"<html><body><nav><a href=x>Home</a></nav><article><h1>Title</h1><p>{text}so <math><mi>E</mi><mo>=</mo><mi>m</mi></math>, as known.</p>"
        f"<object data=x><p>Object: {text}</p></object><p><svg><style>p {{}}</style><text>Label</text></svg> {text}</p>"
        f"<p>{text}<select><option>one<option>two</select></p></article><footer>(c) 2020</footer>"
    )
    assert html_extract.extract([source], model) == [f"Title {text}so E=m, as known. Object: {text}Label {text}{text}one two"]


def test_raw_text_stays_raw():
    dom = Dom("<p>a<script src=x/></p><b>no markup</b></script>b<textarea/><i>raw</i></textarea>c<svg><title/><g/></svg>d")
    assert [t for t in dom.texts if t] == ["a", "</p><b>no markup</b>", "b", "<i>raw</i>", "c", "d"]
    assert [dom.tags[dom.parents[dom.texts.index(t)]] for t in ("a", "b", "c", "d")] == ["p", "p", "p", "p"]


@pytest.mark.parametrize("source", ["<div>" * 200_000, "<i>" * 100_000 + "</x>" * 100_000, "<p><i>" * 50_000 + "</b>" * 50_000, "<li>" * 100_000])
def test_deep_pages_are_read_in_linear_time(source):
    """Seconds each, where searching the open tags would take hours."""
    start = time.monotonic()
    Dom(source)
    assert time.monotonic() - start < 30
