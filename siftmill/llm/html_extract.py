"""Main text of web pages: boosted trees over DOM nodes, decoded along the hierarchy."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from siftmill.llm import boosted_trees
from siftmill.llm.boosted_trees import BoostedTrees
from siftmill.llm.html_dom import RAW, Dom

SAMPLE_PAGES = 150  # pages the trees are fitted on
SAMPLE_CHARS = 100_000  # longer pages are not used for fitting
LEAST_PAGES = 40  # where fewer pages of the sample have main text, generated ones make up the number
PAGES_AT_ONCE = 64

# Tags with a feature of their own, alone and as an ancestor.
TAGS = (
    "nav footer header aside article main section form button h1 h2 h3 h4 p div ul ol li table tr td a span blockquote pre figure "
    "figcaption label input dl head body #text"
).split()
ABOVE = "nav footer header aside article main form button ul table a head figure".split()
# Parts of attribute values, as words authors use for what surrounds a text and for the text.
AROUND = frozenset(
    "ad ads adv advert advertisement banner sponsor sponsored promo promoted sidebar side widget nav navbar navigation menu "
    "breadcrumb breadcrumbs pagination pager footer header masthead topbar copyright legal comment comments reply replies disqus "
    "respond share sharing social follow subscribe subscription newsletter signup login cookie cookies consent notice alert banner "
    "popup modal overlay dialog gdpr related recommended recommendations popular trending more tags toolbar search skip hidden "
    "complementary contentinfo form toc".split()
)
INSIDE = frozenset("article articlebody content entry post story main text body page blog news hentry prose maincontent".split())
HASHED = 32
_PUNCTUATION = re.compile(r"[.,;:!?]")


_TAG_NUMBER = {tag: i for i, tag in enumerate(TAGS)}
_ABOVE_BIT = {tag: 1 << i for i, tag in enumerate(ABOVE)}
_SUMS = 6  # characters, punctuation, words, linked characters, nodes, texts


def features(doms: list[Dom]) -> np.ndarray:
    """One row per node: tag and attributes, own and above; depth; siblings; text of the subtree.

    The nodes of several pages follow each other.
    """
    up, root, tags, depth, place, ties, above, around, inside, above_around, above_inside, raw = ([] for _ in range(12))
    sums: list[list[float]] = []
    hashed: list[tuple[int, int]] = []
    children: list[int] = []
    for dom in doms:
        first = len(up)
        same_tag: dict[tuple[int, str], int] = {}
        for i, (tag, p, tokens, text) in enumerate(zip(dom.tags, dom.parents, dom.tokens, dom.texts)):
            p += first
            if not i:
                p = first
                depth.append(0), place.append(0), above.append(0), above_around.append(0), above_inside.append(0), raw.append(False)
            else:
                depth.append(depth[p] + 1), place.append(children[p])
                children[p] += 1
                same_tag[p, tag] = same_tag.get((p, tag), 0) + 1
                above.append(above[p] | _ABOVE_BIT.get(tag, 0))
                above_around.append(above_around[p]), above_inside.append(above_inside[p])
                raw.append(raw[p] or tag in RAW or tag == "head")
            up.append(p), root.append(first), children.append(0), tags.append(_TAG_NUMBER.get(tag, len(TAGS)))
            own_around = own_inside = 0
            for token in tokens:
                own_around += token in AROUND
                own_inside += token in INSIDE
                hashed.append((first + i, zlib.crc32(token.encode()) % HASHED))
            around.append(own_around), inside.append(own_inside)
            above_around[-1] += own_around
            above_inside[-1] += own_inside
            words = text.split()
            if words:
                chars = sum(map(len, words)) + len(words) - 1
                sums.append([chars, len(_PUNCTUATION.findall(text)), len(words), chars if above[-1] & _ABOVE_BIT["a"] else 0, 1, 1])
            else:
                sums.append([0, 0, 0, 0, 1, 0])
        for i in range(len(dom.tags) - 1, 0, -1):
            low, high = sums[first + i], sums[up[first + i]]
            for k in range(_SUMS):
                high[k] += low[k]
        ties += [same_tag.get((p + first, tag), 1) for p, tag in zip(dom.parents, dom.tags)]
    up, root = np.array(up), np.array(root)
    chars, marks, words, linked, nodes, texts = np.array(sums, np.float32).T
    children, place, ties = (np.array(x, np.float32) for x in (children, place, ties))
    around, inside, above_around, above_inside = (np.array(x, np.float32) for x in (around, inside, above_around, above_inside))
    one_of = np.eye(len(TAGS) + 1, dtype=np.float32)[:, :-1]
    own_tag = one_of[np.array(tags)]
    siblings = np.maximum(children[up], 1)
    tokens = np.zeros((len(up), HASHED), np.float32)
    if hashed:
        np.add.at(tokens, tuple(np.array(hashed).T), 1)
    columns = [
        np.array(depth), np.log1p(chars), chars / nodes, linked / (chars + 1), marks / (words + 1), words / np.maximum(texts, 1),
        chars / (chars[up] + 1), chars / (chars[root] + 1), children, place, place / siblings, ties, ties / siblings,
        np.log1p(chars[up]), linked[up] / (chars[up] + 1), words[up] / np.maximum(texts[up], 1),
        around, inside, around[up], inside[up], above_around, above_inside, np.array(raw),
    ]
    passed = (np.array(above)[:, None] >> np.arange(len(ABOVE))) & 1
    return np.column_stack([*columns, own_tag, own_tag[up], passed, tokens]).astype(np.float32)


def decode(parents: list[int], scores: np.ndarray) -> list[bool]:
    """The best choice of main nodes under one rule: below a node that is not main, none is.

    ``scores`` are log odds of being main. From the leaves up, a subtree is
    worth most with its top main (the top's score and the better choice of each
    child) or not main at all (0); from the root down the choices are read off.
    """
    n = len(parents)
    best = scores.tolist()
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[parents[i]] += best[i]
    chosen = [True] * n
    for i in range(1, n):
        chosen[i] = chosen[parents[i]] and best[i] > 0
    return chosen


def gathered(dom: Dom, chosen: list[bool]) -> str:
    """Text of the chosen nodes: one space for white space in a block and between blocks."""
    blocks: dict[int, list[str]] = {}
    for i, tag in enumerate(dom.tags):
        if tag == "#text" and chosen[i]:
            blocks.setdefault(dom.blocks[i], []).append(dom.texts[i])
    joined = (" ".join("".join(parts).split()) for parts in blocks.values())
    return " ".join(text for text in joined if text)


def _textful(dom: Dom) -> np.ndarray:
    """Nodes with more than white space in their subtree."""
    below = [bool(text) and not text.isspace() for text in dom.texts]
    for i in range(len(below) - 1, 0, -1):
        below[dom.parents[i]] |= below[i]
    return np.array(below)


def choose(doms: list[Dom], model: BoostedTrees) -> list[list[bool]]:
    """The main nodes of each page."""
    scores = model.scores(features(doms))
    chosen, at = [], 0
    for dom in doms:
        own = scores[at : at + len(dom.tags)]
        at += len(dom.tags)
        # nodes without text have no say; white space goes with its surroundings
        own = np.where(_textful(dom), own, np.where([text != "" for text in dom.texts], 1e-9, 0.0))
        chosen.append(decode(dom.parents, own))
    return chosen


def extract(sources: list[str | None], model: BoostedTrees) -> list[str]:
    """Main text of pages; empty for null, empty and textless pages."""
    doms = [Dom(source or "") for source in sources]
    return [gathered(dom, chosen) for dom, chosen in zip(doms, choose(doms, model))]


# Training pages

_MARK = "data-side"
_CONTAINERS = (
    ("<div class=\"post-content\">", "</div>"), ("<div id=\"content\">", "</div>"), ("<main>", "</main>"),
    ("<section class=\"entry\">", "</section>"), ("<div class=\"story-body\">", "</div>"), ("<div>", "</div>"),
)
_BESIDE = (
    '<aside data-side="0" class="sidebar"><h3>{a}</h3><ul><li><a href="/x">{b}</a></li><li><a href="/y">{c}</a></li></ul></aside>',
    '<aside data-side="0"><p>{d}</p></aside>',
    '<div data-side="0" class="widget"><p>{d}</p></div>',
    '<div data-side="0" id="sidebar"><h4>{a}</h4><p>{d}</p></div>',
    '<div data-side="0" class="cookie-notice"><p>{d}</p><button>{a}</button></div>',
    '<div data-side="0" id="cookie-consent" role="dialog">{d} <a href="/p">{a}</a></div>',
    '<div data-side="0" class="notice">{d}</div>',
    '<div data-side="0" class="ad">{d}</div>',
    '<div data-side="0" class="advertisement"><p>{d}</p></div>',
    '<div data-side="0" class="banner promo"><a href="/b">{d}</a></div>',
    '<section data-side="0" class="comments"><h2>{a}</h2><div class="comment"><p>{d}</p></div><div class="comment"><b>{b}</b><p>{e}</p></div></section>',
    '<div data-side="0" id="comments"><ol><li><p>{d}</p></li><li><p>{e}</p></li></ol></div>',
    '<form data-side="0" action="/s"><label>{a}</label><input name="q"><button>{b}</button></form>',
    '<div data-side="0" class="newsletter-signup"><form><p>{d}</p><input type="email"><button>{a}</button></form></div>',
    '<div data-side="0" class="related-posts"><h3>{a}</h3><ul><li><a href="/1">{d}</a></li><li><a href="/2">{e}</a></li></ul></div>',
    '<ul data-side="0" class="share social"><li><a href="/f">{a}</a></li><li><a href="/t">{b}</a></li></ul>',
    '<header data-side="0"><a href="/">{a}</a><p>{b}</p></header>',
    '<div data-side="0" class="header"><span>{a}</span></div>',
    '<div data-side="0" class="breadcrumbs"><a href="/">{a}</a> &gt; <a href="/c">{b}</a></div>',
    '<nav data-side="0"><a href="/1">{a}</a> <a href="/2">{b}</a> <a href="/3">{c}</a></nav>',
    '<footer data-side="0"><p>{d}</p></footer>',
)
# Things of a text that a tree should not take for its surroundings.
_WITHIN = (
    "<ul><li>{d}</li><li>{e}</li></ul>", "<blockquote><p>{d}</p></blockquote>", "<h2>{a}</h2>", "<p>{b} <a href=\"/l\">{a}</a> {d}</p>",
    "<table><tr><td>{a}</td><td>{b}</td></tr></table>", "<pre>{d}</pre>", "<p>{a}</p>",
    "<p>{d} <math><mi>{a}</mi><mo>=</mo><mn>{b}</mn></math> {e}</p>", "<object data=\"/o\"><p>{d}</p></object>",
    "<p><svg class=\"icon\"><path d=\"M0\"/><text>{a}</text></svg> {d}</p>", "<p>{d} <select><option>{a}</option><option>{b}</option></select></p>",
)
_WORDS = re.compile(r"[^\s<>&\"]+")


def variants(source: str, others: str, seed: int) -> list[str]:
    """Training pages made from one page: itself, and versions with other containers and more around.

    Parts that are known not to be main text carry the attribute ``data-side``;
    their words come from ``others``, text of other pages.
    """
    rng = random.Random(seed)
    words = _WORDS.findall(re.sub(r"<[^>]*>", " ", others)) or ["text"]

    def phrase(low: int, high: int) -> str:
        start, size = rng.randrange(len(words)), rng.randint(low, high)
        return " ".join((words * (size // len(words) + 2))[start : start + size])

    def filled(pattern: str) -> str:
        return pattern.format(a=phrase(1, 4), b=phrase(1, 6), c=phrase(1, 6), d=phrase(4, 40), e=phrase(3, 30))

    made = [source]
    for _ in range(2):
        page = source
        if rng.random() < 0.6:
            start, end = rng.choice(_CONTAINERS)
            page = re.sub(r"<article\b[^>]*>", f'<div data-side="1">{start}', page, flags=re.I)
            page = re.sub(r"</article\s*>", f"{end}</div>", page, flags=re.I)
        if rng.random() < 0.5:
            page = re.sub(r"<nav\b", '<div data-side="0" class="menu"', page, flags=re.I)
            page = re.sub(r"</nav\s*>", "</div>", page, flags=re.I)
        if rng.random() < 0.5:
            page = re.sub(r"<footer\b", '<div data-side="0" id="footer"', page, flags=re.I)
            page = re.sub(r"</footer\s*>", "</div>", page, flags=re.I)
        inner = [filled(rng.choice(_WITHIN)) for _ in range(rng.randint(0, 3))]
        # once within the text as well, as comments and adverts often are
        inner += [filled(rng.choice(_BESIDE)) for _ in range(rng.randint(0, 2))]
        rng.shuffle(inner)
        for extra in inner:
            at = [m.start() for m in re.finditer(r"<p>", page)]
            if at:
                cut = rng.choice(at)
                page = page[:cut] + extra + page[cut:]
        before, after = ("".join(filled(rng.choice(_BESIDE)) for _ in range(rng.randint(0, 3))) for _ in range(2))
        page = re.sub(r"(<body\b[^>]*>)", lambda m: m[1] + before, page, count=1, flags=re.I)
        body_end = re.search(r"</body|</html|\Z", page, re.I).start()
        made.append(page[:body_end] + after + page[body_end:])
    return made


_SIDE_TAGS = frozenset("nav footer header aside form button head".split()) | RAW


def truth(dom: Dom) -> np.ndarray:
    """Whether each node of a training page is main: text by its marks and tags, others if any text below is.

    Text is main inside a marked container, an ``article`` or ``main``, or
    anywhere where a page has none of these, unless a closer ancestor is marked
    otherwise, has a tag for surroundings, or an attribute that says so.
    """
    n = len(dom.tags)
    starts = [i for i in range(n) if dom.tags[i] in ("article", "main") or dom.marks[i] == "1"]
    state = np.zeros(n, bool)
    state[0] = not starts
    heads = set(starts)
    side = np.zeros(n, bool)
    for i in range(1, n):
        p = dom.parents[i]
        wrong = dom.marks[i] == "0" or dom.tags[i] in _SIDE_TAGS or bool(AROUND.intersection(dom.tokens[i]) and i not in heads)
        side[i] = side[p] or wrong
        state[i] = (state[p] or i in heads) and not side[i]
    main = np.array([tag == "#text" and bool(t.strip()) for tag, t in zip(dom.tags, dom.texts)]) & state
    for i in range(n - 1, 0, -1):
        main[dom.parents[i]] |= main[i]
    return main


def train(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> BoostedTrees:
    """Trees fitted on about ``sample_pages`` different pages of at most ``SAMPLE_CHARS`` characters.

    The pages are those with the smallest hashes of their ids and contents;
    copies count once, and the driver gets twice that number at most. All pages
    are used where there are fewer. The sample decides what the trees are fitted
    on, not whether there are any: generated pages stand in where it has few
    pages with main text, or none because all are longer.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).filter(F.length("html").between(1, SAMPLE_CHARS))
    scale = 1 << 30
    share = min(scale, scale * sample_pages // max(rows.count(), 1) + 1)
    sample = rows.filter(F.pmod(F.xxhash64("id", "html"), F.lit(scale)) < share).select("html").distinct()
    chosen = sorted(r["html"] for r in sample.limit(2 * sample_pages).collect())
    useful = sum(bool(truth(Dom(source)).any()) for source in chosen)
    return fit_pages(chosen + generated(max(LEAST_PAGES - useful, 0)))


def generated(n: int) -> list[str]:
    """``n`` pages of made-up words in common layouts, from one paragraph to hundreds."""
    rng = random.Random(5)

    def phrase(low: int, high: int) -> str:
        return " ".join("".join(rng.choices("aeinorstl", k=rng.randint(2, 9))) + rng.choice(("", "", "", "", "", "", ",", ".")) for _ in range(rng.randint(low, high)))

    def paragraph() -> str:
        words = phrase(5, 90)
        if rng.random() < 0.3:
            first, _, rest = words.partition(" ")
            words = rng.choice((f"<b>{first}</b> {rest}", f'{first} <a href="/l">{phrase(1, 3)}</a> {rest}', f"{first}<br>{rest}"))
        return rng.choice(("<p>{}</p>",) * 8 + ("<h2>{}</h2>", "<ul><li>{}</li><li>{}</li></ul>", "<div>{}</div>", "<blockquote>{}</blockquote>")).replace("{}", words) + "\n"

    def links(most: int) -> str:
        return " ".join(f'<a href="/{k}">{phrase(1, 4)}</a>' for k in range(rng.randint(2, most)))

    made = []
    for _ in range(n):
        body = "".join(paragraph() for _ in range(int(4 ** rng.uniform(0, 4.2))))
        start, end = rng.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div><article>", "</article></div>"), ("<main><div>", "</div></main>")))
        above = rng.choice((f"<nav>{links(8)}</nav>", f"<header><a href='/'>{phrase(1, 3)}</a><nav>{links(6)}</nav></header>", ""))
        beside = rng.choice((f"<aside>{links(30)}</aside>", f"<aside><h3>{phrase(1, 3)}</h3><p>{phrase(4, 40)}</p></aside>", ""))
        below = rng.choice((f"<footer>{phrase(3, 20)} {links(5)}</footer>", f"<footer><p>{phrase(3, 20)}</p></footer>"))
        head = f"<head><title>{phrase(2, 8)}</title><style>p {{ margin: 0 }}</style></head>"
        script = rng.choice(("<script>var a = 1;</script>", ""))
        made.append(f"<!DOCTYPE html><html>{head}<body>{above}\n{start}<h1>{phrase(2, 9)}</h1>\n{body}{end}\n{beside}{below}{script}</body></html>")
    return made


def fit_pages(sources: list[str]) -> BoostedTrees:
    tables, labels = [], []
    for seed, source in enumerate(sources):
        for page in variants(source, sources[seed - 1], seed):
            dom = Dom(page, keep=_MARK)
            has_text = _textful(dom)
            tables.append(features([dom])[has_text])
            labels.append(truth(dom)[has_text])
    return boosted_trees.fit(np.concatenate(tables), np.concatenate(labels).astype(float))


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = SAMPLE_PAGES) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text.

    ``text`` is the main text of the whole page: character references decoded,
    white space inside a block one space, blocks joined by one space. Null,
    empty and textless pages have the empty text. Rows are independent of each
    other once the trees are fitted: repeats, null ids and other columns change
    nothing.
    """
    model = train(pages, id_col=id_col, html_col=html_col, sample_pages=sample_pages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(StringType())
    def main_text(sources: pd.Series) -> pd.Series:
        trees, found = shared.value, []
        for at in range(0, len(sources), PAGES_AT_ONCE):
            part = list(sources[at : at + PAGES_AT_ONCE])
            found += extract(part, trees)
        return pd.Series(found, dtype=object)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col)).alias("text"))
