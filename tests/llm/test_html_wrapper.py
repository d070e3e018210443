"""Wrapper induction: tree matching against brute force, and pages that only alignment can tell apart."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from postsift.llm import html_extract

DATA = "/root/testdata"
LISTS = ("FURNITURE", "ROLES", "NAMES", "COMMENTS", "CONTENT")


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><script>x='<p>'</script></head><body>{body}</body></html>"


def plain_match(a, b):
    """Simple tree matching by its definition."""
    if a.tag != b.tag:
        return 0
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + plain_match(x, y))
    return 1 + table[-1][-1]


def random_tree(rng, depth=0):
    tag = "div" if depth == 0 else rng.choice(["div", "span", "em"])
    kids = "".join(random_tree(rng, depth + 1) for _ in range(rng.integers(0, 5))) if depth < 4 else ""
    return f"<{tag}>{kids}</{tag}>"


def test_matching_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(150):
        a, b = html_extract.parse(random_tree(rng)), html_extract.parse(random_tree(rng))
        shapes = {}
        html_extract._measure(a, shapes)
        html_extract._measure(b, shapes)
        want = plain_match(a, b)
        assert html_extract.match(a, b, {}) == want
        pairs = html_extract.alignment(a, b)
        assert len(pairs) == want
        for x, y in pairs:  # level-keeping, and parents are aligned with each other
            assert x.tag == y.tag and (x.parent is None or any(p is x.parent and q is y.parent for p, q in pairs))


@pytest.mark.parametrize("depth", [600, 5000])
def test_deep_pages(depth):
    pages = [page("<div>" * depth + f"<p>leaf {i}</p>" * (i + 1) + "</div>" * depth) for i in range(6)]
    assert html_extract.extract_group(pages) == ["\n".join([f"leaf {i}"] * (i + 1)) for i in range(6)]


def test_wide_pages():
    pages = [page("<div>" + "".join(f"<p>{'<b>x</b>' * (k % (2 + i % 2))}word {k} of {i}</p>" for k in range(1500 + 7 * i)) + "</div>") for i in range(4)]
    assert [len(t.split("\n")) for t in html_extract.extract_group(pages)] == [1500 + 7 * i for i in range(4)]


def furnished(i, article):
    """No element, role or name tells the article; the menu, the advert and the last line vary with the page."""
    return page(f"<div><div><a href=x>menu {i}</a><a href=y>entry {i * 3}</a></div><div>buy {i * 11} now</div><div>{article}</div><div>all rights kept {i}</div></div>")


def article(i, heading=""):
    return f"<h1>Title {i}</h1>{heading}" + "".join(f"<p>Sentence {k} of story {i} says more than a menu.</p>" for k in range(2 + i % 3))


def text_of(source):
    return "\n".join(re.findall(r"<(?:h1|h2|p)>(.*?)</", source))


@pytest.mark.parametrize("n", [3, 10])
def test_region_is_found_by_alignment(n):
    bodies = [article(i) for i in range(n)]
    assert html_extract.extract_group([furnished(i, b) for i, b in enumerate(bodies)]) == [text_of(b) for b in bodies]


def test_a_heading_common_to_articles_stays():
    bodies = [article(i, "<h2>Background</h2><p>As said before.</p>") for i in range(10)]
    assert html_extract.extract_group([furnished(i, b) for i, b in enumerate(bodies)]) == [text_of(b) for b in bodies]


def test_paragraphs_inside_the_region_stay():
    """A dateline and a closing sentence that all articles of a host share are part of each, however many pages there are."""
    for n in (2, 3, 6):
        bodies = [f"<p>Printed edition</p>{article(i)}<p>Reported by our own staff.</p>" for i in range(n)]
        found = html_extract.extract_group([page(f"<div class=menu>menu {i}</div><article>{b}</article>") for i, b in enumerate(bodies)])
        assert found == [text_of(b) for b in bodies]


@pytest.mark.parametrize(
    "body, text",
    [
        ("<form action=x><div><article><p>The article.</p></article><input name=q></div></form>", "The article."),
        (f"<form><div><h1>T</h1><p>{'Words of the page. ' * 9}</p></div></form><form><p>search</p></form>", "T\n" + ("Words of the page. " * 9).strip()),
        ("<main><article><p>first</p></article><div class=ad>buy</div><article><p>second, longer</p></article></main>", "first\nsecond, longer"),
        ("<article><div data-title='A hidden gem'><p>seen</p></div><p onclick=\"x.style='display:none'\">clicked</p></article>", "seen\nclicked"),
        ("<article><p hidden>a</p><p style='color:red; display : none'>b</p><p aria-hidden=true>c</p><p aria-hidden=false>d</p></article>", "d"),
        ("<div class=modal><article><p>in a frame of a bad name</p></article></div>", "in a frame of a bad name"),
        ("<article><p>text</p></article><div class=comments><article><p>a reader says much more than the text</p></article></div>", "text"),
        ("<article><p>text</p><aside><article><p>teaser</p></article></aside></article>", "text"),
    ],
)
def test_no_article_is_lost(body, text):
    assert html_extract.extract_group([page(body)]) == [text]


@pytest.mark.parametrize("attributes", ["class='comments open'", "class=menu id=sidebar", "hidden", "style='display:none'", "role=navigation"])
def test_the_body_is_never_furniture(attributes):
    assert html_extract.extract_group([f"<html><body {attributes}><article><p>text</p></article></body></html>"]) == ["text"]


def test_several_articles_of_aligned_pages_stay():
    pages = [page(f"<div><a href=x>menu {i}</a></div><div><article><p>Story {i} is told here at length.</p></article><article><p>And story {i * 7} beside it, too.</p></article></div>") for i in range(6)]
    assert html_extract.extract_group(pages) == [f"Story {i} is told here at length.\nAnd story {i * 7} beside it, too." for i in range(6)]


@pytest.mark.parametrize("cells", [1, 40, 1 << 26])
def test_halved_tables_give_as_heavy_a_pairing(monkeypatch, cells):
    monkeypatch.setattr(html_extract, "TRACE_CELLS", cells)
    rng = np.random.default_rng(cells)
    for _ in range(80):
        r, c = rng.integers(0, 12), rng.integers(1, 12)
        weights = [rng.integers(0, 4, c) for _ in range(r)]
        pairs = sorted(html_extract._pairing(weights))
        assert all(a < b and x < y for (a, x), (b, y) in zip(pairs, pairs[1:], strict=False))
        assert sum(int(weights[i][j]) for i, j in pairs) == html_extract._fold(weights)[0]


def test_no_partitioning_changes_a_text(spark):
    """One host, most pages with the same first line, pages that repeat, and one that repeats more often than a group has rows."""
    rows = [(i, f"http://h/{i}", page(f"<div>menu {i % 7}</div><div><p>{'Same first line' if i % 5 else f'Line {i}'}</p><p>Story {i % 170} goes on.</p></div>")) for i in range(300)]
    rows += [(1000 + i, "http://h/often", page("<div>menu</div><div><p>Repeated text here.</p></div>")) for i in range(60)] + [(None, None, None)] * 30
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = []
    for dealt in (frame.coalesce(1), frame.repartition(6), frame.orderBy(F.rand(5))):
        out = html_extract.extract_main_text(dealt, group_pages=24).collect()
        assert len(out) == len(rows)
        found.append(sorted((r.page_id or -1, r.url or "", r.text, r.n_chars) for r in out))
    assert found[0] == found[1] == found[2]
    assert len({t for i, u, t, n in found[0] if u == "http://h/often"}) == 1


@pytest.mark.parametrize("name, kept", [("social-history", True), ("related-work", True), ("ad-banner", False), ("siteFooter", False), ("cookie_notice", False), ("related posts", False)])
def test_names(name, kept):
    found = html_extract.extract_group([page(f'<article><p>first</p><div class="{name}">second</div></article>')])
    assert found == ["first\nsecond" if kept else "first"]


def test_copies_of_an_article_are_not_template():
    pages = [page(f"<nav><a href=a>m {i}</a></nav><div class=ad>buy {i}</div><article><h1>One</h1><p>{'The same story. ' * 20}</p></article>") for i in range(5)]
    want = "One\n" + ("The same story. " * 20).strip()
    assert html_extract.extract_group(pages) == [want] * 5


def test_without_lists_induction_still_finds_the_articles(spark, monkeypatch):
    """The tables' pages as div soup: every list empty, every telling element a div."""
    rows = spark.read.parquet(f"{DATA}/sf0.1/pages.parquet").where("url like '%//blog.tionsh.example.com/%'").orderBy("page_id").limit(96).collect()
    sources = [r.html for r in rows]
    want = html_extract.extract_group(sources)
    soup = [re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", h.replace('<div class="ad">', "<div>")) for h in sources]
    for name in LISTS:
        monkeypatch.setattr(html_extract, name, frozenset())
    assert len(want) == 96 and html_extract.extract_group(soup) == want
    monkeypatch.setattr(html_extract, "induce", lambda pages: [None] * len(pages))
    assert all(a != b for a, b in zip(html_extract.extract_group(soup), want, strict=True))


def test_repeated_and_nameless_rows_are_spread(spark):
    rows = [(None, None, page(article(1)))] * 40 + [(7, "http://h/x", page(article(2)))] * 40 + [(None, None, None)] * 20
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("row", F.lit(1)).withColumn("groups", F.lit("x"))
    found = html_extract.extract_main_text(frame, group_pages=4).collect()
    assert len(found) == 100 and sum(r.text == text_of(article(2)) for r in found) == 40 and sum(r.n_chars == 0 for r in found) == 20
