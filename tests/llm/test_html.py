"""Main-text extraction: the cut against brute force, what it adds to the classifier, markup cases, tables of pages."""

import itertools
import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from sextant.llm import html

LONG = "This is a long real paragraph of the article with many words in it, and it goes on for a while."
PAGES = Path("/root/testdata/sf0.01/pages.parquet")


def block(region=0, parent=0, tag="p"):
    return html.Block("x", (0.0,) * len(html.PRIOR), 0.0, region, parent, tag, None, False)


def cost(values, found, keep):
    """Of a labelling: terminal capacities and smoothness edges that it cuts."""
    total = sum(max(v, 0) if not k else max(-v, 0) for v, k in zip(values, keep, strict=True))
    last = {}
    for i, b in enumerate(found):
        if i and keep[i] != keep[i - 1]:
            a = found[i - 1]
            total += 0.1 if a.region != b.region else 0.8 if a.parent == b.parent else 0.4
        j = last.get(b.parent)
        if j is not None and keep[i] != keep[j]:
            total += (1.0 + 0.4 * (found[j].tag == b.tag)) if found[j].region == b.region else 0.1
        last[b.parent] = i
    return total


def test_the_cut_is_the_cheapest_labelling():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 9)
        found = [block(rng.randint(0, 1), rng.randint(0, 2), rng.choice(["p", "li"])) for _ in range(n)]
        values = [rng.uniform(-3, 3) for _ in range(n)]
        best = min(cost(values, found, keep) for keep in itertools.product([True, False], repeat=n))
        assert cost(values, found, html.content(values, found)) == pytest.approx(best, abs=1e-6)


def stripped(page):
    page = re.sub(r'\s(?:class|id|role)="[^"]*"', "", page)
    return re.sub(r"<(/?)(article|nav|footer|aside|header|main)\b", r"<\1div", page)


def test_weak_blocks_go_with_their_neighbours():
    page = f"<div><h1>Why</h1><p>{LONG}</p><p>Hm</p><p>{LONG}</p></div><div><a href=x>one</a></div>"
    rows = {b.text: (own, cut) for b, own, cut in html.labelled(page)}
    assert rows["Hm"] == (False, True) and rows["Why"][1] and not rows["one"][1]


def test_without_tags_and_classes_the_cut_is_no_worse_than_the_classifier():
    own_right = cut_right = blocks = 0
    for page in pq.read_table(PAGES).column("html").to_pylist():
        truth, got = html.labelled(page), html.labelled(stripped(page or ""))
        assert len(truth) == len(got)
        blocks += len(got)
        own_right += sum(t[2] == g[1] for t, g in zip(truth, got, strict=True))
        cut_right += sum(t[2] == g[2] for t, g in zip(truth, got, strict=True))
    assert cut_right >= own_right and cut_right > 0.99 * blocks


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("plain", None), ("<p", ""),
        ("<html><head><title>t</title></head><body><nav><a href=x>Menu</a></nav><article><h1>Big &amp; small</h1><p>One  sentence here.<p>Two.</article><footer>foot</footer>", "Big & small\nOne sentence here.\nTwo."),
        (f"<article><p>{LONG}</p><div class='related'><p>{LONG} {LONG}</p></div><div class=related><ul><li><a href=x>Other story</a></li></ul></div></article>", f"{LONG}\n{LONG} {LONG}"),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><aside><p>{LONG}</p></aside></article><section id=comments><p>{LONG}</p></section>", LONG),
        (f"<div><p>Subscribe to our newsletter today.</p></div><div><h1>Title here</h1><p>{LONG}</p></div>", f"Title here\n{LONG}"),
        (f"<html><head><meta a=b><title>x</title><p>{LONG}</p>", LONG), (f"<head><p>{LONG}", LONG), (f"<body><p>{LONG}</p>", LONG),
        (f"<article><p>{LONG}</p><button>Share<p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><select><option>a<option>b</select><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<form><article><p>{LONG}</p></article></form>", LONG), (f"<article><noscript><div>Enable it.</div></noscript><p>{LONG}</p></article>", LONG),
        (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header><p>{LONG}</p></article>", f"Title\n{LONG}"),
        (f"<article><p>a &lt; b &#233;&nbsp;c {LONG}</p><script>if (a < b) '</p>'</script><style>p{{}}</style></article>", f"a < b é c {LONG}"),
    ],
)
def test_markup(page, text):
    got = html.main_text(page)
    assert got == text or text is None


def test_hostile_pages_take_linear_time():
    for piece in ("<a '", "<!", "<", "<a b='", "<script>", "<button>", "<!--", "&amp", "<p class='"):
        began = time.time()
        html.main_text(piece * (1_000_000 // len(piece)))
        assert time.time() - began < 20, piece
    began = time.time()
    html.main_text("<a '" * 250_000)
    assert time.time() - began < 1


def test_fit_learns_from_blocks_that_their_place_labels(spark):
    pages = spark.read.parquet(str(PAGES))
    weights = html.fit(pages)
    assert weights[2] < -2 and weights[1] > 0 and not np.allclose(weights, html.PRIOR)
    assert (html.fit(pages.limit(0)) == html.PRIOR).all()
    assert (html.fit_weights(np.ones((4, len(html.PRIOR))), np.ones(4)) == html.PRIOR).all()


def test_a_table_of_pages(spark):
    rows = [(1, 10, f"<article><p>{LONG}</p></article>", "t"), (1, 10, f"<article><p>{LONG}</p></article>", "t"), (None, 11, None, "t"), (3, 12, "", "t"), (4, 13, "<article>" + f"<p>{LONG}</p>" * 5000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url int, html string, text string")
    got = html.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert sorted((r.page_id or 0, r.url, r.text) for r in got.collect()) == [(0, 11, ""), (1, 10, LONG), (1, 10, LONG), (3, 12, ""), (4, 13, "\n".join([LONG] * 5000))]
    assert html.extract(pages.limit(0)).count() == 0


def test_a_slash_closes_no_element_of_html():
    page = '<article><script src=/a/>alert(1)</script><p>First of the words.<div class="x"/><p>Second of the words.</div><svg width=3 /><p>Third of the words.<svg viewBox=a/><p>not text</p></svg></article>'
    read = "".join(x for kind, x, _ in html.tokens(page) if kind == "text")
    assert "alert" not in read and "not text" not in read and all(w in read for w in ("First", "Second", "Third"))
    assert html.self_closed("svg", " /") and html.self_closed("math", "/") and not html.self_closed("svg", " href=/a/") and not html.self_closed("style", "/")
