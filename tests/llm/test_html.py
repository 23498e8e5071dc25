"""Main text: the scan against all ranges, what learned and standard weights leave out, and hostile pages."""

import html
import random
import re
import time

import pytest

from granary.llm import html_text

SMALL = "/root/testdata/sf0.01"


def test_scan_like_all_ranges():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.choice([-2.0, -0.5, 0.25, 1.0, 3.0]) for _ in range(rng.randrange(0, 30))]
        low, high = html_text.best_region(scores)
        sums = [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
        assert sum(scores[low:high]) == max([0.0, *sums])


@pytest.mark.parametrize(("page", "want"), [
    ("<div class='container no-sidebar'><article><p>Some words of it.</p></article></div>", "Some words of it."),
    ("<article><p>Text one two.</p><div class='post search-engine-basics'><p>Kept</p></div><section id='related-work'><p>Also kept</p></section></article>", "Text one two.\n\nKept\n\nAlso kept"),
    ("<article><p>Text one two three.</p><div><div><p>End.</p></div></div></article>", "Text one two three.\n\nEnd."),
    ("<article><p>Text one two three.</p><aside>no no no</aside><p>End.</p></article><div>Share this page</div>", "Text one two three.\n\nEnd."),
    ("<div>Site</div><main><p>" + "w " * 9 + "</p><ul><li><a href='x'>one</a></li></ul></main>", " ".join("w" * 9) + "\n\none"),
    ("<div>" + "long text " * 30 + "</div><aside><article>a teaser</article></aside>", " ".join(["long text"] * 30)),
])
def test_articles_stay_whole(page, want):
    for weights in ({}, {("name", "ad"): -5.0, ("tag", "ul"): 0.1, ("tag", "a"): 1.5, ("word", "li"): 0.2}):
        assert html_text.main_text(page, weights) == want


def test_labelled_pages_teach_names(spark):
    page = "<body><article><h1>Head</h1><p>{0}</p><div class='xyz'>{1}</div><div class='comments'>{0}</div></article></body>"
    other = "<body><div class='xyz'>{0}</div><article><p>{0}</p><p class='comments'>{0}</p></article></body>"
    rows = [(k, (page if k % 2 else other).format("good words here " * 5, "bad " * 3)) for k in range(200)]
    weights = html_text.learn_weights(spark.createDataFrame([(k, other.format("good words here " * 5)) for k in range(200)], "page_id long, html string"))
    assert weights["name", "xyz"] < -html_text.DECISIVE and weights["name", "comments"] > html_text.DECISIVE
    text = html_text.main_text(rows[1][1], weights)
    assert "bad" not in text and text.count("good") == 10  # the learned name goes, and what else passes for comments stays


@pytest.mark.parametrize("names", [True, False])
def test_scan_alone_finds_the_articles(spark, monkeypatch, names):
    """Without any name of a class or id, learned or not, words beside the article lose by the scan."""
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    weights = html_text.learn_weights(pages)
    if not names:
        monkeypatch.setattr(html_text, "PRIOR_NAMES", frozenset())
        weights = {k: v for k, v in weights.items() if k[0] != "name"}
    for (page,) in pages.select("html").collect():
        body = page[page.index(">", page.index("<article")) + 1 : page.rindex("</article>")]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert html_text.main_text(page, weights) == "\n\n".join(b for b in blocks if b)


def test_hostile_pages_take_linear_time():
    began = time.monotonic()
    for page in ("<div>" * 50_000 + "x </b>" * 50_000, "<b><p><li>" * 30_000 + "x", "<li><div>" + "<b>" * 30_000 + "<li></li>" * 30_000, "<a '\">" * 50_000):
        html_text.main_text(page, {})
    assert time.monotonic() - began < 20
