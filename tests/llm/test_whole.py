"""What earlier settings of the operators lost."""

import random

import corpus_pipeline
import pytest
from granary.llm import minhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_finds_appended_tails(spark):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**6)}"
    docs = []
    for k in range(40):  # 196 of 236 shingles of five words, 198 of 238 of three
        base = [word() for _ in range(200)]
        docs += [(2 * k, " ".join(base), "en", "s", 1), (2 * k + 1, " ".join(base + [word() for _ in range(40)]), "en", "s", 1)]
    for k in range(20):  # 196 of 256 shingles of five words: not similar enough
        base = [word() for _ in range(200)]
        docs += [(1000 + 2 * k, " ".join(base), "en", "s", 1), (1001 + 2 * k, " ".join(base + [word() for _ in range(60)]), "en", "s", 1)]
    got = corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(docs, DOCS), "")
    assert {r.doc_id for r in got.collect()} == {2 * k for k in range(40)} | set(range(1000, 1040))


def test_bands_follow_from_the_similarity():
    assert minhash.bands_for(minhash.PERCENT) == minhash.BANDS
    assert (1 - 0.8**minhash.ROWS) ** minhash.bands_for(80) <= (1 - 0.85**minhash.ROWS) ** minhash.BANDS < 1e-6


def test_high_rates_keep_weights_and_size(spark):
    from granary.llm import mixing

    docs = spark.range(20_000).selectExpr("id as doc_id", "'ten chars' as text", "case when id % 100 = 0 then 'rare' when id = 1 then 'one' else 'rest' end as source")
    got = {r.source: r for r in mixing.mix_sources(docs, {"rare": 0.5, "one": 0.2, "rest": 0.3}).selectExpr("*", "count(*) over (partition by doc_id) as n").groupBy("source").agg({"*": "count", "rate": "max"}).collect()}
    assert {s: round(r["max(rate)"], 6) for s, r in got.items()} == {"rare": 50.0, "one": 4000.0, "rest": round(6000 / 19_799, 6)}
    for s, want in (("rare", 10_000), ("one", 4000), ("rest", 6000)):
        assert abs(got[s]["count(1)"] - want) < 5 * want**0.5, (s, got[s])


def test_spread_of_high_rates(spark):
    from granary.llm import mixing

    docs = spark.range(200_000).selectExpr("id as doc_id", "'ten chars' as text", "case when id % 100 = 0 then 'rare' else 'rest' end as source")
    n = [r.n_copies for r in mixing.mix_sources(docs, {"rare": 0.5, "rest": 0.5}).where("source = 'rare' and copy = 0").collect()]
    mean = sum(n) / len(n)
    assert len(n) == 2000 and abs(mean - 50) < 1 and 43 < sum((x - mean) ** 2 for x in n) / len(n) < 58


WORDS = " ".join(f"word{k}" for k in range(40))


@pytest.mark.parametrize("tag", ["a href='/hidden-gems'", "span title='hidden costs'", "p data-state=\"hidden\"", "div data-testid='comments'", "div class='content has-sidebar'", "div id='right-sidebar-layout'", "div class='no-comments'", "div class=share-enabled", "div class='sidebar'"])
def test_text_that_no_name_leaves_out(tag):
    from granary.llm.html_text import main_text

    name = tag.split()[0]
    assert main_text(f"<body><{tag}>{WORDS}</{name}></body>", {}) == WORDS


@pytest.mark.parametrize("tag", ["div hidden", "div HIDDEN=''", "div class='ad'", "div class='box site-ads'", "div id=\"comments\"", "section class=page-sidebar", "div style='display: none'", "div title='x' role='search'", "div title='a > b' hidden"])
def test_text_that_is_left_out(tag):
    from granary.llm.html_text import main_text

    assert main_text(f"<body><p>{WORDS}</p><{tag}>not this</{tag.split()[0]}></body>", {}) == WORDS
