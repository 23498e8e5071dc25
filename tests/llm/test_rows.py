"""The other operators against brute force, with nulls, empty and very long texts, repeated rows, empty tables and clashing columns."""

import gzip
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from granary.llm import html_text, language, mixing, packing, quality, sharding, token_output, tokens, warc
from granary.llm.common import new_path
from granary.llm.tokens import BYTE_LEVEL, WORD_LEVEL, Encoder

SCHEMA = "doc_id long, text string, lang string, source string, kept string"
ODD = [
    None, "", " ", "\n", "  a", " a", "a ", "a\n b", "a \nb", "a\n\nb", "a\tb\r\nc", "don't STOP!! it's 123 45.5, ok..,", "'S x'll", "<|endoftext|> hi <|startoftext|>", "a <|endoftext|> b", "x<|ENDOFTEXT|>y", "café É ÉCOLE ǅ İstanbul ΣΑΣ ς", "é ́x", "日本語 テスト ok", "a\x1cb a\x85b a b", "foo²½ ½x",
    "😀 hi😀", "…“x”", "word, word. word,", "long " * 20000, "x" * 30000,
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    words = {"aa": ["the", "of", "and", "house", "that", "with"], "bb": ["der", "und", "nicht", "straße", "mit", "über"]}
    out = [(k, t, None, None) for k, t in enumerate(ODD)]
    for k in range(300):
        lang = rng.choice(["aa", "bb"])
        out.append((1000 + k, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(1, 400))), lang, rng.choice(["s0", "s0", "s0", "s1", "s2"])))
    return out + [out[5], out[-1], out[-1], (None, "no id", "aa", "s1"), (None, None, None, None)]


def test_encoders_like_the_library(rows):
    for name in (BYTE_LEVEL, WORD_LEVEL):
        e, plain = Encoder(name), Tokenizer.from_file(public_tokenizers.path(name))
        library = lambda t: np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes()  # noqa: B023, E731
        for _ in range(2):
            assert [t for _, t, *_ in rows if t and e.encode(t) != library(t)] == []


def test_word_texts_together_like_the_library(rows, monkeypatch):
    rng = random.Random(4)
    plain = Tokenizer.from_file(public_tokenizers.path(WORD_LEVEL))
    texts = [t or "" for _, t, *_ in rows] + ["".join(rng.choice("abAB é中ªΩд.,!'s|0٣ \n\t_ßİ") for _ in range(rng.randrange(60))) for _ in range(2000)] + ["x" * 200 + ".", "é" * 99 + "!", "", " "]
    want = [plain.encode(t, add_special_tokens=False).ids + [1] for t in texts]
    end = np.array([1], "<u4").tobytes()
    for kept in (600_000, 30):  # all words stay in the table, and it is cut again and again
        monkeypatch.setattr(tokens, "KEPT_WORDS", kept)
        monkeypatch.setattr(tokens, "KEPT_PIECES", kept)
        e = Encoder(WORD_LEVEL)
        for size in (len(texts), 7):
            for lo in range(0, len(texts), size):
                ids, n = e.encode_all(texts[lo : lo + size], end)
                assert n.tolist() == [len(w) for w in want[lo : lo + size]] and ids.tolist() == sum(want[lo : lo + size], [])
        assert max(map(len, e.table[0].to_pylist())) <= 2 * tokens.KEPT_LENGTH
    ids, n = e.encode_all([], end)
    assert len(ids) == len(n) == 0
    assert [len(b) for b in token_output._sized(iter([pa.record_batch({"doc_id": range(6), "text": ["a", "b", "c" * 30, "d", "e", "f"]})]), 20, 3)] == [2, 1, 3]


def test_words_are_merged_once(monkeypatch):
    e, merged = Encoder(WORD_LEVEL), Counter()
    merge = e.merge
    monkeypatch.setattr(e, "merge", lambda piece: merged.update([piece]) or merge(piece))
    e.encode("the!! the?? the;; the. über.")
    e.encode("The (the) über!!")
    assert set(merged.values()) == {1}


def test_sharding(spark, rows):
    got = sharding.shard_documents(table(spark, rows), 8).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    count = Counter(r.shard for r in got)
    assert set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in count.items())
    assert sharding.shard_documents(table(spark, []), 8).count() == 0


def test_ring_moves_little_and_overflows_clockwise():
    counts = dict.fromkeys(range(1024), 100)
    where = lambda n: {(arc, k): s for arc, s, lo, hi, *_ in sharding.bounded_plan(counts, n, 1024) for k in range(lo, hi)}
    eight, nine = where(8), where(9)
    assert sum(eight[k] != nine[k] for k in eight) / len(eight) < 0.45 < 8 / 9
    orders, free = sharding.ring_order(8, 1024), [102400 // 8] * 8
    for arc in range(1024):
        for k in range(100):
            want = next(s for s in orders[arc] if free[s])
            free[want] -= 1
            assert eight[arc, k] == want


def test_mixing_like_brute_force(spark, rows):
    weights = {"s0": 1.0, "s1": 2.0, "s2": 1.0}
    got = mixing.mix_sources(table(spark, rows), weights, seed=3).collect()
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").encode()) + 1
    rate = {s: min(16.0, weights.get(s, 0.0) / 4 * sum(size.values()) / n) for s, n in size.items()}
    want = Counter()
    for i, t, _, s in rows:
        key = f"3:{i if i is not None else '-' + (t or '')}"
        u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
        n, p, step = 0, math.exp(-rate[s]), math.exp(-rate[s])
        while step <= u:
            n += 1
            p *= rate[s] / n
            step += p
        for copy in range(n):
            want[i, copy, n] += 1
    assert Counter((r.doc_id, r.copy, r.n_copies) for r in got) == want
    assert sorted(r.position for r in got) == list(range(len(got)))
    assert {r.kept for r in got} == {"clash"}
    by = Counter()
    for r in got:
        by[r.source] += len(r.text.encode()) + 1
    assert by["s1"] > by["s0"] and not by[None]
    assert mixing.mix_sources(table(spark, [])).count() == 0


def test_poisson_is_poisson(spark):
    n = spark.range(20000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'x' as text", "if(doc_id % 4 = 0, 'a', 'b') as source")
    got = mixing.mix_sources(n, {"a": 1.0, "b": 1.0}).groupBy("source", "doc_id").count().toPandas()
    a = got[got.source == "a"]["count"]
    assert abs(a.sum() / 5000 - 2) < 0.08 and abs((5000 - len(a)) / 5000 - math.exp(-2)) < 0.02


def test_quality_counts(spark, rows):
    got = {(r.doc_id, r.n_words): r for r in quality.quality_verdicts(table(spark, rows).drop("kept")).collect()}
    for i, t, *_ in rows:
        words = quality.WORD_RE.findall(t or "")
        r = got[i, len(words)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = Counter(windows)
        covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if quality.WORD_RE.search(x)]
        assert (r.word_chars, r.n_repeat_words, r.n_dup_lines) == (sum(map(len, words)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)
    assert {type(r.kept) for r in quality.quality_verdicts(table(spark, rows)).collect()} == {bool}
    assert quality.quality_verdicts(table(spark, [])).count() == 0


def test_clashing_columns_give_way(spark, rows):
    names = ["n_words", "N_Symbols", "score", "lang_pred", "copy", "rate", "_range", "_source", "piece", "offset", "_text", "_group", "a.b", "_aside1"]
    docs = table(spark, rows[:30]).withColumns({n: F.lit("clash") for n in names})
    judged = quality.quality_verdicts(docs).collect()
    assert {type(r.n_words) for r in judged} == {int} and {r["a.b"] for r in judged} == {r._text for r in judged} == {"clash"}
    assert {type(r.score) for r in language.predict_languages(docs, {}).collect()} == {float}
    mixed = mixing.mix_sources(docs)
    assert {(type(r.copy), r._range, r._source, r._aside1) for r in mixed.collect()} == {(int, "clash", "clash", "clash")}
    packed = packing.pack_documents(docs).collect()
    assert {(type(r.piece), type(r.offset), r._group, r._text) for r in packed} == {(int, int, "clash", "clash")}



def test_divergence_rejects_symbols_and_keeps_prose(spark):
    rng = random.Random(1)
    prose = [" ".join(rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.5 else "".join(rng.choices("etaoinshr", k=rng.randrange(3, 9))) for _ in range(120)) + "." for _ in range(60)]
    junk = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in p.split()) for p in prose[:5]]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate(prose + junk)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in quality.quality_verdicts(docs).where("kept").collect()}
    assert kept == set(range(60))
    assert quality.js_distance(np.array([1, 0]), np.array([0, 3])) == 1 and quality.js_distance(np.array([1, 2]), np.array([2, 4])) == 0


def test_language(spark, rows):
    docs = table(spark, rows)
    profiles = language.learn_profiles(docs, ~language.held_out())
    assert sorted(profiles) == ["aa", "bb"]
    got = language.predict_languages(docs, profiles).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    known = [r for r in got if r.lang]
    assert np.mean([r.lang == r.lang_pred for r in known]) > 0.97
    model = language.RankOrder(profiles)
    for text in ("the house", "straße nicht", "日本"):  # by the definition, one n-gram at a time
        own = Counter(language.ngrams(text).tolist())
        ranked = sorted(own, key=lambda c: (-own[c], c))[: language.PROFILE]
        off = {x: sum(abs(list(p).index(c) - k) if c in p else language.PROFILE for k, c in enumerate(ranked)) for x, p in profiles.items()}
        best = min(sorted(off), key=off.get)
        assert model.predict(text) == (best, pytest.approx(1 - off[best] / (language.PROFILE * len(ranked))))
    assert {r.lang_pred for r in language.predict_languages(docs, {}).collect()} == {"und"}
    assert language.learn_profiles(table(spark, []), ~language.held_out()) == {}


def test_token_files(spark, rows):
    path = new_path(spark, "test-tokens")
    token_output.write_tokens(table(spark, rows), path)
    got = token_output.token_digests(spark, path).collect()
    e, at = Encoder(WORD_LEVEL), 0
    want = Counter()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted((i for i, *_ in rows), key=lambda i: -1 if i is None else i)
    for r in ordered:
        assert r.start == at
        at += r.n_tokens
    for i, t, *_ in rows:
        ids = e.whole(t or "") + np.array([1], "<u4").tobytes()
        want[i, len(ids) // 4, zlib.crc32(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    for f in spark.read.parquet(path).inputFiles():
        meta = pq.ParquetFile(f.removeprefix("file://")).metadata
        for g in range(meta.num_row_groups):
            cols = {meta.row_group(g).column(k).path_in_schema: meta.row_group(g).column(k) for k in range(3)}
            assert all(c.has_offset_index for c in cols.values()) and cols["doc_id"].has_column_index
            assert "DELTA_BINARY_PACKED" in cols["doc_id"].encodings and cols["tokens.list.element"].has_dictionary_page
    empty = new_path(spark, "test-tokens")
    token_output.write_tokens(table(spark, []), empty)
    assert token_output.token_digests(spark, empty).count() == 0


def test_packing(spark, rows):
    got = packing.pack_documents(table(spark, rows), ["doc_id", "source"], with_ids=True).collect()
    e = Encoder(BYTE_LEVEL)
    want = Counter()
    for i, t, *_ in rows:
        ids = e.whole(t or "") + np.array([2], "<u4").tobytes()
        n = len(ids) // 4
        cuts = [0, *range(n % 1024 or 1024, n + 1, 1024)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 1024
    assert packing.pack_documents(table(spark, []), ["doc_id"]).count() == 0


def test_sum_of_squares_by_definition():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 41, 400)
    bins, offsets = packing.sum_of_squares_bins(lengths, 40)
    fill = {}
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        fits = [b for b, f in fill.items() if f < 40 and f + size <= 40]
        if fits:
            def cost(b):
                gaps = Counter(40 - f - (size if x == b else 0) for x, f in fill.items())
                return sum(n * n for g, n in gaps.items() if 0 < g < 40), 40 - fill[b]
            assert cost(bins[i]) == min(map(cost, fits))
        else:
            assert bins[i] not in fill
        assert offsets[i] == fill.get(bins[i], 0)
        fill[bins[i]] = fill.get(bins[i], 0) + size
    best: list[int] = []  # best fit of the same order
    for size in sorted(map(int, lengths), reverse=True):
        if fits := [k for k, f in enumerate(best) if f + size <= 40]:
            best[max(fits, key=best.__getitem__)] += size
        else:
            best.append(size)
    assert len(fill) <= len(best) + 2


PAGE = "page_id long, url string, html string, payload string"


def test_warc(spark):
    big, other = "<p>ä\r\n\r\nWARC/1.1\r\n</p>" * 60, "x" * 1000
    rows = [(k, f"http://a/{k} b\r\nX: y", big, "") for k in range(20)] + [(30, None, other, ""), (31, "u", other, ""), (31, "u", other, ""), (40, "u", "small", ""), (41, "u", "small", ""), (42, "u", None, ""), (43, "u", "", ""), (50, "u", "y" * 999, ""), (51, "u", "y" * 999, ""), (None, "n", big, "")]
    pages = spark.createDataFrame(rows, PAGE)
    path = new_path(spark, "test-warc")
    warc.write_archives(pages.drop("payload"), path)
    got = warc.read_archives(spark, path).collect()
    largest = {}
    for i, _, h, _ in rows:
        if i is not None:
            largest[h or ""] = max(i, largest.get(h or "", i))
    want = Counter()
    for i, _, h, _ in rows:
        body = (h or "").encode()
        to = largest[h or ""] if len(body) >= 1000 and i != largest[h or ""] else None
        want[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if to is not None else "response", to] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.record_type == "revisit") and (r.payload is None or hashlib.sha1(r.payload).hexdigest() == r.payload_digest) for r in got)
    files = [f.removeprefix("file:") for f in spark.read.format("binaryFile").load(path).select("path").toPandas()["path"]]
    content = b"".join(gzip.open("/" + f.lstrip("/")).read() for f in files)
    assert content.count(b"WARC-Type: revisit") == sum(n for k, n in want.items() if k[3] == "revisit")
    empty = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame([], PAGE).drop("payload"), empty)
    assert warc.read_archives(spark, empty).count() == 0


ARTICLE = "<h1>Title &amp; more</h1><p>First  words of\nthe <b>bold</b> text here.</p><aside>side words</aside><p>Second paragraph, a few more words<br>and a line</p><ul><li>one item of it</li></ul>"
WANT = "Title & more\n\nFirst words of the bold text here.\n\nSecond paragraph, a few more words and a line\n\none item of it"


def test_html(spark):
    shell = "<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>if (a<b) document.write('<p>no</p>')</script></head><body><nav><ul><li><a href='/x'>menu</a></li><li><a>menu two</a></li></ul></nav><div class='ad'>buy now</div>{0}<form><label>mail</label><input></form><section id='comments'><p>nice article I think so too</p></section><footer>&copy; us</footer></body></html>"
    pages = [shell.format(f"<article>{ARTICLE}</article>") for _ in range(60)]
    odd = [None, "", "   ", "plain text only", "<p>unclosed <b>words <p>and more", "<", "<!-- never closed", "a < b and b > a", shell.format(f"<div class='content'>{ARTICLE}</div>"), shell.format(f"<main>{ARTICLE}</main>")[:-40], "<p>" + "w " * 200000 + "</p>", "<nav>menu</nav>"]
    df = spark.createDataFrame([(k, "u", h, "clash") for k, h in enumerate(pages + odd + odd)], "page_id long, url string, html string, n_words string")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert {got[k].text for k in range(60)} == {WANT}
    want = ["", "", "", "plain text only", "unclosed words\n\nand more", "<", "", "a < b and b > a", WANT, WANT, " ".join(["w"] * 200000), ""]
    for k, x in enumerate(want + want):
        assert got[60 + k].text == x and got[60 + k].n_chars == len(x), k
    assert html_text.extract_text(df.where("false")).count() == 0
    assert html_text.extract_text(df.withColumnRenamed("n_words", "text")).where("text = 'clash'").count() == 0
    assert html_text.main_text("<p>one</p><svg class='x'/><p>two</p><svg><text>no</text></svg>", {}) == "one\n\ntwo"
