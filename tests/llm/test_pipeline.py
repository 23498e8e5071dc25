"""The pipeline against a plain-Python version of its five stages, and the registered queries against their SQL."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
import oracle
from granary.llm import language, mixing, quality, registry
from granary.llm.tokens import BYTE_LEVEL, Encoder
from test_pairs import shingle_set, true_components

SMALL = "/root/testdata/sf0.001"


def rounds(docs):
    """docs: dicts; the same stages one document at a time, with models that are learned by their definitions."""
    refs = {}
    for lang in {d["lang"] for d in docs if d["lang"] and d["text"]}:
        texts = [d["text"] for d in docs if d["lang"] == lang and d["text"]]
        words = Counter(w for t in texts for w in quality.WORD_RE.findall(t.lower()))
        if words.total() >= quality.LEAST_LANGUAGE_WORDS:
            short = sorted(((w, n) for w, n in words.items() if len(w) <= quality.COMMON_LENGTH), key=lambda x: (-x[1], x[0]))[: quality.COMMON_WORDS]
            refs[lang] = sum(map(quality.char_classes, texts)), dict(short), words.total()

    def good(text):
        words = quality.WORD_RE.findall(text or "")
        often = Counter(zip(words, words[1:], words[2:]))
        covered = {k + j for k in range(len(words) - 2) if often[tuple(words[k : k + 3])] > 1 for j in range(3)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            return False
        if len(text) < quality.LEAST_CHARS or not refs:
            return True
        own, near = Counter(w.lower() for w in words), []
        for lang in sorted(refs):
            chars, common, total = refs[lang]
            p = [own[w] for w in common]
            q = list(common.values())
            near.append((quality.js_distance(quality.char_classes(text), chars), quality.js_distance(np.array([*p, len(words) - sum(p)], float), np.array([*q, total - sum(q)], float))))
        c, w = min(near, key=sum)
        return c <= quality.MOST_CHAR_DISTANCE and w <= quality.MOST_WORD_DISTANCE

    docs = [d for d in docs if good(d["text"])]
    grams = {}
    for d in docs:
        if d["lang"]:
            grams.setdefault(d["lang"], Counter()).update(language.ngrams(d["text"]).tolist())
    profiles = {lang: np.array(sorted(c, key=lambda g: (-c[g], g))[: language.PROFILE]) for lang, c in grams.items()}
    model = language.RankOrder(profiles)
    named = []
    for d in docs:
        lang, score = model.predict(d["text"])
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            named.append(d | {"lang": lang})
    sets = {d["doc_id"]: shingle_set(d["text"]) for d in named}
    top = true_components(sets)
    kept = [d for d in named if top[d["doc_id"]] == d["doc_id"]]
    size = Counter()
    for d in kept:
        size[d["source"]] += len(d["text"].encode()) + 1
    weight = {s: float(n) ** mixing.TEMPERATURE for s, n in size.items()}
    pieces, e = Counter(), Encoder(BYTE_LEVEL)
    for d in kept:
        rate = min(mixing.MAX_RATE, weight[d["source"]] / sum(weight.values()) * sum(size.values()) / size[d["source"]])
        u = int(hashlib.md5(f"{mixing.SEED}:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        n, p, step = 0, math.exp(-rate), math.exp(-rate)
        while step <= u:
            n += 1
            p *= rate / n
            step += p
        ids = e.whole(d["text"]) + np.array([2], "<u4").tobytes()
        cuts = [0, *range(len(ids) // 4 % 1024 or 1024, len(ids) // 4 + 1, 1024)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            if n:
                pieces[d["doc_id"], k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])] += n
    return pieces


def test_pipeline_like_plain_python(spark, tmp_path):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rng = random.Random(5)
    base = [d["text"] for d in docs if 80 < len((d["text"] or "").split()) < 400][:5]
    for k in range(60):
        words = base[k % 5].split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append({"doc_id": 10_000 + k, "text": " ".join(words), "lang": None, "source": "src0", "n_chars": 1})
    docs += [{"doc_id": 20_000, "text": None, "lang": None, "source": None, "n_chars": None}, {"doc_id": 20_001, "text": "1 2 3 " * 40, "lang": "en", "source": None, "n_chars": None}]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "'x' as kept", "'x' as Lang_Pred", "'x' as copy", "'x' as _text", "'x' as `a.b`").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == rounds(docs)
    fill = {}
    for r in got:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in fill.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and s[0][0] == 0 and sum(n for _, n in s) <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_like_its_sql(spark, name):
    oracle.compare(registry.QUERIES[name](spark, SMALL), oracle.connect(SMALL), registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0
