"""Bounds that hold at any size: blocks, files, languages, rows without ids, and tables that are deleted."""

import os
import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from granary.llm import common, embedding, language, minhash, quality, sharding, warc
from granary.llm.common import new_path
from test_pairs import near_copies, shingle_set, true_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stage_keeps_one_row_of_each_group(spark):
    rng = random.Random(11)
    one, two, three = (" ".join(f"w{rng.randrange(9999)}" for _ in range(80)) for _ in range(3))
    rows = [(5, one, "en", "s", 1), (5, one, "en", "s", 1), (None, two, "en", "s", 1), (None, two, "de", "s", 1), (7, one + " tail", "en", "s", 1), (5, three, "en", "s", 1), (9, None, "en", "s", 1), (9, "", "en", "s", 1)]
    got = corpus_pipeline.minhash_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(5, one), (None, two), (5, three), (9, None), (9, "")])


def test_large_buckets_in_small_blocks(spark, monkeypatch):
    """A group whose members are mostly not similar to its leader, cut into many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 60)
    rng = random.Random(8)
    texts = [*near_copies(rng, 400, 120, 12), *near_copies(rng, 60, 70, 4)]
    rows = [(3 * k, t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = true_components({i: shingle_set(t) for i, t in rows})
    assert got == want and 20 < len(set(want.values())) < 400


def test_vectors_that_share_an_id(spark):
    e = lambda k: [1.0 if i == k else 0.0 for i in range(8)]
    rows = [(4, e(0), 1), (4, e(1), 1), (6, e(1), 1), (9, e(0), 1), (9, e(2), 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(4, 1, 4), (4, 1, 4), (6, 1, 4), (9, 0, 9), (9, 1, 4)]


def test_walk_visits_the_nearest_cells():
    rng = np.random.default_rng(3)
    x = embedding.unit(rng.standard_normal((400, 12)))
    index = embedding.MultiIndex(x, words=9)
    index.radius2, index.most = 99.0, 20
    index.ranks = index._ranks()
    who, one, two = index.visits(x[:50])
    for k in range(50):
        far = [((x[k, :6] - index.books[0]) ** 2).sum(1), ((x[k, 6:] - index.books[1]) ** 2).sum(1)]
        table = far[0][:, None] + far[1][None]
        nearest = {divmod(int(c), 9) for c in np.argsort(table, axis=None)[:20]}
        assert set(zip(one[who == k].tolist(), two[who == k].tolist(), strict=True)) == nearest


def test_two_thousand_languages():
    rng = np.random.default_rng(1)
    profiles = {f"l{k:04d}": rng.permutation(5000)[:400].astype(np.int64) for k in range(2000)}
    text = "some words of a text"
    own = language.top_codes(text)
    profiles["l1234"][: len(own)] = own
    profiles["l1234"][len(own) :] = np.arange(10**6, 10**6 + 400 - len(own))
    assert language.RankOrder(profiles).predict(text) == ("l1234", 1.0)
    refs = {f"l{k:04d}": {"chars": rng.random(quality.CLASSES) + 0.1, "words": {f"w{k}a": 30, f"w{k}b": 20}, "total": 100} for k in range(2000)}
    words = (["w77a"] * 30 + ["w77b"] * 20 + ["other"] * 50) * 2
    found = quality.nearest_reference(refs)(" ".join(words), words)
    by_hand = min((quality.js_distance(quality.char_classes(" ".join(words)), r["chars"]) + quality.js_distance(np.array([words.count(w) for w in r["words"]] + [len(words) - sum(words.count(w) for w in r["words"])], float), np.array([30.0, 20.0, 50.0])) for r in refs.values()))
    assert sum(found) == pytest.approx(by_hand)


def test_archives_are_bounded_by_bytes(spark):
    rng = random.Random(2)
    page = lambda n: "".join(rng.choices("abcdefgh <>", k=n))
    rows = [(k, "u", page(100_000 if k % 5 == 0 else 500)) for k in range(60)] + [(100, "u", "z" * (17 << 20))]
    path = new_path(spark, "test-warc")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, file_bytes=250_000)
    got = {r.page_id: r.payload for r in warc.read_archives(spark, path).collect()}
    assert {i: bytes(p).decode() for i, p in got.items()} == {i: h for i, _, h in rows}
    sizes, members = [], 0
    for top, _, names in os.walk(path.removeprefix("file://")):
        for name in names:
            if name.startswith("part-"):
                content = open(f"{top}/{name}", "rb").read()
                held = [len(m) for m in warc.members(memoryview(content))]
                members += len(held)
                sizes.append(sum(held) - held[-1])
                assert sum(map(len, map(bytes, warc.members(memoryview(content))))) == sum(held)
    assert members == len(rows) + 1 and max(s for s in sizes if s < 16 << 20) <= 250_000


def test_what_one_more_shard_moves(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', cast(id % 50 as int)) as text")
    got = sharding.shard_documents(docs, 8).toPandas()
    assert set(got.more_ring_shard[got.more_ring_shard != got.ring_shard]) == {8}  # the ring alone moves keys to the new shard only
    moved = (got["shard"] != got["more_shard"]).mean()
    assert (got.ring_shard != got.more_ring_shard).mean() < 0.2 and moved < 0.6
    sizes = got["more_shard"].value_counts()
    assert len(sizes) == 9 and sizes.max() - sizes.min() <= 1


def test_intermediate_tables_go(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * 30) for k in range(20)], "doc_id long, text string")
    before = set(os.listdir(common.shared_dir(spark).removeprefix("file://")))
    out = common.finished(lambda: minhash.near_duplicates(docs), "kept")
    left = set(os.listdir(common.shared_dir(spark).removeprefix("file://"))) - before
    assert out.count() == 20 and [x for x in left if x.startswith("granary")] == [os.path.basename(out._granary_path)]
    common.forget(out)
    assert not os.path.exists(out._granary_path.removeprefix("file://"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())
