"""Near-duplicate documents and vectors against brute force."""

import random

import numpy as np
import pytest

from granary.llm import embedding, minhash
from granary.llm.components import connected_components

DOCS = "doc_id long, text string, component string, rep string"


def true_components(sets):
    """By comparing all pairs."""
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                root[high] = low
    return {i: top(i) for i in ids}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + 3]) for k in range(len(words) - 2)} if len(words) > 2 else ({tuple(words)} if words else set())


def near_copies(rng, n, size, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(size)] = f"x{rng.randrange(5000)}"
        yield " ".join(own)


def test_documents_like_brute_force(spark):
    rng = random.Random(3)
    texts = [t for n, size, edits in ((2, 60, 3), (5, 200, 8), (40, 90, 6), (700, 150, 9)) for t in near_copies(rng, n, size, edits)]
    texts += [" ".join(f"u{rng.randrange(9999)}" for _ in range(50)) for _ in range(100)]
    texts += [texts[0]] * 30 + ["", None, "  \n\t", "one", "ONE", "one two", "Ö one", "ö one"] + ["long " * 30000]
    rows = [(10 * k, t, "clash", "clash") for k, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    sets = {i: shingle_set(t) for i, t, *_ in rows}
    want = true_components(sets)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())
    assert len({want[10 * k] for k in range(47, 747)}) < 400  # the large group holds many links


def test_documents_without_id_repeated_and_none(spark):
    rows = [(None, "a b c d", "", ""), (None, "a b c d", "", ""), (5, "a b c d", "", ""), (5, "a b c d", "", ""), (4, None, "", "")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert got == [("4", "4", True), ("5", "5", True), ("5", "5", True), ("None", "None", True), ("None", "None", True)]
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_pruning_keeps_what_is_similar_enough():
    """The chance that a pair of similarity 0.85 is pruned is small: by simulation of its matching hashes."""
    rng = np.random.default_rng(1)
    hits = rng.random((200_000, minhash.HASHES)) < 0.85
    for n in range(minhash.BATCH, minhash.HASHES + 1, minhash.BATCH):
        assert (hits[:, :n].sum(1) >= minhash.least_matches(n)).mean() > 0.9999
    assert minhash.least_matches(minhash.HASHES) > 0.6 * minhash.HASHES


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 60)] + [(100, 200), (200, 300), (7, 7), (None, 3), (100, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 61)} | {100: 100, 200: 100, 300: 100}


def vectors(rng):
    rows = []
    for label in (0, 1):
        base = rng.standard_normal((150, 16))
        rows += [(x, label) for x in base]
        rows += [(x + 0.15 * rng.standard_normal(16), label) for x in base[:60]]
        rows += [(base[0] + 0.02 * rng.standard_normal(16), label) for _ in range(120)]
        rows += [(base[1], label)] * 25 + [(3 * base[1], label)] * 2
    return [([float(np.float32(v)) for v in x], label) for x, label in rows]


@pytest.mark.parametrize("small_blocks", [False, True])
def test_vectors_like_brute_force(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(embedding, "INDEX_BLOCK", 40)
        monkeypatch.setattr(embedding, "QUERY_BLOCK", 50)
    rows = vectors(np.random.default_rng(4))
    odd = [(None, 0), ([0.0] * 16, 0), ([float("nan")] * 16, 0), ([1.0, None] * 8, 0), ([float("inf")] * 16, 1), (rows[0][0], None), ([1.0], 0), ([2.0], 0), ([], 1)]
    table = [(k, x, label, "clash") for k, (x, label) in enumerate(rows + odd)] + [(None, rows[0][0], 0, "clash")]
    got = {r.vec_id: r for r in embedding.near_duplicate_vectors(spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, component string")).collect()}
    n = len(rows)
    x = np.array([np.float64(v) for v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([y for _, y in rows])
    links = (x @ x.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(links, False)
    found = np.array([got[k].n_links for k in range(n)])
    assert (found <= links.sum(1)).all() and found.sum() >= 0.99 * links.sum()
    low = np.arange(n)
    while True:
        new = np.minimum(low, np.where(links, low[None], n).min(1))
        if (new == low).all():
            break
        low = new
    assert np.mean([got[k].component_id == low[k] for k in range(n)]) > 0.99
    assert [(got[n + k].n_links, got[n + k].component_id - n) for k in range(len(odd))] == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (0, 5), (1, 6), (1, 6), (0, 8)]
    assert got[None].component_id is None and got[None].kept and got[None].n_links == 0


def test_no_vectors(spark):
    assert embedding.near_duplicate_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert [tuple(r) for r in embedding.near_duplicate_vectors(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).collect()] == [(1, 0, 1, True)]
