"""Repeated passages against brute force, and the parts of the sort against what they must give."""

import os
import random
from collections import Counter

import numpy as np
import pytest

from granary.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, hash string, spans string, n_bytes long, block string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(x[k : k + length] for x in data for k in range(len(x) - length + 1))
    out = []
    for x in data:
        gone = [False] * len(x)
        for k in range(len(x) - length + 1):
            if seen[x[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = [k for k in range(len(x) + 1) if (k < len(x) and gone[k]) != (k > 0 and gone[k - 1])]
        out.append((len(x), list(zip(spans[::2], spans[1::2])), bytes(b for b, g in zip(x, gone) if not g)))
    return out


def texts(rng, length):
    letters = "ab" if length < 9 else "abcdé"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [piece(length * k // 2) for k in (1, 2, 3, 6)]
    out = [None, "", " ", "a", "a" * (5 * length), "ab" * (3 * length), "é" * length, "\0" * length + "b", "\0" * (length + 1)]
    for _ in range(60):
        out.append("".join(rng.choice([*shared, piece(rng.randrange(1, 2 * length))]) for _ in range(rng.randrange(1, 5))))
    return out + rng.choices(out, k=12) + [out[-1]] * 20


@pytest.mark.parametrize("length", [2, 7, 20, 200])
def test_like_brute_force(spark, length):
    rng = random.Random(length)
    docs = texts(rng, length)
    got = S.remove_repeats(spark.createDataFrame([(None if k % 7 == 0 else k // 2, t, "clash", "clash", k, "clash") for k, t in enumerate(docs)], SCHEMA).withColumnRenamed("n_bytes", "k"), length).collect()
    assert len(got) == len(docs) and {(r.hash, r.block) for r in got} == {("clash", "clash")}
    want = brute(docs, length)
    for r in got:
        assert r.doc_id == (None if r.k % 7 == 0 else r.k // 2)
        assert (r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) == want[r.k], (length, docs[r.k])


def test_many_blocks_and_parts(spark, monkeypatch):
    for name, value in (("LEAST_BLOCK", 2000), ("MOST_BLOCK", 2000), ("MOST_RANGES", 3), ("COMPARED", 10)):
        monkeypatch.setattr(S, name, value)
    docs = texts(random.Random(1), 12)
    got = S.cut_repeats(spark.createDataFrame([(t,) for t in docs], "text string"), 12).collect()
    want = {t or "": kept for t, (_, _, kept) in zip(docs, brute(docs, 12))}
    assert Counter(bytes(r.kept) for r in got) == Counter(want.values())


def test_no_rows_and_long_texts(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh ") for _ in range(3 << 20))
    again = long[(1 << 20) - 100 : (1 << 20) + 150]
    rows = S.remove_repeats(spark.createDataFrame([(1, long), (2, "x" + again + "y"), (3, "long " * 60_000)], "doc_id long, text string")).collect()
    found = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows}
    assert found == {1: [((1 << 20) - 100, (1 << 20) + 150)], 2: [(1, 251)], 3: [(0, 300_000)]}
    with pytest.raises(ValueError):
        S.cut_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 1)


def test_every_window_has_one_entry(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 50)
    rng = np.random.default_rng(2)
    for length in (2, 5, 20):
        g = S.Geometry(length)
        sizes = rng.integers(0, 90, 30)
        data, offsets = rng.integers(97, 99, sizes.sum()).astype(np.uint8), np.append(0, np.cumsum(sizes))
        seen, at = Counter(), {}
        for core, least, most, h in S.entries(data, offsets, g):
            for c, lo, hi, x in zip(core.tolist(), least.tolist(), most.tolist(), h.tolist()):
                for a in range(lo, hi + 1):
                    window = data[c - a : c - a + length].tobytes()
                    seen[c - a] += 1
                    assert 0 <= a < g.half and at.setdefault(window, (a, x)) == (a, x)  # equal windows have the same core
        assert dict(seen) == {s: 1 for lo, hi in zip(offsets, offsets[1:]) for s in range(lo, hi - length + 1)}


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(4)
    for n in (0, 1, 2, 3, 7, 16):
        runs = [sorted(bytes(rng.choices(b"ab\0", k=rng.randrange(0, 9))) for _ in range(rng.randrange(0, 30))) for _ in range(n)]
        out = list(S.merged([(r, list(S.front_coded(r))) for r in runs])) if n else []
        strings = [runs[r][k] for r, k, _ in out]
        assert strings == sorted(s for r in runs for s in r)
        for a, b, (*_, h) in zip(strings, strings[1:], out[1:]):
            assert h == len(os.path.commonprefix([a, b]))


def test_known_prefixes_are_not_compared(monkeypatch):
    seen = []
    real = S.common_prefix
    monkeypatch.setattr(S, "common_prefix", lambda a, b, known: seen.append(known) or real(a, b, known))
    runs = [[b"x" * 50 + bytes([k]) for k in range(j, 60, 3)] for j in range(3)]
    coded = [(r, [0] + [50] * (len(r) - 1)) for r in runs]
    assert len(list(S.merged(coded))) == 60
    assert seen.count(0) <= 3 and all(k >= 50 for k in seen if k)
