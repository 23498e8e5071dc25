"""Prefix tries against brute force, with ranges so small that most nodes lie on a border."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, depth long, words string, turns string"


def brute(rows):
    """The nodes of op12's contract, by its words."""
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in by.items()}
    full = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in full.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = {}
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        leaf = [q for q in below if not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in members)]
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(cs) if len(full[c]) == len(p))
        out[p] = (min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def rows_of(rng, n):
    out = []
    for c in range(n):
        k = rng.choice([1, 1, 2, 3, 5])
        for turn in range(k):
            out.append((c, turn if turn or rng.random() < 0.8 else None, rng.choice(["user", "user", None]), rng.choice(["hi  there", "a b c", "", None, f"w{rng.randrange(3)}"])))
    out += [(1000 + c, t, "user", f"same words {t}") for c in range(40) for t in range(3)]
    out += [(-20, 0, "user", "minus"), (-3, 0, "user", "x"), (None, 0, "user", "nobody"), (2000, 0, "long", "word " * 20_000)]
    out += [(3000, t, "user", f"turn {t}") for t in range(300)] + [(3000 + k, t, "user", f"turn {t}") for k in (1, 2) for t in range(150 * k)]
    rng.shuffle(out)
    return out + out[:3]


@pytest.fixture(scope="module")
def rows():
    return rows_of(random.Random(8), 150)


@pytest.mark.parametrize("turns,fan", [(10**6, 64), (60, 64), (130, 3)])
def test_trie_like_brute_force(spark, rows, monkeypatch, turns, fan):
    monkeypatch.setattr(P, "FAN", fan)
    monkeypatch.setattr(P, "CHUNK_IDS", 7)
    table = spark.createDataFrame([(*r, 1, "clash", "clash") for r in rows], SCHEMA)
    got = P.prefix_trie(P.rebuilt(P.conversation_turns(table)), turns)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_no_conversations_and_none_with_turns(spark):
    assert P.prefix_trie(P.rebuilt(P.conversation_turns(spark.createDataFrame([], SCHEMA)))).collect() == []
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4)  # no conversation 0, one turn, all of it replaced by nothing
    got = P.prefix_trie(P.rebuilt(P.conversation_turns(spark.createDataFrame([(c, 0, "user", "x", 1, "", "")], SCHEMA)))).collect()
    assert [tuple(r) for r in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_one_hot_conversation_over_many_ranges(spark):
    same = spark.range(3000).select(F.col("id").alias("conv_id"), F.array(F.lit(b"a" * 16), F.lit(b"b" * 16)).alias("turns"), F.array(F.lit(2), F.lit(3)).alias("words"))
    got = sorted(P.prefix_trie(same, 500).collect(), key=lambda r: r.depth)
    assert [(r.conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(0, 3000, 1, 1, 5 * 2999), (0, 3000, 1, 1, 5 * 2999), (0, 3000, 0, 1, 3 * 2999)]
    assert got[2].ends_sha256 == hashlib.sha256(",".join(map(str, range(3000))).encode()).hexdigest()
