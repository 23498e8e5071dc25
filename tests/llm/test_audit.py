"""Filter audits against the definition, order by order."""

import random
import re
from collections import Counter
from itertools import permutations
from math import factorial

from granary.llm import filter_audit as audit

SCHEMA = "doc_id long, text string, source string, part string, A string, hash long, n_chars long"


def brute(docs, labels):
    """(part, order, step): the seven counts, by applying every order to every document."""
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = []
    for i, t, source, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        said = [(q, x) for d, q, x in labels if d == i and i is not None]
        rows.append((source or "", {f for f in fails if fails[f]}, any(q == 1 for q, _ in said), any(x == 1 for _, x in said)))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        own = [r[1:] for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                hit, stay = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                out[part, "".join(order), k + 1] = (len(stay), len(hit), sum(f in r[0] for r in own) - len(hit), sum(r[0] == {f} for r in own), sum(r[1] for r in hit), sum(r[2] for r in hit))
                shapley[part, f] += len(hit)
                left = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, docs, labels):
    table = spark.createDataFrame([(*d, "clash", "clash", 1, 2) for d in docs], SCHEMA)
    flagged = audit.document_failures(table, spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, good string"))
    got = audit.audit_filters(flagged, list("ABCDE"), marks=("good", "toxic")).collect()
    found = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}
    assert len(found) == len(got)
    return found


def test_audit_like_every_order(spark):
    rng = random.Random(5)
    docs = [(None, None, None), (None, "", "s"), (3, None, ""), (4, "", "s"), (4, "", "s"), (5, "\x0b\x0c  \n", None), (6, "A# b", "s"), (7, "long " * 30_000, "s"), (8, "w" * 100_000, "t"), (9, "é" * 99 + "A" * 2, "t"), (10, "é" * 98 + "A" * 2, "t"), (11, "a\x85b\xa0c", "t")]
    for k in range(150):
        n = rng.choice([3, 199, 200, 201])
        t = " ".join(rng.choice(["a", "B", "c#", f"w{rng.randrange(10**5)}", f"x{rng.randrange(10**5)}"]) if k % 2 else f"w{rng.randrange(10**5)}" for _ in range(n))
        docs.append((rng.randrange(1000, 1100), t, rng.choice(["s", "s", "s", "t", None])))
    docs += [rng.choice(docs) for _ in range(30)] + [(rng.randrange(900, 1200), rng.choice(docs)[1], "s") for _ in range(60)]
    labels = [(None, 1, 1), (3, None, 1), (4, 1, None), (4, 0, 1)] + [(d[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d in docs if rng.random() < 0.6]
    assert run(spark, docs, labels) == brute(docs, labels)


def test_no_documents_or_labels(spark):
    assert run(spark, [], []) == {}
    one = run(spark, [(1, "only one", None)], [])
    assert len(one) == 600 and sum(v[1] for (_, o, k), v in one.items() if o == "ABCDE") == 1


def test_lattice_counts_orders():
    for n in range(1, 7):
        edges = audit.lattice(n)
        assert len(edges) == n << (n - 1) and sum(w for *_, w in edges) == n * factorial(n)
        for s, f, w in edges:
            k = s.bit_count()
            assert w == factorial(k) * factorial(n - k - 1)
