import math
import random

from scriptorium.llm import topk


def brute(rows, k=10):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(1024.0 * x) for x in v):
            good[i] = min(good.get(i, list(v)), list(v))
    ints = {i: [math.floor(1024.0 * x) for x in v] for i, v in good.items()}
    out = []
    for q in sorted(ints):
        if q % 100 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:k]
            out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(scored)]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", True) for i, v in rows], "vec_id long, embedding array<double>, query string, is_query boolean")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.exact_top_k(df, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.5, -0.25, r.uniform(-1, 1)]) for _ in range(r.choice([6, 8]))]) for i in range(301)]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, []), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (100, [0.5]), (-200, [1e12, 1.0]), (9, [1e308, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(300, [1.0])]) == []


def test_ties_go_to_smaller_ids(spark):
    rows = [(100, [1.0])] + [(i, [1.0]) for i in range(1, 40)]
    assert [x[2] for x in run(spark, rows)] == list(range(1, 11))


def test_empty(spark):
    assert run(spark, []) == []
