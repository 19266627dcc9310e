"""Robust maps and one-to-one matches against plain Python."""

import math
import random

import pytest

from ridgeline.operators import blocks, matching, pairs

POINTS = "pair string, id long, x double, y double, u double, v double"


def planted(pair, n, outliers, a, b, tx, ty, rng):
    rows = []
    for i in range(n + outliers):
        x, y = rng.uniform(0, 400), rng.uniform(0, 400)
        u, v = (a * x - b * y + tx + rng.uniform(-1, 1), b * x + a * y + ty + rng.uniform(-1, 1)) if i < n else (rng.uniform(0, 400), rng.uniform(0, 400))
        rows.append((pair, i, x, y, u, v))
    return rows


def test_robust_affine_finds_planted_maps(spark):
    rng = random.Random(3)
    true = {"few": (7, 3, 0.9, 0.3, 5.0, -3.0), "half": (60, 60, 1.1, -0.2, -40.0, 20.0), "large": (900, 600, 0.8, 0.6, 0.0, 9.0)}
    rows = [r for pair, (n, bad, *m) in true.items() for r in planted(pair, n, bad, *m, rng)]
    rows += [("one", 1, 1.0, 2.0, 3.0, 4.0), ("same", 1, 5.0, 5.0, 1.0, 1.0), ("same", 2, 5.0, 5.0, 9.0, 9.0), ("null", 1, None, 2.0, 3.0, 4.0), ("null", 2, 1.0, 2.0, 3.0, None), (None, 1, 1.0, 2.0, 3.0, 4.0)]
    points = spark.createDataFrame(rows, POINTS)
    got = {r["pair"]: r for r in matching.robust_affine(points, "pair").collect()}
    assert got.keys() == true.keys()
    for pair, (n, bad, a, b, tx, ty) in true.items():
        r = got[pair]
        assert r["n"] == n + bad and n <= r["inliers"] <= n + max(2, bad // 20)
        assert math.isclose(r["a"], a, abs_tol=0.02) and math.isclose(r["b"], b, abs_tol=0.02) and abs(r["tx"] - tx) < 4 and abs(r["ty"] - ty) < 4
    held = matching.inliers(points, matching.robust_affine(points, "pair"), "pair").collect()
    assert {p: sum(r["pair"] == p for r in held) for p in true} == {p: got[p]["inliers"] for p in true} and all(r["error"] < 8 for r in held)
    assert matching.robust_affine(points.limit(0), "pair").count() == 0


def test_hypotheses_of_few_points_are_all_their_pairs(spark):
    rng = random.Random(1)
    points = spark.createDataFrame([("g", i, rng.random(), rng.random(), rng.random(), rng.random()) for i in range(5)], POINTS)
    maps = matching.hypotheses(points, ["pair"], 500, 100, 7).collect()
    assert sorted(r["h"] for r in maps) == list(range(20)) and len({(round(r["a"], 9), round(r["b"], 9)) for r in maps}) == 10
    assert matching.hypotheses(points, ["pair"], 12, 3, 7).count() == 6


def greedy(edges):
    taken, used = [], set()
    for by, q, g, cost in sorted(edges, key=lambda e: (e[3], e[1], e[2])):
        if not {(by, "q", q), (by, "g", g)} & used:
            used |= {(by, "q", q), (by, "g", g)}
            taken.append((by, q, g, cost))
    return sorted(taken)


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_take_what_one_greedy_pass_takes(spark, seed):
    rng = random.Random(seed)
    edges = {(rng.choice("ab"), rng.randrange(40), rng.randrange(30)): rng.choice([rng.random(), 0.25, 0.5]) for _ in range(600)}
    edges |= {("chain", k // 2 + k % 2, k // 2): float(k) for k in range(12)}
    rows = [(*k, c) for k, c in edges.items()]
    extra = [(None, 1, 1, 0.0), ("a", None, 1, 0.0), ("a", 1, None, 0.0), ("a", 1, 1, None), ("a", 1, 2, float("nan")), *[(b, q, g, c + 1) for b, q, g, c in rows[:5]]]
    df = spark.createDataFrame(rows + extra, "by string, q long, g long, cost double").selectExpr("*", "q as k", "'x' as note")
    got = matching.one_to_one(df, "by")
    assert got.columns == df.columns and sorted((r["by"], r["q"], r["g"], r["cost"]) for r in got.collect()) == greedy(rows)
    assert matching.one_to_one(df.limit(0), "by").count() == 0


def test_two_way_neighbours_are_those_of_either_side(spark):
    rng = random.Random(5)
    unit = lambda: (lambda v: [x / math.hypot(*v) for x in v])([rng.gauss(0, 1) for _ in range(8)])
    schema = "id long, owner long, v array<double>"
    a, b = (spark.createDataFrame([(i, 0, unit()) for i in range(lo, lo + n)] + [(None, 0, unit()), (lo + n, 0, None)], schema) for lo, n in ((0, 30), (20, 45)))
    both = blocks.nearest_both(a, b, 3).collect()
    rows = lambda df: sorted((r["q"], r["g"], r["d"], r["rank"]) for r in df.collect())
    assert sorted((r["of"], r["to"], r["d"], r["rank"]) for r in both if not r["back"]) == rows(blocks.nearest(a, b, 3))
    assert sorted((r["of"], r["to"], r["d"], r["rank"]) for r in both if r["back"]) == rows(blocks.nearest(b, a, 3))
    one = spark.createDataFrame([(100, 0, unit())], schema)
    assert pairs.two_way_ratio(blocks.nearest_both(one, one.selectExpr("id + 1 AS id", "owner", "v"), 2)).count() == 1
    assert blocks.nearest_both(a, b.limit(0), 3).count() == 0
