"""Distances, whole numbers and normalisations that must be what SQL and plain Python have, also at size."""

import math
import time

import duckdb
import numpy as np

from ridgeline.functions import arrays
from ridgeline.operators import blocks, negatives
from ridgeline.plans import all_queries

QUERIES, ORACLES = all_queries()


def units(n, seed, width=64):
    v = np.random.default_rng(seed).normal(size=(n, width))
    return (v / np.linalg.norm(v, axis=1)[:, None]).astype(np.float32).astype(float)


def distance(a, b):
    dot = 0.0
    for x, y in zip(a, b, strict=True):
        dot += x * y
    return math.floor(math.sqrt(max(2 - 2 * dot, 0)) * 1e12 + 0.5) / 1e12


def test_negatives_of_both_directions_tie_as_in_sql(spark):
    v = units(200, 3).tolist()
    rows = [(0, i, i, i, 0, 0.0, 0.0, x, x[::-1]) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "batch long, id long, owner long, point long, frame int, x double, y double, v array<double>, p array<double>")
    found = {r["anchor"]: [tuple(n) for n in r["negatives"]] for r in negatives.hard_negatives(df, 1 << 30).collect()}
    d = [[distance(x, y[::-1]) for y in v] for x in v]
    for i in range(len(v)):
        assert found[i] == sorted([(d[i][j], 0, j) for j in range(len(v)) if j != i] + [(d[j][i], 1, j) for j in range(len(v)) if j != i])


def test_halves_of_float_products_round_as_in_sql(spark, tmp_path):
    near = [np.float32((k + 0.5) / 100) for k in range(-60, 60)]
    odd = [float(x) for x in near if float(x * np.float32(100)) % 1 == 0.5 and (float(x) * 100) % 1 != 0.5]
    assert len(odd) >= 10
    spark.createDataFrame([(i, [*odd[:8], *([0.25] * 56)], 1) for i in range(4)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("template_hashes", "templates_to_build"):
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
        assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_sums_of_a_vector_are_not_worked_out_for_each_value(spark):
    v = np.abs(units(1, 5, 1500)[0])
    began = time.time()
    df = spark.createDataFrame([(v.tolist(),)], "v array<double>")
    one = df.select(arrays.unit(df.v).alias("u"), arrays.rootsift(df.v).alias("r"), arrays.standardised(df.v).alias("s")).first()
    root = np.sqrt(v / (v.sum() + 1e-12))
    assert np.allclose(one["u"], v / np.linalg.norm(v)) and np.allclose(one["r"], root / (np.linalg.norm(root) + 1e-12)) and np.allclose(one["s"], (v - v.mean()) / v.std())
    assert time.time() - began < 20


def test_blocks_meet_without_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(blocks, "GALLERY", 8)
    monkeypatch.setattr(blocks, "PARTS", 3, raising=False)
    v = units(90, 8)
    rows = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "id long, owner long, v array<double>")
    near = blocks.nearest(rows.where("id % 3 = 0"), rows, 4)
    got = sorted((r["q"], r["rank"], r["g"], r["d"]) for r in near.collect())
    want = [(q, k + 1, g, d) for q in range(0, 90, 3) for k, (d, g) in enumerate(sorted((distance(v[q], v[g]), g) for g in range(90) if g != q)[:4])]
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-11)
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()


def test_pooled_metrics_are_those_of_all_pairs(spark):
    from ridgeline.operators import verification

    v = units(120, 11, 8)
    v[40:60] = v[40]  # ties
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)] + [(200, None, v[0].tolist()), (201, 1, None)], "id long, owner long, v array<double>")
    asked = rows.where("id % 2 = 0")
    pairs = blocks.nearest(asked, rows, 1 << 30).selectExpr("d", "q % 3 = g % 3 AS positive")
    want = verification.distance_metrics(pairs, positive_at=(0.95,)).first()
    for cell_rows, at_once in ((1 << 18, None), (50, 900)):
        got = verification.pooled_metrics(asked, rows, (0.95,), cell_rows, at_once)
        one = got.first()
        assert one.asDict().keys() == want.asDict().keys() and all(math.isclose(one[k], want[k], rel_tol=1e-12, abs_tol=1e-12) for k in want.asDict())
    one_owner = verification.pooled_metrics(asked.where("owner = 0"), rows.where("owner = 0")).first()
    assert one_owner["roc_auc"] is None and one_owner["neg_mean"] is None and one_owner["pos_mean"] > 0
    assert verification.pooled_metrics(asked.limit(0), rows).first()["pos_mean"] is None


def test_all_distances_are_not_shuffled_as_rows(spark, monkeypatch):
    monkeypatch.setattr(blocks, "nearest", lambda *a, **k: (_ for _ in ()).throw(AssertionError("ranks every pair")))
    assert QUERIES["distance_metrics_exact"](spark, "/root/testdata/sf0.001").count() == 1


def test_pairs_within_a_radius_are_hashed_not_sorted(spark):
    from ridgeline.operators import pairs

    rng = np.random.default_rng(4)
    rows = [(0, i, float(x), float(y), float(a)) for i, (x, y, a) in enumerate(zip(rng.integers(0, 30, 200), rng.integers(0, 30, 200), rng.integers(0, 4, 200) * 45, strict=True))]
    df = spark.createDataFrame(rows, "g int, id long, x double, y double, angle double")
    near = pairs.nearby(df, df.withColumn("x", df.x + 1), "g", 6.0, 20.0)
    got = {r["a"]: (r["b"], r["distance"]) for r in near.collect()}
    want = {}
    for _, i, x, y, a in rows:
        found = []
        for _, j, u, v, b in rows:
            d, turn = math.hypot(u + 1 - x, v - y), abs((b - a + 180) % 360 - 180)
            if d <= 6:
                found.append((d + 6 * min(min(turn, 180 - turn) / 20, 2), j, d))
        if found:
            want[i] = min(found)[1:]
    assert got == want
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan.split("== Initial Plan ==")[0] and "min(cost" in plan
