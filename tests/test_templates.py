"""Template tables, published versions, running sums, early stops and loss values on small cases with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import events, losses, negatives, numbering, stages, verification
from ridgeline.sources import templates, versions
from ridgeline.sources.templates import Contract


def test_contracts_travel_with_the_table(spark, tmp_path):
    df = spark.createDataFrame([(1, [[1.0]])], "id long, descriptors array<array<double>>")
    binary = Contract("binary", "hamming", 256, "packed_uint8", "little", "walsh", "t1")
    templates.with_contract(df, binary).write.parquet(f"{tmp_path}/t")
    back = spark.read.parquet(f"{tmp_path}/t")
    assert templates.contract_of(back) == binary and binary.width == 32 and templates.comparable(back, back) == binary
    with pytest.raises(ValueError, match="bitorder is 'little' and 'big'"):
        templates.comparable(back, templates.with_contract(df, Contract("binary", "hamming", 256, "packed_uint8", "big", "walsh", "t1")))
    with pytest.raises(ValueError, match="no contract"):
        templates.contract_of(df)
    with pytest.raises(ValueError, match="other fields"):
        templates.contract_of(df.withMetadata("descriptors", {templates.KEY: '{"kind": "float"}'}))
    for bad in (("float", "hamming"), ("float", "l2", 128, "packed_uint8"), ("binary", "hamming", 12, "packed_uint8", "big"), ("other",)):
        with pytest.raises(ValueError):
            Contract(*bad)


def test_hashes_tell_contents_apart(spark):
    rows = [(1, [1, 2], [3]), (2, [1, 2], [3]), (3, [1], [2, 3]), (4, [], [3]), (5, None, [3]), (6, [1, None], [3]), (7, [12], [3])]
    got = {r["id"]: r["h"] for r in spark.createDataFrame(rows, "id int, a array<int>, b array<int>").select("id", templates.content_hash(F.col("a"), F.col("b")).alias("h")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 6


def test_reuse_and_lists_of_templates(spark):
    stored = spark.createDataFrame([("p", "a", "h1"), ("p", "b", "h2"), ("p", "b", "h2"), ("q", "c", "h3"), (None, "d", "h4")], "identity string, image string, hash string")
    images = spark.createDataFrame([("p", "a", "h1"), ("p", "b", "new"), ("q", "a", "h1"), ("q", "c", None)], "identity string, image string, hash string")
    assert sorted(r["identity"] + r["image"] for r in templates.to_build(images, stored).collect()) == ["pb", "qa", "qc"]
    assert sorted(tuple(r) for r in templates.identity_templates(stored).collect()) == [("p", ["a", "b"], 2), ("q", ["c"], 1)]


def test_readers_see_whole_versions(spark, tmp_path):
    folder, one = str(tmp_path / "store"), spark.range(3)
    assert versions.published(spark, folder) == {}
    assert versions.publish({"a": one, "b": spark.range(5)}, folder) == 1
    with pytest.raises(Exception):  # noqa: B017  the second table fails, so the version isn't listed
        versions.publish({"a": spark.range(9), "b": one.select(F.raise_error(F.lit("stop")))}, folder)
    assert {k: v.count() for k, v in versions.published(spark, folder).items()} == {"a": 3, "b": 5}
    assert versions.publish({"a": spark.range(7)}, folder) == 2
    assert {k: v.count() for k, v in versions.published(spark, folder).items()} == {"a": 7}
    assert {k: v.count() for k, v in versions.published(spark, folder, 1).items()} == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        versions.publish({}, folder)


def test_running_sums(spark):
    rows = [(float(k), k % 3, 1) for k in range(50)]
    got = numbering.running_sums(spark.createDataFrame(rows, "d double, p long, n long").repartition(7), ["d"], ["p", "n"]).collect()
    for r in got:
        assert r["upto_p"] == sum(p for d, p, _ in rows if d <= r["d"]) and r["upto_n"] == r["d"] + 1 and r["all_n"] == 50 and r["all_p"] == sum(p for _, p, _ in rows)


def test_early_stops(spark):
    scores = {"a": [1.0, 1.04, 1.2, 1.1, 1.0, 1.1, 9.0], "b": [0.5, -1.0, 0.56], "c": [-1.0, -1.05, -1.2]}
    rows = [(run, k, s) for run, v in scores.items() for k, s in enumerate(v)] + [("d", 0, None), (None, 0, 1.0), ("d", 1, math.nan)]
    got = events.early_stop(spark.createDataFrame(rows, "run string, step int, score double"), 0.1, 3).collect()
    assert sorted((r["run"], r["step"], r["reference"], r["stale"], r["stopped"]) for r in got) == [
        ("a", 0, 1.0, 0, False), ("a", 1, 1.0, 1, False), ("a", 2, 1.2, 0, False), ("a", 3, 1.2, 1, False), ("a", 4, 1.2, 2, False), ("a", 5, 1.2, 3, True),
        ("b", 0, 0.5, 0, False), ("b", 1, 0.5, 1, False), ("b", 2, 0.56, 0, False), ("c", 0, -1.0, 0, False), ("c", 1, -1.05, 0, False), ("c", 2, -1.05, 1, False),
    ]


def test_both_kinds_are_always_there(spark):
    empty = spark.createDataFrame([], "genuine boolean, score double, geometry double, texture double, evaluated boolean, available boolean, decision string")
    got = verification.score_summary(empty, 0.5).collect()
    assert sorted(r["genuine"] for r in got) == [False, True] and all(v == 0 for r in got for k, v in r.asDict().items() if k != "genuine")
    columns = {c for c in (*stages.RATES.values(), *stages.MEANS.values(), "templates_with_candidates")}
    one = spark.createDataFrame([(1,)], "label int").select("label", *[F.lit(2.0).alias(c) for c in columns])
    rows = {r["kind"]: r for r in stages.stage_coverage(one).collect()}
    assert rows["genuine"]["count"] == 1 and rows["impostor"]["count"] == 0 and rows["impostor"]["candidate_ready"] == 0


def test_metrics_without_rounding_and_without_a_kind(spark):
    rows = [(0.1000001, True), (0.1000004, False), (0.2, True), (0.3, False), (None, True), (math.inf, False), (0.1, None)]
    df = spark.createDataFrame(rows, "d double, positive boolean")
    exact, coarse = verification.distance_metrics(df).head(), verification.distance_metrics(df, 6).head()
    assert exact["roc_auc"] == 0.75 and coarse["roc_auc"] == 0.625
    only = verification.distance_metrics(df.where("positive")).head()
    assert only["neg_mean"] is None and only["neg_p01"] is None and only["roc_auc"] is None and math.isclose(only["pos_mean"], 0.15, abs_tol=1e-6)


def test_losses_against_plain_matrices(spark):
    rng = np.random.default_rng(1)
    rows, want = [], {}
    for batch, n in ((1, 7), (2, 1), (3, 40)):
        a, p, ta, tp = (rng.uniform(-1, 1, (n, k)) for k in (4, 4, 6, 6))
        rows += [(batch, *(m[i].tolist() for m in (a, p, ta, tp))) for i in range(n)]
        x, t = np.concatenate([a, p]), np.concatenate([ta, tp])
        u, w = x / np.linalg.norm(x, axis=1, keepdims=True), t / np.linalg.norm(t, axis=1, keepdims=True)
        gap, off = (u @ u.T - w @ w.T) ** 2, np.cov(x.T) ** 2
        m = len(x)
        want[batch] = ((gap.sum() - np.trace(gap)) / (m * (m - 1)), (0.5 * (1 - a * p)).mean(), ((1 - abs(x)) ** 2).mean(), (x.mean(0) ** 2).mean(), (off.sum() - np.trace(off)) / 12)
    df = spark.createDataFrame([*rows, (3, None, [0.0] * 4, [0.0] * 6, [0.0] * 6)], "batch long, anchor array<double>, positive array<double>, anchor_teacher array<double>, positive_teacher array<double>")
    for r in losses.binary_losses(df.repartition(3), 4, 6).collect():
        assert np.allclose([r[k] for k in losses.WEIGHTS], want[r["batch"]]) and math.isclose(r["loss"], sum(r[k] * w for k, w in losses.WEIGHTS.items()))
    with pytest.raises(ValueError):
        losses.binary_losses(df, 4, 6, {"balance": -1.0})


def test_validation_tells_the_pool_from_what_was_chosen(spark):
    """The pool of candidates stays the same while the chosen ones change: rates stay, the loss doesn't."""
    def rows(first):
        pool = {1: [0.1, 0.7, 0.8, 0.9], 2: [0.6, 0.7, 0.8, 0.9], 3: []}
        order = lambda v: sorted(v, key=lambda d: (d != first, d))
        return spark.createDataFrame([(0, a, 0.2, [(d, 0, k) for k, d in enumerate(order(v))]) for a, v in pool.items()], "batch long, anchor long, positive_dist double, negatives array<struct<d:double,direction:int,candidate:long>>")

    near, far = (negatives.validation_summary(rows(d), 1, 0.8).head() for d in (0.1, 0.7))
    assert near["fpr_at_tpr95"] == far["fpr_at_tpr95"] == 0.125 and near["neg_mean"] == far["neg_mean"] and near["loss"] > far["loss"]
    assert (near["valid_anchor_count"], near["skipped_anchor_count"], near["batches"]) == (2, 1, 1) and math.isclose(near["valid_anchor_ratio"], 2 / 3) and near["pos_p95"] == 0.2
    assert math.isclose(near["loss"], (0.9 + 0.4) / 2) and math.isclose(far["loss"], 0.3) and near["active_triplet_ratio"] == 1
    with pytest.raises(Exception, match="zero legal negatives"):
        negatives.validation_summary(rows(0.1).where("anchor = 3")).collect()


def test_scans_end_with_the_first_good_template(spark):
    rows = [("q", 1, 1, "a", 0.5, 0.1, 3), ("q", 1, 2, "b", 0.9, 0.1, 0), ("q", 1, 3, "c", 0.95, 0.2, 5), ("q", 2, 1, "d", 0.4, 0.1, None), ("q", 2, 2, "e", 0.4, 0.3, 1), ("q", 2, 3, "f", 0.4, 0.3, 1), ("q", 3, 1, "g", None, None, None)]
    df = spark.createDataFrame(rows, "q string, owner int, pos int, template string, score double, quality double, k int")
    got = {r["owner"]: r for r in verification.identity_fusion(df, 0.8, ("k",), ("k",)).collect()}
    assert (got[1]["best_template"], got[1]["templates"], got[1]["stopped"], got[1]["with_k"], got[1]["max_k"]) == ("b", 2, True, 1, 3.0)
    assert (got[2]["best_template"], got[2]["best_pos"], got[2]["stopped"]) == ("e", 2, False) and (got[3]["best_score"], got[3]["templates"]) == (0.0, 1)
    full = {r["owner"]: r for r in verification.identity_fusion(df).collect()}
    assert full[1]["best_template"] == "c" and not full[1]["stopped"] and math.isclose(full[1]["top_mean"], 2.35 / 3)


def test_arrays_of_numbers(spark):
    from ridgeline.functions import arrays

    df = spark.createDataFrame([(1, [3.0, 4.0, 0.0]), (2, [0.0, 0.0, 0.0]), (3, [])], "id int, v array<double>")
    v = F.col("v")
    mean, std = arrays.mean_std(v)
    got = {r["id"]: r for r in df.select("id", arrays.unit(v).alias("unit"), arrays.rootsift(v).alias("root"), mean.alias("mean"), std.alias("std"), arrays.standardised(v).alias("z"), arrays.share_above(v, 3).alias("share")).collect()}
    assert got[1]["unit"] == [0.6, 0.8, 0.0] and got[2]["unit"] == [0.0] * 3 and got[2]["z"] == [0.0] * 3
    assert np.allclose(got[1]["root"], np.sqrt([3 / 7, 4 / 7, 0])) and math.isclose(got[1]["std"], np.std([3, 4, 0])) and math.isclose(got[1]["share"], 1 / 3)
    assert got[3]["mean"] is None and got[3]["share"] is None and got[3]["unit"] == []
    rng = np.random.default_rng(3)
    bits = [rng.integers(0, 2, n).tolist() for n in (8, 13, 64)]
    for b in bits:
        row = spark.createDataFrame([(b,)], "b array<int>").select(*[arrays.packed(F.col("b"), len(b), o).alias(o) for o in ("little", "big")]).head()
        assert all(row[o] == np.packbits(b, bitorder=o).tolist() for o in ("little", "big"))
    signs = df.where("id = 1").select(arrays.bits_of(v, False).alias("a"), arrays.bits_of(v).alias("b")).head()
    assert signs["a"] == [1, 1, 0] and signs["b"] == [1, 1, 1]
    assert arrays.transform_id("t", 8, "big", True) == arrays.transform_id("t", 8, "big", True) != arrays.transform_id("t", 8, "little", True)
    one = lambda *x: df.limit(1).select(arrays.checkpoint_score(*[F.lit(y).cast("double") for y in x]).alias("s")).head()["s"]
    best = one(0.6, 0.2, 0.7, 0.2, 0.4)
    assert math.isclose(best, 0.69) and all(one(*x) > best for x in ((0.5, 0.2, 0.7, 0.2, 0.4), (0.6, 0.1, 0.7, 0.2, 0.4), (0.6, 0.2, 0.8, 0.2, 0.4), (0.6, 0.2, 0.7, 0.1, 0.4), (0.6, 0.2, 0.7, 0.2, 0.3)))
    assert one(None, None, math.nan, math.inf, None) == 0.0
