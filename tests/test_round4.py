"""Whole tables, and what must not be broadcast, shuffled or sorted at size."""

import math

import numpy as np

from ridgeline.operators import blocks
from ridgeline.plans import all_queries
from tests.test_round3 import distance, units

QUERIES, ORACLES = all_queries()


def embeddings(spark, path, v, labels):
    spark.createDataFrame([(i, x.tolist(), k) for i, (x, k) in enumerate(zip(v, labels, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")


def test_ratio_matches_ask_for_every_vector(spark, tmp_path, monkeypatch):
    v = units(90, 21)
    v[30:40] = v[30]  # copies: no ratio holds between them
    v[70] = v[71] + 1e-3
    embeddings(spark, tmp_path, v, [i % 3 for i in range(len(v))])
    v = v.astype(np.float32).astype(float)
    want = []
    for q in range(len(v)):
        (a, g), (b, _) = sorted((distance(v[q], v[g]), g) for g in range(len(v)) if g != q)[:2]
        if a < 0.97 * b and b > 1e-12:
            want.append((q, g, round(a, 6)))
    assert any(q % 20 for q, _, _ in want)
    for block, gallery, side in ((512, 2048, 8), (16, 8, 3)):
        monkeypatch.setattr(blocks, "BLOCK", block)
        monkeypatch.setattr(blocks, "GALLERY", gallery)
        monkeypatch.setattr(blocks, "SIDE", side)
        got = sorted(tuple(r) for r in QUERIES["ratio_matches"](spark, str(tmp_path)).select("q", "g", "d").collect())
        assert [x[:2] for x in got] == [x[:2] for x in want] and all(math.isclose(x[2], y[2], abs_tol=1e-6) for x, y in zip(got, want, strict=True))


def test_spelling_variants_meet_without_a_broadcast(spark):
    from ridgeline.llm import variants

    words = spark.createDataFrame([("harbour", 50), ("harbor", 5), ("harbours", 7), ("garbour", 1), ("lantern", 9)], "word string, n long")
    got = variants.variant_forms(words)
    for df in (variants.nearest(words), got):
        df.collect()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {r["word"]: (r["form"], r["root"]) for r in got.collect()} == {"harbour": (None, "harbour"), "harbor": ("harbour", "harbour"), "harbours": ("harbour", "harbour"), "garbour": ("harbour", "harbour"), "lantern": (None, "lantern")}


def test_buckets_of_fingerprints_meet_without_a_broadcast(spark, tmp_path, monkeypatch):
    from ridgeline.llm import simhash

    plans, write = [], simhash.staged
    monkeypatch.setattr(simhash, "staged", lambda df, name, **k: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df, name, **k))
    fps = [(x << 8 | y,) for x in (3, 5, 1000) for y in (0, 1, 2)]
    spark.createDataFrame(fps, "fp long").write.parquet(f"{tmp_path}/fps")
    links = simhash.near_links(spark.read.parquet(f"{tmp_path}/fps"), 2).collect()
    assert {x for r in links for x in r} >= {3 << 8, 3 << 8 | 1, 1000 << 8}
    assert plans and not any("Broadcast" in p for p in plans)


def test_only_segments_that_may_hold_equal_strings_are_sorted(spark, monkeypatch):
    from ridgeline.llm import anchors, suffix_dedup

    rng = np.random.default_rng(6)
    noise = lambda n: rng.integers(97, 123, n, np.uint8).tobytes()
    long_, short = noise(150), noise(60)
    texts = [noise(200) + (long_[k % 9 : 101 + k % 50] if k < 40 else short) + noise(200) for k in range(80)]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    ah, _, lo, hi = anchors.segments(suffix_dedup.byte_hashes(data.tobytes()), ends, 100, 32)
    n = hi - lo + 1
    cut = [data.tobytes()[a : a + m + 99] for a, m in zip(lo, n, strict=True)]
    edge = np.append(0, np.cumsum([len(c) for c in cut]))
    tiers = suffix_dedup.stretches(np.frombuffer(b"".join(cut), np.uint8), edge, ah.view(np.int64), n, 100, 32)
    assert not (tiers == 1).any()
    windows = [{c[k : k + 100] for k in range(m)} for c, m in zip(cut, n, strict=True)]
    alike, sharing = 0, set()
    for i in range(len(cut)):
        for j in range(i):
            same = bool(((tiers[i] == tiers[j]) & (tiers[i] != 0)).any())
            if windows[i] & windows[j]:
                assert same and ah[i] == ah[j]
                alike += 1
            sharing |= {i, j} if same else set()
    phrase = {i for i, c in enumerate(cut) if short in c and (ah == ah[i]).sum() > 1}
    assert alike and len(phrase) > 30 and not phrase & sharing
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text binary")
    unsure = anchors.judged(anchors.anchored(docs, suffix_dedup.byte_hashes, 100, 32)).where(f"kind = {anchors.UNSURE}").select("key", "ah", "lo", "n")
    monkeypatch.setattr(suffix_dedup, "SHARD", 1000)
    assert suffix_dedup.repeated_spans(docs, unsure, 100).rdd.getNumPartitions() > 5  # not one shard of all


def test_an_area_with_certain_decimals_needs_no_order(spark, monkeypatch):
    from ridgeline.operators import verification

    monkeypatch.setattr(blocks, "SIDE", 3)
    monkeypatch.setattr(blocks, "GALLERY", 40)
    v = units(150, 12, 8)
    v[42:60:3] = v[42]  # ties of one owner
    v[7] = np.nan
    rows = spark.createDataFrame([(i, i % 3, x.tolist()) for i, x in enumerate(v)] + [(200, None, v[0].tolist()), (201, 1, None)], "id long, owner long, v array<double>")
    asked = rows.where("id % 2 = 0")
    pairs = [(distance(v[q], v[g]), q % 3 == g % 3) for q in range(0, 150, 2) for g in range(150) if q != g and 7 not in (q, g)]
    want = verification.distance_metrics(spark.createDataFrame(pairs, "d double, positive boolean")).first()
    ordered = []
    monkeypatch.setattr(verification, "each", lambda *a, e=verification.each, **k: ordered.append(1) or e(*a, **k))
    for digits, fine, order in ((3, 1 << 22, False), (6, 16, True)):
        got = verification.pooled_metrics(asked, rows, at_once=900, digits=digits, fine=fine).first()
        assert bool(ordered) == order, "orders all distances"
        for k in want.asDict():
            assert math.isclose(got[k], want[k], abs_tol=10.0**-digits if k == "roc_auc" else 1e-10), k
        assert round(got["roc_auc"], digits) == round(want["roc_auc"], digits)
