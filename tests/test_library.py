"""Learning libraries in batch and as a stream, gates, sources: small cases, and plain Python where SQL can't express them."""

import pytest
from pyspark.sql import functions as F

from ridgeline.operators import geometry, library
from ridgeline.plans import all_queries
from ridgeline.sources import files, images
from ridgeline.streaming.library import learning_stream

SF = "/root/testdata/sf0.001"
ROWS = "identity long, kind int, ord long, query string, content string, score double, matched string, admissible boolean"
FULL = [
    (1, 0, 0, "s0", "c0", None, None, True), (1, 0, 1, "s1", "c1", None, None, True),
    (1, 1, 10, "a", "ca", 0.2, "s0", True), (1, 1, 11, "a", "ca", 0.9, "zz", True), (1, 1, 12, "a", "ca", 0.9, "s1", True),
    (1, 1, 13, "b", "ca", 0.9, "s0", True), (1, 1, 14, "b", "cb", 0.9, "a", False), (1, 1, 15, "b", "cb", 0.9, "s0", True),
    (2, 1, 1, "q", "cq", 0.9, "s0", True), (2, 1, 2, None, None, None, None, None),
]
WANT = {
    (1, 10): ("unlock_failed", "", "s0 s1"), (1, 11): ("matched_template_not_in_library", "", "s0 s1"), (1, 12): ("accepted", "", "a s1 s0"),
    (1, 13): ("duplicate_content", "", "s0 a s1"), (1, 14): ("not_admissible", "", "a s0 s1"), (1, 15): ("accepted", "a", "b s0 s1"),
    (2, 1): ("matched_template_not_in_library", "", ""), (2, 2): ("unlock_failed", "", ""),
}


def test_learning_log(spark):
    rows = spark.createDataFrame(FULL, ROWS)
    seeds = rows.where("kind = 0").select("identity", F.col("ord").alias("rank"), F.col("query").alias("template"), "content")
    got = library.learning_log(seeds, rows.where("kind = 1"), size=3).collect()
    assert {(r["identity"], r["ord"]): (r["reason"], r["replaced"], " ".join(r["library"])) for r in got} == WANT
    assert library.learning_log(seeds, rows.where("kind = 9")).count() == 0


def test_full_of_protected():
    entries = [["s0", "c0", True], ["s1", "c1", True]]
    assert library.learn(entries, "q", "cq", 0.9, "s1", True, 0.55, 2) == (True, False, "", "template_library_full_and_all_templates_protected")
    assert [e[0] for e in entries] == ["s1", "s0"]


def test_learning_log_query_against_plain(spark):
    got = all_queries()[0]["learning_log"](spark, SF).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["ord"]):
        mine, seen = by.setdefault(r["identity"], ["s0", "s1"]), r["ord"]
        if seen % 10 / 10 >= 0.55 and seen % 3 < 2:
            mine.remove(f"s{seen % 3}")
            mine.insert(0, f"s{seen % 3}")
            if r["learned"]:
                if len(mine) >= 5:
                    mine.remove([m for m in mine if m[0] == "e"][-1])
                mine.insert(0, r["query"])
            else:
                assert r["reason"] == "duplicate_content" or seen % 4 == 0
        assert mine == r["library"]
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").count() and any(r["replaced"] for r in got)


def test_learning_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in (FULL[:5], FULL[5:]):
        spark.createDataFrame(part, ROWS).coalesce(1).write.mode("append").parquet(source)
    stream = learning_stream(spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source), size=3)
    run = stream.writeStream.format("memory").queryName("learned").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert run.awaitTermination(240)
    assert {(r["identity"], r["ord"]): (r["reason"], r["replaced"], " ".join(r["library"])) for r in spark.table("learned").collect()} == WANT


def test_as_of_edges(spark):
    rows = spark.createDataFrame([(1, 5.0, "x"), (1, 25.0, "y"), (2, 5.0, "z"), (None, 5.0, "n")], "k long, at double, tag string")
    versions = spark.createDataFrame([(1, 5.0, 7), (1, 5.0, 8), (1, 6.0, 9), (2, 6.0, 1), (None, 1.0, 3)], "k long, at double, v long")
    assert {r["tag"]: r["v"] for r in library.as_of(rows, versions, "k", "at", 10.0, "v").collect()} == {"x": 8, "y": 9, "z": None, "n": None}


def test_candidate_gate(spark):
    names = "id int, x_a double, y_a double, angle_a double, size_a double, std_a double, x_b double, y_b double, angle_b double, size_b double, std_b double, width int, height int, rotation double, scale double, expanded boolean"
    base = [50.0, 50.0, 10.0, 4.0, 9.0, 50.0, 50.0, 200.0, 4.0, 9.0, 100, 100, 10.0, 1.0, True]
    changed = lambda i, **at: (i, *[at.get(f"c{k}", v) for k, v in enumerate(base)])
    rows = [changed(1), changed(2, c0=7.9), changed(3, c7=60.0), changed(4, c7=60.0, c14=False), changed(5, c8=6.0), changed(6, c9=4.0), changed(7, c5=92.0), changed(8, c5=None)]
    assert {r["id"] for r in geometry.candidate_gate(spark.createDataFrame(rows, names)).collect()} == {1, 4}


def test_sources(spark, tmp_path):
    root = tmp_path / "images"
    for name in ("f1/a.png", "f1/a.bmp", "f2/b.BMP", "f2/c.txt", "top.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    found = images.image_files(spark, str(root), ("bmp", "png"))
    got = {(r["finger_id"], r["image_id"], r["path"].rsplit(".", 1)[1]) for r in images.sample_index(found, ("bmp", "png")).collect()}
    assert got == {("f1", "a", "bmp"), ("f2", "b", "BMP"), ("unknown_finger", "top", "png")}
    with pytest.raises(ValueError, match="1 of 4"):
        images.strict_images(found)
    strict = {r["image_id"][:3] for r in images.strict_images(found.where("rel != 'top.png'")).collect()}
    assert strict == {"a__", "b"}


def test_csv(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("﻿finger_id,image_pair_id,image_a_id,image_b_id,x_a,y_a,x_b,y_b\nf,p,a,b,1.5,2,3,4\n", encoding="utf-8")
    rows = files.read_text_csv(spark, str(path))
    assert rows.columns[0] == "finger_id" and files.checked_pairs(rows).head()["x_a"] == 1.5
    for bad in ("", "abc", "nan", "inf"):
        with pytest.raises(ValueError, match="0 rows without image ids, 1 without"):
            files.checked_pairs(rows.withColumn("y_b", F.lit(bad)))
    out = str(tmp_path / "out")
    files.write_csv(spark.createDataFrame([(0.00123456, "t")], "x double, s string"), out)
    assert files.read_text_csv(spark, out).head()["x"] == "0.001235"
    metrics = str(tmp_path / "m")
    files.append_metrics(rows, metrics)
    files.append_metrics(rows, metrics)
    assert spark.read.parquet(metrics).count() == 2
    with pytest.raises(ValueError, match="other columns"):
        files.append_metrics(rows.drop("x_a"), metrics)


def test_small_splits_are_not_empty(spark):
    from ridgeline.operators.pairs import group_split, split_runs

    assert split_runs(4, (0.8, 0.1, 0.1)) == ({"train": [0, 2], "val": [3, 4], "test": [4, 4]}, {3: "test"})
    for n, want in ((3, [1, 1, 1]), (4, [2, 1, 1]), (2, [2, 0, 0]), (0, [0, 0, 0])):
        got = [r["split"] for r in group_split(spark.createDataFrame([(i,) for i in range(n)] * 2 + [(None,)], "owner long")).collect()]
        assert [got.count(s) for s in ("train", "val", "test")] == want


def test_affine_fit_of_far_points(spark):
    from ridgeline.operators.pairs import affine_fit

    far = 1e8
    rows = [(1, far + x, far + y, 0.5 * x - 0.25 * y, 0.25 * x + 0.5 * y) for x in range(4) for y in range(4)] + [(2, 1.0, 1.0, 2.0, 2.0)] * 3
    got = {r["g"]: r for r in affine_fit(spark.createDataFrame(rows, "g int, x double, y double, u double, v double"), "g").collect()}
    assert abs(got[1]["a"] - 0.5) < 1e-6 and abs(got[1]["b"] - 0.25) < 1e-6 and got[2]["a"] is None


def test_distance_metrics_of_no_rows(spark):
    from ridgeline.operators.verification import distance_metrics

    kind = "d double, positive boolean"
    assert all(x is None for x in distance_metrics(spark.createDataFrame([], kind)).first())
    rows = [(0.1, True), (0.2, True), (0.3, False), (0.4, False), (float("nan"), True), (None, False), (0.5, None)]
    got = distance_metrics(spark.createDataFrame(rows, kind)).first()
    assert (got["fpr_at_tpr95"], got["tpr_at_fpr_1e_4"], got["roc_auc"], got["eer"]) == (0.0, 1.0, 1.0, 0.0)
