"""The pipeline's stages on the smallest tables: each decision takes effect, columns stay, and nothing else goes."""

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF).cache()
    kept = {r["doc_id"] for r in clean.collect()}
    assert clean.columns == docs.columns
    assert all(i in kept for i, t in labels.items() if not t)
    toxic = [i for i, t in labels.items() if t]
    assert sum(i not in kept for i in toxic) >= 0.5 * len(toxic)
    single = stages["near copies"](spark, clean, SF).cache()
    rows = sorted((r["doc_id"], r["text"]) for r in clean.collect())
    sets = [set(brute.shingles(t, 5)) for _, t in rows]
    alike = lambda i, j: (not sets[i] and not sets[j]) or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    comp = brute.components([i for i, _ in rows], alike)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == set(comp.values())
    cut = stages["repeated passages"](spark, single, SF).cache()
    left = [(r["doc_id"], r["text"]) for r in single.collect()]
    found = brute.repeats(left, 100, lambda t: (t or "").encode())
    for r in cut.collect():
        u, gone = found[r["doc_id"]]
        whole = bytes(c for c, g in zip(u, gone, strict=True) if not g)
        want, at = b"", 0  # a character goes only if all its bytes do
        for ch in (u.decode() if isinstance(u, bytes) else ""):
            n = len(ch.encode())
            want += b"" if all(gone[at : at + n]) else ch.encode()
            at += n
        assert (r["text"] or "").encode() == want and len(want) >= len(whole)
    assert cut.count() == len(left)
    mixed = stages["source mix"](spark, cut, SF)
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = stages["packing"](spark, mixed, SF)
    assert packed.where("length < 1 or length > 2048 or offset < 0 or offset + length > 2048").count() == 0
    again: dict = {}
    for r in packed.collect():
        again[r["doc_id"]] = again.get(r["doc_id"], 0) + (r["piece"] == 0)
    drawn: dict = {}
    for (i,) in mixed.select("doc_id").collect():
        drawn[i] = drawn.get(i, 0) + 1
    assert again == drawn


def test_stages_with_repeated_and_null_rows(spark, tmp_path):
    """Repeated rows, one doc_id with two texts, null doc_ids and null texts go through all stages."""
    long = " ".join(f"t{i}" for i in range(80))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(1, long, "en", "a", None), (1, long, "en", "a", None), (1, "another " + long, "en", "b", 5), (None, "a text of its own", "en", "a", 3), (None, None, None, None, None), (None, "", "en", "b", 0), (7, None, "en", None, None)]
    some = docs.where("doc_id < 60").unionByName(spark.createDataFrame(odd, docs.schema))
    some.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, str(tmp_path)).cache()
        assert after.columns == docs.columns, name
        if name != "source mix":
            assert after.count() > 0 and after.count() <= now.count()
        now = after
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() >= now.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
