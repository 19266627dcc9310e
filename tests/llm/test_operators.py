"""Each operator against a plain version of its contract, on small tables with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import hashlib
import random
import sys
import tempfile
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from ridgeline.llm import anchors, common, fingerprint_index, induced, licenses, mixing, near_texts, ogg, packing, quality, rabitq, simhash, suffix_dedup, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp int, size int, `a.b` string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple[int, str | None]]:
    """Texts with shared passages, copies, repeats within a text, non-ASCII words, empty and null ones, and a long one."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "Übung", "日本", "x" * 50]
    some = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [some(40) for _ in range(3)]
    texts: list[str | None] = [None, "", "  \n\t ", "one", " ".join(["again"] * 90), " ".join(some(3000))]
    for _ in range(n):
        w = some(rng.randint(1, 80))
        for passage in rng.sample(shared, rng.randint(0, 2)):
            at, lo = rng.randint(0, len(w)), rng.randint(0, 10)
            w[at:at] = passage[lo : lo + rng.randint(15, 40)]
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    texts += [texts[8], texts[8], texts[9] + " tail", (texts[10] or "").upper(), texts[5]]
    ids = list(range(3, 3 + 2 * len(texts), 2))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def table(spark, rows):
    full = [(i, t, "en", [None, "a", "b", "c"][(i or 0) % 4], None, "k", 1, 2, "z") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, corpus()).repartition(5).cache()


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


# SimHash


def test_simhash_equals_brute_force(docs):
    got = {d: (fp & (2**64 - 1), c) for d, fp, c in rows(simhash.near_duplicates(docs), "doc_id", "fp", "component_id")}
    want = sorted(corpus())
    fps = [brute.simhash(t) for _, t in want]
    comp = brute.components([d for d, _ in want], lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    assert got == {d: (fps[i], comp[i]) for i, (d, _) in enumerate(want)}


def test_every_near_pair_shares_a_mask():
    rng = np.random.default_rng(0)
    for radius, bits in ((2, 64), (7, 64), (2, 20)):
        p = rng.uniform(0.1, 0.9, 64)
        masks = simhash.covering_masks(list(range(bits)), radius, 1e6, p, np.eye(64))
        for _ in range(500):
            flips = rng.choice(bits, radius, replace=False)
            assert any(all(not m >> int(b) & 1 for b in flips) for m in masks)


def test_a_large_bucket_is_split_and_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 128)
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(250)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    links = rows(simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 2), "a", "b")
    at = {f: i for i, f in enumerate(signed)}
    linked = {(at[a], at[b]) for a, b in links} | {(at[b], at[a]) for a, b in links}
    order = list(range(len(fps)))
    assert brute.components(order, lambda i, j: (i, j) in linked) == brute.components(order, lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)


def test_a_dense_bucket_is_one_component(spark):
    rng = random.Random(6)
    fps = sorted({sum(1 << b for b in rng.sample(range(20), rng.randint(0, 3))) for _ in range(3000)})
    links = rows(simhash.near_links(spark.createDataFrame([(f,) for f in fps], "fp long"), 6), "a", "b")
    root, _ = simhash.spanning(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert len(fps) > 700 and sorted(root.tolist()) == fps[1:]


def test_simhash_of_no_rows_and_null_ids(spark):
    assert rows(simhash.near_duplicates(table(spark, []))) == []
    got = rows(simhash.near_duplicates(table(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, None)])), "doc_id", "component_id")
    assert sorted(got, key=str) == [(5, 5), (5, 5), (9, 9), (None, 5)]


# vectors


def vectors(seed: int = 2):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, 16))
    out = [(i, [float(x) for x in base[i % 6] + rng.choice([0.05, 0.12, 0.2, 0.4]) * rng.standard_normal(16)], [1, 2, None][i % 3 if i % 11 else 2]) for i in range(300)]
    odd = [(301, None, 1), (302, [0.0] * 16, 1), (303, [float("nan")] + [1.0] * 15, 1), (304, [None] + [1.0] * 15, 1), (305, [], 1), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1), (308, [float("inf")] * 16, 2), (309, out[0][1], out[0][2]), (310, [1e300] * 16, 2), (311, [1e300] * 16, 2)]
    return out + odd


def test_vectors_equal_brute_force(spark):
    data = vectors()
    got = {r[0]: r[1:] for r in rows(rabitq.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 0.93))}
    big = [v if v is None or not v or v[0] != 1e300 else [1.0] * 16 for _, v, _ in data]
    linked = brute.cosine_links(big, [x for *_, x in data], 0.93)
    n = len(data)
    links = [sum(linked(i, j) for j in range(n) if j != i) for i in range(n)]
    comp = brute.components([d for d, *_ in data], linked)
    assert got == {d: (links[i], comp[i], comp[i] == d) for i, (d, *_) in enumerate(data)}


def test_blocks_of_a_large_bucket_count_each_link_once(spark, monkeypatch):
    monkeypatch.setattr(rabitq, "BLOCK", 8)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    data = [(i, [float(x) for x in base + 0.1 * rng.standard_normal(16)], 1) for i in range(80)]
    got = {r[0]: r[1] for r in rows(rabitq.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int"), 0.93))}
    linked = brute.cosine_links([v for _, v, _ in data], [1] * 80, 0.93)
    assert got == {i: sum(linked(i, j) for j in range(80) if j != i) for i in range(80)}


def test_estimate_is_unbiased_and_bounded():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((400, 64)) + 0.6 * rng.standard_normal(64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    offs = []
    for seed in range(60):  # unbiased over the random rotation
        estimate, bound = rabitq.estimates(rabitq.encode(v, seed), 64, slice(0, 200), slice(200, 400))
        offs.append(estimate - v[:200] @ v[200:].T)
        assert (np.abs(offs[-1]) <= bound).all()
    by_seed = np.mean(offs, axis=(1, 2))  # pairs share a rotation, so the rotations are what is independent
    assert abs(by_seed.mean()) < 4 * by_seed.std() / 60**0.5 < 0.01 and np.std(offs) < bound.mean() / rabitq.EPSILON * 1.3
    assert np.abs(np.mean(offs, axis=0)).max() < 6 * np.std(offs) / 60**0.5  # the largest of 40,000


@pytest.mark.parametrize("whole", [20_000, 100])
def test_planted_pairs_at_the_threshold_are_found(spark, monkeypatch, whole):
    monkeypatch.setattr(rabitq, "WHOLE", whole)
    rng = np.random.default_rng(8)
    base = rng.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    noise = rng.standard_normal((1500, 64))
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.9301, 0.95, (1500, 1))
    near = c * base + np.sqrt(1 - c * c) * noise
    data = [(i, v.tolist(), i % 1500 % 2) for i, v in enumerate(np.concatenate([base, near]))]
    d = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")
    got = {r[0]: r[1:] for r in rows(rabitq.near_duplicates(d, 0.93))}
    assert got == {i: (1, i % 1500, i < 1500) for i in range(3000)}
    assert rows(rabitq.near_duplicates(d.limit(0))) == []


# mixing


def test_mix_meets_its_targets(docs, spark):
    got = rows(mixing.mix(docs), "doc_id", "source", "size", "source_size", "target", "taken")
    by = {d: t for d, t in corpus()}
    sizes: dict = {}
    for d, source, size, *_ in got:
        assert size == len(brute.words(by[d]))
        sizes[source] = sizes.get(source, 0) + size
    want = brute.mix_targets(sizes, [3, 1, 2], 1.5, 2.0)
    for s in sizes:
        mine = [r for r in got if r[1] == s]
        assert all(r[3] == sizes[s] and abs(r[4] - want[s]) < 1e-6 and 0 <= r[5] <= 2 * r[2] for r in mine)
        assert sum(r[5] for r in mine) == round(want[s])
    assert len(got) == len(by) and sorted(got) == sorted(rows(mixing.mix(docs.repartition(3)), "doc_id", "source", "size", "source_size", "target", "taken"))


def test_mixed_rows_hold_the_words_that_are_drawn(docs):
    drawn: dict = {}
    for d, t in rows(mixing.mixed_rows(docs), "doc_id", "text"):
        drawn[d] = drawn.get(d, 0) + len(brute.words(t))
    assert drawn == {d: n for d, n in rows(mixing.mix(docs), "doc_id", "taken") if n}
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_mixed_rows_of_repeated_rows(spark):
    full = [(i, t, "en", s, None, "k", 1, 2, "z") for i, t, s in [(1, "a b c d", "x"), (1, "a b c d", "x"), (1, "a b c d", "y"), (1, "other text", "x"), (None, "e f", "y"), (None, None, None), (2, "", "x"), *((k, f"w{k} v u", "xyz"[k % 3]) for k in range(3, 60))]]
    d = spark.createDataFrame(full, SCHEMA)
    taken: dict = {}
    for s, t in rows(mixing.mixed_rows(d), "source", "text"):
        taken[s] = taken.get(s, 0) + len(brute.words(t))
    sizes: dict = {}
    for _, t, _, s, *_ in full:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = brute.mix_targets(sizes, [3, 1, 2], 1.5, 2.0)
    assert taken == {s: round(x) for s, x in want.items() if round(x)}


def test_shards_draw_what_the_tree_deals(spark, tmp_path):
    blocks = spark.createDataFrame([("a", k, 2) for k in range(100)] + [("b", k, k % 2) for k in range(40)] + [(None, 0, 3)], "source string, block int, reads long")
    quotas = spark.createDataFrame([("a", 200, 1), ("b", 20, 2), (None, 3, 3)], "source string, blocks long, rank int")
    dealt = rows(mixing.shard_quotas(quotas, 8, 11), "shard", "source", "n", "start")
    for s, n in (("a", 200), ("b", 20), (None, 3)):
        mine = sorted(x for x in dealt if x[1] == s)
        assert sum(x[2] for x in mine) == n and [x[3] for x in mine] == np.cumsum([0, *(x[2] for x in mine)])[:-1].tolist()
    per = [sum(x[2] for x in dealt if x[0] == k) for k in range(8)]
    assert max(per) - min(per) <= 1 and len({x[2] for x in dealt if x[1] == "a"}) > 1
    drawn = rows(mixing.drawn_blocks(blocks, 8, 11), "source", "block", "reading", "shard")
    assert sorted(map(str, (x[:3] for x in drawn))) == sorted(str((s, b, r)) for s, b, n in blocks.collect() for r in range(1, n + 1))
    assert {(k, s): n for k, s, n, _ in dealt if n} == {(k, s): sum(x[0] == s and x[3] == k for x in drawn) for k, s in {(x[3], x[0]) for x in drawn}}
    d = table(spark, corpus())
    mixing.write_shards(d, str(tmp_path / "mix"), shards=4)
    back = spark.read.parquet(str(tmp_path / "mix"))
    whole = lambda df: sorted(map(str, rows(df, "doc_id", "text")))
    assert whole(back) == whole(mixing.mixed_rows(d, shards=4)) and {r[0] for r in rows(back, "shard")} == {0, 1, 2, 3}


def test_the_last_document_is_cut_wherever_blocks_end(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PART_DIGITS", 1)
    data = [(i, "w " * (i % 7 + 1)) for i in range(3000)]
    got = rows(mixing.mix(table(spark, data)), "source", "target", "taken", "size")
    by: dict = {}
    for s, goal, n, size in got:
        assert n <= 2 * size
        by.setdefault((s, goal), []).append(n)
    assert {s: sum(n) for (s, _), n in by.items()} == {s: round(goal) for s, goal in by}


def test_hypergeometric_has_the_right_mean_and_bounds(spark):
    one = spark.range(4000).select(((F.col("id") + 0.5) / 4000).alias("u"))
    draw = mixing.hypergeometric(F.col("u"), F.lit(30).cast("long"), F.lit(70).cast("long"), F.lit(20).cast("long"))
    got = np.array([r[0] for r in one.select(draw).collect()])
    assert abs(got.mean() - 6) < 0.05 and abs(got.var() - 20 * 0.3 * 0.7 * 80 / 99) < 0.1 and got.min() >= 0 and got.max() <= 20


def test_mix_of_no_rows_and_of_empty_texts(spark):
    assert rows(mixing.mix(table(spark, []))) == []
    assert {r[0] for r in rows(mixing.mix(table(spark, [(1, None), (2, "")])), "taken")} == {0}
    assert sum(r[0] for r in rows(mixing.mix(table(spark, [(1, "a b"), (1, "a b"), (None, "c")])), "taken")) > 0


# toxicity and quality


def test_toxicity_tells_labelled_texts_apart(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    d, labels = read("documents"), read("labels")
    fit = labels.where("doc_id % 4 != 2")
    got = toxicity.score(d, toxicity.train(d.select("doc_id", "text"), fit)).join(labels, "doc_id").where("doc_id % 4 = 2")
    right, n = rows(got, F.count_if(F.col("tox_toxic") == (F.col("toxic") == 1)), F.count("*"))[0]
    assert right / n > 0.95


def test_scores_equal_a_plain_reading(spark):
    index = {b"idiot": 0, b"idio*": 1, b"stupid": 2}
    model = toxicity.Model(index, np.array([2.0, 0.5, 1.5]), np.array([1.0, 2.0, 4.0]))
    data = [(1, None), (2, ""), (3, "clean words only"), (4, "You IDIOT, idiots!"), (4, "You IDIOT, idiots!"), (None, "stupid " * 5000), (5, "x" * 100_000), (6, "stupid-idiotic")]
    got = toxicity.score(table(spark, data), model)
    assert got.columns == [*table(spark, []).columns, *toxicity.NEW]
    found = sorted(map(str, rows(got, "doc_id", "tox_p", "tox_severity", "tox_grade", "tox_toxic")))
    want = []
    for i, t in data:
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in (t or "").lower()).split()
        counts = [words.count("idiot"), sum(w.startswith("idio") and len(w) > 4 for w in words), words.count("stupid")]
        z = sum(w * float(np.log1p(n)) for w, n in zip([2.0, 0.5, 1.5], counts, strict=True))
        over = [1 / (1 + float(np.exp(c - z))) for c in (1.0, 2.0, 4.0)]
        p = [1 - over[0], over[0] - over[1], over[1] - over[2], over[2]]
        want.append((i, over[0], sum(over), p.index(max(p)), over[0] >= 0.5))
    short = lambda r: (str(r[0]), round(r[1], 9), round(r[2], 9), r[3], r[4])
    assert sorted(map(short, rows(got, "doc_id", "tox_p", "tox_severity", "tox_grade", "tox_toxic"))) == sorted(map(short, want)) and len(found) == len(data)


def test_ordinal_fit_recovers_ordered_grades():
    rng = np.random.default_rng(0)
    x = rng.poisson(1.0, (600, 3)).astype(float)
    grade = np.digitize(x @ [1.0, 2.0, 0.0] + rng.logistic(0, 0.3, 600), [2, 4, 6])
    r, c = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(r, c, x[r, c], grade, 3)
    assert (np.diff(cuts) > 0).all() and w[1] > w[0] > abs(w[2])


def test_toxicity_without_labels_or_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs.select("doc_id", "text"), none)
    assert toxicity.score(docs, model).where("tox_toxic").count() == 0
    assert toxicity.score(table(spark, []), model).count() == 0


def test_quality_orders_held_out_texts(spark):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet")
    got = quality.quality_scores(read("documents"), read("labels")).join(read("labels"), "doc_id").where("held_out")
    data = rows(got, "score", "quality")
    good, bad = [s for s, q in data if q == 1], [s for s, q in data if q == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.85 and all(0 <= s <= 1 for s, _ in data)


def test_quality_never_reads_held_out_labels(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 4 = 2")
    flipped = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(rows(quality.quality_scores(d, labels))) == sorted(rows(quality.quality_scores(d, flipped)))
    got = rows(quality.quality_scores(d, labels), "doc_id", "held_out")
    assert len(got) == d.count() and all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got)


def plain_pools(at, ones, n):
    """Rising shares: any two neighbours that don't rise are merged, as long as there are any."""
    for smooth in (True, False):
        pools = [(x * m, y, m) for x, y, m in zip(at, ones, n, strict=True)]
        while (k := next((k for k in range(len(pools) - 1) if pools[k][1] / pools[k][2] >= pools[k + 1][1] / pools[k + 1][2]), None)) is not None:
            pools[k : k + 2] = [tuple(p + q for p, q in zip(*pools[k : k + 2], strict=True))]
        at, n = [x / m for x, _, m in pools], [m for *_, m in pools]
        ones = [(y + 0.5) / (m + 1) * m if smooth else y for _, y, m in pools]
    return np.array(at), np.array(ones) / np.array(n)


def test_quality_equals_dense_normal_equations(spark):
    """All scores from one matrix of all labelled rows in memory and from pools merged one by one."""
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    odd = [(10**7, None, 1), (10**7 + 1, "", 0), (10**7 + 2, "word " * 200_000, 1), (10**7 + 3, "again", 1), (10**7 + 3, "again", 0), (10**7 + 4, "\n \n", None)]
    d = d.select("doc_id", "text").unionByName(spark.createDataFrame([x[:2] for x in odd], "doc_id long, text string")).withColumn("score", F.lit("a clashing name"))
    labels = labels.select("doc_id", "quality").unionByName(spark.createDataFrame([(i, q) for i, _, q in odd], "doc_id long, quality int"))
    texts = rows(d, "doc_id", "text")
    stats = np.array([quality.statistics((t or "").encode()) for _, t in texts])
    best: dict[int, float] = {}
    for i, q in rows(labels, "doc_id", "quality"):
        if q is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            best[i] = max(best.get(i, 0.0), float(q))
    part = dict(rows(d.select("doc_id", F.expr("pmod(xxhash64(doc_id, 77), 4)").alias("p"))))
    fit, rest = ([k for k, (i, _) in enumerate(texts) if i in best and (part[i] != 0) == side] for side in (True, False))
    y = lambda at: np.array([best[texts[k][0]] for k in at])
    mean, scale = stats[fit].mean(0), np.maximum(stats[fit].std(0), 1e-6)
    rng = np.random.default_rng(3)
    directions, phases = rng.standard_normal((quality.WIDTH, stats.shape[1])) / np.sqrt(stats.shape[1]), rng.uniform(0, 2 * np.pi, quality.WIDTH)
    x = np.clip((stats - mean) / scale, -6, 6)
    f = np.column_stack([np.ones(len(x)), x, np.sqrt(2 / quality.WIDTH) * np.cos(x @ directions.T + phases)])
    raw = f @ np.linalg.solve(f[fit].T @ f[fit] + 1e-3 * len(fit) * np.eye(f.shape[1]), f[fit].T @ y(fit))
    cells: dict[int, list] = {}
    for k, v in zip(rest, y(rest), strict=True):
        cells.setdefault(int((np.clip(raw[k], -1, 2) + 1) / 3 * quality.BINS), []).append(v)
    bins = sorted(cells)
    knots, levels = plain_pools([(b + 0.5) / quality.BINS * 3 - 1 for b in bins], [sum(cells[b]) for b in bins], [len(cells[b]) for b in bins])
    want = sorted((i, round(float(v), 6)) for (i, _), v in zip(texts, np.clip(np.interp(raw, knots, levels), 0, 1), strict=True))
    got = rows(quality.quality_scores(d, labels), "doc_id", "held_out", "score", "predicted")
    assert np.allclose([s for _, s in sorted((i, s) for i, _, s, _ in got)], [s for _, s in want], atol=1e-5)
    assert all(p == (s >= 0.7) and h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h, s, p in got)


def test_quality_of_odd_tables(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r[0] for r in rows(quality.quality_scores(docs, none), "score")} == {0.5}
    assert rows(quality.quality_scores(table(spark, []), none)) == []


def test_isotonic_rises():
    for seed in range(50):
        rng = np.random.default_rng(seed)
        n = rng.integers(1, 30, 25).astype(float)
        x, y = quality.isotonic(np.arange(25.0), np.array([rng.integers(0, m + 1) for m in n], float), n)
        assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and 0 < y[0] <= y[-1] < 1
    _, y = quality.isotonic(np.array([0.0, 1.0]), np.array([9.0, 1.0]), np.array([10.0, 1.0]))
    assert (np.diff(y) >= 0).all()
    x = np.arange(10.0)
    _, y = quality.isotonic(x, np.array([0, 1, 0, 1, 1, 0, 1, 1, 1, 1.0]), np.ones(10))
    assert (np.diff(y) >= 0).all()


# Ogg


def test_media_of_odd_tables(spark):
    d = table(spark, [(1, None), (2, ""), (3, "same"), (3, "same"), (4, "x" * 64)])
    got = sorted(rows(ogg.media_features(ogg.media_column(d)), "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "feature", "error"))
    assert [g[:3] for g in got] == [(1, 0, 64), (2, 0, 64), (3, 4, 64), (3, 4, 64), (4, 64, 64)] and got[2] == got[3] and got[0][3:] == got[1][3:] and all(g[5] is None for g in got)
    feature = dict(x.split("=") for x in got[4][4].split(";"))
    assert feature["mean"] == f"{ord('x'):.6f}" and feature["peak"] == str(ord("x")) and feature["levels"] == "1" and int(feature["end_us"]) == 64 * 1_000_000 // int(feature["rate"])
    assert rows(ogg.media_features(ogg.media_column(table(spark, [])))) == []


def test_media_round_trip(spark):
    data = [*corpus(3, 10), (1000, "é" * 40_000), (1001, "a" * 64), (1002, "b" * 4096 * 80)]
    d = table(spark, data)
    got = {r["doc_id"]: r for r in ogg.media_features(ogg.media_column(d)).collect()}
    for i, t in data:
        raw = (t or "").encode()
        padded = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["error"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), None)
        media = ogg.encode(padded, len(raw))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())


def test_any_flipped_byte_is_found():
    data = ogg.encode(bytes(range(256)) * 40, 10_000)
    rng = random.Random(0)
    for at in rng.sample(range(len(data)), 60):
        bad = bytearray(data)
        bad[at] ^= 1 << rng.randrange(8)
        with pytest.raises(ogg.Corrupt):
            ogg.decode(bytes(bad))
    with pytest.raises(ogg.Corrupt):
        ogg.decode(data[:-1])


def test_packets_of_any_length_are_reassembled():
    packets = [(bytes([i % 251]) * n, i) for i, n in enumerate([1, 0, 254, 255, 256, 510, 70_000, 65_025, 3])]
    got = ogg.demultiplex(b"".join(ogg.stream_pages(packets, 9)))[9]
    assert got.packets == [p for p, _ in packets]


# licences


def test_license_scan_equals_sql(spark):
    con = duckdb.connect()
    extra = [(10**6, "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.\nThe MIT License"), (10**6 + 1, None), (10**6 + 2, ""), (10**6 + 3, "Released under the MIT License! Released under the MIT license.")]
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    con.register("documents", d.toArrow())
    got = rows(licenses.scan(d), "doc_id", "rule", "license", "matches", "first_sentence")
    assert sorted(got) == sorted(con.execute(f"SELECT doc_id, rule, license, matches, first_sentence FROM ({licenses.oracle_sql()})").fetchall())
    found = {(i, r): (m, f) for i, r, _, m, f in got}
    assert found[10**6, "apache2-line"] == (1, 0) and found[10**6, "mit-heading"] == (1, 2) and found[10**6 + 3, "mit-line"] == (2, 0)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
MIT = """MIT License

Copyright (c) 2020 A. Nobody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>."""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED."""


def test_titles_tags_and_denials(spark):
    texts = {
        "The MIT License is a permissive licence, wrote the blogger.": None, "This project is not under the MIT License": None, "It is not released under the MIT License, sadly.": None, "an MIT license": None, "not licensed under CC BY 4.0": None,
        "# MIT License\n\nfoo": "MIT", "text\n  The MIT License (MIT)  \nmore": "MIT", "MIT License\r\nx": "MIT", "  GNU GENERAL PUBLIC LICENSE\n     Version 2, June 1991\n": "GPL-2.0-only", "Released under the MIT License": "MIT",
        "// SPDX-License-Identifier: Apache-2.0\ncode": "Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "is licensed under the GNU General Public License version 2": "GPL-2.0-only",
        "has waived all copyright and related or neighboring rights to this work": "CC0-1.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License.": "GPL-3.0-only",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at": "EPL-2.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.": "CC-BY-ND-4.0",
    }
    d = spark.createDataFrame([(k, t, "r", "l") for k, t in enumerate(texts)], "doc_id long, text string, rule string, left string")
    assert sorted(rows(licenses.scan(d), "doc_id", "license")) == [(k, x) for k, x in enumerate(texts.values()) if x]
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toPandas())
    assert sorted(rows(licenses.scan(d))) == sorted(con.execute(f"SELECT doc_id, rule, license, matches, first_sentence FROM ({licenses.oracle_sql()})").fetchall())


def test_usual_licences_are_recognised_however_they_are_wrapped(spark):
    texts = {"apache2-header": APACHE, "mit-text": MIT, "gpl3-header": GPL, "bsd3-text": BSD, "bsd2-text": BSD[: BSD.index("3. ")] + BSD[BSD.index("THIS") :]}
    shapes = [lambda t: t, lambda t: " ".join(t.split()), lambda t: "".join(f"# {x}\n" for x in t.split("\n")), lambda t: "/*\n" + "".join(f" * {x}\r\n" for x in t.split("\n")) + " */\nint main;", lambda t: "".join(f"// {x}\n" for x in t.split("\n"))]
    data = [(10 * i + k, f(t)) for i, t in enumerate(texts.values()) for k, f in enumerate(shapes)]
    data += [(900, None), (901, ""), (902, "a permission to license nothing"), (903, MIT + "\n" + MIT), (903, MIT + "\n" + MIT), (904, "long " * 100_000 + GPL), (905, APACHE.replace("Unless", "word " * 80 + "Unless"))]
    d = table(spark, data)
    got = rows(licenses.scan(d), "doc_id", "rule", "matches")
    assert {(i, r) for i, r, _ in got if i < 900} == {(10 * i + k, r) for i, r in enumerate(texts) for k in range(len(shapes))}
    assert sorted(x for x in got if x[0] >= 900) == [(903, "mit-text", 2), (903, "mit-text", 2), (904, "gpl3-header", 1), (905, "apache2-line", 1)]
    con = duckdb.connect()
    con.register("documents", d.select("doc_id", "text").toArrow())
    assert sorted(rows(licenses.scan(d))) == sorted(con.execute(f"SELECT doc_id, rule, license, matches, first_sentence FROM ({licenses.oracle_sql()})").fetchall())
    assert rows(licenses.scan(table(spark, []))) == []


# packing


def test_packing_places_every_token_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    data = [*corpus(6, 80), (None, "no id"), (9000, "x" * 3), (9001, " ".join(["full"] * 255)), (7777, "<s> special </s> Ünïcode 🙂 tokens12345"), (8888, "long " * 5000)]
    got = packing.packed_documents(table(spark, data), capacity=256).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in data:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by[i], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids), 256))
        for r in pieces:
            part = ids[r["start"] : r["start"] + 256]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r["length"] for r in got)
    assert len(seqs) <= 1.03 * total / 256 + 2


def test_plan_uses_every_item_within_capacity():
    rng = random.Random(1)
    for _ in range(40):
        counts = {rng.randint(1, 100): rng.randint(1, 30) for _ in range(rng.randint(1, 60))}
        used: dict = {}
        for content, n in packing.pack_counts(counts, 100):
            assert sum(content) <= 100 and sum(3 * x > 100 for x in content) <= 2
            for x in content:
                used[x] = used.get(x, 0) + n
        assert used == counts


def test_packing_keeps_control_characters():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    spaces = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    for text in [f"ab{c}cd {c} ef{c}" for c in spaces] + ["ab\x1f", "\x1c", "Ab\x1d\x1e\u2003x" + "".join(spaces)]:
        assert encoder.encode_all([text]) == [encoder.encode(text)], repr(text)


def test_packing_knows_the_tokenizers_white_space():
    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"), 500)
    texts = [f"ab{chr(c)}cd Ab{chr(c)} {chr(c)}. x{chr(c)}{chr(c)}y{chr(c)}'s" for c in [*range(0x3100), *range(0xA000, 0xA100), *range(0xFB00, 0x10000), *range(0x1F300, 0x1F400)]]
    for at in range(0, len(texts), 100):
        assert encoder.encode_all(texts[at : at + 100]) == [encoder.encode(t) for t in texts[at : at + 100]]


def test_packing_learns_words_by_their_parts_only_where_the_tokenizer_does():
    import itertools

    import public_tokenizers

    encoder = packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert encoder.by_parts
    words = ["".join(x) for x in itertools.product(["a", "É", "ß", "Über", "x9", "naïve", "e\u0301"], *[list("'`.,s_t\"\\")] * 2)] + ["'s", "don't", "a'", "\u00b5", "\u00aaa,"]
    assert encoder.encode_all(words) == [encoder.encode(w) for w in words]
    assert not packing.Encoder(public_tokenizers.path("byte_bpe_50k.json")).by_parts  # it keeps upper case


def test_packing_no_rows_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 8)
    got = packing.packed_documents(table(spark, [(1, "a b c"), (1, "a b c"), (None, None), (2, "")] * 20 + [(3, "w " * 15)] * 9), capacity=16).collect()
    seqs: dict = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(got) == 89 and sum(n for s in seqs.values() for _, n in s) == 40 * 4 + 40 + 9 * 16
    assert all(a + n == b for s in seqs.values() for (a, n), (b, _) in zip(sorted(s), [*sorted(s)[1:], (sum(sorted(s)[-1]), 0)], strict=True))
    assert len(seqs) == 9 + (40 * 4 + 40) // 16 + 1
    assert rows(packing.packed_documents(table(spark, []))) == []


# repeated passages


@pytest.mark.parametrize("seed", [1, 2])
def test_word_windows_equal_brute_force(spark, seed):
    data = corpus(seed)
    got = rows(fingerprint_index.without_repeats(table(spark, data).repartition(6), window=20), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert len(got) == len(data) and set(got) == brute.word_dedup(data, 20)


def test_compacting_the_index_changes_nothing(spark):
    data = corpus(5, 30)
    got = rows(fingerprint_index.without_repeats(table(spark, data), window=20, batches=6, most_runs=1), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert set(got) == brute.word_dedup(data, 20)


@pytest.mark.parametrize("seed", [1, 2])
def test_byte_strings_equal_brute_force(spark, seed):
    data = corpus(seed)
    got = rows(suffix_dedup.without_repeats(table(spark, data).repartition(6), length=100), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert len(got) == len(data) and set(got) == brute.byte_dedup(data, 100)


def test_repeats_of_odd_tables(spark):
    text = " ".join(f"t{i}" for i in range(60))
    for f, n in ((fingerprint_index.without_repeats, "n_words"), (suffix_dedup.without_repeats, "n_bytes")):
        assert rows(f(table(spark, []))) == []
        odd = rows(f(table(spark, [(None, text), (4, text), (4, text), (4, "other " + text)])), "doc_id", n, "n_removed")
        assert len(odd) == 4 and [r for r in odd if r[0] is None][0][2] == 0 and all(r[2] > 0 for r in odd if r[0] == 4)


def test_cut_texts_keep_whole_characters_and_columns(spark):
    shared = "日本語の文" * 20
    d = table(spark, [(1, shared + "a"), (2, "é" + shared), (3, None), (4, "short")])
    got = {r["doc_id"]: r for r in suffix_dedup.cut_texts(d).collect()}
    assert suffix_dedup.cut_texts(d).columns == d.columns
    assert got[2]["text"] == "é" and got[2]["n_chars"] == 1 and got[3]["text"] is None and got[4]["text"] == "short"


@pytest.mark.parametrize("short", [4, 1 << 15])
def test_suffix_order_is_sorted_with_common_prefixes(monkeypatch, short):
    monkeypatch.setattr(induced, "SHORT", short)
    rng = np.random.default_rng(1)
    for most in (50, 700, 10**6):
        for symbols, n in ((3, 300), (2, 100), (30, 500), (258, 3000), (1500, 2000)):
            values = np.append(rng.integers(1, symbols, n), 0)
            if n == 3000:
                values[500:900] = values[1500:1900]
            cap = 100 if symbols <= 258 else 0
            with tempfile.TemporaryDirectory() as name:
                folder = induced.Folder(name)
                text = folder.text(n + 1, np.uint16 if cap else np.int32)
                text[:] = values
                parts = [(np.array(p), np.array(x)) for p, x in induced.suffixes(text, symbols, folder, most, cap)]
            order, lcp = np.concatenate([p for p, _ in parts]), np.concatenate([x for _, x in parts])
            plain = values.tolist()
            want = sorted(range(n + 1), key=lambda i: plain[i:], reverse=True)  # noqa: B023
            assert order.tolist() == want
            for k in range(1, (n + 1) if cap else 1):
                a, b = values[want[k - 1] :], values[want[k] :]
                m = min(len(a), len(b))
                assert lcp[k] == min(int(np.argmin(np.append(a[:m] == b[:m], False))), 100)


def test_a_shard_far_larger_than_the_bound_is_sorted_within_it(monkeypatch):
    rng = np.random.default_rng(5)
    parts = [rng.integers(97, 101, 150).astype(np.uint8).tobytes() for _ in range(150)]
    segments = [parts[i] for i in rng.integers(0, 150, 700)]
    most, peaks, put = 2000, [], induced.DiskQueue.put

    def watched(self, key, pos, lcp):
        put(self, key, pos, lcp)
        peaks.append(self.total)

    monkeypatch.setattr(induced.DiskQueue, "put", watched)
    monkeypatch.setattr(induced, "CHUNK", 1000)
    monkeypatch.setattr(induced, "SHORT", 100)
    raw = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.uint16) + 2, 1) for s in segments])
    start = np.arange(700) * 151
    with tempfile.TemporaryDirectory() as name:
        folder = induced.Folder(name)
        text = folder.text(len(raw) + 1, np.uint16)
        text[:-1] = raw
        again = np.array(induced.repeated_windows(text, start, np.full(700, 51), 100, folder, most))
    seen, want = set(), np.zeros(len(raw) + 1, bool)
    for s, at in zip(segments, start, strict=True):
        for k in range(51):
            want[at + k] = s[k : k + 100] in seen
            seen.add(s[k : k + 100])
    assert (again.astype(bool) == want).all() and want.any()
    assert len(raw) > 50 * most and max(peaks) <= most


def test_a_frequent_phrase_is_dealt_by_its_windows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9)))
    phrase = " ".join(word() for _ in range(14))[:92]
    long_phrase = " ".join(word() for _ in range(30))[:130]
    texts = [" ".join(word() for _ in range(20)) + " " + rng.choice([phrase, long_phrase]) + " " + " ".join(word() for _ in range(20)) for _ in range(60)]
    data = list(enumerate(texts))
    docs, distinct = anchors.document_keys(table(spark, data).select("doc_id", F.col("text").cast("binary").alias("text")))
    for hot in (3, 10**6):
        got: dict = {i: [False] * len(t) for i, t in data}
        for r in suffix_dedup.spans(distinct, 100, 32, hot).collect():
            for k in range(r["a"], r["b"]):
                got[r["key"]][k] = True
        assert got == {i: gone for i, (_, gone) in brute.repeats(data, 100, lambda t: t.encode()).items()}


def test_unequal_passages_of_equal_hashes_are_an_error():
    v = {"a": np.array([0]), "b": np.array([3]), "proof": [b"abd"]}
    with pytest.raises(ValueError):
        anchors.checked(b"abcdef", 1, 0, v, bytes)
    assert anchors.checked(b"abdef", 1, 0, v, bytes) == [(0, 3)]


def test_an_index_goes_from_one_job_to_the_next(spark, tmp_path):
    data = sorted(corpus(7, 40))
    half = len(data) // 2
    key = lambda rows_: spark.createDataFrame([(i, (t or "").encode()) for i, t in rows_], "key long, text binary")
    index = fingerprint_index.LogIndex(spark, most_runs=1)
    first = index.absorb(key(data[: half // 2])).unionByName(index.absorb(key(data[half // 2 : half])))
    assert index.compactions == 1 and len(index.runs) == 1
    index.save(str(tmp_path / "index"))
    again = fingerprint_index.LogIndex.open(spark, str(tmp_path / "index"))
    with common.settings(spark, all_keys="false"):
        plan = spark.table(again.runs[0]).join(spark.table(index.runs[0]).hint("merge"), ["ah", "sh"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    second = again.absorb(key(data[half:]))
    spans = fingerprint_index.spans(key(data), first.unionByName(second))
    got = rows(fingerprint_index.cut(key(data).withColumn("doc_id", F.col("key")), spans), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert set(got) == brute.word_dedup(data, 20)
    index.drop()
    again.drop()


def test_runs_are_merged_in_the_order_they_are_stored_in(spark):
    data = sorted(corpus(9, 40))
    key = lambda rows_: spark.createDataFrame([(i, (t or "").encode()) for i, t in rows_], "key long, text binary").repartition(3)
    index = fingerprint_index.LogIndex(spark, most_runs=4)
    for k in range(3):
        index.absorb(key(data[k::3]))
    newest, index.runs = index.runs[-1], index.runs[:-1]
    assert len(index.runs) == 2
    with common.settings(spark, **index.ORDERED):
        plan = index.met(spark.table(newest))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 4 and "Sort [" not in plan and "Exchange" not in plan
    where = spark.sql(f"DESCRIBE TABLE EXTENDED {newest}").where("col_name = 'Location'").head()["data_type"]
    assert common.shared_dir(spark) in where
    index.runs.append(newest)
    index.drop()
    assert not spark.catalog.databaseExists(index.base)


def test_segments_cover_every_window_once():
    rng = np.random.default_rng(2)
    sym = rng.integers(0, 2**63, 500).astype(np.uint64)
    _, _, lo, hi = anchors.segments(sym, np.array([100, 101, 300, 500]), 20, 8)
    starts = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    want = [*range(0, 81), *range(101, 281), *range(300, 481)]
    assert sorted(starts.tolist()) == want


# near copies


def test_one_of_each_group_of_near_copies(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(12)]
    data, group = [], {}
    for g, w in enumerate(base):
        for k in range(5):
            v = list(w)
            for at in rng.sample(range(200), k):
                v[at] = "changed"
            i = len(data) + 1
            data.append((i, " ".join(v)))
            group[i] = g
    data += [(500, None), (501, ""), (502, "other")]
    d = table(spark, data)
    kept = [r[0] for r in rows(near_texts.one_of_each(d), "doc_id")]
    assert near_texts.one_of_each(d).columns == d.columns
    sets = {i: set(brute.shingles(t, 5)) for i, t in data}
    alike = lambda a, b: not sets[a] and not sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    ids = [i for i, _ in data]
    comp = brute.components(ids, lambda x, y: alike(ids[x], ids[y]))
    assert sorted(kept) == sorted(set(comp.values()))
    assert rows(near_texts.one_of_each(table(spark, []))) == []


def test_near_copies_with_blocks_changed(spark):
    rng = random.Random(11)
    some = lambda k: [f"v{rng.randrange(5000)}" for _ in range(k)]
    texts, pairs = [], 0
    for k in range(240):
        size = rng.choice([12, 25, 60, 110, 250, 600, 1500])
        w, n = some(size), max(size // 11, 1)
        at = rng.randrange(size - n)
        other = [w + some(int(size * 0.2)), w[: size - int(size * 0.17)], w[:at] + some(n) + w[at + n :]][k % 3]
        texts += [" ".join(w), " ".join(other)]
    data = list(enumerate(texts))
    sets = {i: set(brute.shingles(t, 5)) for i, t in data}
    gone = {i + 1 for i in range(0, len(data), 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    assert len(gone) > 150
    assert {r[0] for r in rows(near_texts.one_of_each(table(spark, data)), "doc_id")} == set(range(len(data))) - gone
