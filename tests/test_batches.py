"""Batches, thinning in rounds and dense numbers against plain Python, on odd rows."""

import math
import random
from collections import Counter, defaultdict

import pytest

from ridgeline.operators import batches, numbering, pairs


def greedy(points, distance, sides):
    kept = defaultdict(list)
    for p in sorted(points, key=lambda p: (-p[2], p[1])):
        if all(math.hypot(p[i] - k[i], p[j] - k[j]) >= distance for k in kept[p[0]] for i, j in sides):
            kept[p[0]].append(p)
    return sorted((p[0], p[1]) for v in kept.values() for p in v)


@pytest.mark.parametrize(("columns", "sides"), [((("x", "y"),), ((3, 4),)), ((("x", "y"), ("u", "v")), ((3, 4), (5, 6)))])
def test_thinning_in_rounds_is_greedy(spark, columns, sides):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice([rng.random(), 0.5]), *(rng.uniform(0, 60) for _ in range(4))) for i in range(250)]
    rows += [("same", i, 1.0, 5.0, 5.0, 5.0, 5.0) for i in range(40)] + [("line", i, float(i), 3.0 * i, 0.0, 0.0, 3.0 * i) for i in range(12)]
    odd = [("a", 900, None, 1.0, 1.0, 1.0, 1.0), ("a", 901, 1.0, None, 1.0, 1.0, 1.0), (None, 902, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows + odd, "g string, id long, score double, x double, y double, u double, v double").selectExpr("*", "'q' AS rank")
    for distance in (5.0, 0.0):
        assert sorted((r["g"], r["id"]) for r in pairs.spaced(df, "g", distance, columns).collect()) == greedy(rows, distance, sides)
    assert pairs.spaced(df.limit(0), "g", 5.0, columns).count() == 0


def test_dense_numbers(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(50), f"k{rng.randrange(30)}" if rng.random() < 0.9 else None) for _ in range(400)]
    df = spark.createDataFrame(rows, "at long, key string").repartition(5)
    got = numbering.dense_numbers(df, ["at", "key"], "n").collect()
    assert sorted(r["n"] for r in got) == list(range(400))
    order = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    assert [(r["at"], r["key"]) for r in sorted(got, key=lambda r: r["n"])] == order
    first = {}
    for at, key in sorted(rows, key=lambda r: r[0]):
        first.setdefault(key, at)
    want = sorted(first.items(), key=lambda kv: (kv[1], kv[0] is not None, kv[0] or ""))
    assert [(r["key"], r["first"]) for r in sorted(numbering.first_appearance(df, ["key"], "at", "n").collect(), key=lambda r: r["n"])] == want
    assert numbering.dense_numbers(df.limit(0), ["at"], "n").count() == 0


@pytest.fixture(scope="module")
def records(spark):
    rng = random.Random(4)
    rows = [(o, f"{o}-{p}", k % (1 if o == 0 else 9), 1000 * o + 100 * p + k) for o in range(7) for p in range(1 + o) for k in range(rng.randint(3, 14))]
    return spark.createDataFrame([*rows, (None, "x", 1, 1), (1, None, 1, 1), (1, "1-0", None, 1), (1, "1-0", 1, None)], "owner long, pair string, point long, id long")


def check(rows, size, count, owners):
    by = defaultdict(list)
    for r in rows:
        by[r["batch"]].append(r)
    assert sorted(by) == list(range(count))
    for got in by.values():
        assert sorted(r["place"] for r in got) == list(range(size))
        quota = Counter(r["owner"] for r in got)
        assert len(quota) == owners and max(quota.values()) - min(quota.values()) <= 1
        assert all(len({r["pair"] for r in got if r["owner"] == o}) == 1 for o in quota)
        fresh = [(r["owner"], r["point"]) for r in got if not r["again"]]
        assert len(fresh) == len(set(fresh)) and all((r["owner"], r["point"]) in fresh for r in got)
    return by


def test_validation_batches_cycle_through_pairs(spark, records):
    rows = batches.validation_batches(records, 10, 12, 4).collect()
    by = check(rows, 10, 12, 4)
    there = Counter(r["owner"] for r in records.dropna().select("owner", "pair").distinct().collect())
    for owner in {r["owner"] for r in rows}:
        order = [next(r["pair"] for r in by[b] if r["owner"] == owner) for b in range(12)]
        n = there[owner]
        assert all(len(set(order[lo : lo + n])) == len(order[lo : lo + n]) for lo in range(0, 12, n))
    assert sorted(rows) == sorted(batches.validation_batches(records.repartition(3), 10, 12, 4).collect())
    assert len({r["owner"] for r in batches.validation_batches(records, 10, 2).collect()}) == 7


def test_training_batches_differ_by_epoch(spark, records):
    one, two = (batches.training_batches(records, 9, 3, 7, epoch=e).collect() for e in (0, 1))
    check(one, 9, 7, 3)
    check(two, 9, 7, 3)
    assert sorted(one) != sorted(two) and sorted(one) == sorted(batches.training_batches(records.repartition(2), 9, 3, 7).collect())


def test_plans_are_refused_before_they_are_made(records):
    for size, count, owners in ((10, 0, 2), (1, 5, 1), (10_000, 1_001, 2), (4, 2, 5), (20, 2, 8), (10, 2, 0)):
        with pytest.raises(ValueError):
            batches.validation_batches(records, size, count, owners)
    with pytest.raises(ValueError):
        batches.validation_batches(records.limit(0), 4, 2)
    with pytest.raises(ValueError):
        batches.training_batches(records, 9, 8, 2)
    with pytest.warns(RuntimeWarning):
        batches.validation_batches(records, 2, 50_001, 1)
