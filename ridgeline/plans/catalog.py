"""Every query over the driver's tables, by name, with its SQL twin where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.functions import arrays, scalars
from ridgeline.operators import batches, blocks, codes, events, geometry, groups, learning, library, losses, matching, negatives, numbering, pairs, stages, verification
from ridgeline.sources import images, templates, versions
from ridgeline.sources.tables import shared_folder, table, vectors, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under a name, with the SQL that must return the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


EMB = "emb AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS owner, CAST(embedding AS DOUBLE[]) AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings)"
L2 = "round(sqrt(greatest(2 - 2 * list_dot_product(q.v, g.v), 0)), 12)"
SCORES = f"""WITH {EMB},
pairs AS (SELECT q.id AS q, q.owner AS q_owner, g.owner AS owner, g.id AS g, round(greatest(1 - {L2} / 2, 0), 12) AS s FROM emb q, emb g WHERE q.rn > 5 AND g.rn <= 5),
scores AS (SELECT q, q_owner, owner, q_owner = owner AS genuine, round(max(s), 6) AS best, round(avg(s), 6) AS mean, round(list_avg(list(s ORDER BY s DESC)[1:3]), 6) AS top_mean, list(g ORDER BY s DESC, g)[1] AS best_id FROM pairs GROUP BY ALL)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six decimals, as the SQL has them; the operators take them as they are."""
    return verification.scores(vectors(spark, sf_dir), count=5).withColumns({c: F.round(c, 6) for c in ("best", "mean", "top_mean")})


@query("far_frr_table", f"""{SCORES}, t AS (SELECT round(CAST(0.2 AS DOUBLE) + i * CAST(0.01 AS DOUBLE), 10) AS threshold FROM range(37) r(i))
SELECT threshold, count(*) FILTER (NOT genuine AND best >= threshold) AS fa, count(*) FILTER (genuine AND best < threshold) AS fr, round(fa / count(*) FILTER (NOT genuine), 6) AS far, round(fr / count(*) FILTER (genuine), 6) AS frr FROM t, scores GROUP BY threshold""")
def far_frr_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.far_frr_table(_scores(spark, sf_dir), 0.2, 0.56, 0.01)


@query("identity_scores", f"{SCORES} SELECT q, q_owner, owner, genuine, best, mean, top_mean, best_id FROM scores")
def identity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir)


@query("threshold_curve", f"""{SCORES}, c AS (SELECT best AS score, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS i FROM scores GROUP BY best)
SELECT score, CAST(sum(i) OVER (ORDER BY score DESC) AS BIGINT) AS far_n, CAST(sum(g) OVER (ORDER BY score) - g AS BIGINT) AS frr_n, CAST(sum(i) OVER () AS BIGINT) AS impostors, CAST(sum(g) OVER () AS BIGINT) AS genuines FROM c""")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.cumulative(_scores(spark, sf_dir)).drop("g", "i")


@query("threshold_rates", f"""{SCORES}, t AS (SELECT DISTINCT round(x, 10) AS threshold FROM (SELECT unnest([CAST(0.3 AS DOUBLE), CAST(0.35 AS DOUBLE)]) AS x UNION ALL SELECT CAST(0.2 AS DOUBLE) + i * CAST(0.05 AS DOUBLE) FROM range(17) r(i) UNION ALL SELECT best FROM scores) WHERE round(x, 10) BETWEEN 0 AND 1),
n AS (SELECT count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS i FROM scores) SELECT threshold, count(*) FILTER (NOT genuine AND best >= threshold) AS fa, count(*) FILTER (genuine AND best < threshold) AS fr, round(count(*) FILTER (NOT genuine AND best >= threshold) / any_value(n.i), 6) AS far, round(count(*) FILTER (genuine AND best < threshold) / any_value(n.g), 6) AS frr FROM t, scores, n GROUP BY threshold""")
def threshold_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At two configured thresholds, an even grid and every score."""
    got = verification.threshold_rates(_scores(spark, sf_dir), (0.3, 0.35), (0.2, 1.0, 0.05))
    return got.select("threshold", "fa", "fr", F.round("far", 6).alias("far"), F.round("frr", 6).alias("frr"))


@query("zero_far_point", f"""{SCORES}, m AS (SELECT max(best) FILTER (NOT genuine) AS threshold_above FROM scores)
SELECT threshold_above, count(*) FILTER (genuine AND best <= coalesce(threshold_above, -1)) AS fr, round(fr / count(*) FILTER (genuine), 6) AS frr, CAST(CASE WHEN count(*) FILTER (NOT genuine) > 0 THEN 0 END AS DOUBLE) AS far FROM scores, m GROUP BY threshold_above""")
def zero_far_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.zero_far_point(_scores(spark, sf_dir))


@query("per_owner_rates", f"""{SCORES} SELECT CAST(grouping(owner) AS INT) AS overall, owner, count(*) FILTER (genuine AND best < 0.36) AS fr, count(*) FILTER (NOT genuine AND best >= 0.36) AS fa, round(fr / nullif(count(*) FILTER (genuine), 0), 6) AS frr, round(fa / nullif(count(*) FILTER (NOT genuine), 0), 6) AS far FROM scores GROUP BY GROUPING SETS ((), (owner))""")
def per_owner_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.per_owner_rates(_scores(spark, sf_dir), 0.36)


@query("auc_eer", f"""{SCORES}, c AS (SELECT best AS score, count(*) FILTER (genuine) AS g, count(*) FILTER (NOT genuine) AS i FROM scores GROUP BY best),
r AS (SELECT score, sum(i) OVER (ORDER BY score DESC) / sum(i) OVER () AS fpr, sum(g) OVER (ORDER BY score DESC) / sum(g) OVER () AS tpr FROM c),
l AS (SELECT *, coalesce(lag(fpr) OVER (ORDER BY score DESC), 0) AS f0, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS t0 FROM r)
SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) AS auc, round(list((fpr + 1 - tpr) / 2 ORDER BY round(abs(fpr - (1 - tpr)), 9), score DESC)[1], 6) AS eer FROM l""")
def auc_eer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.auc_eer(_scores(spark, sf_dir))


@query("distance_metrics", f"""{SCORES}, e AS (SELECT genuine AS positive, round(2 * (1 - best), 6) AS d FROM scores), c AS (SELECT d, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM e GROUP BY d),
r AS (SELECT d, sum(n) OVER (ORDER BY d) / sum(n) OVER () AS fpr, sum(p) OVER (ORDER BY d) / sum(p) OVER () AS tpr FROM c), l AS (SELECT *, lag(fpr, 1, 0) OVER (ORDER BY d) AS f0, lag(tpr, 1, 0) OVER (ORDER BY d) AS t0 FROM r),
x AS (SELECT *, (f0 + t0 - 1) / ((f0 + t0 - 1) - (fpr + tpr - 1)) AS w FROM l WHERE round(fpr + tpr - 1, 12) >= 0 ORDER BY d LIMIT 1)
SELECT round(avg(d) FILTER (positive), 6) AS pos_mean, round(avg(d) FILTER (NOT positive), 6) AS neg_mean, round(quantile_cont(d, 0.01) FILTER (NOT positive), 6) AS neg_p01, round(quantile_cont(d, 0.05) FILTER (NOT positive), 6) AS neg_p05,
(SELECT round(min(fpr), 6) FROM l WHERE tpr >= 0.95) AS fpr_at_tpr95, (SELECT round(coalesce(max(tpr), 0), 6) FROM l WHERE fpr <= 0.0001) AS tpr_at_fpr_1e_4, (SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) FROM l) AS roc_auc,
(SELECT round((f0 + w * (fpr - f0) + 1 - t0 - w * (tpr - t0)) / 2, 6) FROM x) AS eer FROM e""")
def distance_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _scores(spark, sf_dir).select(F.col("genuine").alias("positive"), F.round(2 * (1 - F.col("best")), 6).alias("d"))
    got = verification.distance_metrics(found)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


@query("distance_metrics_exact", f"""WITH {EMB}, e AS (SELECT a.owner = b.owner AS positive, {L2.replace("q.v", "a.v").replace("g.v", "b.v")} AS d FROM emb a, emb b WHERE a.id % 20 = 0 AND a.id <> b.id), c AS (SELECT d, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM e GROUP BY d),
r AS (SELECT d, sum(n) OVER (ORDER BY d) / sum(n) OVER () AS fpr, sum(p) OVER (ORDER BY d) / sum(p) OVER () AS tpr FROM c), l AS (SELECT *, lag(fpr, 1, 0) OVER (ORDER BY d) AS f0, lag(tpr, 1, 0) OVER (ORDER BY d) AS t0 FROM r),
x AS (SELECT *, (f0 + t0 - 1) / ((f0 + t0 - 1) - (fpr + tpr - 1)) AS w FROM l WHERE round(fpr + tpr - 1, 12) >= 0 ORDER BY d LIMIT 1)
SELECT round(avg(d) FILTER (positive), 6) AS pos_mean, round(avg(d) FILTER (NOT positive), 6) AS neg_mean, round(quantile_cont(d, 0.01) FILTER (NOT positive), 6) AS neg_p01, round(quantile_cont(d, 0.05) FILTER (NOT positive), 6) AS neg_p05,
(SELECT round(min(fpr), 6) FROM l WHERE tpr >= 0.95) AS fpr_at_tpr95, (SELECT round(coalesce(max(tpr), 0), 6) FROM l WHERE fpr <= 0.0001) AS tpr_at_fpr_1e_4, (SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) FROM l) AS roc_auc,
(SELECT round((f0 + w * (fpr - f0) + 1 - t0 - w * (tpr - t0)) / 2, 6) FROM x) AS eer FROM e""")
def distance_metrics_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all distances of every twentieth vector to all others; positive: of one owner. Distances are taken as they are."""
    rows = vectors(spark, sf_dir)
    got = verification.pooled_metrics(rows.where("id % 20 = 0"), rows, digits=6)
    return got.select(*[F.round(c, 6).alias(c) for c in got.columns])


SUMMED = "s AS (SELECT o_orderkey AS id, o_custkey % 3 = 0 AS genuine, CAST(o_totalprice AS DOUBLE) / 500000 AS score, CAST(o_custkey % 100 AS DOUBLE) / 100 AS geometry, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 50 AS DOUBLE) / 50 END AS texture, o_orderkey % 4 <> 0 AS evaluated, o_orderkey % 8 > 2 AS available, CASE o_orderkey % 3 WHEN 0 THEN 'fused_score' WHEN 1 THEN 'geometry_below_low_gate' END AS decision FROM orders)"


@query("score_summary", f"""WITH {SUMMED}, k AS (SELECT unnest([true, false]) AS genuine) SELECT k.genuine, count(id) AS count, count(*) FILTER (evaluated) AS texture_evaluated, count(*) FILTER (available) AS texture_available, count(*) FILTER (decision = 'fused_score') AS fused_score_count, count(*) FILTER (score >= CAST(0.4 AS DOUBLE)) AS match_score_accept, count(*) FILTER (geometry >= CAST(0.4 AS DOUBLE)) AS geometry_only_accept,
count(*) FILTER ((score >= CAST(0.4 AS DOUBLE)) <> (geometry >= CAST(0.4 AS DOUBLE))) AS decision_changed, round(coalesce(avg(score), 0), 6) AS mean_score, round(coalesce(avg(geometry), 0), 6) AS mean_geometry, round(coalesce(avg(coalesce(texture, 0)), 0), 6) AS mean_texture FROM k LEFT JOIN s USING (genuine) GROUP BY k.genuine""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as attempts with geometry and texture scores."""
    c, n = F.col, F.col("o_orderkey")
    texture = F.when(n % 7 != 0, (n % 50).cast("double") / 50)
    decision = F.when(n % 3 == 0, "fused_score").when(n % 3 == 1, "geometry_below_low_gate")
    rows = table(spark, sf_dir, "orders").select((c("o_custkey") % 3 == 0).alias("genuine"), (c("o_totalprice").cast("double") / 500000).alias("score"), ((c("o_custkey") % 100).cast("double") / 100).alias("geometry"), texture.alias("texture"), (n % 4 != 0).alias("evaluated"), (n % 8 > 2).alias("available"), decision.alias("decision"))
    got = verification.score_summary(rows, 0.4)
    return got.select(*[F.round(x, 6).alias(x) if x.startswith("mean_") else x for x in got.columns])


FUSED = "f AS (SELECT l_orderkey AS q, l_suppkey % 2 AS owner, l_linenumber * 1000 + l_partkey % 1000 AS pos, l_partkey AS template, CAST(l_discount AS DOUBLE) * 10 AS score, CAST(l_tax AS DOUBLE) AS quality, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_suppkey % 4 END AS candidates, l_partkey % 3 AS inliers FROM lineitem)"


def _fusion_sql(stop: str) -> str:
    return f"""WITH {FUSED}, k AS (SELECT *, min(CASE WHEN score >= {stop} THEN pos END) OVER (PARTITION BY q, owner) AS last_ FROM f), s AS (SELECT * FROM k WHERE last_ IS NULL OR pos <= last_)
SELECT q, owner, round(max(score), 6) AS best_score, round(avg(score), 6) AS mean_score, round(list_avg(list(score ORDER BY score DESC)[1:3]), 6) AS top_mean, list(template ORDER BY score DESC, quality DESC, pos, template DESC)[1] AS best_template, list(pos ORDER BY score DESC, quality DESC, pos)[1] AS best_pos, count(*) AS templates, max(score) >= {stop} AS stopped,
count(*) FILTER (coalesce(candidates, 0) > 0) AS with_candidates, count(*) FILTER (inliers > 0) AS with_inliers, CAST(max(coalesce(candidates, 0)) AS DOUBLE) AS max_candidates, CAST(max(inliers) AS DOUBLE) AS max_inliers FROM s GROUP BY q, owner"""


@query("identity_fusion", _fusion_sql("CAST(0.8 AS DOUBLE)"))
def identity_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as templates' results, scanned in order until one reaches 0.8."""
    c = F.col
    candidates = F.when(c("l_partkey") % 5 != 0, c("l_suppkey") % 4)
    rows = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("q"), (c("l_suppkey") % 2).alias("owner"), (c("l_linenumber") * 1000 + c("l_partkey") % 1000).alias("pos"), c("l_partkey").alias("template"), (c("l_discount").cast("double") * 10).alias("score"), c("l_tax").cast("double").alias("quality"), candidates.alias("candidates"), (c("l_partkey") % 3).alias("inliers"))
    got = verification.identity_fusion(rows, 0.8, ("candidates", "inliers"), ("candidates", "inliers"))
    return got.select(*[F.round(x, 6).alias(x) if x in ("best_score", "mean_score", "top_mean") else x for x in got.columns])


@query("binary_losses", f"""WITH {EMB}, p AS (SELECT owner AS batch, (rn + 1) // 2 AS pair, (rn + 1) % 2 AS side, list_transform(v[1:16], lambda x: least(greatest(4 * x, -1), 1)) AS c, v FROM emb), full_ AS (SELECT batch, pair FROM p GROUP BY ALL HAVING count(*) = 2), d AS (SELECT p.*, row_number() OVER (PARTITION BY batch ORDER BY pair, side) AS i FROM p JOIN full_ USING (batch, pair)),
rel AS (SELECT a.batch, sum((list_cosine_similarity(a.c, b.c) - list_cosine_similarity(a.v, b.v)) ** 2) / count(*) AS teacher_similarity FROM d a JOIN d b ON a.batch = b.batch AND a.i <> b.i GROUP BY a.batch),
con AS (SELECT a.batch, avg((1 - list_dot_product(a.c, b.c) / 16) / 2) AS positive_consistency FROM d a JOIN d b ON a.batch = b.batch AND a.pair = b.pair AND a.side = 0 AND b.side = 1 GROUP BY a.batch),
bit AS (SELECT batch, i, k, c[k + 1] AS x FROM d, range(16) r(k)), m AS (SELECT batch, k, avg(x) AS m FROM bit GROUP BY ALL), q AS (SELECT batch, avg((1 - abs(x)) ** 2) AS quantization FROM bit GROUP BY batch), bal AS (SELECT batch, avg(m ** 2) AS balance FROM m GROUP BY batch),
cov AS (SELECT a.batch, a.k AS ka, b.k AS kb, sum((a.x - ma.m) * (b.x - mb.m)) / (count(*) - 1) AS cv FROM bit a JOIN bit b ON a.batch = b.batch AND a.i = b.i AND a.k <> b.k JOIN m ma ON ma.batch = a.batch AND ma.k = a.k JOIN m mb ON mb.batch = b.batch AND mb.k = b.k GROUP BY ALL), dec AS (SELECT batch, avg(cv ** 2) AS decorrelation FROM cov GROUP BY batch), n AS (SELECT batch, count(*) AS n FROM d GROUP BY batch)
SELECT batch, n, round(teacher_similarity, 6) AS teacher_similarity, round(positive_consistency, 6) AS positive_consistency, round(quantization, 6) AS quantization, round(balance, 6) AS balance, round(decorrelation, 6) AS decorrelation, round(teacher_similarity / 2 + positive_consistency / 10 + quantization / 10 + balance / 50 + decorrelation / 50, 6) AS loss FROM n JOIN rel USING (batch) JOIN con USING (batch) JOIN q USING (batch) JOIN bal USING (batch) JOIN dec USING (batch)""")
def binary_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each owner's vectors as a batch of consecutive pairs: 16 clipped components as bits, all as the teacher's descriptor."""
    c, rn = F.col, F.row_number().over(W.partitionBy("owner").orderBy("id"))
    bits = F.transform(F.slice("v", 1, 16), lambda x: F.least(F.greatest(4 * x, F.lit(-1.0)), F.lit(1.0)))
    rows = vectors(spark, sf_dir).select(c("owner").alias("batch"), F.floor((rn + 1) / 2).alias("pair"), ((rn + 1) % 2).alias("side"), bits.alias("c"), "v")
    two = [F.max(F.when(c("side") == k, c(x))).alias(name) for name, k, x in (("anchor", 0, "c"), ("positive", 1, "c"), ("anchor_teacher", 0, "v"), ("positive_teacher", 1, "v"))]
    got = losses.binary_losses(rows.groupBy("batch", "pair").agg(*two).drop("pair"), 16, 64)
    return got.select("batch", "n", *[F.round(x, 6).alias(x) for x in got.columns[2:]])


@query("failure_topn", f"""{SCORES}, k AS (SELECT CASE WHEN genuine AND best < 0.36 THEN 'false_reject' WHEN NOT genuine AND best >= 0.36 THEN 'false_accept' END AS kind, q, owner, best FROM scores)
SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY best DESC, q, owner) AS INT) AS rank, q, owner, best FROM k WHERE kind IS NOT NULL QUALIFY rank <= 20""")
def failure_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.failures(_scores(spark, sf_dir), 0.36, 20)


@query("score_components", f"{SCORES} SELECT genuine, count(*) AS n, count(*) FILTER (best >= 0.36) AS accepted, round(avg(best), 6) AS best_mean, round(avg(mean), 6) AS mean_mean, round(max(best), 6) AS best_max FROM scores GROUP BY genuine")
def score_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _scores(spark, sf_dir).groupBy("genuine")
    return got.agg(F.count("*").alias("n"), F.count_if(F.col("best") >= 0.36).alias("accepted"), F.round(F.avg("best"), 6).alias("best_mean"), F.round(F.avg("mean"), 6).alias("mean_mean"), F.round(F.max("best"), 6).alias("best_max"))


NEAR = f"near AS (SELECT q.id AS q, g.id AS g, {L2} AS d, row_number() OVER (PARTITION BY q.id ORDER BY {L2}, g.id) AS rank FROM emb q, emb g WHERE q.id % 20 = 0 AND q.id <> g.id)"


def _near(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return blocks.nearest(rows.where("id % 20 = 0"), rows, k)


@query("l2_topk", f"WITH {EMB}, {NEAR} SELECT q, g, round(d, 6) AS d, CAST(rank AS INT) AS rank FROM near WHERE rank <= 10")
def l2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir, 10).withColumn("d", F.round("d", 6))


@query("ratio_matches", f"WITH {EMB}, {NEAR.replace('q.id % 20 = 0 AND ', '')} SELECT a.q, a.g, round(a.d, 6) AS d FROM near a JOIN near b ON a.q = b.q AND a.rank = 1 AND b.rank = 2 WHERE a.d < 0.97 * b.d AND b.d > 1e-12")
def ratio_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every vector, not of every twentieth as in l2_topk."""
    rows = vectors(spark, sf_dir)
    return pairs.ratio_matches(blocks.nearest_of_all(rows, rows, 2), 0.97).withColumn("d", F.round("d", 6))


SIDES = f"sides AS (SELECT a.id AS a, b.id AS b, round(sqrt(greatest(2 - 2 * list_dot_product(a.v, b.v), 0)), 12) AS d FROM emb a, emb b WHERE a.rn <= 5 AND b.rn > 5)"


@query("mutual_nn", f"WITH {EMB}, {SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS f, row_number() OVER (PARTITION BY b ORDER BY d, a) AS k FROM sides) SELECT a AS q, b AS g, round(d, 6) AS d FROM r WHERE f = 1 AND k = 1")
def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.mutual(_near_both(spark, sf_dir, 1)).withColumn("d", F.round("d", 6))


def _near_both(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Enrolled vectors and the others, nearest both ways."""
    rows = verification.enrolled(vectors(spark, sf_dir))
    return blocks.nearest_both(rows.where("enrolled").drop("enrolled"), rows.where("not enrolled").drop("enrolled"), k)


@query("two_way_ratio", f"""WITH {EMB}, {SIDES}, r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS f, row_number() OVER (PARTITION BY b ORDER BY d, a) AS k FROM sides),
s AS (SELECT *, coalesce(lead(d) OVER (PARTITION BY a ORDER BY f), 'inf') AS f2, coalesce(lead(d) OVER (PARTITION BY b ORDER BY k), 'inf') AS k2 FROM r)
SELECT a AS q, b AS g, round(d, 6) AS d FROM s WHERE f = 1 AND k = 1 AND d < 0.99 * f2 AND d < 0.99 * k2 AND f2 > 1e-12 AND k2 > 1e-12""")
def two_way_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.two_way_ratio(_near_both(spark, sf_dir, 2), 0.99).withColumn("d", F.round("d", 6))


@query("point_groups", f"""WITH RECURSIVE {EMB}, {SIDES}, e AS (SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS f FROM sides) WHERE f <= 2),
both_ AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(node, root) AS (SELECT a, a FROM both_ UNION SELECT both_.b, reach.root FROM reach JOIN both_ ON reach.node = both_.a) SELECT node, min(root) AS root FROM reach GROUP BY node""")
def point_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verification.enrolled(vectors(spark, sf_dir))
    near = blocks.nearest(rows.where("enrolled").drop("enrolled"), rows.where("not enrolled").drop("enrolled"), 2)
    return groups.point_groups(near.select(F.col("q").alias("a"), F.col("g").alias("b")))


WHT = "list_sum(list_transform(range(64), lambda i: CASE WHEN bit_count((8 * j + b) & i) % 2 = 0 THEN v[i + 1] ELSE -v[i + 1] END))"


@query("hadamard_codes", f"WITH {EMB} SELECT id, array_to_string(list_transform(range(8), lambda j: CAST(list_sum(list_transform(range(8), lambda b: CASE WHEN {WHT} >= 0 THEN 1 << b ELSE 0 END)) AS BIGINT)), ',') AS code FROM emb")
def hadamard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.coefficients(vectors(spark, sf_dir), 64).select("id", codes.signs(F.col("w")).alias("bits"))
    return rows.select("id", F.array_join(codes.packed_bytes(F.col("bits"), 64).cast("array<string>"), ",").alias("code"))


@query("bit_statistics", f"WITH {EMB}, w AS (SELECT k, avg(CASE WHEN v[k + 1] >= 0 THEN 1 ELSE 0 END) AS p FROM emb, range(64) r(k) GROUP BY k) SELECT round(avg(p), 6) AS one_fraction, round(avg(abs(p - 0.5)), 6) AS balance_error, round(avg(CASE WHEN p IN (0, 1) THEN 1 ELSE 0 END), 6) AS constant_ratio FROM w")
def bit_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.bit_statistics(vectors(spark, sf_dir).select(codes.signs(F.col("v")).alias("bits")))


XY = "p AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS owner, 50 + 200 * CAST(embedding[1] AS DOUBLE) AS x, 50 + 200 * CAST(embedding[2] AS DOUBLE) AS y, 50 + 200 * CAST(embedding[3] AS DOUBLE) AS u, 50 + 200 * CAST(embedding[4] AS DOUBLE) AS v FROM embeddings)"
#: Each enrolled point and its ten nearest others; two thirds of them lie where one map of their owner puts them, the rest anywhere.
CAND = f"""{EMB}, {SIDES}, {XY}, near10 AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 10),
cand AS (SELECT p.owner, n.a * 1000000 + n.b AS id, n.a AS q, n.b AS g, n.d, p.x, p.y, CASE WHEN (n.a * 7 + n.b) % 3 <> 0 THEN CAST(0.9 AS DOUBLE) * p.x - CAST(0.3 AS DOUBLE) * p.y + 12 + o.x / 100 ELSE o.x END AS u,
CASE WHEN (n.a * 7 + n.b) % 3 <> 0 THEN CAST(0.3 AS DOUBLE) * p.x + CAST(0.9 AS DOUBLE) * p.y - 7 + o.y / 100 ELSE o.y END AS v, CAST((n.a * 13 + n.b * 7) % 40 - 2 AS DOUBLE) AS angle FROM near10 n JOIN p ON p.id = n.a JOIN p o ON o.id = n.b)"""


@query("array_norms", f"""WITH {EMB}, p AS (SELECT id, v, list_transform(v, lambda x: abs(x)) AS a, list_transform(v, lambda x: round(128 + 300 * x)) AS g FROM emb), s AS (SELECT *, sqrt(list_sum(list_transform(v[1:20], lambda x: x * x))) AS n, list_transform(a, lambda x: sqrt(x / (list_sum(a) + 1e-12))) AS r, list_avg(g) AS m, list_stddev_pop(g) AS sd FROM p)
SELECT id, round(v[3] / greatest(n, 1e-12), 6) AS unit, round(r[5] / (sqrt(list_sum(list_transform(r, lambda x: x * x))) + 1e-12), 6) AS root, round(sd, 6) AS std, round((g[7] - m) / greatest(sd, 1e-6), 6) AS standardised, round(len(list_filter(g, lambda x: x > 120)) / len(g), 6) AS valid,
CAST(list_sum(list_transform(range(8), lambda i: CASE WHEN v[i + 1] > 0 THEN 1 << CAST(7 - i AS INT) ELSE 0 END)) AS INT) AS big, CAST(list_sum(list_transform(range(8), lambda i: CASE WHEN v[i + 1] >= 0 THEN 1 << CAST(i AS INT) ELSE 0 END)) AS INT) AS little, '{arrays.transform_id("walsh", 64, "big", False)}' AS transform FROM s""")
def array_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value of each normalisation of a vector, patch statistics, and its first byte in either bit order."""
    c, v = F.col, F.col("v")
    rows = vectors(spark, sf_dir).select("id", "v", F.transform("v", F.abs).alias("a"), F.transform("v", lambda x: F.round(128 + 300 * x)).alias("g"))
    values = {"unit": arrays.unit(F.slice(v, 1, 20))[2], "root": arrays.rootsift(c("a"))[4], "std": arrays.mean_std(c("g"))[1], "standardised": arrays.standardised(c("g"))[6], "valid": arrays.share_above(c("g"), 120)}
    codes_ = {"big": arrays.packed(arrays.bits_of(v, False), 64, "big")[0], "little": arrays.packed(arrays.bits_of(v), 64)[0]}
    return rows.select("id", *[F.round(x, 6).alias(k) for k, x in values.items()], *[x.alias(k) for k, x in codes_.items()], F.lit(arrays.transform_id("walsh", 64, "big", False)).alias("transform"))


@query("checkpoint_scores", """WITH m AS (SELECT event_id AS epoch, CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(value AS DOUBLE) / 40 END AS loss, CAST(event_id % 17 AS DOUBLE) / 10 AS pm, CAST(event_id % 23 AS DOUBLE) / 10 AS nm, CAST(event_id % 13 AS DOUBLE) / 10 AS fpr, CASE WHEN event_id % 7 = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST(event_id % 29 AS DOUBLE) / 10 END AS p95, CAST(value AS DOUBLE) AS whole FROM events)
SELECT epoch, round(CAST(0.3 AS DOUBLE) * CASE WHEN loss IS NULL THEN 0 ELSE 1 - least(greatest(loss / 3, 0), 1) END + CAST(0.2 AS DOUBLE) * least(greatest((nm - pm) / 2, 0), 1) + CAST(0.35 AS DOUBLE) * (1 - least(fpr, 1)) + CAST(0.15 AS DOUBLE) * CASE WHEN isnan(p95) THEN 0 ELSE 1 - least(p95 / 2, 1) END, 6) AS score, round(greatest(0, whole - coalesce(loss, 0) - pm), 6) AS core FROM m""")
def checkpoint_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as epochs with the measures of a validation, some missing."""
    n, value = F.col("event_id"), F.col("value").cast("double")
    tenth = lambda k: (n % k).cast("double") / 10
    loss, p95 = F.when(n % 5 != 0, value / 40), F.when(n % 7 == 0, float("nan")).otherwise(tenth(29))
    return table(spark, sf_dir, "events").select(n.alias("epoch"), F.round(arrays.checkpoint_score(loss, tenth(17), tenth(23), tenth(13), p95), 6).alias("score"), F.round(arrays.core_time(value, loss, tenth(17)), 6).alias("core"))


CASES = "c AS (SELECT o_custkey % 40 AS q_owner, o_orderkey AS q, o_orderkey % 12 AS u, CAST(o_totalprice AS DOUBLE) AS score, CAST(o_custkey % 7 AS DOUBLE) AS quality FROM orders)"


@query("extreme_cases", f"""WITH {CASES}, t AS (SELECT 'top' AS side, row_number() OVER (ORDER BY u DESC, score DESC, quality DESC, q_owner DESC, q DESC) AS rank, * FROM c QUALIFY rank <= 25), b AS (SELECT 'bottom' AS side, row_number() OVER (ORDER BY u, score, quality, q_owner, q) AS rank, * FROM c WHERE u >= 3 QUALIFY rank <= 15)
SELECT side, CAST(rank AS INT) AS rank, q_owner, q, u AS inliers, score, quality FROM (FROM t UNION ALL FROM b)""")
def extreme_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    rows = table(spark, sf_dir, "orders").select((c("o_custkey") % 40).alias("q_owner"), c("o_orderkey").alias("q"), (c("o_orderkey") % 12).alias("inliers"), c("o_totalprice").cast("double").alias("score"), (c("o_custkey") % 7).cast("double").alias("quality"))
    return verification.extreme_cases(rows, 25, 15, 3)


@query("nearest_candidates", f"WITH {CAND} SELECT owner, q, g, round(d, 6) AS d FROM cand QUALIFY row_number() OVER (PARTITION BY owner ORDER BY d, q, g) <= 20")
def nearest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest candidates of each owner."""
    return verification.nearest_candidates(_seen_candidates(spark, sf_dir), "owner", 20).select("owner", "q", "g", F.round("d", 6).alias("d"))


@query("image_pairs", f"WITH {EMB} SELECT owner, a, b FROM (SELECT p.owner, p.id AS a, q.id AS b, row_number() OVER (PARTITION BY p.owner ORDER BY p.id, q.id) AS n FROM emb p JOIN emb q ON p.owner = q.owner AND p.id < q.id) WHERE n <= 100")
def image_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.image_pairs(vectors(spark, sf_dir), 100)


@query("group_split", "WITH c AS (SELECT DISTINCT o_custkey AS owner FROM orders WHERE o_custkey IS NOT NULL), r AS (SELECT owner, row_number() OVER (ORDER BY md5('42|' || owner), owner) AS pos, count(*) OVER () AS n FROM c) SELECT owner, CASE WHEN pos <= round_even(n * CAST(0.8 AS DOUBLE), 0) THEN 'train' WHEN pos <= round_even(n * CAST(0.9 AS DOUBLE), 0) THEN 'val' ELSE 'test' END AS split FROM r")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.group_split(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner")))




def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and scores from the first components of each vector."""
    return vectors(spark, sf_dir).select("id", "owner", *[(F.col("v")[i] * 200 + 50).alias(n) for i, n in enumerate("xyuv")], F.col("v")[4].alias("score"))


@query("affine_fit", f"""WITH {XY}, c AS (SELECT owner, count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM p GROUP BY owner),
f AS (SELECT owner, c.n, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) / sum((x - mx) ** 2 + (y - my) ** 2) AS a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) / sum((x - mx) ** 2 + (y - my) ** 2) AS b, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv FROM p JOIN c USING (owner) GROUP BY owner, c.n)
SELECT owner, n, round(a, 6) AS a, round(b, 6) AS b, round(mu - a * mx + b * my, 6) AS tx, round(mv - b * mx - a * my, 6) AS ty FROM f""")
def affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pairs.affine_fit(_points(spark, sf_dir), "owner")
    return got.select("owner", "n", *[F.round(c, 6).alias(c) for c in ("a", "b", "tx", "ty")])


ROBUST = f"""{CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY md5('7|' || id), id) - 1 AS i, count(*) OVER (PARTITION BY owner) AS n FROM cand),
ends AS (SELECT s.owner, t.h, p1.x AS x1, p1.y AS y1, p1.u AS u1, p1.v AS v1, p2.x - p1.x AS dx, p2.y - p1.y AS dy, p2.u - p1.u AS du, p2.v - p1.v AS dv FROM (SELECT DISTINCT owner, n FROM r) s JOIN range(256) t(h) ON t.h < s.n * (s.n - 1)
JOIN r p1 ON p1.owner = s.owner AND p1.i = t.h % s.n JOIN r p2 ON p2.owner = s.owner AND p2.i = (t.h % s.n + 1 + (t.h // s.n) % (s.n - 1)) % s.n),
turned AS (SELECT *, (dx * du + dy * dv) / (dx * dx + dy * dy) AS a, (dx * dv - dy * du) / (dx * dx + dy * dy) AS b FROM ends WHERE dx * dx + dy * dy <> 0),
maps AS (SELECT owner, h, a, b, u1 - a * x1 + b * y1 AS tx, v1 - b * x1 - a * y1 AS ty FROM turned),
votes AS (SELECT m.owner, m.h, m.a, m.b, m.tx, m.ty, count(*) AS n, count(*) FILTER ((m.a * c.x - m.b * c.y + m.tx - c.u) ** 2 + (m.b * c.x + m.a * c.y + m.ty - c.v) ** 2 <= 25) AS inliers FROM maps m JOIN cand c USING (owner) GROUP BY ALL),
best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY owner ORDER BY inliers DESC, h) = 1),
inl AS (SELECT c.* FROM cand c JOIN best m USING (owner) WHERE (m.a * c.x - m.b * c.y + m.tx - c.u) ** 2 + (m.b * c.x + m.a * c.y + m.ty - c.v) ** 2 <= 25),
mid AS (SELECT owner, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM inl GROUP BY owner),
ab AS (SELECT owner, any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv, sum((x - mx) * (u - mu) + (y - my) * (v - mv)) / sum((x - mx) ** 2 + (y - my) ** 2) AS a, sum((x - mx) * (v - mv) - (y - my) * (u - mu)) / sum((x - mx) ** 2 + (y - my) ** 2) AS b FROM inl JOIN mid USING (owner) GROUP BY owner),
fit AS (SELECT owner, a, b, mu - a * mx + b * my AS tx, mv - b * mx - a * my AS ty FROM ab)"""
#: The plain greedy pass, edge by edge.
GREEDY = f"""{ROBUST}, scored AS (SELECT i.*, sqrt((f.a * i.x - f.b * i.y + f.tx - i.u) ** 2 + (f.b * i.x + f.a * i.y + f.ty - i.v) ** 2) AS error FROM inl i JOIN fit f USING (owner)),
costs AS (SELECT *, d + CAST(0.05 AS DOUBLE) * error AS cost FROM scored), queue AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY cost, q, g) AS k FROM costs),
pass(owner, k, uq, ug, taken) AS (SELECT DISTINCT owner, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), false FROM queue
UNION ALL SELECT p.owner, e.k, CASE WHEN ok THEN list_append(uq, e.q) ELSE uq END, CASE WHEN ok THEN list_append(ug, e.g) ELSE ug END, ok FROM (SELECT p.*, NOT list_contains(uq, e.q) AND NOT list_contains(ug, e.g) AS ok, e.k AS ek, e.q, e.g FROM pass p JOIN queue e ON e.owner = p.owner AND e.k = p.k + 1) p JOIN queue e ON e.owner = p.owner AND e.k = p.ek),
kept AS (SELECT e.* FROM queue e JOIN pass p ON p.owner = e.owner AND p.k = e.k AND p.taken)"""


def _seen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = verification.enrolled(vectors(spark, sf_dir))
    near = blocks.nearest(rows.where("enrolled").drop("enrolled"), rows.where("not enrolled").drop("enrolled"), 10)
    p, c = _points(spark, sf_dir), F.col
    placed = near.join(p.select("owner", c("id").alias("q"), "x", "y"), "q").join(p.select(c("id").alias("g"), c("x").alias("ox"), c("y").alias("oy")), "g")
    true = (c("q") * 7 + c("g")) % 3 != 0
    u = F.when(true, 0.9 * c("x") - 0.3 * c("y") + 12 + c("ox") / 100).otherwise(c("ox"))
    v = F.when(true, 0.3 * c("x") + 0.9 * c("y") - 7 + c("oy") / 100).otherwise(c("oy"))
    return placed.select("owner", (c("q") * 1000000 + c("g")).alias("id"), "q", "g", "d", "x", "y", u.alias("u"), v.alias("v"), ((c("q") * 13 + c("g") * 7) % 40 - 2).cast("double").alias("angle"))


@query("robust_affine", f"WITH {ROBUST} SELECT m.owner, m.n, m.inliers, m.h, round(f.a, 6) AS a, round(f.b, 6) AS b, round(f.tx, 6) AS tx, round(f.ty, 6) AS ty FROM best m JOIN fit f USING (owner)")
def robust_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = matching.robust_affine(_seen_candidates(spark, sf_dir), "owner")
    return got.select("owner", "n", "inliers", "guess.h", *[F.round(k, 6).alias(k) for k in ("a", "b", "tx", "ty")])


def _matches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, the map of each owner, and its one-to-one inliers."""
    candidates = written(_seen_candidates(spark, sf_dir), "candidates")
    maps = matching.robust_affine(candidates, "owner")
    found = matching.inliers(candidates, maps, "owner").withColumn("cost", F.col("d") + 0.05 * F.col("error"))
    return candidates, maps, matching.one_to_one(found, "owner")


@query("verified_matches", f"WITH RECURSIVE {GREEDY} SELECT owner, q, g, round(cost, 6) AS cost, round(error, 6) AS error FROM kept")
def verified_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that agree with their owner's map, each point in one of them, cheapest first."""
    return _matches(spark, sf_dir)[2].select("owner", "q", "g", F.round("cost", 6).alias("cost"), F.round("error", 6).alias("error"))


@query("match_summary", f"""WITH RECURSIVE {GREEDY}, n AS (SELECT owner, count(*) AS candidates FROM cand GROUP BY owner),
bins AS (SELECT owner, CAST(least(floor((angle + 180) / 10), 35) AS INT) AS bin, count(*) AS votes FROM kept GROUP BY ALL), main AS (SELECT owner, list(bin ORDER BY votes DESC, bin)[1] * 10 - 180 + CAST(5 AS DOUBLE) AS main_angle FROM bins GROUP BY owner),
e AS (SELECT owner, count(*) AS matches, avg(error) AS mean_error, avg(CASE WHEN abs(angle - main_angle) <= 15 THEN 1 ELSE 0 END) AS consistency, any_value(main_angle) AS main_angle FROM kept JOIN main USING (owner) GROUP BY owner),
j AS (SELECT n.owner, n.candidates, coalesce(sqrt(f.a * f.a + f.b * f.b) BETWEEN CAST(0.75 AS DOUBLE) AND CAST(1.35 AS DOUBLE), false) AS success, b.inliers, e.*EXCLUDE (owner), degrees(atan2(f.b, f.a)) AS rotation, sqrt(f.a * f.a + f.b * f.b) AS scale FROM n LEFT JOIN best b USING (owner) LEFT JOIN fit f USING (owner) LEFT JOIN e USING (owner))
SELECT owner, candidates, success, CASE WHEN success THEN inliers ELSE 0 END AS inliers, CASE WHEN success THEN coalesce(matches, 0) ELSE 0 END AS matches, round(CASE WHEN success THEN rotation ELSE 0 END, 6) AS rotation, round(CASE WHEN success THEN scale ELSE 0 END, 6) AS scale,
round(CASE WHEN success THEN mean_error ELSE 0 END, 6) AS mean_error, CASE WHEN success THEN main_angle ELSE 0 END AS main_angle, round(CASE WHEN success THEN consistency ELSE 0 END, 6) AS consistency FROM j""")
def match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates, maps, kept = _matches(spark, sf_dir)
    got = matching.pair_summary(candidates, maps, kept, "owner")
    return got.select("owner", "candidates", "success", "inliers", "matches", *[F.round(k, 6).alias(k) for k in ("rotation", "scale", "mean_error", "main_angle", "consistency")])


@query("radius_matches", f"""WITH {XY}, m AS (SELECT a.owner, a.id AS a, b.id AS b, sqrt((b.u - a.x) ** 2 + (b.v - a.y) ** 2) AS d FROM p a JOIN p b ON a.owner = b.owner),
k AS (SELECT *, abs((((b * 11 - a * 7 + 180) % 360 + 360) % 360) - 180) AS turn FROM m WHERE d <= 12 QUALIFY row_number() OVER (PARTITION BY owner, a ORDER BY d + 12 * least(least(turn, 180 - turn) / CAST(20 AS DOUBLE), 2), b) = 1)
SELECT owner, a, b, round(d, 6) AS distance FROM k WHERE (a + b) % 5 <> 0""")
def radius_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points against the second places of others of their owner; pairs whose ids sum to a multiple of five are known."""
    rows, n = _points(spark, sf_dir), F.col("id")
    found = pairs.nearby(rows.select("owner", "id", "x", "y", (n * 7).alias("angle")), rows.select("owner", "id", F.col("u").alias("x"), F.col("v").alias("y"), (n * 11).alias("angle")), "owner", 12.0, 20.0)
    known = found.where("(a + b) % 5 = 0").select("owner", "a", "b")
    return pairs.expanded(found, known, "owner").withColumn("distance", F.round("distance", 6))


@query("reserved_picks", """WITH r AS (SELECT o_custkey AS owner, o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS score, o_orderkey % 3 = 0 AS reserved FROM orders),
f AS (SELECT *, reserved AND row_number() OVER (PARTITION BY owner, reserved ORDER BY score DESC, id) <= 2 AS first_ FROM r),
k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY owner ORDER BY first_ DESC, score DESC, id) <= 5)
SELECT owner, id, score, reserved, CAST(row_number() OVER (PARTITION BY owner ORDER BY score DESC, id) AS INT) AS rank FROM k""")
def reserved_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), n.alias("id"), F.col("o_totalprice").cast("double").alias("score"), (n % 3 == 0).alias("reserved"))
    return pairs.reserved_picks(rows, "owner", 2, 5)


@query("dominant_angle", f"WITH {XY}, b AS (SELECT owner, CAST(least(floor((degrees(atan2(y - 50, x - 50)) + 180) / 10), 35) AS INT) AS bin, count(*) AS votes FROM p GROUP BY ALL) SELECT owner, list(bin ORDER BY votes DESC, bin)[1] * 10 - 180 + CAST(5 AS DOUBLE) AS angle, max(votes) AS votes FROM b GROUP BY owner")
def dominant_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.dominant_angle(_points(spark, sf_dir), "owner", F.degrees(F.atan2(F.col("y") - 50, F.col("x") - 50)))


def _spaced_sql(near: str) -> str:
    """The plain greedy pass, point by point; k is a point that stayed, e the next."""
    return f"""WITH RECURSIVE {XY}, s AS (SELECT p.*, CAST(embedding[5] AS DOUBLE) AS score FROM p JOIN embeddings ON vec_id = id), e AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, id) AS n FROM s),
pass AS (SELECT owner, CAST(1 AS BIGINT) AS n, [{{'id': id, 'x': x, 'y': y, 'u': u, 'v': v}}] AS kept FROM e WHERE n = 1
UNION ALL SELECT p.owner, e.n, CASE WHEN len(list_filter(p.kept, lambda k: {near})) = 0 THEN list_append(p.kept, {{'id': e.id, 'x': e.x, 'y': e.y, 'u': e.u, 'v': e.v}}) ELSE p.kept END FROM pass p JOIN e ON e.owner = p.owner AND e.n = p.n + 1)
SELECT owner, k.id AS id FROM (SELECT owner, unnest(kept) AS k FROM pass QUALIFY row_number() OVER (PARTITION BY owner ORDER BY n DESC) = 1)"""


@query("spaced_points", _spaced_sql("sqrt((k.x - e.x) ** 2 + (k.y - e.y) ** 2) < 20"))
def spaced_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.spaced(_points(spark, sf_dir), "owner", 20.0)


@query("spaced_pairs", _spaced_sql("sqrt((k.x - e.x) ** 2 + (k.y - e.y) ** 2) < 12 OR sqrt((k.u - e.u) ** 2 + (k.v - e.v) ** 2) < 12"))
def spaced_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As spaced_points, by either of two places."""
    return pairs.spaced(_points(spark, sf_dir), "owner", 12.0, (("x", "y"), ("u", "v")))


RECORDS = "r AS (SELECT l_suppkey AS owner, l_suppkey || '-' || CAST(l_quantity AS BIGINT) % 7 AS pair, l_partkey % 400 AS point, l_orderkey * 10 + l_linenumber AS id FROM lineitem), o AS (SELECT DISTINCT owner, pair FROM r)"
FILLED = """q AS (SELECT *, {base} + CASE WHEN row_number() OVER (PARTITION BY batch ORDER BY md5(concat_ws('|', {seed}, batch, owner)), owner) <= {rest} THEN 1 ELSE 0 END AS quota FROM sched),
one AS (SELECT q.batch, q.owner, q.pair, q.quota, r.point, md5(concat_ws('|', {seed}, q.batch, r.id)) AS k, r.id FROM q JOIN r USING (owner, pair) QUALIFY row_number() OVER (PARTITION BY batch, q.owner, q.pair, point ORDER BY k, r.id) = 1),
pick AS (SELECT *, row_number() OVER (PARTITION BY batch, owner, pair ORDER BY k, id, point) - 1 AS i, least(count(*) OVER (PARTITION BY batch, owner, pair), quota) AS m FROM one QUALIFY i < quota),
slots AS (SELECT p.*, s.slot FROM pick p, range({base} + 1) s(slot) WHERE s.slot < p.quota AND s.slot % p.m = p.i)
SELECT batch, row_number() OVER (PARTITION BY batch ORDER BY md5(concat_ws('|', {seed}, batch, owner, slot)), owner, slot) - 1 AS place, owner, pair, point, id, slot >= m AS again FROM slots"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as matched points: a supplier is an owner, a few of its quantities a pair of images, parts are points."""
    c = F.col
    pair = F.concat(c("l_suppkey").cast("string"), F.lit("-"), (c("l_quantity").cast("long") % 7).cast("string"))
    return table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("owner"), pair.alias("pair"), (c("l_partkey") % 400).alias("point"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"))


@query("validation_batches", f"""WITH {RECORDS}, f AS (SELECT owner FROM o GROUP BY owner ORDER BY md5('42|' || owner), owner LIMIT 6), n AS (SELECT owner, count(*) AS n FROM o WHERE owner IN (FROM f) GROUP BY owner),
c AS (SELECT o.owner, o.pair, n.n, t.cycle, row_number() OVER (PARTITION BY o.owner, t.cycle ORDER BY md5(concat_ws('|', 42, t.cycle, o.owner, o.pair)), o.pair) AS place FROM o JOIN n USING (owner), range(20) t(cycle) WHERE t.cycle * n.n < 20),
sched AS (SELECT cycle * n + place - 1 AS batch, owner, pair FROM c WHERE cycle * n + place - 1 < 20), {FILLED.format(base=32 // 6, rest=32 % 6, seed=42)}""")
def validation_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty fixed batches of 32 from six suppliers; their pairs recur once all have been."""
    return batches.validation_batches(_records(spark, sf_dir), 32, 20, 6)


@query("training_batches", f"""WITH {RECORDS}, w AS (SELECT owner, count(*) OVER () AS n FROM o GROUP BY owner),
a AS (SELECT owner, t.cycle, n // 4 AS each_, row_number() OVER (PARTITION BY t.cycle ORDER BY md5(concat_ws('|', 45, t.cycle, owner)), owner) - 1 AS spot FROM w, range(30) t(cycle) WHERE t.cycle * (n // 4) < 30),
b AS (SELECT spot // 4 + cycle * each_ AS batch, owner FROM a WHERE spot < each_ * 4 AND spot // 4 + cycle * each_ < 30),
sched AS (SELECT batch, owner, pair FROM b JOIN o USING (owner) QUALIFY row_number() OVER (PARTITION BY batch, owner ORDER BY md5(concat_ws('|', 45, batch, owner, pair)), pair) = 1), {FILLED.format(base=30 // 4, rest=30 % 4, seed=45)}""")
def training_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epoch 3 of thirty batches of 30, four suppliers in each."""
    return batches.training_batches(_records(spark, sf_dir), 30, 4, 30, seed=42, epoch=3)


@query("group_numbers", """WITH r AS (SELECT l_suppkey AS owner, l_orderkey * 10 + l_linenumber AS id, l_returnflag AS a, l_linestatus AS b FROM lineitem), f AS (SELECT owner, min(id) AS first FROM r GROUP BY owner),
s AS (SELECT owner, frame, min(spot) AS first FROM (SELECT owner, a AS frame, 2 * id AS spot FROM r UNION ALL SELECT owner, b, 2 * id + 1 FROM r) GROUP BY ALL)
SELECT 'owner' AS kind, owner, '' AS frame, row_number() OVER (ORDER BY first, owner) - 1 AS number FROM f UNION ALL SELECT 'frame', owner, frame, row_number() OVER (ORDER BY first, owner, frame) - 1 FROM s""")
def group_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, and the frames of the first and second image of each row, numbered as they first come up."""
    c, rows = F.col, table(spark, sf_dir, "lineitem")
    r = rows.select(c("l_suppkey").alias("owner"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), "l_returnflag", "l_linestatus")
    frames = r.select("owner", F.inline(F.array(*[F.struct(c(k).alias("frame"), (2 * c("id") + i).alias("at")) for i, k in enumerate(("l_returnflag", "l_linestatus"))])))
    owners = numbering.first_appearance(r, ["owner"], "id", "number").select(F.lit("owner").alias("kind"), "owner", F.lit("").alias("frame"), "number")
    return owners.unionByName(numbering.first_appearance(frames, ["owner", "frame"], "at", "number").select(F.lit("frame").alias("kind"), "owner", "frame", "number"))


@query("counts_by_key", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def counts_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("timing_summary", "WITH s AS (SELECT event_type, list(value ORDER BY value) AS l, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(l) AS n, l[1] AS least, mean, l[CAST(round_even((len(l) - 1) * CAST(0.5 AS DOUBLE), 0) AS BIGINT) + 1] AS p50, l[CAST(round_even((len(l) - 1) * CAST(0.95 AS DOUBLE), 0) AS BIGINT) + 1] AS p95, l[-1] AS most FROM s")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.timing_summary(table(spark, sf_dir, "events"), "event_type", "value")


@query("best_so_far", "WITH b AS (SELECT user_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events) SELECT user_id, max(best) AS best, count(*) FILTER (value >= best) AS bests FROM b GROUP BY user_id")
def best_so_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events.best_so_far(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value")
    return rows.groupBy("user_id").agg(F.max("best").alias("best"), F.count_if("is_best").alias("bests"))


@query("weighted_mean", "SELECT user_id, round(coalesce(sum(value * (event_id % 7)) / nullif(sum(event_id % 7), 0), 0), 6) AS mean FROM events GROUP BY user_id")
def weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.weighted_mean(table(spark, sf_dir, "events").withColumn("w", F.col("event_id") % 7), "user_id", "value", "w")


@query("lru_library", "WITH l AS (SELECT user_id, event_type, max({'ts': ts, 'e': event_id}) AS last FROM events GROUP BY ALL) SELECT user_id, event_type, CAST(row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS INT) AS position FROM l QUALIFY position <= 3")
def lru_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.library_contents(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"], 3)


PMOD = "((({0}) % 360 + 360) % 360)"


@query("angles", f"SELECT event_id, round(180 - {PMOD.format('180 - value * 7')}, 6) AS wrapped, round(abs({PMOD.format('value * 3 - value * 5 + 180')} - 180), 6) AS diff, round(least(diff, 180 - diff), 6) AS axis FROM events")
def angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    diff = F.round(scalars.angle_diff(v * 3, v * 5), 6)
    return table(spark, sf_dir, "events").select("event_id", F.round(scalars.wrap_angle(v * 7), 6).alias("wrapped"), diff.alias("diff"), F.round(F.least(diff, 180 - diff), 6).alias("axis"))


TOKEN = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(trim(coalesce({0}, '')), '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''), 'unknown')"


@query("stable_ids", f"SELECT doc_id, left({TOKEN.format('source')} || '__' || {TOKEN.format('lang')} || '__' || doc_id || '__' || left(sha1(concat_ws('|', source, lang, doc_id)), 12), 180) AS stable_id, md5({TOKEN.format('text')}) AS token_md5 FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scalars.stable_id(F.col("source"), F.col("lang"), F.col("doc_id")).alias("stable_id"), F.md5(scalars.sanitize_token(F.col("text"))).alias("token_md5"))


BATCH = f"""WITH b AS (SELECT vec_id AS id, vec_id // 50 AS batch, CAST(label AS BIGINT) AS owner, CAST(embedding AS DOUBLE[]) AS v, list_reverse(v) AS p, 50 + 200 * v[1] AS x, 50 + 200 * v[2] AS y FROM embeddings),
pairs AS (SELECT i.batch, i.id AS anchor, j.id AS candidate, i.v, i.p, j.v AS jv, j.p AS jp FROM b i JOIN b j ON i.batch = j.batch AND i.id <> j.id AND (i.owner <> j.owner OR greatest(abs(i.x - j.x), abs(i.y - j.y)) >= 20)),
both_ AS (SELECT batch, anchor, candidate, 0 AS direction, round(sqrt(greatest(2 - 2 * list_dot_product(v, jp), 0)), 12) AS d FROM pairs UNION ALL SELECT batch, anchor, candidate, 1, round(sqrt(greatest(2 - 2 * list_dot_product(jv, p), 0)), 12) FROM pairs),
hard AS (SELECT *, row_number() OVER (PARTITION BY batch, anchor ORDER BY d, direction, candidate) AS rank FROM both_ QUALIFY rank <= 3)"""


def _negatives(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """Batches of 50 vectors by id; a vector's positive is its values in reverse order."""
    v = F.col("v")
    rows = vectors(spark, sf_dir).select(F.floor(F.col("id") / 50).alias("batch"), "id", "owner", F.col("id").alias("point"), F.lit(0).alias("frame"), (v[0] * 200 + 50).alias("x"), (v[1] * 200 + 50).alias("y"), "v", F.reverse(v).alias("p"))
    return negatives.hard_negatives(rows, top, True, 20.0)


@query("hard_negatives", f"{BATCH} SELECT batch, anchor, CAST(rank AS INT) AS rank, candidate, CAST(direction AS INT) AS direction, round(d, 6) AS d FROM hard")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _negatives(spark, sf_dir).select("batch", "anchor", F.posexplode("negatives").alias("at", "n"))
    return found.select("batch", "anchor", (F.col("at") + 1).alias("rank"), "n.candidate", "n.direction", F.round("n.d", 6).alias("d"))


@query("triplet_loss", f"""{BATCH}, a AS (SELECT batch, anchor, list(d ORDER BY rank) AS n FROM hard GROUP BY ALL),
s AS (SELECT b.batch, n, round(sqrt(greatest(2 - 2 * list_dot_product(v, p), 0)), 12) AS pos, list_transform(n, lambda d: greatest(0, 1 + pos - d)) AS h FROM b LEFT JOIN a ON b.id = a.anchor),
t AS (SELECT batch, count(n) AS anchors, count(*) FILTER (n IS NULL) AS skipped, avg(CASE WHEN len(n) > 1 THEN CAST(0.6 AS DOUBLE) * h[1] + CAST(0.4 AS DOUBLE) * list_avg(h[2:]) WHEN len(n) = 1 THEN h[1] END) AS ranking, avg(list_avg(n)) AS neg_mean, avg(pos) FILTER (n IS NOT NULL) AS pos_mean, quantile_cont(pos, 0.95) FILTER (n IS NOT NULL) AS p95, quantile_cont(pos, 0.99) FILTER (n IS NOT NULL) AS p99 FROM s GROUP BY batch),
u AS (SELECT *, CAST(0.5 AS DOUBLE) * (greatest(0, p95 - CAST(0.5 AS DOUBLE)) ** 2 + greatest(0, p99 - CAST(0.7 AS DOUBLE)) ** 2) / 2 AS tail FROM t)
SELECT batch, anchors, skipped, round(ranking, 6) AS ranking, round(neg_mean, 6) AS neg_mean, round(pos_mean, 6) AS pos_mean, round(p95, 6) AS p95, round(p99, 6) AS p99, round(tail, 6) AS tail, round(ranking + tail, 6) AS loss FROM u""")
def triplet_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.triplet_loss(_negatives(spark, sf_dir))


@query("validation_summary", f"""{BATCH}, a AS (SELECT anchor, count(*) AS k FROM both_ GROUP BY anchor), s AS (SELECT b.batch, b.id, a.k, round(sqrt(greatest(2 - 2 * list_dot_product(v, p), 0)), 12) AS pos FROM b LEFT JOIN a ON b.id = a.anchor),
h AS (SELECT s.id, avg(greatest(0, 1 + s.pos - hard.d)) AS loss, max(greatest(0, 1 + s.pos - hard.d)) > 0 AS active FROM s JOIN hard ON s.id = hard.anchor GROUP BY s.id),
e AS (SELECT true AS positive, pos AS d FROM s WHERE k > 0 UNION ALL SELECT false, d FROM both_), c AS (SELECT d, count(*) FILTER (positive) AS p, count(*) FILTER (NOT positive) AS n FROM e GROUP BY d),
r AS (SELECT d, sum(n) OVER (ORDER BY d) / sum(n) OVER () AS fpr, sum(p) OVER (ORDER BY d) / sum(p) OVER () AS tpr FROM c), l AS (SELECT *, lag(fpr, 1, 0) OVER (ORDER BY d) AS f0, lag(tpr, 1, 0) OVER (ORDER BY d) AS t0 FROM r),
x AS (SELECT *, (f0 + t0 - 1) / ((f0 + t0 - 1) - (fpr + tpr - 1)) AS w FROM l WHERE round(fpr + tpr - 1, 12) >= 0 ORDER BY d LIMIT 1)
SELECT (SELECT count(DISTINCT batch) FROM s) AS batches, (SELECT count(k) FROM s) AS valid_anchor_count, (SELECT count(*) - count(k) FROM s) AS skipped_anchor_count, (SELECT round(count(k) / count(*), 6) FROM s) AS valid_anchor_ratio, (SELECT round(avg(loss), 6) FROM h) AS loss, (SELECT round(avg(CAST(active AS INT)), 6) FROM h) AS active_triplet_ratio,
round(avg(d) FILTER (positive), 6) AS pos_mean, round(avg(d) FILTER (NOT positive), 6) AS neg_mean, round(quantile_cont(d, 0.01) FILTER (NOT positive), 6) AS neg_p01, round(quantile_cont(d, 0.05) FILTER (NOT positive), 6) AS neg_p05, round(quantile_cont(d, 0.95) FILTER (positive), 6) AS pos_p95, round(quantile_cont(d, 0.99) FILTER (positive), 6) AS pos_p99,
(SELECT round(min(fpr), 6) FROM l WHERE tpr >= 0.95) AS fpr_at_tpr95, (SELECT round(coalesce(max(tpr), 0), 6) FROM l WHERE fpr <= 0.0001) AS tpr_at_fpr_1e_4, (SELECT round(sum((fpr - f0) * (tpr + t0) / 2), 6) FROM l) AS roc_auc, (SELECT round((f0 + w * (fpr - f0) + 1 - t0 - w * (tpr - t0)) / 2, 6) FROM x) AS eer FROM e""")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all batches: rates of the whole candidate pool, loss values of each anchor's nearest three."""
    got = negatives.validation_summary(_negatives(spark, sf_dir, 1 << 30), 3)
    return got.select(*[F.round(x, 6).alias(x) if t == "double" else x for x, t in got.dtypes])


@query("hamming_topk", f"""WITH {EMB}, c AS (SELECT id, list_transform(v, lambda x: CASE WHEN x >= 0 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END) AS s FROM emb)
SELECT q.id AS q, g.id AS g, (1 - list_dot_product(q.s, g.s) / 64) / 2 AS d, CAST(row_number() OVER (PARTITION BY q.id ORDER BY (1 - list_dot_product(q.s, g.s) / 64) / 2, g.id) AS INT) AS rank FROM c q, c g WHERE q.id % 20 = 0 AND q.id <> g.id QUALIFY rank <= 10""")
def hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("v", F.transform("v", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0)))
    return blocks.nearest(rows.where("id % 20 = 0"), rows, 10, "hamming")


#: What each policy keeps of the nearest three.
POLICIES = {
    "match_candidates": ("topk_or_ratio", "CASE WHEN alone THEN rank = 1 ELSE many END"),
    "match_candidates_ratio": ("ratio_only", "alone AND rank = 1"),
    "match_candidates_topk": ("topk_only", "many"),
}


def _candidates(policy: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pairs.candidates(_near(spark, sf_dir, 3), policy, 3, 0.97, 1.2, 0.03).withColumn("d", F.round("d", 6))


for _name, (_policy, _kept) in POLICIES.items():
    query(_name, f"""WITH {EMB}, {NEAR}, r AS (SELECT q, g, d, rank, min(d) FILTER (rank = 1) OVER w AS best, min(d) FILTER (rank = 2) OVER w AS second FROM near WHERE rank <= 3 WINDOW w AS (PARTITION BY q)),
k AS (SELECT *, best < CAST(0.97 AS DOUBLE) * second AND best <= CAST(1.2 AS DOUBLE) AS alone, d <= least(CAST(1.2 AS DOUBLE), best + CAST(0.03 AS DOUBLE)) AS many FROM r)
SELECT list(q ORDER BY d, q)[1] AS q, g, round(min(d), 6) AS d FROM k WHERE {_kept} GROUP BY g""")(_candidates(_policy))


@query("fused_scores", "SELECT event_id, round(CASE WHEN event_id % 15 < 4 OR event_id % 11 = 0 THEN 0 ELSE least(least((event_id % 15) / 12, 1) * CAST(0.7 AS DOUBLE) + (event_id % 101) / 100 * CAST(0.3 AS DOUBLE), 1) END, 6) AS score, CASE WHEN event_id % 15 < 4 THEN 'geometry_below_low_gate' WHEN event_id % 11 = 0 THEN 'insufficient_texture_area' ELSE 'fused_score' END AS decision FROM events")
def fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    got = geometry.fused_score(n % 15, F.when(n % 11 != 0, (n % 101) / 100))
    return table(spark, sf_dir, "events").select("event_id", F.round(got["score"], 6).alias("score"), got["decision"].alias("decision"))


@query("patch_reasons", "SELECT CASE WHEN event_id % 13 = 0 THEN 'image_read_failed' WHEN event_id % 7 / 6 < 0.55 THEN 'overlap_too_low' WHEN event_id % 5 / 4 > 0.55 THEN 'blank_ratio_too_high' WHEN event_id % 17 < 5 THEN 'patch_std_too_low' WHEN event_id % 11 / 10 < 0.35 THEN 'valid_ratio_too_low' ELSE '' END AS reason, count(*) AS n FROM events GROUP BY 1")
def patch_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    reason = geometry.patch_reason(n % 13 != 0, n % 7 / 6, n % 5 / 4, n % 17, n % 11 / 10)
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("reprojection_errors", f"WITH {XY} SELECT id, round(sqrt((CAST(0.9 AS DOUBLE) * x - CAST(0.2 AS DOUBLE) * y + 3 - u) ** 2 + (CAST(0.2 AS DOUBLE) * x + CAST(0.9 AS DOUBLE) * y - 4 - v) ** 2), 6) AS error, round(greatest(0, least(300, x + 16) - greatest(0, x - 16)) * greatest(0, least(300, y + 16) - greatest(0, y - 16)) / 1024, 6) AS overlap FROM p")
def reprojection_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = [F.lit(x) for x in (0.9, -0.2, 3.0, 0.2, 0.9, -4.0)]
    x, y, u, v = (F.col(c) for c in "xyuv")
    return _points(spark, sf_dir).select("id", F.round(geometry.reprojection_error(m, x, y, u, v), 6).alias("error"), F.round(geometry.overlap_ratio(x, y, F.lit(300), F.lit(300), 32), 6).alias("overlap"))


@query("learning_log")
def learning_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as attempts in order, against a library of 5 with two seeds; the last learned template is matched now and then."""
    rows, n = table(spark, sf_dir, "events"), F.col("event_id")
    seeds = rows.select(F.col("user_id").alias("identity")).distinct().select("identity", F.inline(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(f"s{i}").alias("template"), F.lit(f"s{i}").alias("content")) for i in range(2)])))
    attempts = rows.select(F.col("user_id").alias("identity"), n.alias("ord"), F.concat(F.lit("e"), n).alias("query"), F.sha2(F.col("value").cast("string"), 256).alias("content"), (n % 10 / 10).alias("score"), F.concat(F.lit("s"), n % 3).alias("matched"), (n % 4 != 0).alias("admissible"))
    return library.learning_log(seeds, attempts)


RULES = learning.Rules(unlock=0.32, learn=0.33, most_common=0.6, least_pixels=256, size=4)
#: The first two vectors of an owner are seeds, the others queries in order; the fold over each owner's library, step by step.
ONLINE = f"""{EMB}, t AS (SELECT id, owner, rn, v, CAST(id % 37 AS VARCHAR) AS content, 200 * v[1] AS x, 200 * v[2] AS y FROM emb),
fold AS (SELECT owner, CAST(2 AS BIGINT) AS k, list({{'id': id, 'content': content, 'x': x, 'y': y, 'v': v, 'kept': true}} ORDER BY rn) AS lib, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS score, CAST(NULL AS BIGINT) AS matched, false AS accepted, false AS learned, CAST(NULL AS BIGINT) AS replaced, '' AS reasons, 0 AS confirmations, CAST(NULL AS DOUBLE) AS common_ratio, 0 AS updates FROM t WHERE rn <= 2 GROUP BY owner
UNION ALL SELECT owner, k, CASE WHEN NOT accepted THEN lib WHEN NOT learned THEN touched ELSE list_concat([{{'id': id, 'content': content, 'x': x, 'y': y, 'v': v, 'kept': false}}], CASE WHEN replaced IS NULL THEN touched ELSE list_filter(touched, lambda z: z.id <> replaced) END) END,
id, score, matched, accepted, learned, CASE WHEN learned THEN replaced END, CASE WHEN NOT accepted THEN 'unlock_failed' WHEN learned THEN 'accepted' WHEN why <> '' THEN why ELSE 'template_library_full_and_all_templates_protected' END, CASE WHEN accepted AND sure THEN 1 ELSE 0 END, CASE WHEN accepted THEN share END, CASE WHEN learned THEN 2 WHEN accepted THEN 1 ELSE 0 END
FROM (SELECT *, accepted AND why = '' AND (len(lib) < 4 OR replaced IS NOT NULL) AS learned FROM (SELECT *, concat_ws(',', CASE WHEN twice THEN 'duplicate_template_content' END, CASE WHEN NOT sure THEN 'no_high_score_low_overlap_match' END) AS why, CASE WHEN len(lib) >= 4 THEN list_filter(touched, lambda z: NOT z.kept)[-1].id END AS replaced
FROM (SELECT *, share * 10000 AS pixels, score >= CAST(0.33 AS DOUBLE) AND share > 0 AND share * 10000 >= 256 AND share <= CAST(0.6 AS DOUBLE) AS sure, list_contains(list_transform(lib, lambda z: z.content), content) AS twice
FROM (SELECT *, m.id AS matched, score >= CAST(0.32 AS DOUBLE) AS accepted, list_concat([m], list_filter(lib, lambda z: z.id <> m.id)) AS touched, greatest(100 - abs(x - m.x), 0) * greatest(100 - abs(y - m.y), 0) / 10000 AS share
FROM (SELECT *, list_max(sims) AS score, lib[list_position(sims, list_max(sims))] AS m FROM (SELECT f.owner, e.rn AS k, f.lib, e.id, e.content, e.x, e.y, e.v, list_transform(f.lib, lambda z: round(greatest(1 - sqrt(greatest(2 - 2 * list_dot_product(z.v, e.v), 0)) / 2, 0), 12)) AS sims FROM fold f JOIN t e ON e.owner = f.owner AND e.rn = f.k + 1))))))),
log AS (SELECT * FROM fold WHERE id IS NOT NULL)"""


def _online(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each owner's first two vectors as seeds, the others as queries in the order of ids; boxes of 100 by 100 from the first components."""
    c, by = F.col, W.partitionBy("owner").orderBy("id")
    box = F.array(c("v")[0] * 200, c("v")[1] * 200, F.lit(100.0), F.lit(100.0))
    rows = vectors(spark, sf_dir).select(c("owner").alias("identity"), "id", (c("id") % 37).cast("string").alias("content"), "v", box.alias("box"), F.row_number().over(by).alias("rank"))
    return rows.where("rank <= 2"), rows.where("rank > 2").withColumn("ord", c("id"))


@query("online_log", f"WITH RECURSIVE {ONLINE} SELECT owner AS identity, id AS query, round(score, 6) AS score, matched, accepted, learned, replaced, reasons, confirmations, round(common_ratio, 6) AS common_ratio, len(lib) AS templates, CAST(sum(updates) OVER (ORDER BY id) AS BIGINT) AS update_counter FROM log")
def online_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query's genuine attempt, what its library learned from it and why not, and the count of updates so far."""
    log, _ = learning.attempts(*_online(spark, sf_dir), RULES)
    return log.select("identity", "query", F.round("score", 6).alias("score"), "matched", "accepted", "learned", "replaced", F.array_join("reasons", ",").alias("reasons"), "confirmations", F.round("common_ratio", 6).alias("common_ratio"), "templates", "update_counter")


@query("online_attempts", f"""WITH RECURSIVE {ONLINE}, lives AS (SELECT l.id, l.owner, l.v, l.born, r.id AS dead FROM (SELECT id, owner, v, -1 AS born FROM t WHERE rn <= 2 UNION ALL SELECT t.id, t.owner, t.v, t.id FROM t JOIN log ON log.id = t.id AND log.learned) l LEFT JOIN log r ON r.owner = l.owner AND r.replaced = l.id),
others AS (SELECT q.id AS query, l.owner AS identity, round(greatest(1 - sqrt(greatest(2 - 2 * list_dot_product(l.v, q.v), 0)) / 2, 0), 12) AS s, l.id FROM t q JOIN lives l ON q.rn > 2 AND l.owner <> q.owner AND l.born < q.id AND (l.dead IS NULL OR q.id <= l.dead)),
b AS (SELECT query, identity, max(s) AS s, list(id ORDER BY s DESC, id)[1] AS matched FROM others GROUP BY ALL)
SELECT id AS query, owner AS identity, true AS genuine, round(score, 6) AS score, matched, accepted FROM log UNION ALL SELECT query, identity, false, round(s, 6), matched, s >= CAST(0.32 AS DOUBLE) FROM b""")
def online_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query against its own library, then against all others as they are at that time."""
    _, every = learning.attempts(*_online(spark, sf_dir), RULES)
    return every.select("query", "identity", "genuine", F.round("score", 6).alias("score"), "matched", "accepted")


@query("online_summary", f"WITH RECURSIVE {ONLINE} SELECT (SELECT count(*) FROM t WHERE rn <= 2) AS initial_template_count, count(*) AS num_queries_processed, count(*) FILTER (accepted) AS num_unlock_accepts, count(*) FILTER (learned) AS num_templates_learned, count(replaced) AS num_templates_replaced, CAST(sum(updates) AS BIGINT) AS update_counter, 4 AS max_active_templates FROM log")
def online_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds, queries_ = _online(spark, sf_dir)
    return learning.learning_summary(seeds, learning.genuine_log(seeds, queries_, RULES), RULES)


STEPS = "e AS (SELECT user_id % 50 AS run, event_id AS step, CAST(value AS DOUBLE) AS score, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL)"


@query("early_stop", f"""WITH RECURSIVE {STEPS}, f AS (SELECT run, step, score, k, score AS reference, CAST(0 AS BIGINT) AS stale FROM e WHERE k = 1
UNION ALL SELECT e.run, e.step, e.score, e.k, CASE WHEN e.score > f.reference * CAST(1.05 AS DOUBLE) THEN e.score ELSE f.reference END, CASE WHEN e.score > f.reference * CAST(1.05 AS DOUBLE) THEN 0 ELSE f.stale + 1 END FROM f JOIN e ON e.run = f.run AND e.k = f.k + 1 WHERE f.stale < 15)
SELECT run, step, score, reference, stale, stale >= 15 AS stopped FROM f""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the scores of fifty runs; a run stops after 15 events without a gain of five per cent."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_id").alias("step"), F.col("value").alias("score"))
    return events.early_stop(rows, 0.05, 15)


ENROLLED = f"""{EMB}, n AS (SELECT *, count(*) OVER (PARTITION BY owner) AS n FROM emb), s AS (SELECT *, greatest(1, n // 5) AS step, row_number() OVER (PARTITION BY owner ORDER BY md5('7|' || id), id) AS r FROM n)"""


@query("enrolment", f"WITH {ENROLLED} SELECT id, rn <= 5 AS first, (rn - 1) % step = 0 AND (rn - 1) // step < 5 AS stride, r <= 5 AS random FROM s")
def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors each way of enrolment takes."""
    rows = vectors(spark, sf_dir)
    every = [verification.enrolled(rows, 5, k).select("id", F.col("enrolled").alias(k)) for k in ("first", "stride", "random")]
    return every[0].join(every[1], "id").join(every[2], "id")


@query("match_quality", """WITH p AS (SELECT o_orderkey AS id, CAST(o_custkey % 60 AS DOUBLE) AS a, CAST(o_orderkey % 11 AS DOUBLE) / 10 AS b, CAST(o_totalprice AS DOUBLE) / 500000 AS c, CAST(o_custkey % 90 AS DOUBLE) / 10 - 1 AS d FROM orders)
SELECT id, round(CAST(0.55 AS DOUBLE) * least(a / 40, 1) + CAST(0.2 AS DOUBLE) * b + CAST(0.15 AS DOUBLE) * c + CAST(0.1 AS DOUBLE) * least(greatest(1 - d / 5, 0), 1), 6) AS quality, round(exp(-greatest(d, 0) / 3), 6) AS closeness, round(least(greatest(CAST(0.28 AS DOUBLE) * b + CAST(0.22 AS DOUBLE) * exp(-c / CAST(0.7 AS DOUBLE)) + CAST(0.24 AS DOUBLE) * exp(-greatest(d, 0) / 5) + CAST(0.18 AS DOUBLE) * exp(-a / 30) + CAST(0.08 AS DOUBLE) * c, 0), 1), 6) AS stability FROM p""")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of matches from counts, shares and errors that orders stand for."""
    c = F.col
    p = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 60).cast("double").alias("a"), ((c("o_orderkey") % 11).cast("double") / 10).alias("b"), (c("o_totalprice").cast("double") / 500000).alias("c"), ((c("o_custkey") % 90).cast("double") / 10 - 1).alias("d"))
    return p.select("id", F.round(geometry.quality_score(c("a"), c("b"), c("c"), c("d")), 6).alias("quality"), F.round(scalars.exp_score(c("d"), 3.0), 6).alias("closeness"), F.round(scalars.stability_score(c("b"), c("c"), c("d"), c("a"), c("b"), c("c"), c("b")), 6).alias("stability"))


TEMPLATES = "t AS (SELECT CAST(label AS BIGINT) AS identity, CAST(vec_id // 3 AS VARCHAR) AS image, list_transform(embedding[1:4], lambda x: CAST(round(x * 1000) AS INT)) AS p, list_transform(embedding, lambda x: CAST(round(x * 100) AS INT)) AS d, vec_id FROM embeddings), g AS (SELECT identity, image, list(p ORDER BY vec_id) AS points, list(d ORDER BY vec_id) AS descriptors FROM t GROUP BY ALL), h AS (SELECT *, sha256('[' || array_to_string(flatten(points), ',') || ']|[' || array_to_string(flatten(descriptors), ',') || ']') AS hash FROM g)"


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive vectors of an owner as the points of an image; whole numbers, so that both sides write them alike. The products
    are floats, as in the SQL: some lie halfway between two numbers only then."""
    c = F.col
    whole = lambda of, by: F.transform(of, lambda x: F.round(x * F.lit(by).cast("float")).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select(c("label").cast("long").alias("identity"), F.floor(c("vec_id") / 3).cast("string").alias("image"), F.struct("vec_id", whole(F.slice("embedding", 1, 4), 1000).alias("p"), whole(c("embedding"), 100).alias("d")).alias("x"))
    some = rows.groupBy("identity", "image").agg(F.sort_array(F.collect_list("x")).alias("x")).select("identity", "image", c("x.p").alias("points"), c("x.d").alias("descriptors"))
    return some.withColumn("hash", templates.content_hash(F.flatten("points"), F.flatten("descriptors")))


@query("template_hashes", f"WITH {TEMPLATES} SELECT identity, image, len(points) AS points, hash FROM h")
def template_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir).select("identity", "image", F.size("points").alias("points"), "hash")


@query("templates_to_build", f"WITH {TEMPLATES} SELECT identity, image, CASE WHEN CAST(image AS BIGINT) % 5 = 0 THEN 'changed' ELSE hash END AS hash FROM h WHERE CAST(image AS BIGINT) % 5 = 0 OR CAST(image AS BIGINT) % 7 = 0")
def templates_to_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates are published as a version, with the list of their identities, and read from it; every fifth image has changed since, every seventh was never built."""
    every, image = written(_templates(spark, sf_dir), "images"), F.col("image").cast("long")
    folder = f"{shared_folder(spark)}/templates-{uuid.uuid4().hex}"
    built = templates.with_contract(every.where(image % 7 != 0), templates.Contract(dimension=64))
    versions.publish({"templates": built, "identities": templates.identity_templates(built)}, folder)
    stored = versions.published(spark, folder)["templates"]
    templates.comparable(stored, built)
    return templates.to_build(every.select("identity", "image", F.when(image % 5 == 0, "changed").otherwise(F.col("hash")).alias("hash")), stored)


@query("template_problems", f"WITH {TEMPLATES}, b AS (SELECT identity, image, CAST(image AS BIGINT) % 6 AS k, len(points) AS n FROM h) SELECT identity, image, CASE k WHEN 0 THEN 'no_keypoints' WHEN 1 THEN 'descriptor_count_differs' WHEN 2 THEN 'descriptor_width_differs' ELSE 'descriptor_holds_null' END AS problem FROM b WHERE k < 4")
def template_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates that are damaged in one of four ways by their image's number."""
    c, k = F.col, F.col("image").cast("long") % 6
    points = F.when(k == 0, F.slice("points", 1, 0)).otherwise(c("points"))
    descriptors = F.when(k == 1, F.slice("descriptors", 1, F.size("descriptors") - 1)).when(k == 2, F.transform("descriptors", lambda d: F.slice(d, 1, 63))).when(k == 3, F.transform("descriptors", lambda d: F.transform(d, lambda x, i: F.when(i != 0, x)))).otherwise(c("descriptors"))
    return templates.problems(_templates(spark, sf_dir).withColumn("points", points).withColumn("descriptors", descriptors), templates.Contract(dimension=64))


@query("library_versions", "WITH v AS (SELECT user_id, ts, max(event_id) AS version FROM events WHERE event_id % 3 <> 0 GROUP BY ALL) SELECT e.event_id, e.user_id, v.version FROM (SELECT * FROM events WHERE event_id % 3 = 0) e ASOF LEFT JOIN v ON e.user_id = v.user_id AND e.ts >= v.ts")
def library_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    versions = rows.where("event_id % 3 <> 0").select("user_id", "at", F.col("event_id").alias("version"))
    return library.as_of(rows.where("event_id % 3 = 0"), versions, "user_id", "at", 86_400e6, "version").drop("at")


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: a source is an identity, and few stems recur within it."""
    stem = F.concat("lang", F.lit("_"), (F.col("doc_id") % 300).cast("string"))
    return table(spark, sf_dir, "documents").select(F.col("source").alias("identity_id"), stem.alias("stem"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("rel"))


IMAGES = "i AS (SELECT source AS identity_id, lang || '_' || (doc_id % 300) AS stem, source || '/' || doc_id AS rel FROM documents), u AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY identity_id, stem) > 1 THEN stem || '__' || left(sha1(rel), 10) ELSE stem END AS image_id FROM i)"


@query("image_ids", f"WITH {IMAGES} SELECT identity_id, rel, image_id FROM u")
def image_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.unique_image_ids(_images(spark, sf_dir)).select("identity_id", "rel", "image_id")


@query("trial_images", f"WITH {IMAGES}, e AS (SELECT *, count(*) OVER (PARTITION BY identity_id) AS n, row_number() OVER (PARTITION BY identity_id ORDER BY image_id) AS k FROM u QUALIFY n >= 5), d AS (SELECT *, dense_rank() OVER (ORDER BY identity_id) AS r FROM e) SELECT identity_id, image_id FROM d WHERE r <= 3 AND k <= 4")
def trial_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.with_enough(images.unique_image_ids(_images(spark, sf_dir)), 5)
    return images.limited(rows.select("identity_id", "image_id"), 3, 4)


#: Attempts with a count for each stage, from the numbers of order lines; some are null.
ATTEMPTS = {
    "id": "l_orderkey * 10 + l_linenumber",
    "label": "CAST(CASE WHEN l_partkey % 3 = 0 THEN 1 ELSE 0 END AS INT)",
    "templates_with_candidates": "CASE WHEN l_partkey % 5 > 0 THEN l_suppkey % 4 END",
    "templates_with_abs_distance_pass": "l_partkey % 2",
    "templates_with_ratio_pass": "l_linenumber % 3",
    "templates_with_ransac_success": "l_suppkey % 5",
    "scale_rejected": "l_orderkey % 2",
    "templates_with_unique_inlier_ready": "l_partkey % 7",
    "templates_with_texture_evaluated": "CASE WHEN l_linenumber <> 4 THEN l_suppkey % 3 END",
    "templates_with_texture_available": "l_partkey % 4",
    "templates_with_fused_score": "l_suppkey % 2",
    "max_geometry_similarity": "CAST(l_suppkey % 100 AS DOUBLE) / 100",
    "score": "CAST(l_partkey % 100 AS DOUBLE) / 100",
    "num_candidates": "l_suppkey % 40",
    "raw_inliers": "l_partkey % 30",
    "unique_inliers": "l_partkey % 20",
    "max_unique_inliers": "l_partkey % 25",
    "max_candidate_query_coverage": "l_discount",
    "mean_reproj_error": "CASE WHEN l_linenumber < 6 THEN l_tax END",
}
ATTEMPTS_SQL = "attempts AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in ATTEMPTS.items()) + " FROM lineitem)"


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*[f"{e} AS {n}" for n, e in ATTEMPTS.items()])


_NONE = {c: f"coalesce({c}, 0)" for c in (*stages.COUNTS, "score", "max_geometry_similarity")}


@query("failure_stages", f"""WITH {ATTEMPTS_SQL}, n AS (SELECT id, {", ".join(f"{e} AS {c}" for c, e in _NONE.items())} FROM attempts WHERE label = 1 AND coalesce(score, 0) < 0.7)
SELECT id, CASE WHEN templates_with_candidates = 0 AND templates_with_abs_distance_pass = 0 THEN 'descriptor_distance_reject'
WHEN templates_with_candidates = 0 AND templates_with_ratio_pass = 0 THEN 'ratio_reject' WHEN templates_with_candidates = 0 THEN 'candidate_insufficient'
WHEN templates_with_ransac_success = 0 AND scale_rejected > 0 THEN 'ransac_scale_reject' WHEN templates_with_ransac_success = 0 THEN 'ransac_failed'
WHEN templates_with_unique_inlier_ready = 0 THEN 'unique_inlier_insufficient'
WHEN templates_with_texture_evaluated > 0 AND templates_with_texture_available = 0 THEN 'texture_unavailable'
WHEN templates_with_fused_score > 0 AND max_geometry_similarity >= 0.7 AND score < 0.7 THEN 'texture_fusion_reject'
WHEN CAST(0.7 AS DOUBLE) - score <= CAST(0.05 AS DOUBLE) THEN 'threshold_edge' ELSE 'score_below_threshold' END AS stage FROM n""")
def failure_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejected = _attempts(spark, sf_dir).where("label = 1 and coalesce(score, 0) < 0.7D")
    return rejected.select("id", stages.failure_stage(0.7, "topk_or_ratio", texture=True).alias("stage"))


@query("stage_coverage", f"""WITH {ATTEMPTS_SQL}, k AS (SELECT unnest(['genuine', 'impostor']) AS kind), g AS (SELECT CASE WHEN label = 1 THEN 'genuine' ELSE 'impostor' END AS kind, count(*) AS count, count(*) FILTER (coalesce(templates_with_candidates, 0) > 0) AS candidate_ready,
{", ".join(f"round(avg(CASE WHEN coalesce({c}, 0) > 0 THEN 1 ELSE 0 END), 6) AS {n}" for n, c in stages.RATES.items())}, {", ".join(f"round(avg(CAST(coalesce({c}, 0) AS DOUBLE)), 6) AS {n}" for n, c in stages.MEANS.items())} FROM attempts GROUP BY 1) SELECT kind, coalesce(COLUMNS(* EXCLUDE (kind)), 0) FROM k LEFT JOIN g USING (kind)""")
def stage_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = stages.stage_coverage(_attempts(spark, sf_dir))
    return got.select("kind", "count", "candidate_ready", *[F.round(c, 6).alias(c) for c in (*stages.RATES, *stages.MEANS)])
