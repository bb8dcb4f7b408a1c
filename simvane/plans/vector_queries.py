"""Queries over vectors: neighbours, neighbourhood metrics, labelings, geometry, perturbations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.functions import scalars as S
from simvane.operators import contingency, integrity, perturb
from simvane.operators import expression as X
from simvane.operators import knn as N
from simvane.operators import neighborhood as M
from simvane.plans.tables import cells, halves

E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 4 AS batch, label, list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS cluster FROM embeddings)"


def _knn_sql(k: int, name: str = "nn", v: str = "v", extra: str = "", distance: str = "list_distance(a.{v}, b.{v})", part: str = "") -> str:
    d = distance.format(v=v)
    by = f"a.id{', ' + part if part else ''}"
    return f"{name} AS (SELECT * FROM (SELECT a.id AS q, b.id AS n, {d} AS d, row_number() OVER (PARTITION BY {by} ORDER BY {d}, b.id) AS rank{', ' + part + ' AS part' if part else ''} FROM e a JOIN e b ON a.id <> b.id {extra}) WHERE rank <= {k})"


def _r(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def exact_knn(spark: SparkSession, sf: str) -> DataFrame:
    return N.exact_neighbors(cells(spark, sf), 15).select("q", "n", "rank", _r("d"))


def knn_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return N.exact_neighbors(cells(spark, sf), 15, metric="cosine").select("q", "n", "rank", _r("d"))


def knn_batch_balanced(spark: SparkSession, sf: str) -> DataFrame:
    out = N.exact_neighbors(cells(spark, sf), 3, within="batch")
    return out.select("q", "n", "rank", _r("d"), F.col("part").cast("long").alias("part"))


def mutual_nn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return N.mutual_neighbors(c.filter("batch = 0"), c.filter("batch = 1"), 10)


def neighbor_purity_by_label(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    by = M.purity(N.exact_neighbors(c, 30), c).groupBy(F.col("q_label").alias("label"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg("purity"), 6).alias("purity"))


def neighbor_jaccard_paired(spark: SparkSession, sf: str) -> DataFrame:
    return M.overlap(N.exact_neighbors(cells(spark, sf), 30), N.exact_neighbors(halves(spark, sf), 30)).select("q", _r("jaccard"))


def purity_delta_rollup(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    before, after = N.exact_neighbors(c, 30), N.exact_neighbors(halves(spark, sf), 30)
    a = M.purity(before, c).select("q", F.col("q_label").cast("string").alias("label"), F.col("purity").alias("before"))
    rows = a.join(M.purity(after, c).select("q", F.col("purity").alias("after")), "q").join(M.overlap(before, after), "q")
    out = rows.rollup("label").agg(F.grouping("label").alias("g"), F.avg("before").alias("before"), F.avg("after").alias("after"), F.avg(F.col("after") - F.col("before")).alias("delta"), F.avg("jaccard").alias("stability"))
    return out.select(F.when(F.col("g") == 1, "__ALL__").otherwise(F.col("label")).alias("label"), *(_r(x) for x in ("before", "after", "delta", "stability")))


def d_batch(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return M.inverse_simpson(N.exact_neighbors(c, 89), c).select("q", _r("d_batch"))


def ilisi(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    per = M.ilisi(N.exact_neighbors(c, 90), c, 30.0)
    return M.scaled_median(per, c.select("batch").distinct().count()).select(_r("score"), "status")


def median_kth_radius(spark: SparkSession, sf: str) -> DataFrame:
    return M.median_radius(N.exact_neighbors(cells(spark, sf), 15), 15).select(_r("median_radius"))


def target_fraction_at_k(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    near = N.exact_neighbors(c, 30, queries=c.filter("label = 0"))
    return M.purity(near, c).agg(F.count("*").alias("n"), F.round(F.avg("purity"), 6).alias("fraction"))


def rare_recall_at_k(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    out = M.rare_recall(N.exact_neighbors(c, 30), c, 30, 0.1)
    return out.select("label", "n", *(_r(x) for x in ("purity", "purity_ceiling", "recall", "recall_ceiling")))


def silhouette_samples(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return M.silhouette(N.label_sums(c), c).select("q", "label", _r("s"))


def silhouette_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return M.silhouette_summary(M.silhouette(N.label_sums(c), c)).select(_r("mean_s"), _r("median_s"), _r("negative_share"), "n")


def isolated_label_asw(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf).filter("label <> 0 or batch = 0")
    return M.isolated_asw(M.silhouette(N.label_sums(c), c), c, 1).select(_r("isolated_asw"), "n_labels")


def class_compactness(spark: SparkSession, sf: str) -> DataFrame:
    """Mean distance within each label over ordered pairs, and the mean of those means."""
    c = cells(spark, sf)
    own = N.label_sums(c).join(c.select(F.col("id").alias("q"), F.col("label").cast("string").alias("own")), "q").filter("label = own")
    by = own.groupBy("label").agg(F.sum("n").alias("n_pairs"), (F.sum("total") / F.sum("n")).alias("mean_d"))
    total = by.agg(F.lit("__ALL__").alias("label"), F.sum("n_pairs").alias("n_pairs"), F.avg("mean_d").alias("mean_d"))
    return by.unionByName(total).select("label", "n_pairs", _r("mean_d"))


def centroid_geometry(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.centroid_geometry(cells(spark, sf), halves(spark, sf), "label").select("n_pairs", _r("pearson"), _r("spearman"))


def centroid_separation(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.separation(cells(spark, sf), "label").select("cluster", "n", _r("radius"), _r("nearest"), _r("ratio"))


def confusion(spark: SparkSession, sf: str) -> DataFrame:
    return contingency.contingency(cells(spark, sf), "label", "cluster").select("label", "cluster", "n", _r("label_share"), _r("cluster_share"))


def ari_ri_nmi(spark: SparkSession, sf: str) -> DataFrame:
    return contingency.agreement(cells(spark, sf), "label", "cluster").select("n", _r("ari"), _r("ri"), _r("nmi"))


def cluster_purity_entropy(spark: SparkSession, sf: str) -> DataFrame:
    return contingency.cluster_purity_entropy(cells(spark, sf), "label", "cluster").select("cluster", "n", _r("purity"), "dominant", _r("entropy"))


def embedding_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.vector_diagnostics(cells(spark, sf)).select("dim", "n", _r("least"), _r("largest"), "constant")


def leading_projection(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return c.select("id", F.transform(S.leading("v", 4), lambda x: F.round(x, 6)).alias("head"), F.transform(S.pick("v", [63, 0, 7]), lambda x: F.round(x, 6)).alias("picked"))


def label_encoding(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.label_codes(cells(spark, sf), "cluster")


def imbalance_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.downsample_batch(cells(spark, sf).select("id", "batch", "label"), "batch", 0, 0.1, 7)


def nonoverlap_drop(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.drop_combination(cells(spark, sf).select("id", "batch", "label"), "batch", 1, "label", 2)


def stratified_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.stratified_sample(cells(spark, sf).select("id", "batch", "label"), "label", 100, 11)


def heldout_split(spark: SparkSession, sf: str) -> DataFrame:
    held = cells(spark, sf).select("batch", perturb.is_heldout("id", 3).alias("heldout"), perturb.fold_of("id").alias("fold"))
    return held.groupBy("batch", "heldout", "fold").agg(F.count("*").alias("n"))


def shifted(spark: SparkSession, sf: str) -> DataFrame:
    """The cells under every batch, moved by the median distance to the 15th neighbour."""
    c = cells(spark, sf)
    radius = M.median_radius(N.exact_neighbors(c, 15), 15).first()[0]
    return perturb.batch_shift(c, "batch", radius, 1.0)


def batch_simplex_shift(spark: SparkSession, sf: str) -> DataFrame:
    return shifted(spark, sf).select("id", "hyp_batch", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


def local_warp(spark: SparkSession, sf: str) -> DataFrame:
    moved = perturb.local_warp(cells(spark, sf), "label", 0, "batch", F.col("v")[0], [0.0, 1.0] + [0.0] * 62, 2.0, 0.1)
    return moved.select("id", F.transform("v", lambda x: S.rounded(x)).alias("v"))


def counterfactual_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.sensitivity(shifted(spark, sf), cells(spark, sf)).select(_r("numerator"), _r("denominator"), _r("ratio"))


def neighbor_marker_endpoint(spark: SparkSession, sf: str) -> DataFrame:
    """Each label's marker score, averaged over 30 neighbours, as a ranking of the cells of that label, and the mean over labels of 45 cells or more. Components stand for genes: label c has the eight from 8 c on."""
    c = cells(spark, sf)
    coo = c.select(F.col("id").alias("cell"), F.posexplode("v").alias("gene", "value")).withColumn("value", F.greatest("value", F.lit(0.0)))
    panel = spark.range(64).select(F.floor(F.col("id") / 8).cast("string").alias("cls"), F.col("id").cast("int").alias("gene"))
    scores = X.neighbor_scores(X.marker_scores(coo, c.select(F.col("id").alias("cell")), panel), N.exact_neighbors(c, 30))
    rows = scores.join(c.select(F.col("id").alias("cell"), F.col("label").cast("string").alias("label")), "cell").select("cls", F.round("score", 9).alias("score"), (F.col("label") == F.col("cls")).alias("positive"))
    metrics = ["auroc", "ap", "ap_lift", "contrast"]
    by_class = X.auroc_ap(rows, by=["cls"]).filter("n_pos > 0")
    macro = X.macro_endpoint(by_class, metrics, 45)
    return by_class.select("cls", "n_pos", *(_r(m) for m in metrics)).unionByName(macro.select(F.lit("__MACRO__").alias("cls"), F.col("n_classes").alias("n_pos"), *(_r(m) for m in metrics)))


def train_only_batch_centering(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.train_only_centering(cells(spark, sf), perturb.is_heldout("id", 3), "batch").select("id", "dim", _r("value"))


def student_t_target(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return perturb.soft_assignment(c, perturb.centroids(c, "label")).select("id", "cluster", _r("q"), _r("p"))


_SHIFT = f"""{_knn_sql(15, "nr")}, r AS (SELECT quantile_cont(d, 0.5) AS r FROM nr WHERE rank = 15),
flat AS (SELECT b, f, CASE WHEN b <= f THEN 1.0 WHEN b = f + 1 THEN -(f + 1.0) ELSE 0 END / sqrt((f + 1.0) * (f + 2.0)) * sqrt(4 / 3.0) AS x FROM (SELECT unnest([0, 1, 2, 3]) AS b), (SELECT unnest([0, 1, 2]) AS f)),
turned AS (SELECT b, p, sum(x * sqrt(CASE WHEN f = 0 THEN 1 ELSE 2 END / 64.0) * cos(pi() * (p + 0.5) * f / 64)) AS x FROM flat, (SELECT unnest(range(64)) AS p) GROUP BY 1, 2),
mean AS (SELECT p, sum(x * n) / sum(n) AS m FROM turned JOIN (SELECT batch, count(*) AS n FROM e GROUP BY 1) ON batch = b GROUP BY 1),
moves AS (SELECT b::BIGINT AS b, list(r * (x - m) ORDER BY p) AS move FROM turned JOIN mean USING (p), r GROUP BY 1)"""
_HASH = "sha256(id::VARCHAR || '|{seed}')"
_SIL = """o AS (SELECT a.id AS q, a.label AS own, b.label AS other, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.id <> b.id GROUP BY 1, 2, 3),
ab AS (SELECT q, own, max(m) FILTER (own = other) AS a, min(m) FILTER (own <> other) AS b FROM o GROUP BY 1, 2),
sil AS (SELECT q, own::VARCHAR AS label, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""
_PUR = "pur AS (SELECT q, qe.label, avg((qe.label = ne.label)::INT) AS purity FROM nn JOIN e qe ON qe.id = q JOIN e ne ON ne.id = n GROUP BY 1, 2)"
_HALF = "h AS (SELECT id, v[1:32] AS v, label FROM e)"
_NN2 = "n2 AS (SELECT * FROM (SELECT a.id AS q, b.id AS n, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM h a JOIN h b ON a.id <> b.id) WHERE rank <= 30)"
_JAC = "jac AS (SELECT q, count(*) / (60.0 - count(*)) AS jaccard FROM nn JOIN n2 USING (q, n) GROUP BY 1)"
_LONG = "x AS (SELECT id, batch, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e)"
_CENT = "cen AS (SELECT label AS cluster, list(x ORDER BY dim) AS c FROM (SELECT label, dim, avg(x) AS x FROM x GROUP BY 1, 2) GROUP BY 1)"
_HELD = f"('0x' || substr({_HASH.format(seed=3)}, 1, 16))::UBIGINT % 5 = 0"

SQL = {
    "exact_knn": f"WITH {E}, {_knn_sql(15)} SELECT q, n, rank, round(d, 6) AS d FROM nn",
    "knn_cosine": f"WITH {E}, {_knn_sql(15, distance='1 - list_cosine_similarity(a.{v}, b.{v})')} SELECT q, n, rank, round(d, 6) AS d FROM nn",
    "knn_batch_balanced": f"WITH {E}, {_knn_sql(3, part='b.batch')} SELECT q, n, rank, round(d, 6) AS d, part FROM nn",
    "mutual_nn_pairs": f"WITH {E}, {_knn_sql(10, 'ab', extra='WHERE a.batch = 0 AND b.batch = 1')}, {_knn_sql(10, 'ba', extra='WHERE a.batch = 1 AND b.batch = 0')} SELECT ab.q AS a_id, ab.n AS b_id FROM ab JOIN ba ON ab.q = ba.n AND ab.n = ba.q",
    "neighbor_purity_by_label": f"WITH {E}, {_knn_sql(30)}, {_PUR} SELECT label, count(*) AS n, round(avg(purity), 6) AS purity FROM pur GROUP BY 1",
    "neighbor_jaccard_paired": f"WITH {E}, {_HALF}, {_knn_sql(30)}, {_NN2}, {_JAC} SELECT e.id AS q, round(coalesce(jaccard, 0), 6) AS jaccard FROM e LEFT JOIN jac ON q = id",
    "purity_delta_rollup": f"""WITH {E}, {_HALF}, {_knn_sql(30)}, {_NN2}, {_JAC}, {_PUR},
p2 AS (SELECT q, avg((qe.label = ne.label)::INT) AS after FROM n2 JOIN e qe ON qe.id = q JOIN e ne ON ne.id = n GROUP BY 1),
r AS (SELECT label, purity AS before, after, coalesce(jaccard, 0) AS jaccard FROM pur JOIN p2 USING (q) LEFT JOIN jac USING (q))
SELECT coalesce(label::VARCHAR, '__ALL__') AS label, round(avg(before), 6) AS before, round(avg(after), 6) AS after, round(avg(after - before), 6) AS delta, round(avg(jaccard), 6) AS stability FROM r GROUP BY ROLLUP (r.label)""",
    "d_batch": f"WITH {E}, {_knn_sql(89)}, m AS (SELECT q, batch FROM nn JOIN e ON id = n UNION ALL SELECT id, batch FROM e), c AS (SELECT q, batch, count(*) AS c FROM m GROUP BY 1, 2) SELECT q, round(sum(c) * sum(c) / sum(c * c), 6) AS d_batch FROM c GROUP BY 1",
    "ilisi": f"""WITH RECURSIVE {E}, {_knn_sql(90)}, rows AS (SELECT q, list(d - near ORDER BY rank) AS gap FROM (SELECT *, min(d) OVER (PARTITION BY q) AS near FROM nn) GROUP BY 1),
steps AS (SELECT q, gap, 0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1::DOUBLE AS beta, false AS done, 0 AS step FROM rows
UNION ALL SELECT q, gap, CASE WHEN NOT fine AND h > ln(30) THEN beta ELSE lo END, CASE WHEN NOT fine AND h <= ln(30) THEN beta ELSE hi END,
CASE WHEN fine THEN beta WHEN h > ln(30) THEN CASE WHEN hi = 'infinity' THEN beta * 2 ELSE (beta + hi) / 2 END ELSE (beta + lo) / 2 END, fine, step + 1
FROM (SELECT *, done OR abs(h - ln(30)) < 1e-5 AS fine FROM (SELECT *, ln(total) + beta * list_sum(list_transform(gap, lambda g: g * exp(-beta * g))) / total AS h FROM (SELECT *, list_sum(list_transform(gap, lambda g: exp(-beta * g))) AS total FROM steps WHERE step < 60)))),
w AS (SELECT q, beta FROM steps WHERE step = 60), p AS (SELECT nn.q, b.batch, sum(exp(-beta * (d - near))) AS x FROM (SELECT *, min(d) OVER (PARTITION BY q) AS near FROM nn) nn JOIN w USING (q) JOIN e b ON b.id = n GROUP BY 1, 2),
l AS (SELECT q, sum(x) * sum(x) / sum(x * x) AS lisi FROM p GROUP BY 1)
SELECT round((quantile_cont(lisi, 0.5) - 1) / ((SELECT count(DISTINCT batch) FROM e) - 1), 6) AS score, 'ok' AS status FROM l""",
    "median_kth_radius": f"WITH {E}, {_knn_sql(15)} SELECT round(quantile_cont(d, 0.5), 6) AS median_radius FROM nn WHERE rank = 15",
    "target_fraction_at_k": f"WITH {E}, {_knn_sql(30)}, {_PUR} SELECT count(*) AS n, round(avg(purity), 6) AS fraction FROM pur WHERE label = 0",
    "rare_recall_at_k": f"""WITH {E}, {_knn_sql(30)}, s AS (SELECT label, count(*) AS n FROM e GROUP BY 1 HAVING count(*) <= 0.1 * (SELECT count(*) FROM e)),
h AS (SELECT qe.label, q, sum((qe.label = ne.label)::INT) AS same FROM nn JOIN e qe ON qe.id = q JOIN e ne ON ne.id = n GROUP BY 1, 2),
b AS (SELECT label, avg(same / 30) AS purity, avg(same) AS same FROM h GROUP BY 1)
SELECT label, n, round(purity, 6) AS purity, round(least(30, n - 1) / 30, 6) AS purity_ceiling, round(same / nullif(n - 1, 0), 6) AS recall, round(least(30, n - 1) / nullif(n - 1, 0), 6) AS recall_ceiling FROM s JOIN b USING (label)""",
    "silhouette_samples": f"WITH {E}, {_SIL} SELECT q, label, round(s, 6) AS s FROM sil",
    "silhouette_summary": f"WITH {E}, {_SIL} SELECT round(avg(s), 6) AS mean_s, round(quantile_cont(s, 0.5), 6) AS median_s, round(avg((s < 0)::INT), 6) AS negative_share, count(s) AS n FROM sil",
    "isolated_label_asw": f"WITH e0 AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, vec_id % 4 AS batch, label FROM embeddings), e AS (SELECT * FROM e0 WHERE label <> 0 OR batch = 0), {_SIL}, b AS (SELECT sil.label, count(DISTINCT batch) AS nb, avg((s + 1) / 2) AS w FROM sil JOIN e ON id = q GROUP BY 1) SELECT round(avg(w), 6) AS isolated_asw, count(*) AS n_labels FROM b WHERE nb <= 1",
    "class_compactness": f"WITH {E}, b AS (SELECT a.label::VARCHAR AS label, count(*) AS n_pairs, avg(list_distance(a.v, b.v)) AS m FROM e a JOIN e b ON a.id <> b.id AND a.label = b.label GROUP BY 1) SELECT label, n_pairs::BIGINT AS n_pairs, round(m, 6) AS mean_d FROM b UNION ALL SELECT '__ALL__', sum(n_pairs)::BIGINT, round(avg(m), 6) FROM b",
    "centroid_geometry": f"""WITH {E}, {_LONG}, {_CENT}, y AS (SELECT cluster, c, c[1:32] AS c32 FROM cen),
p AS (SELECT list_distance(a.c, b.c) AS da, list_distance(a.c32, b.c32) AS db FROM y a JOIN y b ON a.cluster < b.cluster),
r AS (SELECT *, rank() OVER (ORDER BY round(da, 9)) + (count(*) OVER (PARTITION BY round(da, 9)) - 1) / 2 AS ra, rank() OVER (ORDER BY round(db, 9)) + (count(*) OVER (PARTITION BY round(db, 9)) - 1) / 2 AS rb FROM p)
SELECT count(*) AS n_pairs, round(corr(da, db), 6) AS pearson, round(corr(ra, rb), 6) AS spearman FROM r""",
    "centroid_separation": f"""WITH {E}, {_LONG}, {_CENT}, r AS (SELECT cluster, count(*) AS n, sqrt(avg(list_distance(v, c) * list_distance(v, c))) AS radius FROM e JOIN cen ON cluster = e.label GROUP BY ALL),
d AS (SELECT a.cluster, min(list_distance(a.c, b.c)) AS nearest FROM cen a JOIN cen b ON a.cluster <> b.cluster GROUP BY 1)
SELECT r.cluster, n, round(radius, 6) AS radius, round(nearest, 6) AS nearest, round(nearest / radius, 6) AS ratio FROM r LEFT JOIN d USING (cluster)""".replace("FROM e JOIN cen ON cluster = e.label", "FROM (SELECT id, v, label FROM e) e JOIN cen ON cen.cluster = e.label"),
    "confusion": f"WITH {E}, c AS (SELECT label, cluster::INT AS cluster, count(*) AS n FROM e GROUP BY 1, 2) SELECT label, cluster, n, round(n / sum(n) OVER (PARTITION BY label), 6) AS label_share, round(n / sum(n) OVER (PARTITION BY cluster), 6) AS cluster_share FROM c",
    "ari_ri_nmi": f"""WITH {E}, c AS (SELECT label AS a, cluster AS b, count(*)::DOUBLE AS n FROM e GROUP BY 1, 2),
r AS (SELECT sum(n) AS n FROM c GROUP BY a), k AS (SELECT sum(n) AS n FROM c GROUP BY b),
s AS (SELECT (SELECT sum(n) FROM c) AS t, (SELECT sum(n * (n - 1) / 2) FROM c) AS pij, (SELECT sum(n * (n - 1) / 2) FROM r) AS pi, (SELECT sum(n * (n - 1) / 2) FROM k) AS pj, (SELECT sum(n * ln(n)) FROM c) AS eij, (SELECT sum(n * ln(n)) FROM r) AS ei, (SELECT sum(n * ln(n)) FROM k) AS ej),
u AS (SELECT *, t * (t - 1) / 2 AS al, pi * pj / (t * (t - 1) / 2) AS ex FROM s)
SELECT t::BIGINT AS n, round((pij - ex) / ((pi + pj) / 2 - ex), 6) AS ari, round((al + 2 * pij - pi - pj) / al, 6) AS ri, round((ln(t) + (eij - ei - ej) / t) / ((2 * ln(t) - (ei + ej) / t) / 2), 6) AS nmi FROM u""",
    "cluster_purity_entropy": f"""WITH {E}, c AS (SELECT cluster::VARCHAR AS cluster, label::VARCHAR AS label, count(*) AS n FROM e GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER (PARTITION BY cluster) AS size FROM c),
b AS (SELECT cluster, size::BIGINT AS n, max(n / size) AS purity, (list(label ORDER BY n DESC, label))[1] AS dominant, sum(-(n / size) * log2(n / size)) + ((SELECT count(DISTINCT label) FROM e) - count(*)) * (-1e-12 * log2(1e-12)) AS entropy FROM p GROUP BY cluster, size)
SELECT cluster, n, round(purity, 6) AS purity, dominant, round(entropy, 6) AS entropy FROM b UNION ALL SELECT '__ALL__', sum(n)::BIGINT, round(sum(purity * n) / sum(n), 6), NULL, round(sum(entropy * n) / sum(n), 6) FROM b""",
    "embedding_diagnostics": f"WITH {E}, {_LONG} SELECT dim::INT AS dim, count(*) AS n, round(min(x), 6) AS least, round(max(x), 6) AS largest, min(x) = max(x) AS constant FROM x GROUP BY 1",
    "leading_projection": f"WITH {E} SELECT id, list_transform(v[1:4], lambda z: round(z, 6)) AS head, list_transform([v[64], v[1], v[8]], lambda z: round(z, 6)) AS picked FROM e",
    "label_encoding": f"WITH {E}, d AS (SELECT DISTINCT cluster::INT AS cluster FROM e) SELECT cluster, (row_number() OVER (ORDER BY cluster) - 1)::INT AS code FROM d",
    "imbalance_downsample": f"WITH {E}, r AS (SELECT id, batch, label, row_number() OVER (PARTITION BY batch ORDER BY {_HASH.format(seed=7)}, id) AS k, count(*) OVER (PARTITION BY batch) AS n FROM e) SELECT id, batch, label FROM r WHERE batch <> 0 OR k <= greatest(2, floor(n * 0.1))",
    "nonoverlap_drop": f"WITH {E} SELECT id, batch, label FROM e WHERE NOT (batch = 1 AND label = 2)",
    "stratified_subsample": f"""WITH {E}, s AS (SELECT label, count(*) AS n FROM e GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total FROM s),
b AS (SELECT *, least(n, greatest(1, floor(n * 100 / total))) AS base, round(n * 100 / total - floor(n * 100 / total), 9) AS rest FROM t),
k AS (SELECT *, 100 - sum(base) OVER () AS todo, row_number() OVER (ORDER BY rest DESC, label) AS place FROM b),
m AS (SELECT label, least(n, base + CASE WHEN place <= todo THEN 1 ELSE 0 END) AS take FROM k),
r AS (SELECT id, batch, label, row_number() OVER (PARTITION BY label ORDER BY {_HASH.format(seed=11)}, id) AS nth FROM e)
SELECT id, batch, r.label FROM r JOIN m ON r.label = m.label WHERE nth <= take""",
    "heldout_split": f"WITH {E} SELECT batch, {_HELD} AS heldout, (('0x' || substr(sha256(id::VARCHAR), 1, 2))::INT & 1)::INT AS fold, count(*) AS n FROM e GROUP BY ALL",
    "local_warp": f"WITH {E}, t AS (SELECT *, CASE WHEN label = 0 THEN tanh(v[1] / 0.1) END AS c FROM e), d AS (SELECT *, c - avg(c) OVER (PARTITION BY batch) AS cc FROM t) SELECT id, list_concat([round(v[1], 6), round(v[2] + 2.0 * 0.1 * coalesce(cc, 0), 6)], list_transform(v[3:], lambda z: round(z, 6))) AS v FROM d",
    "batch_simplex_shift": f"WITH {E}, {_SHIFT} SELECT id, b AS hyp_batch, list_transform(range(1, 65), lambda j: round(v[j] + move[j], 6)) AS v FROM e, moves",
    "counterfactual_sensitivity": f"""WITH {E}, {_LONG}, {_SHIFT}, g AS (SELECT sum(s) AS numerator FROM (SELECT p, var_pop(r * x) AS s FROM turned, r GROUP BY 1)),
k AS (SELECT sum(s) AS denominator FROM (SELECT var_pop(x) AS s FROM x GROUP BY dim))
SELECT round(numerator, 6) AS numerator, round(denominator, 6) AS denominator, round(numerator / denominator, 6) AS ratio FROM g, k""",
    "neighbor_marker_endpoint": f"""WITH {E}, {_knn_sql(30)}, {_LONG}, c AS (SELECT id, dim, greatest(x, 0) AS x FROM x), z AS (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM c GROUP BY 1),
raw AS (SELECT id, (c.dim // 8)::VARCHAR AS cls, sum(CASE WHEN s > 1e-12 THEN (x - m) / s ELSE 0 END) / 8 AS score FROM c JOIN z USING (dim) GROUP BY 1, 2),
sc AS (SELECT q AS id, cls, avg(score) AS score FROM nn JOIN raw ON raw.id = n GROUP BY 1, 2),
r AS (SELECT cls, round(score, 9) AS s, label::VARCHAR = cls AS pos FROM sc JOIN e USING (id)), l AS (SELECT cls, s, count(*) FILTER (pos) AS p, count(*) AS n FROM r GROUP BY 1, 2),
t AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cls ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS rank, sum(p) OVER d / sum(n) OVER d AS prec FROM l WINDOW d AS (PARTITION BY cls ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
b AS (SELECT cls, sum(p)::BIGINT AS n_pos, (sum(p * rank) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)) AS auroc, sum(p * prec) / sum(p) AS ap, sum(p * prec) / sum(p) * sum(n) / sum(p) AS ap_lift, sum(p * s) / sum(p) - sum((n - p) * s) / sum(n - p) AS contrast FROM t GROUP BY 1 HAVING sum(p) > 0)
SELECT cls, n_pos, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(ap_lift, 6) AS ap_lift, round(contrast, 6) AS contrast FROM b
UNION ALL SELECT '__MACRO__', count(*), round(avg(auroc), 6), round(avg(ap), 6), round(avg(ap_lift), 6), round(avg(contrast), 6) FROM b WHERE n_pos >= 45""",
    "train_only_batch_centering": f"WITH {E}, {_LONG}, y AS (SELECT *, {_HELD} AS held FROM x), b AS (SELECT batch, dim, avg(x) AS bm FROM y WHERE NOT held GROUP BY 1, 2), g AS (SELECT dim, avg(x) AS gm FROM y WHERE NOT held GROUP BY 1) SELECT id, y.dim::INT AS dim, round(x + gm - bm, 6) AS value FROM y JOIN b ON y.batch = b.batch AND y.dim = b.dim JOIN g ON y.dim = g.dim",
    "student_t_target": f"""WITH {E}, {_LONG}, {_CENT}, w AS (SELECT id, cen.cluster, 1 / (1 + list_distance(v, c) * list_distance(v, c)) AS w FROM e, cen),
q AS (SELECT id, cluster, w / sum(w) OVER (PARTITION BY id) AS q FROM w), f AS (SELECT *, q * q / sum(q) OVER (PARTITION BY cluster) AS z FROM q)
SELECT id, cluster, round(q, 6) AS q, round(z / sum(z) OVER (PARTITION BY id), 6) AS p FROM f""",
}

QUERIES = {f.__name__: f for f in (exact_knn, knn_cosine, knn_batch_balanced, mutual_nn_pairs, neighbor_purity_by_label, neighbor_jaccard_paired, purity_delta_rollup, d_batch, ilisi, median_kth_radius, target_fraction_at_k, rare_recall_at_k, silhouette_samples, silhouette_summary, isolated_label_asw, class_compactness, centroid_geometry, centroid_separation, confusion, ari_ri_nmi, cluster_purity_entropy, embedding_diagnostics, leading_projection, label_encoding, imbalance_downsample, nonoverlap_drop, stratified_subsample, heldout_split, batch_simplex_shift, local_warp, counterfactual_sensitivity, neighbor_marker_endpoint, train_only_batch_centering, student_t_target)}
