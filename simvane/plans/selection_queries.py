"""Queries over selections, heuristics, predictions and graphs on coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.operators import expression as X
from simvane.operators import knn as N
from simvane.operators import perturb
from simvane.operators import selection as P
from simvane.plans.table_queries import _COO
from simvane.plans.tables import cells, count_cells, counts, table
from simvane.plans.vector_queries import SQL as VECTOR_SQL
from simvane.plans.vector_queries import shifted


def _r(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def matrix_kind(spark: SparkSession, sf: str) -> DataFrame:
    return P.matrix_kind(counts(spark, sf).withColumn("value", F.when(F.col("gene") % 9 == 0, F.col("value") / 7).otherwise(F.col("value"))), ["cell", "gene"]).select(_r("integer_share"), _r("p99"), "integer_like", "log_like")


def counterfactual_observed(spark: SparkSession, sf: str) -> DataFrame:
    return P.counterfactual_slice(shifted(spark, sf), "batch").select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


def effective_rank(spark: SparkSession, sf: str) -> DataFrame:
    return P.effective_rank(cells(spark, sf)).select("dim", _r("effective_rank"))


def signature_recall(spark: SparkSession, sf: str) -> DataFrame:
    c = count_cells(spark, sf).withColumn("fold", perturb.fold_of("cell"))
    signatures = X.crossfit_signatures(counts(spark, sf), c, 10)
    return P.signature_recall(counts(spark, sf), c, signatures, 10).select("fold", "label", "n", _r("recall"))


def resolution_picks(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    grid = li.groupBy(F.col("l_linenumber").alias("seed"), F.col("l_discount").cast("double").alias("resolution")).agg(F.countDistinct("l_suppkey").alias("k"), F.round(F.avg(F.col("l_quantity").cast("double")), 9).alias("score"))
    return P.pick_resolution(grid, "seed", "resolution", "k", "score", 0.05, 90).select("seed", "rule", "resolution", "k", _r("score"), "boundary")


def gaussian_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return P.gaussian_affinity(N.exact_neighbors(cells(spark, sf), 6), 1.0).select("q", "n", _r("w"))


def pixel_scaling(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", P.scaled_pixels(F.col("c_custkey"), 0.25, 10_000_000).alias("pixel"))


def json_rows(spark: SparkSession, sf: str) -> DataFrame:
    return P.flat_json(table(spark, sf, "events"), "props", ["event_id"])


def dispersion_ranks(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").count()
    return P.dispersion_ranks(counts(spark, sf), n).filter("rank <= 100").select("gene", _r("mean"), _r("normalised"), "rank")


def synthetic_balance(spark: SparkSession, sf: str) -> DataFrame:
    return P.synthetic_cells(spark, 25, 5, 4, 8, 1.5).groupBy("group", "batch").agg(F.count("*").alias("n"))


_SIG = """f AS (SELECT *, (('0x' || substr(sha256(cell::VARCHAR), 1, 2))::INT & 1)::INT AS own FROM cells), tr AS (SELECT cell, label, 1 - own AS fold FROM f),
z AS (SELECT fold, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY fold) AS total FROM tr GROUP BY 1, 2), s AS (SELECT fold, label, gene, sum(value) AS s, sum(sum(value)) OVER (PARTITION BY fold, gene) AS a FROM coo JOIN tr USING (cell) GROUP BY 1, 2, 3),
d AS (SELECT fold, label, gene, round(s / n - (a - s) / nullif(total - n, 0), 9) AS diff FROM s JOIN z USING (fold, label)),
sig AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fold, label ORDER BY diff DESC, gene) AS rank FROM d) WHERE rank <= 10)"""

SQL = {
    "matrix_kind": f"WITH {_COO}, h AS (SELECT CASE WHEN gene % 9 = 0 THEN value / 7 ELSE value END AS v FROM coo ORDER BY cell, gene LIMIT 5000), a AS (SELECT avg((v = round(v))::INT) AS s, quantile_cont(v, 0.99) AS p FROM h) SELECT round(s, 6) AS integer_share, round(p, 6) AS p99, s >= 0.95 AS integer_like, s < 0.5 AND p < 50 AS log_like FROM a",
    "counterfactual_observed": f"SELECT id, v FROM ({VECTOR_SQL['batch_simplex_shift']}) WHERE hyp_batch = id % 4",
    "signature_recall": f"""WITH {_COO}, {_SIG}, sm AS (SELECT f.cell, sig.fold, sig.label AS cls, sum(value) / 10 AS score FROM coo JOIN f USING (cell) JOIN sig ON sig.gene = coo.gene AND sig.fold = f.own GROUP BY 1, 2, 3),
g AS (SELECT f.cell, f.label AS truth, k.fold, k.cls, coalesce(score, 0) AS score FROM f JOIN (SELECT DISTINCT fold, label AS cls FROM sig) k ON k.fold = f.own LEFT JOIN sm ON sm.cell = f.cell AND sm.fold = k.fold AND sm.cls = k.cls),
y AS (SELECT *, round(CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END, 9) AS zz FROM g WINDOW w AS (PARTITION BY fold, cls)),
b AS (SELECT fold, cell, truth, cls FROM (SELECT *, row_number() OVER (PARTITION BY fold, cell ORDER BY zz DESC, cls) AS k FROM y) WHERE k = 1)
SELECT fold, truth AS label, count(*) AS n, round(avg((cls = truth)::INT), 6) AS recall FROM b GROUP BY 1, 2""",
    "resolution_picks": """WITH g AS (SELECT l_linenumber AS seed, l_discount::DOUBLE AS resolution, count(DISTINCT l_suppkey) AS k, round(avg(l_quantity::DOUBLE), 9) AS score FROM lineitem GROUP BY 1, 2),
m AS (SELECT *, resolution = min(resolution) OVER (PARTITION BY seed) OR resolution = max(resolution) OVER (PARTITION BY seed) AS boundary, row_number() OVER (PARTITION BY seed ORDER BY abs(k - 90), resolution) AS r1, row_number() OVER (PARTITION BY seed ORDER BY score DESC, resolution) AS r2 FROM g)
SELECT seed, 'fixed' AS rule, resolution, k, round(score, 6) AS score, boundary FROM m WHERE resolution = 0.05 UNION ALL SELECT seed, 'matched', resolution, k, round(score, 6), boundary FROM m WHERE r1 = 1 UNION ALL SELECT seed, 'best', resolution, k, round(score, 6), boundary FROM m WHERE r2 = 1""",
    "gaussian_affinity": "WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT * FROM (SELECT a.id AS q, b.id AS n, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 6) SELECT q, n, round(exp(-d * d / 2), 6) AS w FROM n",
    "pixel_scaling": "SELECT c_custkey, round_even(c_custkey * 0.25::DOUBLE, 0)::BIGINT AS pixel FROM customer",
    "json_rows": "SELECT event_id, key AS field, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)",
    "dispersion_ranks": f"""WITH {_COO}, n AS (SELECT count(*)::DOUBLE AS n FROM orders), b AS (SELECT gene, sum(value) / max(n) AS m, greatest(sum(value * value) - max(n) * (sum(value) / max(n)) * (sum(value) / max(n)), 0) / (max(n) - 1) AS v FROM coo, n GROUP BY 1),
g AS (SELECT gene, ln(1 + m) AS mean, round(ln(nullif(v / m, 0)), 9) AS disp FROM b), l AS (SELECT *, least(19, floor(round((mean - min(mean) OVER ()) / (max(mean) OVER () - min(mean) OVER ()) * 20, 9))) AS bin FROM g WHERE disp IS NOT NULL),
z AS (SELECT gene, mean, round(CASE WHEN stddev_samp(disp) OVER (PARTITION BY bin) IS NULL THEN 1 ELSE (disp - avg(disp) OVER (PARTITION BY bin)) / nullif(stddev_samp(disp) OVER (PARTITION BY bin), 0) END, 9) AS norm FROM l),
r AS (SELECT *, row_number() OVER (ORDER BY norm DESC NULLS LAST, gene) AS rank FROM z) SELECT gene, round(mean, 6) AS mean, round(norm, 6) AS normalised, rank::INT AS rank FROM r WHERE rank <= 100""",
    "synthetic_balance": 'SELECT g AS "group", b AS batch, 25::BIGINT AS n FROM (SELECT unnest(range(5)) AS g), (SELECT unnest(range(4)) AS b)',
}

QUERIES = {f.__name__: f for f in (matrix_kind, counterfactual_observed, effective_rank, signature_recall, resolution_picks, gaussian_affinity, pixel_scaling, json_rows, dispersion_ranks, synthetic_balance)}
