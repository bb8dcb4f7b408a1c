"""Queries over fitted models, graphs, times and selections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.functions import scalars as S
from simvane.operators import integrity, models, panels, perturb
from simvane.operators import knn as N
from simvane.plans.tables import cells, table
from simvane.streaming import ingest


def _r(c: str, name: str | None = None):
    return F.round(F.col(c), 6).alias(name or c)


def pca32(spark: SparkSession, sf: str) -> DataFrame:
    return models.principal_components(cells(spark, sf), 32).select("id", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return models.kmeans(cells(spark, sf), 8).groupBy("cluster").agg(F.count("*").alias("n"))


def fuzzy_affinity(spark: SparkSession, sf: str) -> DataFrame:
    return models.fuzzy_affinity(N.exact_neighbors(cells(spark, sf), 15)).select("a", "b", _r("w"))


def propagated_labels(spark: SparkSession, sf: str) -> DataFrame:
    from simvane.sources.sinks import checkpoint_folder

    checkpoint_folder(spark)
    return models.label_propagation(models.fuzzy_affinity(N.exact_neighbors(cells(spark, sf), 15)), 4)


def modularity_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of the affinity graph over a grid of resolutions and seeds: their number, their modularity, and whether the number is nearest to that of the labels."""
    from simvane.sources.sinks import checkpoint_folder

    checkpoint_folder(spark)
    c = cells(spark, sf)
    edges = models.fuzzy_affinity(N.exact_neighbors(c, 15)).checkpoint()
    grid = models.modularity(edges, models.modularity_grid(edges, [0.5, 1.0, 2.0], [0, 1], 4)).checkpoint()
    n_labels = c.select("label").distinct().count()
    picked = panels.count_match(grid, "seed", "resolution", "n_clusters", n_labels).select("seed", "resolution", F.lit(True).alias("matched"))
    return grid.join(picked, ["seed", "resolution"], "left").select("resolution", "seed", "n_clusters", _r("modularity"), F.coalesce("matched", F.lit(False)).alias("matched"))


def scaled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return models.scaled(cells(spark, sf), clip=1.5).select("id", F.transform("v", lambda x: S.rounded(x)).alias("v"))


def hex_refinement(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return models.majority_refinement(c.select(F.col("id").alias("node"), F.col("cluster")), N.exact_neighbors(c, 6))


def windowed_event_counts(spark: SparkSession, sf: str) -> DataFrame:
    out = ingest.windowed_counts(table(spark, sf, "events"), "ts", ["event_type"], "1 day", "1 hour")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", _r("total"))


def asof_events(spark: SparkSession, sf: str) -> DataFrame:
    """For each purchase the value of the user's latest click at that time or before; the largest of equals in time."""
    e = table(spark, sf, "events")
    clicks = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return ingest.asof_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", "value").select("event_id", "user_id", _r("asof_value"))


def fixed_sample(spark: SparkSession, sf: str) -> DataFrame:
    return perturb.sample_rows(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), 200, 5, "c_custkey")


def feature_variance(spark: SparkSession, sf: str) -> DataFrame:
    """The 10 dimensions of largest variance, ties by place."""
    long = cells(spark, sf).select(F.posexplode("v").alias("dim", "x")).groupBy("dim").agg(F.round(F.var_pop("x"), 9).alias("variance"))
    return long.orderBy(F.desc("variance"), "dim").limit(10).select("dim", _r("variance"))


def repaired_vectors(spark: SparkSession, sf: str) -> DataFrame:
    hurt = cells(spark, sf).withColumn("v", F.transform("v", lambda x: F.when(x > 0.2, F.lit(float("nan"))).otherwise(x)))
    return hurt.select("id", F.transform(integrity.repair_vector("v"), lambda x: S.rounded(x)).alias("v"))


_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, list_position(embedding[1:8], list_max(embedding[1:8])) - 1 AS cluster FROM embeddings)"
_X = "x AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e)"

# the scale of each row is halved in 64 steps, as the operator does; a scale below a thousandth of the mean distance is raised to that
_FUZZY = """nn AS (SELECT * FROM (SELECT a.id AS q, b.id AS n, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 15),
rows AS (SELECT q, list(d ORDER BY rank) AS d, coalesce(min(d) FILTER (d > 0), 0) AS near FROM nn GROUP BY 1),
gaps AS (SELECT q, list_transform(d, lambda x: greatest(0, x - near)) AS gap, near, list_sum(d) / 16 AS mean FROM rows),
steps AS (SELECT q, gap, near, mean, 0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1::DOUBLE AS mid, false AS done, 0 AS step FROM gaps
UNION ALL SELECT q, gap, near, mean, CASE WHEN NOT fine AND NOT above THEN mid ELSE lo END, CASE WHEN NOT fine AND above THEN mid ELSE hi END,
CASE WHEN fine THEN mid WHEN above THEN (lo + mid) / 2 WHEN hi = 'infinity' THEN mid * 2 ELSE (mid + hi) / 2 END, fine, step + 1
FROM (SELECT *, done OR abs(total - 4) < 1e-5 AS fine, total > 4 AS above FROM (SELECT *, list_sum(list_transform(gap, lambda g: exp(-g / mid))) AS total FROM steps WHERE step < 64))),
scales AS (SELECT q, near, greatest(mid, 1e-3 * CASE WHEN near > 0 THEN mean ELSE (SELECT avg(mean) FROM gaps) END) AS scale FROM steps WHERE step = 64),
w AS (SELECT nn.q, n, CASE WHEN d > near THEN exp(-(d - near) / scale) ELSE 1 END AS w FROM nn JOIN scales USING (q)),
f AS (SELECT least(q, n) AS a, greatest(q, n) AS b, coalesce(max(w) FILTER (q < n), 0) AS x, coalesce(max(w) FILTER (q > n), 0) AS y FROM w GROUP BY 1, 2)"""

SQL = {
    "fuzzy_affinity": f"WITH RECURSIVE {_E}, {_FUZZY} SELECT a, b, round(x + y - x * y, 6) AS w FROM f",
    "scaled_vectors": f"WITH {_E}, {_X}, m AS (SELECT dim, avg(x) AS m, coalesce(nullif(stddev_samp(x), 0), 1) AS s FROM x GROUP BY 1) SELECT id, list(round(least(1.5, (x - m) / s), 6) ORDER BY m.dim) AS v FROM x JOIN m ON x.dim = m.dim GROUP BY 1",
    "hex_refinement": f"""WITH {_E}, n AS (SELECT * FROM (SELECT a.id AS q, b.cluster AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id) WHERE rank <= 6),
c AS (SELECT q, other, count(*) AS c FROM n GROUP BY 1, 2), t AS (SELECT q, arg_min(other, -c * 1000 + other) AS top, max(c) AS top_c FROM c GROUP BY 1)
SELECT id AS node, (CASE WHEN coalesce(o.c, 0) * 2 < 6 AND top_c * 2 > 6 THEN top ELSE cluster END)::INT AS cluster FROM e JOIN t ON t.q = id LEFT JOIN c o ON o.q = id AND o.other = cluster""",
    "windowed_event_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2",
    "asof_events": "WITH k AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) SELECT p.event_id, p.user_id, round(k.value, 6) AS asof_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.ts >= k.ts",
    "fixed_sample": "SELECT c_custkey, c_nationkey FROM customer ORDER BY sha256(c_custkey::VARCHAR || '|5'), c_custkey LIMIT 200",
    "feature_variance": f"WITH {_E}, {_X}, a AS (SELECT dim::INT AS dim, round(var_pop(x), 9) AS variance FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT dim, round(variance, 6) AS variance FROM a",
    "repaired_vectors": f"WITH {_E} SELECT id, list_transform(v, lambda z: round(CASE WHEN z > 0.2 THEN 0 ELSE z END, 6)) AS v FROM e",
}

QUERIES = {f.__name__: f for f in (pca32, kmeans_clusters, fuzzy_affinity, propagated_labels, modularity_grid, scaled_vectors, hex_refinement, windowed_event_counts, asof_events, fixed_sample, feature_variance, repaired_vectors)}
