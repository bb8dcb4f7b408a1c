"""Queries that write a file from the tables to the shared folder and read it strictly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.functions import scalars as S
from simvane.operators import panels as P
from simvane.plans.tables import cells, counts, seed_rows, table
from simvane.sources import readers as R
from simvane.sources import sinks as K


def published_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of a published run, checked against its manifest."""
    run = K.Run(spark, K.shared_folder(spark), "run")
    run.write("suppliers", table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"))
    return K.read_table(spark, run.publish(kind="table"), "suppliers")


def published_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """The completed ones among a run for each region."""
    root = K.shared_folder(spark)
    for r in table(spark, sf, "region").orderBy("r_regionkey").collect():  # five regions
        K.write_json(spark, f"{root}/region-{r.r_regionkey}/run.json", {"status": "completed" if r.r_regionkey % 2 == 0 else "failed", "name": r.r_name})
    return R.run_catalog(spark, f"{root}/*/run.json").select("run", "name", "status")


def embedding_file(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors through a CSV of text ids, checked against the canonical ids."""
    at = f"{K.shared_folder(spark)}/embedding"
    named = cells(spark, sf).select(F.lpad(F.col("id").cast("string"), 8, "0").alias("cell_id"), "v")
    K.write_embedding_csv(named, at, 64)
    return R.embedding_csv(spark, at, 64, named.select("cell_id")).select("cell_id", F.transform("v", lambda x: S.rounded(x)).alias("v"))


def manifest_file(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{K.shared_folder(spark)}/manifest"
    K.write_manifest_csv(table(spark, sf, "nation"), at, ["n_nationkey", "n_name"], "n_nationkey")
    return spark.read.option("header", True).schema("n_nationkey long, n_name string").csv(at)


def panel_file(spark: SparkSession, sf: str) -> DataFrame:
    """A panel of the parts of each brand, as gzip JSON."""
    at = f"{K.shared_folder(spark)}/panel"
    K.write_panel(table(spark, sf, "part").groupBy(F.col("p_brand").alias("cls")).agg(F.array_sort(F.collect_list("p_partkey")).alias("genes")), at)
    return spark.read.schema("cls string, genes array<long>").json(at)


def position_file(spark: SparkSession, sf: str) -> DataFrame:
    """A headerless table of places."""
    at = f"{K.shared_folder(spark)}/positions"
    c = table(spark, sf, "customer")
    c.select(F.concat(F.lit("spot-"), "c_custkey"), F.col("c_custkey") % 2, "c_nationkey", F.col("c_custkey") % 7, F.col("c_custkey") * 3, F.col("c_custkey") * 5).write.csv(at)
    return R.spot_positions(spark, at)


def layer_file(spark: SparkSession, sf: str) -> DataFrame:
    at = f"{K.shared_folder(spark)}/layers"
    table(spark, sf, "supplier").select("s_name", F.col("s_nationkey").cast("string"), F.concat(F.lit("layer "), F.col("s_suppkey") % 7)).write.option("sep", "\t").csv(at)
    return R.layer_map(spark, at)


def scale_file(spark: SparkSession, sf: str) -> DataFrame:
    """Scale factors from sizes of tables."""
    at = f"{K.shared_folder(spark)}/scales.json"
    sizes = [table(spark, sf, t).count() for t in ("region", "nation", "supplier", "customer")]
    K.write_json(spark, at, {f: n / 4 for f, n in zip(R.SCALE_FIELDS, sizes, strict=True)})
    return R.scale_factors(spark, at)


def marker_file(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical human markers of a gzip TSV with several ways to name a species."""
    at = f"{K.shared_folder(spark)}/markers"
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    species = F.when(key % 4 == 0, "Hs").when(key % 4 == 1, "Mm Hs").when(key % 4 == 2, "Homo sapiens").otherwise("Mm")
    symbol = F.when(key % 11 == 0, F.concat(F.lit("bad "), key)).otherwise(F.concat(F.lit("Gene_"), key % 50))
    rows = p.select(species.alias("species"), symbol.alias("official gene symbol"), F.col("p_brand").alias("cell type"), F.when(key % 3 == 0, "1").when(key % 3 == 1, "Canonical marker").otherwise("0").alias("canonical marker"))
    rows.write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(at)
    return R.marker_tsv(spark, at)


def ontology_file(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as the terms of an OBO file; regions' names as synonyms; every fifth is obsolete."""
    at = f"{K.shared_folder(spark)}/terms"
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    text = F.concat(F.lit("[Term]\nid: CL:"), F.lpad(F.col("n_nationkey").cast("string"), 7, "0"), F.lit("\nname: "), "n_name", F.lit('\nsynonym: "'), "r_name", F.lit('" EXACT []\n'), F.when(F.col("n_nationkey") % 5 == 0, "is_obsolete: true\n").otherwise(""))
    n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey")).select(text.alias("value")).write.text(at)
    return R.ontology_obo(spark, at)


def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    return R.resolve_names(table(spark, sf, "nation").select(F.col("n_name").alias("label")), ontology_file(spark, sf), "label")


def loss_file(spark: SparkSession, sf: str) -> DataFrame:
    """A log of one loss for each event, by its number."""
    at = f"{K.shared_folder(spark)}/losses"
    table(spark, sf, "events").select(F.col("event_id").alias("step"), F.round("value", 6).alias("loss")).write.json(at)
    return R.loss_log(spark, at).select("n", "first", "last", "least", F.round("mean", 6).alias("mean"))


def staged_annotation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a staged annotation table: NaN as NULL, category codes resolved."""
    o = table(spark, sf, "orders")
    names = o.select("o_orderpriority").distinct().select((F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("code"), F.col("o_orderpriority").alias("name"))
    price = F.when(F.col("o_orderkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice").cast("double"))
    frame = o.select(F.col("o_orderkey").alias("_index"), price.alias("price"), F.when(F.col("o_orderkey") % 8 == 0, -1).otherwise(F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("priority"))
    return R.annotation_frame(frame, names, "priority").select("_index", F.round("price", 6).alias("price"), "priority")


def staged_counts(spark: SparkSession, sf: str) -> DataFrame:
    return R.sparse_counts(counts(spark, sf))


def united_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers and customers as two parts under synthetic ids."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row"), F.col("s_name").alias("name"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("row"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return R.synthetic_ids(R.union_parts([s, c], "row"), "row", "part_no").select("part_no", "row", "name", "segment", "cell_id")


def allowed_methods(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of two methods of three, without rows that lack the value."""
    rows = seed_rows(spark, sf).withColumn("value", F.when(F.col("quantity") > 5, F.col("value")))
    kept = rows.filter(F.col("method").isin("A", "R")).dropna(subset=["value"])
    by = kept.groupBy("method", "seed").agg(F.avg("value").alias("value"))
    return P.seed_stats(by, ["method"], "value").select("method", "n", *(F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max")))


def canonical_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of each nation's canonical JSON."""
    return table(spark, sf, "nation").select("n_nationkey", S.canonical_hash("n_name", "n_nationkey", "n_regionkey").alias("hash"))


SQL = {
    "published_table": "SELECT s_suppkey, s_name, s_nationkey FROM supplier",
    "published_catalog": "SELECT 'region-' || r_regionkey AS run, r_name AS name, 'completed' AS status FROM region WHERE r_regionkey % 2 = 0",
    "embedding_file": "SELECT lpad(vec_id::VARCHAR, 8, '0') AS cell_id, list_transform(embedding::DOUBLE[], lambda x: round(x, 6)) AS v FROM embeddings",
    "manifest_file": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation",
    "panel_file": "SELECT p_brand AS cls, list(p_partkey::BIGINT ORDER BY p_partkey) AS genes FROM part GROUP BY 1",
    "position_file": "SELECT 'spot-' || c_custkey AS barcode, (c_custkey % 2)::INT AS in_tissue, c_nationkey::BIGINT AS array_row, (c_custkey % 7)::BIGINT AS array_col, (c_custkey * 3)::BIGINT AS pxl_row, (c_custkey * 5)::BIGINT AS pxl_col FROM customer",
    "layer_file": "SELECT s_name AS barcode, s_nationkey::VARCHAR AS section, 'layer ' || s_suppkey % 7 AS label FROM supplier",
    "scale_file": "SELECT " + ", ".join(f"(SELECT count(*) FROM {t}) / 4 AS {f}" for f, t in zip(R.SCALE_FIELDS, ("region", "nation", "supplier", "customer"), strict=True)),
    "marker_file": "SELECT DISTINCT 'Gene_' || p_partkey % 50 AS symbol, p_brand AS cell_type FROM part WHERE p_partkey % 4 <> 3 AND p_partkey % 3 <> 2 AND p_partkey % 11 <> 0",
    "ontology_file": "SELECT 'CL:' || lpad(n_nationkey::VARCHAR, 7, '0') AS id, n_name AS name, [r_name] AS synonyms, n_nationkey % 5 = 0 AS obsolete FROM nation JOIN region ON n_regionkey = r_regionkey",
    "resolved_names": "SELECT n_name AS label, CASE WHEN n_nationkey % 5 <> 0 THEN 'CL:' || lpad(n_nationkey::VARCHAR, 7, '0') END AS term_id FROM nation",
    "loss_file": "SELECT count(value) AS n, round(arg_min(value, event_id), 6) AS first, round(arg_max(value, event_id), 6) AS last, round(min(value), 6) AS least, round(avg(round(value, 6)), 6) AS mean FROM events",
    "staged_annotation": "SELECT o_orderkey AS _index, CASE WHEN o_orderkey % 9 <> 0 THEN round(o_totalprice::DOUBLE, 6) END AS price, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderpriority END AS priority FROM orders",
    "staged_counts": "SELECT l_orderkey AS cell, l_partkey AS gene, sum(l_quantity)::INT AS value FROM lineitem GROUP BY 1, 2",
    "united_parts": "SELECT 0 AS part_no, s_suppkey AS row, s_name AS name, NULL::VARCHAR AS segment, 'Cell-' || s_suppkey || '-Batch-0' AS cell_id FROM supplier UNION ALL SELECT 1, c_custkey, c_name, c_mktsegment, 'Cell-' || c_custkey || '-Batch-1' FROM customer",
    "allowed_methods": "WITH r AS (SELECT l_returnflag AS method, l_linenumber AS seed, avg(l_extendedprice::DOUBLE) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_quantity > 5 AND l_returnflag IN ('A', 'R') GROUP BY 1, 2) SELECT method, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS sd, round(min(v), 6) AS min, round(max(v), 6) AS max FROM r GROUP BY 1",
    "canonical_hashes": "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS hash FROM nation",
}

QUERIES = {f.__name__: f for f in (published_table, published_catalog, embedding_file, manifest_file, panel_file, position_file, layer_file, scale_file, marker_file, ontology_file, resolved_names, loss_file, staged_annotation, staged_counts, united_parts, allowed_methods, canonical_hashes)}
