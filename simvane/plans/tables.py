"""The input tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, v, batch, label and cluster (place of the largest of the first 8 components) of the embeddings."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 4).alias("batch"), F.col("label"))
    return e.withColumn("cluster", S.argmax("v", 8))


def halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells with the first 32 components only."""
    return cells(spark, sf_dir).withColumn("v", S.leading("v", 32))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, gene, value: quantities of parts in orders."""
    x = table(spark, sf_dir, "lineitem")
    return x.groupBy(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("gene")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def count_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, batch (order priority), label (order status) of the orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_orderpriority").alias("batch"), F.col("o_orderstatus").alias("label"))


def seed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seed (line number), section (nation), donor (region), method (return flag), value (price) of the line items."""
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return rows.select(F.col("l_linenumber").alias("seed"), F.col("n_name").alias("section"), F.col("r_name").alias("donor"), F.col("l_returnflag").alias("method"), F.col("l_extendedprice").cast("double").alias("value"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"))
