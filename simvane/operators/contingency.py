"""Agreement of two labelings by their contingency table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CLIP = 1e-12


def contingency(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """label, cluster, n and the shares of n in its label and in its cluster."""
    n = df.groupBy(F.col(label).alias("label"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    row, column = (F.sum("n").over(Window.partitionBy(c)) for c in ("label", "cluster"))
    return n.select("label", "cluster", "n", (F.col("n") / row).alias("label_share"), (F.col("n") / column).alias("cluster_share"))


def agreement(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """One row: ari, ri, nmi (arithmetic mean normaliser), n. A single cluster on both sides gives ari 1 and nmi 1."""
    cells = df.groupBy(F.col(label).alias("a"), F.col(cluster).alias("b")).agg(F.count("*").cast("double").alias("n"))

    def pairs(c: str = "n") -> object:
        return F.col(c) * (F.col(c) - 1) / 2

    def entropy(c: str = "n") -> object:
        return F.col(c) * F.log(F.col(c))

    joint = cells.agg(F.sum("n").alias("t"), F.sum(pairs()).alias("pij"), F.sum(entropy()).alias("eij"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(pairs()).alias("pi"), F.sum(entropy()).alias("ei"))
    columns = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(pairs()).alias("pj"), F.sum(entropy()).alias("ej"))
    one = joint.crossJoin(rows).crossJoin(columns)  # one row each
    t, pij, pi, pj = (F.col(c) for c in ("t", "pij", "pi", "pj"))
    every = t * (t - 1) / 2
    expected = pi * pj / F.nullif(every, F.lit(0.0))
    spread = (pi + pj) / 2 - expected
    h_a, h_b = F.log(t) - F.col("ei") / t, F.log(t) - F.col("ej") / t
    mutual = F.log(t) + (F.col("eij") - F.col("ei") - F.col("ej")) / t
    return one.select(
        t.cast("long").alias("n"),
        F.when(spread == 0, 1.0).otherwise((pij - expected) / spread).alias("ari"),
        ((every + 2 * pij - pi - pj) / F.nullif(every, F.lit(0.0))).alias("ri"),
        F.when(h_a + h_b < 1e-15, 1.0).otherwise(mutual / ((h_a + h_b) / 2)).alias("nmi"),
    )


def cluster_purity_entropy(df: DataFrame, label: str, cluster: str) -> DataFrame:
    """cluster, n, purity, dominant label (the smallest of equals), entropy in bits over all labels of the table, shares clipped below at 1e-12; and the row `__ALL__`, weighted by size."""
    found = df.groupBy(F.col(cluster).cast("string").alias("cluster"), F.col(label).cast("string").alias("label")).agg(F.count("*").alias("n"))
    n_labels = df.agg(F.countDistinct(label).alias("n_labels"))
    p = found.withColumn("size", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("p", F.col("n") / F.col("size"))
    by = p.groupBy("cluster", "size").agg(
        F.max("p").alias("purity"),
        F.min_by("label", F.struct((-F.col("n")).alias("m"), F.col("label"))).alias("dominant"),
        F.sum(-F.col("p") * F.log2("p")).alias("h"),
        F.count("*").alias("seen"),
    ).crossJoin(F.broadcast(n_labels))
    empty = -CLIP * F.log2(F.lit(CLIP))
    by = by.withColumn("entropy", F.col("h") + (F.col("n_labels") - F.col("seen")) * empty)
    out = by.select("cluster", F.col("size").alias("n"), "purity", "dominant", "entropy")
    total = out.agg(F.lit("__ALL__").alias("cluster"), F.sum("n").alias("n"), (F.sum(F.col("purity") * F.col("n")) / F.sum("n")).alias("purity"), F.lit(None).cast("string").alias("dominant"), (F.sum(F.col("entropy") * F.col("n")) / F.sum("n")).alias("entropy"))
    return out.unionByName(total)
