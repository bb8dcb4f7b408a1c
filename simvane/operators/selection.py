"""Selections, heuristics on matrices, predictions from signatures, graphs on coordinates, synthetic rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simvane.operators.blocks import matrix
from simvane.operators.sizes import bounded


def matrix_kind(coo: DataFrame, order: list[str], value: str = "value", head: int = 5000) -> DataFrame:
    """integer_share and p99 of the first `head` values in order, integer_like (0.95 or more), log_like (over half not whole, p99 below 50)."""
    x = coo.orderBy(*order).limit(head)
    whole = F.avg((F.col(value) == F.round(value)).cast("double"))
    out = x.agg(whole.alias("integer_share"), F.percentile(value, 0.99).alias("p99"))
    return out.withColumn("integer_like", F.col("integer_share") >= 0.95).withColumn("log_like", (F.col("integer_share") < 0.5) & (F.col("p99") < 50))


def counterfactual_slice(moved: DataFrame, batch: str) -> DataFrame:
    """Of rows under every batch, those under their own."""
    return moved.filter(F.col("hyp_batch") == F.col(batch)).drop("hyp_batch")


def effective_rank(df: DataFrame, vector: str = "v") -> DataFrame:
    """dim, effective_rank: exp of the entropy of the shares of the centred matrix's singular values. Each task adds up its vectors and their products; d by d sums alone leave it."""
    x = F.col(vector).cast("array<double>")

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, products = 0, None, None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0))
                n, total, products = n + len(m), m.sum(0) + (0 if total is None else total), m.T @ m + (0 if products is None else products)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([products.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "total", "products"])

    sums = df.select(x.alias("v")).mapInArrow(gram, "n long, total array<double>, products array<double>")
    both = sums.select("n", F.posexplode(F.concat("total", "products")).alias("i", "x")).groupBy("i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect()
    flat = np.array([r["x"] for r in sorted(both, key=lambda r: r["i"])])
    d = int((np.sqrt(1 + 4 * len(flat)) - 1) / 2 + 0.5)
    n = both[0]["n"] if both else 0
    mean = flat[:d] / max(1, n)
    s = np.sqrt(np.maximum(np.linalg.eigvalsh(flat[d:].reshape(d, d) / max(1, n) - np.outer(mean, mean)), 0.0)) if d else np.zeros(0)
    p = s[s > 0] / s.sum() if s.sum() > 0 else np.zeros(0)
    rank = float(np.exp(-(p * np.log(p)).sum())) if len(p) else None
    return df.sparkSession.createDataFrame([(d, rank)], "dim int, effective_rank double")


def signature_recall(coo: DataFrame, cells: DataFrame, signatures: DataFrame, top: int, cell: str = "cell", gene: str = "gene", value: str = "value", label: str = "label", fold: str = "fold") -> DataFrame:
    """fold, label, n, recall: the rows of each fold are given the class with the highest z-score of the mean of its signature's genes (the smallest of equals); absent values count as zeros."""
    test = cells.select(F.col(cell).alias("cell"), F.col(label).alias("truth"), F.col(fold).alias("fold"))
    sums = coo.join(signatures.select("fold", F.col("label").alias("cls"), gene), gene).join(test.select(F.col("cell").alias("c_"), F.col("fold").alias("f_")), (F.col(cell) == F.col("c_")) & (F.col("fold") == F.col("f_")))
    sums = sums.groupBy(F.col("c_").alias("cell"), "fold", "cls").agg((F.sum(F.col(value).cast("double")) / top).alias("score"))
    classes = signatures.select("fold", F.col("label").alias("cls")).distinct()
    grid = test.join(bounded(classes), "fold").join(sums, ["cell", "fold", "cls"], "left").fillna(0.0, "score")
    by = grid.groupBy("fold", "cls").agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    z = grid.join(bounded(by), ["fold", "cls"]).withColumn("z", F.round(F.when(F.col("s") > 1e-12, (F.col("score") - F.col("m")) / F.col("s")).otherwise(0.0), 9))
    best = z.groupBy("fold", "cell", "truth").agg(F.min_by("cls", F.struct((-F.col("z")).alias("m"), F.col("cls"))).alias("guess"))
    return best.groupBy("fold", F.col("truth").alias("label")).agg(F.count("*").alias("n"), F.avg((F.col("guess") == F.col("truth")).cast("double")).alias("recall"))


def balanced_accuracy(recalls: DataFrame, by: str = "fold") -> DataFrame:
    return recalls.groupBy(by).agg(F.avg("recall").alias("balanced_accuracy"), F.count("*").alias("n_classes"))


def pick_resolution(grid: DataFrame, seed: str, resolution: str, count: str, score: str, fixed: float, target: int) -> DataFrame:
    """seed, rule (fixed, matched, best), resolution, count, score, boundary: the row at the fixed resolution, the one of nearest count, the one of best score; the lowest resolution of equals; boundary if it is the grid's first or last."""
    w = Window.partitionBy(seed)
    marked = grid.withColumn("edge_", (F.col(resolution) == F.min(resolution).over(w)) | (F.col(resolution) == F.max(resolution).over(w)))
    row = F.struct(resolution, count, score, "edge_")
    rules = {"fixed": (F.col(resolution) == fixed, F.struct(resolution)), "matched": (F.lit(True), F.struct(F.abs(F.col(count) - target).alias("d"), F.col(resolution))), "best": (F.col(score).isNotNull(), F.struct((-F.col(score)).alias("s"), F.col(resolution)))}
    picks = [F.struct(F.lit(name).alias("rule"), F.min_by(F.when(ok, row), F.when(ok, key)).alias("x")) for name, (ok, key) in rules.items()]
    out = marked.groupBy(seed).agg(F.array(*picks).alias("p")).select(seed, F.explode("p").alias("p")).filter("p.x is not null")
    return out.select(seed, "p.rule", f"p.x.{resolution}", f"p.x.{count}", f"p.x.{score}", F.col("p.x.edge_").alias("boundary"))


def gaussian_affinity(neighbors: DataFrame, length: float) -> DataFrame:
    """q, n, w = exp(-d^2 / (2 length^2)) on the edges of a neighbour table."""
    return neighbors.select("q", "n", F.exp(-F.col("d") * F.col("d") / (2 * length * length)).alias("w"))


def scaled_pixels(x: Column, factor: Column | float, limit: int | None = None) -> Column:
    """Full-resolution pixels in a smaller picture, to the nearest whole one (halves to even); outside it the query fails."""
    p = F.rint(x * factor).cast("long")
    return p if limit is None else F.when((p < 0) | (p >= limit), F.raise_error(F.lit("a pixel is outside the picture")).cast("long")).otherwise(p)


def flat_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """keys, field and value (as text) of each top-level field of a JSON column."""
    return df.select(*keys, F.explode(F.from_json(column, "map<string,string>")).alias("field", "value"))


def dispersion_ranks(coo: DataFrame, n_cells: int, bins: int = 20, gene: str = "gene", value: str = "value") -> DataFrame:
    """gene, mean, dispersion, normalised, rank: variance over mean, in logs, as a z-score among the genes of the same of `bins` equal ranges of log mean; a gene alone in its range gets 1. Absent values are zeros."""
    x = F.col(value).cast("double")
    by = coo.groupBy(gene).agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    mean = F.col("s1") / n_cells
    variance = F.greatest(F.col("s2") - n_cells * mean * mean, F.lit(0.0)) / (n_cells - 1)
    g = by.select(gene, F.log1p(mean).alias("mean"), F.round(F.log(F.nullif(variance / mean, F.lit(0.0))), 9).alias("dispersion")).filter("dispersion is not null")
    span = g.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    g = g.crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.lit(bins - 1), F.floor(F.round((F.col("mean") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins, 9))))
    stats = g.groupBy("bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("s"))
    z = F.when(F.col("s").isNull(), 1.0).otherwise((F.col("dispersion") - F.col("m")) / F.nullif("s", F.lit(0.0)))
    out = g.join(bounded(stats), "bin").select(gene, "mean", "dispersion", F.round(z, 9).alias("normalised"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("normalised"), gene)))


def hash_normal(*of: Column) -> Column:
    """A number that looks drawn from the standard normal distribution, the same everywhere (Box-Muller on two hashes)."""
    u, v = ((F.shiftrightunsigned(F.xxhash64(F.lit(k), *of), 11).cast("double") + 0.5) / 2.0**53 for k in (1, 2))
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2 * np.pi * v)


def synthetic_cells(spark: SparkSession, per_cell: int, groups: int, batches: int, dimension: int, shift: float, seed: int = 0) -> DataFrame:
    """id, group, batch, v: `per_cell` rows for each of groups x batches; v is normal noise around the group's own axis, plus a shift along the batch's axis."""
    n = per_cell * groups * batches
    rows = spark.range(n).select("id", (F.col("id") % groups).alias("group"), (F.floor(F.col("id") / groups) % batches).alias("batch"))
    dims = F.sequence(F.lit(0), F.lit(dimension - 1))
    part = lambda i: hash_normal(F.lit(seed), F.col("id"), i) + F.when(i == F.col("group") % dimension, 4.0).otherwise(0.0) + F.when(i == (F.col("batch") + groups) % dimension, float(shift)).otherwise(0.0)
    return rows.withColumn("v", F.transform(dims, part))
