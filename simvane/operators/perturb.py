"""Deterministic sampling, splits and shifts of labelled vectors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simvane.operators.sizes import bounded


#: Hexadecimal digits of a hash by which a stratum is counted before it is ranked.
HEAD = 3


def hash_order(id_col: str, seed: int) -> Column:
    """A column that orders rows as if at random, the same everywhere."""
    return F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")), 256)


def downsample_batch(df: DataFrame, batch: str, target, fraction: float, seed: int, id_col: str = "id") -> DataFrame:
    """Keeps the first floor(n * fraction), 2 at least, of the rows of one batch in hash order; others are untouched.

    The cut is found from a count and the hash's order, so the batch is sorted by Spark's range
    partitioning and not in one window.
    """
    inside = F.col(batch) == F.lit(target)
    n = df.filter(inside).count()
    keep = min(n, max(2, math.floor(n * fraction)))
    chosen = df.filter(inside).select(id_col).orderBy(hash_order(id_col, seed), id_col).limit(keep)
    return df.filter(~F.coalesce(inside, F.lit(False))).unionByName(df.filter(inside).join(chosen, id_col, "left_semi").select(*df.columns))


def drop_combination(df: DataFrame, batch: str, b, label: str, y) -> DataFrame:
    """Rows but those of class y in batch b."""
    return df.filter(~F.coalesce((F.col(batch) == F.lit(b)) & (F.col(label) == F.lit(y)), F.lit(False)))


def stratified_sample(df: DataFrame, stratum: str, target: int, seed: int, id_col: str = "id") -> DataFrame:
    """About target rows in proportion to the strata: floors first, 1 at least, then one more for the largest remainders (ties by stratum); rows of a stratum in hash order."""
    sizes = df.groupBy(stratum).agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    exact = F.col("n") * target / F.col("total")
    sizes = sizes.withColumn("base", F.least(F.col("n"), F.greatest(F.lit(1), F.floor(exact)))).withColumn("rest", F.round(exact - F.floor(exact), 9))
    sizes = sizes.withColumn("left", target - F.sum("base").over(Window.partitionBy()))
    sizes = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rest"), stratum)))
    sizes = sizes.select(F.col(stratum).alias("s_"), F.least(F.col("n"), F.col("base") + F.when(F.col("place") <= F.col("left"), 1).otherwise(0)).alias("take_"))
    # a stratum is cut in the hash's order: the rows of each first digits are counted, so that only the digits on the cut are ranked
    key = hash_order(id_col, seed)
    marked = df.withColumn("key_", key).withColumn("head_", F.substring("key_", 1, HEAD))
    heads = marked.groupBy(F.col(stratum).alias("h_s"), F.col("head_").alias("h_head")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("h_s").orderBy("h_head").rowsBetween(Window.unboundedPreceding, -1))
    cuts = heads.withColumn("before", F.coalesce(before, F.lit(0))).join(bounded(sizes), F.col("h_s").eqNullSafe(F.col("s_"))).filter("before < take_").select("h_s", "h_head", "n", "before", "take_")
    found = marked.join(cuts, F.col(stratum).eqNullSafe(F.col("h_s")) & (F.col("head_") == F.col("h_head")))
    whole = found.filter("before + n <= take_")
    ranked = found.filter("before + n > take_").withColumn("nth_", F.row_number().over(Window.partitionBy("h_s", "h_head").orderBy("key_", id_col))).filter("before + nth_ <= take_")
    return whole.select(*df.columns).unionByName(ranked.select(*df.columns))


def sample_rows(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """n rows in hash order, without replacement."""
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def fold_of(id_col: str) -> Column:
    """0 or 1: the lowest bit of the first byte of sha256(id)."""
    return F.conv(F.substring(F.sha2(F.col(id_col).cast("string"), 256), 1, 2), 16, 10).cast("int").bitwiseAND(F.lit(1))


def is_heldout(id_col: str, seed: int, parts: int = 5) -> Column:
    """Whether the first 8 bytes of sha256(id|seed) are divisible by parts."""
    head = F.conv(F.substring(hash_order(id_col, seed), 1, 16), 16, 10).cast("decimal(20,0)")
    return head % parts == 0


def simplex_directions(vertices: int, dimension: int) -> list[list[float]]:
    """Unit vectors to the corners of a regular simplex, by Helmert's matrix; their sum is 0. A cosine transform turns them so that no axis is favoured."""
    if not 2 <= vertices <= dimension + 1:
        raise ValueError("a simplex needs 2 to dimension + 1 corners")
    place, wave = np.arange(dimension)[:, None], np.arange(dimension)[None, :]
    turn = np.cos(np.pi * (place + 0.5) * wave / dimension) * np.where(wave > 0, math.sqrt(2 / dimension), math.sqrt(1 / dimension))
    corner, axis = np.arange(vertices)[:, None], np.arange(1, dimension + 1)[None, :]
    flat = np.where(axis >= vertices, 0.0, np.where(corner < axis, 1.0, np.where(corner == axis, -axis, 0.0)) / np.sqrt(axis * (axis + 1.0)))
    return (flat / np.sqrt((flat * flat).sum(axis=1, keepdims=True)) @ turn.T).tolist()


def batch_shift(df: DataFrame, batch: str, radius: float, strength: float, vector: str = "v") -> DataFrame:
    """All rows under every batch: hyp_batch and v + strength * radius * (direction of the batch - weighted mean direction), so the weighted centroid stays."""
    sizes = {r[0]: r[1] for r in df.groupBy(batch).agg(F.count("*")).collect()}
    levels = sorted(sizes)
    first = df.select(F.size(vector).alias("d")).first()
    if first is None:
        return df.withColumn("hyp_batch", F.col(batch))
    corners = simplex_directions(len(levels), first["d"])
    total = sum(sizes.values())
    mean = [sum(sizes[b] * c[j] for b, c in zip(levels, corners, strict=True)) / total for j in range(first["d"])]
    moved = [(b, [strength * radius * (x - m) for x, m in zip(c, mean, strict=True)]) for b, c in zip(levels, corners, strict=True)]
    shifts = df.sparkSession.createDataFrame(moved, f"hyp_batch {df.schema[batch].dataType.simpleString()}, shift array<double>")
    return df.crossJoin(F.broadcast(shifts)).withColumn(vector, F.zip_with(F.col(vector).cast("array<double>"), "shift", lambda a, b: a + b)).drop("shift")


def local_warp(df: DataFrame, label: str, target, batch: str, axis: Column, direction: list[float], strength: float, scale: float, vector: str = "v") -> DataFrame:
    """Rows of one class move along direction by strength * scale * (tanh(axis / scale) - its mean in their batch). The means are summed up first and sent back, so vectors stay where they are."""
    inside = F.coalesce(F.col(label) == F.lit(target), F.lit(False))
    c = F.tanh(axis / scale)
    means = bounded(df.filter(inside).groupBy(F.col(batch).alias("b_")).agg(F.avg(c).alias("m_")))
    out = df.join(means, F.col(batch).eqNullSafe(F.col("b_")), "left")
    step = F.array(*[F.lit(x) for x in direction])
    moved = F.zip_with(F.col(vector).cast("array<double>"), step, lambda a, b: a + strength * scale * F.coalesce(c - F.col("m_"), F.lit(0.0)) * b)
    new = F.when(inside, moved).otherwise(F.col(vector).cast("array<double>"))
    return out.select(*(new.alias(x) if x == vector else df[x] for x in df.columns))


def sensitivity(counterfactual: DataFrame, clean: DataFrame, id_col: str = "id", vector: str = "v") -> DataFrame:
    """numerator, denominator, ratio: mean over (hyp_batch, row) of the squared distance from the row's mean, over the mean squared distance of clean rows from their mean; NULL if those collapse.

    Sums of whole vectors: what a row becomes under all batches is one vector before anything is shuffled.
    """

    def spread(df: DataFrame, by: list[str]) -> DataFrame:
        x = Summarizer.metrics("variance", "count").summary(array_to_vector(F.col(vector).cast("array<double>")))
        out = df.groupBy(*by).agg(x.alias("x")).select(F.col("x.count").alias("n"), F.aggregate(vector_to_array("x.variance"), F.lit(0.0), lambda a, v: a + v).alias("variance"))
        return out.agg(F.sum(F.col("variance") * (F.col("n") - 1)).alias("ss"), F.sum("n").alias("n"))

    numerator = spread(counterfactual, [id_col]).select((F.col("ss") / F.col("n")).alias("numerator"))
    one = numerator.crossJoin(spread(clean, []).select((F.col("ss") / F.col("n")).alias("denominator")))
    return one.withColumn("ratio", F.when(F.col("denominator") > 1e-12, F.col("numerator") / F.col("denominator")))


def train_only_centering(df: DataFrame, heldout: Column, batch: str, vector: str = "v", id_col: str = "id") -> DataFrame:
    """id, dim, value + overall mean - mean of its batch, both means from the rows not held out."""
    long = df.select(id_col, batch, heldout.alias("held"), F.posexplode(F.col(vector).cast("array<double>")).alias("dim", "x"))
    train = long.filter(~F.col("held"))
    means = train.groupBy(batch, "dim").agg(F.avg("x").alias("bm")).join(train.groupBy("dim").agg(F.avg("x").alias("gm")), "dim")
    return long.join(bounded(means), [batch, "dim"]).select(id_col, "dim", (F.col("x") + F.col("gm") - F.col("bm")).alias("value"))


def soft_assignment(df: DataFrame, centers: DataFrame, id_col: str = "id", vector: str = "v", center_col: str = "center") -> DataFrame:
    """id, cluster, q, p: Student-t similarities 1 / (1 + d^2) normalised by row, and the sharpened target q^2 / sum of q over rows, normalised by row. centers (cluster, center) is a small table."""
    pairs = df.select(F.col(id_col).alias("id"), F.col(vector).cast("array<double>").alias("v")).crossJoin(bounded(centers, must=True))
    d2 = F.aggregate(F.zip_with("v", center_col, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    raw = pairs.select("id", "cluster", (1 / (1 + d2)).alias("w"))
    row = Window.partitionBy("id")
    q = raw.withColumn("q", F.col("w") / F.sum("w").over(row)).drop("w")
    mass = q.groupBy("cluster").agg(F.sum("q").alias("mass"))
    p = q.join(bounded(mass), "cluster").withColumn("w", F.col("q") * F.col("q") / F.col("mass"))
    return p.select("id", "cluster", "q", (F.col("w") / F.sum("w").over(row)).alias("p"))


def centroids(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """cluster, center: means by label."""
    long = df.select(F.col(label).alias("cluster"), F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    by = long.groupBy("cluster", "i").agg(F.avg("x").alias("x"))
    return by.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("center"))


def centroid_geometry(a: DataFrame, b: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """n_pairs, pearson, spearman of the distances between class centroids in two representations; NULL for fewer than 3 classes."""

    def pairs(df: DataFrame, name: str) -> DataFrame:
        c = centroids(df, label, vector)
        x, y = c.select(F.col("cluster").alias("c1"), F.col("center").alias("x")), c.select(F.col("cluster").alias("c2"), F.col("center").alias("y"))
        d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
        return x.join(bounded(y, must=True), F.col("c1") < F.col("c2")).select("c1", "c2", d.alias(name))  # pairs of classes, not of rows

    def average_rank(c: str) -> Column:
        return F.rank().over(Window.orderBy(F.round(c, 9))) + (F.count("*").over(Window.partitionBy(F.round(c, 9))) - 1) / 2

    both = pairs(a, "da").join(pairs(b, "db"), ["c1", "c2"]).withColumn("ra", average_rank("da")).withColumn("rb", average_rank("db"))
    enough = F.count("*") >= 3
    return both.agg(F.count("*").alias("n_pairs"), F.when(enough, F.corr("da", "db")).alias("pearson"), F.when(enough, F.corr("ra", "rb")).alias("spearman"))


def separation(df: DataFrame, label: str, vector: str = "v") -> DataFrame:
    """cluster, n, radius (root mean square distance to the centroid), nearest other centroid, ratio of the two."""
    c = centroids(df, label, vector)
    far = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), "center", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t)
    radius = df.select(F.col(label).alias("cluster"), vector).join(bounded(c), "cluster").groupBy("cluster").agg(F.count("*").alias("n"), F.sqrt(F.avg(far)).alias("radius"))
    x, y = c.select("cluster", F.col("center").alias("x")), c.select(F.col("cluster").alias("c2"), F.col("center").alias("y"))
    d = F.sqrt(F.aggregate(F.zip_with("x", "y", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, t: s + t))
    near = x.join(bounded(y, must=True), F.col("cluster") != F.col("c2")).groupBy("cluster").agg(F.min(d).alias("nearest"))
    return radius.join(near, "cluster", "left").withColumn("ratio", F.col("nearest") / F.nullif(F.col("radius"), F.lit(0.0)))
