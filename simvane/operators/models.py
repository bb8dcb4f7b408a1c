"""Matrix and graph operators: scaling, PCA, k-means, affinities, label propagation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaled(df: DataFrame, id_col: str = "id", vector: str = "v", clip: float = 10.0) -> DataFrame:
    """id, v: each dimension centred and divided by its sample sd (1 if that is 0), clipped above. Two numbers a dimension are summed up and sent back; vectors stay where they are."""
    x = F.col(vector).cast("array<double>")
    by = df.select(F.posexplode(x).alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    one = by.agg(F.array_sort(F.collect_list(F.struct("i", "m", F.coalesce(F.nullif("s", F.lit(0.0)), F.lit(1.0)).alias("s")))).alias("by"))
    return df.select(id_col, x.alias(vector)).crossJoin(F.broadcast(one)).select(id_col, F.zip_with(vector, "by", lambda a, t: F.least(F.lit(clip), (a - t["m"]) / t["s"])).alias(vector))


def principal_components(df: DataFrame, n: int, id_col: str = "id", vector: str = "v") -> DataFrame:
    """id, v: scores on the first n components of the centred vectors; a component's largest loading is positive."""
    x = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("x_"))
    model = PCA(k=n, inputCol="x_", outputCol="p_").fit(x)
    loadings = model.pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(n)])
    scores = model.transform(x).select(id_col, vector_to_array("p_").alias("p"))
    mean = scores.select(*[F.avg(F.get("p", F.lit(i))).alias(f"m{i}") for i in range(n)]).first()
    parts = [(F.get("p", F.lit(i)) - float(mean[i] or 0.0)) * float(sign[i]) for i in range(n)]
    return scores.select(id_col, F.array(*parts).alias(vector))


def kmeans(df: DataFrame, k: int, seed: int = 0, id_col: str = "id", vector: str = "v") -> DataFrame:
    """id, cluster."""
    x = df.select(id_col, array_to_vector(F.col(vector).cast("array<double>")).alias("x_"))
    return KMeans(k=k, seed=seed, featuresCol="x_", predictionCol="cluster", maxIter=50).fit(x).transform(x).select(id_col, "cluster")


def smooth_weights(d: np.ndarray, overall: float, steps: int = 64) -> np.ndarray:
    """Weights exp(-(d - nearest) / scale) of rows of k distances each, nearest being the smallest above 0; the scales are found by halving until the weights of a row add up to log2(k + 1), as the row itself counts as a neighbour at distance 0. A scale is a thousandth at least of the mean distance of its row, with the row itself, or of all rows (`overall`) where all of its distances are 0."""
    k = d.shape[1]
    nearest = np.where(d > 0, d, np.inf).min(axis=1)
    nearest[~np.isfinite(nearest)] = 0.0
    gap = np.maximum(0.0, d - nearest[:, None])
    lo, hi, mid = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d))
    goal, open_ = np.log2(k + 1), np.ones(len(d), bool)
    for _ in range(steps):
        total = np.exp(-gap / mid[:, None]).sum(axis=1)
        open_ &= np.abs(total - goal) >= 1e-5
        if not open_.any():
            break
        above, below = open_ & (total > goal), open_ & (total <= goal)
        hi[above] = mid[above]
        lo[below] = mid[below]
        with np.errstate(invalid="ignore"):
            mid = np.where(above, (lo + hi) / 2, np.where(below, np.where(np.isinf(hi), mid * 2, (lo + hi) / 2), mid))
    least = 1e-3 * np.where(nearest > 0, d.sum(axis=1) / (k + 1), overall)
    scale = np.maximum(mid, least)
    return np.where(gap > 0, np.exp(-gap / np.where(scale > 0, scale, 1.0)[:, None]), 1.0)


def fuzzy_affinity(neighbors: DataFrame, steps: int = 64) -> DataFrame:
    """a, b, w (a < b): the weights of `smooth_weights` for each row's neighbours, joined over both directions as x + y - x * y."""
    lists = neighbors.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "n", "d"))).alias("near"))
    kind = neighbors.schema["q"].dataType.simpleString()
    lists = lists.select("q", F.transform("near", lambda x: x["n"]).alias("n"), F.transform("near", lambda x: x["d"]).alias("d"))
    per_row = neighbors.groupBy("q").agg(F.sum("d").alias("s"), F.count("*").alias("k"))
    overall = float(per_row.agg(F.sum("s") / F.sum(F.col("k") + 1)).first()[0] or 0.0)

    def weigh(batches):
        for b in batches:
            held = b.column(2)
            sizes = np.diff(held.offsets.to_numpy())
            flat = held.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            out = np.empty(len(flat))
            for k in np.unique(sizes[sizes > 0]).tolist():
                at = starts[:-1][sizes == k][:, None] + np.arange(k)
                out[at] = smooth_weights(flat[at], overall, steps)
            weights = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(out))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), weights], names=["q", "n", "w"])

    made = lists.mapInArrow(weigh, f"q {kind}, n array<{kind}>, w array<double>")
    edges = made.select("q", F.explode(F.arrays_zip("n", "w")).alias("e")).select("q", F.col("e.n").alias("n"), F.col("e.w").alias("w"))
    both = edges.select(F.least("q", "n").alias("a"), F.greatest("q", "n").alias("b"), F.when(F.col("q") < F.col("n"), F.col("w")).alias("x"), F.when(F.col("q") > F.col("n"), F.col("w")).alias("y"))
    one = both.groupBy("a", "b").agg(F.coalesce(F.max("x"), F.lit(0.0)).alias("x"), F.coalesce(F.max("y"), F.lit(0.0)).alias("y"))
    return one.select("a", "b", (F.col("x") + F.col("y") - F.col("x") * F.col("y")).alias("w"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """node, cluster: each node takes the label of most weight among its neighbours (the smallest of equals), all at once, `rounds` times; the label of a node is at first its own id. A deterministic stand-in for modularity clustering."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    labels = both.select(F.col("a").alias("node")).distinct().withColumn("cluster", F.col("node"))
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("node").alias("b"), "cluster"), "b").groupBy("a", "cluster").agg(F.round(F.sum("w"), 9).alias("w"))
        best = votes.groupBy("a").agg(F.min_by("cluster", F.struct((-F.col("w")).alias("m"), F.col("cluster"))).alias("cluster"))
        labels = best.select(F.col("a").alias("node"), "cluster").checkpoint()
    return labels


def modularity_grid(edges: DataFrame, resolutions: Sequence[float], seeds: Sequence[int], rounds: int = 6, levels: int = 2) -> DataFrame:
    """resolution, seed, node, cluster: a partition of high modularity for each setting of a grid, all settings at once.

    Rounds of local moving: a node goes to the neighbouring cluster of the largest gain
    w(node, cluster) - resolution * strength(node) * strength(cluster) / total strength, its own
    one and then the smallest of equals; in each round a half of the nodes moves, drawn by a hash
    of node, seed and round. Then clusters become nodes and move in the same way, `levels` times
    in all. edges: a, b, w, each pair once. The grid is a small table; call sinks.checkpoint_folder first.
    """
    spark, key = edges.sparkSession, ["resolution", "seed"]
    settings = spark.createDataFrame([(float(r), int(s)) for r in resolutions for s in seeds], "resolution double, seed long")
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    graph = both.crossJoin(F.broadcast(settings)).checkpoint()
    total = float(both.agg(F.sum("w")).first()[0] or 0.0)
    labels = graph.groupBy(*key, F.col("a").alias("node")).agg(F.sum("w").alias("k")).withColumn("cluster", F.col("node")).checkpoint()
    members = labels.select(*key, "node", "cluster")
    for level in range(levels):
        for r in range(rounds):
            mass = labels.groupBy(*key, "cluster").agg(F.sum("k").alias("mass"))
            near = graph.filter("a <> b").join(labels.select(*key, F.col("node").alias("b"), "cluster"), [*key, "b"]).select(*key, F.col("a").alias("node"), "cluster", "w")
            votes = near.unionByName(labels.select(*key, "node", "cluster", F.lit(0.0).alias("w"))).groupBy(*key, "node", "cluster").agg(F.sum("w").alias("w"))
            own = F.col("cluster") == F.col("own")
            ranked = votes.join(mass, [*key, "cluster"]).join(labels.select(*key, "node", "k", F.col("cluster").alias("own")), [*key, "node"])
            gain = F.col("w") - F.col("resolution") * F.col("k") * (F.col("mass") - F.when(own, F.col("k")).otherwise(0.0)) / total
            best = F.min_by("cluster", F.struct((-F.round(gain, 9)).alias("g"), (~own).alias("o"), F.col("cluster")))
            moves = F.pmod(F.xxhash64("node", "seed", F.lit(level), F.lit(r)), F.lit(2)) == 0
            chosen = ranked.groupBy(*key, "node", "k", "own").agg(best.alias("best"))
            labels = chosen.select(*key, "node", "k", F.when(moves, F.col("best")).otherwise(F.col("own")).alias("cluster")).checkpoint()
        members = members.select(*key, F.col("node").alias("first"), F.col("cluster").alias("node")).join(labels.select(*key, "node", "cluster"), [*key, "node"]).select(*key, F.col("first").alias("node"), "cluster").checkpoint()
        if level + 1 < levels:
            of = labels.select(*key, "node", "cluster")
            graph = graph.join(of.withColumnRenamed("node", "a").withColumnRenamed("cluster", "x"), [*key, "a"]).join(of.withColumnRenamed("node", "b").withColumnRenamed("cluster", "y"), [*key, "b"])
            graph = graph.groupBy(*key, F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")).checkpoint()
            labels = labels.groupBy(*key, F.col("cluster").alias("node")).agg(F.sum("k").alias("k")).withColumn("cluster", F.col("node"))
    return members


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """resolution, seed, n_clusters, modularity of partitions of `modularity_grid`."""
    key = ["resolution", "seed"]
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    of = members.select(*key, "node", "cluster")
    ends = both.join(of.withColumnRenamed("node", "a").withColumnRenamed("cluster", "x"), "a").join(of.withColumnRenamed("node", "b").withColumnRenamed("cluster", "y"), [*key, "b"])
    by = ends.groupBy(*key, F.col("x").alias("cluster")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("x") == F.col("y"), F.col("w")).otherwise(0.0)).alias("inner"))
    out = by.groupBy(*key).agg(F.count("*").alias("n_clusters"), F.sum("inner").alias("inner"), F.sum("k").alias("total"), F.sum(F.col("k") * F.col("k")).alias("squares"))
    return out.select(*key, "n_clusters", (F.col("inner") / F.col("total") - F.col("resolution") * F.col("squares") / F.col("total") / F.col("total")).alias("modularity"))


def majority_refinement(labels: DataFrame, neighbors: DataFrame) -> DataFrame:
    """node, cluster: a node whose label less than half of its neighbours share takes their most frequent one (the smallest of equals)."""
    of = labels.select(F.col("node").alias("n"), F.col("cluster").alias("other"))
    votes = neighbors.select("q", "n").join(of, "n").groupBy("q", "other").agg(F.count("*").alias("c"))
    total = Window.partitionBy("q")
    best = votes.withColumn("all", F.sum("c").over(total)).groupBy("q", "all").agg(F.min_by("other", F.struct((-F.col("c")).alias("m"), F.col("other"))).alias("top"), F.max("c").alias("top_c"), F.map_from_entries(F.collect_list(F.struct("other", "c"))).alias("by"))
    joined = labels.join(best, F.col("node") == F.col("q"), "left")
    own = F.coalesce(F.try_element_at("by", F.col("cluster")), F.lit(0))
    change = (own * 2 < F.col("all")) & (F.col("top_c") * 2 > F.col("all"))
    return joined.select("node", F.when(F.coalesce(change, F.lit(False)), F.col("top")).otherwise(F.col("cluster")).alias("cluster"))
