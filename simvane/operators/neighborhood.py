"""Metrics on neighbour tables (q, n, rank, d)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simvane.operators.sizes import bounded


def with_labels(neighbors: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """neighbors with the label of the query (q_label) and of the neighbour (n_label)."""
    of = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("x"))
    out = neighbors.join(of.select(F.col("i").alias("q"), F.col("x").alias("q_label")), "q")
    return out.join(of.select(F.col("i").alias("n"), F.col("x").alias("n_label")), "n")


def purity(neighbors: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """q, q_label, purity: share of the neighbours that have the query's label."""
    return with_labels(neighbors, labels, id_col, label_col).groupBy("q", "q_label").agg(F.avg((F.col("q_label") == F.col("n_label")).cast("double")).alias("purity"))


def overlap(before: DataFrame, after: DataFrame) -> DataFrame:
    """q, jaccard: neighbours in both tables over neighbours in either."""
    lists = [t.groupBy("q").agg(F.collect_set("n").alias(c)) for t, c in ((before, "a"), (after, "b"))]
    both = lists[0].join(lists[1], "q")
    return both.select("q", (F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))).alias("jaccard"))


def inverse_simpson(neighbors: DataFrame, batches: DataFrame, id_col: str = "id", batch_col: str = "batch") -> DataFrame:
    """q, d_batch: 1 / sum of squared batch shares among the query itself and its neighbours."""
    of = batches.select(F.col(id_col).alias("n"), F.col(batch_col).alias("batch"))
    own = batches.select(F.col(id_col).alias("q"), F.col(batch_col).alias("batch"))
    members = neighbors.select("q", "n").join(of, "n").select("q", "batch").unionByName(own)
    counts = members.groupBy("q", "batch").agg(F.count("*").alias("c"))
    return counts.groupBy("q").agg((F.sum("c") * F.sum("c") / F.sum(F.col("c") * F.col("c"))).alias("d_batch"))


def median_radius(neighbors: DataFrame, k: int) -> DataFrame:
    """Median over rows of the distance to the k-th neighbour."""
    return neighbors.filter(F.col("rank") == k).agg(F.percentile("d", 0.5).alias("median_radius"))


def ilisi(neighbors: DataFrame, batches: DataFrame, perplexity: float = 30.0, id_col: str = "id", batch_col: str = "batch") -> DataFrame:
    """q, lisi: inverse Simpson index of the batches of the neighbours, weighted so that the weights' entropy is log(perplexity)."""
    of = batches.select(F.col(id_col).alias("n"), F.col(batch_col).cast("string").alias("batch"))
    lists = neighbors.join(of, "n").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "d", "batch"))).alias("near"))
    lists = lists.select("q", F.transform("near", lambda x: x["d"]).alias("d"), F.transform("near", lambda x: x["batch"]).alias("batch"))
    kind = lists.schema["q"].dataType.simpleString()

    def solve(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            sizes = np.diff(b.column(1).offsets.to_numpy())
            d, names = b.column(1).flatten().to_numpy(zero_copy_only=False), np.asarray(b.column(2).flatten().to_pylist(), str)
            starts, out = np.concatenate(([0], np.cumsum(sizes))), np.full(len(sizes), np.nan)
            _, code = np.unique(names, return_inverse=True)
            for k in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == k)
                at = starts[rows][:, None] + np.arange(k)
                share = np.zeros((len(rows), int(code.max()) + 1))
                np.add.at(share, (np.arange(len(rows))[:, None], code[at]), perplexity_weights(d[at], perplexity))
                out[rows] = 1.0 / (share * share).sum(axis=1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, from_pandas=True)], names=["q", "lisi"])

    return lists.mapInArrow(solve, f"q {kind}, lisi double")


def perplexity_weights(d: np.ndarray, perplexity: float, tolerance: float = 1e-5, steps: int = 100) -> np.ndarray:
    """Weights of rows of distances, proportional to exp(-beta * d); the betas are found by halving until the entropy of a row's weights is log(perplexity)."""
    lo, hi, beta, goal = np.zeros(len(d)), np.full(len(d), np.inf), np.ones(len(d)), np.log(perplexity)
    gap, open_ = d - d.min(axis=1, keepdims=True), np.ones(len(d), bool)
    for _ in range(steps):
        w = np.exp(-beta[:, None] * gap)
        w /= w.sum(axis=1, keepdims=True)
        entropy = -(w * np.log(np.maximum(w, 1e-300))).sum(axis=1)
        open_ &= np.abs(entropy - goal) >= tolerance
        if not open_.any():
            break
        above, below = open_ & (entropy > goal), open_ & (entropy <= goal)
        lo[above], hi[below] = beta[above], beta[below]
        with np.errstate(invalid="ignore"):
            beta = np.where(above, np.where(np.isinf(hi), beta * 2, (beta + hi) / 2), np.where(below, (beta + lo) / 2, beta))
    return w


def scaled_median(per_row: DataFrame, n_batches: int, value: str = "lisi") -> DataFrame:
    """(median - 1) / (batches - 1); NULL with a status for a single batch."""
    median = F.percentile(value, 0.5)
    score = (median - 1) / (n_batches - 1) if n_batches > 1 else F.lit(None).cast("double")
    return per_row.agg(score.alias("score"), F.lit("ok" if n_batches > 1 else "not_applicable").alias("status"))


def silhouette(sums: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """q, label, s from label_sums: (b - a) / max(a, b); NULL for a row alone in its label, 0 where max is 0."""
    own = labels.select(F.col(id_col).alias("q"), F.col(label_col).cast("string").alias("own"))
    mean = F.col("total") / F.col("n")
    by = sums.join(own, "q").groupBy("q", "own").agg(F.max(F.when(F.col("label") == F.col("own"), mean)).alias("a"), F.min(F.when(F.col("label") != F.col("own"), mean)).alias("b"))
    top = F.greatest("a", "b")
    s = F.when(F.col("a").isNull() | F.col("b").isNull(), None).when(top == 0, 0.0).otherwise((F.col("b") - F.col("a")) / top)
    return by.select("q", F.col("own").alias("label"), s.alias("s"))


def silhouette_summary(per_row: DataFrame) -> DataFrame:
    return per_row.agg(F.avg("s").alias("mean_s"), F.percentile("s", 0.5).alias("median_s"), F.avg((F.col("s") < 0).cast("double")).alias("negative_share"), F.count("s").alias("n"))


def isolated_asw(per_row: DataFrame, batches: DataFrame, threshold: int, id_col: str = "id", batch_col: str = "batch") -> DataFrame:
    """Mean over the labels found in at most `threshold` batches of their mean (s + 1) / 2; NULL if there are none."""
    of = batches.select(F.col(id_col).alias("q"), F.col(batch_col).alias("batch"))
    by = per_row.join(of, "q").groupBy("label").agg(F.countDistinct("batch").alias("n_batches"), F.avg((F.col("s") + 1) / 2).alias("w"))
    return by.filter(F.col("n_batches") <= threshold).agg(F.avg("w").alias("isolated_asw"), F.count("*").alias("n_labels"))


def rare_recall(neighbors: DataFrame, labels: DataFrame, k: int, share: float, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """label, n, purity, recall and their ceilings for labels with at most `share` of the rows; recall NULL for a single row."""
    total = Window.partitionBy()
    sizes = labels.groupBy(F.col(label_col).alias("label")).agg(F.count("*").alias("n")).withColumn("rows", F.sum("n").over(total))
    rare = sizes.filter(F.col("n") <= share * F.col("rows"))
    near = with_labels(neighbors, labels, id_col, label_col).filter(F.col("rank") <= k)
    hits = near.join(bounded(rare.select(F.col("label").alias("q_label"))), "q_label", "left_semi").groupBy("q", "q_label").agg(F.count_if(F.col("q_label") == F.col("n_label")).alias("same"))
    by = hits.groupBy(F.col("q_label").alias("label")).agg(F.avg(F.col("same") / k).alias("purity"), F.avg("same").alias("same"))
    others = F.when(F.col("n") > 1, F.col("n") - 1)
    best = F.least(F.lit(k), F.col("n") - 1)
    return rare.join(by, "label", "left").select("label", "n", "purity", (best / k).alias("purity_ceiling"), (F.col("same") / others).alias("recall"), (best / others).alias("recall_ceiling"))
