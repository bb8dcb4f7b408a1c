"""Sparse feature counts as (cell, gene, value) rows; a missing row is a zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simvane.operators.sizes import bounded


def normalize_log1p(coo: DataFrame, target: float = 1e4, cell: str = "cell", value: str = "value") -> DataFrame:
    """ln(1 + value * target / total of the cell); a cell whose total is 0 fails."""
    total = F.sum(value).over(Window.partitionBy(cell))
    scaled = F.when(total == 0, F.raise_error(F.lit("a cell has no counts"))).otherwise(F.log1p(F.col(value) * target / total))
    return coo.withColumn(value, scaled)


def gene_filter(coo: DataFrame, batches: DataFrame, min_cells: int, cell: str = "cell", gene: str = "gene", value: str = "value", batch: str = "batch") -> DataFrame:
    """gene, n_cells, n_batches of the genes found in at least min_cells cells and in every batch."""
    n = batches.agg(F.countDistinct(batch).alias("all_batches"))
    by = coo.filter(F.col(value) > 0).join(batches, cell).groupBy(gene).agg(F.countDistinct(cell).alias("n_cells"), F.countDistinct(batch).alias("n_batches"))
    return by.crossJoin(F.broadcast(n)).filter((F.col("n_cells") >= min_cells) & (F.col("n_batches") == F.col("all_batches"))).drop("all_batches")


def matrix_stats(coo: DataFrame, cells: DataFrame, n_genes: int, cell: str = "cell", value: str = "value", batch: str = "batch") -> DataFrame:
    """Of the whole matrix (batch NULL) and each batch: n_cells, nnz, negatives, zero_rows, zero_share, least and largest value with implicit zeros, and row sums' min, median and max."""
    rows = coo.groupBy(cell).agg(F.count_if(F.col(value) != 0).alias("nnz"), F.count_if(F.col(value) < 0).alias("negatives"), F.sum(value).alias("total"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    rows = cells.select(cell, batch).join(rows, cell, "left").fillna(0, ["nnz", "negatives"]).fillna(0.0, ["total", "lo", "hi"])
    out = rows.groupingSets([[], [batch]], batch).agg(
        F.count("*").alias("n_cells"),
        F.sum("nnz").alias("nnz"),
        F.sum("negatives").alias("negatives"),
        F.count_if(F.col("nnz") == 0).alias("zero_rows"),
        (1 - F.sum("nnz") / (F.count("*") * F.lit(n_genes))).alias("zero_share"),
        F.min(F.least(F.col("lo"), F.lit(0.0))).alias("least"),
        F.max(F.greatest(F.col("hi"), F.lit(0.0))).alias("largest"),
        F.min("total").alias("row_min"),
        F.percentile("total", 0.5).alias("row_median"),
        F.max("total").alias("row_max"),
    )
    return out


def marker_scores(coo: DataFrame, cells: DataFrame, panel: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "value", min_genes: int = 1) -> DataFrame:
    """cell, cls, score: mean over the class's found genes of the z-score (population sd over all cells, zeros included; a constant gene gives 0).

    A z-score is value / sd - mean / sd, so a cell's score is the sum over its own
    values of value / sd, less a constant of the class: absent rows are never made.
    """
    n = cells.agg(F.count("*").cast("double").alias("n_all"))
    x = F.col(value).cast("double")
    moments = coo.groupBy(gene).agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2")).crossJoin(F.broadcast(n))
    mean = F.col("s1") / F.col("n_all")
    sd = F.sqrt(F.greatest(F.col("s2") / F.col("n_all") - mean * mean, F.lit(0.0)))
    moments = moments.select(gene, mean.alias("mean"), sd.alias("sd"))
    found = panel.select("cls", gene).distinct().join(moments, gene)
    weights = found.withColumn("g", F.count("*").over(Window.partitionBy("cls"))).filter(F.col("g") >= min_genes)
    live = weights.filter(F.col("sd") > 1e-12)
    base = weights.groupBy("cls").agg(F.max("g").alias("g"), F.sum(F.when(F.col("sd") > 1e-12, F.col("mean") / F.col("sd")).otherwise(0.0)).alias("shift"))
    own = coo.join(live.select("cls", gene, "sd"), gene).groupBy(F.col(cell).alias("cell"), "cls").agg(F.sum(x / F.col("sd")).alias("up"))
    grid = cells.select(F.col(cell).alias("cell")).crossJoin(bounded(base, must=True))  # every cell has a score for each class of the panel
    return grid.join(own, ["cell", "cls"], "left").select("cell", "cls", ((F.coalesce("up", F.lit(0.0)) - F.col("shift")) / F.col("g")).alias("score"))


def neighbor_scores(scores: DataFrame, neighbors: DataFrame) -> DataFrame:
    """cell, cls, score: the mean score over a cell's neighbours (q, n), the cell itself left out."""
    return neighbors.select("q", "n").join(scores, F.col("n") == F.col("cell")).groupBy(F.col("q").alias("cell"), "cls").agg(F.avg("score").alias("score"))


def cluster_means(scores: DataFrame, clusters: DataFrame, cluster: str = "cluster", cell: str = "cell") -> DataFrame:
    """cluster, cls, n, score: the mean score of each class over the cells of each cluster."""
    return scores.join(clusters.select(F.col(cell).alias("cell"), F.col(cluster).cast("string").alias("cluster")), "cell").groupBy("cluster", "cls").agg(F.count("*").alias("n"), F.avg("score").alias("score"))


def macro_endpoint(by_class: DataFrame, metrics: Sequence[str], least_cells: int = 1) -> DataFrame:
    """n_classes, n_excluded and the mean of each metric over the classes with at least `least_cells` positive cells; no such class fails."""
    eligible = F.col("n_pos") >= least_cells
    checked = F.when(F.count_if(eligible) == 0, F.raise_error(F.lit("no class has enough cells")).cast("long")).otherwise(F.count_if(eligible))
    return by_class.agg(checked.alias("n_classes"), F.count_if(~eligible).alias("n_excluded"), *(F.avg(F.when(eligible, F.col(m))).alias(m) for m in metrics))


#: Width of the parts that the scores of one ranking are cut into, so that a ranking isn't one task's.
PART = 1 / 16


def auroc_ap(scores: DataFrame, positive: str = "positive", score: str = "score", by: Sequence[str] = (), part: float = PART) -> DataFrame:
    """by, n_pos, n_neg, auroc (average ranks for ties), ap (at distinct thresholds), ap_lift (ap / prevalence), contrast of means. NULL without both kinds.

    Running counts come in two levels: over parts of the score's range of the width `part`,
    and inside each part.
    """
    by = list(by)
    levels = scores.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(positive).alias("p"), F.count("*").alias("n")).withColumn("part", F.floor(F.col("s") / part))
    parts = levels.groupBy(*by, "part").agg(F.sum("n").alias("n_part"), F.sum("p").alias("p_part"))
    outer = Window.partitionBy(*by).orderBy("part")
    below, above = outer.rowsBetween(Window.unboundedPreceding, -1), outer.rowsBetween(1, Window.unboundedFollowing)
    parts = parts.select(*by, "part", F.coalesce(F.sum("n_part").over(below), F.lit(0)).alias("n_below"), F.coalesce(F.sum("n_part").over(above), F.lit(0)).alias("n_above"), F.coalesce(F.sum("p_part").over(above), F.lit(0)).alias("p_above"))
    levels = levels.join(parts, [*by, "part"])
    inner = Window.partitionBy(*by, "part")
    up = inner.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    down = inner.orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    levels = levels.withColumn("rank", F.col("n_below") + F.coalesce(F.sum("n").over(up), F.lit(0)) + (F.col("n") + 1) / 2)
    levels = levels.withColumn("precision", (F.col("p_above") + F.sum("p").over(down)) / (F.col("n_above") + F.sum("n").over(down)))
    n1, n0 = F.sum("p"), F.sum(F.col("n") - F.col("p"))
    both = (n1 > 0) & (n0 > 0)
    ap = F.sum(F.col("p") * F.col("precision")) / n1
    return levels.groupBy(*by).agg(
        n1.alias("n_pos"),
        n0.alias("n_neg"),
        F.when(both, (F.sum(F.col("p") * F.col("rank")) - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"),
        F.when(both, ap).alias("ap"),
        F.when(both, ap * (n1 + n0) / n1).alias("ap_lift"),
        F.when(both, F.sum(F.col("p") * F.col("s")) / n1 - F.sum((F.col("n") - F.col("p")) * F.col("s")) / n0).alias("contrast"),
    )


def crossfit_signatures(coo: DataFrame, cells: DataFrame, top: int = 10, cell: str = "cell", gene: str = "gene", value: str = "value", label: str = "label", fold: str = "fold") -> DataFrame:
    """fold, label, gene, rank, diff: the genes of highest class mean less the mean of the rest, on the rows outside the fold; means count absent rows as zeros."""
    folds = cells.select(F.col(fold).alias("test_fold")).distinct()
    train = cells.select(cell, F.col(label).alias("label"), F.col(fold).alias("own")).join(bounded(folds, must=True), F.col("own") != F.col("test_fold"))
    sizes = train.groupBy("test_fold", "label").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("test_fold")))
    sums = coo.join(train, cell).groupBy("test_fold", "label", gene).agg(F.sum(F.col(value).cast("double")).alias("s"))
    sums = sums.withColumn("all_s", F.sum("s").over(Window.partitionBy("test_fold", gene)))
    diff = F.col("s") / F.col("n") - (F.col("all_s") - F.col("s")) / F.nullif(F.col("total") - F.col("n"), F.lit(0))
    ranked = sums.join(bounded(sizes), ["test_fold", "label"]).withColumn("diff", F.round(diff, 9))
    w = Window.partitionBy("test_fold", "label").orderBy(F.desc("diff"), gene)
    return ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(F.col("test_fold").alias("fold"), "label", gene, "rank", "diff")


def rank_fusion(ranks: DataFrame, top: int, gene: str = "gene", batch: str = "batch", rank: str = "rank") -> DataFrame:
    """gene, freq, mean_rank, position: by (freq desc, mean rank, gene)."""
    by = ranks.groupBy(gene).agg(F.countDistinct(batch).alias("freq"), F.avg(rank).alias("mean_rank"))
    ordered = by.orderBy(F.desc("freq"), "mean_rank", gene).limit(top)
    return ordered.withColumn("position", F.row_number().over(Window.orderBy(F.desc("freq"), "mean_rank", gene)))


def variance_ranks(coo: DataFrame, cells: DataFrame, top: int, cell: str = "cell", gene: str = "gene", value: str = "value", batch: str = "batch") -> DataFrame:
    """batch, gene, variance, rank: the `top` genes of each batch by population variance with implicit zeros, ties by gene."""
    n = cells.groupBy(batch).agg(F.count("*").cast("double").alias("n"))
    x = F.col(value).cast("double")
    by = coo.join(cells.select(cell, batch), cell).groupBy(batch, gene).agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2")).join(bounded(n), batch)
    by = by.withColumn("variance", F.round(F.col("s2") / F.col("n") - F.pow(F.col("s1") / F.col("n"), 2), 9))
    w = Window.partitionBy(batch).orderBy(F.desc("variance"), gene)
    return by.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select(batch, gene, "variance", "rank")


def welch_t(coo: DataFrame, cells: DataFrame, cell: str = "cell", gene: str = "gene", value: str = "value", cluster: str = "cluster") -> DataFrame:
    """cluster, gene, t: Welch's statistic of a cluster against the rest, absent rows as zeros."""
    n = cells.groupBy(cluster).agg(F.count("*").cast("double").alias("n")).withColumn("all_n", F.sum("n").over(Window.partitionBy()))
    x = F.col(value).cast("double")
    sums = coo.join(cells.select(cell, cluster), cell).groupBy(cluster, gene).agg(F.sum(x).alias("s1"), F.sum(x * x).alias("s2"))
    whole = Window.partitionBy(gene)
    sums = sums.withColumn("t1", F.sum("s1").over(whole)).withColumn("t2", F.sum("s2").over(whole)).join(bounded(n), cluster)

    def moments(s1, s2, n):
        mean = s1 / n
        return mean, F.greatest(s2 - n * mean * mean, F.lit(0.0)) / F.nullif(n - 1, F.lit(0.0))

    m1, v1 = moments(F.col("s1"), F.col("s2"), F.col("n"))
    rest = F.col("all_n") - F.col("n")
    m0, v0 = moments(F.col("t1") - F.col("s1"), F.col("t2") - F.col("s2"), F.nullif(rest, F.lit(0.0)))
    return sums.select(cluster, gene, ((m1 - m0) / F.sqrt(F.nullif(v1 / F.col("n") + v0 / rest, F.lit(0.0)))).alias("t"))


def marker_status(t: DataFrame, markers: DataFrame, cluster: str = "cluster", gene: str = "gene") -> DataFrame:
    """cls, gene, best cluster, rank of the gene there and its status: Preserved (first 10), High (50), Moderate (200), Lost, Not detected."""
    known = t.filter(F.col("t").isNotNull()).withColumn("t", F.round("t", 9))
    place = known.withColumn("rank", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc("t"), gene)))
    best = place.groupBy(gene).agg(F.min_by(F.struct(cluster, "rank"), F.struct((-F.col("t")).alias("m"), cluster)).alias("b"))
    out = markers.join(best, gene, "left").select("cls", gene, F.col(f"b.{cluster}").alias("best_cluster"), F.col("b.rank").alias("rank"))
    status = F.when(F.col("rank").isNull(), "Not detected").when(F.col("rank") <= 10, "Preserved").when(F.col("rank") <= 50, "High").when(F.col("rank") <= 200, "Moderate").otherwise("Lost")
    return out.withColumn("status", status)
