"""Exact nearest neighbours: self-joins with deterministic ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from simvane.operators import blocks as B


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1.0, size)


def exact_neighbors(df: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "v", metric: str = "euclidean", within: str | None = None, queries: DataFrame | None = None, order: str | None = None, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """q, n, rank (from 1), d: the k nearest rows of df other than the row itself, ordered by (d, id).

    metric: euclidean or cosine (1 - cosine similarity). within: a column; the k nearest
    of each of its values are kept, with the column in the result as `part`. queries: rows
    to search for; all of df if not given. Ties at the cut are resolved by id like all
    others, or by the column `order` where ids stand in a list of their own. k must be above
    0 and below the number of rows (of df; for queries from elsewhere it may equal it).
    Vectors that are null, of several lengths or not finite are errors.
    """
    n_data = df.count()
    n_queries = n_data if queries is None else queries.count()
    if not 0 < k < n_data + (queries is not None):
        raise ValueError(f"k must be above 0 and below the number of rows, {n_data}")
    if metric not in ("euclidean", "cosine"):
        raise ValueError(f"unknown metric {metric}")
    part = F.col(within) if within else F.lit(0)
    data = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), part.cast("string").alias("part"), F.col(order or id_col).alias("at"))
    asked = data if queries is None else queries.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.lit("").alias("part"), F.lit(None).cast(df.schema[order or id_col].dataType).alias("at"))
    kind, at_kind = df.schema[id_col].dataType, df.schema[order or id_col].dataType.simpleString()
    at_type = to_arrow_type(df.schema[order or id_col].dataType)
    arrow = pa.string() if kind.simpleString() == "string" else pa.int64()
    if arrow == pa.int64():
        data, asked = (x.withColumn("id", F.col("id").cast("long")) for x in (data, asked))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"q": [], "n": [], "part": [], "d": [], "at": []}
        if left.num_rows and right.num_rows:
            a, b = B.matrix(left.column("v")), B.matrix(right.column("v"))
            if metric == "cosine":
                a, b = _unit(a), _unit(b)
            qid = np.asarray(left.column("id").to_pylist())
            nid, parts = np.asarray(right.column("id").to_pylist()), np.asarray(right.column("part").to_pylist(), dtype=object)
            place = right.column("at").combine_chunks()
            sorted_ = np.argsort(np.asarray(place.to_pylist()), kind="stable")
            nid, parts, b, place = nid[sorted_], parts[sorted_].astype(str), b[sorted_], place.take(pa.array(sorted_))
            d2 = B.square_distances(a, b)
            slack = 1e-9 * (1.0 + (a * a).sum(1).max() + (b * b).sum(1).max())
            for p in np.unique(parts):
                mine = np.flatnonzero(parts == p)
                rows = np.where(nid[mine][None, :] == qid[:, None], np.inf, d2[:, mine])
                last = min(k, len(mine)) - 1
                cuts = np.partition(rows, last, axis=1)[:, last]
                for i, (row, cut) in enumerate(zip(rows, cuts, strict=True)):
                    near = mine[np.flatnonzero((row <= cut + slack) & np.isfinite(row))]
                    d = B.exact_distance(a[i], b[near])
                    if metric == "cosine":
                        d = d * d / 2.0
                    best = np.lexsort((near, d))[:k]
                    out["q"] += [qid[i]] * len(best)
                    out["n"] += nid[near[best]].tolist()
                    out["at"] += place.take(pa.array(near[best])).to_pylist()
                    out["part"] += [p] * len(best)
                    out["d"] += d[best].tolist()
        return pa.table({"q": pa.array(out["q"], arrow), "n": pa.array(out["n"], arrow), "part": pa.array(out["part"], pa.string()), "d": pa.array(out["d"], pa.float64()), "at": pa.array(out["at"], at_type)})

    name = "string" if arrow == pa.string() else "long"
    best = B.pair_blocks(asked, data, kernel, f"q {name}, n {name}, part string, d double, at {at_kind}", block_rows=block_rows, rows=(n_queries, n_data))
    rank = F.row_number().over(Window.partitionBy("q", "part").orderBy("d", "at", "n"))
    out = best.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select("q", "n", "rank", "d", *(["part"] if within else []))


def mutual_neighbors(a: DataFrame, b: DataFrame, k: int, **options) -> DataFrame:
    """a_id, b_id: pairs of which each is among the other's k nearest across the two sides (ids must differ between sides)."""
    ab = exact_neighbors(b, k, queries=a, **options).select(F.col("q").alias("a_id"), F.col("n").alias("b_id"))
    ba = exact_neighbors(a, k, queries=b, **options).select(F.col("n").alias("a_id"), F.col("q").alias("b_id"))
    return ab.join(ba, ["a_id", "b_id"])


def remove_self(neighbors: DataFrame, k: int, query: str = "q", listed: str = "neighbors") -> DataFrame:
    """The first k of each list of neighbour ids without the query's own id."""
    return neighbors.withColumn(listed, F.slice(F.filter(listed, lambda x: x != F.col(query)), 1, k))


def label_sums(df: DataFrame, *, id_col: str = "id", vector_col: str = "v", label_col: str = "label", queries: DataFrame | None = None, block_rows: int = B.BLOCK_ROWS) -> DataFrame:
    """q, label, n, total: number of other rows of each label and the sum of their distances from q."""
    data = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    asked = data if queries is None else queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "label": pa.array([], pa.string()), "n": pa.array([], pa.int64()), "total": pa.array([], pa.float64())})
        a, b = B.matrix(left.column("v")), B.matrix(right.column("v"))
        qid, nid = left.column("id").to_numpy(), right.column("id").to_numpy()
        names, code = np.unique(np.asarray(right.column("label").to_pylist(), dtype=str), return_inverse=True)
        one = np.zeros((len(code), len(names)))
        one[np.arange(len(code)), code] = 1
        total, n = np.zeros((len(qid), len(names))), np.zeros((len(qid), len(names)))
        for lo in range(0, len(qid), 512):
            d = np.sqrt(B.square_distances(a[lo : lo + 512], b))
            own = qid[lo : lo + 512, None] == nid[None, :]
            d[own] = 0.0
            total[lo : lo + 512], n[lo : lo + 512] = d @ one, (~own) @ one
        q, c = np.nonzero(n)
        return pa.table({"q": qid[q], "label": names[c], "n": n[q, c].astype(np.int64), "total": total[q, c]})

    part = B.pair_blocks(asked, data, kernel, "q long, label string, n long, total double", block_rows=block_rows)
    return part.groupBy("q", "label").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
