"""Exact top-k search by inner product: a Voronoi kNN join.

Vectors are turned into integers, floor(scale * x). Pivots, vectors of the table
themselves, split the data into Voronoi cells by Euclidean distance, and each query
belongs to the pivot that it scores highest with. A cell is summed up by the k + 1
rows of different ids that score highest with its pivot and by a histogram of the
distances to the pivot. Scored against all summaries, a query gets a score that k
candidates reach for certain; a row x of the cell of pivot p can reach it only if
|x - p| >= (that score - q p) / |q|, by q x <= q p + |q| |x - p|. The least such
distance over a group of queries is the group's bound for that cell: rows nearer to
their pivot are not replicated to the group. A group is solved locally, block by block: a
block is a bounded number of queries against a bounded number of data rows, and
the k best of all blocks of a query are merged.

Groups are queries of pivots near to each other. Neighbouring ones are put together
as long as the histograms say that together they need fewer rows than apart: where
bounds prune nothing, GROUP_QUERIES queries share one copy of the rows; where cells
are far apart, groups stay small and get little more than their own cells.

Plan: equal rows are put together first; one pass finds dimension and length, one assigns cells, one
sums up, one replicates. Pivots (at most `pivots`), summaries (pivots * (k + 1) vectors),
histograms and group bounds (pivots * pivots numbers at most) are all that is collected
or broadcast. A cell with a third of all rows, such as one vector repeated, is spread
over as many blocks as it fills; a group's queries go to as many blocks as its rows fill.

Scores are exact: by floating point where all sums stay below 2^53, else by 64-bit
integers.

Defined results: vectors null, holding null or a non-finite component, of a length
other than the most frequent one in rows (the larger of two), empty, or with a product
with themselves beyond 64 bits after scaling take no part, nor do rows without an id;
the scores of all others fit 64 bits. Rows that share an id are one's own to each
other. Equal rows are one candidate; an id with several vectors is a candidate with
each score they give, and a query id with several vectors has the k best of them all.
Equal scores rank by the smaller id. With fewer
than k candidates all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simvane.llm.common import per_batch, shared_folder, stored

K_BEST = 10
SCALE = 1024
LARGEST = 2**63 - 1
PIVOTS = 64
GROUP_QUERIES = 1024
BLOCK_BYTES = 1 << 23
BINS = 64


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors held as bytes of 64-bit integers, as a matrix."""
    if not len(column):
        return np.zeros((0, 0), np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(len(column), -1)


def _fits(v: np.ndarray) -> bool:
    """Whether the product of v with itself, and so that of any two such vectors, is at most LARGEST."""
    norm2 = float(v @ v)
    return norm2 < LARGEST / 2 or norm2 < LARGEST * 2.0 and sum(int(x) ** 2 for x in v.tolist()) <= LARGEST


def quantised(vectors: DataFrame, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, dim, v (bytes of 64-bit integers) and norm2 of the vectors that can take part."""

    def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, dims, out, norms = [], [], [], []
        for i, x in zip(batch.column(0), batch.column(1), strict=True):
            if not i.is_valid or not x.is_valid or x.values.null_count or not len(x.values):
                continue
            v = np.floor(x.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
            if np.isfinite(v).all() and _fits(v):
                w = v.astype("<i8")
                ids.append(i.as_py())
                dims.append(len(w))
                out.append(w.tobytes())
                norms.append(float(v @ v))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary()), pa.array(norms, pa.float64())], names=["vec_id", "dim", "v", "norm2"])

    return vectors.select(F.col(id_col).cast("long"), F.col(vector_col).cast("array<double>")).mapInArrow(per_batch(turn), "vec_id long, dim int, v binary, norm2 double")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def chained(pivot: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest one left."""
    gap = _distances(pivot, pivot)
    order, left = [0], set(range(1, len(pivot)))
    while left:
        order.append(min(left, key=lambda j: (gap[order[-1], j], j)))
        left.remove(order[-1])
    return order


def grouped(order: list[int], queries: dict[int, int], needs: dict[int, np.ndarray], rows_for: Callable[[np.ndarray], int], most: int = GROUP_QUERIES) -> list[list[int]]:
    """Pivots with queries, dealt to groups: neighbours in `order` go together while their queries are no more than `most` and they need fewer rows together than apart."""
    groups: list[tuple[list[int], np.ndarray, int]] = []
    for g in (g for g in order if g in queries):
        need, rows = needs[g], rows_for(needs[g])
        if groups:
            held, before, had = groups[-1]
            both = np.minimum(before, need)
            together = rows_for(both)
            if sum(queries[x] for x in held) + queries[g] <= most and together < had + rows:
                groups[-1] = ([*held, g], both, together)
                continue
        groups.append(([g], need, rows))
    return [held for held, _, _ in groups]


def replicated(vectors: DataFrame, is_query: Column, k: int = K_BEST, scale: int = SCALE, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame | None, int, int]:
    """(g, qb, db, asks, vec_id, v: queries and the rows that their groups need, dealt to blocks; rows that take part; dimension); None for the first without queries."""
    spark = vectors.sparkSession
    folder = shared_folder(spark)
    different = quantised(vectors, scale, id_col, vector_col).groupBy("vec_id", "dim", "v").agg(F.first("norm2").alias("norm2"), F.count("*").alias("copies"))
    rows = stored(different, f"{folder}/vectors")
    shape = rows.groupBy("dim").agg(F.sum("copies").alias("in_rows"), F.count("*").alias("n"), F.max("norm2").alias("top")).orderBy(F.desc("in_rows"), F.desc("dim")).first()
    if shape is None:
        return None, 0, 0
    rows, top, dim, n_rows = rows.filter(F.col("dim") == shape["dim"]), shape["top"], int(shape["dim"]), int(shape["n"])
    flagged = rows.withColumn("is_query", is_query)
    if flagged.filter("is_query").limit(1).count() == 0:
        return None, n_rows, dim

    # a few more than needed, as some may be equal; no shuffle of vectors
    sample = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(4 * pivots).collect()
    pivot = _matrix(pa.array(list(dict.fromkeys(bytes(r["v"]) for r in sample))[:pivots], pa.binary())).astype(np.float64)
    n_pivots = len(pivot)
    longest = np.sqrt(top)

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = _matrix(batch.column(1)).astype(np.float64)
        d, score = _distances(m, pivot), m @ pivot.T
        cell, near, at = d.argmin(1), score.argmax(1), np.arange(len(m))
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(cell.astype(np.int32)), pa.array(d[at, cell]), pa.array(score[at, cell]), pa.array(near.astype(np.int32))], names=["vec_id", "v", "is_query", "cell", "d", "along", "near"])

    assigned = flagged.select("vec_id", "v", "is_query").mapInArrow(per_batch(assign), "vec_id long, v binary, is_query boolean, cell int, d double, along double, near int")
    assigned = stored(assigned, f"{folder}/assigned")

    # summaries: of each cell the k + 1 rows of different ids that score highest with its pivot, and how far its rows are
    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for b in batches:
            held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            cell, along, ids = (held.column(i).to_numpy() for i in range(3))
            order = np.lexsort((ids, -along, cell))
            _, first = np.unique(np.column_stack((cell[order], ids[order])), axis=0, return_index=True)
            order = order[np.sort(first)]
            rank = np.arange(len(order)) - np.searchsorted(cell[order], cell[order], "left")
            held = held.take(pa.array(order[rank <= k])).combine_chunks()
        if held is not None:
            yield from held.to_batches()

    best_of = assigned.select("cell", "along", "vec_id", "v").mapInArrow(highest, "cell int, along double, vec_id long, v binary").groupBy("cell", "vec_id").agg(F.max("along").alias("along"), F.max_by("v", "along").alias("v"))
    nth = F.row_number().over(Window.partitionBy("cell").orderBy(F.desc("along"), "vec_id"))
    found = best_of.withColumn("nth", nth).filter(F.col("nth") <= k + 1).select("vec_id", "v").collect()
    summary = list({r["vec_id"]: r for r in found}.values())  # an id counts once, also where its vectors lie in several cells
    known_ids = np.array([r["vec_id"] for r in summary], np.int64)
    known = _matrix(pa.array([bytes(r["v"]) for r in summary], pa.binary())).astype(np.float64)
    width = 2 * longest / BINS or 1.0
    bins = assigned.groupBy("cell", F.least(F.floor(F.col("d") / width), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n")).collect()
    held = np.zeros((n_pivots, BINS + 1), np.int64)
    for r in bins:
        held[r["cell"], r["bin"]] = r["n"]
    at_least = held[:, ::-1].cumsum(1)[:, ::-1]  # rows of a cell from a bin on

    def rows_for(need: np.ndarray) -> int:
        """Rows with at least the distances of need to their pivots, by the histograms: no fewer than there are."""
        with np.errstate(invalid="ignore"):
            bin_ = np.clip(np.floor(need / width), 0, BINS - 1).astype(int)
        return int(at_least[np.arange(n_pivots), bin_].sum())

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For the queries of each pivot in a task: how many, and the least distance to each pivot that one of them needs."""
        out: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            q = _matrix(b.column(1)).astype(np.float64)
            length = np.sqrt((q * q).sum(1))
            score = q @ known.T
            score[b.column(0).to_numpy()[:, None] == known_ids[None, :]] = -np.inf
            reached = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(q), -np.inf)
            slack = 1e-9 * (1.0 + length * longest)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = (reached[:, None] - slack[:, None] - q @ pivot.T) / length[:, None]
            need = np.where(np.isnan(need) | (length[:, None] == 0), -np.inf, need) - 1e-6 * (1.0 + longest)
            for g in np.unique(near := b.column(2).to_numpy()).tolist():
                n, least = out.get(g, (0, np.full(n_pivots, np.inf)))
                out[g] = n + int((near == g).sum()), np.minimum(least, need[near == g].min(0))
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([n for n, _ in out.values()], pa.int64()), pa.array([x.tolist() for _, x in out.values()], pa.list_(pa.float64()))], names=["near", "n", "need"])

    each = assigned.filter("is_query").select("vec_id", "v", "near").mapInArrow(bound, "near int, n long, need array<double>")
    asked = each.select("near", "n", F.posexplode("need").alias("cell", "need")).groupBy("near", "cell").agg(F.sum("n").alias("n"), F.min("need").alias("need")).collect()
    counts = {r["near"]: r["n"] for r in asked}
    needs = {g: np.full(n_pivots, -np.inf) for g in counts}
    for r in asked:
        needs[r["near"]][r["cell"]] = r["need"]
    groups = grouped(chained(pivot), counts, needs, rows_for)
    group_of, n_groups = np.full(n_pivots, -1, np.int32), len(groups)
    for i, held_by in enumerate(groups):
        group_of[held_by] = i
    need = np.stack([np.min([needs[g] for g in held_by], axis=0) for held_by in groups])
    block_rows = max(1, BLOCK_BYTES // (8 * dim))
    data_blocks = np.array([max(1, -(-rows_for(x) // block_rows)) for x in need])
    query_blocks = [max(1, -(-sum(counts[g] for g in held_by) // GROUP_QUERIES)) for held_by in groups]

    def spread(ids: np.ndarray, n: int | np.ndarray) -> np.ndarray:
        z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((z >> np.uint64(33)) % np.asarray(n, np.uint64)).astype(np.int32)

    names = ["g", "qb", "db", "asks", "vec_id", "v"]

    def deal(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Each query once for each data block of its group, each needed data row once for each group and query block."""
        ids, cell, d, near = (batch.column(i).to_numpy() for i in (0, 3, 4, 6))
        asks = batch.column(2).to_numpy(zero_copy_only=False)
        for g in range(n_groups):
            wanted = np.flatnonzero(d >= need[g][cell])
            for qb in range(query_blocks[g]):
                yield out(batch, wanted, g, np.full(len(wanted), qb, np.int32), spread(ids[wanted], data_blocks[g]), False)
        mine = np.flatnonzero(asks)
        if len(mine):
            g = group_of[near[mine]]
            qb = spread(ids[mine], np.asarray(query_blocks)[g])
            times = data_blocks[g]
            at = np.repeat(np.arange(len(mine)), times)
            db = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
            yield out(batch, mine[at], g[at], qb[at], db.astype(np.int32), True)

    def out(batch, at, g, qb, db, asks) -> pa.RecordBatch:
        n, take = len(at), pa.array(at)
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.asarray(g, np.int32), n)), pa.array(qb), pa.array(db), pa.array(np.full(n, asks)), batch.column(0).take(take), batch.column(1).take(take)], names=names)

    return assigned.mapInArrow(per_batch(deal), "g int, qb int, db int, asks boolean, vec_id long, v binary"), n_rows, dim


def top_k(vectors: DataFrame, is_query: Column, k: int = K_BEST, scale: int = SCALE, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k candidates of highest integer inner product for each row of vectors where is_query, a condition on vec_id, holds."""
    dealt, _, dim = replicated(vectors, is_query, k, scale, pivots, id_col, vector_col)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def solve(block: pa.Table) -> pa.Table:
        asks = block.column("asks").to_numpy()
        ids = block.column("vec_id").to_numpy()
        m = _matrix(block.column("v").combine_chunks())
        order = np.argsort(ids[~asks], kind="stable")
        data, data_ids = m[~asks][order], ids[~asks][order]
        queries, query_ids = m[asks], ids[asks]
        got: list[np.ndarray] = []
        surplus = len(data_ids) - len(np.unique(data_ids))  # rows of ids with several vectors, which may have equal scores
        exact = len(data) and len(queries) and float(np.abs(data).max()) * float(np.abs(queries).max()) * dim < 2**53
        for lo in range(0, len(queries), 256):
            q = queries[lo : lo + 256]
            score = (q.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64) if exact else q @ data.T
            for i, row in enumerate(score):
                own = query_ids[lo + i]
                a, b = np.searchsorted(data_ids, own, "left"), np.searchsorted(data_ids, own, "right")
                many = k + int(b - a) + surplus
                if len(row) > many:
                    floor = np.partition(row, len(row) - many)[len(row) - many]
                    # all above the floor, and of those on it the smallest ids
                    at = np.concatenate((np.flatnonzero(row > floor), np.flatnonzero(row == floor)[:many]))
                else:
                    at = np.arange(len(row))
                at = at[(at < a) | (at >= b)]
                at = at[np.lexsort((at, -row[at]))]
                same = (data_ids[at[1:]] == data_ids[at[:-1]]) & (row[at[1:]] == row[at[:-1]])
                at = at[np.concatenate((np.ones(len(at[:1]), bool), ~same))][:k]
                got.append(np.column_stack((np.full(len(at), own), data_ids[at], row[at])))
        found = np.concatenate(got) if got else np.zeros((0, 3), np.int64)
        return pa.table({"query_id": found[:, 0], "vec_id": found[:, 1], "score": found[:, 2]})

    best = dealt.groupBy("g", "qb", "db").applyInArrow(solve, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
