"""Mixing sources to target weights by a low-discrepancy schedule.

Each source gets a target number of words; the mix is a row of slots. Slot i takes
the point frac(i * golden ratio) through the cumulative targets and so falls to a
source; the rank of a slot among its source's slots says which block of the source's
shuffled stream of words it holds. A source's stream is its documents in hash order,
gone through again when it ends. The first words of the stream, as many as the target
has, rounded down, are cut into as many blocks as the source has slots, equal to one
word; and as the points share the slots out by the targets, blocks of all sources
are nearly equal too. Any stretch of slots has the sources in their target shares, to
a few slots. What a document gives is the sum over the slots that its blocks stand
in. A source whose share is too small for the points to meet gets one slot of its
own, behind the slot at the middle of its stretch of the targets.

Slots are as many as it takes to keep a block at `block` words or fewer, at least
`slots`, so blocks don't grow with the data; the schedule is made in chunks of
CHUNK slots, with ranks in two levels, and is never collected.

Plan: one scan that counts words, an aggregation of equal rows, a shuffle of
(id, size) rows for their places in the streams, and a join of document pieces with
the schedule by (source, rank). The table of sources, whose number is checked against
`max_sources`, is the only broadcast. Places in a stream are running sums in two
levels, over buckets of the hash and then inside each bucket, so a source that holds a
third of all rows is spread over as many tasks as it has buckets of ROWS_A_BUCKET
rows. Equal rows are one entry of a stream until they have their places, so repeats of
one row meet nowhere.

Defined results: a null or empty text has size 0 and takes 0; a null source is a
source of its own, last in order; rows that repeat an id are documents of their
own; if all sizes are 0, so are all targets; an empty table gives an empty
result; other columns are never looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simvane.llm import textkit as K
from simvane.llm.common import per_batch, row_mark, shared_folder, stored, text_mark

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SLOTS = 1 << 16
BLOCK = 1 << 14
CHUNK = 1 << 16
ROWS_A_BUCKET = 2000
#: 2^64 divided by the golden ratio, to the nearest odd number.
GOLDEN = 0x9E3779B97F4A7C15


def word_counts(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.diff(K.words_of(data, offsets, hashed=False).first) for _, _, data, offsets in K.chunks(texts)] or [np.zeros(0, np.int64)])


def filled(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of total by weight, none above most * size; what is above goes to the others by weight, until none is."""
    limits = [most * s for s in sizes]
    out, open_ = [0.0] * len(sizes), list(range(len(sizes)))
    rest = min(total, float(sum(limits)))
    while open_:
        by = rest / sum(weights[i] for i in open_)
        over = [i for i in open_ if by * weights[i] > limits[i]]
        if not over:
            for i in open_:
                out[i] = by * weights[i]
            break
        for i in over:
            out[i] = float(limits[i])
            rest -= limits[i]
        open_ = [i for i in open_ if i not in set(over)]
    return out


def point(slots: np.ndarray) -> np.ndarray:
    """frac(i * golden ratio), in [0, 1), of each slot i."""
    with np.errstate(over="ignore"):
        return (slots.astype(np.uint64) * np.uint64(GOLDEN) >> np.uint64(11)).astype(float) / 2.0**53


def falls_to(points: np.ndarray, targets: Sequence[int]) -> np.ndarray:
    """The source of each point: sources lie end to end along [0, 1), each as long as its share of the targets."""
    edges = np.cumsum(np.asarray(targets, float)) / float(sum(targets))
    last = max(i for i, t in enumerate(targets) if t)
    return np.minimum(np.searchsorted(edges, points, "right"), last)


def schedule(spark: SparkSession, targets: Sequence[int], n: int) -> tuple[DataFrame, list[int]]:
    """(slot, source_no, rank) of n slots and those of the sources that no point meets, and how many slots each source has."""
    targets = list(targets)
    names = ["source_no", "rank", "chunk", "slot"]

    def fall(batch: pa.RecordBatch):
        for c in batch.column(0).to_pylist():
            slot = np.arange(c * CHUNK, min(n, (c + 1) * CHUNK))
            source = falls_to(point(slot), targets)
            order = np.argsort(source, kind="stable")
            counts = np.bincount(source, minlength=len(targets))
            rank = np.empty(len(slot), np.int64)
            rank[order] = np.arange(len(slot)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([pa.array(source.astype(np.int32)), pa.array(rank), pa.array(np.full(len(slot), c)), pa.array(slot)], names=names)

    chunks = spark.range(-(-n // CHUNK) if sum(targets) else 0)
    slots = chunks.mapInArrow(per_batch(fall), "source_no int, rank long, chunk long, slot long")
    counts = slots.groupBy("source_no", "chunk").agg(F.count("*").alias("held"))
    held = {r.source_no: r.n for r in counts.groupBy("source_no").agg(F.sum("held").alias("n")).collect()}
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("source_no", "chunk", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    slots = slots.join(counts, ["source_no", "chunk"]).select("slot", "source_no", (F.col("rank") + F.col("earlier")).alias("rank"))
    edges = np.cumsum(np.asarray(targets, float))
    lone = [(int((edges[i] - t / 2) / edges[-1] * n), i, 0) for i, t in enumerate(targets) if t and i not in held]
    if lone:
        slots = slots.unionByName(spark.createDataFrame(lone, "slot long, source_no int, rank long"))
    return slots, [held.get(i, int(t > 0)) for i, t in enumerate(targets)]


class Mix:
    """A mix of docs: `sources` (source, size, target), `slots` (slot, source_no, rank) and `pieces`, the words that each slot takes of each row.

    pieces: doc_id, source, mark, own (more that tells rows apart), nth (tells equal rows apart), size, source_size, target,
    and slot, pass (0 for the first time through the source), from_word and to_word, null
    for a row that the mix doesn't take.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, slots: int = SLOTS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_sources: int = 100_000, own: Column | None = None):
        spark = docs.sparkSession
        folder = shared_folder(spark)

        def count(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(word_counts(batch.column(2))), batch.column(3), batch.column(4)], names=["doc_id", "source", "size", "mark", "own"])

        kind = {f.name: f.dataType.simpleString() for f in docs.schema}
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), text_mark(text_col).alias("mark"), (F.lit(0).cast("long") if own is None else own).alias("own"))
        sizes = rows.mapInArrow(per_batch(count), f"doc_id {kind[id_col]}, source {kind[source_col]}, size long, mark long, own long")
        # equal rows are one entry of a stream until they have their places
        entries = sizes.groupBy("source", "doc_id", "mark", "own").agg(F.max("size").alias("size"), F.count("*").alias("n"))
        entries = stored(entries.withColumn("at", F.xxhash64(F.lit("mix"), "doc_id", "mark")), f"{folder}/entries")
        found = entries.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.count("*").alias("n")).limit(max_sources + 1).collect()
        if len(found) > max_sources:
            raise ValueError(f"more than {max_sources} sources; the schedule has a share for each")
        found.sort(key=lambda r: (r.source is None, r.source or ""))
        source_sizes = [int(r["size"]) for r in found]
        targets = filled(source_sizes, [weights[i % len(weights)] for i in range(len(found))], share * sum(source_sizes), most)
        taken = [min(int(t), int(most * s)) for t, s in zip(targets, source_sizes, strict=True)]
        made, counts = schedule(spark, taken, min(sum(taken), max(slots, -(-sum(taken) // block))))
        self.slots = stored(made, f"{folder}/slots")

        # the first `long_blocks` blocks of a source have one word more than `short`
        table = [(i, r.source, s, t, w, w // max(1, c), w % max(1, c), max(1, -(-int(r.n) // ROWS_A_BUCKET))) for i, (r, s, t, w, c) in enumerate(zip(found, source_sizes, targets, taken, counts, strict=True))]
        self.sources = spark.createDataFrame(table, f"source_no int, source {kind[source_col]}, source_size long, target double, taken_size long, short long, long_blocks long, buckets long")

        placed = entries.join(F.broadcast(self.sources), entries["source"].eqNullSafe(self.sources["source"])).drop(self.sources["source"])
        placed = placed.withColumn("bucket", F.pmod(F.shiftrightunsigned("at", 40), F.col("buckets"))).withColumn("entry_size", F.col("size") * F.col("n"))
        # documents of a stream stand in the order of (bucket, hash)
        of_bucket = placed.groupBy("source_no", "bucket").agg(F.sum("entry_size").alias("bucket_size"))
        before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        of_bucket = of_bucket.select("source_no", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_from"))
        inside = Window.partitionBy("source_no", "bucket").orderBy("at", "doc_id", "mark", "own").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("in_bucket", F.coalesce(F.sum("entry_size").over(inside), F.lit(0))).join(of_bucket, ["source_no", "bucket"])
        self.placed = placed.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("begin", F.col("bucket_from") + F.col("in_bucket") + F.col("nth") * F.col("size"))

        passes = self.placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(max(0, int(np.ceil(most)) - 1))))) if most > 1 else self.placed.withColumn("pass", F.lit(0))
        passes = passes.withColumn("lo", F.col("begin") + F.col("pass") * F.col("source_size"))
        passes = passes.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("taken_size")))
        split = F.col("long_blocks") * (F.col("short") + 1)

        def rank_of(word: Column) -> Column:
            return F.when(word < split, F.floor(word / (F.col("short") + 1))).otherwise(F.col("long_blocks") + F.floor((word - split) / F.greatest("short", F.lit(1))))

        def begin_of(rank: Column) -> Column:
            return rank * F.col("short") + F.least(rank, F.col("long_blocks"))

        ranks = F.when(F.col("lo") < F.col("hi"), F.sequence(rank_of(F.col("lo")), rank_of(F.col("hi") - 1)))
        # one row stays of a row that is not taken, under ranks that no slot has, so that such rows don't meet in one task
        passes = passes.withColumn("rank", F.explode_outer(ranks)).filter("rank is not null or pass = 0").withColumn("rank", F.coalesce("rank", -1 - F.pmod("at", F.lit(1 << 20))))
        passes = passes.join(self.slots, ["source_no", "rank"], "left")
        start, end = F.greatest(F.col("lo"), begin_of(F.col("rank"))), F.least(F.col("hi"), begin_of(F.col("rank") + 1))
        self.pieces = passes.select("doc_id", "source", "mark", "own", "nth", "size", "source_size", "target", "slot", "pass", *(F.when(F.col("slot").isNotNull(), x - F.col("lo")).alias(c) for x, c in ((start, "from_word"), (end, "to_word"))))

    def taken(self) -> DataFrame:
        """One row for each row of docs: doc_id, size, source_size, target, taken, slot (the first one; null if none), source, mark and nth."""
        by = self.pieces.groupBy("source", "doc_id", "mark", "own", "nth").agg(*(F.max(c).alias(c) for c in ("size", "source_size", "target")), F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("slot"))
        return by.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "slot", "source", "mark", "nth")


def _id_mark(id_: Column) -> Column:
    return F.xxhash64(F.lit(23), id_, id_.isNull())


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs as often as the mix takes them, with the columns of docs; the last copy of a row taken in part holds its first words, joined by one space.

    Rows stand in the order of their first slots within a partition, and a partition
    holds whole stretches of slots, so each has the sources in their shares. Where docs
    has n_chars, a cut row's is counted anew.
    """
    text_col, spark = options.get("text_col", "text"), docs.sparkSession
    id_col = options.get("id_col", "doc_id")
    mix = Mix(docs, own=row_mark(docs), **options)
    # what a pass takes of a row: all words or, at the end of the target, the first ones
    copies = mix.pieces.filter("slot is not null").groupBy("source", "doc_id", "mark", "own", "nth", "pass").agg(F.max("size").alias("size"), F.sum(F.col("to_word") - F.col("from_word")).alias("words"), F.min("slot").alias("slot"))
    # equal rows are one row with the copies of all; the row is a struct, so its names clash with none, and the keys are never null, so both sides are dealt alike
    keys = ["row_mark", "id_mark"]
    rows = docs.select(F.struct(*docs.columns).alias("row"), row_mark(docs).alias("row_mark"), _id_mark(docs[id_col]).alias("id_mark")).dropDuplicates(keys)
    joined = rows.join(copies.select(F.col("own").alias("row_mark"), _id_mark(F.col("doc_id")).alias("id_mark"), "size", "slot", "words"), keys).select("row", "size", "slot", "words")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_slots = mix.slots.agg(F.max("slot")).first()[0] or 0
    stretch = max(1, -(-(n_slots + 1) // (4 * parts)))
    joined = joined.repartition(parts, F.floor(F.col("slot") / stretch)).sortWithinPartitions("slot")
    text = F.col("row")[text_col]
    words = F.filter(F.split(text, "[ \t\n\x0b\f\r]+"), lambda w: w != "")
    cut = F.col("words") < F.col("size")
    left = F.when(cut, F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")).otherwise(text)
    columns = []
    for c in docs.columns:
        if c == text_col:
            columns.append(left.alias(c))
        elif c == "n_chars":
            columns.append(F.when(cut, F.length(left)).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col("row")[c].alias(c))
    return joined.select(*columns)
