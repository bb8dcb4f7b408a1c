"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns several points of a ring of 2^32 places; a document's id hashes
to a place and its home is the shard of the next point clockwise. A shard takes
no more rows than its capacity; rows beyond it continue clockwise to the next
point whose shard still has room. With the default capacities, which add up to
the number of rows, counts are at most one apart (law `rows`).

Only DataFrame functions are used. The ring is cut into cells finer than the
arcs between points; one aggregation counts rows per cell, and all placement is
decided on that small table, whose size depends on `shards`, `vnodes` and `cells`
and not on the data: rows keep the order of their places, so a row's shard and
slot follow from its rank in its cell. The only window over documents is
partitioned by cell and holds one entry for all rows equal in id, checksum and size,
so no task gets more than its share of the ring; an id with many texts alone shares
one place. The tables broadcast back to the documents have at most cells + shards * vnodes rows.

Defined results: a null text has 16 bytes and the checksum of the empty text; a
null id takes its place by its text; rows with equal ids share a place and are
ordered by checksum, then size; exact repeats are interchangeable; an empty
table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLACES = 2**32
ROW_BYTES = 16


def _place(*of: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*of), 32)


def ring(docs: DataFrame, shards: int, vnodes: int, cells: int) -> DataFrame:
    """The points of the ring: shard, point, cell. A further shard adds points and moves none."""
    spark = docs.sparkSession
    points = spark.range(shards * vnodes, numPartitions=1).select(F.floor(F.col("id") / vnodes).cast("int").alias("shard"), _place(F.lit("ring"), F.col("id")).alias("point"))
    points = points.groupBy("point").agg(F.min("shard").alias("shard"))
    return points.withColumn("cell", (F.col("point") / F.lit(PLACES // cells)).cast("int"))


def place(docs: DataFrame, shards: int = 40, vnodes: int = 64, cells: int = 8192, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    With slack 0 the capacities are the even shares, so the law is `rows`; with more,
    every shard may take (1 + slack) even shares, fewer rows leave their home, and a
    further shard moves fewer of them. size is the text's UTF-8 bytes plus 16.
    """
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(F.col(id_col).isNull(), _place(F.lit("text"), F.col(text_col))).otherwise(_place(F.lit("id"), F.col(id_col))).alias("place"),
    )
    points = ring(docs, shards, vnodes, cells)
    by_cell = points.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("point", "shard"))).alias("points"))
    # the stretches: in a cell with p points, p + 1 of them; the last runs on into later cells
    first = points.agg(F.min_by("shard", "point").alias("first_shard"))
    every = docs.sparkSession.range(cells, numPartitions=1).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(by_cell), "cell", "left")
    ahead = Window.orderBy("cell").rowsBetween(1, Window.unboundedFollowing)
    every = every.crossJoin(F.broadcast(first)).select(
        "cell",
        F.coalesce(F.transform("points", lambda x: x["point"]), F.array().cast("array<bigint>")).alias("edges"),
        F.concat(F.coalesce(F.transform("points", lambda x: x["shard"]), F.array().cast("array<int>")), F.array(F.coalesce(F.first(F.col("points")[0]["shard"], ignorenulls=True).over(ahead), F.col("first_shard")))).alias("homes"),
    )
    cell = (F.col("place") / F.lit(PLACES // cells)).cast("int")
    seen = base.withColumn("cell", cell).join(F.broadcast(every.select("cell", "edges")), "cell").withColumn("part", F.size(F.filter("edges", lambda x: x < F.col("place")))).drop("edges")

    # all below is on the stretches alone: at most cells + shards * vnodes rows
    counts = seen.groupBy("cell", "part").agg(F.count("*").alias("n"))
    stretches = every.select("cell", F.posexplode("homes").alias("part", "home")).join(counts, ["cell", "part"], "left").fillna(0, "n")
    total = F.sum("n").over(Window.partitionBy())
    even = F.floor(total / shards) + F.when(F.col("home") < total % shards, 1).otherwise(0)
    capacity = F.greatest(even, F.ceil(total * (1 + slack) / shards)) if slack else even
    clockwise = Window.orderBy("cell", "part")
    so_far = clockwise.rowsBetween(Window.unboundedPreceding, -1)
    at_home = Window.partitionBy("home").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    held = stretches.withColumn("capacity", capacity.cast("long"))
    held = held.withColumn("stay", F.least(F.col("n"), F.greatest(F.lit(0), F.col("capacity") - F.coalesce(F.sum("n").over(at_home), F.lit(0)))))
    held = held.withColumn("gone", F.col("n") - F.col("stay"))
    held = held.withColumn("gone_before", F.coalesce(F.sum("gone").over(so_far), F.lit(0)))

    # room at each point in the order of the walk: twice around, the rows that wait go on clockwise, first come first placed
    ends = held.groupBy("home").agg(F.max("capacity").alias("capacity"), F.sum("stay").alias("stay")).select(F.col("home").alias("shard"), (F.col("capacity") - F.col("stay")).alias("room"))
    rooms = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.coalesce(F.element_at(F.col("room_of"), s), F.lit(0)))
    # between two points of the ring all stretches have one home, so the walk takes a step for each run of stretches
    turn = F.when(F.col("home") != F.lag("home").over(clockwise), 1).otherwise(0)
    runs = held.withColumn("run", F.sum(turn).over(clockwise.rowsBetween(Window.unboundedPreceding, 0))).groupBy("run").agg(F.first("home").alias("home"), F.sum("gone").alias("gone"))
    start = F.struct(F.col("rooms").alias("rooms"), F.lit(0).cast("long").alias("waiting"), F.lit(0).cast("long").alias("placed"), F.array().cast("array<struct<upto:bigint,shard:int>>").alias("steps"))

    def step(state: Column, at: Column) -> Column:
        room = F.element_at(state["rooms"], at["home"] + 1)
        waiting = state["waiting"] + at["gone"]
        take = F.least(room, waiting)
        moved = F.when(take > 0, F.concat(F.slice(state["rooms"], F.lit(1), at["home"]), F.array(room - take), F.slice(state["rooms"], at["home"] + 2, F.lit(shards)))).otherwise(state["rooms"])
        steps = F.when(take > 0, F.concat(state["steps"], F.array(F.struct((state["placed"] + take).alias("upto"), at["home"].alias("shard"))))).otherwise(state["steps"])
        return F.struct(moved.alias("rooms"), (waiting - take).alias("waiting"), (state["placed"] + take).alias("placed"), steps.alias("steps"))

    lap = F.transform(F.array_sort(F.collect_list(F.struct("run", "home", "gone"))), lambda x: F.struct(x["home"].alias("home"), x["gone"].alias("gone")))
    walk = runs.agg(lap.alias("lap")).crossJoin(ends.agg(F.map_from_entries(F.collect_list(F.struct("shard", "room"))).alias("room_of"))).withColumn("rooms", rooms)
    again = F.concat("lap", F.transform("lap", lambda x: F.struct(x["home"].alias("home"), F.lit(0).cast("long").alias("gone"))))
    steps = walk.select(F.explode(F.aggregate(again, start, step)["steps"]).alias("s")).select(F.col("s.upto"), F.col("s.shard"))
    steps = steps.withColumn("from", F.coalesce(F.lag("upto").over(Window.orderBy("upto")), F.lit(0).cast("long")))

    # a stretch's rows: those that stay, then pieces of the walk
    stays = held.filter("stay > 0").select("cell", "part", F.lit(0).cast("long").alias("lo"), F.col("stay").alias("hi"), F.col("home").alias("shard"))
    left = held.filter("gone > 0").select("cell", "part", "stay", F.col("gone_before").alias("g"), (F.col("gone_before") + F.col("gone")).alias("g_end"))
    parts = left.join(F.broadcast(steps), (F.col("from") < F.col("g_end")) & (F.col("upto") > F.col("g")))
    goes = parts.select("cell", "part", (F.col("stay") + F.greatest("from", "g") - F.col("g")).alias("lo"), (F.col("stay") + F.least("upto", "g_end") - F.col("g")).alias("hi"), "shard")
    order = Window.partitionBy("shard").orderBy("cell", "part", "lo").rowsBetween(Window.unboundedPreceding, -1)
    spans = stays.unionByName(goes).withColumn("slot_from", F.coalesce(F.sum(F.col("hi") - F.col("lo")).over(order), F.lit(0)))
    spans = spans.groupBy("cell", "part").agg(F.collect_list(F.struct("lo", "hi", "shard", "slot_from")).alias("spans"))

    # equal rows are one entry until they have their ranks
    entries = seen.groupBy("cell", "part", "place", "doc_id", "text_crc32", "size").agg(F.count("*").alias("n"))
    inside = Window.partitionBy("cell", "part").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = entries.withColumn("begin", F.coalesce(F.sum("n").over(inside), F.lit(0))).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("rank", F.col("begin") + F.col("nth"))
    mine = ranked.join(F.broadcast(spans), ["cell", "part"]).withColumn("span", F.filter("spans", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0])
    return mine.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows" if not slack else "bounded").alias("law"),
        F.col("span.shard").cast("int").alias("shard"),
        (F.col("span.slot_from") + F.col("rank") - F.col("span.lo")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
