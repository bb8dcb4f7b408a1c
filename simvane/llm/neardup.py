"""MinHash near-dedup with fast similarity sketches.

A document's set is its distinct `shingle`-word shingles (ASCII letters lowered).
Its sketch has t coordinates, filled in rounds: in each of the first t rounds every
element is thrown into one bin, by a hash of its own for that round; in round t + i
all elements compete for bin i. Lower rounds win, then lower hashes, so all bins
are filled after 2t rounds at the latest, usually after a few, and two sets agree
in a coordinate with the probability of their Jaccard similarity, with
concentration as for independent coordinates.

Bands of `rows` coordinates are hashed to buckets. Documents whose word sequences
are equal are one class, and only its smallest document goes on. Links are then
confirmed on full sets:

1. In each bucket every document is paired with the smallest one, its hub. A
   document is first compared with the hub with which it shares most buckets.
2. Connected components of the confirmed links.
3. In each hub's group of documents that still spans several components, all
   pairs of documents in different components are compared, except that documents
   which can't be linked with any other are left out: a document linked at 0.8
   shares at least 0.8 of its elements with its partner, so one with too few
   elements that any other candidate also has is out, exactly. The comparison is
   blockwise, in bounded blocks, by one matrix product on the shared elements, and
   gives only links that join what the block has not joined yet: fewer than it
   has documents.
4. Connected components of all links.

So every pair in a bucket is either confirmed, refuted or connected already, while
no step emits the pairs of a group. With 28 bands of 4, a pair at similarity 0.8
shares no bucket with a probability of 4e-7.

Plan: sketches are made in one scan and stored (28 hashes a document). Texts are
shuffled once, to pick out those of candidates, which are stored; later joins move
candidates only. Hot keys (a class, a bucket, a
hub with a third of all rows) are pre-aggregated, or joined to one row, or spread
over blocks.

Defined results: a null or empty text has no set and is linked with nothing; fewer
words than a shingle make one shingle; exact repeats of a row are linked if they
have words; rows that repeat an id with another text are told apart by the text; a
row with a null id is linked like others and gets the smallest id of its group, or
null if there is none; an empty table gives an empty result; other columns are
never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simvane.llm import textkit as K
from simvane.llm.common import NO_ID, drop_folder, id_or_last, integer_id, per_batch, row_mark, shared_folder, stored, text_mark, tidy

BANDS, ROWS = 28, 4
SHINGLE = 5
#: Documents, and elements of their sets, that a block of a comparison has at most, but for its luck in the dealing and for one longer document.
BLOCK = 1000
BLOCK_ELEMENTS = 1 << 20
#: Text of a block after which a worker gives its memory back.
TIDY_BYTES = 1 << 20
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LATE = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray, K.Words]:
    """(elements, first, words): text d has the distinct elements[first[d]:first[d + 1]], ascending."""
    words = K.words_of(data, offsets, lower=True)
    h, n_words = words.hashes, np.diff(words.first)
    docs = len(n_words)
    ok = np.flatnonzero(words.starts_of(shingle))
    doc = np.repeat(np.arange(docs), n_words)
    keys, owner = [K.runs_of(h, shingle)[ok]], [doc[ok]]
    for n in range(1, shingle):  # short texts: the whole sequence
        short = np.flatnonzero(n_words == n)
        if len(short):
            keys.append(K.runs_of(h, n)[words.first[short]])
            owner.append(short)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    return key, np.searchsorted(own, np.arange(docs + 1)), words


def sketches(elements: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """A (texts, t) matrix of coordinates; a text without elements keeps the largest number everywhere."""
    docs = len(first) - 1
    out = np.full(docs * t, _LATE)
    sizes = np.diff(first)
    open_ = np.flatnonzero(sizes)
    salts = K.stream(77, 2 * t)
    for i in range(2 * t):
        if not len(open_):
            break
        if i >= t:  # only texts whose bin i - t is empty
            mine = open_[out[open_ * t + (i - t)] == _LATE]
        else:
            mine = open_
        if len(mine):
            n = sizes[mine]
            at = np.repeat(first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            h = K.mix(elements[at] ^ salts[i])
            bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else np.int64(i - t)
            value = np.uint64(i) << np.uint64(48) | K.mix(h + _GOLD) >> np.uint64(16)
            np.minimum.at(out, np.repeat(mine, n) * t + bins, value)
        if i < t or i % 16 == 0:
            open_ = open_[(out.reshape(docs, t)[open_] == _LATE).any(axis=1)]
    return out.reshape(docs, t)


def _signed(batch: pa.RecordBatch, shingle: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """For rows (d, mark, text): d, mark, s1, s2 (the word sequence), n_shingles, bands (hashes, as bytes)."""
    for lo, hi, data, offsets in K.chunks(batch.column(2), 4 * K.CHUNK):
        elements, first, words = shingle_sets(data, offsets, shingle)
        docs = hi - lo
        sketch = sketches(elements, first, bands * rows)
        band = np.zeros((docs, bands), np.uint64)
        for j in range(rows):
            band = K.mix((band + sketch[:, j::rows]) * _GOLD + np.uint64(j))
        band = K.mix(band + np.arange(1, bands + 1, dtype=np.uint64) * _GOLD)
        whole = []
        for salt in (1, 2):
            placed = K.mix(words.hashes * (_GOLD + np.uint64(2 * salt)) + (np.arange(len(words.hashes)) - np.repeat(words.first[:-1], np.diff(words.first))).astype(np.uint64))
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(placed)))
            whole.append(sums[words.first[1:]] - sums[words.first[:-1]])
        own = slice(lo, hi)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0)[own], batch.column(1)[own], K.long_array(whole[0]), K.long_array(whole[1]), pa.array(np.diff(first).astype(np.int64)), pa.array([x.tobytes() for x in band], pa.binary())],
            names=["d", "mark", "s1", "s2", "n_shingles", "bands"],
        )


def _key() -> Column:
    return F.struct("d", "mark")


def components(links: DataFrame, folder: str, rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) of the nodes in links (a, b); nodes without links are absent.

    Rounds of large-star and small-star: each hangs neighbours on the smallest one; paths shorten
    by a constant factor, so rounds grow with the logarithm of a component's diameter.
    """
    spark = links.sparkSession
    edges = stored(links.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), f"{folder}/edges")
    before = None
    for k in range(rounds):
        both = edges.select(F.col("lo").alias("x"), F.col("hi").alias("y")).unionByName(edges.select(F.col("hi").alias("x"), F.col("lo").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        # dealt by hi once, which serves the distinct pairs, the smallest of each and the join with it
        large = both.join(least, "x").filter("y > x").select(F.col("m").alias("lo"), F.col("y").alias("hi")).filter("lo <> hi").repartition("hi").dropDuplicates(["hi", "lo"])
        # small-star: neighbours not above a node, and the node itself, hang on the smallest of them
        small = large.groupBy("hi").agg(F.min("lo").alias("m"))
        hung = large.join(small, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).unionByName(small.select(F.col("m").alias("lo"), "hi"))
        now = stored(hung.filter("lo <> hi").distinct(), f"{folder}/round{k}")
        sign = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("lo", "hi")).alias("x")).first()
        drop_folder(spark, f"{folder}/edges" if k == 0 else f"{folder}/round{k - 1}")
        edges = now
        if before == (sign["n"], sign["x"]):
            break
        before = (sign["n"], sign["x"])
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _sets(texts: pa.Array, shingle: int) -> list[np.ndarray]:
    out = []
    for lo, hi, data, offsets in K.chunks(texts):
        elements, first, _ = shingle_sets(data, offsets, shingle)
        out += [elements[first[i] : first[i + 1]] for i in range(hi - lo)]
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets."""
    total = np.zeros((len(left), len(right)), np.float32)
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    step = max(1, 4_000_000 // (len(left) + len(right)))
    for lo in range(0, len(both), step):
        part = both[lo : lo + step]

        def bits(sets: list[np.ndarray], part=part) -> np.ndarray:
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hit = part[at] == flat
            out = np.zeros((len(sets), len(part)), np.float32)
            out[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]] = 1
            return out

        total += bits(left) @ bits(right).T
    return total.astype(np.int64)


def _grouped(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """d, mark and n_shingles of each row of docs, root (a number for each component, null without words) and least (its smallest d)."""
    folder = shared_folder(docs.sparkSession)
    integer_id(docs, id_col)
    keyed = docs.select(id_or_last(id_col).cast("long").alias("d"), text_mark(text_col).alias("mark"), F.col(text_col).alias("text"))
    signed = keyed.mapInArrow(per_batch(lambda b: _signed(b, shingle, bands, rows)), "d long, mark long, s1 long, s2 long, n_shingles long, bands binary")
    signed = stored(signed, f"{folder}/signed")

    # classes of equal word sequences; the smallest member stands for its class, under a number fixed when this is stored
    heads = signed.filter("n_shingles > 0").groupBy("s1", "s2").agg(F.min(_key()).alias("key"), F.max("bands").alias("bands"), F.max("n_shingles").alias("n"))
    heads = stored(heads.select("s1", "s2", "key.d", "key.mark", "bands", "n", F.monotonically_increasing_id().alias("node")), f"{folder}/heads")

    def buckets(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        each = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(each), *(batch.column(i).take(pa.array(np.repeat(np.arange(n), bands))) for i in (0, 2))], names=["bucket", "node", "n"])

    spread = heads.select("node", "bands", "n").mapInArrow(per_batch(buckets), "bucket long, node long, n long")
    hubs = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.max("node").alias("top")).filter("hub <> top").select("bucket", "hub")
    pairs = spread.join(hubs, "bucket").filter("node <> hub").groupBy("hub", "node").agg(F.count("*").alias("shared"), F.max("n").alias("n"))
    pairs = stored(pairs, f"{folder}/pairs")
    candidates = pairs.select("node").union(pairs.select("hub")).distinct()
    wanted = heads.select("node", "d", "mark").join(candidates, "node")
    # one text for each class, however often its smallest row is repeated
    text_of = stored(keyed.join(wanted, ["d", "mark"]).dropDuplicates(["d", "mark"]).select(F.col("node").alias("at"), "text"), f"{folder}/texts")

    def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * inter >= percent * (a + b - inter)

    # 1: each document with the hub it shares most buckets with
    best = pairs.groupBy("node").agg(F.max_by("hub", F.struct("shared", "hub")).alias("hub"), F.max("n").alias("n"))

    def blocks(rows: Column, elements: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(rows / BLOCK), F.ceil(elements / BLOCK_ELEMENTS)).cast("int")

    fans = best.groupBy("hub").agg(blocks(F.count("*"), F.sum("n")).alias("salts"))
    asks = best.join(fans, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"))
    hub_rows = fans.select("hub", F.col("hub").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    asked = asks.unionByName(hub_rows)
    texts = asked.join(text_of, asked["node"] == text_of["at"]).select("hub", "salt", "node", "text")

    def compare(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        hub, node = block.column("hub")[0].as_py(), block.column("node").to_numpy()
        _, first = np.unique(node, return_index=True)
        sets = _sets(block.column("text").combine_chunks().take(pa.array(first)), shingle)
        node = node[first]
        core = sets[int(np.flatnonzero(node == hub)[0])]
        out = {"node": [], "n": [], "inter": [], "ok": [], "rest": []}
        for i, s in zip(node.tolist(), sets, strict=True):
            if i != hub:
                at = np.searchsorted(core, s)
                at[at == len(core)] = 0
                hit = core[at] == s
                inter = int(hit.sum())
                for name, value in zip(out, (i, len(s), inter, bool(linked(inter, len(s), len(core))), s[~hit].tobytes()), strict=True):
                    out[name].append(value)
        kinds = {"ok": pa.bool_(), "rest": pa.binary()}
        if block.nbytes > TIDY_BYTES:
            tidy()
        return pa.table({"hub": pa.array([hub] * len(out["node"]), pa.int64())} | {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in out.items()})

    compared = texts.groupBy("hub", "salt").applyInArrow(compare, "hub long, node long, n long, inter long, ok boolean, rest binary")
    compared = stored(compared, f"{folder}/compared")
    links = compared.filter("ok").select(F.col("hub").alias("a"), F.col("node").alias("b"))

    # 2
    roots = components(links, f"{folder}/first")
    root_of = roots.select(F.col("node").alias("r_node"), "root")

    # 3: groups that span several components
    group = pairs.select("hub", "node", "n").unionByName(pairs.select("hub", F.col("hub").alias("node")).distinct().withColumn("n", F.lit(0).cast("long")))
    group = group.join(root_of, F.col("node") == F.col("r_node"), "left").select("hub", "node", F.coalesce("root", "node").alias("root"), F.col("n").alias("elements"))
    group = stored(group, f"{folder}/group")
    by_root = group.groupBy("hub", "root").agg(F.count("*").alias("n"))
    open_ = by_root.groupBy("hub").agg(F.max_by("root", F.struct("n", "root")).alias("major"), F.sum("n").alias("n"), F.count("*").alias("n_roots")).filter("n_roots > 1")
    # a group of two that were compared with each other is settled
    settled = pairs.groupBy("hub").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1").join(best, ["hub", "node"], "left_semi")
    open_ = open_.join(settled.select("hub"), "hub", "left_anti")

    # elements that another candidate has too: of the rest of each document, and of the hubs
    def elements(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(each)), [len(x) for x in each]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(each)), batch.column(0).take(at)], names=["e", "node"])

    def own(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = _sets(batch.column(1), shingle)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "s"])

    spans = open_.select("hub", "major", "n")
    minor = group.join(spans, "hub").filter(F.col("root") != F.col("major")).select("node").distinct()
    # a document's elements are its rest and elements of its hub, and so on up to a hub that was compared with none
    hub_nodes = pairs.select(F.col("hub").alias("node")).distinct().join(best.select("node"), "node", "left_anti")
    hub_sets = hub_nodes.join(text_of, F.col("node") == F.col("at")).select("node", "text").mapInArrow(per_batch(own), "node long, s binary")
    rests = compared.select("node", F.col("rest").alias("s"))
    held = rests.unionByName(hub_sets).filter(F.length("s") > 0).mapInArrow(per_batch(elements), "e long, node long")
    known = held.groupBy("e").agg(F.min("node").alias("one"), F.max("node").alias("other"))
    # what only one document holds goes back to that document
    alone = known.filter("one = other").groupBy(F.col("one").alias("a_node")).agg(F.count("*").alias("alone"))
    facts = compared.select("node", "n").join(alone, F.col("node") == F.col("a_node"), "left").select("node", F.col("n"), (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared_n"))
    # those compared with a document may share what it holds alone here
    hopeless = facts.filter(F.col("shared_n") * 100 < F.col("n") * percent).select("node").join(fans.select(F.col("hub").alias("node")), "node", "left_anti").select(F.col("node").alias("h_node"))
    live = minor.join(hopeless, F.col("node") == F.col("h_node"), "left_anti")
    live = stored(live, f"{folder}/live")

    hopeful = live.select(F.col("node").alias("l_node"), F.lit(True).alias("asks"))
    members = group.join(spans, "hub").join(hopeful, F.col("node") == F.col("l_node"), "left").withColumn("asks", F.coalesce("asks", F.lit(False)) & (F.col("root") != F.col("major")))
    # written, so that what follows sums up before it shuffles by hub, and a hub's rows can be split among tasks
    members = stored(members.select("hub", "node", "root", "asks", "elements"), f"{folder}/members")
    sizes = members.groupBy("hub").agg(F.count_if("asks").alias("n_asks"), F.sum(F.when(F.col("asks"), F.col("elements"))).alias("asked"), F.count("*").alias("n"), F.sum("elements").alias("held")).filter("n_asks > 0")
    parts = sizes.select("hub", blocks(F.col("n_asks"), F.col("asked")).alias("a_parts"), blocks(F.col("n"), F.col("held")).alias("b_parts"))
    cells = members.select("hub", "node", "root", "asks").join(parts, "hub")
    mine_b = F.pmod(F.xxhash64("node"), F.col("b_parts")).cast("int")
    mine_a = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("a_parts")).cast("int")
    as_b = cells.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("a_parts") - 1))).select("hub", "node", "root", "pa", mine_b.alias("pb"), F.lit(False).alias("asking"))
    as_a = cells.filter("asks").withColumn("pb", F.explode(F.sequence(F.lit(0), F.col("b_parts") - 1))).select("hub", "node", "root", mine_a.alias("pa"), "pb", F.lit(True).alias("asking"))
    dealt = as_b.unionByName(as_a)
    dealt = dealt.join(text_of, dealt["node"] == text_of["at"]).select("hub", "pa", "pb", "asking", "node", "root", "text")

    def cross(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        asking = block.column("asking").to_numpy()
        node, root = block.column("node").to_numpy(), block.column("root").to_numpy().copy()
        sets = _sets(block.column("text").combine_chunks(), shingle)
        a, b = np.flatnonzero(asking), np.flatnonzero(~asking)
        left, right = [], []
        if len(a) and len(b):
            n = np.array([len(s) for s in sets])
            inter = _common([sets[i] for i in a], [sets[i] for i in b])
            ok = linked(inter, n[a][:, None], n[b][None, :])
            for i, row in zip(a.tolist(), ok, strict=True):  # only links that join what the block hasn't joined yet
                reached, at = np.unique(root[b[row]], return_index=True)
                for other, j in zip(reached.tolist(), b[row][at].tolist(), strict=True):
                    if other != root[i]:
                        left.append(int(node[i]))
                        right.append(int(node[j]))
                if len(reached):
                    root[np.isin(root, reached)] = root[i]
        if block.nbytes > TIDY_BYTES:
            tidy()
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    more = dealt.groupBy("hub", "pa", "pb").applyInArrow(cross, "a long, b long")
    every = links.unionByName(more)

    # 4
    roots = components(every, f"{folder}/second").select(F.col("node").alias("r_node"), "root")
    for done in ("pairs", "texts", "compared", "first", "group", "live", "members"):  # nothing lazy reads them any more
        drop_folder(docs.sparkSession, f"{folder}/{done}")

    named = heads.select("s1", "s2", "d", "node").join(roots, F.col("node") == F.col("r_node"), "left").select(F.col("s1").alias("c1"), F.col("s2").alias("c2"), "d", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("d").alias("least"))
    named = named.select("c1", "c2", "root").join(least, "root").select("c1", "c2", "root", "least")
    return signed.select("d", "mark", "s1", "s2", "n_shingles").join(named, (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")) & (F.col("n_shingles") > 0), "left").select("d", "mark", "n_shingles", "root", "least")


def near_duplicates(docs: DataFrame, percent: int = 80, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept, and mark (64 bits of the text).

    Two documents are linked if 100 * |A & B| >= percent * |A | B|; a component's id is its
    smallest doc_id, and the document that bears it is kept.
    """
    out = _grouped(docs, percent, shingle, bands, rows, id_col, text_col)
    given = F.when(F.col("d") != NO_ID, F.col("d"))
    component = F.coalesce(F.col("least"), F.col("d"))
    return out.select(given.alias("doc_id"), "n_shingles", F.when(component != NO_ID, component).alias("component_id"), (F.col("d") == component).alias("kept"), "mark")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays of each group: the one with the smallest id, and one of the rows that repeat its id and text. Rows without words stay."""
    text_col = options.get("text_col", "text")
    marked = _grouped(docs, id_col=id_col, **options)
    stay = marked.filter("root is not null").groupBy("root").agg(F.min(_key()).alias("first")).select("first.*")
    bare = ~F.coalesce(docs[text_col].rlike("[^ \t\n\x0b\f\r]"), F.lit(False))
    # the row is a struct, so its names clash with none; repeats are put together before they are shuffled
    rows = docs.filter(~bare).select(F.struct(*docs.columns).alias("row"), id_or_last(docs[id_col]).cast("long").alias("d"), text_mark(docs[text_col]).alias("mark"), row_mark(docs).alias("own"))
    kept = rows.groupBy("d", "mark").agg(F.min_by("row", "own").alias("row")).join(stay, ["d", "mark"], "left_semi")
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns)).unionByName(docs.filter(bare))
