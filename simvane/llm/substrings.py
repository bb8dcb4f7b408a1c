"""Substring dedup on a log-structured fingerprint index.

A window is `window` consecutive words of one document. A word is removed if some
window that covers it has a word sequence that also starts somewhere else; all
copies count, in the same document too.

The index holds a fingerprint for each window by way of its anchor: of the
`gram`-word runs inside the window, the one with the smallest hash (the leftmost
of equals). Equal windows have equal anchors, and neighbouring windows mostly
share theirs, so about 2 in (window - gram + 2) places are stored. A batch of
documents becomes one immutable run: a table bucketed and sorted by hash, with a row
for each hash, how often it was seen, and where if that was once. A new run is
merge-joined with the older ones bucket by bucket, without an exchange; once `fanout`
runs are of one level they are merged into one of the next, so a hash is rewritten a
number of times that grows with the logarithm of the history.

Anchors only nominate. A window whose anchor was met once in all runs is unique; the
others are verified: hashed whole, to 128 bits, and counted, together with the
windows that earlier batches had verified.

`substring_digests` judges one table on itself: its documents enter a fresh index in
`batches` runs, made in one scan, and the merge joins of the runs say which anchors
were met once. `SubstringIndex` keeps the runs in a folder of its own, from one
session to the next: each `dedup` judges a new batch on itself and on all earlier
ones. It reads the texts of the new batch and, of the history, those documents alone
that hold an anchor which the batch meets for the second time.

Plan: hot keys never meet in one task unaggregated: an anchor or window that a
third of all documents hold is one row for each task before it is shuffled. Both
judgements go back to the documents as the places of what is *unique*, at most one
row for each hash, never as a join of all occurrences. Documents of equal text are
one class: one of them is hashed whole, with the weight of all, and all of them lose
every word a window covers. A document's text is shuffled by its own key, once for
both uses if Spark reuses the exchange. Spark sorts buckets again when it reads them
(unless spark.sql.legacy.bucketedTableScan.outputOrdering is set), which is a pass
over rows already in order.

Defined results: a null text has no words; fewer words than a window: nothing is
removed; exact repeats of a row are copies of each other; rows that repeat an id
with another text are told apart by the text; ids are integers (others raise); an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simvane.llm import textkit as K
from simvane.llm.common import NO_ID, drop_folder, file_system, id_or_last, integer_id, per_batch, shared_folder, stored, text_mark

WINDOW, GRAM = 35, 8
BATCHES, FANOUT = 3, 2


def anchors_of(words: K.Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, anchors, hashes): places where a window begins, the place of each one's anchor, and the hash of the gram at each place."""
    hashes = K.runs_of(words.hashes, gram)
    span = window - gram + 1  # grams in a window
    n = len(hashes)
    best = np.arange(n)
    # leftmost smallest of the next `have` grams, doubled until it spans a window
    have = 1
    while have < span:
        step = min(have, span - have)
        m = n - step
        if m <= 0:
            break
        other = best[step:]
        best = best.copy()
        best[:m] = np.where(hashes[other] < hashes[best[:m]], other, best[:m])
        have += step
    places = np.flatnonzero(words.starts_of(window))
    return places, best[places], hashes


def _rows(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """For rows (d, mark, text): the anchors of each text, as h, d, mark, at (place in the text) and n, summed over a chunk."""
    for lo, hi, data, offsets in K.chunks(batch.column(2)):
        words = K.words_of(data, offsets)
        places, anchor, hashes = anchors_of(words, window, gram)
        if not len(places):
            continue
        at = anchor[np.concatenate(([True], anchor[1:] != anchor[:-1]))]
        found, where, n = np.unique(hashes[at], return_index=True, return_counts=True)
        at = at[where]
        doc = np.searchsorted(words.first, at, "right") - 1
        of = pa.array(doc + lo)
        yield pa.RecordBatch.from_arrays([K.long_array(found), batch.column(0).take(of), batch.column(1).take(of), pa.array((at - words.first[doc]).astype(np.int32)), pa.array(n)], names=["h", "d", "mark", "at", "n"])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    integer_id(docs, id_col)
    return docs.select(id_or_last(id_col).cast("long").alias("d"), text_mark(text_col).alias("mark"), F.col(text_col).alias("text"))


class FingerprintIndex:
    """Sorted immutable runs of counted hashes, in a folder that driver and executors share.

    A row of a run: the keys (hashes), n (times seen), d, mark and at (where, if it was
    seen once). What the folder holds is listed in it, so a later session goes on with it.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str] = ("h",), fanout: int = FANOUT):
        self.spark, self.folder, self.keys, self.fanout = spark, folder.rstrip("/"), list(keys), fanout
        held = self._listed()
        self.buckets = held["buckets"] if held else int(spark.conf.get("spark.sql.shuffle.partitions"))
        self._made, self._saved = (held["made"], held["saved"]) if held else (0, 0)
        self.runs: list[tuple[int, str]] = [tuple(x) for x in held["runs"]] if held else []  # (level, name), oldest first

    # the folder

    def _listed(self) -> dict | None:
        files, path = file_system(self.spark, self.folder)
        found = [str(x.getPath()) for x in files.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(path, "runs-*.json")) or []]
        return json.loads(self.spark.read.text(max(found), wholetext=True).first()[0]) if found else None

    def _save(self) -> None:
        """A new list beside the old ones; the last one holds."""
        files, path = file_system(self.spark, self.folder)
        self._saved += 1
        out = files.create(self.spark._jvm.org.apache.hadoop.fs.Path(path, f"runs-{self._saved:09d}.json"), False)
        out.write(json.dumps({"runs": self.runs, "made": self._made, "saved": self._saved, "buckets": self.buckets}).encode())
        out.close()

    def _columns(self) -> str:
        return ", ".join([*(f"{k} BIGINT" for k in self.keys), "n BIGINT", "d BIGINT", "mark BIGINT", "at BIGINT"])

    def open(self, name: str) -> DataFrame:
        """A run as a bucketed table; its entry in the catalogue is gone once the plan holds it."""
        entry, keys = f"simvane_{uuid.uuid4().hex}", ", ".join(self.keys)
        self.spark.sql(f"CREATE TABLE {entry} ({self._columns()}) USING parquet CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
        run = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")
        return run

    def _write(self, rows: DataFrame, name: str, *by: str) -> None:
        entry = f"simvane_{uuid.uuid4().hex}"
        out = rows.write.format("parquet").bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", f"{self.folder}/{name}")
        (out.partitionBy(*by) if by else out).saveAsTable(entry)
        self.spark.sql(f"DROP TABLE {entry}")

    # merge joins

    def met(self, run: DataFrame, others: Sequence[str]) -> DataFrame:
        """Merge join of a run with others: its rows and old_n (times seen in the others), old_d, old_mark, old_at (where, if once)."""
        old = [F.lit(0).cast("long"), *[F.lit(None).cast("long")] * 3]
        for k, name in enumerate(others):
            other = self.open(name).select(*self.keys, *(F.col(c).alias(f"{c}_{k}") for c in ("n", "d", "mark", "at")))
            run = run.hint("merge").join(other.hint("merge"), self.keys, "left")
            old = [old[0] + F.coalesce(F.col(f"n_{k}"), F.lit(0)), *(F.coalesce(x, F.col(f"{c}_{k}")) for x, c in zip(old[1:], ("d", "mark", "at"), strict=True))]
        return run.select(*self.keys, "n", "d", "mark", "at", *(x.alias(f"old_{c}") for x, c in zip(old, ("n", "d", "mark", "at"), strict=True)))

    def known(self, name: str) -> DataFrame:
        """The rows of a run, by its name, merge-joined with all other runs."""
        return self.met(self.open(name), [x for _, x in self.runs if x != name])

    def unique(self) -> DataFrame:
        """d, mark and at of the hashes seen once in all runs."""
        out = None
        for _, name in self.runs:
            once = self.known(name).filter("n = 1 and old_n = 0").select("d", "mark", "at")
            out = once if out is None else out.unionByName(once)
        return out

    # growth

    def add(self, rows: DataFrame, batches: int = 1) -> list[str]:
        """Adds rows (keys, d, mark, at, n) as a run, or dealt by a hash of d as `batches` of them, made in one pass; returns their names. `compact` comes later, as the runs are to be met first."""
        of = F.pmod(F.xxhash64(F.lit("batch"), "d"), F.lit(batches))
        parts = []
        for k in range(batches):  # one row for each hash, with the numbers of all batches: one shuffle, by the keys alone
            mine = (lambda c, k=k: F.when(of == k, F.col(c))) if batches > 1 else F.col
            parts += [F.sum(mine("n")).alias(f"n{k}"), *(F.min(mine(c)).alias(f"{c}{k}") for c in ("d", "mark", "at"))]
        # of a hash seen once, the smallest of each is that one place; plain numbers keep this a hash aggregation
        wide = rows.groupBy(*self.keys).agg(*parts)
        first = self._made
        self._made += batches
        if batches == 1:
            names = [f"run{first}"]
            self._write(wide.select(*self.keys, *(F.col(f"{c}0").cast("long").alias(c) for c in ("n", "d", "mark", "at"))), names[0])
        else:
            names = [f"run{first}/batch={k}" for k in range(batches)]
            each = F.array(*(F.struct(F.lit(k).alias("batch"), *(F.col(f"{c}{k}").cast("long").alias(c) for c in ("n", "d", "mark", "at"))) for k in range(batches)))
            self._write(wide.select(*self.keys, F.explode(each).alias("x")).select(*self.keys, "x.n", "x.d", "x.mark", "x.at", "x.batch").filter("n is not null"), f"run{first}", "batch")
            for name in names:  # a batch without a row has no folder yet
                files, path = file_system(self.spark, f"{self.folder}/{name}")
                files.mkdirs(path)
        return names

    def enter(self, name: str, drop: bool = True) -> None:
        """Takes a run into the history and merges runs where a level is full."""
        self.runs.append((0, name))
        level, gone = 0, []
        while len(full := [x for x in self.runs if x[0] == level]) >= self.fanout:
            merged = self.open(full[0][1])
            for _, other in full[1:]:
                merged = self._merged(merged, self.open(other))
            made = f"run{self._made}"
            self._made += 1
            self._write(merged, made)
            self.runs = [x for x in self.runs if x[0] != level] + [(level + 1, made)]
            gone += [x for _, x in full]
            level += 1
        self.runs.sort(key=lambda x: -x[0])
        self._save()
        for x in gone if drop else ():
            drop_folder(self.spark, f"{self.folder}/{x}")

    def _merged(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Merge join of two runs into one."""
        b = b.select(*self.keys, *(F.col(c).alias(f"{c}_") for c in ("n", "d", "mark", "at")))
        one = [F.coalesce(c, f"{c}_").alias(c) for c in ("d", "mark", "at")]
        return a.hint("merge").join(b.hint("merge"), self.keys, "full_outer").select(*self.keys, (F.coalesce("n", F.lit(0)) + F.coalesce("n_", F.lit(0))).alias("n"), *one)


def anchor_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    """h, d, mark, at, n of keyed documents, summed over chunks."""
    return rows.mapInArrow(per_batch(lambda b: _rows(b, window, gram)), "h long, d long, mark long, at int, n long")


def _places(found: DataFrame, name: str) -> DataFrame:
    return found.groupBy("d", "mark").agg(F.collect_list(F.col("at").cast("int")).alias(name))


def _candidates(words: K.Words, places: np.ndarray, anchor: np.ndarray, single: pa.Array, docs: int) -> np.ndarray:
    """Which windows have an anchor that is not among the places in single, lists by document."""
    offsets = single.offsets.to_numpy()
    flat = single.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    once = np.zeros(len(words.hashes) + 1, bool)
    once[np.repeat(words.first[:-1], np.diff(offsets)) + flat] = True
    return ~once[anchor]


def _facts(rows: DataFrame, single: DataFrame) -> DataFrame:
    """rows with n_copies (of the class of equal texts, at one of its documents; else 0) and single."""
    none = F.array().cast("array<int>")
    classes = rows.select("d", "mark", F.xxhash64(F.lit(21), "text").alias("mark2")).groupBy("mark", "mark2").agg(F.min("d").alias("d"), F.count("*").alias("n_copies"))
    # the small sides meet first, so a text takes part in one join
    side = classes.select("d", "mark", "n_copies").join(_places(single, "single"), ["d", "mark"], "full_outer")
    return rows.join(side, ["d", "mark"], "left").select("d", "mark", "text", F.coalesce("n_copies", F.lit(0).cast("long")).alias("n_copies"), F.coalesce("single", none).alias("single"))


def _window_rows(facts: DataFrame, window: int, gram: int, only: bool = False) -> DataFrame:
    """w1, w2, d, mark, at, n of the nominated windows of one document of each class; with only, of the windows with an anchor among single."""

    def whole(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        heads = batch.filter(pa.array(batch.column(3).to_numpy() > 0))
        for lo, hi, data, offsets in K.chunks(heads.column(2)):
            words = K.words_of(data, offsets)
            places, anchor, _ = anchors_of(words, window, gram)
            at = places[_candidates(words, places, anchor, heads.column(4).slice(lo, hi - lo), hi - lo) != only]
            if not len(at):
                continue
            w1 = K.runs_of(words.hashes, window)[at]
            w2 = K.runs_of(K.words_of(data, offsets, seed=2).hashes, window, 2)[at]
            doc = np.searchsorted(words.first, at, "right") - 1
            of = pa.array(doc + lo)
            yield pa.RecordBatch.from_arrays([K.long_array(w1), K.long_array(w2), heads.column(0).take(of), heads.column(1).take(of), pa.array(at - words.first[doc]), heads.column(3).take(of)], names=["w1", "w2", "d", "mark", "at", "n"])

    return facts.mapInArrow(per_batch(whole), "w1 long, w2 long, d long, mark long, at long, n long")


def removed_words(batch: pa.RecordBatch, window: int, gram: int) -> Iterator[tuple[int, int, np.ndarray, K.Words, np.ndarray]]:
    """(from row, to row, bytes, words, whether each word is removed) for rows d, mark, text, n_copies, single, unique."""
    for lo, hi, data, offsets in K.chunks(batch.column(2)):
        words = K.words_of(data, offsets)
        places, anchor, _ = anchors_of(words, window, gram)
        again = _candidates(words, places, anchor, batch.column(4).slice(lo, hi - lo), hi - lo)
        unique = _candidates(words, places, places, batch.column(5).slice(lo, hi - lo), hi - lo)
        copied = batch.column(3).slice(lo, hi - lo).to_numpy() != 1
        doc = np.searchsorted(words.first, places, "right") - 1
        yield lo, hi, data, words, K.covered(places[again & unique | copied[doc]], len(words.hashes), window)


def _digests(facts: DataFrame, unique: DataFrame, window: int, gram: int) -> DataFrame:
    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        n_words, n_removed, kept = [], [], []
        for lo, hi, data, words, gone in removed_words(batch, window, gram):
            n_words.append(np.diff(words.first))
            sums = np.concatenate(([0], np.cumsum(gone)))
            n_removed.append(np.diff(sums[words.first]))
            kept += [hashlib.sha256(_joined(data, words, gone, k)).hexdigest() for k in range(hi - lo)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_removed)), pa.array(kept)], names=["d", "n_words", "n_removed", "kept_sha256"])

    none = F.array().cast("array<int>")
    marked = facts.join(_places(unique, "unique"), ["d", "mark"], "left").select("d", "mark", "text", "n_copies", "single", F.coalesce("unique", none).alias("unique"))
    out = marked.mapInArrow(per_batch(digest), "d long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def substring_digests(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs, judged on the whole of docs."""
    index = FingerprintIndex(docs.sparkSession, shared_folder(docs.sparkSession), fanout=fanout)
    rows = keyed(docs, id_col, text_col)
    for name in index.add(anchor_rows(rows, window, gram), batches):
        index.enter(name)
    facts = _facts(rows, index.unique())
    counted = _window_rows(facts, window, gram).groupBy("w1", "w2").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("d", "mark", "at")))
    return _digests(facts, counted.filter("n = 1"), window, gram)


class SubstringIndex:
    """Incremental substring dedup: an index of anchors and one of verified windows, in a folder that outlives the session."""

    def __init__(self, spark: SparkSession, folder: str, window: int = WINDOW, gram: int = GRAM, fanout: int = FANOUT):
        self.window, self.gram = window, gram
        self.anchors = FingerprintIndex(spark, f"{folder.rstrip('/')}/anchors", fanout=fanout)
        self.windows = FingerprintIndex(spark, f"{folder.rstrip('/')}/windows", ("w1", "w2"), fanout)

    def dedup(self, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 of each row of a new batch, judged on itself and on all batches before it, which `history` has to hold. Documents of earlier batches are not judged again."""
        window, gram, spark = self.window, self.gram, docs.sparkSession
        folder = shared_folder(spark)
        rows = keyed(docs, id_col, text_col)
        (new,) = self.anchors.add(anchor_rows(rows, window, gram))
        met = stored(self.anchors.known(new).filter("n = 1 and old_n = 0 or old_n = 1"), f"{folder}/met")
        facts = _facts(rows, met.filter("n = 1 and old_n = 0").select("d", "mark", "at"))
        mine = stored(_window_rows(facts, window, gram).groupBy("w1", "w2").agg(F.sum("n").alias("n"), *(F.min(c).alias(c) for c in ("d", "mark", "at"))), f"{folder}/windows")
        every = mine
        if self.anchors.runs:
            if history is None:
                raise ValueError("the documents of earlier batches are needed")
            # anchors seen once in the history and now again: the windows on them have not been verified yet
            woken = met.filter("old_n = 1").select(F.col("old_d").alias("d"), F.col("old_mark").alias("mark"), F.col("old_at").alias("at"))
            old = keyed(history, id_col, text_col).join(_places(woken, "single"), ["d", "mark"]).dropDuplicates(["d", "mark"]).select("d", "mark", "text", F.lit(1).cast("long").alias("n_copies"), "single")
            every = mine.unionByName(_window_rows(old, window, gram, only=True).select(*mine.columns))
        (verified,) = self.windows.add(every)
        once = self.windows.known(verified).filter("n = 1 and old_n = 0").select("w1", "w2")
        unique = stored(mine.filter("n = 1").join(once, ["w1", "w2"], "left_semi").select("d", "mark", "at"), f"{folder}/unique")
        self.anchors.enter(new)
        self.windows.enter(verified)
        return _digests(facts, unique, window, gram)


def _joined(data: np.ndarray, words: K.Words, gone: np.ndarray, k: int) -> bytes:
    """The words of text k that are left, joined by one space."""
    own = slice(words.first[k], words.first[k + 1])
    left = ~gone[own]
    starts, ends = words.starts[own][left], words.ends[own][left]
    if not len(starts):
        return b""
    size = ends - starts + 1
    to = np.cumsum(size)
    at = np.repeat(starts - (to - size), size) + np.arange(to[-1])
    out = data[np.minimum(at, len(data) - 1)]
    out[to - 1] = 0x20
    return out[:-1].tobytes()
