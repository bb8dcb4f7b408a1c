r"""Line dedup by overlapping three-line windows.

A line is a \n-split line with a word in it; three consecutive lines of one
document make a window. Windows are compared over the whole table; of equal
windows the first by (doc_id, place) stays and the lines of all later ones are
removed, overlapping stretches merged. Lines without a word are left where they
are. A removed line always has an earlier equal line, so one copy of every line
stays.

Plan: the windows of a document are hashed to 128 bits in one Arrow map; an
aggregation with partial sums finds the first place of each window, so a window
that a third of all documents share costs one row for each task. What goes back
to the documents is the list of *first* places, at most one row for each window,
never one for each pair of equal windows; so no join key is hotter than the
document with the most windows. Texts are shuffled once, by their document; equal rows
are made one with a count before that, and are told apart again at the end.

Defined results: a null text stays null and has no lines; documents of fewer than
`window` lines are untouched; rows that repeat an id with another text are told
apart by the text; exact repeats of a row count as later copies of each other,
one of them stays whole; ids are integers (others raise); an empty table gives an
empty result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from simvane.llm import textkit as K
from simvane.llm.common import id_or_last, integer_id, per_batch, row_mark, text_mark

WINDOW = 3
KEYS = ["d", "mark", "own"]


def _spoken(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the lines that hold a word."""
    starts, ends, first = K.lines_of(data, offsets)
    word_starts = K.words_of(data, offsets, hashed=False).starts
    has = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    return starts[has], ends[has], np.concatenate(([0], np.cumsum(has)))[first]


def _windows(batch: pa.RecordBatch, window: int):
    """For one batch of (d, mark, own, text): rows (h1, h2, d, mark, own, at) of all windows."""
    for lo, hi, data, offsets in K.chunks(batch.column(3)):
        starts, ends, first = _spoken(data, offsets)
        last = np.repeat(first[1:], np.diff(first))
        ok = np.flatnonzero(np.arange(len(starts)) + window <= last)
        if not len(ok):
            continue
        doc = np.repeat(np.arange(lo, hi), np.diff(first))[ok]
        at = ok - np.repeat(first[:-1], np.diff(first))[ok]
        hashes = [K.runs_of(K.segment_hashes(data, starts, ends, seed), window, seed)[ok] for seed in (1, 2)]
        yield pa.RecordBatch.from_arrays([*map(K.long_array, hashes), *(batch.column(i).take(pa.array(doc)) for i in range(3)), pa.array(at.astype(np.int32))], names=["h1", "h2", *KEYS, "at"])


def _keys(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """d and mark (the id and the text) and own (the whole row) of each row of docs."""
    integer_id(docs, id_col)
    return [id_or_last(docs[id_col]).cast("long").alias("d"), text_mark(docs[text_col]).alias("mark"), row_mark(docs).alias("own")]


def first_places(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document that holds the first of some window: d, mark, own, places (line numbers among lines with a word)."""
    rows = docs.select(*_keys(docs, id_col, text_col), docs[text_col].alias("text"))
    windows = rows.mapInArrow(per_batch(lambda b: _windows(b, window)), "h1 long, h2 long, d long, mark long, own long, at int")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct(*KEYS, "at")).alias("f"))
    return first.select("f.*").groupBy(*KEYS).agg(F.collect_list("at").alias("places"))


def _removed(first: np.ndarray, places: pa.Array, window: int) -> np.ndarray:
    """Which lines lie in a window that is not the first of its kind."""
    n = np.diff(first)
    last = np.repeat(first[1:], n)
    later = np.arange(len(last)) + window <= last
    offsets = places.offsets.to_numpy()
    flat = places.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    doc = np.repeat(np.arange(len(n)), np.diff(offsets))
    later[first[doc] + flat] = False
    return K.covered(np.flatnonzero(later), len(last), window)


def _deduped(docs: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """row (the columns of docs, the text without later copies of windows), n_lines (lines with a word) and n_removed."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_keys(docs, id_col, text_col))
    each = rows.groupBy(*KEYS).agg(F.first("row").alias("row"), F.count("*").alias("n"))
    joined = each.join(first_places(docs, window, id_col, text_col), KEYS, "left")
    # of equal rows, only one holds the first places
    none = F.array().cast("array<int>")
    joined = joined.select("row", "places", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("nth"))
    joined = joined.select("row", F.when(F.col("nth") == 0, F.coalesce("places", none)).otherwise(none).alias("places"))
    at = docs.columns.index(text_col)

    def clean(batch: pa.RecordBatch) -> pa.RecordBatch:
        row = batch.column(0)
        fields = [row.field(i) for i in range(row.type.num_fields)]
        texts, places = fields[at], batch.column(1)
        new, n_lines, n_removed = [], [], []
        for lo, hi, data, offsets in K.chunks(texts):
            starts, ends, first = _spoken(data, offsets)
            gone = _removed(first, places.slice(lo, hi - lo), window)
            n_lines.append(np.diff(first))
            sums = np.concatenate(([0], np.cumsum(gone)))
            n_removed.append(np.diff(sums[first]))
            for k in range(hi - lo):
                text = texts[lo + k].as_py()
                if n_removed[-1][k]:
                    own = slice(first[k], first[k + 1])
                    raw, base = data[offsets[k] : offsets[k + 1]].tobytes(), offsets[k]
                    out, pos = [], 0
                    for a, b in zip(starts[own][gone[own]] - base, ends[own][gone[own]] - base, strict=True):
                        out.append(raw[pos:a])
                        pos = min(b + 1, len(raw))
                    out.append(raw[pos:])
                    kept = b"".join(out)
                    if pos >= len(raw) and kept.endswith(b"\n") and not raw.endswith(b"\n"):
                        kept = kept[:-1]
                    text = kept.decode()
                new.append(text)
        fields[at] = pa.array(new, fields[at].type)
        made = pa.StructArray.from_arrays(fields, fields=[row.type.field(i) for i in range(row.type.num_fields)])
        return pa.RecordBatch.from_arrays([made, pa.array(np.concatenate(n_lines)), pa.array(np.concatenate(n_removed))], names=["row", "n_lines", "n_removed"])

    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    return joined.mapInArrow(per_batch(clean), schema)


def dedup_lines(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines_", "n_removed_")) -> DataFrame:
    """The rows of docs with all their columns, later copies of windows removed from the text, and the two `counts`: lines with a word and lines removed. A name that docs has is refused."""
    if taken := set(counts) & set(docs.columns):
        raise ValueError(f"docs has columns {sorted(taken)}; name the counts otherwise")
    out = _deduped(docs, window, id_col, text_col)
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("n_lines").alias(counts[0]), F.col("n_removed").alias(counts[1]))


def line_digests(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the text left, null if the text is)."""
    out = _deduped(docs.select(id_col, text_col), window, id_col, text_col)
    return out.select(F.col("row")[id_col].alias("doc_id"), "n_lines", "n_removed", F.sha2(F.col("row")[text_col].cast("binary"), 256).alias("kept_sha256"))


def dedup_documents(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows and columns of docs, later copies of windows removed from the text; rows left without a character are dropped if a line of theirs was removed, and n_chars, where docs has it, follows the text."""
    out = _deduped(docs, window, id_col, text_col)
    text, changed = F.col("row")[text_col], F.col("n_removed") > 0
    out = out.filter(~(changed & (F.length(text) == 0)))
    new = {c: F.col("row")[c] for c in docs.columns}
    if "n_chars" in new:
        new["n_chars"] = F.when(changed, F.length(text)).otherwise(new["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(x.alias(c) for c, x in new.items()))
