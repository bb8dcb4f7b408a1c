"""Quality rules: repetition coverage.

For every document, word n-grams of several lengths are hashed with a rolling
hash in numpy, each length's from that of the one before by the next word, and the
characters that lie inside n-grams found twice or more in the same document are
measured, likewise the characters of repeated lines. A
document is rejected when a share exceeds the limit for its n-gram length or the
limit for lines, or when a base rule fails.

Plan: one scan and one Arrow map; no shuffle, no state between documents. Memory
is bounded by one Arrow batch plus a few machine words for each word of about
one megabyte of text (or of one longer text).

Defined results: a null text and an empty text have no words, fail the base rule
and are not kept; rows that repeat an id are judged one by one; an empty table
gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from simvane.llm import textkit as K
from simvane.llm.common import per_batch

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
#: Largest share of word characters inside repeated n-grams, by n.
GRAM_LIMITS = {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30}
#: Largest share of word characters inside lines that repeat another line.
LINE_LIMIT = 0.30
MIN_WORDS = 50

SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, gram_chars map<int,long>, dup_line_chars long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_MARK = np.uint64(0x9E3779B97F4A7C15)
_ROLL = np.uint64(0xD1342543DE82EF95)


def _per_doc(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive edges."""
    sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return np.diff(sums[edges])


def _share_over(part: np.ndarray, whole: np.ndarray, limit: float) -> np.ndarray:
    return part > limit * whole


def measure(data: np.ndarray, offsets: np.ndarray, gram_limits: Mapping[int, float], line_limit: float) -> dict[str, np.ndarray]:
    """The signals of the texts data[offsets[d]:offsets[d + 1]]."""
    words = K.words_of(data, offsets)
    docs = len(offsets) - 1
    n_words = np.diff(words.first)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    word_points = points[words.ends] - points[words.starts]
    doc = np.repeat(np.arange(docs), n_words)
    salt = K.mix(doc.astype(np.uint64) + np.uint64(1)) * _MARK

    h = words.hashes
    out = {"n_words": n_words, "word_chars": _per_doc(word_points, words.first), "n_symbols": _per_doc(_SYMBOL[data], offsets)}

    at = np.flatnonzero(words.starts_of(3))
    at = at[K.repeated(K.runs_of(h, 3)[at] + salt[at])]
    out["n_repeat_words"] = _per_doc(K.covered(at, len(h), 3), words.first)

    last = words.doc_end()
    key, length = np.zeros(len(at), np.uint64), 0
    for n in sorted(gram_limits):  # an n-gram repeats only where each shorter one does
        held = at + n <= last[at]
        at, key = at[held], key[held]
        while length < n:  # the hash rolls on by one word
            key = key * _ROLL + h[at + length]
            length += 1
        again = K.repeated(K.mix(key) + salt[at])
        at, key = at[again], key[again]
        out[f"gram_{n}"] = _per_doc(K.covered(at, len(h), n) * word_points, words.first) if len(at) else np.zeros(docs, np.int64)

    starts, ends, first = K.lines_of(data, offsets)
    low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    with_word = high > low
    line_doc = np.repeat(np.arange(docs), np.diff(first))
    key = K.segment_hashes(data, starts, ends) + K.mix(line_doc.astype(np.uint64) + np.uint64(1)) * _MARK
    spoken = np.flatnonzero(with_word)
    order = spoken[np.argsort(key[spoken], kind="stable")]
    again = np.zeros(len(key), bool)
    if len(order):
        again[order[1:][key[order][1:] == key[order][:-1]]] = True
    out["n_dup_lines"] = _per_doc(again, first)
    same = np.zeros(len(key), bool)
    same[spoken] = K.repeated(key[spoken])
    summed = np.concatenate(([0], np.cumsum(word_points)))
    out["dup_line_chars"] = _per_doc(same * (summed[high] - summed[low]), first)

    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > 50 * n_words)
    bad = out["base_failed"] | _share_over(out["dup_line_chars"], out["word_chars"], line_limit)
    for n, limit in gram_limits.items():
        bad |= _share_over(out[f"gram_{n}"], out["word_chars"], limit)
    out["kept"] = ~bad
    return out


def _checked(gram_limits: Mapping[int, float]) -> dict[int, float]:
    if any(n < 3 for n in gram_limits):
        raise ValueError("n-grams have 3 words at least, as repeats are looked for from the base rule's 3-word windows on")
    return dict(gram_limits)


def _measured(texts: pa.Array, gram_limits: Mapping[int, float], line_limit: float) -> dict[str, np.ndarray]:
    parts = [measure(data, offsets, gram_limits, line_limit) for _, _, data, offsets in K.chunks(texts)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def quality_signals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram_limits: Mapping[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """One row for each row of docs: its id, the base counts, the characters inside repeated n-grams and lines, and the verdict."""
    limits = _checked(gram_limits)

    def signals(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _measured(batch.column(1), limits, line_limit)
        n = batch.num_rows
        columns = [batch.column(0)]
        columns += [pa.array(x[k]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
        keys = np.tile(np.array(sorted(limits), np.int32), n)
        values = np.stack([x[f"gram_{k}"] for k in sorted(limits)], axis=1).reshape(-1) if limits else np.zeros(0, np.int64)
        columns.append(pa.MapArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(limits)), pa.array(keys), pa.array(values)))
        columns.append(pa.array(x["dup_line_chars"]))
        return pa.RecordBatch.from_arrays(columns, names=[id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "gram_chars", "dup_line_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(per_batch(signals), f"`{id_col}` {kind}, {SIGNALS}")


def quality_filter(docs: DataFrame, text_col: str = "text", gram_limits: Mapping[int, float] = GRAM_LIMITS, line_limit: float = LINE_LIMIT) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    limits, at = _checked(gram_limits), docs.columns.index(text_col)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pc.filter(batch, pa.array(_measured(batch.column(at), limits, line_limit)["kept"]))

    return docs.mapInArrow(per_batch(keep), docs.schema)
