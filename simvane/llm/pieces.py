"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs: the pair whose joined piece
has the best score is merged first, the leftmost one among equals, until no
adjacent pair joins to a piece; symbols outside the vocabulary become byte pieces.

A text is first cut where no merge can reach across: between two characters that
stand side by side in no piece, so before each word mark that follows another
character, and around characters that only byte pieces can write. Segments are
independent, so each is encoded once and its ids are held in a cache of bounded
size, as are those of the words made of them; a text's ids are its segments' ids
laid end to end. The agendas of all segments new to the cache are worked in step
in numpy, one merge of each segment at a time; a segment of more than LONGEST
characters gets a heap of its own. The new segments are also given to the
sentencepiece library, and the task fails if an id differs.

Plan: one scan and one Arrow map, no shuffle. Besides the batch, a worker holds
at most 2 * CACHE words and segments of at most LONGEST characters and those of the
batch, and gives them and the model back when its task ends.

Defined results: a null text counts as empty; an empty text has just the begin
and end ids and decodes to ""; rows that repeat an id are encoded one by one; an
empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from simvane.llm.common import per_batch, tidy

MARK = "▁"
CACHE = 30_000
NONE = np.int32(2**31 - 1)
#: Classes of characters that are told apart where a text is cut.
CLASSES = 2048
LONGEST = 40
#: Characters of text that are worked on together.
TOGETHER = 1_000_000


class PieceModel:
    """Encoder and decoder for one serialized model of merge type with identity normalisation."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.id_of = {self.pieces[i]: i for i in plain}
        self.score_of = {self.pieces[i]: sp.get_score(i) for i in plain}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_of = {v: k for k, v in self.byte_id.items()}
        self.silent = {i for i in range(n) if sp.is_control(i)}
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        for probe in ("a  b", " a", "a ", "\t a\n", "ﬁ Ⅳ"):
            if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
                raise ValueError("the model must use identity normalisation with a leading mark")
        longer = [p for p in self.id_of if len(p) > 1]
        self._build_cuts(longer)
        self._bytelike = frozenset(self.byte_of) | {self.unk} | self.silent
        self._said = [p.replace(MARK, " ") for p in self.pieces]
        self._build_pairs()
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        #: Decoded text of the parts in the cache that don't decode to themselves.
        self._odd: dict[str, str] = {}

    def _build_cuts(self, longer: list[str]) -> None:
        """Classes of characters (0: in no longer piece, 1: not told apart) and which classes stand side by side in a piece."""
        inner = sorted(set("".join(longer)), key=lambda c: (c != MARK, c))
        self._class = np.zeros(0x110000, np.int16)
        for k, c in enumerate(inner):
            self._class[ord(c)] = k + 2 if k < CLASSES - 2 else 1
        self._beside = np.zeros((CLASSES, CLASSES), bool)
        self._beside[1, 1:] = self._beside[1:, 1] = True
        for piece in longer:
            k = self._class[[ord(c) for c in piece]]
            self._beside[k[:-1], k[1:]] = True
        mark = self._class[ord(MARK)]
        self._words_apart = not self._beside[:, mark].any() or (self._beside[:, mark].sum() == 1 and self._beside[mark, mark])

    def _cut(self, texts: list[str]) -> list[list[str]]:
        """Segments of each normalised text."""
        whole = "".join(texts)
        if not whole:
            return [[] for _ in texts]
        k = self._class[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")]
        cut = np.empty(len(k) + 1, bool)
        cut[0] = cut[-1] = True
        np.logical_not(self._beside[k[:-1], k[1:]], out=cut[1:-1])
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        cut[ends] = True
        edges = np.flatnonzero(cut)
        last = np.searchsorted(edges, ends).tolist()
        at = edges.tolist()
        segments = [whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        return [segments[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]

    def _build_pairs(self) -> None:
        """A hash table from pairs of ids to the rank of their joined piece, and from ranks to pieces."""
        order = sorted(self.id_of, key=lambda p: -self.score_of[p])
        scores = np.array([self.score_of[p] for p in order])
        level = np.concatenate(([0], np.cumsum(scores[1:] != scores[:-1])))
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for piece, rank in zip(order, level.tolist(), strict=True):
            for cut in range(1, len(piece)):
                a, b = self.id_of.get(piece[:cut]), self.id_of.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = (rank, self.id_of[piece])
        keys = np.array([a << 32 | b for a, b in pairs], np.uint64)
        values = np.array(list(pairs.values()), np.int32).reshape(-1, 2)
        self._bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self._key = np.full(1 << self._bits, np.iinfo(np.uint64).max, np.uint64)
        self._rank = np.full(1 << self._bits, NONE, np.int32)
        self._join = np.full(1 << self._bits, -1, np.int32)
        slot, left, self._probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self._probes += 1
            free = self._key[slot[left]] == np.iinfo(np.uint64).max
            tried = left[free]
            self._key[slot[tried]] = keys[tried]
            left = left[self._key[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self._bits) - 1)
        at = self._find(keys)
        self._rank[at], self._join[at] = values[:, 0], values[:, 1]
        self._char = np.full(0x110000, -1, np.int32)
        for piece, i in self.id_of.items():
            if len(piece) == 1:
                self._char[ord(piece)] = i

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 for a pair that joins to no piece."""
        slot = self._slot(keys)
        out = np.where(self._key[slot] == keys, slot, -1)
        left = np.flatnonzero((out < 0) & (self._key[slot] != np.iinfo(np.uint64).max))
        for _ in range(self._probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & ((1 << self._bits) - 1)
            got = self._key[slot[left]]
            hit = got == keys[left]
            out[left[hit]] = slot[left[hit]]
            left = left[~hit & (got != np.iinfo(np.uint64).max)]
        return out

    def _pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._find(a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64))
        return np.where(at < 0, NONE, self._rank[at]), self._join[at]

    def merged_together(self, segments: list[str]) -> list[list[int]]:
        """Ids of many segments: the agenda of each is a row of ranks, and each round takes the best pair of every row."""
        out: list[list[int]] = [[]] * len(segments)
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(lengths, kind="stable")
        for lo in range(0, len(order), 8192):
            rows = order[lo : lo + 8192]
            size = lengths[rows]
            width = max(1, int(size[-1]))
            chars = np.frombuffer("".join([segments[i] for i in rows]).encode("utf-32-le", "surrogatepass"), "<u4")
            mine = np.arange(width) < size[:, None]
            symbol = np.zeros((len(rows), width + 1), np.int32)
            symbol[:, :width][mine] = self._char[chars]
            odd = ((symbol < 0) | (lengths[rows] > LONGEST)[:, None]).any(axis=1)
            rank = np.full((len(rows), width + 1), NONE, np.int32)
            pair = (np.arange(width) < size[:, None] - 1) & ~odd[:, None]
            r, c = np.nonzero(pair)
            rank[r, c] = self._pair(symbol[r, c], symbol[r, c + 1])[0]
            live = np.flatnonzero(~odd)
            done = symbol.copy()
            count = size.copy()
            symbol, rank, left = symbol[live], rank[live], size[live]
            at = np.arange(width + 1)
            while len(live):
                best = rank.argmin(axis=1)
                n = np.arange(len(live))
                more = rank[n, best] != NONE
                if not more.all():
                    ended = ~more
                    done[live[ended], : symbol.shape[1]], count[live[ended]] = symbol[ended], left[ended]
                    live, symbol, rank, left, best = live[more], symbol[more], rank[more], left[more], best[more]
                    n = np.arange(len(live))
                    if not len(live):
                        break
                symbol[n, best] = self._pair(symbol[n, best], symbol[n, best + 1])[1]
                source = np.minimum(at + (at > best[:, None]), symbol.shape[1] - 1)
                symbol = np.take_along_axis(symbol, source, axis=1)
                source = np.minimum(at + (at >= best[:, None]), symbol.shape[1] - 1)
                rank = np.take_along_axis(rank, source, axis=1)
                left = left - 1
                for edge, there in ((best, best + 1 < left), (best - 1, best > 0)):
                    e = edge[there]
                    i = n[there]
                    rank[i, e] = self._pair(symbol[i, e], symbol[i, e + 1])[0]
                ends = np.flatnonzero(best + 1 >= left)
                rank[ends, best[ends]] = NONE
            for k, i in enumerate(rows.tolist()):
                out[i] = self.merged(segments[i]) if odd[k] else done[k, : count[k]].tolist()
        return out

    def merged(self, text: str) -> list[int]:
        """Ids of normalised text by the agenda alone."""
        symbols = list(text)
        n = len(symbols)
        score = self.score_of
        agenda = [(-s, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (s := score.get(symbols[i] + symbols[i + 1])) is not None]
        if agenda:
            heapq.heapify(agenda)
            after = list(range(1, n + 1))
            before = list(range(-1, n - 1))
            while agenda:
                _, i, piece = heapq.heappop(agenda)
                left = symbols[i]
                if not left or (j := after[i]) >= n or len(left) >= len(piece) or left + symbols[j] != piece:
                    continue  # one of the two has been merged since
                symbols[i], symbols[j] = piece, ""
                k = after[i] = after[j]
                if k < n:
                    before[k] = i
                    joined = piece + symbols[k]
                    if (s := score.get(joined)) is not None:
                        heapq.heappush(agenda, (-s, i, joined))
                if (k := before[i]) >= 0:
                    joined = symbols[k] + piece
                    if (s := score.get(joined)) is not None:
                        heapq.heappush(agenda, (-s, k, joined))
        ids = []
        for symbol in symbols:
            if symbol:
                if (i := self.id_of.get(symbol)) is not None:
                    ids.append(i)
                elif self.byte_id:
                    ids.extend(self.byte_id[b] for b in symbol.encode())
                else:
                    ids.append(self.unk)
        return ids

    def decoded(self, ids: Iterable[int]) -> str:
        """Text of ids, as the library's decode gives it."""
        out, held, first = [], bytearray(), True
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                held.append(b)
                continue
            if held:
                out.append(_from_bytes(held))
                held, first = bytearray(), False
            if i in self.silent:
                continue
            if i == self.unk:
                out.append(" ⁇ ")
                first = False
                continue
            piece = self.pieces[i]
            if first and piece.startswith(MARK):  # the mark that encoding put in front
                piece = piece[1:]
            first = False
            out.append(piece.replace(MARK, " "))
        if held:
            out.append(_from_bytes(held))
        return "".join(out)

    def _fresh(self, names: list[str]) -> list[tuple[bytes, str]]:
        """(ids as bytes, decoded text) of segments, checked against the library."""
        made = self.merged_together(names)
        # the library puts a mark in front of what it encodes; "\n" holds it off, as no merge crosses it
        guard = "\n"
        lead = self.merged(MARK) + self.merged(guard)
        plain = [s.replace(MARK, " ") for s in names]
        theirs = self.library.encode([guard + s for s in plain], num_threads=1)
        skip = len(lead)
        if any(ids[skip:] != mine or ids[:skip] != lead for mine, ids in zip(made, theirs, strict=True)):
            wrong = next(x for x in zip(names, made, theirs, strict=True) if x[2] != lead + x[1])
            raise AssertionError(f"segment {wrong[0]!r}: {wrong[1]}, the library has {wrong[2][skip:]}")
        edges = np.concatenate(([0], np.cumsum([len(x) for x in made]))) * 4
        flat = np.fromiter(chain.from_iterable(made), "<u4", int(edges[-1]) // 4).tobytes()
        at = edges.tolist()
        return [(flat[a:b], self._inside(ids)) for a, b, ids in zip(at[:-1], at[1:], made, strict=True)]

    def _inside(self, ids: list[int]) -> str:
        """Decoded text of a segment, with all of its marks as spaces."""
        if self._bytelike.isdisjoint(ids):
            said = self._said
            return "".join([said[i] for i in ids])
        return self.decoded([self.id_of[MARK], *ids])

    def _split(self, text: str) -> tuple[list[str], bool]:
        """(words between single spaces, True) or, where spaces or marks run together, (segments, False)."""
        if self._words_apart and "  " not in text and MARK not in text and text[0] != " " and text[-1] != " ":
            return text.split(" "), True
        return self._cut([MARK + text.replace(" ", MARK)])[0], False

    def _bring(self, wanted: Iterable[str]) -> dict[str, bytes]:
        """Brings parts into the cache; returns those too long for it."""
        if len(self._young) > CACHE:
            self._old, self._young = self._young, {}
            self._odd = {k: v for k, v in self._odd.items() if k in self._old}
        young, old = self._young, self._old
        # a word between single spaces stands in the cache under its own name, a segment under " " and its name, as no word has a space
        new: dict[str, None] = {}

        def bring(names: Iterable[str]) -> None:
            for name in names:
                if name not in young:
                    if (v := old.get(name)) is not None:
                        young[name] = v
                    else:
                        new[name] = None

        bring(wanted)
        if not new:
            return {}
        long: dict[str, bytes] = {}
        spelt = [x for x in new if x[0] != " "]
        made_of = [[" " + s for s in x] for x in self._cut([MARK + x for x in spelt])]
        bring(chain.from_iterable(made_of))
        needed = [x for x in new if x[0] == " "]
        for name, (ids, said) in zip(needed, self._fresh([x[1:] for x in needed]), strict=True):
            (young if len(name) <= LONGEST else long)[name] = ids
            if said != name[1:].replace(MARK, " "):
                self._odd[name] = said
        for name, segments in zip(spelt, made_of, strict=True):
            ids = b"".join([young[x] if x in young else long[x] for x in segments])
            (young if len(name) <= LONGEST else long)[name] = ids
            if self._odd and not self._odd.keys().isdisjoint(segments):
                said = "".join([self._odd.get(x, x[1:].replace(MARK, " ")) for x in segments])
                if said != " " + name:
                    self._odd[name] = said
        return long

    def round_trips(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """(ids with begin and end as little-endian 32-bit bytes, their decoded text) of each text."""
        names, ids, wanted = [], [], set()
        for text in texts:
            mine, words = self._split(text) if text else ([], True)
            if not words:
                mine = [" " + x for x in mine]
            got = list(map(self._young.get, mine))
            if None in got:
                wanted.update([x for x, v in zip(mine, got, strict=True) if v is None])
            names.append(mine)
            ids.append(got)
        long = self._bring(wanted)
        young, odd = self._young, self._odd
        bos, eos = (np.asarray([i], "<u4").tobytes() for i in (self.bos, self.eos))
        for k, (text, mine, got) in enumerate(zip(texts, names, ids, strict=True)):
            if None in got:
                got = [v if v is not None else young[x] if x in young else long[x] for x, v in zip(mine, got, strict=True)]
            if odd and not odd.keys().isdisjoint(mine):
                text = "".join([odd[x] if x in odd else x[1:].replace(MARK, " ") if x.startswith(" ") else " " + x for x in mine])
                text = text[1:] if text.startswith(" ") else text
            elif MARK in text:
                text = text.replace(MARK, " ")
            names[k] = ids[k] = ()
            yield b"".join([bos, *got, eos]), text

    def round_trip(self, text: str) -> tuple[bytes, str]:
        return next(self.round_trips([text]))


def _from_bytes(held: bytearray) -> str:
    """Text of byte pieces: whole characters where they are valid, else one replacement character for each byte."""
    out, i = [], 0
    while i < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(held[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                if n == 4 or i + n >= len(held):
                    out.append("�")
                    i += 1
                    break
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model_of(proto: bytes) -> PieceModel:
    """One model, with its cache, for each task."""
    key = hashlib.sha256(proto).hexdigest()
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = PieceModel(proto)
    return _MODELS[key]


def let_go() -> None:
    """Drops the model at a task's end: the worker may wait long beside others. A function of the module, as what tasks refer to directly is a copy."""
    _MODELS.clear()
    tidy()


def read_model(path: str) -> bytes:
    """The model file, read on the driver; tasks get its bytes (under a megabyte)."""
    with open(path, "rb") as file:
        return file.read()


def _together(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about TOGETHER characters."""
    lo, held, size = 0, [], 0
    for i, x in enumerate(column):
        text = x.as_py() or ""
        if held and size + len(text) > TOGETHER:
            yield lo, held
            lo, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield lo, held


def _mapped(docs: DataFrame, id_col: str, text_col: str, proto: bytes, fields: list[tuple[str, T.DataType, pa.DataType]], row: Callable[[bytes, str], tuple]) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(proto)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model = model_of(held.value)
        for at, texts in _together(batch.column(1)):
            rows = [row(ids, said) for ids, said in model.round_trips(texts)]
            columns = [batch.column(0).slice(at, len(rows)), *(pa.array(list(x), kind) for x, (_, _, kind) in zip(zip(*rows, strict=True), fields, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, *(f[0] for f in fields)])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from per_batch(run)(batches)
        let_go()

    schema = T.StructType([docs.schema[id_col], *(T.StructField(n, t) for n, t, _ in fields)])
    return docs.select(id_col, text_col).mapInArrow(task, schema)


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, its ids (begin and end included) and their decoded text."""

    def row(ids: bytes, said: str) -> tuple:
        return np.frombuffer(ids, "<i4"), said

    return _mapped(docs, id_col, text_col, read_model(model_path), [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())), ("decoded", T.StringType(), pa.string())], row)


def encoding_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode_documents, with digests in place of ids and text: n_tokens, ids_sha256, decoded_sha256."""

    def row(ids: bytes, said: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said.encode()).hexdigest()

    return _mapped(docs, id_col, text_col, read_model(model_path), [("n_tokens", T.LongType(), pa.int64()), ("ids_sha256", T.StringType(), pa.string()), ("decoded_sha256", T.StringType(), pa.string())], row)
