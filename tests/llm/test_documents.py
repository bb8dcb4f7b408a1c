"""The document operators against brute force, on odd rows and on a whole small table."""

import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from simvane.llm import licenses, lines, mixing, neardup, pieces, quality, queries, shards, substrings
from simvane.llm import textkit as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def pairs(df):
    return [(r[0], r[1]) for r in df.select("doc_id", "text").collect()]


def key(x):
    return tuple((v is not None, v) for v in x)


def same(got, want):
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.fixture(scope="module", params=["odd", "table"])
def docs(request, spark, sf):
    return request.getfixturevalue("odd") if request.param == "odd" else spark.read.parquet(f"{sf}/documents.parquet")


# hashing


@pytest.mark.parametrize("size", [1 << 19, 64])
def test_words_are_the_same_in_any_slicing(odd, monkeypatch, size):
    texts = [t for _, t in pairs(odd)][:14] + ["", "a" * 300, " b" * 99]
    expected = [WORD.findall(t or "") for t in texts]
    monkeypatch.setattr(K, "SLICE", size)
    got, hashes = [], {}
    for _, _, data, offsets in K.chunks(pa.array(texts), 500):
        w = K.words_of(data, offsets)
        for d in range(len(offsets) - 1):
            own = slice(w.first[d], w.first[d + 1])
            got.append([data[a:b].tobytes().decode() for a, b in zip(w.starts[own], w.ends[own])])
            for x, h in zip(got[-1], w.hashes[own].tolist()):
                assert hashes.setdefault(x, h) == h
    assert got == expected
    assert len(set(hashes.values())) == len(hashes)


def test_runs_and_segments():
    h = K.stream(3, 200)
    for k in (1, 2, 3, 5, 8, 35):
        r = K.runs_of(np.concatenate((h, h)), k)
        assert (r[: 200 - k + 1] == r[200 : 400 - k + 1]).all() and len(set(r[: 200 - k + 1].tolist())) == 200 - k + 1
    data = np.frombuffer(b"ab ab\nab ab\nabab" * 3, np.uint8)
    starts, ends, _ = K.lines_of(data, np.array([0, len(data)]))
    names = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    found = K.segment_hashes(data, starts, ends).tolist()
    assert len(set(zip(names, found))) == len(set(names)) == len(set(found))


# op3


def brute_quality(text):
    w = WORD.findall(text or "")
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {i + j for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


def test_quality_counts(docs):
    got = quality.quality_signals(docs).collect()
    same([(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got], [(i, *(b := brute_quality(t)), b[0] < 50 or 100 * b[4] > 50 * b[0]) for i, t in pairs(docs)])
    assert all(not (r.kept and r.base_failed) for r in got)


def test_quality_measures_characters_in_repeated_grams(docs):
    def covered(w, n):
        c = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        at = {i + j for i in range(len(w) - n + 1) if c[tuple(w[i : i + n])] > 1 for j in range(n)}
        return sum(len(w[i]) for i in at)

    got = quality.quality_signals(docs).select("doc_id", F.element_at("gram_chars", 5), F.element_at("gram_chars", 10)).collect()
    same([tuple(r) for r in got], [(i, covered(WORD.findall(t or ""), 5), covered(WORD.findall(t or ""), 10)) for i, t in pairs(docs)])


def test_quality_filter_keeps_columns_and_agrees(docs):
    kept = quality.quality_filter(docs)
    assert kept.schema == docs.schema
    same([r[0] for r in kept.select(F.struct("doc_id")).collect()], [(r.doc_id,) for r in quality.quality_signals(docs).filter("kept").collect()])


# op2


def brute_substrings(rows, window):
    w = [(i, WORD.findall(t or "")) for i, t in rows]
    c = collections.Counter(tuple(x[k : k + window]) for _, x in w for k in range(len(x) - window + 1))
    out = []
    for i, x in w:
        gone = set()
        for k in range(len(x) - window + 1):
            if c[tuple(x[k : k + window])] > 1:
                gone.update(range(k, k + window))
        out.append((i, len(x), len(gone), hashlib.sha256(" ".join(y for k, y in enumerate(x) if k not in gone).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("options", [{}, {"window": 12, "gram": 3, "batches": 5, "fanout": 2}, {"window": 4, "gram": 4, "batches": 1}])
def test_substrings(docs, options):
    got = substrings.substring_digests(docs, **options).collect()
    same([tuple(r) for r in got], brute_substrings(pairs(docs), options.get("window", 35)))


def test_index_is_incremental(spark, sf, odd, tmp_path):
    """Batches in an index that is opened anew each time, against brute force on all batches so far; texts of the history are read where an anchor is met again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    batches = [docs.filter(f"coalesce(doc_id, 0) % 3 = {k}") for k in range(3)]
    before = None
    for batch in batches:
        index = substrings.SubstringIndex(spark, f"file://{tmp_path}/index", window=12, gram=3)
        got = [tuple(r) for r in index.dedup(batch, before).collect()]
        old, new = pairs(before) if before else [], pairs(batch)
        same(got, brute_substrings(old + new, 12)[len(old) :])
        before = batch if before is None else before.unionByName(batch)
    assert [level for level, _ in index.anchors.runs] == [1, 0]
    with pytest.raises(ValueError):
        substrings.SubstringIndex(spark, f"file://{tmp_path}/index").dedup(batches[0])


def test_runs_meet_without_an_exchange(spark, sf):
    from simvane.llm.common import shared_folder

    docs = substrings.keyed(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text")
    index = substrings.FingerprintIndex(spark, shared_folder(spark))
    for k in range(3):
        (name,) = index.add(substrings.anchor_rows(docs.filter(f"d % 3 = {k}"), 35, 8))
        if k:
            plan = index.known(name)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        index.enter(name)
    assert "Exchange" not in index.unique()._jdf.queryExecution().executedPlan().toString()
    assert not spark.catalog.listTables()
    counts = collections.Counter(r.h for r in substrings.anchor_rows(docs, 35, 8).select("h", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).collect())
    same([tuple(r) for r in index.unique().groupBy().count().collect()], [(sum(n == 1 for n in counts.values()),)])


# op4


def brute_lines(rows, window=3):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] if rows[k][0] is not None else 2**63, k))
    spoken = {k: [n for n, x in enumerate((rows[k][1] or "").split("\n")) if WORD.search(x)] for k in order}
    seen, out = set(), []
    for k in order:
        split = (rows[k][1] or "").split("\n")
        gone = set()
        for j in range(len(spoken[k]) - window + 1):
            w = tuple(split[n] for n in spoken[k][j : j + window])
            if w in seen:
                gone.update(spoken[k][j : j + window])
            seen.add(w)
        left = None if rows[k][1] is None else "\n".join(x for n, x in enumerate(split) if n not in gone)
        out.append((rows[k][0], left, len(spoken[k]), len(gone)))
    return out


@pytest.mark.parametrize("window", [1, 3])
def test_lines(docs, window):
    out = lines.dedup_lines(docs, window)
    assert out.columns == [*docs.columns, "n_lines_", "n_removed_"]
    rows = pairs(docs)
    if any(i == 9 for i, _ in rows) and len(rows) < 40:  # of a repeated id the order between texts is the marks'
        marks = {t: m for t, m in docs.select("text", lines.text_mark("text")).collect()}
        rows.sort(key=lambda r: (r[0] is None, r[0], marks[r[1]]))
    same([tuple(r) for r in out.select("doc_id", "text", "n_lines_", "n_removed_").collect()], brute_lines(rows, window))


def test_line_documents_keep_schema(docs):
    assert lines.dedup_documents(docs).schema == docs.schema


# op6


@pytest.mark.parametrize("options", [{}, {"shards": 3, "vnodes": 2, "cells": 16}, {"shards": 1}])
def test_ring(docs, options):
    n = options.get("shards", 40)
    got = shards.place(docs, **options).collect()
    crc = {t: zlib.crc32((t or "").encode()) for _, t in pairs(docs)}
    same([(r.doc_id, r["size"], r.text_crc32) for r in got], [(i, len((t or "").encode()) + 16, crc[t]) for i, t in pairs(docs)])
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None and 0 <= r.shard < n
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(n)]
    assert max(counts) - min(counts) <= 1


def walked(points, rows, n_shards):
    """(shard, slot) of each row, in the order of rows: a plain walk around the ring, one row at a time."""
    points = sorted(points)
    order = sorted(range(len(rows)), key=lambda k: tuple((x is not None, x) for x in rows[k]))
    at = {k: next((j for j, (p, _) in enumerate(points) if p >= rows[k][0]), len(points)) for k in order}
    home = {k: points[j % len(points)][1] for k, j in at.items()}
    room = {s: len(rows) // n_shards + (s < len(rows) % n_shards) for s in range(n_shards)}
    shard, waiting = {}, {}
    for k in order:
        if room[home[k]]:
            room[home[k]] -= 1
            shard[k] = home[k]
        else:
            waiting.setdefault(at[k], []).append(k)
    queue = []
    for lap in range(2):
        for j in range(len(points) + 1):  # the stretch behind the last point ends at the first one
            queue += waiting.get(j, []) if lap == 0 else []
            s = points[j % len(points)][1]
            while queue and room[s]:
                room[s] -= 1
                shard[queue.pop(0)] = s
    slots, out = collections.Counter(), {}
    for k in order:
        out[k] = (shard[k], slots[shard[k]])
        slots[shard[k]] += 1
    return [out[k] for k in range(len(rows))]


@pytest.mark.parametrize("options", [{}, {"shards": 3, "vnodes": 2, "cells": 16}, {"shards": 7, "vnodes": 3, "cells": 64}])
def test_ring_against_a_walk(spark, docs, options):
    n, vnodes, cells = options.get("shards", 40), options.get("vnodes", 64), options.get("cells", 8192)
    points = [(r.point, r.shard) for r in shards.ring(docs, n, vnodes, cells).collect()]
    place = F.when(F.col("doc_id").isNull(), shards._place(F.lit("text"), F.col("text"))).otherwise(shards._place(F.lit("id"), F.col("doc_id")))
    rows = [(r.place, r.doc_id, zlib.crc32((r.text or "").encode()), len((r.text or "").encode()) + 16) for r in docs.select("doc_id", "text", place.alias("place")).collect()]
    want = [(r[1], r[3], r[2], *x) for r, x in zip(rows, walked(points, rows, n))]
    same([(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in shards.place(docs, **options).collect()], want)


def test_ring_moves_few_rows(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    at = [{r.doc_id: r.shard for r in shards.place(docs, shards=n, slack=s).collect()} for n, s in ((40, 0.0), (41, 0.0), (40, 0.25), (41, 0.25))]
    assert sum(at[0][i] != at[1][i] for i in at[0]) < 0.15 * len(at[0])
    assert sum(at[2][i] != at[3][i] for i in at[2]) < 0.08 * len(at[0])
    assert max(collections.Counter(at[2].values()).values()) <= 1.25 * 500 + 1


def test_ring_uses_no_python(spark, odd):
    plan = shards.place(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# op7


def brute_targets(sizes, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    open_, out, rest = set(names), {}, share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if rest * weight[s] / total > most * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        rest -= sum(most * sizes[s] for s in over)
        open_ -= over
    return out


def test_mix(docs):
    rows = [(r[0], r[1], len(WORD.findall(r[2] or ""))) for r in docs.select("doc_id", "source", "text").collect()]
    sizes = collections.Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = brute_targets(sizes)
    got = mixing.Mix(docs).taken().collect()
    same([(r.doc_id, r.source, r["size"], r.source_size) for r in got], [(i, s, n, sizes[s]) for i, s, n in rows])
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = mixing.Mix(docs.repartition(5)).taken().collect()
    same([(r.doc_id, r.source, r.mark, r.taken) for r in again], [(r.doc_id, r.source, r.mark, r.taken) for r in got])


def brute_mix(rows, slots, block):
    """taken and first slot of each (id, source, size, place of its copy in the stream), walked word by word of a source through a schedule made one slot at a time."""
    sizes = collections.Counter()
    for _, s, n, _ in rows:
        sizes[s] += n
    targets = brute_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    words = [min(int(targets[s]), 2 * sizes[s]) for s in names]
    n = min(sum(words), max(slots, -(-sum(words) // block)))
    turns = [[] for _ in names]
    for i in range(n):
        x = ((i * 0x9E3779B97F4A7C15) % 2**64 >> 11) / 2.0**53
        k, so_far = 0, 0
        while k < len(names) and x >= (so_far := so_far + words[k]) / sum(words):
            k += 1
        turns[min(k, len(names) - 1)].append(i)
    edge = 0
    for k, w in enumerate(words):
        edge += w
        if w and not turns[k]:
            turns[k] = [int((edge - w / 2) / sum(words) * n)]
    out = []
    for k, s in enumerate(names):
        stream = [r for r in sorted((r for r in rows if r[1] == s), key=lambda r: r[3]) if r[2]]
        got, first, at = collections.Counter(), {}, 0
        short, extra = divmod(words[k], max(1, len(turns[k])))
        ends = [(j + 1) * short + min(j + 1, extra) for j in range(len(turns[k]))]
        while at < words[k]:
            for r in stream:
                for _ in range(r[2]):
                    if at < words[k]:
                        slot = turns[k][next(j for j, e in enumerate(ends) if at < e)] if r not in first or at < 60 else 0
                        got[r] += 1
                        first[r] = min(first.get(r, slot), slot) if r not in first else first[r]
                        at += 1
        out += [(r[0], r[1], r[2], got[r], first.get(r)) for r in rows if r[1] == s]
    return out


def test_mix_takes_what_its_slots_hold(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    rows = [(k, " ".join(["w"] * (k * 7 % 23 + 1)), s) for k in range(60) for s in ["a", "b", None, "a"][k % 4 : k % 4 + 1]] + [(100, "one", "tiny"), (101, "", "a"), (102, None, "c")] + [(7, "x y z", "b")] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    mix = mixing.Mix(docs, slots=50, block=9)
    streams = [(r.doc_id, r.source, r["size"], (r.bucket, r.at, r.doc_id, r.mark, r.nth)) for r in mix.placed.collect()]
    got = [(r.doc_id, r.source, r["size"], r.taken, r.slot) for r in mix.taken().collect()]
    same([x[:4] for x in got], [x[:4] for x in brute_mix(streams, 50, 9)])
    want = {x[0]: x[4] for x in brute_mix(streams, 50, 9)}
    assert all(x[4] == want[x[0]] for x in got if x[0] != 7 and x[3])
    # without a slot nothing is taken: the schedule decides
    slots = mix.slots.collect()
    assert collections.Counter(r.source_no for r in slots if r.source_no == 0)[0] == max(r["rank"] for r in slots if r.source_no == 0) + 1


def test_mix_slots_follow_the_targets_early(docs):
    mix = mixing.Mix(docs, slots=4000)
    slots = [(r.slot, r.source_no) for r in mix.slots.collect()]
    whole = collections.Counter(s for _, s in slots)
    first = collections.Counter(s for i, s in slots if i < len(slots) // 2)
    assert all(abs(first[s] - whole[s] / 2) <= 0.005 * len(slots) + 1 for s in whole)
    held = mix.pieces.filter("slot is not null").groupBy("source", "slot").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("n")).groupBy("source").agg(F.max("n") - F.min("n")).collect()
    assert all(r[1] <= 1 for r in held)  # equal blocks
    few = mixing.Mix(docs, slots=1, block=50)
    assert few.slots.count() >= few.sources.agg(F.sum("taken_size")).first()[0] // 50


def test_mixed_documents(docs):
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns
    want = collections.Counter()
    for r in mixing.Mix(docs).taken().collect():
        want[r.doc_id] += r.taken
    got = collections.Counter()
    for i, t in pairs(out):
        got[i] += len(WORD.findall(t or ""))
    assert got == +want


# op9


def test_pieces(docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = []
    for i, t in pairs(docs):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    same([tuple(r) for r in pieces.encoding_digests(docs, MODEL).collect()], want)
    r = pieces.encode_documents(docs, MODEL).filter("doc_id = 5").first()
    if r:
        assert r.decoded == library.decode(list(r.ids))


def test_piece_agenda_alone():
    model = pieces.PieceModel(open(MODEL, "rb").read())
    for text in ("▁the", "▁" * 40, "thethethe" * 30, "a", "▁日本語x", "\x00"):
        assert model.merged(text) == model.merged_together([text, "zz"])[0]
    assert model.decoded([model.bos, 300, model.unk, model.eos]) == model.library.decode([model.bos, 300, model.unk, model.eos])


# op10


def brute_links(rows, shingle, percent=80):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets.append(frozenset(tuple(w[k : k + shingle]) for k in range(len(w) - shingle + 1)) if len(w) >= shingle else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 2**63), 2**63 if i is None else i)
    out = []
    for k, (i, _) in enumerate(rows):
        c = least[find(k)] if least[find(k)] < 2**63 else None
        out.append((i, len(sets[k]), c, i == c))
    return out


def test_near_duplicates(docs):
    got = neardup.near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    same([tuple(r) for r in got], brute_links(pairs(docs), 4))


def test_near_duplicates_in_a_hot_group(spark, monkeypatch):
    """Edits of one text at many rates: links around the limit, chains, and blocks smaller than the group."""
    import random

    monkeypatch.setattr(neardup, "BLOCK", 40)
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    rows = [(1000 + k, " ".join(x if rng.random() > rate else f"e{rng.randrange(10**6)}" for x in base)) for k in range(220) for rate in [rng.choice((0.0, 0.01, 0.02, 0.04, 0.06, 0.1))]]
    rows += [(k, " ".join(base[: 150 - k])) for k in range(60)] + [(2000 + k, " ".join(base[k : k + 120])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, shingle=4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    same([tuple(r) for r in got], brute_links(rows, 4))


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    for shared in (100, 400, 900):
        a = K.stream(1, 1000)
        b = np.concatenate((a[:shared], K.stream(2, 1000 - shared)))
        s = neardup.sketches(np.concatenate((np.sort(a), np.sort(b))), np.array([0, 1000, 2000]), 4000)
        assert abs((s[0] == s[1]).mean() - shared / (2000 - shared)) < 0.04
    small = neardup.sketches(K.stream(9, 3), np.array([0, 1, 3, 3]), 64)
    assert (small[:2] != 2**64 - 1).all() and (small[2] == 2**64 - 1).all()
    del rng


def test_dropping_near_duplicates(odd):
    out = neardup.drop_near_duplicates(odd, shingle=4)
    assert out.columns == odd.columns
    groups = brute_links(pairs(odd), 4)
    texts = [i for i, n, *_ in groups if n == 0]
    kept = collections.Counter(i for i, _ in pairs(out))
    assert kept[8] == 0 and kept[7] == 1 and kept[None] == 1 + texts.count(None)


#: Names that the operators use inside.
INNER = "row d mark own key n nth places at slot size words copies row_mark id_mark source_no bucket rank lo hi begin cell part root least node hub n_lines n_removed n_lines_ n_removed_ size_ taken_ row_ nth_ words_ cut_ d_ mark_ kept_ n_ kept".split()


def test_clashing_names_and_many_repeats(spark):
    """Columns with every inner name; 2000 repeats of a row; 2000 rows without an id, some of one text."""
    base = " ".join(f"w{i}" for i in range(60))
    lines_ = "one two\nthree four\nfive six\nseven"
    rows = [(5, lines_, "a")] * 2000 + [(None, lines_ if k % 2 else f"{lines_} {k}\n{base}", "b") for k in range(2000)] + [(6, base, "a"), (7, base + " end", "c"), (8, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").select("*", *(F.lit(f"x{k}").alias(c) for k, c in enumerate(INNER))).repartition(4)
    marks = F.concat_ws("|", *INNER)
    for made in (lines.dedup_documents(df), neardup.drop_near_duplicates(df), mixing.mix_documents(df, slots=500)):
        assert made.columns == df.columns
        assert [r[0] for r in made.select(marks).distinct().collect()] == ["|".join(f"x{k}" for k in range(len(INNER)))]
    with pytest.raises(ValueError):
        lines.dedup_lines(df)
    out = lines.dedup_lines(df, counts=("lines", "gone")).groupBy("doc_id", "text").count().collect()
    assert {(r.doc_id, r.text): r["count"] for r in out}[5, lines_] == 1  # one of the repeats stays whole
    kept = neardup.drop_near_duplicates(df.drop(*INNER)).collect()
    assert sum(r.text == lines_ for r in kept) == 1 and sum(r.text is None for r in kept) == 1
    groups = neardup.near_duplicates(df).groupBy("component_id").count().collect()
    assert {r.component_id: r["count"] for r in groups}[5] >= 3000
    counts = collections.Counter(r.shard for r in shards.place(df, shards=7, vnodes=3, cells=64).collect())
    assert max(counts.values()) - min(counts.values()) <= 1
    (taken,) = mixing.Mix(df.drop(*INNER), slots=500).taken().agg(F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size")), F.count("*")).collect()
    assert taken[2] == len(rows) and taken[1] <= 0


def test_ids_must_be_integers(spark):
    df = spark.createDataFrame([("a", "x y z", "s")], "doc_id string, text string, source string")
    for f in (lines.line_digests, substrings.substring_digests, neardup.near_duplicates, neardup.drop_near_duplicates):
        with pytest.raises(TypeError, match="integer"):
            f(df)
    with pytest.raises(ValueError):
        quality.quality_signals(df, gram_limits={2: 0.1})


def test_components(spark):
    from simvane.llm.common import shared_folder

    chain = [(k, k + 1) for k in range(1, 40)] + [(100, 50), (50, 70), (200, 201)]
    links = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.root for r in neardup.components(links, shared_folder(spark)).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 50: 50, 70: 50, 100: 50, 200: 200, 201: 200}


# op1


def test_dropping_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(200)]
    near = [" ".join([*words, f"end{k}"]) for k in range(4)]
    other = [" ".join([f"v{i}" for i in range(200)] + [f"end{k}"]) for k in range(3)]
    rows = [(None, t) for t in near] + [(7, t) for t in other] + [(None, "alone and on its own"), (None, None), (None, ""), (3, "")]
    out = [tuple(r) for r in neardup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert [sum(r in g for r in out) for g in ([(None, t) for t in near], [(7, t) for t in other])] == [1, 1]
    assert all(r in out for r in rows[7:]) and len(out) == 6


def test_licenses(docs):
    got = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    for i, t in pairs(docs):
        if t and "Licensed under the Apache License, Version 2.0." in t:
            assert "apache-2.0" in [m.license for m in got[i].matches]
    assert licenses.license_scan(docs).count() == docs.count()
    assert licenses.license_matches(docs).columns == ["doc_id", "license", "coverage", "n_words", "word_from", "word_to"]


def test_patience_alignment():
    t = "a b c d e f g h".split()
    assert licenses.patience(t, t) == [(k, k) for k in range(8)]
    assert licenses.patience([], t) == [] == licenses.patience(t, [])
    run = licenses.patience("x a b the c the d y".split(), "a b the q the d".split())
    assert [("x a b the c the d y".split()[i], "a b the q the d".split()[j]) for i, j in run] == [(w, w) for w in "a b the the d".split()]
    assert all(a < c and b < d for (a, b), (c, d) in zip(run, run[1:]))
    templates = {"x": licenses.folded("Permission is hereby granted, free of charge, to any person.")}
    noisy = "the the of " * 500 + "PERMISSION is hereby granted free of any charge, to any person " + "of to any " * 500
    (found,) = licenses.scan_text(noisy, templates, 0.85)
    assert found[1] == 1.0
    assert licenses.scan_text("permission to charge any person", templates, 0.85) == []


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(was for was in _next_row(row, x, b))]
    return row[-1]


def _next_row(row, x, b):
    left = 0
    for k, y in enumerate(b):
        left = row[k] + 1 if x == y else max(left, row[k + 1])
        yield left


def test_licenses_against_brute_force():
    """Every window of random texts: nothing is lost, and nothing is more than a common subsequence, which it equals where no word is repeated."""
    import random

    rng = random.Random(11)
    words = [f"w{k}" for k in range(12)]
    for _ in range(300):
        template = [rng.choice(words) for _ in range(rng.randrange(1, 9))]
        text = [rng.choice([*words, "foreign", "other"]) for _ in range(rng.randrange(0, 30))]
        at = rng.randrange(len(text) + 1)
        text[at:at] = [w for w in template if rng.random() < 0.9]
        width, n = 2 * len(template), len(template)
        by_window = [licenses.patience(text[k : k + m], template) for k in range(len(text)) for m in range(1, width + 1)]
        most = max(map(len, by_window), default=0)
        found = licenses.scan_text(" ".join(text), {"x": template}, 0.6)
        if most >= 0.6 * n:
            assert found and found[0][2] >= most, (text, template)
        for _, coverage, aligned, a, b in found:
            assert b - a <= width and coverage == aligned / n >= 0.6
            assert aligned <= max(longest_common(text[k : k + width], template) for k in range(len(text)))
        got = licenses.patience(text, template)
        assert all(text[i] == template[j] for i, j in got) and all(p < q and r < t for (p, r), (q, t) in zip(got, got[1:]))
        a, b = rng.sample(words, 9), rng.sample(words, 7)
        assert len(licenses.patience(a, b)) == longest_common(a, b)


def test_foreign_words_inside_a_notice():
    templates = {"x": licenses.folded(licenses.TEMPLATES["apache-2.0-use"]), "none": [], "marks": licenses.folded("... !!")}
    words = licenses.TEMPLATES["apache-2.0-use"].split()
    for n in (0, 8, 9, 20, len(words)):
        (found,) = licenses.scan_text(" ".join(["before"] * 70 + words[:12] + ["foreign"] * n + words[12:] + ["after"] * 50), templates, licenses.LIMIT)
        assert found[:2] == ("x", 1.0)
    assert licenses.scan_text(" ".join(w + " far" * 40 for w in words), templates, licenses.LIMIT) == []  # scattered
    assert licenses.scan_text("", {"x": []}, 0.0) == []


def test_license_bodies():
    templates = {name: licenses.folded(t) for name, t in licenses.TEMPLATES.items()}
    for name, text in licenses.TEMPLATES.items():
        found = {m[0]: m[1] for m in licenses.scan_text(f"Copyright (c) 2020 Somebody\n\n{text}\n\nint main() {{ return 0; }}", templates, licenses.LIMIT)}
        assert found[name] == 1.0


def test_notice_given_twice():
    templates = {name: licenses.folded(t) for name, t in licenses.TEMPLATES.items()}
    for name, notice in licenses.TEMPLATES.items():
        notice, n = notice.rstrip("."), len(templates[name])
        once = f"The code is {notice}, see the file."
        for text in (once, f"The code is {notice}. The data is {notice}, see the README.", " and also ".join([notice] * 5), f"{notice} {notice}"):
            found = {m[0]: m for m in licenses.scan_text(text, templates, licenses.LIMIT)}
            assert found[name][1:3] == (1.0, n), (name, text)
            assert n <= found[name][4] - found[name][3]
        # a copy with a word put in, next to a copy that lacks its middle
        words = notice.split()
        hurt = " ".join([*words[: n // 2], "(really)", *words[n // 2 :]])
        torn = " ".join(words[: n // 3] + words[-(n // 3) :])
        for text in (f"{torn}, {hurt}, {torn}", f"{hurt}; {hurt}"):
            assert name in {m[0] for m in licenses.scan_text(text, templates, licenses.LIMIT)}, (name, text)


# all


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in ("op5_voronoi_knn", "op8_chat_snapshots")])
def test_empty_table(name, spark, empty, tmp_path):
    empty.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.QUERIES[name](spark, str(tmp_path))
    assert out.collect() == [] and out.columns[0] == "doc_id"
