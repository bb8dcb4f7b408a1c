"""The kNN join and the chat operator against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from simvane.llm import chat, knn


def brute_top(rows, k=10):
    ok = []
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(1024 * x) for x in v]
            if max(map(abs, w)) <= 2**27:
                ok.append((i, w))
    dims = {}
    for _, w in ok:
        dims[len(w)] = dims.get(len(w), 0) + 1
    dim = max(dims, key=lambda d: (dims[d], d), default=0)
    ok = [(i, w) for i, w in ok if len(w) == dim]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string, score string").repartition(3)
    return sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0, **options).collect())


def single(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("pivots,block,group", [(64, 8192, 1024), (5, 60, 1), (1, 8192, 1024)])
def test_top_k(spark, monkeypatch, pivots, block, group):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 64 * block)
    monkeypatch.setattr(knn, "GROUP_QUERIES", group)
    rng = random.Random(2)
    rows = [(i, [single(rng.gauss(0, 1) + 3 * (i % 4 == 0)) for _ in range(8)]) for i in range(700)]
    rows += [(1000 + i, rows[100][1]) for i in range(300)]  # one vector many times
    rows += [(5000, None), (5100, [1.0, None] + [0.0] * 6), (5200, [float("nan")] * 8), (5300, [float("inf")] * 8), (5400, [1.0] * 7), (5500, []), (None, [1.0] * 8), (5600, [1e30] * 8), (5700, [0.0] * 8)]
    got = run(spark, [(i, v, "a", "b") for i, v in rows], pivots=pivots)
    assert got == sorted(brute_top(rows))


def test_bounds_prune_clustered_rows(spark):
    """Twelve directions far apart: a query's group gets few rows beyond its own cluster, and nothing is lost."""
    rng = random.Random(5)
    centres = [[30.0 * (i == c) for i in range(12)] for c in range(12)]
    rows = [(i, [single(x + rng.gauss(0, 0.3)) for x in centres[i % 12]]) for i in range(4800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    dealt, n, dim = knn.replicated(df, F.col("vec_id") % 100 == 0)
    copies, groups = dealt.filter("not asks").count(), dealt.select("g").distinct().count()
    assert (n, dim) == (4800, 12) and groups > 1 and copies < 0.5 * n * groups
    assert sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") % 100 == 0).collect()) == sorted(brute_top(rows))


def test_top_k_small_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0, 2.0], "a", "b")]) == []
    assert run(spark, [(0, [1.0, 2.0], "a", "b"), (1, [1.0, 0.5], "a", "b"), (2, [1.0, 0.5], "a", "b")]) == [(0, 1, 1, 1024 * 1024 * 2), (0, 2, 2, 1024 * 1024 * 2)]
    assert run(spark, [(1, [1.0], "a", "b"), (2, None, "a", "b")]) == []


def test_large_components_are_exact(spark):
    rows = [(0, [100_000.0, 99_999.5]), (1, [100_000.0, -3.25]), (2, [131_000.0, 131_000.0]), (3, [-131_000.0, 0.001])]
    assert run(spark, [(i, [single(x) for x in v], "a", "b") for i, v in rows]) == sorted(brute_top([(i, [single(x) for x in v]) for i, v in rows]))


def brute_different(rows, k=10):
    """The k best different (vec_id, score) of each query id, in whole numbers."""
    scaled = {(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows}
    scaled = [(i, w) for i, w in scaled if sum(x * x for x in w) < 2**63]
    out = []
    for q in {i for i, _ in scaled if i % 100 == 0}:
        best = sorted({(-sum(x * y for x, y in zip(a, b)), i) for p, a in scaled if p == q for i, b in scaled if i != q})[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("pivots,block", [(64, 8192), (5, 60), (1, 8192)])
def test_repeated_candidates(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(knn, "BLOCK_BYTES", 32 * block)
    rng = random.Random(3)
    rows = [(i, [single(rng.gauss(0, 1)) for _ in range(4)]) for i in range(400)]
    rows += [(700, [50.0] * 4)] * 40 + [(701, [-50.0, 50.0, 50.0, -50.0])] * 25  # candidates on more than k equal rows
    rows += [rows[100]] * 30 + [(200, [single(rng.gauss(0, 9)) for _ in range(4)]) for _ in range(30)]  # a query repeated, a query id with many vectors
    rows += [(300, [1.0, 0.0, 0.0, 0.0]), (702, [60.0, 0.0, 0.0, 0.0])] + [(702, [60.0, float(x), 0.0, 0.0]) for x in range(30)]  # an id whose vectors give equal scores
    rows += [(800, [1.0, 0.0, 0.0, 0.0])]
    got = run(spark, [(i, v, "a", "b") for i, v in rows], pivots=pivots)
    assert got == brute_different(rows)
    assert {q: sum(r[0] == q for r in got) for q in (0, 100, 800)} == {0: 10, 100: 10, 800: 10}


def test_components_up_to_64_bits(spark):
    rows = [(0, [1_000_000.0, -3.0]), (1, [2_000_000.0, 0.5]), (2, [-2_900_000.0, 131_073.0]), (3, [1.0, 2.0]), (100, [0.001, 2_000_000.5])]
    assert run(spark, [(i, [single(x) for x in v], "a", "b") for i, v in [*rows, (4, [3e6, 3e6])]]) == brute_different([(i, [single(x) for x in v]) for i, v in rows])


def brute_chats(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn, role is not None, role, text is not None, text))
    said = {c: tuple((x[3], x[5]) for x in sorted(t, key=lambda x: (x[0], x[1] or 0, x[2], x[3] or "", x[4], x[5] or ""))) for c, t in convs.items()}
    out = []
    for c, t in said.items():
        copies = [d for d, u in said.items() if u == t]
        if any(len(u) > len(t) and u[: len(t)] == t for u in said.values()) or min(copies, key=lambda d: (d is not None, d or 0)) != c and min((d for d in copies if d is not None), default=None) != c:
            continue
        out.append((c, len(t), len(copies), "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in t)))
    return out


def test_chats(spark):
    rows = []
    for c in range(1, 9):
        for t in range(c if c < 6 else 3):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t}" if c < 8 else f"other {t}"))
    rows += [(20, 0, None, "x"), (21, 0, "", "x"), (22, 0, "user", None), (23, 0, "user", ""), (24, 0, "user", "twice"), (24, 0, "user", "twice"), (25, 5, "user", "twice"), (26, 0, "user", "long " * 50_000), (None, 0, "user", "alone")]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, length string, total int")
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted((tuple(r) for r in chat.format_chats(df).collect()), key=key) == sorted(brute_chats(rows), key=key)
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chats_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    grown = df.unionAll(df.filter("conv_id % 3 = 0 and turn < 2").withColumn("conv_id", F.col("conv_id") + 100_000))
    assert sorted(tuple(r) for r in chat.format_chats(df).collect()) == sorted(brute_chats(rows))
    more = {r.conv_id for r in chat.format_chats(grown).collect()}
    assert all(c < 100_000 for c in more) and {r[0] for r in brute_chats(rows)} == more
