"""Operators on small tables with known results."""

import gzip
import json
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from simvane.functions import scalars as S
from simvane.operators import contingency, expression, integrity, models, neighborhood, panels, perturb
from simvane.operators import knn as N
from simvane.operators.sizes import bounded
from simvane.sources import readers, sinks
from simvane.streaming import ingest


def near(df, k, **o):
    out = {}
    for r in sorted(N.exact_neighbors(df, k, **o).collect(), key=lambda r: (r.q, r.rank)):
        out.setdefault(r.q, []).append(r.n)
    return out


def test_knn_on_a_line(spark):
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate([0.0, 1.0, 3.0, 9.0, 20.0])], "id long, v array<double>")
    assert near(df, 1) == {0: [1], 1: [0], 2: [1], 3: [2], 4: [3]}
    fine = spark.createDataFrame([(0, [0.0]), (1, [1 + 5e-8]), (2, [1.0]), (3, [4.0])], "id long, v array<double>")
    assert near(fine, 1)[0] == [2]


def test_knn_ties_and_text_ids(spark):
    rows = [("z", [0.0, 0.0]), ("a", [0.0, 0.0]), ("c", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("d", [0.0, 1.0]), ("e", [0.0, -1.0])]
    got = near(spark.createDataFrame(rows, "id string, v array<double>"), 3, block_rows=2)
    assert got["z"] == ["a", "b", "c"] and got["a"] == ["z", "b", "c"] and all(q not in n for q, n in got.items())
    same = [(f"cell-{i:02d}", [0.0]) for i in range(30)]
    a, b = (near(spark.createDataFrame(r, "id string, v array<double>"), 4, block_rows=7) for r in (same, same[::-1]))
    assert a == b and a["cell-00"] == ["cell-01", "cell-02", "cell-03", "cell-04"]


def test_knn_refuses(spark):
    df = spark.createDataFrame([(0, [0.0]), (1, [1.0])], "id long, v array<double>")
    for k in (0, 2, 3):
        with pytest.raises(ValueError):
            N.exact_neighbors(df, k)
    assert N.exact_neighbors(df, 2, queries=df.withColumn("id", F.col("id") + 10)).count() == 4
    good = [(i, [float(i)] * 64) for i in range(63)]
    for bad in (None, [1.0] * 63, [1.0] * 63 + [None], [1.0] * 63 + [float("nan")], [float("inf")] * 64):
        with pytest.raises(Exception, match="vector"):
            N.exact_neighbors(spark.createDataFrame([*good, (99, bad)], "id long, v array<double>"), 3).collect()
    with pytest.raises(Exception, match="length"):
        N.label_sums(spark.createDataFrame([(0, [1.0] * 3, "a"), (1, [1.0] * 5, "a")], "id long, v array<double>, label string")).collect()


def test_knn_ties_in_the_order_of_a_list(spark):
    rows = [(i, [0.0, 0.0], n) for n, i in enumerate("zambqc")]
    df = spark.createDataFrame(rows, "id string, v array<double>, pos int").repartition(3)
    assert near(df, 2, order="pos")["z"] == ["a", "m"] and near(df, 2)["z"] == ["a", "b"]


def test_neighborhood_metrics(spark):
    a = spark.createDataFrame([(0, 1), (0, 2), (1, 0), (1, 2)], "q long, n long")
    b = spark.createDataFrame([(0, 2), (0, 3), (1, 0), (1, 2)], "q long, n long")
    assert {r.q: r.jaccard for r in neighborhood.overlap(a, b).collect()} == {0: pytest.approx(1 / 3), 1: 1.0}
    edges = spark.createDataFrame([(0, 1), (1, 0), (2, 1)], "q long, n long")
    labels = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "id long, label int")
    assert {r.q: r.purity for r in neighborhood.purity(edges, labels).collect()} == {0: 1.0, 1: 1.0, 2: 0.0}
    df = spark.createDataFrame([(0, [0.0], 0), (1, [0.01], 1), (2, [10.0], 0), (3, [10.01], 1)], "id long, v array<double>, batch int")
    assert {r.d_batch for r in neighborhood.inverse_simpson(N.exact_neighbors(df, 1), df).collect()} == {2.0}
    assert neighborhood.scaled_median(spark.createDataFrame([(1.0,)], "lisi double"), 1).first().status == "not_applicable"


def test_silhouette_rules(spark):
    df = spark.createDataFrame([(0, [0.0], "a"), (1, [1.0], "a"), (2, [5.0], "b"), (3, [5.0], "c"), (4, [5.0], "c")], "id long, v array<double>, label string")
    s = {r.q: r.s for r in neighborhood.silhouette(N.label_sums(df, block_rows=2), df).collect()}
    assert s[2] is None and s[3] == 0.0 and s[0] == pytest.approx((5 - 1) / 5)


def test_agreement(spark):
    df = spark.createDataFrame([(i % 3, (i % 3) + 10) for i in range(30)], "a int, b int")
    r = contingency.agreement(df, "a", "b").first()
    assert (r.ari, r.ri) == (1.0, 1.0) and r.nmi == pytest.approx(1.0)
    assert contingency.agreement(df.withColumn("b", F.lit(1)), "a", "b").first().ari == 0.0


def test_seed_stats_and_macro(spark):
    df = spark.createDataFrame([(0, "A", "s1", 0.0), (0, "A", "s2", 2.0), (0, "B", "s3", 20.0)], "seed int, donor string, section string, x double")
    assert panels.macro_by_seed(df, "seed", ["donor", "section"], "x").first().x == 10.5
    one = df.filter("section = 's3'")
    assert panels.seed_stats(one, ["donor"], "x").first().sd == 0.0
    assert panels.seed_stats(one, ["donor"], "x", single_sd=None).first().sd is None


def test_signs_and_count_match(spark):
    d = spark.createDataFrame([(s, g, 0.1 if g == 0.5 else -0.1) for s in range(3) for g in (0.2, 0.5, 1.0)], "seed int, grid double, d double")
    assert tuple(panels.sign_counts(d, "seed", "grid", 0.5, "d").first()) == (3, 0, 6, 6)
    c = spark.createDataFrame([(0, 0.6, 4), (0, 0.4, 4), (0, 0.2, 4)], "seed int, r double, k int")
    assert panels.count_match(c, "seed", "r", "k", 4).first().r == 0.4
    assert panels.count_match(c.unionAll(spark.createDataFrame([(0, 0.5, 4)], c.schema)), "seed", "r", "k", 4).first().r == 0.5


def test_repeated_or_invalid_grid_values_are_refused(spark):
    for rows in ([(0, 0.5, 4), (0, 0.5, 3)], [(0, 0.0, 4)], [(0, None, 4)]):
        with pytest.raises(Exception, match="grid value"):
            panels.count_match(spark.createDataFrame(rows, "seed int, r double, k int"), "seed", "r", "k", 4).collect()


def test_mixing_screen(spark):
    def panel(name, harm=0.0, gain=0.1, batches=3, clear=True, seeds=range(5), rare=0.0):
        return [(name, s, harm if s == 3 else 0.0, gain, batches, clear, {"a": rare, "b": 0.0}) for s in seeds]

    rows = [*panel("good"), *panel("harmed", harm=-0.02), *panel("rare", rare=-0.06), *panel("edge", harm=-0.01, rare=-0.05), *panel("single", gain=None, batches=1, clear=False), *panel("unclear", gain=None, clear=False)]
    rows += [*panel("flat", gain=0.01), *panel("short", seeds=range(4)), *panel("twice", seeds=[0, 1, 2, 3, 3]), *panel("foreign", seeds=[0, 1, 2, 3, 9]), *panel("none", gain=None), *panel("nan", harm=float("nan")), *panel("large", gain=2.5), *panel("odd", batches=1)]
    rows += [("mixed", s, 0.0, 0.1, 3, True, {"a": 0.0} if s else {"b": 0.0}) for s in range(5)]
    df = spark.createDataFrame(rows, "k string, seed int, d double, g double, batches int, clear boolean, rare map<string,double>")
    got = {r.k: r.outcome for r in panels.mixing_screen(df, ["k"], "seed", {"d": -0.01}, "g", "batches", "clear", range(5), "rare").collect()}
    assert got == {"good": panels.CANDIDATE, "harmed": panels.HARM, "rare": panels.HARM, "edge": panels.CANDIDATE, "single": panels.CLEAN, "unclear": panels.PENDING, "flat": panels.NO_GAIN} | dict.fromkeys(("short", "twice", "foreign", "none", "nan", "large", "odd", "mixed"), "invalid")


def test_screen_is_inclusive_and_wants_all_seeds(spark):
    rows = [("x", s, -0.01, 0.1) for s in range(5)] + [("y", s, -0.01, 0.1) for s in range(4)] + [("z", s, -0.5 if s == 2 else 1.0, 0.1) for s in range(5)] + [("w", s % 5, -0.01, 0.1) for s in range(6)]
    got = {r.k: r.verdict for r in panels.harm_screen(spark.createDataFrame(rows, "k string, seed int, d double, g double"), ["k"], "seed", {"d": -0.01}, ["g"], range(5)).collect()}
    assert got == {"x": "passed", "y": "incomplete", "z": "failed", "w": "incomplete"}


def test_f_survival():
    assert panels.f_survival(4.0, 2, 10) == pytest.approx(0.0530, abs=5e-4)
    assert panels.f_survival(0.0, 2, 10) == 1.0
    for f in (0.3, 1.7, 9.0):
        assert panels.f_survival(f, 2, 14) == pytest.approx((1 + 2 * f / 14) ** -7)


def test_marker_endpoint(spark):
    coo = spark.createDataFrame([(c, "gA" if c < 6 else "gB", 5.0 + c % 2) for c in range(12)] + [(c, "flat", 1.0) for c in range(12)], "cell int, gene string, value double")
    cells = spark.createDataFrame([(c, "A" if c < 6 else "B") for c in range(12)], "cell int, label string")
    panel = spark.createDataFrame([("A", "gA"), ("B", "gB"), ("A", "flat"), ("C", "none")], "cls string, gene string")
    scores = expression.marker_scores(coo, cells, panel)
    assert {r.cls for r in scores.select("cls").distinct().collect()} == {"A", "B"}
    r = expression.auroc_ap(scores.join(cells, "cell").withColumn("positive", F.col("label") == F.col("cls")), by=["cls"]).collect()
    assert all(x.auroc == 1.0 and x.ap == pytest.approx(1.0) and x.contrast > 0 for x in r)
    tied = spark.createDataFrame([(True, 1.0), (False, 1.0), (True, 1.0), (False, 1.0)], "positive boolean, score double")
    assert expression.auroc_ap(tied).first().auroc == 0.5
    assert expression.auroc_ap(tied.filter("positive")).first().auroc is None
    rng = random.Random(4)
    rows = [(rng.random() < 0.3, round(rng.gauss(0, 2), 1)) for _ in range(400)]
    pos, neg = ([x for p, x in rows if p is kind] for kind in (True, False))
    auc = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    ap = sum(sum(a == x for a in pos) * sum(a >= x for a in pos) / sum(b >= x for _, b in rows) for x in set(pos)) / len(pos)
    for part in (1 / 16, 0.5, 100.0):
        got = expression.auroc_ap(spark.createDataFrame(rows, "positive boolean, score double"), part=part).first()
        assert (got.auroc, got.ap) == (pytest.approx(auc), pytest.approx(ap))
    macro = expression.macro_endpoint(spark.createDataFrame([("a", 5, 0.5), ("b", 1, 0.9)], "cls string, n_pos long, auroc double"), ["auroc"], 2).first()
    assert tuple(macro) == (1, 1, 0.5)
    means = expression.cluster_means(scores, cells.withColumn("cluster", F.col("cell") % 2)).collect()
    assert sum(r.n for r in means) == 24 and {r.cluster for r in means} == {"0", "1"}


def test_zero_cell_fails(spark):
    with pytest.raises(Exception, match="no counts"):
        expression.normalize_log1p(spark.createDataFrame([(0, "g", 0.0)], "cell int, gene string, value double")).collect()


def test_simplex():
    corners = perturb.simplex_directions(4, 8)
    assert all(sum(x * x for x in c) == pytest.approx(1) for c in corners)
    gaps = {round(sum((a - b) ** 2 for a, b in zip(p, q)), 9) for i, p in enumerate(corners) for q in corners[:i]}
    assert len(gaps) == 1 and all(sum(c[j] for c in corners) == pytest.approx(0) for j in range(8))
    assert all(any(abs(c[j]) > 0.01 for c in corners) for j in range(8))  # no axis is left out
    with pytest.raises(ValueError):
        perturb.simplex_directions(5, 3)


def test_shift_keeps_the_weighted_centroid(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0, 0.0], i % 3) for i in range(7)], "id long, v array<double>, batch int")
    moved = perturb.batch_shift(df, "batch", 2.0, 1.0).filter("batch = hyp_batch")
    a, b = (d.select(*[F.avg(F.col("v")[j]) for j in range(3)]).first() for d in (df, moved))
    assert all(x == pytest.approx(y) for x, y in zip(a, b))
    flat = df.withColumn("v", F.array(F.lit(1.0), F.lit(1.0), F.lit(1.0)))
    assert perturb.sensitivity(perturb.batch_shift(flat, "batch", 1.0, 1.0), flat).first().ratio is None


def test_stratified_sample_is_cut_in_hash_order(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else "small") for i in range(9000)], "id long, s string")
    kept = perturb.stratified_sample(df, "s", 500, 3)
    hashes = {r.id: r.h for r in df.select("id", perturb.hash_order("id", 3).alias("h")).collect()}
    for name, n in (("big", 450), ("small", 50)):
        want = sorted((r.id for r in df.filter(F.col("s") == name).collect()), key=lambda i: (hashes[i], i))[:n]
        assert sorted(r.id for r in kept.filter(F.col("s") == name).collect()) == sorted(want)


def test_broadcasts_are_checked(spark):
    assert "broadcast" in bounded(spark.range(5), 5)._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in bounded(spark.range(6), 5)._jdf.queryExecution().analyzed().toString().lower()
    with pytest.raises(ValueError):
        bounded(spark.range(6), 5, must=True)


def test_folds(spark):
    ids = spark.range(30).select(F.concat(F.lit("cell-"), "id").alias("id"))
    folds = [r[0] for r in ids.select(perturb.fold_of("id")).collect()]
    assert set(folds) == {0, 1} and folds == [r[0] for r in ids.select(perturb.fold_of("id")).collect()]


def test_strict_join(spark):
    a = spark.createDataFrame([("1",), ("2",)], "id string")
    assert integrity.strict_join(a, a.withColumn("x", F.lit(1)), "id").count() == 2
    for bad in ([("1",)], [("1",), ("2",), ("3",)], [("1",), ("2",), ("2",)], [("1",), (None,)]):
        with pytest.raises(integrity.IntegrityError):
            integrity.strict_join(a, spark.createDataFrame(bad, "id string"), "id")
    with pytest.raises(integrity.IntegrityError):
        integrity.select_canonical(a, spark.createDataFrame([("9",)], "id string"), "id")


def test_vectors_repaired_or_refused(spark):
    df = spark.createDataFrame([([1.0, float("nan"), float("inf"), None],)], "v array<double>")
    assert df.select(integrity.repair_vector("v")).first()[0] == [1.0, 0.0, 0.0, 0.0]
    with pytest.raises(Exception, match="not finite"):
        df.select(integrity.strict_vector("v")).collect()


def test_scalars(spark):
    df = spark.createDataFrame([("a.b-1",), ("x;y| NA ,z",), (None,)], "s string")
    rows = df.select(S.normal_name("s"), S.split_list("s"), S.is_missing("s"), S.ontology_id(F.lit("CL_0000123")), S.year_in(F.lit("x 1999 y"))).collect()
    assert rows[0][0] == "a-b" and rows[1][1] == ["x", "y", "z"] and rows[2][2] and rows[0][3:] == ("CL:0000123", 1999)
    assert df.select(S.canonical_hash("s")).distinct().count() == 3
    names = spark.createDataFrame([(x,) for x in ("AAAC-2", "AAAC-3", "AAAC.1-1", "A.1", "A.12")], "s string")
    assert [r[0] for r in names.select(S.normal_name("s")).collect()] == ["AAAC-2", "AAAC-3", "AAAC", "A", "A-12"]
    with pytest.raises(ValueError):
        S.pick("s", [1, 1])


def test_affinity_and_propagation(spark):
    rows = [(i, [float(i % 2) * 50 + i * 0.1]) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    edges = models.fuzzy_affinity(N.exact_neighbors(df, 4))
    assert edges.filter("w < 0 or w > 1.000001 or a >= b").count() == 0
    rng = np.random.default_rng(3)
    d = np.sort(rng.random((50, 15)) + 0.2, axis=1)
    assert np.abs(models.smooth_weights(d, float(d.mean())).sum(axis=1) - np.log2(16)).max() < 1e-4
    assert (models.smooth_weights(np.zeros((2, 3)), 0.0) == 1.0).all()
    spread = models.label_propagation(edges, 3).collect()
    sides = {0: set(), 1: set()}
    for r in spread:
        sides[r.node % 2].add(r.cluster)
    assert not sides[0] & sides[1]
    labels = spark.createDataFrame([(0, 5), (1, 7), (2, 7), (3, 7)], "node long, cluster long")
    around = spark.createDataFrame([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)], "q long, n long")
    assert {r.node: r.cluster for r in models.majority_refinement(labels, around).collect()}[0] == 7


def test_modularity_clusters(spark):
    rng = random.Random(2)
    pairs = [(i, j, 1.0 if i // 10 == j // 10 else 0.05) for i in range(30) for j in range(i) if i // 10 == j // 10 or rng.random() < 0.1]
    edges = spark.createDataFrame([(j, i, w) for i, j, w in pairs], "a long, b long, w double")
    sinks.checkpoint_folder(spark)
    members = models.modularity_grid(edges, [1.0], [0], 5)
    assert members.count() == 30
    planted = spark.createDataFrame([(1.0, 1, i, i // 10) for i in range(30)], "resolution double, seed long, node long, cluster long")
    got = {r.seed: r for r in models.modularity(edges, members.unionByName(planted)).collect()}
    total = 2 * sum(w for _, _, w in pairs)
    strength = [sum(w * ((i // 10 == g) + (j // 10 == g)) for i, j, w in pairs) for g in range(3)]
    inner = 2 * sum(w for i, j, w in pairs if i // 10 == j // 10)
    assert got[1].modularity == pytest.approx(inner / total - sum((k / total) ** 2 for k in strength))
    assert got[0].modularity > 0.75 * got[1].modularity and 3 <= got[0].n_clusters <= 6


def test_pca_and_scaling(spark):
    df = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "id long, v array<double>")
    p = [r.v[0] for r in models.principal_components(df, 1).orderBy("id").collect()]
    assert p == sorted(p) and sum(p) == pytest.approx(0, abs=1e-9)
    z = models.scaled(df).orderBy("id").collect()
    assert z[0].v[2] == 0.0 and z[0].v[0] == pytest.approx(z[0].v[1])
    assert models.kmeans(df, 2).select("cluster").distinct().count() == 2


def png(width, height):
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))


def test_readers(spark, tmp_path):
    (tmp_path / "e.csv").write_text("id,a,b\n007,1,2\n01,3,4.5\n")
    got = readers.embedding_csv(spark, str(tmp_path / "e.csv"), 2)
    assert sorted(tuple(r) for r in got.collect()) == [("007", [1.0, 2.0]), ("01", [3.0, 4.5])]
    with pytest.raises(integrity.IntegrityError):
        readers.embedding_csv(spark, str(tmp_path / "e.csv"), 3)
    for body in ("id,a,b\nx,1,y\n", "id,a,b\nx,1,2\nx,3,4\n", "id,a,b\nx,1,\n"):
        (tmp_path / "bad.csv").write_text(body)
        with pytest.raises(Exception):
            readers.embedding_csv(spark, str(tmp_path / "bad.csv"), 2).collect()
    with pytest.raises(integrity.IntegrityError):
        readers.embedding_csv(spark, str(tmp_path / "e.csv"), 2, spark.createDataFrame([("007",)], "cell_id string"))
    (tmp_path / "pos.csv").write_text("AA,1,0,1,10,20\nBB,0,0,2,30,40\n")
    assert readers.spot_positions(spark, str(tmp_path / "pos.csv")).count() == 2
    good = dict.fromkeys(readers.SCALE_FIELDS, 1.5)
    (tmp_path / "s.json").write_text(json.dumps(good))
    assert readers.scale_factors(spark, str(tmp_path / "s.json")).first().tissue_hires_scalef == 1.5
    for bad in (good | {"more": 1}, good | {"tissue_hires_scalef": 0}, {"tissue_hires_scalef": 1}):
        (tmp_path / "s2.json").write_text(json.dumps(bad))
        with pytest.raises(Exception):
            readers.scale_factors(spark, str(tmp_path / "s2.json")).collect()
    (tmp_path / "i.png").write_bytes(png(30, 20))
    assert tuple(readers.png_images(spark, str(tmp_path / "i.png")).first())[1:] == (30, 20)
    (tmp_path / "j.png").write_bytes(b"GIF89a" + bytes(40))
    with pytest.raises(Exception, match="PNG"):
        readers.png_images(spark, str(tmp_path / "j.png")).collect()


def test_marker_and_ontology_readers(spark, tmp_path):
    head = "species\tofficial gene symbol\tcell type\tcanonical marker\n"
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write(head + "Hs\tINS\tBeta\t1\nMm Hs\tIAPP\tBeta\tcanonical marker\nMm\tXX\tBeta\t1\nHuman\tMaf_a\tBeta\tYes\nHs\tNO\tBeta\t0\nhomo sapiens\tx1.2\tBeta\ttrue\nHs\ta b\tBeta\t1\nHs\tINS\t\t1\n")
    assert sorted(r.symbol for r in readers.marker_tsv(spark, str(tmp_path / "m.tsv.gz")).collect()) == ["IAPP", "INS", "Maf_a", "x1.2"]
    (tmp_path / "none.tsv").write_text(head + "Mm\tXX\tBeta\t1\n")
    with pytest.raises(integrity.IntegrityError):
        readers.marker_tsv(spark, str(tmp_path / "none.tsv"))
    (tmp_path / "c.obo").write_text('format-version: 1.2\n\n[Term]\nid: CL:0000001\nname: one\nsynonym: "uno" EXACT []\n\n[Term]\nid: CL:0000002\nname: two\nis_obsolete: true\n\n[Term]\nid: GO:1\nname: no\n\n[Typedef]\nid: CL:0000009\nname: part\n')
    terms = readers.ontology_obo(spark, str(tmp_path / "c.obo"))
    assert sorted((r.id, r.name, list(r.synonyms), r.obsolete) for r in terms.collect()) == [("CL:0000001", "one", ["uno"], False), ("CL:0000002", "two", [], True)]
    named = readers.resolve_names(spark.createDataFrame([("one",), ("two",)], "label string"), terms, "label").collect()
    assert {r.label: r.term_id for r in named} == {"one": "CL:0000001", "two": None}


def test_owl(spark, tmp_path):
    (tmp_path / "c.owl").write_text('<rdf:RDF xmlns:rdf="r" xmlns:owl="o" xmlns:rdfs="s" xmlns:oboInOwl="b"><owl:Class rdf:about="http://x/CL_0000001"><rdfs:label>one</rdfs:label><oboInOwl:hasExactSynonym>uno</oboInOwl:hasExactSynonym></owl:Class><owl:Class rdf:about="http://x/CL_0000002"><rdfs:label>two</rdfs:label><owl:deprecated>true</owl:deprecated></owl:Class></rdf:RDF>')
    assert sorted((r.id, r.name, list(r.synonyms), r.obsolete) for r in readers.ontology_owl(spark, str(tmp_path / "c.owl")).collect()) == [("CL:0000001", "one", ["uno"], False), ("CL:0000002", "two", [], True)]


def test_runs(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    run = sinks.Run(spark, f"file://{tmp_path}", "a")
    run.write("t", df)
    assert not (tmp_path / "a").exists()
    at = run.publish(kind="score")
    assert sinks.read_table(spark, at, "t").count() == 5 and json.loads((tmp_path / "a/manifest.json").read_text())["kind"] == "score"
    with pytest.raises(FileExistsError):
        sinks.Run(spark, f"file://{tmp_path}", "a")
    with pytest.raises(ValueError):
        sinks.write_json(spark, f"file://{tmp_path}/n.json", {"x": float("nan")})
    spark.range(1).withColumn("x", F.lit(9).cast("long")).write.mode("append").parquet(f"{at}/t")
    with pytest.raises(integrity.IntegrityError):
        sinks.read_table(spark, at, "t")
    lines = [r.line for r in sinks.markdown(df.limit(2), ["id"]).collect()]
    assert lines == ["| id | x |", "|---|---|", "| 0 | 0 |", "| 1 | 2 |"]


def test_stream_and_asof(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.file_stream(spark, str(tmp_path / "in"), events.schema)
    for _ in range(2):  # the second time there is nothing new
        ingest.ingest_available(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == events.count()
    counts = ingest.windowed_counts(back, "ts", ["event_type"], "1 day", "1 hour")
    assert counts.agg(F.sum("n")).first()[0] == events.count()
    left = spark.createDataFrame([("k", 5), ("k", 10), ("j", 1)], "key string, t int")
    right = spark.createDataFrame([("k", 5, "a"), ("k", 7, "b")], "key string, t int, v string")
    assert sorted(tuple(r) for r in ingest.asof_join(left, right, "key", "t", "v").collect()) == [("j", 1, None), ("k", 5, "a"), ("k", 10, "b")]
