"""Queries against their SQL on values that the given tables hold only at size, compared bit by bit: the sign of a zero counts."""

import duckdb
import numpy as np
import pytest

from simvane.plans import catalog


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Vectors in pairs that add up to 0, some of whose components round to 0 or are halves; pages with ids of one to six digits."""
    at = str(tmp_path_factory.mktemp("odd"))
    x = np.random.default_rng(5).normal(0, 0.125, (40, 64)).astype("f4")
    x[np.arange(40), np.arange(40)] = np.float32(4e-8)
    x[np.arange(40), (np.arange(40) + 9) % 64] = np.float32(0.0078125)
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(np.concatenate([x, -x]))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    pages = [(i, f"https://a{i}.example/b-{i}") for i in (0, 7, 99, 2499, 8099, 8100, 8101, 54321, 98100, 654321)]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return at


def bits(v):
    return tuple(map(bits, v)) if isinstance(v, (list, tuple)) else v.hex() if isinstance(v, float) else v


@pytest.mark.parametrize("name", ["local_warp", "repaired_vectors", "scaled_vectors", "embedding_file", "header_sanitize_scalars"])
def test_same_bits(spark, odd, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet/*.parquet')")
    want = con.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert "-0x0.0p+0" in str(bits(rows)) or name == "header_sanitize_scalars"
    assert sorted(bits(tuple(r[n] for n in names)) for r in catalog.QUERIES[name](spark, odd).collect()) == sorted(map(bits, rows))
