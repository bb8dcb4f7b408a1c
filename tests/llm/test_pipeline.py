"""The pipeline, stage by stage against brute force where that is small, and its queries against SQL."""

import collections

import duckdb
import pytest

import corpus_pipeline
from simvane.llm import queries
from simvane.llm.common import shared_folder, stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), shared_folder(spark) + name)
        sizes.append(docs.count())
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] < sizes[4] == sizes[5]
    again = corpus_pipeline.run(spark, sf)
    assert collections.Counter(tuple(r) for r in again.collect()) == collections.Counter(tuple(r) for r in docs.collect())


def test_stages_on_odd_rows(spark, odd, sf):
    docs = odd.withColumnRenamed("row", "lang").withColumnRenamed("n_words", "n_chars")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stored(stage(spark, docs, sf), shared_folder(spark) + "x")
        assert docs.columns[0] == "doc_id"
    assert docs.count() > 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf).select(*names).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want.fetchall())
