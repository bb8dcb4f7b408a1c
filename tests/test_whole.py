"""Queries that take in the whole of their tables and vectors."""

import json

import numpy as np
import pytest

from simvane.plans import catalog


def test_json_rows_of_every_event(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "props").collect()
    want = sorted((e.event_id, k, str(v)) for e in events for k, v in json.loads(e.props).items())
    assert any(i % 10 for i, _, _ in want)
    assert sorted(tuple(r) for r in catalog.QUERIES["json_rows"](spark, sf).collect()) == want


@pytest.mark.parametrize("name", ["scaled_vectors", "repaired_vectors", "counterfactual_observed", "batch_simplex_shift", "local_warp"])
def test_all_components(spark, sf, name):
    assert {len(r.v) for r in catalog.QUERIES[name](spark, sf).collect()} == {64}


def test_effective_rank_of_whole_vectors(spark, sf):
    x = np.array([r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("embedding").collect()], float)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False)
    p = s / s.sum()
    (got,) = catalog.QUERIES["effective_rank"](spark, sf).collect()
    assert got.dim == 64 and got.effective_rank == pytest.approx(np.exp(-(p * np.log(p)).sum()), abs=1e-5)
