"""Candidate indexes for vectors against exact search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import jobs
from mnemospark.operators import joins as J
from mnemospark.operators import vectors as V


def clustered(n, dim, seed, spread, centres):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return c[rng.integers(centres, size=n)] + spread * rng.standard_normal((n, dim))


def frame(spark, x, name="id", start=0):
    return spark.createDataFrame([(start + i, [float(z) for z in v]) for i, v in enumerate(x)], f"{name} long, vector array<double>")


@pytest.mark.parametrize("n, spread", [(1500, 0.5), (6000, 0.5), (1500, 5.0)])
def test_lists_find_the_nearest(spark, n, spread):
    x = clustered(n, 24, n, spread, 40)
    q, v = frame(spark, x[:60], "query_id").withColumn("own", F.col("query_id")), frame(spark, x)
    exact = {(r["query_id"], r["id"]) for r in J.vector_topk(q, v, 10, -2.0).collect()}
    got = {(r["query_id"], r["id"]) for r in J.vector_topk(q, v, 10, -2.0, mode="lists", recall=0.98, block_rows=500).collect()}
    assert len(exact) == len(got) == 600 and len(exact & got) / 600 >= 0.95


def test_lists_leave_most_vectors_of_clustered_tables_out():
    x = clustered(4000, 24, 1, 0.5, 40)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = V.fit_lists(x, 63)
    assert V.probes_for(x, c, 10, 0.98) <= 16


def test_lists_of_odd_tables(spark):
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, float("nan")]), (5, [1.0, None]), (6, [1.0, 2.0, 3.0]), (7, [1.0, 0.0]), (8, [1.0, 0.1]), (9, [-1.0, 0.1])]
    v = spark.createDataFrame(odd, "id long, vector array<double>")
    q = v.withColumnRenamed("id", "query_id").withColumn("own", F.lit(None).cast("long"))
    for mode in ("exact", "lists"):
        got = sorted((r["query_id"], r["id"]) for r in J.vector_topk(q, v, 2, 0.5, mode=mode).collect() if r["query_id"] != 6)
        assert got == [(7, 7), (7, 8), (8, 7), (8, 8), (9, 9)]
        assert J.vector_topk(q, v.limit(0), 2, 0.5, mode=mode).count() == 0
    with pytest.raises(ValueError):
        J.vector_topk(q, v, 2, 0.5, mode="other")


@pytest.mark.parametrize("n, least", [(800, 0.9), (3000, 0.7)])
def test_bands_find_pairs(spark, n, least):
    x = clustered(n, 16, n, 0.25, n // 8)
    exact = {(r["a"], r["b"]) for r in J.vector_pairs(frame(spark, x), least).collect()}
    got = {(r["a"], r["b"]) for r in V.banded_pairs(frame(spark, x), least).collect()}
    assert got <= exact and len(got) >= 0.98 * len(exact) > 100


def test_bands_for_the_wanted_share():
    for n, least, recall in ((10**4, 0.9, 0.99), (10**8, 0.9, 0.95), (10**6, 0.7, 0.95)):
        tables, bits = V.bands_for(n, least, recall)
        agree = 1 - np.arccos(least) / np.pi
        assert 1 - (1 - agree**bits) ** tables >= recall - 1e-9 and tables <= 256


def test_near_dup_vectors_by_bands_equal_blocks(spark):
    x = clustered(300, 16, 9, 0.15, 60)
    x = np.vstack([x, x[:30], x[:30], np.repeat(x[:1], 200, axis=0)])  # copies, one of them many times
    v = frame(spark, x)
    tokens = v.select("id", F.array(F.lit("a"), (F.col("id") % 3).cast("string")).alias("tokens"))
    run = lambda mode: sorted((r["id"], r["other"], r["kind"]) for r in J.near_dup_vectors(v, tokens, 0.98, 0.95, 0.9, mode=mode, recall=0.9999).collect())
    assert run("bands") == run("exact") and run("exact")


def test_vector_clusters_by_bands_equal_blocks(spark):
    x = np.vstack([clustered(300, 16, 4, 0.3, 30), np.ones((50, 16))])
    run = lambda mode: sorted((r["id"], r["leader"]) for r in jobs.vector_clusters(frame(spark, x), 0.8, 3, mode, 0.9999).collect())
    assert run("bands") == run("exact") and len(run("exact")) > 100


def test_semantic_candidates_look_at_all_that_terms_can_lift(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 6))
    corpus = spark.createDataFrame([(i, "alpha beta" if rng.random() < 0.2 else "alpha" if rng.random() < 0.2 else "zzz", f"s{i % 150}") for i in range(400)], "id long, text string, source string").persist()
    queries = spark.createDataFrame([(0, "alpha beta gamma"), (1, "alpha"), (2, "")], "query_id long, query string")
    q = frame(spark, x[:3], "query_id")
    run = lambda k: {(r["query_id"], r["source"]): (r["rank"], r["id"]) for r in J.semantic_candidates(queries, q, frame(spark, x), corpus, k).collect()}
    few, all_ = run(5), run(1000)
    assert few == {k: v for k, v in all_.items() if v[0] <= 5} and len(few) == 15
