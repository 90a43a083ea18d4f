"""Findings of round 3, each by a small case that failed before."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.functions import scores as S
from mnemospark.functions import text as T
from mnemospark.llm import simhash
from mnemospark.operators import evaluate
from mnemospark.operators import jobs
from mnemospark.operators import joins as J
from mnemospark.operators import vectors as V


def test_a_query_meets_the_cluster_that_bears_its_own_number(spark):  # F9
    queries = spark.createDataFrame([(0, 0, [1.0, 0.0])], "query_id long, own long, vector array<double>")
    clusters = spark.createDataFrame([(0, [1.0, 0.1]), (1, [0.5, 0.5])], "id long, centroid array<double>")
    assert [r["id"] for r in jobs.search_clusters(queries, clusters, k=2).orderBy("rank").collect()] == [0, 1]


@pytest.mark.parametrize("seed", range(2))
def test_halves_round_as_in_sql(spark, duck, seed):  # F9
    rng = np.random.default_rng(seed)
    # products of four and two decimals are often halves of the fourth, of which doubles lie on either side
    values = [float(a) / 1e4 * (1 + float(b) / 100) for a, b in zip(rng.integers(0, 10000, 2000), rng.integers(0, 15, 2000), strict=True)] + [-0.00015, 0.0, 0.57755]
    want = [duck.execute("select round(?::double, 4)", [x]).fetchone()[0] for x in values]
    got = [r["y"] for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double").select("i", S.rounded(F.col("x"), 4).alias("y")).orderBy("i").collect()]
    assert got == want
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (None,)], "x double").select(S.rounded(F.col("x"), 4).alias("y")).collect()
    assert np.isnan(odd[0]["y"]) and odd[1]["y"] == float("inf") and odd[2]["y"] is None


def test_queries_without_terms_keep_their_nearest_only(spark, monkeypatch):  # F14
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 8))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    corpus = rows.select("id", F.lit("some text").alias("text"), F.concat(F.lit("s"), F.col("id") % 50).alias("source"))
    queries = spark.createDataFrame([(1, "some")], "query_id long, query string")
    asked = rows.where("id < 3").select(F.col("id").alias("query_id"), "vector")
    sizes, nearest = [], V.nearest

    def counted(*args, **kwargs):
        out = nearest(*args, **kwargs)
        sizes.append(out.where("query_id <> 1").count())
        return out

    monkeypatch.setattr(V, "nearest", counted)
    got = J.semantic_candidates(queries, asked, rows, corpus, 5, 0.0).orderBy("query_id", "rank").collect()
    assert sum(sizes) <= 2 * 3 * 5
    for q in (0, 2):
        cosine = x @ x[q] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[q])
        best = {}
        for i in np.argsort(-cosine):
            best.setdefault(f"s{i % 50}", int(i))
        assert [(r["source"], r["id"]) for r in got if r["query_id"] == q] == list(best.items())[:5]


def test_blocks_of_pairs_grow_with_the_rows():  # F17, F22
    assert J.pair_blocks(600_000, 2048) <= J.PAIR_BLOCKS
    assert all(J.pair_blocks(n, 2048) * max(J.PAIR_ROWS, 2048) >= n for n in (1, 2048, 10**6, 10**7))
    assert J.pair_blocks(5000, 2048) == 3


def test_pairs_of_vectors_in_few_large_blocks(spark):  # F17, F22
    rng = np.random.default_rng(9)
    x = rng.standard_normal((150, 6))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, vector array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if (u @ u.T)[i, j] >= 0.5}
    got = [(r["a"], r["b"]) for r in J.vector_pairs(df, 0.5, 4).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_equal_sets_are_told_apart_by_all_of_their_tokens(spark):  # F4 to F7
    sets = [["a b"], ["a", "b"], ["b", "a"], [], [""], ["a", "", "b"], []]
    reps, members = J.jaccard_classes(spark.createDataFrame([(i, t) for i, t in enumerate(sets)], "id long, tokens array<string>"))
    assert sorted(r["id"] for r in reps.collect()) == [0, 1, 3, 4, 5]
    assert sorted((r["member"], r["id"]) for r in members.collect()) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 3)]
    assert "tokens" not in members._jdf.queryExecution().executedPlan().toString()


def test_texts_are_split_once_for_both_counts_of_members(spark, monkeypatch):  # F19
    from mnemospark.operators import aggregates as agg

    rows = [("x", 1, "a"), ("x", 1, "a"), ("x", 2, "a"), ("x", 2, "b"), ("x", None, "a"), ("y", 3, "c")]
    words = spark.createDataFrame(rows, "cluster_id string, member_id long, word string")
    out = agg.cluster_labels(words)
    assert "LogicalRDD" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [("x", "b-a"), ("y", "c")]


def test_token_sets_of_two_texts_are_made_once_a_row(spark):  # F18
    from mnemospark.functions import text as T

    pairs = spark.createDataFrame([("aa bb", "bb cc"), ("", "")], "a string, b string").select(T.text_jaccard(F.col("a"), F.col("b"), "lower2", 0.5).alias("x"))
    assert pairs._jdf.queryExecution().analyzed().toString().count("split(") == 2
    assert [r["x"] for r in pairs.collect()] == [1 / 3, 0.5]


def test_near_copies_meet_in_balls_of_their_fingerprints(spark, monkeypatch):  # F11
    rows = [(1, 9, 0), (2, 9, 0), (3, 8, 0b11), (4, 7, 0b111 << 40), (5, 6, -1), (6, 6, -3)]
    pairs = simhash._ball_pairs(spark.createDataFrame(rows, "node long, n int, fp long")).collect()
    assert {(r["a"], r["b"], r["sizes"]) for r in pairs} == {(1, 2, 18), (1, 3, 17), (5, 6, 12)}
    met, real = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda fps: met.append(1) or real(fps))
    words = [f"w{k * k % 397}" for k in range(300)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:299], "x"])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3] and met


@pytest.mark.parametrize("latest", [3, 70])
def test_novelty_adds_up_what_is_common_and_makes_no_pairs(spark, latest):  # F20
    rng = np.random.default_rng(latest)
    tokens = lambda: sorted({f"t{x}" for x in rng.zipf(1.5, int(rng.integers(0, 12))) if x < 40})
    schema = "id long, owner_id long, tokens array<string>, status string, created_at int"
    base = [(k, k % 3 if k % 11 else None, tokens() if k % 13 else None, "active" if k % 5 else "archived", int(rng.integers(0, 50))) for k in range(300)]
    batch = [(k % 190, k % 4, tokens() if k % 17 else None, "active", 0) for k in range(200)]  # ids come twice, owner 3 has no rows
    batch.append(batch[1])

    def likest(row):
        mine = sorted((b for b in base if b[1] == row[1] and b[3] == "active"), key=lambda b: (-b[4], -b[0]))[:latest]
        met = [(set(row[2]), set(b[2])) for b in mine if row[2] is not None and b[2] is not None]
        return max([len(a & b) / len(a | b) if a | b else 1.0 for a, b in met], default=0.0)

    most = {}
    for row in batch:
        most[row[0]] = max(most.get(row[0], 0.0), likest(row))
    got = jobs.novelty(spark.createDataFrame(batch, schema), spark.createDataFrame(base, schema), latest)
    assert "array_intersect" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = got.select("id", "owner_id", "surprise", "admitted").collect()
    assert len(rows) == len(batch)
    assert all(r["surprise"] == pytest.approx(1 - most[r["id"]], abs=1e-8) and r["admitted"] == (round(1 - most[r["id"]], 9) >= 0.25) for r in rows)


def test_words_are_parted_without_a_pattern_as_with_it(spark):  # F24, F21
    texts = ["A-b c\x00d\te", "gr\u00fc\u00df-e \u212aelvin \u0130x", "\u4e2d\u6587 mixed-In \U0001f600x", "", None, " --  ", "x\u2014y\u00a0z\u3000q\u0301r", "line\none\x0btwo\x85three"]
    rows = [(k, x) for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "k int, x string")
    by = lambda pattern, least: F.filter(F.split(F.lower("x"), pattern), lambda w: F.length(w) > least)
    ws = F.array_distinct(F.filter(F.split("x", r"\s+"), lambda w: w != ""))
    got = df.select(T.ascii_words(F.col("x")), by("[^a-z0-9-]+", 0), T.token_set(F.col("x"), "lower2"), F.array_distinct(by("[^a-z0-9]+", 1)), T.token_set(F.col("x"), "ws"), ws).collect()
    assert all(r[k] == r[k + 1] for r in got for k in (0, 2, 4)) and any(r[0] for r in got)
    plan = df.select(F.explode(T.ascii_words(F.col("x"))))._jdf.queryExecution().optimizedPlan().toString()
    assert "translate" in plan


def test_quotations_meet_on_one_rare_word_without_hashes_of_places(spark):  # F24, F25, F27
    docs = spark.createDataFrame([(1, "x a b the c d y"), (2, "the the the a b"), (3, "xa b the cz"), (4, None)], "id long, text string")
    items = spark.createDataFrame([(7, "a b the c"), (8, "the the the"), (9, "q the the"), (5, "b zz the c")], "query_id long, passage string")
    got = evaluate.quotations(docs, items)
    assert {(r["query_id"], r["id"]) for r in got.collect()} == {(7, 1), (7, 3), (8, 2)}
    assert "xxhash64" not in got._jdf.queryExecution().optimizedPlan().toString()
