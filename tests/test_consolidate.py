"""Cluster summaries and consolidated clusters against brute force; vector pairs against numpy."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from mnemospark.operators import consolidate as C
from mnemospark.operators import jobs
from mnemospark.operators import joins as J


def sentence(text):
    parts = [p.strip(" ") for p in re.split(r"[.\n]", text)]
    return next((p for p in parts if len(p.encode()) > 5), text)[:120]


def words(s):
    return {w for w in re.split("[^a-z0-9]+", s.lower()) if len(w) > 1}


def brute_summaries(entries, clusters, most=8, overlap=0.8):
    homes, out = {}, {}
    for i, leader in clusters:
        homes.setdefault(leader, []).append(i)
    for leader, ids in homes.items():
        taken = []
        for i in sorted(ids):
            s = sentence(entries[i])
            like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
            if len(taken) < most and all(like(words(s), words(t)) < overlap for t in taken):
                taken.append(s)
        out[leader] = (len(ids), ". ".join(taken))
    return out


def test_summaries_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(14)]
    entries = {i: " ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) + rng.choice([". More.", "\nnext", ""]) for i in range(200)}
    clusters = [(i, i % 7) for i in range(200) if rng.random() < 0.8]
    got = jobs.summarize_clusters(spark.createDataFrame(list(entries.items()), "id long, text string"), spark.createDataFrame(clusters, "id long, leader long"))
    assert {r["leader"]: (r["size"], r["summary"]) for r in got.collect()} == brute_summaries(entries, clusters)


def test_a_second_run_changes_nothing(spark, tmp_path):
    rows = [(i, f"alpha beta topic{i % 3} common{i % 3}. rest {i}", [float(i % 3 == k) + 0.01 * i for k in range(3)]) for i in range(30)]
    entries = spark.createDataFrame(rows, "id long, text string, vector array<double>")
    clusters = spark.createDataFrame([(i, i % 3) for i in range(30)], "id long, leader long")
    show = lambda df: sorted((r["id"], r["label"], r["size"], r["version"]) for r in df.collect())
    path = f"{tmp_path}/crystals"
    first = show(C.consolidate(entries.where("id < 21"), clusters.where("id < 21"), path))
    again = show(C.consolidate(entries.where("id < 21"), clusters.where("id < 21"), path))
    assert first == again and {v for *_, v in first} == {1} and len(first) == 3
    grown = show(C.consolidate(entries.where("id < 21 or id % 3 = 0"), clusters.where("id < 21 or id % 3 = 0"), path))
    assert sorted(v for *_, v in grown) == [1, 1, 2] and [x[:2] for x in grown] == [x[:2] for x in first]
    members = {(r["id"], r["member"]) for r in C.current(spark, path)[1].collect()}
    assert len(members) == 24 and {i for i, *_ in grown} == {i for i, _ in members}


def test_vector_pairs_equal_all_pairs(spark):
    x = np.random.default_rng(3).standard_normal((70, 5))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vector array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(a, b) for a in range(70) for b in range(a + 1, 70) if unit[a] @ unit[b] >= 0.4}
    for block in (9, 2048):
        assert {(r["a"], r["b"]) for r in J.vector_pairs(df, 0.4, block).collect()} == want


def test_callers_see_their_clusters(spark):
    clusters = spark.createDataFrame([(1, [1.0, 0.0], 7, "private"), (2, [0.9, 0.1], 8, "shared"), (3, [0.8, 0.2], 8, "private"), (4, [0.7, 0.3], None, "shared")], "id long, centroid array<double>, owner_id long, visibility string")
    queries = spark.createDataFrame([(1, 7), (2, 8), (3, None)], "query_id long, caller long").withColumn("vector", F.array(F.lit(1.0), F.lit(0.0)))
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in jobs.search_clusters(queries, clusters).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 3)]
