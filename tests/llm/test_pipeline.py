"""The pipeline's stages, each on what the one before kept."""

from __future__ import annotations

import collections
import random
import re

from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.plans.scratch import materialize
from tests.llm.test_ops import brute_exact, union_find

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == columns
    tox, exact, near, mix, packed = (seen[n] for n, _ in corpus_pipeline.STAGES)
    keep = {k for _, k, _ in brute_exact(list(zip(tox.doc_id, tox.text, strict=True)))}
    assert set(exact.doc_id) == keep
    sets = {r.doc_id: shingles(r.text) for r in exact.itertuples()}
    by = collections.defaultdict(set)
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    pairs = {(a, b) for ids in by.values() if len(ids) < 50 for a in ids for b in ids if a < b}
    alike = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert set(near.doc_id) == set(union_find(list(sets), alike).values())
    assert set(mix.doc_id) <= set(near.doc_id) and mix.groupby("doc_id").size().max() <= 2
    assert set(packed.doc_id) == set(mix.doc_id) and packed.groupby("bin_id")["size"].sum().max() <= 2048
    assert packed.groupby(["bin_id", "doc_id"]).size().max() == 1


def test_planted_copies_go_and_clean_documents_stay(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in "klmnprst" for b in ("ana", "ero", "ilu", "osti")]
    clean = [(k, " ".join(rng.choice(words) + str(rng.randint(0, 60)) for _ in range(200)), "en", f"s{k % 3}", 0) for k in range(40)]
    t = clean[7][1].split()
    near = " ".join([*t[:100], "changed", *t[101:]])
    rows = [*clean, (100, clean[3][1] + "\n", "en", "s0", 0), (101, near, "en", "s1", 0), (102, None, "en", None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_copies(spark, df, SF).collect()}
    assert kept == {i for i, *_ in rows} - {3}  # of equal texts the one with more characters stays
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df.where("doc_id <> 3"), SF).collect()}
    assert kept == {i for i, *_ in rows} - {3, 101}


def test_null_and_repeated_ids_through_all_stages(spark):
    rng = random.Random(12)
    text = lambda n=60: " ".join(f"{rng.choice('bdfgk')}{rng.choice(('ana', 'elo', 'iru'))}{rng.randint(0, 99)}" for _ in range(n))
    ids = [None] * 8 + [7] * 6 + [9007199254740993 + k for k in range(10)]
    rows = [(i, text(), "en", f"s{k % 2}", k) for k, i in enumerate(ids)]
    copies = [(None, rows[0][1], "en", "s0", 100), (None, rows[0][1], "en", "s0", 101), (7, rows[8][1], "en", "s0", 102), (7, rows[8][1], "en", "s0", 103)]
    near = [(None, rows[15][1] + " one", "en", "s0", 104), (7, rows[1][1] + " two", "en", "s0", 105)]
    docs = spark.createDataFrame([*rows, *copies, *near], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({"score": F.lit("mine"), "row": F.lit(3), "one": F.lit(1)})
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        seen[name] = [r.asDict() for r in docs.collect()]
    texts = lambda name: collections.Counter(r["text"] for r in seen[name])
    clean = {r["n_chars"] for r in seen["toxicity"]}
    assert clean == {r[4] for r in [*rows, *copies, *near]}
    assert texts("exact_dedup") == collections.Counter({r[1] for r in [*rows, *near]})
    want = [r for r in rows if r[4] != 1] + near[1:]  # of near ones the row with an id stays
    assert texts("near_dedup") == collections.Counter(r[1] for r in want)
    brute = corpus_pipeline.mixing.mix(spark.createDataFrame(want, "doc_id long, text string, lang string, source string, n_chars long"), whole=True, key=F.col("n_chars"))
    named = {r[4]: r[1] for r in want}
    assert texts("mixing") == collections.Counter({named[r["row_key"]]: r["copies"] for r in brute.collect() if r["copies"]})
    assert collections.Counter(r["doc_id"] for r in seen["packing"]) == collections.Counter(r["doc_id"] for r in seen["mixing"])


def test_empty_tables_pass_all_stages(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.count() == 0
