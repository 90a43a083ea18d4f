"""Operators without SQL, and rules with hand-written rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as T
from mnemospark.operators import filters, ingest, jobs
from mnemospark.operators import joins as J
from mnemospark.operators import windows as W
from mnemospark.sources import corpus
from mnemospark.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def leaders(n, pairs, least):
    near = {frozenset(p) for p in pairs}
    seeds, out = [], {}
    for i in range(n):
        home = next((s for s in seeds if frozenset((s, i)) in near), None)
        if home is None:
            seeds.append(i)
            home = i
        out[i] = home
    sizes = {s: list(out.values()).count(s) for s in seeds}
    return {i: s for i, s in out.items() if sizes[s] >= least}


@pytest.mark.parametrize("seed", range(3))
def test_leader_clusters_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    n = 30
    pairs = [(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12]
    for in_one in (0, 40, 2_000_000):  # by rounds alone, in part, by the pass alone
        got = jobs.leader_clusters(spark.createDataFrame(pairs, "a long, b long"), spark.range(n), 2, in_one=in_one)
        assert {r["id"]: r["leader"] for r in got.collect()} == leaders(n, pairs, 2)


def test_leader_clusters_of_a_long_chain(spark):
    pairs = spark.range(10_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = jobs.leader_clusters(pairs, spark.range(10_001), 1)
    assert got.where("leader = id").count() == 5001 and got.where("id % 2 = 1 and leader = id - 1").count() == 5000


def test_leader_clusters_without_pairs(spark):
    assert jobs.leader_clusters(spark.createDataFrame([], "a long, b long"), spark.range(4), 2).count() == 0


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(5)
    sets = {i: sorted({f"w{int(rng.random() ** 2 * 25)}" for _ in range(rng.randint(0, 9))}) for i in range(60)}
    df = spark.createDataFrame(list(sets.items()), "id long, tokens array<string>")
    got = {(r["a"], r["b"]) for r in J.jaccard_join(df, df, 0.5, selfjoin=True).collect()}
    sim = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y)) if x or y else 0
    assert got == {(a, b) for a in sets for b in sets if a < b and sim(sets[a], sets[b]) >= 0.5} and got


def test_vector_topk_in_several_blocks(spark):
    rng = random.Random(2)
    v = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(40)]
    q = spark.createDataFrame(v[:7] + [(99, None)], "query_id long, vector array<double>")
    c = spark.createDataFrame(v, "id long, vector array<double>")
    small = {(r["query_id"], r["rank"]): r["id"] for r in J.vector_topk(q, c, 5, -2.0, block_rows=8).collect()}
    large = {(r["query_id"], r["rank"]): r["id"] for r in J.vector_topk(q, c, 5, -2.0).collect()}
    assert small == large and len(small) == 35 and all(small[i, 1] == i for i in range(7))


def test_global_rank_equals_one_window(spark):
    df = spark.range(500).select("id", (F.col("id") * 37 % 101).cast("double").alias("x"))
    got = {r["id"]: r["rank"] for r in W.global_rank(df, "x", "id", 7).collect()}
    order = sorted(range(500), key=lambda i: (-(i * 37 % 101), i))
    assert got == {i: k + 1 for k, i in enumerate(order)}


def test_rate_audit_denied_requests_do_not_count(spark):
    ts = [(i, f"2024-01-01 00:00:{s:02d}", "a") for i, s in enumerate([0, 1, 2, 3, 30, 59])] + [(9, "2024-01-01 00:01:01", "a")]
    df = spark.createDataFrame(ts, "event_id long, t string, k string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    got = {r["event_id"]: r["accepted"] for r in streams.rate_audit(df, 2, 60, ["k"]).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False, 9: True}


def test_stream_dedup_and_sessions_run(spark, data, tmp_path):
    raw = spark.readStream.schema(spark.read.parquet(f"{data}/events.parquet").schema).parquet(f"{data}/events.parquet*")
    e = raw.select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), "user_id").alias("agent"), "event_type", F.lit(1).cast("long").alias("saved"), F.lit(1).cast("long").alias("served"), F.col("event_type").alias("operation"))
    for k, df in enumerate((streams.stream_dedup(e, ["event_type"], "1 hour"), streams.stream_sessions(e), streams.stream_rollup(e))):
        q = df.writeStream.format("parquet").option("path", f"{tmp_path}/{k}").option("checkpointLocation", f"{tmp_path}/c{k}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.read.parquet(f"{tmp_path}/{k}").count() > 0


def test_chunks_join_to_the_text():
    text = "One. Two; three\nfour five six. " * 20
    parts = ingest.chunk_text(text, 50)
    assert "".join(parts) == text and max(map(len, parts)) <= 50 and parts[0].endswith((".", ";", "\n"))
    assert ingest.chunk_text("", 10) == []


def test_budget_shares_add_up(spark):
    items = spark.createDataFrame([(1, f"n{i}", 100 * (i + 1), float(i)) for i in range(8)], "context long, name string, tokens long, priority double")
    got = {r["name"]: r["share"] for r in jobs.allocate_budget(items, 400, 40, 1200).collect()}
    assert sum(got.values()) == pytest.approx(1200, abs=1e-3) and all(v <= 400 + 1e-6 for v in got.values()) and min(got.values()) >= 40 - 1e-6


def test_budget_skips_what_repeats(spark):
    r = spark.createDataFrame(
        [(1, "a", 0.9, 10, ["x", "y"], ["x"]), (1, "b", 0.8, 10, ["x", "y"], ["x"]), (1, "c", 0.7, 10, ["z"], ["x"]), (1, "d", 0.6, 90, ["q"], ["x"])],
        "query_id long, source string, relevance double, tokens long, terms array<string>, query_terms array<string>",
    )
    got = [x["source"] for x in jobs.apply_budget(r.withColumn("rank", F.lit(0)), 50).orderBy("rank").collect()]
    assert got == ["a", "c"]


def test_text_rules(spark):
    assert one(spark, T.redact(F.lit("Bearer " + "a" * 32 + " key = s3cr3t " + "f" * 41))) == "Bearer [REDACTED] [CREDENTIAL_REDACTED] [HASH_REDACTED]"
    assert one(spark, T.quality(F.lit("short"))) == 0
    assert one(spark, T.quality(F.lit("The file src/main.rs holds the parser, which it reads at start"))) == 90
    assert one(spark, T.tokens(F.lit("é" * 19))) == 10
    assert one(spark, T.classify_message(F.lit("We decided to migrate and never look back"))["kind"]) == "decision"
    assert one(spark, T.content_hash(F.lit("a"))) == 0xE40C292C
    assert one(spark, T.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 1.0
    assert one(spark, S.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0
    assert one(spark, S.retention_class(F.lit("?"), F.lit("You must never do it"))) == "durable"
    assert one(spark, T.compress(F.lit("Let me first check it\nC:\\Users\\me\\x is full"))) == "~\\x is full"
    assert one(spark, T.query_terms(F.lit("ab 東京都 ab"))) == ["ab", "東京", "京都"]
    assert filters.duration_seconds("2h") == 7200 and filters.duration_seconds("soon") == 3600


def test_contradictions(spark):
    tok = lambda s: T.token_set(F.lit(s), "lower2")
    near = "we always use tabs in this code base here"
    assert one(spark, jobs.contradiction(tok(near), tok(near.replace("always", "never")), F.lit(0.7)))
    assert not one(spark, jobs.contradiction(tok(near), tok(near), F.lit(1.0)))


def test_markdown_and_jsonl(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\ntitle: 'One'\ntags: x\n---\n# Head\n\n## Notes\nbody here\n## End\n")
    (tmp_path / "b.md").write_text("no matter\n")
    got = {r["body"][:2]: r["fields"] for r in corpus.load_markdown(spark, str(tmp_path)).collect()}
    assert got["# "] == {"title": "One", "tags": "x"} and got["no"] == {}
    md = corpus.load_markdown(spark, str(tmp_path)).where("body like '#%'")
    assert corpus.extract_section(md, "## Notes", "body").first()["section"].strip() == "body here"
    (tmp_path / "x.jsonl").write_text('# note\n{"a": 1}\n\n// more\n{"a": 2}\n')
    assert sorted(r["a"] for r in corpus.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]


def test_plans_hold_no_cross_joins_of_rows(spark, data):
    from mnemospark.plans import registry

    for name in ("j09_keyword_candidates", "j13_jaccard_join", "j19_match_recent_query", "f04_permitted", "str06_lock_audit"):
        plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name


@pytest.mark.parametrize("seed", range(3))
def test_rate_audit_in_pieces_equals_one_fold(spark, seed):
    rng = random.Random(seed)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0.0, 0.5, 1.0, 3.0, 9.5, 10.0, 10.5, 40.0])
        rows.append((i, t, rng.choice(["a", "b", None])))
    want, kept = {}, {}
    for i, t, k in rows:
        times = [x for x in kept.get(k, []) if x > t - 10]
        want[i] = len(times) < 2
        kept[k] = [*times, t] if want[i] else times
    df = spark.createDataFrame(rows, "event_id long, t double, k string").select("event_id", "k", F.timestamp_seconds("t").cast("timestamp_ntz").alias("ts"))
    assert {r["event_id"]: r["accepted"] for r in streams.rate_audit(df, 2, 10, ["k"]).collect()} == want


def brute_share(items, most, least, cap):
    """The whole of an allocation for one context, item by item."""
    items = sorted(items, key=lambda x: (-x[2], x[0]))
    need = [min(t, most) for _, t, _ in items]
    mean = sum(p for *_, p in items) / len(items)
    given, left = [0.0] * len(items), float(cap)
    if len(items) == 1 or sum((p - mean) ** 2 for *_, p in items) / len(items) < 1e-4:
        for i, n in enumerate(need):
            given[i] = min(n, left)
            left -= given[i]
    else:
        for i, n in enumerate(need):
            given[i] = min(n, least, left)
            left -= given[i]
        while left > 1e-9 and (open_ := [i for i in range(len(items)) if need[i] - given[i] > 1e-9]):
            total = sum(max(items[i][2], 1e-9) for i in open_)
            parts = {i: min(left * max(items[i][2], 1e-9) / total, need[i] - given[i]) for i in open_}
            for i, x in parts.items():
                given[i] += x
            left -= sum(parts.values())
    return {n: round(g, 6) for (n, *_), g in zip(items, given, strict=True)}


def test_shares_equal_a_slow_form(spark):
    rng = random.Random(4)
    contexts = {c: [(f"n{i}", rng.randint(0, 900), rng.choice([0.5, 0.5, 0.9, 0.1]) if c % 3 else 0.5) for i in range(rng.randint(1, 12))] for c in range(30)}
    df = spark.createDataFrame([(c, *x) for c, items in contexts.items() for x in items], "context long, name string, tokens long, priority double")
    got = {}
    for r in jobs.allocate_budget(df, 600, 40, 1500).collect():
        got.setdefault(r["context"], {})[r["name"]] = r["share"]
    for c, items in contexts.items():
        assert got[c] == pytest.approx(brute_share(items, 600, 40, 1500), abs=1e-5)


def test_what_becomes_of_budgeted_results(spark):
    rows = [(1, "a", 0.9, 10, ["x", "y"], ["x", "q"]), (1, "b", 0.8, 10, ["x", "y"], ["x", "q"]), (1, "c", 0.7, 100, ["z"], ["x", "q"]), (1, "d", 0.6, 10, ["q", "y"], ["x", "q"]), (1, "e", 0.5, 1, ["w"], ["x", "q"]), (1, "f", 0.4, 1, ["w"], ["x", "q"]), (1, "g", 0.1, 1, ["w"], ["x", "q"])]
    df = spark.createDataFrame(rows, "query_id long, source string, relevance double, tokens long, terms array<string>, query_terms array<string>")
    got = {r["source"]: (r["reason"], r["added"], r["spent"]) for r in jobs.explain_budget(df, 24, 0.2, 5).collect()}
    assert got == {"a": ("taken", 1, 10), "b": ("alike", 0, 10), "c": ("no room", 0, 10), "d": ("taken", 1, 20), "e": ("covered", 0, 20), "f": ("late", None, None), "g": ("weak", None, None)}


def test_callers_in_buckets_see_the_same(spark):
    rows = spark.createDataFrame([(i, i % 5 if i % 7 else None, ["private", "team", "shared", None][i % 4]) for i in range(60)], "id long, owner_id long, visibility string")
    callers = spark.createDataFrame([(c,) for c in [*range(9), None, 3]], "caller long")
    few, many = (sorted((r["caller"], r["id"]) for r in filters.visible_to(rows, callers, sent, 3).collect()) for sent in (100, 2))
    assert few == many == sorted((c, i) for c in range(9) for i in range(60) if i % 7 and (i % 4 in (1, 2) or i % 5 == c))


def test_pair_agreement_equals_all_pairs(spark):
    from mnemospark.operators import evaluate

    rng = random.Random(6)
    rows = [(q, i, rng.random(), rng.random()) for q in range(6) for i in range([1, 2, 3, 17, 32, 40][q])]
    got = evaluate.proxy_agreement(spark.createDataFrame(rows, "query_id long, id long, full double, proxy double")).first()
    pairs = [(a[2] > b[2]) == (a[3] > b[3]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    assert got["pair_agreement"] == round(sum(pairs) / len(pairs), 6)
