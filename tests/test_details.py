"""Detail-seeking retrieval against brute force and hand-written cases; the feed stream over restarts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from mnemospark.operators import details as D
from mnemospark.operators import evaluate as E
from mnemospark.operators import joins as J
from mnemospark.streaming import streams


@pytest.mark.parametrize("seed", range(40))
def test_best_window_equals_every_window(seed):
    rng = random.Random(seed)
    length, width = rng.randint(20, 90), rng.randint(3, 19)
    spans = []
    for _ in range(rng.randint(0, 9)):
        a = rng.randrange(length)
        spans.append((a, min(length, a + rng.randint(1, 25)), rng.randint(1, 4)))

    def score(at):
        return sum(w * (2 * (a < at + width and b > at) + (a >= at and b <= at + width)) for a, b, w in spans)

    starts = range(length - width + 1)
    assert D.best_window(length, spans, width) == max(starts, key=lambda at: (score(at), -at))


def test_clips(spark):
    patterns = [(re.compile(r"\d+"), 1)]
    text = "a" * 50 + " 1234 " + "b" * 50
    assert D.clip_text(text, patterns, 30).count("1234") == 1 and len(D.clip_text(text, patterns, 30)) <= 35
    assert D.clip_text("x" * 20, patterns, 20) == "x" * 20 and D.clip_text("x" * 20, patterns, 7) == "x" * 7
    assert D.clip_text("start " + "y" * 90 + " end", [], 21) == "start yy ... yyyy end"
    df = spark.createDataFrame([(1, None), (2, ""), (3, text)], "id long, text string")
    assert [r["clip"] for r in D.clip_detail(df, [(r"\d+", 1)], 40).orderBy("id").collect()][:2] == [None, ""]


PLACES, GENERIC = r"\b(rome|oslo|paris|city)\b", r"\bcity\b"


def siblings(spark, seeds, facts, wants=True, **kw):
    results = spark.createDataFrame(seeds, "query_id long, rank int, id string, text string")
    facts = spark.createDataFrame(facts, "id string, text string")
    queries = spark.createDataFrame([(q, ["trip", "train"], wants) for q in {s[0] for s in seeds}], "query_id long, terms array<string>, wants_place boolean")
    got = D.expand_siblings(results, facts, queries, PLACES, GENERIC, [(r"\d", 3.0)], **kw).where("added").orderBy("query_id", "rank").collect()
    return [r["id"] for r in got]


def test_siblings_at_both_ends_of_a_family(spark):
    facts = [(f"a::fact::{i}", t) for i, t in enumerate(["trip to the city", "in rome", "nothing", "none", "by train 7 in oslo", "trip end in paris"])]
    facts += [("b::fact::1", "trip train 9"), ("a", "trip train rome"), ("a::fact::x", "trip")]
    seeds = [(1, 1, "a::fact::0", facts[0][1]), (1, 2, "a::fact::5", facts[5][1])]
    # neighbours first, then the best of the family; what is no fact of the family stays out
    assert siblings(spark, seeds, facts, per_seed=0, most=6) == ["a::fact::1", "a::fact::4"]
    assert siblings(spark, seeds, facts, per_seed=0, most=1) == ["a::fact::1"]
    assert siblings(spark, seeds[1:], facts, per_seed=0, most=6) == ["a::fact::4", "a::fact::0"]
    assert siblings(spark, seeds[:1], facts, wants=False, per_seed=1, most=6) == ["a::fact::4"]
    assert siblings(spark, seeds, facts, wants=False, margin=0.0, per_seed=3, most=6) == ["a::fact::4"]
    assert siblings(spark, [(1, 1, "lone", "trip")], facts) == []


def brute_promote(rows, k):
    """A query's rows (rank, id, terms, score, question, generic, anywhere) reordered, as a list of ids."""
    rows = sorted(rows)
    fam = lambda i: re.sub(r"::fact::\d+$", "", i)
    pos = lambda i: int(m[1]) if (m := re.search(r"::fact::(\d+)$", i)) else None
    first, best = rows[0], None
    for r in rows[1:]:
        new = len(set(r[2]) - set(first[2]))
        if not new or not (r[6] or fam(r[1]) == fam(first[1])):
            continue
        near = fam(r[1]) == fam(first[1]) and None not in (pos(r[1]), pos(first[1])) and abs(pos(r[1]) - pos(first[1])) <= 1
        key = (not r[4], near, new, not r[5], r[3], -r[0])
        if best is None or key > best[0]:
            best = (key, r)
    ids = [r[1] for r in rows]
    if best:
        i = best[1][0] - 1
        to = 1 if rows[0][6] or len(rows) <= k else k - 1 if i >= k else i
        ids.insert(to, ids.pop(i))
    return ids


def test_promoted_complements_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for q in range(80):
        for rank in range(1, rng.randint(1, 9) + 1):
            rows.append((q, rank, rng.choice(["a", "a", "b"]) + f"::fact::{q * 100 + rank * rng.choice([1, 1, 3])}", rng.sample("uvwxyz", rng.randint(0, 3)), rng.randint(0, 3), rng.random() < 0.3, rng.random() < 0.3, q % 4 == 0))
    df = spark.createDataFrame(rows, "query_id long, rank int, id string, terms array<string>, score int, question boolean, generic boolean, anywhere boolean")
    got = {}
    for r in D.promote_complement(df, 4).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q in range(80):
        assert [got[q][k] for k in sorted(got[q])] == brute_promote([r[1:] for r in rows if r[0] == q], 4)


def test_query_variants(spark):
    intents = [("place", "where", ["where", "city"]), ("number", r"how many|\d", ["number"])]
    df = spark.createDataFrame([(1, "Where is b a"), (2, "b2 a1 how many"), (3, ""), (4, "abc"), (5, None)], "id int, q string")
    got = {r["id"]: r["v"] for r in df.select("id", D.query_variant(F.col("q"), intents, ["exact"]).alias("v")).collect()}
    assert got == {1: "is where city exact", 2: "a1 b2 how many number exact", 3: None, 4: None, 5: None}


def test_quotations_of_passages_of_all_lengths(spark):
    docs = [(1, "so (one two three four five six seven) ends"), (2, "prefixone two threesuffix"), (3, "one two"), (4, ""), (5, None), (6, "one  two three four five six seven"), (7, "single")]
    items = [(1, "one two three four five six seven"), (2, "one two three"), (3, "one two"), (4, "one"), (5, ""), (6, None), (7, "two three four five six seven eight"), (8, "one two three four five six"), (9, "three four")]
    got = {(r["query_id"], r["id"]) for r in E.quotations(spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(items, "query_id long, passage string")).collect()}
    assert got == {(q, i) for q, p in items for i, t in docs if p and t and p in t}


def test_unread_stream_over_restarts_equals_unread(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"2024-01-{1 + i // 40:02d} 00:00:{i % 40 // 2:02d}", f"u{rng.randrange(4)}") for i in range(160)]
    feed = spark.createDataFrame(rows, "id long, t string, author string").select("id", F.col("t").cast("timestamp").alias("ts"), "author")
    acks = spark.createDataFrame([("u0", 37), ("u1", 90), ("u2", 159), ("u9", 0), ("lost", -1)], "agent string, ack_id long")
    anchors = acks.join(feed.select(F.col("id").alias("ack_id"), F.col("ts").alias("ack_ts")), "ack_id", "left")
    path = str(tmp_path)
    for part in range(4):
        feed.where((F.col("id") >= part * 40) & (F.col("id") < part * 40 + 40)).write.mode("append").parquet(f"{path}/feed")
        stream = spark.readStream.schema(feed.schema).parquet(f"{path}/feed")
        streams.run_unread(stream, anchors, f"{path}/out", f"{path}/state", latest=7).awaitTermination()
        streams.run_unread(stream, anchors, f"{path}/out", f"{path}/state", latest=7).awaitTermination()  # nothing new: nothing again
    got = sorted((r["agent"], r["id"]) for r in spark.read.parquet(f"{path}/out").collect())
    want = [(r["agent"], r["id"]) for r in J.unread(feed, acks.where("ack_id >= 0")).collect()] + [("lost", i) for i in range(33, 160)]
    assert got == sorted(want)


def test_unread_stream_replays_to_the_same(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i // 2:02d}", [None, "u0", "u1", "u1", "u1"][i % 5]) for i in range(80)]
    feed = spark.createDataFrame(rows, "id long, t string, author string").select("id", F.col("t").cast("timestamp").alias("ts"), "author")
    acks = spark.createDataFrame([("u0", 31, "2024-01-01 00:00:15"), ("u1", None, None), ("u2", 99, None)], "agent string, ack_id long, t string").select("agent", "ack_id", F.col("t").cast("timestamp").alias("ack_ts"))
    give = streams.unread_sink(acks, f"{tmp_path}/out", f"{tmp_path}/state", latest=5)
    parts = [feed.where("id < 40"), feed.where("id >= 40 and id < 60"), feed.where("id >= 60")]
    for epoch in (0, 1, 1, 2):  # the second is replayed
        give(parts[epoch], epoch)
    got = sorted((r["agent"], r["id"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = [("u0", i) for i in range(32, 80) if rows[i][2] != "u0"]
    for agent in ("u1", "u2"):
        others = [i for i in range(80) if rows[i][2] != agent]
        want += [(agent, i) for i in [i for i in others if i < 40][-5:] + [i for i in others if i >= 40]]
    assert got == sorted(want)
    feed.write.parquet(f"{tmp_path}/feed")
    query = streams.run_unread(spark.readStream.schema(feed.schema).parquet(f"{tmp_path}/feed"), acks, f"{tmp_path}/out2", f"{tmp_path}/state2", latest=5)
    query.awaitTermination()
    assert not query.lastProgress["stateOperators"]  # rows go through no keyed state in Python
