"""Retrieval quality, gates, percentiles and rater agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.operators.joins import sent
from mnemospark.plans.scratch import materialize


def quotations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, id) of passages (query_id, passage) and the documents (id, text) that hold them whole.

    A text holds all words of a passage but its first and last as words of its own, parted by single spaces: both meet on the one of them
    that is rarest in all texts, and the whole passage is sought then. Passages of two words or fewer are sought in every text. Empty and null passages are in none.
    """
    items = items.where(F.length("passage") > 0).withColumn("words", F.split("passage", " ", -1))
    met = docs.join(items.where(F.size("words") < 3).select("query_id", F.col("passage").alias("short")), F.contains("text", "short")).select("query_id", "id")
    inner = items.where(F.size("words") > 2).select("query_id", "passage", F.explode(F.slice("words", F.lit(2), F.size("words") - 2)).alias("word"))
    words = docs.select("id", F.explode_outer(F.split("text", " ", -1)).alias("word"))  # joins drop null ones
    counts = words.join(sent(inner.select("word").distinct()), "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = materialize(inner.join(counts, "word").groupBy("query_id", "passage").agg(F.min_by("word", F.struct("n", "word")).alias("word")), "passage-words")
    at = words.join(sent(rarest), "word").select("query_id", "passage", "id").distinct()
    return met.unionByName(at.join(docs, "id").where(F.contains("text", "passage")).select("query_id", "id"))


def retrieval_metrics(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Per query with gold (query_id, id): precision, reciprocal rank, hit in the first 1 and 3, coverage, tokens of all results.

    ``results`` has query_id, id, rank, tokens.
    """
    g = gold.select("query_id", "id").distinct()
    n_gold = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    r = results.join(g.withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    per = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("hits"), F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum("tokens").alias("tokens"))
    j = n_gold.join(per, "query_id", "left").fillna(0, ["n", "hits", "tokens"])
    rate = lambda k: F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))
    return j.select(
        "query_id",
        F.round(S.ratio(F.col("hits"), F.col("n")), 6).alias("precision"),
        F.round(F.coalesce(1.0 / F.col("first"), F.lit(0.0)), 6).alias("rr"),
        rate(1).alias("top1"),
        rate(3).alias("top3"),
        F.round(S.ratio(F.col("hits"), F.col("n_gold")), 6).alias("coverage"),
        "hits",
        "tokens",
    )


def summarize_metrics(per_query: DataFrame) -> DataFrame:
    names = ("precision", "rr", "top1", "top3", "coverage")
    per_hit = S.ratio(F.sum("tokens"), F.sum("hits"))
    return per_query.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in names], F.round(per_hit, 6).alias("tokens_per_hit"))


def regression_gate(current: DataFrame, base: DataFrame, tolerance: float) -> DataFrame:
    """Metrics (metric, value, higher_is_better) against a base (metric, value): relative delta and regressed; missing ones are skipped."""
    j = current.join(base.select("metric", F.col("value").alias("base")), "metric", "full")
    raw = F.col("value") - F.col("base")
    delta = F.when(F.abs("base") > 2.220446049250313e-16, raw / F.abs("base")).otherwise(raw)
    worse = F.when(F.col("higher_is_better"), delta < -tolerance).otherwise(delta > tolerance)
    status = F.when(F.col("value").isNull() | F.col("base").isNull(), "skipped").when(worse, "regressed").otherwise("ok")
    return j.select("metric", F.round(delta, 6).alias("delta"), status.alias("status"))


def effective_limits(limits: DataFrame, measured: DataFrame, slack: float = 0.05) -> DataFrame:
    """Limits drawn towards what has been measured, less a slack, never loosened; and the delta to it."""
    j = limits.join(measured, "metric", "left")
    best = F.when(F.col("direction") == "min", F.greatest("limit", F.col("value") * (1 - slack))).otherwise(F.least("limit", F.col("value") * (1 + slack)))
    return j.select("metric", "direction", F.round(F.coalesce(best, "limit"), 6).alias("limit"), F.round(F.col("value") - F.col("limit"), 6).alias("delta"), F.round(100.0 * S.ratio(F.col("value") - F.col("limit"), F.abs("limit")), 6).alias("percent"))


def token_stats(metrics: DataFrame) -> DataFrame:
    """From (query_id, tokens, budget, calls): mean, most, sum, rows over budget, tokens per call."""
    return metrics.agg(
        F.round(F.avg("tokens"), 6).alias("avg"),
        F.max("tokens").alias("max"),
        F.sum("tokens").alias("total"),
        F.sum((F.col("tokens") > F.col("budget")).cast("long")).alias("over_budget"),
        F.round(S.ratio(F.sum("tokens"), F.sum("calls")), 6).alias("per_call"),
    )


def percentiles(df: DataFrame, value: str, p: float, parts: int = 64) -> DataFrame:
    """Three definitions side by side: linear, the value at the rounded-up index, and at the rounded index.

    Distinct values are ranked by ranges whose counts are added up, so none is ranked in one place; no row, no result.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    bounds = counts.agg(F.percentile_approx("v", [i / parts for i in range(1, parts)], 10_000).alias("b"))
    dealt = counts.crossJoin(F.broadcast(bounds)).withColumn("part", F.size(F.filter("b", lambda e: e <= F.col("v")))).drop("b")  # bounds: one row
    sums = dealt.groupBy("part").agg(F.sum("c").alias("n"))  # one row a range
    sums = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), F.sum("n").over(Window.partitionBy()).alias("n"))
    inner = F.sum("c").over(Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    upto = dealt.join(F.broadcast(sums), "part").select("v", "n", (F.col("below") + inner).alias("upto"))
    first = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    place = F.lit(p) * (F.col("n") - 1)
    got = upto.groupBy("n").agg(first(F.floor(place) + 1).alias("low"), first(F.ceil(place) + 1).alias("high"), first(F.greatest(F.ceil(F.lit(p) * F.col("n")), F.lit(1))).alias("ceil_index"), first(F.floor(place + 0.5) + 1).alias("round_index"))
    return got.select((F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("linear"), "ceil_index", "round_index")


def consensus_verdict(ratings: DataFrame) -> DataFrame:
    """Per item the verdict of most raters, ambiguous in a tie, and whether all agree."""
    votes = ratings.groupBy("item_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    g = votes.groupBy("item_id").agg(F.max("n").alias("top"), F.collect_list(F.struct("n", "verdict")).alias("v"), F.count(F.lit(1)).alias("kinds"))
    best = F.filter("v", lambda x: x["n"] == F.col("top"))
    return g.select("item_id", F.when(F.size(best) == 1, F.element_at(best, 1)["verdict"]).otherwise("ambiguous").alias("consensus"), (F.col("kinds") == 1).alias("unanimous"))


def cohen_kappa(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa of every pair of raters (a < b) over the items both have rated."""
    x = ratings.select("item_id", F.col("rater").alias("a"), F.col("verdict").alias("va"))
    y = ratings.select("item_id", F.col("rater").alias("b"), F.col("verdict").alias("vb"))
    cells = x.join(y, "item_id").where("a < b").groupBy("a", "b", "va", "vb").agg(F.count(F.lit(1)).alias("n"))
    total = cells.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("va") == F.col("vb"), F.col("n")).otherwise(0)).alias("agree"))
    rows = cells.groupBy("a", "b", F.col("va").alias("v")).agg(F.sum("n").alias("r"))
    cols = cells.groupBy("a", "b", F.col("vb").alias("v")).agg(F.sum("n").alias("c"))
    chance = rows.join(cols, ["a", "b", "v"]).groupBy("a", "b").agg(F.sum(F.col("r") * F.col("c")).alias("rc"))
    j = total.join(chance, ["a", "b"], "left").select("a", "b", "n", (F.col("agree") / F.col("n")).alias("po"), F.coalesce(F.col("rc") / (F.col("n") * F.col("n")), F.lit(0.0)).alias("pe"))
    return j.select("a", "b", "n", F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("po") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa over items, each rated by the same number of raters."""
    cells = ratings.groupBy("item_id", "verdict").agg(F.count(F.lit(1)).alias("n"))
    items = cells.groupBy("item_id").agg(F.sum(F.col("n") * F.col("n")).alias("sq"), F.sum("n").alias("k"))
    p_bar = items.agg(F.avg((F.col("sq") - F.col("k")) / (F.col("k") * (F.col("k") - 1))).alias("p"))
    shares = cells.groupBy("verdict").agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("pe"))
    return p_bar.crossJoin(shares).select(F.round(F.when(F.col("pe") == 1, 1.0).otherwise((F.col("p") - F.col("pe")) / (1 - F.col("pe"))), 6).alias("kappa"))


def judge_report(ratings: DataFrame) -> DataFrame:
    """By category and by rater, and over all: rates of correct and ambiguous verdicts, mean latency."""
    rate = lambda v: F.round(F.avg((F.col("verdict") == v).cast("double")), 6).alias(v)
    return ratings.groupingSets([["category"], ["rater"], []], "category", "rater").agg(F.count(F.lit(1)).alias("n"), rate("correct"), rate("ambiguous"), F.round(F.avg("latency_ms"), 6).alias("latency"))


def wilson(df: DataFrame, hits: str, n: str, z: float = 1.96) -> DataFrame:
    """Wilson interval of hits out of n; (0, 1) without observations."""
    p, m = F.col(hits) / F.col(n), F.col(n)
    mid, spread = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    scale = 1 + z * z / m
    return df.withColumn("low", F.round(F.when(m > 0, (mid - spread) / scale).otherwise(0.0), 6)).withColumn("high", F.round(F.when(m > 0, (mid + spread) / scale).otherwise(1.0), 6))


def compare_modes(per_query: DataFrame) -> DataFrame:
    """Modes a and b of (mode, query_id, top1, latency, ids): deltas of top-1 and p95 latency, share of equal orders."""
    a, b = per_query.where("mode = 'a'"), per_query.where("mode = 'b'").select("query_id", F.col("top1").alias("t2"), F.col("latency").alias("l2"), F.col("ids").alias("i2"))
    return a.join(b, "query_id").agg(
        F.round(F.avg("t2") - F.avg("top1"), 6).alias("top1_delta"),
        F.round(F.percentile("l2", 0.95) - F.percentile("latency", 0.95), 6).alias("p95_delta"),
        F.round(F.avg((F.col("ids") == F.col("i2")).cast("double")), 6).alias("same_order"),
    )


def proxy_agreement(scored: DataFrame) -> DataFrame:
    """Two scorings (query_id, id, full, proxy): share of equal firsts, mean rank error, share of pairs in one order.

    Pairs are counted as a merge sort counts them: at each level of halving by full rank, rows of a right half count those of the
    left half before them by proxy rank. So n rows take n log n steps, and no pairs are made.
    """
    rank = lambda c: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "id"))
    r = scored.select("query_id", "id", (rank("full") - 1).alias("rf"), (rank("proxy") - 1).alias("rp"))
    sizes = r.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    shift = lambda x, by: F.call_function("shiftright", x, by)
    deep = F.length(F.bin(F.greatest(F.col("n") - 1, F.lit(1)))) - 1
    levels = r.join(sizes, "query_id").select("query_id", "rf", "rp", F.explode(F.sequence(F.lit(0), deep)).alias("level"))
    halves = levels.withColumn("node", shift(F.col("rf"), F.col("level") + 1)).withColumn("left", 1 - shift(F.col("rf"), F.col("level")).bitwiseAND(F.lit(1)))
    before = F.sum("left").over(Window.partitionBy("query_id", "level", "node").orderBy("rp").rowsBetween(Window.unboundedPreceding, 0))
    alike = halves.withColumn("before", before).agg(F.sum(F.when(F.col("left") == 0, F.col("before"))).alias("alike"))
    every = sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("every"))
    per = r.agg(F.avg(F.when(F.col("rf") == 0, (F.col("rp") == 0).cast("double"))).alias("top1"), F.avg(F.abs(F.col("rf") - F.col("rp"))).alias("error"))
    pairs = F.when(F.col("every") > 0, F.coalesce("alike", F.lit(0)) / F.col("every"))
    return per.crossJoin(alike).crossJoin(every).select(F.round("top1", 6).alias("top1"), F.round("error", 6).alias("rank_error"), F.round(pairs, 6).alias("pair_agreement"))
