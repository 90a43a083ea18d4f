"""Rollups, statistics, feedback and reliability aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.operators.filters import at
from mnemospark.plans.scratch import materialize

COUNTERS = ["saved", "served", "baseline", "events", "hits", "misses"]


def rollup_hourly(events: DataFrame) -> DataFrame:
    """Additive counters by day, hour and operation; negative amounts count as nothing."""
    pos = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)), F.lit(0))
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "operation").agg(
        F.sum(F.coalesce("saved", F.lit(0))).alias("saved"),
        F.sum(pos("served")).alias("served"),
        F.sum(pos("baseline")).alias("baseline"),
        F.count(F.lit(1)).alias("events"),
        F.sum((pos("hits") > 0).cast("long")).alias("hits"),
        F.sum((pos("hits") == 0).cast("long")).alias("misses"),
    )


def merge_rollup(old: DataFrame, new: DataFrame, keys=("day", "hour", "operation")) -> DataFrame:
    """Counters of both tables added up by key."""
    return old.unionByName(new).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTERS])


def rollup_all(events: DataFrame, earlier: DataFrame | None = None) -> DataFrame:
    """One row: all events folded with the counters of an earlier rollup."""
    detail = rollup_hourly(events).select(COUNTERS)
    return (detail if earlier is None else detail.unionByName(earlier.select(COUNTERS))).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTERS])


def payload_counters(events: DataFrame, types: dict[str, str], keys: dict[str, list[str]], as_of: str, days: int, payload: str = "data") -> DataFrame:
    """Rows for a rollup (ts, agent, operation, saved, served, baseline, hits) from events (ts, agent, type, JSON payload) of the last ``days`` before ``as_of``.

    ``types`` names the operation of each event type that counts. Of a counter's ``keys`` the first that a payload holds as a number gives its value, else 0.
    """
    t = at(as_of)
    names = F.create_map(*[F.lit(x) for kv in types.items() for x in kv])
    value = lambda k: F.coalesce(*[F.get_json_object(payload, f"$.{x}").try_cast("double") for x in keys[k]], F.lit(0.0)).cast("long")
    rows = events.where(F.col("type").isin(*types) & (F.col("ts") > t - F.make_dt_interval(days=F.lit(days))) & (F.col("ts") <= t))
    return rows.select("ts", "agent", names[F.col("type")].alias("operation"), *[value(k).alias(k) for k in ("saved", "served", "baseline", "hits")])


def savings(rows: DataFrame, rollups: DataFrame | None = None) -> DataFrame:
    """Sums by day, agent, operation and over all, in one job; level names the grouping.

    ``rollups`` (day, operation, counters) hold what is no longer there in detail; they know no agents, so that level is of the details alone.
    """
    detail = rows.select("day", "agent", "operation", "saved", "served", "baseline", F.lit(1).cast("long").alias("events"), F.lit(True).alias("known"))
    if rollups is not None:
        detail = detail.unionByName(rollups.select("day", F.lit(None).cast("string").alias("agent"), "operation", "saved", "served", "baseline", "events", F.lit(False).alias("known")))
    sets = detail.groupingSets([["day"], ["agent"], ["operation"], []], "day", "agent", "operation")
    sums = sets.agg(*[F.sum(c).alias(c) for c in ("saved", "served", "baseline", "events")], F.max("known").alias("known"), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 3, "day").when(F.col("gid") == 5, "agent").when(F.col("gid") == 6, "operation").otherwise("all")
    named = sums.withColumn("level", level).where((F.col("level") != "agent") | F.col("known"))
    return named.select("level", F.coalesce("day", "agent", "operation").alias("name"), "saved", "served", "baseline", "events", F.round(S.ratio(100.0 * F.col("saved"), F.col("baseline")), 4).alias("percent"))


def heatmap(events: DataFrame) -> DataFrame:
    """Events by weekday (0 is Sunday) and hour."""
    return events.groupBy((F.dayofweek("ts") - 1).alias("weekday"), F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("events"))


def recall_tier(p: Column) -> Column:
    """Tier of a retrieval from its payload struct: named, cached, by mode, else by the methods that gave rows."""
    n = lambda m: F.coalesce(p["method_breakdown"][m], F.lit(0)) > 0
    k, s, h, c = n("keyword"), n("semantic"), n("hybrid"), n("crystal")
    suffix = lambda name, only: F.when(c, f"{name}_crystal").otherwise(only)
    return (
        F.when(F.coalesce(F.trim(p["tier"]), F.lit("")) != "", p["tier"])
        .when(F.coalesce(p["cached"], F.lit(False)), "cache_hit")
        .when(p["mode"] == "headlines", "headlines")
        .when(p["mode"] == "semantic", "semantic_only")
        .when(h | (k & s), suffix("hybrid", "hybrid_fusion"))
        .when(k, suffix("keyword", "keyword_only"))
        .when(s, suffix("semantic", "semantic_only"))
        .when(c, "crystal_only")
        .otherwise("unknown")
    )


PAYLOAD = (
    "mode string, tier string, budget long, baseline long, spent long, served long, saved long, hits long, results long, latency_ms long, cached boolean, "
    "method_breakdown struct<keyword: long, semantic: long, hybrid: long, crystal: long, associative: long>"
)


def recall_stats(events: DataFrame, payload: str = "data") -> DataFrame:
    """By tier: count, share of all in percent, budget, spent, saved and hits, mean latency of the known ones."""
    p = F.from_json(payload, PAYLOAD)
    rows = events.select(p.alias("p")).select(
        recall_tier(F.col("p")).alias("tier"),
        F.greatest(F.coalesce("p.budget", "p.baseline", F.lit(0)), F.lit(0)).alias("budget"),
        F.greatest(F.coalesce("p.spent", "p.served", F.lit(0)), F.lit(0)).alias("spent"),
        F.coalesce("p.saved", F.lit(0)).alias("saved"),
        F.greatest(F.coalesce("p.hits", "p.results", F.lit(0)), F.lit(0)).alias("hits"),
        F.when(F.col("p.latency_ms") >= 0, F.col("p.latency_ms")).alias("latency"),
    )
    by = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("budget", "spent", "saved", "hits")], F.avg("latency").alias("avg_latency"))
    return by.withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4)).withColumn("avg_latency", F.round("avg_latency", 6))


def gate(metrics: DataFrame, limits: DataFrame) -> DataFrame:
    """Metrics that miss their limit: limits has metric, direction (min or max) and limit; missing metrics fail."""
    m = limits.join(metrics, "metric", "left")
    bad = F.col("value").isNull() | F.when(F.col("direction") == "min", F.col("value") < F.col("limit")).otherwise(F.col("value") > F.col("limit"))
    return m.where(bad).select("metric", "value", "limit", "direction")


def comparison_gate(stats: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """One-row statistics against limits (column -> (min or max, limit)): blockers and ready."""
    names = [F.when(F.coalesce(F.col(c) < x if kind == "min" else F.col(c) > x, F.lit(True)), c) for c, (kind, x) in sorted(limits.items())]
    return stats.withColumn("blockers", F.array_compact(F.array(*names))).withColumn("ready", F.size("blockers") == 0)


def feedback_boost(feedback: DataFrame, as_of: str, half_life: float = 30.0, weight: Column | None = None) -> DataFrame:
    """Per source: sum of signal, weight and age decay, kept within -0.2 and 0.3."""
    days = F.greatest(S.seconds_between(at(as_of), F.col("created_at")) / 86400.0, F.lit(0.0))
    w = F.lit(1.0) if weight is None else weight
    return feedback.groupBy("result_source").agg(S.clamp(F.sum(F.col("signal") * w * F.pow(F.lit(2.0), -days / half_life)), -0.2, 0.3).alias("boost"))


def similarity_weight(cosine: Column) -> Column:
    """Weight of feedback by the likeness of its query: 0.6 where no vector is stored."""
    return F.when(cosine.isNull(), F.lit(0.6)).otherwise(0.2 + 0.8 * cosine)


def feedback_stats(feedback: DataFrame) -> DataFrame:
    s = F.col("signal")
    return feedback.agg(F.count(F.lit(1)).alias("total"), F.sum((s > 0).cast("long")).alias("positive"), F.sum((s < 0).cast("long")).alias("negative"), F.countDistinct("result_source").alias("sources"))


def top_signals(feedback: DataFrame, as_of: str, days: int = 30, n: int = 10) -> DataFrame:
    """Sources with the largest net signal of the last days."""
    recent = feedback.where(F.col("created_at") >= at(as_of) - F.make_dt_interval(days=F.lit(days)))
    return recent.groupBy("result_source").agg(F.sum("signal").alias("net"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("net"), "result_source").limit(n)


def agent_reliability(outcomes: DataFrame, as_of: str, half_life: float = 21.0) -> DataFrame:
    """Overall, by agent and by task class: decayed mean of 0.6 outcome + 0.4 quality, counts and null-aware means."""
    days = F.greatest(S.seconds_between(at(as_of), F.col("created_at")) / 86400.0, F.lit(0.0))
    rows = outcomes.withColumn("w", F.exp(-F.log(F.lit(2.0)) / half_life * days)).withColumn("b", S.clamp(0.6 * F.col("outcome_score") + 0.4 * F.col("quality_score"), 0.0, 1.0))
    count = lambda x: F.sum((F.col("outcome") == x).cast("long")).alias(x)
    mean = lambda c: F.avg(F.greatest(F.col(c), F.lit(0))).alias(f"avg_{c}")
    out = rows.groupingSets([[], ["agent"], ["task_class"]], "agent", "task_class").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("b") * F.col("w")).alias("bw"), F.sum("w").alias("sw"), count("success"), count("partial"), count("failure"), mean("latency_ms"), mean("retries")
    )
    return out.select(
        F.coalesce("agent", "task_class", F.lit("all")).alias("name"), "n", F.round(S.clamp(S.ratio(F.col("bw"), F.col("sw")), 0.0, 1.0), 6).alias("reliability"),
        "success", "partial", "failure", F.round("avg_latency_ms", 6).alias("avg_latency_ms"), F.round("avg_retries", 6).alias("avg_retries"),
    )


def top_sources(outcomes: DataFrame, n: int = 10) -> DataFrame:
    """Sources most often named in the JSON array column memory_sources."""
    names = outcomes.select(F.explode(F.from_json("memory_sources", "array<string>")).alias("source"))
    return names.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(n)


def compact_feedback(feedback: DataFrame, as_of: str, days: int) -> DataFrame:
    """Old rows of a source that has several become one row with their net signal."""
    old = F.col("created_at") < at(as_of) - F.make_dt_interval(days=F.lit(days))
    sums = feedback.where(old).groupBy("result_source").agg(F.count(F.lit(1)).alias("merged"), F.sum("signal").alias("signal"), F.min("id").alias("id"))
    return feedback.where(~F.coalesce(old, F.lit(False))).select("id", "result_source", "signal", F.lit(1).cast("long").alias("merged")).unionByName(sums.select("id", "result_source", "signal", "merged"))


def recommend_k(outcomes: DataFrame, as_of: str, base_k: int, rows: int = 40, days: int = 30, least: int = 8) -> DataFrame:
    """Depth per agent and task class from the latest outcomes; none below ``least`` samples."""
    w = Window.partitionBy("agent", "task_class").orderBy(F.desc("created_at"), F.desc("id"))
    recent = outcomes.where(F.col("created_at") >= at(as_of) - F.make_dt_interval(days=F.lit(days))).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= rows)
    rate = lambda x: F.avg((F.col("outcome") == x).cast("double"))
    s = recent.groupBy("agent", "task_class").agg(F.count(F.lit(1)).alias("samples"), rate("failure").alias("failure"), rate("partial").alias("partial"), rate("success").alias("success"), F.avg(S.clamp(F.col("quality_score"), 0.0, 1.0)).alias("quality"))
    raised, lowered = (F.col("failure") >= 0.3) | (F.col("partial") >= 0.45), (F.col("success") >= 0.75) & (F.col("quality") >= 0.82)
    return s.where(F.col("samples") >= least).select(
        "agent", "task_class", "samples",
        F.when(raised, min(base_k + 4, 24)).when(lowered, max(base_k - 2, 6)).otherwise(base_k).alias("k"),
        F.when(raised, "raise").when(lowered, "reduce").otherwise("keep").alias("reason"),
    )


def co_occurrence(baskets: DataFrame, most: int | None = None, of: DataFrame | None = None, deal: int = 16) -> DataFrame:
    """Pairs (a < b) of a basket's distinct items, with count and last time: of all its items, or of the smallest ``most`` if that is given.

    ``of`` (item) leaves the pairs that hold one of its items, all of them, which is what partners of few items need. The items of a large basket
    meet in ``deal`` parts, so no row holds its pairs and no task makes them all.
    """
    if most is not None:
        items = baskets.select(F.slice(F.array_sort(F.array_distinct("items")), 1, most).alias("i"), "seen")
        pairs = F.flatten(F.transform("i", lambda a: F.transform(F.filter("i", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        met = items.select(F.explode(pairs).alias("p"), "seen").select("p.a", "p.b", "seen")
        if of is not None:
            met = met.join(of.select(F.col("item").alias("a"), F.lit(True).alias("mine")).distinct(), "a", "left").join(of.select(F.col("item").alias("b"), F.lit(True).alias("other")).distinct(), "b", "left").where("mine or other")
    else:
        numbered = baskets.select(F.monotonically_increasing_id().alias("basket"), "seen", "items")
        items = materialize(numbered.select("basket", "seen", F.explode(F.array_distinct("items")).alias("item")).where("item is not null"), "basket-items")
        if of is None:
            items = items.withColumn("wanted", F.lit(True))
        else:
            items = items.join(of.select("item", F.lit(True).alias("wanted")).distinct(), "item", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))
        mine = items.where("wanted").select("basket", F.col("item").alias("x"), "seen", F.pmod(F.xxhash64("item"), F.lit(deal)).cast("int").alias("part"))
        other = items.select("basket", F.col("item").alias("y"), "wanted", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))).alias("part"))
        met = mine.join(other, ["basket", "part"]).where("x < y or x > y and not wanted").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "seen")
    return met.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("seen").alias("last_seen"))


def prune_singletons(edges: DataFrame, least: int = 2) -> DataFrame:
    return edges.where(F.col("n") >= least)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pressure(counts: DataFrame, soft: int, hard: int) -> DataFrame:
    return counts.withColumn("pressure", F.when(F.col("n") >= hard, "hard").when(F.col("n") >= soft, "soft").otherwise("normal"))


def centroids(members: DataFrame) -> DataFrame:
    """(cluster_id, centroid): mean vector of each cluster, scaled to length 1; the zero vector stays."""
    mean = members.select("cluster_id", F.posexplode("vector").alias("i", "x")).groupBy("cluster_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    whole = mean.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
    n = S.norm(F.col("v"))
    return whole.select("cluster_id", F.when(n > 0, F.transform("v", lambda x: x / n)).otherwise(F.col("v")).alias("centroid"))


def cluster_labels(words: DataFrame, share: float = 0.4, n: int = 4) -> DataFrame:
    """(cluster_id, label) from (cluster_id, member_id, word): frequent words of many members, joined by '-'."""
    # words are counted per member once; both counts of members read that table, so texts are split once
    per = materialize(words.groupBy("cluster_id", "member_id", "word").agg(F.count(F.lit(1)).alias("n")), "label-words")
    sizes = per.select("cluster_id", "member_id").distinct().groupBy("cluster_id").agg(F.count("member_id").alias("size"))
    freq = per.groupBy("cluster_id", "word").agg(F.sum("n").alias("tf"), F.count("member_id").alias("df")).join(sizes, "cluster_id")
    score = F.round(F.col("tf") * F.greatest(F.log(F.col("size") / F.col("df")), F.lit(0.1)), 9)
    top = freq.where(F.col("df") >= share * F.col("size")).withColumn("rn", F.row_number().over(Window.partitionBy("cluster_id").orderBy(score.desc(), "word"))).where(F.col("rn") <= n)
    named = top.groupBy("cluster_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda s: s["word"]), "-").alias("label"))
    return sizes.join(named, "cluster_id", "left").select("cluster_id", F.coalesce("label", F.lit("misc")).alias("label"))


def baseline_tokens(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.agg(F.ceil(F.sum(F.octet_length(text)) / F.lit(3.8)).cast("long").alias("tokens"))


def throughput(daily: DataFrame, days: int, as_of_day: str) -> DataFrame:
    """Mean saved per day over the trailing days, divided by the days that have any history if they are fewer."""
    end = F.lit(as_of_day).cast("date")
    d = F.col("day").cast("date")
    win = daily.where((d <= end) & (d > F.date_sub(end, days)))
    span = F.least(F.lit(days), F.datediff(end, F.min(d)) + 1)
    return win.agg(F.sum("saved").alias("saved"), span.alias("days")).withColumn("per_day", F.round(S.ratio(F.col("saved"), F.col("days")), 6))


def activity_since(events: DataFrame, anchors: DataFrame, skip=("error",)) -> DataFrame:
    """Events per agent and kind after the agent's anchor (all, if it has none), without the skipped kinds."""
    e = events.where(~F.col("event_type").isin(*skip)).join(anchors, "agent", "left")
    return e.where(F.col("anchor").isNull() | (F.col("ts") > F.col("anchor"))).groupBy("agent", "event_type").agg(F.count(F.lit(1)).alias("n"))


def event_mix(events: DataFrame, n: int) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_type").limit(n)


def canonical_agents(names: DataFrame) -> DataFrame:
    """One spelling per name whatever its case: the first that carries a model in brackets, else the first."""
    key = F.lower(F.trim(F.substring_index("name", "(", 1)))
    return names.where(F.trim("name") != "").groupBy(key.alias("key")).agg(F.min_by("name", F.struct((~F.col("name").contains("(")).alias("plain"), "name")).alias("name"))


def digest(events: DataFrame, as_of_day: str, n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(totals, top): all and the day's counts and savings in one pass, and the day's busiest agents."""
    today = F.date_format("ts", "yyyy-MM-dd") == as_of_day
    totals = events.agg(F.count(F.lit(1)).alias("total"), F.sum(today.cast("long")).alias("today"), F.sum((today & (F.col("operation") == "boot")).cast("long")).alias("boots"), F.sum(F.when(today, F.col("saved")).otherwise(0)).alias("saved_today"), F.sum("saved").alias("saved"))
    top = events.where(today).groupBy("agent").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "agent").limit(n)
    return totals, top


def daily_report(tables: dict[str, DataFrame], recalled: dict[str, DataFrame], events: DataFrame, as_of_day: str, n: int = 5) -> DataFrame:
    """(section, name, total, today): rows of each table (created_at) and those of the day; ``recalled``: of each table (id, source, retrievals)
    the ``n`` most retrieved; boots: per agent of the day; savings: saved, served and baseline of events (ts, operation, agent), all and the day's.
    """
    today = lambda c: F.date_format(c, "yyyy-MM-dd") == as_of_day
    parts = [df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(today("created_at").cast("long")), F.lit(0)).alias("today")).select(F.lit("counts").alias("section"), F.lit(name).alias("name"), "total", "today") for name, df in tables.items()]
    for name, df in recalled.items():
        top = df.where("retrievals > 0").orderBy(F.desc("retrievals"), "id").limit(n)
        parts.append(top.select(F.lit(f"recalled {name}").alias("section"), F.col("source").alias("name"), F.col("retrievals").cast("long").alias("total"), F.lit(None).cast("long").alias("today")))
    boots = events.where(today("ts") & (F.col("operation") == "boot")).groupBy("agent").agg(F.count(F.lit(1)).alias("today"))
    parts.append(boots.select(F.lit("boots").alias("section"), F.col("agent").alias("name"), F.lit(None).cast("long").alias("total"), "today"))
    names = ("saved", "served", "baseline")
    sums = events.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in names], *[F.coalesce(F.sum(F.when(today("ts"), F.col(c))), F.lit(0)).cast("long").alias(f"{c}_today") for c in names])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("total"), F.col(f"{c}_today").alias("today")) for c in names])).alias("x")
    parts.append(sums.select(pairs).select(F.lit("savings").alias("section"), "x.name", "x.total", "x.today"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def eval_snapshot(outcomes: DataFrame) -> DataFrame:
    """Baseline and assisted tasks side by side: success rate, median latency and mean retries, and their deltas."""
    by = outcomes.groupBy().pivot("task_class", ["baseline", "assisted"]).agg(F.avg((F.col("outcome") == "success").cast("double")).alias("success"), F.percentile("latency_ms", 0.5).alias("median_latency"), F.avg("retries").alias("retries"))
    names = ["success", "median_latency", "retries"]
    cols = [F.round(f"{k}_{m}", 6).alias(f"{k}_{m}") for k in ("baseline", "assisted") for m in names]
    return by.select(*cols, *[F.round(F.col(f"assisted_{m}") - F.col(f"baseline_{m}"), 6).alias(f"delta_{m}") for m in names])


def eval_signals(memories: DataFrame, decisions: DataFrame, events: DataFrame, as_of: str, days: int) -> DataFrame:
    """One row: active memories and decisions, open conflicts, and the rates of the last ``days`` (1 to 180) before ``as_of``.

    Entries: status, score, pinned, retrievals, last_accessed, expires_at, trust_score; decisions also disputes. events: kind (decision_conflict, decision_resolve, recall_query,
    consensus), ts, promoted, failed. conflict_burden: open conflicts by active decisions; decay_burden: active rows below one half that are not
    pinned; resolution_velocity: resolutions a day; contradiction_rate: conflicts by recalls; hits are active rows retrieved in the window: stale_hit_rate of memories that
    are weak or expired, low_trust_hit_rate of all; consensus_precision: promoted by promoted and failed. Rates of nothing are 0.
    """
    days = max(1, min(180, days))
    t = at(as_of)
    since = t - F.make_dt_interval(days=F.lit(days))
    count = lambda x: F.coalesce(F.sum(F.coalesce(x, F.lit(False)).cast("long")), F.lit(0))
    active = F.col("status") == "active"
    hit = active & (F.col("retrievals") > 0) & (F.col("last_accessed") >= since)
    weak = F.col("score") < 0.5
    both = [count(active).alias("active"), count(active & weak & ~F.col("pinned")).alias("decayed"), count(hit).alias("hits"), count(hit & (F.col("trust_score") < 0.5)).alias("low")]
    m = memories.agg(*both, count(hit & (weak | (F.col("expires_at") <= t))).alias("stale")).select(*[F.col(c).alias(f"m_{c}") for c in ("active", "decayed", "hits", "low", "stale")])
    d = decisions.agg(*both, count((F.col("status") == "disputed") & F.col("disputes").isNotNull()).alias("open")).select(*[F.col(c).alias(f"d_{c}") for c in ("active", "decayed", "hits", "low", "open")])
    kind = lambda k: F.col("kind") == k
    e = events.where(F.col("ts") >= since).agg(*[count(kind(k)).alias(n) for k, n in (("decision_conflict", "conflicts"), ("decision_resolve", "resolved"), ("recall_query", "recalls"))], *[F.coalesce(F.sum(F.when(kind("consensus"), F.col(c))), F.lit(0)).alias(c) for c in ("promoted", "failed")])
    rate = lambda a, b: F.round(S.ratio(a, b), 6)
    c = F.col
    return m.crossJoin(d).crossJoin(e).select(
        c("m_active").alias("active_memories"),
        c("d_active").alias("active_decisions"),
        c("d_open").alias("open_conflicts"),
        rate(c("d_open"), c("d_active")).alias("conflict_burden"),
        rate(c("m_decayed") + c("d_decayed"), c("m_active") + c("d_active")).alias("decay_burden"),
        F.round(c("resolved") / F.lit(float(days)), 6).alias("resolution_velocity"),
        rate(c("conflicts"), c("recalls")).alias("contradiction_rate"),
        rate(c("m_stale"), c("m_hits")).alias("stale_hit_rate"),
        rate(c("m_low") + c("d_low"), c("m_hits") + c("d_hits")).alias("low_trust_hit_rate"),
        rate(c("promoted"), c("promoted") + c("failed")).alias("consensus_precision"),
    )
