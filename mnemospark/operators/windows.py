"""Rankings, caps, fusion, trends and other ordered operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.operators.filters import at


def rank_within(df: DataFrame, keys: list[str], order: list[Column], out: str = "rank") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rrf(lists: DataFrame, weights: dict[str, float], k: float = 60.0) -> DataFrame:
    """Weighted reciprocal-rank fusion of rows (query_id, list, id, score); lists of weight 0 are left out."""
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    ranked = rank_within(lists, ["query_id", "list"], [S.finite(F.col("score")).desc(), F.col("id")])
    part = F.greatest(F.coalesce(F.try_element_at(w, F.col("list")), F.lit(1.0)), F.lit(0.0))
    fused = ranked.withColumn("part", part).where("part > 0").groupBy("query_id", "id").agg(F.sum(F.col("part") / (k + F.col("rank"))).alias("rrf"))
    return fused


def top_k(df: DataFrame, k: int, keys=("query_id",), score: str = "relevance", tie: str = "source") -> DataFrame:
    """Per query the k rows of the highest score, ties by ``tie``; non-finite scores last."""
    return rank_within(df, list(keys), [S.finite(F.col(score)).desc(), F.col(tie)]).where(F.col("rank") <= k)


def keyword_confident(candidates: DataFrame, top: float = 0.78, gap: float = 0.10, share: float = 0.6) -> DataFrame:
    """Queries whose best keyword hit is so clear that no vectors are needed: (query_id, confident)."""
    two = top_k(candidates, 2)
    first, second = F.max(F.when(F.col("rank") == 1, F.struct("relevance", "matched", "terms"))), F.max(F.when(F.col("rank") == 2, F.col("relevance")))
    g = two.groupBy("query_id").agg(first.alias("f"), second.alias("s"))
    sure = (F.col("f.relevance") >= top) & (F.col("f.relevance") - F.coalesce("s", F.lit(0.0)) >= gap) & (F.col("f.matched") >= F.ceil(share * F.col("f.terms")))
    return g.select("query_id", sure.alias("confident"))


def best_per_source(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("query_id", "source").agg(F.max("relevance").alias("relevance"))


def keep_latest(df: DataFrame, keys: list[str], order: list[Column], n: int | None = None, caps: DataFrame | None = None) -> DataFrame:
    """The latest rows of each key: ``n``, or what ``caps`` (keys, cap) says; keys without a cap stay whole."""
    ranked = rank_within(df, keys, order, "__rank")
    if caps is not None:
        ranked = ranked.join(caps, keys, "left").where(F.col("cap").isNull() | (F.col("__rank") <= F.col("cap"))).drop("cap")
    else:
        ranked = ranked.where(F.col("__rank") <= n)
    return ranked.drop("__rank")


def global_rank(df: DataFrame, order: str, tie: str, parts: int = 64, descending: bool = True) -> DataFrame:
    """Add rank from 1 over all rows without one window for all: rows are dealt by ranges of ``order``.

    Range bounds are approximate quantiles; rows are counted per range, the counts are added up, and
    only within a range are rows ordered. ``order`` must be a number.
    """
    cuts = [i / parts for i in range(1, parts)]
    bounds = df.agg(F.percentile_approx(order, cuts, 10_000).alias("b"))
    dealt = df.crossJoin(F.broadcast(bounds)).withColumn("__range", F.coalesce(F.size(F.filter("b", lambda e: e <= F.col(order))), F.lit(0))).drop("b")
    sign = F.col("__range") * (-1 if descending else 1)
    counts = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    below = F.coalesce(F.sum("__n").over(Window.orderBy(sign).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__below", below).drop("__n")  # one row for each range
    by = F.col(order).desc() if descending else F.col(order).asc()
    inner = F.row_number().over(Window.partitionBy("__range").orderBy(by, tie))
    return dealt.join(F.broadcast(counts), "__range").withColumn("rank", F.col("__below") + inner).drop("__range", "__below")


def trim_overflow(events: DataFrame, keep: int, protected: list[str], order: str = "event_id") -> DataFrame:
    """All protected kinds, and of the others the newest that the quota, less the protected rows, leaves room for."""
    safe = events.where(F.col("event_type").isin(*protected))
    room = safe.agg(F.greatest(F.lit(0), F.lit(keep) - F.count(F.lit(1))).alias("room"))
    rest = global_rank(events.where(~F.col("event_type").isin(*protected)), order, order).crossJoin(F.broadcast(room)).where("rank <= room")
    return safe.unionByName(rest.select(events.columns))


def oldest_batch(df: DataFrame, n: int, order: str = "event_id") -> tuple[DataFrame, DataFrame]:
    """(batch, rest): the n oldest rows, and all others."""
    batch = df.orderBy(order).limit(n)
    return batch, df.join(batch.select(order), order, "left_anti")


def cumulative(daily: DataFrame, value: str = "saved") -> DataFrame:
    """Running total over days; one row a day comes in."""
    return daily.withColumn("total", F.sum(value).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def hit_trend(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.sum((F.col("hits") > 0).cast("long")).alias("hits"), F.count(F.lit(1)).alias("queries"))
    return g.withColumn("rate", F.round(S.ratio(F.col("hits"), F.col("queries")), 6))


def predict_next(history: DataFrame, last: int = 50, least: int = 3) -> DataFrame:
    """Per user and query the likeliest next query among the latest ones, seen ``least`` times or more."""
    recent = keep_latest(history, ["user_id"], [F.desc("ts"), F.desc("event_id")], last)
    step = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = recent.withColumn("next", F.lead("query").over(step)).where("next is not null and next <> query")
    counts = pairs.groupBy("user_id", "query", "next").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("latest")).where(F.col("n") >= least)
    return rank_within(counts, ["user_id", "query"], [F.desc("n"), F.desc("latest"), F.col("next")]).where("rank = 1").select("user_id", "query", "next", "n")


PRIORITY = ("critical", "high", "medium", "low")


def next_task(tasks: DataFrame) -> DataFrame:
    """The pending task each capability takes next: by priority, then age, then id."""
    level = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("priority"))
    return rank_within(tasks.where("status = 'pending'"), ["capability"], [level, F.col("created_at"), F.col("task_id")]).where("rank = 1").drop("rank")


CLASS_SCORES = {"durable": 1.0, "operational": 0.8, "audit": 0.4, "ephemeral": 0.2}


def rank_context(df: DataFrame, n: int, as_of: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Entries for a context: 0.30 class, 0.30 recency, 0.25 relevance, 0.15 activity; the best n (per key)."""
    kind = F
    for name, value in CLASS_SCORES.items():
        kind = kind.when(F.col("retention_class") == name, F.lit(value))
    hours = lambda c: F.floor(S.seconds_between(at(as_of), c) / 3600)
    activity = 0.55 * F.least(F.greatest(F.col("retrievals"), F.lit(0)) / 10.0, F.lit(1.0)) + 0.45 * S.recency_step(hours(F.col("last_accessed")))
    total = 0.30 * kind.otherwise(F.lit(0.6)) + 0.30 * S.recency_step(hours(F.coalesce("updated_at", "created_at"))) + 0.25 * S.clamp(F.col("score"), 0.0, 1.0) + 0.15 * activity
    scored = df.withColumn("total", F.round(total, 9))
    order = [F.desc("total"), F.desc("updated_at"), F.col("id")]
    return rank_within(scored, list(keys), order).where(F.col("rank") <= n) if keys else scored.orderBy(*order).limit(n)


def timeline(tables: dict[str, DataFrame], kind: str | None = None, n: int = 32) -> DataFrame:
    """The newest rows (kind, id, ts) of several tables."""
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias("kind"), F.col("id"), F.col("ts"))
        out = part if out is None else out.unionByName(part)
    return (out if kind is None else out.where(F.col("kind") == kind)).orderBy(F.desc("ts"), "kind", F.desc("id")).limit(n)


def collapse_families(results: DataFrame, families: DataFrame) -> DataFrame:
    """Results (query_id, source, relevance) with members folded under their head: best relevance and the members found."""
    joined = results.join(families.select(F.col("member").alias("source"), "head"), "source", "left").withColumn("head", F.coalesce("head", "source"))
    return joined.groupBy("query_id", F.col("head").alias("source")).agg(
        F.max("relevance").alias("relevance"),
        F.max_by("source", F.struct("relevance", "source")).alias("best"),
        F.array_sort(F.collect_set(F.when(F.col("source") != F.col("head"), F.col("source")))).alias("members"),
    )


def reinforce(df: DataFrame, hits: DataFrame) -> DataFrame:
    """Returned rows gain a retrieval and up to 0.15 of score, less the more they have been retrieved."""
    h = hits.select("id").distinct().withColumn("__hit", F.lit(True))
    j = df.join(h, "id", "left")
    gain = F.least(F.lit(1.0), F.col("score") + 0.15 / (1.0 + 0.1 * F.col("retrievals")))
    return j.withColumn("score", F.when(F.col("__hit"), gain).otherwise(F.col("score"))).withColumn("retrievals", F.col("retrievals") + F.when(F.col("__hit"), 1).otherwise(0)).drop("__hit")


def compare_rankings(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """Per query, for two rankings (query_id, source, rank): overlap, Jaccard, mean rank distance of shared rows, equal firsts."""
    x = a.where(F.col("rank") <= k).select("query_id", "source", F.col("rank").alias("ra"))
    y = b.where(F.col("rank") <= k).select("query_id", "source", F.col("rank").alias("rb"))
    j = x.join(y, ["query_id", "source"], "full")
    both = (F.col("ra").isNotNull() & F.col("rb").isNotNull()).cast("long")
    g = j.groupBy("query_id").agg(F.sum(both).alias("shared"), F.count(F.lit(1)).alias("union"), F.greatest(F.count("ra"), F.count("rb")).alias("larger"), F.avg(F.abs(F.col("ra") - F.col("rb"))).alias("delta"), F.max(((F.col("ra") == 1) & (F.col("rb") == 1)).cast("int")).alias("top"))
    return g.select("query_id", F.round(S.ratio(F.col("shared"), F.col("larger")), 6).alias("overlap"), F.round(S.ratio(F.col("shared"), F.col("union")), 6).alias("jaccard"), F.round(F.coalesce("delta", F.lit(0.0)), 6).alias("rank_delta"), (F.coalesce("top", F.lit(0)) == 1).alias("same_first"))


def fuse_rerank(results: DataFrame, scores: DataFrame, n: int, alpha: float = 0.65) -> DataFrame:
    """Rerank the first n results per query by scores (query_id, source, rerank); the rest keeps its order behind them.

    Both scores are scaled to 0..1 within the window and mixed, and mapped back to the window's span of relevance.
    """
    ranked = rank_within(results, ["query_id"], [S.finite(F.col("relevance")).desc(), F.col("source")]).join(scores, ["query_id", "source"], "left")
    w = Window.partitionBy("query_id", F.col("rank") <= n)
    unit = lambda c: S.ratio(F.col(c) - F.min(c).over(w), F.max(c).over(w) - F.min(c).over(w))
    low, high = F.min("relevance").over(w), F.max("relevance").over(w)
    mixed = (1 - alpha) * unit("relevance") + alpha * F.coalesce(unit("rerank"), F.lit(0.0))
    new = ranked.withColumn("relevance", F.when(F.col("rank") <= n, low + mixed * (high - low)).otherwise(F.col("relevance"))).withColumn("tail", F.col("rank") > n)
    return rank_within(new.drop("rank"), ["query_id"], [F.col("tail"), F.desc(F.round("relevance", 12)), F.col("source")]).drop("tail", "rerank")


def merge_calls(results: DataFrame) -> DataFrame:
    """Payloads of several calls per query: the first row of each source and excerpt, in call order."""
    key = F.left("excerpt", F.lit(240))
    return results.withColumn("__k", key).withColumn("__rn", F.row_number().over(Window.partitionBy("query_id", "source", "__k").orderBy("call", "rank"))).where("__rn = 1").drop("__k", "__rn")


def trend(daily: DataFrame) -> DataFrame:
    """Per day: mean and spread of the last seven days, and the last four against the four before in percent."""
    by = Window.orderBy("day")  # one row a day
    recent, before = F.sum("saved").over(by.rowsBetween(-3, 0)), F.sum("saved").over(by.rowsBetween(-7, -4))
    seven = by.rowsBetween(-6, 0)
    return daily.select(
        "day",
        F.round(F.avg("saved").over(seven), 6).alias("mean7"),
        (F.max("saved").over(seven) - F.min("saved").over(seven)).alias("spread7"),
        F.round(F.when(before > 0, 100.0 * (recent - before) / before), 6).alias("momentum"),
    )


def pick_rules(df: DataFrame, pattern: str, top: int = 20, n: int = 5, clip: int = 120) -> DataFrame:
    """Of the best-scored entries those whose text matches, the first n, clipped."""
    best = df.orderBy(F.desc("score"), "id").limit(top)
    return best.where(F.col("text").rlike(pattern)).orderBy(F.desc("score"), "id").limit(n).select("id", F.left("text", F.lit(clip)).alias("rule"))


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return rank_within(df, keys, order, "__rank").where("__rank = 1").drop("__rank")
