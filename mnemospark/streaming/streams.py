"""Structured Streaming twins of batch operators, and audits of ordered requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.operators.filters import at


def stream_rollup(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Counters by hour and operation; an hour is final once the watermark has passed it."""
    w = F.window("ts", "1 hour")
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "operation").agg(F.sum("saved").alias("saved"), F.sum("served").alias("served"), F.count(F.lit(1)).alias("events")).select(
        F.date_format("w.start", "yyyy-MM-dd").alias("day"), F.hour("w.start").alias("hour"), "operation", "saved", "served", "events"
    )


def stream_dedup(served: DataFrame, keys: list[str], ttl: str = "60 seconds") -> DataFrame:
    """The first of rows with equal keys within the time to live."""
    return served.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def batch_dedup(served: DataFrame, keys: list[str], ttl_seconds: int = 60) -> DataFrame:
    """Batch twin: rows whose previous row with equal keys lies more than the time to live back.

    Rows are ordered within spans of the time to live; a span's first row meets the last time of the span
    before. So even one key's rows are spread over time.
    """
    micro = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    ttl = int(ttl_seconds * 1_000_000)
    rows = served.withColumn("__t", micro).withColumn("__span", F.floor(F.col("__t") / ttl))
    last = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys], (F.col("__span") + 1).alias("__next")).agg(F.max("__t").alias("__last"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("__span") == F.col("__next")]
    met = rows.join(last, on, "left")
    prev = F.coalesce(F.lag("__t").over(Window.partitionBy(*keys, "__span").orderBy("__t", "event_id")), "__last")
    kept = met.withColumn("__prev", prev).where(F.col("__prev").isNull() | (F.col("__t") - F.col("__prev") > ttl))
    return kept.select(served.columns)


def rate_audit(requests: DataFrame, limit: int, window_seconds: float, keys: list[str]) -> DataFrame:
    """Accepted or denied for requests (event_id, ts, keys): at most ``limit`` accepted in the window before; denied ones don't count.

    A request that comes a whole window or more after the one before it starts afresh, so a key's requests are cut into pieces at such gaps and pieces are folded in
    time order apart from each other, in Arrow batches that carry only the last ``limit`` accepted times from one to the next. Gaps of
    a window lie between spans of a window: only the spans' first and last times are ordered per key, not the requests.
    """
    cols = [*keys, "piece", "t", "event_id"]
    sec = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")) / 1e6
    rows = requests.select(*keys, sec.alias("t"), "event_id").withColumn("span", F.floor(F.col("t") / window_seconds))
    spans = rows.groupBy(*keys, "span").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by = Window.partitionBy(*keys).orderBy("span")
    spans = spans.withColumn("new", F.coalesce((F.col("lo") - window_seconds >= F.lag("hi").over(by)).cast("int"), F.lit(1)))
    spans = spans.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("span").alias("__span"), F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("piece"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("span") == F.col("__span")]
    pieces = rows.join(spans, on).select(*cols)
    ordered = pieces.repartition(*[F.col(k) for k in keys], "piece").sortWithinPartitions(*cols)
    schema = ", ".join([*(f"{k} {dict(requests.dtypes)[k]}" for k in keys), "event_id long, accepted boolean"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, times = None, []
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(getattr(row, k) for k in keys)
                if (*key, row.piece) != current:
                    current, times = (*key, row.piece), []
                times = [t for t in times if t > row.t - window_seconds]
                ok = len(times) < limit
                if ok:
                    times.append(row.t)
                out.append((*key, row.event_id, ok))
            yield pd.DataFrame(out, columns=[*keys, "event_id", "accepted"])

    return ordered.mapInPandas(fold, schema)


def load_count(requests: DataFrame, keys: list[str], window_seconds: int) -> DataFrame:
    """Requests of the same keys in the seconds before each, itself included.

    Rows are counted within spans of the window; each is in its own span and, for the window's reach, in the next.
    """
    sec = S.seconds_between(F.col("ts"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    rows = requests.withColumn("__t", sec).withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    rows = rows.withColumn("__span", F.floor(F.col("__t") / window_seconds) + F.when(F.col("__own"), 0).otherwise(1))
    w = Window.partitionBy(*keys, "__span").orderBy("__t").rangeBetween(-window_seconds, 0)
    return rows.withColumn("load", F.count(F.lit(1)).over(w)).where("__own").drop("__t", "__own", "__span")


def sessions(heartbeats: DataFrame, as_of: str, gap_seconds: int = 7200, active_seconds: int = 75) -> DataFrame:
    """Sessions per agent, parted by gaps: start and end as seconds, heartbeats, and whether still active."""
    by = Window.partitionBy("agent").orderBy("ts", "event_id")
    sec = S.seconds_between(F.col("ts"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    marked = heartbeats.withColumn("t", sec).withColumn("new", F.coalesce((F.col("t") - F.lag("t").over(by) > gap_seconds).cast("int"), F.lit(1)))
    numbered = marked.withColumn("session", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    now = S.seconds_between(at(as_of), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    return numbered.groupBy("agent", "session").agg(F.min("t").alias("started"), F.max("t").alias("ended"), F.count(F.lit(1)).alias("beats")).withColumn("active", now - F.col("ended") < active_seconds)


def stream_sessions(heartbeats: DataFrame, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    return heartbeats.withWatermark("ts", late).groupBy("agent", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("beats")).select("agent", F.col("w.start").alias("started"), "beats")


def lock_audit(locks: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Pairs of holds of one path (lock_id, path, agent, start, ends) by different agents that overlap in time.

    Holds meet in the time buckets they touch; a pair counts in the first bucket both touch.
    """
    b = locks.select("*", F.explode(F.sequence(F.floor(F.col("start") / bucket_seconds), F.floor((F.col("ends") - 1) / bucket_seconds))).alias("bucket"))
    x, y = (b.select(*[F.col(c).alias(f"{c}{k}") for c in ("lock_id", "agent", "start", "ends")], "path", "bucket") for k in (1, 2))
    j = x.join(y, ["path", "bucket"]).where("lock_id1 < lock_id2 and agent1 <> agent2 and start1 < ends2 and start2 < ends1")
    return j.where(F.col("bucket") == F.floor(F.greatest("start1", "start2") / bucket_seconds)).select("path", F.col("lock_id1").alias("a"), F.col("lock_id2").alias("b"), (F.least("ends1", "ends2") - F.greatest("start1", "start2")).alias("overlap"))


def task_durations(transitions: DataFrame) -> DataFrame:
    """Per task (task, state, t): seconds from pending to claimed and from claimed to the end, and the last state."""
    first = lambda s: F.min(F.when(F.col("state") == s, F.col("t")))
    g = transitions.groupBy("task").agg(first("pending").alias("p"), first("claimed").alias("c"), F.min(F.when(F.col("state").isin("completed", "abandoned"), F.col("t"))).alias("e"), F.max_by("state", F.struct("t", "state")).alias("last"))
    return g.select("task", (F.col("c") - F.col("p")).alias("waited"), (F.col("e") - F.col("c")).alias("worked"), "last")


def merge_sink(path: str, keys: list[str], counters: list[str]):
    """A foreachBatch function that keeps one additive table: each batch writes its sums to its own folder, replays overwrite it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters]).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def read_merged(spark, path: str, keys: list[str], counters: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def stream_pairs(baskets: DataFrame, path: str, checkpoint: str, most: int = 10):
    """Start an additive pair count over a stream of baskets (items); read it by ``read_merged`` with keys a and b."""
    items = baskets.select(F.slice(F.array_sort(F.array_distinct("items")), 1, most).alias("i"))
    pairs = F.flatten(F.transform("i", lambda a: F.transform(F.filter("i", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    rows = items.select(F.explode(pairs).alias("p")).select("p.a", "p.b", F.lit(1).cast("long").alias("n"))
    return rows.writeStream.foreachBatch(merge_sink(path, ["a", "b"], ["n"])).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unread_sink(acks: DataFrame, out: str, checkpoint: str, latest: int = 200, agents_per_bucket: int = 1024):
    """A foreachBatch function that gives each agent the feed rows (id, ts, author) it has not seen, once: the streaming twin of ``joins.unread``.

    The cursors (agent, at: ts and id) are a table that each micro-batch reads from the folder of the one before and writes to its own, as
    it does with what it gives; replays overwrite both. The first ones are those of ``acks`` (agent, ack_id, ack_ts). An agent whose ack_ts is null has lost its
    row: its first batch gives the ``latest`` newest rows of others, later ones all. As with any cursor, a row that arrives after
    rows of a later time is not given. Agents meet the rows in buckets, so no agents are broadcast unless Spark finds them small.
    """
    schema = "agent string, at struct<ts: timestamp, id: bigint>"
    here = F.struct(F.col("ts").alias("ts"), F.col("id").alias("id"))
    of_others = ~F.col("author").eqNullSafe(F.col("agent"))

    def give(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch == 0:
            start = F.struct(F.col("ack_ts").alias("ts"), F.coalesce("ack_id", F.lit(0)).cast("long").alias("id"))
            acks.select(F.col("agent").cast("string"), F.when(F.col("ack_ts").isNotNull(), start).alias("at")).write.mode("overwrite").parquet(f"{checkpoint}/cursors/epoch=-1")
        cursors = spark.read.schema(schema).parquet(f"{checkpoint}/cursors/epoch={epoch - 1}")
        buckets = max(1, -(-cursors.count() // agents_per_bucket))
        bucket = F.pmod(F.xxhash64("agent"), F.lit(buckets)).cast("int").alias("__bucket")
        rows = batch.select("id", "ts", "author", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("__bucket"))
        given = rows.join(cursors.where("at is not null").select("agent", "at", bucket), "__bucket").where(of_others & (here > F.col("at"))).select("agent", "id")
        lost = cursors.where("at is null").select("agent")
        if not lost.isEmpty():  # an agent's newest rows of others are among the newest of each author
            newest = lambda by: F.row_number().over(Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("id")))
            tops = batch.select("id", "ts", "author").withColumn("__k", newest("author")).where(F.col("__k") <= latest).drop("__k")
            met = tops.crossJoin(lost).where(of_others).withColumn("__k", newest("agent")).where(F.col("__k") <= latest)
            given = given.unionByName(met.select("agent", "id"))
        given.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
        top = batch.where("ts is not null").agg(F.max(here).alias("top"))
        cursors.crossJoin(F.broadcast(top)).select("agent", F.greatest("at", "top").alias("at")).write.mode("overwrite").parquet(f"{checkpoint}/cursors/epoch={epoch}")

    return give


def run_unread(feed: DataFrame, acks: DataFrame, out: str, checkpoint: str, latest: int = 200):
    """Start ``unread_sink`` on what the feed's source holds, into Parquet files under ``out`` that hold every row (agent, id) once; returns the query."""
    return feed.writeStream.foreachBatch(unread_sink(acks, out, checkpoint, latest)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
