"""Predicates and projections over entries, events and requests."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def live(df: DataFrame, as_of: str) -> DataFrame:
    """Active rows that have not expired and are valid at ``as_of`` (from inclusive, until exclusive)."""
    t = at(as_of)
    return df.where(
        (F.col("status") == "active")
        & (F.col("expires_at").isNull() | (F.col("expires_at") > t))
        & (F.col("valid_from").isNull() | (F.col("valid_from") <= t))
        & (F.col("valid_until").isNull() | (F.col("valid_until") > t))
    )


def visible_to(df: DataFrame, callers: DataFrame, sent: int = 4096, parts: int = 64) -> DataFrame:
    """Rows each caller may see: its own, and those shared or for the team. Null callers and owners see and give nothing.

    Open rows are given to every caller, so the result is as large as both together. Up to ``sent`` callers go to all tasks; more are
    dealt into buckets of that size, which the open rows meet ``parts`` at a time.
    """
    who = callers.select("caller").where("caller is not null").distinct()
    rows = df.where("owner_id is not null")
    open_ = rows.where(F.coalesce(F.col("visibility").isin("shared", "team"), F.lit(False)))
    mine = rows.where(~F.coalesce(F.col("visibility").isin("shared", "team"), F.lit(False))).join(who, F.col("owner_id") == F.col("caller"))
    n = who.count()
    if n <= sent:
        shared = open_.crossJoin(F.broadcast(who))
    else:
        buckets = -(-n // sent)
        dealt = who.withColumn("__b", F.pmod(F.xxhash64("caller"), F.lit(buckets))).withColumn("__p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cut = open_.withColumn("__p", F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")).withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
        shared = cut.join(dealt, ["__b", "__p"]).drop("__b", "__p")
    return mine.unionByName(shared.select(*mine.columns))


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """Rows whose source, or derived key where there is none, begins with ``prefix``."""
    return df.where(F.coalesce("source", F.concat(F.lit("memory::"), F.col("id").cast("string"))).startswith(prefix))


def permitted(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests (client, scope, rank) for which some grant of the client has the scope, or '*', and rank enough."""
    g = grants.select(F.col("client").alias("g_client"), F.col("scope").alias("g_scope"), F.col("rank").alias("g_rank"))
    fits = (F.col("client") == F.col("g_client")) & ((F.col("g_scope") == "*") | (F.col("scope") == F.col("g_scope")))
    return requests.join(g, fits & (F.col("g_rank") >= F.col("rank")), "left_semi")


def exclude_prefix(events: DataFrame, prefix: str, columns: list[Column]) -> DataFrame:
    """Rows none of whose given columns begins with ``prefix``, whatever its case; nulls don't."""
    for c in columns:
        events = events.where(~F.lower(F.coalesce(c, F.lit(""))).startswith(prefix.lower()))
    return events


def display_text() -> Column:
    """Whole text of fresh entries; of others the compressed text where there is any."""
    return F.when(F.col("age_tier") == "fresh", F.col("text")).otherwise(F.coalesce(F.nullif("compressed_text", F.lit("")), "text"))


def forget(df: DataFrame, keywords: list[str], factor: float = 0.3) -> DataFrame:
    """Scores times ``factor`` in rows whose text or source holds a keyword; adds forgotten."""
    low = F.lower(F.concat_ws("\n", "text", "source"))
    hit = T.has_any(low, [k.lower() for k in keywords])
    return df.withColumn("forgotten", hit).withColumn("score", F.when(hit, F.col("score") * factor).otherwise(F.col("score")))


def admit(df: DataFrame, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """(admitted, rejected) by text quality."""
    scored = df.withColumn("quality", T.quality(F.col("text")))
    return scored.where(F.col("quality") >= least), scored.where(F.coalesce(F.col("quality") < least, F.lit(True)))


def hash_sample(df: DataFrame, columns: list[str], percent: int) -> DataFrame:
    """A fixed share of the rows by a digest of the columns' texts, parted by a zero byte; the same rows each time."""
    digest = F.md5(F.concat_ws("\0", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < percent)


def duration_seconds(text: str | None, default: int = 3600) -> int:
    """Seconds of 30m, 2h or 1d; the default for anything else."""
    m = re.fullmatch(r"\s*(\d+)\s*([mhd])\s*", text or "")
    return int(m[1]) * {"m": 60, "h": 3600, "d": 86400}[m[2]] if m else default


def since(df: DataFrame, duration: str | None, as_of: str, column: str = "ts") -> DataFrame:
    """Rows of the trailing window that ends at ``as_of``."""
    t = at(as_of)
    return df.where((F.col(column) > t - F.make_dt_interval(secs=F.lit(duration_seconds(duration)))) & (F.col(column) <= t))
