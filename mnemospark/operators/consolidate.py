"""Consolidated clusters kept as a versioned table: label, summary, centroid and members, upserted by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import aggregates as agg
from mnemospark.operators import windows as W
from mnemospark.operators.jobs import summarize_clusters
from mnemospark.plans.scratch import exists, materialize

CRYSTALS = "id long, label string, summary string, centroid array<double>, size long, digest string, version int"
MEMBERS = "id long, member long, version int"


def describe(entries: DataFrame, clusters: DataFrame) -> DataFrame:
    """(leader, label, summary, centroid, size, digest) of clusters (id, leader) over entries (id, text, vector).

    The digest tells whether the members are the same; centroids are rounded, so that the order of a sum does not show.
    """
    rows = entries.join(clusters, "id")
    # outer: a plain explode would have the words made a second time, to test whether there are any
    words = rows.select(F.col("leader").alias("cluster_id"), F.col("id").alias("member_id"), F.explode_outer(T.content_keywords(F.col("text"))).alias("word")).where("word is not null")
    labels = agg.cluster_labels(words).withColumnRenamed("cluster_id", "leader")
    mean = agg.centroids(rows.select(F.col("leader").alias("cluster_id"), "vector")).select(F.col("cluster_id").alias("leader"), F.transform("centroid", lambda x: F.round(x, 9)).alias("centroid"))
    sums = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64(F.lit("a"), "id")).alias("x"), F.bit_xor(F.xxhash64(F.lit("b"), "id")).alias("y"))
    said = summarize_clusters(entries.select("id", "text"), clusters).drop("size")
    digest = F.concat_ws(":", "size", "x", "y")
    return sums.select("leader", "size", digest.alias("digest")).join(said, "leader").join(mean, "leader").join(labels, "leader", "left").select("leader", F.coalesce("label", F.lit("misc")).alias("label"), "summary", "centroid", "size", "digest")


def current(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The latest row of every crystal stored under ``path``, and its members (id, member)."""
    if not exists(spark, f"{path}/crystals"):
        return spark.createDataFrame([], CRYSTALS), spark.createDataFrame([], "id long, member long")
    rows = spark.read.schema(CRYSTALS).parquet(f"{path}/crystals")
    names = [c for c in rows.columns if c not in ("id", "version")]
    latest = rows.groupBy("id").agg(F.max("version").alias("version"), F.max_by(F.struct(*names), "version").alias("x")).select("id", *[F.col(f"x.{c}") for c in names], "version")
    members = spark.read.schema(MEMBERS).parquet(f"{path}/members").join(latest.select("id", "version"), ["id", "version"]).select("id", "member")
    return latest.select([c.split()[0] for c in CRYSTALS.split(", ")]), members


def consolidate(entries: DataFrame, clusters: DataFrame, path: str) -> DataFrame:
    """Upsert the clusters into the table under ``path``; returns what is current then (id, label, summary, centroid, size, digest, version).

    A crystal is found by its label; of several clusters with one label the last, by leader, stands. A found one whose summary, centroid or members
    changed gets a new version, a label that is new the next id; nothing else is written. So a pass that is run again
    changes nothing, and one that was cut short is run again whole: members are written before crystals, which alone make a version count.
    """
    spark = entries.sparkSession
    known, _ = current(spark, path)
    known = materialize(known, "crystals-known")
    described = describe(entries, clusters)
    last = described.groupBy("label").agg(F.max_by(F.struct("leader", "summary", "centroid", "size", "digest"), "leader").alias("x"), F.min("leader").alias("first"))
    last = last.select("label", "first", "x.*")
    old = known.select("label", F.col("id").alias("old"), F.struct("summary", "centroid", "digest").alias("before"))
    met = materialize(last.join(old, "label", "left"), "crystals-met")
    changed = met.where(F.col("old").isNotNull() & (F.struct("summary", "centroid", "digest") != F.col("before")))
    ids = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"), F.coalesce(F.max("version"), F.lit(0)).alias("version")).first()
    new = W.global_rank(met.where("old is null"), "first", "label", descending=False).withColumn("old", F.lit(ids["top"]) + F.col("rank"))
    names = ["label", "leader", "summary", "centroid", "size", "digest"]
    written = changed.select(F.col("old").alias("id"), *names).unionByName(new.select(F.col("old").alias("id"), *names)).withColumn("version", F.lit(ids["version"] + 1))
    written = materialize(written, "crystals-written")
    if not written.isEmpty():
        written.select("id", "leader", "version").join(clusters.withColumnRenamed("id", "member"), "leader").select("id", "member", "version").write.mode("append").parquet(f"{path}/members")
        written.drop("leader").write.mode("append").parquet(f"{path}/crystals")
    return current(spark, path)[0]
