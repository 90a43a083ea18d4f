r"""Exact dedup over an extendible-hash index on shared files, with DataFrame functions only.

Texts are equal when they agree after deleting every character of ``[\x20\x09-\x0D]``.

1. Keys: every row's 64-bit hash of its normalised text goes to a narrow table, with the sizes and
   the digest that later steps need. Texts themselves are not moved.
2. Directory: the distinct keys are counted by the low bits of their slot hash. From one
   bucket it doubles; only buckets with more keys than ``capacity`` split, each to its own local
   depth, so a directory of ``2^depth`` slots points to fewer buckets.
3. Index: every row is routed by its key's slot to a bucket. Owner tasks build the buckets' entries, one per key with its
   rows counted (combined before the shuffle), and write them in key ranges to the shared folder.
4. Chains: an entry that several rows share may still stand for different texts. The rows of such entries,
   and no others, are grouped by bucket, key and normalised bytes; each distinct text is a link of the
   entry's chain.
5. Lookup: rows find their entry in their bucket by key, or by key and bytes where the chain has several links.

The row with the most code points in the original text stays, then the smallest doc_id (nulls
last). All tables beside the input are narrow; nothing is collected but the depth and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.scratch import discard, materialize

_MAX = 9223372036854775807
#: Parts code points from ids in the packed ordering; above the range of a long.
_UNIT = "100000000000000000000"


def normalise(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def hash_key(norm: Column) -> Column:
    return F.xxhash64(norm)


def _order(chars: Column, doc_id: Column) -> Column:
    """A number that is largest for the row that stays; null ids come last of equal lengths."""
    back = F.coalesce(F.lit(_MAX).cast("decimal(38,0)") - doc_id.cast("decimal(38,0)"), F.lit(-1).cast("decimal(38,0)"))
    return (chars.cast("decimal(18,0)") * F.lit(_UNIT).cast("decimal(21,0)") + back).cast("decimal(38,0)")


def _doc_id(order: Column) -> Column:
    # ids below zero make the remainder pass _MAX, up to 2^64 - 1, which _UNIT still exceeds
    rest = F.pmod(order + F.lit(1), F.lit(_UNIT).cast("decimal(38,0)"))
    return F.when(rest > 0, F.lit(_MAX).cast("decimal(38,0)") + F.lit(1) - rest).cast("long")


def _slot(key: Column, depth: int) -> Column:
    """Directory slot of a key: the low ``depth`` bits of a hash of it, so that any key function spreads."""
    return F.xxhash64(key).bitwiseAND((1 << depth) - 1)


def _low(key: Column, depth: Column) -> Column:
    """The low ``depth`` bits, 1 to 64, of the hash that names slots."""
    return F.xxhash64(key).bitwiseAND(F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), (F.lit(64) - depth).cast("int")))


def directory(keys: DataFrame, capacity: int) -> DataFrame:
    """Slots of the directory at its final depth: slot, bucket, local_depth; no bucket where a slot is overfull itself (``beyond``).

    ``keys`` has a column key, repeats allowed. Distinct keys are counted once by the slots of a depth with
    room to spare and summed for every depth above it; a slot belongs to the bucket of the smallest depth whose
    keys fit, as doubling from one bucket and splitting overfull ones gives it. A bucket's number is its
    low bits; no two buckets share one, as one would hold the other.
    """
    if capacity < 1:
        raise ValueError("a bucket must hold a key at least")
    total, deepest = keys.count(), 0
    while (capacity << deepest) < 8 * total:
        deepest += 1
    cells = keys.distinct().groupBy(_slot(F.col("key"), deepest).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = keys.sparkSession.range(1 << deepest).select(F.col("id").alias("slot")).join(cells, "slot", "left").fillna(0, ["n"])
    levels = slots.withColumn("local_depth", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    levels = levels.withColumn("bucket", F.col("slot").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), "local_depth") - 1))
    levels = materialize(levels, "directory-levels")
    fits = levels.groupBy("local_depth", "bucket").agg(F.sum("n").alias("keys")).where(F.col("keys") <= capacity)
    first = F.min(F.struct("local_depth", "bucket")).alias("at")
    found = levels.join(fits, ["local_depth", "bucket"], "left").where("keys is not null or local_depth = 0")
    at = F.min(F.when(F.col("keys").isNotNull(), F.struct("local_depth", "bucket"))).alias("at")
    slots = materialize(found.groupBy("slot").agg(at).select("slot", "at.bucket", "at.local_depth"), "directory")
    discard(levels)
    return slots


def beyond(keys: DataFrame, slots: DataFrame, depth: int, capacity: int) -> DataFrame | None:
    """Buckets (bucket, local_depth) of overfull slots, or None: there doubling goes on for the slots' own keys, up to the
    hash's 64 bits, which differ for different keys."""
    full = slots.where("bucket is null").select("slot")
    if full.isEmpty():
        return None
    over = keys.distinct().withColumn("slot", _slot(F.col("key"), depth)).join(full, "slot", "left_semi")
    deeper = over.select("key", F.explode(F.sequence(F.lit(depth + 1), F.lit(64))).alias("local_depth")).withColumn("bucket", _low(F.col("key"), F.col("local_depth")))
    deeper = materialize(deeper, "directory-deeper")
    fits = deeper.groupBy("local_depth", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= capacity).select("local_depth", "bucket")
    first = F.min(F.struct("local_depth", "bucket")).alias("at")
    return materialize(deeper.join(fits, ["local_depth", "bucket"]).groupBy("key").agg(first).select("at.bucket", "at.local_depth").distinct(), "directory-split")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = 1 << 16, key=hash_key, broadcast_keys: int = 1 << 20, row_key: Column | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars, row_key.

    Null texts count as empty; all empty and blank texts are one group. Repeated rows each count in
    group_size, and where even id and length agree one result row each is given, all kept. Rows with a
    null id are kept only if no row of their length has an id. Other columns are ignored. An empty
    table gives an empty result. ``key`` maps the normalised text to a long; any function gives the
    right result, as bytes are compared. ``capacity`` is the number of keys a bucket holds.
    """
    norm = normalise(F.col(text))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), norm.alias("norm"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"), (F.lit(None).cast("long") if row_key is None else row_key).alias("row_key"))
    narrow = materialize(rows.select("doc_id", "row_key", key(F.col("norm")).alias("key"), "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")), "exact-keys")
    slots = directory(narrow.select("key"), capacity)
    n_slots = slots.count()
    depth = n_slots.bit_length() - 1
    split = beyond(narrow.select("key"), slots, depth, capacity)

    def send(table: DataFrame, n: int) -> DataFrame:
        return F.broadcast(table) if n <= broadcast_keys else table

    def routed(keyed: DataFrame) -> DataFrame:
        """Rows with the bucket that their key's slot points to."""
        at = keyed.withColumn("slot", _slot(F.col("key"), depth)).join(send(slots.select("slot", "bucket"), n_slots), "slot").drop("slot")
        if split is None:
            return at
        # in overfull slots one of the levels beyond the directory has the row's bucket
        levels = at.where("bucket is null").withColumn("local_depth", F.explode(F.sequence(F.lit(depth + 1), F.lit(64)))).withColumn("bucket", _low(F.col("key"), F.col("local_depth")))
        return at.where("bucket is not null").unionByName(levels.join(split, ["local_depth", "bucket"]).select(at.columns))

    # owners build their buckets' entries; a text that many rows repeat sends one row per task
    order = _order(F.col("n_chars"), F.col("doc_id"))
    entries = routed(narrow).groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("best"))
    index = materialize(entries.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key"), "exact-index")
    # chains: the rows of entries with several rows, with their bytes
    shared = index.where("n > 1").select("bucket", "key")
    alike = routed(rows.withColumn("key", key(F.col("norm")))).join(send(shared, shared.count()), ["bucket", "key"], "left_semi")
    chains = alike.groupBy("bucket", "key", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("best"))
    several = chains.groupBy("bucket", "key").agg(F.count(F.lit(1)).alias("links")).where("links > 1")
    several = materialize(several.select("bucket", "key"), "exact-several")
    found = routed(narrow)
    n_several = several.count()
    if n_several:
        found = found.join(send(several, n_several), ["bucket", "key"], "left_anti")
    found = found.join(index, ["bucket", "key"]).select("doc_id", "row_key", "n_chars", "text_sha256", "n", "best")
    if n_several:  # keys with a chain of texts: their rows are looked up by the bytes
        again = routed(rows.withColumn("key", key(F.col("norm")))).join(send(several, n_several), ["bucket", "key"], "left_semi")
        links = again.groupBy("bucket", "key", "norm").agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("best"))
        by_bytes = again.join(links, ["bucket", "key", "norm"]).select("doc_id", "row_key", "n_chars", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "n", "best")
        found = found.unionByName(by_bytes)
    return found.select(
        "doc_id",
        _doc_id(F.col("best")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (order == F.col("best")).alias("kept"),
        "text_sha256",
        "n_chars",
        "row_key",
    )


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') as norm
  from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
  doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm order by chars desc, doc_id)
"""
