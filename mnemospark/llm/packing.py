"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Texts longer than a bin are cut into full bins and a rest, so nothing is dropped. Pieces are spread
over shards of a bounded number of rows by a hash; each shard is packed on its own, longest piece
first. Open bins are kept in the order of their residual room. For a piece, the search begins at
the tightest bin that has room and goes on to the next until one without a conflict is found; if none
is, a new bin opens. A bin carries two bitmaps, over the shard's own numbering: sources that have
used up their share of the bin, and duplicate clusters it holds. Two members of a cluster never share
a bin, and a source fills at most ``max_per_source`` places of a bin.

A shard's bins are final. The room lost is at most what the few last bins of each shard leave, and a
shard holds thousands of pieces.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.mixing import words
from mnemospark.plans.scratch import materialize


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int, max_per_source: int) -> list[int]:
    """Bin number of each piece, taken in the given order; bins count from 0."""
    number: dict = {}
    source_bit = [1 << number.setdefault(s, len(number)) for s in sources]
    members: dict = {}
    for c in clusters:
        members[c] = members.get(c, 0) + 1
    # only clusters with several members here can clash
    number = {}
    cluster_bit = [1 << number.setdefault(c, len(number)) if members[c] > 1 else 0 for c in clusters]
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    full_sources: list[int] = []
    held: list[int] = []
    places: list[dict[int, int]] = []
    found = []
    for size, s, c in zip(sizes, source_bit, cluster_bit, strict=True):
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and (full_sources[open_bins[at][1]] & s or held[open_bins[at][1]] & c):
            at += 1
        if at < len(open_bins):
            room, b = open_bins.pop(at)
        else:
            room, b = capacity, len(held)
            full_sources.append(0)
            held.append(0)
            places.append({})
        held[b] |= c
        places[b][s] = places[b].get(s, 0) + 1
        if places[b][s] >= max_per_source:
            full_sources[b] |= s
        if room > size:
            insort(open_bins, (room - size, b))
        found.append(b)
    return found


def pack(
    docs: DataFrame,
    capacity: int = 2048,
    max_per_source: int = 4,
    size: Column | None = None,
    cluster: Column | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    shard_rows: int = 8192,
) -> DataFrame:
    """One row per piece: doc_id, piece (from 0), start and size (words), bin_id, source, cluster.

    ``size``: words of the text unless given. ``cluster``: duplicate cluster, by default a hash of the
    lower-case text without white space. Null and blank texts have size 0 and are one piece that
    takes no room and has no cluster. Null sources are a source of their own, null clusters never clash. Every row counts,
    repeated ones too (they are one cluster). Other columns are ignored; an empty table gives an empty result.
    """
    own = F.xxhash64(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(words(F.col(text)) if size is None else size, F.lit(0)).cast("long").alias("words"),
        F.col(source).cast("string").alias("source"),
        (own if cluster is None else cluster).cast("long").alias("cluster"),
        F.xxhash64(F.col(doc_id), F.coalesce(text, F.lit(""))).alias("tie"),
        F.monotonically_increasing_id().alias("row"),
    )
    if cluster is None:
        rows = rows.withColumn("cluster", F.when(F.col("words") > 0, F.col("cluster")))
    rows = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("words") / capacity) - 1).cast("int"))))
    rows = rows.withColumn("start", F.col("piece") * F.lit(capacity).cast("long"))
    rows = materialize(rows.withColumn("size", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("start"))), "pack-pieces")
    shards = max(1, math.ceil(rows.count() / shard_rows))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("tie", "piece", "row"), F.lit(shards)))
    # pandas would turn ids beside nulls into doubles
    rows = rows.withColumn("no_id", F.col("doc_id").isNull()).withColumn("doc_id", F.coalesce("doc_id", F.lit(0).cast("long")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "no_id", "doc_id", "piece", "tie"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        lone = [("alone", i) if pd.isna(c) else c for i, c in enumerate(part["cluster"])]
        names = [None if pd.isna(x) else x for x in part["source"]]
        bins = best_fit(part["size"].tolist(), names, lone, capacity, max_per_source)
        part["bin_id"] = int(part["shard"].iloc[0]) * (1 << 32) + np.array(bins, np.int64)
        return part[["doc_id", "no_id", "piece", "start", "size", "bin_id", "source", "cluster"]]

    packed = rows.groupBy("shard").applyInPandas(run, "doc_id long, no_id boolean, piece int, start long, size long, bin_id long, source string, cluster long")
    return packed.withColumn("doc_id", F.when(~F.col("no_id"), F.col("doc_id"))).drop("no_id")


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(docs)
