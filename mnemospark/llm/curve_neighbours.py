"""Nearest neighbours by inner product over shifted space-filling curves.

Equal vectors are one class that carries its smallest ids, as many as a result can hold, so a vector that a third
of all rows repeat is one point. A further coordinate levels the norms (``sqrt(M^2 - |v|^2)``; 0 for queries), so that
the largest product is the smallest angle. Every curve projects these points on its own random
orthonormal axes, shifts and quantises them, and Spark orders them by their Hilbert keys in ranges
of curve and key. Counts of the ranges turn places into ranks and ranks into blocks of ``block_rows``
points. A query meets its block and the two beside it on each curve; points travel as bytes of one scaled
number a coordinate. Each window keeps a few more than are asked for, the windows of all curves
are merged, and what is left is ranked by the exact product of the original vectors.

The work is ``n_curves`` times the rows: a window is a number of points, not a share of them. Each group that a task
compares is ``group_blocks`` blocks and one more on either side, whatever the data. See the README for
recall, measured against brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.plans.scratch import materialize


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of rows of non-negative cell numbers below ``2 ** bits`` (Skilling 2004)."""
    x = cells.astype(np.int64).T.copy()
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            flip = (x[i] & q) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0]) ^ swap
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    gray, q = np.zeros_like(x[0]), top
    while q > 1:
        gray = np.where((x[-1] & q) > 0, gray ^ (q - 1), gray)
        q >>= 1
    x ^= gray
    key = np.zeros(x.shape[1], np.int64)
    for bit in range(bits - 1, -1, -1):
        for row in x:
            key = (key << 1) | ((row >> bit) & 1)
    return key


def curves(n: int, dim: int, axes: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Projection axes and shifts of ``n`` curves."""
    rng = np.random.default_rng(seed)
    return [(np.linalg.qr(rng.normal(size=(dim, min(axes, dim))))[0], rng.random(min(axes, dim))) for _ in range(n)]


def usable(vector: Column) -> Column:
    """Not null, not zero, and all components finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda v: v != 0)


def pack(v: np.ndarray) -> list[bytes]:
    """Rows as bytes: a scale (float32), then a signed byte for every coordinate."""
    scale = np.maximum(np.abs(v).max(axis=1, keepdims=True), 1e-300) / 127
    scale = scale.astype(np.float32).astype(float)
    cells = np.rint(v / np.maximum(scale, 1e-45)).clip(-127, 127).astype(np.int8)
    return [s.tobytes() + c.tobytes() for s, c in zip(scale.astype("<f4")[:, 0], cells, strict=True)]


def unpack(packed: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
    return raw[:, :4].copy().view("<f4") * raw[:, 4:].view(np.int8).astype(np.float32)


def _windows(k: int):
    """For one group of blocks: each query against the points of its block and the two beside it."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        held = part[~part["asks"]].sort_values("block", kind="stable")
        asked = part[part["asks"]].sort_values("block", kind="stable")
        out = [], [], []
        if len(held) and len(asked):
            x, ids, at = unpack(held["packed"].to_list()), held["cls"].to_numpy(), held["block"].to_numpy()
            q, q_ids, q_at = unpack(asked["packed"].to_list()), asked["cls"].to_numpy(), asked["block"].to_numpy()
            for block in np.unique(q_at):
                low, high = np.searchsorted(at, [block - 1, block + 2])
                mine = slice(*np.searchsorted(q_at, [block, block + 1]))
                near = q[mine] @ x[low:high].T
                n = min(k, high - low)
                if n:
                    first = np.argpartition(-near, n - 1, axis=1)[:, :n]
                    out[0].append(np.repeat(q_ids[mine], n))
                    out[1].append(ids[low:high][first].ravel())
                    out[2].append(np.take_along_axis(near, first, axis=1).ravel())
        cat = lambda parts, kind: np.concatenate(parts) if parts else np.array([], kind)
        return pd.DataFrame({"asker": cat(out[0], np.int64), "cls": cat(out[1], np.int64), "near": cat(out[2], np.float32).astype(float)})

    return run


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    n_curves: int = 64,
    axes: int = 4,
    bits: int = 7,
    block_rows: int = 192,
    group_blocks: int = 32,
    spare: int = 12,
    seed: int = 11,
    broadcast_rows: int = 1 << 18,
) -> DataFrame:
    """The ``k`` nearest rows found for each row that ``is_query`` marks: query_id, rank, vec_id, score.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    with a null id or of another length than most vectors have (ties: the shortest length). Repeated rows with one id are one
    candidate: the first by its components. All other columns are ignored; an empty table gives an empty result.
    Up to two blocks of different vectors are searched exactly. ``spare``: candidates of a window beyond
    ``k`` + 1, as windows are compared by rounded vectors.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = materialize(rows.groupBy("vec_id").agg(F.min("v").alias("v"), F.max("q").alias("q")), "ann-vectors")
    sizes = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim = sizes["dim"]
    rows = rows.where(F.size("v") == dim)
    points = materialize(rows.groupBy("v").agg(F.min("vec_id").alias("cls"), F.max("q").alias("asked")), "ann-points")
    named = materialize(rows.join(points.select("v", "cls"), "v").select("vec_id", "q", "cls"), "ann-classes")
    top = points.agg(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)))).first()[0]
    plan = curves(n_curves, dim + 1, axes, seed)
    bits = max(1, min(bits, 62 // min(axes, dim + 1)))

    @F.pandas_udf("packed binary, held array<long>, asked array<long>")
    def spots(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def keys(x: np.ndarray) -> np.ndarray:
            found = []
            for basis, shift in plan:
                # directions are laid on the lower half of the grid and shifted by up to the other half
                at = (np.clip((x @ basis) * math.sqrt(dim + 1) / 3.0, -1, 1) + 1) / 4 + shift / 2
                found.append(hilbert_keys(np.minimum((at * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits))
            return np.stack(found, axis=1)

        for batch in batches:
            x = np.stack(batch.to_list()) if len(batch) else np.empty((0, dim))
            norms = np.linalg.norm(x, axis=1, keepdims=True)
            held = np.hstack([x / top, np.sqrt(np.maximum(0.0, 1 - (norms / top) ** 2))])
            yield pd.DataFrame({"packed": pack(x), "held": list(keys(held)), "asked": list(keys(np.hstack([x / norms, np.zeros_like(norms)])))})

    placed = points.select("cls", "asked", spots("v").alias("at")).select("cls", "asked", "at.packed", F.col("at.held").alias("held"), F.col("at.asked").alias("asks"))
    sides = F.array(F.struct(F.lit(False).alias("asks"), F.col("held").alias("keys")), F.struct(F.lit(True).alias("asks"), F.when(F.col("asked"), F.col("asks")).alias("keys")))
    placed = placed.select("cls", "packed", F.explode(sides).alias("side")).select("cls", "packed", "side.asks", F.posexplode("side.keys").alias("curve", "key"))
    ordered = placed.repartitionByRange("curve", "key", "cls").sortWithinPartitions("curve", "key", "cls", "asks").drop("key").withColumn("place", F.monotonically_increasing_id())
    ordered = materialize(ordered, "ann-ordered")
    # the upper bits of a place are its range, the lower its number there
    ranges = ordered.groupBy("curve", F.call_function("shiftright", "place", F.lit(33)).alias("part")).agg(F.min("place").alias("low"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = materialize(ranges.select("curve", "part", "low", F.coalesce(before, F.lit(0)).alias("before")), "ann-ranges")
    few = ranges.count() <= broadcast_rows
    ranked = ordered.withColumn("part", F.call_function("shiftright", "place", F.lit(33))).join(F.broadcast(ranges) if few else ranges, ["curve", "part"])
    ranked = ranked.withColumn("block", F.floor((F.col("before") + F.col("place") - F.col("low")) / block_rows).cast("long"))
    home = F.floor(F.col("block") / group_blocks).cast("long")
    beside = F.when(~F.col("asks") & (F.col("block") % group_blocks == 0), home - 1).when(~F.col("asks") & (F.col("block") % group_blocks == group_blocks - 1), home + 1)
    dealt = ranked.select("curve", F.explode(F.array_compact(F.array(home, beside))).alias("grp"), "block", "cls", "asks", "packed")
    met = dealt.groupBy("curve", "grp").applyInPandas(_windows(k + 1 + spare), "asker long, cls long, near double")

    found = met.groupBy("asker", "cls").agg(F.max("near").alias("near"))
    closest = Window.partitionBy("asker").orderBy(F.desc("near"), "cls")
    pairs = found.withColumn("nth", F.row_number().over(closest)).where(F.col("nth") <= k + 1 + spare).select("asker", "cls")
    both = pairs.join(points.select("cls", "v"), "cls").join(points.select(F.col("cls").alias("asker"), F.col("v").alias("w")), "asker")
    product = F.aggregate(F.zip_with("v", "w", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    scored = both.select("asker", "cls", product.alias("score"))
    # of a class no more than its k + 1 smallest ids can be among the nearest
    first = Window.partitionBy("cls").orderBy("vec_id")
    members = named.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1).select("cls", "vec_id")
    best = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    lists = scored.join(members, "cls").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1).select("asker", "vec_id", "score")
    asking = named.where("q").select(F.col("vec_id").alias("query_id"), F.col("cls").alias("asker"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    result = asking.join(lists, "asker").where("query_id <> vec_id").withColumn("rank", F.row_number().over(order))
    return result.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_curve_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, F.col("vec_id") % 20 == 0)
