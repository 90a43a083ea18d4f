"""Vectors by cosine: exact matrix blocks, and candidate indexes whose hits are checked exactly.

* Inverted lists, for the nearest vectors of a query: vectors belong to the nearest of up to 1,024 centroids,
  fitted on a bounded sample; queries look into as many lists as on that sample find the wanted share of the true nearest.
* Hyperplane bands, for pairs above a threshold: signs of projections make keys, as many tables of as many bits as
  the wanted share of pairs at the threshold needs by the law ``1 - angle / pi`` for one bit.

All rows are indexed. Lists and blocks of many rows are cut into cells of bounded size, with the queries that
look into them, so no list is one task. Vectors that are null, zero or of another length than
their partner, or that hold null or non-finite components, take no part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.plans.scratch import materialize

#: Bounds of what the driver holds to fit lists: centroids, and sampled vectors.
MAX_LISTS, SAMPLE = 1024, 16_384
Cut = Callable[[float], float]


def usable(c: str = "vector") -> Column:
    n = S.norm(F.col(c))
    return F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x)) & (n > 0) & (n < float("inf"))


def _unit(vectors) -> np.ndarray:
    a = np.stack(list(vectors)).astype(float)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _places(line: np.ndarray, ids: np.ndarray, grp: np.ndarray, k: int, cut: Cut | None) -> np.ndarray:
    """Places of a query's k nearest rows, ties to the smaller id; with ``cut`` of all down to ``cut`` of the cosine of the k-th group."""
    n = len(line)
    most = min(n, k if cut is None else 16 * k)
    near = np.arange(n) if most == n else np.flatnonzero(line >= np.partition(line, n - most)[n - most] - 2e-9)
    if cut is None:
        return near[np.lexsort((ids[near], -np.round(line[near], 9)))][:k]
    for found in (near, np.arange(n)):
        order = found[np.argsort(-line[found], kind="stable")]
        first = np.sort(np.unique(grp[order], return_index=True)[1])
        if len(first) >= k:  # what rounds to the same relevance may tie
            return np.flatnonzero(line >= cut(line[order[first[k - 1]]]) - 1e-8)
    return np.arange(n)


def _best(k: int, cut: Cut | None):
    """Of a cell of queries and one of vectors: per query the k nearest above its floor; with ``cut`` all down to ``cut`` of the cosine of the k-th group."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        asked, found, near = [], [], []
        by_length = right["v"].map(len) if len(right) else None
        for length, queries in left.groupby(left["qv"].map(len)) if len(left) and len(right) else []:
            rows = right[by_length == length]
            if not len(rows):
                continue
            ids, grp, unit = rows["id"].to_numpy(), rows["grp"].to_numpy(), _unit(rows["v"]).T
            for at in range(0, len(queries), 512):
                some = queries.iloc[at : at + 512]
                for qid, own, floor, line in zip(some["query_id"], some["own"], some["floor"], _unit(some["qv"]) @ unit, strict=True):
                    line[ids == own] = -np.inf
                    order = _places(line, ids, grp, k, cut)
                    order = order[line[order] > floor]
                    asked.append(np.full(len(order), qid, np.int64))
                    found.append(ids[order])
                    near.append(np.minimum(line[order], 1.0))
        whole = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.array([], kind)
        return pd.DataFrame({"query_id": whole(asked, np.int64), "id": whole(found, np.int64), "cosine": whole(near, float)})

    return best


def _queries(queries: DataFrame, floor: float) -> DataFrame:
    own = (F.col("own") if "own" in queries.columns else F.lit(None)).cast("long")
    least = F.coalesce(F.col("floor"), F.lit(floor)) if "floor" in queries.columns else F.lit(floor)
    return queries.where(usable()).select("query_id", own.alias("own"), least.cast("double").alias("floor"), F.col("vector").cast("array<double>").alias("qv"))


def _vectors(vectors: DataFrame) -> DataFrame:
    group = F.col("grp") if "grp" in vectors.columns else F.col("id")
    return vectors.where(usable()).select("id", group.cast("long").alias("grp"), F.col("vector").cast("array<double>").alias("v"))


def exact(queries: DataFrame, vectors: DataFrame, k: int, floor: float, block_rows: int = 4096, cut: Cut | None = None) -> DataFrame:
    """(query_id, id, cosine): per block of vectors the nearest of each query, so a superset of its k nearest.

    Each pair of blocks is one matrix product. The query table is stated and small beside the vectors: the work
    is its size times theirs.
    """
    # with ``cut`` a query keeps a share of a block's rows, so cells have few queries
    n_q, n_v = max(1, -(-queries.count() // (block_rows if cut is None else max(1, block_rows // 8)))), max(1, -(-vectors.count() // block_rows))
    q = _queries(queries, floor).select(F.pmod(F.xxhash64("query_id"), F.lit(n_q)).cast("int").alias("qb"), "*", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))).alias("vb"))
    v = _vectors(vectors).select(F.pmod(F.xxhash64("id"), F.lit(n_v)).cast("int").alias("wb"), "*", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("pb"))
    return q.groupBy("qb", "vb").cogroup(v.groupBy("pb", "wb")).applyInPandas(_best(k, cut), "query_id long, id long, cosine double")


def fit_lists(sample: np.ndarray, n_lists: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Unit centroids of a sample of unit vectors by spherical k-means; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:n_lists]].copy()
    for _ in range(rounds):
        home = (sample @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), c)
    return c


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float, n_queries: int = 256) -> int:
    """Lists to look into so that of the k nearest in the sample the share ``recall`` is found.

    A table's neighbours are nearer than its sample's, and nearer ones are found sooner, so the number errs on the safe side.
    """
    q = sample[:n_queries]
    sim = q @ sample.T
    np.fill_diagonal(sim[:, : len(q)], -np.inf)
    near = np.argsort(-sim, axis=1)[:, : min(k, len(sample) - 1)]
    home = (sample @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(q @ centroids.T), axis=1), axis=1)
    seen = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(seen[min(len(seen) - 1, math.ceil(recall * len(seen)) - 1)]) + 1 if seen.size else 1


def in_lists(queries: DataFrame, vectors: DataFrame, k: int, floor: float, recall: float = 0.97, block_rows: int = 4096, cut: Cut | None = None, n_lists: int | None = None) -> DataFrame:
    """As ``exact``, but queries look into their nearest inverted lists only; about ``recall`` of the nearest are found.

    Lists and the number looked into are fitted on at most ``SAMPLE`` vectors, those of the smallest hashes of their ids.
    Vectors of other lengths than most of the sample are compared with no query.
    """
    spark = vectors.sparkSession
    rows = materialize(_vectors(vectors), "vector-rows")
    asked = materialize(_queries(queries, floor), "vector-queries")
    head = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").collect()  # SAMPLE rows
    lengths = [len(r["v"]) for r in head]
    length = max(set(lengths), key=lengths.count, default=0)
    rows, asked = rows.where(F.size("v") == length), asked.where(F.size("qv") == length)
    if not head:
        return spark.createDataFrame([], "query_id long, id long, cosine double")
    sample = _unit(r["v"] for r in head if len(r["v"]) == length)
    n = rows.count()
    centroids = fit_lists(sample, min(n_lists or max(1, round(math.sqrt(n))), MAX_LISTS, len(sample)))
    probes = probes_for(sample, centroids, k, recall)

    @F.pandas_udf("array<int>")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.argsort(-(_unit(batch) @ centroids.T), axis=1)[:, :probes].astype(np.int32))) if len(batch) else pd.Series([], dtype=object)

    @F.pandas_udf("int")
    def home(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series((_unit(batch) @ centroids.T).argmax(axis=1).astype(np.int32)) if len(batch) else pd.Series([], dtype=np.int32)

    placed = materialize(rows.withColumn("list", home("v")), "vector-lists")
    looked = materialize(asked.withColumn("list", F.explode(nearest("qv"))), "vector-probes")
    cells = lambda t, name: t.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias(name))
    sizes = F.broadcast(cells(placed, "n_v").join(cells(looked, "n_q"), "list"))  # MAX_LISTS rows
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = looked.join(sizes, "list").select("list", deal("query_id", "n_q").alias("qb"), "query_id", "own", "floor", "qv", every("n_v").alias("vb"))
    v = placed.join(sizes, "list").select("list", deal("id", "n_v").alias("wb"), "id", "grp", "v", every("n_q").alias("pb"))
    return q.groupBy("list", "qb", "vb").cogroup(v.groupBy("list", "pb", "wb")).applyInPandas(_best(k, cut), "query_id long, id long, cosine double")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, floor: float, mode: str = "exact", recall: float = 0.97, block_rows: int = 4096, cut: Cut | None = None) -> DataFrame:
    """(query_id, id, cosine) of queries (query_id, vector[, own, floor]) and vectors (id, vector[, grp]), by ``exact`` or ``in_lists`` (mode ``lists``).

    A query leaves out the vector of its ``own`` id, and those not above its ``floor``. With ``cut`` all rows down to ``cut(c)``
    are kept, c being the cosine of the k-th group (``grp``, else the row).
    """
    if mode == "lists":
        return in_lists(queries, vectors, k, floor, recall, block_rows, cut)
    if mode != "exact":
        raise ValueError(f"no such mode: {mode}")
    return exact(queries, vectors, k, floor, block_rows, cut)


def bands_for(n: int, least: float, recall: float, most: int = 256) -> tuple[int, int]:
    """(tables, bits) that find the share ``recall`` of pairs at cosine ``least`` among n rows, at the lowest number of rows and chance meetings."""
    agree = 1 - math.acos(min(1.0, least)) / math.pi
    best = (math.inf, 1, 1)
    for bits in range(1, 31):
        hit = agree**bits
        tables = 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if tables <= most:
            best = min(best, (tables * (1 + n / 2**bits), tables, bits))
    return best[1], best[2]


def vector_classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives, membership): one row (id, vector) for each distinct vector, the smallest id, and (id, member)."""
    keyed = df.where(usable()).select("id", F.col("vector").cast("array<double>").alias("vector"))
    reps = keyed.groupBy("vector").agg(F.min("id").alias("id")).select("id", "vector")
    return reps, keyed.withColumnRenamed("id", "member").join(reps, "vector").select("id", "member")


def banded_pairs(df: DataFrame, least: float, recall: float = 0.99, seed: int = 11) -> DataFrame:
    """Pairs (a, b, cosine) with a < b and cosine of ``least`` or more: of those at ``least`` the share ``recall`` is found, of nearer ones more.

    Vectors (id, vector) should be distinct (``vector_classes``); rows meet on equal signs of projections, once
    a pair, and only then are their vectors compared. All vectors need the length that most of them have.
    """
    rows = materialize(df.where(usable()).select("id", F.col("vector").cast("array<double>").alias("v")), "band-rows")
    length = rows.groupBy(F.size("v").alias("l")).count().orderBy(F.desc("count"), "l").first()
    if length is None:
        return df.sparkSession.createDataFrame([], "a long, b long, cosine double")
    tables, bits = bands_for(length["count"], least, recall)
    dim = length["l"]

    @F.pandas_udf("array<long>")
    def keys(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        weights = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if len(batch):
                signs = (np.stack(batch.to_list()) @ planes > 0).reshape(len(batch), tables, bits)
                yield pd.Series(list(signs @ weights))
            else:
                yield pd.Series([], dtype=object)

    met = materialize(rows.where(F.size("v") == dim).select("id", F.posexplode(keys("v")).alias("table", "key")), "band-keys")
    pairs = met.select(F.col("id").alias("a"), "table", "key").join(met.select(F.col("id").alias("b"), "table", "key"), ["table", "key"]).where("a < b").select("a", "b").distinct()
    left, right = (rows.select(F.col("id").alias(c), F.col("v").alias(f"v{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", F.least(S.cosine(F.col("va"), F.col("vb")), F.lit(1.0)).alias("cosine")).where(F.col("cosine") >= least)
