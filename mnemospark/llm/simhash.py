r"""Near-duplicate documents by SimHash and meet-in-the-middle ball hashing.

A fingerprint has 64 bits. Two fingerprints within distance ``2 r`` have a common variant within
distance ``r`` of both. So with a radius of 2 every distinct fingerprint emits itself and its 64
one-bit variants, and all that meet at a variant are within the radius, which the distance test
confirms. A variant's members are written as a 64-bit mask of the flipped bit (and a flag for the
variant itself), so the group at a variant is one row of fixed size that combines before the
shuffle; it never holds a list. Members of one variant are all linked to each other, thus a star
from its smallest member keeps every connection with at most 64 edges.

Fingerprints are made per row in Python over Arrow batches: words and shingles are byte slices,
hashes are XXH64, and the bit counts are summed in blocks of bounded size. Only fingerprints and ids
are shuffled, never texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.components import components
from mnemospark.plans.scratch import discard, materialize

_LOWER = bytes(range(256)).lower()
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles as an unsigned 64-bit number; 0 for texts without words.

    A-Z become lower case, words are runs of bytes other than space and \\t to \\r, shingles count as
    often as they occur, and fewer words than ``shingle`` are one shingle. A bit is set if it is set
    in over half the hashes.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    counts, n = np.zeros(64, np.int64), max(len(words) - shingle + 1, 1)
    for at in range(0, n, _BLOCK):
        line = b" ".join(words[at : at + _BLOCK + shingle - 1])
        lengths = np.fromiter(map(len, words[at : at + _BLOCK + shingle - 1]), np.int64)
        starts = np.cumsum(lengths + 1) - lengths - 1
        k = min(_BLOCK, n - at)
        last = np.minimum(np.arange(k) + shingle - 1, len(lengths) - 1)
        view, ends = memoryview(line), (starts + lengths)[last]
        hashes = np.array([xxhash.xxh64_intdigest(view[s:e], seed) for s, e in zip(starts[:k].tolist(), ends.tolist(), strict=True)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, seed: int = 42, out: str = "fp") -> DataFrame:
    """Add the fingerprint of every row's whole text as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, shingle, seed) for x in batch], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, prints(F.col(text)))


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def _meets(fps: DataFrame, bits: int) -> DataFrame:
    """Arrays of the distinct values of column fp that meet at a variant: two members or more, at most ``bits`` + 1.

    Only the low ``bits`` bits are flipped; what stands above them must be equal.
    """
    variants = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(bits - 1))).alias("flip")).select(  # flip -1: fp itself
        F.when(F.col("flip") < 0, F.col("fp")).otherwise(F.col("fp").bitwiseXOR(_bit(F.greatest("flip", F.lit(0))))).alias("variant"),
        F.when(F.col("flip") < 0, F.lit(0).cast("long")).otherwise(_bit(F.greatest("flip", F.lit(0)))).alias("flipped"),
        (F.col("flip") < 0).cast("int").alias("itself"),
    )
    meets = variants.groupBy("variant").agg(F.bit_or("flipped").alias("mask"), F.max("itself").alias("itself"))
    meets = meets.where(F.bit_count("mask") + F.col("itself") > 1)
    flips = F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col("mask").bitwiseAND(_bit(i)) != 0)
    members = F.concat(
        F.when(F.col("itself") == 1, F.array("variant")).otherwise(F.array().cast("array<long>")),
        F.transform(flips, lambda i: F.col("variant").bitwiseXOR(_bit(i))),
    )
    return meets.select("variant", members.alias("m"))


def links(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) between distinct fingerprints that differ in 1 or 2 bits, enough to connect all that are linked."""
    # few bytes become 65 times as many rows: they are dealt out first, by number, as sizes would leave them to one or two tasks
    spread = fps.select(F.col(fp).alias("fp")).distinct().repartition(4 * fps.sparkSession.sparkContext.defaultParallelism, "fp")
    stars = _meets(spread, 64).select(F.array_min("m").alias("a"), F.explode("m").alias("b"))
    return stars.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), component_id (smallest doc_id in its group).

    Texts without words, null ones too, have fingerprint zero and are linked like any other. Equal
    fingerprints are one class before any link is sought, so copies cost one row each. Rows with a null
    id take part and get their group's smallest id; a group without ids gets null. Repeated rows are
    kept. Other columns are ignored; an empty table gives an empty result.
    """
    prints = materialize(with_fingerprint(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", shingle).select("doc_id", "fp"), "simhash")
    owners = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-owners")
    groups = components(links(owners))
    roots = owners.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    firsts = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    found = materialize(roots.join(firsts, "root").select("fp", "component_id"), "simhash-groups")
    return prints.join(found, "fp").select("doc_id", "fp", "component_id")


_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int, known: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """Digest of a text's words, and the distinct hashes of its word shingles; fewer words are one shingle.

    Words are runs of bytes other than space and \\t to \\r. ``known`` keeps hashes of words between calls.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").split()
    if len(known) > 1 << 18:
        known.clear()
    for w in set(parts).difference(known):
        known[w] = xxhash.xxh64_intdigest(w, 42)
    hashes = np.fromiter(map(known.__getitem__, parts), np.uint64, len(parts))
    width = min(words, len(parts))
    n = len(parts) - width + 1
    with np.errstate(over="ignore"):
        x = np.full(n, width, np.uint64)
        for j in range(width):
            x = (x ^ hashes[j : j + n]) * _P
            x ^= x >> np.uint64(32)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return hashlib.sha256(b" ".join(parts)).digest(), np.unique(x).view(np.int64)


def _first(hashes: np.ndarray, similarity: float, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The hashes one of which any set as similar must share, in the common order: by rank in ``often`` (0 for others), then hash."""
    n = len(hashes)
    p = n - math.ceil(similarity * n - 1e-9) + 1
    if len(often):
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        place = np.where(often[at] == hashes, rank[at], 0)
        hashes = hashes[np.lexsort((hashes, place))]
    return hashes[:p]


def _print_of(hashes: np.ndarray) -> int:
    """SimHash of a set given by its hashes, as a signed long: a bit is set if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = np.ascontiguousarray(hashes[at : at + _BLOCK], "<i8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def _ball_pairs(prints: DataFrame) -> DataFrame:
    """Pairs (a, b, sizes) of rows (node, n, fp) that meet in a ball: rows of one fingerprint with its first, and the firsts of fingerprints within two bits."""
    firsts = materialize(prints.groupBy("fp").agg(F.min_by(F.struct("node", "n"), "node").alias("x")), "near-balls")
    same = prints.join(firsts, "fp").where("node <> x.node").select(F.col("x.node").alias("a"), F.col("node").alias("b"), (F.col("n") + F.col("x.n")).alias("sizes"))
    x, y = (firsts.select(F.col("fp").alias(end), F.col("x").alias(f"x{end}")) for end in "ab")
    met = links(firsts).join(x, "a").join(y, "b")
    return same.unionByName(met.select(F.least("xa.node", "xb.node").alias("a"), F.greatest("xa.node", "xb.node").alias("b"), (F.col("xa.n") + F.col("xb.n")).alias("sizes")))


def _parity(hashes: np.ndarray) -> bytes:
    """Bitmap of the set: a bit for each value of the hashes' low bits, set where an odd number of members have it; about a bit a member."""
    bits = 1 << max(8, int(len(hashes)).bit_length())
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _least_apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of members that only one of two sets has: places where their bitmaps, folded to one size, differ."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) > len(y):
        x, y = y, x
    y = np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def _may(na: str, ia: str, nb: str, ib: str, similarity: float) -> Column:
    """Whether sets of sizes na and nb whose first common hash is at places ia and ib can be as similar."""
    return F.lit(1) + F.least(F.col(na) - F.col(ia), F.col(nb) - F.col(ib)) >= F.lit(similarity / (1 + similarity)) * (F.col(na) + F.col(nb)) - 1e-9


def near_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, stars: int = 1, sample: int = 16, listed: int = 1 << 18, broadcast_ids: int = 1 << 20
) -> DataFrame:
    """One row per document: doc_id, component_id (smallest doc_id in its group of near duplicates).

    Near duplicates are all pairs whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
    Texts of equal words are one class. Rows that meet in a ball of their shingles' SimHashes come first: those that are as similar
    are linked. Balls lose pairs, so the other candidates are complete, over what is not in one group yet: in one order of all shingles two such
    sets share a shingle among the first fifth of each, and their sizes and its places there bound what they can have in
    common. Any order is right; shingles that are frequent in one of ``sample`` documents come last (the
    ``listed`` most frequent ones), so that common passages are no meeting points.

    At a meeting point members are first compared with one of them, in ``stars`` rounds with one that is not yet in the
    first one's group, and then those outside the first one's group with all of other groups. So near copies cost
    pairs in proportion to their number, and no link between different groups is left out. Before shingles are
    fetched, bitmaps of their parities, a bit a shingle, rule out pairs that differ in too many; this too is exact.

    Ids must be unique and not null. Texts without words are alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("node"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))

    @F.pandas_udf("array<long>")
    def sets_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[bytes, int] = {}
        for batch in batches:
            yield pd.Series([shingles(x, shingle, known)[1] for x in batch], dtype=object)

    @F.pandas_udf("long")
    def apart(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_least_apart(x, y) for x, y in zip(a, b, strict=True)], dtype="int64")

    part = rows.where(F.pmod(F.xxhash64("node"), F.lit(sample)) == 0).select(F.explode(sets_of("text")).alias("t"))
    top = part.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 2").orderBy(F.desc("f"), "t").limit(listed).toPandas().sort_values("t")
    order = spark.sparkContext.broadcast((top["t"].to_numpy(np.int64), top["f"].to_numpy(np.int64)))

    @F.pandas_udf("digest binary, n int, firsts array<long>, odd binary, fp long")
    def prints_of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[bytes, int] = {}
        often, rank = order.value
        for batch in batches:
            found = [shingles(x, shingle, known) for x in batch]
            columns = {"firsts": lambda s: _first(s, similarity, often, rank), "odd": _parity, "fp": _print_of}
            yield pd.DataFrame({"digest": [d for d, _ in found], "n": [len(s) for _, s in found], **{c: [f(s) for _, s in found] for c, f in columns.items()}})

    prints = materialize(rows.select("node", prints_of("text").alias("p")).select("node", "p.*"), "near-prints")
    owners = materialize(prints.groupBy("digest").agg(F.min("node").alias("owner"), F.count(F.lit(1)).alias("n")), "near-owners")
    copies = owners.where("n > 1").select("digest", "owner")
    same = materialize(prints.select("digest", "node").join(copies, "digest").where("node <> owner").select("node", "owner"), "near-same")
    alone = prints.select("node", "n", "firsts", "fp").join(same.select("node"), "node", "left_anti")
    held = alone.select("node", "n", F.posexplode("firsts").alias("i", "t")).select("t", "node", "n", (F.col("i") + 1).alias("i"))
    shared = held.groupBy("t").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("t")
    held = materialize(held.join(shared, "t"), "near-held")
    maps = prints.select("node", "odd")

    labels, edges = None, None

    def link(pairs: DataFrame) -> None:
        """Add the pairs (a, b, sizes) that are as similar to the edges."""
        nonlocal labels, edges
        near = pairs.join(maps.select(F.col("node").alias("a"), F.col("odd").alias("oa")), "a").join(maps.select(F.col("node").alias("b"), F.col("odd").alias("ob")), "b")
        near = near.where(apart("oa", "ob") <= F.lit((1 - similarity) / (1 + similarity)) * F.col("sizes") + 1e-9)
        pairs = materialize(near.select("a", "b"), "near-pairs")
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "near-wanted")
        n_wanted = wanted.count()
        if n_wanted:
            sets = rows.join(F.broadcast(wanted) if n_wanted <= broadcast_ids else wanted, "node", "left_semi").select("node", sets_of("text").alias("s"))
            sets = materialize(sets, "near-shingles")
            both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
            both = both.withColumn("common", F.size(F.array_intersect("sa", "sb")))
            alike = materialize(both.where(F.col("common") >= similarity * (F.size("sa") + F.size("sb") - F.col("common")) - 1e-9).select("a", "b"), "near-links")
            discard(sets)
            edges = alike if edges is None else edges.unionByName(alike)
            labels = components(edges).select("node", F.col("component").alias("label"))
        discard(pairs, wanted)

    link(_ball_pairs(alone.select("node", "n", "fp")))
    for step in range(stars + 1):
        seen = held.withColumn("label", F.col("node"))
        if labels is not None:
            seen = held.join(labels.withColumnRenamed("label", "known"), "node", "left").select(*held.columns, F.coalesce("known", "node").alias("label"))
        member = F.struct("label", "node", "n", "i")
        firsts = seen.groupBy("t").agg(F.min(member).alias("lead"), F.max("label").alias("last"))
        firsts = firsts.where("lead.label < last").select("t", "lead")  # elsewhere all are in one group
        open_ = seen.join(firsts, "t")
        if step == stars:
            open_ = materialize(open_, "near-rest")
            x = open_.where("label <> lead.label")
            x = x.select("t", F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), F.col("label").alias("la"))
            y = open_.select("t", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("i").alias("ib"), F.col("label").alias("lb"))
            pairs = x.join(y, "t").where("la <> lb")
        else:
            if step:
                nexts = open_.where("label <> lead.label").groupBy("t").agg(F.min_by(member, F.xxhash64("node", F.lit(step))).alias("other"))
                open_ = open_.drop("lead").join(nexts.withColumnRenamed("other", "lead"), "t")
            x = open_.where("label <> lead.label")
            pairs = x.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("i").alias("ia"), *[F.col(f"lead.{c}").alias(f"{d}b" if c != "node" else "b") for c, d in (("node", ""), ("n", "n"), ("i", "i"))])
        pairs = pairs.where(_may("na", "ia", "nb", "ib", similarity))
        link(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("na") + F.col("nb")).alias("sizes")).distinct())
        if step == stars:
            discard(open_)
    discard(held, prints)
    found = same.select("node", "owner").unionByName(owners.select(F.col("owner").alias("node"), "owner"))
    if labels is not None:
        found = found.join(labels.withColumnRenamed("node", "owner"), "owner", "left").select("node", F.coalesce("label", "owner").alias("owner"))
    return found.select(F.col("node").alias("doc_id"), F.col("owner").alias("component_id"))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
