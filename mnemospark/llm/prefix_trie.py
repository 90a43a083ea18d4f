"""Trie of conversation prefixes with subtree totals by depth-band rollup.

A node is a distinct sequence of first turns; its key is the exclusive or of two 64-bit hashes of each turn's
number and digest. So a prefix's key is a running aggregate, which adds up over chunks of a conversation,
and no conversation is ever one row or one task: turns are numbered within ranges of a global order, running keys go by
chunks of ``CHUNK`` turns, and only the chunks' own sums are ordered per conversation.

Subtree totals: depths are cut into bands of ``BAND`` levels. A node adds its weights to its ancestors of its own
band, ``BAND`` at most. What the first nodes of the bands hold then are the weights of a tree of its own, whose
depth is ``BAND`` times less: it is rolled up the same way, until one band holds all. On the way back the
complete total of each band's first node goes to its ancestors in the band above. So a depth of d takes about
``log(d) / log(BAND)`` rounds each way, and no row explodes to more than ``BAND`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.plans.scratch import discard, materialize

BAND, CHUNK = 8, 512
KEY = ("depth", "k1", "k2")


def _crc(number: Column) -> Column:
    return F.crc32(number.cast("string").cast("binary"))


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, bytes) of all turns of conversations with an id; pos counts from 1.

    Turns go by their number (null first), role and digest of the text.
    """
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        r.alias("role"),
        F.unhex(F.sha2(t.cast("binary"), 256)).alias("said"),
        F.octet_length(t).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "trie-turns")
    order = ["turn", "role", "said", "row"]
    cells = materialize(rows.repartitionByRange("conv_id", *order).withColumn("cell", F.spark_partition_id()), "trie-cells")
    counts = cells.groupBy("conv_id", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("conv_id", "cell", F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    pos = F.col("before") + F.row_number().over(Window.partitionBy("conv_id", "cell").orderBy(*order))
    digest = F.sha2(F.concat(F.col("role").cast("binary"), F.lit(b"\0"), F.col("said")), 256)
    out = materialize(cells.join(before, ["conv_id", "cell"]).select("conv_id", pos.alias("pos"), F.unhex(digest).alias("digest"), "bytes"), "trie-numbered")
    discard(rows, cells)
    return out


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns (conv_id, pos, digest, bytes) of the rebuilt conversations, and a row at pos 0 for every conversation.

    Conversation c takes the first h turns of conversation c - c % 5, then its own without its first h; h is crc32(c) % 9.
    """
    sizes = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = sizes.select("conv_id", (_crc(F.col("conv_id")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("base"))
    lengths = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = materialize(convs.join(lengths, "base", "left").select("conv_id", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("head")), "trie-convs")
    heads = turns.where("pos <= 8").withColumnRenamed("conv_id", "base").join(convs.where("head > 0"), "base").where("pos <= head")  # 5 conversations a base at most
    tails = turns.join(convs, "conv_id").where("pos > h").withColumn("pos", F.col("head") + F.col("pos") - F.col("h"))
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("bytes"))
    columns = ["conv_id", "pos", "digest", "bytes"]
    return heads.select(columns).unionByName(tails.select(columns)).unionByName(roots)


def keyed(rows: DataFrame) -> DataFrame:
    """Add the node key (depth, k1, k2) of the prefix that ends with each row, and the parent's (p1, p2)."""
    own = lambda salt: F.when(F.col("pos") > 0, F.xxhash64(F.lit(salt), "pos", "digest")).otherwise(F.lit(0))
    rows = rows.select("conv_id", "pos", "bytes", own("a").alias("x1"), own("b").alias("x2"), F.floor(F.col("pos") / CHUNK).alias("chunk"))
    rows = materialize(rows, "trie-rebuilt")
    chunks = rows.groupBy("conv_id", "chunk").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"))
    past = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("conv_id", "chunk", *[F.coalesce(F.bit_xor(c).over(past), F.lit(0)).alias(c) for c in ("c1", "c2")])
    run = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    k = {i: F.col(f"c{i}").bitwiseXOR(F.bit_xor(f"x{i}").over(run)) for i in (1, 2)}
    out = rows.join(chunks, ["conv_id", "chunk"]).select("conv_id", F.col("pos").alias("depth"), "bytes", k[1].alias("k1"), k[2].alias("k2"), "x1", "x2")
    return out.select("conv_id", *KEY, "bytes", F.col("k1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("x2")).alias("p2"))


def paths(rows: DataFrame, step: int) -> DataFrame:
    """Per node whose depth ``step`` divides: the keys on its way within its band, itself last, and for bands' first nodes those of the band above.

    ``up``: whether the path is that of the band above (without the node). Depths in a path rise by ``step`` and end at
    the node's own, or one step above it.
    """
    tall = step * BAND
    at = rows.where(F.col("depth") % step == 0).select("conv_id", *KEY, F.floor(F.col("depth") / tall).alias("band"), F.lit(False).alias("up"))
    first = at.where((F.col("depth") % tall == 0) & (F.col("depth") > 0)).select("conv_id", *KEY, (F.col("band") - 1).alias("band"), F.lit(True).alias("up"))
    w = Window.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    seen = at.unionByName(first).select(*KEY, "up", F.collect_list(F.struct(*KEY)).over(w).alias("path"))  # BAND + 1 at most
    once = seen.groupBy(*KEY, "up").agg(F.first("path").alias("path"))
    return once.select(*KEY, "up", F.when(F.col("up"), F.slice("path", 1, F.size("path") - 1)).otherwise(F.col("path")).alias("path"))


def _to_ancestors(weights: DataFrame, ways: DataFrame, sums: list[str]) -> DataFrame:
    """Sums of weights over the paths: what each ancestor gets."""
    each = weights.join(ways, list(KEY)).select(F.explode("path").alias("to"), *sums)
    return each.groupBy(*[F.col(f"to.{k}").alias(k) for k in KEY]).agg(*[F.sum(s).alias(s) for s in sums])


def subtree_sums(rows: DataFrame, weights: DataFrame, sums: list[str], deepest: int) -> DataFrame:
    """(depth, k1, k2, *sums): the weights of every node added up over its subtree. ``rows`` hold every node's way from the root."""
    tiers, step = [], 1
    while True:  # up: partial sums within bands
        ways = materialize(paths(rows, step), "trie-paths")
        part = materialize(_to_ancestors(weights, ways.where("not up"), sums), "trie-band")
        tiers.append((ways, part))
        step *= BAND
        if step > deepest:
            break
        weights = part.where(F.col("depth") % step == 0)
    total = tiers[-1][1]
    for ways, part in reversed(tiers[:-1]):  # down: complete totals of bands' first nodes go to the band above
        more = _to_ancestors(total, ways.where("up"), sums)
        both = part.unionByName(more).groupBy(*KEY).agg(*[F.sum(s).alias(s) for s in sums])
        after = materialize(both, "trie-total")
        if total is not tiers[-1][1]:
            discard(total)
        total = after
    discard(*[t for tier in tiers for t in tier if t is not total])
    return total


def _chunks(parts: Iterator[pa.RecordBatch], most: int = 1 << 11) -> Iterator[pa.RecordBatch]:
    """Runs of one node's ids in ascending rows become comma-joined pieces of ``most`` ids at most: some 20 kB, so a batch of pieces stays small too."""
    node, first, ids = None, None, []
    out: list[tuple] = []

    def close() -> None:
        if ids:
            out.append((*node, first, ",".join(ids)))
            ids.clear()

    names = [*KEY, "first", "piece"]
    for part in parts:
        columns = [part.column(c).to_pylist() for c in (*KEY, "conv_id")]
        for *at, c in zip(*columns, strict=True):
            if at != node or len(ids) >= most:
                close()
                node, first = at, c
            ids.append(str(c))
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_PIECES)
            out.clear()
    close()
    yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_PIECES)


_PIECES = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_DIGESTS = pa.schema([("depth", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("ends_sha256", pa.string())])


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of each node's pieces, which follow each other in rows; a piece is held at a time."""
    node, state = None, None
    for part in parts:
        out = []
        for *at, piece in zip(*[part.column(c).to_pylist() for c in (*KEY, "piece")], strict=True):
            if at != node:
                if state:
                    out.append((*node, state.hexdigest()))
                node, state = at, hashlib.sha256(piece.encode())
            else:
                state.update(b"," + piece.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, x, strict=True)) for x in out], schema=_DIGESTS)
    if state:
        yield pa.RecordBatch.from_pylist([dict(zip(_DIGESTS.names, (*node, state.hexdigest()), strict=True))], schema=_DIGESTS)


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes with ends (depth, k1, k2, conv_id).

    The ids are sorted by ranges over all tasks and joined in pieces there; a digest, which is sequential
    by nature, then streams over its node's few pieces.
    """
    pieces = ends.repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id").mapInArrow(_chunks, "depth long, k1 long, k2 long, first long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def trie(turns: DataFrame, rebuild=rebuilt) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns without a conv_id belong to no conversation and are left out. Null turns come first, null roles and texts are
    empty; turns of one number go by role, then by the digest of their text, and repeated ones each count. Other
    columns are ignored; an empty table gives no nodes. ``rebuild`` maps numbered turns to those of the conversations to be
    built in, with a row at pos 0 for each; the identity of a node is 128 bits of hashes over its turns' SHA-256 digests.
    """
    rows = materialize(keyed(rebuild(numbered(turns))), "trie-rows")
    nodes = rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("bytes").alias("bytes"), F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = materialize(nodes, "trie-nodes")
    up = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    counted = materialize(nodes.join(up, list(KEY), "left").fillna(0, ["n_children"]), "trie-counted")
    weights = counted.select(*KEY, (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(rows, weights, ["n_leaves", "saved_tokens"], deepest)
    length = rows.groupBy("conv_id").agg(F.max(F.struct(*KEY)).alias("at"))
    ends = end_digests(length.select("at.*", "conv_id"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = counted.join(sums, list(KEY)).join(ends, list(KEY), "left").join(parents, ["depth", "p1", "p2"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


ORACLE_SQL = r"""
with raw as (
  select conv_id, turn, coalesce(role, '') as role, sha256(coalesce(text, '')) as said, strlen(coalesce(text, '')) as bytes
  from conversations where conv_id is not null),
turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, said) as pos, sha256(role || chr(10) || said) as digest, bytes from raw),
convs as (
  select conv_id, conv_id - conv_id % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % 9 as h
  from turns group by 1),
sized as (select c.*, least(h, (select count(*) from turns t where t.conv_id = c.base)) as head from convs c),
rows as (
  select c.conv_id, pos, digest, bytes from sized c join turns t on t.conv_id = c.base where pos <= head
  union all select c.conv_id, head + pos - h, digest, bytes from sized c join turns t on t.conv_id = c.conv_id where pos > h
  union all select conv_id, 0, '', 0 from convs),
keyed as (select *, sha256(string_agg(digest, '' order by pos) over (partition by conv_id order by pos rows unbounded preceding)) as k, max(pos) over (partition by conv_id) = pos as ends from rows),
linked as (select *, lag(k) over (partition by conv_id order by pos) as pk from keyed),
nodes as (
  select k, pos as depth, min(conv_id) as conv_id, min(pk) as pk, count(*) as n_convs, min(bytes) as bytes,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from linked group by 1, 2),
kids as (select pk as k, count(*) as n from nodes where depth > 0 group by 1),
weighed as (select n.*, coalesce(kids.n, 0) as n_children, kids.n is null as leaf, (n_convs - 1) * bytes as saved from nodes n left join kids using (k)),
sums as (select a.k, sum(w.leaf::int)::bigint as n_leaves, sum(w.saved)::bigint as saved_tokens from weighed w join linked a on a.conv_id = w.conv_id and a.pos <= w.depth group by 1)
select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
from weighed w join sums using (k) left join nodes p on p.k = w.pk and w.depth > 0
"""
