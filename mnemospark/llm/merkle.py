"""Merkle manifest of a data set as a postorder append log, with an inclusion proof for every row.

Leaves of a tree (here: of one language) are numbered in their order by ranges over all tasks. Aligned builders
take blocks of ``2^HEIGHT`` leaves and append nodes to their block's segment of the log in completion order: a leaf,
then every node that it completes. The tops of the blocks are the leaves of the next tier, built the same way,
until a tree has one block; so there are ``log(n) / HEIGHT`` tiers, each ``2^HEIGHT`` times smaller.

In completion order a node's place needs no pointers: before the leaf e (from 0) there are ``2e - popcount(e)``
nodes, as e leaves complete ``e - popcount(e)`` inner ones; the node of level j over full leaves follows its last leaf by j
places; and the nodes over a ragged end come last, by level (``place``). Proofs are read from the log by these
places: within a block in the block's task, above it by a join of the blocks, not of the leaves, with the tier above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.plans.scratch import materialize

#: Levels of a builder's block: 1,024 leaves, a segment of 64 kB.
HEIGHT = 10
SIZE = 32


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value.cast("string")).cast("string"), F.lit(":"), value.cast("string")), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]).cast("binary"), 256)


def join(nodes: list[bytes]) -> bytes:
    """The node over one or two nodes: the digest of their hex texts."""
    return hashlib.sha256("".join(n.hex() for n in nodes).encode()).digest()


def levels(n: int) -> int:
    """Levels above n leaves until one node remains."""
    return (n - 1).bit_length()


def segment(leaves: list[bytes], top: int) -> bytes:
    """The log of a tree of ``top`` levels over the leaves, in completion order; lone nodes are joined alone."""
    log, open_ = [], [None] * (top + 1)
    for node in leaves:
        log.append(node)
        level = 0
        while level < top and open_[level] is not None:
            node, open_[level] = join([open_[level], node]), None
            log.append(node)
            level += 1
        open_[level] = node
    ragged = None
    for level in range(top):
        run = [x for x in (open_[level], ragged) if x is not None]
        if run:
            ragged = join(run)
            log.append(ragged)
    return b"".join(log)


def place(n: int, level: int, index: int) -> int:
    """Place in the log over n leaves of the node ``index`` of a level."""
    end = (index + 1) << level
    if end <= n:
        return 2 * (end - 1) - (end - 1).bit_count() + level
    return 2 * n - n.bit_count() + level - (n & -n).bit_length()  # its first ragged level is one above the lowest bit of n


def way(log: bytes, n: int, top: int, index: int) -> bytes:
    """Siblings of a leaf on its way up: per level a byte (0 none, 1 left of it, 2 right) and the sibling's digest."""
    out = []
    for level in range(top):
        at = index >> level
        other = at ^ 1
        if other << level < n:
            p = place(n, level, other) * SIZE
            out += [b"\1" if other < at else b"\2", log[p : p + SIZE]]
        else:
            out.append(b"\0")
    return b"".join(out)


def fold(node: bytes, path: bytes) -> bytes:
    """The root that a leaf's digest and its siblings lead to."""
    at = 0
    while at < len(path):
        side = path[at]
        at += 1
        if side:
            other = path[at : at + SIZE]
            at += SIZE
            node = join([other, node] if side == 1 else [node, other])
        else:
            node = join([node])
    return node


def siblings(path: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(path):
        at += 1
        if path[at - 1]:
            out.append(path[at : at + SIZE])
            at += SIZE
    return out


def number(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Add index (from 0, in ``order`` within a tree) and n (the tree's rows); the last of ``order`` makes rows unique.

    Rows are cut into ranges of the whole order, so that neither a large tree nor a value that many rows share
    is one task's.
    """
    cells = materialize(rows.repartitionByRange(tree, *order).withColumn("cell", F.spark_partition_id()), "merkle-cells")
    counts = cells.groupBy(tree, "cell").agg(F.count(F.lit(1)).alias("in_cell"))
    by = Window.partitionBy(tree)
    before = F.coalesce(F.sum("in_cell").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(tree, "cell", before.alias("before"), F.sum("in_cell").over(by).alias("n"))
    index = F.col("before") + F.row_number().over(Window.partitionBy(tree, "cell").orderBy(*order)) - 1
    return cells.join(counts, [tree, "cell"]).withColumn("index", index).drop("cell", "before")


_BLOCK = pa.schema([("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("count", pa.int64()), ("log", pa.binary()), ("top", pa.binary()), ("carried", pa.list_(pa.string())), ("changed", pa.list_(pa.binary()))])


def _builder(height: int):
    def build(part: pa.Table) -> pa.Table:
        part = part.sort_by("index")
        tree, n = part.column("tree")[0].as_py(), part.column("n")[0].as_py()
        leaves = part.column("node").to_pylist()
        log = segment(leaves, height if n > 1 << height else levels(n))
        row = {"tree": tree, "block": part.column("block")[0].as_py(), "n": n, "count": len(leaves), "log": log, "top": log[-SIZE:], "carried": part.column("carried").to_pylist(), "changed": part.column("changed").to_pylist()}
        return pa.Table.from_pylist([row], schema=_BLOCK)

    return build


def tiers(leaves: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Blocks of all tiers over leaves (tree, index, n, node, carried, changed), the lowest first.

    A block is (tree, block, n, count, log, top, carried, changed): its segment of the log, its top node, and what
    its leaves carry, in their order. A tree is ready in the tier in which it has one block.
    """
    out, open_ = [], leaves
    while True:
        cut = open_.select("tree", F.call_function("shiftright", "index", F.lit(height)).alias("block"), "index", "n", "node", "carried", "changed")
        blocks = materialize(cut.groupBy("tree", "block").applyInArrow(_builder(height), "tree string, block long, n long, count long, log binary, top binary, carried array<string>, changed array<binary>"), "merkle-blocks")
        out.append(blocks)
        more = blocks.where(F.col("n") > 1 << height)
        if more.isEmpty():
            return out
        per = F.ceil(F.col("n") / F.lit(1 << height)).cast("long")
        open_ = more.select("tree", F.col("block").alias("index"), per.alias("n"), F.col("top").alias("node"), F.lit(None).cast("string").alias("carried"), F.lit(None).cast("binary").alias("changed"))


def roots(blocks: list[DataFrame], height: int = HEIGHT) -> DataFrame:
    """(tree, root) of every tree."""
    out = None
    for tier in blocks:
        part = tier.where(F.col("n") <= 1 << height).select("tree", F.col("top").alias("root"))
        out = part if out is None else out.unionByName(part)
    return out


def _ways(height: int):
    """Blocks with ``above`` (the way from their top to the root) to the ways of their leaves."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("above", pa.binary())])
        for part in parts:
            for b in part.to_pylist():
                top = height if b["n"] > 1 << height else levels(b["n"])
                first = b["block"] << height
                yield pa.RecordBatch.from_pylist([{"tree": b["tree"], "index": first + i, "above": way(b["log"], b["count"], top, i) + b["above"]} for i in range(b["count"])], schema=schema)

    return read


def with_ways(blocks: list[DataFrame], above_trees: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The lowest tier's blocks with ``above``, the way from their top to the root. ``above_trees`` (tree, above) leads from trees' roots on."""
    lower = None  # (tree, index, above) of the nodes of the tier below
    for tier in reversed(blocks):
        ready = tier.where(F.col("n") <= 1 << height).join(above_trees, "tree")
        if lower is None:
            found = ready
        else:
            found = ready.unionByName(tier.where(F.col("n") > 1 << height).join(lower.withColumnRenamed("index", "block"), ["tree", "block"]).select(ready.columns))
        if tier is blocks[0]:
            return found
        slim = found.select("tree", "block", "n", "count", "log", "above")
        lower = materialize(slim.mapInArrow(_ways(height), "tree string, index long, above binary"), "merkle-ways")


_PROOF = pa.schema([("tree", pa.string()), ("carried", pa.string()), ("node", pa.binary()), ("proof_sha256", pa.string()), ("folded", pa.binary())])


def _prover(height: int):
    def prove(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for b in part.to_pylist():
                top = height if b["n"] > 1 << height else levels(b["n"])
                out = []
                for i, (carried, changed) in enumerate(zip(b["carried"], b["changed"], strict=True)):
                    p = place(b["count"], 0, i) * SIZE
                    node = b["log"][p : p + SIZE]
                    path = way(b["log"], b["count"], top, i) + b["above"]
                    out.append({"tree": b["tree"], "carried": carried, "node": node, "proof_sha256": join(siblings(path)).hex(), "folded": fold(changed or node, path)})
                yield pa.RecordBatch.from_pylist(out, schema=_PROOF)

    return prove


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf covers doc_id, source, lang, n_chars and text. The leaves of a language ascend by doc_id (null first, rows
    with equal ids by their leaf); a null language is one of its own, the first. Where 7 divides crc32(doc_id), never for null ids,
    n_chars is raised by 1 before the proof is folded; a null stays. Empty texts and nulls differ. Repeated
    rows are leaves each. Other columns are ignored; an empty table gives an empty result.
    """
    c = {k: F.col(k) for k in ("doc_id", "source", "lang", "text")}
    chars = F.col("n_chars").cast("long")
    parts = lambda n: leaf(c["doc_id"].cast("long"), c["source"], c["lang"], n, c["text"])
    tampered = F.crc32(c["doc_id"].cast("long").cast("string").cast("binary")) % 7 == 0
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), c["lang"]), F.lit("")).alias("tree"),
        c["doc_id"].cast("long").alias("doc_id"),
        F.unhex(parts(chars)).alias("node"),
        F.when(tampered, F.unhex(parts((chars.cast("decimal(20,0)") + 1).cast("decimal(20,0)")))).alias("changed"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = materialize(rows, "merkle-rows")
    leaves = number(rows, "tree", ["doc_id", "node", "row"]).withColumn("carried", F.col("doc_id").cast("string"))
    blocks = tiers(leaves, height)
    subroots = materialize(roots(blocks, height).withColumn("all", F.lit("")), "merkle-subroots")
    over = number(subroots, "all", ["tree"]).select(F.col("all").alias("tree"), "index", "n", F.col("root").alias("node"), F.col("tree").alias("carried"), F.lit(None).cast("binary").alias("changed"))
    upper = tiers(over, height)
    whole = roots(upper, height).select(F.col("root"))  # one row at most
    start = subroots.select(F.lit("").alias("tree"), F.lit(b"").alias("above")).distinct()
    ways = with_ways(upper, start, height).select("tree", "block", "n", "count", "log", "above", "carried").mapInArrow(_tree_ways(height), "tree string, above binary")
    ways = materialize(ways, "merkle-tree-ways")
    proofs = with_ways(blocks, ways, height).mapInArrow(_prover(height), "tree string, carried string, node binary, proof_sha256 string, folded binary")
    out = proofs.join(subroots.select("tree", F.col("root").alias("sub")), "tree").crossJoin(F.broadcast(whole))
    text = lambda x: F.lower(F.hex(x))
    return out.select(
        F.col("carried").cast("long").alias("doc_id"),
        text("node").alias("leaf"),
        text("sub").alias("subroot"),
        text("root").alias("root"),
        "proof_sha256",
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


def _tree_ways(height: int):
    """Blocks of the tree over all trees to (tree, above): the way of each tree's root."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("tree", pa.string()), ("above", pa.binary())])
        for part in parts:
            for b in part.to_pylist():
                top = height if b["n"] > 1 << height else levels(b["n"])
                yield pa.RecordBatch.from_pylist([{"tree": t, "above": way(b["log"], b["count"], top, i) + b["above"]} for i, t in enumerate(b["carried"])], schema=schema)

    return read


def op13_merkle(spark, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text"))


ORACLE_SQL = r"""
with recursive rows as (
  select doc_id, coalesce('=' || lang, '') as tree,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') as head,
    n_chars, coalesce(strlen(text) || ':' || text, '-') as tail,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384::bigint))), 4294967295::bigint) % 7 = 0 as tampered
  from documents),
leaves as (
  select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    sha256(head || case when n_chars is null then '-' when tampered then strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1) else strlen(n_chars::varchar) || ':' || n_chars end || tail) as changed from rows),
indexed as (select *, row_number() over w - 1 as i, count(*) over (partition by tree) as n from leaves window w as (partition by tree order by doc_id nulls first, leaf)),
nodes as (
  select tree, 0 as level, i, n, leaf as h from indexed
  union all
  select tree, level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) from (select *, lead(h) over (partition by tree, level order by i) as other from nodes) where n > 1 and i % 2 = 0),
subs as (select tree, h as subroot, row_number() over (order by tree) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, i, n, subroot as h from subs
  union all
  select level + 1, i // 2, (n + 1) // 2, sha256(h || coalesce(other, '')) from (select *, lead(h) over (partition by level order by i) as other from tops) where n > 1 and i % 2 = 0),
ways as (
  select d.doc_id, d.leaf, d.changed, d.tree, x.level as step, s.h as other, (d.i >> x.level) % 2 = 1 as left_of
  from indexed d join (select distinct tree, level from nodes where n > 1) x using (tree) left join nodes s on s.tree = d.tree and s.level = x.level and s.i = xor(d.i >> x.level, 1)
  union all
  select d.doc_id, d.leaf, d.changed, d.tree, 1000 + x.level, s.h, (t.i >> x.level) % 2 = 1
  from indexed d join subs t using (tree) cross join (select distinct level from tops where n > 1) x left join tops s on s.level = x.level and s.i = xor(t.i >> x.level, 1)),
steps as (select *, row_number() over (partition by tree, doc_id, leaf order by step) as k from ways),
folded as (
  select tree, doc_id, leaf, 0 as k, changed as h from indexed
  union all
  select f.tree, f.doc_id, f.leaf, f.k + 1, sha256(case when s.other is null then f.h when s.left_of then s.other || f.h else f.h || s.other end)
  from folded f join steps s on s.tree = f.tree and s.doc_id is not distinct from f.doc_id and s.leaf = f.leaf and s.k = f.k + 1),
ends as (select tree, doc_id, leaf, arg_max(h, k) as folded_root from folded group by 1, 2, 3),
proofs as (select tree, doc_id, leaf, sha256(coalesce(string_agg(other, '' order by k) filter (where other is not null), '')) as proof_sha256 from steps group by 1, 2, 3)
select e.doc_id, e.leaf, t.subroot, r.h as root, coalesce(p.proof_sha256, sha256('')) as proof_sha256, e.folded_root, e.folded_root = r.h as verified
from ends e join subs t using (tree) left join proofs p on p.tree = e.tree and p.doc_id is not distinct from e.doc_id and p.leaf = e.leaf, tops r where r.n = 1
"""
