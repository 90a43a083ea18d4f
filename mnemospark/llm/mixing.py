r"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Each source gets a word target: all sources share ``total`` times all words by weight, and a
target stops at ``max_epochs`` times its source's words, the excess being reshared by weight.
A source first takes all its documents in complete epochs; what is left of its target is drawn
without replacement by exponential keys ``-ln(u) / w``, smallest first, where ``w`` is the document's
quality weight and ``u`` a hash of its id, until the words drawn reach the rest. The document at the
end gives only the words still missing (``whole=True``: all or none, whichever comes nearer).

The prefix sums need no source in one task: keys fall into cells by their rank share, words are
summed per source and cell, the cells' sums are added up, and only the one cell in which the
budget ends is ordered document by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.plans.scratch import materialize


def words(text: Column) -> Column:
    r"""Number of runs of characters outside ``[\x20\x09-\x0D]``."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return (F.size(parts) - F.when(F.element_at(parts, 1) == "", 1).otherwise(0) - F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)).cast("long")


def quality_weight(chars: Column, size: Column) -> Column:
    """1 for documents of five words or more whose words have 3 to 12 characters on average, else one half."""
    mean = chars / F.greatest(size, F.lit(1))
    return F.when((size >= 5) & (mean >= 3) & (mean <= 12), F.lit(1.0)).otherwise(F.lit(0.5))


def uniform(doc_id: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the seed and the id."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), total: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """Add weight and target to ``sources`` (source, source_size and more), which has one row per source.

    Weights repeat over the sources in code-point order, null last. Raising targets by weight until none
    is above its limit is the same as one level for all sources under their limits, found by adding up the
    sources in the order in which a rising level reaches their limits.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    table = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("weight", F.element_at(table, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("most", (F.col("source_size") * max_epochs).cast("long")).withColumn("reach", F.col("most") / F.col("weight"))
    rise = Window.orderBy("reach", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    full = F.sum("most").over(rise.rowsBetween(Window.unboundedPreceding, -1))
    rest = F.sum("weight").over(rise.rowsBetween(0, Window.unboundedFollowing))
    wanted = F.lit(float(total)) * F.sum("source_size").over(every)
    level = (wanted - F.coalesce(full, F.lit(0))) / rest
    # the first source, in this order, whose limit lies above the level sets it for itself and all behind
    ranked = ranked.withColumn("level", F.when(level < F.col("reach"), level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(rise.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.coalesce(F.col("level") * F.col("weight"), F.col("most").cast("double"))
    return ranked.select(*sources.columns, "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5, 2, 1),
    total: float = 1.5,
    max_epochs: int = 2,
    seed: int = 7,
    whole: bool = False,
    cell_rows: int = 1024,
    key: Column | None = None,
) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, epochs, copies, taken, row_key (``key``).

    Null and blank texts have size 0 and take 0 words; a source of such texts has target 0. Null
    sources are a source of their own, last in order. Rows with equal ids are drawn side by side in the
    order of their size and text hash; rows that agree in all of these share a place in the order, and
    what falls to them is split among them arbitrarily. Null ids are drawn by the text hash. Other
    columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        words(F.col(text)).alias("size"),
        F.coalesce(F.length(text), F.lit(0)).alias("chars"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("tie"),
        (F.lit(None).cast("long") if key is None else key).alias("row_key"),
    )
    share = uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("tie"))), seed)
    rows = rows.withColumn("es", -F.log(share) / quality_weight(F.col("chars"), F.col("size"))).drop("chars")
    rows = materialize(rows, "mix-rows")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    aims = targets(sums, weights, total, max_epochs)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = aims.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    aims = materialize(aims.withColumnRenamed("source", "of"), "mix-targets")
    # 1 - exp(-key) lies in (0, 1) and rises with the key: it deals a source's rows into cells of about cell_rows
    cell = F.floor((F.lit(1.0) - F.exp(-F.col("es"))) * F.ceil(F.col("n") / F.lit(cell_rows)))
    dealt = rows.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("cell", cell)
    run = Window.partitionBy("of").orderBy("in_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = dealt.groupBy(F.col("source").alias("of"), F.col("cell").alias("in_cell")).agg(F.sum("size").alias("cell_size"))
    cells = materialize(cells.withColumn("below", F.coalesce(F.sum("cell_size").over(run), F.lit(0))), "mix-cells")
    placed = dealt.join(cells, F.col("source").eqNullSafe(F.col("of")) & (F.col("cell") == F.col("in_cell"))).drop("of", "in_cell")
    ends = (F.col("below") < F.col("rest")) & (F.col("below") + F.col("cell_size") > F.col("rest"))
    # one cell of each source holds the end of its budget; only there the documents' own order counts
    inner = Window.partitionBy("source", "cell").orderBy("es", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("below") + F.coalesce(F.sum("size").over(inner), F.lit(0))
    split = placed.where(ends).withColumn("before", before)
    nearest = (2 * F.col("before") + F.col("size") <= 2 * F.col("rest")).cast("long")
    part = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("rest") - F.col("before")))
    split = split.withColumn("drawn", nearest).withColumn("words", F.col("size") * nearest if whole else part).drop("before")
    inside = (F.col("below") < F.col("rest")).cast("long")
    clear = placed.where(~ends).withColumn("drawn", inside).withColumn("words", F.col("size") * inside)
    return clear.unionByName(split).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        "epochs",
        (F.col("epochs") + F.col("drawn")).alias("copies"),
        (F.col("epochs") * F.col("size") + F.col("words")).alias("taken"),
        "row_key",
    )


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, length(coalesce(text, '')) as chars
  from documents),
k as (
  select *, -ln((('0x' || substr(md5('7:' || doc_id), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double)
    / (case when size >= 5 and chars / size between 3 and 12 then 1.0 else 0.5 end)::double as es
  from d),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, 2 * source_size as most,
    ([5, 2, 1])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight from s),
l as (
  select *, most / weight as reach,
    (1.5::double * sum(source_size) over () - coalesce(sum(most) over (order by most / weight, source is null, source rows between unbounded preceding and 1 preceding), 0))::double
      / sum(weight) over (order by most / weight, source is null, source rows between current row and unbounded following) as level
  from w),
c as (select min_by(level, reach) filter (where level < reach) as level from l),
t as (
  select source, source_size, case when c.level < l.reach then c.level * weight else most end::double as target from l, c),
e as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as epochs from t),
p as (
  select k.*, e.source_size, e.target, e.epochs, floor(e.target - e.epochs * e.source_size)::bigint as rest,
    coalesce(sum(size) over (partition by k.source order by es, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from k join e on k.source is not distinct from e.source)
select doc_id, size::bigint as size, source_size, target, epochs * size + greatest(0, least(size, rest - before)) as taken from p
"""
