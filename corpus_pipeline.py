"""Training-corpus pipeline over ``documents``: toxicity, exact dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a frame, which is
written and read again as the next stage's ``docs``. All but the last keep the columns of documents.
Rows are rows of their own, whatever their doc_id: null and repeated ones are dropped, mixed and packed like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import exact_dedup, mixing, packing, simhash, toxicity
from mnemospark.plans.scratch import materialize


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored text scores under one half; the model is fitted on the labelled rows of ``docs``."""
    model = toxicity.train(docs, _labels(spark, sf_dir))
    score = _free(docs, "score")
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).drop(score)


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column of ``docs`` bears."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def _keyed(docs: DataFrame) -> tuple[DataFrame, str, bool]:
    """``docs`` with a unique key, the key's name, and whether it is the id; rows without one or with equal ones are written with a key."""
    row = _free(docs, "row")
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        return docs.withColumn(row, F.col("doc_id").cast("long")), row, True
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row, False


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that stays of each group of equal texts."""
    rows, row, unique = _keyed(docs)
    kept = exact_dedup.dedup(rows, row_key=F.col(row)).where("kept")
    if not unique:  # rows that agree in length and id all come as kept
        kept = kept.groupBy("text_sha256").agg(F.min("row_key").alias("row_key"))
    return rows.join(kept.select(F.col("row_key").alias(row)), row, "left_semi").select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest id, nulls last, of each group of texts that share four fifths of their five-word shingles."""
    rows, row, unique = _keyed(docs)
    groups = simhash.near_classes(rows, doc_id=row)
    if unique:
        kept = groups.where("doc_id = component_id").select(F.col("doc_id").alias(row))
    else:
        named = groups.select(F.col("doc_id").alias("at"), "component_id").join(rows.select(F.col(row).alias("at"), "doc_id"), "at")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at"))
        kept = named.groupBy("component_id").agg(first.alias("first")).select(F.col("first.at").alias(row))
    return rows.join(kept, row, "left_semi").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, whole: rows of two epochs come twice."""
    rows, row, _ = _keyed(docs)
    copies = mixing.mix(rows, whole=True, key=F.col(row)).where("copies > 0")
    repeated = copies.select(F.col("row_key").alias(row), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("one")).drop("one")
    return rows.join(repeated, row).select(docs.columns)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their bins; copies of one document never share a bin."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_bins),
]
#: Toxicity scores and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; every stage reads what the one before has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
