"""Readers of corpus tables, conversation exports, Markdown folders and JSONL, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemospark.operators.filters import at

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

EXPORT_SCHEMA = (
    "title string, create_time double, mapping map<string, struct<message: struct<author: struct<role: string, name: string>, content: struct<parts: array<string>>, create_time: double>>>"
)


def load_corpus(spark: SparkSession, folder: str, tables: list[str] = TABLES) -> dict[str, DataFrame]:
    """The tables of a folder; columns are pruned and filters pushed down by whoever reads them."""
    return {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in tables}


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation exports: a JSON array, or one object a line, of titled message maps."""
    return spark.read.schema(EXPORT_SCHEMA).option("multiLine", True).json(path)


def explode_conversations(exports: DataFrame, min_len: int = 30) -> DataFrame:
    """Turns (title, role, text, ts, turn) in time order; messages below ``min_len`` characters are left out."""
    numbered = exports.withColumn("conv", F.monotonically_increasing_id())
    m = numbered.select("conv", "title", F.explode(F.map_values("mapping")).alias("m")).select("conv", "title", "m.message.*")
    rows = m.select("conv", "title", F.col("author.role").alias("role"), F.trim(F.concat_ws("\n", "content.parts")).alias("text"), F.col("create_time").alias("ts"))
    rows = rows.where(F.length("text") >= min_len)
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy("conv").orderBy("ts", "role", "text"))).drop("conv")


def load_markdown(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, fields, body): front matter as a map, and the text behind it."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.regexp_replace("value", "\r\n", "\n").alias("value"))
    head = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n?", 1)
    return raw.select("path", front_matter(head).alias("fields"), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n?", "").alias("body"))


def front_matter(head):
    """Map of 'key: value' lines; quotes around values come off."""
    lines = F.filter(F.split(head, "\n"), lambda x: x.rlike(r"^[\w-]+:"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_replace(F.trim(F.regexp_replace(x, r"^[\w-]+:", "")), "^[\"']|[\"']$", "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"]))


def extract_section(df: DataFrame, header: str, text: str = "text", out: str = "section") -> DataFrame:
    """The text between a header line and the next second-level header or the end; null without the header."""
    at_ = F.instr(text, header)
    rest = F.substring(F.col(text), at_ + len(header), F.lit(2_000_000_000))
    return df.withColumn(out, F.when(at_ > 0, F.trim(F.substring_index(rest, "\n## ", 1))))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines and those that begin with # or // are skipped."""
    lines = spark.read.text(path).where(~F.trim("value").rlike(r"^(#|//|$)"))
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def export_active(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.where("status = 'active'").write.format(fmt).save(path)


def export_page(df: DataFrame, limit: int, after_id: int | None = None) -> DataFrame:
    """A page in id order behind ``after_id``, of 1 to 5000 rows, with has_more and next_id on every row."""
    n = max(1, min(5000, limit))
    page = (df if after_id is None else df.where(F.col("id") > after_id)).orderBy("id").limit(n + 1)
    w = Window.partitionBy()
    ranked = page.withColumn("__rn", F.row_number().over(Window.orderBy("id"))).withColumn("has_more", F.count(F.lit(1)).over(w) > n)
    kept = ranked.where(F.col("__rn") <= n).drop("__rn")
    return kept.withColumn("next_id", F.when(F.col("has_more"), F.max("id").over(w)))


def export_changes(df: DataFrame, since: str, as_of: str) -> DataFrame:
    """Rows changed after ``since`` and up to ``as_of``."""
    t = F.coalesce("updated_at", "created_at")
    return df.where((t > at(since)) & (t <= at(as_of)))


def import_rows(base: DataFrame, incoming: DataFrame, key: str = "source", version: str = "updated_at") -> DataFrame:
    """Base with incoming rows, latest of each key; missing columns become null; incoming wins ties."""
    both = base.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn", "__new")


def assign_owner(df: DataFrame, owner: int, visibility: str = "private") -> DataFrame:
    return df.withColumn("owner_id", F.coalesce("owner_id", F.lit(owner))).withColumn("visibility", F.coalesce("visibility", F.lit(visibility)))
