"""Conversation and document ingest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.windows import rank_within


def extract_memories(turns: DataFrame, least: int = 30, most: int = 2000, sure: float = 0.5, clip: int = 500, **signals) -> DataFrame:
    """Entries (conv_id, turn, kind, confidence, text) from users' turns that say something and are no short question."""
    c = T.classify_message(F.col("text"), **signals)
    n = F.length("text")
    rows = turns.where((F.col("role") == "user") & (n >= least) & (n <= most) & ~(F.trim("text").endswith("?") & (n < 100))).withColumn("c", c)
    cut = F.concat(F.trim(F.left("text", F.lit(clip))), F.when(n > clip, "...").otherwise(""))
    return rows.where(F.col("c.confidence") >= sure).select("conv_id", "turn", F.col("c.kind").alias("kind"), F.round("c.confidence", 6).alias("confidence"), cut.alias("text"))


def triage(turns: DataFrame, words: list[str], least: float = 0.02, much: float = 0.05) -> DataFrame:
    """Per conversation: share of the owner's words in users' turns, and whose it is: owner, other or uncertain."""
    w = T.search_keywords(F.col("text"))
    hit = F.size(F.filter(w, lambda x: x.isin(*words)))
    user = F.col("role") == "user"
    g = turns.groupBy("conv_id").agg(F.sum(F.when(user, hit).otherwise(0)).alias("hits"), F.sum(F.when(user, F.size(w)).otherwise(0)).alias("words"), F.sum(user.cast("long")).alias("turns"))
    d = F.when(F.col("words") > 0, F.col("hits") / F.col("words")).otherwise(0.0)
    return g.select("conv_id", "turns", F.round(d, 6).alias("density"), F.when(d >= much, "owner").when(d < least, "other").otherwise("uncertain").alias("whose"))


# fixed values: tools that only the owner's conversations use, and what signals are worth
OWNER_TOOLS = ("python", "browser", "dalle", "bio")
PER_DENSITY, PER_OTHER, CODE_WORTH, LONG_WORTH, TOOL_WORTH, LONG_TURNS = 8.0, 0.3, 0.3, 0.1, 0.2, 20


def triage_scores(turns: DataFrame, words: list[str], others: list[str]) -> DataFrame:
    """Per conversation of (conv_id, role, text, tool): turns, owner_score, other_score and whose it is: owner, other or uncertain.

    The owner's score grows with the share of ``words`` among the words of users' turns, with two code fences or more, over 20 turns and an owner's tool; the
    other's with the phrases of ``others`` that a user's turn holds, each once. Between the two bounds it stays uncertain. Null texts are empty.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    said = F.filter(F.split(low, r"\s+"), lambda w: w != "")
    fences = ((F.length(low) - F.length(F.replace(low, F.lit("```"), F.lit("")))) / 3).cast("long")
    rows = turns.select(
        "conv_id",
        F.when(user, F.size(said)).otherwise(0).alias("n"),
        F.when(user, F.size(F.filter(said, lambda w: w.isin(*words)))).otherwise(0).alias("hits"),
        fences.alias("fences"),
        F.coalesce(F.col("tool").isin(*OWNER_TOOLS), F.lit(False)).alias("tool"),
        *[(user & low.contains(x)).cast("int").alias(f"other_{i}") for i, x in enumerate(others)],
    )
    g = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.sum("fences").alias("fences"), F.max("tool").alias("tool"), *[F.max(f"other_{i}").alias(f"other_{i}") for i in range(len(others))])
    one = F.lit(1.0)
    owner = F.least(one, F.col("hits") / F.greatest("n", F.lit(1)) * PER_DENSITY)
    for when, worth in ((F.col("fences") >= 2, CODE_WORTH), (F.col("turns") > LONG_TURNS, LONG_WORTH), (F.col("tool"), TOOL_WORTH)):
        owner = F.when(when, F.least(one, owner + worth)).otherwise(owner)
    held = F.lit(0)
    for i in range(len(others)):
        held = held + F.col(f"other_{i}")
    scored = g.select("conv_id", "turns", F.round(owner, 9).alias("own"), F.round(F.least(one, held * PER_OTHER), 9).alias("oth"))
    label = F.when((F.col("own") >= 0.35) & (F.col("oth") < 0.2), "owner").when((F.col("oth") >= 0.2) & (F.col("own") < 0.2), "other").otherwise("uncertain")
    return scored.select("conv_id", "turns", F.round("own", 3).alias("owner_score"), F.round("oth", 3).alias("other_score"), label.alias("whose"))


def summarize_entries(entries: DataFrame, signals=T.SIGNAL_WORDS, most: int = 5, clip: int = 500) -> DataFrame:
    """Per session (session, seq, text): up to three entries joined, of more those with a signal; and the tokens saved in percent.

    Only the entries that a summary can hold are gathered; of all others their bytes are summed.
    """
    marked = entries.select("session", "seq", "text", F.coalesce(T.has_any(F.lower("text"), signals), F.lit(False)).alias("good"))
    sums = marked.groupBy("session").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.octet_length("text")).alias("bytes"), F.count("text").alias("texts"), F.max("good").alias("any"))
    order = [F.col("seq"), F.col("text")]
    picked = rank_within(marked.where("good"), ["session"], order).where(F.col("rank") <= most).unionByName(rank_within(marked, ["session"], order).where(F.col("rank") <= 3).withColumn("good", F.lit(False)))
    lists = picked.groupBy("session", "good").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]).alias("l"))
    chosen = sums.join(lists, "session").where(F.col("good") == ((F.col("entries") > 3) & F.col("any")))
    s = chosen.withColumn("summary", F.left(F.array_join("l", " | "), F.lit(clip)))
    raw = F.ceil((F.coalesce("bytes", F.lit(0)) + F.greatest(F.col("texts") - 1, F.lit(0))) / F.lit(3.8)).cast("long")
    return s.select("session", F.col("entries").cast("int").alias("entries"), "summary", F.round(F.when(raw > 0, 100.0 * (raw - T.tokens(F.col("summary"))) / raw).otherwise(0.0), 4).alias("saved"))


def chunk_text(text: str, cap: int) -> list[str]:
    """Parts of at most ``cap`` characters that end, where they can, behind the last of \\n.!?; in their last two thirds."""
    parts, at = [], 0
    while at < len(text):
        end = min(at + cap, len(text))
        if end < len(text):
            best = max(text.rfind(c, at + cap // 3, end) for c in "\n.!?;")
            end = best + 1 if best > at else end
        parts.append(text[at:end])
        at = end
    return parts


def chunk(df: DataFrame, cap: int, text: str = "text") -> DataFrame:
    """One row per chunk: the frame's columns, with text cut, and chunk from 0. Joined, chunks give the text back; null and empty texts have none."""

    @F.pandas_udf("array<string>")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: chunk_text(x or "", cap))

    return df.select("*", F.posexplode(parts(F.col(text))).alias("chunk", "__part")).drop(text).withColumnRenamed("__part", text)


def fact_snippets(turns: DataFrame, n: int, personal: str, fact: str) -> DataFrame:
    """Per conversation the n best sentences of users' turns that hold a personal word, scored by fact words, numbers and length."""
    s = turns.where("role = 'user'").select("conv_id", "turn", F.posexplode(T.sentences(F.col("text"))).alias("pos", "s"))
    low = F.lower("s")
    score = 2 * low.rlike(fact).cast("int") + low.rlike(r"\d").cast("int") + (F.length("s") > 40).cast("int")
    kept = s.where(low.rlike(personal)).withColumn("score", score)
    once = kept.withColumn("__rn", F.row_number().over(Window.partitionBy("conv_id", F.lower("s")).orderBy("turn", "pos"))).where("__rn = 1")
    best = once.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("score"), "turn", "pos"))).where(F.col("rank") <= n)
    return best.select("conv_id", "rank", "turn", "score", F.col("s").alias("snippet"))


def compact_payload(events: DataFrame, schema: str, clip: int = 64, payload: str = "data", cap: int | None = None, kind: str = "type", keep: tuple[str, ...] = (), least: tuple[str, ...] = ()) -> DataFrame:
    """JSON payloads cut to known keys, with long strings clipped.

    With ``cap`` a payload of more bytes is cut to its ``keep`` keys, and where these are too many yet to ``least``; both then say that it was truncated, the
    event's ``kind`` and how many bytes it had.
    """
    p = F.from_json(payload, schema)
    fields = [x.strip().split(" ")[:2] for x in schema.split(",")]
    cols = {k: (F.left(p[k], F.lit(clip)) if t == "string" else p[k]).alias(k) for k, t in fields}
    whole = F.to_json(F.struct(*cols.values()))
    if cap is None:
        return events.withColumn(payload, whole)
    size = F.octet_length(whole)
    told = [F.lit(True).alias("truncated"), F.col(kind).alias("type"), size.alias("bytes")]
    some, few = (F.to_json(F.struct(*told, *[cols[k] for k in names])) for names in (keep, least))
    return events.withColumn(payload, F.when(size <= cap, whole).when(F.octet_length(some) <= cap, some).otherwise(few))


def detail_rerank(results: DataFrame, bonuses: list[tuple[str, float]], terms: str = "terms") -> DataFrame:
    """Results (query_id, source, excerpt, terms) by 10 per query term held, and a bonus or penalty for each pattern."""
    low = F.lower("excerpt")
    score = 10.0 * F.size(F.filter(terms, lambda t: F.instr(low, t) > 0))
    for pattern, bonus in bonuses:
        score = score + F.when(low.rlike(pattern), bonus).otherwise(0.0)
    scored = results.withColumn("detail", score)
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("detail"), "source")))
