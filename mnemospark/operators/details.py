"""Detail-seeking retrieval: facts beside a result, complements that cover missing terms, and clips that keep details.

Ids of facts end in a place within their family, as in ``talk-7::fact::3``; what stands before is the family.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.windows import rank_within

# fixed values: how ids name facts, what a neighbour that adds terms is worth, what new terms and specific ones are worth
FACT = r"(?i)::fact::(\d+)$"
NEIGHBOUR, PER_TERM, TERMS_MOST, SPECIFIC = 30, 3, 6, 4


def family(doc_id: Column) -> Column:
    return F.regexp_replace(F.trim(doc_id), FACT, "")


def position(doc_id: Column) -> Column:
    """The place of a fact in its family, null for other ids."""
    return F.nullif(F.regexp_extract(F.trim(doc_id), FACT, 1), F.lit("")).try_cast("long")


def detail_score(low: Column, terms: Column, bonuses: list[tuple[str, float]], per_term: float = 10.0) -> tuple[Column, Column]:
    """(score, detail) of a lower-case text: the bonuses of the patterns it holds, and with them ``per_term`` for each query term held."""
    detail = F.lit(0.0)
    for pattern, bonus in bonuses:
        detail = detail + F.when(low.rlike(pattern), float(bonus)).otherwise(0.0)
    return per_term * F.size(F.filter(terms, lambda t: F.contains(low, t))) + detail, detail


def expand_siblings(results: DataFrame, facts: DataFrame, queries: DataFrame, places: str, generic: str, bonuses: list[tuple[str, float]], per_seed: int = 2, most: int = 6, margin: float = 8.0) -> DataFrame:
    """(query_id, rank, id, added): results (query_id, rank, id, text) followed by facts (id, text) of their families.

    For queries (query_id, terms, wants_place). A fact that is no result qualifies beside a seed if its score is within ``margin`` of
    the seed's or its detail is stronger; for queries that want places also if it holds more places (``places``, a pattern with one group)
    than the seed, other ones, or none that is ``generic`` where the seed's is. It ranks by score, more for new places, most for those next to the
    seed (place +-1 in the family). Seeds in the order of their rank take the best such neighbour, then the ``per_seed`` best facts (two more
    for places); none twice, ``most`` per query.

    Families meet their seeds by an equi-join. A seed keeps only as many candidates as the caps can reach, so the fold over a
    query's candidates is bounded by its number of seeds.
    """
    low = F.lower("text")
    shown = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(places), 1))
    seeds = results.join(queries.select("query_id", "terms", "wants_place"), "query_id")
    score, detail = detail_score(low, F.col("terms"), bonuses)
    seeds = seeds.select("query_id", "terms", "wants_place", F.col("rank").alias("seed"), family(F.col("id")).alias("family"), position(F.col("id")).alias("at"), score.alias("s0"), detail.alias("d0"), shown(low).alias("p0"), low.rlike(generic).alias("g0"))
    pool = facts.where(position(F.col("id")).isNotNull()).select(F.col("id"), low.alias("low"), family(F.col("id")).alias("family"), position(F.col("id")).alias("pos"), shown(low).alias("p1"), low.rlike(generic).alias("g1"))
    met = seeds.join(pool, "family").join(results.select("query_id", "id"), ["query_id", "id"], "left_anti")
    score, detail = detail_score(F.col("low"), F.col("terms"), bonuses)
    met = met.withColumn("s1", score).withColumn("d1", detail).withColumn("new", F.when(F.col("wants_place"), F.size(F.array_except("p1", "p0"))).otherwise(0))
    wants = F.col("wants_place")
    beside = wants & (F.abs(F.col("pos") - F.col("at")) <= 1) & (F.col("new") > 0)
    specific = wants & F.col("g0") & (F.size("p1") > 0) & ~F.col("g1")
    good = (F.col("s1") >= F.col("s0") - margin) | (F.col("d1") > F.col("d0")) | (wants & (F.size("p1") > F.size("p0"))) | specific | (F.col("new") > 0)
    beside = F.coalesce(beside, F.lit(False))
    value = F.col("s1") + F.when(beside, NEIGHBOUR).otherwise(0) + F.when(specific, SPECIFIC).otherwise(0) + F.least(F.lit(TERMS_MOST), F.col("new") * PER_TERM)
    scored = met.where(good).select("query_id", "seed", "id", "wants_place", beside.alias("beside"), value.alias("value"), "s1", "d1", F.size("p1").alias("n1"), "g1", "new")
    scored = rank_within(scored, ["query_id", "seed"], [F.desc("value"), F.desc("d1"), F.desc("n1"), F.desc("s1"), F.desc("id")], "place")
    scored = rank_within(scored, ["query_id", "seed"], [F.desc("beside"), F.col("g1"), F.desc("new"), F.desc("s1"), F.col("id")], "next")
    reach = per_seed + 3 + most  # earlier seeds may have taken ``most``
    kept = scored.where((F.col("place") <= reach) | F.col("beside") & (F.col("next") <= most + 1))

    def take(part: pd.DataFrame) -> pd.DataFrame:
        taken, limit = [], per_seed + (2 if part["wants_place"].iloc[0] else 0)
        for _, mine in part.groupby("seed", sort=True):
            if len(taken) >= most:
                break
            mine = mine[~mine["id"].isin(taken)]
            first = mine[mine["beside"]].sort_values("next").head(1)
            for x in [*first["id"], *mine.sort_values("place").head(limit)["id"]]:
                if x not in taken and len(taken) < most:
                    taken.append(x)
        return pd.DataFrame({"query_id": part["query_id"].iloc[0], "nth": range(1, len(taken) + 1), "id": taken}).astype({"query_id": "int64", "nth": "int32", "id": "str"})

    added = kept.select("query_id", "seed", "id", "wants_place", "beside", "place", "next").groupBy("query_id").applyInPandas(take, "query_id long, nth int, id string")
    last = results.groupBy("query_id").agg(F.max("rank").alias("last"))
    more = added.join(last, "query_id").select("query_id", (F.col("last") + F.col("nth")).cast("int").alias("rank"), "id", F.lit(True).alias("added"))
    return results.select("query_id", F.col("rank").cast("int").alias("rank"), "id", F.lit(False).alias("added")).unionByName(more)


def promote_complement(results: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id): the result that best adds terms the first one lacks moves up.

    ``results`` has query_id, rank, id, terms, score, question, generic and, where another family may complement, anywhere. Candidates share
    the first's family (or ``anywhere``) and hold terms the first lacks; the best is no question, stands next to the first in the family, adds the most
    terms, is not generic, has the highest score, comes first. It moves to rank 2 if the query has at most ``k`` results or looks anywhere;
    else, if it lies beyond ``k``, to rank k. The first result meets the others by a join and a query's best is an aggregate: no query's rows are gathered.
    """
    rows = results if "anywhere" in results.columns else results.withColumn("anywhere", F.lit(False))
    first = rows.where("rank = 1").select("query_id", F.col("terms").alias("t0"), family(F.col("id")).alias("f0"), position(F.col("id")).alias("at"))
    met = rows.where("rank > 1").join(first, "query_id").withColumn("new", F.size(F.array_except("terms", "t0")))
    near = F.coalesce(F.abs(position(F.col("id")) - F.col("at")) <= 1, F.lit(False)) & (family(F.col("id")) == F.col("f0"))
    order = F.struct((~F.col("question")).alias("a"), near.alias("b"), F.col("new").alias("c"), (~F.col("generic")).alias("d"), F.col("score").alias("e"), (-F.col("rank")).alias("f"))
    fit = met.where((F.col("new") > 0) & ((family(F.col("id")) == F.col("f0")) & (F.col("f0") != "") | F.col("anywhere")))
    best = fit.groupBy("query_id").agg(F.max(order).alias("x")).select("query_id", (-F.col("x.f")).alias("from"))
    sizes = rows.groupBy("query_id").agg(F.max("rank").alias("n"), F.max("anywhere").alias("any"))
    to = F.when(F.col("any") | (F.col("n") <= k), 2).when(F.col("from") > k, k).otherwise(F.col("from"))
    moves = best.join(sizes, "query_id").select("query_id", "from", to.alias("to"))
    j = rows.join(moves, "query_id", "left")
    at = F.when(F.col("rank") == F.col("from"), F.col("to")).when((F.col("rank") >= F.col("to")) & (F.col("rank") < F.col("from")), F.col("rank") + 1).otherwise(F.col("rank"))
    return j.select("query_id", at.cast("int").alias("rank"), "id")


def best_window(length: int, spans: list[tuple[int, int, int]], width: int) -> int:
    """Start of the window of ``width`` characters that holds the most: two parts of a span's weight if it touches it, a third if it holds it whole.

    Spans are (start, end, weight). A window's score changes only where one begins or ceases to touch or hold a span, so
    the changes are added up in order of place. Ties go to the first window.
    """
    last = length - width
    change: dict[int, int] = {}

    def add(low: int, high: int, value: int) -> None:
        """``value`` for windows that start at ``low`` to ``high``, both included."""
        low, high = max(low, 0), min(high, last)
        if low <= high:
            change[low] = change.get(low, 0) + value
            change[high + 1] = change.get(high + 1, 0) - value

    for start, end, weight in spans:
        add(start - width + 1, end - 1, 2 * weight)
        add(end - width, start, weight)
    score, best, at = 0, 0, 0
    for place in sorted(change):
        score += change[place]
        if score > best and place <= last:
            best, at = score, place
    return at


def clip_text(text: str, patterns: list[tuple[re.Pattern, int]], most: int) -> str:
    """At most ``most`` characters of a text around its details; without any its head and tail."""
    if len(text) <= most or most <= 0:
        return text
    if most <= 8:
        return text[:most]
    spans = [(*m.span(), weight) for pattern, weight in patterns for m in pattern.finditer(text) if m.end() > m.start()]
    width = most - 5
    if not spans:
        head = max(3, width // 2)
        return f"{text[:head].rstrip()} ... {text[len(text) - max(2, width - head):].lstrip()}"
    at = best_window(len(text), spans, width)
    chunk, left, right = text[at : at + width], at > 0, at + width < len(text)
    if left and right:
        return f"... {chunk.strip()} ..."
    return f"... {chunk.lstrip()}" if left else f"{chunk.rstrip()} ..."


def clip_detail(df: DataFrame, patterns: list[tuple[str, int]], most: int, text: str = "text", out: str = "clip") -> DataFrame:
    """Add each text's clip of at most ``most`` characters around what the patterns (regular expression, weight) find. Nulls stay."""

    @F.pandas_udf("string")
    def clipped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled = [(re.compile(p), w) for p, w in patterns]
        for batch in batches:
            yield batch.map(lambda x: None if x is None else clip_text(x, compiled, most))

    return df.withColumn(out, clipped(F.col(text)))


def query_profile(query: Column, intents: list[tuple[str, str, list[str]]]) -> Column:
    """Struct of flags, one for each intent (name, pattern, hints) that the lower-case query shows, and ``detail``: whether any does."""
    low = F.trim(F.lower(query))
    flags = {name: low.rlike(pattern) for name, pattern, _ in intents}
    any_ = F.lit(False)
    for flag in flags.values():
        any_ = any_ | flag
    return F.struct(*[flag.alias(name) for name, flag in flags.items()], any_.alias("detail"))


def query_variant(query: Column, intents: list[tuple[str, str, list[str]]], detail_hints: list[str], most_terms: int = 10) -> Column:
    """The query's sorted terms and the hints of the intents it shows, each once; null where nothing is left or it says the same as the query."""
    profile = query_profile(query, intents)
    none = F.array().cast("array<string>")
    words = lambda w: F.array(*[F.lit(x) for x in w]) if w else none
    hints = [F.when(profile[name], words(h)).otherwise(none) for name, _, h in intents]
    parts = F.array_distinct(F.concat(F.slice(F.array_sort(T.query_terms(query)), 1, most_terms), *hints, F.when(profile["detail"], words(detail_hints)).otherwise(none)))
    joined = F.array_join(parts, " ")
    return F.when((joined != "") & (joined != F.trim(F.lower(query))), joined)
