"""Boosts of retrieved rows by entropy, entities and alignment with the query, each rounded to four digits in turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as T

# fixed values: words that are no entities, the bounds and weights of the boosts
ENTITY_STOPWORDS = (
    "the a an and or for with from into this that these those what which when where why how about around there their your our have has had will would could should"
).split()
ENTITY_OVERLAP, ENTITY_MATCH, ENTITY_MOST = 0.10, 0.01, 0.12
ALIGN_EXACT, ALIGN_COVERAGE, ALIGN_MOST = 0.08, 0.07, 0.15
ENTROPY_FLOOR = 3.5
#: Rate and bound of the entropy boost by route.
ENTROPY_RATES = {"hybrid": (0.08, 0.12), "semantic": (0.05, 0.08)}


def _no_stopwords(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*ENTITY_STOPWORDS)))


def entity_terms(text: Column) -> Column:
    """Lower-case tokens that look like names: with an upper-case letter, a digit or one of _-./: inside, or nine characters and more; else all keywords."""
    parts = F.transform(F.split(text, "[^A-Za-z0-9_./:-]+"), lambda w: F.regexp_replace(w, "^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", ""))
    named = F.filter(parts, lambda w: w.rlike("[A-Z0-9_./:-]") | (F.length(w) >= 9))
    found = _no_stopwords(F.transform(named, F.lower))
    return F.when(F.size(found) > 0, found).otherwise(_no_stopwords(T.search_keywords(text)))


def entity_boost(wanted: Column, held: Column) -> Column:
    matches = F.size(F.array_intersect(wanted, held))
    boost = matches / F.greatest(F.size(wanted), F.lit(1)) * ENTITY_OVERLAP + F.least(matches, F.lit(3)) * ENTITY_MATCH
    return F.when(matches > 0, F.least(boost, F.lit(ENTITY_MOST))).otherwise(0.0)


def alignment_boost(query: Column, terms: Column, source: Column, excerpt: Column) -> Column:
    """For rows that hold the query as it stands, and by the share of its terms they hold."""
    low, held = F.lower(F.trim(query)), F.lower(F.concat_ws("\n", source, excerpt))
    exact = (F.lower(source).contains(low) | F.lower(excerpt).contains(low)) & (low != "")
    hits = F.size(F.filter(terms, lambda t: F.contains(held, t)))
    boost = F.when(exact, ALIGN_EXACT).otherwise(0.0) + F.least(hits / F.greatest(F.size(terms), F.lit(1)), F.lit(1.0)) * ALIGN_COVERAGE
    return F.least(boost, F.lit(ALIGN_MOST))


def apply_boosts(results: DataFrame, queries: DataFrame, route: str = "hybrid") -> DataFrame:
    """Results (query_id, id, source, excerpt, relevance) with relevance raised, and entropy, entity and alignment as columns.

    ``queries``: query_id, query. An excerpt's entropy is that of its bytes; excerpts that several rows share are counted once.
    """
    rate, most = ENTROPY_RATES[route]
    results = results.withColumn("excerpt", F.coalesce("excerpt", F.lit("")))
    bits = T.entropy(results.select("excerpt").distinct(), "excerpt", "excerpt")
    words = T.content_keywords(F.col("query"))
    asked = queries.select("query_id", "query", entity_terms(F.col("query")).alias("wanted"), F.array_distinct(F.when(F.size(words) > 0, words).otherwise(T.search_keywords(F.col("query")))).alias("focus"))
    j = results.join(asked, "query_id").join(bits, "excerpt")
    j = j.withColumn("entity", entity_boost(F.col("wanted"), entity_terms(F.concat_ws(" ", "source", "excerpt"))))
    j = j.withColumn("alignment", alignment_boost(F.col("query"), F.col("focus"), F.col("source"), F.col("excerpt")))
    steps = (S.clamp((F.col("entropy") - ENTROPY_FLOOR) * rate, 0.0, most), F.col("entity"), F.col("alignment"))
    for step in steps:
        j = j.withColumn("relevance", S.rounded(F.col("relevance") * (1 + step), 4))
    return j.withColumn("entropy", F.round("entropy", 4)).drop("query", "wanted", "focus")
