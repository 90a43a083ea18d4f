"""Queries of boosts and ranking scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as T
from mnemospark.operators import aggregates as agg
from mnemospark.operators import boosts as op
from mnemospark.operators.filters import at
from mnemospark.plans.fixtures import AS_OF, duck, view
from mnemospark.plans.q_windows import _candidates


def _excerpts(s, d):
    heads = view(s, d, "v_memory").select("id", F.left("text", F.lit(240)).alias("excerpt"))
    return _candidates(s, d).select("query_id", "id", "source", "relevance").join(heads, "id")


def m08(s, d, route="hybrid"):
    out = op.apply_boosts(_excerpts(s, d), view(s, d, "v_query"), route)
    return out.select("query_id", "id", "relevance", "entropy", F.round("entity", 6).alias("entity"), F.round("alignment", 6).alias("alignment"))


def m06(s, d):
    """Candidates by keyword, score, recency and retrievals, weighed by the shape of their query."""
    q = view(s, d, "v_query").select("query_id", S.ranking_weights(T.query_shape(F.col("query")), F.lit(6)).alias("w"))
    days = F.floor(S.seconds_between(at(AS_OF), F.col("created_at")) / 86400)
    m = view(s, d, "v_memory").select("id", "score", "retrievals", days.alias("days"))
    j = _candidates(s, d).join(m, "id").join(q, "query_id")
    return j.select("query_id", "id", F.round(S.lexical_score(F.col("w"), F.col("terms"), F.col("matched"), F.col("score"), F.col("days"), F.col("retrievals")), 6).alias("lexical"))


def j20(s, d):
    """Feedback boosts weighed by the likeness of the vectors of event and user; users without one get the fixed weight."""
    v = view(s, d, "v_vector").select("vec_id", "embedding")
    e = view(s, d, "v_event").select(F.col("event_id").alias("id"), "user_id")
    f = view(s, d, "v_feedback").join(e, "id")
    f = f.join(v.select((F.col("vec_id") * 3).alias("id"), F.col("embedding").alias("qv")), "id", "left").join(v.select((F.col("vec_id") * 7).alias("user_id"), F.col("embedding").alias("sv")), "user_id", "left")
    return agg.feedback_boost(f, AS_OF, weight=agg.similarity_weight(F.when(F.col("qv").isNotNull() & F.col("sv").isNotNull(), S.cosine(F.col("qv"), F.col("sv"))))).select("result_source", F.round("boost", 6).alias("boost"))


QUERIES = {"m06_lexical_score": m06, "m08_apply_boosts": m08, "m08_semantic_boosts": lambda s, d: m08(s, d, "semantic"), "j20_similarity_weight": j20}

_STOP = "(" + ", ".join(f"'{w}'" for w in op.ENTITY_STOPWORDS) + ")"
_KW = "list_filter(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 1)"
_CONTENT = "list_filter(" + _KW + ", lambda w: length(w) > 2 and w not in (" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "))"
_NAMED = f"list_distinct(list_filter(list_transform(list_filter(list_transform(regexp_split_to_array({{x}}, '[^A-Za-z0-9_./:-]+'), lambda w: regexp_replace(w, '^[^A-Za-z0-9]+|[^A-Za-z0-9]+$', '', 'g')), lambda w: regexp_matches(w, '[A-Z0-9_./:-]') or length(w) >= 9), lambda w: lower(w)), lambda w: length(w) >= 3 and w not in {_STOP}))"
_PLAIN = f"list_distinct(list_filter({_KW}, lambda w: length(w) >= 3 and w not in {_STOP}))"


def _entities(x: str) -> str:
    return f"case when len({_NAMED.format(x=x)}) > 0 then {_NAMED.format(x=x)} else {_PLAIN.format(x=x)} end"


#: CTEs: entropy of the first 240 characters of every document, and what is sought in them by each query.
HEADS = f"""hd as (select doc_id as id, left(text, 240) as ex from documents), hb as (select id, hex(encode(ex)) as hx from hd), hp as (select id, unnest(list_transform(range(0, length(hx) // 2), lambda i: substr(hx, 2 * i + 1, 2))) as c from hb),
      hn as (select id, c, count(*) as n, sum(count(*)) over (partition by id) as t from hp group by 1, 2), en as (select id, -sum(n / t * log2(n / t)) as bits from hn group by 1),
      qq as (select query_id, lower(trim(query)) as low, {_entities("query")} as wanted, list_distinct(case when len({_CONTENT.format(x="query")}) > 0 then {_CONTENT.format(x="query")} else {_KW.format(x="query")} end) as focus from v_query)"""


def lifted(table: str, rate: float, most: float, more: str = "") -> str:
    """CTE ``lift``: rows of ``table`` (query_id, id, source, r0) with relevance after the three boosts."""
    return f"""jj as (select {table}.*, coalesce(bits, 0) as bits, wanted, focus, len(list_intersect(wanted, {_entities("(source || ' ' || ex)")})) as m, len(list_filter(focus, lambda t: contains(lower(source || chr(10) || ex), t))) as hits,
        low <> '' and (contains(lower(source), low) or contains(lower(ex), low)) as exact from {table} join hd using (id) join qq using (query_id) left join en using (id)),
      kk as (select *, case when m > 0 then least({op.ENTITY_MOST}::double, m / greatest(len(wanted), 1)::double * {op.ENTITY_OVERLAP}::double + least(m, 3) * {op.ENTITY_MATCH}::double) else 0 end::double as entity,
        least({op.ALIGN_MOST}::double, case when exact then {op.ALIGN_EXACT}::double else 0 end + least(1.0::double, hits / greatest(len(focus), 1)::double) * {op.ALIGN_COVERAGE}::double) as alignment from jj),
      lift as (select query_id, id, source, {more}round(round(round(r0 * (1 + greatest(0.0::double, least({most}::double, (bits - {op.ENTROPY_FLOOR}::double) * {rate}::double))), 4) * (1 + entity), 4) * (1 + alignment), 4) as relevance, round(bits, 4)::double as entropy, round(entity, 6)::double as entity, round(alignment, 6)::double as alignment from kk)"""


#: CTE: what each query seeks.
SOUGHT = "qq as (" + HEADS.split("qq as (")[1]


def lifted_rows(table: str, rate: float, most: float, more: str = "") -> str:
    """CTEs to ``lift``: rows of ``table`` (query_id, id, source, r0, ex: the row's own excerpt) with relevance after the three boosts. Needs ``SOUGHT``."""
    entropy = f"""hb as (select ex, hex(encode(ex)) as hx from (select distinct ex from {table})), hp as (select ex, unnest(list_transform(range(0, length(hx) // 2), lambda i: substr(hx, 2 * i + 1, 2))) as c from hb),
      hn as (select ex, c, count(*) as n, sum(count(*)) over (partition by ex) as t from hp group by 1, 2), en as (select ex, -sum(n / t * log2(n / t)) as bits from hn group by 1)"""
    return entropy + ", " + lifted(table, rate, most, more).replace("join hd using (id) ", "").replace("left join en using (id)", "left join en using (ex)")


def _boosted(rate: float, most: float) -> str:
    rows = "e as (select id % 20 as query_id, id, source, (id * 7919) % 1000 / 1000.0::double as r0 from v_memory)"
    return f"{duck('v_memory', 'v_query')}, {rows}, {HEADS}, {lifted('e', rate, most)} select query_id, id, relevance, entropy, entity, alignment from lift"


_NOW = f"timestamp '{AS_OF}'"
_DOT = "list_dot_product({a}::double[], {b}::double[])"
_COS = f"{_DOT.format(a='q.embedding', b='s.embedding')} / sqrt({_DOT.format(a='q.embedding', b='q.embedding')} * {_DOT.format(a='s.embedding', b='s.embedding')})"

SQL = {
    "m08_apply_boosts": _boosted(*op.ENTROPY_RATES["hybrid"]),
    "m08_semantic_boosts": _boosted(*op.ENTROPY_RATES["semantic"]),
    "j20_similarity_weight": f"""select 'doc::' || (user_id % 10) as result_source, round(greatest(-0.2, least(0.3, sum(case when event_id % 3 = 0 then 1.0 else -0.5 end::double * (case when q.embedding is null or s.embedding is null then 0.6 else 0.2 + 0.8 * greatest(0, least(1, {_COS})) end)::double
      * pow(2.0::double, -greatest((epoch({_NOW}) - epoch(date_trunc('second', ts))) / 86400.0::double, 0) / 30.0::double)))), 6)::double as boost
      from events e left join embeddings q on q.vec_id * 3 = e.event_id left join embeddings s on s.vec_id * 7 = e.user_id group by 1""",
    "m06_lexical_score": f"""{duck("v_memory", "v_query")}, f as (select query_id, position('/' in query) > 0 or position('"' in query) > 0 or position('`' in query) > 0 or position('::' in query) > 0 or position(chr(92) in query) > 0 or len(list_filter(['.rs', '.ts', '.js', '.py'], lambda w: contains(lower(query), w))) > 0 or n <= 3 or length(trim(query)) <= 24 as e,
        n >= 8 or length(trim(query)) >= 56 or trim(query) like '%?' as nat from (select *, len(list_filter(regexp_split_to_array(trim(query), '[ \t\n]+'), lambda w: w <> '')) as n from v_query)),
      c as (select query_id, case when e and not nat then 1 when nat and not e then 2 else 3 end as c from f),
      w as (select query_id, 0.40 + [0.12, -0.08, 0][c] - 0.04 as k, 0.25 + [-0.03, 0.05, 0][c] + 0.02 as s, 0.20 + [-0.05, 0.02, 0][c] + 0.01 as y, 0.15 + [-0.04, 0.01, 0][c] + 0.01 as t from c)
      select w.query_id, id, round(((id % 6) / 6.0::double * k + score * s + 1 / (1 + floor((epoch({_NOW}) - epoch(created_at)) / 86400) / 7.0::double) * y + least(retrievals, 20) / 20.0::double * t) / (k + s + y + t)::double, 6) as lexical
      from v_memory join w on w.query_id = id % 20""",
}
