"""Queries of detail-seeking retrieval: turns are the facts of their conversation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mnemospark.operators import details as op
from mnemospark.plans.fixtures import duck, view

_PLACES, _GENERIC = r"([a-z]{2,}(?:heit|tion|ment|able))", "the"
_BONUSES = [("erth", 4.0), ("ing", 3.0), ("xx", -5.0)]
_INTENTS = [("number", "on|an", ["exact", "number"]), ("place", "th|ei", ["where", "place", "exact"]), ("name", "zzz", ["name"])]


def _facts(s, d):
    return view(s, d, "v_turn").select("conv_id", "turn", F.concat(F.lit("talk-"), "conv_id", F.lit("::fact::"), "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


def _seeds(s, d):
    """For every conversation its first and last turn, and the second of another."""
    f = _facts(s, d)
    ends = f.groupBy("conv_id").agg(F.min("turn").alias("lo"), F.max("turn").alias("hi"))
    own = f.join(ends, "conv_id").where("turn = lo or turn = hi").select(F.col("conv_id").alias("query_id"), F.when(F.col("turn") == F.col("lo"), 1).otherwise(2).alias("rank"), "id", "text")
    other = f.where("turn = 1").join(ends.select((F.col("conv_id") + 1).alias("conv_id"), F.col("conv_id").alias("query_id")), "conv_id").select("query_id", F.lit(3).alias("rank"), "id", "text")
    return own.unionByName(other)


def m35(s, d):
    queries = _facts(s, d).select(F.col("conv_id").alias("query_id")).distinct().select("query_id", F.array(F.lit("erth"), F.lit("tion"), F.lit("the")).alias("terms"), (F.col("query_id") % 2 == 0).alias("wants_place"))
    return op.expand_siblings(_seeds(s, d), _facts(s, d).select("id", "text"), queries, _PLACES, _GENERIC, _BONUSES, 1, 4)


def m42(s, d):
    f = _facts(s, d)
    rows = f.select(
        F.col("conv_id").alias("query_id"),
        F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("rank"),
        F.when(F.col("turn") % 3 == 2, F.concat(F.lit("other-"), "id")).otherwise(F.col("id")).alias("id"),
        F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(_PLACES), 1)).alias("terms"),
        (F.length("text") % 50).alias("score"),
        (F.col("turn") % 4 == 0).alias("question"),
        F.lower("text").contains(_GENERIC).alias("generic"),
        (F.col("conv_id") % 5 == 0).alias("anywhere"),
    )
    return op.promote_complement(rows, 3)


def m41(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.translate("text", "\n\t\r", "   ").alias("text"))
    return op.clip_detail(docs, [("[jqz]", 1), ("[0-9]", 2)], 160).select("doc_id", "clip")


def m40(s, d):
    q = view(s, d, "v_query")
    return q.select("query_id", op.query_profile(F.col("query"), _INTENTS).alias("p"), op.query_variant(F.col("query"), _INTENTS, ["exact detail"]).alias("variant")).select("query_id", "p.number", "p.place", "p.name", "p.detail", "variant")


QUERIES = {"m35_expand_siblings": m35, "m40_query_profile": m40, "m41_clip_detail": m41, "m42_promote_complement": m42}

_P = r"([a-z]{2,}(?:heit|tion|ment|able))"
_SHOWN = f"list_distinct(regexp_extract_all(lower(text), '{_P}', 1))"
_F = "f as (select conv_id, turn, 'talk-' || conv_id || '::fact::' || turn as id, lower(text) as low, SHOWN as p, contains(lower(text), 'the') as g, case when contains(lower(text), 'erth') then 4 else 0 end + case when contains(lower(text), 'ing') then 3 else 0 end - case when contains(lower(text), 'xx') then 5 else 0 end as d from (select conv_id, turn, coalesce(text, '') as text from conversations))".replace("SHOWN", _SHOWN)
_LESS = lambda a, b: f"len(list_filter({a}, lambda t: not list_contains({b}, t)))"

SQL = {
    "m35_expand_siblings": f"""with recursive {_F}, sc as (select *, d + 10 * len(list_filter(['erth', 'tion', 'the'], lambda t: contains(low, t))) as s from f), e as (select conv_id, min(turn) as lo, max(turn) as hi from f group by 1),
      r as (select conv_id as query_id, case when turn = lo then 1 else 2 end as rank, sc.* from sc join e using (conv_id) where turn = lo or turn = hi union all select sc.conv_id - 1, 3, sc.* from sc join e on e.conv_id = sc.conv_id - 1 where turn = 1),
      m as (select r.query_id, r.rank as seed, y.id, r.query_id % 2 = 0 as w, r.query_id % 2 = 0 and abs(y.turn - r.turn) <= 1 and {_LESS('y.p', 'r.p')} > 0 as beside, r.query_id % 2 = 0 and r.g and len(y.p) > 0 and not y.g as special,
        case when r.query_id % 2 = 0 then {_LESS('y.p', 'r.p')} else 0 end as new, y.s, y.d, len(y.p) as n, y.g, y.s >= r.s - 8 or y.d > r.d or r.query_id % 2 = 0 and len(y.p) > len(r.p) as good
        from r join sc y using (conv_id) where not exists (select 1 from r z where z.query_id = r.query_id and z.id = y.id)),
      v as (select *, s + case when beside then 30 else 0 end + case when special then 4 else 0 end + least(6, new * 3) as value from m where good or special or new > 0),
      l as (select query_id, seed, any_value(w) as w, list(id order by value desc, d desc, n desc, s desc, id desc) as p, list(id order by g, new desc, s desc, id) filter (where beside) as b, row_number() over (partition by query_id order by seed) as i from v group by 1, 2),
      t as (select distinct query_id, 0::bigint as i, []::varchar[] as taken from r union all
        select query_id, i, list_concat(taken, list_concat(one, list_filter(more, lambda x: not list_contains(one, x))))[1:4] from (
          select *, list_filter(p, lambda x: not list_contains(taken, x))[1:(case when w then 3 else 1 end)] as more from (
            select t.query_id, l.i, t.taken, l.w, l.p, coalesce(list_filter(l.b, lambda x: not list_contains(t.taken, x))[1:1], []) as one from t join l on l.query_id = t.query_id and l.i = t.i + 1))),
      x as (select query_id, arg_max(taken, i) as taken from t group by 1)
      select query_id, rank::integer as rank, id, false as added from r union all select x.query_id, ((select max(rank) from r where r.query_id = x.query_id) + k)::integer, taken[k], true from x, range(1, 5) y(k) where k <= len(taken)""",
    "m40_query_profile": f"""{duck('v_query')}, p as (select query_id, lower(query) as q, regexp_matches(lower(query), 'on|an') as number, regexp_matches(lower(query), 'th|ei') as place, contains(lower(query), 'zzz') as name, list_sort(list_distinct(regexp_extract_all(lower(query), '[a-z0-9]{{2,}}')))[1:10] as t from v_query),
      l as (select *, list_concat(list_concat(t, case when number then ['exact', 'number'] else [] end), list_concat(list_concat(case when place then ['where', 'place', 'exact'] else [] end, case when name then ['name'] else [] end), case when number or place or name then ['exact detail'] else [] end)) as a from p)
      select query_id, number, place, name, number or place or name as detail, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ' ') as variant from l""",
    "m41_clip_detail": """with d as (select doc_id, translate(text, chr(10) || chr(9) || chr(13), '   ') as text from documents), c as (select doc_id, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as i from d where length(text) > 160),
      p as (select doc_id, i, sum(case when c in ('j', 'q', 'z') then 1 when c between '0' and '9' then 2 else 0 end) over (partition by doc_id order by i rows between current row and 154 following) as n, max(i) over (partition by doc_id) as len from c),
      b as (select doc_id, arg_max(i, (n, -i)) as pos, max(n) as n, any_value(len) as len from p where i <= len - 154 group by 1)
      select d.doc_id, case when pos is null then text when n = 0 then rtrim(left(text, 77), ' ') || ' ... ' || ltrim(right(text, 78), ' ') when pos > 1 and pos + 154 < len then '... ' || trim(substr(text, pos, 155), ' ') || ' ...' when pos > 1 then '... ' || ltrim(substr(text, pos, 155), ' ') else rtrim(left(text, 155), ' ') || ' ...' end as clip
      from d left join b using (doc_id)""",
    "m42_promote_complement": f"""with f as (select conv_id as query_id, turn, row_number() over (partition by conv_id order by turn) as rank, 'talk-' || conv_id || '::fact::' || turn as fid, {_SHOWN} as terms, length(text) % 50 as score, turn % 4 = 0 as question, contains(lower(text), 'the') as generic from (select conv_id, turn, coalesce(text, '') as text from conversations)),
      r as (select *, case when turn % 3 = 2 then 'other-' || fid else fid end as id, case when turn % 3 = 2 then 'other-' else '' end || query_id as fam from f), o as (select query_id, terms as t0, fam as f0, turn as t1 from r where rank = 1),
      m as (select r.*, {_LESS('r.terms', 'o.t0')} as new, fam = f0 as same, coalesce(abs(turn - t1) <= 1, false) and fam = f0 as adj from r join o using (query_id) where rank > 1),
      b as (select query_id, arg_max(rank, (not question, adj, new, not generic, score, -rank)) as src from m where new > 0 and (same or query_id % 5 = 0) group by 1), n as (select query_id, max(rank) as n from r group by 1),
      v as (select query_id, src, case when query_id % 5 = 0 or n <= 3 then 2 when src > 3 then 3 else src end as dst from b join n using (query_id))
      select query_id, (case when rank = src then dst when rank >= dst and rank < src then rank + 1 else rank end)::integer as rank, id from r left join v using (query_id)""",
}
