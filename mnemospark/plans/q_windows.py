"""Queries of rankings, caps and trends."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.operators import aggregates as agg
from mnemospark.operators import windows as op
from mnemospark.plans.fixtures import AS_OF, duck, view


def _mem(s, d):
    return view(s, d, "v_memory")


def _ev(s, d):
    return view(s, d, "v_event")


def _daily(s, d):
    return agg.rollup_hourly(_ev(s, d)).groupBy("day").agg(F.sum("saved").alias("saved"))


def _candidates(s, d):
    # results of 20 queries: every entry is a candidate of one query, with two scores from its id
    return _mem(s, d).select((F.col("id") % 20).alias("query_id"), "source", "id", ((F.col("id") * 7919) % 1000 / 1000.0).alias("relevance"), ((F.col("id") * 104729) % 997 / 997.0).alias("other"), (F.col("id") % 6).alias("matched"), F.lit(6).alias("terms"))


def wn01(s, d):
    c = _candidates(s, d)
    lists = c.select("query_id", F.lit("keyword").alias("list"), "id", F.col("relevance").alias("score")).unionByName(c.select("query_id", F.lit("semantic").alias("list"), "id", F.col("other").alias("score"))).unionByName(c.select("query_id", F.lit("off").alias("list"), "id", F.col("other").alias("score")))
    return op.rrf(lists, {"keyword": 1.2, "semantic": 0.85, "off": 0.0}).select("query_id", "id", F.round("rrf", 9).alias("rrf"))


def wn05(s, d):
    caps = s.createDataFrame([("click", 100), ("error", 20)], "event_type string, cap int")
    return op.keep_latest(_ev(s, d), ["event_type"], [F.desc("ts"), F.desc("event_id")], caps=caps).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("oldest"))


def wn06(s, d):
    return op.trim_overflow(_ev(s, d), 5000, ["purchase", "signup"]).select("event_id", "event_type")


def wn07(s, d):
    batch, rest = op.oldest_batch(_ev(s, d), 300)
    return batch.select("event_id", F.lit("batch").alias("part")).unionByName(rest.select("event_id", F.lit("rest").alias("part")))


def wn13(s, d):
    tables = {"memory": _mem(s, d).select("id", F.col("created_at").alias("ts")), "event": _ev(s, d).select(F.col("event_id").alias("id"), "ts"), "task": view(s, d, "v_task").select(F.col("task_id").alias("id"), F.col("created_at").alias("ts"))}
    return op.timeline(tables).select("kind", "id")


def wn14(s, d):
    families = _mem(s, d).select(F.col("source").alias("member"), F.concat(F.lit("crystal::"), (F.col("id") % 40).cast("string")).alias("head")).where("substr(member, -1) in ('1', '2', '3')")
    return op.collapse_families(_candidates(s, d), families).select("query_id", "source", F.round("relevance", 6).alias("relevance"), "best", F.array_join("members", ",").alias("members"))


def wn18(s, d):
    hits = _candidates(s, d).where("relevance > 0.9").select("id")
    return op.reinforce(_mem(s, d), hits).select("id", "retrievals", F.round("score", 9).alias("score"))


def _ranking(s, d, score):
    return op.top_k(_candidates(s, d), 10, score=score).select("query_id", "source", "rank")


def wn20(s, d):
    c = _candidates(s, d)
    out = op.fuse_rerank(c.select("query_id", "source", "relevance"), c.select("query_id", "source", F.col("other").alias("rerank")), 10)
    return out.select("query_id", "source", F.round("relevance", 6).alias("relevance"), "rank")


def wn21(s, d):
    c = _candidates(s, d).select("query_id", F.concat(F.lit("doc::"), (F.col("id") % 90).cast("string")).alias("source"), F.concat(F.lit("t"), (F.col("id") % 3).cast("string")).alias("excerpt"), (F.col("id") % 4).alias("call"), F.col("id").alias("rank"))
    return op.merge_calls(c).select("query_id", "source", "excerpt", "rank")


QUERIES = {
    "wn01_rrf": wn01,
    "wn02_top_k": lambda s, d: op.top_k(_candidates(s, d), 5).select("query_id", "source", "rank"),
    "wn03_keyword_confident": lambda s, d: op.keyword_confident(_candidates(s, d)),
    "wn04_best_per_source": lambda s, d: op.best_per_source(_candidates(s, d).withColumn("source", F.concat(F.lit("s"), (F.col("id") % 100).cast("string")))),
    "wn05_keep_latest": wn05,
    "wn06_trim_overflow": wn06,
    "wn07_oldest_batch": wn07,
    "wn08_cumulative": lambda s, d: op.cumulative(_daily(s, d)),
    "wn09_hit_trend": lambda s, d: op.hit_trend(_ev(s, d)),
    "wn10_predict_next": lambda s, d: op.predict_next(view(s, d, "v_history"), least=2),
    "wn11_next_task": lambda s, d: op.next_task(view(s, d, "v_task")).select("capability", "task_id", "priority"),
    "wn12_rank_context": lambda s, d: op.rank_context(_mem(s, d), 3, AS_OF, ("owner_id",)).select("owner_id", "rank", "id", F.round("total", 6).alias("total")),
    "wn13_timeline": wn13,
    "wn14_collapse_families": wn14,
    "wn18_reinforce": wn18,
    "wn19_compare_rankings": lambda s, d: op.compare_rankings(_ranking(s, d, "relevance"), _ranking(s, d, "other"), 10),
    "wn20_fuse_rerank": wn20,
    "wn21_merge_calls": wn21,
    "wn22_newest": lambda s, d: op.keep_latest(_ev(s, d), ["agent"], [F.desc("ts"), F.desc("event_id")], 3).select("agent", "event_id"),
    "wn23_trend": lambda s, d: op.trend(_daily(s, d)),
    "wn24_pick_rules": lambda s, d: op.pick_rules(_mem(s, d), "(?i)th"),
    "st01_entries": lambda s, d: _mem(s, d).select(F.lit("memory").alias("kind"), "id", F.length("text").cast("long").alias("n")).unionByName(view(s, d, "v_turn").select(F.lit("decision").alias("kind"), F.col("conv_id").alias("id"), F.length("text").cast("long").alias("n"))),
    "st02_distinct_first": lambda s, d: op.distinct_first(_ev(s, d), ["agent", "event_type"], [F.col("ts"), F.col("event_id")]).select("agent", "event_type", "event_id"),
}

_EV, _MEM, _TASK = duck("v_event"), duck("v_memory"), duck("v_task")
_CAND = f"{_MEM}, c as (select id % 20 as query_id, source, id, (id * 7919) % 1000 / 1000.0::double as relevance, (id * 104729) % 997 / 997.0::double as other, id % 6 as matched, 6 as terms from v_memory)"
_DAILY = f"{_EV}, r as (select strftime(ts, '%Y-%m-%d') as day, sum(saved)::bigint as saved from v_event group by 1)"
_NOW = f"timestamp '{AS_OF}'"


def _step(c: str) -> str:
    h = f"floor((epoch({_NOW}) - epoch({c})) / 3600)"
    return f"case when {h} <= 1 then 1.0 when {h} <= 24 then 0.85 when {h} <= 168 then 0.6 when {h} <= 720 then 0.35 when {h} <= 2160 then 0.15 else 0.05 end::double"


SQL = {
    "wn01_rrf": f"{_CAND}, l as (select query_id, 1.2::double as w, id, row_number() over (partition by query_id order by relevance desc, id) as r from c union all select query_id, 0.85::double, id, row_number() over (partition by query_id order by other desc, id) from c) select query_id, id, round(sum(w / (60.0::double + r)), 9) as rrf from l group by 1, 2",
    "wn02_top_k": f"{_CAND}, r as (select query_id, source, row_number() over (partition by query_id order by relevance desc, source)::integer as rank from c) select * from r where rank <= 5",
    "wn03_keyword_confident": f"{_CAND}, r as (select *, row_number() over (partition by query_id order by relevance desc, source) as rn from c) select query_id, max(case when rn = 1 then relevance end) >= 0.78 and max(case when rn = 1 then relevance end) - coalesce(max(case when rn = 2 then relevance end), 0) >= 0.10 and max(case when rn = 1 then matched end) >= 4 as confident from r group by 1",
    "wn04_best_per_source": f"{_CAND} select query_id, 's' || (id % 100) as source, max(relevance) as relevance from c group by 1, 2",
    "wn05_keep_latest": f"{_EV}, r as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as rn from v_event) select event_type, count(*) as n, min(event_id) as oldest from r where rn <= case event_type when 'click' then 100 when 'error' then 20 else 1000000000 end group by 1",
    "wn06_trim_overflow": f"{_EV}, r as (select *, row_number() over (order by event_id desc) as rn from v_event where event_type not in ('purchase', 'signup')) select event_id, event_type from v_event where event_type in ('purchase', 'signup') union all select event_id, event_type from r where rn <= greatest(0, 5000 - (select count(*) from v_event where event_type in ('purchase', 'signup')))",
    "wn07_oldest_batch": f"{_EV} select event_id, case when row_number() over (order by event_id) <= 300 then 'batch' else 'rest' end as part from v_event",
    "wn08_cumulative": f"{_DAILY} select day, saved, sum(saved) over (order by day)::bigint as total from r",
    "wn09_hit_trend": f"{_EV} select strftime(ts, '%Y-%m-%d') as day, sum((hits > 0)::int)::bigint as hits, count(*) as queries, round(avg((hits > 0)::int), 6) as rate from v_event group by 1",
    "wn10_predict_next": duck("v_history")
    + ", h as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from v_history), n as (select *, lead(query) over (partition by user_id order by ts, event_id) as next from h where rn <= 50), c as (select user_id, query, next, count(*) as n, max(ts) as latest from n where next <> query group by 1, 2, 3 having count(*) >= 2), r as (select *, row_number() over (partition by user_id, query order by n desc, latest desc, next) as k from c) select user_id, query, next, n from r where k = 1",
    "wn11_next_task": f"{_TASK}, r as (select *, row_number() over (partition by capability order by list_position(['critical', 'high', 'medium', 'low'], priority), created_at, task_id) as rn from v_task where status = 'pending') select capability, task_id, priority from r where rn = 1",
    "wn12_rank_context": f"{_MEM}, t as (select *, round(0.3::double * case retention_class when 'durable' then 1.0 when 'operational' then 0.8 when 'audit' then 0.4 when 'ephemeral' then 0.2 else 0.6 end::double + 0.3::double * {_step('updated_at')} + 0.25::double * score + 0.15::double * (0.55::double * least(retrievals / 10.0::double, 1) + 0.45::double * {_step('last_accessed')}), 9) as total from v_memory), r as (select *, row_number() over (partition by owner_id order by total desc, updated_at desc, id) as rank from t) select owner_id, rank::integer as rank, id, round(total, 6) as total from r where rank <= 3",
    "wn13_timeline": f"{duck('v_memory', 'v_event', 'v_task')} select kind, id from (select 'memory' as kind, id, created_at as ts from v_memory union all select 'event', event_id, ts from v_event union all select 'task', task_id, created_at from v_task) order by ts desc, kind, id desc limit 32",
    "wn14_collapse_families": f"{_CAND}, h as (select *, case when right(source, 1) in ('1', '2', '3') then 'crystal::' || (id % 40) else source end as head from c) select query_id, head as source, round(max(relevance), 6) as relevance, arg_max(source, (relevance, source)) as best, coalesce(array_to_string(list_sort(list(source) filter (where source <> head)), ','), '') as members from h group by 1, 2",
    "wn18_reinforce": f"{_CAND} select v.id, v.retrievals + (c.relevance > 0.9)::int as retrievals, round(case when c.relevance > 0.9 then least(1.0::double, score + 0.15::double / (1.0::double + 0.1::double * retrievals)) else score end, 9) as score from v_memory v join c on v.id = c.id",
    "wn19_compare_rankings": f"{_CAND}, a as (select query_id, source, row_number() over (partition by query_id order by relevance desc, source) as r from c), b as (select query_id, source, row_number() over (partition by query_id order by other desc, source) as r from c), j as (select coalesce(x.query_id, y.query_id) as query_id, x.r as ra, y.r as rb from (select * from a where r <= 10) x full join (select * from b where r <= 10) y on x.query_id = y.query_id and x.source = y.source) select query_id, round(sum((ra is not null and rb is not null)::int) / greatest(count(ra), count(rb)), 6)::double as overlap, round(sum((ra is not null and rb is not null)::int) / count(*), 6)::double as jaccard, round(coalesce(avg(abs(ra - rb)), 0), 6) as rank_delta, coalesce(bool_or(ra = 1 and rb = 1), false) as same_first from j group by 1",
    "wn20_fuse_rerank": f"{_CAND}, r as (select *, row_number() over (partition by query_id order by relevance desc, source) as k from c), w as (select *, min(relevance) over p as lo, max(relevance) over p as hi, min(other) over p as l2, max(other) over p as h2 from r window p as (partition by query_id, k <= 10)), m as (select query_id, source, k, case when k <= 10 then lo + (0.35::double * case when hi > lo then (relevance - lo) / (hi - lo) else 0 end + 0.65::double * case when h2 > l2 then (other - l2) / (h2 - l2) else 0 end) * (hi - lo) else relevance end as rel from w) select query_id, source, round(rel, 6) as relevance, row_number() over (partition by query_id order by k > 10, round(rel, 12) desc, source)::integer as rank from m",
    "wn21_merge_calls": f"{_CAND}, x as (select query_id, 'doc::' || (id % 90) as source, 't' || (id % 3) as excerpt, id as rank, row_number() over (partition by query_id, id % 90, id % 3 order by id % 4, id) as rn from c) select query_id, source, excerpt, rank from x where rn = 1",
    "wn22_newest": f"{_EV}, r as (select *, row_number() over (partition by agent order by ts desc, event_id desc) as rn from v_event) select agent, event_id from r where rn <= 3",
    "wn23_trend": f"{_DAILY}, t as (select day, avg(saved) over (order by day rows between 6 preceding and current row) as m, max(saved) over (order by day rows between 6 preceding and current row) - min(saved) over (order by day rows between 6 preceding and current row) as s, sum(saved) over (order by day rows between 3 preceding and current row) as a, sum(saved) over (order by day rows between 7 preceding and 4 preceding) as b from r) select day, round(m, 6) as mean7, s as spread7, round(case when b > 0 then 100.0::double * (a - b) / b end, 6)::double as momentum from t",
    "wn24_pick_rules": f"{_MEM}, b as (select * from v_memory order by score desc, id limit 20) select id, left(text, 120) as rule from b where regexp_matches(text, '(?i)th') order by score desc, id limit 5",
    "st01_entries": f"{duck('v_memory', 'v_turn')} select 'memory' as kind, id, length(text) as n from v_memory union all select 'decision', conv_id, length(text) from v_turn",
    "st02_distinct_first": f"{_EV}, r as (select *, row_number() over (partition by agent, event_type order by ts, event_id) as rn from v_event) select agent, event_type, event_id from r where rn = 1",
}
