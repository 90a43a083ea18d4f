"""Queries of the aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import aggregates as op
from mnemospark.plans.fixtures import AS_OF, duck, view


def _ev(s, d):
    return view(s, d, "v_event")


def _out(s, d):
    return view(s, d, "v_outcome")


def _fb(s, d):
    return view(s, d, "v_feedback")


def _baskets(s, d):
    # one basket per user and day: its event types and value buckets
    e = _ev(s, d).select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("seen"), F.explode(F.array("event_type", F.concat(F.lit("k"), (F.col("k") % 20).cast("string")))).alias("item"))
    return e.groupBy("user_id", "seen").agg(F.collect_set("item").alias("items"))


_PAYLOAD = """to_json(named_struct('mode', case when event_id % 7 = 0 then 'headlines' when event_id % 7 = 1 then 'semantic' else 'balanced' end, 'cached', event_id % 11 = 0,
  'budget', baseline, 'served', served, 'saved', saved, 'results', hits, 'latency_ms', case when event_id % 5 = 0 then null else event_id % 90 end,
  'method_breakdown', named_struct('keyword', event_id % 2, 'semantic', event_id % 3, 'hybrid', case when event_id % 13 = 0 then 1 else 0 end, 'crystal', event_id % 4)))"""


def a06(s, d):
    return op.recall_stats(_ev(s, d).withColumn("data", F.expr(_PAYLOAD)))


def a07(s, d):
    stats = op.recall_stats(_ev(s, d).withColumn("data", F.expr(_PAYLOAD))).agg(F.sum("n").alias("samples"), F.max("share").alias("largest_share"), F.sum("hits").alias("hits"))
    gate = op.comparison_gate(stats, {"samples": ("min", 500), "largest_share": ("max", 5.0), "hits": ("min", 1_000_000_000)})
    return gate.select("samples", F.array_join("blockers", ",").alias("blockers"), "ready")


def a08(s, d):
    totals, _ = op.digest(_ev(s, d), "2024-01-15")
    return totals


def a08_top(s, d):
    return op.digest(_ev(s, d), "2024-01-15")[1]


def a10(s, d):
    return op.feedback_boost(_fb(s, d), AS_OF).select("result_source", F.round("boost", 6).alias("boost"))


def a20(s, d):
    m = view(s, d, "v_vector").select(F.col("label").alias("cluster_id"), F.col("embedding").alias("vector"))
    return op.centroids(m).select("cluster_id", F.posexplode("centroid").alias("i", "x")).select("cluster_id", "i", F.round("x", 6).alias("x"))


def a21(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return op.cluster_labels(docs.select(F.col("source").alias("cluster_id"), F.col("doc_id").alias("member_id"), F.explode(T.content_keywords(F.col("text"))).alias("word")))


def a23(s, d):
    daily = op.rollup_hourly(_ev(s, d)).groupBy("day").agg(F.sum("saved").alias("saved"))
    return op.throughput(daily, 7, "2024-01-20")


def a24(s, d):
    e = _ev(s, d)
    anchors = e.where("event_type = 'signup'").groupBy("agent").agg(F.max("ts").alias("anchor"))
    return op.activity_since(e, anchors)


def a27(s, d):
    e = _ev(s, d)
    name = F.concat(F.when(F.col("k") % 2 == 0, F.upper("agent")).otherwise(F.col("agent")), F.when(F.col("k") % 5 == 0, " (m)").otherwise(""))
    return op.canonical_agents(e.select(name.alias("name")).distinct())


def a18(s, d):
    return op.table_counts({t: s.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "events", "embeddings", "labels")})


def a04_rollups(s, d):
    """The first days only as a stored rollup, the others in detail."""
    e = _ev(s, d)
    old = op.rollup_hourly(e.where("ts < timestamp_ntz'2024-01-10'"))
    return op.savings(e.where("ts >= timestamp_ntz'2024-01-10'").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), old)


def a01_payload(s, d):
    e = _ev(s, d).select("ts", "agent", F.col("event_type").alias("type"), F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(F.col("saved").alias("savedTokens"), "hits"))).otherwise(F.to_json(F.struct("saved", F.col("served").alias("tokens"), F.lit("x").alias("baseline")))).alias("data"))
    keys = {"saved": ["saved", "savedTokens"], "served": ["served", "tokens"], "baseline": ["baseline", "saved"], "hits": ["hits"]}
    return op.rollup_hourly(op.payload_counters(e, {"click": "recall", "purchase": "store", "view": "tool"}, keys, AS_OF, 20))


def a08_report(s, d):
    m = view(s, d, "v_memory")
    tables = {"memories": m.where("id % 2 = 0"), "decisions": m.where("id % 2 = 1"), "events": _ev(s, d).withColumnRenamed("ts", "created_at")}
    return op.daily_report(tables, {k: tables[k] for k in ("memories", "decisions")}, _ev(s, d), "2024-01-15")


def a15_signals(s, d):
    m = view(s, d, "v_memory")
    dec = m.where("id % 2 = 1").withColumn("disputes", F.when(F.col("id") % 3 == 0, F.col("id") - 1)).withColumn("status", F.when(F.col("id") % 31 == 0, "disputed").otherwise(F.col("status")))
    kinds = F.when(F.col("event_type") == "click", "recall_query").when(F.col("event_type") == "purchase", "decision_conflict").when(F.col("event_type") == "signup", "decision_resolve").when(F.col("event_type") == "view", "consensus")
    e = _ev(s, d).select("ts", kinds.alias("kind"), (F.col("k") % 3).alias("promoted"), (F.col("k") % 2).alias("failed"))
    return op.eval_signals(m.where("id % 2 = 0"), dec, e, AS_OF, 20)


QUERIES = {
    "a15_eval_signals": a15_signals, "a08_daily_report": a08_report,
    "a04_savings_with_rollups": a04_rollups, "a01_payload_rollup": a01_payload,
    "a01_rollup_hourly": lambda s, d: op.rollup_hourly(_ev(s, d)),
    "a02_merge_rollup": lambda s, d: op.merge_rollup(op.rollup_hourly(_ev(s, d).where("event_id % 2 = 0")), op.rollup_hourly(_ev(s, d).where("event_id % 2 = 1"))),
    "a03_rollup_all": lambda s, d: op.rollup_all(_ev(s, d).where("k >= 50"), op.rollup_hourly(_ev(s, d).where("k < 50"))),
    "a04_savings": lambda s, d: op.savings(_ev(s, d).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))),
    "a05_heatmap": lambda s, d: op.heatmap(_ev(s, d)),
    "a06_recall_stats": a06,
    "a07_comparison_gate": a07,
    "a08_digest": a08,
    "a08_digest_top": a08_top,
    "a09_feedback_stats": lambda s, d: op.feedback_stats(_fb(s, d)),
    "a09_top_signals": lambda s, d: op.top_signals(_fb(s, d), AS_OF, 20),
    "a10_feedback_boost": a10,
    "a11_agent_reliability": lambda s, d: op.agent_reliability(_out(s, d), AS_OF),
    "a12_top_sources": lambda s, d: op.top_sources(_out(s, d)),
    "a13_compact_feedback": lambda s, d: op.compact_feedback(_fb(s, d), AS_OF, 20),
    "a14_recommend_k": lambda s, d: op.recommend_k(_out(s, d), AS_OF, 10),
    "a15_eval_snapshot": lambda s, d: op.eval_snapshot(_out(s, d)),
    "a16_co_occurrence": lambda s, d: op.co_occurrence(_baskets(s, d), 10),
    "a17_prune_singletons": lambda s, d: op.prune_singletons(op.co_occurrence(_baskets(s, d), 10)).select("a", "b", "n"),
    "a18_table_counts": a18,
    "a20_centroids": a20,
    "a21_cluster_labels": a21,
    "a22_baseline_tokens": lambda s, d: op.baseline_tokens(s.read.parquet(f"{d}/documents.parquet")),
    "a23_throughput": a23,
    "a24_activity_since": a24,
    "a25_pressure": lambda s, d: op.pressure(a18(s, d), 500, 5000),
    "a26_event_mix": lambda s, d: op.event_mix(_ev(s, d), 3),
    "a27_canonical_agents": a27,
}

_EV, _FB, _OUT = duck("v_event"), duck("v_feedback"), duck("v_outcome")
_NOW = f"timestamp '{AS_OF}'"
_ROLL = "select strftime(ts, '%Y-%m-%d') as day, hour(ts)::integer as hour, operation, sum(saved)::bigint as saved, sum(greatest(served, 0))::bigint as served, sum(greatest(baseline, 0))::bigint as baseline, count(*) as events, sum((hits > 0)::int)::bigint as hits, sum((hits = 0)::int)::bigint as misses from v_event group by 1, 2, 3"
_BASKETS = f"{_EV}, i as (select distinct user_id, strftime(ts, '%Y-%m-%d') as seen, unnest([event_type, 'k' || (k % 20)]) as item from v_event), r as (select *, row_number() over (partition by user_id, seen order by item) as rn from i), p as (select x.item as a, y.item as b, x.seen from r x join r y on x.user_id = y.user_id and x.seen = y.seen and x.item < y.item where x.rn <= 10 and y.rn <= 10), c as (select a, b, count(*) as n, max(seen) as last_seen from p group by 1, 2)"
_TIER = f"""{_EV}, t as (select *, case when event_id % 11 = 0 then 'cache_hit' when event_id % 7 = 0 then 'headlines' when event_id % 7 = 1 then 'semantic_only'
  when event_id % 13 = 0 or (event_id % 2 > 0 and event_id % 3 > 0) then case when event_id % 4 > 0 then 'hybrid_crystal' else 'hybrid_fusion' end
  when event_id % 2 > 0 then case when event_id % 4 > 0 then 'keyword_crystal' else 'keyword_only' end
  when event_id % 3 > 0 then case when event_id % 4 > 0 then 'semantic_crystal' else 'semantic_only' end
  when event_id % 4 > 0 then 'crystal_only' else 'unknown' end as tier from v_event),
  st as (select tier, count(*) as n, sum(greatest(baseline, 0))::bigint as budget, sum(greatest(served, 0))::bigint as spent, sum(saved)::bigint as saved, sum(hits)::bigint as hits, round(avg(case when event_id % 5 = 0 then null else event_id % 90 end), 6) as avg_latency, round(100.0::double * count(*) / sum(count(*)) over (), 4) as share from t group by 1)"""
_REL = "select {name} as name, count(*) as n, round(sum(b * w) / sum(w), 6) as reliability, sum((outcome = 'success')::int)::bigint as success, sum((outcome = 'partial')::int)::bigint as partial, sum((outcome = 'failure')::int)::bigint as failure, round(avg(greatest(latency_ms, 0)), 6) as avg_latency_ms, round(avg(retries), 6) as avg_retries from w {by}"

SQL = {
    "a01_rollup_hourly": f"{_EV} {_ROLL}",
    "a02_merge_rollup": f"{_EV} {_ROLL}",
    "a03_rollup_all": f"{_EV} select sum(saved)::bigint as saved, sum(served)::bigint as served, sum(baseline)::bigint as baseline, sum(events)::bigint as events, sum(hits)::bigint as hits, sum(misses)::bigint as misses from ({_ROLL})",
    "a04_savings": f"{_EV}, e as (select *, strftime(ts, '%Y-%m-%d') as day from v_event), g as (select coalesce(day, agent, operation) as name, case when day is not null then 'day' when agent is not null then 'agent' when operation is not null then 'operation' else 'all' end as level, sum(saved)::bigint as saved, sum(served)::bigint as served, sum(baseline)::bigint as baseline, count(*) as events from e group by grouping sets ((day), (agent), (operation), ())) select *, round(case when baseline > 0 then 100.0::double * saved / baseline else 0 end, 4)::double as percent from g",
    "a05_heatmap": f"{_EV} select dayofweek(ts)::integer as weekday, hour(ts)::integer as hour, count(*) as events from v_event group by 1, 2",
    "a06_recall_stats": f"{_TIER} select * from st",
    "a07_comparison_gate": f"{_TIER} select sum(n)::bigint as samples, 'hits,largest_share' as blockers, false as ready from st having max(share) > 5 and sum(hits) < 1000000000 and sum(n) >= 500",
    "a04_savings_with_rollups": f"""{_EV}, e as (select *, strftime(ts, '%Y-%m-%d') as day, ts < timestamp '2024-01-10' as old from v_event), g as (select coalesce(day, operation) as name, case when day is not null then 'day' when operation is not null then 'operation' else 'all' end as level, sum(saved)::bigint as saved, sum(served)::bigint as served, sum(baseline)::bigint as baseline, count(*) as events from e group by grouping sets ((day), (operation), ())
      union all select agent, 'agent', sum(saved)::bigint, sum(served)::bigint, sum(baseline)::bigint, count(*) from e where not old group by 1) select *, round(case when baseline > 0 then 100.0::double * saved / baseline else 0 end, 4)::double as percent from g""",
    "a01_payload_rollup": f"""{_EV}, p as (select ts, case event_type when 'click' then 'recall' when 'purchase' then 'store' when 'view' then 'tool' end as operation, saved, case when event_id % 3 = 0 then 0 else served end as served, case when event_id % 3 = 0 then 0 else saved end as baseline, case when event_id % 3 = 0 then hits else 0 end as hits from v_event where event_type in ('click', 'purchase', 'view') and ts > {_NOW} - to_days(20) and ts <= {_NOW})
      select strftime(ts, '%Y-%m-%d') as day, hour(ts)::integer as hour, operation, sum(saved)::bigint as saved, sum(greatest(served, 0))::bigint as served, sum(greatest(baseline, 0))::bigint as baseline, count(*) as events, sum((hits > 0)::int)::bigint as hits, sum((hits <= 0)::int)::bigint as misses from p group by 1, 2, 3""",
    "a08_daily_report": f"""{duck("v_memory", "v_event")}, x as (select case when id % 2 = 0 then 'memories' else 'decisions' end as name, strftime(created_at, '%Y-%m-%d') = '2024-01-15' as t from v_memory union all select 'events', strftime(ts, '%Y-%m-%d') = '2024-01-15' from v_event),
      r as (select id % 2 as p, source, retrievals, row_number() over (partition by id % 2 order by retrievals desc, id) as rn from v_memory where retrievals > 0), e as (select *, strftime(ts, '%Y-%m-%d') = '2024-01-15' as t from v_event)
      select 'counts' as section, name, count(*) as total, sum(t::int)::bigint as today from x group by 2 union all select case p when 0 then 'recalled memories' else 'recalled decisions' end, source, retrievals, null from r where rn <= 5
      union all select 'boots', agent, null, count(*) from e where t and operation = 'boot' group by 2 union all select 'savings', 'saved', sum(saved)::bigint, sum(case when t then saved else 0 end)::bigint from e
      union all select 'savings', 'served', sum(served)::bigint, sum(case when t then served else 0 end)::bigint from e union all select 'savings', 'baseline', sum(baseline)::bigint, sum(case when t then baseline else 0 end)::bigint from e""",
    "a15_eval_signals": f"""{duck("v_memory", "v_event")}, x as (select *, id % 2 = 0 as mem, case when id % 2 = 1 and id % 31 = 0 then 'disputed' else status end as st from v_memory), y as (select *, st = 'active' and retrievals > 0 and last_accessed >= {_NOW} - to_days(20) as hit from x),
      a as (select count(*) filter (where mem and st = 'active') as ma, count(*) filter (where not mem and st = 'active') as da, count(*) filter (where not mem and st = 'disputed' and id % 3 = 0) as oc, count(*) filter (where st = 'active' and score < 0.5 and not pinned) as dc,
        count(*) filter (where hit and mem) as mh, count(*) filter (where hit) as h, count(*) filter (where hit and mem and (score < 0.5 or expires_at <= {_NOW})) as sh, count(*) filter (where hit and trust_score < 0.5) as lh from y),
      e as (select count(*) filter (where event_type = 'purchase') as c, count(*) filter (where event_type = 'signup') as r, count(*) filter (where event_type = 'click') as q, sum(k % 3) filter (where event_type = 'view') as p, sum(k % 2) filter (where event_type = 'view') as f from v_event where ts >= {_NOW} - to_days(20))
      select ma as active_memories, da as active_decisions, oc as open_conflicts, round(oc / da, 6)::double as conflict_burden, round(dc / (ma + da), 6)::double as decay_burden, round(r / 20.0::double, 6) as resolution_velocity, round(c / q, 6)::double as contradiction_rate, round(sh / mh, 6)::double as stale_hit_rate, round(lh / h, 6)::double as low_trust_hit_rate, round(p / (p + f), 6)::double as consensus_precision from a, e""",
    "a08_digest": f"{_EV} select count(*) as total, sum((strftime(ts, '%Y-%m-%d') = '2024-01-15')::int)::bigint as today, sum((strftime(ts, '%Y-%m-%d') = '2024-01-15' and operation = 'boot')::int)::bigint as boots, sum(case when strftime(ts, '%Y-%m-%d') = '2024-01-15' then saved else 0 end)::bigint as saved_today, sum(saved)::bigint as saved from v_event",
    "a08_digest_top": f"{_EV} select agent, count(*) as n from v_event where strftime(ts, '%Y-%m-%d') = '2024-01-15' group by 1 order by 2 desc, 1 limit 5",
    "a09_feedback_stats": f"{_FB} select count(*) as total, sum((signal > 0)::int)::bigint as positive, sum((signal < 0)::int)::bigint as negative, count(distinct result_source) as sources from v_feedback",
    "a09_top_signals": f"{_FB} select result_source, sum(signal) as net, count(*) as n from v_feedback where created_at >= {_NOW} - to_days(20) group by 1 order by 2 desc, 1 limit 10",
    "a10_feedback_boost": f"{_FB} select result_source, round(greatest(-0.2, least(0.3, sum(signal * pow(2.0::double, -greatest((epoch({_NOW}) - epoch(date_trunc('second', created_at))) / 86400.0::double, 0) / 30.0::double)))), 6)::double as boost from v_feedback group by 1",
    "a11_agent_reliability": f"{_OUT}, w as (select *, 0.6::double * outcome_score + 0.4::double * quality_score as b, exp(-ln(2.0::double) / 21.0::double * (epoch({_NOW}) - epoch(created_at)) / 86400.0::double) as w from v_outcome) "
    + " union all ".join([_REL.format(name="'all'", by=""), _REL.format(name="agent", by="group by agent"), _REL.format(name="task_class", by="group by task_class")]),
    "a12_top_sources": f"{_OUT} select source, count(*) as n from (select unnest(['doc::' || (substr(agent, 2)::bigint % 10), 'doc::' || (id % 7)]) as source from v_outcome) group by 1 order by 2 desc, 1 limit 10",
    "a13_compact_feedback": f"{_FB} select id, result_source, signal, 1::bigint as merged from v_feedback where created_at >= {_NOW} - to_days(20) union all select min(id), result_source, sum(signal), count(*) from v_feedback where created_at < {_NOW} - to_days(20) group by 2",
    "a14_recommend_k": f"""{_OUT}, r as (select *, row_number() over (partition by agent, task_class order by created_at desc, id desc) as rn from v_outcome where created_at >= {_NOW} - to_days(30)),
      s as (select agent, task_class, count(*) as samples, avg((outcome = 'failure')::int) as f, avg((outcome = 'partial')::int) as p, avg((outcome = 'success')::int) as s, avg(quality_score) as q from r where rn <= 40 group by 1, 2 having count(*) >= 8)
      select agent, task_class, samples, case when f >= 0.3 or p >= 0.45 then 14 when s >= 0.75 and q >= 0.82 then 8 else 10 end::integer as k, case when f >= 0.3 or p >= 0.45 then 'raise' when s >= 0.75 and q >= 0.82 then 'reduce' else 'keep' end as reason from s""",
    "a15_eval_snapshot": f"""{_OUT}, s as (select task_class as c, avg((outcome = 'success')::int) as s, quantile_cont(latency_ms, 0.5) as l, avg(retries) as r from v_outcome group by 1)
      select round(b.s, 6) as baseline_success, round(b.l, 6)::double as baseline_median_latency, round(b.r, 6) as baseline_retries, round(a.s, 6) as assisted_success, round(a.l, 6)::double as assisted_median_latency, round(a.r, 6) as assisted_retries, round(a.s - b.s, 6) as delta_success, round(a.l - b.l, 6)::double as delta_median_latency, round(a.r - b.r, 6) as delta_retries from s a, s b where a.c = 'assisted' and b.c = 'baseline'""",
    "a16_co_occurrence": f"{_BASKETS} select * from c",
    "a17_prune_singletons": f"{_BASKETS} select a, b, n from c where n >= 2",
    "a18_table_counts": "select 'documents' as \"table\", count(*) as n from documents union all select 'events', count(*) from events union all select 'embeddings', count(*) from embeddings union all select 'labels', count(*) from labels",
    "a20_centroids": "with p as (select label, i - 1 as i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by 1, 2), n as (select label, sqrt(sum(x * x)) as n from p group by 1) select label as cluster_id, i::integer as i, round(x / n, 6) as x from p join n using (label)",
    "a21_cluster_labels": f"""with w as (select source, doc_id, unnest(list_filter(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 2 and not list_contains({"[" + ", ".join(f"'{x}'" for x in T.STOPWORDS) + "]"}, w))) as word from documents),
      z as (select source, count(distinct doc_id) as size from w group by 1), f as (select source, word, count(*) as tf, count(distinct doc_id) as df from w group by 1, 2),
      r as (select f.source, word, row_number() over (partition by f.source order by round(tf * greatest(ln(size / df), 0.1::double), 9) desc, word) as rn from f join z using (source) where df >= 0.4::double * size)
      select z.source as cluster_id, coalesce(string_agg(word, '-' order by rn), 'misc') as label from z left join r on r.source = z.source and rn <= 4 group by 1""",
    "a22_baseline_tokens": "select ceil(sum(strlen(text)) / 3.8::double)::bigint as tokens from documents",
    "a23_throughput": f"{_EV}, r as (select ts::date as day, sum(saved) as saved from v_event where ts::date <= date '2024-01-20' and ts::date > date '2024-01-13' group by 1) select sum(saved)::bigint as saved, least(7, datediff('day', min(day), date '2024-01-20') + 1)::integer as days, round((sum(saved) / least(7, datediff('day', min(day), date '2024-01-20') + 1))::double, 6) as per_day from r",
    "a24_activity_since": f"{_EV}, a as (select agent, max(ts) as anchor from v_event where event_type = 'signup' group by 1) select e.agent, event_type, count(*) as n from v_event e left join a using (agent) where event_type <> 'error' and (anchor is null or ts > anchor) group by 1, 2",
    "a25_pressure": "select *, case when n >= 5000 then 'hard' when n >= 500 then 'soft' else 'normal' end as pressure from (select 'documents' as \"table\", count(*) as n from documents union all select 'events', count(*) from events union all select 'embeddings', count(*) from embeddings union all select 'labels', count(*) from labels)",
    "a26_event_mix": f"{_EV} select event_type, count(*) as n from v_event group by 1 order by 2 desc, 1 limit 3",
    "a27_canonical_agents": f"{_EV}, n as (select distinct (case when k % 2 = 0 then upper(agent) else agent end) || (case when k % 5 = 0 then ' (m)' else '' end) as name, agent from v_event), r as (select agent, name, row_number() over (partition by agent order by not contains(name, '('), encode(name)) as rn from n) select agent as key, name from r where rn = 1",
}
