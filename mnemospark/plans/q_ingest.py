"""Queries of sources, sinks, ingest and the streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import ingest as op
from mnemospark.plans.fixtures import AS_OF, duck, view
from mnemospark.plans.q_filters import _sql_list
from mnemospark.plans.q_windows import _candidates
from mnemospark.plans.scratch import shared_dir
from mnemospark.sources import corpus as src
from mnemospark.streaming import streams as st


def _mem(s, d):
    return view(s, d, "v_memory")


def _ev(s, d):
    return view(s, d, "v_event")


def _turn(s, d):
    return view(s, d, "v_turn")


def src02(s, d):
    msg = F.struct(F.struct("role", F.lit(None).cast("string").alias("name")).alias("author"), F.struct(F.array("text").alias("parts")).alias("content"), F.col("turn").cast("double").alias("create_time"))
    exports = _turn(s, d).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string").alias("k"), F.struct(msg.alias("message")).alias("v")))).alias("mapping"))
    return src.explode_conversations(exports.select(F.concat(F.lit("c"), "conv_id").alias("title"), "mapping")).select("title", "role", "turn", F.length("text").cast("long").alias("n"))


def src04(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("# A\n\n## Notes\n"), "text", F.lit("\n## Next\nend")).alias("text"))
    return src.extract_section(docs, "## Notes").select("doc_id", F.length("section").cast("long").alias("n"))


def snk04(s, d):
    m = _mem(s, d).select("id", "source", "updated_at", "lang")
    incoming = m.where("id % 3 = 0").select((F.col("id") + 100000).alias("id"), "source", (F.col("updated_at") + F.make_dt_interval(days=F.when(F.col("id") % 2 == 0, 1).otherwise(-1))).alias("updated_at"))
    return src.import_rows(m, incoming).select("id", "source", "lang")


def m17(s, d):
    e = _turn(s, d).select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), "text")
    return op.summarize_entries(e, ["erth", "heit", "ment"])


def m20(s, d):
    return op.triage(_turn(s, d), ["the", "of", "der", "la"], 0.05, 0.12)


def m20_scores(s, d):
    turns = _turn(s, d).select("conv_id", "role", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("``` "), "text")).otherwise(F.col("text")).alias("text"), F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 1), "python").alias("tool"))
    return op.triage_scores(turns, ["the", "of", "der", "la"], ["erth th", "ung", "elle"])


def m21(s, d):
    return op.extract_memories(_turn(s, d), decision=["erth", "tion"], preference=["ung"], fact=["elle"])


def m31(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return op.chunk(docs, 1000).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def m33(s, d):
    c = _candidates(s, d).drop("terms").join(_mem(s, d).select("id", F.col("text").alias("excerpt")), "id").withColumn("terms", F.array(F.lit("erth"), F.lit("tion"), F.lit("heit")))
    return op.detail_rerank(c, [("ing", 3.0), ("&&&", -5.0)]).select("query_id", "source", "detail", "rank")


def _stream(s, d):
    raw = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    e = raw.withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    op_ = F.when(F.col("event_type") == "click", "recall").when(F.col("event_type") == "purchase", "store").when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "signup", "boot").otherwise("other")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), op_.alias("operation"), F.floor("value").cast("long").alias("saved"), F.col("k").alias("served"))


def str01(s, d):
    """The streamed rollup of the events file, each micro-batch merged additively into one table."""
    import uuid

    run = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    keys, counters = ["day", "hour", "operation"], ["saved", "served", "events"]
    rows = _stream(s, d).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"), "operation", "saved", "served", F.lit(1).cast("long").alias("events"))
    q = rows.writeStream.foreachBatch(st.merge_sink(f"{run}/table", keys, counters)).option("checkpointLocation", f"{run}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return st.read_merged(s, f"{run}/table", keys, counters)


def str05(s, d):
    import uuid

    run = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    raw = s.readStream.schema(s.read.parquet(f"{d}/events.parquet").schema).parquet(f"{d}/events.parquet*")
    bucket = F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("long") % 20).cast("string"))
    st.stream_pairs(raw.select(F.array("event_type", bucket, F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string"))).alias("items")), f"{run}/table", f"{run}/state").awaitTermination()
    return st.read_merged(s, f"{run}/table", ["a", "b"], ["n"])


def str06(s, d):
    e = _ev(s, d)
    t = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    locks = e.select(F.col("event_id").alias("lock_id"), F.concat(F.lit("p"), F.col("k").cast("string")).alias("path"), "agent", t.alias("start"), (t + 600 + F.col("k") * 60).alias("ends"))
    return st.lock_audit(locks)


def str07(s, d):
    t = F.timestamp_diff("SECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    state = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "claimed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "abandoned")
    return st.task_durations(_ev(s, d).select((F.col("event_id") % 500).alias("task"), state.alias("state"), t.alias("t")).where("state is not null"))


def str08(s, d):
    """The events as a feed that comes in three parts, the stream stopped and started again before each."""
    import uuid

    run = f"{shared_dir(s)}/feed-{uuid.uuid4().hex}"
    feed = _ev(s, d).select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.col("agent").alias("author"), F.floor(F.dayofmonth("ts") / 12).alias("part"))
    acks = s.createDataFrame([("u1", 900), ("u2", 500), ("u3", 7777), ("u4", None)], "agent string, ack_id long")
    anchors = acks.join(feed.select(F.col("id").alias("ack_id"), F.col("ts").alias("ack_ts")), "ack_id", "left").select("agent", "ack_id", "ack_ts")
    for part in range(3):
        feed.where(F.col("part") == part).select("id", "ts", "author").write.mode("append").parquet(f"{run}/feed")
        rows = s.readStream.schema("id long, ts timestamp, author string").parquet(f"{run}/feed")
        st.run_unread(rows, anchors, f"{run}/out", f"{run}/state").awaitTermination()
    return s.read.parquet(f"{run}/out").select("agent", "id")


def snk01(s, d):
    """What is written of the active rows, read back."""
    import uuid

    path = f"{shared_dir(s)}/export-{uuid.uuid4().hex}"
    src.export_active(_mem(s, d).select("id", "source", "status", "score"), path)
    return s.read.parquet(path).select("id", "source", "score")


QUERIES = {
    "snk01_export_active": snk01,
    "src01_load_corpus": lambda s, d: src.load_corpus(s, d)["documents"].groupBy("lang").agg(F.count(F.lit(1)).alias("n")),
    "src02_explode_conversations": src02,
    "src04_extract_section": src04,
    "snk02_export_page": lambda s, d: src.export_page(_mem(s, d).select("id", "source"), 100, 250),
    "snk03_export_changes": lambda s, d: src.export_changes(_mem(s, d), "2024-01-01 00:00:00", "2024-01-20 00:00:00").select("id"),
    "snk04_import_rows": snk04,
    "snk05_assign_owner": lambda s, d: src.assign_owner(_mem(s, d).withColumn("owner_id", F.when(F.col("id") % 3 == 0, F.col("owner_id"))).withColumn("visibility", F.when(F.col("id") % 4 == 0, F.col("visibility"))), 9).select("id", "owner_id", "visibility"),
    "m17_summarize_entries": m17, "m20_triage": m20, "m20_triage_scores": m20_scores, "m21_extract_memories": m21, "m31_chunk": m31,
    "m32_fact_snippets": lambda s, d: op.fact_snippets(_turn(s, d), 3, "(^| )(the|der|la|el) ", "erth|tion|heit"),
    "m33_detail_rerank": m33,
    "m36_compact_payload": lambda s, d: op.compact_payload(_ev(s, d).withColumn("data", F.to_json(F.struct("event_type", F.col("agent").alias("other"), "k"))), "event_type string, k long", 4).select("event_id", "data"),
    "m36_payload_cap": lambda s, d: op.compact_payload(_ev(s, d).withColumn("data", F.to_json(F.struct("agent", "event_type", F.repeat(F.lit("x"), F.col("k").cast("int")).alias("query"), "k"))), "agent string, event_type string, query string, k long", 90, cap=95, kind="event_type", keep=("agent", "k"), least=("agent",)).select("event_id", "data"),
    "str01_stream_rollup": str01,
    "str02_batch_dedup": lambda s, d: st.batch_dedup(_ev(s, d), ["event_type", "hits"], 600).select("event_id"),
    "str03_rate_audit": lambda s, d: st.rate_audit(_ev(s, d), 3, 7200, ["event_type", "operation"]).select("event_id", "accepted"),
    "str03_load_count": lambda s, d: st.load_count(_ev(s, d), ["event_type"], 3600).select("event_id", "load"),
    "str04_sessions": lambda s, d: st.sessions(_ev(s, d), AS_OF),
    "str05_stream_pairs": str05, "str06_lock_audit": str06, "str07_task_durations": str07, "str08_unread_stream": str08,
}

_MEM, _EV, _TURN = duck("v_memory"), duck("v_event"), duck("v_turn")
_S = "datediff('second', timestamp '2024-01-01 00:00:00', date_trunc('second', ts))"
_HIT = lambda w: f"len(list_filter({_sql_list(w)}, lambda w: contains(lower(text), w)))"
_KW = "list_filter(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 1)"

SQL = {
    "str05_stream_pairs": f"{_EV}, i as (select event_id, unnest([event_type, 'k' || (k % 20), 'u' || (user_id % 5)]) as x from v_event) select a.x as a, b.x as b, count(*) as n from i a join i b on a.event_id = b.event_id and a.x < b.x group by 1, 2",
    "src01_load_corpus": "select lang, count(*) as n from documents group by 1",
    "src02_explode_conversations": "select 'c' || conv_id as title, role, row_number() over (partition by conv_id order by turn)::integer as turn, length(trim(text, ' ')) as n from conversations where length(trim(text, ' ')) >= 30",
    "src04_extract_section": "select doc_id, length(trim(substr(text, 1, case when position(chr(10) || '## ' in text) > 0 then position(chr(10) || '## ' in text) - 1 else length(text) end), ' ')) + 1 as n from documents",
    "snk01_export_active": f"{_MEM} select id, source, score from v_memory where status = 'active'",
    "snk02_export_page": f"{_MEM}, p as (select id, source, row_number() over (order by id) as rn from v_memory where id > 250 order by id limit 101) select id, source, (select count(*) from p) > 100 as has_more, case when (select count(*) from p) > 100 then (select max(id) from p where rn <= 100) end as next_id from p where rn <= 100",
    "snk03_export_changes": f"{_MEM} select id from v_memory where updated_at > timestamp '2024-01-01' and updated_at <= timestamp '2024-01-20'",
    "snk04_import_rows": f"{_MEM} select case when id % 6 = 0 then id + 100000 else id end as id, source, case when id % 6 = 0 then null else lang end as lang from v_memory",
    "snk05_assign_owner": f"{_MEM} select id, case when id % 3 = 0 then owner_id else 9 end as owner_id, case when id % 4 = 0 then visibility else 'private' end as visibility from v_memory",
    "m17_summarize_entries": f"""{_TURN}, e as (select conv_id as session, list(text order by turn) as l from v_turn group by 1), g as (select *, list_filter(l, lambda x: len(list_filter(['erth', 'heit', 'ment'], lambda w: contains(lower(x), w))) > 0) as good from e),
      c as (select *, left(array_to_string(case when len(l) <= 3 then l when len(good) > 0 then good[1:5] else l[1:3] end, ' | '), 500) as summary, array_to_string(l, ' ') as raw from g)
      select session, len(l)::integer as entries, summary, round(case when strlen(raw) > 0 then 100.0::double * (ceil(strlen(raw) / 3.8::double) - ceil(strlen(summary) / 3.8::double)) / ceil(strlen(raw) / 3.8::double) else 0 end, 4)::double as saved from c""",
    "m20_triage": f"{_TURN}, g as (select conv_id, sum(case when role = 'user' then len(list_filter({_KW}, lambda w: w in ('the', 'of', 'der', 'la'))) else 0 end) as h, sum(case when role = 'user' then len({_KW}) else 0 end) as w, sum((role = 'user')::int)::bigint as turns from v_turn group by 1), x as (select *, case when w > 0 then h / w else 0 end::double as d from g) select conv_id, turns, round(d, 6) as density, case when d >= 0.12 then 'owner' when d < 0.05 then 'other' else 'uncertain' end as whose from x",
    "m20_triage_scores": rf"""{_TURN}, t as (select conv_id, role = 'user' as u, turn, lower(case when turn % 2 = 0 then '``` ' || text else text end) as low from v_turn),
      w as (select *, list_filter(regexp_split_to_array(low, '\s+'), lambda w: w <> '') as ws from t),
      g as (select conv_id, count(*) as turns, sum(case when u then len(ws) else 0 end) as n, sum(case when u then len(list_filter(ws, lambda w: w in ('the', 'of', 'der', 'la'))) else 0 end) as h, sum((length(low) - length(replace(low, '```', ''))) // 3) as f, bool_or(conv_id % 7 = 0 and turn = 1) as tool,
        max((u and contains(low, 'erth th'))::int) + max((u and contains(low, 'ung'))::int) + max((u and contains(low, 'elle'))::int) as o from w group by 1),
      a as (select *, least(1.0::double, h / greatest(n, 1)::double * 8) as x0 from g), b as (select *, case when f >= 2 then least(1.0::double, x0 + 0.3::double) else x0 end as x1 from a), c as (select *, case when turns > 20 then least(1.0::double, x1 + 0.1::double) else x1 end as x2 from b),
      e as (select *, round(case when tool then least(1.0::double, x2 + 0.2::double) else x2 end, 9) as own, round(least(1.0::double, o * 0.3::double), 9) as oth from c)
      select conv_id, turns, round(own, 3) as owner_score, round(oth, 3) as other_score, case when own >= 0.35 and oth < 0.2 then 'owner' when oth >= 0.2 and own < 0.2 then 'other' else 'uncertain' end as whose from e""",
    "m21_extract_memories": f"{_TURN}, c as (select *, {_HIT(['erth', 'tion'])} as h, {_HIT(['ung'])} as p, {_HIT(['elle'])} as f from v_turn where role = 'user' and length(text) between 30 and 2000 and not (trim(text) like '%?' and length(text) < 100)) select conv_id, turn, case when h >= 2 then 'decision' when p >= 1 then 'preference' else 'fact' end as kind, round(case when h >= 2 then least(0.9, 0.5 + h * 0.1) when p >= 1 then least(0.85, 0.5 + p * 0.15) else least(0.8, 0.5 + f * 0.15) end::double, 6) as confidence, trim(left(text, 500), ' ') || case when length(text) > 500 then '...' else '' end as text from c where h >= 2 or p >= 1 or f >= 1",
    "m32_fact_snippets": rf"""{_TURN}, s as (select conv_id, turn, unnest(p) as s, generate_subscripts(p, 1) as pos from (select conv_id, turn, list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda x: trim(x, ' ')), lambda x: strlen(x) > 5) as p from v_turn where role = 'user')),
      k as (select *, 2 * regexp_matches(lower(s), 'erth|tion|heit')::int + regexp_matches(lower(s), '\d')::int + (length(s) > 40)::int as score, row_number() over (partition by conv_id, lower(s) order by turn, pos) as rn from s where regexp_matches(lower(s), '(^| )(the|der|la|el) ')),
      r as (select *, row_number() over (partition by conv_id order by score desc, turn, pos)::integer as rank from k where rn = 1) select conv_id, rank, turn, score, s as snippet from r where rank <= 3""",
    "m33_detail_rerank": "with c as (select doc_id % 20 as query_id, 'doc::' || doc_id as source, 10.0::double * len(list_filter(['erth', 'tion', 'heit'], lambda w: contains(lower(text), w))) + case when contains(lower(text), 'ing') then 3 else 0 end - case when contains(text, '&&&') then 5 else 0 end as detail from documents) select query_id, source, detail::double as detail, row_number() over (partition by query_id order by detail desc, source)::integer as rank from c",
    "m36_compact_payload": f"""{_EV} select event_id, '{{"event_type":"' || left(event_type, 4) || '","k":' || k || '}}' as data from v_event""",
    "m36_payload_cap": f"""{_EV}, w as (select *, '{{"agent":"' || agent || '","event_type":"' || event_type || '","query":"' || repeat('x', least(k, 90)::int) || '","k":' || k || '}}' as j from v_event), t as (select *, '{{"truncated":true,"type":"' || event_type || '","bytes":' || strlen(j) || ',"agent":"' || agent || '"' as h from w)
      select event_id, case when strlen(j) <= 95 then j when strlen(h || ',"k":' || k || '}}') <= 95 then h || ',"k":' || k || '}}' else h || '}}' end as data from t""",
    "str01_stream_rollup": f"{_EV} select strftime(ts, '%Y-%m-%d') as day, hour(ts)::integer as hour, operation, sum(saved)::bigint as saved, sum(served)::bigint as served, count(*) as events from v_event group by 1, 2, 3",
    "str02_batch_dedup": f"{_EV}, p as (select event_id, ts, lag(ts) over (partition by event_type, hits order by ts, event_id) as prev from v_event) select event_id from p where prev is null or epoch_us(ts) - epoch_us(prev) > 600000000",
    "str03_load_count": f"{_EV}, t as (select event_id, event_type, {_S} as t from v_event) select event_id, count(*) over (partition by event_type order by t range between 3600 preceding and current row) as load from t",
    "str04_sessions": f"{_EV}, t as (select agent, event_id, ts, epoch(date_trunc('second', ts))::bigint as t from v_event), n as (select *, coalesce((t - lag(t) over w > 7200)::int, 1) as new from t window w as (partition by agent order by ts, event_id)), s as (select *, sum(new) over (partition by agent order by ts, event_id) as session from n) select agent, session::bigint as session, min(t) as started, max(t) as ended, count(*) as beats, epoch(timestamp '{AS_OF}')::bigint - max(t) < 75 as active from s group by 1, 2",
    "str08_unread_stream": f"""{_EV}, a(agent, ack) as (values ('u1', 900), ('u2', 500), ('u3', 7777), ('u4', null)), k as (select a.agent, e.ts, ack from a left join v_event e on e.event_id = ack),
      l as (select *, day(ts) // 12 as part from v_event), f as (select k.agent, event_id, row_number() over (partition by k.agent order by l.ts desc, event_id desc) as rn from k join l on k.ts is null and k.agent <> l.agent where part = 0)
      select k.agent, e.event_id as id from k join v_event e on (e.ts, e.event_id) > (k.ts, k.ack) where k.ts is not null and k.agent <> e.agent union all select agent, event_id from f where rn <= 200 union all select k.agent, event_id from k join l on k.ts is null and k.agent <> l.agent where part > 0""",
    "str06_lock_audit": f"{_EV}, l as (select event_id as id, 'p' || k as path, agent, {_S} as s, {_S} + 600 + k * 60 as e from v_event) select x.path, x.id as a, y.id as b, least(x.e, y.e) - greatest(x.s, y.s) as overlap from l x join l y on x.path = y.path and x.id < y.id and x.agent <> y.agent and x.s < y.e and y.s < x.e",
    "str07_task_durations": f"{_EV}, t as (select event_id % 500 as task, case event_type when 'view' then 'pending' when 'click' then 'claimed' when 'purchase' then 'completed' when 'error' then 'abandoned' end as state, {_S} as t from v_event where event_type <> 'signup') select task, min(t) filter (where state = 'claimed') - min(t) filter (where state = 'pending') as waited, min(t) filter (where state in ('completed', 'abandoned')) - min(t) filter (where state = 'claimed') as worked, arg_max(state, (t, state)) as last from t group by 1",
}
