"""Queries of filters, projections and text measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import scores as S
from mnemospark.functions import text as T
from mnemospark.operators import filters as op
from mnemospark.plans.fixtures import AS_OF, duck, view

_NOW = f"timestamp '{AS_OF}'"
_LIVE = f"status = 'active' and (expires_at is null or expires_at > {_NOW}) and (valid_from is null or valid_from <= {_NOW}) and (valid_until is null or valid_until > {_NOW})"


def _mem(spark, d):
    return view(spark, d, "v_memory")


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any(col: str, words) -> str:
    return f"len(list_filter({_sql_list(words)}, lambda w: contains({col}, w))) > 0"


def f2(spark, d):
    return op.visible_to(_mem(spark, d), spark.createDataFrame([(1,), (3,), (None,)], "caller long")).groupBy("caller", "visibility").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


def f4(spark, d):
    requests = view(spark, d, "v_event").select("event_id", F.col("agent").alias("client"), F.col("operation").alias("scope"), (F.col("k") % 3).alias("rank"))
    users = view(spark, d, "v_event").select("user_id").distinct()
    grants = users.select(F.concat(F.lit("u"), "user_id").alias("client"), F.when(F.col("user_id") % 3 == 0, "*").when(F.col("user_id") % 3 == 1, "recall").otherwise("tool").alias("scope"), (F.col("user_id") % 4).alias("rank"))
    return op.permitted(requests, grants)


def f5(spark, d):
    e = view(spark, d, "v_event")
    return op.exclude_prefix(e, "U1", [F.col("agent"), F.get_json_object("props", "$.source")]).select("event_id", "agent")


def f8(spark, d):
    yes, no = op.admit(_docs(spark, d).select("doc_id", "text"))
    return yes.select("doc_id", "quality", F.lit("admitted").alias("outcome")).unionByName(no.select("doc_id", "quality", F.lit("rejected").alias("outcome")))


QUALITY_SQL = (
    "greatest(0, least(100, case when length(trim(t)) < 10 then 0 when length(trim(t)) < 50 then 30 when length(trim(t)) < 200 then 70 else 100 end"
    f" + case when {_any('trim(t)', ['/', chr(92), '::', '()', '->'])} or {_any('lower(trim(t))', [*T.FILE_MARKS, *T.CODE_MARKS])}"
    r" or regexp_matches(trim(t), '(^|\s)(\S*[A-Za-z]\S*_\S*|\S*_\S*[A-Za-z]\S*)(\s|$)') then 20 else 0 end - case when trim(t) like '%?' then 30 else 0 end))"
)


def m1(spark, d):
    return T.entropy(_docs(spark, d), "doc_id", "text").withColumn("entropy", F.round("entropy", 6))


def m2(spark, d):
    return _docs(spark, d).select("doc_id", F.array_join(T.content_keywords(F.col("text")), " ").alias("content"), F.size(T.search_keywords(F.col("text"))).alias("n_search"))


def m4(spark, d):
    shape = T.query_shape(F.col("query"))
    q = view(spark, d, "v_query").withColumn("shape", shape).withColumn("groups", F.size(T.search_keywords(F.col("query"))))
    w, r = S.fusion_weights(F.col("shape")), S.ranking_weights(F.col("shape"), F.col("groups"))
    return q.select("query_id", "shape.exactish", "shape.naturalish", F.round(w["keyword"], 6).alias("w_keyword"), F.round(w["semantic"], 6).alias("w_semantic"), F.round(r["keyword"], 6).alias("r_keyword"), F.round(r["retrieval"], 6).alias("r_retrieval"))


def m7(spark, d):
    days = S.seconds_between(op.at(AS_OF), F.col("created_at")) / 86400.0
    return _mem(spark, d).select(
        "id",
        F.round(S.importance(F.col("score"), F.col("trust_score")), 6).alias("importance"),
        F.round(S.compound(1.0 / (60 + F.col("id") % 20), F.col("score") * 100, days), 6).alias("compound"),
        F.round(S.recency_step(S.seconds_between(op.at(AS_OF), F.col("created_at")) / 3600), 6).alias("recency"),
    )


def m10(spark, d):
    model = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("Opus A", "sonnet b", "Gemini x Pro", "gemini y", "qwen z", "other")]), (F.col("id") % 6 + 1).cast("int")))
    return _mem(spark, d).select("id", S.trust(F.col("score") * 1.2, model).alias("trust"))


def m12(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("policy", "audit", "scratch", "note", "unknown", "other")])
    r = S.retention_class(F.element_at(kinds, (F.col("id") % 6 + 1).cast("int")), F.concat(F.when(F.col("id") % 12 == 4, "never ").when(F.col("id") % 12 == 5, "temporary ").otherwise(""), F.col("text")))
    return _mem(spark, d).select("id", r.alias("retention"), S.ttl_days(r).alias("ttl_days"))


def m13(spark, d):
    raw = F.concat(F.lit(" Client-"), F.col("event_type"), F.lit("! (v1)"))
    return view(spark, d, "v_event").select("event_id", T.normalize_client(raw).alias("client"), T.normalize_depth(F.element_at(F.array(F.lit("Multi Step"), F.lit("user_stated"), F.lit(""), F.lit("x")), (F.col("k") % 4 + 1).cast("int"))).alias("depth"))


def m13_labels(spark, d):
    pick = lambda *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.col("k") % len(x) + 1).cast("int"))
    e = view(spark, d, "v_event")
    return e.select("event_id", T.normalize_outcome(pick(" OK ", "Mixed", "error", "other", None)).alias("outcome"), T.normalize_task_class(pick("  ", "Coding ", None)).alias("task_class"), T.normalize_agent(pick("Droid", " codex ", "x (y)", "", None, "a\tb"), F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("agent"))


def m14(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.redact(F.col("text")).cast("binary")).alias("digest"), (T.redact(F.col("text")) != F.col("text")).alias("redacted"))


def m15(spark, d):
    terms = F.array(F.lit("erth"), F.lit("tion"), F.lit("schen"))
    return _docs(spark, d).select("doc_id", T.excerpt(F.col("text"), terms, 120).alias("excerpt"))


_SIGNALS = ["erth", "ung", "ment", "cion"]


def m16(spark, d):
    return _docs(spark, d).select("doc_id", T.key_points(F.col("text"), _SIGNALS).alias("key_points"), T.one_liner(F.col("text")).alias("one_liner"))


def m18(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.compress(F.concat(F.lit("Let me check it\n"), "text")).cast("binary")).alias("digest"), F.length(T.compress(F.concat(F.lit("Let me check it\n"), "text"))).cast("long").alias("n"))


def m19(spark, d):
    c = T.classify_message(F.col("text"), ["erth", "tion", "hea"], ["ung", "keit"], ["ment", "elle"])
    return _docs(spark, d).select("doc_id", c["kind"].alias("kind"), F.round(c["confidence"], 6).alias("confidence"))


def m26(spark, d):
    return _docs(spark, d).select("doc_id", T.tokens(F.col("text")).alias("tokens"), F.length(T.truncate_to_tokens(F.col("text"), 100)).cast("long").alias("cut"))


def m27(spark, d):
    v = view(spark, d, "v_vector")
    other = v.where("vec_id = 0").select(F.col("embedding").alias("b"))
    return v.crossJoin(F.broadcast(other)).select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("b")), 6).alias("cosine"))


def m28(spark, d):
    v = view(spark, d, "v_vector").withColumn("s", S.quantize(F.col("embedding")))
    err = F.array_max(F.zip_with("embedding", S.dequantize(F.col("s")), lambda a, b: F.abs(a.cast("double") - b)))
    return v.select("vec_id", F.round("s.scale", 8).alias("scale"), F.aggregate("s.q", F.lit(0).cast("long"), lambda a, q: a + q).alias("q_sum"), (err <= F.col("s.scale") / 2 + 1e-12).alias("within"))


def m29(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    pairs = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("other")), "doc_id")
    j = lambda v, e=1.0: F.round(T.text_jaccard(F.col("text"), F.col("other"), v, e), 6).alias(v)
    return pairs.select("doc_id", j("ws"), j("lower2"), j("alnum3", 0.0), j("lower3"), j("terms"))


def m30(spark, d):
    return _docs(spark, d).select("doc_id", T.content_hash(F.col("text")).alias("hash"))


def m34(spark, d):
    return view(spark, d, "v_query").select("query_id", F.array_join(T.query_terms(F.concat("query", F.lit(" 東京都"))), "|").alias("terms"))


def m37(spark, d):
    stamp = F.element_at(F.array(F.lit("2024-01-0"), F.lit("bad"), F.lit("2023-12-1")), (F.col("event_id") % 3 + 1).cast("int"))
    full = F.concat(stamp, (F.col("event_id") % 9 + 1).cast("string"), F.element_at(F.array(F.lit("T05:06:07Z"), F.lit(" 05:06:07"), F.lit(" 05:06:07.250"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int")))
    return view(spark, d, "v_event").select("event_id", S.seconds_between(T.parse_ts(full), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("seconds"))


def m38(spark, d):
    p = T.parse_source(F.when(F.col("id") % 4 == 0, F.concat(F.lit("x"), "source", F.lit("y"))).otherwise(F.col("source")))
    return _mem(spark, d).select("id", p["kind"].alias("kind"), p["id"].alias("key"))


def m39(spark, d):
    days = S.seconds_between(op.at(AS_OF), F.coalesce("last_accessed", "created_at")) / 86400.0
    new = F.when(~F.col("pinned") & (days > 1), F.greatest(F.lit(0.05), F.col("score") * S.decay_factor(F.col("retrievals"), days))).otherwise(F.col("score"))
    return _mem(spark, d).select("id", F.round(new, 6).alias("score"))


QUERIES = {
    "f01_live": lambda s, d: op.live(_mem(s, d), AS_OF).select("id", "status"),
    "f02_visible_to": f2,
    "f03_with_prefix": lambda s, d: op.with_prefix(_mem(s, d).withColumn("source", F.when(F.col("id") % 2 == 0, F.col("source"))), "memory::1").select("id"),
    "f04_permitted": f4,
    "f05_exclude_prefix": f5,
    "f06_display_text": lambda s, d: _mem(s, d).select("id", op.display_text().alias("shown")),
    "f07_forget": lambda s, d: op.forget(_mem(s, d), ["Erth", "doc::7"]).select("id", "forgotten", F.round("score", 6).alias("score")),
    "f08_admit": f8,
    "f09_hash_sample": lambda s, d: op.hash_sample(_mem(s, d), ["id"], 20).select("id"),
    "f10_since": lambda s, d: op.since(view(s, d, "v_event"), "3d", "2024-01-20 00:00:00").select("event_id", "user_id"),
    "m01_entropy": m1, "m02_keywords": m2, "m04_query_shape": m4, "m07_compound": m7, "m10_trust": m10, "m12_retention": m12,
    "m13_normalize_labels": m13, "m13_task_labels": m13_labels, "m14_redact": m14, "m15_excerpt": m15, "m16_key_points": m16, "m18_compress": m18,
    "m19_classify_message": m19, "m26_tokens": m26, "m27_cosine": m27, "m28_quantize": m28, "m29_jaccard": m29,
    "m30_content_hash": m30, "m34_query_terms": m34, "m37_parse_ts": m37, "m38_parse_source": m38, "m39_decay": m39,
}

_MEM, _EV = duck("v_memory"), duck("v_event")
_ASCII = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> '')"
_SENT = r"list_filter(list_transform(regexp_split_to_array(text, '[.\n]'), lambda x: trim(x, ' ')), lambda x: strlen(x) > 5)"
_DAYS = f"(epoch({_NOW}) - epoch(created_at))"


def _set(variant: str, col: str) -> str:
    return {
        "ws": rf"list_distinct(list_filter(regexp_split_to_array({col}, '\s+'), lambda w: w <> ''))",
        "lower2": rf"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda w: length(w) > 1))",
        "lower3": rf"list_distinct(list_filter(regexp_split_to_array(lower({col}), '[^a-z0-9]+'), lambda w: length(w) > 2))",
        "alnum3": rf"list_distinct(list_filter(list_transform(regexp_split_to_array(lower({col}), '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: length(w) > 2))",
        "terms": rf"list_distinct(list_filter(list_filter(string_split(regexp_replace(lower({col}), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 2 and not list_contains({_sql_list(T.STOPWORDS)}, w)))",
    }[variant]


def _jac(variant: str, empty: str = "1.0") -> str:
    a, b = f"{variant}_a", f"{variant}_b"
    return f"round(case when len({a}) + len({b}) = 0 then {empty} else len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) end, 6)::double as {variant}"


_V = ["ws", "lower2", "alnum3", "lower3", "terms"]
_HIT = f"len(list_filter({_sql_list(['erth', 'tion', 'hea'])}, lambda w: contains(lower(text), w)))"
_HIT_P = f"len(list_filter({_sql_list(['ung', 'keit'])}, lambda w: contains(lower(text), w)))"
_HIT_F = f"len(list_filter({_sql_list(['ment', 'elle'])}, lambda w: contains(lower(text), w)))"
_RED = r"regexp_replace(regexp_replace(regexp_replace(text, 'Bearer\s+[a-f0-9]{32,}', 'Bearer [REDACTED]', 'g'), '[a-f0-9]{40,}', '[HASH_REDACTED]', 'g'), '(?i)(?:token|key|secret|password)\s*[:=]\s*\S+', '[CREDENTIAL_REDACTED]', 'g')"
_W = "case when exactish then 0.35 else 0 end"

SQL = {
    "f01_live": f"{_MEM} select id, status from v_memory where {_LIVE}",
    "f02_visible_to": f"{_MEM} select caller, visibility, count(*) as n, sum(id)::bigint as ids from v_memory, (values (1), (3)) c(caller) where owner_id = caller or visibility in ('shared', 'team') group by 1, 2",
    "f03_with_prefix": f"{_MEM} select id from v_memory where id % 2 = 1 and starts_with('memory::' || id, 'memory::1')",
    "f04_permitted": f"{_EV}, g as (select distinct 'u' || user_id as client, case user_id % 3 when 0 then '*' when 1 then 'recall' else 'tool' end as scope, user_id % 4 as rank from v_event) select event_id, agent as client, operation as scope, k % 3 as rank from v_event e where exists (select 1 from g where g.client = e.agent and (g.scope = '*' or g.scope = e.operation) and g.rank >= e.k % 3)",
    "f05_exclude_prefix": f"{_EV} select event_id, agent from v_event where not starts_with(agent, 'u1')",
    "f06_display_text": f"{_MEM} select id, case when age_tier = 'fresh' then text else coalesce(nullif(compressed_text, ''), text) end as shown from v_memory",
    "f07_forget": f"{_MEM} select id, contains(lower(text || chr(10) || source), 'erth') or contains(source, 'doc::7') as forgotten, round(score * case when contains(lower(text || chr(10) || source), 'erth') or contains(source, 'doc::7') then 0.3 else 1 end, 6)::double as score from v_memory",
    "f08_admit": f"select doc_id, quality, case when quality >= 20 then 'admitted' else 'rejected' end as outcome from (select doc_id, ({QUALITY_SQL})::integer as quality from (select doc_id, text as t from documents))",
    "f10_since": f"{_EV} select event_id, user_id from v_event where ts > timestamp '2024-01-17 00:00:00' and ts <= timestamp '2024-01-20 00:00:00'",
    "f09_hash_sample": "select doc_id as id from documents where ('0x' || substr(md5(doc_id::varchar), 1, 8))::bigint % 100 < 20",
    "m01_entropy": "with b as (select doc_id, hex(encode(text)) as h from documents), p as (select doc_id, unnest(list_transform(range(0, length(h) // 2), lambda i: substr(h, 2 * i + 1, 2))) as c from b), n as (select doc_id, c, count(*) as n, sum(count(*)) over (partition by doc_id) as t from p group by 1, 2) select doc_id, round(-sum(n / t * log2(n / t)), 6) as entropy from n group by 1",
    "m02_keywords": f"select doc_id, array_to_string(list_filter({_ASCII}, lambda w: length(w) > 2 and not list_contains({_sql_list(T.STOPWORDS)}, w)), ' ') as content, len(list_filter({_ASCII}, lambda w: length(w) > 1))::integer as n_search from documents",
    "m04_query_shape": duck("v_query")
    + rf""", q as (select query_id, trim(query) as q, len(list_filter(regexp_split_to_array(trim(query), '\s+'), lambda w: w <> '')) as n, len(list_filter(list_filter(string_split(regexp_replace(lower(query), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 1)) as g from v_query),
      f as (select *, {_any('q', [chr(34), '`', '::', '/', chr(92)])} or {_any('lower(q)', ['.rs', '.ts', '.tsx', '.js', '.py'])} or n <= 3 or length(q) <= 24 as exactish, n >= 8 or length(q) >= 56 or q like '%?' as naturalish from q),
      r as (select *, case when exactish and not naturalish then 1 when naturalish and not exactish then 2 else 3 end as c, case when g <= 1 then 1 when g >= 5 then 2 else 3 end as b from f),
      w as (select *, greatest(0.05, 0.40 + [0.12, -0.08, 0][c] + [0.05, -0.04, 0][b]) as k, greatest(0.05, 0.25 + [-0.03, 0.05, 0][c] + [0.01, 0.02, 0][b]) as s, greatest(0.05, 0.20 + [-0.05, 0.02, 0][c] + [-0.03, 0.01, 0][b]) as y, greatest(0.05, 0.15 + [-0.04, 0.01, 0][c] + [-0.03, 0.01, 0][b]) as t from r)
      select query_id, exactish, naturalish, round(1.0 + {_W} - case when naturalish then 0.15 else 0 end, 6)::double as w_keyword, round(1.0 - case when exactish then 0.15 else 0 end + case when naturalish then 0.35 else 0 end, 6)::double as w_semantic,
      round((k / (k + s + y + t))::double, 6) as r_keyword, round((t / (k + s + y + t))::double, 6) as r_retrieval from w""",
    "m07_compound": f"{_MEM} select id, round(0.65::double * score + 0.35::double * trust_score, 6) as importance, round(1.0::double / (60 + id % 20) * 0.6::double + case when score * 100 <= 1 then score * 100 else score end * 0.2::double + exp(-{_DAYS} / 86400.0::double / 30.0::double) * 0.2::double, 6) as compound, case when {_DAYS} / 3600 <= 1 then 1.0 when {_DAYS} / 3600 <= 24 then 0.85 when {_DAYS} / 3600 <= 168 then 0.6 when {_DAYS} / 3600 <= 720 then 0.35 when {_DAYS} / 3600 <= 2160 then 0.15 else 0.05 end::double as recency from v_memory",
    "m10_trust": f"{_MEM} select id, round(least(1.0::double, score * 1.2::double) * ([1.0, 0.85, 0.8, 0.6, 0.5, 0.7])[(id % 6 + 1)::int]::double, 4) as trust from v_memory",
    "m12_retention": f"""{_MEM}, r as (select id, case id % 6 when 0 then 'durable' when 1 then 'audit' when 2 then 'ephemeral' when 3 then 'operational' else case when id % 12 = 4 then 'durable' when {_any('lower(text)', S.RETENTION_PHRASES[0][1])} then 'durable' when {_any('lower(text)', S.RETENTION_PHRASES[1][1])} then 'audit' when id % 12 = 5 then 'ephemeral' else 'operational' end end as retention from v_memory)
      select id, retention, case retention when 'operational' then 90 when 'audit' then 365 when 'ephemeral' then 14 end::integer as ttl_days from r""",
    "m13_task_labels": f"{_EV} select event_id, ['success', 'partial', 'failure', null, null][(k % 5 + 1)::int] as outcome, ['general', 'coding', 'general'][(k % 3 + 1)::int] as task_class, case when event_id % 2 = 0 then ['DROID (' || event_type || ')', 'codex (' || event_type || ')', 'x (y)', null, null, null][(k % 6 + 1)::int] else ['Droid', 'codex', 'x (y)', null, null, null][(k % 6 + 1)::int] end as agent from v_event",
    "m13_normalize_labels": f"{_EV} select event_id, 'client-' || event_type as client, ['multi-step', 'user-stated', 'single-shot', 'single-shot'][(k % 4 + 1)::int] as depth from v_event",
    "m14_redact": f"select doc_id, md5({_RED}) as digest, {_RED} <> text as redacted from documents",
    "m15_excerpt": """with t as (select doc_id, text, length(text) as n, case when instr(lower(text), 'schen') > 0 then instr(lower(text), 'schen') when instr(lower(text), 'erth') > 0 then instr(lower(text), 'erth') when instr(lower(text), 'tion') > 0 then instr(lower(text), 'tion') end as hit from documents),
      s as (select *, greatest(1, least(case when hit is null then 1 else greatest(hit - 40, 1) end, n - 119)) as b from t)
      select doc_id, case when n <= 120 then text else case when b > 1 then '...' else '' end || substr(text, b, 120) || case when b + 120 <= n then '...' else '' end end as excerpt from s""",
    "m16_key_points": f"""with s as (select doc_id, text, {_SENT} as p from documents), k as (select *, array_to_string(list_concat(p[1:1], list_filter(p[2:], lambda x: {_any('lower(x)', _SIGNALS)})[1:3]), '. ') as j from s)
      select doc_id, case when len(p) <= 2 then left(text, 300) when strlen(j) > 300 then left(j, 300) || '...' else j end as key_points, left(coalesce(p[1], text), 120) as one_liner from k""",
    "m19_classify_message": f"select doc_id, case when {_HIT} >= 2 then 'decision' when {_HIT_P} >= 1 then 'preference' when {_HIT_F} >= 1 then 'fact' else 'context' end as kind, round(case when {_HIT} >= 2 then least(0.9, 0.5 + {_HIT} * 0.1) when {_HIT_P} >= 1 then least(0.85, 0.5 + {_HIT_P} * 0.15) when {_HIT_F} >= 1 then least(0.8, 0.5 + {_HIT_F} * 0.15) else 0.4 end::double, 6) as confidence from documents",
    "m26_tokens": "select doc_id, ceil(strlen(text) / 3.8::double)::bigint as tokens, (case when ceil(strlen(text) / 3.8::double) <= 100 then length(text) else least(380, length(text)) + 3 end)::bigint as cut from documents",
    "m27_cosine": "select vec_id, round(greatest(0, least(1, list_dot_product(embedding::double[], b) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(b, b))))), 6) as cosine from embeddings, (select embedding::double[] as b from embeddings where vec_id = 0)",
    "m28_quantize": "with s as (select vec_id, embedding::double[] as e, list_max(list_transform(embedding, lambda x: abs(x::double))) / 127 as scale from embeddings), q as (select *, list_transform(e, lambda x: round(x / scale)) as q from s) select vec_id, round(scale, 8) as scale, list_sum(q)::bigint as q_sum, list_max(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - q[i] * scale))) <= scale / 2 + 1e-12 as within from q",
    "m29_jaccard": "with p as (select a.doc_id, a.text as ta, b.text as tb from documents a join documents b on b.doc_id = a.doc_id + 1), s as (select doc_id, " + ", ".join(f"{_set(v, 'ta')} as {v}_a, {_set(v, 'tb')} as {v}_b" for v in _V) + ") " if False else "",
    "m30_content_hash": "with recursive c as (select doc_id, left(text, 100) as t, 0 as i, 2166136261::bigint as h from documents union all select doc_id, t, i + 1, (xor(h, unicode(substr(t, i + 1, 1))::bigint)::hugeint * 16777619 % 4294967296)::bigint from c where i < length(t)) select doc_id, h as hash from c where i = length(t)",
    "m34_query_terms": duck("v_query") + " select query_id, array_to_string(list_concat(list_filter(t, lambda x, i: list_position(t, x) = i), ['東京', '京都']), '|') as terms from (select query_id, regexp_extract_all(lower(query), '[a-z0-9]{2,}') as t from v_query)",
    "m37_parse_ts": f"""{_EV}, t as (select event_id, ['2024-01-0', 'bad', '2023-12-1'][(event_id % 3 + 1)::int] || (event_id % 9 + 1) as day, event_id % 4 as f from v_event)
      select event_id, case when f = 3 or event_id % 3 = 1 then 0 else epoch(try_cast(day as date)::timestamp)::bigint + 18367 end as seconds from t""",
    "m38_parse_source": f"{_MEM} select id, case when id % 4 = 0 then null else 'doc' end as kind, case when id % 4 = 0 then null else id end as key from v_memory",
    "m39_decay": f"{_MEM}, t as (select *, (epoch({_NOW}) - epoch(coalesce(last_accessed, created_at))) / 86400.0::double as days from v_memory) select id, round(case when not pinned and days > 1 then greatest(0.05::double, score * pow(least(1.0::double, 0.95::double + 0.005::double * least(retrievals, 10)), days)) else score end, 6) as score from t",
}
SQL["m29_jaccard"] = (
    "with p as (select a.doc_id, a.text as ta, b.text as tb from documents a join documents b on b.doc_id = a.doc_id + 1), s as (select doc_id, "
    + ", ".join(f"{_set(v, 'ta')} as {v}_a, {_set(v, 'tb')} as {v}_b" for v in _V)
    + " from p) select doc_id, "
    + ", ".join(_jac(v, "0.0" if v == "alnum3" else "1.0") for v in _V)
    + " from s"
)
