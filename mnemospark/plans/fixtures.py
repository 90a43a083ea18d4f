"""Views over the given tables, in Spark and as DuckDB text with the same arithmetic.

Derived columns are pure functions of ids. Times are without a zone; ``AS_OF`` is the fixed "now".
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-02-01 00:00:00"

#: {days x}: AS_OF minus x days. {ts}: the literal AS_OF. The rest is common SQL.
_VIEWS = {
    "v_memory": """select doc_id as id, text, 'doc::' || doc_id as source, lang, cast((doc_id * 37) % 100 as double) / 100 as score,
      cast((doc_id * 53) % 100 as double) / 100 as trust_score, cast(doc_id % 13 as bigint) as retrievals, doc_id % 17 = 0 as pinned,
      <days (doc_id * 7) % 90> as created_at, <days (doc_id * 7) % 90> as updated_at,
      case when doc_id % 5 = 0 then null else <days (doc_id * 3) % 45> end as last_accessed,
      case doc_id % 4 when 0 then 'fresh' when 1 then 'recent' when 2 then 'old' else 'archived' end as age_tier,
      case when doc_id % 19 = 0 then 'archived' else 'active' end as status,
      case when doc_id % 11 = 0 then <days (doc_id % 40) - 10> end as expires_at,
      case when doc_id % 23 = 0 then <days -3> end as valid_from, case when doc_id % 29 = 0 then <days 1> end as valid_until,
      doc_id % 7 as owner_id, case doc_id % 3 when 0 then 'private' when 1 then 'team' else 'shared' end as visibility,
      case when doc_id % 6 = 0 then null else substr(text, 1, 40) end as compressed_text,
      case doc_id % 5 when 0 then 'durable' when 1 then 'operational' when 2 then 'audit' when 3 then 'ephemeral' else 'other' end as retention_class
      from documents""",
    "v_query": "select item_id as query_id, text as query from benchmark",
    "v_vector": "select vec_id, embedding, label from embeddings",
    "v_event": """select event_id, ts, user_id, event_type, value, props, k,
      case event_type when 'click' then 'recall' when 'purchase' then 'store' when 'view' then 'tool' when 'signup' then 'boot' else 'other' end as operation,
      cast(floor(value) as bigint) as saved, k as served, cast(floor(value) as bigint) + k as baseline, k % 3 as hits, 'u' || user_id as agent
      from (select *, cast(json_extract_string(props, '$.k') as bigint) as k from events)""",
    "v_feedback": """select event_id as id, 'doc::' || (user_id % 10) as result_source, cast(case when event_id % 3 = 0 then 1.0 else -0.5 end as double) as signal, ts as created_at,
      'u' || user_id as agent from events""",
    "v_outcome": """select event_id as id, 'u' || user_id as agent, case when event_type in ('purchase', 'signup') then 'success' when event_type = 'error' then 'failure' else 'partial' end as outcome,
      cast(case when event_type in ('purchase', 'signup') then 1.0 when event_type = 'error' then 0.0 else 0.5 end as double) as outcome_score,
      cast(event_id % 100 as double) / 100 as quality_score, cast(floor(value) as bigint) as latency_ms, event_id % 3 as retries,
      case when event_id % 4 = 0 then 'baseline' else 'assisted' end as task_class, ts as created_at, event_id % 50 as tokens_used,
      '["doc::' || (user_id % 10) || '","doc::' || (event_id % 7) || '"]' as memory_sources from events""",
    "v_history": """select user_id, ts, event_id, event_type || (cast(json_extract_string(props, '$.k') as bigint) % 5) as query from events""",
    "v_task": """select o_orderkey as task_id, case when o_orderpriority like '1-%' then 'critical' when o_orderpriority like '2-%' then 'high' when o_orderpriority like '3-%' then 'medium' else 'low' end as priority,
      case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'claimed' end as status, o_custkey % 3 as capability, o_orderdate as created_at from orders""",
    "v_rating": """select doc_id as item_id, r as rater, case when (doc_id * (r + 3)) % 10 < 6 then 'correct' when (doc_id * (r + 3)) % 10 < 9 then 'incorrect' else 'ambiguous' end as verdict,
      cast((doc_id * 31 + r * 7) % 900 as bigint) as latency_ms, lang as category from documents cross join (values (0), (1), (2)) raters(r)""",
    "v_turn": "select conv_id, turn, role, text, conv_id * 60 + turn as minute from conversations",
}
_SPARK = {
    "json_extract_string": "get_json_object",
}


def _days(text: str, spark: bool) -> str:
    out, at = [], 0
    while (i := text.find("<days ", at)) >= 0:
        j = text.index(">", i)
        x = text[i + 6 : j]
        out.append(text[at:i] + (f"(timestamp_ntz'{AS_OF}' - make_dt_interval(cast({x} as int)))" if spark else f"(timestamp '{AS_OF}' - to_days(cast({x} as integer)))"))
        at = j + 1
    return "".join(out) + text[at:]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; nothing is registered."""
    text = _days(_VIEWS[name], True)
    for old, new in _SPARK.items():
        text = text.replace(old, new)
    table = next(t for t in ("documents", "benchmark", "embeddings", "events", "orders", "conversations") if f"from {t}" in text)
    return spark.sql(text.replace(f"from {table}", "from {" + table + "}"), **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def duck(*names: str) -> str:
    """A WITH clause, open at its end, that defines the views in DuckDB."""
    return "with " + ", ".join(f"{n} as ({_days(_VIEWS[n], False)})" for n in names)
