"""Queries of the evaluation statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import evaluate as op
from mnemospark.operators import joins
from mnemospark.plans.fixtures import duck, view
from mnemospark.plans.scratch import materialize
from mnemospark.plans.q_joins import _J9, _docs, _groups
from mnemospark.plans.q_windows import _CAND, _candidates


def _rating(s, d):
    return view(s, d, "v_rating")


def _metrics(s, d):
    """Keyword retrieval of benchmark passages, measured against the documents that quote them."""
    docs = _docs(s, d)
    groups = materialize(_groups(s, d), "term-groups")
    post = materialize(joins.term_counts(docs, groups), "term-counts")
    found = materialize(joins.keyword_candidates(groups, post, 10), "keyword-strict")
    every = found.unionByName(joins.keyword_fallback(groups, post, found, 10))
    results = every.join(docs.select("id", T.tokens(F.col("text")).alias("tokens")), "id")
    items = s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    gold = op.quotations(docs, items)
    return op.retrieval_metrics(results.select("query_id", "id", "rank", "tokens"), gold)


def e02(s, d):
    from mnemospark.operators.aggregates import gate

    m = op.summarize_metrics(_metrics(s, d)).selectExpr("stack(3, 'precision', precision, 'rr', rr, 'coverage', coverage) as (metric, value)")
    limits = s.createDataFrame([("precision", "min", 0.5), ("rr", "min", 0.01), ("coverage", "min", 0.9), ("p95", "max", 1.0)], "metric string, direction string, limit double")
    return gate(m, limits).select("metric", "direction", "limit")


def _daily_metrics(s, d, half):
    e = view(s, d, "v_event").where(f"event_id % 2 = {half}")
    return e.groupBy(F.col("operation").alias("metric")).agg(F.round(F.avg("value"), 6).alias("value"))


def e03(s, d):
    return op.regression_gate(_daily_metrics(s, d, 0).withColumn("higher_is_better", F.col("metric") < "s"), _daily_metrics(s, d, 1), 0.001)


def e04(s, d):
    limits = _daily_metrics(s, d, 1).select("metric", F.when(F.col("metric") < "s", "min").otherwise("max").alias("direction"), F.col("value").alias("limit"))
    return op.effective_limits(limits, _daily_metrics(s, d, 0))


def e05(s, d):
    e = view(s, d, "v_event").select(F.col("event_id").alias("query_id"), F.col("served").alias("tokens"), F.lit(90).alias("budget"), (F.col("event_id") % 3 + 1).alias("calls"))
    return op.token_stats(e)


def e06(s, d):
    c = _candidates(s, d)
    part = lambda m, x: c.groupBy(F.lit(m).alias("mode"), "query_id").agg(F.max(F.col(x)).alias("top1"), F.sum(F.col("id") % 89).alias("latency"), F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(x)).alias("k"), "id"))), 1, 2), lambda z: z["id"] % 2).alias("ids"))
    return op.compare_modes(part("a", "relevance").unionByName(part("b", "other")))


def e12(s, d):
    v = _rating(s, d).groupBy("rater").agg(F.sum((F.col("verdict") == "correct").cast("long")).alias("hits"), F.count(F.lit(1)).alias("n"))
    return op.wilson(v, "hits", "n")


QUERIES = {
    "e01_retrieval_metrics": _metrics,
    "e01_summary": lambda s, d: op.summarize_metrics(_metrics(s, d)),
    "e02_gate": e02, "e03_regression_gate": e03, "e04_effective_limits": e04, "e05_token_stats": e05, "e06_compare_modes": e06,
    "e07_percentiles": lambda s, d: op.percentiles(view(s, d, "v_event"), "value", 0.95),
    "e08_consensus": lambda s, d: op.consensus_verdict(_rating(s, d)),
    "e09_cohen_kappa": lambda s, d: op.cohen_kappa(_rating(s, d)),
    "e10_fleiss_kappa": lambda s, d: op.fleiss_kappa(_rating(s, d)),
    "e11_judge_report": lambda s, d: op.judge_report(_rating(s, d)),
    "e12_wilson": e12,
    "e13_proxy_agreement": lambda s, d: op.proxy_agreement(_candidates(s, d).select("query_id", "id", F.col("relevance").alias("full"), (F.col("relevance") * 0.5 + F.col("other") * 0.5).alias("proxy"))),
}

_RAT = duck("v_rating")
_M = f"""{_J9}, f2 as (select *, row_number() over (partition by query_id order by matched desc, tf desc, id)::integer as rank from h where query_id not in (select query_id from k)),
  res as (select query_id, id, rank from k union all select query_id, id, rank from f2 where rank <= 10), g as (select item_id as query_id, d.doc_id as id from benchmark b join documents d on contains(d.text, b.text)),
  per as (select r.query_id, count(*) as n, count(g.id) as hits, min(case when g.id is not null then rank end) as first, sum(ceil(strlen(x.text) / 3.8::double))::bigint as tokens from res r join documents x on x.doc_id = r.id left join g on g.query_id = r.query_id and g.id = r.id group by 1),
  ng as (select query_id, count(*) as n_gold from g group by 1),
  m as (select ng.query_id, round(case when coalesce(n, 0) > 0 then hits / n else 0 end, 6)::double as precision, round(coalesce(1.0 / first, 0), 6)::double as rr, coalesce((first <= 1)::int, 0)::integer as top1, coalesce((first <= 3)::int, 0)::integer as top3, round(coalesce(hits, 0) / n_gold, 6)::double as coverage, coalesce(hits, 0)::bigint as hits, coalesce(tokens, 0)::bigint as tokens from ng left join per using (query_id))"""
_HALF = duck("v_event") + ", a as (select operation as metric, round(avg(value), 6) as value from v_event where event_id % 2 = 0 group by 1), b as (select operation as metric, round(avg(value), 6) as value from v_event where event_id % 2 = 1 group by 1)"
_Z = "1.96::double"

SQL = {
    "e01_retrieval_metrics": f"{_M} select * from m",
    "e01_summary": f"{_M} select count(*) as queries, round(avg(precision), 6) as precision, round(avg(rr), 6) as rr, round(avg(top1), 6) as top1, round(avg(top3), 6) as top3, round(avg(coverage), 6) as coverage, round(case when sum(hits) > 0 then sum(tokens) / sum(hits) else 0 end, 6)::double as tokens_per_hit from m",
    "e02_gate": f"{_M}, s as (select avg(precision) as p, avg(rr) as r, avg(coverage) as c from m) select * from (select 'precision' as metric, 'min' as direction, 0.5::double as \"limit\" from s where p < 0.5 union all select 'rr', 'min', 0.01 from s where r < 0.01 union all select 'coverage', 'min', 0.9 from s where c < 0.9 union all select 'p95', 'max', 1.0)",
    "e03_regression_gate": f"{_HALF} select metric, round((a.value - b.value) / abs(b.value), 6) as delta, case when (metric < 's' and (a.value - b.value) / abs(b.value) < -0.001) or (metric >= 's' and (a.value - b.value) / abs(b.value) > 0.001) then 'regressed' else 'ok' end as status from a join b using (metric)",
    "e04_effective_limits": f"{_HALF} select metric, case when metric < 's' then 'min' else 'max' end as direction, round(case when metric < 's' then greatest(b.value, a.value * 0.95::double) else least(b.value, a.value * 1.05::double) end, 6) as \"limit\", round(a.value - b.value, 6) as delta, round(100.0::double * (a.value - b.value) / abs(b.value), 6) as percent from a join b using (metric)",
    "e05_token_stats": f"{duck('v_event')} select round(avg(served), 6) as avg, max(served) as max, sum(served)::bigint as total, sum((served > 90)::int)::bigint as over_budget, round((sum(served) / sum(event_id % 3 + 1))::double, 6) as per_call from v_event",
    "e06_compare_modes": f"{_CAND}, r as (select *, row_number() over (partition by query_id order by -relevance, id) as r1, row_number() over (partition by query_id order by -other, id) as r2 from c), q as (select query_id, max(relevance) as t1, max(other) as t2, sum(id % 89)::bigint as l, list(id % 2 order by r1) filter (where r1 <= 2) as i1, list(id % 2 order by r2) filter (where r2 <= 2) as i2 from r group by 1) select round(avg(t2) - avg(t1), 6) as top1_delta, 0.0::double as p95_delta, round(avg((i1 = i2)::int), 6) as same_order from q",
    "e07_percentiles": "with n as (select value, row_number() over (order by value) as i, count(*) over () as n from events) select quantile_cont(value, 0.95) as linear, min(case when i >= ceil(0.95::double * n) then value end) as ceil_index, min(case when i >= floor(0.95::double * (n - 1) + 0.5::double) + 1 then value end) as round_index from n",
    "e08_consensus": f"{_RAT}, v as (select item_id, verdict, count(*) as n from v_rating group by 1, 2), t as (select *, max(n) over (partition by item_id) as top, count(*) over (partition by item_id) as kinds from v) select item_id, case when sum((n = top)::int) = 1 then max(case when n = top then verdict end) else 'ambiguous' end as consensus, max(kinds) = 1 as unanimous from t group by 1",
    "e09_cohen_kappa": f"{_RAT}, p as (select x.rater as a, y.rater as b, x.verdict as va, y.verdict as vb from v_rating x join v_rating y on x.item_id = y.item_id and x.rater < y.rater), o as (select a, b, count(*) as n, avg((va = vb)::int) as po from p group by 1, 2), r as (select a, b, va as v, count(*) as r from p group by 1, 2, 3), c as (select a, b, vb as v, count(*) as c from p group by 1, 2, 3), e as (select a, b, sum(r * c) as rc from r join c using (a, b, v) group by 1, 2) select a::integer as a, b::integer as b, n, round((po - rc / (n * n)) / (1 - rc / (n * n)), 6) as kappa from o join e using (a, b)",
    "e10_fleiss_kappa": f"{_RAT}, v as (select item_id, verdict, count(*) as n from v_rating group by 1, 2), i as (select (sum(n * n) - 3) / 6.0::double as p from v group by item_id), s as (select verdict, sum(n) as n from v group by 1), e as (select (sum(n * n) / pow(sum(n), 2))::double as pe from s) select round(((select avg(p) from i) - pe) / (1 - pe), 6) as kappa from e",
    "e11_judge_report": f"{_RAT} select category, rater::integer as rater, count(*) as n, round(avg((verdict = 'correct')::int), 6) as correct, round(avg((verdict = 'ambiguous')::int), 6) as ambiguous, round(avg(latency_ms), 6) as latency from v_rating group by grouping sets ((category), (rater), ())",
    "e12_wilson": f"{_RAT}, v as (select rater::integer as rater, sum((verdict = 'correct')::int)::bigint as hits, count(*) as n from v_rating group by 1), p as (select *, hits / n::double as p from v) select rater, hits, n, round((p + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 6) as low, round((p + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n), 6) as high from p",
    "e13_proxy_agreement": f"{_CAND}, r as (select query_id, row_number() over (partition by query_id order by relevance desc, id) as f, row_number() over (partition by query_id order by relevance * 0.5::double + other * 0.5::double desc, id) as p from c) select round((select avg((p = 1)::int) from r where f = 1), 6) as top1, round((select avg(abs(f - p)) from r), 6) as rank_error, round((select avg((a.p < b.p)::int) from r a join r b on a.query_id = b.query_id and a.f < b.f), 6) as pair_agreement",
}
