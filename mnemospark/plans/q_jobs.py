"""Queries of the multi-stage jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import aggregates as agg
from mnemospark.operators import jobs as op
from mnemospark.operators import joins as J
from mnemospark.operators.admission import admit_batch
from mnemospark.operators.capsule import SECTIONS, capsule_items, context_capsule
from mnemospark.operators.consolidate import consolidate
from mnemospark.operators.boosts import ENTROPY_RATES
from mnemospark.plans.fixtures import AS_OF, duck, view
from mnemospark.plans.q_boosts import SOUGHT, lifted_rows
from mnemospark.plans.q_joins import _TERMS, _edges, _emb, _tokens
from mnemospark.plans.q_windows import _CAND, _candidates
from mnemospark.plans.scratch import materialize, shared_dir


def _mem(s, d):
    return view(s, d, "v_memory")


def hybrid_retrieve(s, d):
    """Every benchmark passage over all documents, with vectors by a declared link."""
    corpus = _mem(s, d)
    v = view(s, d, "v_vector")
    queries = view(s, d, "v_query")
    query_vectors = v.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), F.col("vec_id").alias("own"), F.col("embedding").alias("vector")).join(queries.select("query_id"), "query_id", "left_semi")
    vectors = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).join(corpus.select("id"), "id", "left_semi")
    boosts = agg.feedback_boost(view(s, d, "v_feedback"), AS_OF).withColumnRenamed("result_source", "source")
    clusters, members = _clusters(s, d)
    return op.retrieve(queries, corpus, vectors, query_vectors, AS_OF, boosts=boosts, clusters=clusters, members=members, floor=0.0)


def _clusters(s, d):
    """The labelled vectors as clusters that speak by their first document, and a third of the documents as members."""
    labelled = view(s, d, "v_vector").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cluster_id"), F.col("embedding").alias("vector")).join(_mem(s, d).select("id", "source", "text"), "id")
    named = labelled.groupBy("cluster_id").agg(F.min_by("text", "id").alias("text"))
    clusters = agg.centroids(labelled.select("cluster_id", "vector")).join(named, "cluster_id").select(F.col("cluster_id").alias("id"), F.concat(F.lit("cluster::"), "cluster_id").alias("source"), "text", "centroid")
    return clusters, labelled.where("id % 3 = 0").select("cluster_id", "source")


def job04(s, d):
    top = _candidates(s, d).where("relevance >= 0.5").select("query_id", "source", "id")
    return op.headlines(top, _mem(s, d))


def _leaders(s, d, least=0.6):
    reps, members = J.jaccard_classes(_tokens(s, d))
    reps, members = materialize(reps, "text-classes"), materialize(members, "text-members")
    pairs = J.jaccard_join(reps, reps, least, selfjoin=True)
    lead = op.leader_clusters(pairs, reps.select("id"), 1)
    whole = lead.join(members, "id").select(F.col("member").alias("id"), "leader")
    sizes = whole.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("leader")
    return whole.join(sizes, "leader", "left_semi").select("id", "leader")


def job05_vectors(s, d):
    v = view(s, d, "v_vector").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return op.leader_clusters(J.vector_pairs(v, 0.35).select("a", "b"), v.select("id"), 3)


def job07_visible(s, d):
    """Cluster search by callers: a third of the clusters belong to one owner each, the rest to all."""
    v = view(s, d, "v_vector")
    mean = agg.centroids(v.select(F.col("label").alias("cluster_id"), F.col("embedding").alias("vector")))
    clusters = mean.select(F.col("cluster_id").cast("long").alias("id"), "centroid", (F.col("cluster_id") % 4).cast("long").alias("owner_id"), F.when(F.col("cluster_id") % 3 == 0, "private").otherwise("shared").alias("visibility"))
    queries = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("vec_id") % 350 != 0, F.col("vec_id") / 50 % 4).cast("long").alias("caller"), F.col("embedding").alias("vector"))
    return op.search_clusters(queries, clusters, floor=0.0, k=4)


def job08_copies(s, d):
    """Groups of equal token sets as clusters."""
    members = J.jaccard_classes(_tokens(s, d))[1]
    return op.archive_duplicates(_mem(s, d).select("id", "score"), members.select(F.col("member").alias("id"), F.col("id").alias("leader")))


def job07(s, d):
    v = view(s, d, "v_vector")
    clusters = agg.centroids(v.select(F.col("label").alias("cluster_id"), F.col("embedding").alias("vector"))).withColumnRenamed("cluster_id", "id").withColumn("id", F.col("id").cast("long"))
    return op.search_clusters(v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), clusters, floor=0.05, k=3)


def m22(s, d):
    return op.class_counts(_tokens(s, d), 0.4, ["erth", "ung"], [("tion", "heit")])


def m23(s, d):
    rows = _tokens(s, d).select("id", "tokens", (F.col("id") % 4).alias("agent"), ((F.col("id") * 53) % 100 / 100).alias("trust"))
    return op.resolve_incoming(rows.where("id % 2 = 1"), rows.where("id % 2 = 0"), 0.4, ["erth", "ung"], [("tion", "heit")])


def m24(s, d):
    actions = _mem(s, d).where("id % 10 = 0").select(F.col("id").alias("keep_id"), (F.col("id") + 1).alias("other_id"), F.element_at(F.array(F.lit("keep"), F.lit("merge"), F.lit("archive")), (F.col("id") % 3 + 1).cast("int")).alias("action"))
    return op.apply_resolutions(_mem(s, d), actions)


def m25(s, d):
    m = _mem(s, d)
    pairs = m.select("id", (F.col("id") - 1).alias("other"), F.col("trust_score").alias("trust")).join(m.select(F.col("id").alias("other"), F.col("trust_score").alias("other_trust")), "other")
    return op.consensus(pairs, 0.4)


def _items(s, d):
    return _mem(s, d).select(F.floor(F.col("id") / 40).alias("context"), F.col("source").alias("name"), T.tokens(F.col("text")).alias("tokens"), F.col("score").alias("priority"))


def wn17(s, d):
    c = _candidates(s, d).drop("terms").join(_mem(s, d).select("id", T.tokens(F.col("text")).alias("tokens"), T.token_set(F.col("text"), "terms").alias("terms")), "id")
    return op.apply_budget(c.withColumn("query_terms", F.array(F.lit("erth"), F.lit("then"))).withColumn("rank", F.lit(0)), 3000)


def job10(s, d):
    edges = _edges(s, d)
    return op.compact(view(s, d, "v_event"), _emb(s, d), _mem(s, d), edges, AS_OF)


def job10_tables(s, d):
    e = view(s, d, "v_event")
    rollups = agg.rollup_hourly(e.where("event_id % 50 = 0"))
    steps = op.compact_tables(
        e, rollups, _mem(s, d), _emb(s, d), _emb(s, d).where("vec_id % 9 = 0").select("target_type", "target_id"), view(s, d, "v_feedback"), _edges(s, d), AS_OF, "MINI",
        savings=("signup",), protected=("purchase",), caps={"view": 100, "error": 40}, keep=900, savings_days=10, rollup_days=20, event_days=14, strip_days=45, feedback_days=20, least_active=10,
    )
    return op.compaction_report(steps)


def m03(s, d):
    syn = s.createDataFrame([("erth", "earth"), ("the", "tha"), ("der", "die")], "term string, synonym string")
    return op.term_groups(view(s, d, "v_query"), syn, [(["erth"], ["earthy", "ground"]), (["der", "ein"], ["eine"])])


def f11(s, d):
    rows = _tokens(s, d).join(_mem(s, d).select("id", "owner_id", "status", "created_at"), "id")
    return op.novelty(rows.where("id % 4 = 0"), rows.where("id % 4 <> 0")).select("id", F.round("surprise", 6).alias("surprise"), "admitted")


def job02(s, d):
    corpus = _mem(s, d).select("id", "text", "source", "created_at", "last_accessed")
    v = view(s, d, "v_vector")
    linked = v.where("vec_id % 50 = 0").select((F.col("vec_id") / 50).cast("long").alias("query_id"), F.col("vec_id").alias("own"), F.col("embedding").alias("vector"))
    queries = view(s, d, "v_query")
    return op.retrieve_semantic(queries, linked.join(queries.select("query_id"), "query_id", "left_semi"), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), corpus, AS_OF, floor=0.0, recency="ein|der")


def job03(s, d):
    corpus = _mem(s, d)
    basket = _candidates(s, d).where("relevance > 0.8").groupBy("query_id").agg(F.collect_set("source").alias("items"), F.lit(None).cast("timestamp_ntz").alias("seen"))
    results = materialize(hybrid_retrieve(s, d), "budget-retrieved")
    # results alone are anchors, so pairs of other sources are not asked for
    edges = agg.co_occurrence(basket, of=results.select(F.col("source").alias("item"))).select("a", "b", "n")
    texts = corpus.select("source", "text").unionByName(_clusters(s, d)[0].select("source", "text"))
    return op.retrieve_budgeted(results, edges, texts, view(s, d, "v_query"), 4000)


def job06_consolidate(s, d):
    """Labelled vectors as clusters: a third of them, then all, then all again; what is current, with the version that each crystal has."""
    import uuid

    path = f"{shared_dir(s)}/crystals-{uuid.uuid4().hex}"
    docs = _mem(s, d).select("id", "text")
    entries = view(s, d, "v_vector").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("leader")).join(docs, "id")
    for rows in (entries.where("id % 3 = 0"), entries, entries):
        found = consolidate(rows.select("id", "text", "vector"), rows.select("id", "leader"), path)
    return found.select("id", "label", "size", "version")


def job12(s, d):
    rows = _mem(s, d).select("id", F.concat(F.lit("a"), (F.col("id") % 4).cast("string")).alias("agent"), F.col("trust_score").alias("trust"), "text", F.lit(None).cast("string").alias("context"), F.col("score"), F.lit(50).alias("quality"), F.lit(0).cast("long").alias("merged"), "status")
    decisions, table = admit_batch(rows.where("id % 2 = 1").select("id", "agent", "trust", "text", "context"), rows.where("id % 2 = 0"), negations=["erth", "ung"], flips=[("tion", "heit")])
    return decisions.join(table.select("id", "status", "score", "quality", "merged"), "id", "left")


def job11_items(s, d):
    e = view(s, d, "v_event")
    n = F.col("event_id")
    agents = e.groupBy("agent").agg(F.max(F.when(n % 7 == 0, n)).alias("boot"), F.max(F.when(n % 11 == 0, n)).alias("seen"))
    when = e.select(n.alias("x"), F.col("ts").alias("t"))
    agents = agents.join(when.withColumnRenamed("x", "boot").withColumnRenamed("t", "last_boot"), "boot", "left").join(when.withColumnRenamed("x", "seen").withColumnRenamed("t", "seen_ts"), "seen", "left").select("agent", "last_boot", "seen_ts", F.col("seen").alias("seen_id"))
    messages = e.where("event_type = 'purchase'").select(n.alias("id"), F.concat(F.lit("u"), n % 150).alias("recipient"), F.col("agent").alias("sender"), F.concat(F.lit("m"), n).alias("text"), "ts")
    sessions = e.where("event_id % 97 = 0").select(n.alias("id"), "agent", F.col("event_type").alias("project"), F.concat(F.lit("s"), n).alias("description"), "ts")
    locks = e.where("event_id % 89 = 0").select(n.alias("id"), F.concat(F.lit("p"), "k").alias("path"), F.col("agent").alias("holder"), "ts")
    feed = e.where("event_type = 'view'").select(n.alias("id"), F.col("agent").alias("author"), F.col("operation").alias("kind"), F.concat(F.lit("f"), n).alias("summary"), "ts")
    tasks = view(s, d, "v_task").select(F.col("task_id").alias("id"), F.concat(F.lit("t"), "task_id").alias("title"), "priority", "status", F.concat(F.lit("u"), F.col("task_id") % 150).alias("owner"))
    m = _mem(s, d)
    status = F.when(F.col("id") % 31 == 0, "disputed").otherwise(F.col("status"))
    decisions = m.select("id", F.col("source").alias("text"), F.concat(F.lit("u"), F.col("id") % 150).alias("author"), status.alias("status"), (F.col("id") - 1).alias("disputes"), F.col("created_at").alias("ts"))
    memories = m.select("id", "text", F.col("lang").alias("kind"), "status", F.col("updated_at").alias("ts"))
    return capsule_items(agents, messages, sessions, locks, feed, tasks, decisions, memories, e.select(F.col("event_type").alias("kind"), "ts"))


QUERIES = {
    "job07_visible_clusters": job07_visible, "job08_archive_copies": job08_copies, "job06_consolidate": job06_consolidate, "job12_admit_batch": job12, "job11_capsule_items": job11_items,
    "job11_context_capsule": lambda s, d: context_capsule(job11_items(s, d), 260),
    "f11_novelty": f11, "job02_semantic_retrieve": job02, "job03_budgeted_retrieve": job03,
    "job01_hybrid_retrieve": hybrid_retrieve, "job04_headlines": job04, "job05_leader_clusters": _leaders, "job05_leader_vectors": job05_vectors,
    "job06_summaries": lambda s, d: op.summarize_clusters(_mem(s, d), _leaders(s, d)),
    "job07_search_clusters": job07,
    "job08_archive_duplicates": lambda s, d: op.archive_duplicates(_mem(s, d), _leaders(s, d)),
    "job09_age": lambda s, d: op.age(_mem(s, d), view(s, d, "v_feedback"), AS_OF),
    "job10_compact": job10, "job10_compact_tables": job10_tables,
    "job13_cleanup_report": lambda s, d: op.cleanup_report(_mem(s, d).select("id", "text", F.concat(F.lit("s"), (F.col("id") % 700).cast("string")).alias("source"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")),
    "m03_term_groups": m03, "m22_classify_pairs": m22, "m23_resolve_incoming": m23, "m24_apply_resolutions": m24, "m25_consensus": m25,
    "wn15_allocate_budget": lambda s, d: op.allocate_budget(_items(s, d), 600, 40, 3000),
    "wn16_pack_greedy": lambda s, d: op.pack_greedy(_items(s, d), 2000),
    "wn17_apply_budget": wn17,
}

_MEM, _EV = duck("v_memory"), duck("v_event")
_NOW = f"timestamp '{AS_OF}'"
_TOK = "t as (select doc_id as id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: length(w) > 1)) as t from documents)"
_JJ = "len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b})))::double"
_CLASS = """case when s < 0.4 then 'UNRELATED' when (case when na = nb then flip and s >= 0.55 else len(ca) + len(cb) = 0 or len(list_intersect(ca, cb)) >= 0.35::double * (len(ca) + len(cb) - len(list_intersect(ca, cb))) end) then 'CONTRADICTS' when s >= 0.84 then 'AGREES' else 'REFINES' end"""
_PAIR = "list_has_any({x}.t, ['erth', 'ung'])"
_PAIRS = f"p as (select x.id as a, y.id as b, {_JJ.format(a='x.t', b='y.t')} as s, {_PAIR.format(x='x')} as na, {_PAIR.format(x='y')} as nb, (list_contains(x.t, 'tion') and list_contains(y.t, 'heit')) or (list_contains(x.t, 'heit') and list_contains(y.t, 'tion')) as flip, list_filter(x.t, lambda w: w not in ('erth', 'ung')) as ca, list_filter(y.t, lambda w: w not in ('erth', 'ung')) as cb from t x join t y on {{on}} and len(x.t) > 0 and len(x.t) >= 0.4 * len(y.t) and len(y.t) >= 0.4 * len(x.t) where {_JJ.format(a='x.t', b='y.t')} >= 0.4::double - 1e-9)"
_IDLE, _SEEN = f"(epoch({_NOW}) - epoch(updated_at)) / 86400", f"(epoch({_NOW}) - epoch(coalesce(last_accessed, created_at))) / 86400"

_LOW = "(" + ", ".join(f"'{w}'" for w in T.LOW_SIGNAL) + ")"
_TELLING = f"list_filter(words, lambda w: w not in {_LOW})"
#: Keywords that count as groups: natural queries of six and more lose those of low signal.
_GROUPED = f"""kq as (select query_id, len(list_filter(regexp_split_to_array(trim(query), '[ \t\n]+'), lambda w: w <> '')) >= 8 or length(trim(query)) >= 56 or trim(query) like '%?' as nat, list_filter(list_filter(string_split(regexp_replace(lower(query), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 1) as words from v_query),
  gq as (select distinct query_id, unnest(case when nat and len(words) >= 6 and len({_TELLING}) > 0 then {_TELLING} else words end) as term from kq)"""
_EXCERPT = "case when length({t}) <= 300 then {t} else case when {at} > 1 then '...' else '' end || substr({t}, {at}, 300) || case when {at} + 300 <= length({t}) then '...' else '' end end"
#: Start of a text's excerpt: a third before the first hit of the longest term held.
_AT = "greatest(1, least(coalesce(greatest(instr(lower({t}), list_sort(list_transform(list_filter(said, lambda t: contains(lower({t}), t)), lambda t: {{'l': -length(t), 't': t}}))[1].t) - 100, 1), 1), length({t}) - 299))"
_COSINE = "list_dot_product({a}, {b}) / sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b}))"


def _cut(table: str, text: str, columns: str) -> str:
    """A query over ``table`` (with said) that adds ex, the excerpt of ``text``."""
    return f"select {columns}, {_EXCERPT.format(t=text, at='at_')} as ex from (select *, {_AT.format(t=text)} as at_ from {table})"


_RETRIEVE = (
    _TERMS
    + f""", {duck('v_memory')[5:]}, {_GROUPED}, sq as (select query_id, list(term) as said from qt group by 1), need as (select query_id, count(*) as need from gq group by 1), h as (select query_id, id, count(distinct term) as matched, sum(tf)::bigint as tf from gq join p using (term) group by 1, 2),
  k as (select query_id, id, matched, row_number() over (partition by query_id order by tf desc, id) as rank from h join need using (query_id) where matched = need),
  f as (select query_id, id, matched, row_number() over (partition by query_id order by matched desc, tf desc, id) as rank from h where query_id not in (select query_id from k)),
  sh as (select query_id, (position('/' in query) > 0 or position('"' in query) > 0 or position('`' in query) > 0 or position('::' in query) > 0 or position(chr(92) in query) > 0 or len(list_filter(['.rs', '.ts', '.js', '.py'], lambda w: contains(lower(query), w))) > 0 or len(string_split(trim(query), ' ')) <= 3 or length(trim(query)) <= 24) as e, (len(list_filter(regexp_split_to_array(trim(query), '[ \t\n]+'), lambda w: w <> '')) >= 8 or length(trim(query)) >= 56 or trim(query) like '%?') as n from v_query),
  cg as (select query_id, need, case when e and not n then 1 when n and not e then 2 else 3 end as c, case when need <= 1 then 1 when need >= 5 then 2 else 3 end as g from sh join need using (query_id)),
  lw as (select query_id, need, 0.40::double + [0.12, -0.08, 0.0][c] + [0.05, -0.04, 0.0][g] as wk, 0.25::double + [-0.03, 0.05, 0.0][c] + [0.01, 0.02, 0.0][g] as ws, 0.20::double + [-0.05, 0.02, 0.0][c] + [-0.03, 0.01, 0.0][g] as wy, 0.15::double + [-0.04, 0.01, 0.0][c] + [-0.03, 0.01, 0.0][g] as wt from cg),
  kw as (select x.query_id, x.id, source, matched, need, round((matched / need * wk + score * ws + 1 / (1 + floor((epoch({_NOW}) - epoch(created_at)) / 86400.0::double) / 7.0::double) * wy + least(retrievals, 20) / 20.0::double * wt) / (wk + ws + wy + wt), 9) as rel
    from (select * from k where rank <= 50 union all select * from f where rank <= 50) x join lw using (query_id) join v_memory using (id)),
  kr as (select *, row_number() over (partition by query_id order by rel desc, source) as rank, lead(rel) over (partition by query_id order by rel desc, source) as next from kw),
  clear as (select query_id from kr where rank = 1 and rel >= 0.78 and rel - coalesce(next, 0) >= 0.1 and matched >= ceil(0.6::double * need)),
  v as (select a.vec_id // 50 as query_id, b.vec_id as id, {_COSINE.format(a='a.embedding::double[]', b='b.embedding::double[]')} as c from embeddings a, embeddings b where a.vec_id % 50 = 0 and b.vec_id <> a.vec_id and a.vec_id // 50 in (select query_id from v_query) and b.vec_id in (select doc_id from documents)),
  sv as (select v.query_id, v.id, c, coalesce(len(said), 0) as n, coalesce(len(list_filter(said, lambda t: contains(lower(text), t))), 0) as held from v join v_memory using (id) left join sq using (query_id) where query_id not in (select query_id from clear)),
  se as (select query_id, id, round((0.55::double + c * 0.45::double) * case when n = 0 then 1.0::double when held = 0 then 0.82::double else 1.0::double + held / n * 0.08::double end, 9) as rel from sv where c > case when n >= 3 then 0.12::double else 0.0::double end),
  sr as (select *, row_number() over (partition by query_id order by rel desc, 'doc::' || id) as rank from se),
  l as (select query_id, id, 'keyword' as list, rel from kw union all select query_id, id, 'semantic', rel from sr where rank <= 50),
  lr as (select *, row_number() over (partition by query_id, list order by rel desc, id) as rank from l),
  u as (select query_id, id, sum(case when list = 'keyword' then 1.0 + e::int * 0.35 - n::int * 0.15 else 1.0 - e::int * 0.15 + n::int * 0.35 end::double / (60.0::double + rank)) as rrf, string_agg(distinct list, '+' order by list) as method from lr join sh using (query_id) group by 1, 2),
  b as (select 'doc::' || (user_id % 10) as source, greatest(-0.2, least(0.3, sum((case when event_id % 3 = 0 then 1.0 else -0.5 end)::double * pow(2.0::double, -greatest((epoch({_NOW}) - epoch(date_trunc('second', ts))) / 86400.0::double, 0) / 30.0::double))))::double as boost from events group by 1),
  x0 as (select query_id, u.id, source, rrf, method, text, said, round(rrf * 0.6::double + score * 0.2::double + exp(-((epoch({_NOW}) - epoch(created_at)) / 86400.0::double) / 30.0::double) * 0.2::double, 4) as r0 from u join v_memory using (id) join sq using (query_id)),
  xe as ({_cut('x0', 'text', 'query_id, id, source, rrf, method, r0, said')}),
  cp as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) where vec_id in (select doc_id from documents) group by 1, 2), cc as (select label, list(x order by i) as cv from cp group by 1), ct as (select label, arg_min(text, vec_id) as text from embeddings join documents on doc_id = vec_id group by 1),
  cs as (select vec_id // 50 as query_id, label, {_COSINE.format(a='embedding::double[]', b='cv')} as c from (select vec_id, embedding from embeddings where vec_id % 50 = 0 and vec_id // 50 in (select query_id from v_query)) e, cc),
  cr as (select *, row_number() over (partition by query_id order by round(c, 9) desc, label) as place from cs where c > 0),
  ch0 as (select cr.query_id, place, cr.label::bigint as id, 'cluster::' || cr.label as source, text, said, round(0.55::double + round(c * 1.15::double, 6) * 0.45::double, 4) as r0 from cr join ct using (label) join sq using (query_id) where place <= 3),
  ch as ({_cut('ch0', 'text', 'query_id, place, id, source, r0, said')}),
  fm as (select ch.query_id, 'doc::' || vec_id as source, arg_min(ch.id, place) as cid from ch join embeddings e on e.label = ch.id where vec_id % 3 = 0 and vec_id in (select doc_id from documents) group by 1, 2),
  xm as (select xe.*, cid from xe left join fm using (query_id, source)),
  cf as (select query_id, id as cid, r0, ex, source, said, 0 as later from ch union all select query_id, cid, r0, ex, source, said, 1 from xm where cid is not null),
  cg2 as (select query_id, cid, max(r0) as r0, arg_min(ex, (-len(list_filter(said, lambda t: contains(lower(ex), t))), later, -r0, source)) as ex, sum(later)::bigint as folded from cf group by 1, 2),
  x as (select query_id, id, source, rrf, method, r0, ex, 0::bigint as folded from xm where cid is null union all select query_id, cid, 'cluster::' || cid, 0.0::double, 'cluster', r0, ex, folded from cg2),
  {SOUGHT}, {lifted_rows("x", *ENTROPY_RATES["hybrid"], more="rrf, method, folded, ")},
  z as (select lift.* exclude (relevance), round(relevance * (1 + coalesce(boost, 0)), 4) as relevance from lift left join b using (source)),
  y as (select *, row_number() over (partition by query_id order by relevance desc, source)::integer as rank from z)
  select query_id, rank, id, source, relevance, round(rrf, 9) as rrf, method, entropy, entity, alignment, folded from y where rank <= 10"""
)

_WORDS = "list_filter(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9-]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: length(w) > 2 and not list_contains([" + ", ".join(f"'{x}'" for x in T.STOPWORDS) + "], w))"
_LEVEL = "case priority when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end"
#: Per section: its lines (agent, o: order, line).
_SECTION_SQL = {
    "## Pending Messages": "select 'u' || (event_id % 150) as agent, row_number() over (partition by event_id % 150 order by ts desc, event_id desc) as o, 'From ' || agent || ': \"m' || event_id || '\"' as line from v_event where event_type = 'purchase'",
    "## Active Agents": "select a.agent, row_number() over (partition by a.agent order by ts desc, event_id desc) as o, e.agent || ' working on ' || event_type || ': \"s' || event_id || '\"' from a join v_event e on e.agent <> a.agent where event_id % 97 = 0",
    "## Active Locks": "select a.agent, row_number() over (partition by a.agent order by ts desc, event_id desc), 'p' || k || ' locked by ' || e.agent from a, v_event e where event_id % 89 = 0",
    "## Feed": "select a.agent, row_number() over (partition by a.agent order by e.ts desc, event_id desc), '[' || operation || '] ' || e.agent || ': f' || event_id from a join v_event e on e.agent <> a.agent where event_type = 'view' and (seen is null or (e.ts, event_id) > (seen_ts, seen))",
    "## Pending Tasks": f"select a.agent, row_number() over (partition by a.agent order by {_LEVEL}, task_id), '[' || priority || '] t' || task_id from a, v_task where status = 'pending'",
    "## Your Active Tasks": f"select 'u' || (task_id % 150), row_number() over (partition by task_id % 150 order by {_LEVEL}, task_id), '[' || priority || '] t' || task_id from v_task where status = 'claimed'",
    "CONFLICTS:": "select a.agent, row_number() over (partition by a.agent order by m.created_at desc, m.id desc), '#' || m.id || ' (u' || (m.id % 150) || '): ' || m.source || coalesce(' vs #' || (m.id - 1) || ' (u' || (p.id % 150) || '): ' || p.source, '') from a, v_memory m left join v_memory p on p.id = m.id - 1 where m.id % 31 = 0",
    "New decisions:": "select a.agent, row_number() over (partition by a.agent order by m.created_at desc, m.id desc), '[u' || (m.id % 150) || '] ' || m.source from a join v_memory m on m.created_at >= a.boot_ts where m.status = 'active' and m.id % 31 <> 0",
    "Recent decisions:": "select a.agent, row_number() over (partition by a.agent order by m.created_at desc, m.id desc), m.source from a join v_memory m on a.boot is null where m.status = 'active' and m.id % 31 <> 0",
    "New knowledge:": "select a.agent, row_number() over (partition by a.agent order by m.updated_at desc, m.id desc), '[' || lang || '] ' || left(text, 100) from a join v_memory m on m.updated_at >= a.boot_ts where m.status = 'active'",
}
_ITEMS = (
    duck("v_event", "v_memory", "v_task").replace("with ", "with recursive ", 1)
    + ", b as (select agent, max(event_id) filter (where event_id % 7 = 0) as boot, max(event_id) filter (where event_id % 11 = 0) as seen from v_event group by 1), a as (select b.*, x.ts as boot_ts, y.ts as seen_ts from b left join v_event x on x.event_id = boot left join v_event y on y.event_id = seen), parts as ("
    + " union all ".join(f"select agent, '{k}' as section, {SECTIONS[k][0]}::double as priority, '{k}' || chr(10) || '- ' || string_agg(line, chr(10) || '- ' order by o) as text from ({q}) q(agent, o, line) where o <= {SECTIONS[k][1]} and agent in (select agent from a) group by 1" for k, q in _SECTION_SQL.items())
    + f" union all select agent, 'Activity since last boot:', {SECTIONS['Activity since last boot:'][0]}::double, 'Activity since last boot: ' || string_agg(n || ' ' || replace(event_type, '_', ' '), ', ' order by event_type) from (select a.agent, event_type, count(*) as n from a join v_event e on e.ts > a.boot_ts group by 1, 2) group by 1), items as (select *, ceil(strlen(text) / 3.8::double)::bigint as tokens from parts)"
)

SQL = {
    "f11_novelty": f"{_MEM}, {_TOK}, r as (select m.owner_id, t.t, row_number() over (partition by m.owner_id order by m.created_at desc, m.id desc) as rn from v_memory m join t on t.id = m.id where m.status = 'active' and m.id % 4 <> 0), x as (select m.id, 1 - coalesce(max(case when len(t.t) + len(r.t) = 0 then 1.0 else {_JJ.format(a='t.t', b='r.t')} end), 0) as s from v_memory m join t on t.id = m.id left join r on r.owner_id = m.owner_id and rn <= 50 where m.id % 4 = 0 group by 1) select id, round(s, 6)::double as surprise, round(s, 9) >= 0.25 as admitted from x",
    "job02_semantic_retrieve": f"""{_TERMS}, {duck('v_memory')[5:]}, sq as (select query_id, list(term) as said from qt group by 1),
      v as (select a.vec_id // 50 as query_id, b.vec_id as id, {_COSINE.format(a='a.embedding::double[]', b='b.embedding::double[]')} as c from embeddings a, embeddings b where a.vec_id % 50 = 0 and b.vec_id <> a.vec_id and a.vec_id // 50 in (select query_id from v_query)),
      sv as (select v.*, source, text, said, coalesce(last_accessed, created_at) as seen, coalesce(len(said), 0) as n, coalesce(len(list_filter(said, lambda t: contains(lower(text), t))), 0) as held from v join v_memory using (id) left join sq using (query_id)),
      se as (select *, round((0.55::double + c * 0.45::double) * case when n = 0 then 1.0::double when held = 0 then 0.82::double else 1.0::double + held / n * 0.08::double end, 9) as rel from sv where c > case when n >= 3 then 0.12::double else 0.0::double end),
      sr as (select *, row_number() over (partition by query_id order by rel desc, source) as rk from se),
      x0 as (select query_id, id, source, text, said, case when regexp_matches(lower(query), 'ein|der') then round(round(rel, 4) * (1 + (1 / (1 + greatest(epoch({_NOW}) - epoch(seen), 0) / 86400.0::double / 14) - 0.5::double) * 0.16::double), 4) else round(rel, 4) end as r0 from sr join v_query using (query_id) where rk <= 120),
      x as (select query_id, id, source, r0, {_EXCERPT.replace('300', '280').format(t='text', at='at_')} as ex from (select *, {_AT.replace('- 100', '- 93').replace('- 299', '- 279').format(t='text')} as at_ from x0)),
      {SOUGHT}, {lifted_rows("x", *ENTROPY_RATES["semantic"])}, y as (select *, row_number() over (partition by query_id order by relevance desc, source)::integer as rank from lift) select query_id, rank, id, source, relevance, entropy from y where rank <= 10""",
    "job01_hybrid_retrieve": _RETRIEVE,
    "job04_headlines": f"{_CAND} select query_id, count(*) as results, sum(ceil(strlen(text) / 3.8::double))::bigint as full, sum(ceil(strlen(c.source) / 3.8::double))::bigint as served, (sum(ceil(strlen(text) / 3.8::double)) - sum(ceil(strlen(c.source) / 3.8::double)))::bigint as saved from c join documents on doc_id = id where relevance >= 0.5 group by 1",
    "job07_visible_clusters": "with p as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by 1, 2), c as (select label, list(x order by i) as v from p group by 1), s as (select vec_id as query_id, c.label::bigint as id, list_dot_product(embedding::double[], v) / sqrt(list_dot_product(v, v) * list_dot_product(embedding::double[], embedding::double[])) as c from embeddings e, c where vec_id % 50 = 0 and vec_id % 350 <> 0 and (c.label % 3 <> 0 or c.label % 4 = vec_id // 50 % 4)), r as (select *, row_number() over (partition by query_id order by round(c, 9) desc, id)::integer as rank from s where c > 0.0) select query_id, rank, id, round(c * 1.15::double, 6) as relevance from r where rank <= 4",
    "job08_archive_copies": f"{_MEM}, {_TOK}, k as (select id, min(id) over (partition by list_sort(t)) as leader from t), r as (select m.id, leader, row_number() over (partition by leader order by score desc, m.id) as rn from v_memory m join k using (id)) select id, leader, case when rn = 1 then 'active' else 'archived' end as status from r",
    "job07_search_clusters": "with p as (select label, i, avg(embedding[i]::double) as x from embeddings, range(1, 65) r(i) group by 1, 2), c as (select label, list(x order by i) as v from p group by 1), s as (select vec_id as query_id, c.label::bigint as id, list_dot_product(embedding::double[], v) / sqrt(list_dot_product(v, v) * list_dot_product(embedding::double[], embedding::double[])) as c from embeddings, c where vec_id % 50 = 0), r as (select *, row_number() over (partition by query_id order by round(c, 9) desc, id)::integer as rank from s where c > 0.05) select query_id, rank, id, round(c * 1.15::double, 6) as relevance from r where rank <= 3",
    "job09_age": f"{duck('v_memory', 'v_feedback')}, g as (select result_source as source, count(*) as good from v_feedback where signal > 0 and created_at >= {_NOW} - to_days(14) group by 1) select id, age_tier as before, case when status <> 'active' then age_tier when not pinned and score < 0.15 and {_SEEN} > 3 then 'archived' when age_tier = 'fresh' and {_IDLE} > 3 and coalesce(good, 0) < 5 then 'recent' when age_tier = 'recent' and {_IDLE} > 14 and coalesce(good, 0) < 5 then 'old' when age_tier = 'old' and {_IDLE} > 60 then 'archived' else age_tier end as after from v_memory left join g using (source)",
    "job10_compact_tables": f"""{duck('v_memory', 'v_event', 'v_history', 'v_feedback')}, sr as (select * from v_event where not (event_type = 'signup' and ts < {_NOW} - to_days(10))),
      ru as (select distinct strftime(ts, '%Y-%m-%d') as day, hour(ts) as hour, operation from v_event where event_id % 50 = 0 or (event_type = 'signup' and ts < {_NOW} - to_days(10))),
      ao as (select * from sr where ts >= {_NOW} - to_days(14) or event_type = 'purchase'), tc as (select * from (select *, row_number() over (partition by event_type order by event_id desc) as rn from ao) where rn <= case event_type when 'view' then 100 when 'error' then 40 else rn end),
      n as (select count(*) as a, sum((event_type = 'purchase')::int) as p from tc), l as (select * from v_memory where expires_at is null or expires_at >= {_NOW}),
      em as (select vec_id, vec_id * 3 as t, vec_id % 4 = 0 as mini from embeddings), cv as (select * from em where vec_id % 9 <> 0), orp as (select * from cv where t in (select id from l where status = 'active')), mb as (select t from em where vec_id % 9 = 0),
      ed as (select query, 'u' || (user_id % 12) as u, count(*) as n from v_history group by 1, 2)
      select 'savings_rollup' as step, (select count(*) from v_event) as before, (select count(*) from sr) as after union all select 'rollup_prune', count(*), count(*) filter (where day >= strftime({_NOW} - to_days(20), '%Y-%m-%d')) from ru
      union all select 'age_out', (select count(*) from sr), (select count(*) from ao) union all select 'type_caps', (select count(*) from ao), (select count(*) from tc) union all select 'overflow', a, (p + least(a - p, greatest(0, 900 - p)))::bigint from n
      union all select 'text_strip', count(*), count(*) filter (where not (status = 'archived' and updated_at < {_NOW} - to_days(45))) from v_memory union all select 'expired', (select count(*) from v_memory), (select count(*) from l)
      union all select 'covered', (select count(*) from em), (select count(*) from cv) union all select 'orphans', (select count(*) from cv), (select count(*) from orp) union all select 'orphan_members', (select count(*) from mb), (select count(*) from mb where t in (select id from l where status = 'active'))
      union all select 'feedback', count(*), count(*) filter (where created_at >= {_NOW} - to_days(20)) + count(distinct case when created_at < {_NOW} - to_days(20) then result_source end) from v_feedback
      union all select 'stale_model', count(*), case when count(*) filter (where mini) >= 10 then count(*) filter (where mini) else count(*) end from orp union all select 'singletons', count(*), sum((n >= 2)::int)::bigint from ed""",
    "job10_compact": f"""{duck('v_memory', 'v_event', 'v_history')}, a as (select * from v_event where ts >= {_NOW} - to_days(14) or event_type = 'purchase'), n as (select count(*) as a, sum((event_type = 'purchase')::int) as p from a),
      l as (select * from v_memory where expires_at is null or expires_at > {_NOW}), e as (select query, 'u' || (user_id % 12) as u, count(*) as n from v_history group by 1, 2)
      select 'age_out' as step, (select count(*) from v_event) as before, (select a from n) as after union all select 'overflow', a, (p + least(a - p, greatest(0, 5000 - p)))::bigint from n union all select 'expired', (select count(*) from v_memory), (select count(*) from l)
      union all select 'orphans', (select count(*) from embeddings), (select count(*) from embeddings where vec_id * 3 in (select id from l where status = 'active')) union all select 'singletons', count(*), sum((n >= 2)::int)::bigint from e""",
    "m03_term_groups": f"""{duck("v_query")}, {_GROUPED}, w as (select query_id, term as "group" from gq union select query_id, unnest(case when contains(lower(query), 'erth') then ['earthy', 'ground'] else [] end) from v_query union select query_id, unnest(case when contains(lower(query), 'der') and contains(lower(query), 'ein') then ['eine'] else [] end) from v_query)
      select query_id, "group", "group" as term from w union all select query_id, "group", s from w join (values ('erth', 'earth'), ('the', 'tha'), ('der', 'die')) y(t, s) on "group" = t""",
    "job11_capsule_items": f"{_ITEMS} select agent, section, priority, text, tokens from items",
    "job11_context_capsule": f"""{_ITEMS}, r as (select *, row_number() over (partition by agent order by priority desc, section) as i from items),
      f as (select agent, 0::bigint as i, 260::bigint as room, null::varchar as section, 0::bigint as used from (select distinct agent from r) union all
        select f.agent, f.i + 1, f.room - (case when r.tokens <= f.room then r.tokens when r.priority >= 0.7 and f.room > 0 then f.room else 0 end), r.section, case when r.tokens <= f.room then r.tokens when r.priority >= 0.7 and f.room > 0 then f.room else 0 end from f join r on r.agent = f.agent and r.i = f.i + 1)
      select agent, section, used from f where used > 0""",
    "job06_consolidate": f"""with e as (select vec_id as id, label as leader, text from embeddings join documents on doc_id = vec_id), w as (select p, leader, id, unnest({_WORDS}) as word from (select 0 as p, * from e where id % 3 = 0 union all select 1, * from e)),
      n as (select p, leader, count(*) as size from (select 0 as p, * from e where id % 3 = 0 union all select 1, * from e) group by 1, 2), c as (select p, leader, word, count(*) as tf, count(distinct id) as df, any_value(size) as k from w join (select p, leader, count(distinct id) as size from w group by 1, 2) using (p, leader) group by 1, 2, 3),
      t as (select *, row_number() over (partition by p, leader order by round(tf * greatest(ln(k / df), 0.1::double), 9) desc, word) as rn from c where df >= 0.4::double * k), l as (select n.p, n.leader, n.size, coalesce(string_agg(word, '-' order by rn) filter (where rn <= 4), 'misc') as label from n left join t using (p, leader) group by 1, 2, 3),
      u as (select p, label, arg_max(size, leader) as size, min(leader) as first from l group by 1, 2), o as (select label, size, row_number() over (order by first, label) as id from u where p = 0), z as (select * from u where p = 1)
      select o.id, o.label, coalesce(z.size, o.size) as size, case when z.label is null or z.size = o.size then 1 else 2 end as version from o left join z using (label)
      union all select (select count(*) from o) + row_number() over (order by z.first, z.label), z.label, z.size, 2 from z where label not in (select label from o)""",
    "m22_classify_pairs": f"with {_TOK}, {_PAIRS.format(on='x.id < y.id')} select {_CLASS} as class, count(*) as n from p group by 1",
    "m23_resolve_incoming": f"""with {_TOK}, {_PAIRS.format(on='x.id % 2 = 1 and y.id % 2 = 0')}, r as (select *, row_number() over (partition by a order by round(s, 9) desc, b) as rn from p), c as (select a, b, {_CLASS} as class from r where rn = 1),
      j as (select t.id, b as target, coalesce(class, 'UNRELATED') as class, (t.id * 53) % 100 as trust, (b * 53) % 100 as trust2, t.id % 4 = b % 4 as same from t left join c on c.a = t.id where t.id % 2 = 1)
      select id, target, class, case class when 'CONTRADICTS' then case when trust > trust2 then 'supersede' else 'dispute' end when 'REFINES' then case when same or trust >= trust2 then 'supersede' else 'dispute' end when 'AGREES' then 'merge' else 'insert' end as action from j""",
    "m24_apply_resolutions": f"{_MEM} select id, case when id % 10 = 0 and id % 3 = 2 or id % 10 = 1 and (id - 1) % 3 = 2 then 'archived' when id % 10 = 1 and (id - 1) % 3 = 0 then 'superseded' when id % 10 = 1 and (id - 1) % 3 = 1 then 'merged' else status end as status from v_memory",
    "m25_consensus": f"{_MEM}, p as (select a.id, b.id as other, a.trust_score as t, b.trust_score as u, round(abs(a.trust_score - b.trust_score), 9) as g from v_memory a join v_memory b on b.id = a.id - 1) select id, other, case when g >= 0.4 then case when t > u then id else other end end as winner, case when g < 0.4 then 'margin too small' end as skipped from p",
    "wn16_pack_greedy": f"""with recursive m as (select doc_id // 40 as context, 'doc::' || doc_id as name, ceil(strlen(text) / 3.8::double)::bigint as tokens, ((doc_id * 37) % 100) / 100.0::double as priority from documents),
      r as (select *, row_number() over (partition by context order by priority desc, name) as i from m),
      f as (select context, 0 as i, 2000::bigint as room, null::varchar as name, 0::bigint as used from (select distinct context from r) union all
        select f.context, f.i + 1, f.room - (case when r.tokens <= f.room then r.tokens when r.priority >= 0.7 and f.room > 0 then f.room else 0 end), r.name, case when r.tokens <= f.room then r.tokens when r.priority >= 0.7 and f.room > 0 then f.room else 0 end from f join r on r.context = f.context and r.i = f.i + 1)
      select context, name, used from f where used > 0""",
}
