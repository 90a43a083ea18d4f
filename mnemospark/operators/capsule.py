"""Context capsules: per agent what changed since it was last here, by sections with quotas, packed into a token budget."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators.jobs import pack_greedy
from mnemospark.operators.windows import PRIORITY, rank_within

# fixed values: sections, their priorities and how many of their rows count
SECTIONS = {
    "## Pending Messages": (0.95, 10), "CONFLICTS:": (0.90, 6), "## Your Active Tasks": (0.80, 10), "## Pending Tasks": (0.75, 10), "## Active Locks": (0.70, 10),
    "## Active Agents": (0.60, 10), "New decisions:": (0.55, 5), "Recent decisions:": (0.50, 5), "New knowledge:": (0.45, 3), "## Feed": (0.40, 10), "Activity since last boot:": (0.30, None),
}
MESSAGE_CHARS, KNOWLEDGE_CHARS = 200, 100


def _newest(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """The n newest rows, with pos from 1."""
    top = df.orderBy(F.desc(ts), F.desc("id")).limit(n)
    return top.withColumn("one", F.lit(1)).transform(lambda t: rank_within(t, ["one"], [F.desc(ts), F.desc("id")], "pos")).drop("one")


def _lines(rows: DataFrame, section: str, line: Column, joint: str = "\n- ") -> DataFrame:
    """(agent, section, text) of rows (agent, pos), ``SECTIONS``' quota of them at most."""
    lists = rows.select("agent", F.struct("pos", line.alias("line")).alias("x")).groupBy("agent").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["line"]).alias("l"))
    return lists.select("agent", F.lit(section).alias("section"), F.concat(F.lit(section), F.lit(joint), F.array_join("l", joint)).alias("text"))


def _quota(section: str) -> int:
    return SECTIONS[section][1]


def _shared(agents: DataFrame, newest: DataFrame, keep: Column, section: str) -> DataFrame:
    """Agents with the rows of a short list (``newest``, bounded by quotas) that concern them, numbered anew."""
    met = agents.crossJoin(F.broadcast(newest)).where(keep)
    return rank_within(met, ["agent"], [F.col("pos")], "nth").where(F.col("nth") <= _quota(section)).drop("pos").withColumnRenamed("nth", "pos")


def _by_author(df: DataFrame, n: int, author: str) -> DataFrame:
    """Newest rows enough for every agent's ``n`` newest that are not its own: twice n, when none has over n by one author."""
    few = rank_within(df, [author], [F.desc("ts"), F.desc("id")], "__rn").where(F.col("__rn") <= n).drop("__rn")
    return _newest(few, 2 * n)


def activity(agents: DataFrame, events: DataFrame, span: int = 3600) -> DataFrame:
    """(agent, kind, n): events (kind, ts) after each agent's last_boot. Whole spans are added up once; in a cursor's own span it meets counts by time, not events."""
    at = lambda c: F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))
    cell = lambda t: F.floor(t / F.lit(span * 1_000_000)).cast("long")
    counts = events.select("kind", at("ts").alias("t")).groupBy("kind", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("span", cell(F.col("t")))
    spans = counts.groupBy("kind", "span").agg(F.sum("n").alias("n"))
    cursors = agents.where("last_boot is not null").select("agent", at("last_boot").alias("cursor")).withColumn("own", cell(F.col("cursor")))
    # every kind's spans and the cursors' spans in one order: what comes later than a cursor's span is a running sum. Pairs of kind and cursor span are no more than the result's rows
    marks = spans.select("kind").distinct().crossJoin(cursors.select(F.col("own").alias("span")).distinct()).select("kind", "span", F.lit(0).cast("long").alias("n"))
    later = F.sum("n").over(Window.partitionBy("kind").orderBy(F.desc("span")).rangeBetween(Window.unboundedPreceding, -1))
    starts = spans.unionByName(marks).groupBy("kind", "span").agg(F.sum("n").alias("n")).withColumn("n", later).where("n > 0")
    whole = cursors.join(starts.withColumnRenamed("span", "own"), "own").select("agent", "kind", "n")
    part = cursors.join(counts, F.col("own") == F.col("span")).where("t > cursor").select("agent", "kind", "n")
    return whole.unionByName(part).groupBy("agent", "kind").agg(F.sum("n").alias("n"))


def capsule_items(agents: DataFrame, messages: DataFrame, sessions: DataFrame, locks: DataFrame, feed: DataFrame, tasks: DataFrame, decisions: DataFrame, memories: DataFrame, events: DataFrame) -> DataFrame:
    """(agent, section, priority, text, tokens) for agents (agent, last_boot, seen_ts, seen_id; nulls: never).

    messages: id, recipient, sender, text, ts. sessions: id, agent, project, description, ts. locks: id, path, holder, ts. feed: id, author, kind, summary, ts.
    tasks: id, title, priority, status, owner. decisions: id, text, author, status, disputes, ts. memories: id, text, kind, status, ts. events: kind, ts.

    What all agents share is cut to a section's quota before it meets them: the newest rows since a cursor are the newest
    of all, less those before it. Rows of one's own are left out of agents and feed. Agents that come for the first time get recent decisions in place of what is new.
    """
    shown = lambda c: F.coalesce(F.col(c), F.lit("?"))
    since = lambda c: F.col("last_boot").isNotNull() & (F.col(c) >= F.col("last_boot"))
    level = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("priority"))
    own = lambda df, key, order, section: rank_within(df.withColumnRenamed(key, "agent").join(agents.select("agent"), "agent", "left_semi"), ["agent"], order, "pos").where(F.col("pos") <= _quota(section))
    parts = []

    def add(rows: DataFrame, section: str, line: Column) -> None:
        parts.append(_lines(rows, section, line))

    new = [F.desc("ts"), F.desc("id")]
    add(own(messages, "recipient", new, "## Pending Messages"), "## Pending Messages", F.concat(F.lit("From "), shown("sender"), F.lit(': "'), F.left(F.coalesce("text", F.lit("")), F.lit(MESSAGE_CHARS)), F.lit('"')))
    others = _by_author(sessions.withColumnRenamed("agent", "who"), _quota("## Active Agents"), "who")
    add(_shared(agents, others, F.col("who") != F.col("agent"), "## Active Agents"), "## Active Agents", F.concat(shown("who"), F.lit(" working on "), F.coalesce("project", F.lit("unknown")), F.lit(': "'), F.coalesce("description", F.lit("no description")), F.lit('"')))
    add(_shared(agents, _newest(locks, _quota("## Active Locks")), F.lit(True), "## Active Locks"), "## Active Locks", F.concat(shown("path"), F.lit(" locked by "), shown("holder")))
    unseen = F.col("seen_ts").isNull() | (F.col("ts") > F.col("seen_ts")) | ((F.col("ts") == F.col("seen_ts")) & (F.col("id") > F.col("seen_id")))
    add(_shared(agents, _by_author(feed, _quota("## Feed"), "author"), (F.col("author") != F.col("agent")) & unseen, "## Feed"), "## Feed", F.concat(F.lit("["), shown("kind"), F.lit("] "), shown("author"), F.lit(": "), F.coalesce("summary", F.lit(""))))
    todo = tasks.where("status = 'pending'").withColumn("lvl", level).orderBy("lvl", "id").limit(_quota("## Pending Tasks"))
    todo = rank_within(todo.withColumn("one", F.lit(1)), ["one"], [F.col("lvl"), F.col("id")], "pos").drop("one")
    task = F.concat(F.lit("["), shown("priority"), F.lit("] "), shown("title"))
    add(_shared(agents, todo, F.lit(True), "## Pending Tasks"), "## Pending Tasks", task)
    add(own(tasks.where("status = 'claimed'").withColumn("lvl", level), "owner", [F.col("lvl"), F.col("id")], "## Your Active Tasks"), "## Your Active Tasks", task)
    open_ = _newest(decisions.where("status = 'disputed'"), _quota("CONFLICTS:"))
    partner = decisions.select(F.col("id").alias("disputes"), F.col("text").alias("text2"), F.col("author").alias("author2"))
    pairs = open_.join(partner, "disputes", "left")
    told = F.concat(F.lit("#"), F.col("id"), F.lit(" ("), shown("author"), F.lit("): "), F.coalesce("text", F.lit("")), F.coalesce(F.concat(F.lit(" vs #"), F.col("disputes"), F.lit(" ("), F.coalesce("author2", F.lit("?")), F.lit("): "), F.col("text2")), F.lit("")))
    add(_shared(agents, pairs.select("pos", told.alias("line")), F.lit(True), "CONFLICTS:"), "CONFLICTS:", F.col("line"))
    made = _newest(decisions.where("status = 'active'"), _quota("New decisions:"))
    add(_shared(agents, made, since("ts"), "New decisions:"), "New decisions:", F.concat(F.lit("["), shown("author"), F.lit("] "), F.coalesce("text", F.lit(""))))
    add(_shared(agents, made, F.col("last_boot").isNull(), "Recent decisions:"), "Recent decisions:", F.coalesce("text", F.lit("")))
    learnt = _newest(memories.where("status = 'active' and coalesce(kind, '') <> 'state'"), _quota("New knowledge:"))
    add(_shared(agents, learnt, since("ts"), "New knowledge:"), "New knowledge:", F.concat(F.lit("["), shown("kind"), F.lit("] "), F.left(F.coalesce("text", F.lit("")), F.lit(KNOWLEDGE_CHARS))))
    done = activity(agents, events).select("agent", F.col("kind").alias("pos"), "n")
    lists = done.groupBy("agent").agg(F.array_sort(F.collect_list(F.struct("pos", "n"))).alias("l"))  # one for each kind of event
    kinds = F.array_join(F.transform("l", lambda x: F.concat(x["n"], F.lit(" "), F.translate(x["pos"], "_", " "))), ", ")
    parts.append(lists.select("agent", F.lit("Activity since last boot:").alias("section"), F.concat(F.lit("Activity since last boot: "), kinds).alias("text")))
    every = reduce(DataFrame.unionByName, parts)
    value = F.create_map(*[F.lit(x) for k, (p, _) in SECTIONS.items() for x in (k, p)])
    return every.select("agent", "section", value[F.col("section")].alias("priority"), "text", T.tokens(F.col("text")).alias("tokens"))


def context_capsule(items: DataFrame, budget: int) -> DataFrame:
    """(agent, section, used): the sections that fit an agent's budget of tokens, by priority. An agent has as many items as there are sections."""
    packed = pack_greedy(items.select(F.col("agent").alias("context"), F.col("section").alias("name"), "tokens", "priority"), budget)
    return packed.select(F.col("context").alias("agent"), F.col("name").alias("section"), "used")
