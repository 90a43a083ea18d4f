"""Admission of a batch in which rows supersede, merge with and dispute each other as if they came one by one.

A row meets the active rows, of the base and of the batch before it, that share its owner's words; the likest decides. What a
row reads and changes lies among the classes of equal token sets next to its own. So in a round all classes
decide whose first open row comes before every open row within two steps of likeness: those can't touch each other. A
class decides its rows up to the next such row of another class at once: rows before the first that wins are disputed, that one
takes the target's place, and those behind merge into it. So copies cost no rounds, and rounds are as many as the
longest chain of different texts that wait for each other. Where a bound is given, one task passes over the rows left in order
as soon as the classes that they read fit it, so long chains take no rounds of their own.
"""

from __future__ import annotations

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.functions import text as T
from mnemospark.operators import joins as J
from mnemospark.operators.jobs import AGREES, FLIPS, NEGATIONS, RELATED, contradiction
from mnemospark.plans.scratch import discard, materialize

#: fixed value: what a merge adds to the target's score
MERGE_BONUS = 5.0
#: Edges between classes, open and active rows that one task takes, whose memory this bounds.
IN_ONE = 4_000_000
KINDS = ("CONTRADICTS", "AGREES", "REFINES")


def _relations(rows: DataFrame, least: float, negations, flips) -> tuple[DataFrame, DataFrame]:
    """(membership, edges) of rows (id, tokens): (class, id), and (c, d, jaccard, kind) between classes alike, both ways and with itself."""
    reps, members = J.jaccard_classes(rows)
    reps = materialize(reps, "admit-classes")
    pairs = materialize(J.jaccard_join(reps, reps, least, selfjoin=True), "admit-pairs")
    same = reps.where(F.size("tokens") > 0).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    side = lambda c: reps.select(F.col("id").alias(c), F.col("tokens").alias(f"t{c}"))
    both = pairs.unionByName(same).join(side("a"), "a").join(side("b"), "b")
    against = contradiction(F.col("ta"), F.col("tb"), F.col("jaccard"), negations, flips)
    kind = F.when(against, "CONTRADICTS").when(F.col("jaccard") >= AGREES, "AGREES").otherwise("REFINES")
    one = both.select(F.col("a").alias("c"), F.col("b").alias("d"), F.round("jaccard", 9).alias("jaccard"), kind.alias("kind"))
    edges = one.unionByName(one.where("c <> d").select(F.col("d").alias("c"), F.col("c").alias("d"), "jaccard", "kind"))
    return members.select(F.col("id").alias("class"), F.col("member").alias("id")), materialize(edges, "admit-edges")


def _wins(kind: Column) -> Column:
    """Whether an open row takes the place of the target: against contradictions by more trust, against refinements as the same agent or with as much."""
    more = F.col("trust") > F.col("trust2")
    return F.when(kind == "CONTRADICTS", more).when(kind == "REFINES", more | (F.col("trust") == F.col("trust2")) | F.col("agent").eqNullSafe(F.col("agent2"))).otherwise(F.lit(False))


def _pass_in_order(open_: DataFrame, active: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, action, target, class) of the open rows by one pass over ascending ids in one task.

    Rows (id, class, agent, trust); edges (c, d, jaccard, kind) of the open rows' classes, both ways and with themselves.
    """
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda t, part: t.select(F.lit(part).alias("part"), "id", "class", none("long").alias("other"), F.col("agent").cast("string").alias("agent"), "trust", none("int").alias("kind"))
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    edge = edges.select(F.lit(2).alias("part"), none("long").alias("id"), F.col("c").alias("class"), F.col("d").alias("other"), none("string").alias("agent"), F.col("jaccard").alias("trust"), kind.alias("kind"))

    def settle(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        cut = lambda k: table.filter(pa.array(part == k))
        known, links = cut(1), cut(2)
        facts = {i: (c, a, t) for i, c, a, t in zip(*(known[x].to_pylist() for x in ("id", "class", "agent", "trust")), strict=True)}
        heaps: dict[int, list[int]] = {}
        for i, (c, _, _) in facts.items():
            heaps.setdefault(c, []).append(i)
        for heap in heaps.values():
            heapq.heapify(heap)
        source = links["class"].to_numpy()
        by = np.argsort(source, kind="stable")
        source, other, likeness, kinds = source[by], links["other"].to_numpy()[by], links["trust"].to_numpy()[by], links["kind"].to_numpy()[by]
        rows = cut(0)
        first, last = np.searchsorted(source, rows["class"].to_numpy(), "left"), np.searchsorted(source, rows["class"].to_numpy(), "right")
        fields = [rows[x].to_pylist() for x in ("id", "class", "agent", "trust")]
        ids, classes, agents, trusts = fields
        nan = lambda x: x is not None and x != x  # noqa: E731  (Spark has NaN equal to itself and above all else)
        more = lambda x, y: x is not None and y is not None and (x > y or nan(x) and not nan(y))
        even = lambda x, y: x is not None and y is not None and (x == y or nan(x) and nan(y))
        gone: set[int] = set()
        out: list[tuple] = []
        for k in sorted(range(len(ids)), key=ids.__getitem__):
            i, c, agent, trust = ids[k], classes[k], agents[k], trusts[k]
            best = None
            for d, s, kind in zip(other[first[k] : last[k]].tolist(), likeness[first[k] : last[k]].tolist(), kinds[first[k] : last[k]].tolist(), strict=True):
                heap = heaps.get(d)
                while heap and heap[0] in gone:
                    heapq.heappop(heap)
                if heap and (best is None or (s, -heap[0]) > best[:2]):
                    best = (s, -heap[0], KINDS[kind])
            if best is None:
                out.append((i, "insert", None, "UNRELATED"))
            else:
                target, kind = -best[1], best[2]
                _, agent2, trust2 = facts[target]
                wins = kind == "CONTRADICTS" and more(trust, trust2) or kind == "REFINES" and (more(trust, trust2) or even(trust, trust2) or agent == agent2)
                out.append((i, "merge" if kind == "AGREES" else "supersede" if wins else "dispute", target, kind))
                if not wins:
                    continue
                gone.add(target)
            facts[i] = (c, agent, trust)
            heapq.heappush(heaps.setdefault(c, []), i)
        cells = list(zip(*out, strict=True)) or [[], [], [], []]
        types = (pa.int64(), pa.string(), pa.int64(), pa.string())
        return pa.table({n: pa.array(v, t) for n, v, t in zip(("id", "action", "target", "class"), cells, types, strict=True)})

    every = row(open_, 0).unionByName(row(active, 1)).unionByName(edge).withColumn("all", F.lit(0))
    return every.groupBy("all").applyInArrow(lambda t: settle(t), "id long, action string, target long, class string")


def resolve_in_order(batch: DataFrame, base: DataFrame, least: float = RELATED, negations=NEGATIONS, flips=FLIPS, max_rounds: int = 200, in_one: int = 0) -> DataFrame:
    """(id, action, target, class) of batch rows (id, agent, trust, tokens) as a pass by ascending id over the active base (id, agent, trust, tokens) decides them.

    insert: nothing alike; merge: into the target; supersede: the row takes the target's place; dispute: it is kept beside it, and
    nothing is compared with it later. Ids are unique over both tables. Rows without tokens are inserted. As soon as the open rows, the active rows next to them
    and their classes' edges are no more than ``in_one``, one task passes over them in order. It raises an error after ``max_rounds``.
    """
    columns = ["id", "agent", "trust", "tokens"]
    incoming, known = batch.select(columns), base.select(columns)
    members, edges = _relations(incoming.select("id", "tokens").unionByName(known.select("id", "tokens")), least, negations, flips)
    placed = lambda t: t.select("id", "agent", F.col("trust").cast("double").alias("trust"), (F.size("tokens") > 0).alias("some")).join(members, "id")
    rows = materialize(placed(incoming), "admit-rows")
    active = materialize(placed(known).where("some").drop("some"), "admit-active")
    open_, out = materialize(rows.where("some").drop("some"), "admit-open"), []
    nobody = rows.where("not some").select("id", F.lit("insert").alias("action"), F.lit(None).cast("long").alias("target"), F.lit("UNRELATED").alias("class"))
    stern = edges.where("c = d and kind = 'CONTRADICTS'").select(F.col("c").alias("class"), F.lit(True).alias("stern"))
    last = None
    while not open_.isEmpty():
        if in_one:
            asked = edges.join(open_.select(F.col("class").alias("c")).distinct(), "c", "left_semi")
            beside_open = active.join(asked.select(F.col("d").alias("class")).distinct(), "class", "left_semi")
            if asked.count() + open_.count() + beside_open.count() <= in_one:
                last = materialize(_pass_in_order(open_, beside_open, asked), "admit-decided")
                break
        if len(out) >= max_rounds:
            raise RuntimeError(f"a batch did not settle in {max_rounds} rounds")
        first = materialize(open_.groupBy("class").agg(F.min("id").alias("u")), "admit-first")
        near = edges.join(first.select(F.col("class").alias("d"), "u"), "d").groupBy("c").agg(F.min("u").alias("low"))
        lowest = edges.join(near.withColumnRenamed("c", "d"), "d").groupBy(F.col("c").alias("class")).agg(F.min("low").alias("low"))
        ready = materialize(first.join(lowest, "class").where("u = low").select("class"), "admit-ready")
        # each class beside a ready one has no other ready one beside it, so this join has a row an edge at most
        beside = edges.join(ready.withColumnRenamed("class", "c"), "c").select(F.col("c").alias("class"), F.col("d").alias("r"))
        limit = beside.join(edges.select(F.col("c").alias("r"), "d"), "r").where("d <> class").join(first.select(F.col("class").alias("d"), "u"), "d").groupBy("class").agg(F.min("u").alias("until"))
        heads = active.groupBy(F.col("class").alias("d")).agg(F.min_by(F.struct("id", "agent", "trust"), "id").alias("h"))
        likest = F.max(F.struct("jaccard", (-F.col("h.id")).alias("back"), "kind", F.col("h.agent").alias("agent2"), F.col("h.trust").alias("trust2"))).alias("x")
        targets = edges.join(ready.withColumnRenamed("class", "c"), "c").join(heads, "d").groupBy(F.col("c").alias("class")).agg(likest).select("class", (-F.col("x.back")).alias("target"), "x.kind", "x.agent2", "x.trust2")
        runs = open_.join(ready, "class").join(limit, "class", "left").join(stern, "class", "left").join(first, "class").where((F.col("until").isNull() | (F.col("id") < F.col("until"))) & (F.col("stern").isNull() | (F.col("id") == F.col("u"))))
        met = runs.join(targets, "class", "left").withColumn("wins", F.col("target").isNull() | _wins(F.col("kind")))
        winner = met.where("wins").groupBy("class").agg(F.min("id").alias("winner"))
        after = met.join(winner, "class", "left")
        action = (
            F.when((F.col("kind") == "AGREES") | (F.col("id") > F.col("winner")), "merge")
            .when(F.col("id") == F.col("winner"), F.when(F.col("target").isNull(), "insert").otherwise("supersede"))
            .otherwise("dispute")
        )
        behind = F.col("id") > F.col("winner")
        decided = after.select("id", "class", "agent", "trust", action.alias("action"), F.when(behind, F.col("winner")).otherwise(F.col("target")).alias("target"), F.when(behind, "AGREES").otherwise(F.coalesce("kind", F.lit("UNRELATED"))).alias("kind"))
        decided = materialize(decided, "admit-decided")
        out.append(decided)
        gone = decided.where("action = 'supersede'").select(F.col("target").alias("id"))
        new = decided.where("action in ('insert', 'supersede')").select(active.columns)
        still, rest = materialize(active.join(gone, "id", "left_anti").unionByName(new), "admit-active"), materialize(open_.join(decided.select("id"), "id", "left_anti"), "admit-open")
        discard(active, open_, first, ready)
        active, open_ = still, rest
    found = [d.select("id", "action", "target", F.col("kind").alias("class")) for d in out]
    return reduce(DataFrame.unionByName, found if last is None else [*found, last], nobody)


def fold_merges(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows (id, text, context, score, quality, merged) with what merged into them: ``MERGE_BONUS`` a merge, the best quality, the notes.

    ``rows`` holds the base and the batch; ``decisions`` are those of ``resolve_in_order``. A merged row's note is its context or else its text, trimmed; notes that
    are empty, equal the target's text or a note already there, whatever their case, add nothing. They follow by id, parted by an empty line.
    """
    merged = decisions.where("action = 'merge'").select("id", "target").join(rows.select("id", "text", "context", "quality"), "id")
    trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
    note = F.when(trimmed("context") != "", trimmed("context")).otherwise(trimmed("text"))
    sums = merged.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("more"), F.max("quality").alias("best"))
    told = merged.select("target", "id", note.alias("note")).where("note <> ''").groupBy("target", F.lower("note").alias("low")).agg(F.min(F.struct("id", "note")).alias("n"))
    own = rows.select(F.col("id").alias("target"), F.lower(trimmed("text")).alias("own"), F.explode_outer(F.transform(F.split(F.coalesce("context", F.lit("")), "\n\n"), lambda p: F.lower(F.trim(p)))).alias("part"))
    fresh = told.join(own.select("target", F.col("own").alias("low")), ["target", "low"], "left_anti").join(own.select("target", F.col("part").alias("low")), ["target", "low"], "left_anti")
    notes = fresh.groupBy(F.col("target").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["note"]), "\n\n").alias("notes"))  # distinct notes: what the row holds in the end
    j = rows.join(sums, "id", "left").join(notes, "id", "left")
    context = F.when(F.col("notes").isNull(), F.col("context")).when(trimmed("context") == "", F.col("notes")).otherwise(F.concat_ws("\n\n", "context", "notes"))
    return j.select(
        "id",
        "text",
        context.alias("context"),
        (F.coalesce("score", F.lit(0.0)) + F.coalesce("more", F.lit(0)) * MERGE_BONUS).alias("score"),
        F.when(F.col("more") > 0, F.greatest(F.coalesce("quality", F.lit(50)), "best")).otherwise(F.col("quality")).alias("quality"),
        (F.coalesce("merged", F.lit(0)) + F.coalesce("more", F.lit(0))).cast("long").alias("merged"),
    )


def admit_batch(batch: DataFrame, base: DataFrame, least_quality: int = 20, least: float = RELATED, negations=NEGATIONS, flips=FLIPS) -> tuple[DataFrame, DataFrame]:
    """(decisions, table) of a batch (id, agent, trust, text, context) against a base with also score, quality, merged and status.

    Rows whose text is of a quality under ``least_quality`` are rejected before they meet anything. The table holds the base and what the batch adds to it, with
    ``status`` active, superseded or disputed; merged and rejected rows are not in it. Base rows that are not active meet nothing and stay as they are.
    """
    words = lambda t: t.withColumn("tokens", T.token_set(F.coalesce("text", F.lit("")), "lower2"))
    graded = materialize(batch.select("id", "agent", "trust", "text", "context", T.quality(F.coalesce("text", F.lit(""))).alias("quality")), "admit-batch")
    good, poor = graded.where(F.col("quality") >= least_quality), graded.where(F.col("quality") < least_quality)
    decided = materialize(resolve_in_order(words(good), words(base.where("status = 'active'")), least, negations, flips, in_one=IN_ONE), "admit-decisions")
    fields = ["id", "text", "context", "score", "quality", "merged"]
    both = base.select(fields).unionByName(good.select("id", "text", "context", F.lit(0.0).alias("score"), "quality", F.lit(0).cast("long").alias("merged")))
    folded = fold_merges(both, decided)
    gone = decided.where("action = 'supersede'").select(F.col("target").alias("id"), F.lit("superseded").alias("lost"))
    came = decided.where("action <> 'merge'").select("id", F.when(F.col("action") == "dispute", "disputed").otherwise("active").alias("came"))
    old = base.select("id", F.col("status").alias("was"))
    table = folded.join(came.join(old, "id", "full"), "id").join(gone, "id", "left").withColumn("status", F.coalesce("lost", "came", "was")).select(*fields, "status")
    reject = poor.select("id", F.lit("reject").alias("action"), F.lit(None).cast("long").alias("target"), F.lit(None).cast("string").alias("class"))
    return decided.unionByName(reject), table
