"""Connected components over a table of edges, by joins.

Every node keeps a label, at first itself. A round takes the smallest label among a node and
its neighbours, then replaces each label by that label's own label (pointer jumping), so long
chains halve each round. It ends when no label changes. All steps are equi-joins and
aggregates that combine before the shuffle; labels that many nodes share make one side of a join
uneven, which adaptive execution splits, as the other side has one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.scratch import discard, materialize


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 100) -> DataFrame:
    """Rows (node, component) for every node of ``edges``; component is the smallest node reachable.

    Self edges, repeated edges and either direction are allowed; edges with a null end are ignored. An
    empty table gives an empty result. It raises an error after ``max_rounds``, never a partial result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    both = materialize(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        lower = materialize(lower, "labels-lower")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("root"))
        after = materialize(lower.join(jump, "label", "left").select("node", "old", F.least("label", "root").alias("label")), "labels")
        discard(lower, labels)
        if after.where("old <> label").isEmpty():
            discard(both)
            return after.select("node", F.col("label").alias("component"))
        labels = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
