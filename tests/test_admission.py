"""Batches admitted in rounds against a pass row by row."""

from __future__ import annotations

import random

import pytest

from mnemospark.operators import admission as A

NEG, FLIPS = ["not"], [("on", "off")]
ROWS = "id long, agent string, trust double, tokens array<string>"


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def kind(a, b, s):
    na, nb = "not" in a, "not" in b
    core = jaccard(set(a) - {"not"}, set(b) - {"not"})
    flip = any(x in a and y in b or y in a and x in b for x, y in FLIPS)
    if (flip and s >= 0.55) if na == nb else core >= 0.35:
        return "CONTRADICTS"
    return "AGREES" if s >= 0.84 else "REFINES"


def in_order(batch, base, least=0.4):
    active, out = {r[0]: r for r in base if r[3]}, {}
    for i, agent, trust, tokens in sorted(batch):
        near = [(-round(jaccard(tokens, r[3]), 9), r[0]) for r in active.values() if tokens and jaccard(tokens, r[3]) >= least - 1e-9]
        if not near:
            out[i] = ("insert", None, "UNRELATED")
        else:
            t = active[min(near)[1]]
            k = kind(tokens, t[3], jaccard(tokens, t[3]))
            if k == "AGREES":
                out[i] = ("merge", t[0], k)
                continue
            win = trust > t[2] if k == "CONTRADICTS" else agent == t[1] or trust >= t[2]
            out[i] = ("supersede" if win else "dispute", t[0], k)
            if not win:
                continue
            del active[t[0]]
        if tokens:
            active[i] = (i, agent, trust, tokens)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_rounds_equal_a_pass_row_by_row(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(9 + seed)] + ["on", "off", "not"]
    row = lambda i: (i, rng.choice("ab"), rng.choice([0.2, 0.5, 0.8]), sorted(rng.sample(vocabulary, rng.choice([0, 2, 3, 4, 5, 6]))))
    rows = [row(i) for i in range(40)]
    rows += [(200 + i, rng.choice("ab"), rng.choice([0.2, 0.5, 0.8]), rows[rng.choice([3, 20, 30])][3]) for i in range(20)]  # copies
    rng.shuffle(rows)
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    base, batch = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    got = A.resolve_in_order(spark.createDataFrame(batch, ROWS), spark.createDataFrame(base, ROWS), negations=NEG, flips=FLIPS)
    want = in_order(batch, base)
    assert {r["id"]: (r["action"], r["target"], r["class"]) for r in got.collect()} == want
    assert {a for a, _, _ in want.values()} == {"insert", "merge", "supersede", "dispute"}


def test_copies_take_few_rounds(spark):
    rows = [(i, "a", 0.5, ["x", "y"]) for i in range(3000)] + [(5000, "a", 0.5, ["z"])]
    got = A.resolve_in_order(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], ROWS), max_rounds=1)
    assert got.where("action = 'merge' and target = 0").count() == 2999 and got.where("action = 'insert'").count() == 2


def test_a_batch_that_does_not_settle_is_an_error(spark):
    rows = [(i, "a", 0.5, [f"w{i}", f"w{i + 1}", f"w{i + 2}"]) for i in range(12)]
    with pytest.raises(RuntimeError):
        A.resolve_in_order(spark.createDataFrame(rows, ROWS), spark.createDataFrame([], ROWS), max_rounds=2)


def test_admitted_table(spark):
    base = spark.createDataFrame([(1, "a", 0.5, "use the red build for every release we make", "old note", 10.0, 60, 0, "active"), (2, "a", 0.9, "keep the logs of the server for thirty days", None, 1.0, None, 2, "active"), (3, "b", 0.9, "use the red build for every release we make", None, 1.0, 50, 0, "archived")], "id long, agent string, trust double, text string, context string, score double, quality int, merged long, status string")
    batch = spark.createDataFrame([(11, "b", 0.1, "Use the red build for every release we make", " Second Note "), (12, "b", 0.1, "use the red build for every release we make", "second note"), (13, "b", 0.1, "use the red build for every release we make", None), (14, "b", 0.1, "never keep the logs of the server for thirty days", None), (15, "b", 0.1, "ok?", None), (16, "c", 0.2, "something else that nobody has said so far, in src/main.rs", None), (17, "c", 0.2, None, "x")], "id long, agent string, trust double, text string, context string")
    decisions, table = A.admit_batch(batch, base)
    assert {r["id"]: (r["action"], r["target"]) for r in decisions.collect()} == {11: ("merge", 1), 12: ("merge", 1), 13: ("merge", 1), 14: ("dispute", 2), 15: ("reject", None), 16: ("insert", None), 17: ("reject", None)}
    rows = {r["id"]: r for r in table.collect()}
    assert {i: r["status"] for i, r in rows.items()} == {1: "active", 2: "active", 3: "archived", 14: "disputed", 16: "active"}
    assert (rows[1]["score"], rows[1]["merged"], rows[1]["context"]) == (25.0, 3, "old note\n\nSecond Note") and rows[1]["quality"] >= 60
    assert (rows[2]["score"], rows[2]["quality"], rows[2]["context"]) == (1.0, None, None)
