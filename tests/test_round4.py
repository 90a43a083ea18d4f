"""Findings of round 4."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mnemospark.llm import line_dedup as L
from mnemospark.operators import admission as A
from mnemospark.operators import aggregates as agg
from mnemospark.operators import joins as J
from mnemospark.operators import set_pairs as P
from tests.test_admission import FLIPS, NEG, ROWS, in_order


def test_all_items_of_a_basket_are_paired(spark):  # F9
    baskets = [([f"s{(k * 7 + j * 3) % 40:02}" for j in range(k)], k) for k in (0, 1, 2, 9, 14, 30)] + [(["s01", "s01", None, "s02"], 99)]
    df = spark.createDataFrame(baskets, "items array<string>, seen int")
    pairs = [(p, seen) for items, seen in baskets for p in itertools.combinations(sorted({x for x in items if x}), 2)]
    want = {(*p, n, max(t for q, t in pairs if q == p)) for p, n in Counter(p for p, _ in pairs).items()}
    assert {tuple(r) for r in agg.co_occurrence(df).collect()} == want and len(want) > 300
    of = spark.createDataFrame([("s05",), ("s05",), ("s36",), ("none",)], "item string")
    assert {tuple(r) for r in agg.co_occurrence(df, of=of).collect()} == {w for w in want if {"s05", "s36"} & set(w[:2])}
    first = {p for items, _ in baskets for p in itertools.combinations(sorted({x for x in items if x})[:10], 2)}
    assert {(r["a"], r["b"]) for r in agg.co_occurrence(df, 10).collect()} == first


def _block(sets, least, common, bits=64):
    n = np.array([len(s) for s in sets], np.int64)
    hashes = P.ordered(np.array([h for s in sets for h in s], np.uint32), n, np.array(common, np.uint32))
    held = P.prefix_length(n, P.eased(least))
    first = np.arange(len(hashes)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(held, n)
    odd = P.parity_maps(hashes, n, np.full(len(n), bits))
    return P.Block(pa.table({"n": n, "prefix": P.binaries(hashes[first], held), "odd": pa.array(odd, pa.binary())}))


@pytest.mark.parametrize("least", [0.4, 0.6, 1.0])
def test_prefixes_leave_out_no_pair_and_meet_few(monkeypatch, least):  # F3 to F8
    """Small chunks, hashes that several tokens share, sets that share frequent tokens with all others."""
    monkeypatch.setattr(P, "_MATCHES", 7)
    monkeypatch.setattr(P, "_ROWS", 5)
    rng = random.Random(int(10 * least))
    draw = lambda k: [rng.randrange(1000, 1400) for _ in range(k)] + list(range(k))
    base = [draw(rng.randint(1, 12)) for _ in range(60)]
    sets = base + [s[: rng.randint(1, len(s))] + draw(1) for s in base]
    common = list(range(11, -1, -1))
    x, y = _block(sets, least, common), _block(sets[::-1], least, common, 128)

    def share(a, b):  # with repeats
        both = sum((Counter(a) & Counter(b)).values())
        return both / (len(a) + len(b) - both)

    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[::-1]) if len(b) <= len(a) and share(a, b) >= least}
    got = set(zip(*(v.tolist() for v in P.may_meet(x, y, least, False)), strict=True))
    assert want <= got and len(want) >= len(sets) and len(got) < len(sets) ** 2 / 4
    less = set(zip(*(v.tolist() for v in P.may_meet(x, y, least, True)), strict=True))
    assert less == {(i, j) for i, j in got if len(sets[::-1][j]) < len(sets[i])}


def test_pairs_of_sets_are_compared_once(spark):  # F3 to F8
    rows = [(k, [f"w{j}" for j in range(k % 5, 9)]) for k in range(12)] + [(99, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    pairs = J.jaccard_join(df, df, 0.6, selfjoin=True)
    assert pairs._jdf.queryExecution().optimizedPlan().toString().count("array_intersect") == 1
    want = {(a, b): len(set(x) & set(y)) / len(set(x) | set(y)) for (a, x), (b, y) in itertools.combinations(rows[:-1], 2)}
    assert {(r["a"], r["b"]): r["jaccard"] for r in pairs.collect()} == {k: v for k, v in want.items() if v >= 0.6}


@pytest.mark.parametrize("seed", range(2))
def test_long_chains_are_passed_over_in_one_task(spark, seed):  # F2
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["on", "off", "not"]
    trust = lambda: rng.choice([0.2, 0.5, 0.8])
    rows = [(rng.choice("ab"), trust(), sorted(rng.sample(words, rng.choice([0, 2, 3, 4, 5])))) for _ in range(70)]
    rows += [(rng.choice("ab"), trust(), [f"v{i}", f"v{i + 1}", f"v{i + 2}"]) for i in range(40)]  # one chain
    rows += [rows[rng.randrange(20)] for _ in range(30)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    base, batch = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    frame = lambda t: spark.createDataFrame(t, ROWS)
    want = in_order(batch, base)
    for rounds, most in ((1, 1_000_000), (200, 400)):  # at once, and after some rounds
        got = A.resolve_in_order(frame(batch), frame(base), negations=NEG, flips=FLIPS, max_rounds=rounds, in_one=most)
        assert {r["id"]: (r["action"], r["target"], r["class"]) for r in got.collect()} == want


def test_pairs_of_lines_are_sent_in_passes(spark):  # F1
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinsrh") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    lines = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 4, 8, 8, 9, 15, 15, 40, 41) for _ in range(3)]
    lines += [x[:k] + "q" + x[k + 1 :] for x in lines for k in (1, len(x) // 2)]
    df = spark.createDataFrame([(k, k, x) for k, x in enumerate(lines)], "id long, label long, norm string")
    want = {tuple(sorted((r["a"], r["b"]))) for r in L.all_links(df, 0.8, block=25).collect()}
    chars = sum(map(len, lines))
    written = []
    real = L.materialize

    def kept(table, name):
        written.append(name)
        return real(table, name)

    L.materialize = kept
    try:
        got = L.all_links(df, 0.8, block=25, block_chars=400, pass_chars=chars).collect()
    finally:
        L.materialize = real
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in got) == sorted(want) and len(want) > len(lines) / 2
    assert written.count("line-links") > 3
