"""Sharding, the conversation trie and the Merkle manifest against brute force and odd tables."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest

from mnemospark.llm import merkle, prefix_trie, sharding

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (None, " \t"), (None, "a b"), (-5, "a b"), (7, "A b"), (7, "A b"), (8, "ab" * 50_000)]

# Sharding -----------------------------------------------------------------------------------------


def check_shards(rows, n_shards):
    per = collections.defaultdict(list)
    for r in rows:
        per[r["shard"]].append(r["slot"])
        assert 0 <= r["shard"] < n_shards and r["law"] == "bytes" and r["grown_shard"] is None
    assert all(sorted(p) == list(range(len(p))) for p in per.values())


def test_shards_hold_all_documents_in_equal_sizes(spark, data, duck):
    got = sharding.op11_sharding(spark, data).collect()
    want = {d: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in duck.execute("select doc_id, text from documents").fetchall()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == want and len(got) == len(want)
    check_shards(got, 16)
    loads = collections.Counter()
    for r in got:
        loads[r["shard"]] += r["size"]
    assert max(loads.values()) - min(loads.values()) < max(s for s, _ in want.values())
    assert sorted(map(str, got)) == sorted(map(str, sharding.op11_sharding(spark, data).collect()))


def test_shards_of_odd_tables(spark):
    docs = spark.createDataFrame([(*r, "x", 1) for r in ODD], DOCS + ", shard string, slot int")
    got = sharding.shard(docs, 3, 16).collect()
    check_shards(got, 3)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in ODD)
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0


def test_repeated_rows_are_spread(spark):
    docs = spark.createDataFrame([(None, "same text")] * 4000 + [(i, f"text {i}") for i in range(4000)], DOCS).repartition(7)
    got = sharding.shard(docs, 8, 256).collect()
    check_shards(got, 8)
    counts = collections.Counter(r["shard"] for r in got)
    assert max(counts.values()) < 1.05 * min(counts.values())


@pytest.mark.parametrize("seed", range(4))
def test_a_new_shard_takes_slots_only_into_itself(seed):
    rng = random.Random(seed)
    slots = sharding.edit([sharding.Slot(s, s % 16, int(rng.paretovariate(2) * 1000)) for s in range(4096)], 16)
    loads = collections.Counter()
    for s in slots:
        loads[s.shard] += s.bytes
    mean = sum(loads.values()) / 16
    assert max(loads.values()) <= max(1.001 * mean, max(s.bytes for s in slots))
    grown = sharding.grow(slots, 16)
    moved = [(a, b) for a, b in zip(slots, grown, strict=True) if a.shard != b.shard]
    assert moved and all(b.shard == 16 for _, b in moved)
    assert abs(sum(s.bytes for s in grown if s.shard == 16) - 16 * mean / 17) < 0.02 * mean
    few = sharding.edit([sharding.Slot(s.slot, s.shard, s.bytes + (s.slot == 5) * 1000) for s in slots], 16)
    assert sum(a.shard != b.shard for a, b in zip(slots, few, strict=True)) < 200


def test_one_huge_slot_leaves_the_others_even():
    slots = sharding.edit([sharding.Slot(s, s % 4, 10**9 if s == 2 else 1000 + s) for s in range(64)], 4)
    loads = collections.Counter()
    for s in slots:
        loads[s.shard] += s.bytes
    *rest, most = sorted(loads.values())
    assert most == 10**9 and max(rest) - min(rest) < 50
    assert any(s.shard == 4 for s in sharding.grow(slots, 4))


def test_shards_are_written_whole_by_a_stored_map(spark, tmp_path):
    rows = [(*r, "x") for r in ODD] + [(i, f"text {i}", None) for i in range(100, 400)]
    docs = spark.createDataFrame(rows, DOCS + ", key string")
    placed = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in sharding.shard(docs, 4, 64, path=f"{tmp_path}/map").collect()}
    assert {r["version"] for r in spark.read.parquet(f"{tmp_path}/map").select("version").distinct().collect()} == {0, 1}
    sharding.write_shards(docs, f"{tmp_path}/map", 1, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(((r["doc_id"], r["text"], r["key"]) for r in back), key=str) == sorted(rows, key=str)
    for r in back:
        assert placed[r["doc_id"], zlib.crc32((r["text"] or "").encode())] == r["shard"]


# Trie ---------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(rows, rebuild=True):
    own = collections.defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((n is not None, n or 0, role, hashlib.sha256(text.encode()).digest(), text))
    own = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    full = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuild else 0
        full[c] = own.get(c - c % 5, [])[:h] + t[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, t in full.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
        ends[tuple(t)].append(c)
    kids = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def got_trie(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_trie_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])) for c in range(60) for t in range(rng.randrange(1, 14))]
    rows += [(c, t, "user", "same") for c in range(100, 160) for t in range(3)]  # one common conversation
    rows += [(500, t, "user", f"long {t // 3}") for t in range(700)] + [(505, t, "user", f"long {t // 3}") for t in range(650)]  # several chunks and bands
    rows += [(None, 1, "user", "x"), (3, None, None, None), (3, None, "user", "z"), (3, 2, "user", "tie"), (3, 2, "user", "tie"), (7001, 0, "user", "no base")]
    turns = spark.createDataFrame([(*r, 1, "x") for r in rows], TURNS + ", depth int, k1 string").repartition(5)
    assert got_trie(prefix_trie.trie(turns)) == brute_trie(rows)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0


def test_trie_of_plain_conversations(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (2, 0, "user", "a"), (3, 0, "user", "c")]
    plain = lambda turns: turns.unionByName(turns.selectExpr("conv_id").distinct().selectExpr("conv_id", "0L pos", "cast(null as binary) digest", "0L bytes"))
    assert got_trie(prefix_trie.trie(spark.createDataFrame(rows, TURNS), plain)) == brute_trie(rows, False)


def test_digest_pieces_join_without_a_seam(monkeypatch):
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict({"depth": [0] * 7 + [1], "k1": [1] * 8, "k2": [2] * 8, "conv_id": list(range(8))})
    pieces = [b for b in prefix_trie._chunks(iter([part]), most=3) if len(b)]
    got = [r for b in prefix_trie._digests(iter(pieces)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in got] == [hashlib.sha256(x).hexdigest() for x in (b"0,1,2,3,4,5,6", b"7")]


# Manifest -----------------------------------------------------------------------------------------

FULL = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """Levels of a tree and each leaf's siblings with their side."""
    rows, at = [list(leaves)], list(leaves)
    while len(at) > 1:
        at = [h(*at[i : i + 2]) for i in range(0, len(at), 2)]
        rows.append(at)
    ways = []
    for i in range(len(leaves)):
        way = []
        for level in rows[:-1]:
            j = i ^ 1
            way.append((level[j], j < i) if j < len(level) else None)
            i >>= 1
        ways.append(way)
    return at[0], ways


def brute_manifest(rows):
    def leaf(r):
        return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(r), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: brute_tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    root, above = brute_tree([trees[g][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for x, way in zip(sorted(by[g], key=lambda x: x[:3]), trees[g][1], strict=True):
            r, way = x[3], way + above[k]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = leaf((*r[:3], r[3] + 1, r[4])) if hit else x[2]
            for s in way:
                at = h(at) if s is None else h(s[0], at) if s[1] else h(at, s[0])
            out.append((r[0], x[2], trees[g][0], root, h(*(s[0] for s in way if s)), at, at == root))
    return sorted(out, key=str)


def got_manifest(df):
    return sorted((tuple(r[n] for n in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 21, 64, 77])
def test_manifest_equals_brute_force(spark, n):
    rng = random.Random(n)
    rows = [(i * 3, rng.choice(["s", None, ""]), "en" if i % 3 else rng.choice(["de", None, "ça", ""]), rng.choice([None, 0, 9, 99]), rng.choice(["", None, "é" * i, "x"])) for i in range(n)]
    if n > 20:
        rows += [(None, None, None, None, None), (None, "s", "en", 1, ""), (9, "s", "en", 1, ""), (9, "s", "en", 1, ""), (-4, "s", "en", 9, "x")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], FULL + ", tree int, leaf string").repartition(3)
    assert got_manifest(merkle.manifest(docs, height=2)) == brute_manifest(rows)


def test_manifest_of_one_and_of_many_languages(spark):
    one = [(i, "s", "en", i, f"t{i}") for i in range(9)]
    many = [(i, "s", f"l{i}", i, f"t{i}") for i in range(40)]
    for rows in (one, one[:1], many):
        assert got_manifest(merkle.manifest(spark.createDataFrame(rows, FULL), height=2)) == brute_manifest(rows)
    assert merkle.manifest(spark.createDataFrame([], FULL)).count() == 0


@pytest.mark.parametrize("n", [*range(1, 35), 64, 100])
def test_places_in_the_log(n):
    leaves = [hashlib.sha256(bytes([i])).digest() for i in range(n)]
    for top in {merkle.levels(n), 7}:
        log, level = merkle.segment(leaves, top), leaves
        for k in range(top + 1):
            for i, node in enumerate(level):
                p = merkle.place(n, k, i) * merkle.SIZE
                assert log[p : p + merkle.SIZE] == node
            level = [merkle.join(level[i : i + 2]) for i in range(0, len(level), 2)]
