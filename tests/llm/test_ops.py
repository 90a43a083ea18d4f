"""The training-data operators against brute force, round trips and planted cases."""

from __future__ import annotations

import collections
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from mnemospark.llm import chat_format, components, curve_neighbours, entry, exact_dedup, html_text, line_dedup, mixing, packing, simhash, token_counts, toxicity

DOCS = "doc_id long, text string"
#: Nulls, empty and blank texts, ties, repeated rows.
ODD = [(1, None), (2, ""), (None, " \t"), (None, "a b"), (-5, "a b"), (7, "A b"), (7, "A b"), (8, "ab")]


def union_find(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(name, same):
    assert same(entry.queries()[name], entry.oracle_sql()[name])


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, text from documents order by 1").fetchall()


# HTML ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""), ("", ""), ("<nav><a href=x>menu</a></nav>", ""), ("plain &amp; short", "plain & short"),
        ("<article><h1>T</h1><p><b>one\n two<br><p>three</article><footer>foot</footer>", "T one two three"),
        ("<div class='ad'>buy</div><article><p>x<script>var a='</p>'</script>y &lt;z&gt;</p></article><aside>side</aside>", "xy <z>"),
        ("<article><header><h1>T</h1></header><p>body</p></article><section id=comments><p>" + "I disagree. " * 50 + "</p></section>", "T body"),
        ("<body><header>Site</header><div id=content><h2>A</h2><p>" + "long text " * 30 + "</p><p>end</p></div><div class='cookie-notice'>ok?</div></body>", "A " + "long text " * 30 + "end"),
        ("<article><p class='notice-period'>three months</p><p class='share-price'>ten</p><p class='notice'>cookies</p><p class='share-links'><a href=x>mail this</a></p><div class='ad-box'>buy</div><h2 class=nav>menu</h2></article>", "three months ten"),
        ("<article><p>body</p><div class='reader-feedback'><p>" + "I disagree. " * 5 + "</p></div></article>", "body"),
        ("<p>a<form><input><button>Send</button></form><noscript>no</noscript><p hidden>h</p></p><p>b", "a b"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_pages_of_an_empty_table_and_clashing_columns(spark):
    pages = spark.createDataFrame([(1, None, "old", 5), (2, "<p>a &amp; b", "old", 5), (2, "<p>a &amp; b", "old", 5)], "page_id long, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect())
    assert got == [(1, "", 0), (2, "a & b", 5), (2, "a & b", 5)]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_main_text_survives_deep_and_broken_pages():
    assert html_text.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_text.main_text("<<<a <b c='") is not None
    assert html_text.main_text("<p>" + "word " * 200_000) == ("word " * 200_000).strip()


LONG = "Long words in a plain paragraph about many things. " * 12
PARAGRAPHS, BOTH = f"<p>{LONG}</p><p>{LONG}</p>", f"{LONG.strip()} {LONG.strip()}"


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='site has-sidebar'>{PARAGRAPHS}</div>", f"<div id='page' class='no-banner'><article>{PARAGRAPHS}</article></div>", f"<form id=aspnet><article>{PARAGRAPHS}</article></form>",
        f"<div class='post social-news'>{PARAGRAPHS}</div>", f"<head><title>x</title><body>{PARAGRAPHS}", f"<body><nav><a href=x>m</a><div>{PARAGRAPHS}</div>", f"<div><aside><p>x</div><div>{PARAGRAPHS}</div>",
        f"<p class=notice>cookie<p>{LONG}<p>{LONG}", f"<main><article><p>{LONG}</article><article><p>{LONG}</article></main>",
        "<div class=a>" + "".join(f"<div class=t><a href=x>Teaser {i} here</a> short</div>" for i in range(6)) + f"</div><div class=b>{PARAGRAPHS}</div><div class=c>Copyright Someone 2020</div>",
        f"<div class=x><div class=y>{PARAGRAPHS}</div><div class=z><a href=x>one</a> <a href=y>two</a> <a href=y>three</a></div></div>",
    ],
)
def test_wrappers_and_plain_pages_keep_the_article(page):
    assert html_text.main_text(page) == BOTH


def test_hostile_markup_takes_linear_time():
    for part in ("<p a=\"x", "<div></x><li>x", "<a b='", "<!--", "<title>", "<b>x<div>"):
        began = time.perf_counter()
        html_text.main_text(part * 30_000)
        assert time.perf_counter() - began < 20
    assert html_text.main_text('<p title="broken>hello</p>') == "hello"


def slow_densities(node):
    """The density rule written out: counts are taken anew for every node."""
    inside = lambda n: [x for k in n.parts if not isinstance(k, str) for x in [k, *inside(k)]]
    strings = lambda n: [p for x in [n, *inside(n)] for p in x.parts if isinstance(p, str)]
    links = lambda n: [x for x in [n, *inside(n)] if x.tag == "a"]
    count = lambda ns: sum(len(s.strip()) for n in ns for s in strings(n))
    root = node
    while root.parent:
        root = root.parent
    c, t = count([node]), max(len(inside(node)), 1)
    lc, lt = count(links(node)), len([x for x in inside(node) if x.tag == "a"])
    if not c:
        return 0.0
    total, total_links = max(count([root]), 1), count(links(root))
    base = math.log(c / max(c - lc, 1) * lc + total_links / total * c + math.e)
    return c / t * math.log(max(c / max(lc, 1) * t / max(lt, 1), 1) + 1) / max(base, 1)


def test_densities_equal_a_slow_form():
    page = f"<div><p>{LONG}<a href=x>link text</a></p><ul><li><a href=y>one</a><li>two</ul></div><div><p>short</div>tail"
    root = html_text.parse(page)
    nodes = html_text.densities(root)
    assert len(nodes) == 10 and all(abs(n.density - slow_densities(n)) < 1e-9 * max(1, n.density) for n in nodes)
    assert html_text.main_nodes(root)[0].tag == "div"


def test_extract_keeps_rows_and_columns(spark, data):
    df = spark.createDataFrame([(1, None, "old"), (2, "<p>x", "old"), (2, "<p>x", "old")], "page_id long, html string, text string")
    got = html_text.extract(df)
    assert got.columns == ["page_id", "html", "text", "n_chars"] and sorted((r["page_id"], r["text"], r["n_chars"]) for r in got.collect()) == [(1, "", 0), (2, "x", 1), (2, "x", 1)]
    pages = html_text.op1_html_text(spark, data).toPandas().set_index("page_id")
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():  # these pages hold one article each
        body = re.search(r"(?s)<article>(.*)</article>", r["html"])[1]
        parts = (" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?p>|<br>|</?h1>", re.sub(r"</?b>", "", body)))
        assert pages.text[r["page_id"]] == " ".join(x for x in parts if x)


# packing ------------------------------------------------------------------------------------------


def brute_best_fit(sizes, sources, clusters, capacity, most):
    bins, out = [], []
    for size, s, c in zip(sizes, sources, clusters, strict=True):
        fits = [(capacity - sum(x[0] for x in b), k) for k, b in enumerate(bins) if sum(x[0] for x in b) + size <= capacity and sum(x[1] == s for x in b) < most and all(x[2] != c for x in b) and sum(x[0] for x in b) < capacity]
        k = min(fits)[1] if fits else len(bins)
        if k == len(bins):
            bins.append([])
        bins[k].append((size, s, c))
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_equals_brute_force(seed):
    rng = random.Random(seed)
    n = 120
    args = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True), [rng.randint(0, 3) for _ in range(n)], [rng.randint(0, 40) for _ in range(n)], 100, 2
    assert packing.best_fit(*args) == brute_best_fit(*args)


def test_packing_constraints(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = packing.pack(docs, capacity=300, max_per_source=2, shard_rows=64).toPandas()
    assert got.groupby("bin_id")["size"].sum().max() <= 300 and got.groupby(["bin_id", "source"]).size().max() <= 2 and got.groupby(["bin_id", "cluster"]).size().max() == 1
    sizes = docs.select("doc_id", mixing.words(F.col("text")).alias("n")).toPandas().set_index("doc_id").n
    assert (got.groupby("doc_id")["size"].sum() == sizes.loc[sorted(sizes.index)]).all()
    odd = spark.createDataFrame([(i, t, None) for i, t in ODD], DOCS + ", source string")
    assert packing.pack(odd, capacity=1).count() >= len(ODD) and packing.pack(odd.limit(0)).count() == 0


def test_blank_rows_share_bins_and_few_bins_are_opened(spark, data):
    blank = spark.createDataFrame([(i, [None, "", " "][i % 3], f"s{i % 200}") for i in range(500)], DOCS + ", source string")
    assert packing.pack(blank).select("bin_id").distinct().count() <= 4
    same = spark.createDataFrame([(1, "a b c", "s")] * 300, DOCS + ", source string")
    got = packing.pack(same, shard_rows=50).toPandas()
    assert len(got) == 300 and got.bin_id.nunique() == 300 and (got.bin_id // (1 << 32)).nunique() > 3
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = packing.pack(docs, max_per_source=10**6, cluster=F.lit(None)).toPandas()
    assert got.bin_id.nunique() <= 1.02 * got["size"].sum() / 2048 + 1


# chat ---------------------------------------------------------------------------------------------


def test_escapes_are_reversible(spark):
    rng = random.Random(1)
    bits = ["<", "|", "\\", "</s>", "[INST]", "[/INST]", "<|end|>", "<|text|>", "x", " ", "\n", "[", "/", "<<SYS>>", "é"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not re.search(r"<\||</?s>|\[/?INST\]|<</?SYS>>", r["e"])
    turns = spark.createDataFrame([(k // 5, k % 5, ["user", "assistant", texts[k], None, "assistant"][k % 5], t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    closing = chat_format.expand(turns).where("closing").select("conv_id", chat_format.parse(F.col("formatted")).alias("p")).collect()
    for r in closing:
        for k, (role, text) in enumerate(r["p"]):
            i = r["conv_id"] * 5 + k
            assert text == texts[i] and role == (["user", "assistant", texts[i], "", "assistant"][k])


def test_examples(spark):
    turns = spark.createDataFrame([(1, 0, "user", "u"), (1, 1, "assistant", "a1"), (1, 2, "user", None), (1, 3, "assistant", "a2"), (2, 0, "system", "s"), (2, 1, "user", "q"), (None, 0, "assistant", "")], "conv_id long, turn long, role string, text string")
    ex = chat_format.expand(turns)
    got = {(r["conv_id"], r["target"]): r for r in ex.collect()}
    assert set(got) == {(1, 2), (1, 4), (2, None), (None, 1)}
    r = got[1, 4]
    assert r["formatted"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] == "a2" and "a1" in r["formatted"][: r["loss_start"]]
    assert got[2, None]["closing"] and got[2, None]["loss_chars"] is None
    assert {(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in chat_format.digests(ex).collect()} == {(1, 4, 4), (2, 2, 0), (None, 1, 0)}
    assert chat_format.digests(chat_format.expand(turns.limit(0))).count() == 0


# SimHash ------------------------------------------------------------------------------------------


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_classes_equal_brute_force(spark, texts, data):
    prints = {i: brute_fingerprint(t) for i, t in texts}
    ids = sorted(prints)
    want = union_find(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if bin(prints[a] ^ prints[b]).count("1") <= 2])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op4_simhash(spark, data).collect()}
    assert got == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_balls_connect_all_within_two_bits(spark):
    rng = random.Random(4)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))) for s in seeds for _ in range(25)} | {0, 1, 3, 1 << 63})
    want = union_find(fps, [(a, b) for k, a in enumerate(fps) for b in fps[:k] if bin(a ^ b).count("1") <= 2])
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r["node"] % (1 << 64): r["component"] for r in components.components(simhash.links(df)).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert groups(got) == {g for g in groups(want) if len(g) > 1}


def test_simhash_odd_rows(spark):
    got = collections.Counter((r["doc_id"], r["component_id"]) for r in simhash.classes(spark.createDataFrame(ODD, DOCS)).collect())
    assert got == collections.Counter([(1, 1), (2, 1), (None, 1), (None, -5), (-5, -5), (7, -5), (7, -5), (8, 8)])
    assert simhash.classes(spark.createDataFrame([], DOCS)).count() == 0


def test_near_classes_by_shingles(spark):
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 400)}" for _ in range(300)]
    near = [*base[:150], "changed", *base[151:]]
    far = [rng.choice(base) for _ in range(300)]
    rows = [(3, " ".join(base)), (5, " ".join(near)), (9, " ".join(far)), (1, ""), (2, " "), (4, "one two")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_classes(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {3: 3, 5: 3, 9: 9, 1: 1, 2: 1, 4: 4}


def test_near_classes_find_every_pair_of_appended_and_block_edited_copies(spark):
    rng = random.Random(17)
    fresh = lambda n: [f"w{rng.randint(0, 900)}" for _ in range(n)]
    common = fresh(40)
    texts = []
    for _ in range(30):
        base = fresh(rng.randint(60, 300))
        n = len(base)
        texts += [base, [*base, *fresh(n // 10)], [*base, *fresh(n * 3 // 20)], [*base, *fresh(n // 5)]]
        for share in (0.05, 0.08, 0.1):
            at, k = rng.randint(0, n // 2), int(share * n)
            texts.append([*base[:at], *fresh(k), *base[at + k :]])
    texts += [[*common, *fresh(k % 12)] for k in range(60)]  # meet at one passage, but not all are alike
    rng.shuffle(texts)
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = union_find(range(len(sets)), [(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], DOCS)
    for options in ({}, {"sample": 1, "stars": 1}):
        assert {r["doc_id"]: r["component_id"] for r in simhash.near_classes(df, **options).collect()} == want


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)] + [(50, 51), (51, 52)]])
def test_components(spark, edges):
    want = union_find({x for e in edges for x in e}, edges)
    assert {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


# tokens -------------------------------------------------------------------------------------------


def test_spliced_counts_equal_the_library(spark, texts):
    rng = random.Random(3)
    bits = ["<|endoftext|>", "'s", "'ll", " ", "  ", "\n\n", "é", "日本", "😀", "0", "12", "a", "Zz", "--", "\t", "\x85"]
    rows = texts[:40] + [(1000 + k, "".join(rng.choice(bits) for _ in range(rng.randint(1, 5000)))) for k in range(8)]
    rows += [(-1, None), (-2, ""), (-3, "a" * 9000), (-4, "日本語" * 2000), (-5, " " * 5000), (-5, "<|endoftext|>" * 500)]
    df = spark.createDataFrame(rows, DOCS).withColumn("n_bytes", F.lit("clash"))
    got = sorted((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.count_tokens(df, chunk_chars=1024, overlap=300).collect())
    n = token_counts.counts([t or "" for _, t in rows], token_counts.DEFAULT_TOKENIZER)
    assert got == sorted((i, len((t or "").encode()), k, k > 1024) for (i, t), k in zip(rows, n, strict=True))
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS)).count() == 0


def test_token_counts_with_clashing_names(spark):
    rows = [(1, "huge words " * 400, "x", 2), (2, None, "y", 3)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes string, row string, count int")
    got = token_counts.count_tokens(df, text="n_bytes", chunk_chars=1024, overlap=300)
    n = token_counts.counts(["huge words " * 400], token_counts.DEFAULT_TOKENIZER)[0]
    assert {(r["doc_id"], r["n_bytes"], r["n_tokens"], r["row"], r["count"]) for r in got.collect()} == {(1, 4400, n, "x", 2), (2, 0, 0, "y", 3)}


def test_units_count_like_whole_texts():
    rng = random.Random(5)
    bits = ["<|endoftext|>", "'s", "'ll", "é", "日本", "😀", "0", "12", "a", "Zz", "--", "the", "x\ny", "\u3000", "\xa0", "’s", "\n", "a\tb", "  "]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 20))) for _ in range(8000)]
    units = token_counts.UnitCounts(token_counts.DEFAULT_TOKENIZER, most=3000)
    assert [n for k in range(0, 8000, 400) for n in units.counts(texts[k : k + 400])] == token_counts.counts(texts, token_counts.DEFAULT_TOKENIZER)


def test_other_tokenizers_encode_whole(spark):
    df = spark.createDataFrame([(1, "Hello there " * 400), (2, None)], DOCS)
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json"):
        got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(df, tokenizer=name, chunk_chars=1024, overlap=300).collect()}
        assert got == {1: token_counts.counts(["Hello there " * 400], name)[0], 2: token_counts.counts([""], name)[0]}


# mixing -------------------------------------------------------------------------------------------


def test_mixing_targets_and_cells(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    fine = mixing.mix(docs, cell_rows=4).toPandas()
    assert (fine.taken <= 2 * fine["size"]).all() and (fine.target <= 2 * fine.source_size + 1e-9).all()
    assert (abs(fine.groupby("source").taken.sum() - fine.groupby("source").target.first()) < 1).all()
    assert abs(fine.groupby("source").target.first().sum() - 1.5 * fine["size"].sum()) < 1e-3
    coarse = mixing.mix(docs, cell_rows=10**6).toPandas()
    assert dict(zip(fine.doc_id, fine.taken, strict=True)) == dict(zip(coarse.doc_id, coarse.taken, strict=True))
    whole = mixing.mix(docs, whole=True).toPandas()
    assert (whole.taken == whole.copies * whole["size"]).all()


def test_mixing_odd_rows(spark):
    odd = spark.createDataFrame([(i, t, s) for (i, t), s in zip(ODD, ["a", "a", None, "b", "b", None, None, "zz"], strict=True)], DOCS + ", source string")
    got = mixing.mix(odd).toPandas()
    assert len(got) == len(ODD) and (got.taken <= 2 * got["size"]).all() and mixing.mix(odd.limit(0)).count() == 0


# exact dedup --------------------------------------------------------------------------------------


def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    return {(i, min(groups[norm(t)])[3], len(groups[norm(t)])) for i, t in rows}


@pytest.mark.parametrize("key", [exact_dedup.hash_key, lambda n: F.length(n).cast("long") % 7])
def test_exact_dedup_equals_brute_force(spark, texts, key):
    rows = texts + [(10_000 + i, " " + (t or "")) for i, t in texts[:50]] + ODD
    got = exact_dedup.dedup(spark.createDataFrame(rows, DOCS), key=key, capacity=16)
    assert {(r["doc_id"], r["keep_id"], r["group_size"]) for r in got.collect()} == brute_exact(rows)
    assert exact_dedup.dedup(spark.createDataFrame([], DOCS), key=key).count() == 0


def test_directory_splits_only_full_buckets(spark):
    keys = spark.range(400).select((F.col("id") * 64).alias("key"))
    d = exact_dedup.directory(keys, 50)
    n = d.count()
    per = keys.withColumn("slot", exact_dedup._slot(F.col("key"), n.bit_length() - 1)).join(d, "slot").groupBy("bucket", "local_depth").count().collect()
    assert n & (n - 1) == 0 and sum(r["count"] for r in per) == keys.count() and len({r["local_depth"] for r in per}) > 1 and max(r["count"] for r in per) <= 50
    cells = {(r["slot"], r["bucket"], r["local_depth"]) for r in d.collect()}
    assert all(slot % (1 << depth) == bucket for slot, bucket, depth in cells)
    parents = collections.Counter((b % (1 << depth - 1), depth - 1) for _, b, depth in {(0, b, dep) for _, b, dep in cells} if depth)
    sizes = {(r["bucket"], r["local_depth"]): r["count"] for r in per}
    for (low, depth), _ in parents.items():  # a bucket was split only as its keys did not fit
        assert sum(c for (b, dep), c in sizes.items() if dep > depth and b % (1 << depth) == low) > 50


@pytest.mark.parametrize("capacity", [1, 2, 3, 4])
def test_buckets_of_few_keys_go_on_doubling(spark, capacity):
    rows = [(i, f"text {i % 150}") for i in range(300)]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup(df, capacity=capacity).collect()}
    assert got == {i: (i % 150, 2, i < 150) for i in range(300)}
    keys = df.select(exact_dedup.hash_key(F.col("text")).alias("key"))
    slots = exact_dedup.directory(keys, capacity)
    split = exact_dedup.beyond(keys, slots, slots.count().bit_length() - 1, capacity)
    assert (split is None) == slots.where("bucket is null").isEmpty()


def test_a_bucket_holds_a_key_at_least(spark):
    with pytest.raises(ValueError):
        exact_dedup.dedup(spark.createDataFrame(ODD, DOCS), capacity=0)


def test_results_come_through_the_directory(spark, monkeypatch):
    rows = [(k, f"text {k % 40}") for k in range(120)]
    df, whole = spark.createDataFrame(rows, DOCS), exact_dedup.directory
    assert exact_dedup.dedup(df, capacity=4).count() == 120

    def half(keys, capacity):
        slots = whole(keys, capacity)
        return slots.withColumn("slot", F.when(F.col("slot") % 2 == 0, F.col("slot")).otherwise(-1 - F.col("slot")))  # odd slots lead nowhere

    monkeypatch.setattr(exact_dedup, "directory", half)
    assert 0 < exact_dedup.dedup(df, capacity=4).count() < 120


# toxicity -----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01"
    return folder, toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))


def test_toxicity_held_out(spark, model):
    folder, m = model
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    r = toxicity.score(docs, m).join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))).toPandas()
    assert ((r.score >= 0.5) == (r.toxic == 1)).mean() > 0.93 and r.score.between(0, 1).all()
    odd = toxicity.score(spark.createDataFrame([*ODD, (9, " \n" * 1000)], DOCS), m).collect()
    assert len(odd) == len(ODD) + 1 and all(0 <= r["score"] < 0.5 for r in odd) and toxicity.score(docs.limit(0), m).count() == 0


def test_viterbi_finds_the_likeliest_of_all_paths(model):
    channel = toxicity.Channel(model[1]["grams"])
    rng = random.Random(2)
    words = ["1d10t", "i.d.i.o.t", "l0s3r", "idiooot", "st*pid", "tr@sh", "$cum"] + ["".join(rng.choice("abe013$@.*oos") for _ in range(rng.randint(2, 6))) for _ in range(150)]

    def total(said):
        x = y = 0
        s = 0.0
        for c in said:
            z = 0 if c == " " else int(toxicity._INDEX[ord(c)])
            if z == 0 and y == 0:
                continue
            s += channel.log_p[x][y][z]
            x, y = y, z
        return s + (channel.log_p[x][y][0] if y else 0.0)

    for word in words:
        paths = {}
        for path in itertools.product(*toxicity.Channel._options(word)):
            said = "".join(c for c, _ in path)
            clean = re.sub("^ +| +(?= )", "", said)
            paths[clean] = max(paths.get(clean, -1e9), total(said) + sum(cost for _, cost in path))
        assert paths[channel.restore(word)] > max(paths.values()) - 1e-9, word


def test_log_odds_and_logistic_equal_a_direct_fit():
    assert abs(toxicity.log_odds(5, 3, 0.2, 10) - (math.log(7 / 11) - math.log(0.2 / 0.8))) < 1e-12
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=400) > 0).astype(float)
    w, design = toxicity.logistic(x, y), np.column_stack([np.ones(400), x])
    gradient = design.T @ (y - 1 / (1 + np.exp(-design @ w))) - np.array([0, *w[1:]])
    assert np.abs(gradient).max() < 1e-6


def test_obfuscated_words_are_restored(model):
    scorer = toxicity.Scorer(model[1])
    for word, plain in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "l0s3r": "loser", "idiooot": "idiot", "st*pid": "stupid", "tr@sh": "trash", "$cum": "scum"}.items():
        assert plain in scorer.words(f"{word} of the"), word
    assert "idiot" in " ".join(scorer.words("the, I D I O T, of"))
    assert scorer.heaviest("of the 1d10t and the l0s3r, cl0wn")[2] > 0 and scorer.heaviest("") == [0.0, 0.0, 0.0] == scorer.heaviest(None)


def test_held_out_split(spark):
    got = {r["id"]: r["h"] for r in spark.range(50).select("id", toxicity.held_out(F.col("id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    m = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] < 0.5 for r in toxicity.score(docs, m).collect()} == {True}


# neighbours ---------------------------------------------------------------------------------------


def brute_neighbours(rows, asks, k=20):
    """By plain sums of products, every row against every query."""
    out = {}
    for i, v in rows:
        if asks(i):
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in rows if j != i)
            out[i] = [(j, -s) for s, j in scored[:k]]
    return out


def check_neighbours(got, want, recall=0.9):
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(want) and all(len(found[i]) == len(want[i]) for i in want)
    scores = {i: dict(w) for i, w in want.items()}
    assert all(abs(s - scores[i][j]) < 1e-9 * max(1, abs(s)) for i, f in found.items() for j, s in f if j in scores[i])
    assert all(f == sorted(f, key=lambda x: (-x[1], x[0])) for f in found.values())
    hit = sum(len({j for j, _ in found[i]} & set(scores[i])) for i in want)
    assert hit >= recall * sum(map(len, want.values()))


def test_neighbours_recall_and_scores(spark, data):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    check_neighbours(curve_neighbours.op9_curve_neighbours(spark, data).collect(), brute_neighbours(rows, lambda i: i % 20 == 0))


def test_neighbours_of_uneven_norms_in_small_windows(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 24))
    x = (centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 24))) * rng.lognormal(0, 0.5, size=(3000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = curve_neighbours.nearest(df, F.col("vec_id") % 50 == 0, block_rows=64, group_blocks=4)
    check_neighbours(got.collect(), brute_neighbours(rows, lambda i: i % 50 == 0))


def test_neighbours_of_a_vector_many_rows_repeat(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(600)] + [(600 + i, [1.0] * 8) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(int(i), v) for i, v in rows], "vec_id long, embedding array<double>")
    got = curve_neighbours.nearest(df, F.col("vec_id") % 10 == 0, block_rows=400)
    check_neighbours(got.collect(), brute_neighbours([(int(i), v) for i, v in rows], lambda i: i % 10 == 0), recall=1.0)


def test_neighbours_odd_rows(spark):
    nan = float("nan")
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, 2.0]), (5, [1.0, 2.0]), (6, [3.0, None]), (7, [5.0]), (None, [1.0, 1.0]), (8, [-1.0, 1.0]), (9, [float("inf"), 1.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in curve_neighbours.nearest(v, F.lit(True)).collect()}
    assert got == {(1, 1): (5, 5.0), (1, 2): (8, 1.0), (5, 1): (1, 5.0), (5, 2): (8, 1.0), (8, 1): (1, 1.0), (8, 2): (5, 1.0)}
    assert curve_neighbours.nearest(v.limit(0), F.lit(True)).count() == 0


def test_hilbert_steps_are_neighbours():
    side = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    path = side[np.argsort(curve_neighbours.hilbert_keys(side, 3))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# lines --------------------------------------------------------------------------------------------


def edits(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def majority(hashes, of_seven=7):
    return sum(1 << b for b in range(63) if b % 7 < of_seven and 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def line_blocks(text):
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in text.split(" ")]
    n = len(h)
    if n < 3:
        return set()
    if n < 12:
        return {("less", i, majority(set(h[:i] + h[i + 1 :]))) for i in range(n)}
    step = max(4, 1 << n.bit_length() - 3)
    parts = [majority(set(x), 4) for x in (h[:step], h[step : 2 * step], h[-2 * step :][:step], h[-step:])]
    outer = {(0, 3, step // 2, majority(set(h[: step // 2]), 4), majority(set(h[-(step // 2) :]), 4))} if n >= 32 else set()
    return outer | {(i, j, step, parts[i], parts[j]) for i, j in itertools.combinations(range(4), 2)}


def alike(a, b):
    most = int(0.2 * max(len(a), len(b)) + 1e-9)
    return abs(len(a) - len(b)) <= most and edits(a, b, most) <= most


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    vocab = [f"word{k}" for k in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(n)) for n in (3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 63, 64, 70)]

    def vary(line):
        w = line.split()
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(vocab)], [w[at] + "x"]])
        return " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)

    docs = [(k, "\n".join(rng.choice([vary(rng.choice(base)), vary(rng.choice(base)), rng.choice(vocab), "--", ""]) for _ in range(rng.randint(1, 6)))) for k in range(90)]
    occ = [(i, k, norm(x)) for i, t in docs for k, x in enumerate(t.split("\n"))]
    lines = sorted({n for *_, n in occ if n})
    blocks = [line_blocks(n) for n in lines]
    links = [(i, j) for i in range(len(lines)) for j in range(i) if blocks[i] & blocks[j] and alike(lines[i], lines[j])]
    group, seen, want = union_find(range(len(lines)), links), set(), {}
    at = {n: k for k, n in enumerate(lines)}
    for i, k, n in occ:
        want[i, k] = not n or group[at[n]] not in seen
        if n:
            seen.add(group[at[n]])
    df = spark.createDataFrame(docs, DOCS)
    got = line_dedup.dedup(df)
    assert {(r["doc_id"], r["pos"]): r["kept"] for r in got.collect()} == want and len(links) > 50
    clash = df.withColumns({"gone0": F.lit("mine"), "of0": F.lit(1)})
    whole = {r["doc_id"]: (r["text"], r["gone0"], r["of0"]) for r in line_dedup.clean(clash, got).collect()}
    assert whole == {i: ("\n".join(x for k, x in enumerate(t.split("\n")) if want[i, k]), "mine", 1) for i, t in docs}


def test_complete_line_dedup_equals_all_pairs(spark):
    rng = random.Random(8)
    letters = "etaoin shrdlu é\U00010428"
    base = [" ".join("".join(rng.choice("etaoinsé") for _ in range(rng.randint(1, 8))) for _ in range(n)) for n in (1, 1, 2, 3, 4, 6, 9, 14, 25, 60)]

    def vary(line, k):  # edits anywhere, or at one end, so that places shift
        for _ in range(k):
            at = rng.randrange(len(line) + 1) if k % 2 else rng.choice([0, len(line)])
            line = line[:at] + rng.choice(["", rng.choice(letters)]) + line[at + rng.randint(0, 1) :]
        return line

    rows = [(k, vary(x, e if j % 3 else int(0.2 * len(x)) + rng.randint(0, 1))) for k, (x, e, j) in enumerate(itertools.product(base, (0, 1, 3, 5, 8), range(4)))]
    lines = sorted({norm(x) for _, x in rows} - {""})
    links = [(i, j) for i in range(len(lines)) for j in range(i) if alike(lines[i], lines[j])]
    group, at, seen, want = union_find(range(len(lines)), links), {n: k for k, n in enumerate(lines)}, set(), {}
    for k, x in rows:
        want[k] = not norm(x) or group[at[norm(x)]] not in seen
        seen |= {group[at[norm(x)]]} if norm(x) else set()
    df = spark.createDataFrame(rows, DOCS)
    assert {r["doc_id"]: r["kept"] for r in line_dedup.dedup(df, complete=True).collect()} == want
    assert {r["doc_id"]: r["kept"] for r in line_dedup.dedup(df).collect()} != want
    # all pairs by themselves, in cells of a few lines
    alone = spark.createDataFrame(list(enumerate(lines)), "id long, norm string").withColumn("label", F.col("id"))
    got = [tuple(sorted((r["a"], r["b"]))) for r in line_dedup.all_links(alone, 0.8, block=25).collect()]
    assert sorted(got) == sorted((j, i) for i, j in links) and len(links) > 300


def test_lines_find_what_edit_similarity_finds(spark, texts):
    rng = random.Random(11)
    lines = list({n: None for _, t in texts for x in (t or "").split("\n") if len((n := norm(x)).split(" ")) > 2})[:250]
    cuts = {"letter": 0, "word": 0, "two letters": 0}
    rows, pairs = [(k, x) for k, x in enumerate(lines)], []
    for kind in cuts:
        for k, line in enumerate(lines):
            w = line.split(" ")
            for _ in range(2 if kind == "two letters" else 1):
                at = rng.randrange(len(w))
                c = rng.randrange(len(w[at]))
                w[at] = rng.choice(["klop", "mirtan"]) if kind == "word" else w[at][:c] + rng.choice("qxyz") + w[at][c + 1 :]
            if alike(line, " ".join(w)) and " ".join(w) != line:
                pairs.append((k, kind, 1000 * (len(rows) + 1)))
                rows.append((1000 * (len(rows) + 1), " ".join(w)))
    kept = {r["doc_id"]: r["kept"] for r in line_dedup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    for kind in cuts:
        found = [not kept[i] for _, x, i in pairs if x == kind]
        assert len(found) > 150 and sum(found) >= (0.8 if kind == "two letters" else 0.95) * len(found), (kind, sum(found), len(found))


def test_line_dedup_odd_rows(spark):
    got = line_dedup.dedup(spark.createDataFrame([*ODD, (9, "Foo bar\n\nfoo, BAR")], DOCS))
    assert collections.Counter((r["doc_id"], r["pos"], r["kept"]) for r in got.collect()) == collections.Counter(
        [(1, None, True), (2, 0, True), (None, 0, True), (None, 0, False), (-5, 0, True), (7, 0, False), (7, 0, False), (8, 0, True), (9, 0, True), (9, 1, True), (9, 2, False)]
    )
    assert line_dedup.dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_of_one_key_are_told_apart(spark, monkeypatch):
    real = F.xxhash64
    monkeypatch.setattr(line_dedup, "_identity", lambda words, other=False: real(F.lit(1), words) if other else F.lit(5).cast("long") + 0 * F.size(words))
    got = line_dedup.dedup(spark.createDataFrame([(1, "first line here\nquite another text\nfirst line here")], DOCS))
    assert {r["pos"]: r["kept"] for r in got.collect()} == {0: True, 1: True, 2: False}


@pytest.mark.parametrize("n", [1, 2, 3, 7, 100, 127, 128, 300, 70_000])
def test_majorities_of_any_number_of_words(spark, n):
    hashes = [xxhash.xxh64_intdigest(str(k).encode(), 42) for k in range(n)]
    counts = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0)
    df = spark.range(1).select(line_dedup.simhash(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.xxhash64(k.cast("string")))).alias("x"))
    assert df.first()["x"] == sum(1 << b for b in range(63) if 2 * int(counts[b]) > n)
