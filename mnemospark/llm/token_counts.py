"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Texts up to ``chunk_chars`` are encoded where they lie. Longer ones are cut into overlapping chunks
that spread over the tasks, each encoded with offsets, and spliced: in the overlap of two chunks a
cut is taken at a place where both encodings start a token and that is proven stable. The byte-level
pattern never joins a character that is not white space with white space behind it, nor a letter
with a non-letter behind it, whatever stands around them, so a cut between such characters
is a boundary in the encoding of the whole text too. Places within ``_MARGIN`` characters of a chunk's edge
don't count, so added special tokens, which are matched before the pattern, can't straddle a cut.

Where two chunks share no such place, the document's chunks and overlaps are widened four times,
until one chunk holds it all; that is the plain encoding. Per chunk only totals and the places in
its overlaps are kept, joined on document and chunk number, so no document meets in one task.

Texts encoded where they lie are split at spaces between characters that are not white space. By the same proof each
unit counts for itself, so a worker encodes a unit once and looks it up afterwards. Texts with other white
space than single spaces, tabs and line ends inside units, and texts most of whose units are new, are encoded whole.

Other tokenizers than byte-level ones have no such proof and encode every text whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.scratch import discard, materialize

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
_MARGIN = 64
_WHITE = frozenset(" \t\n\r")
_BATCH_CHARS = 1 << 20


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    """A bare name is a vocabulary of the installed package; anything with a folder is a path."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def _load(name: str):
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def counts(texts: list[str], name: str) -> list[int]:
    """Tokens of each text as the library counts them, in batches of bounded size."""
    tokenizer, found, part, chars = _load(name), [], [], 0
    for k, text in enumerate(texts):
        part.append(text)
        chars += len(text)
        if chars >= _BATCH_CHARS or k == len(texts) - 1:
            if hasattr(tokenizer, "encode_batch_fast"):
                found += [len(x) for x in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            else:
                found += [len(tokenizer.encode(x)) for x in part]
            part, chars = [], 0
    return found


#: Units that begin or end with white space, or characters that the pattern may take for white space.
_ODD_WHITE = "".join(chr(c) for c in range(0x10000) if chr(c).isspace() and chr(c) not in " \t\n\r") + "".join(map(chr, (0x180E, 0x200B, 0x2060, 0xFEFF)))
_UNEVEN = re.compile(rf"^[ \t\r\n]|[ \t\r\n]$| [ \t\r\n]|[\t\r\n] |[{_ODD_WHITE}]")


class UnitCounts:
    """Counts texts by their units, which are encoded once and remembered, the first ``most`` of them."""

    def __init__(self, name: str, most: int = 1 << 19):
        self.name, self.most = name, most
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        found, whole = [0] * len(texts), []
        for k, text in enumerate(texts):
            if not text:
                continue
            if _UNEVEN.search(text):
                whole.append(k)
                continue
            units = text.split(" ")
            units[0] = "\n" + units[0]  # parts a unit without a space before it from the others: no unit begins so
            new = list(set(units).difference(self.known))
            if 2 * len(new) > len(units) and len(units) > 64:  # the text as it stands costs less
                whole.append(k)
                continue
            n = dict(zip(new, counts([x[1:] if x[0] == "\n" else " " + x for x in new], self.name), strict=True)) if new else {}
            if len(self.known) + len(n) <= self.most:
                self.known.update(n)
                n = {}
            found[k] = sum(map(self.known.get, units, repeat(0))) + sum(n[x] for x in units if x in n)
        for k, n in zip(whole, counts([texts[k] for k in whole], self.name), strict=True):
            found[k] = n
        return found


@lru_cache(maxsize=2)
def _units(name: str) -> UnitCounts:
    """One memory for all tasks of a worker."""
    return UnitCounts(name)


def is_byte_level(name: str) -> bool:
    path = tokenizer_path(name)
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) and len(t["content"]) < _MARGIN and not re.search(r"\s", t["content"]) for t in spec.get("added_tokens") or [])
    return bool(spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and plain)


def _stable(text: str, at: int) -> bool:
    left, right = text[at - 1], text[at]
    return left not in _WHITE and right in _WHITE or left.isalpha() and right.isascii() and not right.isalpha()


def _places(text: str, starts: list[int], low: int, high: int) -> tuple[list[int], list[int]]:
    """Token starts in [low, high) that are stable, and the tokens before each."""
    at = [(s, n) for n, s in enumerate(starts) if low <= s < high and s > 0 and (n == 0 or starts[n - 1] != s) and _stable(text, s)]
    return [s for s, _ in at], [n for _, n in at]


_ENCODED = "row long, chunk int, last boolean, total long, left_at array<long>, left_n array<long>, right_at array<long>, right_n array<long>"


def _encode_chunks(name: str, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = _load(name)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                text = row.piece
                starts = [s for s, _ in tokenizer.encode(text, add_special_tokens=False).offsets]
                near, far = min(overlap, len(text)), max(len(text) - overlap, 0)
                left, left_n = _places(text, starts, _MARGIN, near - _MARGIN) if row.chunk else ([], [])
                right, right_n = ([], []) if row.last else _places(text, starts, far + _MARGIN, len(text) - _MARGIN)
                out.append((row.row, row.chunk, row.last, len(starts), [row.start + s for s in left], left_n, [row.start + s for s in right], right_n))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _ENCODED.split(", ")])

    return run


def _cut(chunk_chars: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row, text in zip(batch["row"], batch["text"], strict=True):
                step = chunk_chars - overlap
                starts = range(0, max(len(text) - overlap, 1), step)
                for k, start in enumerate(starts):
                    yield pd.DataFrame({"row": [row], "chunk": [k], "start": [start], "last": [k == len(starts) - 1], "piece": [text[start : start + chunk_chars]]})

    return run


def splice(encoded: DataFrame) -> DataFrame:
    """Per document: row, n_tokens, and ok (false where some pair of chunks shares no stable place)."""
    after = encoded.select("row", (F.col("chunk") - 1).alias("chunk"), "left_at", "left_n")
    ends = encoded.select("row", "chunk", "last", "total", "right_at", "right_n").join(after, ["row", "chunk"], "left")
    place = F.try_element_at(F.array_intersect("right_at", "left_at"), F.lit(1))
    upto = F.try_element_at("right_n", F.array_position("right_at", place).cast("int"))
    skip = F.try_element_at("left_n", F.array_position("left_at", place).cast("int"))
    cuts = ends.withColumn("place", place)
    gained = F.when(F.col("last"), F.col("total")).when(F.col("place").isNotNull(), upto - skip)
    # what the next chunk holds before the cut is not its own: it comes off here
    return cuts.groupBy("row").agg(F.sum(F.coalesce(gained, F.lit(0))).alias("n_tokens"), F.min(F.col("last") | F.col("place").isNotNull()).alias("ok"))


def count_tokens(docs: DataFrame, text: str = "text", tokenizer: str = DEFAULT_TOKENIZER, limit: int = 1024, chunk_chars: int = 1 << 16, overlap: int = 1 << 11) -> DataFrame:
    """Add n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens) to every row.

    Null texts count as empty: zero bytes and tokens. Special strings inside texts are handled as the
    tokenizer does by default; nothing is added, truncated or padded. Repeated rows are kept;
    other columns pass, and those named like a new one are replaced. An empty table gives an empty result.
    """
    if chunk_chars <= 2 * overlap or overlap < 4 * _MARGIN:
        raise ValueError("chunks must be longer than two overlaps, and overlaps than four margins")
    byte_level = is_byte_level(tokenizer)

    @F.pandas_udf("long")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = _units(tokenizer)
        for batch in batches:
            texts = ["" if x is None else x for x in batch]
            yield pd.Series(units.counts(texts) if byte_level else counts(texts, tokenizer), dtype="int64")

    # names of the columns that hold texts and keys on the way, which no column of the input bears
    body, key, n = (_free(docs, name) for name in ("body", "row", "count"))
    rest = docs.withColumn(body, F.coalesce(F.col(text), F.lit(""))).drop(*(c for c in _ADDED if c != text))
    short = F.length(body) <= chunk_chars
    done = (rest.where(short) if byte_level else rest).withColumn(n, whole(F.col(body)))
    if byte_level:
        huge = rest.where(~short)
        if not huge.isEmpty():
            done = done.unionByName(_count_huge(huge, body, key, n, tokenizer, chunk_chars, overlap))
    return done.withColumns({"n_bytes": F.octet_length(body).cast("long"), "n_tokens": F.col(n), "over_limit": F.col(n) > limit}).drop(body, n)


_ADDED = ("n_bytes", "n_tokens", "over_limit")


def _free(docs: DataFrame, name: str) -> str:
    while name in docs.columns or name in _ADDED:
        name = f"_{name}"
    return name


def _count_huge(huge: DataFrame, text: str, key: str, n: str, tokenizer: str, chunk_chars: int, overlap: int) -> DataFrame:
    huge = materialize(huge.withColumn(key, F.monotonically_increasing_id()), "huge-texts")
    parts = huge.sparkSession.sparkContext.defaultParallelism * 4
    todo, found = huge.select(F.col(key).alias("row"), F.col(text).alias("text")), []
    while True:
        pieces = todo.mapInPandas(_cut(chunk_chars, overlap), "row long, chunk int, start long, last boolean, piece string")
        encoded = materialize(pieces.repartition(parts).mapInPandas(_encode_chunks(tokenizer, overlap), _ENCODED), "encoded")
        spliced = materialize(splice(encoded), "spliced")
        discard(encoded)
        found.append(spliced.where("ok").select(F.col("row").alias(key), F.col("n_tokens").alias(n)))
        failed = spliced.where("not ok").select("row")
        if failed.isEmpty():
            break
        todo = todo.join(failed, "row", "left_semi")
        chunk_chars, overlap = 4 * chunk_chars, 4 * overlap
    total = found[0]
    for more in found[1:]:
        total = total.unionByName(more)
    return huge.join(total, key).drop(key)


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")
