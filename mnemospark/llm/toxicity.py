r"""Toxicity of whole texts, after noisy-channel deobfuscation.

Restoring: words that mix letters with digits or symbols, repeat a character three times or more, or
are spelled out with separators become a lattice. Each position offers the characters it may stand
for, each with a channel cost: leetspeak letters, one or two characters of a repeated run, a
separator kept or dropped. Viterbi search picks the likeliest path under a character trigram
model. All other words stand for themselves.

Three things are learned, each by Spark over partitions:

* the trigram counts, over all documents (their number is bounded by the alphabet);
* document frequencies of word features (whole words and prefixes) among toxic and other labelled
  texts, shrunk towards the base rate; a word weighs as much as its strongest feature;
* a logistic regression on a text's three heaviest words, each twice at most, with weights that leave the
  text itself out, on the same rows.

Labels come from at most about ``max_train`` rows, chosen by a hash of the id, of those the caller
allows. The model (the features of that sample with enough evidence, the trigram table, four coefficients) goes to the tasks
as a broadcast of that bounded size. Letters beyond U+024F are one symbol to the trigrams, so other scripts are scored as written. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.plans.scratch import materialize

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
_K = len(LETTERS) + 2  # 0: none, the last: any other letter
_INDEX = np.zeros(0x250, np.int32)
for _cp in range(0x250):
    _c = chr(_cp).lower()
    _INDEX[_cp] = LETTERS.find(_c) + 1 if _c in LETTERS else (_K - 1 if chr(_cp).isalpha() else 0)
_PIECE = 1 << 20
#: What a character may stand for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "h",
}
_LEET_COST, _DROP_COST, _KEEP_COST, _DIGIT_COST, _RUN_COST = -1.0, -0.5, -2.0, -8.0, -0.7
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: Text parts with anything to restore: a letter beside a digit or symbol, a run of three, or spelled-out words.
_ODD = re.compile(r"[^\W\d_][\d@$!|+€£(*#]+[^\W\d_]|[\d@$!|+€£(#][^\W\d_]|[^\W\d_]\d|(\w)\1\1|[^\W\d_][._*~-][^\W\d_]")
_RUN = re.compile(r"(\w)\1\1")
_SPELLED = re.compile(r"(?<![\w])\w(?:[ \t._*~-]{1,2}\w(?!\w)){2,}")


def trigram_counts(texts: Iterator[str]) -> np.ndarray:
    """Counts of letter trigrams; non-letters part words and count as one boundary letter."""
    total = np.zeros(_K**3, np.int64)
    for text in texts:
        for at in range(0, len(text or ""), _PIECE):
            codes = np.frombuffer(text[max(at - 2, 0) : at + _PIECE].encode("utf-32-le", "surrogatepass"), "<u4")
            x = np.where(codes < 0x250, _INDEX[np.minimum(codes, 0x24F)], 0).astype(np.int64)
            x = x[(x > 0) | np.concatenate(([True], x[:-1] > 0))] if at == 0 else x
            if len(x) > 2:
                total += np.bincount((x[:-2] * _K + x[1:-1]) * _K + x[2:], minlength=_K**3)
    return total


class Channel:
    """Restores words under a character trigram model."""

    def __init__(self, counts: np.ndarray, smooth: float = 0.5):
        cube = counts.reshape(_K, _K, _K).astype(float)
        cube[:, 0, :] = cube[:, 0, :].sum(axis=0)  # at a word's start the word before doesn't count
        self.log_p = np.log((cube + smooth) / (cube.sum(axis=2, keepdims=True) + smooth * _K)).tolist()
        self.seen: dict[str, str] = {}

    @staticmethod
    def _options(word: str) -> Iterator[list[tuple[str, float]]]:
        """Per position what it may stand for; a space stands for a kept break between words."""
        for m in re.finditer(r"(.)\1*", word, re.S):
            c, n = m[1], len(m[0])
            if c.isalpha():
                if n < 3:
                    for _ in range(n):
                        yield [(c, 0.0)]
                else:
                    yield [(c, _RUN_COST), (c + c, _RUN_COST)]
            elif c in LEET:
                said = LEET[c]
                cost = _LEET_COST - math.log(len(said))
                more = [(x, cost) for x in said] + ([(x + x, cost) for x in said] if n == 2 else [])
                yield [*more, (" ", (_DIGIT_COST if c.isdigit() else _KEEP_COST) * min(n, 3))]
            else:
                yield [("", _DROP_COST * min(n, 3)), (" ", _DIGIT_COST if c.isdigit() else _KEEP_COST)]

    def restore(self, word: str) -> str:
        """The likeliest reading of a lower-case word or spelled-out group."""
        if (known := self.seen.get(word)) is not None:
            return known
        log_p = self.log_p
        best = {(0, 0): (0.0, None)}  # last two letters -> score and the path as a linked list
        for options in self._options(word):
            after: dict = {}
            for (a, b), (score, path) in best.items():
                for said, cost in options:
                    x, y, s, p = a, b, score + cost, path
                    for c in said:
                        z = 0 if c == " " else int(_INDEX[ord(c)]) if ord(c) < 0x250 else _K - 1
                        if z == 0 and y == 0:
                            continue
                        s += log_p[x][y][z]
                        x, y, p = y, z, (p, c)
                    old = after.get((x, y))
                    if old is None or s > old[0]:
                        after[(x, y)] = (s, p)
            best = after
        score, path = max(((s + log_p[a][b][0] if b else s, p) for (a, b), (s, p) in best.items()), key=lambda t: t[0])
        said = []
        while path is not None:
            path, c = path
            said.append(c)
        if len(self.seen) > 100_000:
            self.seen.clear()
        found = self.seen[word] = "".join(reversed(said))
        return found

    def readings(self, word: str) -> tuple[str, ...]:
        """What a lower-case word between white space stands for, punctuation off; usually itself."""
        if word.isalpha() and not _RUN.search(word):
            return (word,)
        bare = _EDGE.sub("", word)
        if not _ODD.search(word):
            return (bare,) if bare else ()
        found = {bare, *self.restore(bare if bare[:1] == word[:1] else word.rstrip(".,;:!?*%&#$")).split()}
        return tuple(sorted(found - {""}))

    def spelled(self, low: str) -> list[str]:
        """Words restored from letters that stand apart."""
        return [x for m in _SPELLED.finditer(low) for x in self.restore(m[0]).split()]

    def words(self, text: str | None) -> Counter:
        """The lower-case words of the restored text and how often each occurs."""
        low = (text or "").lower()
        found = Counter(self.spelled(low))
        for word, n in Counter(low.split()).items():
            for said in self.readings(word):
                found[said] += n
        return found


def features(word: str, prefixes: tuple[int, ...] = (4, 5, 6)) -> list[str]:
    """The whole word, marked by its end, and its prefixes."""
    return [word + "$", *(word[:k] for k in prefixes if len(word) > k)]


def log_odds(toxic: float, other: float, base: float, prior: float) -> float:
    """Log odds against the base rate of a feature's share of toxic texts, shrunk by ``prior`` texts."""
    p = (toxic + prior * base) / (toxic + other + prior)
    return math.log(p / (1 - p)) - math.log(base / (1 - base))


class Scorer(Channel):
    """Weighs a text's words; what a word stands for and weighs is remembered."""

    def __init__(self, model: dict):
        super().__init__(model["grams"])
        self.model, self.known = model, {}
        self.starts = {f[:3] for f in model["features"]}

    def _stats(self, readings: Iterable[str]) -> tuple:
        """For each reading with known features, these features' counts and weights."""
        known = self.model["features"]
        return tuple(n for n in (tuple(known[f] for f in features(word) if f in known) for word in readings) if n)

    def heaviest(self, text: str | None, leave_out: int | None = None) -> list[float]:
        """Weights of the three heaviest words, each twice at most; ``leave_out``: the label of a text that the counts hold."""
        low, known, starts, found = (text or "").lower(), self.known, self.starts, []
        runs = bool(_RUN.search(low))
        for word, n in Counter(self.spelled(low)).items():
            found += [(stats, n) for stats in self._stats((word,))]
        for word, n in Counter(low.split()).items():
            if word[:3] not in starts and not runs and word.isalpha():
                continue  # it stands for itself, and no feature begins so
            stats = known.get(word)
            if stats is None:
                if len(known) > 200_000:
                    known.clear()
                stats = known[word] = self._stats(self.readings(word))
            if stats:
                found += [(x, n) for x in stats]
        base, prior, top = self.model["base"], self.model["prior"], []
        for stats, n in found:
            if leave_out is None:
                best = max(w for _, _, w in stats)
            else:
                best = max(log_odds(t - (leave_out == 1), c - (leave_out == 0), base, prior) for t, c, _ in stats)
            if best > 0:
                top += [best] * min(n, 2)
        top.sort(reverse=True)
        return [*top[:3], 0.0, 0.0, 0.0][:3]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Coefficients of a ridge logistic regression by Newton steps; the first is the intercept."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), ridge * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w)), x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _sum_trigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(_K**3, np.int64)
    for batch in batches:
        total += trigram_counts(batch["text"])
    at = np.flatnonzero(total)
    yield pd.DataFrame({"gram": at, "n": total[at]})


def fit(docs: DataFrame, labelled: DataFrame, text: str = "text", label: str = "label", prior: float = 20.0, min_texts: int = 5) -> dict:
    """Learn the model: ``docs`` (text) gives the language model, ``labelled`` (text, label 0 or 1) the rest.

    Null labels are left out. Where either class has no rows, the model scores every text alike with
    the share of toxic rows (0 without any).
    """
    sc = docs.sparkSession.sparkContext
    grams = docs.select(F.col(text).alias("text")).mapInPandas(_sum_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(_K**3, np.int64)
    for row in grams.collect():  # at most _K ** 3 rows
        counts[row["gram"]] = row["n"]
    labelled = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("label")).where("label is not null")
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {"grams": counts, "features": {}, "base": 0.5, "prior": prior, "w": np.array([30.0 if n1 else -30.0, 0, 0, 0])}
    shared = sc.broadcast(counts)

    def count_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, found = Channel(shared.value), (Counter(), Counter())

        def out() -> pd.DataFrame:
            names = list(found[0].keys() | found[1].keys())
            return pd.DataFrame({"f": np.array(names, dtype=object), "t": [found[1][x] for x in names], "c": [found[0][x] for x in names]})

        for batch in batches:
            for body, y in zip(batch["text"], batch["label"], strict=True):
                found[1 if y == 1 else 0].update({f for w in channel.words(body) for f in features(w)})
                if len(found[0]) + len(found[1]) > 300_000:
                    yield out()
                    found[0].clear()
                    found[1].clear()
        yield out()

    base = n1 / (n1 + n0)
    p = (F.col("t") + prior * base) / (F.col("t") + F.col("c") + prior)
    kept = labelled.mapInPandas(count_features, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kept = kept.where((F.col("t") >= min_texts) & (p > 1.5 * base))
    known = {r["f"]: (r["t"], r["c"], log_odds(r["t"], r["c"], base, prior)) for r in kept.collect()}
    model = {"grams": counts, "features": known, "base": base, "prior": prior}
    given = sc.broadcast(model)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(given.value)
        for batch in batches:
            top = [scorer.heaviest(body, int(y)) for body, y in zip(batch["text"], batch["label"], strict=True)]
            yield pd.DataFrame(top, columns=["a", "b", "c"]).assign(y=batch["label"].to_numpy(float))

    seen = labelled.mapInPandas(rows, "a double, b double, c double, y double").groupBy("a", "b", "c", "y").count()
    data = np.array([tuple(r) for r in seen.collect()], float)  # at most one row per training text
    data = np.repeat(data, data[:, 4].astype(int), axis=0)
    return model | {"w": logistic(data[:, :3], data[:, 3])}


def score(docs: DataFrame, model: dict, text: str = "text", out: str = "score") -> DataFrame:
    """Add the score, 0 to 1. Null and empty texts, and those without known words, get the model's floor."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer, w = Scorer(given.value), given.value["w"]
        for batch in batches:
            x = np.array([scorer.heaviest(body) for body in batch], float).reshape(-1, 3)
            yield pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ w[1:], -30, 30))))

    return docs.withColumn(out, scores(F.col(text)))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_train: int = 50_000, **options) -> dict:
    """Fit on the labelled rows that are not held out, at most about ``max_train`` of them by a hash of the id."""
    ids = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("doc_id")))
    total = ids.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < max(1, int(1e6 * min(1.0, max_train / max(total, 1))))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    chosen = ids.where(share)
    if chosen.count() <= 2 * max_train:  # the sample's bound; ids that labels repeat may exceed it
        chosen = F.broadcast(chosen)
    sample = materialize(texts.where(share).join(chosen, "doc_id").select("text", "label"), "toxic-sample")
    return fit(texts, sample, **options)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
