"""Text measures and rewrites as column expressions. Word lists are arguments with defaults."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: stopwords of content keywords
STOPWORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might shall can "
    "to of in for on with at by from as into about that this it its not but and or if then so what which who "
    "how when where why all each every both few more most some any no my your his her our their i me"
).split()
# fixed values: words that mark an important sentence
SIGNAL_WORDS = (
    "must never always critical important decision fixed bug error confirmed approved rejected architecture design migration breaking security"
).split()
# fixed values: words that say little in long natural queries
LOW_SIGNAL = (
    "the a an is are was were be been being do does did to of in for on with at by from as into about that this it its my your our their i me we you "
    "what which who how when where why"
).split()
# fixed values: marks of specific texts
FILE_MARKS = ".rs .go .py .ts .tsx .js .jsx .json .toml .yaml .yml .sql .md".split()
CODE_MARKS = ("fn ", "func ", "def ", "class ", "struct ", "impl ", "select ", "insert ", "update ", "delete ")
# fixed values: signals of message types
DECISION_SIGNALS = (
    "always", "never", "prefer", "instead", "switch", "use", "avoid", "decided", "going with", "chose", "better to", "from now on",
    "don't use", "stop using", "migrate", "replace", "upgrade",
)
PREFERENCE_SIGNALS = (
    "i like", "i prefer", "i want", "i need", "my style", "my approach", "i usually", "i tend to", "my workflow", "i always", "for me",
)
FACT_SIGNALS = (
    "i work", "my job", "i'm a", "my team", "our project", "we use", "my stack", "i specialize", "my background", "i studied",
    "my company", "our codebase",
)
# fixed values: lines that say nothing
FILLER_LINES = (
    r"I will now\b.*", r"I am going to\b.*", r"Let me (first |now |also )(check|read|look|verify)\b.*", r"Now I will\b.*",
    r"Next,? I (will|need to|should)\b.*", r"First,? I (will|need to|should)\b.*", r"After completing (this|the|all)\b.*",
    r"The (current |following )?task (is|was)\b.*", r"Summary:?\s*", r"\s*",
)
# fixed values: home folders
HOME_FOLDERS = (r"C:\\Users\\[^\\]+", r"C:/Users/[^/]+", r"/c/Users/[^/]+", r"/home/[^/\s]+")


#: Characters that part words, as far as texts commonly hold them: those of two alphabets and of punctuation.
_PARTS = "".join(c for c in map(chr, [*range(0x250), *range(0x2000, 0x2070)]) if c not in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")


def _parted(text: Column, kept: str = "") -> Column:
    """The lower-case text split at characters other than a-z, 0-9 and ``kept``; there are empty strings among the parts.

    Common ones become spaces first, which takes a fifth of the time of a pattern; texts with others left are split by the pattern.
    """
    parts = "".join(c for c in _PARTS if c not in kept)
    both = F.struct(F.lower(text).alias("lower"), F.translate(F.lower(text), parts, " " * len(parts)).alias("spaced"))
    return bound(both, lambda x: F.split(F.when(F.octet_length(x["spaced"]) == F.length(x["spaced"]), x["spaced"]).otherwise(F.regexp_replace(x["lower"], f"[^a-z0-9{kept}]+", " ")), " ", -1))


def ascii_words(text: Column) -> Column:
    """Lower-case words of a-z, 0-9 and '-'; other characters part words."""
    return F.filter(_parted(text, "-"), lambda w: w != "")


def search_keywords(text: Column) -> Column:
    return F.filter(_parted(text, "-"), lambda w: F.length(w) > 1)


def content_keywords(text: Column, stopwords: list[str] = STOPWORDS) -> Column:
    stop = F.array(*[F.lit(w) for w in stopwords])
    return F.filter(_parted(text, "-"), lambda w: (F.length(w) > 2) & ~F.array_contains(stop, w))


def tokens(text: Column) -> Column:
    """Estimated tokens: UTF-8 bytes by 3.8, rounded up; none for null."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(3.8)).cast("long")


def truncate_to_tokens(text: Column, n: int) -> Column:
    """The text, or as many characters as ``n`` tokens are worth and an ellipsis."""
    return F.when(tokens(text) <= n, text).otherwise(F.concat(F.substring(text, 1, int(n * 3.8)), F.lit("...")))


def entropy(df: DataFrame, key: str, text: str, out: str = "entropy") -> DataFrame:
    """(key, out): Shannon entropy of each text's UTF-8 bytes in bits, rows with one key together; 0 without bytes.

    Bytes are counted within their row, over Arrow batches, so a text of any length sends at most 256 numbers.
    """

    @F.pandas_udf("array<struct<byte: int, n: long>>")
    def counted(texts: pd.Series) -> pd.Series:
        found = []
        for x in texts:
            n = np.bincount(np.frombuffer((x or "").encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
            found.append([{"byte": int(k), "n": int(n[k])} for k in np.flatnonzero(n)])
        return pd.Series(found)

    parts = df.select(key, F.explode(counted(F.col(text).cast("string"))).alias("x")).groupBy(key, "x.byte").agg(F.sum("x.n").alias("n"))
    sums = parts.groupBy(key).agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    empty = df.select(key).distinct()
    return empty.join(sums, key, "left").select(key, F.when(F.col("t") > 0, F.log2("t") - F.col("s") / F.col("t")).otherwise(F.lit(0.0)).alias(out))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def has_any(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])


def hits(text: Column, needles) -> Column:
    """How many of the needles the text holds."""
    return reduce(lambda a, b: a + b, [text.contains(n).cast("int") for n in needles])


def query_shape(query: Column) -> Column:
    """Struct (exactish, naturalish)."""
    trimmed = F.trim(query)
    low = F.lower(trimmed)
    n = F.size(F.filter(F.split(trimmed, r"\s+"), lambda w: w != ""))
    marks = has_any(trimmed, ['"', "`", "::", "/", "\\"]) | has_any(low, [".rs", ".ts", ".tsx", ".js", ".py"])
    return F.struct(
        (marks | (n <= 3) | (F.length(trimmed) <= 24)).alias("exactish"),
        ((n >= 8) | (F.length(trimmed) >= 56) | trimmed.endswith("?")).alias("naturalish"),
    )


def quality(text: Column) -> Column:
    """0 to 100: a band by length, 20 for specific texts, 30 less for questions."""

    def score(trimmed: Column) -> Column:
        n = F.length(trimmed)
        band = F.when(n < 10, 0).when(n < 50, 30).when(n < 200, 70).otherwise(100)
        # few texts hold the mark that the pattern needs, and seeking the pattern is dear
        named = trimmed.contains("_") & trimmed.rlike(r"(^|\s)(\S*[A-Za-z]\S*_\S*|\S*_\S*[A-Za-z]\S*)(\s|$)")
        code = bound(F.lower(trimmed), lambda low: has_any(low, [*FILE_MARKS, *CODE_MARKS]))
        specific = has_any(trimmed, ["/", "\\", "::", "()", "->"]) | code | named
        points = band + F.when(specific, 20).otherwise(0) - F.when(trimmed.endswith("?"), 30).otherwise(0)
        return F.greatest(F.lit(0), F.least(F.lit(100), points))

    return bound(F.trim(text), score)


def redact(text: Column) -> Column:
    """Bearer tokens, long hexadecimal runs and credentials in assignments, in this order."""
    once = F.regexp_replace(text, r"Bearer\s+[a-f0-9]{32,}", "Bearer [REDACTED]")
    twice = F.regexp_replace(once, "[a-f0-9]{40,}", "[HASH_REDACTED]")
    return F.regexp_replace(twice, r"(?i)(?:token|key|secret|password)\s*[:=]\s*\S+", "[CREDENTIAL_REDACTED]")


def sentences(text: Column) -> Column:
    """Trimmed parts between full stops and line ends of over five bytes."""
    return F.filter(F.transform(F.split(text, r"[.\n]"), lambda s: F.trim(s)), lambda s: F.octet_length(s) > 5)


def key_points(text: Column, signals=SIGNAL_WORDS) -> Column:
    """The first sentence and up to three later ones with a signal word, 300 characters at most."""
    parts = sentences(text)
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: has_any(F.lower(s), signals))
    joined = F.array_join(F.concat(F.slice(parts, 1, 1), F.slice(rest, 1, 3)), ". ")
    short = F.when(F.octet_length(joined) > 300, F.concat(F.substring(joined, 1, 300), F.lit("..."))).otherwise(joined)
    return F.when(F.size(parts) <= 2, F.substring(text, 1, 300)).otherwise(short)


def one_liner(text: Column) -> Column:
    return F.substring(F.coalesce(F.try_element_at(sentences(text), F.lit(1)), text), 1, 120)


def strip_filler(text: Column, fillers=FILLER_LINES) -> Column:
    """The text without lines that are narration only."""
    pattern = "(?i)^(" + "|".join(fillers) + ")$"
    return F.trim(F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.trim(x).rlike(pattern)), "\n"))


def compress(text: Column, max_length: int = 500) -> Column:
    """Filler out, home folders as '~', white space collapsed; long texts as the first sentence of each paragraph.

    Filler are the lines of ``FILLER_LINES``; narration in other words stays, as do lines that go on with a fact.
    """
    x = strip_filler(text)
    for folder in HOME_FOLDERS:
        x = F.regexp_replace(x, folder, "~")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, "\n{3,}", "\n\n"), r"[ \t]+(?=\n|$)", ""))
    paragraphs = F.filter(F.transform(F.split(x, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    facts = F.array_join(F.transform(paragraphs, lambda p: F.when(p.rlike(r"^.+?\.\s"), F.regexp_extract(p, r"^(.+?\.)\s", 1)).otherwise(F.substring(p, 1, 200))), " ")
    x = F.when((F.length(x) > max_length) & (F.length(x) >= 500), facts).otherwise(x)
    return F.when(F.length(x) > max_length, F.concat(F.regexp_replace(F.substring(x, 1, max_length), " [^ ]*$", ""), F.lit("..."))).otherwise(x)


def classify_message(text: Column, decision=DECISION_SIGNALS, preference=PREFERENCE_SIGNALS, fact=FACT_SIGNALS) -> Column:
    """Struct (kind, confidence) by the number of signals in the text."""
    low = F.lower(text)
    d, p, f = hits(low, decision), hits(low, preference), hits(low, fact)
    kind = F.when(d >= 2, "decision").when(p >= 1, "preference").when(f >= 1, "fact").otherwise("context")
    sure = F.when(d >= 2, F.least(F.lit(0.9), 0.5 + d * 0.1)).when(p >= 1, F.least(F.lit(0.85), 0.5 + p * 0.15)).when(f >= 1, F.least(F.lit(0.8), 0.5 + f * 0.15)).otherwise(0.4)
    return F.struct(kind.alias("kind"), sure.alias("confidence"))


def token_set(text: Column, variant: str) -> Column:
    """Distinct tokens. ws: by white space, case kept; lower2: alphanumeric, over one character; lower3: over two;
    alnum3: by white space, punctuation trimmed, over two; terms: content keywords."""
    if variant == "ws":
        return F.array_distinct(F.filter(F.split(F.translate(text, "\t\n\x0b\f\r", " " * 5), " ", -1), lambda w: w != ""))
    if variant in ("lower2", "lower3"):
        return F.array_distinct(F.filter(_parted(text), lambda w: F.length(w) > int(variant[-1]) - 1))
    if variant == "alnum3":
        trimmed = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
        return F.array_distinct(F.filter(trimmed, lambda w: F.length(w) > 2))
    return F.array_distinct(content_keywords(text))


def jaccard(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Jaccard similarity of token arrays without repeats; ``empty`` for two empty sets."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(empty)).otherwise(common / union)


def text_jaccard(a: Column, b: Column, variant: str, empty: float = 1.0) -> Column:
    """Jaccard similarity of the token sets of two texts; the sets are made once a row, not anew wherever ``jaccard`` names them."""
    sets = F.struct(token_set(a, variant).alias("a"), token_set(b, variant).alias("b"))

    def share(s: Column) -> Column:
        sizes = F.size(s["a"]) + F.size(s["b"])
        return F.when(sizes == 0, F.lit(empty)).otherwise(bound(F.size(F.array_intersect(s["a"], s["b"])), lambda common: common / (sizes - common)))

    return F.when(a.isNotNull() & b.isNotNull(), bound(sets, share)).otherwise(jaccard(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"), empty))


def content_hash(text: Column) -> Column:
    """32-bit FNV-1a over the code points of the first 100 characters, as a long."""
    chars = F.filter(F.split(F.substring(text, 1, 100), ""), lambda c: c != "")
    step = lambda h, c: F.pmod(h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619), F.lit(1 << 32))
    return F.aggregate(chars, F.lit(2166136261).cast("long"), step)


def parse_ts(text: Column) -> Column:
    """Time without a zone from RFC 3339 or 'yyyy-MM-dd HH:mm:ss', with or without a fraction; else 1970."""
    bare = F.regexp_replace(F.trim(text), r"(Z|\+00:00)$", "")
    ok = bare.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?$")
    return F.coalesce(F.when(ok, bare.try_cast("timestamp_ntz")), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def parse_source(source: Column) -> Column:
    """Struct (kind, id) of keys such as decision::42; nulls where the key has another form."""
    return F.struct(
        F.nullif(F.regexp_extract(source, r"^(\w+)::(\d+)$", 1), F.lit("")).alias("kind"),
        F.regexp_extract(source, r"^(\w+)::(\d+)$", 2).try_cast("long").alias("id"),
    )


def normalize_client(raw: Column) -> Column:
    x = F.regexp_replace(F.lower(F.trim(F.substring_index(raw, "(", 1))), "[^a-z0-9_-]", "")
    return F.when(F.coalesce(x, F.lit("")) == "", "unknown").otherwise(x)


def normalize_depth(raw: Column, known=("chain-of-thought", "single-shot", "tool-assisted", "multi-step", "user-stated")) -> Column:
    x = F.regexp_replace(F.translate(F.lower(F.trim(raw)), " _", "--"), "[^a-z0-9-]", "")
    return F.when(x.isin(*known), x).otherwise("single-shot")


# fixed values: words for outcomes, the longest label
OUTCOMES = {"success": ("success", "ok", "pass"), "partial": ("partial", "mixed", "degraded"), "failure": ("failure", "fail", "error")}
LABEL_BYTES = 160


def normalize_outcome(raw: Column) -> Column:
    """success, partial or failure; null for any other word."""
    x, out = F.lower(F.trim(raw)), F.lit(None).cast("string")
    for name, words in OUTCOMES.items():
        out = F.when(x.isin(*words), name).otherwise(out)
    return out


def normalize_task_class(raw: Column) -> Column:
    return F.lower(F.coalesce(F.nullif(F.trim(raw), F.lit("")), F.lit("general")))


def _label(raw: Column) -> Column:
    """The trimmed label; null if it is empty, too long or holds control characters."""
    x = F.trim(raw)
    return F.when((x != "") & (F.octet_length(x) <= LABEL_BYTES) & ~x.rlike(r"\p{Cntrl}"), x)


def normalize_agent(raw: Column, model: Column) -> Column:
    """An agent's label with its model in brackets, where it names none and one is known; null for labels that are empty, too long or hold control characters."""
    agent, of = _label(raw), _label(model)
    named = F.when(agent.contains("(") | of.isNull(), agent).otherwise(F.concat(F.when(F.lower(agent) == "droid", F.upper(agent)).otherwise(agent), F.lit(" ("), of, F.lit(")")))
    return F.when(F.octet_length(named) <= LABEL_BYTES, named)


def excerpt(text: Column, terms: Column, n: int) -> Column:
    """A window of ``n`` characters around the first hit of the longest term, a third of it before the hit. The lower-case text is made once a row."""

    def window(low: Column) -> Column:
        found = F.filter(terms, lambda t: F.contains(low, t))
        best = F.array_min(F.transform(found, lambda t: F.struct((-F.length(t)).alias("l"), t.alias("t"))))["t"]
        return F.coalesce(F.greatest(F.instr(low, best) - n // 3, F.lit(1)), F.lit(1))

    at = F.when(F.length(text) <= n, F.lit(1)).otherwise(F.element_at(F.transform(F.array(F.lower(text)), window), 1))

    def cut(at: Column) -> Column:
        start = F.greatest(F.lit(1), F.least(at, F.length(text) - n + 1))
        return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, F.lit(n)), F.when(start + n <= F.length(text), "...").otherwise(""))

    return F.when(F.length(text) <= n, text).otherwise(F.element_at(F.transform(F.array(at), cut), 1))


def query_terms(query: Column) -> Column:
    """Distinct words of two or more letters or digits, and bigrams of runs of CJK characters."""
    low = F.lower(query)
    words = F.regexp_extract_all(low, F.lit("([a-z0-9]{2,})"), 1)
    runs = F.regexp_extract_all(low, F.lit("([一-鿿]{2,})"), 1)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, grams))
