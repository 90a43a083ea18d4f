"""Scores, weights and vector measures as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: trust weights by model family, the first that the name holds; and without any
MODEL_WEIGHTS = (("opus", 1.0), ("sonnet", 0.85), ("gemini-pro", 0.80), ("gemini", 0.60), ("qwen", 0.50))
DEFAULT_MODEL_WEIGHT = 0.70
# fixed values: retention classes of entry types
RETENTION_OF_TYPE = {
    "durable": "decision policy rule convention contract procedure playbook runbook".split(),
    "audit": "trace security rollback permission audit".split(),
    "ephemeral": "chatter scratch transient temporary ephemeral".split(),
    "operational": "observation note finding fact memory focus_summary".split(),
}
# fixed values: phrases that tell a retention class
RETENTION_PHRASES = (
    ("durable", ("architectural", "architecture", "convention", "always", "never", "api contract", "must ", "do not")),
    ("audit", ("rollback", "permission", "security event", "audit")),
    ("ephemeral", ("throwaway", "temporary", "transient", "scratch")),
)
TTL_DAYS = {"operational": 90, "audit": 365, "ephemeral": 14}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def rounded(x: Column, digits: int) -> Column:
    """``x`` to ``digits`` decimals, halves of the scaled double away from zero; ``F.round`` takes the shortest decimal form for the number, so products a bit below a half go up."""
    scale = float(10**digits)
    return F.when(F.abs(x) < 1e9, F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale).otherwise(x)


def ratio(n: Column, d: Column) -> Column:
    """n / d, and 0 where d is not above 0."""
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def finite(x: Column) -> Column:
    """Non-finite numbers and nulls as minus infinity, so they sort last in descending order."""
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.lit(float("-inf"))).otherwise(x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Within 0 to 1; 0 for vectors of different length or of norm 0."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), clamp(dot(a, b) / n, 0.0, 1.0)).otherwise(F.lit(0.0))


def quantize(v: Column) -> Column:
    """Struct (scale, q): 8-bit integers and their scale, the largest component by 127."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    scale = F.when(top > 0, top / 127).otherwise(F.lit(1.0))
    return F.struct(scale.alias("scale"), F.transform(v, lambda x: F.round(x.cast("double") / scale).cast("tinyint")).alias("q"))


def dequantize(s: Column) -> Column:
    return F.transform(s["q"], lambda q: q * s["scale"])


def trust(confidence: Column, model: Column, weights=MODEL_WEIGHTS, default: float = DEFAULT_MODEL_WEIGHT) -> Column:
    low, weight = F.lower(model), F
    for name, w in weights:
        said = F.lit(True)
        for part in name.split("-"):
            said = said & low.contains(part)
        weight = weight.when(said, F.lit(w))
    return F.round(clamp(confidence, 0.0, 1.0) * weight.otherwise(F.lit(default)), 4)


def importance(score: Column, trust_score: Column) -> Column:
    return 0.65 * score + 0.35 * trust_score


def retention_class(kind: Column, text: Column, explicit: Column | None = None) -> Column:
    low, found = F.lower(F.trim(text)), F
    for name, kinds in RETENTION_OF_TYPE.items():
        found = found.when(F.lower(F.trim(kind)).isin(*kinds), name)
    for name, phrases in RETENTION_PHRASES:
        said = F.lit(False)
        for p in phrases:
            said = said | low.contains(p)
        found = found.when(said, name)
    found = found.otherwise("operational")
    return found if explicit is None else F.coalesce(explicit, found)


def ttl_days(retention: Column) -> Column:
    """Days to live; null for durable entries."""
    found = F
    for name, days in TTL_DAYS.items():
        found = found.when(retention == name, days)
    return found.otherwise(F.lit(None).cast("int"))


def fusion_weights(shape: Column) -> Column:
    """Struct (keyword, semantic) from a query's shape."""
    e, n = shape["exactish"], shape["naturalish"]
    k = 1.0 + F.when(e, 0.35).otherwise(0.0) - F.when(n, 0.15).otherwise(0.0)
    s = 1.0 - F.when(e, 0.15).otherwise(0.0) + F.when(n, 0.35).otherwise(0.0)
    return F.struct(clamp(k, 0.35, 1.75).alias("keyword"), clamp(s, 0.35, 1.75).alias("semantic"))


def ranking_weights(shape: Column, groups: Column) -> Column:
    """Struct (keyword, score, recency, retrieval) that sums to 1."""
    exact, natural = shape["exactish"] & ~shape["naturalish"], shape["naturalish"] & ~shape["exactish"]
    few, many = groups <= 1, groups >= 5
    # fixed values: a weight, and its steps for exact and natural queries, few and many groups
    steps = {"keyword": (0.40, 0.12, -0.08, 0.05, -0.04), "score": (0.25, -0.03, 0.05, 0.01, 0.02), "recency": (0.20, -0.05, 0.02, -0.03, 0.01), "retrieval": (0.15, -0.04, 0.01, -0.03, 0.01)}
    raw = {
        k: F.greatest(F.lit(0.05), a + F.when(exact, b).when(natural, c).otherwise(0.0) + F.when(few, d).when(many, e).otherwise(0.0))
        for k, (a, b, c, d, e) in steps.items()
    }
    total = raw["keyword"] + raw["score"] + raw["recency"] + raw["retrieval"]
    return F.struct(*[(v / total).alias(k) for k, v in raw.items()])


def lexical_score(weights: Column, groups: Column, matched: Column, score: Column, age_days: Column, retrievals: Column) -> Column:
    return (
        ratio(matched, groups) * weights["keyword"]
        + clamp(score, 0.0, 1.0) * weights["score"]
        + 1.0 / (1.0 + F.greatest(age_days, F.lit(0)) / 7.0) * weights["recency"]
        + F.least(F.greatest(F.coalesce(retrievals, F.lit(0)), F.lit(0)), F.lit(20)) / 20.0 * weights["retrieval"]
    )


def compound(rrf: Column, imp: Column, days: Column) -> Column:
    """0.6 of the fused rank, 0.2 of the importance (0-1, or 0-100), 0.2 of the recency; a null age is very old."""
    c = clamp(imp, 0.0, 100.0)
    return rrf * 0.6 + F.when(c <= 1, c).otherwise(c / 100) * 0.2 + F.coalesce(F.exp(-days / 30.0), F.lit(0.0)) * 0.2


def recency_step(age_hours: Column) -> Column:
    """Steps by age; 0.05 for unknown times."""
    h = F.greatest(age_hours, F.lit(0))
    return F.when(age_hours.isNull(), 0.05).when(h <= 1, 1.0).when(h <= 24, 0.85).when(h <= 168, 0.60).when(h <= 720, 0.35).when(h <= 2160, 0.15).otherwise(0.05)


def decay_factor(retrievals: Column, days: Column) -> Column:
    return F.pow(F.least(F.lit(1.0), 0.95 + 0.005 * F.least(retrievals, F.lit(10))), days)


def seconds_between(later: Column, earlier: Column) -> Column:
    return F.timestamp_diff("SECOND", earlier, later)
