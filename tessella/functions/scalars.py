"""Scalar operators as column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2)


def any_of(text: Column, words: Iterable[str]) -> Column:
    """Does the text contain one of the words?"""
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def count_of(text: Column, words: Iterable[str]) -> Column:
    """How many of the words does the text contain?"""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def first_match(rules: Sequence[tuple[Column, str]], default: str | None) -> Column:
    """The value of the first rule that holds."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for condition, value in rules:
        out = out.when(condition, F.lit(value))
    return out.otherwise(F.lit(default))


def ascii_bounds(pattern: str) -> str:
    """A pattern whose ``\\b`` sees ASCII letters, digits and underscores only, whatever the Java version."""
    return pattern.replace("\\b", "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))")


def sql_pattern(pattern: str) -> str:
    """A pattern that Java reads as DuckDB does: no vertical tab in ``\\s``, only a newline ends ``.``, ``$`` is the very end."""
    return "(?d)" + pattern.replace("\\s", "[\\t\\n\\f\\r ]").replace("$", "\\z")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def tokens_bm25(text: Column) -> Column:
    """Lower-cased ASCII words of two or more letters or digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{2,}"), F.lit(0))


def tokens_ws(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "\\s+"), lambda w: w != "")


def token_f1(answer: Column, truth: Column) -> Column:
    """Struct of precision, recall and f1 of the distinct words."""
    a, b = F.array_distinct(tokens_ws(answer)), F.array_distinct(tokens_ws(truth))
    both = F.size(F.array_intersect(a, b)).cast("double")
    p, r = F.when(F.size(a) > 0, both / F.size(a)).otherwise(0.0), F.when(F.size(b) > 0, both / F.size(b)).otherwise(0.0)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return F.struct(p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def chunk_fixed(text: Column, size: int = 1000, step: int = 900) -> Column:
    """Array of overlapping pieces."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.transform(starts, lambda s: F.substring(text, s, F.lit(size)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 if a vector is all zeros."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def half_life(score: Column, days: Column, half: float = 30.0) -> Column:
    """Positive scores halve every ``half`` days."""
    return F.when(score > 0, score * F.pow(F.lit(2.0), -days / half)).otherwise(score)


def retention(elapsed: Column, half: float) -> Column:
    """Share that is left of a memory after ``elapsed``, in units of ``half``."""
    return F.when(elapsed <= 0, F.lit(1.0)).otherwise(F.exp(-elapsed * LN2 / half) if half > 0 else F.lit(0.0))


#: Half-lives in days.
HALF_LIVES = {"category_affinity": 14, "topic_strength": 30, "mood_weight": 3, "implicit_score": 21}


def decayed(value: Column, elapsed_days: Column, kind: str, least: float = 0.1) -> Column:
    return F.greatest(F.lit(least), F.round(value * retention(elapsed_days, HALF_LIVES.get(kind, HALF_LIVES["implicit_score"])), 4))


def trust_decay(score: Column, days: Column) -> Column:
    """Trust drifts to 0.5."""
    return F.when(days > 0, clamp(0.5 + (score - 0.5) * F.pow(F.lit(0.95), days), 0.1, 1.0)).otherwise(score)


def trust_fold(outcomes: Column, start: float = 0.5) -> Column:
    """Trust after an ordered array of booleans: up 0.05 or down 0.15, clamped at every step."""
    return F.aggregate(outcomes, F.lit(start), lambda s, ok: F.when(ok, F.least(F.lit(1.0), s + 0.05)).otherwise(F.greatest(F.lit(0.1), s - 0.15)))


def trust_step(trust: float, ok: bool) -> float:
    """One step of ``trust_fold``, for folds over sorted rows."""
    return min(1.0, trust + 0.05) if ok else max(0.1, trust - 0.15)


#: Parameters of the spaced-repetition schedule.
FSRS = (0.4, 0.6, 2.4, 5.8, 4.93, 0.94, 0.86, 0.01, 1.49, 0.14, 0.94, 2.18, 0.05, 0.34, 1.26, 0.29, 2.61)


def fsrs(stability: Column, difficulty: Column, rating: Column, elapsed: Column) -> Column:
    """Struct of stability, difficulty and interval after a review; for rating 2, which has no rule, nulls."""
    w = FSRS
    s, d, e = F.greatest(F.lit(0.1), stability), clamp(difficulty, 1.0, 10.0), F.greatest(F.lit(0.0), elapsed)
    recall = F.exp(math.log(0.9) * e / s)
    grown = s * (1 + w[8] * F.pow(d, F.lit(-w[9])) * F.pow(s, F.lit(w[0])) * (F.exp((1 - recall) * w[1]) - 1))
    new_s = F.when(rating == 1, w[10] * F.pow(s, F.lit(-w[12])) * (math.exp(0.1 * w[13]) - 1)).when(rating == 3, grown).when(rating == 4, grown * w[2])
    new_d = F.when(rating == 1, d + w[11] * (1 - d / 10)).when(rating == 3, d - w[11] * (d / 10 - 0.5)).when(rating == 4, d - w[11] * d / 10)
    new_s = F.when(new_s.isNotNull(), clamp(new_s, 0.1, 3650.0))
    new_d = F.when(new_d.isNotNull(), clamp(new_d, 1.0, 10.0))
    return F.struct(new_s.alias("stability"), new_d.alias("difficulty"), F.least(F.lit(365), F.round(new_s).cast("int")).alias("interval"))


def fsrs_step() -> Callable[[float, float, int, float], tuple[float, float]]:
    """Stability and difficulty after a review of rating 1, 3 or 4, as ``fsrs`` has them, for folds over sorted rows."""
    w = FSRS

    def step(stability: float, difficulty: float, rating: int, elapsed: float) -> tuple[float, float]:
        s, d, e = max(0.1, stability), min(max(difficulty, 1.0), 10.0), max(0.0, elapsed)
        if rating == 1:
            new_s, new_d = w[10] * s ** -w[12] * (math.exp(0.1 * w[13]) - 1), d + w[11] * (1 - d / 10)
        else:
            grown = s * (1 + w[8] * d ** -w[9] * s ** w[0] * (math.exp((1 - math.exp(math.log(0.9) * e / s)) * w[1]) - 1))
            new_s, new_d = (grown, d - w[11] * (d / 10 - 0.5)) if rating == 3 else (grown * w[2], d - w[11] * d / 10)
        return min(max(new_s, 0.1), 3650.0), min(max(new_d, 1.0), 10.0)

    return step


def half_up(x: float, digits: int) -> float:
    """Rounded as SQL rounds positive numbers, halves up."""
    return float(Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def card_status(elapsed: Column, stability: Column) -> Column:
    r = F.exp(math.log(0.9) * F.greatest(F.lit(0.0), elapsed) / stability)
    return F.when(elapsed < 0, "learning").when(r > 0.9, "mastered").when(r > 0.7, "review").otherwise("lapsed")


def implicit_signal(clicked: Column, latency_ms: Column) -> Column:
    late = F.when(latency_ms.isNull(), -0.15).when(latency_ms < 30000, 0.2).when(latency_ms < 300000, 0.05).otherwise(-0.05)
    return clamp(0.5 + F.when(clicked, 0.3).otherwise(0.0) + late, 0.0, 1.0)


def ucb1(score: Column, visits: Column, parent: Column) -> Column:
    return score / visits + 1.414 * F.sqrt(F.log(parent) / visits)


def sha_id(kind: Column, name: Column) -> Column:
    """First 16 hex digits of the digest of ``type:name``."""
    return F.substring(F.sha2(F.concat_ws(":", kind, F.lower(F.trim(name))), 256), 1, 16)


def hash32(text: Column) -> Column:
    """The 31-multiplier hash of the normalised text as a signed 32-bit number."""
    normal = F.regexp_replace(F.trim(F.lower(text)), "\\s+", " ")
    codes = F.transform(F.filter(F.split(normal, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    folded = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.when(folded >= 1 << 31, folded - (1 << 32)).otherwise(folded)


def source_score(kind: Column, amount: Column, relevant: Column, confidence: Column) -> Column:
    grown = lambda by: F.least(F.lit(1.0), F.log10(amount + 1) / by)
    base = F.lit(0.6)
    for name, by in (("repo", 5.0), ("video", 6.0), ("reddit", 3.0), ("stackoverflow", 2.5), ("hackernews", 3.0)):
        base = F.when((kind == name) & (amount > 0), grown(by)).otherwise(base)
    base = F.when(kind == "arxiv", 0.75).otherwise(base)
    base = base * F.when(~relevant, 0.5).otherwise(1.0) * F.when(confidence == "high", 1.1).when(confidence == "low", 0.85).otherwise(1.0)
    return clamp(base, 0.0, 1.0)
