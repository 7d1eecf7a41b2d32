"""Scoring sentences by the signs of an opinion they carry."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.functions.text import BEFORE, BEHIND, SPACE, WORD, any_hit, hits

#: Lists, points per entry, most points (fixed values).
LISTS = (("strong_opinion", lx.STRONG, 2.0, 4.0), ("suggestion", lx.SUGGESTION, 1.5, 3.0), ("comparison", lx.COMPARISON, 1.5, 3.0), ("problem", lx.PROBLEM, 1.5, 3.0), ("function", lx.FUNCTION, 1.0, 2.0), ("experience", lx.EXPERIENCE, 1.0, 2.0))
#: Name, points, pattern (fixed values).
PATTERNS = (
    ("suggestion_pattern", 1.5, f"{BEFORE}(?:should|would|could|might){SPACE}{WORD}"),
    ("recommendation_pattern", 1.5, f"{BEFORE}(?:recommend|suggest|advise){SPACE}{WORD}"),
    ("expectation_pattern", 1.0, f"{BEFORE}(?:wish|hope|expect){SPACE}{WORD}"),
    ("comparison_pattern", 1.0, f"{BEFORE}(?:better|worse|best|worst){SPACE}than"),
    ("comparative_pattern", 1.0, f"{BEFORE}(?:more|less){SPACE}{WORD}{SPACE}than"),
    ("problem_pattern", 1.5, f"{BEFORE}(?:problem|issue|defect|flaw){SPACE}with"),
    ("negation_verb_pattern", 1.5, f"{BEFORE}(?:doesn't|won't|can't){SPACE}{WORD}"),
    ("intensity_pattern", 1.0, f"{BEFORE}(?:too|so|very|extremely){SPACE}{WORD}"),
    ("negation_evaluation_pattern", 1.5, f"{BEFORE}(?:not|never){SPACE}{WORD}{SPACE}(?:enough|good|bad)"),
    ("time_experience_pattern", 1.0, f"{BEFORE}(?:after|since){SPACE}{WORD}{SPACE}(?:months?|years?|days?|weeks?)"),
    ("continuous_experience_pattern", 1.0, f"{BEFORE}(?:been|have been|has been){SPACE}{WORD}ing"),
)
#: What a text must hold for a pattern to have a chance: plain searches spare most texts the pattern.
HOLDS = {
    "suggestion_pattern": ("should", "would", "could", "might"),
    "recommendation_pattern": ("recommend", "suggest", "advise"),
    "expectation_pattern": ("wish", "hope", "expect"),
    "comparison_pattern": ("than",),
    "comparative_pattern": ("than",),
    "problem_pattern": ("with",),
    "negation_verb_pattern": ("n't",),
    "intensity_pattern": ("too", "so", "very", "extremely"),
    "negation_evaluation_pattern": ("not", "never"),
    "time_experience_pattern": ("after", "since"),
    "continuous_experience_pattern": ("been",),
}
FIRST_PERSON = f"{BEFORE}(?:i|my|me|we|our){BEHIND}"


def _patterns(text: Column) -> Column:
    held = {name: reduce(or_, [F.contains(text, F.lit(w)) for w in words]) for name, words in HOLDS.items()}
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(points).alias("points"), (held[name] & text.rlike(p)).alias("hit")) for name, points, p in PATTERNS])


def score_sentences(sentences: DataFrame, text: str = "target_sentence", shortest: int = 10, longest: int = 500, threshold: float = 2.0) -> DataFrame:
    """Adds is_candidate, filter_reason and priority_weight.

    Texts outside the length band score 0 with the reason too_short or too_long, NULL texts count as too short. Entries of
    the lists count as substrings, once each; the reasons are joined by `+`, of the patterns the first three are named.
    """
    s = F.col("_lower")
    sentences = sentences.withColumn("_lower", F.lower(F.coalesce(text, F.lit(""))))
    tests = {f"_{name}": hits(s, words) for name, words, _, _ in LISTS} | {"_negation": any_hit(s, lx.NEGATION), "_intensity": any_hit(s, lx.INTENSITY)}
    sentences = sentences.withColumns(tests | {"_patterns": F.filter(_patterns(s), lambda p: p["hit"]), "_first_person": s.rlike(FIRST_PERSON)})
    counts, negation, intensity, first_person = {name: F.col(f"_{name}") for name, *_ in LISTS}, F.col("_negation"), F.col("_intensity"), F.col("_first_person")
    score: Column = sum((F.least(counts[name] * F.lit(points), F.lit(most)) for name, _, points, most in LISTS), F.lit(0.0))
    score = score + F.when(negation & intensity, 1.5).when(negation, 0.5).otherwise(0.0) + F.when(F.contains(text, F.lit("!")), 0.5).otherwise(0.0)
    score = score + F.aggregate("_patterns", F.lit(0.0), lambda total, p: total + p["points"])
    score = score + F.when(first_person, 0.5).otherwise(0.0) + F.when(F.contains(text, F.lit("?")), 0.3).otherwise(0.0)
    named = F.transform("_patterns", lambda p: p["name"])
    reasons = [F.when(counts[name] > 0, F.concat(F.lit(f"{name}("), counts[name].cast("string"), F.lit(")"))) for name, *_ in LISTS]
    reasons += [F.when(negation & intensity, "negation_intensity").when(negation, "negation"), F.when(F.contains(text, F.lit("!")), "exclamation")]
    reasons += [F.when(F.size(named) > 0, F.concat(F.lit("patterns("), F.array_join(F.slice(named, 1, 3), ","), F.lit(")")))]
    reasons += [F.when(first_person, "first_person"), F.when(F.contains(text, F.lit("?")), "question")]
    length = F.coalesce(F.length(text), F.lit(0))
    inside = (length >= shortest) & (length <= longest)
    reason = F.when(length < shortest, "too_short").when(length > longest, "too_long").otherwise(F.coalesce(F.nullif(F.concat_ws("+", *reasons), F.lit("")), F.lit("no_opinion_signal")))
    weight = F.round(F.when(inside, score).otherwise(0.0), 4)
    scored = sentences.withColumns({"filter_reason": reason, "priority_weight": weight, "_inside": inside})
    return scored.withColumn("is_candidate", F.col("_inside") & (F.col("priority_weight") >= threshold)).drop("_lower", "_patterns", "_first_person", "_inside", *tests)
