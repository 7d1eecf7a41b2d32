"""Canonical aspects by a cascade of matches, and the validity of an opinion."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.functions.text import SPACE, strip
from reviewloom.operators.providers import NORMALIZATION_FIELDS, Completer, Embedder, HashedNgrams, complete_prompts, fill_template, structured, with_example
from reviewloom.sources.tables import materialize

#: Entries that the cascade holds at most.
MAX_SYNONYMS = 5_000
#: Least scores of the strategies (fixed values).
FUZZY, OVERLAP, SEMANTIC, MODEL = 0.75, 0.5, 0.7, 0.5


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, SPACE), lambda w: w != ""))


def _synonyms(synonyms: dict[str, str]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), F.lit(v).alias("v")) for i, (k, v) in enumerate(synonyms.items())])


def _best(scored: Column) -> Column:
    """Highest score, of equals the first entry: a struct (score, order, v), NULL if there is none."""
    return F.try_element_at(F.sort_array(scored, asc=False), F.lit(1))


def _fuzzy(synonyms: dict[str, str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            best = []
            for a in frame["a"]:
                ratios = [SequenceMatcher(None, a, k).ratio() for k in synonyms]
                top = max(range(len(ratios)), key=lambda i: (ratios[i], -i), default=None)
                best.append((list(synonyms.values())[top], ratios[top]) if top is not None and ratios[top] >= FUZZY else (None, None))
            yield frame.assign(fuzzy=[b[0] for b in best], fuzzy_score=[b[1] for b in best])

    return run


def normalize_aspects(aspects: DataFrame, synonyms: dict[str, str] = lx.ASPECT_SYNONYMS, fuzzy: bool = True) -> DataFrame:
    """(aspect_raw, aspect_norm, method, confidence) of each different aspect.

    Tried in order: an entry itself; an entry inside the aspect that makes up more than half of it, the longest first; an
    entry of similar spelling; an entry that shares at least half of all words; otherwise the aspect in lower case. NULL
    and empty aspects become empty. One synonym step is made, never two.
    """
    base = aspects.select("aspect_raw").distinct().withColumn("a", F.coalesce(strip(F.lower("aspect_raw")), F.lit("")))
    if fuzzy:
        spelled = base.select("a").distinct().mapInPandas(_fuzzy(synonyms), "a string, fuzzy string, fuzzy_score double")
        base = base.join(spelled, "a")
    else:
        base = base.withColumns({"fuzzy": F.lit(None).cast("string"), "fuzzy_score": F.lit(None).cast("double")})
    a, entries = F.col("a"), _synonyms(synonyms)
    exact = F.try_element_at(F.filter(entries, lambda e: e["k"] == a), F.lit(1))["v"]
    rated = lambda score, e: F.struct(score.cast("double").alias("score"), (-e["i"]).alias("order"), e["v"].alias("v"))
    partial = _best(F.transform(F.filter(entries, lambda e: F.contains(a, e["k"])), lambda e: rated(F.length(e["k"]) / F.length(a), e)))
    jaccard = lambda e: F.size(F.array_intersect(_words(a), _words(e["k"]))) / F.size(F.array_union(_words(a), _words(e["k"])))
    keyword = _best(F.filter(F.transform(entries, lambda e: rated(jaccard(e), e)), lambda r: r["score"] >= OVERLAP))
    out = base.withColumns({"exact": exact, "partial": F.when(a != "", partial), "keyword": F.when(a != "", keyword)})
    ways = [("exact", F.col("exact").isNotNull(), F.col("exact"), F.lit(1.0)), ("partial", F.col("partial.score") > 0.5, F.col("partial.v"), F.col("partial.score")), ("fuzzy", F.col("fuzzy").isNotNull(), F.col("fuzzy"), F.col("fuzzy_score")), ("keyword", F.col("keyword").isNotNull(), F.col("keyword.v"), F.col("keyword.score"))]

    def choose(index: int, otherwise: Column) -> Column:
        column = F.when(a == "", otherwise)
        for name, test, norm, confidence in ways:
            column = column.when(test, (F.lit(name), norm, confidence)[index])
        return column.otherwise(otherwise)

    return out.select("aspect_raw", choose(1, a).alias("aspect_norm"), F.when(a == "", "empty").otherwise(choose(0, F.lit("none"))).alias("method"), F.round(choose(2, F.lit(0.0)), 6).alias("confidence"))


def synonyms_of(entries: DataFrame) -> dict[str, str]:
    """A table (original, normalized) as the dictionary of the cascade, in the order of the originals.

    Both sides trimmed and in lower case, blank ones left out; of equal originals the last normalised name in order counts. More
    than MAX_SYNONYMS entries are an error: this cascade reads every entry for every aspect.
    """
    clean = {c: strip(F.lower(F.col(c))).alias(c) for c in ("original", "normalized")}
    rows = entries.select(*clean.values()).where("original <> '' and normalized <> ''").groupBy("original").agg(F.max("normalized").alias("normalized"))
    held = rows.orderBy("original").limit(MAX_SYNONYMS + 1).collect()
    if len(held) > MAX_SYNONYMS:
        raise ValueError(f"more than {MAX_SYNONYMS} synonyms")
    return {r["original"]: r["normalized"] for r in held}


def _vocabulary(synonyms: dict[str, str]) -> list[str]:
    return sorted(set(synonyms.values()))


def semantic_matches(aspects: DataFrame, vocabulary: list[str], build: Callable[[], Embedder] = HashedNgrams, threshold: float = SEMANTIC) -> DataFrame:
    """(a, term, similarity) of aspects (column a) whose vector is close enough to that of a term; the closest, of equals the smaller.

    The vocabulary is a dictionary that every worker encodes once; nothing but matches leaves it.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = build()
        unit = lambda v: np.divide(v, n := np.linalg.norm(v, axis=1, keepdims=True), out=np.zeros_like(v), where=n > 0)
        terms = unit(np.asarray(encoder.encode(vocabulary), dtype=np.float64)) if vocabulary else None
        for frame in frames:
            if terms is None or frame.empty:
                continue
            scores = np.round(unit(np.asarray(encoder.encode(frame["a"].tolist()), dtype=np.float64)) @ terms.T, 9)
            best = scores.argmax(1)
            out = pd.DataFrame({"a": frame["a"].to_numpy(), "term": [vocabulary[i] for i in best], "similarity": scores[np.arange(len(best)), best]})
            yield out[out["similarity"] >= threshold]

    return aspects.select("a").distinct().mapInPandas(run, "a string, term string, similarity double")


#: Prompt of the model that normalises an aspect.
NORMALIZATION_PROMPT = (
    "Map an aspect of a product review to the closest term of a list. If no term fits and the aspect means something, name a new term: a short English noun phrase in lower case. "
    "Mark words that name nothing, such as product or thing, as noise.\nAspect: {a}\nTerms: {terms}"
)


class PrefixNormalizer:
    """Stand-in for a normalising model: a term that begins with the same four letters, otherwise a new term; noise terms are noise."""

    def complete(self, prompts: list[str]) -> list[str]:
        answers = []
        for prompt in prompts:
            aspect = re.search(r"^Aspect: (.*)$", prompt, re.MULTILINE).group(1)
            terms = re.search(r"^Terms: (.*)$", prompt, re.MULTILINE).group(1).split(", ")
            fits = [t for t in terms if t[:4] == aspect[:4]]
            noise = aspect in lx.NOISE_TERMS
            new = not fits and not noise
            answers.append(json.dumps({"normalized_aspect": fits[0] if fits else aspect, "confidence": 0.9 if fits else 0.6, "is_noise": noise, "is_new_aspect": new, "should_add_to_taxonomy": new}))
        return answers


def model_matches(aspects: DataFrame, vocabulary: list[str], build: Callable[[], Completer] = PrefixNormalizer, retries: int = 1) -> DataFrame:
    """(a, term, confidence, is_noise, is_new) of aspects (column a) by a model's answer; failed calls give no row.

    One call per different aspect, on the workers. A term that the vocabulary lacks is new, whatever the answer says.
    """
    own = aspects.select("a").distinct()
    prompt = fill_template(with_example(NORMALIZATION_PROMPT.replace("{terms}", ", ".join(vocabulary)).replace("{a}", "\0"), NORMALIZATION_FIELDS).replace("{", "{{").replace("}", "}}").replace("\0", "{a}"), ["a"])
    answers = complete_prompts(own.withColumn("prompt", prompt), "a", "prompt", build, retries, lambda t: structured(t, NORMALIZATION_FIELDS)).where("parse_status = 'SUCCESS'")
    field = lambda name: F.get_json_object("llm_output", f"$.{name}")
    term = strip(F.lower(field("normalized_aspect")))
    return answers.select("a", term.alias("term"), field("confidence").cast("double").alias("confidence"), field("is_noise").cast("boolean").alias("is_noise"), (~term.isin(vocabulary)).alias("is_new"))


def normalize_with_models(
    aspects: DataFrame,
    synonyms: dict[str, str] = lx.ASPECT_SYNONYMS,
    fuzzy: bool = True,
    embed: Callable[[], Embedder] | None = None,
    complete: Callable[[], Completer] | None = None,
    semantic_threshold: float = SEMANTIC,
    model_threshold: float = MODEL,
) -> tuple[DataFrame, DataFrame]:
    """(names, growth): the cascade of normalize_aspects, then similar vectors, then a model, each for what is left over.

    names: aspect_raw, aspect_norm, method, confidence. growth: original, normalized, what the model adds to the synonyms.
    Terms that one answer adds do not change another, so that the result does not depend on the order of the calls; a
    second run with the grown synonyms finds them as exact entries. A noise verdict keeps the aspect (llm_noise).
    """
    base = materialize(normalize_aspects(aspects, synonyms, fuzzy).withColumn("a", F.coalesce(strip(F.lower("aspect_raw")), F.lit(""))))
    vocabulary, left = _vocabulary(synonyms), base.where("method = 'none'").select("a").distinct()
    none = aspects.sparkSession.createDataFrame([], "a string, term string, similarity double")
    similar = materialize(semantic_matches(left, vocabulary, embed, semantic_threshold)) if embed else none
    left = left.join(similar, "a", "left_anti")
    empty = aspects.sparkSession.createDataFrame([], "a string, term string, confidence double, is_noise boolean, is_new boolean")
    told = materialize(model_matches(left, vocabulary, complete)) if complete else empty
    joined = base.join(similar.withColumnRenamed("term", "near"), "a", "left").join(told.withColumnRenamed("confidence", "certainty"), "a", "left")
    sure = ~F.col("is_noise") & (F.col("certainty") >= model_threshold)
    open_ = F.col("method") == "none"
    pick = lambda near, sure_, noise, other: F.when(open_ & F.col("near").isNotNull(), near).when(open_ & sure, sure_).when(open_ & F.col("is_noise"), noise).otherwise(other)
    names = joined.select(
        "aspect_raw",
        pick(F.col("near"), F.col("term"), F.col("a"), F.col("aspect_norm")).alias("aspect_norm"),
        pick(F.lit("semantic"), F.lit("llm"), F.lit("llm_noise"), F.col("method")).alias("method"),
        F.round(pick(F.col("similarity"), F.col("certainty"), F.col("certainty"), F.col("confidence")), 6).alias("confidence"),
    )
    return names, told.where("is_new and not is_noise").select(F.col("a").alias("original"), F.col("term").alias("normalized"))


def is_noise_aspect(aspect: Column, terms: list[str] = lx.NOISE_TERMS) -> Column:
    """A noise term, or made of noise terms only."""
    words = F.filter(F.split(strip(F.lower(aspect)), SPACE), lambda w: w != "")
    return strip(F.lower(aspect)).isin(terms) | F.forall(words, lambda w: w.isin(terms))


def is_noise_issue(issue: Column) -> Column:
    return strip(F.lower(issue)).isin(lx.NOISE_ISSUES)


def validity(aspect: Column, issue: Column) -> Column:
    """INVALID if either side is NULL or empty, NOISE if either names nothing, otherwise VALID."""
    missing = (F.coalesce(aspect, F.lit("")) == "") | (F.coalesce(issue, F.lit("")) == "")
    return F.when(missing, "INVALID").when(is_noise_aspect(aspect) | is_noise_issue(issue), "NOISE").otherwise("VALID")


def rating_conflict(rating: Column, sentiment: Column) -> Column:
    """RATING_CONFLICT for high ratings with negative and low ratings with positive sentiment, otherwise NULL."""
    return F.when((rating >= 4) & (sentiment == "negative") | (rating <= 2) & (sentiment == "positive"), "RATING_CONFLICT")


def evidence_found(evidence: Column, sentence: Column) -> Column:
    """Whether the evidence stands in the sentence, letter case aside; empty evidence does."""
    return F.contains(F.lower(sentence), F.lower(F.coalesce(evidence, F.lit(""))))
