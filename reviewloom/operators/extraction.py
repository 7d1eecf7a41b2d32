"""Aspects, sentiments and issues of sentences by word lists and patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.functions.plans import filter_above
from reviewloom.functions.text import BEFORE, SPACE, WORD, any_hit, constant_list, find, first_hit, hits, strip, window

_CANDIDATE = "array<struct<stage:int,seed_no:int,place:int,text:string,seed:string,confidence:double>>"


def _found(texts: Column, stage: int, seed_no: int, seed: str | None, confidence: float) -> Column:
    return F.transform(texts, lambda t, i: F.struct(F.lit(stage).alias("stage"), F.lit(seed_no).alias("seed_no"), i.cast("int").alias("place"), strip(t).alias("text"), F.lit(seed).cast("string").alias("seed"), F.lit(confidence).alias("confidence")))


def _n_words(text: Column) -> Column:
    return F.size(F.split(text, SPACE))


def with_candidates(sentences: DataFrame) -> DataFrame:
    """Adds `candidates`, an array of the aspect candidates of each sentence (target_sentence, context_text), first ones first.

    A seed with the word before and behind it (0.8), up to three words behind an adjective (0.6), and, where the sentence
    holds a pronoun, seeds of its context (0.5). Of equal texts the first counts: by stage, seed order, place.
    """
    s, context = F.lower("target_sentence"), F.lower("context_text")
    word_before = r"[\p{L}\p{N}_]*[\s\p{Z}]*"
    sentences = sentences.withColumns({"_s": s, "_context": context})
    s, context = F.col("_s"), F.col("_context")
    parts = [F.when(F.contains(s, F.lit(w)), _found(F.regexp_extract_all(s, F.lit(f"{word_before}{w}[\\s\\p{{Z}}]*[\\p{{L}}\\p{{N}}_]*"), F.lit(0)), 1, n, w, 0.8)) for n, w in enumerate(lx.ASPECT_SEEDS)]
    phrase = f"{BEFORE}(?:{'|'.join(lx.ADJECTIVES)}){SPACE}({WORD}(?:{SPACE}{WORD}){{0,2}})"
    parts.append(F.filter(_found(F.regexp_extract_all(s, F.lit(phrase), F.lit(1)), 2, 0, None, 0.6), lambda c: ~c["text"].isin(lx.STOP_NOUNS)))
    seeds = F.filter(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(w).alias("w")) for n, w in enumerate(lx.ASPECT_SEEDS)]), lambda x: F.contains(context, x["w"]))
    referred = F.transform(seeds, lambda x: F.struct(F.lit(3).alias("stage"), x["n"].alias("seed_no"), F.lit(0).alias("place"), x["w"].alias("text"), x["w"].alias("seed"), F.lit(0.5).alias("confidence")))
    parts.append(F.when(any_hit(s, lx.PRONOUNS), referred))
    joined = F.flatten(F.array(*[F.coalesce(p.cast(_CANDIDATE), F.array().cast(_CANDIDATE)) for p in parts]))
    sentences = sentences.withColumn("_all", F.filter(joined, lambda c: _n_words(c["text"]) <= 3)).drop("_s", "_context")
    first = F.filter("_all", lambda c, i: ~F.exists(F.slice("_all", 1, i), lambda e: e["text"] == c["text"]))
    return sentences.withColumn("candidates", first).drop("_all")


def candidates(sentences: DataFrame) -> DataFrame:
    """The candidates of with_candidates as rows; sentences without any give none."""
    return with_candidates(sentences).select("*", F.explode("candidates").alias("_c")).select("*", "_c.*").drop("_c", "candidates")


def ranked_candidates(sentences: DataFrame, most: int = 5) -> DataFrame:
    """Candidates that name something, best first, at most `most` per sentence, as rows with candidate_rank.

    A word of the candidate in the product's title or features adds 0.2, a sentiment word within 20 characters 0.1. All of
    it is done inside the row of the sentence, before the candidates become rows, and needs no shuffle.
    """
    meta_text = F.concat(F.coalesce(F.concat(F.lower("product_title"), F.lit(" ")), F.lit("")), F.coalesce(F.lower("features_short"), F.lit("")))
    rows = with_candidates(sentences).withColumns({"_s": F.lower("target_sentence"), "_meta": meta_text})
    s, meta = F.col("_s"), F.col("_meta")

    def rated(c: Column) -> Column:
        text = c["text"]
        near = window(s, text, find(s, text), 20)
        in_meta = F.exists(F.split(text, SPACE), lambda w: F.contains(meta, w)) & (meta != "")
        words = F.when(find(s, text) >= 0, F.filter(constant_list(lx.POSITIVE + lx.NEGATIVE), lambda w: F.contains(near, w))).otherwise(F.array().cast("array<string>"))
        confidence = c["confidence"] + F.when(in_meta, 0.2).otherwise(0.0)
        confidence = confidence + F.when(F.size(words) > 0, 0.1).otherwise(0.0)
        return F.struct((-confidence).alias("order"), *[c[n].alias(n) for n in ("stage", "seed_no", "place", "text", "seed")], confidence.alias("confidence"), F.array_distinct(words).alias("sentiment_words"))

    named = F.filter("candidates", lambda c: ~c["text"].isin(lx.STOP_NOUNS) & (F.length(c["text"]) >= 2) & (_n_words(c["text"]) <= 4))
    best = F.slice(F.array_sort(F.transform(named, rated)), 1, most)
    rows = rows.select("*", F.posexplode(best).alias("_i", "_c")).select("*", (F.col("_i") + 1).alias("candidate_rank"), "_c.*")
    return rows.drop("candidates", "_s", "_meta", "_i", "_c", "order")


def debug_features() -> Column:
    """What led to an opinion, as JSON: the seed, the sentiment words near it, and a pattern, which no stage names."""
    return F.to_json(F.struct(F.col("seed").alias("matched_seed"), "sentiment_words", F.lit(None).cast("string").alias("extraction_pattern")), {"ignoreNullFields": "false"})


def classify(rows: DataFrame) -> DataFrame:
    """Adds sentiment and sentiment_score from the words within 30 characters; candidates without any such word drop.

    A negation swaps the sides. Words of degree would scale both sides alike and change nothing, so they are not counted.
    """
    text, s = F.col("text"), F.lower(F.col("target_sentence"))
    near = F.col("_near")
    rows = rows.withColumn("_near", window(s, text, F.greatest(find(s, text), F.lit(0)), 30)).withColumns({"_p": hits(near, lx.POSITIVE), "_n": hits(near, lx.NEGATIVE), "_f": any_hit(near, lx.FLIPS)})
    rows = filter_above(rows, "_p + _n > 0")
    positive = F.when(F.col("_f"), F.col("_n")).otherwise(F.col("_p")) / (F.col("_p") + F.col("_n"))
    rows = rows.withColumn("_r", positive)
    sentiment = F.when(F.col("_r") > 0.6, "positive").when(F.col("_r") < 0.4, "negative").otherwise("neutral")
    score = F.when(F.col("_r") > 0.6, F.col("_r")).when(F.col("_r") < 0.4, 1 - F.col("_r")).otherwise(0.5)
    return rows.withColumns({"sentiment": sentiment, "sentiment_score": F.round(score, 6)}).drop("_near", "_p", "_n", "_f", "_r")


def issue_phrases(rows: DataFrame) -> DataFrame:
    """Adds issue_raw (the first template that fits within 15 characters) and evidence_text (100 characters)."""
    text, s = F.col("text"), F.lower(F.col("target_sentence"))
    evidence = F.substring("target_sentence", 1, 100)
    rows = rows.withColumns({"_near": window(s, text, find(s, text), 15), "evidence_text": evidence, "_has": find(s, text) >= 0})
    near = F.col("_near")
    some = lambda pattern, group: F.nullif(F.regexp_extract(near, pattern, group), F.lit(""))
    by_aspect = lambda tail, group: F.nullif(F.expr(f"regexp_extract(_near, concat(r'\\Q', text, r'\\E', r'{tail}'), {group})"), F.lit(""))
    is_what = strip(by_aspect(f"{SPACE}(?:is|are|was|were){SPACE}({WORD}(?:{SPACE}{WORD})?)", 1))
    does = F.concat(by_aspect(f"{SPACE}({WORD}){SPACE}({WORD})", 1), F.lit(" "), by_aspect(f"{SPACE}({WORD}){SPACE}({WORD})", 2))
    too = F.concat(F.lit("too "), some(f"too{SPACE}({WORD})", 1))
    no = F.concat(F.lit("not "), some(f"not{SPACE}({WORD})", 1))
    rows = rows.withColumns({"_word": first_hit(near, lx.POSITIVE + lx.NEGATIVE), "_words": F.filter(F.split(near, SPACE), lambda w: w != "")})
    at = F.array_position("_words", F.col("_word"))
    around = F.concat_ws(" ", "_word", F.when(at > 1, F.try_element_at("_words", (at - 1).cast("int"))), F.when((at > 0) & (at < F.size("_words")), F.try_element_at("_words", (at + 1).cast("int"))))
    fallback = F.concat_ws(" ", F.slice(F.filter(F.split(F.lower("evidence_text"), SPACE), lambda w: w != ""), 1, 5))
    issue = F.when(F.col("_has"), F.coalesce(is_what, does, too, no, F.when(F.col("_word").isNotNull(), around), fallback)).otherwise(fallback)
    return rows.withColumn("issue_raw", issue).drop("_near", "_has", "_word", "_words")


def extract(sentences: DataFrame, most: int = 5) -> DataFrame:
    """All steps: sentences (sentence_id, target_sentence, context_text, product_title, features_short) to opinions."""
    return issue_phrases(classify(ranked_candidates(sentences, most))).withColumnRenamed("text", "aspect_raw")
