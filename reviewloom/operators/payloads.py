"""Judging the payloads of an extraction model, and repairing its insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import lexicons as lx
from reviewloom.functions.text import SPACE, find, strip
from reviewloom.operators import normalize
from reviewloom.operators.flatten import decode, flatten_nested

FIELDS = ("aspect", "sentiment", "issue", "evidence_text", "sentiment_score")


def evidence_span(evidence: Column, sentence: Column) -> Column:
    """(start, end) of the evidence in the sentence, letter case aside: as a whole, or from its first three words on as far
    as its words follow in order; (-1, -1) if it is not there or either is NULL or empty."""
    e, s = strip(F.lower(evidence)), F.lower(sentence)
    words = F.filter(F.split(e, SPACE), lambda w: w != "")
    whole = find(s, e)
    head = find(s, F.array_join(F.slice(words, 1, 3), " "))
    walked = F.aggregate(words, F.struct(head.alias("end"), F.lit(True).alias("open")), lambda at, w: _walk(s, at, w), lambda at: at["end"])
    span = F.when(whole >= 0, F.struct(whole.alias("start"), (whole + F.length(evidence)).alias("end"))).when((F.size(words) > 0) & (head >= 0), F.struct(head.alias("start"), walked.alias("end")))
    usable = (F.coalesce(evidence, F.lit("")) != "") & (F.coalesce(sentence, F.lit("")) != "")
    return F.coalesce(F.when(usable, span), F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end")))


def _walk(text: Column, at: Column, word: Column) -> Column:
    place = F.position(word, text, at["end"] + 1) - 1
    return F.when(at["open"] & (place >= 0), F.struct((place + F.length(word)).alias("end"), F.lit(True).alias("open"))).otherwise(F.struct(at["end"].alias("end"), F.lit(False).alias("open")))


def _has_record(payload: str) -> Column:
    """Whether a payload holds a JSON object, looked for as flattening does."""
    return F.udf(lambda text: isinstance(decode(text), dict), "boolean", useArrow=True)(payload)


def judge_payloads(raw: DataFrame, sentences: DataFrame, fuzzy: bool = True, synonyms: dict[str, str] = lx.ASPECT_SYNONYMS) -> tuple[DataFrame, DataFrame]:
    """(valid, issues) of the latest successful payloads, judged against the sentences of their own run.

    raw: run_id, sentence_id, llm_output; sentences: run_id, sentence_id, target_sentence. A payload without a record, NULL
    included, is PARSE_FAIL, evidence that is not in the sentence EVIDENCE_NOT_FOUND; both are issues. Of equal opinions of a sentence
    one is kept. Rows without a sentence in their run are left out.
    """
    rows = raw.join(sentences.groupBy("run_id", "sentence_id").agg(F.min("target_sentence").alias("target_sentence")), ["run_id", "sentence_id"])
    listed = flatten_nested(rows, "llm_output", ["run_id", "sentence_id", "target_sentence"], ("aspects", "has_opinion", "extraction_warnings"), declared=["aspects"], fields=FIELDS).where("list_name = 'aspects'")
    found = normalize.evidence_found(F.col("evidence_text"), F.col("target_sentence"))
    broken = rows.where(~_has_record("llm_output")).select("run_id", "sentence_id", F.lit("PARSE_FAIL").alias("issue_type"))
    lost = listed.where(~found).select("run_id", "sentence_id", F.lit("EVIDENCE_NOT_FOUND").alias("issue_type"))
    names = normalize.normalize_aspects(listed.withColumnRenamed("aspect", "aspect_raw"), synonyms, fuzzy)
    kept = listed.where(found).withColumnRenamed("aspect", "aspect_raw").join(names, "aspect_raw").withColumn("issue_norm", strip(F.lower("issue")))
    kept = kept.withColumn("validity_label", normalize.validity(F.col("aspect_norm"), F.col("issue_norm")))
    valid = kept.where("validity_label = 'VALID'").groupBy("run_id", "sentence_id", "aspect_norm", "issue_norm").agg(F.min(F.struct("ordinal", "aspect_raw", "sentiment", F.expr("try_cast(sentiment_score as double)").alias("sentiment_score"), "evidence_text")).alias("r"))
    return valid.select("run_id", "sentence_id", "aspect_norm", "issue_norm", "r.aspect_raw", "r.sentiment", "r.sentiment_score", "r.evidence_text"), broken.unionByName(lost)


def new_opinions(judged: DataFrame, stored: DataFrame) -> DataFrame:
    """Judged opinions that the run does not hold yet, by sentence, aspect and issue; what the run holds counts if it is VALID."""
    keys = ["run_id", "sentence_id", "aspect_norm", "issue_norm"]
    return judged.join(stored.where("validity_label = 'VALID'").select(*keys), keys, "left_anti")


def trace_evidence(evidence: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Evidence items whose sentence is among the cluster's samples.

    evidence: keys, ordinal, sentence_id, quote; samples: keys, sample_no, sentence_id, target_sentence. A blank id is
    filled from the first sample that holds the quote or is held by it, otherwise from the first sample; foreign ids drop;
    a cluster left without evidence gets its first sample.
    """
    q, t = strip(F.lower("quote")), F.lower("target_sentence")
    held = evidence.where(F.coalesce("sentence_id", F.lit("")) == "").where(F.coalesce("quote", F.lit("")) != "").drop("sentence_id")
    matched = held.join(samples, keys).groupBy(*keys, "ordinal", "quote").agg(F.min(F.when(F.contains(t, q) | F.contains(q, t), F.struct("sample_no", "sentence_id"))).alias("hit"), F.min(F.struct("sample_no", "sentence_id")).alias("first"))
    filled = matched.select(*keys, "ordinal", F.coalesce("hit", "first")["sentence_id"].alias("sentence_id"), "quote")
    own = evidence.where(F.coalesce("sentence_id", F.lit("")) != "").join(samples.select(*keys, "sentence_id").distinct(), [*keys, "sentence_id"], "left_semi").select(*keys, "ordinal", "sentence_id", "quote")
    kept = own.unionByName(filled)
    first = samples.groupBy(*keys).agg(F.min(F.struct("sample_no", "sentence_id", F.substring("target_sentence", 1, 200).alias("quote"))).alias("f"))
    bare = first.join(kept, keys, "left_anti").select(*keys, F.lit(0).alias("ordinal"), "f.sentence_id", "f.quote")
    return kept.unionByName(bare)
