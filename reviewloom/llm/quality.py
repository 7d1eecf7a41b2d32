"""Per-document text statistics and fixed-threshold rules that tell prose from lists, tables and junk.

All statistics are column expressions over the whole text, so that the step is one narrow pass in the JVM. The rules
follow the published kind of web-text filters (word counts, symbol share, share of lines that end in punctuation or start
with a bullet, share of common words), each with a fixed threshold, and every rule that fails is named.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.functions.plans import filter_above

#: Common words that are compared at most; a longer list is an error, not cut.
MAX_COMMON_WORDS = 50_000
#: Prose holds at least one sentence end per so many words; texts of unspaced scripts are judged by characters.
MAX_WORDS_PER_END = 60
#: Share of common words from which a text without sentence ends reads as sentences.
MIN_COMMON = 0.25
#: Share of characters of scripts without spaces from which ends are not required.
MIN_UNSPACED = 0.08
#: Share of lines that must be made of cells, or start with a bullet.
MIN_CELL_LINES, MIN_BULLET_LINES = 0.6, 0.5
#: Share of letters and digits among visible characters below which a text is no list and no table.
MIN_ALNUM = 0.35
#: Words of an item of an enumeration, on average.
MAX_ITEM_WORDS = 7
#: Share of different words below which a text only repeats itself.
MIN_DISTINCT = 0.15
#: Share of words that can be spoken below which lines are no items.
MIN_SPEAKABLE = 0.6
#: Characters of a run between spaces or marks from which an unspaced script reads as clauses, where no sentence ends.
MIN_RUN = 5.0
#: Published thresholds (fixed values). Word count, mean word length, symbols (# and ellipsis) per word, lines that begin with
#: a bullet, lines that end in an ellipsis, words with a letter, and different stop words are those of the Gopher rules.
WORD_COUNT, WORD_LENGTH, SYMBOLS_PER_WORD = (50, 100_000), (3.0, 10.0), 0.1
BULLET_LINES, ELLIPSIS_LINES, ALPHABETIC_WORDS, STOP_WORDS = 0.9, 0.3, 0.8, 2
#: Published thresholds (fixed values) of FineWeb: punctuated lines, and lines of less than 30 characters.
PUNCTUATED_LINES, SHORT_LINE, SHORT_LINES = 0.12, 30, 0.67

_BULLET = r"^\s*(?:[-*•–—+·▪◦‣>]|\[.?\]|[☐☑✓✔]|\(?\p{N}{1,3}[.)]|\(?\p{Ll}[.)])\s"
#: Begins at the mark and looks back, since marks are few.
_END = r"[.!?…](?:(?<=[\p{L}\p{M}\p{N})\]\"”’»」%*_]\s?.)[.!?…]*[\p{Pe}\p{Pf}\"'*_~]*(?=\s|$))|[。！？｡।॥؟۔]"
_NO_WORD = r"[^\p{L}\p{M}\p{N}]+"
#: Thai, Lao, Myanmar, Khmer, kana and Han, by ranges, which are quicker to test than script properties.
_UNSPACED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}]+"
#: The end of a line, read backwards.
_LINE_END = r"^\s*[\p{Pe}\p{Pf}\"'*_~]*[.!?…。！？｡।॥؟۔:;]"


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _count(lines: Column, test: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(lines, test))


def _held(text: Column, marks: str) -> Column:
    """How many characters of the text are among the marks."""
    return F.length(text) - F.length(F.translate(text, marks, ""))


def _has(text: Column, part: str) -> Column:
    return F.contains(text, F.lit(part))


def _made_of_cells(line: Column) -> Column:
    """Whether a line is cut into cells; each pattern is tried only on lines that hold its mark."""
    quoted = (_has(line, '"') | _has(line, "'")) & line.rlike("[\"'][;,|][\"']")
    fields = _has(line, ";") & line.rlike(r"^[^;:]*;[^;]*(?:;|$)")
    columns = _has(line, "  ") & line.rlike(r"\S {2,}\S")
    return _has(line, "\t") | _has(line, "|") & line.rlike(r"\|.*\|") | _has(line, "</t") & line.rlike("</t[dh]>") | quoted | fields | columns | _has(line, ",") & ~line.rlike(r",\s")


def _common(common_words: DataFrame) -> list[str]:
    common = [r["word"] for r in common_words.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(MAX_COMMON_WORDS + 1).collect()]
    if len(common) > MAX_COMMON_WORDS:
        raise ValueError(f"more than {MAX_COMMON_WORDS} common words")
    return common


def _measured(documents: DataFrame) -> DataFrame:
    """Words, sentence ends and visible characters of each document: what the first rule of the verdict asks for."""
    text = F.coalesce("text", F.lit(""))
    tokens = F.array_remove(F.split(F.lower(text), _NO_WORD), "")
    base = documents.select("doc_id", text.alias("text"), tokens.alias("words"))
    bare = F.regexp_replace("text", "(?m)" + _BULLET, "")
    return base.select("*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).alias("word_chars"), F.regexp_count(bare, F.lit(_END)).alias("n_ends"), F.length(F.regexp_replace("text", r"[\s\p{Z}]+", "")).alias("visible"))


def _reads_as_sentences() -> Column:
    return (F.col("n_ends") > 0) & (F.col("n_words") <= MAX_WORDS_PER_END * F.col("n_ends")) & (F.col("n_words") > F.col("n_ends"))


def _judged(measured: DataFrame, common: list[str]) -> DataFrame:
    """All statistics of measured documents, their verdicts, and the rules that they fail."""
    base = measured.withColumn("lines", F.filter(F.split("text", r"\r\n|[\n\r\x{2028}\x{2029}]"), lambda x: x.rlike(r"\S")))
    foreign = F.octet_length("text") > F.length("text")
    unmarked = F.array_join(F.filter("lines", lambda x: ~x.rlike(_BULLET) & ~_made_of_cells(x)), " ")
    unspaced_chars = lambda t: F.when(foreign, F.length(t) - F.length(F.regexp_replace(t, _UNSPACED, ""))).otherwise(0)
    is_common = lambda w: w.isin(common) if common else F.lit(False)
    counted = base.select(
        "doc_id",
        "words",
        "n_words",
        "word_chars",
        "n_ends",
        "visible",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(F.filter("words", is_common)).alias("n_common"),
        (F.col("visible") - _held(F.col("text"), "|;,\"'-")).alias("without_rules"),
        unspaced_chars(F.col("text")).alias("n_unspaced"),
        unspaced_chars(unmarked).alias("n_unmarked_unspaced"),
        _count(F.col("lines"), lambda x: F.reverse(x).rlike(_LINE_END)).alias("n_punct_lines"),
        _count(F.col("lines"), lambda x: x.rlike(_BULLET)).alias("n_bullet_lines"),
        _count(F.col("lines"), _made_of_cells).alias("n_cell_lines"),
        F.regexp_count("text", F.lit(r",\s+")).alias("n_commas"),
        (_held(F.col("text"), "\t|;") + F.when(_has(F.col("text"), "</t"), F.regexp_count("text", F.lit("</t[dh]>"))).otherwise(0)).alias("n_separators"),
        (_held(F.col("text"), "#…") + F.when(_has(F.col("text"), "..."), F.regexp_count("text", F.lit(r"\.{3}"))).otherwise(0)).alias("n_symbols"),
        _count(F.col("lines"), lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")).alias("n_ellipsis_lines"),
        _count(F.col("lines"), lambda x: F.length(x) < SHORT_LINE).alias("n_short_lines"),
        # words of digits only sort before the colon, which spares most words the pattern
        F.size(F.filter("words", lambda w: (w < ":") & w.rlike(r"^\p{N}+$"))).alias("n_numeric"),
        F.size(F.array_distinct(F.filter("words", is_common))).alias("n_common_kinds"),
    )
    stats = counted.select(
        "*",
        F.col("word_chars").alias("n_alnum"),
        _share(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _share(F.greatest(F.col("visible") - F.col("word_chars"), F.lit(0)), F.col("visible")).alias("symbol_ratio"),
        _share(F.col("n_punct_lines"), F.col("n_lines")).alias("punctuated_line_share"),
        _share(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_share"),
        _share(F.col("n_cell_lines"), F.col("n_lines")).alias("cell_line_share"),
        _share(F.col("n_common"), F.col("n_words")).alias("common_word_share"),
    )
    ends = _reads_as_sentences()
    unspaced = F.col("n_unspaced") >= MIN_UNSPACED * F.col("visible")
    lines_of_marks = (F.col("bullet_line_share") >= MIN_BULLET_LINES) | (F.col("cell_line_share") >= MIN_CELL_LINES)
    # without spaces a run of letters is a clause; runs that are short, or stand in lines of marks only, are items
    clauses = (F.col("mean_word_length") >= MIN_RUN) & (F.col("n_unmarked_unspaced") >= MIN_UNSPACED * F.col("visible"))
    runs = (F.col("n_words") > 0) & ((F.col("n_ends") > 0) | clauses)
    readable = ends | unspaced & runs | (F.col("common_word_share") >= MIN_COMMON) & ~lines_of_marks
    # the costliest test, so only where no sentence was found; whatever reads as sentences is spoken
    stats = stats.withColumn("n_speakable", F.when(readable, F.col("n_words")).otherwise(F.size(F.filter("words", lambda w: w.rlike(r"[aeiouyàâäáãåæéèêëíìîïóòôöõøúùûü]|[^\x00-\x{24F}]|^\d+$") & ~w.rlike(r"[bcdfghjklmnpqrstvwxz]{5}|\d\p{L}|\p{L}\d\p{L}|^.{25}")))))
    repeats = (F.col("n_words") >= 30) & (F.col("n_distinct") < MIN_DISTINCT * F.col("n_words"))
    alnum = F.col("n_alnum") >= MIN_ALNUM * F.col("visible")
    prose = readable & ~(repeats & (F.col("n_ends") == 0)) & alnum
    speakable = F.col("n_speakable") >= MIN_SPEAKABLE * F.col("n_words")
    cells_alnum = F.col("n_alnum") >= MIN_ALNUM * F.col("without_rules")
    table = cells_alnum & (F.col("n_words") > 2) & (F.col("cell_line_share") >= MIN_CELL_LINES) & ((F.col("n_lines") > 1) | (F.col("n_separators") >= 4))
    item_words = F.col("n_words") / F.greatest(F.col("n_lines") + F.when(F.col("n_lines") <= 3, F.col("n_commas")).otherwise(0), F.lit(1))
    marked = F.col("bullet_line_share") >= MIN_BULLET_LINES
    plain = ((F.col("n_lines") >= 3) | (F.col("n_commas") >= 3)) & (item_words <= MAX_ITEM_WORDS)
    listed = alnum & (F.col("n_words") > 2) & (marked | plain) & speakable & ~repeats
    kind = F.when(prose, "prose").when(table & ~(marked & ~(F.col("n_separators") > F.col("n_lines"))), "table").when(listed, "list").otherwise("junk")
    n, per_line = F.col("n_words"), lambda c: _share(F.col(c), F.col("n_lines"))
    published = {
        "gopher_word_count": (n < WORD_COUNT[0]) | (n > WORD_COUNT[1]),
        "gopher_mean_word_length": (F.col("mean_word_length") < WORD_LENGTH[0]) | (F.col("mean_word_length") > WORD_LENGTH[1]),
        "gopher_symbols_per_word": _share(F.col("n_symbols"), n) > SYMBOLS_PER_WORD,
        "gopher_bullet_lines": F.col("bullet_line_share") > BULLET_LINES,
        "gopher_ellipsis_lines": per_line("n_ellipsis_lines") > ELLIPSIS_LINES,
        "gopher_alphabetic_words": 1 - _share(F.col("n_numeric"), n) < ALPHABETIC_WORDS,
        "gopher_stop_words": F.col("n_common_kinds") < STOP_WORDS,
        "fineweb_punctuated_lines": F.col("punctuated_line_share") <= PUNCTUATED_LINES,
        "fineweb_short_lines": per_line("n_short_lines") >= SHORT_LINES,
    }
    own = {
        "no_words": n == 0,
        "few_sentence_ends": ~ends & ~unspaced,
        "symbols": ~alnum,
        "bullet_lines": marked,
        "cell_lines": F.col("cell_line_share") >= MIN_CELL_LINES,
        "few_common_words": (F.col("common_word_share") < MIN_COMMON) & ~unspaced,
        "repetition": repeats,
        "unspeakable_words": ~speakable,
    }
    named = F.array_join(F.filter(F.array(*[F.when(test, name) for name, test in (published | own).items()]), lambda x: x.isNotNull()), ",")
    shares = ["mean_word_length", "symbol_ratio", "punctuated_line_share", "bullet_line_share", "cell_line_share", "common_word_share"]
    return stats.select("doc_id", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in shares], F.col("n_ends").cast("long").alias("n_sentence_ends"), kind.alias("kind"), named.alias("reasons"))


def document_statistics(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """One row per document: its statistics, the verdict `kind` (prose, list, table or junk), and the rules that it fails.

    documents: doc_id, text; common_words: word. NULL and blank texts have no words and are junk. Shares are between 0 and
    1; a share of nothing is 0. Repeated rows are judged alike, each for itself. `reasons` names every published rule and
    every rule of the verdict that the text fails, for prose too.
    """
    return _judged(_measured(documents), _common(common_words))


def not_prose(documents: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, kind) of the documents whose verdict is list, table or junk, each once.

    The verdicts are those of document_statistics. Its first rule settles most documents: what reads as sentences and is made
    of letters is prose whatever the other rules say, so these are asked for the rest only.
    """
    settled = _reads_as_sentences() & (F.col("word_chars") >= MIN_ALNUM * F.col("visible"))
    verdicts = _judged(filter_above(_measured(documents), ~settled), _common(common_words)).select("doc_id", F.explode(F.array("kind")).alias("kind"))
    return verdicts.where("kind <> 'prose'").distinct()
