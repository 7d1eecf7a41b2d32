"""Passages of held-out test items inside a corpus, also with exchanged numbers, names and units.

Texts are cut into words, and numbers, units and the names of the items become typed placeholders. Windows of these templates
are hashed; the windows of the test items are few and meet those of the corpus in a hash join that leaves the corpus where it
is. The words themselves are compared for each hit: all slots equal is a leaked passage. In an exchanged passage a name may be
one that no item holds and that has no form to tell it by, so windows meet by two words that are no names instead, and the
slots are checked word by word: slots exchanged consistently are a re-parameterised passage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.tables import materialize

#: Words of a window.
WINDOW = 12
#: Item windows that are copied to every executor (16 bytes and their words each); more are joined by a shuffle.
BROADCAST_WINDOWS = 500_000
#: Different hashes up to which the words of documents are tested for them before any join; it steers cost, not results.
PREFILTER_WINDOWS = 10_000
#: Gap between the two words of an anchor that is taken if there is any such pair; it steers cost, not results.
NEAR_GAP = 1
#: Number words (fixed values; en, de).
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn "
    "zwanzig dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend"
).split()
#: Unit words (fixed values; en, de).
UNITS = (
    "mm cm m km g kg mg l ml inch inches foot feet mile miles pound pounds ounce ounces second seconds minute minutes hour hours day days week weeks "
    "month months year years percent degree degrees dollar dollars euro euros volt volts watt watts sekunde sekunden minuten stunde stunden tag tage "
    "tagen woche wochen monat monate jahr jahre prozent grad"
).split()


def words(text: Column) -> Column:
    """Unbroken runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _kind(w: Column) -> Column:
    # digits sort before the colon, which spares most words the pattern
    digits = ((w < ":") | (F.octet_length(w) > F.length(w))) & w.rlike(r"^\p{N}+$")
    return F.when(w.isin(NUMBER_WORDS) | digits, "<number>").when(w.isin(UNITS), "<unit>")


def _template(tokens: Column, names: list[str]) -> Column:
    """Words with numbers, units and names replaced by typed placeholders."""
    return F.transform(tokens, lambda w: _kind(w).when(w.isin(names), "<name>").otherwise(w))


def _marks(df: DataFrame, key: str, window: int, names: list[str], leads: list[int] | None = None) -> DataFrame:
    """(key, lead, hash, check, held) of every different window, or of those that begin with the two words of a wanted lead.

    A window that a text repeats counts once. `hash` is one of the window's template, `check` one of its words, which keeps
    windows that differ in their slots from meeting in all pairs; `held` are the words and `lead` is a hash of the first two.
    """
    count = F.greatest(F.size("words") - window + 1, F.lit(0))
    first_two = F.zip_with(F.slice("words", 1, count), F.slice("words", 2, count), lambda a, b: F.xxhash64(a, b))

    def mark(lead: Column, i: Column) -> Column:
        own = F.slice("words", i + 1, window)
        template = F.slice("template", i + 1, window) if leads is None else _template(own, names)
        return F.struct(lead.alias("lead"), F.xxhash64(template).alias("hash"), F.xxhash64(F.lit(1), own).alias("check"), F.array_join(own, " ").alias("held"))

    marks = F.transform("leads", mark) if leads is None else F.filter(F.transform("leads", lambda x, i: F.when(x.isin(leads), mark(x, i))), lambda m: m.isNotNull())
    tokens = df.select(key, words(F.col("text")).alias("words")).withColumn("leads", first_two)
    if leads is None:  # each word is in many windows then, and typed once
        tokens = tokens.withColumn("template", _template(F.col("words"), names))
    return tokens.select(key, F.explode(F.array_distinct(marks)).alias("m")).select(key, "m.*")


def _few(df: DataFrame, column: str) -> list[int] | None:
    """The different values of a column if they are at most PREFILTER_WINDOWS; it spares rows the join, not results."""
    found = [r[0] for r in df.select(column).distinct().limit(PREFILTER_WINDOWS + 1).collect()]
    return found if len(found) <= PREFILTER_WINDOWS else None


def matching_windows(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, hash): every window that a document shares with an item, by its template and then word by word.

    documents: doc_id, text; items: item_id, text. NULL texts and texts of fewer words than the window hold none. The
    documents are read once, and of few items only windows that hit leave the scan. If the items hold more windows than are
    broadcast, a first reading shuffles hashes alone and leaves the item windows that some document may hold.
    """
    names = [r["word"] for r in _occurrences(items).where("name").select("word").distinct().collect()]
    asked = materialize(_marks(items, "item_id", window, names).distinct())
    marks = _marks(documents, "doc_id", window, names, _few(asked, "lead"))
    if asked.count() > broadcast_windows:
        asked = materialize(asked.join(marks.select("hash", "check"), ["hash", "check"], "left_semi"))
        marks = _marks(documents, "doc_id", window, names, _few(asked, "lead"))
    hint = F.broadcast if asked.count() <= broadcast_windows else (lambda df: df)
    met = marks.join(hint(asked.drop("lead").withColumnRenamed("held", "item_held")), ["hash", "check"])
    return met.where("held = item_held").select("doc_id", "item_id", "hash")


def _occurrences(items: DataFrame) -> DataFrame:
    """(item_id, text, position, word, name) of every word of the items; `name` as item_words tells it."""
    parts = F.regexp_extract_all("text", F.lit(r"[^\p{L}\p{N}]*[\p{L}\p{N}]+"), F.lit(0))
    seen = items.distinct().select("item_id", "text", F.posexplode(parts).alias("position", "part"))
    raw = F.regexp_extract("part", r"[\p{L}\p{N}]+$", 0)
    inside = (F.col("position") > 0) & F.col("part").rlike(r"^[ \t,;:'’/&-]+[\p{L}\p{N}]")
    seen = seen.select("item_id", "text", "position", raw.alias("raw"), F.lower(raw).alias("word"), inside.alias("inside"))
    small = seen.where("raw = word").select("word", F.lit(True).alias("small")).distinct()
    named = (F.col("raw") != F.col("word")) & (F.col("inside") | F.col("small").isNull()) & _kind(F.col("word")).isNull()
    return seen.join(small, "word", "left").select("item_id", "text", "position", "word", named.alias("name"))


def item_words(items: DataFrame) -> DataFrame:
    """(item_id, tokens): the words of each text in order, with template, its count, and whether their form tells a name.

    Told by the form of each occurrence: a word with a capital inside a sentence is a name; one that starts a sentence is,
    unless the items write it small anywhere.
    """
    seen = _occurrences(items).withColumn("template", _kind(F.col("word")).otherwise(F.col("word")))
    counts = seen.groupBy("template").agg(F.count(F.lit(1)).alias("n"))
    token = F.struct("position", "word", "template", "name", "n")
    return seen.join(counts, "template").groupBy("item_id", "text").agg(F.sort_array(F.collect_list(token)).alias("tokens")).select("item_id", "tokens")


def _anchored(items: DataFrame, window: int) -> DataFrame:
    """(item_id, item_position, item, at, gap, hash): every window of an item with two of its words that are no names.

    Any such pair finds the window; the pair of a short gap that the items hold least often is taken. A window of one word
    and names is anchored by that word, one of nothing but names by its first two.
    """
    places = F.sequence(F.lit(1), F.size("tokens") - window + 1)
    held = item_words(items).where(F.size("tokens") >= window)
    cut = held.select("item_id", F.explode(F.transform(places, lambda i: F.slice("tokens", i, window))).alias("item"))
    fixed = F.filter(F.sequence(F.lit(0), F.lit(window - 1)), lambda i: ~F.col("item")[i]["name"])

    def rated(a: Column, b: Column) -> Column:
        often = F.col("item")[a]["n"] * F.col("item")[b]["n"]
        return F.struct((b - a <= NEAR_GAP).alias("near"), (-often).alias("rare"), (a - b).alias("less"), a.alias("a"), b.alias("b"))

    pairs = F.flatten(F.transform("fixed", lambda a: F.transform(F.filter("fixed", lambda b: b > a), lambda b: rated(a, b))))
    chosen = cut.withColumn("fixed", fixed).withColumn("best", F.array_max(pairs))
    first = F.coalesce("best.a", F.get("fixed", F.lit(0)), F.lit(0))
    second = F.coalesce("best.b", F.get("fixed", F.lit(0)), F.lit(min(1, window - 1)))
    placed = chosen.select("item_id", F.col("item")[0]["position"].alias("item_position"), "item", first.alias("at"), second.alias("b"))
    gap, word_hash = F.col("b") - F.col("at"), lambda c: F.xxhash64(F.col("item")[F.col(c)]["template"])
    return placed.select("item_id", "item_position", "item", "at", gap.alias("gap"), F.xxhash64(word_hash("at"), word_hash("b"), gap).alias("hash"))


def matching_templates(documents: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, doc_words, item_words): pairs of windows that differ in numbers, units and names of the item only.

    In place of a name any word may stand that is written with a capital or is a name in an item; in a document or window
    without difference of case, any that the items do not hold as another word. Windows meet by an anchor of two words
    that are no names and are then compared word by word. The documents are read once: an anchor that hits takes the words
    around it along.
    """
    asked = materialize(_anchored(items, window))
    keys = asked.select("item_id", "item_position", "at", "hash")
    hint = F.broadcast if asked.count() <= broadcast_windows else (lambda df: df)
    wanted = _few(asked, "hash")
    raw = F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    own = documents.select("doc_id", raw.alias("raw"), (F.lower("text") == F.col("text")).alias("flat"))
    typed = own.withColumn("h", F.transform(F.transform("raw", F.lower), lambda w: F.xxhash64(_kind(w).otherwise(w))))

    def mark(hash_: Column, i: Column) -> Column:
        base = F.greatest(i - (window - 1), F.lit(0))
        return F.struct(i.alias("place"), hash_.alias("hash"), base.alias("base"), F.slice("raw", base + 1, 2 * window - 1).alias("near"))

    def marks(gap: int) -> Column:
        count = F.greatest(F.size("h") - gap, F.lit(0))
        pairs = F.zip_with(F.slice("h", 1, count), F.slice("h", gap + 1, count), lambda x, y: F.xxhash64(x, y, F.lit(gap)))
        if wanted is None:
            return F.transform(pairs, mark)
        return F.filter(F.transform(pairs, lambda h, i: F.when(h.isin(wanted), mark(h, i))), lambda m: m.isNotNull())

    gaps = sorted(r["gap"] for r in asked.select("gap").distinct().collect()) or [1]
    found = typed.select("doc_id", "flat", F.explode(F.flatten(F.array(*[marks(g) for g in gaps]))).alias("m")).select("doc_id", "flat", "m.*")
    hits = found.join(hint(keys), "hash").withColumn("position", F.col("place") - F.col("at")).where("position >= 0")
    cut = F.slice("near", F.col("position") - F.col("base") + 1, window)
    found = hits.select("doc_id", "item_id", "item_position", "position", "flat", cut.alias("raw")).where(F.size("raw") == window)
    met = found.join(asked.select("item_id", "item_position", "item"), ["item_id", "item_position"]).withColumn("doc_words", F.transform("raw", F.lower))

    def fits(i: Column) -> Column:
        t, w = F.col("item")[i], F.col("doc_words")[i]
        return (t["word"] == w) | F.when(t["name"], _kind(w).isNull()).otherwise(t["template"] == _kind(w).otherwise(w))

    every = F.sequence(F.lit(0), F.lit(window - 1))
    alike = met.where(F.forall(every, fits)).withColumn("item_words", F.transform("item", lambda t: t["word"]))
    # the form of a word tells nothing where all is small or all is large
    formless = F.col("flat") | F.forall("raw", lambda w: w == F.upper(w))
    alike = materialize(alike.select("doc_id", "item_id", "item_position", "position", "doc_words", "item_words", "item", "raw", formless.alias("formless")))
    placed = ["doc_id", "item_id", "item_position", "position"]
    changed = F.filter(every, lambda i: F.col("item")[i]["name"] & (F.col("item")[i]["word"] != F.col("doc_words")[i]))
    slots = alike.select(*placed, "formless", F.explode(F.transform(changed, lambda i: F.struct(F.col("doc_words")[i].alias("word"), F.col("raw")[i].alias("raw")))).alias("s"))
    slots = slots.select(*placed, "formless", "s.word", (F.col("s.raw") != F.col("s.word")).alias("capital"))
    told = F.explode("tokens").alias("t")
    forms = item_words(items).select(told).groupBy("t.word").agg(F.max("t.name").alias("known"))
    is_name = F.coalesce("known", F.col("formless") | F.col("capital")) | (F.col("capital") & ~F.col("formless"))
    wrong = slots.join(forms, "word", "left").where(~is_name).select(*placed).distinct()
    return alike.join(wrong, placed, "left_anti").select("doc_id", "item_id", "doc_words", "item_words")


def leaked_items(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that hold `window` consecutive words of an item."""
    return matching_windows(documents, items, window).select("doc_id", "item_id").distinct()


def reparameterised_items(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct (doc_id, item_id) of documents that hold a window with exchanged slots and none of the same item unchanged.

    An exchange counts if it is consistent: equal slots of the item stay equal in the document, different ones different.
    """
    pairs = matching_templates(documents, items, window)
    both = F.arrays_zip("item_words", "doc_words")
    changed = F.array_distinct(F.filter(both, lambda p: p["item_words"] != p["doc_words"]))
    consistent = (F.size(F.array_distinct(F.transform(changed, lambda p: p["item_words"]))) == F.size(changed)) & (F.size(F.array_distinct(F.transform(changed, lambda p: p["doc_words"]))) == F.size(changed))
    kept = F.forall(F.filter(both, lambda p: p["item_words"] == p["doc_words"]), lambda p: ~F.exists(changed, lambda c: c["item_words"] == p["item_words"]))
    marked = pairs.select("doc_id", "item_id", (F.col("doc_words") == F.col("item_words")).alias("same"), (consistent & kept).alias("consistent"))
    return marked.groupBy("doc_id", "item_id").agg(F.max("same").alias("same"), F.max("consistent").alias("consistent")).where("consistent and not same").select("doc_id", "item_id")
