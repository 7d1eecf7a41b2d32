"""Sentence boundaries in any language and script.

Follows the sentence-break rules of Unicode Standard Annex 29: terminators are the characters of the properties STerm and
ATerm, with closing marks and spaces attached to the sentence that they end. On top of these rules come the suppressions
that the annex leaves to tailoring: abbreviations by language, initials and ordinals, brackets and quotations inside a
sentence, and speaker clauses after a quotation. Scripts that write no spaces need none; Thai, Lao, Khmer and Burmese end
sentences by spaces.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Abbreviations after which a sentence goes on, by language (fixed values). Arabic and Hindi write them with a full stop too, Thai
#: before a name; Chinese and Japanese have none of their own.
ALWAYS = {
    "en": frozenset("mr mrs ms messrs dr prof lt sgt capt col gen rev hon st mt vs approx incl excl cf e.g i.e viz eg ie esp resp dept".split()),
    "de": frozenset("dr prof hr fr st ca bzw z.b d.h u.a z.t i.d.r inkl exkl zzgl vgl evtl ggf sog bspw dipl ing".split()),
    "fr": frozenset("m mm mme mmes mlle mlles dr pr me st ste env cf c.-à-d c-à-d p.ex".split()),
    "es": frozenset("sr sra sres sras srta dr dra prof d dña ud uds aprox p.ej".split()),
    "ar": frozenset("د أ.د م ص ت".split()),
    "hi": frozenset("डॉ प्रो श्री पं कु रु".split()),
    "th": frozenset("ดร นพ พญ ผศ รศ พ.ศ ค.ศ".split()),
}
#: Abbreviations only before a number, by language (fixed values).
BEFORE_NUMBER = {
    "en": frozenset("no nos nr num art fig figs p pp pg s vol ch sec eq est jan feb mar apr jun jul aug sep sept oct nov dec".split()),
    "de": frozenset("nr nrn no art abb s bd kap jan feb mär apr jun jul aug sep sept okt nov dez".split()),
    "fr": frozenset("n no nos num art fig p pp vol ch chap sec janv févr avr juil sept oct nov déc".split()),
    "es": frozenset("n no núm num art fig p pp pág págs vol cap ene feb mar abr may jun jul ago sep sept oct nov dic".split()),
}
#: Abbreviations that may also end a sentence, by language (fixed values).
MAY_END = {
    "en": frozenset("etc p.m a.m u.s u.s.a u.k e.u u.n d.c ph.d m.d inc ltd co corp jr".split()),
    "de": frozenset("etc usw usf u.s u.s.a p.m a.m".split()),
    "fr": frozenset("etc u.s u.s.a p.m a.m".split()),
    "es": frozenset("etc ee.uu u.s u.s.a p.m a.m s.a s.l cía".split()),
}
#: Words that tell the language of a text in Latin script (fixed values).
FUNCTION_WORDS = {
    "en": frozenset("the and is was are it its to of my our this that with for not but they we you have has had in on at after from about i so very".split()),
    "de": frozenset("der die das und ist war nicht ich mit ein eine einen für auf zu dem den sie wir es aber nach im am sich hat".split()),
    "fr": frozenset("le la les et est était un une des du je pas pour que dans il elle ce cette mon ma nous avec mais après sur au ne".split()),
    "es": frozenset("el la los las y es era un una de del que por con mi se lo en muy pero al para su después nos".split()),
}
#: Abbreviations that are words in some of these languages: they hold in the languages that list them only (fixed values).
WORDS_TOO = frozenset("col me d m ca est gen hon rev st fr ing dipl art may mar vol sec cap dec fig no nos num n s p co corp".split())
_LISTED = frozenset().union(*(words for kind in (ALWAYS, BEFORE_NUMBER, MAY_END) for words in kind.values()))
_OWN_SCRIPT = {"ar": regex.compile(r"\p{Script=Arabic}"), "hi": regex.compile(r"\p{Script=Devanagari}"), "th": regex.compile(r"\p{Script=Thai}")}


#: Words that open a sentence more often than they follow a name (fixed values).
OPENERS = frozenset("the my our your his her their its it they we you i he she if in at is are was were do does did who what why when where would after before this that these those a an not no yes so even both ask put for".split())
#: Verbs of speaker clauses (fixed values; en, de, fr, es).
SPEECH = frozenset("said asked says asks replied answered shouted cried told wrote wondered added whispered exclaimed sagte fragte rief meinte antwortete schrieb dit demanda demande répondit écria cria lança dijo preguntó respondió gritó exclamó pregunta dice".split())
#: Words with which a sentence goes on after an inner quotation (fixed values).
JOINERS = frozenset("and but or nor so then yet while und oder aber dann et ou mais puis y o pero luego".split())
#: Months after a German ordinal (fixed values).
MONTHS = frozenset("januar jänner februar märz april mai juni juli august september oktober november dezember".split())

_STOPS = r"[\p{Sentence_Break=STerm}\p{Sentence_Break=ATerm}…]"
_IGNORED = r"[\p{Sentence_Break=Extend}\p{Sentence_Break=Format}]*"


def _ending(closing: str) -> regex.Pattern:
    """A run of terminators with the closing marks directly behind it; a space may stand before a French closing quote."""
    return regex.compile(rf"(?P<stops>(?:{_STOPS}{_IGNORED})+)(?P<marks>(?:[\p{{Zs}}]?[»›]|[{closing}]|[\p{{Sentence_Break=Format}}])*)")


_CLOSING = r"\p{Pe}\p{Pf}\"'*_~`´"
_END = _ending(_CLOSING)
#: In a text with low opening quotes, the raised opening quote closes.
_END_LOW_QUOTES = _ending(_CLOSING + "“‘")
_STRONG = regex.compile(r"\p{Sentence_Break=STerm}")
_SPACED_SCRIPT = regex.compile(r"(?<=[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}])[\p{Z}\s]+(?=[\p{Script=Thai}\p{Script=Lao}\p{Script=Khmer}\p{Script=Myanmar}\p{L}\p{Ps}\p{Pi}\"'*_])")
_BLANK_LINE = regex.compile(r"\s*\n[^\S\n]*\n\s*| ")
_LINE = regex.compile(r"\s*(?:\r\n|[\n\r\u0085 ])\s*")
_SPACE = regex.compile(r"[\s\p{Z}]*")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}'’\-]+")
_NAME = regex.compile(r"\p{L}[\p{L}\p{M}'’\-]*")
_LABELS = regex.compile(r"[^\n;|.!?]{1,40}[:：][^\n;|]{1,60}(?:[;|][^\n;|.!?]{1,40}[:：][^\n;|]{1,60})+")
_LABEL_ONE = regex.compile(r"^\p{L}[\p{L} ]{0,20}[:：]")
_LAST_VALUE = regex.compile(r"(?<=[\p{Ll}\p{N}])\s+(?=[\p{Pi}\"'(]?\p{Lu}\p{Ll}*[\s'’])")
_HAS_ALNUM = regex.compile(r"[\p{L}\p{N}]")
_CJK_SPEAKER = regex.compile(r"[^。！？，、\s]{0,6}(?:说|道|问|喊|答|表示|回答)(?![：:])|と|って")
_PAIRS = {")": "(", "]": "[", "}": "{", "）": "（", "］": "［", "｝": "｛", "】": "【"}


def _cased(text: str) -> bool:
    """Whether upper and lower case can be trusted as signs: neither all capitals, nor all small, nor Every Word Capital."""
    words = [w for w in _WORD.findall(text) if w[0].isalpha()]
    if len(words) < 2:
        return bool(words) and words[0][0].isupper() and not words[0].isupper()
    capital = sum(w[0].isupper() for w in words)
    return words[0][0].isupper() and 2 * capital <= len(words) + 1 and any(c.islower() for c in text)


def _token_before(text: str, start: int, dot: int) -> str:
    """The word that a full stop ends, without opening marks, with its inner stops."""
    i = dot
    while i > start and not text[i - 1].isspace():
        i -= 1
    return text[i:dot].lstrip("(（[\"'“”„«‘’´`*_¿¡").lower()


class _Suppressed:
    """The abbreviations of the language of a text, which is told when the first one is asked for."""

    def __init__(self, text: str) -> None:
        self.text, self.found = text, None

    def lists(self) -> tuple[frozenset, frozenset, frozenset]:
        if self.found is None:
            language = _language(self.text)
            self.found = _BY_LANGUAGE.get(language) or _BY_LANGUAGE.setdefault(language, _lists_of(language))
        return self.found


def _language(text: str) -> str | None:
    """Language by script, or by the function words that occur most often; None if no or several languages lead."""
    for name, script in _OWN_SCRIPT.items():
        if script.search(text):
            return name
    words = Counter(w.lower() for w in _WORD.findall(text))
    counts = {name: sum(words[w] for w in own) for name, own in FUNCTION_WORDS.items()}
    first, second = sorted(counts.values(), reverse=True)[:2]
    return max(counts, key=counts.get) if first > second else None


#: Lists by language, filled as they are asked for; a decorated function would not travel to workers with its code.
_BY_LANGUAGE: dict[str | None, tuple[frozenset, frozenset, frozenset]] = {}


def _lists_of(language: str | None) -> tuple[frozenset, frozenset, frozenset]:
    """The three lists for a text in a language: its own, and those of all others that are no words anywhere.

    Where no language is told, the number behind an abbreviation is sign enough.
    """
    every = [frozenset().union(*kind.values()) for kind in (ALWAYS, BEFORE_NUMBER, MAY_END)]
    always, number, may_end = (all_ - WORDS_TOO | kind.get(language, frozenset()) for all_, kind in zip(every, (ALWAYS, BEFORE_NUMBER, MAY_END), strict=True))
    return always, number if language else every[1], may_end


def _abbreviation(text: str, start: int, dot: int, after: int, suppressed: _Suppressed) -> bool:
    """Whether the full stop at `dot` belongs to an abbreviation inside a sentence that goes on at `after`."""
    token = _token_before(text, start, dot)
    if not token:
        return False
    always, before_number, may_end = suppressed.lists() if token in _LISTED else (frozenset(),) * 3
    following = _WORD.match(text, after)
    word = following.group() if following else ""
    if token in always or token == "al" and text[start:dot].lower().endswith("et al"):
        return True
    if token in before_number and word[:1].isdigit():
        return True
    if token in may_end:
        if not word or text[after] in "¿¡":
            return False
        if _cased(text[start:dot]):
            return word[0].islower() or word[0].isdigit()
        second = _NAME.search(text, following.end())
        opens = word[0].isupper() and (len(word) == 1 or not word.isupper()) and second is not None and second.group()[0].islower()
        return not opens and word.lower() not in OPENERS
    if len(token) == 1 and token.isalpha():
        before = text[start:dot].rstrip()[:-1].rstrip()
        return not before.endswith((":", "：")) and bool(word) and not (token == "i" and not word[0].isupper())
    return token.isdigit() and len(token) <= 2 and word.lower() in MONTHS


def _inner_bracket(text: str, start: int, closers: str, at: int) -> bool:
    """Whether one of the closing brackets behind a terminator was opened inside the sentence and not at its start."""
    for c in closers:
        if c in _PAIRS:
            depth, i = 1, at - 1
            while i >= start and depth:
                depth += (text[i] == c) - (text[i] == _PAIRS[c])
                i -= 1
            if depth == 0 and _HAS_ALNUM.search(text, start, i + 1):
                return True
    return False


def _speaker_follows(text: str, after: int) -> bool:
    """Whether the words at `after` name the speaker of the quotation before them."""
    end = min((p for p in (text.find(c, after, after + 80) for c in ".,!?;:\n") if p >= 0), default=min(len(text), after + 80))
    words = [w.lower() for w in _WORD.findall(text, after, end)][:8]
    if not words:
        return False
    if words[0] in SPEECH:
        return True
    return len(words) <= 5 and any(w.split("'")[-1] in SPEECH for w in words[1:]) and text[after].islower() or len(words) <= 2 and words[-1] in SPEECH


def _ends(text: str, start: int, match: regex.Match, suppressed: _Suppressed) -> bool:
    """Whether the terminator run `match` ends the sentence that began at `start`."""
    stops, marks, end = match.group("stops"), match.group("marks"), match.end()
    after = _SPACE.match(text, end).end()
    if after >= len(text):
        return True
    strong = _STRONG.search(stops) is not None
    ellipsis = not strong and ("…" in stops or ".." in stops)
    plain = not strong and not ellipsis
    follows = text[after]
    if follows in ",;:،；：，、" and after == end:
        return False
    if plain and not marks and (after == end or _abbreviation(text, start, match.start(), after, suppressed)):
        return False  # no space behind a full stop: decimals, versions, addresses
    if _inner_bracket(text, start, marks, match.start()):
        return False
    if ellipsis and (follows.islower() or len(_WORD.findall(text, start, match.start())) <= 1):
        return False
    if any(c in "\"'”“’»›」』" for c in marks):
        if (after == end or text[end - 1] in "”」』") and _CJK_SPEAKER.match(text, after):
            return False
        if strong and _speaker_follows(text, after):
            return False
        word = _WORD.match(text, after)
        if word and word.group() in JOINERS:
            return False
    return True


def _label_end(text: str, start: int) -> int | None:
    """End of a line of `label: value` parts that begins at `start`: it is one unit, stops and all."""
    first = start
    while first < len(text) and text[first] in "\"'“*_(（":
        first += 1
    if not _LABEL_ONE.match(text, first):
        return None
    found = _LABELS.match(text, first)
    if found is None:
        return None
    last = max(text.rfind(";", first, found.end()), text.rfind("|", first, found.end()))
    value = text.find(":", last, found.end()) + 1
    end = found.end()
    for stop in _END.finditer(text, value, end + 1):
        if stop.end() >= len(text) or text[stop.end()].isspace():
            return stop.end()
    word = _WORD.search(text, value, end)
    cut = _LAST_VALUE.search(text, word.end() - 1, end) if word else None
    return cut.start() if cut else end


def sentence_starts(text: str | None) -> list[int]:
    """Code-point offsets of the first non-space character of every sentence; none for NULL or blank text."""
    if not text or text.isspace():
        return []
    starts: list[int] = []
    suppressed = _Suppressed(text)
    ending = _END_LOW_QUOTES if "„" in text or "‚" in text else _END
    cuts = {m.end() for m in _BLANK_LINE.finditer(text)} | {m.end() for m in _SPACED_SCRIPT.finditer(text)}
    for m in _LINE.finditer(text):
        line = text[max(text.rfind("\n", 0, m.start()), 0) : m.start()]
        if _LABELS.search(line) or _LABELS.match(text, m.end()) or text[m.end() : m.end() + 2] in ("- ", "* ", "• "):
            cuts.add(m.end())
    position = _SPACE.match(text).end()
    begin = position
    pending = sorted(c for c in cuts if c > position)
    while position < len(text):
        end = _label_end(text, begin) if position == begin else None
        if end is not None:
            bound = next((c for c in pending if c > begin), None)
            after = _SPACE.match(text, end).end()
            if bound is not None and bound < after:
                after = bound
            starts.append(begin)
            begin = position = after
            continue
        match = ending.search(text, position)
        bound = next((c for c in pending if c > begin), None)
        if bound is not None and (match is None or bound <= match.end()):
            starts.append(begin)
            begin = position = bound
            continue
        if match is None:
            break
        if _ends(text, begin, match, suppressed):
            starts.append(begin)
            begin = position = _SPACE.match(text, match.end()).end()
        else:
            position = match.end()
    if begin < len(text):
        starts.append(begin)
    return [s for i, s in enumerate(starts) if i == 0 or _HAS_ALNUM.search(text, s, starts[i + 1] if i + 1 < len(starts) else len(text))]


def _splitter(text: str, keys: list[str], with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owners, places, offsets, pieces = [], [], [], []
            for n, value in enumerate(batch.column(text).to_pylist()):
                starts = sentence_starts(value)
                owners += [n] * len(starts)
                places += range(len(starts))
                offsets += starts
                if with_text:
                    pieces += [value[a:b].rstrip() for a, b in zip(starts, [*starts[1:], len(value)], strict=True)] if starts else []
            arrays = [pa.array(places, pa.int32()), pa.array(offsets, pa.int32())] + ([pa.array(pieces, pa.string())] if with_text else [])
            taken = batch.select(keys).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *arrays], [*keys, "sentence_no", "start_char", *(["sentence"] if with_text else [])])

    return run


def split_sentences(df: DataFrame, text: str, keys: list[str], with_text: bool = False) -> DataFrame:
    """One row per sentence of the text column: the keys, sentence_no, start_char (0-based code point), and its text if asked.

    NULL, empty and blank texts have no sentences. Texts are read whole, whatever their length; rows are independent, so
    the step needs no shuffle. Keys must not be named like the result's columns.
    """
    if {"sentence_no", "start_char", "sentence"} & set(keys):
        raise ValueError("key columns named like the result's")
    added = [T.StructField("sentence_no", T.IntegerType()), T.StructField("start_char", T.IntegerType())] + ([T.StructField("sentence", T.StringType())] if with_text else [])
    schema = T.StructType([df.schema[k] for k in keys] + added)
    return df.select(*dict.fromkeys([*keys, text])).mapInArrow(_splitter(text, keys, with_text), schema)
