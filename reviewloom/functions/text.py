"""Text expressions of the opinion pipeline. Word characters and white space are those of Unicode in every pattern."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"[\s\p{Z}]+"
#: A place where no word goes on, before and behind.
BEFORE, BEHIND = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"^{SPACE}|{SPACE}$", "")


def non_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def merged_clean(title: Column, text: Column) -> Column:
    """Title and text by one space, white space collapsed, then tags removed (so that double spaces may remain), stripped."""
    merged = F.concat_ws(" ", strip(non_empty(title)), strip(non_empty(text)))
    return strip(F.regexp_replace(F.regexp_replace(merged, SPACE, " "), "<[^>]+>", ""))


def split_plain(text: Column, longer_than: int = 5) -> Column:
    """Pieces between runs of full stops, exclamation and question marks, stripped, of more than five characters."""
    return F.filter(F.transform(F.split(text, "[.!?]+"), strip), lambda s: F.length(s) > longer_than)


def constant_list(words: list[str]) -> Column:
    """Constant array; list tests over it stay small in generated code, whatever the length of the list."""
    return F.array(*[F.lit(w) for w in words])


def hits(text: Column, words: list[str]) -> Column:
    """How many entries of an ordered list occur as substrings; an entry listed twice counts twice.

    `text` should be a plain column: it is read once per entry.
    """
    return F.size(F.filter(constant_list(words), lambda w: F.contains(text, w)))


def any_hit(text: Column, words: list[str]) -> Column:
    return F.exists(constant_list(words), lambda w: F.contains(text, w))


def first_hit(text: Column, words: list[str]) -> Column:
    """First entry of the list, in its order, that occurs as a substring."""
    return F.try_element_at(F.filter(constant_list(words), lambda w: F.contains(text, w)), F.lit(1))


def find(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence, or -1."""
    return F.position(part, text) - 1


def window(text: Column, part: Column, place: Column, margin: int) -> Column:
    """Characters around `part` at `place`, cut at the ends of the text."""
    start = F.greatest(place - margin, F.lit(0))
    end = F.least(F.length(text), place + F.length(part) + margin)
    return F.substring(text, start + 1, end - start)


def review_pk(parent: Column, user: Column, unix_ts: Column, title: Column, text: Column) -> Column:
    """md5 over the identifying fields, the text cut to 100 characters, NULLs as empty strings."""
    fields = [parent, user, unix_ts.cast("string"), title, F.substring(text, 1, 100)]
    return F.md5(F.concat_ws("|", *[F.coalesce(f, F.lit("")) for f in fields]))


#: Epoch values from here on are milliseconds; in seconds they lie beyond the year 5000.
MILLISECONDS_FROM = 100_000_000_000


def epoch_seconds(unix_ts: Column) -> Column:
    """Epoch seconds of a column that mixes seconds and milliseconds."""
    return F.when(unix_ts >= MILLISECONDS_FROM, F.floor(unix_ts / 1000).cast("long")).otherwise(unix_ts)


def between_seconds(unix_ts: Column, first: int | None, last: int | None) -> Column:
    """Whether a time in seconds or milliseconds lies in a closed range of seconds; comparisons of the bare column reach the scan."""
    seconds, millis = unix_ts < MILLISECONDS_FROM, unix_ts >= MILLISECONDS_FROM
    if first is not None:
        seconds, millis = seconds & (unix_ts >= first), millis & (unix_ts >= first * 1000)
    if last is not None:
        seconds, millis = seconds & (unix_ts <= last), millis & (unix_ts < (last + 1) * 1000)
    return seconds | millis


def slice_id(category: str | None, asin: str | None, time_range: str | None, filters: dict | None) -> str:
    """Identifier of a data slice: 12 hex digits over its parts, or `default`."""
    import hashlib

    parts = [f"category:{category}"] if category else []
    parts += [f"asin:{asin}"] if asin else []
    parts += [f"time:{time_range}"] if time_range else []
    if filters:
        parts.append("filters:" + ",".join(f"{k}={filters[k]}" for k in sorted(filters)))
    return hashlib.md5("|".join(parts).encode()).hexdigest()[:12] if parts else "default"


def slice_id_of(category: Column, asin: Column, time_range: Column) -> Column:
    """The identifier of slice_id for columns: NULL parts are left out; `default` if none is there."""
    part = lambda name, c: F.concat(F.lit(f"{name}:"), F.nullif(c, F.lit("")))
    joined = F.concat_ws("|", part("category", category), part("asin", asin), part("time", time_range))
    return F.when(joined == "", "default").otherwise(F.substring(F.md5(joined), 1, 12))


def truncated(text: Column, limit: int = 2048) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)
