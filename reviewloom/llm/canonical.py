"""Mapping freely typed values to the closest entry of a reference list.

The entries stand in a BK-tree under the Damerau-Levenshtein distance with free transpositions, which is a true metric: a
subtree whose edge differs from the query's distance by more than the threshold cannot hold a match and is not visited.
Before the search a value is brought to a canonical form (case, accents, punctuation, filler words); the words of a value
may stand in any order. Few words are tried in every order; of many words, a second BK-tree, under the distance of bags of
letters, gives every entry that any order could reach, and the orders are then built word by word as far as they fit.

A large reference list is cut into shards by the bag distance to one root entry, the first level of such a tree: a value
visits only the shards that the triangle inequality leaves, and the winners of the shards are merged.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Callable, Collection, Iterable, Iterator
from itertools import permutations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.tables import materialize

#: Result for values that are no form of any entry.
UNMATCHED = "UNMATCHED"
#: Words around a value that name nothing (fixed values); those that an entry holds are tried as words first.
FILLERS = frozenset("the a an its their this that my our your of for on in with and unit product item device thing general generally overall in total poor bad good great nice very really quite aspect issue problem regarding about".split())
#: Words up to which all orders are spelled out; it steers cost, not results.
MAX_ORDERED = 4
#: Entries up to which every worker holds the whole tree; larger lists are sharded.
BROADCAST_ENTRIES = 20_000
#: Entries of a shard, and values that meet a shard in one task.
SHARD_ENTRIES, PART_VALUES = 5_000, 20_000
#: Values of a task beside the whole tree, for as long as tasks are few; a table of any size has tasks of at most MOST_VALUES.
TASK_VALUES, MOST_VALUES = 2_000, 500_000


def _last_row(a: str, b: str) -> list[int]:
    """Damerau-Levenshtein distances of `a` to all prefixes of `b`."""
    last: dict[str, int] = {}
    size = len(b)
    far = len(a) + size
    table = [[far] * (size + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        table[i + 1][1] = i
    table[1] = [far, *range(size + 1)]
    for i, x in enumerate(a, 1):
        match, row, above = 0, table[i + 1], table[i]
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), match
            if x == y:
                cost, match = 0, j
            else:
                cost = 1
            best = above[j] + cost
            if row[j] + 1 < best:
                best = row[j] + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            if k and m:
                swap = table[k][m] + (i - k - 1) + 1 + (j - m - 1)
                if swap < best:
                    best = swap
            row[j + 1] = best
        last[x] = i
    return table[-1][1:]


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance: insertions, deletions, exchanges and transpositions, also of letters apart."""
    return 0 if a == b else _last_row(a, b)[-1]


def bag_distance(a: str, b: str) -> int:
    """Letters that one side has more of, the larger of both: a metric on bags of letters, never above the edit distance."""
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total())


def closest_order(words: Iterable[str], entry: str, most: int) -> int | None:
    """Least distance of any order of the words, written as one, to the entry; None if it is above `most`.

    Orders are built word by word; one whose distance to every prefix of the entry is too large is given up.
    """
    best, seen, open_orders = most + 1, set(), [("", tuple(sorted(words)))]
    while open_orders:
        prefix, left = open_orders.pop()
        if not left:
            best = min(best, distance(prefix, entry))
        for i, word in enumerate(left):
            following = (prefix + word, left[:i] + left[i + 1 :])
            if following not in seen and min(_last_row(following[0], entry)) < best:
                seen.add(following)
                open_orders.append(following)
    return best if best <= most else None


class BKTree:
    """Strings by their distance to the parent; search visits only edges that the triangle inequality allows."""

    def __init__(self, entries: Iterable[str], metric: Callable[[str, str], int] = distance) -> None:
        self.root: tuple[str, dict] | None = None
        self.metric = metric
        for entry in sorted(set(entries)):
            self.add(entry)

    def add(self, entry: str) -> None:
        if self.root is None:
            self.root = (entry, {})
            return
        node = self.root
        while (d := self.metric(entry, node[0])) and d in node[1]:
            node = node[1][d]
        if d:
            node[1][d] = (entry, {})

    def within(self, query: str, threshold: int) -> list[tuple[int, str]]:
        """Every entry within the threshold, with its distance."""
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            entry, edges = open_nodes.pop()
            d = self.metric(query, entry)
            if d <= threshold:
                found.append((d, entry))
            open_nodes += [node for edge, node in edges.items() if d - threshold <= edge <= d + threshold]
        return found


def fold(text: str) -> list[str]:
    """Words without case and accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text.casefold()) if not unicodedata.combining(c))
    return regex.findall(r"[\p{L}\p{N}]+", plain)


def word_lists(text: str, held_fillers: Collection[str] = ()) -> list[list[str]]:
    """What a value may mean, as lists of words: all of them, without fillers that no entry holds, without any filler."""
    tokens = fold(text)
    lists = [tokens, [t for t in tokens if t not in FILLERS or t in held_fillers], [t for t in tokens if t not in FILLERS]]
    return [x for i, x in enumerate(lists) if x and x not in lists[:i]]


def allowed(length: int) -> int:
    """Edits that a form of this length may have."""
    return 0 if length < 3 else 1 if length < 6 else 2


def entry_keys(entries: Iterable[tuple[str, str]]) -> dict[str, tuple[str, str]]:
    """Forms of the entries, each of the entry with the smallest original; whole forms come before those without fillers."""
    names: dict[str, tuple[str, str]] = {}
    for key, _, original, normalized in sorted(_keys(entries), key=lambda k: k[1:]):
        names.setdefault(key, (original, normalized))
    return names


def _keys(entries: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, str, str]]:
    """(form, 0 whole or 1 without fillers, original, normalized)."""
    for original, normalized in entries:
        tokens = fold(original)
        forms = ("".join(tokens), "".join(t for t in tokens if t not in FILLERS))
        yield from ((key, short, original, normalized) for short, key in enumerate(forms) if key)


def fillers_of(originals: Iterable[str]) -> set[str]:
    """Fillers that are words of entries."""
    return {t for o in originals for t in fold(o) if t in FILLERS}


#: (list of words of an exact hit or APPROXIMATE, edits, original, normalized); the smallest is the closest entry.
Hit = tuple[int, int, str, str]
APPROXIMATE = 9


class Matcher:
    """Closest entry among the forms of one shard; equal words get equal answers from a memory of bounded size."""

    def __init__(self, names: dict[str, tuple[str, str]], held_fillers: Collection[str] = ()) -> None:
        self.names, self.held_fillers = names, held_fillers
        self.tree = BKTree(names)
        self.by_bag: dict[str, list[str]] = {}
        for key in names:
            self.by_bag.setdefault("".join(sorted(key)), []).append(key)
        self.bags = BKTree(self.by_bag, bag_distance)
        self.longest = max(map(len, names), default=0)
        self.memory: dict[str, Hit | None] = {}

    def closest(self, value: str) -> Hit | None:
        """The closest entry; an exact form wins over a similar one, of equals the smallest original. None if there is none."""
        lists = word_lists(value, self.held_fillers)
        key = "\t".join(map(" ".join, lists))
        if key not in self.memory:
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[key] = min(self._exact(lists), default=None) or min(self._similar(lists), default=None)
        return self.memory[key]

    def _as_written(self, words: list[str]) -> bool:
        """Whether the words stay in their order: those with fillers that no entry holds."""
        return any(w in FILLERS and w not in self.held_fillers for w in words)

    def _orders(self, words: list[str]) -> Iterable[str]:
        return ["".join(words)] if self._as_written(words) else dict.fromkeys(map("".join, permutations(words)))

    def _exact(self, lists: list[list[str]]) -> Iterator[Hit]:
        for i, words in enumerate(lists):
            if len(words) <= MAX_ORDERED or self._as_written(words):
                yield from ((i, 0, *self.names[q]) for q in self._orders(words) if q in self.names)
            else:
                held = self.by_bag.get("".join(sorted("".join(words))), [])
                yield from ((i, 0, *self.names[e]) for e in held if closest_order(words, e, 0) == 0)

    def _similar(self, lists: list[list[str]]) -> Iterator[Hit]:
        for i, words in enumerate(lists):
            length = sum(map(len, words))
            most = allowed(length)
            if length > self.longest + most:
                continue
            if len(words) <= MAX_ORDERED or self._as_written(words):
                found = [(d, e) for q in self._orders(words) for d, e in self.tree.within(q, most)]
            else:
                near = [e for _, bag in self.bags.within("".join(sorted("".join(words))), most) for e in self.by_bag[bag]]
                found = [(d, e) for e in near if (d := closest_order(words, e, most)) is not None]
            yield from ((APPROXIMATE, d, *self.names[e]) for d, e in found if d <= allowed(len(e)))


def reference_entries(synonyms: DataFrame) -> DataFrame:
    """Usable entries (original, normalized), trimmed and in lower case; either side NULL or blank is unusable."""
    clean = {c: F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).alias(c) for c in ("original", "normalized")}
    return synonyms.select(*clean.values()).where("original <> '' and normalized <> ''").groupBy("original").agg(F.min("normalized").alias("normalized"))


def _with_all(names: dict[str, tuple[str, str]], held_fillers: set[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(names, held_fillers)
        for frame in frames:
            hits = [matcher.closest(v) for v in frame["value"]]
            yield frame.assign(entry=[h and h[2] for h in hits], normalized=[h[3] if h else UNMATCHED for h in hits], edits=pd.array([h and h[1] for h in hits], dtype="Int32"))

    return run


def _with_shard(held_fillers: set[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        matcher = Matcher({k: (o, n) for k, o, n in zip(shard["key"], shard["original"], shard["normalized"], strict=True)}, held_fillers)
        hits = [(v, *h) for v in frame["value"] if (h := matcher.closest(v))]
        return pd.DataFrame(hits, columns=["value", "level", "edits", "entry", "normalized"])

    return run


def _in_shards(values: DataFrame, entries: DataFrame, held_fillers: set[str]) -> DataFrame:
    """(value, level, edits, entry, normalized): the winner of every shard that a value visits.

    Shard r holds the forms at bag distance r from the root, cut by a hash into parts of bounded size. A form within t of a
    value has a distance to the root that differs from the value's by at most t, whatever the order of the value's words.
    """

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(_keys(zip(frame["original"], frame["normalized"], strict=True)), columns=["key", "short", "original", "normalized"])

    forms = entries.mapInPandas(keyed, "key string, short int, original string, normalized string").groupBy("key").agg(F.min(F.struct("short", "original", "normalized")).alias("e"))
    forms = materialize(forms.select("key", "e.original", "e.normalized"))
    root = forms.agg(F.min("key")).first()[0] or ""

    def ringed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(ring=[bag_distance(k, root) for k in frame["key"]])

    def routed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for value in frame["value"]:
                rings = set()
                for text in map("".join, word_lists(value, held_fillers)):
                    at, most = bag_distance(text, root), allowed(len(text))
                    rings.update(range(max(0, at - most), at + most + 1))
                rows += [(value, r) for r in rings]
            yield pd.DataFrame(rows, columns=["value", "ring"])

    forms = forms.mapInPandas(ringed, "key string, original string, normalized string, ring int")
    shards = materialize(forms.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / SHARD_ENTRIES).cast("int").alias("shards")))
    forms = forms.join(shards, "ring").withColumn("shard", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int"))
    sent = materialize(values.select("value").mapInPandas(routed, "value string, ring int").join(shards, "ring"))
    parts = materialize(sent.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / PART_VALUES).cast("int").alias("parts")))
    sent = sent.join(parts, "ring").withColumn("part", F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    forms = forms.join(parts, "ring").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    on = ["ring", "shard", "part"]
    left, right = sent.select(*on, "value").groupBy(*on), forms.select(*on, "key", "original", "normalized").groupBy(*on)
    return left.cogroup(right).applyInPandas(_with_shard(held_fillers), "value string, level int, edits int, entry string, normalized string")


def map_to_entries(values: DataFrame, entries: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """(value, entry, normalized, edits) of each value: the closest entry, or UNMATCHED with NULL entry and edits.

    values: distinct strings in the column `value`, which should be a written table, as it is counted first; entries:
    original, normalized. NULL values must be left out before; values without letters and digits match nothing, as does
    everything if there are no entries. Ties go to the smallest original.
    """
    if entries.count() <= broadcast_entries:
        held = [(r["original"], r["normalized"]) for r in entries.collect()]
        n, cores = values.count(), values.sparkSession.sparkContext.defaultParallelism
        # the work is per value and not per byte, so tasks are cut by values
        tasks = max(1, min(-(-n // TASK_VALUES), max(4 * cores, -(-n // MOST_VALUES))))
        run = _with_all(entry_keys(held), fillers_of(o for o, _ in held))
        return values.select("value").repartition(tasks).mapInPandas(run, "value string, entry string, normalized string, edits int")
    words = entries.select(F.explode(F.regexp_extract_all(F.lower("original"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("word"))
    held_fillers = {r["word"] for r in words.where(F.col("word").isin(sorted(FILLERS))).distinct().collect()}  # at most all fillers
    best = _in_shards(values, entries, held_fillers).groupBy("value").agg(F.min(F.struct("level", "edits", "entry", "normalized")).alias("best"))
    joined = values.select("value").join(best, "value", "left")
    return joined.select("value", "best.entry", F.coalesce("best.normalized", F.lit(UNMATCHED)).alias("normalized"), "best.edits")
