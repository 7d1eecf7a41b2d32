"""Filling containers of fixed capacity with items, by harmonic packing.

Lengths fall into classes by how many items of their size one container holds: an item of class k takes between 1 / (k + 1)
and 1 / k of the capacity, and k items of class k always fit together. Each class fills its own containers with k items,
without looking at any other. Items of the last class, which are small, then fill what is left in all containers before
they open new ones. Items are spread over shards of bounded size by a hash, and every shard is packed on its own, so that
neither a worker nor the driver sees more than one shard.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.sources.tables import materialize

#: Capacity of a container in tokens.
CAPACITY = 2048
#: Classes; items below capacity / CLASSES are small.
CLASSES = 12
#: Items of a shard, on average. A shard leaves at most one unfilled container per class.
SHARD_ITEMS = 50_000
_ENCODERS: dict[str, object] = {}


def default_vocabulary() -> tuple[str, str]:
    """Vocabulary file and split pattern of the public byte-level tokenizer that is installed beside the library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoder(vocabulary: str, pattern: str) -> object:
    """Byte-pair encoder of a vocabulary file of ranks; kept per worker."""
    if vocabulary not in _ENCODERS:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _ENCODERS[vocabulary] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[vocabulary]


#: Characters from which a text is handed to the encoder part by part; it steers memory, not results.
CHUNK = 100_000


def _parts(text: str, pattern: str) -> Iterator[str]:
    """A long text in parts that begin and end where the split pattern cuts, so that no token crosses a border.

    A stretch that the pattern does not cut, such as letters without end, is one part, whatever its length.
    """
    start = 0
    for piece in regex.finditer(pattern, text):
        # behind white space the pattern looks ahead, so a part ends behind other characters only
        if piece.end() - start >= CHUNK and not text[piece.end() - 1].isspace():
            yield text[start : piece.end()]
            start = piece.end()
    if start < len(text):
        yield text[start:]


def count_tokens(text: str, encode: Callable[[str], list[int]], pattern: str) -> int:
    """Tokens of a whole text, the same as in one call of the encoder."""
    return len(encode(text)) if len(text) <= CHUNK else sum(len(encode(part)) for part in _parts(text, pattern))


def _counter(item_id: str, text: str, vocabulary: str, pattern: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            sizes = [None if t is None else count_tokens(t, encode, pattern) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(item_id), pa.array(sizes, pa.int64())], ["item_id", "n_tokens"])

    return run


def token_counts(df: DataFrame, item_id: str, text: str, vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """(item_id, n_tokens) of every row; NULL text has NULL tokens, empty text none."""
    own_vocabulary, own_pattern = (vocabulary, pattern) if vocabulary and pattern else default_vocabulary()
    kind = df.schema[item_id].dataType.simpleString()
    return df.select(item_id, text).mapInArrow(_counter(item_id, text, own_vocabulary, own_pattern), f"item_id {kind}, n_tokens bigint")


def packing_faults(counts: DataFrame, packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: items with tokens, and how many of them are missing, repeated, split though they fit, or of a changed size,
    and how many containers hold more than the capacity.

    counts: item_id, n_tokens; packed: the result of pack_items. All faults of a right packing are 0.
    """
    per_item = packed.groupBy("item_id").agg(F.sum("n_tokens").alias("packed"), F.count(F.lit(1)).alias("pieces"), F.count_distinct("piece").alias("places"))
    joined = counts.where("n_tokens > 0").join(per_item, "item_id", "left")
    items = joined.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.count_if(F.col("packed").isNull()).alias("n_missing"),
        F.count_if(F.col("pieces") > F.col("places")).alias("n_repeated"),
        F.count_if((F.col("n_tokens") <= capacity) & (F.col("pieces") > 1)).alias("n_split"),
        F.count_if(F.col("packed") != F.col("n_tokens")).alias("n_changed"),
    )
    over = packed.groupBy("container").agg(F.sum("n_tokens").alias("n")).agg(F.count_if(F.col("n") > capacity).alias("n_overfull"))
    return items.withColumn("one", F.lit(1)).join(over.withColumn("one", F.lit(1)), "one").drop("one")


def harmonic(sizes: np.ndarray, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """Container number of each item; every size must lie between 1 and the capacity."""
    bins = np.full(len(sizes), -1, dtype=np.int64)
    held = np.minimum(capacity // sizes, classes)
    opened, room = 0, []
    for k in range(1, classes):
        members = np.flatnonzero(held == k)
        members = members[np.argsort(-sizes[members], kind="stable")]  # like sizes together: what is left is of like size too
        number = np.arange(len(members)) // k
        bins[members] = opened + number
        if len(members):
            filled = np.bincount(number, weights=sizes[members]).astype(np.int64)
            room.append(capacity - filled)
            opened += len(filled)
    left = np.concatenate(room) if room else np.empty(0, dtype=np.int64)
    small = np.flatnonzero(held == classes)
    small = small[np.argsort(-sizes[small], kind="stable")]
    order = np.argsort(-left, kind="stable")
    at, current, space = 0, -1, 0
    for item in small:
        size = sizes[item]
        while size > space:
            if at < len(order):
                current, space = order[at], left[order[at]]
                at += 1
                if space < size:  # the rest has less room still
                    at = len(order)
                    space = 0
            else:
                current, space, opened = opened, capacity, opened + 1
        bins[item] = current
        space -= size
    return bins


def _pack_shard(capacity: int, classes: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["item_id", "piece"], kind="stable")
        bins = harmonic(frame["n_tokens"].to_numpy(np.int64), capacity, classes)
        frame["container"] = frame["shard"].astype(str) + "-" + pd.Series(bins, index=frame.index).astype(str)
        return frame[["item_id", "piece", "n_tokens", "container"]]

    return run


def pack_items(counts: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item_id, piece, n_tokens, container): where each item, or piece of an item above the capacity, goes.

    counts: item_id (unique) and n_tokens. An item above the capacity is cut into full pieces and a rest; a full piece has
    a container of its own. Items without tokens (NULL or none) need no container and are left out; an empty table gives
    an empty result. Equal sizes are packed in the order of their ids.
    """
    kind = counts.schema["item_id"].dataType.simpleString()
    counts = materialize(counts.where("n_tokens > 0"))
    full = counts.where(F.col("n_tokens") >= capacity).select("item_id", F.explode(F.sequence(F.lit(0), F.expr(f"cast(n_tokens div {capacity} as int)") - 1)).alias("piece"))
    full = full.select("item_id", "piece", F.lit(capacity).cast("long").alias("n_tokens"), F.concat_ws("-", F.lit("f"), "item_id", "piece").alias("container"))
    rest = counts.select("item_id", F.expr(f"cast(n_tokens div {capacity} as int)").alias("piece"), (F.col("n_tokens") % capacity).alias("n_tokens")).where("n_tokens > 0")
    shards = max(1, -(-counts.count() // shard_items))
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("item_id", "piece"), F.lit(shards)).cast("int"))
    packed = rest.groupBy("shard").applyInPandas(_pack_shard(capacity, classes), f"item_id {kind}, piece int, n_tokens bigint, container string")
    return full.unionByName(packed)
