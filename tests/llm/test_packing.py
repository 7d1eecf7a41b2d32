import random

import numpy as np
import pytest

import reviewloom.llm.packing as module
from reviewloom.llm.packing import count_tokens, default_vocabulary, encoder, harmonic, pack_items, packing_faults, token_counts

pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("seed", range(5))
def test_harmonic_fits_and_fills(seed):
    sizes = np.random.default_rng(seed).integers(1, 2049, 3000)
    bins = harmonic(sizes, 2048)
    filled = np.bincount(bins, weights=sizes)
    assert (bins >= 0).all() and filled.max() <= 2048 and (filled > 0).all()
    assert len(filled) <= 1.6 * sizes.sum() / 2048 + 12


def test_small_items_waste_little():
    sizes = np.random.default_rng(9).integers(20, 160, 5000)
    assert sizes.sum() / 2048 / (harmonic(sizes, 2048).max() + 1) > 0.97


def test_extreme_sizes():
    assert harmonic(np.array([], dtype=np.int64), 10).tolist() == []
    assert sorted(harmonic(np.array([10, 10]), 10)) == [0, 1]
    assert set(harmonic(np.array([1] * 10), 10)) == {0}


def test_pieces_and_left_out_items(spark):
    counts = spark.createDataFrame([(1, 25), (2, 10), (3, 3), (4, 0), (5, None), (6, 30), (7, 2)], "item_id long, n_tokens long")
    rows = pack_items(counts, 10, 4).collect()
    got = {}
    for r in rows:
        got.setdefault(r["item_id"], []).append((r["piece"], r["n_tokens"]))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(0, 10), (1, 10), (2, 5)], 2: [(0, 10)], 3: [(0, 3)], 6: [(0, 10), (1, 10), (2, 10)], 7: [(0, 2)]}
    filled = {}
    for r in rows:
        filled[r["container"]] = filled.get(r["container"], 0) + r["n_tokens"]
    assert max(filled.values()) <= 10 and sum(filled.values()) == 70
    assert pack_items(counts.limit(0)).count() == 0


def test_tokens_of_long_texts_and_special_strings(spark):
    encode = encoder(*default_vocabulary()).encode_ordinary
    text = "A sentence with words, 12.5 numbers and ünïcode. " * 5000
    assert count_tokens(text, encode, default_vocabulary()[1]) == len(encode(text))
    df = spark.createDataFrame([(1, "<|endoftext|>"), (2, ""), (3, None)], "id long, text string")
    assert {r["item_id"]: r["n_tokens"] for r in token_counts(df, "id", "text").collect()} == {1: len(encode("<|endoftext|>")), 2: 0, 3: None}


def test_counts_do_not_depend_on_where_a_long_text_is_cut(monkeypatch):
    vocabulary, pattern = default_vocabulary()
    encode = encoder(vocabulary, pattern).encode_ordinary
    rng = random.Random(4)
    pieces = ["word", "  ", "\n\n", " ", "\t ", "it's", "12.5", "客服说", "!?", "ünï", "x" * 300, "  \n ", "'ll", "\u3000", "👍🏽"]
    texts = ["".join(rng.choices(pieces, k=400)) for _ in range(40)] + ["a" * 5000, " " * 3000, "ab" * 2000 + " ", "\n" * 999 + "x", "色" * 4000]
    for chunk in (1, 7, 50, 1000):
        monkeypatch.setattr(module, "CHUNK", chunk)
        for text in texts:
            assert count_tokens(text, encode, pattern) == len(encode(text))


def test_faults_are_seen(spark):
    counts = spark.createDataFrame([(1, 25), (2, 10), (3, 3), (4, 4), (5, 0)], "item_id long, n_tokens long")
    good = pack_items(counts, 10, 4)
    assert tuple(packing_faults(counts, good, 10).collect()[0]) == (4, 0, 0, 0, 0, 0)
    bad = spark.createDataFrame([(1, 0, 10, "a"), (1, 0, 10, "b"), (1, 2, 5, "c"), (3, 0, 1, "c"), (3, 1, 2, "c"), (4, 0, 5, "c")], "item_id long, piece int, n_tokens long, container string")
    assert tuple(packing_faults(counts, bad, 10).collect()[0]) == (4, 1, 1, 1, 1, 1)
