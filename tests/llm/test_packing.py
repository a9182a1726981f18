"""Packing: ids against the tokenizers library, windows against their rules."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return packing.load()


@pytest.fixture(scope="module")
def library(tokenizer):
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(tokenizer)
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def check_windows(rows, window):
    """Every sequence is gapless and full, or as long as a power of two."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    short = []
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= window
        if at != window:
            assert at & (at - 1) == 0
            short.append(at)
    assert len(short) == len(set(short))
    assert sorted(by) == list(range(len(by)))


def check_pieces(rows, docs, library):
    """Each row's ids lie in exactly one piece, with their CRC."""
    left = defaultdict(list)
    for i, text in docs:
        ids = library(text)
        left[(i, len(ids))].append(ids)
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.id, r.doc_tokens)].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(left)
    for key, found in pieces.items():
        covered = defaultdict(int)
        for start, length, crc in found:
            assert crc in {zlib.crc32(np.array(ids[start:start + length], "<u4")) for ids in left[key]}
            for k in range(start, start + length):
                covered[k] += 1
        assert covered == {k: len(left[key]) for k in range(key[1])}


def test_encoder_equals_the_library(tokenizer, library, monkeypatch):
    rnd = random.Random(3)
    parts = ["a", "Zq", "é", "  ", " ", "\n", "\n\n", "\t", "'s", " 'll", "12", "!?", " ", "　",
             "日本", "\U0001f600", "<|endoftext|>", "\r\n", "\x1c", "​", "_", " the", "\nThe"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 30))) for _ in range(3000)]
    encoder = packing.Encoder(tokenizer)
    want = [library(t) for t in texts]
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want
    monkeypatch.setattr(packing, "BLOCK_BYTES", 64)
    monkeypatch.setattr(packing, "GROUP_UNITS", 3)
    assert [x.tolist() for x in encoder.encode([t.encode() for t in texts])] == want


def test_whole_table(spark, sf_dir, tokenizer, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, tokenizer).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in docs.collect()], library)
    check_windows(rows, packing.WINDOW)


@pytest.mark.parametrize("window,broadcast", [(16, 100_000), (64, 0), (1, 100_000)])
def test_small_windows_cut_pieces(spark, tokenizer, library, monkeypatch, window, broadcast):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", broadcast)
    docs = [(i, f"word{i} and more " * (i % 9)) for i in range(80)] + [(None, "no id"), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = packing.pack(df, tokenizer, window=window).collect()
    check_pieces(rows, docs, library)
    check_windows(rows, window)


def test_edges(spark, small, none, tokenizer, library):
    docs = small.withColumns({"length": F.lit(1), "row": F.lit(2), "digest": F.lit("d"),
                              "_id": F.lit(0), "crc": F.lit(3)})
    rows = packing.pack(docs, tokenizer).collect()
    check_pieces(rows, [(r.doc_id, r.text) for r in small.collect()], library)
    check_windows(rows, packing.WINDOW)
    assert packing.pack(none, tokenizer).collect() == []


def test_one_length_holds_everything(spark, tokenizer):
    """2000 equal documents: nothing but cuts fills the windows."""
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same words here " * 9).alias("text"))
    rows = packing.pack(df, tokenizer, window=64).collect()
    check_windows(rows, 64)
    assert len({r.id for r in rows}) == 2000


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_token_once(seed):
    rnd = np.random.default_rng(seed)
    window = (32, 64, 256, 2048)[seed]
    histogram = np.zeros(window + 1, dtype=np.int64)
    histogram[1:] = rnd.integers(0, (3, 50, 1000, 2_000)[seed], window)
    histogram[rnd.integers(1, window, window // 2)] = 0
    plan = packing.solve(histogram)
    used = np.arange(window + 1) * histogram
    assert plan.sequences - -(-used.sum() // window) <= window.bit_length()
    length = np.repeat(np.arange(window + 1), histogram)
    number = np.concatenate([np.arange(h) for h in histogram])
    piece, start, taken, sequence, offset = packing.places(plan, length, number)
    assert taken.sum() == used.sum() and (np.bincount(piece, taken) == length).all()
    spots = np.unique(sequence * window + offset, return_counts=True)[1]
    assert (spots == 1).all()
    totals = np.bincount(sequence, taken)
    assert (totals[totals != window] == 2.0 ** np.log2(totals[totals != window]).astype(int)).all()


def test_a_bin_of_billions_needs_few_steps():
    histogram = np.zeros(2049, dtype=np.int64)
    histogram[700] = 3 * 10 ** 9
    histogram[[5, 2048, 1348]] = 10 ** 9
    plan = packing.solve(histogram)
    assert len(plan.key) < 500


def test_sequences_hold_the_ids(spark, tokenizer, library):
    docs = [(i, f"text {i} " * (i % 30)) for i in range(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    pieces = packing.pack(df, tokenizer, window=32)
    rows = packing.sequences(df, pieces, tokenizer).collect()
    assert sorted(x for r in rows for x in r.input_ids) == sorted(x for _, t in docs for x in library(t))
    assert all(len(r.input_ids) <= 32 for r in rows)
