"""Importance resampling against plain Python; the SQL covers the whole query."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from revlens.llm import importance


def _lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def _features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(text))
    runs = [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(r.encode()) % 10_000 for r in runs]


def _brute(docs, target):
    found = [(i, *_features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in _features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
            for b in range(10_000)]
    rows = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, len(f), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): k + 1 for k, r in enumerate(able[:5 * len(able) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


def _rows(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()),
                  key=str)


@pytest.mark.parametrize("slice_bytes", [1 << 20, 40])
def test_equals_plain_python(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    texts = [" ".join(f"{'Word' if i % 2 else 'ärgER'}{(i * j) % 17}" for j in range(i % 45))
             for i in range(120)]
    docs = [*enumerate(texts), (500, None), (501, ""), (502, " \n-- "), (503, "x" * 5000 + " y"),
            (504, "日本語 Ä_b c1-d2\0e"), (None, " ".join(texts[:30]))]
    target = ["word1 word2 word3", None, "", "ärger3 ärger5"]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert _rows(importance.resample(df, goal)) == _brute(docs, target)


def test_long_texts_are_cut_without_loss(monkeypatch):
    text = (" ".join(f"w{i % 91}é" for i in range(4000)) + " ..! " * 50 + "end").encode()
    whole = importance.features([text], [0])
    monkeypatch.setattr(importance, "SLICE_BYTES", 333)
    pieces = list(importance._pieces(text))
    parts = [importance.features([p], [c]) for p, c in pieces]
    assert len(pieces) > 10
    for k in range(3):
        assert np.concatenate([p.buckets[k] for p in parts]).tolist() == whole.buckets[k].tolist()


def test_matrices_equal_zlib():
    data = np.frombuffer(bytes(range(256)) * 40, dtype=np.uint8)
    starts = np.array([0, 5, 9, 100, 2000, 1, 7])
    lengths = np.array([1, 3, 3, 40, 1500, 1, 1024])
    got = importance.crc32_spans(data, starts, lengths)
    assert got.tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(starts, lengths)]


def test_repeats_clashing_columns_and_ties(spark, small):
    docs = small.withColumns({"weight": F.lit(1), "score": F.lit(2), "rank": F.lit(3), "_tie": F.lit(4)})
    rows = _rows(importance.resample(docs, spark.createDataFrame([("w1 w2",)], "text string")))
    plain = [(r.doc_id, r.text) for r in small.collect()]
    assert rows == _brute(plain, ["w1 w2"])
    many = spark.range(400).select((F.col("id") % 2).alias("doc_id"),
                                   F.lit(" ".join(f"a{i}" for i in range(20))).alias("text"))
    ranks = [r.rank for r in importance.resample(many, many).collect() if r.rank]
    assert sorted(ranks) == list(range(1, 21))


def test_empty(spark, none):
    assert importance.resample(none, none).collect() == []
    docs = spark.createDataFrame([(1, " ".join("abc" for _ in range(20)))], "doc_id long, text string")
    assert _rows(importance.resample(docs, none)) == _brute([(1, "abc " * 20)], [])
