"""Importance resampling towards a target distribution.

Features are runs of one to three words, hashed into buckets by their CRC-32.
A bucket's gain is the logarithm of its share in the target texts over its
share in the corpus; a document's weight is the sum of its features' gains,
and the documents with the highest weight plus Gumbel noise are drawn, which
is drawing without replacement in proportion to the weights.

All CRCs of a slice of texts are computed together: the distinct features are
grouped by the length of their bytes into two-dimensional uint8 arrays, one
row a feature, and the CRCs of all rows are updated column by column; the
buckets are then scattered back to the features' places.

A text is cut where no word runs on when it is longer than a slice, and the
last two words go along, so memory does not follow the length of a text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_map, checkpointed
from revlens.operators.ordered import with_row_number

BUCKETS = 10_000
RUN = 3                        # words of the longest feature
SLICE_BYTES = 1 << 20
MATRIX_ROWS = 1 << 15
#: Longer features are rare and of many lengths; each is hashed on its own.
LONG_FEATURE = 1 << 10

_SPACE = 0x20
#: The lower-cased byte of a word's bytes (digits, letters, all above ASCII),
#: else a space.
_LETTER = np.full(256, _SPACE, dtype=np.uint8)
_LETTER[0x80:] = np.arange(0x80, 0x100)
_LETTER[0x30:0x3A] = np.arange(0x30, 0x3A)
_LETTER[0x61:0x7B] = _LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320),
                         table >> np.uint32(1))
    return table


_TABLE = _crc_table()


def crc32_matrix(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional uint8 array, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, dtype=np.uint32)
    for column in rows.T:
        crc = _TABLE[crc.astype(np.uint8) ^ column] ^ (crc >> np.uint32(8))
    return ~crc


def crc32_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges of ``data``, by matrices of equal length."""
    out = np.empty(len(starts), dtype=np.uint32)
    order = np.argsort(lengths, kind="stable")
    sizes, firsts = np.unique(lengths[order], return_index=True)
    for size, first, last in zip(sizes, firsts, [*firsts[1:], len(order)]):
        if size > LONG_FEATURE:
            for i in order[first:last]:
                out[i] = zlib.crc32(data[starts[i]:starts[i] + size])
            continue
        windows = np.lib.stride_tricks.sliding_window_view(data, size)
        for at in range(first, last, MATRIX_ROWS):
            part = order[at:min(at + MATRIX_ROWS, last)]
            out[part] = crc32_matrix(windows[starts[part]])
    return out


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each key, and where each number occurs first."""
    codes, distinct = pd.factorize(keys)
    first = np.empty(len(distinct), dtype=np.int64)
    first[codes[::-1]] = np.arange(len(keys) - 1, -1, -1)
    return codes, first


@dataclass(frozen=True)
class Features:
    """Buckets of the features of some texts: ``ends[k]`` are the words at
    which runs of k + 1 words end, ``buckets[k]`` the buckets of these runs;
    text i has the words from ``bounds[i]`` to ``bounds[i + 1]``."""
    bounds: np.ndarray
    ends: list[np.ndarray]
    buckets: list[np.ndarray]

    def sums(self, k: int, values: np.ndarray) -> np.ndarray:
        """Per text the sum of the values of its runs of k + 1 words."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        at = np.searchsorted(self.ends[k], self.bounds)
        return total[at[1:]] - total[at[:-1]]


def features(texts: list[bytes], carried: list[int], buckets: int = BUCKETS) -> Features:
    """The features of each text that end after its first ``carried`` words."""
    raw = _LETTER[np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)]
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    inside = raw != _SPACE
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    bounds = np.searchsorted(np.flatnonzero(opens), begins)
    keep = inside.copy()
    keep[1:] |= inside[:-1]                     # each word, and one space after it
    data = raw[keep]
    n = int(bounds[-1])
    at = np.flatnonzero(opens[keep])
    offsets = np.append(at, len(data)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets),
                                                         pa.py_buffer(data)])
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Features(bounds, [none] * RUN, [none] * RUN)
    ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    counts = np.diff(bounds)
    ordinal = np.arange(n) - np.repeat(bounds[:-1], counts)
    fresh = ordinal >= np.repeat(np.asarray(carried, dtype=np.int64), counts)

    # runs are numbered by the number of the run without its last word
    ends, codes, firsts, starts, lengths = [], [], [], [], []
    number, size = ids, int(ids.max()) + 1
    for k in range(RUN):
        where = np.flatnonzero(ordinal >= k)
        keys = ids[where] if k == 0 else number[where - 1] * size + ids[where]
        code, first = _coded(keys)
        number = np.full(n, -1, dtype=np.int64)
        number[where] = code
        new = fresh[where]
        ends.append(where[new])
        codes.append(code[new])
        firsts.append(first)
        starts.append(offsets[where[first] - k])
        lengths.append(offsets[where[first] + 1] - 1 - starts[-1])
    crcs = crc32_spans(data, np.concatenate(starts), np.concatenate(lengths)) % np.uint32(buckets)
    parts = np.split(crcs.astype(np.int64), np.cumsum([len(f) for f in firsts])[:-1])
    return Features(bounds, ends, [part[code] for part, code in zip(parts, codes)])


def _pieces(text: bytes) -> Iterator[tuple[bytes, int]]:
    """The text in pieces of about a slice, and how many words of each belong
    to the piece before."""
    tail: list[bytes] = []
    first = 0
    while True:
        gap = _GAP.search(text, first + SLICE_BYTES) if len(text) - first > SLICE_BYTES else None
        last = gap.start() if gap else len(text)
        yield b" ".join([*tail, text[first:last]]), len(tail)
        if not gap:
            return
        tail = [*tail, *_WORD.findall(text, first, last)][1 - RUN:]
        first = last


def _slices(column: pa.Array) -> Iterator[tuple[list[int], list[bytes], list[int]]]:
    """(rows, pieces of their texts, carried words) of about a slice each."""
    texts = column.cast(pa.large_binary())
    rows: list[int] = []
    held: list[bytes] = []
    carried: list[int] = []
    size = 0
    for i in range(len(texts)):
        for piece, words in _pieces(texts[i].as_py() or b""):
            rows.append(i)
            held.append(piece)
            carried.append(words)
            size += len(piece)
            if size >= SLICE_BYTES:
                yield rows, held, carried
                rows, held, carried, size = [], [], [], 0
    if held:
        yield rows, held, carried


def bucket_counts(texts: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``n``: how many features of all texts fall into each bucket
    (buckets without features are left out).  A task counts all its texts
    before anything is shuffled.  A null text has no features; an empty table
    gives an empty result."""
    def run(batches):
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, held, carried in _slices(batch.column(0)):
                for found in features(held, carried, buckets).buckets:
                    counts += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()),
                                          pa.array(counts[used], pa.int64())],
                                         names=["bucket", "n"])

    counted = arrow_map(texts.select(text_col), run, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket from the counts of the corpus and the target:
    floor(1000 * ln of the ratio of its smoothed shares).  One number a
    bucket comes to the driver."""
    def counts(df):
        out = np.zeros(buckets, dtype=np.int64)
        for row in df.collect():
            out[row["bucket"]] = row["n"]
        return out

    s, t = counts(corpus), counts(target)
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log(float(b + 1) * all_s / (float(a + 1) * all_t)))
                     for a, b in zip(s.tolist(), t.tolist())], dtype=np.int64)


def weighed(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and ``weight`` (the sum of the
    gains of all features, repeats counted; 0 without) of every row.  Rows
    that repeat an id each get theirs; other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)      # one number a bucket

    def run(batches):
        gains = shared.value
        for batch in batches:
            n = batch.num_rows
            words, count, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for rows, held, carried in _slices(batch.column(1)):
                found = features(held, carried, len(gains))
                for k in range(RUN):
                    ones = found.sums(k, np.ones(len(found.ends[k]), dtype=np.int64))
                    np.add.at(count, rows, ones)
                    np.add.at(weight, rows, found.sums(k, gains[found.buckets[k]]))
                    if k == 0:
                        np.add.at(words, rows, ones)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c) for c in (words, count, weight)]],
                names=["id", "n_words", "n_features", "weight"])

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return arrow_map(source, run,
                     f"id {kind}, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = 42) -> Column:
    """floor(1000 * a Gumbel number) drawn from the key's SHA-256; a null key
    draws as the text ``null``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(float(2 ** 32)))))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20,
             seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id",
             text_col: str = "text", target_col: str = "text") -> DataFrame:
    """``id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every
    row of ``docs``: of the N rows with ``least_words`` words, the
    floor(percent * N / 100) with the highest scores have the ranks 1, 2, ...;
    the others have none.  Ties go to the smaller id, null ids last.

    A null text has no words.  Rows that repeat an id draw the same noise and
    are ranked each by its own weight.  An empty table gives an empty result,
    an empty target the gains of equal shares."""
    gains = bucket_gains(bucket_counts(docs, text_col, buckets),
                         bucket_counts(target, target_col, buckets), buckets)
    scored = checkpointed(
        weighed(docs, gains, id_col, text_col)
        .withColumn("score", F.col("weight") + gumbel(F.col("id"), seed))
        .withColumn("_tie", F.monotonically_increasing_id()))
    able = F.col("n_words") >= least_words
    ranked = with_row_number(scored.filter(able), [
        F.col("score").desc(), F.col("id").asc_nulls_last(), "_tie"], "rank", keep_total="_n")
    drawn = F.col("rank") <= F.floor(F.col("_n") * percent / 100)
    columns = ["id", "n_features", "weight", "score"]
    return ranked.select(*columns, F.when(drawn, F.col("rank")).alias("rank")).unionByName(
        scored.filter(~able).select(*columns, F.lit(None).cast("long").alias("rank")))
