"""Packing tokenised documents into windows by non-negative least squares.

Every document is cut into full windows and a rest.  The lengths of all
pieces form a histogram of at most ``window`` bins; only it goes to the
driver.  There

1. the shallow combinations are enumerated: one, two or three lengths that
   fill a window exactly;
2. non-negative least squares find how often each is repeated so that the
   repeats use up the histogram;
3. the repeats are rounded, the largest first, to what the histogram holds;
4. the pieces that stay are packed greedily, the longest that fits first, and
   a piece that fits nowhere is cut to fill the window.  Such a filling, too,
   is repeated as often as its lengths allow, so the steps follow the number
   of bins and not of documents.  What is left at the end is less than a
   window and is cut into windows of a power of two.

The plan says, for each length, which numbers go where.  In Spark the pieces
of a length are numbered in salted cells, so a length that a third of all
documents have is spread, and look their place up in the plan.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from revlens.llm.common import arrow_map, checkpointed

WINDOW = 2048
END_ID = 1
SALTS = 64
BLOCK_BYTES = 1 << 23
GROUP_UNITS = 4096             # units encoded in one call
PATTERNS = 1 << 14             # combinations taken from the least squares
ROUNDS = 150                   # of their iteration
BROADCAST_ROWS = 100_000       # cut documents that are sent to all tasks

# --- the plan -----------------------------------------------------------------


def combinations(lengths: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """All sums of one, two or three of the ``lengths`` that equal ``window``,
    ascending, padded in front with zeros: an array of three columns."""
    there = np.zeros(window + 1, dtype=bool)
    there[lengths] = True
    there[0] = True                              # no piece
    found = []
    for a in np.flatnonzero(there[:window // 3 + 1]):
        b = np.arange(a, (window - a) // 2 + 1)
        c = window - a - b
        fit = there[b] & there[c]
        found.append(np.stack([np.full(int(fit.sum()), a), b[fit], c[fit]], axis=1))
    return np.concatenate(found)


def least_squares(combos: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Repeats x >= 0 that bring the lengths used close to the histogram:
    projected gradient steps with momentum, scaled by each combination's sums
    of coefficients (so that no step overshoots)."""
    bins = len(histogram)
    weight = (combos > 0).astype(float)
    flat = combos.ravel()

    def used(x):
        out = np.bincount(flat, np.repeat(x, combos.shape[1]), minlength=bins)
        out[0] = 0
        return out

    target = histogram.astype(float)
    degree = used(weight.sum(axis=1))
    step = 1 / np.maximum((weight * degree[combos]).sum(axis=1), 1)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(rounds):
        slack = target - used(y)
        slack[0] = 0
        nxt = np.maximum(y + step * slack[combos].sum(axis=1), 0)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = nxt + (t - 1) / t_next * (nxt - x)
        x, t = nxt, t_next
    return x


@dataclass(frozen=True)
class Plan:
    """Which numbers of each length go where, in intervals sorted by ``key``
    (length and first number).  Number k of an interval that starts at s, with
    ``repeat`` r, goes to sequence ``base`` + (k - s) mod r, at ``offset`` plus
    ``taken`` times the copies before it; where less than the piece is taken,
    the rest is number ``rest_first`` + (k - s) of length ``rest``."""
    key: np.ndarray
    repeat: np.ndarray
    base: np.ndarray
    offset: np.ndarray
    taken: np.ndarray
    rest: np.ndarray
    rest_first: np.ndarray
    sequences: int
    cut: int                       # pieces that are cut


_BITS = 44                         # of a number within its length


class _Builder:
    def __init__(self, histogram: np.ndarray):
        self.free = histogram.astype(np.int64).copy()     # pieces not yet placed
        self.next = np.zeros_like(self.free)              # next number to place
        self.total = self.free.copy()                     # numbers given out
        self.rows: list[tuple[int, ...]] = []
        self.sequences = self.cut = 0

    def place(self, used: list[tuple[int, int]], repeat: int, cut: tuple[int, int] | None = None):
        """``repeat`` sequences, each of n pieces per (length, n) and maybe the
        first part of one more piece."""
        offset = 0
        for length, n in used:
            self._take(length, n * repeat, repeat, offset, length, 0, 0)
            offset += n * length
        if cut:
            length, taken = cut
            rest = length - taken
            self._take(length, repeat, repeat, offset, taken, rest, int(self.total[rest]))
            self.total[rest] += repeat
            self.free[rest] += repeat
            self.cut += repeat
        self.sequences += repeat

    def _take(self, length, count, repeat, offset, taken, rest, rest_first):
        self.rows.append(((length << _BITS) + int(self.next[length]), repeat, self.sequences, offset,
                          taken, rest, rest_first))
        self.next[length] += count
        self.free[length] -= count

    def filling(self, gap: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None, int]:
        """The longest pieces that fit the gap, each as often as it fits, then
        the first part of the longest piece left; and how often that can be
        repeated."""
        used: list[tuple[int, int]] = []
        lengths = np.flatnonzero(self.free)
        i = len(lengths)
        while gap:
            i = min(i, int(np.searchsorted(lengths, gap, side="right")))
            if not i:
                break
            i -= 1
            length = int(lengths[i])
            n = min(gap // length, int(self.free[length]))
            used.append((length, n))
            gap -= n * length
        cut = None
        taken = dict(used)
        if gap:
            longest = next(int(v) for v in lengths[::-1] if self.free[v] > taken.get(int(v), 0))
            cut = (longest, gap)
            taken[longest] = taken.get(longest, 0) + 1
        return used, cut, min(int(self.free[v]) // n for v, n in taken.items())

    def plan(self) -> Plan:
        rows = np.array(sorted(self.rows), dtype=np.int64).reshape(-1, 7)
        return Plan(*rows.T, sequences=self.sequences, cut=self.cut)


def solve(histogram: np.ndarray) -> Plan:
    """The plan for a histogram of piece lengths (index 0 is not used); the
    window is its last length.  All sequences are full but those at the end,
    whose lengths are falling powers of two."""
    window = len(histogram) - 1
    build = _Builder(histogram)
    lengths = np.flatnonzero(histogram)
    if len(lengths):
        combos = combinations(lengths, window)
        repeats = least_squares(combos, histogram)
        order = np.argsort(-repeats, kind="stable")[:PATTERNS]
        for row, wanted in zip(combos[order].tolist(), np.ceil(repeats[order] - 1e-9).tolist()):
            counts: dict[int, int] = {}
            for length in row:
                if length:
                    counts[length] = counts.get(length, 0) + 1
            repeat = min(int(wanted), *(int(build.free[v]) // n for v, n in counts.items()))
            if repeat > 0:
                build.place(list(counts.items()), repeat)
    tokens = int((build.free * np.arange(window + 1)).sum())
    while tokens >= window:
        used, cut, repeat = build.filling(window)
        build.place(used, repeat, cut)
        tokens -= window * repeat
    for bit in range(window.bit_length(), -1, -1):
        if tokens >> bit & 1:
            used, cut, _ = build.filling(1 << bit)
            build.place(used, 1, cut)
    return build.plan()


def places(plan: Plan, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where numbered pieces go: arrays (piece, start in it, length, sequence,
    offset), a row per part."""
    out = []
    piece, start = np.arange(len(length)), np.zeros(len(length), dtype=np.int64)
    while len(piece):
        at = np.searchsorted(plan.key, (length << _BITS) + number, side="right") - 1
        past = number - (plan.key[at] & ((1 << _BITS) - 1))
        copy, which = np.divmod(past, plan.repeat[at])
        taken = plan.taken[at]
        out.append((piece, start, taken, plan.base[at] + which, plan.offset[at] + copy * taken))
        more = plan.rest[at] > 0
        piece, start = piece[more], (start + taken)[more]
        length, number = plan.rest[at][more], (plan.rest_first[at] + past)[more]
    if not out:
        out = [(piece, start, length, number, number)]
    return tuple(np.concatenate(c) for c in zip(*out))


# --- tokens --------------------------------------------------------------------

_END = 0xFF                        # ends a text; no byte of UTF-8
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, _END]] = True


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a large_binary array."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, dtype=np.int64)
    held = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return ends - ends[0], held[ends[0]:ends[-1]]


def _listed(column: pa.Array) -> list[bytes]:
    offsets, data = _buffers(column)
    held, ends = data.tobytes(), offsets.tolist()
    return [held[a:b] for a, b in zip(ends, ends[1:])]


class Encoder:
    """Token ids of texts by a byte-level BPE tokenizer whose pre-tokens never
    run on from other characters into a single space or line end.

    A text is a row of units: each starts at its beginning or at a single
    space or line end between other characters, and is encoded on its own.
    Each distinct unit of a block is encoded once, many to a call, and the ids
    are put together by one Arrow take."""

    def __init__(self, tokenizer_json: str, end_id: int = END_ID):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"     # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True    # in a text they are text
        size = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(size, dtype=bool)        # ids whose text starts with space, line end
        for token, number in self.tokenizer.get_vocab().items():
            self.opens[number] = token[0] in "ĠĊ"
        self.end = np.array([end_id], "<u4").tobytes()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4")
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _alone(self, units: list[bytes]) -> list[bytes]:
        ids = iter(self._encode([u.decode() for u in units if u[-1] != _END]))
        return [self.end if u[-1] == _END else next(ids).tobytes() for u in units]

    def _known(self, distinct: pa.Array) -> pa.Array:
        """The ids of distinct units, as bytes.  Units that start with a space
        or line end and have no other are encoded many to a call; each starts
        at its only id that does so."""
        offsets, data = _buffers(distinct)
        marks = np.concatenate([[0], np.cumsum((data == 0x20) | (data == 0x0A))])
        simple = ((marks[offsets[1:]] - marks[offsets[:-1]] == 1)
                  & (marks[offsets[:-1] + 1] > marks[offsets[:-1]])
                  & (np.diff(offsets) > 1))
        together = distinct.filter(pa.array(simple))
        offsets, data = _buffers(together)
        firsts = np.arange(0, len(together), GROUP_UNITS)
        lasts = np.minimum(firsts + GROUP_UNITS, len(together))
        groups = self._encode([data[offsets[i]:offsets[j]].tobytes().decode()
                               for i, j in zip(firsts, lasts)])
        parts: list[pa.Array] = []
        for i, j, ids in zip(firsts, lasts, groups):
            begins = np.flatnonzero(self.opens[ids])
            if len(begins) == j - i and begins[0] == 0:
                ends = np.append(begins, len(ids)).astype(np.int64) * 4
                parts.append(pa.Array.from_buffers(pa.large_binary(), j - i, [
                    None, pa.py_buffer(ends), pa.py_buffer(ids)]))
            else:
                parts.append(pa.array(self._alone(_listed(together[i:j])), pa.large_binary()))
        other = _listed(distinct.filter(pa.array(~simple)))
        parts.append(pa.array(self._alone(other), pa.large_binary()))
        at = np.empty(len(distinct), dtype=np.int64)
        at[simple] = np.arange(len(together))
        at[~simple] = np.arange(len(together), len(distinct))
        return pa.concat_arrays(parts).take(pa.array(at))

    def _units(self, data: np.ndarray) -> np.ndarray:
        """Where units start in a block; each text in it ends with the end byte."""
        space = _SPACES[data]
        before = np.concatenate([[True], space[:-1]])
        after = np.concatenate([space[1:], [True]])
        starts = (data == _END) | ((data == 0x20) | (data == 0x0A)) & ~before & ~after
        starts[0] = True
        starts[1:] |= data[:-1] == _END
        return np.flatnonzero(starts)

    def _block(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block, and for each unit that is an end byte the
        number of ids up to and with it."""
        starts = self._units(data)
        offsets = np.append(starts, len(data)).astype(np.int64)
        units = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        coded = units.dictionary_encode()
        ends, flat = _buffers(self._known(coded.dictionary).take(coded.indices))
        return flat.view("<u4"), ends[1:][data[starts] == _END] // 4

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """The ids of each text, the end id last.  Texts are encoded in blocks
        cut where units start, so only the ids follow a text's length."""
        data = np.frombuffer(b"".join(t + bytes([_END]) for t in texts), dtype=np.uint8)
        held: list[np.ndarray] = []
        first = 0
        while first < len(data):
            last = len(data)
            if last - first > 2 * BLOCK_BYTES:
                at = first + BLOCK_BYTES
                while at < last:                         # to the next start of a unit
                    near = self._units(data[at:at + BLOCK_BYTES + 2])[1:-1]
                    if len(near):
                        last = at + int(near[0])
                        break
                    at += BLOCK_BYTES
            flat, ends = self._block(data[first:last])
            begin = 0
            for end in ends.tolist():
                held.append(flat[begin:end])
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held, begin = [], end
            if begin < len(flat):
                held.append(flat[begin:])
            first = last


def load(path: str | None = None) -> str:
    """The tokenizer file's text; it is read on the driver and broadcast."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


_encoders: dict[int, Encoder] = {}


def _encoder(tokenizer_json: str, end_id: int) -> Encoder:
    """A worker keeps its encoder for later tasks."""
    key = hash((tokenizer_json, end_id))
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json, end_id)
    return _encoders[key]


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column, about a block at a time; null is empty."""
    texts = column.cast(pa.large_binary())
    held, size = [], 0
    for i in range(len(texts)):
        held.append(texts[i].as_py() or b"")
        size += len(held[-1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


# --- Spark ---------------------------------------------------------------------

def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))


def cut_documents(docs: DataFrame, tokenizer_json: str, window: int = WINDOW, end_id: int = END_ID,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``digest`` (MD5 of the text), ``doc_tokens`` and ``pieces``, an
    array of (length, crc): full windows and a rest of every row's ids."""
    source = _source(docs, id_col, text_col).withColumn("digest", F.md5(F.col("text").cast("binary")))
    kind = source.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, end_id))

    def run(batches):
        encoder = _encoder(*shared.value)
        for batch in batches:
            tokens, lengths, crcs, ends = [], [], [], [0]
            for held in _texts(batch.column(1)):
                for ids in encoder.encode(held):
                    tokens.append(len(ids))
                    for first in range(0, len(ids), window):
                        part = ids[first:first + window]
                        lengths.append(len(part))
                        crcs.append(zlib.crc32(part))
                    ends.append(len(lengths))
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], ["length", "crc"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(tokens, pa.int64()), pieces],
                names=["id", "digest", "doc_tokens", "pieces"])

    return arrow_map(source, run, f"id {kind}, digest string, doc_tokens long, "
                                  "pieces array<struct<length: long, crc: long>>")


def _numbered(pieces: DataFrame, salts: int) -> DataFrame:
    """Pieces with ``number``, from 0 and without gaps within each length."""
    earlier = Window.partitionBy("length").orderBy("salt") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # at most window x salts rows: bounded by the parameters, not by the data
    cells = F.broadcast(
        pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("row", "start"))
    return (pieces.withColumn("_in", inside).join(cells, ["length", "salt"])
            .withColumn("number", F.col("_before") + F.col("_in") - 1).drop("_before", "_in", "salt"))


def _part_crcs(docs: DataFrame, parts: DataFrame, tokenizer_json: str, end_id: int, few: bool,
               id_col: str, text_col: str) -> DataFrame:
    """CRCs of the cut pieces' parts: their documents' ids are made again."""
    wanted = (parts.groupBy("id", "digest")
              .agg(F.array_sort(F.collect_set(F.struct("start", "length"))).alias("parts"))
              .withColumnsRenamed({"id": "_id", "digest": "_digest"}))
    texts = _source(docs, id_col, text_col)
    side = F.broadcast(wanted) if few else wanted          # the plan has counted them
    met = texts.join(side, F.col("id").eqNullSafe(F.col("_id")))
    found = met.withColumn("digest", F.md5(F.col("text").cast("binary"))) \
        .filter("digest = _digest").select("id", "digest", "text", "parts")
    kind = texts.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, end_id))

    def run(batches):
        encoder = _encoder(*shared.value)
        for batch in batches:
            at, out = 0, {"row": [], "start": [], "length": [], "crc": []}
            for held in _texts(batch.column(2)):
                for ids in encoder.encode(held):
                    for part in batch.column(3)[at].as_py():
                        first = part["start"]
                        out["row"].append(at)
                        out["start"].append(first)
                        out["length"].append(part["length"])
                        out["crc"].append(zlib.crc32(ids[first:first + part["length"]]))
                    at += 1
            rows = pa.array(out["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 *[pa.array(out[c], pa.int64()) for c in ("start", "length", "crc")]],
                names=["_id", "_digest", "_start", "_length", "_crc"])

    crcs = arrow_map(found, run, f"_id {kind}, _digest string, _start long, _length long, _crc long")
    return crcs.dropDuplicates(["_id", "_digest", "_start", "_length"])


def pack(docs: DataFrame, tokenizer_json: str, window: int = WINDOW, end_id: int = END_ID,
         salts: int = SALTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` packed: one row per piece with ``id``, ``start``
    (ids of its document before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id`` (from 0) and ``offset`` in the sequence.

    A document is its text's ids and ``end_id``; a null text is empty, so every
    row has at least one token.  Rows that repeat an id, or are equal, are
    packed each.  Every sequence holds ``window`` tokens, but those at the end,
    whose lengths are powers of two below it.  Other columns are ignored; an
    empty table gives an empty result."""
    if window < 1 or window & (window - 1):
        raise ValueError("the window is a power of two")
    cut = checkpointed(cut_documents(docs, tokenizer_json, window, end_id, id_col, text_col)) \
        .withColumn("row", F.monotonically_increasing_id())
    pieces = cut.select("row", "id", "digest", "doc_tokens",
                        F.posexplode("pieces").alias("_at", "_piece")).select(
        "row", "id", "digest", "doc_tokens", (F.col("_at") * F.lit(window).cast("long")).alias("start"),
        F.col("_piece.length").alias("length"), F.col("_piece.crc").alias("crc"),
        F.pmod(F.xxhash64("row", "_at"), F.lit(salts)).cast("int").alias("salt"))
    histogram = np.zeros(window + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        histogram[row["length"]] = row["n"]                # a row per length, ``window`` at most
    plan = solve(histogram)
    shared = docs.sparkSession.sparkContext.broadcast(plan)   # bounded by the window's combinations

    def run(batches):
        plan = shared.value
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length = column["length"].to_numpy()
            piece, start, taken, sequence, offset = places(plan, length, column["number"].to_numpy())
            rows = pa.array(piece)
            whole = pa.array(taken == length[piece])
            yield pa.RecordBatch.from_arrays(
                [column["id"].take(rows), column["digest"].take(rows),
                 pa.array(column["start"].to_numpy()[piece] + start), pa.array(taken),
                 pa.compute.if_else(whole, column["crc"].take(rows), pa.scalar(None, pa.int64())),
                 column["doc_tokens"].take(rows), pa.array(sequence), pa.array(offset)],
                names=["id", "digest", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                       "offset"])

    kind = cut.schema["id"].dataType.simpleString()
    placed = arrow_map(
        _numbered(pieces, salts).select("id", "digest", "doc_tokens", "start", "length", "crc", "number"),
        run, f"id {kind}, digest string, start long, length long, ids_crc32 long, doc_tokens long, "
             "sequence_id long, offset long")
    if not plan.cut:
        return placed.drop("digest")
    placed = checkpointed(placed)
    parts = placed.filter("ids_crc32 IS NULL")
    crcs = _part_crcs(docs, parts, tokenizer_json, end_id, plan.cut <= BROADCAST_ROWS, id_col, text_col)
    same = (F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
            & (F.col("start") == F.col("_start")) & (F.col("length") == F.col("_length")))
    joined = parts.drop("ids_crc32").join(crcs, same).withColumnRenamed("_crc", "ids_crc32")
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return placed.filter("ids_crc32 IS NOT NULL").select(*columns).unionByName(joined.select(*columns))


def sequences(docs: DataFrame, pieces: DataFrame, tokenizer_json: str, end_id: int = END_ID,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed ids themselves: ``sequence_id`` and ``input_ids``, an array
    of at most a window, from ``pack``'s rows.  Ids of ``docs`` must be
    distinct."""
    parts = pieces.groupBy(F.col("id").alias("_id")).agg(F.collect_list(
        F.struct("start", "length", "sequence_id", "offset")).alias("parts"))
    texts = _source(docs, id_col, text_col)
    found = texts.join(parts, F.col("id").eqNullSafe(F.col("_id"))).select("text", "parts")
    shared = docs.sparkSession.sparkContext.broadcast((tokenizer_json, end_id))

    def run(batches):
        encoder = _encoder(*shared.value)
        for batch in batches:
            at, sequence, offset, rows = 0, [], [], []
            for held in _texts(batch.column(0)):
                for ids in encoder.encode(held):
                    for part in batch.column(1)[at].as_py():
                        sequence.append(part["sequence_id"])
                        offset.append(part["offset"])
                        rows.append(ids[part["start"]:part["start"] + part["length"]].astype(np.int32))
                    at += 1
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["sequence_id", "offset", "ids"])

    cut = arrow_map(found, run, "sequence_id long, offset long, ids array<int>")
    return cut.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])).alias("input_ids"))
