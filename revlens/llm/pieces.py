"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The model file gives the pieces and their scores; it is read on the driver
and its pieces are broadcast.  Spaces become the mark U+2581 and one mark is
put in front, so a text is a row of marked words.  Pieces do not cross from a
letter to a mark, so words are encoded on their own, and each distinct word of
a batch once.

The distinct words are sorted, which is a depth-first walk of their trie: two
neighbours share the path down to their common prefix.  The forward table of
a word (for every prefix, its best last piece and score) is kept down to that
depth and only the rest is computed.  What the table holds depends on the kind
of model:

* ``unigram``: Viterbi; the best sum of piece scores of each prefix;
* ``bpe``: the last piece of each prefix's merge result.  A prefix that ends
  in piece t encodes as the shorter prefix plus t exactly when the last two
  pieces, taken alone, merge to just these two; one t fits.  Which pairs fit
  is remembered.  This gives what merging gives, also where the best sum of
  scores would not.

Characters that the model lacks, and U+2581 itself in a text, become byte
pieces, so decoding gives back the exact text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, IntegerType, StringType, StructField,
                               StructType)

from revlens.llm.common import arrow_map
from revlens.llm.words import BLOCK_BYTES

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CACHED_WORDS = 600_000  # a worker's memory of encoded words
CACHED_PAIRS = 400_000  # and of pairs of pieces
SLICE_BYTES = 16 * BLOCK_BYTES


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: list[float]
    kind: str                       # bpe or unigram
    byte_ids: list[int]
    ids: dict[str, int]             # of ordinary pieces
    pairs: dict[int, bool] = field(default_factory=dict)

    def __post_init__(self):
        letters = sorted(p for p in self.ids if len(p) == 1 and p != MARK)
        known = re.escape("".join(letters)) if letters else "\0"
        #: marked words of known letters, runs of marks, single other characters
        self.words = re.compile(f"{MARK}*[{known}]+|{MARK}+|[\\s\\S]")
        #: pieces that can end a prefix; merging must be able to make them
        self.ends = {p: i for p, i in self.ids.items()
                     if self.kind == "unigram" or merge(self, p) == [p]}
        #: the longest piece by its last three, or two, characters
        self.longest: dict[str, int] = {}
        for piece in self.ends:
            for k in (2, 3):
                if len(piece) >= k:
                    end = piece[-k:]
                    self.longest[end] = max(len(piece), self.longest.get(end, 0))
        #: for each piece, the length of its longest proper ending that is a piece
        self.shorter = [0] * len(self.pieces)
        for piece, number in self.ends.items():
            self.shorter[number] = next((len(piece) - k for k in range(1, len(piece))
                                         if piece[k:] in self.ends), 0)

    def __getstate__(self):
        return {**self.__dict__, "words": self.words.pattern, "pairs": {}}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.words = re.compile(state["words"])

    def most(self, word: str, end: int) -> int:
        """No piece that ends at ``end`` is longer than this."""
        return min(end, self.longest.get(word[end - 3:end], 2) if end > 2 else end)


def load(path: str = MODEL, kind: str = "bpe") -> Vocabulary:
    """Pieces and scores of a SentencePiece model file.  ``kind`` is how the
    model was made; the file must have byte pieces, and no piece in which a
    mark follows another character."""
    import sentencepiece

    if kind not in ("bpe", "unigram"):
        raise ValueError("kind is bpe or unigram")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    numbers = range(model.vocab_size())
    pieces = [model.id_to_piece(i) for i in numbers]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)
               for i in numbers]
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces")
    ids = {p: i for i, p in enumerate(pieces) if not special[i]}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece runs across a word's start")
    return Vocabulary(pieces, [model.get_score(i) for i in numbers], kind, byte_ids, ids)


def merge(vocabulary: Vocabulary, word: str) -> list[str]:
    """Plain merging of adjacent pieces, best score first, leftmost of equals."""
    parts = list(word)
    while True:
        best, at = None, -1
        for i in range(len(parts) - 1):
            number = vocabulary.ids.get(parts[i] + parts[i + 1])
            if number is not None and (best is None or vocabulary.scores[number] > best):
                best, at = vocabulary.scores[number], i
        if at < 0:
            return parts
        parts[at:at + 2] = [parts[at] + parts[at + 1]]


def _fits(vocabulary: Vocabulary, left: int, right: int, key: int) -> bool:
    if len(vocabulary.pairs) > CACHED_PAIRS:
        vocabulary.pairs.clear()
    a, b = vocabulary.pieces[left], vocabulary.pieces[right]
    found = vocabulary.pairs[key] = merge(vocabulary, a + b) == [a, b]
    return found


def _merged_end(vocabulary: Vocabulary, word: str, end: int, last: list[int]) -> int:
    """The last piece of what merging makes of ``word[:end]``, from the last
    pieces of the shorter prefixes."""
    get, known, size = vocabulary.ends.get, vocabulary.pairs.get, len(vocabulary.pieces)
    start = end - vocabulary.most(word, end)
    while start < end:
        number = get(word[start:end])
        if number is None:
            start += 1
            continue
        if not start:
            return number
        key = last[start] * size + number
        fits = known(key)
        if fits or fits is None and _fits(vocabulary, last[start], number, key):
            return number
        start = end - vocabulary.shorter[number]
    raise ValueError(f"no piece ends {word[:end]!r}")


def _best_end(vocabulary: Vocabulary, word: str, end: int, best: list[float]) -> tuple[int, float]:
    """The last piece of the best sum of scores of ``word[:end]``, and the sum."""
    chosen, top = -1, float("-inf")
    for start in range(end - vocabulary.most(word, end), end):
        number = vocabulary.ends.get(word[start:end])
        if number is not None and best[start] + vocabulary.scores[number] > top:
            chosen, top = number, best[start] + vocabulary.scores[number]
    return chosen, top


def encode_sorted(vocabulary: Vocabulary, words: list[str]) -> Iterator[array]:
    """Piece ids of each word; ``words`` are sorted, and of known letters."""
    sizes = [len(p) for p in vocabulary.pieces]
    unigram = vocabulary.kind == "unigram"
    last, best, before = [-1], [0.0], ""  # forward table of the last word
    for word in words:
        depth, shared = 0, min(len(before), len(word))
        while depth < shared and before[depth] == word[depth]:
            depth += 1
        del last[depth + 1:]
        if unigram:
            del best[depth + 1:]
            for end in range(depth + 1, len(word) + 1):
                number, score = _best_end(vocabulary, word, end, best)
                last.append(number)
                best.append(score)
        else:
            for end in range(depth + 1, len(word) + 1):
                last.append(_merged_end(vocabulary, word, end, last))
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= sizes[last[end]]
        out.reverse()
        yield array("i", out)
        before = word


def _other(vocabulary: Vocabulary, character: str) -> array:
    text = MARK if character == _LITERAL_MARK else character
    return array("i", [vocabulary.byte_ids[b] for b in text.encode()])


#: Stands for U+2581 in a text while marks are put in; a lone surrogate, which
#: no text of Spark's holds.
_LITERAL_MARK = "\ud800"


def _marked(text: str) -> str:
    return text.replace(MARK, _LITERAL_MARK).replace(" ", MARK)


def _encode_marked(vocabulary: Vocabulary, texts: list[str], cache: dict[str, bytes]) -> list[bytes]:
    """The ids of each text, 32 bits each.  Words are remembered; of a full
    memory the older half goes."""
    rows = [vocabulary.words.findall(text) for text in texts]
    words = {w for row in rows for w in row}
    fresh = words - cache.keys()
    if len(cache) + len(fresh) > CACHED_WORDS:
        for word in list(islice(cache, len(cache) - CACHED_WORDS // 2 if len(cache) > CACHED_WORDS // 2
                                else 0)):
            del cache[word]
        fresh = words - cache.keys()
    ordinary = sorted(w for w in fresh if w[-1] == MARK or w[-1] in vocabulary.ids)
    cache.update(zip(ordinary, (ids.tobytes() for ids in encode_sorted(vocabulary, ordinary))))
    cache.update((w, _other(vocabulary, w).tobytes()) for w in fresh if w not in cache)
    return [cache[row[0]] if len(row) == 1 else b"".join([cache[w] for w in row]) for row in rows]


def encode_texts(vocabulary: Vocabulary, texts: list[str], cache: dict[str, bytes]) -> list[array]:
    return [array("i", ids) for ids in
            _encode_marked(vocabulary, [MARK + _marked(t) if t else "" for t in texts], cache)]


_END = 0xFF                    # ends a text; no byte of UTF-8


def encode_block(vocabulary: Vocabulary, texts: list[bytes], cache: dict[str, bytes]
                 ) -> tuple[np.ndarray, np.ndarray, bytes]:
    """All ids of some texts, the bounds of each text's, and the texts behind
    one another, each with its leading space.

    No piece runs on into a space, so a text is a row of units that start
    where a space follows another character.  Each distinct unit of the block
    is encoded once; one Arrow take puts the ids together."""
    joined = b"".join((b" " + t if t else b"") + bytes([_END]) for t in texts)
    data = np.frombuffer(joined, dtype=np.uint8)
    before = np.concatenate([[_END], data[:-1]])
    starts = np.flatnonzero((data == _END) | (before == _END) | (data == 0x20) & (before != 0x20))
    offsets = np.append(starts, len(data)).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_binary(), len(starts), [
        None, pa.py_buffer(offsets), pa.py_buffer(joined)])
    coded = units.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    encoded = _encode_marked(vocabulary, ["" if u[-1] == _END else _marked(u.decode())
                                          for u in distinct], cache)
    known = pa.array(encoded, pa.large_binary())
    taken = known.take(coded.indices)
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[:len(taken) + 1] // 4
    flat = np.frombuffer(taken.buffers()[2], dtype=np.int32)[:ends[-1]] if ends[-1] else \
        np.empty(0, dtype=np.int32)
    bounds = np.concatenate([[0], ends[1:][data[starts] == _END]])
    return flat, bounds, joined


def _round_trips(table: pa.Array, flat: np.ndarray, bounds: np.ndarray, joined: bytes,
                 texts: list[bytes]) -> list[bool]:
    """Whether the ids of each text stand for its bytes."""
    taken = table.take(pa.array(flat))
    ends = np.frombuffer(taken.buffers()[1], dtype=np.int64)[:len(taken) + 1]
    held = taken.buffers()[2].to_pybytes() if len(flat) else b""
    at, out = ends[bounds].tolist(), []
    first = 0
    for text, a, b in zip(texts, at, at[1:]):
        size = len(text) + 1 if text else 0
        out.append(held[a:b] == joined[first:first + size])
        first += size + 1
    return out


def _slices(batch: pa.RecordBatch, column: str, weight) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows that weigh about SLICE_BYTES together."""
    first, size = 0, 0
    for i, w in enumerate(weight(batch.column(column)).fill_null(0).to_pylist()):
        size += w
        if size >= SLICE_BYTES:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def encode(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text",
           name: str = "token_ids", check: str | None = None) -> DataFrame:
    """``docs`` with the piece ids of the text, an array of int, and, with
    ``check``, a column of that name: whether the ids decode to the text.

    A null text has null ids, an empty one none.  Repeated rows each get
    theirs; other columns pass through (one called ``name`` is replaced).  An
    empty table gives an empty result."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, cache = shared.value, {}
        table = pa.array(piece_bytes(vocabulary).tolist(), pa.large_binary())
        for batch in batches:
            for part in _slices(batch, text_col, lambda c: pa.compute.binary_length(c)):
                column = part.column(text_col)
                texts = [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]
                flat, bounds, joined = encode_block(vocabulary, texts, cache)
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat))
                columns = [*part.columns, pa.compute.if_else(
                    column.is_null(), pa.nulls(len(ids), ids.type), ids)]
                if check:
                    columns.append(pa.array(_round_trips(table, flat, bounds, joined, texts)))
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names, *added])

    added = [name, check] if check else [name]
    kinds = [StructField(name, ArrayType(IntegerType())), StructField(check or "", BooleanType())]
    plain = docs.drop(*added)
    return arrow_map(plain, run, StructType([*plain.schema.fields, *kinds[:len(added)]]))


def piece_bytes(vocabulary: Vocabulary) -> np.ndarray:
    """What each piece stands for; nothing for control pieces."""
    table = np.empty(len(vocabulary.pieces), dtype=object)
    table[:] = b""
    for piece, number in vocabulary.ids.items():
        table[number] = piece.replace(MARK, " ").encode()
    for b, number in enumerate(vocabulary.byte_ids):
        table[number] = bytes([b])
    return table


def decode_ids(table: np.ndarray, ids: np.ndarray) -> str:
    text = b"".join(table[ids].tolist())
    return text[text[:1] == b" ":].decode(errors="replace")


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids_col: str = "token_ids",
           name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its piece ids; null ids give null, control
    pieces give nothing.  Bytes that are no UTF-8 become U+FFFD."""
    # a fixed-size table: one entry a piece
    shared = encoded.sparkSession.sparkContext.broadcast(piece_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for part in _slices(batch, ids_col, lambda c: pa.compute.list_value_length(c)):
                column, texts = part.column(ids_col), []
                for i in range(part.num_rows):
                    row = column[i].values
                    if row is None:
                        texts.append(None)
                        continue
                    texts.append(decode_ids(table, row.to_numpy()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 names=[*part.schema.names, name])

    plain = encoded.drop(name)
    return arrow_map(plain, run, StructType([
        *plain.schema.fields, StructField(name, StringType())]))


def token_counts(encoded: DataFrame, ids_col: str = "token_ids") -> DataFrame:
    return encoded.withColumn("n_tokens", F.coalesce(F.size(ids_col), F.lit(0)).cast("long"))
