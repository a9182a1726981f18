"""Words and shingles of whole texts as 64-bit hashes, for Arrow batches.

A word is a run of bytes other than ASCII white space (0x20, 0x09 to 0x0D)
of the UTF-8 text, A-Z lowered.  Its hash is a polynomial in its bytes: one
running sum over a block of bytes gives the hashes of all words in the block.
Work runs in blocks of bounded size, whatever the length of a text or word
list; only a single word longer than a block makes a larger one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2 ** 64))

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.arange(1, 257, dtype=np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    if "up" not in _tables or len(_tables["up"]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _tables[name] = np.cumprod(table)
    return _tables["up"], _tables["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every bit of the result depends on all of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges from starts to ends; both ascend."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK_BYTES, side="right")))
        block = _LETTER[data[at:ends[j - 1]]]
        up, down = _powers(len(block) + 1)
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(block * up[:len(block)], out=sums[1:])
        s = starts[i:j] - at
        out[i:j] = (sums[ends[i:j] - at] - sums[s]) * down[s]
        i = j
    return mix(out)


@dataclass(frozen=True)
class Words:
    """Words of some texts: text i has the words from ``bounds[i]`` to
    ``bounds[i + 1]``; ``begins[i]`` is its first byte in ``data``."""
    data: np.ndarray
    begins: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray


def split_words(texts: list[bytes]) -> Words:
    data = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    begins = np.cumsum([0, *[len(t) + 1 for t in texts]])
    space = np.concatenate([[True], _IS_SPACE[data], [True]])
    starts = np.flatnonzero(~space[1:-1] & space[:-2])
    ends = np.flatnonzero(~space[1:-1] & space[2:]) + 1
    return Words(data, begins, starts, ends, hash_spans(data, starts, ends),
                 np.searchsorted(starts, begins))


def hashed_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of the texts."""
    words = split_words(texts)
    return words.hashes, words.bounds


def word_hash(word: str) -> int:
    return int(hashed_words([word.encode()])[0][0])


def document_chunks(batch: pa.RecordBatch, column: str,
                    limit: int = 4 * BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The batch's texts in runs of about ``limit`` bytes: (first row, texts).
    Null is empty."""
    texts = batch.column(column).cast(pa.large_binary())
    first, held, size = 0, [], 0
    for i in range(len(texts)):
        text = texts[i].as_py() or b""
        held.append(text)
        size += len(text)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; of fewer words, one of them
    all; of none, none."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    out = np.full(n, min(k, len(words)), dtype=np.uint64)
    for j in range(min(k, len(words))):
        out = out * _BASE + words[j:j + n]
    return mix(out)


def shingle_sets(texts: list[bytes], k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    words, bounds = hashed_words(texts)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield np.unique(shingles(words[a:b], k))
