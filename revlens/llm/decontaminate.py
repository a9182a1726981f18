"""Benchmark decontamination: a BM25 index of the test items, every passage of
the corpus as a query, block-max WAND, and a check of question and answer.

Items.  Every item has a question and an answer; an item of one text is cut,
two thirds of its words being the question.  Term statistics (document
frequency, average length) are counted in Spark over all items.  A posting's
impact is its BM25 weight divided by the item's own score as a query, so a
score is the share of the item that a passage holds, and one threshold fits
items of any length.

Passages.  A document is read in windows that overlap by half and are at least
twice as long as the longest item, so an item that a document holds lies
whole in some window.

Search.  Two exact bounds come before any list is walked.  Terms of many items
("common") cannot bring an item more than its own common share; so a window
can only reach the threshold for an item whose rarer terms bring the rest.
That test is done for all windows of a block of text at once.  The windows
that pass are searched by block-max WAND: the lists' cursors are kept in item
order, the pivot is the first item at which the lists' maxima reach the
threshold, the maxima of the blocks around the pivot are tried next, and only
then is an item scored.  All items above the threshold are retrieved.

Verification.  A retrieved item counts when the window holds enough of the
word trigrams of its question and of its answer.

The index is built in blocks of items of bounded size, by their words; each
block is broadcast and meets every document, so any number of items is
searched whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from revlens.llm.common import arrow_map, checkpointed
from revlens.llm.words import document_chunks, hashed_words, shingles

K1, B = 1.2, 0.75
THRESHOLD = 0.5        # share of an item's own BM25 score
OVERLAP = 0.5          # of the trigrams of the question, and of the answer
TRIGRAM = 3
LEAST_WINDOW = 64      # words
POSTING_BLOCK = 16
INDEX_WORDS = 200_000  # words of the items of one broadcast block
_WINDOWS_AT_ONCE = 2048
_CELLS_AT_ONCE = 1 << 22   # windows x items of one look at the bounds
_LIVE_BITS = 22


@dataclass
class Index:
    """The items of one block, as flat arrays."""
    items: list
    question: list[np.ndarray]
    answer: list[np.ndarray]
    window: int
    vocabulary: np.ndarray       # sorted term hashes
    starts: np.ndarray           # postings of term t: starts[t] to starts[t + 1]
    post_items: np.ndarray
    impacts: np.ndarray
    common: np.ndarray           # of terms: in many items
    common_share: np.ndarray     # of items: what common terms can bring
    live: np.ndarray = field(default=None)

    def __post_init__(self):
        self.live = np.zeros(1 << _LIVE_BITS, dtype=bool)
        self.live[(self.vocabulary >> np.uint64(64 - _LIVE_BITS)).astype(np.int64)] = True
        self.highest = np.maximum.reduceat(self.impacts, self.starts[:-1]) \
            if len(self.impacts) else np.empty(0)

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and term numbers of the words that the index knows."""
        if not len(self.vocabulary):
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        at = np.flatnonzero(self.live[(words >> np.uint64(64 - _LIVE_BITS)).astype(np.int64)])
        near = np.searchsorted(self.vocabulary, words[at])
        near[near == len(self.vocabulary)] = 0
        known = self.vocabulary[near] == words[at]
        return at[known], near[known]


def build_index(rows: list, frequency: dict[int, int], items_in_all: int,
                average: float, window: int) -> Index:
    """``rows``: (item, question words, answer words), the words as hashes."""
    weights: list[tuple[int, int, float]] = []
    for number, (_, question, answer) in enumerate(rows):
        words = np.concatenate([question, answer])
        terms, counts = np.unique(words, return_counts=True)
        tf = counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(words) / average))
        idf = np.array([math.log(1 + (items_in_all - frequency[int(t)] + 0.5)
                                 / (frequency[int(t)] + 0.5)) for t in terms])
        impact = tf * idf
        whole = impact.sum() or 1.0
        weights += zip(terms.tolist(), [number] * len(terms), (impact / whole).tolist())
    weights.sort()
    terms = np.array([w[0] for w in weights], dtype=np.uint64)
    vocabulary, starts, lengths = np.unique(terms, return_index=True, return_counts=True)
    post_items = np.array([w[1] for w in weights], dtype=np.int64)
    impacts = np.array([w[2] for w in weights])
    common = lengths > max(4.0, math.sqrt(len(rows)))
    share = np.bincount(post_items, weights=impacts * np.repeat(common, lengths),
                        minlength=len(rows))
    return Index([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], window,
                 vocabulary, np.append(starts, len(terms)), post_items, impacts, common, share)


def block_max_wand(index: Index, terms: np.ndarray, threshold: float) -> list[tuple[int, float]]:
    """All items whose score for the distinct ``terms`` reaches ``threshold``:
    (item number, score), in item order."""
    found = []
    cursors = [[int(index.post_items[index.starts[t]]), int(index.starts[t]),
                int(index.starts[t + 1]), float(index.highest[t])] for t in terms.tolist()]
    small = 1e-9  # sums in another order than the score's must not lose an item

    def seek(c: list, item: int) -> None:
        c[1] += int(np.searchsorted(index.post_items[c[1]:c[2]], item))
        c[0] = int(index.post_items[c[1]]) if c[1] < c[2] else -1

    while cursors:
        cursors.sort(key=lambda c: c[0])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += c[3]
            if bound + small >= threshold:
                pivot = k
                break
        if pivot is None:
            break
        item = cursors[pivot][0]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
            pivot += 1
        refined, leave = 0.0, len(index.items)
        for c in cursors[:pivot + 1]:
            at = c[1] + int(np.searchsorted(index.post_items[c[1]:c[2]], item))
            if at < c[2]:
                end = min(at - (at - c[1]) % POSTING_BLOCK + POSTING_BLOCK, c[2])
                refined += float(index.impacts[at:end].max())
                leave = min(leave, int(index.post_items[end - 1]) + 1)
        if refined + small < threshold:
            # no item up to the nearest block end can reach the threshold
            goal = leave if pivot + 1 == len(cursors) else min(leave, cursors[pivot + 1][0])
            goal = max(goal, item + 1)
            for c in cursors[:pivot + 1]:
                seek(c, goal)
        elif cursors[0][0] == item:
            score = sum(float(index.impacts[c[1]]) for c in cursors[:pivot + 1])
            if score + small >= threshold:
                found.append((item, score))
            for c in cursors[:pivot + 1]:
                seek(c, item + 1)
        else:
            for c in cursors[:pivot]:
                if c[0] < item:
                    seek(c, item)
        cursors = [c for c in cursors if c[0] >= 0]
    return found


def _overlap(part: np.ndarray, window: np.ndarray) -> float:
    """Share of the part's distinct trigrams that the window holds; a shorter
    part is one shingle, a part without words is held by any window."""
    if not len(part):
        return 1.0
    k = min(TRIGRAM, len(part))
    own = np.unique(shingles(part, k))
    return float(np.isin(own, shingles(window, k)).mean())


def _bounds(index: Index, at: np.ndarray, terms: np.ndarray, span: int) -> np.ndarray:
    """For each of ``span`` windows, no less than any item's score.  ``at``:
    the window of each known word; a word that stands twice counts twice."""
    common = index.common[terms]
    from_common = np.bincount(at[common], weights=index.highest[terms[common]], minlength=span) \
        .astype(float)
    rare_at, rare_terms = at[~common], terms[~common]
    lengths = index.starts[rare_terms + 1] - index.starts[rare_terms]
    place = np.repeat(index.starts[rare_terms] - np.cumsum(lengths) + lengths, lengths) \
        + np.arange(lengths.sum())
    cell = np.repeat(rare_at, lengths) * len(index.items) + index.post_items[place]
    most = np.bincount(cell, weights=index.impacts[place], minlength=span * len(index.items)) \
        .astype(float).reshape(span, len(index.items))
    most += np.minimum(from_common[:, None], index.common_share)
    return most.max(axis=1) + 1e-9


def _candidates(index: Index, at: np.ndarray, terms: np.ndarray, span: int,
                threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ``span`` windows, those that the bounds let through, and the window
    and number of each of their distinct terms."""
    passed = np.flatnonzero(_bounds(index, at, terms, span) >= threshold)
    near = np.isin(at, passed)
    pairs = np.unique(at[near] * len(index.vocabulary) + terms[near])
    at, terms = pairs // len(index.vocabulary), pairs % len(index.vocabulary)
    number = np.searchsorted(passed, at)
    exact = _bounds(index, number, terms, len(passed)) >= threshold
    return passed[exact], at, terms


def search(index: Index, texts: list[bytes], threshold: float = THRESHOLD,
           overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question and answer overlap) of all
    verified pairs, each once, by its best window."""
    words, bounds = hashed_words(texts)
    stride = index.window // 2
    counts = np.maximum(1, -(-np.diff(bounds) // stride))
    base = np.concatenate([[0], np.cumsum(counts)])
    places, terms = index.terms(words)
    known = np.searchsorted(places, bounds)  # of each text's known words
    doc_bounds, doc_base = (np.repeat(x[:-1], np.diff(known)) for x in (bounds, base))
    k = (places - doc_bounds) // stride
    later = doc_base + k                     # the window that begins before a word last
    earlier = np.flatnonzero(k > 0)          # these also stand in the one before it
    earlier_at, earlier_terms = later[earlier] - 1, terms[earlier]
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    step = max(1, min(_WINDOWS_AT_ONCE, _CELLS_AT_ONCE // max(1, len(index.items))))
    for first in range(0, int(base[-1]), step):
        last = min(first + step, int(base[-1]))
        a, b = np.searchsorted(later, [first, last])
        c, d = np.searchsorted(earlier_at, [first, last])
        if a == b and c == d:
            continue
        at = np.concatenate([later[a:b], earlier_at[c:d]]) - first
        held = np.concatenate([terms[a:b], earlier_terms[c:d]])
        windows, at, held = _candidates(index, at, held, last - first, threshold)
        for w in windows.tolist():
            a, b = np.searchsorted(at, [w, w + 1])
            hits = block_max_wand(index, held[a:b], threshold)
            if not hits:
                continue
            w += first
            d = int(np.searchsorted(base, w, side="right")) - 1
            begin = bounds[d] + (w - base[d]) * stride
            window = words[begin:min(begin + index.window, bounds[d + 1])]
            for item, score in hits:
                q, s = _overlap(index.question[item], window), _overlap(index.answer[item], window)
                if q >= overlap and s >= overlap:
                    best[d, item] = max(best.get((d, item), (0.0, 0.0, 0.0)), (score, q, s))
    for (d, item), (score, q, s) in sorted(best.items()):
        yield d, item, score, q, s


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
        question, answer = [], []
        for q, a in zip(columns["question"], columns["answer"]):
            words, _ = hashed_words([(q or "").encode()])
            if a is None:
                cut = -(-2 * len(words) // 3)
                words, tail = words[:cut], words[cut:]
            else:
                tail, _ = hashed_words([a.encode()])
            question.append(words.view(np.int64))
            answer.append(tail.view(np.int64))
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("item"), pa.array(question, kind), pa.array(answer, kind)],
            names=["item", "question", "answer"])


@dataclass
class _Items:
    words: DataFrame
    frequency: DataFrame
    number: int
    all_words: int
    window: int
    blocks: int

    def index(self, block: int) -> Index:
        """The items of one block; about index_words words, whatever the data."""
        mine = self.words.filter(
            F.pmod(F.xxhash64("words"), F.lit(self.blocks)) == block)
        rows = [(r.item, np.array(r.question, dtype=np.int64).view(np.uint64),
                 np.array(r.answer, dtype=np.int64).view(np.uint64))
                for r in mine.select("item", "question", "answer")
                .orderBy("item", "words").collect()]
        known = mine.select(F.explode("words").alias("term")).distinct() \
            .join(self.frequency, "term")
        counts = {r.term & (2 ** 64 - 1): r.df for r in known.collect()}
        return build_index(rows, counts, self.number, self.all_words / self.number, self.window)


def _items(benchmark: DataFrame, item_col: str, question_col: str, answer_col: str | None,
           index_words: int) -> _Items:
    answer: Column = F.col(answer_col).cast("string") if answer_col else F.lit(None).cast("string")
    source = benchmark.select(F.col(item_col).alias("item"),
                              F.col(question_col).cast("string").alias("question"),
                              answer.alias("answer"))
    item_type = source.schema["item"].dataType.simpleString()
    words = checkpointed(arrow_map(
        source, _item_words, f"item {item_type}, question array<long>, answer array<long>")
        .withColumn("words", F.concat("question", "answer")).filter(F.size("words") > 0))
    number, all_words, longest = (int(x) for x in words.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0)),
        F.coalesce(F.max(F.size("words")), F.lit(0))).first())
    frequency = words.select(F.explode(F.array_distinct("words")).alias("term")) \
        .groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return _Items(words, frequency, number, all_words, 2 * max(LEAST_WINDOW // 2, longest),
                  max(1, math.ceil(all_words / index_words)))


def contaminations(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id",
                   question_col: str = "text", answer_col: str | None = None,
                   threshold: float = THRESHOLD, overlap: float = OVERLAP,
                   index_words: int = INDEX_WORDS) -> DataFrame:
    """One row per document row and item that it holds: ``id``, ``item``,
    ``score``, ``question_overlap``, ``answer_overlap``.

    Null and empty texts hold nothing, and items without words are in
    nothing.  Repeated documents each give rows; items that repeat a text or
    an id are items of their own.  An answer column that is null for an item
    leaves its question to be cut.  Other columns are ignored.  Empty tables
    give an empty result.
    """
    items = _items(benchmark, item_col, question_col, answer_col, index_words)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    item_kind = items.words.schema["item"].dataType
    schema = (f"id {texts.schema['id'].dataType.simpleString()}, "
              f"item {item_kind.simpleString()}, score double, question_overlap double, "
              "answer_overlap double")
    if not items.number:
        return docs.sparkSession.createDataFrame([], schema)
    found = None
    for block in range(items.blocks):
        shared = docs.sparkSession.sparkContext.broadcast(items.index(block))
        hits = arrow_map(texts, _searcher(shared, to_arrow_type(item_kind), threshold, overlap),
                         schema)
        found = hits if found is None else found.unionByName(hits)
    return found


def _searcher(shared: Broadcast, item_kind: pa.DataType, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows, items, figures = [], [], ([], [], [])
            for first, chunk in document_chunks(batch, "text"):
                for d, item, *values in search(index, chunk, threshold, overlap):
                    rows.append(first + d)
                    items.append(index.items[item])
                    for column, value in zip(figures, values):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(items, item_kind),
                 *[pa.array(f, pa.float64()) for f in figures]],
                names=["id", "item", "score", "question_overlap", "answer_overlap"])

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text",
                   item_col: str = "item_id", question_col: str = "text",
                   answer_col: str | None = None, threshold: float = THRESHOLD,
                   overlap: float = OVERLAP, index_words: int = INDEX_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item; one pass over the
    documents a block of items, without a join."""
    items = _items(benchmark, item_col, question_col, answer_col, index_words)
    for block in range(items.blocks if items.number else 0):
        shared = docs.sparkSession.sparkContext.broadcast(items.index(block))
        docs = arrow_map(docs, _cleaner(shared, text_col, threshold, overlap), docs.schema)
    return docs


def _cleaner(shared: Broadcast, text_col: str, threshold: float, overlap: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for first, chunk in document_chunks(batch, text_col):
                for d, *_ in search(shared.value, chunk, threshold, overlap):
                    clean[first + d] = False
            yield batch.filter(pa.array(clean))

    return run
