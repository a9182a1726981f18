"""Quality classifier: a weak-label model and a hashed linear scorer.

Two heads, ``low_quality`` and ``toxic``, each made the same way:

1. Overlapping heuristic labellers vote on every document: bad, good, or no
   vote.  Two of the toxic head know fixed words; a third knows the words and
   the beginnings of words that Spark finds associated with the known labels,
   over ``LABELLED_DOCUMENTS`` labelled rows, in any language.  Spark counts the vote
   patterns of all documents; there are at most 3 to the number of labellers
   of them, whatever the corpus.
2. Expectation-maximisation on the pattern counts estimates how often each
   labeller votes what on bad and on good documents, and the share of bad
   ones, without trusting any labeller.  A known toxic label is not estimated:
   such documents count as what they are labelled, whatever the others say,
   and weigh as evidence on unlabelled documents with the same votes.
3. The posteriors label a training sample of about ``SAMPLE_DOCUMENTS``
   documents, and a linear scorer with logistic loss and a ridge penalty is
   trained on hashed features: the words of the text, the beginnings that
   many of its words share, and its style figures in steps, as far as they
   are associated with a label.  The sample's bound is a parameter;
   everything else covers all documents.
4. The scorer alone decides: a document is rejected when either head gives a
   probability of ``REJECT`` or more.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.common import arrow_map, checkpointed, md5_fraction
from revlens.llm.words import Words, document_chunks, hash_spans, mix, split_words, word_hash

HEADS = ("low_quality", "toxic")
SAMPLE_DOCUMENTS = 8_000
LABELLED_DOCUMENTS = 20_000  # labelled rows that the toxic head learns features from
BUCKET_BITS = 30
LEAST_DOCUMENTS = 8      # a feature in fewer sample documents is not trained
LEAST_Z = 8.0            # nor one no nearer to bad documents than this
FEATURES = 400           # trained at most, a head
LEADS = (4, 5, 6)        # bytes of a beginning
LEAD_SHARE = 0.01        # of a text's words that must begin so
LEARNED_SHARE = 0.5      # of documents with a learned feature that are labelled bad
LEARNED = 2 * FEATURES   # features learned from the labels at most, those of largest z
REJECT = 0.5

#: Words that the toxic labellers know.
INSULT_NOUNS = ("clown", "idiot", "imbecile", "jerk", "loser", "moron", "scum", "trash", "vermin")
INSULT_ADJECTIVES = ("despicable", "disgusting", "dumb", "pathetic", "stupid", "worthless")

STYLE = ("upper", "symbols", "marked_words", "bare_symbols", "echoes", "variety", "doubled")
#: Labeller of the low-quality head: figure, from which value on it votes bad,
#: below which it votes good; None: votes only one way.  ``variety`` counts down.
STYLE_VOTES = (("upper", 0.3, 0.15), ("symbols", 0.08, 0.05), ("marked_words", 0.25, 0.1),
               ("bare_symbols", 0.1, 0.05), ("echoes", 0.2, 0.1), ("variety", 0.7, 0.5))
LEAST_WORDS = 8          # style labellers do not vote on shorter texts

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[ord(c) for c in "!#$%&*+<=>@^_|~\\/{}[]"]] = True
_ALNUM = np.zeros(256, dtype=bool)
_ALNUM[[c for c in range(256) if chr(c).isalnum() and c < 128 or c >= 128]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, dtype=bool)
_LOWER[97:123] = True


def _per_text(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[edges[1:]] - sums[edges[:-1]]).astype(float)


def _cores(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and bounds of the words without the marks around them, their
    starts and ends; words of marks only are left out."""
    solid = np.flatnonzero(_ALNUM[w.data])
    first = np.searchsorted(solid, w.starts)
    after = np.searchsorted(solid, w.ends)
    some = after > first
    kept = np.concatenate([[0], np.cumsum(some)])
    starts, ends = solid[first[some]], solid[after[some] - 1] + 1
    return hash_spans(w.data, starts, ends), kept[w.bounds], starts, ends


def profile(texts: list[bytes]):
    """Style figures (texts x STYLE), word counts, the hashes and bounds of
    the words without the marks around them, and the bytes with the starts
    and ends of these words."""
    w = split_words(texts)
    data, edges, bounds = w.data, w.begins, w.bounds
    n = np.diff(bounds).astype(float)
    cores, core_bounds, starts, ends = _cores(w)
    some = np.maximum(n, 1.0)
    upper, lower = _per_text(_UPPER[data], edges), _per_text(_LOWER[data], edges)
    letters = np.concatenate([[0], np.cumsum(_ALNUM[data])])
    symbols = _PUNCTUATION[data]
    visible = np.maximum(_per_text(~np.isin(data, np.frombuffer(b" \t\n\r\v\f", np.uint8)), edges), 1.0)
    bare = letters[w.ends] == letters[w.starts]
    last = w.ends - 1
    marked = symbols[last] & (w.ends - w.starts > 2)
    marked[marked] = data[last[marked]] == data[last[marked] - 1]
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    echo = np.zeros(len(w.hashes), dtype=bool)
    echo[1:] = (w.hashes[1:] == w.hashes[:-1]) & (of[1:] == of[:-1])
    order = np.lexsort((w.hashes, of))
    again = np.zeros(len(order), dtype=bool)
    again[1:] = (w.hashes[order][1:] == w.hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    variety = _per_text(again, bounds) / some
    doubled = np.zeros(len(data), dtype=bool)
    doubled[1:] = symbols[1:] & (data[1:] == data[:-1])
    figures = np.stack([
        upper / np.maximum(upper + lower, 1.0), _per_text(symbols, edges) / visible,
        _per_text(marked, bounds) / some, _per_text(bare, bounds) / some,
        _per_text(echo, bounds) / some, variety, _per_text(doubled, edges) / some], axis=1)
    return figures, n, cores, core_bounds, (data, starts, ends)


def _insult_counts(hashes: np.ndarray, bounds: np.ndarray, lexicon: tuple[str, ...]) -> np.ndarray:
    known = np.array([word_hash(word) for word in lexicon], dtype=np.uint64)
    return _per_text(np.isin(hashes, known), bounds)


def _shortened(bucket: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which buckets are in ``keep`` (sorted), and the places of those there."""
    near = np.minimum(np.searchsorted(keep, bucket), max(len(keep) - 1, 0))
    known = keep[near] == bucket if len(keep) else np.zeros(len(bucket), dtype=bool)
    return known, near[known]


def _distinct(of: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(of << BUCKET_BITS | bucket)
    return pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)


def word_features(profiled, keep: np.ndarray | None = None):
    """(text, bucket) pairs of the words; with ``keep``, (text, place in it)."""
    _, _, hashes, bounds, _ = profiled
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    bucket = (mix(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    if keep is not None:
        known, bucket = _shortened(bucket, keep)
        of = of[known]
    return _distinct(of, bucket)


def lead_features(profiled, keep: np.ndarray | None = None):
    """(text, bucket) pairs of the beginnings, of ``LEADS`` bytes, that a
    share of ``LEAD_SHARE`` of the text's words has; ``keep`` as for words."""
    _, _, _, bounds, (data, starts, ends) = profiled
    count = np.diff(bounds)
    word_of = np.repeat(np.arange(len(bounds) - 1), count)
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for size in LEADS:
        long = ends - starts >= size
        hashes = hash_spans(data, starts[long], starts[long] + size)
        bucket = (mix(hashes ^ np.uint64(size)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        of = word_of[long]
        if keep is not None:
            known, bucket = _shortened(bucket, keep)
            of = of[known]
        pairs, times = np.unique(of << BUCKET_BITS | bucket, return_counts=True)
        pairs = pairs[times >= LEAD_SHARE * count[pairs >> BUCKET_BITS]]
        found.append((pairs >> BUCKET_BITS, pairs & ((1 << BUCKET_BITS) - 1)))
    return tuple(np.concatenate(part) for part in zip(*found))


NOTHING_LEARNED = (np.empty(0, np.int64), np.empty(0, np.int64))


def votes(texts: list[bytes], learned: tuple[np.ndarray, np.ndarray] = NOTHING_LEARNED):
    """Votes of the low-quality and the toxic labellers: 2 bad, 1 good, 0 none.
    ``learned``: the sorted buckets of words and of beginnings of words."""
    profiled = profile(texts)
    figures, n, hashes, bounds, _ = profiled
    low = np.zeros((len(texts), len(STYLE_VOTES)), dtype=np.int64)
    for j, (name, bad, good) in enumerate(STYLE_VOTES):
        x = figures[:, STYLE.index(name)]
        low[:, j] = np.where(x >= bad, 2, np.where(x < good, 1, 0)) * (n >= LEAST_WORDS)
    hits = [_insult_counts(hashes, bounds, INSULT_NOUNS),
            _insult_counts(hashes, bounds, INSULT_ADJECTIVES)]
    # who has learned nothing does not vote
    hits.append(sum(np.bincount(find(profiled, keep)[0], minlength=len(texts))
                    for find, keep in zip((word_features, lead_features), learned))
                if any(map(len, learned)) else np.full(len(texts), -1))
    toxic = np.stack([np.where(h > 0, 2, np.where(h == 0, 1, 0)) * (n > 0) for h in hits], axis=1)
    return low, toxic


def _code(table: np.ndarray) -> np.ndarray:
    return table @ (3 ** np.arange(table.shape[1]))


def _decode(code: int, labellers: int) -> list[int]:
    return [code // 3 ** j % 3 for j in range(labellers)]


LABELLERS = (len(STYLE_VOTES), 4)   # the last of the toxic head: the known label


def label_model(counts: dict[int, int], labellers: int, rounds: int = 200,
                known: int | None = None) -> dict[int, float]:
    """Posterior probability of bad for each vote pattern, by EM.  The votes
    of the labeller ``known`` are the truth where there are any; elsewhere
    the known labels of documents with the same other votes weigh with their
    number against one document's weight of the estimate.

    A labeller that does not vote says nothing.  The start takes votes for
    bad to be rare on good documents; without documents there is nothing to
    learn and the result is empty."""
    patterns = np.array([_decode(c, labellers) for c in counts]).reshape(-1, labellers)
    weight = np.array(list(counts.values()), dtype=float)
    if not len(weight):
        return {}
    accuracy = np.array([[0.5] * labellers, [0.03] * labellers])  # P(votes bad | bad, good)
    prior = 0.1
    posterior = np.full(len(weight), prior)
    if known is not None:
        told = patterns[:, known]
        others = np.delete(patterns, known, axis=1)
        _, same = np.unique(others, axis=0, return_inverse=True)
        same = same.ravel()
        alike = np.bincount(same, weights=weight * (told > 0))[same]
        alike_bad = np.bincount(same, weights=weight * (told == 2))[same]
    for _ in range(rounds):
        score = np.full((2, len(weight)), [[math.log(prior)], [math.log(1 - prior)]])
        for k in (0, 1):
            score[k] += np.where(patterns == 2, np.log(accuracy[k]),
                                 np.where(patterns == 1, np.log(1 - accuracy[k]), 0.0)).sum(axis=1)
        posterior = 1 / (1 + np.exp(np.clip(score[1] - score[0], -500, 500)))
        if known is not None:
            posterior = np.where(told > 0, told == 2, (posterior + alike_bad) / (1 + alike))
        prior = float(np.clip((posterior * weight).sum() / weight.sum(), 1e-4, 0.5))
        for k, belongs in enumerate((posterior, 1 - posterior)):
            mass = (belongs * weight)[:, None]
            bad, good = (mass * (patterns == 2)).sum(axis=0), (mass * (patterns == 1)).sum(axis=0)
            accuracy[k] = np.clip((bad + 0.5) / (bad + good + 1.0), 1e-5, 1 - 1e-5)
    return dict(zip(counts, posterior.tolist()))


def _style_features() -> np.ndarray:
    return np.array([[word_hash(f"\x01{name}:{step}") for step in range(11)] for name in STYLE],
                    dtype=np.uint64)


def features(texts: list[bytes], keep: np.ndarray | None = None):
    """Distinct (text, bucket) pairs as two arrays; ``keep``: sorted buckets
    that matter, others are left out."""
    profiled = profile(texts)
    figures = profiled[0]
    steps = np.minimum((figures * 20).astype(np.int64), 10)
    style = (mix(_style_features()) >> np.uint64(64 - BUCKET_BITS))[
        np.arange(len(STYLE)), steps].astype(np.int64).ravel()
    style_of = np.repeat(np.arange(len(texts)), len(STYLE))
    if keep is not None:
        known, style = _shortened(style, keep)
        style_of = style_of[known]
    found = (word_features(profiled, keep), lead_features(profiled, keep), (style_of, style))
    return _distinct(*[np.concatenate(part) for part in zip(*found)])


def screen(rows: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray,
           most: int = FEATURES) -> np.ndarray:
    """The features most associated with bad documents: those whose share of
    them is further above the sample's than chance explains."""
    seen = np.bincount(columns, minlength=width)
    bad = np.bincount(columns, weights=target[rows], minlength=width)
    share = float(np.clip(target.mean(), 1e-3, 1 - 1e-3))
    z = (bad - seen * share) / np.sqrt(np.maximum(seen, 1) * share * (1 - share))
    z[seen < LEAST_DOCUMENTS] = 0.0
    best = np.argsort(-z, kind="stable")[:most]
    return np.sort(best[z[best] >= LEAST_Z])


def train_head(rows: np.ndarray, columns: np.ndarray, width: int, target: np.ndarray,
               ridge: float = 0.003, rounds: int = 30):
    """Weights and bias of a logistic scorer on 0/1 features, by Newton steps
    with a ridge penalty."""
    x = np.zeros((len(target), width + 1))
    x[rows, columns] = 1.0
    x[:, width] = 1.0
    penalty = np.full(width + 1, ridge)
    penalty[width] = 1e-6
    beta = np.zeros(width + 1)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (chance - target) + penalty * beta
        curve = (x * np.maximum(chance * (1 - chance), 1e-6)[:, None]).T @ x
        curve[np.diag_indices_from(curve)] += penalty
        step = np.linalg.solve(curve, slope)
        beta -= step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta[:width], float(beta[width])


def _votes_of(learned: tuple[np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, toxic = [], []
            for _, texts in document_chunks(batch, "text"):
                a, b = votes(texts, learned)
                low.append(_code(a))
                toxic.append(_code(b))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(np.concatenate([np.empty(0, np.int64), *low])),
                 pa.array(np.concatenate([np.empty(0, np.int64), *toxic]))],
                names=["id", "low", "toxic"])
    return run


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents and bad documents of each feature, added up within a chunk."""
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        for first, texts in document_chunks(batch, "text"):
            profiled = profile(texts)
            for kind, find in enumerate((word_features, lead_features)):
                of, bucket = find(profiled)
                names, place = np.unique(bucket, return_inverse=True)
                seen = np.bincount(place, minlength=len(names)).astype(np.int64)
                bad = np.bincount(place[label[first + of] == 2], minlength=len(names)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(names), kind, np.int32)), pa.array(names),
                     pa.array(seen), pa.array(bad)], names=["kind", "bucket", "seen", "bad"])


def learn_features(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of words and of beginnings that go with the label 2, from
    all rows of ``labelled`` (text, label 1 or 2)."""
    share = labelled.agg(F.avg((F.col("label") == 2).cast("double"))).first()[0]
    if not share or share == 1:
        return NOTHING_LEARNED
    counted = arrow_map(labelled, _label_counts, "kind int, bucket long, seen long, bad long") \
        .groupBy("kind", "bucket").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    z = (F.col("bad") - F.col("seen") * share) / F.sqrt(F.col("seen") * (share * (1 - share)))
    rows = counted.withColumn("z", z).filter(
        (F.col("seen") >= LEAST_DOCUMENTS) & (F.col("z") >= LEAST_Z)
        & (F.col("bad") >= LEARNED_SHARE * F.col("seen"))) \
        .orderBy(F.desc("z"), "kind", "bucket").limit(LEARNED).collect()
    return tuple(np.array(sorted(r["bucket"] for r in rows if r["kind"] == kind), dtype=np.int64)
                 for kind in (0, 1))


def fit_scorer(texts: list[bytes], targets: list[np.ndarray],
               sure: list[np.ndarray] | None = None) -> pd.DataFrame:
    """head, bucket, weight (bucket -1: the bias), one target a head; ``sure``:
    buckets that a head takes in without screening."""
    rows, buckets = [np.empty(0, np.int32)], [np.empty(0, np.int32)]   # BUCKET_BITS fit
    for first in range(0, len(texts), 500):
        of, bucket = features(texts[first:first + 500])
        rows.append((of + first).astype(np.int32))
        buckets.append(bucket.astype(np.int32))
    rows, buckets = np.concatenate(rows), np.concatenate(buckets)
    names, columns = np.unique(buckets, return_inverse=True)
    del buckets
    names = names.astype(np.int64)
    out = []
    for head, target in enumerate(targets):
        live = screen(rows, columns, len(names), target)
        if sure is not None:
            live = np.union1d(live, np.flatnonzero(np.isin(names, sure[head])))
        place = np.full(len(names), -1)
        place[live] = np.arange(len(live))
        inside = place[columns] >= 0
        weights, bias = train_head(rows[inside], place[columns[inside]], len(live), target)
        out.append(pd.DataFrame({"head": head, "bucket": np.append(names[live], -1),
                                 "weight": np.append(weights, bias)}))
    return pd.concat(out)


def _trainer(posteriors: list[dict[int, float]], learned: tuple[np.ndarray, np.ndarray]):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        # of equal texts one with a known label
        sample = sample.sort_values(["label", "id"], ascending=[False, True]) \
            .drop_duplicates("text").sort_values("id")
        texts = [t.encode() for t in sample["text"]]
        parts = [votes(texts[first:first + 500], learned) for first in range(0, len(texts), 500)]
        low, toxic = (np.concatenate(part) for part in zip(*parts))
        known = sample["label"].to_numpy() * 3 ** (LABELLERS[1] - 1)
        return fit_scorer(texts, [
            np.array([posterior.get(int(c), 0.0) for c in code])
            for code, posterior in zip((_code(low), _code(toxic) + known), posteriors)],
            [np.empty(0, np.int64), np.concatenate(learned)])
    return run


def train(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id",
          text_col: str = "text", toxic_col: str = "toxic",
          sample_documents: int = SAMPLE_DOCUMENTS,
          labelled_documents: int = LABELLED_DOCUMENTS) -> pd.DataFrame:
    """The scorer: head, bucket, weight (bucket -1: the bias).

    Two bounds hold whatever the corpus: the scorer is fitted on about
    ``sample_documents`` rows, and its toxic features are learned from about
    ``labelled_documents`` rows with a known label, both drawn by a hash of the
    id.  The ids of the latter are a broadcast of that size, so the scan picks
    their texts and no text is shuffled for a label.  Votes and known labels
    count over all rows.  Null and empty texts vote like texts without words;
    rows that repeat an id share its label; other columns are ignored; an
    empty table gives a scorer that rejects nothing."""
    texts = docs.select(F.col(id_col).alias("id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    if labels is None:
        known = texts.sparkSession.createDataFrame([], f"known {id_type}, label int")
    else:
        # 2 for toxic, 1 for not; a document with both is not known
        known = labels.filter(F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("known")) \
            .agg(F.min(toxic_col).alias("a"), F.max(toxic_col).alias("b")).filter("a = b") \
            .select("known", (F.when(F.col("a") == 1, 2).otherwise(1)).alias("label"))
    learned = NOTHING_LEARNED
    if labels is not None:
        share = min(1.0, labelled_documents / max(1, known.count()))
        drawn = known.filter(md5_fraction(F.concat(F.col("known").cast("string"),
                                                   F.lit("|labelled"))) <= share)
        # about labelled_documents rows of an id and a number
        learned = learn_features(texts.join(F.broadcast(drawn), F.col("id") == F.col("known"))
                                 .select("text", "label"))
    cast = checkpointed(arrow_map(texts, _votes_of(learned), f"id {id_type}, low long, toxic long"))
    unit = 3 ** (LABELLERS[1] - 1)
    voted = cast.join(known, F.col("id") == F.col("known"), "left").select(
        "low", (F.col("toxic") + F.coalesce("label", F.lit(0)) * unit).alias("toxic"))
    # at most 3 ** labellers patterns a head
    patterns = voted.groupBy("low", "toxic").agg(F.count(F.lit(1)).alias("n"))
    posteriors = [
        label_model({r[0]: r[1] for r in patterns.groupBy(c).agg(F.sum("n")).orderBy(c).collect()},
                    m, known=k)
        for c, m, k in zip(("low", "toxic"), LABELLERS, (None, LABELLERS[1] - 1))]
    share = min(1.0, sample_documents / max(1, cast.count()))
    sample = texts.filter(md5_fraction(F.concat(
        F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("|sample"))) <= share) \
        .join(known, F.col("id") == F.col("known"), "left") \
        .select("id", "text", F.coalesce("label", F.lit(0)).alias("label"))
    # one task of a bounded sample
    trained = sample.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(
        _trainer(posteriors, learned), "head int, bucket long, weight double")
    return trained.toPandas()


class Scorer:
    """The trained weights, ready to score texts; as large as the features of
    the bounded sample."""

    def __init__(self, trained: pd.DataFrame):
        self.keep = np.unique(trained.loc[trained["bucket"] >= 0, "bucket"].to_numpy(np.int64))
        self.table = np.zeros((len(HEADS), len(self.keep)))
        self.bias = np.full(len(HEADS), -50.0)  # a head that was not trained rejects nothing
        for head, bucket, weight in trained.itertuples(index=False):
            if bucket < 0:
                self.bias[head] = weight
            else:
                self.table[head, np.searchsorted(self.keep, bucket)] = weight

    def probabilities(self, batch: pa.RecordBatch, text_col: str) -> np.ndarray:
        chances = [np.empty((len(HEADS), 0))]
        for _, texts in document_chunks(batch, text_col):
            rows, columns = features(texts, self.keep)
            sums = np.stack([self.bias[h] + np.bincount(
                rows, weights=self.table[h][columns], minlength=len(texts))
                for h in range(len(HEADS))])
            chances.append(1 / (1 + np.exp(-np.clip(sums, -50, 50))))
        return np.concatenate(chances, axis=1)


def score(docs: DataFrame, trained: pd.DataFrame, id_col: str = "doc_id", text_col: str = "text",
          reject: float = REJECT) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``low_quality``, ``toxic``
    (probabilities) and ``rejected``.

    A null, empty or blank text has no words and is scored by its style
    figures alone (all zero); it is not rejected for lack of words.  Repeated
    rows each give a row.  Other columns are ignored.  An empty table gives an
    empty result; a scorer without rows rejects nothing."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, toxic = shared.value.probabilities(batch, "text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(low), pa.array(toxic),
                 pa.array((low >= reject) | (toxic >= reject))],
                names=["id", "low_quality", "toxic", "rejected"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    return arrow_map(texts, run, f"id {id_type}, low_quality double, toxic double, "
                     "rejected boolean")


def accepted(docs: DataFrame, trained: pd.DataFrame, text_col: str = "text",
             reject: float = REJECT) -> DataFrame:
    """The rows of ``docs``, all columns, that the scorer does not reject; in
    one pass, without a join."""
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(trained))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(
                (shared.value.probabilities(batch, text_col) < reject).all(axis=0)))

    return arrow_map(docs, run, docs.schema)
