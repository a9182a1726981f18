import re
import tracemalloc

import numpy as np
import pytest

from revlens.llm import quality as Q

INSULT = re.compile(r"\b(" + "|".join(Q.INSULT_NOUNS + Q.INSULT_ADJECTIVES) + r")\b", re.I)


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    hit, false = np.array([0.9, 0.7, 0.6, 0.8]), np.array([0.02, 0.05, 0.01, 0.1])
    votes = np.where(rng.random((20_000, 4)) < np.where(truth[:, None], hit, false), 2, 1)
    votes[rng.random((20_000, 4)) < 0.2] = 0
    codes, counts = np.unique(Q._code(votes), return_counts=True)
    posterior = Q.label_model(dict(zip(codes.tolist(), counts.tolist())), 4)
    guess = np.array([posterior[c] > 0.5 for c in Q._code(votes).tolist()])
    assert (guess == truth).mean() > 0.95
    assert Q.label_model({}, 4) == {}


def test_held_out_accuracy(spark):
    """The scorer against the labels that its training did not see."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    trained = Q.train(docs, labels.filter("doc_id % 2 = 0"))
    scores = {r.id: r for r in Q.score(docs, trained).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = [r for r in labels.collect() if r.doc_id % 2]
    low = [(scores[r.doc_id].low_quality >= 0.5) == (r.quality == 0) for r in rows]
    assert np.mean(low) > 0.98
    # only English texts show why they are labelled toxic
    toxic = [(scores[r.doc_id].toxic >= 0.5) == bool(INSULT.search(texts[r.doc_id])) for r in rows]
    assert np.mean(toxic) > 0.97
    clean = [r.doc_id for r in rows if r.quality == 1 and not INSULT.search(texts[r.doc_id])]
    assert np.mean([scores[i].rejected for i in clean]) < 0.01
    kept = {r.doc_id for r in Q.accepted(docs, trained).collect()}
    assert kept == {i for i, r in scores.items() if not r.rejected}


def test_edges(spark, small, none):
    trained = Q.train(small)
    got = Q.score(small, trained).collect()
    assert len(got) == small.count()
    assert not any(r.rejected for r in got if r.id in (1, 2, 3))
    kept = Q.accepted(small, trained)
    assert kept.columns == small.columns
    assert Q.score(none, trained).count() == 0
    empty = Q.train(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert not any(r.rejected for r in Q.score(small, empty).collect())


@pytest.mark.parametrize("text, figure", [
    ("ALL OF THIS SHOUTS", "upper"), ("a%%% b### c&&&", "marked_words"), ("a | b | c |", "bare_symbols"),
    ("same same same same", "echoes")])
def test_style_figures(text, figure):
    figures, n, *_ = Q.profile([b"plain words of prose", text.encode(), b""])
    j = Q.STYLE.index(figure)
    assert figures[1, j] > 0.4 and figures[0, j] < 0.2 and figures[2, j] == 0 and n[2] == 0


def test_toxic_words_outside_the_list_are_learned_from_labels(spark):
    """Two invented beginnings of insults, one of them outside ASCII; half of
    the documents have no label."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        words = [f"{rng.choice(['ta', 'lo', 'mir', 'é'])}{rng.integers(10_000)}" for _ in range(60)]
        if i % 10 == 0:
            for k in rng.choice(60, 4, replace=False):
                words[k] = f"{('grux', 'çêbom')[i // 10 % 2]}{rng.integers(10_000)}"
        rows.append((i, " ".join(words), int(i % 10 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, truth int")
    labels = docs.filter("doc_id div 20 % 2 = 0").selectExpr("doc_id", "truth AS toxic")
    scores = {r.id: r.toxic >= 0.5 for r in Q.score(docs, Q.train(docs, labels)).collect()}
    assert all(scores[i] == bool(truth) for i, _, truth in rows)


def test_known_labels_outweigh_the_other_votes():
    silent = [1, 1, 1]
    counts = {int(Q._code(np.array([[*silent, label]]))[0]): n
              for label, n in ((2, 188), (1, 3500), (0, 6000))}
    posterior = Q.label_model(counts, 4, known=3)
    bad, good, open_ = (posterior[int(Q._code(np.array([[*silent, x]]))[0])] for x in (2, 1, 0))
    assert bad == 1 and good == 0 and 0.02 < open_ < 0.1


def test_a_worker_holds_little_beside_its_batch():
    import pyarrow as pa

    prose = " ".join(f"w{i}" for i in range(400))       # 2 KB
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "text": [prose] * 3000})
    run = Q._votes_of(Q.NOTHING_LEARNED)
    next(run(iter([batch.slice(0, 10)])))               # tables that every batch uses
    tracemalloc.start()
    try:
        out = next(run(iter([batch])))
        assert out.num_rows == 3000 and tracemalloc.get_traced_memory()[1] < 120e6
    finally:
        tracemalloc.stop()
