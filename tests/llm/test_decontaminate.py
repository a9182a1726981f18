import random

import numpy as np

from revlens.llm import decontaminate as D
from revlens.llm.words import hashed_words


def _index(texts):
    rows, df = [], {}
    for i, t in enumerate(texts):
        words, _ = hashed_words([t.encode()])
        cut = -(-2 * len(words) // 3)
        rows.append((i, words[:cut], words[cut:]))
        for w in set(words.tolist()):
            df[w] = df.get(w, 0) + 1
    average = sum(len(a) + len(b) for _, a, b in rows) / len(rows)
    return D.build_index(rows, df, len(rows), average, 64)


def test_block_max_wand_finds_what_scoring_every_item_finds():
    rnd = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)] + ["the", "of"] * 20
    index = _index([" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(3, 30)))
                    for _ in range(150)])
    for _ in range(150):
        words, _ = hashed_words([" ".join(
            rnd.choice(vocabulary) for _ in range(rnd.randint(1, 40))).encode()])
        terms = np.unique(index.terms(words)[1])
        score = np.zeros(150)
        for t in terms:
            span = slice(index.starts[t], index.starts[t + 1])
            score[index.post_items[span]] += index.impacts[span]
        for threshold in (0.05, 0.2, 0.4, 0.7):
            want = [i for i in range(150) if score[i] >= threshold - 1e-9]
            assert [i for i, _ in D.block_max_wand(index, terms, threshold)] == want


def test_every_window_that_reaches_the_threshold_is_searched():
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    index = _index([" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(2, 12)))
                    for _ in range(60)])
    for _ in range(60):
        words, _ = hashed_words([" ".join(rnd.choice(vocabulary) for _ in range(40)).encode()])
        _, terms = index.terms(words)
        for threshold in (0.3, 0.6, 0.9):
            hits = D.block_max_wand(index, np.unique(terms), threshold)
            let, *_ = D._candidates(index, np.zeros(len(terms), dtype=np.int64), terms, 1, threshold)
            assert len(let) or not hits


def test_planted_items_are_found_and_no_others(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    tests = {r.item_id: r.text for r in items.collect()}
    want = {(d, i) for d, t in texts.items() for i, x in tests.items() if t and x in t}
    for words in (200_000, 150):  # one block of items, and many
        got = {(r.id, r.item) for r in D.contaminations(docs, items, index_words=words).collect()}
        assert got == want
    kept = D.decontaminated(docs, items, index_words=400)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in want}
    assert kept.columns == docs.columns


def test_question_without_the_answer_is_not_a_leak(spark):
    question, answer = " ".join(f"q{i}" for i in range(20)), " ".join(f"a{i}" for i in range(8))
    items = spark.createDataFrame([("x", question, answer), ("y", question, answer), ("z", None, None)],
                                  "item string, q string, a string")
    docs = spark.createDataFrame([(1, f"z {question} z"), (2, f"k {question} {answer} m"), (3, answer),
                                  (4, "b " * 500 + question + " " + answer)], "doc_id long, text string")
    got = D.contaminations(docs, items, item_col="item", question_col="q", answer_col="a").collect()
    assert sorted((r.id, r.item) for r in got) == [(2, "x"), (2, "y"), (4, "x"), (4, "y")]


def test_edges(spark, small, none):
    items = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "item_id long, text string")
    got = D.contaminations(small, items).collect()
    assert sorted((r.id, r.item) for r in got) == [(7, 1), (8, 1)]
    assert D.contaminations(none, items).count() == 0
    assert D.contaminations(small, items.limit(0)).count() == 0
    assert D.decontaminated(small, items.limit(0)).count() == small.count()
    assert D.decontaminated(small, items).count() == small.count() - 2
