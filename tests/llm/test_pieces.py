import random

import pytest
import sentencepiece

from revlens.llm import pieces as P

TEXTS = ["", " a", "a  b   c", "x\n\n y\t", "日本語 test 한국어", "a" * 200, "ab " * 40, "     ",
         "don't!!!???...", "http://x.example/a_b?d=%20", "🙂🙂 ok", "é​", "<s> </s> <0x0A> <unk>"]


def _random_texts(n):
    rnd = random.Random(0)
    return ["".join(rnd.choice("abcdefghit  \n.,THEthe") for _ in range(120)) for _ in range(n)]


@pytest.fixture(scope="module")
def model():
    return P.load()


def test_ids_are_those_of_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = TEXTS + _random_texts(150)
    got = P.encode_texts(model, texts, {})
    assert [list(g) for g in got] == [library.encode(t) for t in texts]


def test_the_forward_pass_is_merging(model):
    words = sorted({w for t in _random_texts(40) for w in model.words.findall(P.MARK + t)
                    if w[-1] in model.ids})
    assert [[model.pieces[i] for i in ids] for ids in P.encode_sorted(model, words)] == \
        [P.merge(model, w) for w in words]


def test_viterbi_takes_the_best_sum(model):
    unigram = P.Vocabulary(model.pieces, model.scores, "unigram", model.byte_ids, model.ids)
    words = sorted(["hello", "help", "helping", "▁the", "▁there", "x"])
    for word, ids in zip(words, P.encode_sorted(unigram, words)):
        def best(rest):
            if not rest:
                return 0.0
            return max((unigram.scores[unigram.ids[rest[:k]]] + best(rest[k:])
                        for k in range(1, len(rest) + 1) if rest[:k] in unigram.ids))
        assert "".join(unigram.pieces[i] for i in ids) == word
        assert sum(unigram.scores[i] for i in ids) == pytest.approx(best(word))


def test_round_trip_of_whole_tables(spark, model, small, none):
    odd = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, "a▁b", "▁", None])],
                                "doc_id long, text string")
    for docs in (odd, small):
        rows = P.decode(P.encode(docs, model), model).collect()
        assert len(rows) == docs.count()
        assert all(r.decoded == r.text for r in rows)
        assert all((r.token_ids is None) == (r.text is None) for r in rows)
    assert "shard" in P.encode(small, model).columns
    assert P.encode(none, model).count() == 0


def test_a_small_cache_gives_the_same(model, monkeypatch):
    texts = _random_texts(30)
    want = [list(x) for x in P.encode_texts(model, texts, {})]
    monkeypatch.setattr(P, "CACHED_WORDS", 5)
    cache = {}
    got = [list(x) for t in texts for x in P.encode_texts(model, [t], cache)]
    assert got == want


def test_whole_table_has_the_ids_of_the_library(spark, sf_dir):
    from revlens.llm import queries
    library = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.pieces_query(spark, sf_dir).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    assert all(r.token_ids == library.encode(texts[r.doc_id]) for r in rows)


def test_blocks_give_the_ids_of_whole_texts(model):
    texts = [*TEXTS, "a▁b", "▁", "  x  y ", " "] + _random_texts(20)
    flat, bounds, joined = P.encode_block(model, [t.encode() for t in texts], {})
    want = [list(x) for x in P.encode_texts(model, texts, {})]
    assert [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    import pyarrow as pa
    table = pa.array(P.piece_bytes(model).tolist(), pa.large_binary())
    assert all(P._round_trips(table, flat, bounds, joined, [t.encode() for t in texts]))
    wrong = flat.copy()
    wrong[0] = 5
    assert not P._round_trips(table, wrong, bounds, joined, [t.encode() for t in texts])[1]
