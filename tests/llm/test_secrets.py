import hashlib
import random
import re
import string

from revlens.llm import secrets as S
from revlens.llm.queries import secrets_query

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def _brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def test_query_matches_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in
             spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in secrets_query(spark, sf_dir).collect():
        want = _brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(want.count(k + ":") for k in S.KINDS[:3])
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))


def test_positions_are_code_points_and_short_values_are_consumed(spark, none):
    texts = ["éé🙂 password = 'abcdef12'", "token=token: abcdefgh", "Token:abc SECRET = abcdefg",
             "AKIA" + "A" * 16 + " AKIAAKIA", "f" * 23 + " " + "0" * 24, "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.id: ",".join(f"{S.KINDS[s.kind]}:{s.start}:{s.end}" for s in r.base)
           for r in S.scan(docs, [0.0] * len(S.ALPHABET) ** 2).collect()}
    assert got == {i: _brute(t or "") for i, t in enumerate(texts)}
    assert S.scan(none, [0.0] * len(S.ALPHABET) ** 2).count() == 0


def test_models_tell_random_strings_from_identifiers(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = S.train(S.labelled_samples(docs))
    rnd = random.Random(5)
    random_ones = ["".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(32))
                   for _ in range(200)]
    ordinary = ["theWordsOfAnIdentifierName", "the_words_of_an_identifier_name",
                "and/the/words/of/the/path/here", "THE_WORDS_OF_THE_CONSTANT"] * 5
    rows = [(i, "x " + t + " y") for i, t in enumerate(random_ones + ordinary)]
    found = {r.id for r in S.scan(spark.createDataFrame(rows, "doc_id long, text string"), model)
             .collect() if r.spans}
    assert len([i for i in found if i < 200]) >= 190
    assert not [i for i in found if i >= 200]
