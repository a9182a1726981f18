"""Merkle manifest against a plain rebuild of the whole tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from revlens.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _leaf(row):
    return _hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def _rebuilt(nodes):
    while len(nodes) > 1:
        nodes = [_hash("".join(nodes[i:i + 8])) for i in range(0, len(nodes), 8)]
    return nodes[0]


def _root(leaves_by_lang):
    order = sorted(leaves_by_lang, key=lambda k: (k is not None, (k or "").encode()))
    return _rebuilt([_rebuilt(leaves_by_lang[k]) for k in order])


def _table(spark, n, langs):
    rows = [(i, f"s{i % 3}", langs[i % len(langs)], None if i % 7 == 0 else i,
             None if i % 11 == 0 else "" if i % 13 == 0 else f"Some TEXT Ä {i}") for i in range(n)]
    return rows, spark.createDataFrame(
        rows, "doc_id long, source string, lang string, n_chars int, text string")


def _manifest(df, **kw):
    return merkle.manifest(merkle.leaves(df, FIELDS, **kw))


@pytest.mark.parametrize("n,langs", [(1, ["en"]), (2, ["en", None]), (9, ["en"]), (64, ["de"]),
                                     (65, ["de"]), (700, ["en", "en", "de", None, ""]),
                                     (90, [f"l{i}" for i in range(70)])])
def test_every_fold_equals_a_rebuilt_tree(spark, n, langs):
    rows, df = _table(spark, n, langs)
    lowered = F.lower("text")
    out = {r.id: r for r in _manifest(df, changed={"text": lowered},
                                      where=F.col("doc_id") % 2 == 0).collect()}
    assert len(out) == n
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(_leaf(r))
    root = _root(by)
    for r in (rows if n < 100 else rows[::37]):
        got = out[r[0]]
        other = r[:4] + (None if r[4] is None else r[4].lower(),) if r[0] % 2 == 0 else r
        mine = [_leaf(other) if x == _leaf(r) else x for x in by[r[2]]]
        assert (got.leaf, got.root, got.subroot) == (_leaf(r), root, _rebuilt(by[r[2]]))
        assert got.folded_root == _root({**by, r[2]: mine})


def test_proofs_verify_without_the_tree(spark):
    _, df = _table(spark, 300, ["en", "de", None])
    out = _manifest(df)
    again = out.select((merkle.proven_root(F.col("leaf"), F.col("proof")) == F.col("root")).alias("ok"),
                       (F.col("folded_root") == F.col("root")).alias("same"))
    assert again.filter("ok and same").count() == 300


def test_states_before_slots_resume():
    children = [_hash(str(i)).encode() for i in range(8)]
    parent = merkle.Parent(children)
    assert len(parent.states) == 8
    for slot in range(8):
        new = _hash("new").encode()
        whole = hashlib.sha256(b"".join([*children[:slot], new, *children[slot + 1:]])).hexdigest()
        assert parent.fold(slot, new).decode() == whole
        assert parent.fold(slot, children[slot]) == parent.digest


def test_nulls_repeats_long_texts_and_clashing_columns(spark, small):
    docs = small.withColumns({"lang": F.col("n"), "source": F.lit(None).cast("string"),
                              "n_chars": F.length("text"), "key": F.lit("k"), "pos": F.lit(1),
                              "leaf": F.lit("l"), "_tie": F.lit(0)})
    rows = _manifest(docs).collect()
    assert len(rows) == docs.count()
    leaves = [_leaf(tuple(r[c] for c in FIELDS)) for r in docs.collect()]
    assert sorted(r.leaf for r in rows) == sorted(leaves)
    assert sorted(r.pos for r in rows) == list(range(len(leaves)))
    ordered = [r.leaf for r in sorted(rows, key=lambda r: r.pos)]
    assert {r.root for r in rows} == {_rebuilt(ordered)} == {r.folded_root for r in rows}


def test_equal_rows_and_a_hot_group(spark):
    df = spark.range(2000).select((F.col("id") % 3).alias("doc_id"), F.lit("s").alias("source"),
                                  F.lit("en").alias("lang"), F.lit(1).alias("n_chars"),
                                  F.lit("same").alias("text"))
    out = _manifest(df)
    assert out.count() == 2000 and out.select("root").distinct().count() == 1
    assert out.select("pos").distinct().count() == 2000


def test_empty(spark, none):
    docs = none.withColumns({c: F.lit(None).cast("string") for c in ("source", "lang", "n_chars")})
    assert _manifest(docs).collect() == []


def test_tampered_documents_are_the_unverified_ones(spark, sf_dir):
    from revlens.llm import queries
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.merkle_query(spark, sf_dir).collect():
        text = docs[r.doc_id]
        tampered = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None \
            and any("A" <= c <= "Z" for c in text)
        assert r.verified == (not tampered)
