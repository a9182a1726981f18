import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from revlens.llm import registry
from tests.llm.test_near_dup import _brute

ROOT = Path(__file__).resolve().parents[2]


def test_stages_take_effect_and_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir).checkpoint()
        if k < 4:
            assert out.columns == columns
        if name == "minhash_near_dup":
            rows = [(r.doc_id, r.text) for r in docs.collect()]
            assert {r.doc_id for r in out.collect()} == {i for i, x in _brute(rows).items() if x[2]}
        if name == "line_dedup":
            lengths = [(r.n_chars, len(r.text)) for r in out.collect()]
            assert all(a == b for a, b in lengths)
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0 and counts[1] < counts[0]
    ran = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert ran == {r.doc_id: r.token_ids for r in docs.collect()}


def test_registry_has_all_queries():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(registry.oracle_sql()) <= names


def test_the_entry_point_works_without_the_subpackage():
    code = ("import sys; sys.modules['revlens.llm'] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), [q for q in e.queries() if q.startswith('op')])")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.split() == ["55", "[]"], out.stderr
