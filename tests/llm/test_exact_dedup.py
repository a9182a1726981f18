import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from revlens.llm import exact_dedup as E


def _brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep))
    return sorted(out, key=repr)


def _got(df):
    return sorted(((r.id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


@pytest.mark.parametrize("digest", [E.sha256_hex, lambda t: F.substring(F.md5(t), 1, 1)])
def test_groups_match_brute_force_also_when_digests_collide(small, digest):
    rows = [(r.doc_id, r.text) for r in small.collect()]
    assert _got(E.exact_groups(small, digest=digest, salts=4)) == _brute(rows)


def test_a_hot_group_is_one_group(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(
        F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("text"))
    got = E.exact_groups(docs).filter("group_size > 1").collect()
    assert len(got) == 1334 and {(r.keep_id, r.group_size) for r in got} == {(3999, 1334)}
    assert got[0].digest == hashlib.sha256(b"hot").hexdigest()
    assert E.drop_exact_copies(docs).count() == 4000 - 1333


def test_empty(none):
    assert E.exact_groups(none).count() == 0
