from collections import Counter

from pyspark.sql import functions as F

from revlens.llm import sharding as S


def _shards(spark, tree, n=6000):
    ids = spark.range(n).withColumnRenamed("id", "k")
    return {r.k: r.shard for r in S.with_shard(ids, "k", tree).collect()}


def test_a_new_region_takes_rows_only_into_itself(spark):
    tree = S.uniform_tree(24)
    before, after = _shards(spark, tree), _shards(spark, S.grown(tree))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {24}
    assert abs(len(moved) / len(before) - 1 / 25) < 0.01


def test_weight_changes_move_rows_only_through_their_subtree(spark):
    tree = S.uniform_tree(24)
    before, after = _shards(spark, tree), _shards(spark, S.reweighted(tree, 5, 0.0))
    where = {s.shard: (s.region, s.rack) for s in tree}
    for k in before:
        if before[k] != after[k]:
            # a row leaves the region, the rack, or the shard that lost weight
            assert where[before[k]][0] == where[5][0]
            if where[after[k]][0] == where[before[k]][0]:
                assert where[before[k]][1] == where[5][1]
    assert 5 not in after.values()


def test_shares_follow_weights(spark):
    tree = S.reweighted(S.uniform_tree(8), 0, 3.0)
    counts = Counter(_shards(spark, tree, 20000).values())
    assert abs(counts[0] / 20000 - 0.3) < 0.02 and abs(counts[7] / 20000 - 0.1) < 0.02


def test_slots_have_no_gaps_and_repeated_rows_get_their_own(spark, small, none):
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = S.shard_documents(small.select("doc_id", "text").union(hot), S.uniform_tree(3), blocks=16)
    got = rows.collect()
    assert len(got) == small.count() + 3000
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert {r.size for r in got if r.id == 1} == {8} and {r.text_crc32 for r in got if r.id == 1} == {0}
    assert S.shard_documents(none, S.uniform_tree(3)).count() == 0
