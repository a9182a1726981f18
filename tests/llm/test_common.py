import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from revlens.llm.common import (BATCH_BYTES, RELEASE, arrow_map, bound_batches, checkpointed,
                                checkpointed_count)


@pytest.fixture
def shuffle_files(spark):
    """The shuffle files on this session's local disks."""
    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    folders = [Path(d.getPath()) for d in manager.localDirs()]
    return lambda: {f.name for d in folders for f in d.rglob("shuffle_*")}


def _left(shuffle_files, before, seconds=20):
    """New shuffle files; Spark removes them a moment after the run."""
    end = time.time() + seconds
    while (left := shuffle_files() - before) and time.time() < end:
        time.sleep(0.2)
    return left


def _counted(spark):
    return spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().join(
        spark.range(7).withColumnRenamed("id", "k").hint("merge"), "k")


def test_a_checkpoint_keeps_no_shuffle_files(spark, shuffle_files):
    frame = _counted(spark)             # still referred to: no garbage collection may help
    before = shuffle_files()
    written = checkpointed(frame)
    assert not _left(shuffle_files, before)
    assert sorted(written.collect()) == sorted(frame.collect()) == sorted(written.collect())
    assert sum(r["count"] for r in frame.collect()) == 1000


def test_counting_checkpoints_keep_none_either(spark, shuffle_files):
    frame, before = _counted(spark), shuffle_files()
    written, n = checkpointed_count(frame, F.col("k") > 2)
    assert not _left(shuffle_files, before)
    assert n == 4 and len(written.collect()) == 7


def test_other_runs_of_the_session_keep_their_files(spark, shuffle_files):
    was = spark.conf.get(RELEASE)
    checkpointed(_counted(spark))
    assert spark.conf.get(RELEASE) == was
    frame, before = _counted(spark), shuffle_files()
    frame.collect()
    assert shuffle_files() - before


def test_the_setting_returns_after_a_failure(spark):
    was = spark.conf.get(RELEASE)
    with pytest.raises(Exception, match="no such row"):
        checkpointed(spark.range(3).select(F.raise_error(F.lit("no such row"))))
    assert spark.conf.get(RELEASE) == was


def test_batches_for_python_are_bounded_by_their_bytes(spark):
    def sizes(batches):
        import pyarrow as pa
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])],
                                             names=["rows", "bytes"])

    own = spark.newSession()            # a setting of the session alone
    bound_batches(own)
    texts = own.range(0, 6000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = arrow_map(texts, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 6000
    assert max(r["bytes"] for r in got) < 5 << 20


def test_a_bound_that_the_session_names_stays(spark):
    own = spark.newSession()
    own.conf.set(BATCH_BYTES, "1m")
    bound_batches(own)
    assert own.conf.get(BATCH_BYTES) == "1m"
