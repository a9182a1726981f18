"""S4 as a stream: files landing in a folder are loaded into the typed sales
table with the Q5 gate, exactly once.

The reference bulk-loads one exported CSV into its table.  When exports keep
arriving, the same step is a Structured Streaming file source: each new file
is parsed with the fixed schema (positional binding, header skipped),
validated, and written by ``foreachBatch`` — accepted rows to the table,
rejected and malformed rows with their reasons to a quarantine folder.  A
batch is parsed and judged once, and both results overwrite the batch's own
partition (``batch_id=n``).  The checkpoint location (in the shared checkpoint
folder on a cluster) records which batches were committed; a batch that failed
between its two writes is written again to the same partitions, so a restarted
query neither skips nor repeats a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from revlens.operators.ordered import materialize
from revlens.operators.quality import split_by_reasons, with_reasons
from revlens.schema import SALES_SCHEMA
from revlens.sources.sheets import csv_with_corrupt


def stream_sales_files(spark: SparkSession, landing_dir: str, max_files_per_trigger: int = 100
                       ) -> DataFrame:
    """Streaming DataFrame over CSV exports landing in ``landing_dir``."""
    return (csv_with_corrupt(spark.readStream)
            .option("maxFilesPerTrigger", max_files_per_trigger).csv(landing_dir))


def incremental_load(spark: SparkSession, landing_dir: str, table_dir: str,
                     quarantine_dir: str, checkpoint_location: str,
                     available_now: bool = True) -> StreamingQuery:
    """Start the load; with ``available_now`` it processes every file present
    and stops (batch-like runs on a schedule), otherwise it keeps listening."""

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        accepted, quarantined = split_by_reasons(materialize(with_reasons(batch, SALES_SCHEMA)))
        accepted.write.mode("overwrite").parquet(f"{table_dir}/batch_id={batch_id}")
        (quarantined.withColumn("reasons", F.concat_ws(";", "reasons"))
         .write.mode("overwrite").parquet(f"{quarantine_dir}/batch_id={batch_id}"))

    writer = (stream_sales_files(spark, landing_dir).writeStream
              .foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="1 minute")
    return writer.start()
