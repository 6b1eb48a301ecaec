"""Structured Streaming forms of the loads.

Sources are Parquet file streams; sinks are Parquet (append) or
`foreachBatch` loads into a versioned table.  Every query has its own
checkpoint folder under the shared folder, so a restarted job resumes
where it stopped (exactly-once file sink).  `availableNow` processes what
is there and stops, which is how a scheduled incremental load runs.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maplift.operators.load import append_new_facts, keep_latest


def file_stream(spark: SparkSession, path: str, schema: T.StructType,
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A table as a stream of its files: `path` is its folder of part files, or a single file.

    The path is given as a pattern that matches only itself, which is how a file
    source takes both."""
    folder, _, name = path.rstrip("/").rpartition("/")
    path = f"{folder}/[{name[0]}]{name[1:]}"
    r = spark.readStream.schema(schema).format("parquet")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.load(path)


def _to_event_time(df: DataFrame, ts_col: str) -> DataFrame:
    """Watermarks need TIMESTAMP (with zone); zone-less input is read as UTC."""
    if isinstance(df.schema[ts_col].dataType, T.TimestampNTZType):
        return df.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return df


def run_available(df: DataFrame, sink: str, checkpoint: str, fmt: str = "parquet") -> None:
    q = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink))
    q.awaitTermination()
    if q.exception() is not None:  # pragma: no cover
        raise q.exception()


def fact_incremental_stream(stream: DataFrame, ts_col: str, key: Sequence[str], lateness: str) -> DataFrame:
    """J2 without a table: rows older than (max event time seen - lateness) are
    dropped as late, and a key already seen within the watermark is
    dropped as a duplicate.  State holds keys only up to the watermark, so a key that comes again
    later than that passes; `fact_incremental_to_table` remembers all loaded keys."""
    ev = _to_event_time(stream, ts_col).withWatermark(ts_col, lateness)
    return ev.dropDuplicatesWithinWatermark(list(key))


def fact_incremental_to_table(stream: DataFrame, root: str, checkpoint: str, ts_col: str, key: Sequence[str],
                              lateness: str) -> None:
    """J2 stream form against the loaded table: each micro-batch is joined with the current version at `root`, so a key that
    was loaded at any time is never loaded again, whatever its new event time, and rows older than
    (greatest loaded event time - lateness) are late -- as in the batch form.

    The line of a batch's version names the stream and the batch: a batch that is run again after a failure finds its own
    line and adds nothing.  The first batch of a new table loads each key once."""
    def append_batch(batch: DataFrame, epoch: int) -> None:
        append_new_facts(batch.select(*stream.columns), root, ts_col, key, lateness, f"{checkpoint.rstrip('/')}#{epoch}")
    q = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(append_batch).trigger(availableNow=True).start())
    q.awaitTermination()


def feed_entries(stream: DataFrame) -> DataFrame:
    """Events -> run feed entries (append-only; no array rewrite)."""
    kinds = F.array(*[F.lit(k) for k in ["thought", "tool_call", "tool_result", "tool_error"]])
    return stream.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), "ts",
                         F.element_at(kinds, (F.col("event_id") % 4 + 1).cast("int")).alias("kind"),
                         F.col("event_type").alias("text"))


def known_updates(updates: DataFrame, runs: DataFrame) -> DataFrame:
    """A stream-static semi-join drops the writes to unknown runs."""
    return updates.join(runs.select("run_id"), "run_id", "left_semi")


def run_latest_to_table(updates: DataFrame, root: str, checkpoint: str, key: Sequence[str], order_col: str,
                        buckets: int | None = None) -> None:
    """J4 stream form: each micro-batch is reduced to its latest row per key and merged into the buckets of the
    table at `root` that its keys are in, so a batch costs its own rows and those buckets, not the
    table, and no state is kept between batches.  Merging a batch again (after a restart) changes nothing,
    since the greatest `order_col` wins."""
    def merge_batch(batch: DataFrame, epoch: int) -> None:
        keep_latest(batch.sparkSession, root, batch.select(*updates.columns), key, order_col, buckets)
    q = (updates.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(merge_batch).trigger(availableNow=True).start())
    q.awaitTermination()
