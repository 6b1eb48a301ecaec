"""J5 / F3 as a stream: routing of runs as their attempts arrive, with a timer per run.

A run's state is its number of attempts, its last error, that attempt's place and the latest event time; it is the run's row
of the table, so a micro-batch is one aggregation and one merge into the buckets that it changes.  A run that should be
tried again but gets no attempt for `patience` of event time is `failed`: nothing waits for ever.  An attempt that
comes after that is counted on.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift.model import MAX_ATTEMPTS
from maplift.operators.load import merge_by_key, snapshot, written_once

_STATE = ["attempt", "seq", "error", "ms"]


def watermark_ms(latest_ms: int | None, lateness: str) -> Column:
    """The event time (ms) up to which nothing more is waited for; NULL before the first event."""
    return F.unix_millis(F.timestamp_millis(F.lit(latest_ms).cast("long")) - F.expr(f"INTERVAL {lateness}"))


def routed(state: DataFrame, watermark: Column, patience_ms: int, max_attempts: int) -> DataFrame:
    """J5 for each run's state (as `history.attempt_routing` says it), and the timer of those to be tried again."""
    waited = F.coalesce(F.col("ms") + F.lit(patience_ms) < watermark, F.lit(False))
    route = (F.when(F.col("error") == "", "review").when(F.col("attempt") >= max_attempts, "escalate")
             .when(waited, "failed").otherwise("retry"))
    return state.withColumn("route", route)


def merge_attempts(batch: DataFrame, root: str, keys: Sequence[str], ts_col: str, lateness: str, patience_ms: int,
                   max_attempts: int, note: str) -> str | None:
    """Count a micro-batch of (keys, seq, error, event time) into the table at `root`, once per `note`.

    Rows up to the watermark of the batches before are late and dropped.  The watermark then moves on, and runs of the table whose
    time is over by it are routed anew beside those of the batch; other buckets are neither read whole nor written."""
    spark, keys = batch.sparkSession, list(keys)
    versions, table = snapshot(spark, root)
    if any(v.note == note for v in versions):
        return None
    seen = None if table is None else table.agg(F.max("ms")).first()[0]
    at = F.col(ts_col).cast("timestamp")
    if seen is not None:
        batch = batch.where(F.coalesce(at > F.timestamp_millis(watermark_ms(seen, lateness)), F.lit(True)))
    last = F.max_by(F.struct("error"), F.struct("seq"))
    fresh = (batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("attempt"), F.max("seq").alias("seq"), last.alias("_l"),
                                      F.coalesce(F.max(F.unix_millis(at)), F.lit(0)).alias("ms"))
             .select(*keys, "attempt", "seq", F.col("_l.error").alias("error"), "ms"))
    fresh, stats = written_once(fresh, root, n=F.count(F.lit(1)), ms=F.max("ms"))
    latest = max((x for x in (seen, stats["ms"]) if x is not None), default=None)
    mark, changes = watermark_ms(latest, lateness), fresh
    if table is not None:
        due = table.where((F.col("route") == "retry") & (F.col("ms") + F.lit(patience_ms) < mark))
        due, over = written_once(due.select(*keys), root, n=F.count(F.lit(1)))
        if not stats["n"] + over["n"]:
            return None
        none = [F.lit(0).cast("long").alias("attempt"), *(F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in _STATE[1:])]
        changes = fresh.unionByName(due.select(*keys, *none)) if over["n"] else fresh

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = (old.select(*keys, *_STATE, F.lit(0).alias("_age"))
                .unionByName(new.select(*keys, *_STATE, F.when(F.col("attempt") > 0, 1).otherwise(-1).alias("_age"))))
        last = F.max_by(F.struct("error"), F.struct("seq", "_age"))
        state = both.groupBy(*keys).agg(F.sum("attempt").alias("attempt"), F.max("seq").alias("seq"), last.alias("_l"), F.max("ms").alias("ms"))
        state = state.select(*keys, "attempt", "seq", F.col("_l.error").alias("error"), "ms")
        return routed(state, mark, patience_ms, max_attempts)
    if table is None:
        changes = routed(changes, mark, patience_ms, max_attempts)
    return merge_by_key(spark, root, changes, keys, merge, versions=versions, note=note)


def route_attempts_to_table(attempts: DataFrame, root: str, checkpoint: str, keys: Sequence[str], ts_col: str, lateness: str,
                            patience_ms: int, max_attempts: int = MAX_ATTEMPTS) -> None:
    """Keep state and route of every run in the table at `root`; a batch that is run again changes nothing.

    `attempts` has the keys, `seq` (their order), `error` ('' for none) and the event time."""
    def merge_batch(batch: DataFrame, epoch: int) -> None:
        merge_attempts(batch.select(*attempts.columns), root, keys, ts_col, lateness, patience_ms, max_attempts,
                       f"{checkpoint.rstrip('/')}#{epoch}")
    q = (attempts.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(merge_batch).trigger(availableNow=True).start())
    q.awaitTermination()
