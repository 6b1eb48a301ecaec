"""Training samples and held-out marks for the classifiers."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maplift.llm.common import staged, texts_of


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled documents that are not held out, each distinct text once.

    Rows are taken in the order of a hash of their id, so the sample is spread over all
    labels and the same at every run.  The ids taken are at most ``bound`` longs, hence the
    broadcast; only the sampled texts leave their place.
    """
    ids = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
           .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
           .groupBy("doc_id").agg(F.max("label").alias("label"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    found = texts_of(documents).join(F.broadcast(ids), "doc_id").select("label", "text")
    once = found.withColumn("h", F.sha2("text", 256)).groupBy("h").agg(F.max("label").alias("label"), F.first("text").alias("text"))
    return staged(once.select("label", "text").repartition(16), f"sample-{label}")
