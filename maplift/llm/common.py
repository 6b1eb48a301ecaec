"""Helpers shared by the operators: table reads, staging, batch slicing, slot filters."""
from __future__ import annotations

import os
import tempfile
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maplift.session import fresh_path

#: Bytes of text that one numpy pass works on at a time (a single longer text is taken alone).
SLICE_BYTES = 1 << 18
#: Rows of an Arrow batch; long documents make batches of many rows too large for a worker.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on, and this package's code for the workers."""
    ship_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int) -> Iterator[None]:
    """Arrow batches of at most so many rows and about so many bytes, for what is computed inside the block."""
    asked = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in asked}
    for k, v in asked.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def ship_code(spark: SparkSession) -> None:
    """Send the package to the executors once per context (they need not have it installed)."""
    sc = spark.sparkContext
    if getattr(sc, "_maplift_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="maplift-code-"), "maplift_code.zip")  # served by the driver
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    sc._maplift_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """What is made and run inside the block gives the disk of its shuffles back when it ends, not when the driver collects garbage."""
    asked = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(asked, None)
    spark.conf.set(asked, "true")
    try:
        yield
    finally:
        spark.conf.unset(asked) if before is None else spark.conf.set(asked, before)


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there."""
    spark = df.sparkSession
    path = fresh_path(spark, f"llm-{name}")
    with shuffles_freed(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names; null text is empty."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _field(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def carried(documents: DataFrame) -> DataFrame:
    """(rest, text, doc_id): all columns but text in a struct, out of the way of an operator's own names."""
    rest = F.struct(*(F.col(_field(c)).alias(c) for c in documents.columns if c != "text"))
    return documents.select(rest.alias("rest"), "text", F.col("doc_id").cast("long").alias("doc_id"))


def restored(df: DataFrame, columns: list[str], *added: str) -> DataFrame:
    """The columns of ``carried`` under their names and in their order, and added ones (in place of columns so named)."""
    own = [c for c in columns if c not in added]
    return df.select(*(F.col("text") if c == "text" else F.col(f"rest.{_field(c)}").alias(c) for c in own), *added)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of at most ``limit`` bytes of text (or one row)."""
    n = batch.num_rows
    if not n:
        return
    off = text_offsets(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_offsets(col: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    raw = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)
    return raw[col.offset: col.offset + len(col) + 1].astype(np.int64)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offsets start at 0."""
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = text_offsets(col)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8)[off[0]: off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


# ---------------------------------------------------------------- slot filter
SLOT_BITS = 26
_CHUNK_BITS = 17


def slot_filter(keys: DataFrame, key: str, bits: int = SLOT_BITS) -> bytes:
    """A bitmap of 2**bits bits marking ``pmod(key, 2**bits)`` of every key, compressed (see ``opened``).

    Its size (8 MB at most) does not depend on the data, so it may be sent to every
    task.  It only spares rows of later joins; a full bitmap spares none and
    changes no result.
    """
    chunks = 1 << (bits - _CHUNK_BITS)
    slot = F.col(key).bitwiseAND(F.lit((1 << bits) - 1))
    with shuffles_freed(keys.sparkSession):
        parts = (keys.select(F.shiftright(slot, _CHUNK_BITS).cast("int").alias("chunk"),
                             slot.bitwiseAND(F.lit((1 << _CHUNK_BITS) - 1)).cast("int").alias("bit"))
                 .mapInArrow(_partial_bitmaps, "chunk int, bits binary")
                 .repartition("chunk").mapInArrow(_merged_bitmaps, "chunk int, bits binary"))
        rows = parts.collect()  # at most 2**bits bits
    out = np.zeros(chunks << (_CHUNK_BITS - 3), np.uint8)
    step = 1 << (_CHUNK_BITS - 3)
    for row in rows:
        out[row.chunk * step: (row.chunk + 1) * step] |= np.frombuffer(zlib.decompress(row.bits), np.uint8)
    return zlib.compress(out.tobytes(), 1)


def opened(known, dtype=np.uint8) -> np.ndarray:
    """The array of a broadcast that holds compressed bytes."""
    return np.frombuffer(zlib.decompress(known.value), dtype)


def _partial_bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[int, np.ndarray] = {}
    for b in batches:
        chunk, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
        for c in np.unique(chunk):
            m = maps.setdefault(int(c), np.zeros(1 << _CHUNK_BITS, bool))
            m[bit[chunk == c]] = True
    if maps:
        yield pa.record_batch([pa.array(list(maps), pa.int32()),
                               pa.array([zlib.compress(np.packbits(m, bitorder="little").tobytes(), 1)
                                         for m in maps.values()], pa.binary())], names=["chunk", "bits"])


def _merged_bitmaps(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    maps: dict[int, np.ndarray] = {}
    for b in batches:
        for c, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            part = np.frombuffer(zlib.decompress(raw), np.uint8)
            maps[c] = maps[c] | part if c in maps else part
    if maps:
        yield pa.record_batch([pa.array(list(maps), pa.int32()),
                               pa.array([zlib.compress(m.tobytes(), 1) for m in maps.values()], pa.binary())],
                              names=["chunk", "bits"])


def in_filter(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which (u)int64 keys have their slot set."""
    slot = keys.astype(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


ID_SLOTS = 1 << 20


def _slot(col: str) -> Column:
    return F.pmod(F.xxhash64(col), F.lit(ID_SLOTS))


def _slots(ids: DataFrame, col: str) -> DataFrame:
    """The slots of ids: at most ID_SLOTS longs (8 MB), whatever the input, so they may be broadcast."""
    return F.broadcast(ids.where(F.col(col).isNotNull()).select(_slot(col).alias("_slot")).distinct())


def only_ids(docs: DataFrame, ids: DataFrame, col: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id may be in ``ids`` (a superset, by slot), without a shuffle of ``docs``."""
    return docs.withColumn("_slot", _slot(col)).join(_slots(ids, col), "_slot", "left_semi").drop("_slot")


def by_slot(docs: DataFrame, ids: DataFrame, col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows whose id may be in ``ids``, rows whose id is not): only the first need a join on the id."""
    slots = _slots(ids, col)
    keyed = docs.withColumn("_slot", F.when(F.col(col).isNotNull(), _slot(col)))
    return (keyed.join(slots, "_slot", "left_semi").drop("_slot"),
            keyed.join(slots, "_slot", "left_anti").drop("_slot"))
