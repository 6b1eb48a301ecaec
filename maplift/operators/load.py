"""Loads into a target table: full refresh (A5), append (A6), positional
insert (A7), declared types (A9), Type-1 upsert (J1), incremental append
with late data (J2), incremental filter (C3), partitioned load (J6).

A target is a folder in the shared storage holding immutable data folders
(`v-<id>/`) and a version log, `versions_log/version=<n>/`, of one line per
version: `refresh <folder>` (readers see that folder only), `append <folder>`
(readers see it beside what they saw before) or `replace <folder> <parts>`
(of a table that is dealt into parts, the named parts are read from the new folder
and the others from where they were).  A load writes its folder, audits
it, and only then adds its line, so readers see the old or the new version,
never half of one.  Two writers that start from the same version both try
for the next number; the file stored first counts, the other writer finds
that out and raises.  Nothing is overwritten or deleted.

Parts are the folders of one partition column: a date (J6), or `_bucket`, the hash of a
key (J1, J4), which readers do not see.  Upserts and replacements write only the parts
that their change set has rows for.
"""
from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maplift.functions.rules import declared_value


#: The hidden partition column of tables dealt by a key; rows of a bucket, and buckets, where no number is given.
BUCKET, BUCKET_ROWS, MOST_BUCKETS = "_bucket", 1 << 20, 4096


class LoadError(RuntimeError):
    pass


def _log(root: str) -> str:
    return f"{root.rstrip('/')}/versions_log"


class Version(NamedTuple):
    number: int
    kind: str
    folder: str
    parts: str = ""  # <layout>:<value>=<rows>,<value>=<rows>,...
    note: str = ""  # what the writer wants to find again, as the batch of a stream


def _versions(spark: SparkSession, root: str) -> list[Version]:
    """All committed versions in order; empty when the table is new.

    Only a missing log means a new table; any other read error is passed on."""
    try:
        log = spark.read.schema("value string, version int").option("basePath", _log(root)).text(_log(root))
        lines = log.select("version", F.col("_metadata.file_modification_time").alias("at"), "value").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    first = {v: line for v, _, line in sorted(lines, reverse=True)}  # of writers of one number, who came first
    return [Version(v, *first[v].split("\t")) for v in sorted(first)]


class View(NamedTuple):
    """What readers of a version see: whole folders, and parts by their folder (all of one layout)."""
    whole: list[str]
    layout: str
    parts: dict[str, str]
    rows: dict[str, int]

    def part_paths(self, values: Sequence[str] | None = None) -> list[str]:
        column = self.layout.split("/")[0]
        return [f"{self.parts[v]}/{column}={v}" for v in sorted(self.parts) if values is None or v in values]

    def read(self, spark: SparkSession) -> DataFrame:
        reads = [spark.read.parquet(*self.whole)] if self.whole else []
        if self.layout.startswith(BUCKET):
            reads += [spark.read.parquet(*self.part_paths())] if self.parts else []
        else:  # the partition column is a column of the table
            for folder in dict.fromkeys(self.parts.values()):
                mine = [v for v, f in self.parts.items() if f == folder]
                reads.append(spark.read.option("basePath", folder).parquet(*self.part_paths(mine)))
        out = reads[0]
        for r in reads[1:]:
            out = out.unionByName(r)
        return out


def _view(versions: list[Version]) -> View | None:
    last = max((i for i, v in enumerate(versions) if v.kind == "refresh"), default=0)
    whole, layout, parts, rows = [], "", {}, {}
    for v in versions[last:]:
        if not v.parts:
            whole.append(v.folder)
            continue
        layout, _, values = v.parts.partition(":")
        for value, _, n in (x.partition("=") for x in values.split(",")):
            parts[value], rows[value] = v.folder, int(n)
    return View(whole, layout, parts, rows) if whole or parts else None


def current_files(spark: SparkSession, root: str) -> list[str] | None:
    """The data folders of the latest committed version; None when there is none."""
    view = _view(_versions(spark, root))
    return view and [*view.whole, *view.part_paths()]


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder the latest version was created with (its first folder)."""
    files = current_files(spark, root)
    return files[0] if files else None


def read_current(spark: SparkSession, root: str) -> DataFrame:
    view = _view(_versions(spark, root))
    if not view:
        raise LoadError(f"table {root} has no committed version")
    return view.read(spark)


def snapshot(spark: SparkSession, root: str) -> tuple[list[Version], DataFrame | None]:
    """The log and the rows of its latest version (None when there is none), of one reading."""
    versions = _versions(spark, root)
    view = _view(versions)
    return versions, view and view.read(spark)


def noted_batches(spark: SparkSession, root: str) -> set[str]:
    """The notes of all committed versions (a line per version)."""
    return {v.note for v in _versions(spark, root) if v.note}


def _commit(spark: SparkSession, root: str, kind: str, folder: str, base: int, parts: str = "", note: str = "") -> None:
    """Add the line of version `base + 1`; raises when another writer's came first."""
    text = "\t".join([kind, folder, parts, note]).rstrip("\t")
    line = spark.createDataFrame([(text,)], "value string").coalesce(1)
    line.write.mode("append").text(f"{_log(root)}/version={base + 1}")
    won = {v.number: v.folder for v in _versions(spark, root)}.get(base + 1)
    if won != folder:
        raise LoadError(f"another load of {root} was committed first; this one is not visible")


def _base(spark: SparkSession, root: str) -> int:
    return max((v.number for v in _versions(spark, root)), default=0)


def commit_version(spark: SparkSession, root: str, folder: str) -> None:
    """Make a folder that is already written the table's content."""
    _commit(spark, root, "refresh", folder, _base(spark, root))


def new_version_path(root: str) -> str:
    return f"{root.rstrip('/')}/v-{uuid.uuid4().hex[:16]}"


# Declared table shape.  Spark does not enforce NOT NULL on Parquet, so
# the audit (E4) is the enforcement; here values are cast to the declared types and held to declared lengths.
def conform(df: DataFrame, declared: T.StructType | Mapping[str, str | T.DataType]) -> DataFrame:
    """Cast to the declared types, in declared order (a StructType, or
    name -> type name / DataType).  A text longer than its `VARCHAR(n)` aborts the load, as an insert would."""
    pairs = ([(f.name, f.dataType) for f in declared.fields] if isinstance(declared, T.StructType)
             else list(declared.items()))
    return df.select(*[declared_value(F.col(n), t, n).alias(n) for n, t in pairs])


# The insert column list is the active rows' target fields in order.
def to_target_columns(df: DataFrame, fields: Sequence[str], positional: bool = False) -> DataFrame:
    if positional:
        if len(df.columns) != len(fields):
            raise LoadError(f"{len(df.columns)} columns for {len(fields)} target fields")
        return df.toDF(*fields)
    missing = [f for f in fields if f not in df.columns]
    if missing:
        raise LoadError(f"columns not produced by the select: {', '.join(missing)}")
    return df.select(*fields)


Check = Callable[[DataFrame], None]


def _observed(df: DataFrame, stats: dict | None) -> tuple[DataFrame, Observation | None]:
    """E10 on the write itself: rows counted while they are written (no
    second pass)."""
    if stats is None:
        return df, None
    obs = Observation("load")
    return df.observe(obs, F.count(F.lit(1)).alias("rows_written")), obs


def _staged(df: DataFrame, root: str, check: Check | None, partition_by: Sequence[str], stats: dict | None) -> str:
    """Write a new data folder and run `check` on what was written; a failed check raises before any commit."""
    path = new_version_path(root)
    df, obs = _observed(df, stats)
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    if obs is not None:
        stats.update(obs.get)
    if check is not None:
        check(df.sparkSession.read.parquet(path))
    return path


def full_refresh_load(df: DataFrame, root: str, check: Check | None = None,
                      partition_by: Sequence[str] = (), stats: dict | None = None) -> str:
    """A5: write a new version, run `check` on what was written, then commit it.
    A failed check raises and leaves the old version current.
    With `stats`, the rows written are counted during the write."""
    base = _base(df.sparkSession, root)
    path = _staged(df, root, check, partition_by, stats)
    _commit(df.sparkSession, root, "refresh", path, base)
    return path


def append_load(df: DataFrame, root: str, check: Check | None = None, stats: dict | None = None, note: str = "",
                base: int | None = None) -> str:
    """The new rows go to a new folder, `check` sees that batch alone, then it
    is committed beside the current folders (or as the first version).  `base`: the version the rows were made for,
    if not the latest one."""
    base = _base(df.sparkSession, root) if base is None else base
    path = _staged(df, root, check, (), stats)
    _commit(df.sparkSession, root, "append", path, base, note=note)
    return path


# ------------------------------------------------------------------ parts
def _layout(column: str, key: Sequence[str] = (), n: int = 0) -> str:
    return "/".join([column, str(n), *key]) if key else column


def _dealt(df: DataFrame, key: Sequence[str], n: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))


def _values(df: DataFrame, column: str) -> dict[str, int]:
    """The values of a partition column as folders spell them, and their rows (a row per part reaches the driver)."""
    found = df.groupBy(F.col(column).cast("string").alias("v")).count().collect()
    return dict(sorted((r["v"] or "__HIVE_DEFAULT_PARTITION__", r["count"]) for r in found))


def _plain_names(values: Sequence[str]) -> bool:
    return all(re.fullmatch(r"[\w.-]+", v) for v in values)


def _load_parts(df: DataFrame, root: str, versions: list[Version], kind: str, layout: str, check: Check | None,
                note: str = "") -> str:
    """Write `df` in parts and commit them as the table's (`refresh`: all of them), after `check` has seen the version that makes.

    Rows are dealt by part: AQE splits a hot part over several tasks and merges small ones, so file sizes stay even
    without one task per part or one file per (task, part).
    No rows leave no part: replacing nothing makes no version, and an empty table is one folder without parts."""
    spark, column, stats = df.sparkSession, layout.split("/")[0], {}
    if layout.split("/")[:2] == [BUCKET, "1"]:  # one bucket: nothing to deal
        path = new_version_path(root)
        seen, obs = _observed(df.drop(BUCKET), stats)
        seen.write.mode("errorifexists").parquet(f"{path}/{BUCKET}=0")
        stats.update(obs.get)
        values = {"0": stats["rows_written"]}
    else:
        path, values = _staged(df.hint("rebalance", column), root, None, [column], stats), None
    line = Version(0, kind, path)
    if stats["rows_written"]:
        values = values or _values(spark.read.parquet(path), column)
        if not _plain_names(values):
            raise LoadError(f"values of {column} cannot name folders")
        line = line._replace(parts=f"{layout}:{','.join(f'{v}={n}' for v, n in values.items())}")
    elif kind == "replace":
        return path
    else:
        line = line._replace(folder=_staged(df.drop(BUCKET), root, None, (), None))
    if check is not None:
        check(_view([*versions, line]).read(spark))
    _commit(spark, root, kind, line.folder, max((v.number for v in versions), default=0), line.parts, note)
    return line.folder


def _bucket_number(rows: int) -> int:
    return max(1, min(MOST_BUCKETS, -(-rows // BUCKET_ROWS)))


def merge_by_key(spark: SparkSession, root: str, changes: DataFrame, key: Sequence[str],
                 merge: Callable[[DataFrame, DataFrame], DataFrame], check: Check | None = None, buckets: int | None = None,
                 versions: list[Version] | None = None, note: str = "") -> str:
    """Replace the buckets of a table that `changes` (already written, a row per key) has keys in by
    `merge(their rows, changes)`; the other buckets are neither read nor written.

    A new table, or one that is not dealt by this key yet, is written whole, in `buckets` parts; NULL keys have a bucket
    like others.  Without a number, buckets have about BUCKET_ROWS rows, and a table that has grown to four times
    that is dealt anew.  `versions`: the log as the caller read it."""
    versions = _versions(spark, root) if versions is None else versions
    view = _view(versions)
    key, kind = list(key), "refresh"
    table = view and view.read(spark)
    if view:
        types = {f.name: f.dataType for f in table.schema}
        changes = changes.select(*[F.col(c).cast(types[c]).alias(c) if c in key else F.col(c) for c in changes.columns])
        at = view.layout.split("/")
        if not view.whole and at[0] == BUCKET and at[2:] == key:
            rows = sum(view.rows.values())
            if buckets or rows <= 4 * BUCKET_ROWS * int(at[1]) or int(at[1]) == MOST_BUCKETS:
                buckets, kind = int(at[1]), "replace"
    if not buckets:
        buckets = _bucket_number(table.count() if view else changes.count())
    if kind == "replace" and buckets > 1:
        touched = [v for v in _values(_dealt(changes, key, buckets), BUCKET) if v in view.parts]
        table = (spark.read.schema(table.schema).parquet(*view.part_paths(touched)) if touched
                 else spark.createDataFrame([], table.schema))
    rows = merge(table, changes) if view else changes
    return _load_parts(_dealt(rows, key, buckets), root, versions, kind, _layout(BUCKET, key, buckets), check, note)


def written_once(df: DataFrame, root: str, **stats: Column) -> tuple[DataFrame, dict]:
    """Rows written beside the table and read again, and figures taken while they are written."""
    path, obs = f"{root.rstrip('/')}/changes-{uuid.uuid4().hex[:16]}", Observation("written")
    df.observe(obs, *(c.alias(n) for n, c in stats.items())).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), obs.get


def _written_changes(source: DataFrame, root: str, key: Sequence[str], order_col: str) -> tuple[DataFrame, int]:
    """The latest row per key, written once, and how many there are."""
    path, stats = f"{root.rstrip('/')}/changes-{uuid.uuid4().hex[:16]}", {}
    latest, obs = _observed(latest_per_key(source, key, order_col), stats)
    latest.write.parquet(path)
    return source.sparkSession.read.schema(source.schema).parquet(path), obs.get["rows_written"]


def latest_per_key(source: DataFrame, key: Sequence[str], order_col: str) -> DataFrame:
    """One row per key, the one with the greatest `order_col` (ties: any; a NULL order
    value is older than any other).

    A grouped `max_by` aggregates map-side first, so a hot key is reduced in
    every task before the shuffle instead of landing whole in one window.
    """
    key = list(key)
    others = [c for c in source.columns if c not in key]
    order = F.struct(F.col(order_col))  # never NULL itself, and NULL sorts first within it
    latest = source.groupBy(*key).agg(F.max_by(F.struct(*others), order).alias("_r"))
    return latest.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*source.columns)


def _same_key(left: str, right: str, key: Sequence[str]) -> Column:
    """Null-safe equality: a NULL key matches a NULL key."""
    cond = F.lit(True)
    for k in key:
        cond = cond & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return cond


def _merged(target: DataFrame, latest: DataFrame, key: Sequence[str]) -> DataFrame:
    keys = latest.select(*key)
    kept = target.alias("t").join(keys.alias("s"), _same_key("t", "s", key), "left_anti")
    return kept.unionByName(latest.select(*target.columns))


def scd1_merge(target: DataFrame, source: DataFrame, key: Sequence[str], order_col: str) -> DataFrame:
    """J1 as a DataFrame: target rows whose key is not in the source, plus the
    latest source row per key (matched rows replaced, new rows inserted; NULL
    keys are keys like others).  Spark broadcasts the keys when they measure small."""
    return _merged(target, latest_per_key(source, key, order_col), list(key))


def scd1_upsert(spark: SparkSession, root: str, source: DataFrame, key: Sequence[str], order_col: str,
                check: Check | None = None, buckets: int | None = None) -> str | None:
    """J1 on a versioned table: the change set is reduced to one row per key and
    written once, then merged into the buckets its keys are in (its size is known by then).
    An empty change set makes no version."""
    versions = _versions(spark, root)
    if not versions:
        raise LoadError(f"table {root} has no committed version")
    latest, n = _written_changes(source, root, key, order_col)
    if not n:
        return None
    return merge_by_key(spark, root, latest, key, lambda old, new: _merged(old, new, list(key)), check, buckets, versions)


def keep_latest(spark: SparkSession, root: str, source: DataFrame, key: Sequence[str], order_col: str,
                buckets: int | None = None) -> str | None:
    """J4 on a versioned table: of the table's and the source's rows of a key the one with the greatest `order_col`
    stays.  Merging the same rows again changes nothing."""
    versions = _versions(spark, root)
    latest, n = _written_changes(source, root, key, order_col)
    if not n and versions:
        return None
    return merge_by_key(spark, root, latest, key, lambda old, new: latest_per_key(old.unionByName(new), key, order_col),
                        buckets=buckets, versions=versions)


def high_water_mark(df: DataFrame, col: str) -> Column | None:
    """max(col) of a table as a literal (one aggregated scalar reaches the
    driver, as text, and is cast back in Spark so no time zone of the
    driver's Python process is involved).  As a literal it becomes a pushed
    Parquet filter on the source scan: row groups below the mark are
    skipped.  None when the table is empty."""
    text = df.agg(F.max(col).cast("string")).first()[0]
    return None if text is None else F.lit(text).cast(df.schema[col].dataType)


def incremental_filter(source: DataFrame, target: DataFrame, src_col: str, tgt_col: str) -> DataFrame:
    """Rows with `src_col > (SELECT max(tgt_col) FROM target)`; all rows
    when the target is empty."""
    mark = high_water_mark(target, tgt_col)
    return source if mark is None else source.where(F.col(src_col) > mark)


def fact_incremental(source: DataFrame, target: DataFrame, ts_col: str, key: Sequence[str],
                     lateness: str) -> DataFrame:
    """J2 batch form: rows with event time >= max(loaded) - lateness whose key is not
    loaded yet, each key once, by its earliest event (late rows inside the window
    are taken, repeated ones are not) -- as the stream form does."""
    mark = high_water_mark(target, ts_col)
    fresh = source if mark is None else source.where(F.col(ts_col) >= mark - F.expr(f"INTERVAL {lateness}"))
    key = list(key)
    others = [c for c in source.columns if c not in key]
    once = fresh.groupBy(*key).agg(F.min_by(F.struct(*others), F.struct(ts_col)).alias("_r"))
    once = once.select(*key, *[F.col(f"_r.{c}").alias(c) for c in others]).select(*source.columns)
    return anti_join_small(once, target, key)


def append_new_facts(df: DataFrame, root: str, ts_col: str, key: Sequence[str], lateness: str, note: str) -> str | None:
    """J2 on a versioned table, once per `note`: the rows of `df` that the current version lacks (all keys once, when
    the table is new) become its next version; a note that the log has already makes none."""
    spark = df.sparkSession
    versions = _versions(spark, root)
    if any(v.note == note for v in versions):
        return None
    view = _view(versions)
    target = view.read(spark) if view else spark.createDataFrame([], df.schema)
    return append_load(fact_incremental(df, target, ts_col, key, lateness), root, note=note,
                       base=max((v.number for v in versions), default=0))


def anti_join_small(small: DataFrame, big: DataFrame, key: Sequence[str]) -> DataFrame:
    """`small LEFT ANTI JOIN big` (null-safe), carrying only the keys of `big` that `small` has.

    Where the keys of `small` measure small, Spark broadcasts them and filters
    `big` in place; the anti-join then runs against that small match set."""
    key = list(key)
    hits = (big.select(*key).alias("b").join(small.select(*key).distinct().alias("s"), _same_key("b", "s", key), "left_semi")
            .distinct())
    return small.alias("s").join(hits.alias("h"), _same_key("s", "h", key), "left_anti")


def _dated(df: DataFrame, ts_col: str, part_col: str) -> DataFrame:
    """With its partition column."""
    return df.withColumn(part_col, F.to_date(ts_col))


def partitioned_load(df: DataFrame, root: str, ts_col: str, part_col: str = "dt") -> str:
    """A target partitioned by the date of `ts_col` (partition pruning on read)."""
    return _load_parts(_dated(df, ts_col, part_col), root, _versions(df.sparkSession, root), "refresh", _layout(part_col), None)


def partitions_replaced(old: DataFrame, df: DataFrame, ts_col: str, part_col: str) -> DataFrame:
    """`old` with the partitions that `df` has rows for replaced by those rows."""
    days = df.select(F.to_date(ts_col).alias(part_col)).distinct()
    kept = old.alias("o").join(days.alias("d"), _same_key("o", "d", [part_col]), "left_anti")
    return kept.unionByName(df.withColumn(part_col, F.to_date(ts_col)))


def replace_partitions(df: DataFrame, root: str, ts_col: str, part_col: str = "dt", check: Check | None = None) -> str:
    """A new version in which the partitions that `df` has rows for hold exactly those
    rows and the others are as before; readers never see a half-replaced table.

    Only those partitions are written; a table that was not loaded by `partitioned_load`, or was appended to,
    is first written whole."""
    spark = df.sparkSession
    versions = _versions(spark, root)
    view = _view(versions)
    if view is None:
        raise LoadError(f"table {root} has no committed version")
    kind = "replace" if not view.whole and view.layout == _layout(part_col) else "refresh"
    rows = _dated(df, ts_col, part_col) if kind == "replace" else partitions_replaced(view.read(spark), df, ts_col, part_col)
    return _load_parts(rows, root, versions, kind, _layout(part_col), check)
