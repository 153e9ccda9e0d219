"""A change feed kept as a log-structured merge tree of sorted Parquet runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weft.functions.ids import plain_entry_key
from weft.storage import Scratch, delete, read_text, write_text

#: Rows that the merge reads from a run at once.
BATCH = 65_536


def operation(c: Column) -> Column:
    """``upsert``, ``tombstone`` or what else is written, without regard to case and blanks; null stays null."""
    return F.lower(F.regexp_replace(c, "[^A-Za-z]", ""))


def merge_sorted(runs: list[Iterator[pa.RecordBatch]], order: list[str]) -> Iterator[pa.Table]:
    """The last row by ``order`` of each key of runs sorted by key (k-way, streaming).

    In each turn the least of the runs' last keys at hand is the bound up to which all runs are known; the rows up to
    it are ranked together, the rest waits. Memory is a batch for each run. Strings compare by their bytes and null
    comes before all else, as in the engine.
    """
    held: list[pa.Table | None] = [None] * len(runs)

    def fill(i: int) -> None:
        while held[i] is None or not len(held[i]):
            batch = next(runs[i], None)
            if batch is None:
                held[i] = None
                return
            held[i] = pa.Table.from_batches([batch])

    for i in range(len(runs)):
        fill(i)
    while live := [i for i, t in enumerate(held) if t is not None]:
        bound = min(held[i].column("key")[-1].as_py().encode() for i in live).decode()
        parts = []
        for i in live:
            n = pc.sum(pc.less_equal(held[i].column("key"), bound)).as_py()
            parts.append(held[i].slice(0, n))
            held[i] = held[i].slice(n)
            fill(i)
        t = pa.concat_tables(parts)
        if len(parts) > 1:
            at = pc.sort_indices(t, sort_keys=[("key", "ascending"), *[(c, "ascending") for c in order]], null_placement="at_start")
            t = t.take(at).combine_chunks()
            key = t.column("key")
            last = np.r_[pc.not_equal(key.slice(1), key.slice(0, len(t) - 1)).to_numpy(), True]
            t = t.filter(pa.array(last))
        yield t


def _open(path: str) -> tuple[FileSystem, str]:
    return FileSystem.from_uri("s3://" + path[6:] if path.startswith("s3a://") else path)


def _sorted_run(path: str, bucket: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows of one bucket of a run, which is one sorted file."""
    fs, root = _open(f"{path}/bucket={bucket}")
    for info in fs.get_file_info(FileSelector(root, allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with fs.open_input_file(info.path) as f:
                yield from pq.ParquetFile(f).iter_batches(BATCH, columns=columns)


class ChangeLog:
    """Sorted runs of changes, merged on read and compacted once there are many.

    A run is a folder of buckets by hash of the key, each one file sorted by key, with at most one change per key: the
    last by ``seq``. Reading merges the runs of all levels bucket by bucket (k-way, see merge_sorted), keeps the last
    change and then drops tombstones, so late, repeated and out-of-order changes give the same table whatever the order
    of the appends. New changes are reduced by an aggregate with partial combining first, so a key that is written
    very often meets the shuffle once per task. Of two changes with one key and seq, a tombstone wins, then the
    greater ``op`` and payload; changes without key or seq are dropped on append, as torn.

    The manifest in the log's folder names the runs of each level. It is replaced after new runs are written and before
    old ones are deleted, so a log can be opened again after a failure at any point. Merging keeps tombstones, because
    an older upsert may still arrive. ``compact(low_water)`` states that no change below that seq is still to come:
    tombstones below it are purged, and changes below it are ignored from then on.

    Runs are read in the tasks by pyarrow, so the shared folder must be of a kind that it knows (file, hdfs, s3, gs).
    """

    def __init__(self, spark: SparkSession, payload: list[str], fanout: int = 4, root: Scratch | None = None, buckets: int | None = None):
        self.spark, self.payload, self.fanout = spark, payload, fanout
        self.scratch = root or Scratch(spark, "changelog")
        self.columns = ["key", "seq", "op", *payload]
        kept = read_text(spark, f"{self.scratch.root}/manifest.json")
        known = json.loads(kept) if kept else {}
        self.levels: list[list[str]] = known.get("levels", [])
        self.low_water: int | None = known.get("low_water")
        self.schema: str | None = known.get("schema")
        self.buckets: int = known.get("buckets") or buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self._next = known.get("next", 0)

    def append(self, changes: DataFrame, run: Column | None = None) -> None:
        """Add changes with the columns key, op, seq and the payload as one run, or as several in order of ``run``.

        The changes are read once. Other columns are left out. No rows give an empty run.
        """
        live = changes.where(F.col("key").isNotNull() & F.col("seq").isNotNull())
        if self.low_water is not None:
            live = live.where(F.col("seq") >= self.low_water)
        rows = live.withColumn("__run", F.lit(0) if run is None else run)
        order = F.struct("seq", (operation(F.col("op")) == "tombstone").alias("gone"), "op", *self.payload)
        last = rows.groupBy("__run", "key").agg(F.max(order).alias("last")).select("__run", "key", "last.seq", "last.op", *[f"last.{c}" for c in self.payload])
        self.schema = self.schema or ", ".join(f"`{c}` {t}" for c, t in last.select(*self.columns).dtypes)
        folder = self._folder()
        bucket = F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")
        sent = last.withColumn("bucket", bucket).repartition(self.buckets, "bucket").sortWithinPartitions("__run", "bucket", "key")
        sent.write.partitionBy("__run", "bucket").parquet(folder)
        runs = sorted(int(name.split("=")[1]) for name in self._names(folder) if name.startswith("__run="))
        paths = [f"{folder}/__run={r}" for r in runs] or [folder]
        self.levels = self.levels or [[]]
        self.levels[0] += paths
        self._commit()
        level = 0
        while len(self.levels[level]) >= self.fanout:
            self._merge_into(self.levels[level], level + 1)
            level += 1

    def _names(self, folder: str) -> list[str]:
        fs, root = _open(folder)
        return [i.base_name for i in fs.get_file_info(FileSelector(root))]

    def _folder(self) -> str:
        self._next += 1
        return f"{self.scratch.root}/run-{self._next:06d}"

    def _commit(self) -> None:
        kept = {"levels": self.levels, "low_water": self.low_water, "schema": self.schema, "buckets": self.buckets, "next": self._next}
        write_text(self.spark, f"{self.scratch.root}/manifest.json", json.dumps(kept))

    def _merge(self, paths: list[str], columns: list[str]) -> DataFrame:
        """bucket and columns of the last change of each key: a task merges one bucket of all runs."""
        order = ["seq", "__gone", *columns[2:]]
        fields = self.spark.createDataFrame([], self.schema).schema
        kinds = {f.name: f.dataType.simpleString() for f in fields}
        schema = pa.schema([(c, to_arrow_type(fields[c].dataType)) for c in columns])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def marked(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in rows:
                    gone = pc.equal(pc.utf8_lower(pc.replace_substring_regex(b.column("op"), "[^A-Za-z]", "")), "tombstone")
                    yield b.append_column("__gone", gone)

            for batch in batches:
                for bucket in batch.column(0).to_pylist():
                    for t in merge_sorted([marked(_sorted_run(p, bucket, columns)) for p in paths], order):
                        t = t.select(columns).cast(schema)
                        yield from t.add_column(0, "bucket", pa.array(np.full(len(t), bucket, np.int32))).combine_chunks().to_batches()

        tasks = self.spark.range(0, self.buckets, 1, self.buckets)
        return tasks.mapInArrow(run, ", ".join(["bucket int", *[f"`{c}` {kinds[c]}" for c in columns]]))

    def _merge_into(self, paths: list[str], level: int, low_water: int | None = None) -> None:
        folder = self._folder()
        merged = self._merge(list(paths), self.columns)
        if low_water is not None:
            merged = merged.where(~((F.col("seq") < low_water) & F.coalesce(operation(F.col("op")) == "tombstone", F.lit(False))))
        merged.write.partitionBy("bucket").parquet(folder)
        old = set(paths)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels = [[p for p in ps if p not in old] for ps in self.levels]
        self.levels[level].append(folder)
        self._commit()
        for path in old:
            delete(self.spark, path)

    def merged(self, payload: bool = True) -> DataFrame:
        """The last change of each key, tombstones included; without the payload only its key, seq and op are read."""
        paths = [p for level in self.levels for p in level]
        if not paths:
            raise ValueError("the log has no run yet")
        columns = self.columns if payload else self.columns[:3]
        if len(paths) == 1:
            return self.spark.read.schema(self.schema).parquet(paths[0]).select(*columns)
        return self._merge(paths, columns).select(*columns)

    def state(self, payload: bool = True) -> DataFrame:
        """The rows that exist: keys whose last change is an upsert. A null or unknown op makes nothing exist."""
        return self.merged(payload).where(operation(F.col("op")) == "upsert")

    def compact(self, low_water: int | None = None) -> None:
        """Merge all runs into one. Tombstones below ``low_water`` are purged; see the class."""
        paths = [p for level in self.levels for p in level]
        if low_water is not None:
            self.low_water = max(low_water, self.low_water or low_water)
        if len(paths) > 1 or (paths and low_water is not None):
            self._merge_into(paths, max(1, len(self.levels) - 1), self.low_water)


def replay(entries: DataFrame, runs: int = 4) -> ChangeLog:
    """Append write-ahead entries as up to ``runs`` runs, by pieces of the range of segment_seq, in which segments arrive.

    Entries without a segment belong to the first piece. An empty feed gives an empty run. The feed is read once, but
    for the range of its segments.
    """
    log = ChangeLog(entries.sparkSession, ["payload", "arrived_at"], fanout=max(2, runs))
    low, high = entries.agg(F.min("segment_seq"), F.max("segment_seq")).first()
    low, high = (0, 0) if low is None else (low, high)
    step = max(1, -(-(high - low + 1) // runs))
    piece = F.floor((F.coalesce(F.col("segment_seq"), F.lit(low)) - low) / step).cast("int")
    changes = entries.select(plain_entry_key("entry_key").alias("key"), "op", F.col("lsn").alias("seq"), "payload", "arrived_at", piece.alias("piece"))
    log.append(changes, F.col("piece"))
    return log
