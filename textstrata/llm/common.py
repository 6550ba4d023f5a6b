"""Shared pieces of the training-data operators: shared-folder tables, grouped Arrow streams, connected components, folds."""

from __future__ import annotations

import contextlib
import itertools
import os
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The held-out fold: rows whose crc32(doc_id as text) mod FOLDS is 0 are never learned from.
FOLDS = 5


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local session (one machine, as in tests) gets a folder of its own; a cluster gets an
    error, as its machines would not see each other's files.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return os.path.join(tempfile.gettempdir(), "textstrata-shared")


def _path(spark: SparkSession, path: str):
    """The path's Hadoop file system and Path."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: later reads survive lost executors.

    ``drop_stage`` deletes the folder; at the latest it goes when the driver's file system closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _path(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def drop_stage(*staged: DataFrame) -> None:
    """Delete tables that ``stage`` wrote, once nothing will read them again."""
    for df in staged:
        files, where = _path(df.sparkSession, df.staged_at)
        files.delete(where, True)


def fold_of(doc_id) -> int:
    """crc32 of the id as text, mod FOLDS (driver-side twin of ``fold_col``)."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS


def fold_col(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % FOLDS


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound Arrow batches, so that a Python worker holds few long texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def slices_of(batches: Iterator[pa.RecordBatch], text: str | int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Slices of about ``most`` bytes of text; one longer text is a slice of its own."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            begun = size[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(size, begun + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def ascii_lower(col):
    """Lower-case A-Z only; other letters stay as they are."""
    plain = F.octet_length(col) == F.char_length(col)
    return F.when(plain, F.lower(col)).otherwise(F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def crc_table() -> list[int]:
    """The 256 steps of CRC-32, for SQL that lacks the function."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc_sql(text: str) -> str:
    """DuckDB SQL of the unsigned CRC-32 of a string expression's UTF-8 bytes."""
    table = ",".join(map(str, crc_table()))
    return f"""xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
  lambda a, x: xor(a >> 8, ([{table}]::BIGINT[])[(xor(a & 255, x) + 1)::INT])), 4294967295::BIGINT)"""


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Elements that one fold over an array handles; folds copy what they build at every step, so longer arrays are folded in blocks.
FOLD_BLOCK = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once (a lambda's variable is bound to it)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column], start: int = 0) -> Column:
    """Per place of an array<int>, ``combine`` (sum or maximum) over all places before it, and over all of them at the end: one element more.

    Two levels of blocks: the work grows with the array's length, not with its square.
    """
    first = F.lit(start)

    def fold(part: Column) -> Column:
        """(all, before): the combination of the part, and those before each of its places."""
        zero = F.struct(first.alias("all"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(part, zero, lambda a, v: F.struct(combine(a["all"], v).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before")))

    def joined(values: Column) -> Column:
        cuts = F.sequence(F.lit(0), F.floor(F.size(values) / FOLD_BLOCK).cast("int"))
        blocks = F.transform(cuts, lambda b: fold(F.slice(values, b * FOLD_BLOCK + 1, F.lit(FOLD_BLOCK))))
        return bound(blocks, lambda parts: bound(fold(F.transform(parts, lambda x: x["all"])), lambda ahead: F.concat(
            F.flatten(F.transform(parts, lambda x, b: F.transform(x["before"], lambda v: combine(F.get(ahead["before"], b), v)))), F.array(ahead["all"]))))

    return bound(values, joined)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def by_group(df: DataFrame, keys: list[str], run: Callable[[pa.Table], Iterable[pa.RecordBatch]], schema: str, tasks: int = 0) -> DataFrame:
    """``run`` on the rows of each key, in sorted partitions and so with one key's rows in memory at a time.

    Callers bound the rows of a key; many small keys cost no task or worker of their own. ``tasks``: so many at least.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            changed = np.zeros(batch.num_rows - 1, bool)
            for k in keys:
                column = batch.column(k)
                changed |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(cuts):
                key = tuple(batch.column(k)[a].as_py() for k in keys)
                if kept and key != last:
                    yield from run(pa.Table.from_batches(kept))
                    kept = []
                last = key
                kept.append(batch.slice(a, b - a))
        if kept:
            yield from run(pa.Table.from_batches(kept))

    return df.repartition(max(tasks, partitions(df.sparkSession)), *keys).sortWithinPartitions(*keys).mapInArrow(stream, schema)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): one row (node, root) per node that has an edge to another.

    root is the smallest node reachable. Rounds alternate a large star (each
    node's greater neighbours move to its least one) and a small star (a node's
    lesser neighbours move to the least). Every step is a min-aggregation per
    node, combined before its shuffle, and a join: a hub's edges are rows of one
    join key, which adaptive execution splits where they are many, never an array.
    Each round is written to the shared folder; it has settled when the number
    and the hash sum of its edges stay. Nulls, loops and repeated edges are
    ignored; an empty input gives an empty result.
    """
    plain = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    cur, seen = _edge_stage(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        new, now = _edge_stage(small)
        drop_stage(cur)
        cur = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    heads = cur.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).union(heads)


def _edge_stage(edges: DataFrame) -> tuple[DataFrame, tuple]:
    watch = Observation()
    out = stage(edges.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "edges")
    got = watch.get
    return out, (got["n"], got["h"])
