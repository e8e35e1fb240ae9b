"""What the operators of this subpackage share: shared folders, partition counts, text batches."""

from __future__ import annotations

import atexit
import ctypes
import math
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of input that one task of a shuffle is given.
TASK_BYTES = 48 << 20
#: Catalyst's answer for sources whose size it does not know is far above this.
KNOWN_BYTES = 1 << 60


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where that is not set, a temporary folder will do if all of Spark is one process; on a cluster it is an error, as no
    machine's own folder is seen by the others.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        base = own_dir(spark.sparkContext.master, spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/siftwell/{name}-{uuid.uuid4().hex}"


@lru_cache(1)
def own_dir(master: str, application: str) -> str:
    """A folder for a session on one machine; it goes when Python ends."""
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = tempfile.mkdtemp(prefix="siftwell-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a shared folder and read again: cuts lineage and survives lost executors.

    The folder lives as long as its reader may need it, so it is left to whoever owns ``spark.checkpoint.dir``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def source_bytes(df: DataFrame) -> int:
    """Bytes that the sources of ``df`` hold: file sizes for scans; where a source does not know its size, values are measured."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    if all(x < KNOWN_BYTES for x in sizes):
        return sum(sizes)
    wide = [F.octet_length(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    row = sum((F.coalesce(c, F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    return int(df.agg(F.sum(row.cast("long"))).first()[0] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def task_count(df: DataFrame, per: int = TASK_BYTES) -> int:
    """Partitions for a shuffle of ``df``: the session's count, and more if partitions would exceed ``per``."""
    return max(shuffle_partitions(df.sparkSession), math.ceil(source_bytes(df) / per))


def least_hashes(part: float) -> int:
    """The hash up to which a share ``part`` of all signed 64-bit hashes lies, however small the share."""
    return min((1 << 63) - 1, int(part * 2**64) - (1 << 63))


def bounded(rows: DataFrame, total: int, most: int, *idents: str) -> DataFrame:
    """``most`` of the ``total`` rows, the first by hash of ``idents``; all where there are no more. Tasks keep about two
    times the rows that are given, so the last sort is small."""
    if total <= most:
        return rows
    share = F.xxhash64(F.lit("sample"), *idents) <= F.lit(least_hashes(min(1.0, 2 * most / total)))
    return rows.filter(share).orderBy(F.xxhash64(*idents), *idents).limit(most)


def unused(rows: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``rows`` does not have, whatever the case."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def met(rows: DataFrame, few: DataFrame, key: str | list[str], ident: str) -> DataFrame:
    """``rows`` joined with the one row of ``few`` for their ``key`` (one column or several), of which a few may have a third of all rows.

    Rows are dealt out by ``ident`` too, and what is known of their key goes only where some of them went, so no task gets
    a key's rows together.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(ident), F.lit(shuffle_partitions(rows.sparkSession))).cast("int"))
    keys = [key] if isinstance(key, str) else key
    spread = salted.select(*keys, "salt").distinct().join(few, keys)
    return salted.join(spread, [*keys, "salt"]).drop("salt")


def copies(rows: DataFrame, content: str, ident: str) -> DataFrame:
    """``rows`` of every ``content`` that several of them have, with ``rep``, its smallest ``ident``."""
    classes = rows.groupBy(content).agg(F.min(ident).alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return met(rows, classes, content, ident)


def digest(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


#: What operators remember between tasks of a worker: functions that give it back.
remembered: list[Callable[[], None]] = []


def pieces(batches: Iterator[pa.RecordBatch], name: str, most: int = 2 << 20, remember: bool = False) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that column ``name`` holds at most ``most`` bytes in each (one row at least).

    Workers are used again by later stages; unless ``remember``, what an earlier operator left in memory goes first.
    """
    if not remember:
        give_back()
    try:
        for batch in batches:
            for start, stop in row_ranges(lengths(batch.column(name)), most):
                yield batch.slice(start, stop - start)
    finally:
        trim()


def give_back() -> None:
    """Forgets what operators remember, and trims."""
    for forget in remembered:
        forget()
    trim()


def trim() -> None:
    """Hands memory that is free but still held by allocators back to the system: idle workers stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lengths(column: pa.Array) -> np.ndarray:
    """Bytes of each value; null counts as empty."""
    import pyarrow.compute as pc

    return np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64)


def joined_bytes(column: pa.Array, after: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """All values as one byte array, each with ``after`` behind it, and where each begins (one more entry: the end)."""
    ends = np.concatenate([[0], np.cumsum(lengths(column) + len(after))])
    data = b"".join((x.as_buffer().to_pybytes() if x.is_valid else b"") + after for x in column)
    return np.frombuffer(data, np.uint8), ends


def row_ranges(sizes: np.ndarray, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive rows of ``most`` bytes together, one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield start, stop
        start = stop


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``arange(s, s + n)`` of each pair, one after another."""
    counts = counts.astype(np.int64)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, counts)
