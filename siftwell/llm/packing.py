"""Sequence packing by concatenate and cut.

Pass one encodes every document, ends it with a separator id and writes ids with each document's start within
its partition; the table in the shared folder fixes the order, so a lost executor changes nothing. The partitions'
totals (one number each) are summed up on the driver. Pass two adds them, cuts at every ``width`` tokens and
returns a row for each piece: a document that crosses a cut has one on each side. Only the last sequence is padded.

Nulls, ties, repeats: a null text is empty (one separator); a null ``doc_id`` stays null; repeated rows are packed
each; an empty table gives no rows; other columns are ignored; a very long text is cut at as many sequences as it fills.
No order is asked of documents, so there are no ties: they follow each other as they were written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``part, first, doc_id, n, ids``: ids of each document with ``end_id`` after them; ``first``: tokens before it in its part."""

    def encode(batches):
        e, part, done = tokens.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        end = e.value([end_id])
        for b in common.pieces(batches, "text", 4 << 20, True):
            ids = [x + end for x in e.of(common.texts_of(b))]
            n = np.array([len(x) // e.width for x in ids], np.int64)
            first = done + np.cumsum(n) - n
            done += int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), pa.array(first), b.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())], ["part", "first", "doc_id", "n", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return common.table(rows.mapInArrow(encode, "part int, first long, doc_id long, n long, ids binary"), "packing-ids")


def pack(docs: DataFrame, tokenizer_path: str, width: int = 2048, end_id: int = 1) -> DataFrame:
    """The pieces of all documents, see PIECES; ``with_ids`` in ``cut`` adds their ids."""
    return cut(encoded(docs, tokenizer_path, end_id), f"<u{tokens.encoder(tokenizer_path).width}", width)


def cut(ids: DataFrame, kind: str, width: int, with_ids: bool = False) -> DataFrame:
    spark = ids.sparkSession
    totals = sorted((r["part"], r["n"]) for r in ids.groupBy("part").agg(F.sum("n").alias("n")).collect())  # a row a partition
    base, starts = 0, []
    for part, n in totals:
        starts.append((part, base))
        base += n
    starts = spark.createDataFrame(starts, "part int, base long")
    placed = ids.join(F.broadcast(starts), "part").select("doc_id", (F.col("base") + F.col("first")).alias("at"), "n", "ids")

    def pieces(batches):
        for b in common.pieces(batches, "ids", remember=True):
            at, n = (np.asarray(b.column(c)) for c in ("at", "n"))
            count = (at + n - 1) // width - at // width + 1
            row = np.repeat(np.arange(len(n)), count)
            k = common.ranges(np.zeros(len(n), np.int64), count)
            begin = np.maximum(at[row], (at[row] // width + k) * width)
            length = np.minimum(at[row] + n[row], (at[row] // width + k + 1) * width) - begin
            start = begin - at[row]
            blobs = [np.frombuffer(x, kind).astype("<u4") for x in b.column("ids").to_pylist()]
            own = [blobs[r][s : s + m].tobytes() for r, s, m in zip(row.tolist(), start.tolist(), length.tolist())]
            crc = np.array([zlib.crc32(x) for x in own], np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row)), *map(pa.array, (start, length, crc, n[row], begin // width, begin % width))] + ([pa.array(own, pa.binary())] if with_ids else []),
                [x.split()[0] for x in PIECES.split(", ")] + (["ids"] if with_ids else []),
            )

    return placed.mapInArrow(pieces, PIECES + (", ids binary" if with_ids else ""))
