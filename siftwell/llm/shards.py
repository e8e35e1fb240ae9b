"""Documents in shards, and their two-way exchange with targets, as used by the operators that look for repeats.

Documents lie in shards by ``xxhash64(doc_id)``; what is compared lies elsewhere, by a content hash.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textbytes import mixed

MOVED = "target int, kind int, shard int, blob binary"
BACK = "shard int, kind int, blob binary"
#: Place among ids of documents that have none.
NO_ID = np.iinfo(np.int64).max
#: Bytes of parquet that make a shard.
SHARD_BYTES = 4 << 20


def dump(**arrays: np.ndarray) -> bytes:
    head = json.dumps([(k, v.dtype.str, v.shape) for k, v in arrays.items()]).encode()
    body = b"".join(np.ascontiguousarray(v).tobytes() for v in arrays.values())
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + body)


def load(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for name, kind, shape in json.loads(raw[4:at]):
        count = int(np.prod(shape))
        out[name] = np.frombuffer(raw, kind, count, at).reshape(shape)
        at += count * np.dtype(kind).itemsize
    return out


def gather(blobs: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {k: np.concatenate([b[k] for b in blobs]) for k in blobs[0]} if blobs else {}


def split(keys: np.ndarray, many: int, **arrays: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The arrays' rows by key (0 to many - 1), in their order."""
    order = np.argsort(keys, kind="stable")
    bounds = np.searchsorted(keys[order], np.arange(many + 1))
    for k in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[k] : bounds[k + 1]]
        yield int(k), {n: v[at] for n, v in arrays.items()}


def moved(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate((("target", pa.int32()), ("kind", pa.int32()), ("shard", pa.int32()), ("blob", pa.binary())))})


def back(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["shard", "kind", "blob"])


class Corpus:
    """Documents in shards. Rows that agree in ``doc_id`` (or have none) and text are one document; those that have a
    ``doc_id`` in common and differ in text are documents of their own, in the order of their texts. Documents without
    ``doc_id`` come after all others.

    A shard is what a task holds in memory at once; a task gets as many shards one after another as its share of the
    shuffle has. ``carry``: all columns of ``docs`` travel along as ``own`` (``blank``: the text is null) and can be given back.
    """

    def __init__(self, docs: DataFrame, carry: bool = False):
        size = common.source_bytes(docs)
        self.spark = spark = docs.sparkSession
        self.tasks = max(common.shuffle_partitions(spark), math.ceil(size / common.TASK_BYTES))
        self.shards = self.targets = max(self.tasks, math.ceil(size / SHARD_BYTES))
        doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
        where = F.pmod(F.when(doc_id.isNull(), F.xxhash64(text)).otherwise(F.xxhash64(doc_id)), F.lit(self.shards)).cast("int")
        own = [F.col("text").isNull().alias("blank"), F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("own")] if carry else []
        self.rows = docs.select(where.alias("shard"), doc_id.alias("doc_id"), text.alias("text"), *own)

    def copies(self) -> DataFrame:
        """``shard, doc_id, content, rep`` of documents with exact copies; ``rep``: the first of them."""
        pairs = self.rows.select("shard", "doc_id", common.digest(F.col("text")).alias("content")).distinct()
        return common.table(common.copies(pairs, "content", "doc_id"), "copies")

    def with_docs(self, other: DataFrame, work: Callable[[Shard, pa.Table, int], pa.Table], schema) -> DataFrame:
        """``work(shard, rows of other for it, shard number)`` on each shard."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            common.give_back()
            return work(Shard(left), right, int(left["shard"][0].as_py()))

        both = (x.repartition(self.tasks, "shard").groupBy("shard") for x in (self.rows, other))
        return next(both).cogroup(next(both)).applyInArrow(run, schema)

    def alone(self, work: Callable[[Shard, pa.Table, int], pa.Table], schema) -> DataFrame:
        return self.with_docs(self.spark.createDataFrame([], "shard int"), work, schema)

    def at_targets(self, rows: DataFrame, work: Callable[[list[dict]], list[tuple[int, int, bytes]]]) -> DataFrame:
        """``work(blobs of kind DATA)`` on all that went to a target; rows of kind PASS go on to their shard."""

        def run(batches):
            data = []
            for b in batches:
                for kind, shard, blob in zip(*(b.column(c).to_pylist() for c in ("kind", "shard", "blob"))):
                    if kind == DATA:
                        data.append(load(blob))
                    else:
                        yield back([(shard, DATA, blob)])
            if data:
                for row in work(data):
                    yield back([row])
            del data
            common.give_back()

        return rows.repartitionById(self.targets, F.col("target")).mapInArrow(run, BACK)


#: Kinds of rows: arrays for who receives them, arrays that a target hands on.
DATA, PASS = 0, 1


def blobs(rows: pa.Table) -> list[dict[str, np.ndarray]]:
    return [load(x) for x, k in zip(rows["blob"].to_pylist(), rows["kind"].to_pylist()) if k == DATA]


class Shard:
    """The documents of a shard, each once, in the order of ``doc_id`` and text; a document's row is the same in every pass."""

    def __init__(self, left: pa.Table):
        left = left.sort_by([("doc_id", "ascending"), ("text", "ascending")])  # nulls last
        ids, text = left["doc_id"], left["text"].combine_chunks()
        known = np.asarray(ids.is_valid())
        value = np.asarray(ids.fill_null(0))
        same = np.zeros(len(known), bool)
        same[1:] = (known[1:] == known[:-1]) & (value[1:] == value[:-1])
        for i in np.flatnonzero(same).tolist():
            same[i] = text[i] == text[i - 1]
        self.row_of = np.cumsum(~same) - 1  # of each row of the table
        self.rows = left
        first = np.flatnonzero(~same)
        self.doc_id, self.text = ids.combine_chunks().take(pa.array(first)), text.take(pa.array(first))
        #: Place in the order of all documents: the id, those without one last, and the place among equals.
        self.order = np.where(known, value, NO_ID)[first]
        self.place = np.arange(len(first)) - np.searchsorted(self.order, self.order, "left")
        for i in np.flatnonzero(~known[first]).tolist():  # these lie in all shards, by text
            self.place[i] = int.from_bytes(hashlib.sha256(self.text[i].as_buffer()).digest()[:7], "big")

    def repeat(self, table: pa.Table) -> pa.Table:
        """A row for each row of the input, from one for each document."""
        return table.take(pa.array(self.row_of))


def copied(shard: Shard, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which documents have exact copies, and which are the first of theirs (as are those without any)."""
    rep = {(i, c): r for i, c, r in zip(*(rows[n].to_pylist() for n in ("doc_id", "content", "rep"))) if c is not None}
    has, stands = np.zeros(len(shard.order), bool), np.ones(len(shard.order), bool)
    if rep:
        for k, (i, t) in enumerate(zip(shard.doc_id.to_pylist(), shard.text)):
            key = (i, hashlib.sha256(t.as_buffer()).digest())
            has[k] = key in rep
            stands[k] = not has[k] or rep[key] == i
    return has, stands


def merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans of each row: sorted, without overlap or contact."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    shift = row.astype(np.int64) << 40
    top = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > top[:-1]])
    at = np.flatnonzero(new)
    return row[at], start[at], np.concatenate([top[at[1:] - 1], top[-1:]]) - shift[at]


def polynomial(values: np.ndarray, size: int, base: int) -> np.ndarray:
    """64-bit hash of each run of ``size`` values, from the hashes of runs of 1, 2, 4, ... values."""
    whole, out, done = values, values[:0], 0
    with np.errstate(over="ignore"):
        step = 1
        while True:
            if size & step:
                power = np.uint64(pow(base, step, 1 << 64))
                out = whole if not done else out[: max(0, len(whole) - done)] * power + whole[done:]
                done += step
            if step * 2 > size:
                return out
            whole = whole[: max(0, len(whole) - step)] * np.uint64(pow(base, step, 1 << 64)) + whole[step:]
            step *= 2


def least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` consecutive hashes, the first of equals; depends on content only.

    Hashes are compared by their upper 40 bits, so that the position fits in the rest.
    """
    out = []
    block = (1 << 24) - width
    for at in range(0, max(0, len(h) - width + 1), block):
        part = h[at : at + block + width - 1]
        m = (part & ~np.uint64((1 << 24) - 1)) | np.arange(len(part), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            m = np.minimum(m[:-step], m[step:])
            step *= 2
        if step < width:
            m = np.minimum(m[: len(m) - (width - step)], m[width - step :])
        out.append((m & np.uint64((1 << 24) - 1)).astype(np.int64) + at)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def anchors(h: np.ndarray, width: int, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of windows: position, first and last window that it stands for, and document.

    ``h``: hash at each position of all documents in a row; window ``p`` sees positions ``p`` to ``p + width - 1``;
    document ``d`` has the windows ``starts[d]`` to ``starts[d] + counts[d] - 1``. Equal windows have anchors at
    the same place in them.
    """
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts, 0))
    window = common.ranges(starts, np.maximum(counts, 0))
    if not len(window):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    at = least(h, width)[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.concatenate([new[1:] - 1, [len(at) - 1]])
    return at[new], window[new], window[last], doc[new]


def repeated(h: np.ndarray) -> np.ndarray:
    """Whether each hash occurs more than once."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(h), bool)
    out[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return out


def recurring_anchors(corpus: Corpus, copies: DataFrame, find: Callable[[Shard, np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """Sends to each shard (BACK) the anchors whose hash occurs elsewhere: ``row, at``.

    ``find(shard, stands)`` gives hash, row and place of the shard's anchors. A hash that recurs within a shard is
    settled there, and one witness of it goes out, so that a hash of very many rows loads no target.
    """
    targets, shards = corpus.targets, corpus.shards

    def local(shard: Shard, other: pa.Table, number: int) -> pa.Table:
        h, row, at = find(shard, copied(shard, other)[1])
        own = {"row": row.astype(np.int32), "at": at.astype(np.int32)}
        twice = repeated(h)
        out = []
        if twice.any():
            out.append((number % targets, PASS, number, dump(**{k: v[twice] for k, v in own.items()})))
        witness = np.unique(h[twice])
        home = np.full(len(h), number, np.int32)
        for t, x in split((h[~twice] % np.uint64(targets)).astype(np.int64), targets, h=h[~twice], home=home[~twice], **{k: v[~twice] for k, v in own.items()}):
            out.append((t, DATA, number, dump(**x)))
        none = {k: v[:0] for k, v in {"home": home, **own}.items()}
        for t, x in split((witness % np.uint64(targets)).astype(np.int64), targets, h=witness):
            out.append((t, DATA, number, dump(h=x["h"], **none)))
        return moved(out)

    def settle(data: list[dict]):
        ones = [d for d in data if len(d["row"])]
        if not ones:
            return
        both = np.concatenate([d["h"] for d in ones] + [d["h"] for d in data if not len(d["row"])])
        rows = gather(ones)
        twice = repeated(both)[: len(rows["row"])]
        home = rows["home"][twice]
        for s, x in split(home, shards, row=rows["row"][twice], at=rows["at"][twice]):
            yield s, DATA, dump(**x)

    return corpus.at_targets(corpus.with_docs(copies, local, MOVED), settle)
