"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Vectors are scaled to length one, so the nearest by cosine is the nearest by Euclid. The coarse index has two levels: a
centroid, and a centroid of what remains, shared by all first ones. Their pairs are the lists, as many as the square root
of the number of vectors asks for, though both levels and the codebooks of the residuals are fitted on at most ``sample``
vectors (chosen by hash of their id); every vector is indexed. How many lists a query visits is measured on the sample with
some of the queries themselves, which may lie elsewhere than most vectors.

Equal vectors are one entry that keeps their smallest ids, as many as a result can hold, and equal queries are searched
for once, so a vector that a third of all rows have costs no more than another. A list of many entries is split into
blocks of about ``block``. A task holds one block; its queries are streamed past it, in parts where they are very many:
an asymmetric distance table gives the distance to each code and, with how far a vector is from its code, bounds on the
distance to the vector. Of what these do not rule out the best ``rerank`` (and all that tie with the last) are scored exactly,
in double precision, on the original vectors, component by component in one order, so equal vectors have equal scores wherever
they lie. So no neighbour in a visited list is missed, however fine the differences. Only a query's best of each block are
shuffled to its final ranking.

Nulls, ties, repeats: vectors that are null, empty, zero, or hold null or non-finite components, or whose length
differs from the commonest, take no part, nor do rows without id; repeated rows are one vector (ids name vectors; of
different vectors with one id the least in order counts); ties go to the smaller id; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common



def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from random distinct rows; an empty cell keeps its centroid."""
    rng = np.random.default_rng(seed)
    rows = np.unique(x, axis=0)
    c = rows[np.sort(rng.choice(len(rows), min(k, len(rows)), replace=False))].copy()
    for _ in range(rounds):
        own = nearest(x, c)
        n = np.bincount(own, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(own, x[:, d], len(c))
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(1) / 2
    return np.concatenate([np.argmin(half - x[i : i + 8192] @ c.T, axis=1) for i in range(0, len(x), 8192)]) if len(x) else np.zeros(0, np.int64)


class Index:
    """What is fitted: centroids of two levels and a codebook for each part of the residuals. A list is a pair of centroids."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, codes: int, seed: int = 7):
        many = math.ceil(math.sqrt(lists))
        self.first = kmeans(x, many, 12, seed)
        rest = x - self.first[nearest(x, self.first)]
        self.second = kmeans(rest, math.ceil(lists / len(self.first)), 12, seed - 1)
        rest = rest - self.second[nearest(rest, self.second)]
        self.parts = np.array_split(np.arange(x.shape[1]), min(parts, x.shape[1]))
        self.books = [kmeans(rest[:, p], codes, 8, seed + 1 + i) for i, p in enumerate(self.parts)]

    def lists(self) -> int:
        return len(self.first) * len(self.second)

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """List and code of each vector."""
        one = nearest(x, self.first)
        rest = x - self.first[one]
        two = nearest(rest, self.second)
        rest = rest - self.second[two]
        code = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books)], axis=1).astype(np.uint8)
        return one * len(self.second) + two, code

    def far(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of each query to the middle of each list, but for the query's own length."""
        mixed = self.first @ self.second.T + (self.second * self.second).sum(1) / 2
        out = (self.first * self.first).sum(1)[:, None] / 2 + mixed - (q @ self.first.T)[:, :, None] - (q @ self.second.T)[:, None, :]
        return out.reshape(len(q), -1)

    def rebuilt(self, cell: int, code: np.ndarray) -> np.ndarray:
        """What the codes of a list say of its vectors."""
        out = np.repeat((self.first[cell // len(self.second)] + self.second[cell % len(self.second)])[None], len(code), axis=0)
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, p] += b[code[:, i]]
        return out

    def tables(self, q: np.ndarray, cell: int) -> np.ndarray:
        """Squared distances of each query's residual parts to the codebooks: queries, parts, codes."""
        rest = q - self.first[cell // len(self.second)] - self.second[cell % len(self.second)]
        size = max(len(b) for b in self.books)
        out = np.full((len(q), len(self.parts), size), np.inf)
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            out[:, i, : len(b)] = ((rest[:, None, p] - b[None]) ** 2).sum(2)
        return out


def lists_to_visit(x: np.ndarray, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, index: Index, k: int, recall: float) -> int:
    """Nearest lists that hold ``recall`` of the ``k`` exact neighbours of the queries ``q`` among ``x``; a query's own row is none."""
    if len(x) < 2 or not len(q):
        return index.lists()
    own, near = index.assign(x)[0], q @ x.T
    near[q_ids[:, None] == ids[None, :]] = -np.inf
    most = min(k, len(x) - 1)
    found = own[np.argpartition(-near, most - 1, axis=1)[:, :most]]
    place = np.concatenate([np.argsort(np.argsort(index.far(q[i : i + 64]), axis=1), axis=1) for i in range(0, len(q), 64)])
    ranks = np.sort(np.take_along_axis(place, found, axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(recall * len(ranks)))]) + 1


def added(x: np.ndarray) -> np.ndarray:
    """Sum of each row, component after component: the same for equal rows, whatever stands beside them."""
    out = np.zeros(len(x))
    for column in x.T:
        out += column
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt(added(x * x))[:, None]


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each row of ``q`` with that row of ``x``."""
    return np.clip(added(unit(q) * unit(x)), -1.0, 1.0)


def rows_of(column: pa.Array, kind=np.float64) -> np.ndarray:
    """Binary values of equal length as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


#: Of bounds on distances between vectors of length one, and of their products: far above what rounding does.
SLACK, ROUNDED = 1e-6, 1e-9


def best_of_block(index: Index, entries: pa.Table, asked: pa.RecordBatch, k: int, rerank: int) -> pa.RecordBatch:
    """``query, vec_id, score``: the ``k`` best ids of a block for each query.

    A vector is as far from what its code says as ``off``, so its distance to a query lies within ``off`` of its code's. What cannot be
    among the ``k`` best by these bounds goes; of the rest the ``rerank`` best by product, and all that rounding leaves open, are
    scored exactly.
    """
    cell, ids = entries["cell"][0].as_py(), entries["ids"].combine_chunks()
    code, x = rows_of(entries["code"].combine_chunks(), np.uint8), rows_of(entries["v"].combine_chunks())
    n, every = np.diff(np.asarray(ids.offsets)), np.asarray(ids.flatten())
    begin = np.cumsum(n) - n
    even = unit(x)
    off = np.sqrt(((even - index.rebuilt(cell, code)) ** 2).sum(1))
    q, found = rows_of(asked.column("v")), []
    step, most, scored = max(1, min(256, 2_000_000 // len(x))), min(k, len(x)), min(max(k, rerank), len(x))
    for i in range(0, len(q), step):
        u = unit(q[i : i + step])
        tables = index.tables(u, cell)
        far = np.zeros((len(tables), len(x)))
        for p in range(code.shape[1]):
            far += tables[:, p, code[:, p]]
        far = np.sqrt(far)
        limit = np.partition(far + off, most - 1, axis=1)[:, most - 1 : most] + SLACK
        near = np.where(far - off <= limit, u @ even.T, -np.inf)
        last = np.partition(near, len(x) - scored, axis=1)[:, len(x) - scored, None]
        row, at = np.nonzero((near >= last - ROUNDED) & (near > -np.inf))
        score = np.clip(added(u[row] * even[at]), -1.0, 1.0)  # as ``cosine`` has it
        who, own = np.repeat(np.arange(len(row)), n[at]), every[common.ranges(begin[at], n[at])]
        order = np.lexsort((own, -score[who], row[who]))
        row, own, score = row[who][order], own[order], score[who][order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[keep] + i, own[keep], score[keep]))
    row, own, score = (np.concatenate(c) for c in zip(*found))
    return pa.RecordBatch.from_arrays([asked.column("content").take(pa.array(row)), pa.array(own), pa.array(score)], ["query", "vec_id", "score"])


def drawn(rows: DataFrame, total: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``most`` of the ``total`` vectors, of length one, and their ids."""
    got = common.bounded(rows, total, most, "vec_id").select("vec_id", "v").collect()
    return (unit(np.array([r["v"] for r in got], np.float64)) if got else np.zeros((0, 0))), np.array([r["vec_id"] for r in got], np.int64)


def search(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", query_every: int = 50, k: int = 5, sample: int = 20_000, recall: float = 0.97, rerank: int = 48, block: int = 20_000, asked_part: int = 200_000, parts: int = 16, codes: int = 256, tried: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest found to each vector whose id is divisible by ``query_every``.

    The number of lists is about half the square root of the number of vectors, 8 at least. A query visits as many as
    hold ``recall`` of the exact neighbours that ``tried`` of the queries have within the sample.
    """
    spark = vectors.sparkSession
    rows = common.table(usable(vectors, id_column, vector_column), "vectors")
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, total = sizes[0]
    rows = rows.filter(F.size("v") == dim)
    fitted, ids = drawn(rows, total, sample)
    index = Index(fitted, max(8, math.ceil(math.sqrt(total) / 2)), parts, codes)
    wanted = rows.filter(F.col("vec_id") % query_every == 0)
    visit = lists_to_visit(fitted, ids, *drawn(wanted, wanted.count(), tried), index, k, recall)
    shared = spark.sparkContext.broadcast(index)  # centroids of two levels: a fourth root of the vectors each; codes

    def assign(batches):
        for b in batches:
            if b.num_rows:
                x = np.array(b.column("v").flatten()).reshape(-1, dim)
                cell, code = shared.value.assign(unit(x))
                raw = [r.tobytes() for r in x]
                content = pa.array([hashlib.blake2b(r, digest_size=16).digest() for r in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cell.astype(np.int64)), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(raw, pa.binary()), content], ["vec_id", "cell", "code", "v", "content"])

    indexed = common.table(rows.mapInArrow(assign, "vec_id long, cell long, code binary, v binary, content binary"), "ivf")
    # of equal vectors the k + 1 smallest ids, one of which may be the query's; the limit acts before the shuffle too
    first = indexed.withColumn("n", F.row_number().over(Window.partitionBy("content").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = common.table(first.groupBy("content").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), *(F.first(c).alias(c) for c in ("cell", "code", "v"))), "entries")
    blocks = entries.groupBy("cell").agg(F.count("*").alias("n")).select("cell", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    queries = indexed.filter(F.col("vec_id") % query_every == 0)
    asked = common.table(queries.groupBy("content").agg(F.first("v").alias("v")), "queries")
    portions = max(1, math.ceil(asked.count() / asked_part))

    def visits(batches):
        for b in batches:
            for s in range(0, b.num_rows, 64):
                p = b.slice(s, 64)
                cells = np.argsort(shared.value.far(unit(rows_of(p.column("v")))), axis=1, kind="stable")[:, :visit]
                row = pa.array(np.repeat(np.arange(p.num_rows), cells.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel()), p.column("content").take(row), p.column("v").take(row)], ["cell", "content", "v"])

    def portion(c: str, many) -> Column:
        return F.pmod(F.xxhash64(c), many).cast("int")

    nothing = F.lit(None)
    data = entries.join(F.broadcast(blocks), "cell").select("cell", portion("content", F.col("blocks")).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(portions - 1))).alias("part"), F.lit(0).alias("kind"), "ids", "code", "v", "content")
    wanted = asked.mapInArrow(visits, "cell long, content binary, v binary").join(F.broadcast(blocks), "cell")
    wanted = wanted.select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), portion("content", F.lit(portions)).alias("part"), F.lit(1).alias("kind"), nothing.cast("array<long>").alias("ids"), nothing.cast("binary").alias("code"), "v", "content")

    def scan(batches):
        group, held, block_of = None, [], None
        for b in batches:
            keys = np.stack([np.asarray(b.column(c)) for c in ("cell", "block", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                *own, kind = keys[i].tolist()
                if own != group:
                    group, held, block_of = own, [], None
                if kind == 0:
                    held.append(b.slice(i, j - i))
                elif held:
                    block_of = block_of or pa.Table.from_batches(held)
                    yield best_of_block(shared.value, block_of, b.slice(i, j - i), k + 1, rerank)

    both = data.unionByName(wanted)
    dealt = both.repartition(common.task_count(entries, 4 << 20), "cell", "block", "part").sortWithinPartitions("cell", "block", "part", "kind")
    partial = dealt.mapInArrow(scan, "query binary, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    best = partial.withColumn("place", place).filter(F.col("place") <= k + 1)
    top = best.groupBy(F.col("query").alias("content")).agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("top"))
    each = common.met(queries.select("vec_id", "content"), top, "content", "vec_id").withColumnRenamed("vec_id", "query_id")
    others = F.slice(F.filter("top", lambda t: t["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(others).alias("rank", "hit")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
