"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints are compared 64 at a time: bit planes of a block of up to 64 fingerprints lie in one machine word
each, a query's bit flips the plane, and carry-save counters add the planes into all distances at once. A block
is abandoned when every distance in it exceeds the radius. Which blocks meet is decided by keys: documents with
the same fingerprint are one vertex, and of ``radius + 2`` bands two fingerprints within the radius agree on two
at least, so the bands' pairs are complete keys (six for radius 2). A key that more than ``crowd`` fingerprints have
is parted in the same way by the bits that are not in it, so no link is lost. Within a key only the links of a spanning
forest leave the task, never all pairs.

Nulls, ties, repeats: a null text has no words and fingerprint zero; a row without ``doc_id`` gets a fingerprint
but no component; repeated rows give a row each; a bit that is set in exactly half of the hashes is not set; an empty
table gives no rows; other columns are ignored; a very long text counts with all its shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components, forest
from .textbytes import Words, mixed, shingles, xxh64

ONES = ~np.uint64(0)
#: 16-bit lanes of the four bits of each nibble.
NIBBLE = np.array([sum(((v >> b) & 1) << (16 * b) for b in range(4)) for v in range(16)], np.uint64)
MOST = 60_000  # shingles that a 16-bit lane counts safely


def hashes(column: pa.Array, size: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, int]:
    """XXH64 of each text's shingles of ``size`` lower-cased words, their documents, and the number of texts."""
    w = Words(column, lower=True)
    begin, end, doc = shingles(w, size)
    return xxh64(w.data, begin, end, seed), doc, w.docs


def fingerprints(h: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """A bit is set where it is set in more than half of a document's hashes."""
    n = np.bincount(doc, minlength=docs)
    out = np.zeros(docs, np.uint64)
    if not len(h):
        return out
    first = np.cumsum(n) - n
    begin = np.unique(np.concatenate([first[n > 0], np.arange(0, len(h), MOST)]))
    owner = doc[begin]
    for j in range(16):
        sums = np.add.reduceat(NIBBLE[(h >> np.uint64(4 * j)) & np.uint64(15)], begin)
        for b in range(4):
            ones = np.bincount(owner, ((sums >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(float), docs)
            out |= (2 * ones > n).astype(np.uint64) << np.uint64(4 * j + b)
    return out


def exceed(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose count is above the radius."""
    above, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ONES)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above = above | (equal & counters[k])
            equal = equal & ~counters[k]
    return above


def close(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows in the same group whose fingerprints (rows of 64-bit words) differ in ``radius`` bits at most.

    ``group`` is sorted; equal fingerprints in a group pair up as well.
    """
    n = len(group)
    found = [(np.zeros(0, np.int64),) * 2]
    if n < 2:
        return found[0]
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([start, [n]]))
    base = np.repeat(start, size)
    place = np.arange(n) - base
    blocks = (size + 63) // 64
    first_block = np.cumsum(blocks) - blocks
    block = np.repeat(first_block, size) + place // 64
    lane = place % 64
    words = prints.shape[1]
    planes = np.zeros((int(blocks.sum()), 64 * words), np.uint64)
    used = np.zeros(len(planes), np.uint64)
    np.bitwise_or.at(used, block, np.uint64(1) << lane.astype(np.uint64))
    head = np.concatenate([[0], np.flatnonzero(np.diff(block)) + 1])
    for b in range(64 * words):
        bit = (prints[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)
        planes[block[head], b] = np.add.reduceat(bit << lane.astype(np.uint64), head)
    row_of = np.zeros((len(planes), 64), np.int64)
    row_of[block, lane] = np.arange(n)
    width = max(1, int(radius).bit_length())
    todo = np.repeat(first_block + blocks, size) - block  # a row meets its own block and the later ones of its group
    todo[np.repeat(size, size) < 2] = 0
    ends = np.cumsum(todo)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 400_000, "right")))
        q = np.repeat(np.arange(at, stop), todo[at:stop])
        c = common.ranges(block[at:stop], todo[at:stop])
        over = ~used[c]
        own = block[q] == c
        over[own] |= (np.uint64(2) << lane[q[own]].astype(np.uint64)) - np.uint64(1)  # itself and those before it
        counters = [np.zeros(len(q), np.uint64) for _ in range(width)]
        for b in range(64 * words):
            carry = planes[c, b] ^ (np.uint64(0) - ((prints[q, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
            for k in range(width):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            over |= carry
            if b % 8 == 7:
                over |= exceed(counters, radius)
                if not (alive := over != ONES).all():
                    q, c, over, counters = q[alive], c[alive], over[alive], [x[alive] for x in counters]
                if not len(q):
                    break
        if len(q):
            bits = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, j = np.nonzero(bits)
            found.append((q[i], row_of[c[i], j]))
        at = stop
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def bands_of(places: list[int], radius: int) -> list[list[int]]:
    """The places of bits in ``radius + 2`` bands."""
    n = radius + 2
    return [places[len(places) * i // n : len(places) * (i + 1) // n] for i in range(n)]


def mask(places: list[int]) -> np.uint64:
    return np.uint64(sum(1 << b for b in places))


def band_keys(fp: np.ndarray, radius: int, below: int | None = None) -> list[np.ndarray]:
    """Keys of which two fingerprints within the radius share one at least: each pair of ``radius + 2`` bands.

    ``below``: keys that part the kind of key of that number, by pairs of bands of the bits that are not in it.
    """
    pairs = list(combinations(bands_of(list(range(64)), radius), 2))
    own, first = np.uint64(0), 0
    if below is not None:
        held = sorted(pairs[below][0] + pairs[below][1])
        own, first = mask(held), (below + 1) * len(pairs)
        pairs = list(combinations(bands_of([b for b in range(64) if b not in held], radius), 2))
    # a chance meeting of two kinds only adds a comparison
    return [mixed((fp & (mask(i + j) | own)) ^ np.uint64((first + k) * 0x9E3779B97F4A7C15 & 2**64 - 1)) for k, (i, j) in enumerate(pairs)]


def links(classes: DataFrame, radius: int, crowd: int = 4096) -> DataFrame:
    """``a, b``: links that join all ``classes(vertex, fp)`` (distinct fingerprints) within the radius of each other."""

    def rows_for(keys: list[np.ndarray], fp: np.ndarray, v: np.ndarray, kinds: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(fp, len(keys)).view(np.int64)), pa.array(np.tile(v, len(keys))), pa.array(np.repeat(np.array(kinds, np.int32), len(fp)))], ["key", "fp", "vertex", "kind"]
        )

    def keyed(batches):
        for b in batches:
            fp, v = np.asarray(b.column("fp")).view(np.uint64), np.asarray(b.column("vertex"))
            keys = band_keys(fp, radius)
            yield rows_for(keys, fp, v, list(range(len(keys))))

    def parted(batches):
        for b in batches:
            fp, v, kind = np.asarray(b.column("fp")).view(np.uint64), np.asarray(b.column("vertex")), np.asarray(b.column("kind"))
            for k in np.unique(kind).tolist():
                keys = band_keys(fp[kind == k], radius, k)
                yield rows_for(keys, fp[kind == k], v[kind == k], [k] * len(keys))

    def compare(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        key, fp, v = (np.asarray(t[c].combine_chunks()) for c in ("key", "fp", "vertex"))
        order = np.argsort(key, kind="stable")
        key, fp, v = key[order], fp[order].view(np.uint64), v[order]
        same = key[1:] == key[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, fp, v = key[keep], fp[keep], v[keep]
        a, b = close(key, fp[:, None], radius)
        ids, at = np.unique(v, return_inverse=True)
        low = ids[forest(len(ids), at[a], at[b])]
        far = low != ids
        yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(low[far])], ["a", "b"])

    schema = "key long, fp long, vertex long, kind int"
    rows = classes.mapInArrow(keyed, schema)
    crowded = common.table(rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("key"), "crowded-keys")
    if not crowded.isEmpty():
        rows = rows.join(crowded, "key", "left_anti").unionByName(common.met(rows, crowded, "key", "vertex").select("key", "fp", "vertex", "kind").mapInArrow(parted, schema))
    return rows.repartition(common.task_count(classes, 4 << 20), "key").mapInArrow(compare, "a long, b long")


def with_fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """``doc_id, fp`` (64 bits as a long) of every row."""

    def run(batches):
        for b in common.pieces(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fingerprints(*hashes(b.column("text"), size)).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def near_duplicates(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    prints = common.table(with_fingerprints(docs, size), "fingerprints")
    classes = prints.filter("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("vertex"))
    found = components(links(classes, radius))
    named = classes.join(found, "vertex", "left").select("fp", F.coalesce("component", "vertex").alias("component_id"))
    return prints.join(named, "fp", "left").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
