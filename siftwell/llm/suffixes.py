"""Suffix-array dedup: maximal repeats from the common-prefix interval tree of an enhanced suffix array.

The array is sparse: every string of ``size`` bytes contains one anchor, the least (by hash) of its runs of ``seed``
bytes, at the same place wherever it occurs. Only anchors whose hash recurs get a suffix. They go to targets by the
hash, with ``size`` bytes to the right of the anchor's start and ``size - seed`` to its left. In a target

1. suffixes are sorted and common prefixes of neighbours measured (the enhanced suffix array),
2. a stack scan yields the intervals of the common-prefix tree, each with all its occurrences,
3. within an interval, occurrences are sorted by what lies left of them and a second stack scan splits them wherever
   left extensions differ: an interval of prefix ``r`` whose class shares ``l`` bytes to the left is a maximal repeat
   of ``l + r`` bytes with all its occurrences,
4. groups that agree in their occurrences but for a shift are parts of one longer repeat and are joined.

For dedup steps 1 to 3 are enough: each occurrence but the first (``doc_id``, start) of each group is removed if ``l + r >= size``.
Lengths are measured up to the context that travels, which decides every string of ``size`` bytes. Equal contexts
within a shard leave it once, and exact copies are settled by digest, so hot strings arrive at most once a shard.

Nulls, ties, repeats: a null text is empty; rows that agree in ``doc_id`` (or have none) and text are one document (a
row each is returned); documents with one ``doc_id`` and different texts follow each other by text, those without
``doc_id`` come last; an empty table gives no rows; other columns are ignored. A very long text is taken whole: a shard
holds it in memory, its arrays are made a piece at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .shards import DATA, MOVED, NO_ID, PASS, Corpus, Shard, anchors, blobs, copied, dump, gather, least, merged, moved, polynomial, recurring_anchors, split
from .textbytes import mixed

BASE = 0x9E3779B97F4A7C15
BYTES = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64, endpoint=False)
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def seed_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    return mixed(polynomial(BYTES[data], seed, BASE))


def common_prefixes(sorted_rows: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Bytes that each row shares with the one before it (0 for the first), within what is known of both."""
    out = np.zeros(len(sorted_rows), np.int64)
    if len(out) > 1:
        differ = sorted_rows[1:] != sorted_rows[:-1]
        at = differ.argmax(axis=1)
        at[~differ.any(axis=1)] = sorted_rows.shape[1]
        out[1:] = np.minimum(at, np.minimum(known[1:], known[:-1]))
    return out


def sorted_order(rows: np.ndarray) -> np.ndarray:
    """Order of the rows as byte strings."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}")[:, 0], kind="stable")


def intervals(lcp: list[int], least: int) -> list[tuple[int, int, int]]:
    """Intervals ``first, last, prefix`` of the common-prefix tree with a prefix of ``least`` or more: one stack scan."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # prefix, first
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else 0
        first = i - 1
        while stack and stack[-1][0] > now:
            prefix, first = stack.pop()
            out.append((first, i - 1, prefix))
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))
    return out


def classes(left: list[int], order: list[int], on_group=None) -> list[int]:
    """Second stack scan: occurrences of an interval by left extension.

    ``left``: bytes shared to the left with the occurrence before, -1 where a new interval or class begins; ``order``:
    each one's place among all occurrences. Returns for each the longest left extension that it shares with an
    earlier occurrence, or -1; ``on_group(first, last, extension)`` gets every class.
    """
    best = [-1] * len(left)
    stack: list[list[int]] = []  # extension, first, earliest so far
    for i in range(1, len(left) + 1):
        now = left[i] if i < len(left) else -1
        first = winner = i - 1
        while stack and stack[-1][0] >= max(now, 0):
            extension, begun, other = stack[-1]
            early, late = (other, winner) if order[other] < order[winner] else (winner, other)
            best[late] = extension
            if extension == now:
                stack[-1][2] = early
                break
            stack.pop()
            first, winner = begun, early
            if on_group:
                on_group(begun, i - 1, extension)
        if now >= 0 and (not stack or stack[-1][0] < now):
            stack.append([now, first, winner])
    return best


def anchor_bytes(size: int, seed: int):
    """For ``recurring_anchors``: the anchors of a shard."""

    def find(shard: Shard, stands: np.ndarray):
        found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start, stop in common.row_ranges(common.lengths(shard.text)):  # a byte takes some 40 here
            data, ends = common.joined_bytes(shard.text.slice(start, stop - start))
            n = np.where(stands[start:stop], np.diff(ends) - size + 1, 0)
            h = seed_hashes(data, seed)
            at, _, _, row = anchors(h, size - seed + 1, ends[:-1], n)
            found.append((h[at], row + start, at - ends[row]))
        return tuple(np.concatenate(x) for x in zip(*found))

    return find


class Repeats:
    """Maximal repeats of ``size`` bytes or more over all documents; see the module."""

    def __init__(self, docs: DataFrame, size: int = 100, seed: int = 40):
        self.size, self.seed = size, min(seed, size)
        self.corpus = Corpus(docs)
        self.copies = self.corpus.copies()

    def contexts(self, every: bool = False) -> DataFrame:
        """Anchors with the bytes around them, by target; repeats within a shard are settled and passed on as spans.

        With ``every`` they go along instead: ``more`` is their number for each context, and ``later_*`` list them in that
        order.
        """
        size, seed, corpus = self.size, self.seed, self.corpus
        targets, before = corpus.targets, size - seed

        def around(shard: Shard, other: pa.Table, number: int) -> pa.Table:
            data = blobs(other)
            if not data:
                return moved([])
            x = gather(data)
            raw, ends = common.joined_bytes(shard.text)
            row, at = x["row"].astype(np.int64), x["at"].astype(np.int64)
            order = np.lexsort((at, row))  # the first of equals stays
            row, at = row[order], at[order]
            have_left, have_right = np.minimum(at, before), np.minimum(ends[row + 1] - ends[row] - at, size)
            padded = np.concatenate([np.full(before, 255, np.uint8), raw, np.full(size, 255, np.uint8)])
            view = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, before + size), (1, 1))
            near = view[ends[row] + at].copy()
            head = near[:, :before]
            head[np.arange(before)[None, :] < (before - have_left)[:, None]] = 255
            tail = near[:, before:]
            tail[np.arange(size)[None, :] >= have_right[:, None]] = 255
            h = mixed(polynomial(BYTES[near[:, before : before + seed]].T, seed, BASE)[0])
            _, one, same = np.unique(near.view(f"S{before + size}")[:, 0], return_index=True, return_inverse=True)
            later = np.ones(len(row), bool)
            later[one] = False
            out = []
            if later.any() and not every:
                out.append((number % targets, PASS, number, dump(row=row[later], start=(at - have_left)[later], end=(at + have_right)[later])))
            names = {"row": row.astype(np.int32), "home": np.full(len(row), number, np.int32), "order": shard.order[row], "place": shard.place[row], "at": at.astype(np.int32)}
            own = {k: v[one] for k, v in names.items()} | { "left": have_left[one].astype(np.uint16), "right": have_right[one].astype(np.uint16), "near": near[one]}
            if every:
                own["more"] = np.bincount(same[later], minlength=len(one))
                own["first"] = np.cumsum(own["more"]) - own["more"]
                repeats = np.flatnonzero(later)
                repeats = repeats[np.argsort(same[repeats], kind="stable")]
            for t, part in split((h[one] % np.uint64(targets)).astype(np.int64), targets, **own):
                if every:
                    r = repeats[common.ranges(part.pop("first"), part["more"])]
                    part |= {f"later_{k}": v[r] for k, v in names.items()}
                out.append((t, DATA, number, dump(**part)))
            return moved(out)

        return corpus.with_docs(recurring_anchors(corpus, self.copies, anchor_bytes(size, seed)), around, MOVED)

    def spans(self) -> DataFrame:
        """Blobs ``doc, place, start, end`` (bytes) for each shard: every occurrence but the first of its group."""
        size, seed, shards = self.size, self.seed, self.corpus.shards

        def scan(data: list[dict]):
            x = gather(data)
            at = x["at"].astype(np.int64)
            covered = [np.zeros((0, 3), np.int64)]
            for member, prefix, extension in groups(x, size, seed, None):
                covered.append(np.stack([member, at[member] - extension, at[member] + prefix], axis=1))
            c = np.concatenate(covered)
            who, start, end = merged(c[:, 0], c[:, 1], c[:, 2])
            for s, part in split(x["home"][who], shards, row=x["row"][who].astype(np.int64), start=start, end=end):
                yield s, DATA, dump(**part)

        return self.corpus.at_targets(self.contexts(), scan)


def groups(x: dict[str, np.ndarray], size: int, seed: int, on_group):
    """Yields occurrences that repeat earlier ones (rows, prefixes, left extensions) of one target's contexts.

    ``on_group(rows, prefix, extension)``: gets every maximal repeat group with all its occurrences.
    """
    before = size - seed
    near, left, right = x["near"], x["left"].astype(np.int64), x["right"].astype(np.int64)
    suffix = np.ascontiguousarray(near[:, before:])
    array = sorted_order(suffix)
    lcp = common_prefixes(suffix[array], right[array])
    rank = np.empty(len(array), np.int64)
    rank[np.lexsort((x["at"], x["place"], x["order"]))] = np.arange(len(array))
    turned = np.ascontiguousarray(near[:, before - 1 :: -1] if before else near[:, :0])
    if before:
        by_left = sorted_order(turned)
        place_left = np.empty(len(by_left), np.int64)
        place_left[by_left] = np.arange(len(by_left))
    tree = intervals(lcp.tolist(), seed)
    if not tree:
        return
    first, last, prefix = (np.array(c, np.int64) for c in zip(*tree))
    step = 1_000_000
    n = last - first + 1
    ends = np.cumsum(n)
    k = 0
    while k < len(tree):  # some intervals at a time
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + step, "right")))
        node = np.repeat(np.arange(k, stop), n[k:stop])
        member = array[common.ranges(first[k:stop], n[k:stop])]
        if before:
            o = np.lexsort((place_left[member], node))
            member = member[o]
            shared = common_prefixes(turned[member], left[member])
        else:
            shared = np.zeros(len(member), np.int64)
        shared[np.concatenate([[True], node[1:] != node[:-1]])] = -1
        # groups too short are cut here: one scan serves all intervals
        need = np.maximum(size - prefix[node], 0)
        shared[shared < need] = -1
        emit = (lambda a, b, e: on_group(member[a : b + 1], int(prefix[node[a]]), e)) if on_group else None
        best = np.array(classes(shared.tolist(), rank[member].tolist(), emit), np.int64)
        some = best >= 0
        if some.any():
            yield member[some], prefix[node[some]], best[some]
        k = stop


def removals(docs: DataFrame, size: int = 100, seed: int = 40) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    repeats = Repeats(docs, size, seed)

    def digest(shard: Shard, other: pa.Table, _: int) -> pa.Table:
        data, (_, stands) = blobs(other), copied(shard, other)
        raw, ends = common.joined_bytes(shard.text)
        n = np.diff(ends)
        row, start, end = (np.zeros(0, np.int64),) * 3
        if data:
            x = gather(data)
            row, start, end = merged(x["row"], x["start"].astype(np.int64), x["end"].astype(np.int64))
        gone = np.bincount(row, end - start, len(n)).astype(np.int64)
        spans = np.bincount(row, minlength=len(n)).astype(np.int64)
        copy = ~stands & (n >= size)  # all of it stands in an earlier document
        gone[copy], spans[copy] = n[copy], 1
        blob = raw.tobytes()
        begin = np.searchsorted(row, np.arange(len(n) + 1))
        sha = []
        for r in range(len(n)):
            at, own = int(ends[r]), hashlib.sha256()
            if not copy[r]:
                for s, e in zip(start[begin[r] : begin[r + 1]].tolist(), end[begin[r] : begin[r + 1]].tolist()):
                    own.update(blob[at : int(ends[r]) + s])
                    at = int(ends[r]) + e
                own.update(blob[at : int(ends[r + 1])])
            sha.append(own.hexdigest())
        out = pa.table({"doc_id": shard.doc_id, "n_bytes": pa.array(n), "n_removed": pa.array(gone), "n_spans": pa.array(spans), "kept_sha256": pa.array(sha, pa.string())})
        return shard.repeat(out)

    return repeats.corpus.with_docs(repeats.copies.unionByName(repeats.spans(), allowMissingColumns=True), digest, RESULT)


def repeat_groups(docs: DataFrame, size: int = 100, seed: int = 40) -> DataFrame:
    """``group_id, length, doc_id, place, start``: maximal repeats of ``size`` bytes or more with all occurrences, copies standing once.

    A repeat longer than the context around an anchor is found as overlapping groups, one for each anchor in it, which have
    the same occurrences but for a shift. Such groups are joined: what they cover together is the maximal repeat, as a
    repeat that went on beyond an anchor's context would have another anchor there. Only where an inner part of a long
    repeat stands elsewhere too, it appears as the groups before, in and after that part.
    """
    found = common.table(groups_of_contexts(docs, size, seed).withColumn("group_id", F.col("target") * (1 << 32) + F.col("group_id")).drop("target"), "repeat-groups")
    member = F.struct(F.coalesce("doc_id", F.lit(int(NO_ID))).alias("doc_id"), "place", "start")
    heads = found.groupBy("group_id").agg(F.min(member).alias("first"), F.count("*").alias("n"))
    shifted = common.met(found, heads, "group_id", "start").withColumn("shift", F.xxhash64("doc_id", "place", F.col("start") - F.col("first.start")))
    alike = shifted.groupBy("group_id", "length", "first", "n").agg(F.sum(F.col("shift").cast("decimal(38,0)")).alias("members"))
    alike = alike.select("group_id", "n", "members", F.col("first.doc_id").alias("doc"), F.col("first.place").alias("at"), F.col("first.start").alias("s"), (F.col("first.start") + F.col("length")).alias("e"))
    w = Window.partitionBy("members", "n", "doc", "at").orderBy("s", "group_id")
    fresh = F.coalesce((F.col("s") > F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    runs = alike.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w)).groupBy("members", "n", "doc", "at", "run")
    whole = runs.agg(F.min_by("group_id", F.struct("s", "group_id")).alias("group_id"), (F.max("e") - F.min("s")).alias("length")).select("group_id", "length")
    return common.met(found.drop("length"), whole, "group_id", "start").select("group_id", "length", "doc_id", "place", "start")


def groups_of_contexts(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """``target, group_id, length, doc_id, place, start``: repeats within the context around each anchor."""
    repeats = Repeats(docs, size, seed)
    seed = repeats.seed

    def list_groups(batches):
        from pyspark import TaskContext

        from .shards import load

        blobs = [load(v) for b in batches for v, k in zip(b.column("blob").to_pylist(), b.column("kind").to_pylist()) if k == DATA]
        if not blobs:
            return
        x, out = gather(blobs), []
        part = TaskContext.get().partitionId()
        left, right, more = (x[n].astype(np.int64) for n in ("left", "right", "more"))
        first = np.cumsum(more) - more
        whole = np.zeros(len(more), bool)  # listed with all of its context

        seen = 0

        def numbered(rows, prefix, extension):
            nonlocal seen
            whole[rows] |= (right[rows] == prefix) & (left[rows] == extension)
            # an anchor of windows that reach beyond the repeat only is not one wherever the repeat occurs; its windows have others
            string = x["near"][rows[0], size - seed - extension : size - seed + prefix]
            if extension not in least(seed_hashes(string, seed), size - seed + 1):
                return
            later = common.ranges(first[rows], more[rows])
            for kind, which in (("", rows), ("later_", later)):
                order, place, at = (x[kind + k][which] for k in ("order", "place", "at"))
                out.extend((part, seen, prefix + extension, None if i == NO_ID else i, *r) for i, *r in zip(order.tolist(), place.tolist(), (at - extension).tolist()))
            seen += 1

        for _ in groups(x, size, seed, numbered):
            pass
        for r in np.flatnonzero(~whole & (more > 0) & (left + right >= size)).tolist():  # equal contexts of one shard only
            numbered(np.array([r]), int(right[r]), int(left[r]))
        names = ["target", "group_id", "length", "doc_id", "place", "start"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(6)], names)

    rows = repeats.contexts(every=True)
    return rows.repartitionById(repeats.corpus.targets, rows["target"]).mapInArrow(list_groups, ", ".join(f"{c} long" for c in ("target", "group_id", "length", "doc_id", "place", "start")))


#: The removals by brute force over all strings of 100 bytes, in hexadecimal.
SQL = """
with rows as (select doc_id, coalesce(text, '') as text, count(*) as times from documents group by all),
d as (select row_number() over (order by doc_id nulls last, text) as k, doc_id, times, hex(encode(text)) as h, cast(octet_length(encode(text)) as bigint) as n from rows),
places as (select k, unnest(range(n - 99)) as i, unnest(list_transform(range(n - 99), lambda i: md5_number(substr(h, 2 * i + 1, 200)))) as m from d where n >= 100),
again as (select k, i from (select k, i, row_number() over (partition by m order by k, i) as place from places) where place > 1),
islands as (select k, i, sum(fresh) over (partition by k order by i) as island from (select k, i, case when i > lag(i) over (partition by k order by i) + 100 then 1 else 0 end as fresh from again)),
spans as (select k, island, min(i) as s, max(i) + 100 as e from islands group by k, island),
sums as (select k, cast(sum(e - s) as bigint) as n_removed, count(*) as n_spans from spans group by k),
cuts as (select k, coalesce(lag(e) over (partition by k order by s), 0) as b, s as e from spans union all select d.k, coalesce(last, 0), n from d left join (select k, max(e) as last from spans group by k) using (k)),
kept as (select k, sha256(unhex(string_agg(substr(h, 2 * b + 1, 2 * (e - b)), '' order by b))) as kept_sha256 from cuts join d using (k) group by k)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, kept_sha256
from (select *, unnest(range(times)) as copy from d) d left join sums using (k) join kept using (k)
"""
