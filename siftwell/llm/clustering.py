"""Centroid clustering: plain Lloyd over integer vectors.

Vectors are made integers once and written to the shared folder. Each round broadcasts the centroids; tasks take integer
squared differences to each centroid, the lowest index of the least wins, and each partition gives one row of integer sums
for each centroid that it met (and each limb, see below); a group-by merges those, and the driver, which gets no more than
one row a centroid and limb, divides. No vector leaves the executors, and none is shuffled, so equal vectors, however
many, are no hot key.

Everything is exact: components that do not fit 26 bits are kept as decimal texts and calculated with Python's integers, and
sums travel as limbs of 40 bits, which a sum of longs over all partitions cannot overflow.

Nulls, ties, repeats: a vector that is null, of another length, or with a null or non-finite component takes no part and
gets no row. Rows without id never begin a centroid but belong to one. Rows that share an id are vectors of their own; of
several that could begin a centroid the one whose stored bytes are least goes first. With fewer vectors than centroids
there are as many centroids as vectors; an empty table gives no rows. A distance or inertia beyond a long is null. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Components below this fit an int64 when 64 (and up to a thousand) squared differences of them are added.
NARROW = 1 << 26
LIMB = 40
LONGEST = (1 << 63) - 1
RESULT = "vec_id long, none boolean, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def integers(rows: DataFrame, size: int, scale: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, none, small, wide``: ``floor(scale * x)`` of the vectors that take part, as 32-bit integers one after
    another; ``wide`` has them as decimals where they need more. ``none``: there is no id."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fit = [v is not None and len(v) == size for v in b["v"]]
            b = b[np.array(fit, bool)] if len(b) else b
            x = np.array([np.asarray(v, float) for v in b["v"]], float).reshape(-1, size)
            fit = np.isfinite(x).all(1)
            b, x = b[fit], x[fit]
            wide = (np.abs(x) >= NARROW / scale).any(1)
            small = np.floor(np.where(wide[:, None], 0, x) * scale).astype("<i4")
            big = [",".join(str(math.floor(Fraction(c) * scale)) for c in row.tolist()) if w else None for w, row in zip(wide, x)]
            yield pd.DataFrame({"vec_id": b["vec_id"], "none": b["none"], "small": [r.tobytes() for r in small], "wide": pd.Series(big, b.index, dtype=object)})

    row = rows.select(F.coalesce(F.col(ident).cast("long"), F.lit(0)).alias("vec_id"), F.col(ident).isNull().alias("none"), F.col(vector).cast("array<double>").alias("v"))
    return row.filter(F.size("v") == size).mapInPandas(make, "vec_id long, none boolean, small binary, wide string")


def numbers(batch: pd.DataFrame, size: int) -> np.ndarray:
    """The vectors of a batch, as int64 or, if some are wide, as Python's integers."""
    x = np.frombuffer(b"".join(batch["small"]), "<i4").reshape(-1, size).astype(np.int64)
    wide = batch["wide"].notna().to_numpy()
    if wide.any():
        x = x.astype(object)
        x[wide] = [[int(c) for c in w.split(",")] for w in batch["wide"][wide]]
    return x


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each vector; the smaller number wins a tie."""
    narrow = x.dtype != object and all(abs(c) < NARROW for row in centroids for c in row)
    c = np.array(centroids, np.int64 if narrow else object)
    x = x if narrow else x.astype(object)
    d = np.stack([((x - row) ** 2).sum(1) for row in c], 1)
    at = d.argmin(1).astype(int)
    return at, d[np.arange(len(x)), at]


def limbs(totals: np.ndarray) -> Iterator[np.ndarray]:
    """Integers of any size as parts of LIMB bits from the lowest; the last is signed."""
    while any(abs(v) >= 1 << LIMB for v in totals.flat):
        yield totals & ((1 << LIMB) - 1)
        totals = totals >> LIMB
    yield totals


def summed(rows: DataFrame, centroids: list[list[int]], size: int) -> dict[int, list[int]]:
    """For each centroid that vectors are nearest to: their number, the sum of each component, the sum of distances."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(centroids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(sent.value), size + 2), object)
        for b in batches:
            if len(b):
                x = numbers(b, size)
                at, d = nearest(x, sent.value)
                for k in np.unique(at):
                    own = at == k
                    totals[k] += np.array([int(own.sum()), *x[own].sum(0).tolist(), sum(d[own].tolist())], object)
        met = np.flatnonzero(totals[:, 0].astype(bool))
        for level, part in enumerate(limbs(totals[met])) if len(met) else ():
            yield pd.DataFrame({"cluster": met.astype(np.int32), "level": np.full(len(met), level, np.int32), "sums": [[int(v) for v in r] for r in part]})

    parts = rows.select("small", "wide").mapInPandas(partial, "cluster int, level int, sums array<long>")
    merged = parts.groupBy("cluster", "level").agg(F.array(*(F.sum(F.col("sums")[i]) for i in range(size + 2))).alias("sums"))
    out: dict[int, list[int]] = {}
    for r in merged.collect():
        had = out.setdefault(r.cluster, [0] * (size + 2))
        out[r.cluster] = [a + (b << (LIMB * r.level)) for a, b in zip(had, r.sums)]
    sent.unpersist()
    return out


def first(rows: DataFrame, many: int, seed: int, size: int) -> list[list[int]]:
    """The vectors whose ids are least by hash."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    got = rows.filter("not none").select(key.alias("key"), "small", "wide").orderBy("key", "small", "wide").limit(many).toPandas()
    return [[int(c) for c in row] for row in numbers(got, size)] if len(got) else []


def fitted(rows: DataFrame, centroids: list[list[int]], rounds: int, size: int, report: Callable[[int, int], None] | None = None) -> list[list[int]]:
    """Centroids after ``rounds`` of assigning all vectors and moving every centroid that has some; ``report`` hears of each round and its inertia."""
    for number in range(rounds):
        sums = summed(rows, centroids, size)
        centroids = [[v // sums[k][0] for v in sums[k][1:-1]] if k in sums else c for k, c in enumerate(centroids)]
        if report is not None:
            report(number, sum(s[-1] for s in sums.values()))
    return centroids


def clustered(rows: DataFrame, many: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector that takes part: its cluster, squared distance, the inertia of the cluster and of all, and the
    hash of its centroid. The centroids are few enough for each task to have them all."""
    whole = common.table(integers(rows, size, scale, ident, vector), "integers")
    centroids = fitted(whole, first(whole, many, seed, size), rounds, size)
    sums = summed(whole, centroids, size) if centroids else {}
    own = {k: s[-1] for k, s in sums.items()}
    all_of_them = sum(own.values())
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda values: pd.array([None if v > LONGEST else v for v in values], "Int64")

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and centroids:
                at, d = nearest(numbers(b, size), centroids)
                yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy(), "none": b["none"].to_numpy(), "cluster": at.astype(np.int32), "distance": long(d.tolist()), "cluster_inertia": long(own[k] for k in at.tolist()), "inertia": long([all_of_them] * len(b)), "centroid_sha256": [sha[k] for k in at.tolist()]})

    return whole.mapInPandas(assign, RESULT).withColumn("vec_id", F.when(~F.col("none"), F.col("vec_id"))).drop("none")


def sql(many: int = 8, rounds: int = 10, size: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The same for DuckDB, a pair of steps for each round."""
    steps = [
        f"""e as materialized (select row_number() over () as r, vec_id, list_transform(embedding, lambda x: cast(floor({scale} * cast(x as double)) as bigint)) as v
      from embeddings where len(embedding) = {size} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {size})""",
        f"x as materialized (select r, unnest(range({size})) as i, unnest(v) as a from e)",
        f"""c0 as materialized (select k, unnest(range({size})) as i, unnest(v) as c from (select row_number() over (order by sha256('{seed}:' || vec_id)) - 1 as k, v from e where vec_id is not null) where k < {many})""",
    ]
    near = lambda t: f"n{t} as materialized (select r, arg_min(k, d * {many} + k) as k, min(d) as d from (select r, k, sum((a - c) * (a - c)) as d from x join c{t} using (i) group by r, k) group by r)"
    for t in range(rounds):
        steps.append(near(t))
        steps.append(f"c{t + 1} as materialized (select k, i, coalesce(m, c) as c from c{t} left join (select k, i, (s - ((s % n + n) % n)) // n as m from (select k, i, sum(a) as s, count(*) as n from x join n{t} using (r) group by k, i)) using (k, i))")
    steps.append(near(rounds))
    steps.append(f"f as (select k, sha256(string_agg(cast(cast(c as bigint) as varchar), ',' order by i)) as centroid_sha256 from c{rounds} group by k)")
    body = f"select vec_id, cast(k as integer) as cluster, cast(d as bigint) as distance, cast(sum(d) over (partition by k) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia, centroid_sha256 from n{rounds} join e using (r) join f using (k)"
    return "with " + ",\n".join(steps) + "\n" + body


SQL = sql()
