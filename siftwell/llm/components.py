"""Connected components of a link table, on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable vertex of each of ``n`` vertices, within one task."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(again := new[new], new):
            new = again
        if np.array_equal(new, label):
            return label
        label = new


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``vertex, component`` (smallest vertex reachable) of every vertex in ``links(a, b)``.

    Alternates two steps until nothing changes: every neighbour, then every smaller neighbour, is linked to the
    smallest one around. Only minima are grouped, with map-side aggregation, so a vertex with very many links
    stays cheap; each round is written to the shared folder.
    """
    links = common.table(normal(links), "links")
    before = None
    for _ in range(most_rounds):
        links = common.table(small(large(links)), "links")
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = links.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("component"))
    return found.union(found.select(F.col("component").alias("vertex"), "component").distinct())


def normal(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def large(links: DataFrame) -> DataFrame:
    """Larger neighbours are linked to the smallest of a vertex and its neighbours."""
    least = links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    # a vertex with no smaller neighbour is its own minimum
    down = links.join(least, links["b"] == least["v"], "left").select("a", F.coalesce("m", "b").alias("b"))
    up = least.select(F.col("v").alias("a"), F.col("m").alias("b"))
    return normal(down.union(up))


def small(links: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
    down = links.join(least, links["a"] == least["v"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return normal(down.union(least.select(F.col("v").alias("a"), F.col("m").alias("b"))))
