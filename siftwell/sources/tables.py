"""Tables of leads and their like on Parquet, changed in place: appends that keep a column unique, updates that rewrite only
the shares they touch, and sums that are kept up by deltas.

A table is laid out in shares by hash of its key, and within a share by the batch that rows came with. Writes overwrite
exactly the partitions they have rows for, when all their tasks have succeeded: a task that fails leaves nothing, and a
batch that is run again replaces itself. One writer at a time is assumed, as micro-batches of one query are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import leads

SHARE, BATCH = "share", "batch"


def put(rows: DataFrame, path: str, *parts: str) -> None:
    """Overwrites the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


class Table:
    """Rows at ``path`` in ``shares`` shares by ``key``; the number of shares is the table's for good."""

    def __init__(self, spark: SparkSession, path: str, shares: int = 64, key: str = "id"):
        self.spark, self.path, self.shares, self.key = spark, path, shares, key

    def share(self, key: str | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(key or self.key).cast("string")), F.lit(self.shares)).cast("int")

    def laid_out(self, rows: DataFrame) -> DataFrame:
        """One file for each share and batch."""
        return rows.withColumn(SHARE, self.share()).repartition(SHARE)

    def create(self, rows: DataFrame) -> None:
        """The table's first rows; they are batch 0."""
        put(self.laid_out(rows).withColumn(BATCH, F.lit(0).cast("long")), self.path, SHARE, BATCH)

    def read(self) -> DataFrame:
        return self.parts().drop(SHARE, BATCH)

    def parts(self) -> DataFrame:
        return self.spark.read.parquet(self.path).withColumns({SHARE: F.col(SHARE).cast("int"), BATCH: F.col(BATCH).cast("long")})

    def append(self, new: DataFrame, batch: int, unique: str) -> DataFrame:
        """Adds the rows of ``new`` whose ``unique`` value is free; gives back those whose value is taken, with a reason.

        ``batch``: a number above 0 of its own for each append. Run again, it replaces what it added: its own rows take no value.
        """
        known = self.parts().filter(F.col(BATCH) != batch).select(unique)
        free, taken = leads.inserted(known, new, unique)
        put(self.laid_out(free).withColumn(BATCH, F.lit(batch).cast("long")), self.path, SHARE, BATCH)
        return taken

    def update(self, changes: DataFrame, columns: list[str]) -> int:
        """Partial update (see ``leads.updated``) by a table of changes; returns how many shares were rewritten.

        The shares with changes, a number each, are all that the driver gets; the scan reads no others, and no others are written.
        """
        touched = sorted(r[0] for r in changes.select(self.share().alias(SHARE)).distinct().collect())
        if touched:
            own = self.parts().filter(F.col(SHARE).isin(touched))
            put(leads.updated(own, changes, columns, self.key).repartition(SHARE), self.path, SHARE, BATCH)
        return len(touched)

    def soft_delete(self, gone: DataFrame) -> int:
        """Rows whose keys are in ``gone`` stay, as no longer active."""
        marks = gone.select(self.key).distinct().withColumns({"is_active": F.lit(False), "set_is_active": F.lit(True)})
        return self.update(marks, ["is_active"])


class Sums:
    """Sums of ``value`` by ``by``, kept up by numbered batches: a base up to some batch, and the deltas after it.

    A batch that is added again replaces its delta; one that the base has already is passed over, so no replay counts twice.
    """

    def __init__(self, spark: SparkSession, path: str, by: list[str], value: str = "quantity"):
        self.spark, self.by, self.value = spark, by, value
        self.base, self.deltas = f"{path}/base", f"{path}/deltas"

    def create(self, schema: DataFrame) -> None:
        """Empty sums for records like those of ``schema``."""
        none = self.summed(schema.limit(0))
        marked = lambda c: none.unionByName(self.spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema))).withColumn(c, F.lit(0).cast("long"))
        put(marked("upto"), self.base, "upto")
        put(marked(BATCH), self.deltas, BATCH)

    def summed(self, records: DataFrame) -> DataFrame:
        return records.groupBy(*self.by).agg(F.sum(self.value).cast("long").alias(self.value))

    def upto(self) -> int:
        return int(self.spark.read.parquet(self.base).agg(F.max("upto")).first()[0])

    def add(self, records: DataFrame, batch: int) -> None:
        """The sums of a batch, numbered from 1. A batch without records leaves a mark, so that a replay of it does too."""
        if batch > self.upto():
            mark = self.spark.read.parquet(self.deltas).filter(F.col(BATCH) == 0).drop(BATCH)
            put(self.summed(records).unionByName(mark).withColumn(BATCH, F.lit(batch).cast("long")), self.deltas, BATCH)

    def current(self) -> DataFrame:
        upto = self.upto()
        base = self.spark.read.parquet(self.base).filter(F.col("upto") == upto).drop("upto")
        deltas = self.spark.read.parquet(self.deltas).filter(F.col(BATCH) > upto).drop(BATCH)
        return self.summed(base.unionByName(deltas).filter(F.col(self.value).isNotNull()))

    def compact(self) -> int:
        """All deltas so far go into a new base; returns the batch up to which it counts."""
        last = int(self.spark.read.parquet(self.deltas).agg(F.max(BATCH)).first()[0])
        if last > self.upto():
            mark = self.spark.read.parquet(self.base).filter("upto = 0").drop("upto")
            put(self.current().unionByName(mark).withColumn("upto", F.lit(last).cast("long")), self.base, "upto")
        return self.upto()
