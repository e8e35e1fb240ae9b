"""The same work on streams: micro-batches of pages, windows of daily usage, leads counted once, retries, admission."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from siftwell.functions import fixed
from siftwell.plans.process import processed, write


def process_stream(pages: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Processes a stream of pages into leads and logs; a batch that is run again overwrites its own folder, so nothing is doubled."""

    def process(batch: DataFrame, number: int) -> None:
        write(processed(batch, **options), f"{out}/batch={number}", "overwrite")

    return pages.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_usage_stream(leads: DataFrame, late: str = "1 day") -> DataFrame:
    """Leads of each organization and day as a windowed count; each lead once, late ones up to ``late``."""
    once = leads.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["id"])
    n = once.groupBy(F.window("created_at", "1 day").alias("w"), "organization_id").agg(F.count("*").alias("n"))
    return n.select("organization_id", F.to_date("w.start").alias("day"), "n")


#: Failures in a row after which a lead is tried again, and seconds until then.
RETRIES, DELAY = 3, 60


def retries(attempts: DataFrame) -> DataFrame:
    """``lead_id, id, failures, action, at`` for ``attempts(id, lead_id, success, created_at)``: what follows each.

    ``done`` after a success; after a failure ``retry``, at the time given, or ``failed`` once RETRIES were in vain.
    """
    w = Window.partitionBy("lead_id").orderBy("created_at", "id")
    ok = F.col("success").cast("int")
    rows = attempts.withColumn("_done", F.sum(ok).over(w.rowsBetween(Window.unboundedPreceding, 0)) - ok)  # successes before
    n = F.sum((~F.col("success")).cast("int")).over(Window.partitionBy("lead_id", "_done").orderBy("created_at", "id"))
    rows = rows.withColumn("failures", n.cast("int"))
    action = F.when(F.col("success"), "done").when(F.col("failures") <= RETRIES, "retry").otherwise("failed")
    rows = rows.withColumn("action", action)
    return rows.select("lead_id", "id", "failures", "action", F.when(F.col("action") == "retry", F.col("created_at") + F.expr(f"interval {DELAY} seconds")).alias("at"))


def retry_stream(attempts: DataFrame) -> DataFrame:
    """``retries`` on a stream: the failures in a row of each lead are the state."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"])  # a lead's attempts within a micro-batch
        out = []
        for r in rows.itertuples():
            failures = n if r.success else n + 1
            action = "done" if r.success else "retry" if failures <= RETRIES else "failed"
            out.append((key[0], r.id, failures, action, r.created_at + pd.Timedelta(seconds=DELAY) if action == "retry" else None))
            n = 0 if r.success else failures
        state.update((n,))
        yield pd.DataFrame(out, columns=["lead_id", "id", "failures", "action", "at"])

    schema = f"lead_id {dict(attempts.dtypes)['lead_id']}, id {dict(attempts.dtypes)['id']}, failures int, action string, at {dict(attempts.dtypes)['created_at']}"
    return attempts.groupBy("lead_id").applyInPandasWithState(follow, schema, "failures int", "append", "NoTimeout")


class Retrying(StatefulProcessor):
    """Failures in a row of each lead, and a timer that emits the lead again when its time has come; state that nothing is heard of for ``forget`` goes."""

    def __init__(self, delay: float = DELAY, most: int = RETRIES, forget: float = 86_400):
        self.delay, self.most, self.forget = delay, most, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("failures", "n int, id long", ttlDurationMs=int(self.forget * 1000))

    def clear(self) -> None:
        self.state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        attempts = pd.concat(list(rows)).sort_values(["created_at", "id"])  # a lead's attempts within a micro-batch
        n, out, now = self.state.get()[0] if self.state.exists() else 0, [], timerValues.getCurrentProcessingTimeInMs()
        for r in attempts.itertuples():
            n = 0 if r.success else n + 1
            out.append((key[0], r.id, n, "done" if r.success else "waiting" if n <= self.most else "failed", pd.Timestamp(now, unit="ms")))
        self.clear()
        if 0 < n <= self.most:
            self.state.update((n, int(attempts["id"].iloc[-1])))
            self.handle.registerTimer(now + int(self.delay * 1000))
        yield pd.DataFrame(out, columns=["lead_id", "id", "failures", "action", "at"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            n, last = self.state.get()
            yield pd.DataFrame([(key[0], last, n, "retry", pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms"))], columns=["lead_id", "id", "failures", "action", "at"])

    def close(self) -> None:
        pass


#: The state store that timers need.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def timed_retries(attempts: DataFrame, delay: float = DELAY, most: int = RETRIES, forget: float = 86_400) -> DataFrame:
    """A stream of ``attempts(id, lead_id, success, created_at)`` as ``lead_id, id, failures, action, at``.

    An attempt gives ``done``, ``waiting`` or, once ``most`` retries were in vain, ``failed``. ``delay`` seconds after a failure that is to be
    retried a row ``retry`` comes of itself, by a timer, unless another attempt has been heard of: this is what is sent to work again.
    """
    attempts.sparkSession.conf.set(*ROCKSDB)
    rows = attempts.select(F.col("lead_id").cast("long").alias("lead_id"), F.col("id").cast("long").alias("id"), "success", F.col("created_at").cast("timestamp").alias("created_at"))
    return rows.groupBy("lead_id").transformWithStateInPandas(Retrying(delay, most, forget), "lead_id long, id long, failures int, action string, at timestamp", "Append", "ProcessingTime")


class Admitting(StatefulProcessor):
    """How many leads an organization has asked for on a day; one key's batches take their turn, whatever micro-batch they come in."""

    def __init__(self, late: float):
        self.late = late

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getValueState("asked", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batches = pd.concat(list(rows)).sort_values("batch_id")
        before, out = self.asked.get()[0] if self.asked.exists() else 0, []
        if not self.asked.exists():  # the day's end and what may come after it
            self.handle.registerTimer(int((pd.Timestamp(key[1]) + pd.Timedelta(days=1)).timestamp() * 1000 + self.late * 1000))
        for r in batches.itertuples():
            left = int(r.remaining) - before
            out.append((r.batch_id, key[0], key[1], r.n, "empty" if r.n == 0 else "limit reached" if left <= 0 else "too many" if r.n > left else "accepted"))
            before += int(r.n)
        self.asked.update((before,))
        yield pd.DataFrame(out, columns=["batch_id", "organization_id", "day", "n", "status"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.asked.clear()
        yield pd.DataFrame([], columns=["batch_id", "organization_id", "day", "n", "status"])

    def close(self) -> None:
        pass


def admission_stream(batches: DataFrame, usage: DataFrame, late: str = "1 hour") -> DataFrame:
    """``quota.admit`` on a stream of ``batches(batch_id, organization_id, n, at)``: status of each, all or nothing.

    ``usage`` (see ``quota.usage``) is what is known of organizations before the day's batches. State is kept by organization and day, so two
    batches never see the same room, and goes when the watermark has passed the day by ``late``; batches that come later than that are dropped.
    """
    batches.sparkSession.conf.set(*ROCKSDB)
    known = usage.select(F.col("organization_id").alias("_of"), F.col("remaining_daily_leads").cast("long").alias("remaining"))
    rows = batches.withWatermark("at", late).join(known, F.col("organization_id") == F.col("_of"), "left")
    rows = rows.select(F.col("batch_id").cast("long").alias("batch_id"), F.col("organization_id").cast("long").alias("organization_id"), F.to_date("at").alias("day"), F.col("n").cast("long").alias("n"), F.coalesce("remaining", F.lit(fixed.PLAN_LIMITS["free"])).cast("long").alias("remaining"), "at")
    seconds = pd.Timedelta(late).total_seconds()
    return rows.groupBy("organization_id", "day").transformWithStateInPandas(Admitting(seconds), "batch_id long, organization_id long, day date, n long, status string", "Append", "EventTime")
