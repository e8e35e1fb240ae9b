"""Listing, searching and changing leads and their logs. Every list is ordered by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions import score


#: So many rows are put in order in one place at most.
AT_ONCE = 10_000


def page(rows: DataFrame, skip: int = 0, limit: int = 100, key: str = "id", at_once: int = AT_ONCE) -> DataFrame:
    """``limit`` rows after the first ``skip`` in the order of ``key``, a number.

    Near the beginning this is a top-k, no total sort. Farther on, rows are counted in up to 256 ranges of the key, whose bounds are
    approximate quantiles; sums of the counts tell in which ranges the page lies, and only these are read again, in ranges of
    their own until few rows are left: the bounds reach the scan as a filter. Rows without key come first, as one range.
    """
    if skip + limit <= at_once:
        return rows.orderBy(key).offset(skip).limit(limit)
    k = F.col(key)
    many = rows.count()
    parts = max(2, min(256, 4 * many // at_once))
    bounds = rows.agg(F.percentile_approx(k, [i / parts for i in range(1, parts)], 20 * parts).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    place = F.when(k.isNull(), F.lit(-1)).otherwise(found_among(k, bounds))
    counts = {r["place"]: r["n"] for r in rows.groupBy(place.alias("place")).agg(F.count("*").alias("n")).collect()}  # a row a range
    before, wanted, passed = 0, [], 0
    for p in sorted(counts):
        if before + counts[p] > skip and before < skip + limit:
            wanted.append(p)
        elif before + counts[p] <= skip:
            passed = before + counts[p]
        before += counts[p]
    if not wanted:
        return rows.limit(0)
    low, high = wanted[0], wanted[-1]
    some = F.lit(True)
    if low > 0:
        some = some & (k >= F.lit(bounds[low - 1]))
    if 0 <= high < len(bounds):
        some = some & (k < F.lit(bounds[high]))
    if high < 0:
        some = k.isNull()
    elif low < 0:
        some = k.isNull() | some
    there = sum(counts[p] for p in wanted)
    if there == many:  # one key has so many rows
        return rows.orderBy(key).offset(skip).limit(limit)
    return page(rows.filter(some), skip - passed, limit, key, at_once)


def found_among(k: Column, bounds: list) -> Column:
    """How many of the sorted bounds are no more than ``k``, by halves."""
    if not bounds:
        return F.lit(0)
    middle = len(bounds) // 2
    return F.when(k < F.lit(bounds[middle]), found_among(k, bounds[:middle])).otherwise(F.lit(middle + 1) + found_among(k, bounds[middle + 1 :]))


def of_organization(leads: DataFrame, organization_id: int, active_only: bool = False) -> DataFrame:
    """Deleted leads are listed too unless ``active_only``."""
    rows = leads.filter(F.col("organization_id") == organization_id)
    return rows.filter("is_active") if active_only else rows


def lookup(rows: DataFrame, column: str, value: object, key: str = "id") -> DataFrame:
    """The first row with ``column`` = ``value``, or none."""
    return rows.filter(F.col(column) == F.lit(value)).orderBy(key).limit(1)


def lookup_many(rows: DataFrame, wanted: DataFrame, column: str, key: str = "id") -> DataFrame:
    """The first row for each value in ``wanted``: one join instead of a query a value; left without match: nulls."""
    others = [c for c in rows.columns if c not in (column, key)]
    first = rows.groupBy(column).agg(F.min(key).alias(key), *(F.min_by(c, key).alias(c) for c in others))
    return wanted.join(first, column, "left")


def search(leads: DataFrame, term: str) -> DataFrame:
    """Leads whose website, company or industry contains the term, whatever the case; an empty term finds all."""
    found = lambda c: F.coalesce(F.lower(c).contains(term.lower()), F.lit(False))
    return leads.filter(found(F.col("website")) | found(F.col("company_name")) | found(F.col("industry")))


def in_band(leads: DataFrame, band: str, column: str = "score") -> DataFrame:
    return leads if band == "all" else leads.filter(score.band(F.col(column)) == band)


def usage_range(records: DataFrame, organization_id: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """Usage of an organization between two instants, both included, either open."""
    rows = records.filter(F.col("organization_id") == organization_id)
    if start:
        rows = rows.filter(F.col("recorded_at") >= F.lit(start).cast("timestamp_ntz"))
    return rows.filter(F.col("recorded_at") <= F.lit(end).cast("timestamp_ntz")) if end else rows


def on_day(rows: DataFrame, day: str, column: str = "created_at") -> DataFrame:
    d = F.lit(day).cast("timestamp_ntz")
    return rows.filter((F.col(column) >= d) & (F.col(column) < d + F.expr("interval 1 day")))


def visible_to(leads: DataFrame, callers: DataFrame) -> DataFrame:
    """Leads of the callers' own organizations."""
    return leads.join(callers.select("organization_id"), "organization_id", "left_semi")


def access(leads: DataFrame, caller_organization: int) -> Column:
    return F.when(F.col("organization_id") == caller_organization, "ok").otherwise("forbidden")


def create_status(caller_organization: int, caller: int) -> Column:
    """Why a lead may not be created; organization before owner."""
    return F.when(F.col("organization_id") != caller_organization, "wrong organization").when(F.col("owner_id") != caller, "wrong owner").otherwise("ok")


def displayed() -> list[Column]:
    """Columns as a table shows them: nothing becomes 'N/A' and the like."""
    either = lambda c, text: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(text)).alias(c)
    return [either("company_name", "N/A"), either("industry", "Unknown Industry"), either("employees", "N/A"), either("contact_name", "N/A"), F.date_format("created_at", "MMM dd, yyyy").alias("created")]


def average_score(rows: DataFrame, column: str = "score") -> DataFrame:
    mean = F.coalesce(F.avg(F.coalesce(F.col(column), F.lit(0.0))), F.lit(0.0))
    return rows.agg(mean.alias("avg_score"))


def recent(rows: DataFrame, by: str, many: int = 5, key: str = "id") -> DataFrame:
    """The first ``many`` rows of each group."""
    w = Window.partitionBy(by).orderBy(key)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= many)


def inserted(existing: DataFrame, new: DataFrame, unique: str) -> tuple[DataFrame, DataFrame]:
    """Rows of ``new`` whose unique value is free, and the rejected ones with a reason. Within ``new`` the smallest id wins."""
    first = new.withColumn("_place", F.row_number().over(Window.partitionBy(unique).orderBy("id")))
    known = existing.select(F.col(unique).alias("_taken")).distinct()
    judged = first.join(known, F.col(unique) == F.col("_taken"), "left").withColumn("reason", F.when(F.col("_taken").isNotNull() | (F.col("_place") > 1), F.lit("taken"))).drop("_taken", "_place")
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def updated(rows: DataFrame, changes: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Partial update: ``changes`` has ``key`` and, for each column, ``set_<column>`` and ``<column>``; a set null overwrites."""
    c = changes.select(F.col(key).alias("_key"), *(F.col(n).alias(f"_new_{n}") for n in columns), *(F.col(f"set_{n}").alias(f"_set_{n}") for n in columns))
    joined = rows.join(c, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"_set_{n}"), F.lit(False)), F.col(f"_new_{n}")).otherwise(F.col(n)).alias(n) if n in columns else F.col(n) for n in rows.columns])


def soft_deleted(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is in ``gone`` stay, as no longer active; for tables that are changed in place see ``tables.Table``."""
    marks = gone.select(F.col(key).alias("_gone")).distinct()
    joined = rows.join(marks, F.col(key) == F.col("_gone"), "left")
    return joined.select(*((F.col("is_active") & F.col("_gone").isNull()).alias(c) if c == "is_active" else F.col(c) for c in rows.columns))


def prepended(rows: DataFrame, new: DataFrame) -> DataFrame:
    return new.unionByName(rows)


def removed(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")


def replaced(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new`` take the place of those with their key; keys that are not there are not added."""
    return removed(rows, new, key).unionByName(new.join(rows.select(key), key, "left_semi").select(*rows.columns))


def counted_usage(organizations: DataFrame, records: DataFrame) -> DataFrame:
    """The organizations with the quantities of their usage records summed up."""
    sums = records.groupBy("organization_id").agg(F.sum("quantity").cast("long").alias("usage_count"))
    return organizations.join(sums, organizations["id"] == sums["organization_id"], "left").select(organizations["*"], F.coalesce("usage_count", F.lit(0)).cast("long").alias("usage_count"))


def first_users(users: DataFrame) -> DataFrame:
    """``organization_id, email`` of the first user of each organization."""
    return users.groupBy("organization_id").agg(F.min_by("email", "id").alias("email"))


def log_event(kind: str, *columns: str) -> Column:
    """A structured log record as JSON."""
    return F.to_json(F.struct(F.lit(kind).alias("event"), *columns))


def requests(boxes: DataFrame, column: str = "urls") -> DataFrame:
    """A row for each non-blank line of a text box; repeats stay."""
    return boxes.withColumn("url", F.explode(F.split(column, "\n"))).withColumn("url", F.trim("url")).filter("url <> ''").drop(column)


def public_users(users: DataFrame) -> DataFrame:
    """Users as others may see them."""
    return users.drop("hashed_password")


def usable_key() -> Column:
    return F.col("is_active") & ~F.col("is_revoked")


def new_leads(wanted: DataFrame) -> DataFrame:
    """``wanted(website, organization_id, owner_id, ...)`` as rows to append, with what a lead begins with."""
    return wanted.withColumns({
        "score": F.lit(0.0), "qualification_label": F.lit("Low Priority"), "scrape_confidence": F.lit(0.0), "email_confidence": F.lit(0.0), "enrichment_confidence": F.lit(0.0),
        "enrichment_source": F.lit("none"), "email_source": F.lit("none"), "scrape_source": F.lit("none"), "outreach_sent": F.lit(False), "is_active": F.lit(True), "is_verified": F.lit(False),
    })


def new_subscriptions(wanted: DataFrame) -> DataFrame:
    """``wanted(organization_id, stripe_subscription_id, plan_name)`` as rows to append."""
    return wanted.withColumns({"status": F.lit("active"), "cancel_at_period_end": F.lit(False)})


def exportable(leads: DataFrame, organizations: DataFrame) -> DataFrame:
    """Leads of the organizations that may export."""
    return leads.join(organizations.select(F.col("id").alias("organization_id")), "organization_id", "left_semi")


def export(rows: DataFrame, path: str, kind: str = "csv") -> None:
    """Writes rows as ``csv`` (with a header), ``json``, ``parquet`` or ``orc``, in as many files as there are partitions."""
    rows.write.options(**({"header": "true"} if kind == "csv" else {})).format(kind).save(path)
