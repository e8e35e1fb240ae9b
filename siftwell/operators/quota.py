"""Plans, quotas and subscriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import fixed

from .leads import on_day

#: Sides of plan joins are broadcast by Spark itself where their measured size allows.


def limit_of(plan: Column) -> Column:
    """Leads a day; every plan but pro and enterprise counts as free."""
    return F.when(plan == "pro", fixed.PLAN_LIMITS["pro"]).when(plan == "enterprise", fixed.PLAN_LIMITS["enterprise"]).otherwise(fixed.PLAN_LIMITS["free"])


def allowed(plan: Column, plans: tuple[str, ...]) -> Column:
    return plan.isin(list(plans)) if plans else F.lit(False)


def plan_of(subscriptions: DataFrame) -> DataFrame:
    """``organization_id, plan_name`` of each organization's first subscription, whatever its status."""
    return subscriptions.groupBy("organization_id").agg(F.min_by("plan_name", "id").alias("plan_name"))


def with_plan(rows: DataFrame, subscriptions: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` with ``plan_name``; without subscription the plan is free. ``key`` names the organization."""
    plans = plan_of(subscriptions).withColumnRenamed("organization_id", "_organization")
    return rows.join(plans, rows[key] == plans["_organization"], "left").drop("_organization").withColumn("plan_name", F.coalesce("plan_name", F.lit("free")))


def daily_usage(leads: DataFrame) -> DataFrame:
    """Leads of each organization and day, deleted ones included."""
    return leads.groupBy("organization_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))


def used_on(organizations: DataFrame, leads: DataFrame, day: str) -> DataFrame:
    used = on_day(leads, day).groupBy("organization_id").agg(F.count("*").alias("_used"))
    return organizations.join(used, organizations["id"] == used["organization_id"], "left").select(organizations["*"], F.coalesce("_used", F.lit(0)).alias("current_usage"))


def usage(organizations: DataFrame, subscriptions: DataFrame, leads: DataFrame, day: str, ai_plans: tuple[str, ...] = (), export_plans: tuple[str, ...] = ()) -> DataFrame:
    """Plan, limit, flags and what remains of the day for each organization."""
    rows = with_plan(used_on(organizations.select("id"), leads, day), subscriptions)
    rows = rows.withColumn("max_leads_per_day", limit_of(F.col("plan_name")).cast("long"))
    left = F.greatest(F.lit(0), F.col("max_leads_per_day") - F.col("current_usage"))
    return rows.select(F.col("id").alias("organization_id"), "plan_name", "max_leads_per_day", allowed(F.col("plan_name"), export_plans).alias("can_export"), allowed(F.col("plan_name"), ai_plans).alias("can_use_ai"), "current_usage", left.alias("remaining_daily_leads"), (left > 0).alias("can_process_more_today"))


def admit(batches: DataFrame, usage: DataFrame) -> DataFrame:
    """All or nothing: ``batches(batch_id, organization_id, n)`` with a status. Batches of one organization take their
    turn by id, each seeing what those before it asked for and got as long as all of them fitted."""
    known = usage.select("organization_id", "max_leads_per_day", "current_usage", "remaining_daily_leads")
    w = Window.partitionBy("organization_id").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = batches.join(known, "organization_id", "left").withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
    left = F.coalesce("remaining_daily_leads", F.lit(fixed.PLAN_LIMITS["free"])) - F.col("_before")
    status = F.when(F.col("n") == 0, "empty").when(left <= 0, "limit reached").when(F.col("n") > left, "too many").otherwise("accepted")
    return rows.select("batch_id", "organization_id", "n", status.alias("status"))


def admit_one(n: Column, limit: Column, used: Column) -> Column:
    """Status of one batch by itself."""
    left = F.greatest(F.lit(0), limit - used)
    return F.when(n == 0, "empty").when(left <= 0, "limit reached").when(n > left, "too many").otherwise("accepted")


def process_gate(requests: DataFrame, leads: DataFrame, subscriptions: DataFrame, ai_plans: tuple[str, ...]) -> DataFrame:
    """``lead_id, caller_organization`` with 404, 403 (other tenant or plan without AI) or 200."""
    l = leads.select(F.col("id").alias("lead_id"), "organization_id")
    rows = with_plan(requests.join(l, "lead_id", "left"), subscriptions, "organization_id")
    status = F.when(F.col("organization_id").isNull(), 404).when(F.col("organization_id") != F.col("caller_organization"), 403).when(~allowed(F.col("plan_name"), ai_plans), 403).otherwise(200)
    return rows.select("lead_id", "caller_organization", status.alias("status"))


def assigned(subscriptions: DataFrame, wanted: DataFrame) -> DataFrame:
    """Subscriptions after plans were assigned: known organizations change plan and become active, others get a row.

    ``wanted(organization_id, plan_name)``; only free, pro and enterprise count.
    """
    w = wanted.filter(F.col("plan_name").isin(list(fixed.PLAN_LIMITS))).select(F.col("organization_id").alias("_organization"), F.col("plan_name").alias("_plan"))
    first = subscriptions.groupBy("organization_id").agg(F.min("id").alias("_first")).withColumnRenamed("organization_id", "_of")
    rows = subscriptions.join(w, F.col("organization_id") == F.col("_organization"), "left").join(first, F.col("organization_id") == F.col("_of"), "left")
    hit = F.col("_plan").isNotNull() & (F.col("id") == F.col("_first"))
    changed = rows.select("organization_id", F.when(hit, F.col("_plan")).otherwise(F.col("plan_name")).alias("plan_name"), F.when(hit, "active").otherwise(F.col("status")).alias("status"), "cancel_at_period_end")
    new = w.join(subscriptions.select(F.col("organization_id").alias("_organization")), "_organization", "left_anti")
    return changed.unionByName(new.select(F.col("_organization").alias("organization_id"), F.col("_plan").alias("plan_name"), F.lit("active").alias("status"), F.lit(False).alias("cancel_at_period_end")))


def canceled(subscriptions: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked(organization_id, immediate)``: at once (canceled) or at the period's end (flag set, active)."""
    a = asked.select(F.col("organization_id").alias("_organization"), "immediate")
    rows = subscriptions.join(a, F.col("organization_id") == F.col("_organization"), "left")
    return rows.select("id", "organization_id", "plan_name", F.when(F.col("immediate"), "canceled").when(~F.col("immediate"), "active").otherwise(F.col("status")).alias("status"), F.when(F.col("immediate").isNotNull(), ~F.col("immediate")).otherwise(F.col("cancel_at_period_end")).alias("cancel_at_period_end"))


def plans(spark: SparkSession, ai_plans: tuple[str, ...] = (), export_plans: tuple[str, ...] = ()) -> DataFrame:
    rows = [(n, most, n in export_plans, n in ai_plans, fixed.PLAN_PRICES[n]) for n, most in fixed.PLAN_LIMITS.items()]
    return spark.createDataFrame(rows, "name string, max_leads_per_day long, can_export boolean, can_use_ai boolean, price long")


def plans_in_use(plans: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """``plans`` with ``subscriptions``, how many there are of each."""
    n = subscriptions.groupBy(F.col("plan_name").alias("name")).agg(F.count("*").alias("subscriptions"))
    return plans.join(n, "name", "left").withColumn("subscriptions", F.coalesce("subscriptions", F.lit(0)))


def seeded(existing: DataFrame, defaults: DataFrame) -> DataFrame:
    """The defaults where the table is empty, else the table."""
    n = existing.agg(F.count("*").alias("_n"))
    return existing.unionByName(defaults.crossJoin(n).filter("_n = 0").drop("_n").select(*existing.columns))


def plan_of_price(price: Column) -> Column:
    out = None
    for k, v in fixed.PRICE_PLANS.items():
        out = F.when(price == k, v) if out is None else out.when(price == k, v)
    return out.otherwise("unknown")


def folded(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """State of each organization's subscription after all billing events in order.

    ``events(event_id, at, organization_id, kind, price, status, at_period_end)``. A creation makes or changes the row; an
    update changes it if it is there; a deletion cancels it if it is there; payments change nothing; organization 0
    or null is skipped. ``existing(organization_id, plan_name, status, cancel_at_period_end)``: rows that were there
    before, one for each organization; those without events are given back as they are.

    What counts is a summary of each organization that merges in any order: its first creation, its last event, the last of those
    that carry a plan, the last update. Tasks merge what they read before anything is shuffled, so an organization with
    half of all events is a row a task like any other. Events before the first creation need no filter: the last event, and
    the last that carries a plan, are never before it; an update that is, is known by its place.
    """
    rows = events.filter("coalesce(organization_id, 0) <> 0 and kind in ('created', 'updated', 'deleted')")
    plan = plan_of_price(F.col("price"))
    place = F.struct("at", "event_id")
    of = lambda when, **what: F.max(F.when(when, F.struct("at", "event_id", *(c.alias(n) for n, c in what.items()))))
    created, deleted = F.col("kind") == "created", F.col("kind") == "deleted"
    sums = rows.groupBy(F.col("organization_id").alias("_of")).agg(
        F.min(F.when(created, place)).alias("first"), of(F.lit(True), gone=deleted, status=F.col("status")).alias("last"),
        of(~deleted, plan=plan).alias("paid"), of(F.col("kind") == "updated", flag=F.coalesce("at_period_end", F.lit(False))).alias("updated"),
    )
    if existing is None:
        held = sums.select("_of").limit(0).selectExpr("_of as organization_id", "cast(null as string) as _p", "cast(null as string) as _s", "cast(null as boolean) as _f", "true as _held")
    else:
        held = existing.select("organization_id", F.col("plan_name").alias("_p"), F.col("status").alias("_s"), F.col("cancel_at_period_end").alias("_f"), F.lit(True).alias("_held"))
    both = sums.join(held, F.col("_of") == F.col("organization_id"), "full").withColumn("_held", F.coalesce("_held", F.lit(False))).filter("_held or first is not null")
    at = lambda c: F.struct(F.col(f"{c}.at").alias("at"), F.col(f"{c}.event_id").alias("event_id"))
    # the row that a first creation makes is active, whatever the event says
    made = ~F.col("_held") & (at("last") == F.col("first"))
    status = F.when(F.col("last.gone"), F.lit("canceled")).when(made, F.lit("active")).otherwise(F.col("last.status"))
    flag = F.when(F.col("_held") | (at("updated") > F.col("first")), F.col("updated.flag"))
    return both.select(F.coalesce("organization_id", "_of").alias("organization_id"), F.coalesce("paid.plan", "_p").alias("plan_name"), F.when(F.col("last").isNotNull(), status).otherwise(F.col("_s")).alias("status"), F.coalesce(flag, F.col("_f"), F.lit(False)).alias("cancel_at_period_end"))


def drift(organizations: DataFrame, subscriptions: DataFrame, tier: Column) -> DataFrame:
    """Organizations whose own tier differs from their subscription's plan."""
    rows = with_plan(organizations, subscriptions).withColumn("plan_tier", tier)
    return rows.filter("plan_tier <> plan_name").select(F.col("id").alias("organization_id"), "plan_tier", "plan_name")
