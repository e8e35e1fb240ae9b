"""Every query of the lead engine by name, with its SQL for DuckDB over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import enrich, extract, fixed, message, score, variants
from siftwell.operators import leads as L
from siftwell.operators import quota as Q
from siftwell.plans import process
from siftwell.sources import tables, web
from siftwell.sources.folders import scratch
from siftwell.sources.derived import view, with_views
from siftwell.streaming.leads import retries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
ORG, DAY, AI = 7, "1995-03-15", ("pro", "enterprise")


class Tables:
    """Derived views of one folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self._dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        table = view(self.spark, self._dir, name)
        setattr(self, name, table)  # one plan for each table of a query
        return table


def _flattened(t: Tables) -> DataFrame:
    """JSON-LD leaves as rows by the table function."""
    scripts = t.pages_rich.select("page_id", F.regexp_extract_all("html", F.lit(extract.LD_SCRIPT), 1).alias("scripts"))
    extract.register(t.spark)
    scripts.createOrReplaceTempView("ld_scripts")
    return t.spark.sql("select page_id, f.key, f.value from ld_scripts, lateral flattened(scripts) f")


def query(name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
    if sql:
        ORACLES[name] = with_views(sql)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(items) -> str:
    return ", ".join(map(quoted, items))


def double(x: float) -> str:
    return f"cast({x} as double)"


# --- scans and lookups
LEAD = "id, organization_id, owner_id, website, company_name, industry, employees, is_active"
LEAD_COLUMNS = LEAD.split(", ")
query("scan_leads_by_org", lambda t: L.page(L.of_organization(t.leads, ORG), 2, 100).select(*LEAD_COLUMNS), f"select {LEAD} from leads where organization_id = {ORG} order by id limit 100 offset 2")
query("scan_leads_by_owner", lambda t: L.page(t.leads.filter("owner_id = 5")).select(*LEAD_COLUMNS), f"select {LEAD} from leads where owner_id = 5 order by id limit 100")
query("scan_usage_range", lambda t: L.usage_range(t.usage_records, ORG, "2024-01-05", "2024-01-25 12:00:00"), f"select * from usage_records where organization_id = {ORG} and recorded_at between timestamp '2024-01-05' and timestamp '2024-01-25 12:00:00'")
query("lookup_lead", lambda t: L.lookup(t.leads, "id", 42).select(*LEAD_COLUMNS), f"select {LEAD} from leads where id = 42")
query("lookup_subscription", lambda t: L.lookup_many(t.subscriptions, t.organizations.select(F.col("id").alias("organization_id")), "organization_id"), "select o.id as organization_id, s.id, s.plan_name, s.status, s.cancel_at_period_end from organizations o left join subscriptions s on s.organization_id = o.id")
query("lookup_user_by_email", lambda t: L.public_users(L.lookup(t.users, "email", "user7@c7.example.com")), "select * exclude (hashed_password) from users where email = 'user7@c7.example.com'")
query("lookup_user_by_id", lambda t: L.public_users(L.lookup(t.users, "id", 12)), "select * exclude (hashed_password) from users where id = 12")
query("lookup_org_by_name", lambda t: L.lookup(t.organizations, "name", "Customer#000000009"), "select * from organizations where name = 'Customer#000000009'")
query("lookup_org_by_id", lambda t: L.lookup(t.organizations, "id", 9), "select * from organizations where id = 9")
query("lookup_subscription_by_stripe_id", lambda t: L.lookup(t.subscriptions.withColumn("stripe_subscription_id", F.concat(F.lit("sub_"), "id")), "stripe_subscription_id", "sub_4"), "select *, 'sub_' || id as stripe_subscription_id from subscriptions where id = 4")
query("lookup_api_key", lambda t: L.lookup(t.api_keys, "key_prefix", "sk_00000"), "select * from api_keys where key_prefix = 'sk_00000' order by id limit 1")
query("scan_api_keys_by_org", lambda t: t.api_keys.filter("organization_id = 5"), "select * from api_keys where organization_id = 5")
query("api_key_valid", lambda t: t.api_keys.select("id", L.usable_key().alias("valid")), "select id, is_active and not is_revoked as valid from api_keys")
query("project_public_user", lambda t: L.public_users(t.users), "select * exclude (hashed_password) from users")
IN_USE = "(select plan_name, count(*) as n from subscriptions group by 1)"
PLANS = "(select name, max_leads_per_day, price, coalesce(n, 0) as subscriptions from (values ('free', cast(10 as bigint), cast(0 as bigint)), ('pro', cast(500 as bigint), cast(29 as bigint)), ('enterprise', cast(10000 as bigint), cast(99 as bigint))) v(name, max_leads_per_day, price) left join " + IN_USE + " u on u.plan_name = name)"
plans = lambda t: Q.plans_in_use(Q.plans(t.spark), t.subscriptions)
query("scan_plans", lambda t: plans(t).drop("price"), f"select name, max_leads_per_day, false as can_export, false as can_use_ai, subscriptions from {PLANS}")
query("plan_prices", lambda t: Q.with_plan(t.organizations, t.subscriptions).select("id", "plan_name").join(Q.plans(t.spark).select(F.col("name").alias("plan_name"), "price"), "plan_name", "left"), "select o.id, coalesce(s.plan_name, 'free') as plan_name, cast(case coalesce(s.plan_name, 'free') when 'free' then 0 when 'pro' then 29 when 'enterprise' then 99 end as bigint) as price from organizations o left join subscriptions s on s.organization_id = o.id")

# --- predicates
query("search_leads", lambda t: L.search(t.leads, "TRAVEL").select(*LEAD_COLUMNS), f"select {LEAD} from leads where contains(lower(website), 'travel') or contains(lower(coalesce(company_name, '')), 'travel') or contains(lower(coalesce(industry, '')), 'travel')")
query("active_leads", lambda t: t.leads.filter("is_active").select(*LEAD_COLUMNS), f"select {LEAD} from leads where is_active")
query("tenant_isolation", lambda t: L.visible_to(t.leads, t.organizations.filter("is_active and id % 10 = 3").select(F.col("id").alias("organization_id"))).select(*LEAD_COLUMNS), f"select {LEAD} from leads where organization_id in (select id from organizations where is_active and id % 10 = 3)")
query("lead_access", lambda t: t.leads.select("id", L.access(t.leads, ORG).alias("access")), f"select id, case when organization_id = {ORG} then 'ok' else 'forbidden' end as access from leads")
query("create_authz", lambda t: t.leads.select("id", L.create_status(ORG, ORG % 97).alias("status")), f"select id, case when organization_id <> {ORG} then 'wrong organization' when owner_id <> {ORG % 97} then 'wrong owner' else 'ok' end as status from leads")
query("day_window", lambda t: L.on_day(t.leads, DAY).select("id", "organization_id"), f"select id, organization_id from leads where created_at >= timestamp '{DAY}' and created_at <= timestamp '{DAY} 23:59:59.999999'")
query("display_defaults", lambda t: t.leads.select("id", *L.displayed()), "select id, coalesce(nullif(company_name, ''), 'N/A') as company_name, coalesce(nullif(industry, ''), 'Unknown Industry') as industry, coalesce(nullif(employees, ''), 'N/A') as employees, coalesce(nullif(contact_name, ''), 'N/A') as contact_name, strftime(created_at, '%b %d, %Y') as created from leads")
query("has_sufficient_data", lambda t: t.leads.select("id", message.sufficient_data().alias("enough")), "select id, (coalesce(company_name <> '', false)::int + coalesce(industry <> '', false)::int + coalesce(contact_name <> '', false)::int + coalesce(employees <> '', false)::int) >= 2 as enough from leads")
query("request_lines", lambda t: L.requests(t.pages.select(F.col("page_id").alias("box"), F.concat(F.lit(" "), "url", F.lit(" \n\n  \n"), "url", F.lit("\n"), F.when(F.col("page_id") % 3 == 0, "https://more.example").otherwise("")).alias("urls"))), "select page_id as box, unnest([url, url]) as url from pages union all select page_id, 'https://more.example' from pages where page_id % 3 = 0")

# --- scores
PARTS = {
    "score_industry": ("industry_match", f"case when industry in ({listed(fixed.PREFERRED_INDUSTRIES)}) then 25e0 else 0e0 end"),
    "score_size": ("company_size", f"case when employees in ({listed(fixed.PREFERRED_SIZES)}) then 20e0 else 0e0 end"),
    "score_email": ("email_quality", "case when coalesce(email_confidence, 0) >= 0.6e0 then 15e0 * email_confidence else 0e0 end"),
    "score_scrape": ("scrape_quality", "case when coalesce(scrape_confidence, 0) >= 0.6e0 then 15e0 * scrape_confidence else 0e0 end"),
    "score_enrichment": ("enrichment_quality", "case when coalesce(enrichment_confidence, 0) >= 0.6e0 then 15e0 * enrichment_confidence else 0e0 end"),
    "score_linkedin": ("linkedin_presence", "case when linkedin_url <> '' then 10e0 else 0e0 end"),
}
TOTAL = "least(0e0 + " + " + ".join(f"({sql})" for _, sql in PARTS.values()) + ", 100e0)"
LABELED = "case when s >= 80 then 'Hot Lead' when s >= 60 then 'Warm Lead' when s >= 40 then 'Cold Lead' else 'Disqualified' end"
SCORED = f"(select *, {TOTAL} as s from leads)"
for _name, (_criterion, _sql) in PARTS.items():
    query(_name, lambda t, c=_criterion: t.leads.select("id", score.criteria()[c].alias("points")), f"select id, {_sql} as points from leads")
scored = lambda t: t.leads.withColumn("score", score.total())
query("score_lead", lambda t: scored(t).select("id", "score"), f"select id, s as score from {SCORED}")
query("classify", lambda t: scored(t).select("id", score.label(F.col("score")).alias("label")), f"select id, {LABELED} as label from {SCORED}")
query("score_breakdown", lambda t: t.leads.select("id", F.explode(score.breakdown()).alias("criterion", "points")), " union all ".join(f"select id, '{c}' as criterion, {sql} as points from leads" for c, sql in PARTS.values()))
query("custom_score", lambda t: t.leads.select("id", score.total({"industry_match": {"max_score": 60.0}, "scrape_quality": {"max_score": 40.0, "threshold": 0.5}, "unknown": {}}).alias("score")), f"select id, least(0e0 + case when industry in ({listed(fixed.PREFERRED_INDUSTRIES)}) then 60e0 else 0e0 end + case when scrape_confidence >= 0.5e0 then 40e0 * scrape_confidence else 0e0 end, 100e0) as score from leads")
query("label_distribution", lambda t: scored(t).groupBy(score.label(F.col("score")).alias("label")).agg(F.count("*").alias("n"), F.avg("score").alias("avg_score")), f"select {LABELED} as label, count(*) as n, avg(s) as avg_score from {SCORED} group by 1")
CONFIGURED = f"""(select l.*, coalesce(c.name, d.name) as criterion, coalesce(c.top, d.top) as top, coalesce(c.threshold, {fixed.CONFIDENCE_THRESHOLD}e0) as threshold from leads l
  left join (select organization_id, name, threshold, max_score as top from scoring_rows where name in ({listed(fixed.CRITERIA)})) c on c.organization_id = l.organization_id
  left join (select * from (values {", ".join(f"('{n}', {top}e0)" for n, (_, top) in fixed.CRITERIA.items())}) v(name, top)) d on c.name is null)"""
CONFIGURED_POINTS = f"case criterion when 'industry_match' then case when industry in ({listed(fixed.PREFERRED_INDUSTRIES)}) then top else 0e0 end when 'company_size' then case when employees in ({listed(fixed.PREFERRED_SIZES)}) then top else 0e0 end when 'linkedin_presence' then case when linkedin_url <> '' then top else 0e0 end else case when q >= threshold then top * q else 0e0 end end"
CONFIGURED_SCORES = f"(select id, criterion, {CONFIGURED_POINTS} as points from (select *, coalesce(case criterion when 'email_quality' then email_confidence when 'scrape_quality' then scrape_confidence when 'enrichment_quality' then enrichment_confidence end, 0e0) as q from {CONFIGURED}))"
configured = lambda t: score.by_organization(t.leads, t.scoring_rows)
query("score_by_organization", lambda t: configured(t).select("id", F.round("score", 9).alias("score"), "qualification_label"), f"select id, round(s, 9) as score, {LABELED} as qualification_label from (select id, least(sum(points), 100e0) as s from {CONFIGURED_SCORES} group by id)")
query("breakdown_by_organization", lambda t: configured(t).select("id", F.explode("criteria_scores").alias("criterion", "points")), f"select id, criterion, points from {CONFIGURED_SCORES}")
query("scoring_configurations", lambda t: score.configurations(t.scoring_rows).select("organization_id", "weights_valid", F.inline("criteria")).withColumn("weight", F.round("weight", 12)), f"select organization_id, name, round(case when sum(weight) over w > 0 then weight / sum(weight) over w else weight end, 12) as weight, threshold, max_score, abs(sum(weight) over w - 1) <= 0.01 as weights_valid from scoring_rows where name in ({listed(fixed.CRITERIA)}) window w as (partition by organization_id)")
query("filter_score_band", lambda t: L.in_band(scored(t), "medium").select("id", "score"), f"select id, s as score from {SCORED} where s >= 60 and s < 80")
KNOWN_RULES = f"(select * from scoring_rows where name in ({listed(fixed.CRITERIA)}))"
query("weight_sum_check", lambda t: score.configurations(t.scoring_rows).select("organization_id", F.col("weights_valid").alias("valid")), f"select organization_id, abs(sum(weight) - 1) <= 0.01 as valid from {KNOWN_RULES} group by 1")
query("weight_normalise", lambda t: score.configurations(t.scoring_rows).select("organization_id", F.inline(F.transform("criteria", lambda c: F.struct(c["name"].alias("name"), F.round(c["weight"], 12).alias("weight"))))), f"select organization_id, name, round(weight / sum(weight) over (partition by organization_id), 12) as weight from {KNOWN_RULES}")

# --- plans, quotas, joins
PLAN = "case plan_name when 'pro' then 500 when 'enterprise' then 10000 else 10 end"
PLANNED = "(select o.id, coalesce(s.plan_name, 'free') as plan_name from organizations o left join (select organization_id, arg_min(plan_name, id) as plan_name from subscriptions group by 1) s on s.organization_id = o.id)"
USED = f"(select p.id as organization_id, p.plan_name, cast({PLAN} as bigint) as max_leads_per_day, coalesce(n, 0) as current_usage from {PLANNED} p left join (select organization_id, count(*) as n from leads where created_at >= timestamp '{DAY}' and created_at < timestamp '{DAY}' + interval 1 day group by 1) u on u.organization_id = p.id)"
used = lambda t: Q.usage(t.organizations, t.subscriptions, t.leads, DAY, AI, ("enterprise",))
query("join_org_plan", lambda t: Q.with_plan(t.organizations, t.subscriptions).select("id", "plan_name"), f"select id, plan_name from {PLANNED}")
query("plan_limits", lambda t: Q.with_plan(t.organizations, t.subscriptions).select("id", Q.limit_of(F.col("plan_name")).cast("long").alias("max_leads_per_day")), f"select id, cast({PLAN} as bigint) as max_leads_per_day from {PLANNED}")
query("join_lead_plan", lambda t: Q.with_plan(t.leads, t.subscriptions, "organization_id").select("id", "plan_name"), f"select l.id, p.plan_name from leads l join {PLANNED} p on p.id = l.organization_id")
query("join_org_daily_usage", lambda t: Q.used_on(t.organizations, t.leads, DAY).select("id", "current_usage"), f"select organization_id as id, current_usage from {USED}")
query("join_lead_logs", lambda t: t.leads.join(t.scraping_logs, t.leads["id"] == t.scraping_logs["lead_id"]).select(t.leads["id"], t.scraping_logs["id"].alias("log_id"), "scraping_method", "success"), "select l.id, g.id as log_id, scraping_method, success from leads l join scraping_logs g on g.lead_id = l.id")
query("join_user_org", lambda t: t.leads.select(F.col("owner_id").alias("id")).distinct().join(t.organizations, "id").select("id", "name"), "select o.id, o.name from organizations o where o.id in (select owner_id from leads)")
query("org_first_user", lambda t: L.first_users(t.users), "select organization_id, arg_min(email, id) as email from users group by 1")
query("org_first_lead", lambda t: t.leads.groupBy("organization_id").agg(F.min_by("website", "id").alias("website")), "select organization_id, arg_min(website, id) as website from leads group by 1")
query("orgs_without_subscription", lambda t: t.organizations.join(t.subscriptions, t.organizations["id"] == t.subscriptions["organization_id"], "left_anti").select("id"), "select id from organizations where id not in (select organization_id from subscriptions)")
query("leads_of_active_orgs", lambda t: t.leads.join(t.organizations.filter("is_active").select(F.col("id").alias("organization_id")), "organization_id", "left_semi").select("id"), "select id from leads where organization_id in (select id from organizations where is_active)")
query("org_usage", used, f"select organization_id, plan_name, max_leads_per_day, plan_name = 'enterprise' as can_export, plan_name in ('pro', 'enterprise') as can_use_ai, current_usage, greatest(0, max_leads_per_day - current_usage) as remaining_daily_leads, max_leads_per_day > current_usage as can_process_more_today from {USED}")
query("can_create", lambda t: used(t).select("organization_id", F.col("can_process_more_today").alias("can_create")), f"select organization_id, max_leads_per_day > current_usage as can_create from {USED}")
query("can_use_ai", lambda t: used(t).select("organization_id", "can_use_ai"), f"select organization_id, plan_name in ('pro', 'enterprise') as can_use_ai from {USED}")
query("can_export", lambda t: used(t).select("organization_id", "can_export"), f"select organization_id, plan_name = 'enterprise' as can_export from {USED}")
batches = lambda t: t.leads.groupBy("organization_id", (F.col("id") % 3).alias("batch_id")).agg(F.count("*").alias("n"))
query("admit_batch", lambda t: batches(t).join(used(t).select("organization_id", "max_leads_per_day", "current_usage"), "organization_id").select("organization_id", "batch_id", "n", Q.admit_one(F.col("n") * 3, F.col("max_leads_per_day"), F.col("current_usage")).alias("status")), f"select b.organization_id, batch_id, n, case when max_leads_per_day <= current_usage then 'limit reached' when n * 3 > max_leads_per_day - current_usage then 'too many' else 'accepted' end as status from (select organization_id, id % 3 as batch_id, count(*) as n from leads group by 1, 2) b join {USED} u using (organization_id)")
query("admit_in_turn", lambda t: Q.admit(batches(t), used(t)), f"select batch_id, organization_id, n, case when room <= 0 then 'limit reached' when n > room then 'too many' else 'accepted' end as status from (select b.*, greatest(0, max_leads_per_day - current_usage) - coalesce(sum(n) over (partition by organization_id order by batch_id rows between unbounded preceding and 1 preceding), 0) as room from (select organization_id, id % 3 as batch_id, count(*) as n from leads group by 1, 2) b join {USED} u using (organization_id))")
asked = lambda t: t.events.select((F.col("event_id") * 2).alias("lead_id"), F.col("user_id").alias("caller_organization"))
query("process_gate", lambda t: Q.process_gate(asked(t), t.leads, t.subscriptions, AI), f"select e.event_id * 2 as lead_id, e.user_id as caller_organization, cast(case when l.id is null then 404 when l.organization_id <> e.user_id then 403 when p.plan_name not in ('pro', 'enterprise') then 403 else 200 end as integer) as status from events e left join leads l on l.id = e.event_id * 2 left join {PLANNED} p on p.id = l.organization_id")
wanted = lambda t: t.organizations.select(F.col("id").alias("organization_id"), F.expr("case id % 4 when 0 then 'free' when 1 then 'pro' when 2 then 'gold' else 'enterprise' end").alias("plan_name")).filter("organization_id % 3 = 0")
WANTED = "(select id as organization_id, case id % 4 when 0 then 'free' when 1 then 'pro' else 'enterprise' end as plan_name from organizations where id % 3 = 0 and id % 4 <> 2)"
query("assign_plan", lambda t: Q.assigned(t.subscriptions, wanted(t)), f"select s.organization_id, coalesce(w.plan_name, s.plan_name) as plan_name, case when w.plan_name is null then s.status else 'active' end as status, s.cancel_at_period_end from subscriptions s left join {WANTED} w using (organization_id) union all select organization_id, plan_name, 'active', false from {WANTED} where organization_id not in (select organization_id from subscriptions)")
query("cancel_plan", lambda t: Q.canceled(t.subscriptions, t.organizations.filter("id % 5 < 2").select(F.col("id").alias("organization_id"), (F.col("id") % 5 == 0).alias("immediate"))), "select id, organization_id, plan_name, case organization_id % 5 when 0 then 'canceled' when 1 then 'active' else status end as status, case organization_id % 5 when 0 then false when 1 then true else cancel_at_period_end end as cancel_at_period_end from subscriptions")
query("seed_plans", lambda t: Q.seeded(plans(t).filter("subscriptions < 0").drop("price", "subscriptions"), plans(t).filter("subscriptions > 0").drop("price", "subscriptions")), f"select name, max_leads_per_day, false as can_export, false as can_use_ai from {PLANS} where subscriptions > 0")
query("seed_plans_again", lambda t: Q.seeded(plans(t).filter("subscriptions > 0").select("name", "price"), Q.plans(t.spark).select("name", (F.col("price") + 1).alias("price"))), f"select name, price from {PLANS} where subscriptions > 0")
query("plans_count", lambda t: plans(t).filter("subscriptions > 0").agg(F.count("*").alias("n")), f"select count(*) as n from {PLANS} where subscriptions > 0")
PRICE = "case event_id % 4 when 0 then 'price_123' when 1 then 'price_456' when 2 then 'price_789' else 'price_0' end"
query("plan_from_price", lambda t: t.events.select("event_id", Q.plan_of_price(F.expr(PRICE)).alias("plan_name")), "select event_id, case event_id % 4 when 0 then 'starter' when 1 then 'pro' when 2 then 'enterprise' else 'unknown' end as plan_name from events")
billing = lambda t: t.events.select("event_id", F.col("ts").alias("at"), F.col("user_id").alias("organization_id"), F.expr("case event_type when 'signup' then 'created' when 'purchase' then 'updated' when 'error' then 'deleted' else 'payment' end").alias("kind"), F.expr(PRICE).alias("price"), F.expr("case when event_id % 7 = 0 then 'past_due' else 'active' end").alias("status"), (F.col("event_id") % 2 == 0).alias("at_period_end"))
BILLING = f"(select event_id, ts as happened, user_id as organization_id, case event_type when 'signup' then 'created' when 'purchase' then 'updated' when 'error' then 'deleted' end as kind, case event_id % 4 when 0 then 'starter' when 1 then 'pro' when 2 then 'enterprise' else 'unknown' end as plan, case when event_id % 7 = 0 then 'past_due' else 'active' end as status, event_id % 2 = 0 as flag from events where event_type in ('signup', 'purchase', 'error') and user_id <> 0)"
query("apply_billing_events", lambda t: Q.folded(billing(t)), f"""with b as (select *, row_number() over (partition by organization_id order by happened, event_id) as place from {BILLING}),
first as (select organization_id, min(place) as start from b where kind = 'created' group by 1), r as (select b.*, start from b join first using (organization_id) where place >= start)
select organization_id, arg_max(plan, place) filter (where kind <> 'deleted') as plan_name, arg_max(case when kind = 'deleted' then 'canceled' when place = start then 'active' else status end, place) as status, coalesce(arg_max(flag, place) filter (where kind = 'updated'), false) as cancel_at_period_end from r group by 1""")
HELD = "(select organization_id, plan_name as p0, status as s0, cancel_at_period_end as f0 from subscriptions where organization_id % 2 = 0)"
query("apply_billing_to_subscriptions", lambda t: Q.folded(billing(t), t.subscriptions.filter("organization_id % 2 = 0")), f"""with b as (select *, row_number() over (partition by organization_id order by happened, event_id) as place from {BILLING}),
first as (select organization_id, min(place) as start from b where kind = 'created' group by 1),
r as (select b.*, start, h.organization_id is not null as held from b left join first using (organization_id) left join {HELD} h using (organization_id) where h.organization_id is not null or place >= start),
n as (select organization_id, arg_max(plan, place) filter (where kind <> 'deleted') as plan_name, arg_max(case when kind = 'deleted' then 'canceled' when place = start and not held then 'active' else status end, place) as status, arg_max(flag, place) filter (where kind = 'updated') as flag from r group by 1)
select coalesce(n.organization_id, h.organization_id) as organization_id, coalesce(n.plan_name, p0) as plan_name, coalesce(n.status, s0) as status, coalesce(n.flag, f0, false) as cancel_at_period_end from n full join {HELD} h on h.organization_id = n.organization_id""")
query("admit_batch_client", lambda t: Q.admit(batches(t).withColumn("n", F.col("n") * 4), used(t).filter("organization_id % 3 <> 0")), f"select batch_id, organization_id, n, case when room <= 0 then 'limit reached' when n > room then 'too many' else 'accepted' end as status from (select b.*, case when max_leads_per_day is null then 10 else greatest(0, max_leads_per_day - current_usage) end - coalesce(sum(n) over (partition by organization_id order by batch_id rows between unbounded preceding and 1 preceding), 0) as room from (select organization_id, id % 3 as batch_id, 4 * count(*) as n from leads group by 1, 2) b left join (select * from {USED} where organization_id % 3 <> 0) u using (organization_id))")
query("plan_tier_drift", lambda t: Q.drift(t.organizations, t.subscriptions, F.expr("case when id % 2 = 0 then 'free' else 'pro' end")), f"select id as organization_id, case when id % 2 = 0 then 'free' else 'pro' end as plan_tier, plan_name from {PLANNED} where plan_name <> case when id % 2 = 0 then 'free' else 'pro' end")

# --- aggregates
query("daily_usage", lambda t: Q.daily_usage(t.leads), "select organization_id, cast(created_at as date) as day, count(*) as n from leads group by 1, 2")
query("avg_score", lambda t: L.average_score(scored(t)), f"select coalesce(avg(s), 0) as avg_score from {SCORED}")
query("active_count", lambda t: t.leads.agg(F.count_if("is_active").alias("n")), "select count(*) filter (where is_active) as n from leads")
query("usage_counter", lambda t: L.counted_usage(t.organizations, t.usage_records).select("id", "usage_count"), "select o.id, cast(coalesce(sum(quantity), 0) as bigint) as usage_count from organizations o left join usage_records u on u.organization_id = o.id group by 1")
query("org_remaining", lambda t: L.counted_usage(t.organizations, t.usage_records).select("id", (F.col("max_leads") - F.col("usage_count")).alias("remaining")), "select o.id, cast(any_value(max_leads) - coalesce(sum(quantity), 0) as bigint) as remaining from organizations o left join usage_records u on u.organization_id = o.id group by 1")
query("total_pages", lambda t: t.leads.agg(F.ceil(F.count("*") / 10).cast("long").alias("pages")), "select cast(ceil(count(*) / 10.0) as bigint) as pages from leads")
query("log_success_rate", lambda t: t.scraping_logs.groupBy("scraping_method").agg(F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("rate"), F.sum("processing_time_ms").cast("long").alias("ms")), "select scraping_method, count(*) as n, avg(success::int) as rate, cast(sum(processing_time_ms) as bigint) as ms from scraping_logs group by 1")
query("usage_rollup", lambda t: t.usage_records.rollup("action", F.to_date("recorded_at").alias("day")).agg(F.sum("quantity").cast("long").alias("quantity")), "select action, cast(recorded_at as date) as day, cast(sum(quantity) as bigint) as quantity from usage_records group by rollup (action, cast(recorded_at as date))")

# --- order, sets, changes
query("page_leads", lambda t: L.page(t.leads, 20, 10).select(*LEAD_COLUMNS), f"select {LEAD} from leads order by id limit 10 offset 20")
query("page_leads_deep", lambda t: L.page(t.leads, t.leads.count() * 2 // 3, 25, at_once=100).select(*LEAD_COLUMNS), f"select {LEAD} from leads order by id limit 25 offset (select count(*) * 2 // 3 from leads)")
query("recent_leads", lambda t: L.recent(t.leads, "organization_id").select("id", "organization_id", "place"), "select id, organization_id, cast(place as integer) as place from (select *, row_number() over (partition by organization_id order by id) as place from leads) where place <= 5")
query("top_leads", lambda t: scored(t).orderBy(F.desc("score"), "id").limit(20).select("id", "score"), f"select id, s as score from {SCORED} order by s desc, id limit 20")
new = lambda t: t.leads.filter("id % 10 = 1").withColumn("company_name", F.lit("New"))
query("prepend", lambda t: L.prepended(t.leads, new(t)).groupBy("company_name").agg(F.count("*").alias("n")), "select company_name, count(*) as n from (select company_name from leads union all select 'New' from leads where id % 10 = 1) group by 1")
query("remove", lambda t: L.removed(t.leads, t.leads.filter("id % 3 = 0")).select("id"), "select id from leads where id % 3 <> 0")
query("replace", lambda t: L.replaced(t.leads, new(t)).select("id", "company_name"), "select id, case when id % 10 = 1 then 'New' else company_name end as company_name from leads")
query("partial_update", lambda t: L.updated(t.leads, t.leads.filter("id % 4 = 0").select("id", F.lit(True).alias("set_industry"), F.lit(None).cast("string").alias("industry"), (F.col("id") % 8 == 0).alias("set_employees"), F.lit("1-10").alias("employees")), ["industry", "employees"]).select("id", "industry", "employees"), "select id, case when id % 4 <> 0 then industry end as industry, case when id % 8 = 0 then '1-10' else employees end as employees from leads")
query("soft_delete", lambda t: L.soft_deleted(t.leads, t.scraping_logs.filter("not success").select(F.col("lead_id").alias("id"))).select("id", "is_active"), "select id, is_active and id not in (select lead_id from scraping_logs where not success) as is_active from leads")
query("insert_if_absent", lambda t: L.inserted(t.organizations.filter("id % 2 = 0").select("id", "name"), t.organizations.select((F.col("id") + 1).alias("id"), "name"), "name")[0], "select id + 1 as id, name from organizations where id % 2 <> 0")
query("insert_rejected", lambda t: L.inserted(t.organizations.filter("id % 2 = 0").select("id", "name"), t.organizations.select((F.col("id") + 1).alias("id"), "name"), "name")[1], "select id + 1 as id, name, 'taken' as reason from organizations where id % 2 = 0")
query("insert_lead", lambda t: L.new_leads(t.leads.filter("id % 7 = 0").select("id", "website", "organization_id", "owner_id")), "select id, website, organization_id, owner_id, 0e0 as score, 'Low Priority' as qualification_label, 0e0 as scrape_confidence, 0e0 as email_confidence, 0e0 as enrichment_confidence, 'none' as enrichment_source, 'none' as email_source, 'none' as scrape_source, false as outreach_sent, true as is_active, false as is_verified from leads where id % 7 = 0")
query("insert_subscription", lambda t: L.new_subscriptions(t.organizations.filter("id % 3 = 1").select(F.col("id").alias("organization_id"), F.concat(F.lit("sub_"), "id").alias("stripe_subscription_id"), F.lit("pro").alias("plan_name"))), "select id as organization_id, 'sub_' || id as stripe_subscription_id, 'pro' as plan_name, 'active' as status, false as cancel_at_period_end from organizations where id % 3 = 1")
more_usage = lambda t: t.leads.select(F.col("organization_id"), F.lit("lead_created").alias("action"), F.lit(1).cast("long").alias("quantity"), F.col("created_at").alias("recorded_at"))
query("record_usage", lambda t: L.counted_usage(t.organizations, t.usage_records.drop("id").unionByName(more_usage(t))).select("id", "usage_count"), "select o.id, cast(coalesce(sum(quantity), 0) as bigint) as usage_count from organizations o left join (select organization_id, quantity from usage_records union all select organization_id, 1 from leads) u on u.organization_id = o.id group by 1")
query("export_leads", lambda t: L.exportable(t.leads, Q.with_plan(t.organizations, t.subscriptions).filter(Q.allowed(F.col("plan_name"), ("enterprise",)))).select("id", "website"), f"select l.id, l.website from leads l join {PLANNED} p on p.id = l.organization_id where plan_name = 'enterprise'")
query("retry_plan", lambda t: retries(t.scraping_logs), "select lead_id, id, cast(n as integer) as failures, case when success then 'done' when n <= 3 then 'retry' else 'failed' end as action, case when not success and n <= 3 then created_at + interval 60 second end as at from (select *, sum((not success)::int) over (partition by lead_id, done order by created_at, id) as n from (select *, sum(success::int) over (partition by lead_id order by created_at, id rows between unbounded preceding and current row) - success::int as done from scraping_logs))")
query("log_records", lambda t: t.scraping_logs.select("id", L.log_event("scraping_attempt", "lead_id", "scraping_method", "success").alias("record")), """select id, concat('{"event":"scraping_attempt","lead_id":', lead_id, ',"scraping_method":"', scraping_method, '","success":', success, '}') as record from scraping_logs""")
query("api_call_records", lambda t: t.usage_records.select("id", L.log_event("api_call", F.concat(F.lit("/api/v2/"), "action").alias("endpoint"), F.lit("POST").alias("method"), "organization_id", F.when(F.col("quantity") > 5, 429).otherwise(200).alias("status_code")).alias("record")), """select id, concat('{"event":"api_call","endpoint":"/api/v2/', action, '","method":"POST","organization_id":', organization_id, ',"status_code":', case when quantity > 5 then 429 else 200 end, '}') as record from usage_records""")


# --- tables that are changed in place
def appended(t: Tables) -> DataFrame:
    """Half of the users, then all of them again under other ids, twice: emails stay unique."""
    table = tables.Table(t.spark, scratch(t.spark, "users"), 16)
    table.create(t.users.filter("id % 2 = 0").select("id", "email", "is_active"))
    new = t.users.select((F.col("id") + 1_000_000).alias("id"), "email", "is_active")
    for _ in range(2):
        table.append(new, 1, "email")
    return table.read()


def changed(t: Tables) -> DataFrame:
    """Leads of which few are updated, and those whose scraping failed once deleted softly."""
    table = tables.Table(t.spark, scratch(t.spark, "leads"), 64)
    table.create(t.leads.select("id", "industry", "is_active"))
    table.update(t.organizations.filter("id <= 20").select("id", F.lit("Travel").alias("industry"), F.lit(True).alias("set_industry")), ["industry"])
    table.soft_delete(t.scraping_logs.filter("not success").select(F.col("lead_id").alias("id")))
    return table.read()


def kept_up(t: Tables) -> DataFrame:
    """Daily usage from four batches of records, of which one came twice and one after it was compacted."""
    sums = tables.Sums(t.spark, scratch(t.spark, "usage"), ["organization_id", "day"])
    records = t.usage_records.select("organization_id", F.to_date("recorded_at").alias("day"), "quantity", F.pmod("id", F.lit(4)).alias("part"))
    sums.create(records)
    for batch in (1, 2, 2, 3):
        sums.add(records.filter(F.col("part") == batch - 1), batch)
    sums.compact()
    for batch in (2, 4):
        sums.add(records.filter(F.col("part") == batch - 1), batch)
    return sums.current()


query("append_users", appended, "select id, email, is_active from users where id % 2 = 0 union all select id + 1000000, email, is_active from users where id % 2 <> 0")
query("update_leads_in_place", changed, "select id, case when id <= 20 then 'Travel' else industry end as industry, is_active and id not in (select lead_id from scraping_logs where not success) as is_active from leads")
query("usage_kept_up", kept_up, "select organization_id, cast(recorded_at as date) as day, cast(sum(quantity) as bigint) as quantity from usage_records group by 1, 2")

# --- extraction
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: The entities that occur in these pages, for SQL; tests hold the others against pages written by hand.
ENT = "{}"
for _a, _b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&ndash;", "–"), ("&amp;", "&")):
    ENT = f"replace({ENT}, {quoted(_a)}, {quoted(_b)})"
TITLE = STRIP.format(ENT.format(r"regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
META_DESC = r"""regexp_extract(html, '(?is)<meta\b[^>]*\bname\s*=\s*["'']description["''][^>]*>', 0)"""
CONTENT = r"""regexp_extract({}, '(?is)\bcontent\s*=\s*"([^"]*)"', 1)"""
DESC = f"case when {META_DESC} <> '' then {STRIP.format(ENT.format(CONTENT.format(META_DESC)))} end"
pages_of = lambda which: lambda build: lambda t: build(getattr(t, which))


def meta_sql(attr: str, prefix: str) -> str:
    """Name and content of each element; the last of a name wins; names in order."""
    tags = rf"""unnest(list_transform(regexp_extract_all(html, '(?is)<meta\b[^>]*\b{attr}\s*=\s*["'']{prefix}:[^>]*>', 0), lambda x: x))"""
    name = rf"""'{prefix}_' || regexp_extract(tag, '(?is)\b{attr}\s*=\s*"{prefix}:([^"]*)"', 1)"""
    return f"select page_id, coalesce(string_agg(k || '=' || v, ';' order by k), '') as fields from (select page_id, k, arg_max(v, place) as v from (select page_id, {name} as k, {CONTENT.format('tag')} as v, row_number() over () as place from (select page_id, {tags} as tag from pages_rich)) group by 1, 2) group by 1"


ALL_PAGES = "select page_id, coalesce(fields, '') as fields from pages_rich left join ({}) m using (page_id)"
HREFS = r"""regexp_extract_all(html, '(?is)<a\b[^>]*\bhref\s*=\s*["'']([^"'']*)["'']', 1)"""
LINKS = rf"""list_filter(list_transform({HREFS}, lambda h: case when h like 'http://%' or h like 'https://%' then h when h like '//%' then regexp_extract(url, '^(\w+):', 1) || ':' || h when h like '/%' then regexp_extract(url, '^(\w+://[^/?#]*)', 1) || h end), lambda h: h is not null)"""
VISIBLE = "substr(trim(regexp_replace(" + ENT.format(r"regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>|<script\b[^>]*/>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')") + r", '[ \t\n\r\f\v]+', ' ', 'g')), 1, 8000)"
#: The body's text as it is, tags put out.
BARE = "substr(" + ENT.format(r"regexp_replace(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), '(?is)<script\b[^>]*/>|<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?s)<[^>]*>', '', 'g')") + ", 1, 8000)"
found_in = lambda text: tuple(f"nullif(regexp_extract(lower({text}), {quoted(p)}, 1), '')" for p in (fixed.EMAIL, fixed.PHONE))
EMAIL, PHONE = found_in(VISIBLE)
COMPANY = r"split_part(replace(regexp_extract(url, '^\w+://(?:[^/?#@]*@)?([^/?#:]*)', 1), 'www.', ''), '.', 1)"
for _view in ("pages", "pages_rich"):
    _end = "" if _view == "pages_rich" else "_raw"
    query("extract_title" + _end, lambda t, v=_view: getattr(t, v).select("page_id", extract.title(F.col("html")).alias("title")), f"select page_id, {TITLE} as title from {_view}")
    query("extract_links" + _end, lambda t, v=_view: getattr(t, v).select("page_id", F.posexplode(extract.links(F.col("html"), F.col("url"))).alias("place", "link")), f"select page_id, cast(unnest(range(len(l))) as integer) as place, unnest(l) as link from (select page_id, {LINKS} as l from {_view})")
    query("extract_email" + _end, lambda t, v=_view: getattr(t, v).select("page_id", extract.email(extract.visible_text(F.col("html"))).alias("email")), f"select page_id, {EMAIL} as email from {_view}")
    query("extract_phone" + _end, lambda t, v=_view: getattr(t, v).select("page_id", extract.phone(extract.visible_text(F.col("html"))).alias("phone")), f"select page_id, {PHONE} as phone from {_view}")
    query("visible_text" + _end, lambda t, v=_view: getattr(t, v).select("page_id", extract.visible_text(F.col("html")).alias("text")), f"select page_id, {VISIBLE} as text from {_view}")
    query("domain_company" + _end, lambda t, v=_view: getattr(t, v).select("page_id", extract.domain_company(F.col("url")).alias("company")), f"select page_id, {COMPANY} as company from {_view}")
ABSOLUTE = f"list_filter({HREFS}, lambda h: h like 'http://%' or h like 'https://%')"
query("extract_links_abs", lambda t: t.renders.select("page_id", F.posexplode(extract.absolute_links(F.col("rendered_html"))).alias("place", "link")), f"select page_id, cast(unnest(range(len(l))) as integer) as place, unnest(l) as link from (select page_id, {ABSOLUTE} as l from (select page_id, rendered_html as html from renders))")
query("extract_description", lambda t: t.pages_rich.select("page_id", extract.description(F.col("html")).alias("description")), f"select page_id, {DESC} as description from pages_rich")
query("extract_og", lambda t: t.pages_rich.select("page_id", extract.shown_map(extract.meta_map(F.col("html"), "og")).alias("fields")), ALL_PAGES.format(meta_sql("property", "og")))
query("extract_twitter", lambda t: t.pages_rich.select("page_id", extract.shown_map(extract.meta_map(F.col("html"), "twitter")).alias("fields")), ALL_PAGES.format(meta_sql("name", "twitter")))
SCRIPT = r"""nullif(regexp_extract(html, '(?is)<script\b[^>]*type\s*=\s*["'']application/ld\+json["''][^>]*>(.*?)</script>', 1), '')"""
#: The script where it is well-formed.
LD = f"case when json_valid({SCRIPT}) then {SCRIPT} end"
LEAF = r"""replace(replace(replace(replace(substr(fullkey, 3), '"', ''), '[', '_'), ']', ''), '.', '_')"""
#: Leaves of each page's record.
LEAVES = f"select page_id, {LEAF} as key, atom->>'$' as value, case type when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then 'null' else 'number' end as kind from (select page_id, {LD} as j from pages_rich) p, json_tree(p.j) where j is not null and type not in ('OBJECT', 'ARRAY')"
query("jsonld_fields", lambda t: extract.fields(t.pages_rich).filter("ld.ok").select("page_id", *(F.element_at("ld.data", k).alias(k.lower()) for k in ("name", "foundingDate", "address", "address_street"))), f"select page_id, json_extract_string(j, '$.name') as name, json_extract_string(j, '$.foundingDate') as foundingdate, case when json_type(j, '$.address') = 'VARCHAR' then json_extract_string(j, '$.address') end as address, json_extract_string(j, '$.address.street') as address_street from (select page_id, {LD} as j from pages_rich) where j is not null")
query("flatten_json", lambda t: extract.fields(t.pages_rich).filter("ld.ok").select("page_id", F.explode("ld.data").alias("key", "value"), F.element_at("ld.kinds", F.col("key")).alias("kind")), LEAVES)
query("flatten_json_rows", lambda t: _flattened(t), f"select page_id, key, value from ({LEAVES})")
query("flatten_json_jvm", lambda t: variants.merged(variants.leaves(extract.scripts(t.pages_rich), "page_id", "script"), "page_id"), LEAVES)
scalar = lambda *keys: " or ".join(f"coalesce(json_type({LD}, '$.{k}') not in ('OBJECT', 'ARRAY'), false)" for k in keys)
LD_TERMS = (("name", "legalName"), "0.3e0"), (("description",), "0.2e0"), (("url",), "0.1e0"), (("email", "telephone"), "0.1e0"), (("address",), "0.2e0"), (("foundingDate",), "0.1e0")
LD_CONF = f"case when {LD} is null then 0e0 else least(0e0 + " + " + ".join(f"case when {scalar(*keys)} then {w} else 0e0 end" for keys, w in LD_TERMS) + "".join(f" + case when contains(lower({LD}), {quoted(w)}) then 0.1e0 else 0e0 end" for w in fixed.STRUCTURED_WORDS) + ", 1e0) end"
OG = r"""regexp_matches(html, '(?is)<meta\b[^>]*\bproperty\s*=\s*["'']og:{}["''][^>]*\bcontent\s*=\s*"[^"]+"')"""
META_CONF = f"least(0e0 + case when {TITLE} <> '' then 0.3e0 else 0e0 end + case when {DESC} <> '' then 0.3e0 else 0e0 end + case when {OG.format('title')} or {OG.format('description')} then 0.2e0 else 0e0 end + case when len({LINKS}) > 0 then 0.1e0 else 0e0 end + case when {OG.format('image')} then 0.1e0 else 0e0 end, 1e0)"
rendered_sql = lambda mail, call: f"least(0.3e0 + case when {TITLE} <> '' then 0.2e0 else 0e0 end + case when {DESC} <> '' or {OG.format('description')} then 0.2e0 else 0e0 end + case when {mail} is not null then 0.2e0 else 0e0 end + case when {call} is not null then 0.1e0 else 0e0 end + case when len({ABSOLUTE}) > 5 then 0.1e0 else 0e0 end + case when {COMPANY} <> '' then 0.1e0 else 0e0 end, 1e0)"
RENDERED_CONF = rendered_sql(EMAIL, PHONE)
PLAIN_CONF = rendered_sql(*found_in(BARE))
query("jsonld_confidence", lambda t: extract.fields(t.pages_rich).select("page_id", F.when(F.col("ld.ok"), extract.jsonld_confidence(F.col("ld.data"), F.col("ld.shown"))).otherwise(F.lit(0.0)).alias("confidence")), f"select page_id, {LD_CONF} as confidence from pages_rich")
query("meta_confidence", lambda t: extract.fields(t.pages_rich).select("page_id", extract.meta_confidence(F.col("title"), F.col("description"), F.col("og"), F.col("links")).alias("confidence")), f"select page_id, {META_CONF} as confidence from pages_rich")
query("rendered_confidence", lambda t: extract.fields(t.pages_rich).select("page_id", extract.rendered_confidence(F.col("title"), F.col("description"), F.element_at("og", "og_description"), F.col("email"), F.col("phone"), F.col("plain_links"), F.col("company")).alias("confidence")), f"select page_id, {RENDERED_CONF} as confidence from pages_rich")
query("scrape_waterfall", lambda t: extract.attempted(t.pages_rich).select("page_id", F.col("scraping_method").alias("method"), F.col("scraping_confidence").alias("confidence")), f"select page_id, case when c1 > 0.7e0 then 'json_ld' when c2 > 0.5e0 then 'structured_data' else 'playwright' end as method, case when c1 > 0.7e0 then c1 when c2 > 0.5e0 then c2 else c3 end as confidence from (select page_id, {LD_CONF} as c1, {META_CONF} as c2, {RENDERED_CONF} as c3 from pages_rich)")

# pages that fail both gates get what a renderer made of them, and no others
query("render_waterfall", lambda t: extract.attempted(t.pages_rich, render=web.rendered_from(t.renders)).select("page_id", "success", F.col("scraping_method").alias("method"), F.col("scraping_confidence").alias("confidence"), "error_message", "title", "email", "phone", "linkedin_url", "render_wanted"), f"""
with plain as (select page_id, url, html, {LD_CONF} as c1, {META_CONF} as c2, {PLAIN_CONF} * 0.8e0 as c4, {TITLE} as title, {LINKS} as links, {ABSOLUTE} as abs_links, json_extract_string({LD}, '$.email') as ld_email, {found_in(BARE)[0]} as p_email, {found_in(BARE)[1]} as p_phone from pages_rich),
wanted as (select r.page_id, r.render_status, r.render_error, url, r.rendered_html as html from renders r join plain on plain.page_id = r.page_id where not (c1 > 0.7e0 or c2 > 0.5e0)),
seen as (select page_id, render_status, render_error, html is not null as there, {RENDERED_CONF} as c3, {TITLE} as r_title, {EMAIL} as r_email, {PHONE} as r_phone, {ABSOLUTE} as r_links from wanted),
chosen as (select *, case when c1 > 0.7e0 then 'json_ld' when c2 > 0.5e0 then 'structured_data' when contains(render_error, 'NotImplementedError') then 'requests' else 'playwright' end as method, coalesce(there and render_status = 200, false) as rendered from plain left join seen using (page_id))
select page_id, method <> 'playwright' or rendered as success, method,
  case method when 'json_ld' then c1 when 'structured_data' then c2 when 'requests' then c4 else case when rendered then c3 when render_status = 200 then 0.3e0 else 0e0 end end as confidence,
  case when method = 'playwright' and not rendered then coalesce(render_error, case when render_status <> 200 then 'HTTP ' || render_status when render_status = 200 then 'No data extracted by Playwright' end, 'no answer') end as error_message,
  case method when 'json_ld' then null when 'playwright' then case when rendered then r_title end else title end as title, case method when 'json_ld' then ld_email when 'playwright' then case when rendered then r_email end when 'requests' then p_email end as email,
  case method when 'playwright' then case when rendered then r_phone end when 'requests' then p_phone end as phone,
  list_filter(case method when 'structured_data' then links when 'playwright' then case when rendered then r_links end when 'requests' then abs_links end, lambda h: contains(h, 'linkedin.com'))[1] as linkedin_url,
  not (c1 > 0.7e0 or c2 > 0.5e0) as render_wanted from chosen""")

# --- enrichment
HITS = {n: " + ".join(f"contains(low, {quoted(w)})::int" for w in words) for n, words in fixed.INDUSTRIES.items()}
MOST = f"greatest({', '.join(HITS.values())})"
INDUSTRY = f"case when {MOST} = 0 then null " + " ".join(f"when {sql} = {MOST} then {quoted(n)}" for n, sql in HITS.items()) + " end"
DIGITS = "coalesce(" + ", ".join(f"nullif(regexp_extract(low, {quoted(p)}, 1), '')" for p in fixed.SIZE_PATTERNS) + ")"
EMPLOYEES = "case " + " ".join(f"when {' or '.join(f'contains(low, {quoted(w)})' for w in words)} then {quoted(b)}" for b, words in fixed.SIZE_WORDS.items()) + f" when {DIGITS} is null then null " + " ".join(f"when cast({DIGITS} as hugeint) <= {m} then {quoted(b)}" for m, b in fixed.SIZE_BOUNDS) + f" else {quoted(fixed.SIZE_ABOVE)} end"
REVENUE = "case employees " + " ".join(f"when {quoted(k)} then {quoted(v)}" for k, v in fixed.REVENUE.items()) + " end"
first_of = lambda patterns: "coalesce(" + ", ".join(f"nullif(regexp_extract(text, {quoted(p)}, 1), '')" for p in patterns) + ")"
CONTACT, RAW_TITLE = first_of(fixed.CONTACT_PATTERNS), first_of(fixed.TITLE_PATTERNS)
PERSON = f"array_to_string(list_transform(string_split(lower({RAW_TITLE}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
YEARS = [f"(select case when y between 1900 and 2030 then y end from (select try_cast(case when m like '''%' then '20' || m[2:] else m end as integer) as y from (select nullif(regexp_extract(text, {quoted(p)}, 1), '') as m)))" for p in fixed.YEAR_PATTERNS]
YEAR = f"coalesce({', '.join(YEARS)})"
INFERRED = f"(select *, {REVENUE} as revenue_band from (select id, {INDUSTRY} as industry, {EMPLOYEES} as employees, {CONTACT} as contact_name, case when {RAW_TITLE} is not null then {PERSON} end as contact_title, {YEAR} as founded_year from (select id, text, lower(text) as low from lead_text)))"
CONF = "case when coalesce(industry, employees, revenue_band, contact_name, contact_title, cast(founded_year as varchar)) is not null then least(0e0" + "".join(f" + case when {c} is not null then {w}e0 else 0e0 end" for c, w in fixed.HEURISTIC_WEIGHTS.items()) + f", {fixed.HEURISTIC_CAP}e0) end"
for _name, _column in (("infer_industry", "industry"), ("estimate_employees", "employees"), ("revenue_band", "revenue_band"), ("extract_contact_name", "contact_name"), ("extract_contact_title", "contact_title"), ("extract_founded_year", "founded_year")):
    query(_name, lambda t, c=_column: enrich.inferred(t.lead_text).select("id", c), f"select id, {_column} from {INFERRED}")
query("heuristic_confidence", lambda t: enrich.inferred(t.lead_text).select("id", "confidence"), f"select id, {CONF} as confidence from {INFERRED}")
FOUND = ("industry", "employees", "revenue_band", "founded_year", "contact_name", "contact_title")
query("enrich_waterfall", lambda t: enrich.waterfall(t.lead_text).select("id", *FOUND, "confidence", "method"), "select id, " + ", ".join(f"case when c > 0.7e0 then {x} end as {x}" for x in FOUND) + f", case when c > 0.7e0 then c end as confidence, case when c > 0.7e0 then 'heuristic' end as method from (select *, {CONF} as c from {INFERRED})")
query("merge_enrichment", lambda t: t.leads.select("id", "industry", "employees").join(enrich.waterfall(t.lead_text).select("id", F.col("industry").alias("i"), F.col("employees").alias("e")), "id", "left").select("id", F.coalesce("i", "industry").alias("industry"), F.coalesce("e", "employees").alias("employees")), f"select l.id, coalesce(case when c > 0.7e0 then x.industry end, l.industry) as industry, coalesce(case when c > 0.7e0 then x.employees end, l.employees) as employees from leads l left join (select *, {CONF} as c from {INFERRED}) x on x.id = l.id")
query("llm_confidence", lambda t: enrich.inferred(t.lead_text).select("id", enrich.language_model_confidence([F.col(c) for c in fixed.HEURISTIC_WEIGHTS]).alias("confidence")), "select id, least(0.5e0 + 0.1e0 * (" + " + ".join(f"({c} is not null)::int" for c in fixed.HEURISTIC_WEIGHTS) + f"), 0.8e0) as confidence from {INFERRED}")


#: Fields of the answers, with how many of their keys have a value.
TOLD = r"""(select id, prompt, case when named > 0 then named end as named, case when named > 0 then v end as v from (select *, len(list_filter(json_keys(v), lambda k: json_type(json_extract(v, '$."' || k || '"')) <> 'NULL')) as named from
  (select id, prompt, case when json_valid(b) then b end as v from (select id, prompt, nullif(regexp_extract(answer, '(?s)\{.*\}', 0), '') as b from answers))))"""
TOLD_FIELDS = ", ".join([*(f"case when json_type(v, '$.{c}') = 'VARCHAR' then json_extract_string(v, '$.{c}') end as {c}" for c in fixed.HEURISTIC_WEIGHTS if c != "founded_year"), "case when json_type(v, '$.founded_year') = 'UBIGINT' then cast(json_extract_string(v, '$.founded_year') as integer) end as founded_year"])
told = lambda t: enrich.answered(t.lead_text, "text", t.answers.select("prompt", "answer"), "told")
query("model_answers", lambda t: told(t).filter("told is not null").select("id", "told.*"), f"select id, {TOLD_FIELDS}, named from {TOLD} where v is not null")
#: Each tier behind its gate: inference, the service's stored answer, the model's.
TIERS = f"(select x.id, c, n.v, n.named, s.industry as si, s.employees as se, s.confidence as sc, x.industry as hi, x.employees as he, x.founded_year as hy, case when c > 0.7e0 then 'heuristic' when s.confidence > 0.6e0 then 'external_api' when n.named > 0 then 'llm' end as method from (select *, {CONF} as c from {INFERRED}) x left join services s on s.id = x.id left join {TOLD} n on n.id = x.id)"


def tiers(t: Tables) -> DataFrame:
    known = t.services.select(F.col("id").alias("_id"), F.col("industry").alias("si"), F.col("employees").alias("se"), F.col("confidence").alias("sc"))
    rows = told(t).join(known, F.col("id") == F.col("_id"), "left")
    none = F.lit(None).cast("string")
    service = F.struct(F.col("si").alias("industry"), F.col("se").alias("employees"), none.alias("revenue_band"), none.alias("contact_name"), none.alias("contact_title"), F.lit(None).cast("int").alias("founded_year"), F.col("sc").alias("confidence"))
    found = enrich.waterfall(rows, external=lambda text: F.when(text.isNotNull(), service), model=lambda text: F.when(text.isNotNull(), F.col("told")))
    return found.select("id", "industry", "employees", "founded_year", F.round("confidence", 9).alias("confidence"), "method")


query("enrich_tiers", tiers, f"select id, case method when 'heuristic' then hi when 'external_api' then si when 'llm' then industry end as industry, case method when 'heuristic' then he when 'external_api' then se when 'llm' then employees end as employees, case method when 'heuristic' then hy when 'llm' then founded_year end as founded_year, round(case method when 'heuristic' then c when 'external_api' then sc when 'llm' then least(0.5e0 + 0.1e0 * named, 0.8e0) end, 9) as confidence, method from (select id, c, named, si, se, sc, hi, he, hy, method, {TOLD_FIELDS} from {TIERS})")


query("enrichment_log_records", lambda t: enrich.waterfall(t.lead_text).select("id", L.log_event("enrichment_attempt", F.col("id").alias("lead_id"), F.coalesce("method", F.lit("none")).alias("method"), F.col("method").isNotNull().alias("success")).alias("record")), f"""select id, concat('{{"event":"enrichment_attempt","lead_id":', id, ',"method":"', case when c > 0.7e0 then 'heuristic' else 'none' end, '","success":', coalesce(c > 0.7e0, false), '}}') as record from (select id, {CONF} as c from {INFERRED})""")


# --- messages
def template_sql(text: str) -> str:
    """The template as nested replacements; names are put in one after the other."""
    values = {"contact": f"coalesce(nullif(contact_name, ''), {quoted(fixed.NO_CONTACT)})", "company": f"coalesce(nullif(company_name, ''), {quoted(fixed.NO_COMPANY)})", "industry": "coalesce(industry, '')", "website": f"coalesce(nullif(website, ''), {quoted(fixed.NO_WEBSITE)})", "sender": quoted(fixed.SENDER)}
    out = quoted(text)
    for name, value in values.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


INDUSTRY_MESSAGE = "case replace(lower(coalesce(industry, '')), ' ', '') " + " ".join(f"when {quoted(k)} then {template_sql(v)}" for k, v in fixed.TEMPLATES.items()) + f" else {template_sql(fixed.TEMPLATE_INDUSTRY)} end"
MESSAGE = f"case when company_name <> '' and industry <> '' then {INDUSTRY_MESSAGE} when company_name <> '' then {template_sql(fixed.TEMPLATE_COMPANY)} else {template_sql(fixed.TEMPLATE_WEBSITE)} end"
query("message_template", lambda t: t.leads.select("id", message.template().alias("message")), f"select id, {MESSAGE} as message from leads")
query("industry_template", lambda t: t.leads.select("id", message.industry_template().alias("message")), f"select id, {INDUSTRY_MESSAGE} as message from leads")
query("generic_template", lambda t: t.leads.select("id", message.generic_template().alias("message")), f"select id, {template_sql(fixed.TEMPLATE_COMPANY)} as message from leads")
query("website_template", lambda t: t.leads.select("id", message.website_template().alias("message")), f"select id, {template_sql(fixed.TEMPLATE_WEBSITE)} as message from leads")
query("style_professional", lambda t: t.leads.select("id", message.professional(message.template()).alias("message")), f"select id, case when contains(m, 'Best regards,') then m else m || chr(10) || chr(10) || 'Best regards,' || chr(10) || '{fixed.SENDER}' end as message from (select id, replace({MESSAGE}, 'Hi ', 'Dear ') as m from leads)")
query("style_friendly", lambda t: t.leads.select("id", message.friendly(message.template()).alias("message")), f"select id, replace(replace({MESSAGE}, 'Dear ', 'Hi '), 'Best regards,', 'Cheers,') as message from leads")
query("style_short", lambda t: t.leads.select("id", message.short(message.template()).alias("message")), f"select id, array_to_string(string_split({MESSAGE}, chr(10))[1:4], chr(10)) as message from leads")
query("ensure_company_mention", lambda t: t.leads.select("id", message.ensure_company(F.concat(F.lit("About company 1 and "), F.col("website")), F.col("company_name")).alias("message")), "select id, case when company_name <> '' and not contains(lower('About company 1 and ' || website), lower(company_name)) then 'Hi ' || company_name || ' team,' || chr(10) || chr(10) else '' end || 'About company 1 and ' || website as message from leads")
query("gated_message", lambda t: Q.with_plan(t.leads, t.subscriptions, "organization_id").select("id", message.gated(Q.allowed(F.col("plan_name"), AI), message.template()).alias("message")), f"select l.id, case when plan_name in ('pro', 'enterprise') then {MESSAGE} else {quoted(fixed.NO_MESSAGE)} end as message from leads l join (select id as pid, plan_name from {PLANNED}) p on p.pid = l.organization_id")
PROMPT = template_sql(fixed.PROMPT.replace("{industry}", "{kind}").replace("{company}", "{firm}"))
query("llm_prompt", lambda t: t.leads.withColumn("about_text", F.when(F.col("id") % 2 == 0, F.repeat(F.lit("about "), 40))).select("id", message.prompt().alias("prompt")), f"select id, concat_ws(chr(10), 'Sender Organization: {fixed.SENDER}', 'Recipient Company: ' || firm, 'Industry: ' || kind, 'Website: ' || website, case when id % 2 = 0 then 'About: ' || substr(repeat('about ', 40), 1, 200) || '...' end, 'Contact: ' || coalesce(nullif(contact_name, ''), 'the team'), case when employees <> '' then 'Size: ' || employees || ' employees' end, replace(replace({PROMPT}, '{{kind}}', kind), '{{firm}}', firm)) as prompt from (select *, coalesce(nullif(company_name, ''), 'their company') as firm, coalesce(nullif(industry, ''), 'their industry') as kind from leads)")

# --- the whole way
PY = "case type when 'VARCHAR' then '''' || (atom->>'$') || '''' when 'BOOLEAN' then case atom->>'$' when 'true' then 'True' else 'False' end when 'NULL' then 'None' else atom->>'$' end"
SHOWN = f"(select '{{' || coalesce(string_agg('''' || {LEAF} || ''': ' || {PY}, ', ' order by x.id), '') || '}}' from json_tree({LD}) x where type not in ('OBJECT', 'ARRAY'))"
OG_DESC = ENT.format(r"""nullif(regexp_extract(html, '(?is)<meta\b[^>]*\bproperty\s*=\s*["'']og:description["''][^>]*\bcontent\s*=\s*"([^"]*)"', 1), '')""")
LINKEDIN, ABS_LINKEDIN = (f"list_filter({links}, lambda h: contains(h, 'linkedin.com'))[1]" for links in (LINKS, ABSOLUTE))
PRIOR = {"website": "url", **{c: f"cast(null as {'integer' if c == 'founded_year' else 'varchar'})" for c in list(process.LEAD)[1:-1]}, "email_confidence": "0e0"}


def process_sql(source: str, ai: str, strict: bool = False, told: bool = False) -> str:
    """What becomes of ``source(page_id, url, html, status, ..., old_<field>, ai)``, step by step."""
    one = "cast(0 as double)"
    tried = f"(select *, coalesce(error is null and status = 200, false) as answered, coalesce(contains(render_error, 'NotImplementedError') or contains(lower(render_error), 'subprocess'), false) as stand_in, coalesce(render_error is null and render_status = 200, false) as rendered, {LD_CONF} as c1, {META_CONF} as c2, {RENDERED_CONF} as c3, {PLAIN_CONF} as c4, {OG_DESC} as og_desc, {LINKEDIN} as linked, {ABS_LINKEDIN} as abs_linked, {BARE} as bare, {SHOWN} as repr, json_extract_string({LD}, '$.description') as ld_desc, json_extract_string({LD}, '$.email') as ld_email, {found_in(BARE)[0]} as bare_email, {found_in(BARE)[1]} as bare_phone, {TITLE} as page_title, {DESC} as page_desc, {EMAIL} as page_email, {PHONE} as page_phone, {VISIBLE} as visible from {source})"
    chosen = f"(select *, case when answered and c1 > 0.7e0 then 'json_ld' when answered and c2 > 0.5e0 then 'structured_data' when stand_in then 'requests' else 'playwright' end as way from {tried})"
    done = f"(select *, case way when 'requests' then answered when 'playwright' then rendered else true end as ok from {chosen})"
    of = lambda ld, meta, shown, plain, old: f"case when not ok then {old} when way = 'json_ld' then {ld} when way = 'structured_data' then {meta} when way = 'playwright' then {shown} else {plain} end"
    http = "coalesce({0}error, case when {0}status <> 200 then 'HTTP ' || {0}status end, 'no answer')"
    merged = f"""(select page_id as id, old_website as website, {of('old_company_name', 'page_title', 'page_title', 'page_title', 'old_company_name')} as company_name,
      {of('ld_desc', 'coalesce(og_desc, page_desc, old_about_text)', 'og_desc', 'coalesce(og_desc, old_about_text)', 'old_about_text')} as about_text,
      {of('ld_email', 'old_email', 'page_email', 'coalesce(bare_email, old_email)', 'old_email')} as email, {of('old_phone', 'old_phone', 'page_phone', 'coalesce(bare_phone, old_phone)', 'old_phone')} as phone,
      {of('old_linkedin_url', 'coalesce(linked, old_linkedin_url)', 'coalesce(abs_linked, old_linkedin_url)', 'coalesce(abs_linked, old_linkedin_url)', 'old_linkedin_url')} as linkedin_url,
      case when ok then way end as scrape_source, {of('c1', 'c2', 'c3', 'c4 * 0.8e0', one)} as scraping_confidence, way as scraping_method, ok as scraping_success,
      case when ok then null when way = 'requests' then {http.format('')} else {http.format('render_')} end as error_message,
      {of('ld_desc', 'coalesce(page_desc, og_desc, page_title)', 'visible', 'bare', 'null')} as told, case when ok and way in ('playwright', 'requests') then repr end as shown, {ai} as ai, {', '.join(f'old_{c}' for c in (*fixed.HEURISTIC_WEIGHTS, 'email_confidence'))} from {done})"""
    texts = f"(select *, case when ai then concat_ws(' ', 'Company: ' || nullif(company_name, ''), nullif(about_text, ''), told, shown) end as text from {merged})"
    inferred = INFERRED.replace("(select id, text, lower(text) as low from lead_text)", f"(select id, text, lower(text) as low from {texts})")
    if told:
        return texts
    best = f"(select id as iid, case when {CONF} > 0.7e0 then {CONF} end as sure, {', '.join(f'{c} as new_{c}' for c in fixed.HEURISTIC_WEIGHTS)} from {inferred})"
    fields = ", ".join(f"coalesce(case when sure is not null then new_{c} end, old_{c}) as {c}" for c in fixed.HEURISTIC_WEIGHTS)
    sums = (one, one) if strict else ("scraping_confidence", "coalesce(sure, 0)")
    rich = f"(select m.* exclude ({', '.join(f'old_{c}' for c in (*fixed.HEURISTIC_WEIGHTS, 'email_confidence'))}, told, shown), {fields}, {sums[0]} as scrape_confidence, case when sure is not null then 'heuristic' end as enrichment_source, {sums[1]} as enrichment_confidence, old_email_confidence as email_confidence, sure as inference_confidence from {merged} m join {best} on iid = id)"
    final = f"(select *, {one if strict else TOTAL} as score from {rich})"
    label = "'Low Priority'" if strict else LABELED.replace("when s ", "when score ")
    return f"(select id as lead_id, website, company_name, about_text, email, phone, linkedin_url, {', '.join(fixed.HEURISTIC_WEIGHTS)}, scrape_source, scrape_confidence, enrichment_source, enrichment_confidence, email_confidence, score, {label} as qualification_label, case when ai then {MESSAGE} else {quoted(fixed.NO_MESSAGE)} end as outreach_message, 'completed' as status, scraping_success, inference_confidence is not null as enrichment_success, scraping_method, scraping_confidence, error_message, inference_confidence from {final})"


FETCHED = ", ".join(f"{x} as old_{c}" for c, x in PRIOR.items())
PLAIN = f"(select page_id, url, html, 200 as status, cast(null as varchar) as error, 200 as render_status, cast(null as varchar) as render_error, {FETCHED} from pages_rich)"
TRIED = f"(select *, {FETCHED} from fetches)"
query("process_lead", lambda t: process.processed(t.pages_rich), f"select * from {process_sql(PLAIN, 'true')}")
query("process_lead_strict", lambda t: process.processed(t.pages_rich, strict=True), f"select * from {process_sql(PLAIN, 'true', True)}")
query("process_lead_without_ai", lambda t: process.processed(t.pages_rich, can_use_ai=False), f"select * from {process_sql(PLAIN, 'false')}")
query("process_fetches", lambda t: process.processed(t.fetches), f"select * from {process_sql(TRIED, 'true')}")
query("merge_scrape", lambda t: process.scraped(t.fetches), f"select lead_id, website, company_name, about_text, email, phone, linkedin_url, scrape_source, scrape_confidence, scraping_success, error_message from {process_sql(TRIED, 'false')}")
query("analysis_text", lambda t: process.told(t.pages_rich), f"select id as page_id, text from {process_sql(PLAIN, 'true', told=True)}")
query("generate_message", lambda t: t.leads.select("id", message.generated(F.when(F.col("id") % 2 == 0, F.concat(F.lit("Dear "), F.col("company_name")))).alias("message")), f"select id, coalesce(case when (coalesce(company_name <> '', false)::int + coalesce(industry <> '', false)::int + coalesce(contact_name <> '', false)::int + coalesce(employees <> '', false)::int) >= 2 and id % 2 = 0 then 'Dear ' || company_name end, {MESSAGE}) as message from leads")
asked_leads = lambda t: t.pages.select((F.col("page_id") * 2).alias("lead_id")).unionByName(t.pages.select((-F.col("page_id")).alias("lead_id")))
ASKED = "(select distinct lead_id from (select page_id * 2 as lead_id from pages union all select -page_id from pages))"
of_requests = lambda t: process.process_leads(asked_leads(t), t.leads, t.fetches, t.subscriptions, AI)
OLD = {"website": "l.website", "company_name": "l.company_name", "industry": "l.industry", "employees": "l.employees", "contact_name": "l.contact_name", "linkedin_url": "l.linkedin_url", "email_confidence": "l.email_confidence"}
KNOWN = f"(select l.id as page_id, coalesce(f.url, l.website) as url, f.html, f.status, f.error, f.render_status, f.render_error, p.plan_name in ('pro', 'enterprise') as can_ai, {', '.join(f'{OLD.get(c, x)} as old_{c}' for c, x in PRIOR.items())} from leads l join {ASKED} a on a.lead_id = l.id left join {PLANNED} p on p.id = l.organization_id left join fetches f on f.page_id = l.id)"
DONE = process_sql(KNOWN, "can_ai")
query("process_leads", of_requests, f"select * from {DONE} union all by name select lead_id, 'error' as status, 'Lead ' || lead_id || ' not found' as error_message from {ASKED} where lead_id not in (select id from leads)")
query("process_results", lambda t: process.results(of_requests(t)), f"select lead_id, 'success' as status, scraping_success, enrichment_success, cast(null as varchar) as error from {DONE} union all select lead_id, 'error', null, null, 'Lead ' || lead_id || ' not found' from {ASKED} where lead_id not in (select id from leads)")
query("scraping_log_rows", lambda t: process.scraping_log(of_requests(t)), f"select lead_id, scraping_method, scraping_success as success, error_message, scraping_confidence as confidence_score from {DONE}")
query("enrichment_log_rows", lambda t: process.enrichment_log(of_requests(t)).drop("enrichment_data"), f"select lead_id, enrichment_source as enrichment_type, inference_confidence as confidence_score from {DONE} where enrichment_success")
