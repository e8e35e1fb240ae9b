"""The whole way of a lead: scrape, merge, enrich, score, message; one lazy chain of narrow steps after the joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import enrich, extract, message, score
from siftwell.operators import quota

#: What a lead has before and after; scraping and enrichment set some of it.
LEAD = {
    "website": "string", "company_name": "string", "about_text": "string", "email": "string", "phone": "string", "linkedin_url": "string",
    **{c: "int" if c == "founded_year" else "string" for c in enrich.FIELDS}, "email_confidence": "double",
}


def merged(scraped: DataFrame) -> DataFrame:
    """A lead's fields after a scrape: what the page's record has replaces what was there, an explicit nothing included."""
    old = lambda c: F.col(f"lead.{c}")
    either = lambda has, new, c: F.when(F.col("success") & F.coalesce(has, F.lit(False)), new).otherwise(old(c)).alias(c)
    about = F.when(F.col("has_og_description"), F.col("og_description")).otherwise(F.col("description"))
    return scraped.select(
        *[F.col(c) for c in scraped.columns if c not in ("email", "phone", "linkedin_url")],
        old("website").alias("website"), either(F.col("has_title"), F.col("title"), "company_name"), either(F.col("has_og_description") | F.col("has_description"), about, "about_text"),
        either(F.col("has_email"), F.col("email"), "email"), either(F.col("has_phone"), F.col("phone"), "phone"), either(F.col("linkedin_url").isNotNull(), F.col("linkedin_url"), "linkedin_url"),
    )


def told(pages: DataFrame) -> DataFrame:
    """``page_id, text``: what the scrape of each page gives to infer from, as a new lead."""
    out = merged(extract.attempted(with_new_lead(pages), ["lead"]))
    return out.select("page_id", analysis().alias("text"))


def analysis() -> Column:
    return extract.analysis_text(F.col("company_name"), F.col("about_text"), F.col("text"), F.col("shown"))


def with_new_lead(pages: DataFrame) -> DataFrame:
    nothing = F.struct(*(F.col("url").alias(c) if c == "website" else (F.lit(0.0) if c == "email_confidence" else F.lit(None).cast(t)).alias(c) for c, t in LEAD.items()))
    return pages.withColumn("lead", nothing)


def processed(pages: DataFrame, can_use_ai: bool | str = True, strict: bool = False, external=None, model=None, render=None) -> DataFrame:
    """A row for each page, see ``run``; a page's lead is new, its id and website are the page's."""
    return run(with_new_lead(pages), can_use_ai, strict, external, model, render)


def run(pages: DataFrame, can_use_ai: bool | str = True, strict: bool = False, external=None, model=None, render=None) -> DataFrame:
    """``pages`` (see ``extract.attempted``) with a struct ``lead`` of LEAD, scraped, merged, enriched, scored and written to.

    ``can_use_ai``: for all, or the name of a column. ``strict``: computed confidences are not kept, so scores see zeros.
    ``render``: see ``extract.attempted``.
    A page that could not be scraped leaves its lead as it was; what is known of the lead is enriched all the same.
    """
    kept = ["lead"] + ([can_use_ai] if isinstance(can_use_ai, str) else [])
    allowed = F.col(can_use_ai) if isinstance(can_use_ai, str) else F.lit(can_use_ai)
    leads = merged(extract.attempted(pages, kept, render))
    text = analysis()
    rich = enrich.waterfall(leads.withColumn("_text", F.when(allowed, text)), "_text", external, model).drop("_text", "text", "shown")
    rich = rich.withColumnsRenamed({"method": "enrichment_source", "confidence": "enrichment_confidence"})
    rich = rich.withColumns({c: F.coalesce(F.col(c), F.col(f"lead.{c}")) for c in enrich.FIELDS} | {"email_confidence": F.col("lead.email_confidence")})
    zero = F.lit(0.0)
    rich = rich.withColumns({
        "scrape_source": F.when(F.col("success"), F.col("scraping_method")), "scrape_confidence": zero if strict else F.coalesce(F.when(F.col("success"), F.col("scraping_confidence")), zero),
        "enrichment_success": F.col("enrichment_source").isNotNull(), "sure": F.col("enrichment_confidence"), "enrichment_confidence": zero if strict else F.coalesce(F.col("enrichment_confidence"), zero),
    })
    scored = rich.withColumn("score", score.total())
    scored = scored.withColumn("qualification_label", score.label(F.col("score")))
    if strict:
        scored = scored.withColumns({"score": zero, "qualification_label": F.lit("Low Priority")})
    out = scored.withColumns({"outreach_message": message.gated(allowed, message.template()), "status": F.lit("completed")})
    return out.select(
        F.col("page_id").alias("lead_id"), "website", "company_name", "about_text", "email", "phone", "linkedin_url", *enrich.FIELDS, "scrape_source", "scrape_confidence", "enrichment_source", "enrichment_confidence",
        "email_confidence", "score", "qualification_label", "outreach_message", "status", F.col("success").alias("scraping_success"), "enrichment_success", "scraping_method", "scraping_confidence", "error_message", F.col("sure").alias("inference_confidence"),
    )


def scraped(pages: DataFrame) -> DataFrame:
    """What the scrape of each page makes of a new lead."""
    return processed(pages, can_use_ai=False).select("lead_id", "website", "company_name", "about_text", "email", "phone", "linkedin_url", "scrape_source", "scrape_confidence", "scraping_success", "error_message")


def process_leads(requests: DataFrame, leads: DataFrame, fetches: DataFrame, subscriptions: DataFrame, ai_plans: tuple[str, ...], **options) -> DataFrame:
    """``run`` for the leads of ``requests(lead_id)``: each with the page fetched for it and the plan of its organization.

    A lead that does not exist gives a row with status ``error`` and nothing else. A lead without a page could not be scraped.
    """
    asked = requests.select("lead_id").distinct()
    own = F.struct(*(F.col(c).cast(t).alias(c) if c in leads.columns else F.lit(None).cast(t).alias(c) for c, t in LEAD.items())).alias("lead")
    known = quota.with_plan(leads, subscriptions, "organization_id").select(F.col("id").alias("page_id"), own, quota.allowed(F.col("plan_name"), ai_plans).alias("ai"))
    found = asked.join(known, F.col("lead_id") == F.col("page_id"), "left")
    # the leads are hashed and the pages stream past them: a sort would hold whole pages in a task's memory
    pages = found.filter("page_id is not null").drop("lead_id").hint("shuffle_hash").join(fetches, "page_id", "left").withColumn("url", F.coalesce("url", F.col("lead.website")))
    out = run(pages, "ai", **options)
    missing = found.filter("page_id is null").select("lead_id", F.lit("error").alias("status"), F.concat(F.lit("Lead "), F.col("lead_id").cast("string"), F.lit(" not found")).alias("error_message"))
    return out.unionByName(missing, allowMissingColumns=True)


def results(rows: DataFrame) -> DataFrame:
    """What the work reports of each lead."""
    missing = F.col("status") == "error"
    return rows.select("lead_id", F.when(missing, "error").otherwise("success").alias("status"), "scraping_success", "enrichment_success", F.when(missing, F.col("error_message")).alias("error"))


def scraping_log(rows: DataFrame) -> DataFrame:
    """A row for each scrape, good or bad."""
    return rows.filter("status <> 'error'").select("lead_id", "scraping_method", F.col("scraping_success").alias("success"), "error_message", F.col("scraping_confidence").alias("confidence_score"))


def enrichment_log(rows: DataFrame) -> DataFrame:
    """A row for each enrichment that found something.

    Rows come out of an array instead of a filter: pushed below, a filter would repeat the whole inference for each of its terms.
    """
    row = F.struct("lead_id", F.col("enrichment_source").alias("enrichment_type"), F.to_json(F.struct(*enrich.FIELDS)).alias("enrichment_data"), F.col("inference_confidence").alias("confidence_score"))
    return rows.select(F.explode(F.when(F.col("enrichment_success"), F.array(row))).alias("r")).select("r.*")


def write(rows: DataFrame, folder: str, mode: str = "error") -> None:
    """Leads and both logs as Parquet below ``folder``; rows are computed once, the logs are made from what was written."""
    rows.write.mode(mode).parquet(f"{folder}/leads")
    kept = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/leads")
    scraping_log(kept).write.mode(mode).parquet(f"{folder}/scraping_logs")
    enrichment_log(kept).write.mode(mode).parquet(f"{folder}/enrichment_logs")
