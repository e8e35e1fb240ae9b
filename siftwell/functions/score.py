"""Scores of leads and labels of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed


def industry_match(top: float = 25.0) -> Column:
    return F.when(F.col("industry").isin(fixed.PREFERRED_INDUSTRIES), F.lit(top)).otherwise(F.lit(0.0))


def company_size(top: float = 20.0) -> Column:
    return F.when(F.col("employees").isin(fixed.PREFERRED_SIZES), F.lit(top)).otherwise(F.lit(0.0))


def quality(column: str, top: float = 15.0, threshold: float = fixed.CONFIDENCE_THRESHOLD) -> Column:
    c = F.coalesce(F.col(column), F.lit(0.0))
    return F.when(c >= F.lit(threshold), F.lit(top) * c).otherwise(F.lit(0.0))


def linkedin(top: float = 10.0) -> Column:
    return F.when(F.coalesce(F.col("linkedin_url") != "", F.lit(False)), F.lit(top)).otherwise(F.lit(0.0))


def criteria(override: dict[str, dict] | None = None) -> dict[str, Column]:
    """Score of each criterion. ``override`` picks criteria and may set max_score and threshold; unknown names go."""
    known = {
        "industry_match": lambda o: industry_match(o.get("max_score", 25.0)),
        "company_size": lambda o: company_size(o.get("max_score", 20.0)),
        "email_quality": lambda o: quality("email_confidence", o.get("max_score", 15.0), o.get("threshold", fixed.CONFIDENCE_THRESHOLD)),
        "scrape_quality": lambda o: quality("scrape_confidence", o.get("max_score", 15.0), o.get("threshold", fixed.CONFIDENCE_THRESHOLD)),
        "enrichment_quality": lambda o: quality("enrichment_confidence", o.get("max_score", 15.0), o.get("threshold", fixed.CONFIDENCE_THRESHOLD)),
        "linkedin_presence": lambda o: linkedin(o.get("max_score", 10.0)),
    }
    chosen = {n: {} for n in known} if override is None else override
    return {n: known[n](chosen[n]) for n in known if n in chosen}


def total(override: dict[str, dict] | None = None) -> Column:
    """Sum in the criteria's order, 100 at most."""
    out = F.lit(0.0)
    for c in criteria(override).values():
        out = out + c
    return F.least(out, F.lit(100.0))


def breakdown(override: dict[str, dict] | None = None) -> Column:
    return F.create_map(*(x for n, c in criteria(override).items() for x in (F.lit(n), c)))


def label(score: Column) -> Column:
    out = None
    for least, name in fixed.LABELS:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(fixed.LABEL_BELOW)


def band(score: Column) -> Column:
    return F.when(score >= 80, "high").when(score >= 60, "medium").otherwise("low")

#: A criterion as an organization sets it.
CRITERION = "struct<name: string, weight: double, threshold: double, max_score: double>"


def criterion_points(c: Column) -> Column:
    """What a lead gets for one criterion, a struct of CRITERION; 0 for a name that is not known."""

    def quality_points(column: str) -> Column:
        sure = F.coalesce(F.col(column), F.lit(0.0))
        return F.when(sure >= c["threshold"], c["max_score"] * sure).otherwise(F.lit(0.0))

    met = {"industry_match": F.col("industry").isin(fixed.PREFERRED_INDUSTRIES), "company_size": F.col("employees").isin(fixed.PREFERRED_SIZES), "linkedin_presence": F.col("linkedin_url") != ""}
    out = None
    for name, condition in met.items():
        points = F.when(condition, c["max_score"]).otherwise(F.lit(0.0))
        out = F.when(c["name"] == name, points) if out is None else out.when(c["name"] == name, points)
    for name in ("email_quality", "scrape_quality", "enrichment_quality"):
        out = out.when(c["name"] == name, quality_points(name.replace("quality", "confidence")))
    return out.otherwise(F.lit(0.0))


def defaults() -> Column:
    """The criteria of organizations that have set none."""
    return F.array(*(F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight"), F.lit(fixed.CONFIDENCE_THRESHOLD).alias("threshold"), F.lit(top).alias("max_score")) for n, (w, top) in fixed.CRITERIA.items()))


def configurations(rows: DataFrame) -> DataFrame:
    """``organization_id, criteria, weights_valid``: the criteria of each organization in their order, weights made to add up to 1.

    ``rows(organization_id, position, name, weight, threshold, max_score)``. Names that are not known go; a threshold or score that is null is the
    default's. ``weights_valid``: the weights as given add up to 1, to a hundredth. A dozen criteria an organization at most make a small array.
    """
    known = rows.filter(F.col("name").isin(list(fixed.CRITERIA)))
    top = F.create_map(*(x for n, (_, most) in fixed.CRITERIA.items() for x in (F.lit(n), F.lit(most))))
    one = F.struct("position", "name", F.col("weight").cast("double").alias("weight"), F.coalesce(F.col("threshold").cast("double"), F.lit(fixed.CONFIDENCE_THRESHOLD)).alias("threshold"), F.coalesce(F.col("max_score").cast("double"), top[F.col("name")]).alias("max_score"))
    grouped = known.groupBy("organization_id").agg(F.array_sort(F.collect_list(one)).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["weight"])
    share = lambda x: F.when(F.col("total") > 0, x["weight"] / F.col("total")).otherwise(x["weight"])
    return grouped.withColumn("total", total).select("organization_id", F.transform("c", lambda x: F.struct(x["name"].alias("name"), share(x).alias("weight"), x["threshold"].alias("threshold"), x["max_score"].alias("max_score"))).alias("criteria"), (F.abs(F.col("total") - 1) <= 0.01).alias("weights_valid"))


def by_organization(leads: DataFrame, rows: DataFrame) -> DataFrame:
    """``leads`` with ``score``, ``qualification_label`` and ``criteria_scores`` (a map) by the criteria of their organization, else the defaults."""
    set_up = configurations(rows).select(F.col("organization_id").alias("_of"), "criteria")
    joined = leads.join(set_up, F.col("organization_id") == F.col("_of"), "left").withColumn("criteria", F.coalesce("criteria", defaults()))
    scored = joined.withColumn("_points", F.transform("criteria", lambda c: F.struct(c["name"].alias("name"), criterion_points(c).alias("points"))))
    total = F.least(F.aggregate("_points", F.lit(0.0), lambda a, p: a + p["points"]), F.lit(100.0))
    out = scored.withColumns({"score": total, "criteria_scores": F.map_from_entries("_points")})
    return out.withColumn("qualification_label", label(F.col("score"))).drop("_of", "_points", "criteria")
