"""Outreach texts from templates, their styles and the gate of the plan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def present(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def worded(template: str, **values: Column) -> Column:
    """The template with its names filled in, as one concatenation."""
    parts = [values[p[1:-1]] if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def names(sender: str) -> dict[str, Column]:
    either = lambda c, other: F.when(present(F.col(c)), F.col(c)).otherwise(F.lit(other))
    return {"contact": either("contact_name", fixed.NO_CONTACT), "company": either("company_name", fixed.NO_COMPANY), "industry": F.coalesce(F.col("industry"), F.lit("")), "website": either("website", fixed.NO_WEBSITE), "sender": F.lit(sender)}


def industry_template(sender: str = fixed.SENDER) -> Column:
    v = names(sender)
    key = F.replace(F.lower(v["industry"]), F.lit(" "), F.lit(""))
    out = None
    for name, text in fixed.TEMPLATES.items():
        out = F.when(key == name, worded(text, **v)) if out is None else out.when(key == name, worded(text, **v))
    return out.otherwise(worded(fixed.TEMPLATE_INDUSTRY, **v))


def generic_template(sender: str = fixed.SENDER) -> Column:
    return worded(fixed.TEMPLATE_COMPANY, **names(sender))


def website_template(sender: str = fixed.SENDER) -> Column:
    return worded(fixed.TEMPLATE_WEBSITE, **names(sender))


def template(sender: str = fixed.SENDER) -> Column:
    company, industry = present(F.col("company_name")), present(F.col("industry"))
    return F.when(company & industry, industry_template(sender)).when(company, generic_template(sender)).otherwise(website_template(sender))


def professional(m: Column, sender: str = fixed.SENDER) -> Column:
    m = F.replace(m, F.lit("Hi "), F.lit("Dear "))
    return F.when(m.contains("Best regards,"), m).otherwise(F.concat(m, F.lit(f"\n\nBest regards,\n{sender}")))


def friendly(m: Column) -> Column:
    return F.replace(F.replace(m, F.lit("Dear "), F.lit("Hi ")), F.lit("Best regards,"), F.lit("Cheers,"))


def short(m: Column) -> Column:
    return F.array_join(F.slice(F.split(m, "\n"), 1, 4), "\n")


def ensure_company(m: Column, company: Column) -> Column:
    missing = present(company) & ~F.contains(F.lower(m), F.lower(company))
    return F.when(F.coalesce(missing, F.lit(False)), F.concat(F.lit("Hi "), company, F.lit(" team,\n\n"), m)).otherwise(m)


def sufficient_data(about: str | None = None) -> Column:
    terms = [present(F.col(c)).cast("int") for c in ("company_name", "industry", "contact_name", "employees")]
    if about:
        terms.append((F.coalesce(F.length(about), F.lit(0)) > 50).cast("int"))
    return sum(terms[1:], terms[0]) >= 2


def prompt(sender: str = fixed.SENDER) -> Column:
    """What a language model is asked, parts with nothing to say left out; ``{sender_org}`` in the last stays as it is."""
    company = F.when(present(F.col("company_name")), F.col("company_name")).otherwise("their company")
    industry = F.when(present(F.col("industry")), F.col("industry")).otherwise("their industry")
    contact = F.when(present(F.col("contact_name")), F.col("contact_name")).otherwise(fixed.NO_CONTACT)
    return F.concat_ws(
        "\n",
        F.lit(f"Sender Organization: {sender}"), F.concat(F.lit("Recipient Company: "), company), F.concat(F.lit("Industry: "), industry), F.concat(F.lit("Website: "), F.col("website")),
        F.when(present(F.col("about_text")), F.concat(F.lit("About: "), F.substring("about_text", 1, 200), F.lit("..."))), F.concat(F.lit("Contact: "), contact),
        F.when(present(F.col("employees")), F.concat(F.lit("Size: "), F.col("employees"), F.lit(" employees"))),
        worded(fixed.PROMPT, sender=F.lit(sender), company=company, industry=industry, sender_org=F.lit("{sender_org}")),
    )


def generated(model: Column | None = None, about: str | None = None) -> Column:
    """What a language model wrote where data suffice and it wrote something, else the template."""
    return template() if model is None else F.coalesce(F.when(sufficient_data(about), model), template())


def gated(can_use_ai: Column, m: Column) -> Column:
    return F.when(can_use_ai, m).otherwise(fixed.NO_MESSAGE)
