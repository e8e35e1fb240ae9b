"""Tables shaped like the lead data, derived from the raw tables; the same text serves Spark and DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The views as both sides must have them.
VIEWS = {
    "organizations": """
select c_custkey as id, c_name as name, 100 as max_leads, c_acctbal >= -900 as is_active from customer
""",
    "subscriptions": """
select c_custkey as id, c_custkey as organization_id,
  case c_mktsegment when 'BUILDING' then 'pro' when 'MACHINERY' then 'enterprise' when 'HOUSEHOLD' then 'starter' else 'free' end as plan_name,
  case when c_acctbal < 0 then 'canceled' else 'active' end as status,
  c_acctbal < 500 as cancel_at_period_end
from customer where c_mktsegment <> 'FURNITURE'
""",
    "leads": """
select o_orderkey as id, o_custkey as organization_id, o_custkey % 97 as owner_id,
  concat('https://www.c', cast(o_custkey as varchar(20)), '.example.com/') as website,
  case when o_orderkey % 5 = 0 then null else concat('Company ', cast(o_custkey as varchar(20))) end as company_name,
  case o_orderkey % 12 when 0 then 'Software' when 1 then 'Consulting' when 2 then 'E-commerce' when 3 then 'Finance' when 4 then 'Healthcare'
    when 5 then 'Marketing' when 6 then 'Education' when 7 then 'Real Estate' when 8 then 'Travel' when 9 then 'Food & Beverage' when 10 then 'Fintech' end as industry,
  case o_orderkey % 7 when 0 then '1-10' when 1 then '11-50' when 2 then '51-200' when 3 then '201-500' when 4 then '500+' when 5 then '' end as employees,
  cast(o_orderkey % 11 as double) / 10 as email_confidence,
  cast(o_orderkey % 13 as double) / 12 as scrape_confidence,
  cast(o_orderkey % 17 as double) / 16 as enrichment_confidence,
  case when o_orderkey % 3 = 0 then concat('https://linkedin.com/company/c', cast(o_custkey as varchar(20))) when o_orderkey % 3 = 1 then '' end as linkedin_url,
  case when o_orderkey % 4 = 0 then concat('Dana Lee') end as contact_name,
  o_orderstatus <> 'F' as is_active, o_orderdate as created_at
from orders
""",
    "usage_records": """
select event_id as id, user_id as organization_id, event_type as action, cast(floor(value / 10) as bigint) + 1 as quantity, ts as recorded_at from events
""",
    "scraping_logs": """
select event_id as id, event_id % 1500 as lead_id,
  case event_type when 'click' then 'json_ld' when 'view' then 'structured_data' when 'signup' then 'playwright' else 'requests' end as scraping_method,
  event_type <> 'error' as success, cast(event_id % 11 as double) / 10 as confidence_score,
  cast(floor(value) as bigint) as processing_time_ms, ts as created_at
from events
""",
    "lead_text": """
select doc_id as id, concat('Company: C', cast(doc_id as varchar(20)), ' ', text, ' ',
  case doc_id % 11 when 0 then 'Cloud software platform' when 1 then 'Advisory and strategy consulting' when 2 then 'Online shop and marketplace'
    when 3 then 'Fintech payment' when 4 then 'Medical clinic' when 5 then 'Advertising campaign' when 6 then 'University course'
    when 7 then 'Property and housing' when 8 then 'Hotel booking' when 9 then 'Cafe catering' else '' end, ' ',
  case doc_id % 8 when 0 then 'early stage startup' when 1 then 'a growing team' when 2 then 'well established' when 3 then 'very large'
    when 4 then 'massive' when 5 then '57 employees' when 6 then 'team of 9' else '' end, ' ',
  case doc_id % 5 when 0 then 'CEO Jane Doe' when 1 then 'Mark Smith Founder' when 2 then 'Chief Data Officer' when 3 then 'leading cookie' else '' end, ' ',
  case doc_id % 6 when 0 then 'Founded in 2005' when 1 then 'since 1998' when 2 then 'established ''98' when 3 then '1987 launched' when 4 then 'founded 2011' else '' end) as text
from documents
""",
    "pages_rich": """
select page_id, url, replace(replace(html, '<meta charset="utf-8">', concat('<meta charset="utf-8">',
  case when page_id % 2 = 0 then '<meta name="description" content=" Cloud software &amp; platform ">' else '' end,
  case when page_id % 3 = 0 then '<meta property="og:title" content="OG"><meta property="og:description" content="Growing team, founded in 2005">' else '' end,
  case when page_id % 7 = 0 then '<meta property="og:image" content="i.png"/><meta name="twitter:card" content="summary"><script src="t.js"/>' else '' end,
  case when page_id % 5 = 0 then concat('<script type="application/ld+json">{"@type":"Organization","name":"Acme ', cast(page_id as varchar(20)), '","description":"d","url":"u","email":"a@b.co","foundingDate":"2001"',
    case when page_id % 10 = 0 then ',"address":"x"' else ',"address":{"street":"s"}' end,
    case when page_id % 15 = 0 then ',"sameAs":["https://x.example/a","https://y.example/b"],"offers":[{"price":1.5,"tags":[],"ok":true},{"price":null,"n":3,"of":{"logo":"l.png"}}]' else '' end,
    case when page_id % 35 = 0 then '' else '}' end, '</script>') else '' end)),
  '<body>', concat('<body>', case when page_id % 4 <> 3 then '<a href="/about">a</a><a href="https://www.linkedin.com/company/a">l</a><a href="#x">h</a>' else '' end,
  ' mail INFO@Acme.example.com call +1 555-010-0001 ')) as html
from pages
""",
}
#: How pages were fetched: some not answered, some not rendered, some by a renderer that cannot start.
VIEWS["fetches"] = f"""
select page_id, url, html, cast(case page_id % 9 when 4 then 404 when 7 then 503 when 5 then null else 200 end as int) as status,
  case when page_id % 9 = 5 then 'timed out' end as error,
  cast(case page_id % 8 when 3 then 500 when 1 then null when 7 then null when 4 then null else 200 end as int) as render_status,
  case page_id % 8 when 1 then 'Browser launch failed: NotImplementedError' when 7 then 'no Subprocess here' when 4 then 'crashed' end as render_error
from ({VIEWS["pages_rich"].strip()}) p
"""
#: What a renderer made of pages: some elements come from scripts only; some pages were not rendered, or gave nothing.
VIEWS["renders"] = """
select page_id, case when page_id % 11 = 4 then null else replace(replace(html, '</title>', concat(' &ndash; page ', cast(page_id as varchar(20)), '</title>')), '<body>', concat('<body><p>Reach us: team', cast(page_id as varchar(20)), '@rendered.example.org or +44 (555) 010-7788</p>',
    case when page_id % 3 = 1 then '<a href="https://a.example/1">1</a><a href="https://a.example/2">2</a><a href="https://a.example/3">3</a><a href="https://a.example/4">4</a><a href="https://a.example/5">5</a><a href="https://linkedin.com/in/b">6</a>' else '' end)) end as rendered_html,
  cast(case page_id % 8 when 3 then 500 when 1 then null when 5 then null else 200 end as int) as render_status,
  case page_id % 8 when 1 then 'Browser launch failed: NotImplementedError' when 5 then 'crashed' end as render_error
from pages
"""
#: Users, keys and requests shaped like the application's.
VIEWS["users"] = """
select c_custkey as id, concat('user', cast(c_custkey % 400 as varchar(20)), '@c', cast(c_custkey as varchar(20)), '.example.com') as email, concat('hash', cast(c_custkey as varchar(20))) as hashed_password,
  c_name as first_name, c_mktsegment as last_name, c_acctbal >= 0 as is_active, c_nationkey % 2 = 0 as is_verified, c_custkey as organization_id
from customer
"""
#: What organizations have set: two kinds of criteria, one that is not known among them; half of them have set nothing.
VIEWS["scoring_rows"] = """
select c_custkey as organization_id, position, name, weight, threshold, max_score from customer join (select * from (values
  (0, 1, 'industry_match', 0.5e0, 0.6e0, 60e0), (0, 2, 'scrape_quality', 0.3e0, 0.5e0, 40e0), (0, 3, 'unknown', 0.2e0, 0.5e0, 99e0),
  (1, 1, 'linkedin_presence', 2e0, 0.6e0, 55e0), (1, 2, 'email_quality', 1e0, 0.2e0, 25e0), (1, 3, 'company_size', 1e0, 0.6e0, 30e0), (1, 4, 'enrichment_quality', 0e0, 0.9e0, 20e0)) v(kind, position, name, weight, threshold, max_score)) c on c_custkey % 4 = kind
"""
#: What a model answered to texts, as text: chat around the braces, fields missing or null, other keys and types, broken and no JSON.
VIEWS["answers"] = """
select id, text as prompt, case id % 9
  when 0 then concat('Sure, here it is:\n{"industry": "Retail", "employees": "11-50", "revenue_band": null, "founded_year": ', cast(1950 + id % 70 as varchar(20)), '}\nAnything else?')
  when 1 then '{"industry": "Retail", "employees": null, "contact_name": "Ann Lee", "contact_title": "CTO", "founded_year": 1999, "note": "x"}'
  when 2 then '{"industry": "Ret' when 3 then 'I cannot say.' when 4 then '{"industry": null, "employees": null}'
  when 5 then '{"industry": ["a", "b"], "founded_year": "soon", "employees": "1-10"}' when 6 then '{"a": {"b": 1}} and {"industry": "Late"}'
  when 7 then '```json {"industry":"Travel","employees":"51-200","revenue_band":"$10M-50M","contact_name":"Bo Li","contact_title":"CEO","founded_year":2001} ```' end as answer
from lead_text
"""
#: What an outside service knows of some of them, as it was stored.
VIEWS["services"] = """
select id, case id % 5 when 0 then 'Retail' when 1 then 'Travel' end as industry, '11-50' as employees, case id % 5 when 0 then 0.9e0 when 1 then 0.6e0 end as confidence from lead_text where id % 5 < 2
"""
VIEWS["api_keys"] = """
select s_suppkey as id, s_suppkey % 50 as organization_id, concat('sk_', substr(s_name, 10, 5)) as key_prefix, s_acctbal >= 0 as is_active, s_nationkey % 7 = 0 as is_revoked, s_name as name from supplier
"""


#: Tables of texts, on whose rows much work is done; and how many bytes of one are dealt out if its files are fewer than the session's tasks.
TEXTS, SMALL = ("documents", "pages"), 64 << 20


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is. A small one of texts in a file or two would be the work of a task or two, so its rows are dealt out first."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plan = getattr(rows, "_jdf", None)  # remote sessions tell no sizes: the table stays as it is
    if name not in TEXTS or plan is None or int(plan.queryExecution().analyzed().stats().sizeInBytes()) > SMALL:
        return rows
    tasks = spark.sparkContext.defaultParallelism
    return rows.repartition(tasks) if len(rows.inputFiles()) < tasks else rows


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a raw table, over the tables of ``sf_dir``."""
    if name not in VIEWS:
        return raw(spark, sf_dir, name)
    text = VIEWS[name]
    for other in VIEWS:
        if re.search(rf"from {other}\b", text):
            view(spark, sf_dir, other).createOrReplaceTempView(f"derived_{other}")
            text = re.sub(rf"from {other}\b", f"from derived_{other}", text)
    for table in RAW:
        if re.search(rf"from {table}\b", text):
            raw(spark, sf_dir, table).createOrReplaceTempView(f"raw_{table}")
            text = re.sub(rf"from {table}\b", f"from raw_{table}", text)
    return spark.sql(text)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB with the views that it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b(from|join) {n}\b", sql)]
    used = [n for n in VIEWS if n in used or any(re.search(rf"\bfrom {n}\b", VIEWS[u]) for u in used)]
    head = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in used)
    if not head:
        return sql
    body = sql.strip()
    return f"with {head}, {body[5:]}" if body.lower().startswith("with ") else f"with {head} {body}"
