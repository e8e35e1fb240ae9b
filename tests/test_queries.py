"""All registered queries of the lead engine against DuckDB, and the parts that SQL does not reach."""

import datetime
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftwell.operators import leads, quota
from siftwell.plans import catalogue, process
import web_fixture
from siftwell.functions import extract
from siftwell.sources import web
from siftwell.sources.derived import RAW, view
from siftwell.streaming.leads import daily_usage_stream, process_stream, retries, retry_stream

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in RAW:
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=repr)
    assert got == want


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    """The tables, but titles and headings of pages end within a reference, as some of larger tables do."""
    folder, con = tmp_path_factory.mktemp("cut"), duckdb.connect()
    end = "['&amp', '&quo', '&lt', '&'][1 + page_id // 2 % 4]"
    con.execute(f"copy (select * replace (replace(replace(html, '</title>', {end} || '</title>'), '</h1>', {end} || '</h1>') as html) from '{SF}/pages.parquet') to '{folder}/pages.parquet' (format parquet)")
    for name in RAW:
        if name != "pages":
            (folder / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", ["extract_title", "extract_title_raw", "visible_text", "merge_scrape", "process_fetches", "render_waterfall", "process_lead", "process_lead_strict", "process_lead_without_ai", "process_leads"])
def test_pages_cut_within_references_equal_sql(spark, cut, name, monkeypatch):
    monkeypatch.setitem(globals(), "SF", cut[0])
    test_query_equals_sql(spark, cut[1], name)


def test_entry(spark):
    assert {r.label for r in entry.entry(spark).collect()} >= {"Warm Lead", "Cold Lead", "Disqualified"}
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inference_sees_whole_texts(spark, tmp_path):
    """What stands far beyond the beginning of a document counts."""
    text = "word " * 5000 + "We are an airline with a vacation flight program. 77 staff. President Ann Lee. Incorporated in 1977"
    spark.createDataFrame([(5 * 88 * 3 - 1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {n: catalogue.QUERIES[n](spark, str(tmp_path)).first()[1] for n in ("infer_industry", "estimate_employees", "extract_contact_name", "extract_contact_title", "extract_founded_year")}
    assert found == {"infer_industry": "Travel", "estimate_employees": "51-200", "extract_contact_name": "Ann Lee", "extract_contact_title": "President", "extract_founded_year": 1977}


def test_process(spark):
    pages = view(spark, SF, "pages_rich")
    rows = {r.lead_id: r for r in process.processed(pages).collect()}
    assert len(rows) == pages.count() and {r.scrape_source for r in rows.values()} == {"json_ld", "structured_data", "playwright"}
    assert any(r.enrichment_source for r in rows.values()) and any(r.score > 0 for r in rows.values())
    # a page with structured data has no title for the name, one with an og description shows it
    assert rows[10].company_name is None and rows[3].about_text == "Growing team, founded in 2005"
    strict = process.processed(pages, strict=True).collect()
    assert {(r.score, r.qualification_label, r.scrape_confidence) for r in strict} == {(0.0, "Low Priority", 0.0)}
    off = process.processed(pages, can_use_ai=False).collect()
    assert {r.industry for r in off} == {None} and all(r.outreach_message.startswith("No outreach") for r in off)
    assert process.processed(pages.limit(0)).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    pages = view(spark, SF, "pages_rich")
    pages.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    process_stream(stream, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    folders = sorted((tmp_path / "out").iterdir())
    assert all({p.name for p in f.iterdir() if p.is_dir()} == {"leads", "scraping_logs", "enrichment_logs"} for f in folders)
    got = spark.read.parquet(*(f"{f}/leads" for f in folders))
    logs = spark.read.parquet(*(f"{f}/scraping_logs" for f in folders))
    assert logs.count() == got.count() and spark.read.parquet(*(f"{f}/enrichment_logs" for f in folders)).count() == got.filter("enrichment_success").count()
    want = process.processed(pages)
    assert got.count() == want.count() and want.select(*got.columns).exceptAll(got).count() == 0

    rows = view(spark, SF, "leads").select("id", "organization_id", "created_at").orderBy("created_at")
    rows.coalesce(1).write.parquet(f"{tmp_path}/leads")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/leads").withColumn("created_at", F.col("created_at").cast("timestamp"))
    query = daily_usage_stream(source).writeStream.outputMode("append").format("memory").queryName("usage").trigger(availableNow=True).start()
    query.awaitTermination()
    streamed = {(r.organization_id, r.day): r.n for r in spark.table("usage").collect()}
    batch = {(r.organization_id, r.day): r.n for r in quota.daily_usage(rows).collect()}
    last = max(d for _, d in batch)
    closed = {k: n for k, n in batch.items() if k[1] < last - datetime.timedelta(days=2)}
    assert closed and all(streamed.get(k) == n for k, n in closed.items())


def test_retries_on_a_stream_equal_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, i % 7, i % 7 != 0 and i % 3 == 0, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=i)) for i in range(60)], "id long, lead_id int, success boolean, created_at timestamp")
    for k in range(3):  # a file a micro-batch, in order of time
        rows.filter(f"id div 20 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = retry_stream(source).writeStream.format("memory").queryName("retries").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, retries(rows).collect()), key=str)
    assert sorted(map(tuple, spark.table("retries").select("lead_id", "id", "failures", "action", "at").collect()), key=str) == want
    assert {r[3] for r in want} == {"done", "retry", "failed"}


def test_web_pages(spark):
    spark.sparkContext.addPyFile(web_fixture.__file__)
    web.register(spark)
    df = spark.read.format("web_pages").option("urls", " https://a.example \n\nhttps://bad.example\nhttps://c.example").option("fetch", "web_fixture:fetch").option("slices", "2").load()
    got = {r.url: (r.status, r.html, r.error) for r in df.collect()}
    assert got == {"https://a.example": (200, "<title>https://a.example</title>", None), "https://bad.example": (None, None, "refused"), "https://c.example": (200, "<title>https://c.example</title>", None)}
    asked = spark.createDataFrame([(7, "https://a.example"), (8, "https://bad.example")], "page_id int, url string")
    rows = {r.page_id: (r.success, r.title, r.error_message) for r in extract.attempted(web.fetched_pages(asked, web_fixture.fetch)).collect()}
    assert rows == {7: (True, "https://a.example", None), 8: (False, None, "no answer")}


def test_only_pages_that_fail_both_gates_are_rendered(spark, tmp_path):
    """Each call of fetch and render leaves a file: one a page, and one for each page of the third tier."""
    folder = str(tmp_path)
    plain = view(spark, SF, "pages_rich").limit(40).select("page_id", "url", "html").toPandas()
    plain["url"] = [f"https://p{i}.example/" for i in plain["page_id"]]
    htmls = dict(zip(plain["url"], plain["html"]))

    def noted(kind, url):
        import uuid

        open(f"{folder}/{kind}-{url.split('/')[2]}-{uuid.uuid4().hex}", "w").close()

    def fetch(url):
        noted("fetch", url)
        return {"status": 200, "html": htmls[url]}

    def render(url):
        noted("render", url)
        if url.startswith("https://p1."):
            raise OSError("crashed")
        return {"render_status": 200, "html": f"<title>rendered {url}</title><p>x@y.example"}

    asked = spark.createDataFrame(plain[["page_id", "url"]]).repartition(3)
    rows = extract.attempted(web.fetched_pages(asked, fetch), render=web.rendering(render)).collect()
    last = {r.url for r in rows if r.scraping_method == "playwright"}
    calls = {k: sorted(f"https://{p.name.split('-')[1]}/" for p in tmp_path.iterdir() if p.name.startswith(k)) for k in ("fetch", "render")}
    assert calls["render"] == sorted(last) == sorted(r.url for r in rows if r.render_wanted) and 0 < len(last) < 40
    assert calls["fetch"] == sorted(htmls)
    assert {r.url: (r.success, r.title, r.email) for r in rows if r.url in last} == {u: (False, None, None) if u.startswith("https://p1.") else (True, f"rendered {u}", "x@y.example") for u in last}


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a,b"), (2, None)], "id int, name string")
    for kind in ("csv", "json", "parquet", "orc"):
        leads.export(rows, f"{tmp_path}/{kind}", kind)
        back = spark.read.format(kind).schema(rows.schema).options(header="true").load(f"{tmp_path}/{kind}")
        assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None)]


def test_leads_that_are_missing_or_not_fetched(spark):
    got = {r.lead_id: r for r in process.results(catalogue.of_requests(catalogue.Tables(spark, SF))).collect()}
    assert (got[-1].status, got[-1].error) == ("error", "Lead -1 not found") and got[-1].scraping_success is None
    assert got[2].status == "success" and {r.scraping_success for r in got.values()} == {True, False, None}


def test_admission(spark):
    usage = spark.createDataFrame([(1, 10, 8, 2), (2, 10, 10, 0)], "organization_id int, max_leads_per_day int, current_usage int, remaining_daily_leads int")
    batches = spark.createDataFrame([(1, 1, 3), (2, 2, 1), (3, 1, 0), (4, 9, 10), (5, 9, 1)], "batch_id int, organization_id int, n int")
    assert {r.batch_id: r.status for r in quota.admit(batches, usage).collect()} == {1: "too many", 2: "limit reached", 3: "empty", 4: "accepted", 5: "limit reached"}


def test_insert_and_update(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, name string, note string")
    new, rejected = leads.inserted(old, spark.createDataFrame([(5, "b", "n"), (6, "c", "n"), (7, "c", "n")], "id int, name string, note string"), "name")
    assert [r.id for r in new.collect()] == [6] and sorted(r.id for r in rejected.collect()) == [5, 7]
    changes = spark.createDataFrame([(2, None, True)], "id int, note string, set_note boolean")
    assert {r.id: r.note for r in leads.updated(old, changes, ["note"]).collect()} == {1: "x", 2: None}


def test_plans_keep_filters_at_the_scan(spark, capsys):
    """The tenant's filter and the needed columns reach the scan."""
    df = catalogue.QUERIES["scan_leads_by_owner"](spark, SF)
    catalogue.QUERIES["active_leads"](spark, SF).explain("formatted")
    shown = capsys.readouterr().out
    assert "o_orderstatus" in shown.split("PushedFilters")[1].split("ReadSchema")[0]
    assert "o_totalprice" not in shown.split("ReadSchema")[1]
    assert df.columns[0] == "id"


def test_pages_far_down_a_list(spark, monkeypatch):
    """Every page equals the plain one: ties at bounds, rows without key, one key that many rows have, pages beyond the end."""
    ids = [None] * 30 + [5] * 400 + list(range(1000)) + [2000 + i // 3 for i in range(300)]
    rows = spark.createDataFrame([(i,) for i in ids], "id long").repartition(3)
    order = sorted(ids, key=lambda i: (i is not None, i or 0))
    for skip, limit in ((0, 5), (25, 10), (200, 30), (433, 3), (900, 100), (1725, 10), (5000, 3)):
        got = [r.id for r in leads.page(rows, skip, limit, at_once=40).collect()]
        assert got == order[skip : skip + limit], (skip, limit)


def test_billing_merges_in_tasks(spark):
    """No window, and each task gives a row an organization: partial sums stand before the exchange."""
    plan = catalogue.QUERIES["apply_billing_to_subscriptions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan


def test_billing_before_and_after_creation(spark):
    """What comes before an organization's first creation changes nothing, unless there was a row."""
    at = datetime.datetime(2024, 1, 1)
    kinds = {1: ["updated", "created"], 2: ["deleted", "updated"], 3: ["created", "deleted"], 4: ["updated", "created", "updated"], 5: ["payment"], 6: ["deleted"], 7: ["created", "created"]}
    events = spark.createDataFrame([(i, at + datetime.timedelta(minutes=i), o, k, f"price_{(123, 456, 789)[i % 3]}", "past_due", True) for o, ks in kinds.items() for i, k in enumerate(ks)], "event_id long, at timestamp, organization_id long, kind string, price string, status string, at_period_end boolean")
    got = {r.organization_id: tuple(r)[1:] for r in quota.folded(events).collect()}
    assert got == {1: ("pro", "active", False), 3: ("starter", "canceled", False), 4: ("enterprise", "past_due", True), 7: ("pro", "past_due", False)}
    held = spark.createDataFrame([(2, "pro", "active", False), (5, "free", "active", True), (6, "pro", "active", True)], "organization_id long, plan_name string, status string, cancel_at_period_end boolean")
    got = {r.organization_id: tuple(r)[1:] for r in quota.folded(events, held).filter("organization_id in (2, 5, 6)").collect()}
    assert got == {2: ("pro", "past_due", True), 5: ("free", "active", True), 6: ("pro", "canceled", True)}
