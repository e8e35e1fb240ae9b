"""Hand-derived cases and properties of extraction, inference, scores and messages."""

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions import enrich, extract, message, score, variants
from siftwell.plans import process


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_confidence_gate_follows_the_order_of_addition(spark):
    got = enrich.waterfall(texts(spark, "57 employees CEO Jane Doe since 1998", "Cafe CEO Jane Doe since 1998", "Cafe 57 employees CEO Jane Doe since 1998", "", None)).orderBy("id").collect()
    assert [(r.confidence, r.method) for r in got] == [(0.7000000000000001, "heuristic"), (None, None), (0.9, "heuristic"), (None, None), (None, None)]
    assert column(enrich.inferred(texts(spark, "Cafe CEO Jane Doe since 1998")), "confidence") == [0.7]


@pytest.mark.parametrize(
    "name, cases",
    [
        ("industry", [("buy", "E-commerce"), ("happy", "Software"), ("nothing", None), (None, None)]),
        ("employees", [("very large", "201-500"), ("57 employees", "51-200"), ("team of 9", "1-10"), ("99999999999999999999 staff", "500+"), ("000000000012 staff", "11-50"), ("none", None)]),
        ("contact_title", [("leading cookie", "Lead"), ("CEO", "Ceo"), ("Chief Data Officer", "Chief Data Officer"), ("no one", None)]),
        ("founded_year", [("Founded in 2005", 2005), ("founded 2011", 2011), ("since 1998", 1998), ("1987 launched", 1987), ("established '98", None), ("founded '98 since 2001", 2001)]),
        ("contact_name", [("CEO Jane Doe", "Jane Doe"), ("Mark Smith Founder", "Mark Smith"), ("Owner Ann Lee", "Ann Lee"), ("ceo jane doe", None)]),
    ],
)
def test_inference(spark, name, cases):
    assert column(enrich.inferred(texts(spark, *(c[0] for c in cases))), name) == [c[1] for c in cases]


def test_inference_equals_plain_patterns(spark):
    """Words in one pass and patterns from the first of them on give what plain searches of the whole text do; letters that change their number in lower case too."""
    import random
    import re

    from siftwell.functions import fixed

    r = random.Random(11)
    words = [w for ws in (*fixed.INDUSTRIES.values(), *fixed.SIZE_WORDS.values()) for w in ws] + ["CEO", "Founder", "Chief  Data Officer", "Owner", "LEAD", "vp", "Jane Doe", "Mark Smith", "founded in 1999", "Since  2005", "1987 launched", "established '07", "from 1820", "57 employees", "9 staff", "team of 12", "3 person team", "İ", "ß", "xİxİ", "\n", "lead", "Manager Ann Lee"]
    rows = [None, ""] + [" ".join(r.choice(words) for _ in range(r.randint(1, 14))) for _ in range(300)]
    first = lambda text, patterns: next((m[1] for p in patterns if (m := re.search(p, text, re.ASCII)) and m[1]), None)

    def plain(text):
        low = (text or "").lower()
        hits = [sum(k in low for k in ws) for ws in fixed.INDUSTRIES.values()]
        years = [m[1] for p in fixed.YEAR_PATTERNS if (m := re.search(p, text or "", re.ASCII))]
        years = [int("20" + y[1:] if y[0] == "'" else y) for y in years]
        band = next((b for b, ws in fixed.SIZE_WORDS.items() if any(w in low for w in ws)), None)
        n = first(low, fixed.SIZE_PATTERNS)
        if band is None and n is not None:
            band = next((b for most, b in fixed.SIZE_BOUNDS if int(n) <= most), fixed.SIZE_ABOVE)
        title = first(text or "", fixed.TITLE_PATTERNS)
        return (list(fixed.INDUSTRIES)[hits.index(max(hits))] if max(hits) else None, band, first(text or "", fixed.CONTACT_PATTERNS), title and " ".join(w.capitalize() for w in title.split(" ")), next((y for y in years if 1900 <= y <= 2030), None))

    got = enrich.inferred(texts(spark, *rows)).orderBy("id").collect()
    assert [(x.industry, x.employees, x.contact_name, x.contact_title, x.founded_year) for x in got] == [plain(t) for t in rows]


LEAD = "id int, industry string, employees string, email_confidence double, scrape_confidence double, enrichment_confidence double, linkedin_url string"


def test_scores_at_their_edges(spark):
    rows = [(0, "Software", "11-50", 1.0, 1.0, 1.0, "x"), (1, None, None, 0.6, 0.5999, None, ""), (2, "Travel", "1-10", 0.0, 0.0, 0.0, None)]
    got = spark.createDataFrame(rows, LEAD).select("id", score.total().alias("s")).withColumn("label", score.label(F.col("s"))).orderBy("id").collect()
    assert [(r.s, r.label) for r in got] == [(100.0, "Hot Lead"), (15.0 * 0.6, "Disqualified"), (0.0, "Disqualified")]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["Software", "AI", None, ""]), st.sampled_from(["11-50", "500+", None]), st.floats(0, 1), st.floats(0, 1), st.floats(0, 1), st.sampled_from(["u", "", None])), min_size=1, max_size=20))
def test_scores_stay_in_range_and_labels_follow(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], LEAD).select(score.total().alias("s")).withColumn("label", score.label(F.col("s")))
    got = sorted((r.s, r.label) for r in df.collect())
    order = ["Disqualified", "Cold Lead", "Warm Lead", "Hot Lead"]
    assert all(0 <= s <= 100 for s, _ in got)
    places = [order.index(x) for _, x in got]
    assert places == sorted(places)


def test_flatten():
    assert extract.flatten({"a": {"b": 1}, "c": [{"d": 2}, 3], "e": {}, "n": None}) == {"a_b": 1, "c_0_d": 2, "c_1": 3, "n": None}
    assert extract.read_scripts(['{"a": 1, "b": 2}', "not json", '[{"b": 3}, 4]']) == (True, {"a": 1, "b": 3})
    assert extract.read_scripts(['{"a": 1}', ""]) == (False, {}) and extract.read_scripts(None) == (True, {})


PAGE = """<html><head><title> Acme &amp; Co </title><meta content='d1' name="description"><meta property="og:title" content="one"><meta property="og:title" content="two">{}</head>
<body><a href="/about">a</a><a href='//cdn.x/y'>b</a><a href="http://z">c</a><a href="#t">d</a><a href="mailto:q">e</a><script>"</p>"</script>Mail INFO@Acme.example.com or +1 555-010-0001</body></html>"""


def pages(spark, *html, url="https://www.acme.co.uk:80/p?q"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(html)], "page_id int, url string, html string")


def test_entities_and_links_as_browsers_see_them(spark):
    """Expected by hand: named and numbered entities, unquoted and quoted attributes, comments, schemes."""
    html = """<title>Caf&eacute; &#8217;A&apos; &mdash; B</title><meta name=description content=x&amp;y><meta content="it's" property='og:a'><meta property="og:" content="no">
    <!-- <a href="http://hidden">h</a> --><script>var a = '<a href="http://script">s</a>'</script>
    <body><a href=https://plain.example/a?b=1&amp;c=2>1</a><a href="httpdocs/x">2</a><a HREF='/o"k'>3</a><a href="/it's">4</a><a href="../up">5</a><a href="/a/../b">6</a><a name=x>7</a> caf&#233; &lt;b&gt;</body>"""
    r = extract.fields(pages(spark, html)).first()
    assert (r.title, r.description, r.og) == ("Caf\u00e9 \u2019A' \u2014 B", "x&y", {"og_a": "it's"})
    assert r.links == ["https://plain.example/a?b=1&c=2", 'https://www.acme.co.uk:80/o"k', "https://www.acme.co.uk:80/it's", "https://www.acme.co.uk:80/b"]
    assert r.plain_links == r.links[:1] and "caf\u00e9 <b>" in r.visible and "script" not in r.body_text


def test_references_without_an_end_are_text(spark):
    """Titles that were cut within a reference; scripts and comments hold no references; unknown names are text."""
    html = """<!-- & <script> --><title>a &amp;&amp; b &amp</title><meta name="description" content="R&D &copy &amp; x?a=1&lt=2"><script type="application/ld+json">{"name": "A & B &amp; &amp"}</script><script src="t.js"/><body>&ampx &notit; &#39 &#39;c&lt;<style>&</style>&lt &gt"""
    r = extract.fields(pages(spark, html)).first()
    assert (r.title, r.description, r.visible, r.ld.data) == ("a && b &amp", "R&D &copy & x?a=1&lt=2", "&ampx &notit; &#39 'c< &lt &gt", {"name": "A & B &amp; &amp"})


def test_elements_that_close_themselves_hold_nothing(spark):
    """A page of 3 KB with entities, comments and elements that close themselves: all that follows them counts."""
    words = " ".join(f"w{i} &lt;{i}&gt;" for i in range(250))
    html = f"""<!DOCTYPE html><html><head><meta charset="utf-8"/><script src="a.js"/><style/><title>Hello &amp; all</title><meta name="description" content="d"/></head>
    <body><script async src='b.js' /><!-- <p>hidden</p> --><p>Caf&eacute;<br/>open</p>\n\t <title/>{words}<script>var t = "</p>";</script>mail <b>A@b.co</b></body></html>"""
    r = extract.fields(pages(spark, html)).first()
    assert len(html) > 3000 and (r.title, r.description, r.email) == ("Hello & all", "d", "a@b.co")
    assert r.visible.startswith("Caf\u00e9 open w0 <0> w1 <1>") and r.visible.endswith("mail A@b.co") and "hidden" not in r.visible and "var t" not in r.body_text
    assert r.visible == " ".join(r.visible.split(" ")) and "  " not in r.visible


def test_json_on_the_jvm_equals_the_table_function(spark):
    """Deep and mixed values, several texts of one record, an outermost list, malformed texts."""
    deep = "1"
    for i in range(60):
        deep = f'{{"k{i}":[{deep},"x"]}}' if i % 2 else f"[{deep},null,{{}},[]]"
    texts_of = {1: ['{"a":{"b":[1,{"c":null}]},"d":"x y","e":{},"t":true,"z":[[],[[2.5]]]}'], 2: ['[3,{"k":"v"},[["n"]],"bare"]'], 3: ["bad", '{"a":1} x', '{"a":1},{"b":2}', '{"a":1'], 4: ['"s"'], 5: [f'{{"deep":{deep}}}'], 6: ['{"a":1,"b":false}', '{"c":"\\u00e9\\"q"}'], 7: [""]}
    rows = [(i, t) for i, ts in texts_of.items() for t in ts]
    found = variants.leaves(spark.createDataFrame(rows, "id int, t string"), "id", "t")
    got = {(r.id, r.key, r.value, r.kind) for r in variants.merged(found, "id").collect()}
    want = {(i, k, extract.as_text(v), extract.kind(v)) for i, ts in texts_of.items() for ok, data in [extract.read_scripts(ts)] if ok for k, v in data.items()}
    assert got == want and max(len(r.place) for r in found.collect()) > 55
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_attempts(spark):
    """How a page was fetched decides what it gives: by hand, one row a case."""
    good, bare = PAGE.format(""), "<p>mail a@b.co</p>"
    rows = [
        (0, good, 200, None, 200, None), (1, bare, 404, None, 200, None), (2, bare, 503, None, 404, None), (3, bare, None, "timed out", None, "crashed"),
        (4, bare, 200, None, None, "x NotImplementedError"), (5, bare, 500, None, None, "SubProcess"), (6, None, 200, None, 200, None), (7, f"<body>{bare}", 200, None, None, "a subprocess died"),
    ]
    df = spark.createDataFrame(rows, "page_id int, html string, status int, error string, render_status int, render_error string").withColumn("url", F.lit("https://www.acme.example/"))
    got = {r.page_id: (r.success, r.scraping_method, round(r.scraping_confidence, 9), r.error_message, r.email) for r in extract.attempted(df).collect()}
    assert got == {
        0: (True, "structured_data", 0.9, None, None), 1: (True, "playwright", 0.6, None, "a@b.co"), 2: (False, "playwright", 0.0, "HTTP 404", None), 3: (False, "playwright", 0.0, "crashed", None),
        4: (True, "requests", 0.32, None, None), 5: (False, "requests", 0.0, "HTTP 500", None), 6: (False, "playwright", 0.3, "No data extracted by Playwright", None), 7: (True, "requests", 0.48, None, "a@b.co"),
    }


def test_tiers_of_enrichment(spark):
    """Each tier behind its gate; later ones see only what earlier ones leave, the model 2000 characters of it."""
    sure = F.udf(lambda t: None if t is None else ("Travel", None, None, None, None, None, 0.6 if "low" in t else 0.61), "industry string, employees string, revenue_band string, contact_name string, contact_title string, founded_year int, confidence double")
    told = F.udf(lambda t: None if t is None or "mute" in t else (None, None, None, str(len(t)), None, None), "industry string, employees string, revenue_band string, contact_name string, contact_title string, founded_year int")
    rows = texts(spark, "Cafe 57 employees CEO Jane Doe since 1998", "nothing", "low " + "x" * 3000, "low mute", None)
    got = [(r.method, r.industry, r.contact_name, r.confidence) for r in enrich.waterfall(rows, external=sure, model=told).orderBy("id").collect()]
    assert got == [("heuristic", "Food & Beverage", "Jane Doe", 0.9), ("external_api", "Travel", None, 0.61), ("llm", None, "2000", 0.6), (None, None, None, None), (None, None, None, None)]


def test_patterns_are_matched_once(spark):
    """The plan has each pattern once and lower-cases the text once."""
    plan = enrich.waterfall(texts(spark, "a").withColumn("text", F.concat("text", F.lit("x"))))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == sum(map(len, enrich.PATTERNS.values())) and plan.count("lower(") == 1


def test_extraction(spark):
    r = extract.fields(pages(spark, PAGE.format(""))).first()
    assert (r.title, r.description, r.og, r.twitter, r.company) == ("Acme & Co", "d1", {"og_title": "two"}, {}, "acme")
    assert r.links == ["https://www.acme.co.uk:80/about", "https://cdn.x/y", "http://z"] and r.plain_links == ["http://z"]
    assert (r.email, r.phone) == ("info@acme.example.com", "+1 555-010-0001") and "script" not in r.visible
    empty = extract.fields(pages(spark, "", None)).collect()
    assert [(x.title, x.description, x.email) for x in empty] == [(None, None, None)] * 2


def test_waterfall_picks_one_way(spark):
    ld = '<script type="application/ld+json">{}</script>'
    full = ld.format('{"name":"n","description":"d","url":"u","email":"e","address":"a"}')
    nested = ld.format('{"name":"n","description":"d","url":"u","address":{"street":"s"}}')
    only_titles = '<title>t</title><meta property="og:title" content="x">'
    html = [PAGE.format(full), PAGE.format(nested), PAGE.format(full + ld.format("")), only_titles, '<title>t</title><meta name="description" content="x">', "<p>nothing</p>"]
    got = [(r.scraping_method, round(r.scraping_confidence, 9)) for r in extract.attempted(pages(spark, *html)).orderBy("page_id").collect()]
    assert [m for m, _ in got] == ["json_ld", "structured_data", "structured_data", "playwright", "structured_data", "playwright"]
    assert all(0 <= c <= 1 for _, c in got)


def test_messages(spark):
    row = (0, "Acme", "E-commerce", None, "", "https://a", None)
    df = spark.createDataFrame([row, (1, "Acme", "Software", "Ann", None, "https://a", None), (2, "", "Software", "Ann", None, "https://a", None)], "id int, company_name string, industry string, contact_name string, employees string, website string, about_text string")
    got = column(df.select("id", message.template("Us").alias("m")), "m")
    assert "in the E-commerce space and thought" in got[0] and got[0].startswith("Hi the team,") and "in the software space" in got[1] and got[2].startswith("Hi team,\n\nI visited https://a and was impressed by your company's")
    m = F.col("m")
    styled = df.select("id", message.template("Us").alias("m")).select("id", message.professional(m).alias("p"), message.professional(message.professional(m)).alias("pp"), message.friendly(m).alias("f"), message.short(m).alias("s")).first()
    assert styled.p == styled.pp and styled.p.startswith("Dear ") and "Cheers," in styled.f and styled.s.count("\n") == 3
    assert column(df.select("id", message.generated(F.when(F.col("id") == 1, "from the model")).alias("m")), "m")[1] == "from the model"
    assert column(df.select("id", message.gated(F.lit(False), m=F.lit("x")).alias("m")), "m") == ["No outreach message generated - AI features not available on your plan"] * 3


def test_model_answers_are_read_from_text(spark):
    """Chat around the braces, braces within, other types, malformed texts, nothing: by hand."""
    fields = '"industry": "Retail", "employees": "1-10", "revenue_band": null, "contact_name": null, "contact_title": null'
    cases = {
        f'Here: {{{fields}, "founded_year": 1999}} bye': ("Retail", "1-10", None, 1999, 3), '{"industry": "a{b}c", "other": [1]}': ("a{b}c", None, None, None, 2), '{"industry": 5, "founded_year": "soon"}': (None, None, None, None, 2),
        '{"industry": "x"} and {"industry": "y"}': None, '{"industry": "x"': None, "no braces": None, '{"industry": null}': None, "{}": None, "": None, None: None, '{\n"contact_name":\n"Ann"}': (None, None, "Ann", None, 1),
    }
    df = spark.createDataFrame([(i, a) for i, a in enumerate(cases)], "id int, answer string")
    got = [None if r.t is None else (r.t.industry, r.t.employees, r.t.contact_name, r.t.founded_year, r.t.named) for r in df.select("id", enrich.told(F.col("answer")).alias("t")).orderBy("id").collect()]
    assert got == list(cases.values())


def test_prompts_are_asked_once_and_together(spark, tmp_path):
    """Equal prompts go to the model once, in groups; a group that fails leaves its rows to inference."""
    folder = str(tmp_path)

    def ask(prompts):
        import json
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            json.dump(prompts, f)
        if "fail" in prompts:
            raise OSError("no model")
        return ['{"industry": "' + p.title() + '"}' for p in prompts]

    import json

    rows = texts(spark, *["one", "two"] * 20, *[f"p{i}" for i in range(50)], None, "fail").repartition(3)
    answers = spark.createDataFrame(enrich.asked(rows, "text", ask, together=8).collect(), "prompt string, answer string")
    groups = [json.load(open(p)) for p in tmp_path.iterdir()]
    assert sorted(x for g in groups for x in g) == sorted({"one", "two", "fail", *(f"p{i}" for i in range(50))}) and max(map(len, groups)) <= 8 and len(groups) < 20
    got = enrich.answered(rows, "text", answers, "told")
    found = {r.text: r.industry for r in enrich.waterfall(got, model=lambda text: F.when(text.isNotNull(), F.col("told"))).collect()}
    lost = {x for g in groups if "fail" in g for x in g}
    assert found["one"] == (None if "one" in lost else "One") and all(found[x] is None for x in lost) and found[None] is None
    assert got.count() == rows.count()


def test_pages_become_objects_in_pieces(monkeypatch):
    """A worker has few pages as objects at a time, a long one and nulls among them; none is left out."""
    texts = pa.array(["a" * 30, None, "b" * 90, "c" * 500, "", "d" * 60])
    assert [(p.start, p.stop) for p in extract.pieces(texts, 120)] == [(0, 3), (3, 4), (4, 6)]
    assert list(extract.pieces(pa.array([], pa.string()))) == []


def test_of_a_page_only_what_is_asked_for_leaves_the_worker(spark):
    """The read of a title returns one column; null pages and several batches keep their places."""
    rows = spark.range(25_000, numPartitions=1).selectExpr("if(id % 3 = 0, null, concat('<title>t', id, '</title>', repeat('x', 200))) as html", "id")
    out = rows.select("id", extract.title(F.col("html")).alias("title"))
    assert "body_text" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.filter("not (title <=> if(id % 3 = 0, null, concat('t', id)))").count() == 0


def test_pages_of_leads_are_not_sorted(spark):
    """Pages stream past the leads that are asked for; no sort holds them."""
    leads = spark.sql("select 1L as id, 1L as organization_id, 'w' as website")
    fetches = spark.sql("select 1L as page_id, 'u' as url, '<title>t</title>' as html, 200 as status, cast(null as string) as error")
    plans = spark.sql("select 1L as id, 1L as organization_id, 'pro' as plan_name")
    out = process.process_leads(spark.sql("select 1L as lead_id union all select 2L"), leads, fetches, plans, ("pro",))
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "strategy=shuffle_hash" in plan and sorted((r.lead_id, r.status) for r in out.select("lead_id", "status").collect()) == [(1, "completed"), (2, "error")]
