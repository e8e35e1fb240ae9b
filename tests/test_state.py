"""Streams that keep state, a source that is started again, and tables that are changed in place."""

import datetime
import json
import os
import time

import pytest
from pyspark.sql import functions as F

import web_fixture
from siftwell.operators import leads, quota
from siftwell.sources import requests, tables
from siftwell.sources.derived import view
from siftwell.streaming import leads as streams

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def asked(folder, name, *rows):
    with open(f"{folder}/.{name}", "w") as f:
        f.write("\n".join(json.dumps({"page_id": i, "url": u}) for i, u in rows) + "\n")
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def test_requested_pages_are_fetched_once(spark, tmp_path):
    """The query is started again between batches and within one; files whose names come before others that are done count too."""
    spark.sparkContext.addPyFile(web_fixture.__file__)
    requests.register(spark)
    folder, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    folder.mkdir()

    def run():
        pages = spark.readStream.format("requested_pages").option("path", str(folder)).option("fetch", "web_fixture:fetch").load()
        query = pages.writeStream.format("parquet").option("checkpointLocation", str(state)).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        return [r.page_id for r in spark.read.schema(pages.schema).parquet(str(out)).orderBy("page_id").collect()]

    asked(folder, "m", (1, "https://a.example"), (2, "https://bad.example"))
    asked(folder, "n", (3, "https://c.example"))
    assert run() == [1, 2, 3]
    assert run() == [1, 2, 3]  # started again: nothing new
    asked(folder, "a", (4, "https://d.example"))
    with open(folder / "b", "w") as f:
        f.write("no request\n")
    got = run()
    assert sorted(x for x in got if x is not None) == [1, 2, 3, 4] and len(got) == 5
    rows = {r.page_id: (r.html, r.error) for r in spark.read.parquet(str(out)).collect()}
    assert rows[1] == ("<title>https://a.example</title>", None) and rows[2] == (None, "refused") and rows[None][1].startswith("malformed request")


def test_requested_pages_are_processed(spark, tmp_path):
    """From a table of requests over the stream to leads and logs."""
    spark.sparkContext.addPyFile(web_fixture.__file__)
    requests.register(spark)
    folder = str(tmp_path / "in")
    requests.ask(spark.createDataFrame([(i, f"https://p{i}.example/") for i in range(6)] + [(9, "https://bad.example")], "page_id long, url string").repartition(3), folder)
    pages = spark.readStream.format("requested_pages").option("path", folder).option("fetch", "web_fixture:fetch").load()
    streams.process_stream(pages, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = {r.lead_id: r for r in spark.read.option("recursiveFileLookup", "true").parquet(*(f"{f}/leads" for f in (tmp_path / "out").iterdir())).collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 5, 9} and not rows[9].scraping_success and rows[9].error_message == "no answer"
    assert rows[3].company_name == "https://p3.example/"


def test_a_reader_plans_what_is_not_committed_again(tmp_path):
    """As Spark calls it: offsets of a batch that was lost give the same files, also by another reader; after a commit they are gone."""
    options = {"path": str(tmp_path), "fetch": "web_fixture:fetch", "slices": "1"}
    names = lambda r, a, b: sorted(n for p in r.partitions(a, b) for n in p.names)
    first = requests.Reader(options)
    start = first.initialOffset()
    asked(tmp_path, "x", (1, "u"))
    one = first.latestOffset()
    asked(tmp_path, "b", (2, "u"))
    assert names(first, start, one) == ["x"] and first.latestOffset() != one
    again = requests.Reader(options)
    two = again.latestOffset()
    assert names(again, start, one) == ["x"] and names(again, one, two) == ["b"] and again.latestOffset() == two
    again.commit(one)
    third = requests.Reader(options)
    assert names(third, one, two) == ["b"] and third.latestOffset() == two
    third.commit(two)
    assert requests.Reader(options).latestOffset() == two and sorted(os.listdir(tmp_path / "_done")) == ["b", "x"]


def test_retries_come_of_themselves(spark, tmp_path):
    schema = "id long, lead_id long, success boolean, created_at timestamp"
    at = datetime.datetime(2024, 1, 1)

    def put(name, *rows):
        spark.createDataFrame([(i, lead, ok, at) for i, lead, ok in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    put("a", (1, 7, False), (2, 8, True), (3, 9, False))
    source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = streams.timed_retries(source, delay=3, most=2).writeStream.format("memory").queryName("timed").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="300 milliseconds").start()
    try:
        rows = lambda: [(r.lead_id, r.id, r.failures, r.action) for r in spark.table("timed").collect()]

        def wait(row, seconds=90):
            until = time.time() + seconds
            while row not in rows():
                assert time.time() < until and query.exception() is None, (row, rows())
                time.sleep(0.2)

        wait((7, 1, 1, "waiting"))
        put("b", (4, 9, True))  # lead 9 is heard of; whether before or after its timer, its state is gone
        wait((7, 1, 1, "retry"))
        wait((9, 4, 0, "done"))
        begun = spark.table("timed").filter("lead_id = 7 and action = 'waiting'").first().at
        assert (spark.table("timed").filter("lead_id = 7 and action = 'retry'").first().at - begun).total_seconds() == 3
        put("c", (5, 7, False), (6, 9, False))
        wait((7, 5, 2, "retry"))
        wait((9, 6, 1, "waiting"))  # counted from the beginning again
        put("d", (7, 7, False))
        wait((7, 7, 3, "failed"))
        time.sleep(4)
        assert (7, 7, 3, "retry") not in rows() and (8, 2, 0, "done") in rows() and len([r for r in rows() if r[0] == 8]) == 1
    finally:
        query.stop()
    left = spark.read.format("statestore").option("stateVarName", "failures").load(f"{tmp_path}/state")
    assert 7 not in {r.key.lead_id for r in left.select("key").collect()}


@pytest.mark.parametrize("splits", [1, 3])
def test_admission_on_a_stream_equals_the_batch(spark, tmp_path, splits):
    usage = spark.createDataFrame([(o, 10 * (o + 1), o, 9 * o + 10) for o in range(4)], "organization_id long, max_leads_per_day long, current_usage long, remaining_daily_leads long")
    at = datetime.datetime(2024, 1, 1, 9)
    rows = [(i, i % 6, (i * 7) % 5 if i % 9 else 0, at + datetime.timedelta(minutes=i)) for i in range(90)]
    batches = spark.createDataFrame(rows, "batch_id long, organization_id long, n long, at timestamp")
    for k in range(splits):
        batches.filter(F.floor(F.col("batch_id") * splits / 90) == k).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        time.sleep(0.05)
    end = spark.createDataFrame([(1000, 0, 1, at + datetime.timedelta(days=3)), (1001, 0, 1, at + datetime.timedelta(days=6))], batches.schema)
    for k in range(2):  # later days, each with the limit for itself
        end.filter(f"batch_id = {1000 + k}").coalesce(1).write.parquet(f"{tmp_path}/in/z{k}")
        time.sleep(0.05)
    source = spark.readStream.schema(batches.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    name = f"admitted{splits}"
    query = streams.admission_stream(source, usage).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {r.batch_id: (r.organization_id, r.n, r.status) for r in spark.table(name).collect()}
    want = {r.batch_id: (r.organization_id, r.n, r.status) for r in quota.admit(batches, usage).collect()}
    assert {k: v for k, v in got.items() if k < 1000} == want and {v[2] for v in want.values()} == {"accepted", "too many", "limit reached", "empty"}
    assert got[1000][2] == got[1001][2] == "accepted"
    days = {r.key.day for r in spark.read.format("statestore").option("stateVarName", "asked").load(f"{tmp_path}/state").select("key").collect()}
    assert datetime.date(2024, 1, 1) not in days and datetime.date(2024, 1, 7) in days


def test_appends_keep_a_column_unique_and_can_be_repeated(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"https://{i}.example", True) for i in range(50)], "id long, website string, is_active boolean")
    table = tables.Table(spark, str(tmp_path / "leads"), shares=8)
    table.create(rows)
    new = spark.createDataFrame([(100, "https://3.example", True), (101, "https://new.example", True), (102, "https://new.example", True)], rows.schema)
    for _ in range(2):  # the batch is run again
        taken = {(r.id, r.reason) for r in table.append(new, 1, "website").collect()}
        assert taken == {(100, "taken"), (102, "taken")}
        assert sorted(r.id for r in table.read().collect()) == [*range(50), 101]
    assert {r.reason for r in table.append(new, 2, "website").collect()} == {"taken"} and table.read().count() == 51

    def failing(x):
        raise OSError("task lost") if x == 205 else None

    broken = spark.range(200, 210).select("id", F.udf(lambda i: failing(i) or f"https://{i}.example")("id").alias("website"), F.lit(True).alias("is_active"))
    with pytest.raises(Exception, match="task lost"):
        table.append(broken, 3, "website")
    assert table.read().count() == 51 and leads.new_leads(rows).count() == 50


def test_updates_leave_other_files_alone(spark, tmp_path):
    rows = view(spark, SF, "leads").select("id", "organization_id", "industry", "is_active")
    table = tables.Table(spark, str(tmp_path / "leads"), shares=16)
    table.create(rows)
    files = lambda: {r[0] for r in spark.read.parquet(table.path).select(F.input_file_name()).distinct().collect()}
    before, total = files(), rows.count()
    some = [r.id for r in rows.orderBy("id").limit(2).collect()]
    changes = spark.createDataFrame([(some[0], None, True), (some[1], "Travel", True), (-5, "none", True)], "id long, industry string, set_industry boolean")
    touched = table.update(changes, ["industry"])
    assert touched <= 3 and len(before - files()) <= touched and len(before & files()) >= 13
    got = {r.id: r.industry for r in table.read().collect()}
    assert got[some[0]] is None and got[some[1]] == "Travel" and len(got) == total and -5 not in got
    table.soft_delete(spark.createDataFrame([(some[1],), (some[1],)], "id long"))
    assert [r.is_active for r in table.read().filter(f"id = {some[1]}").collect()] == [False] and table.read().count() == total
    assert table.update(changes.limit(0), ["industry"]) == 0


def test_sums_are_kept_up_through_replays(spark, tmp_path):
    records = view(spark, SF, "usage_records").select("organization_id", F.to_date("recorded_at").alias("day"), "quantity", "id")
    sums = tables.Sums(spark, str(tmp_path / "usage"), ["organization_id", "day"])
    sums.create(records)
    part = lambda k: records.filter(f"id % 4 = {k - 1}")
    assert sums.current().count() == 0
    for batch in (1, 2, 2):
        sums.add(part(batch), batch)
    assert sums.compact() == 2 and sums.compact() == 2
    for batch in (1, 2, 3, 3):  # what the base has is passed over
        sums.add(part(batch), batch)
    sums.add(records.limit(0), 4)
    sums.add(part(4), 5)
    want = {(r[0], r[1]): r[2] for r in sums.summed(records).collect()}
    assert {(r[0], r[1]): r[2] for r in sums.current().collect()} == want
    assert sums.compact() == 5 and {(r[0], r[1]): r[2] for r in sums.current().collect()} == want
