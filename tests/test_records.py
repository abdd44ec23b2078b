"""Users' records, and what the registered queries don't reach: nulls, ties, empty tables, sinks."""

import random
from datetime import datetime

from postmill.functions import dates, text
from postmill.operators import analytics, filters, records, search
from postmill.sources import files, vendors
from pyspark.sql import functions as F


def test_ranges():
    assert dates.range_to_dates("7d", "2024-01-01") == (None, None, "7d") and dates.range_to_dates("ever", "2024-01-01") == (None, None, None)
    first, last, preset = dates.range_to_dates("custom", "2024-01-10", None)
    assert (first.isoformat(), last, preset) == ("2024-01-10", None, None)


def test_reposts_of_null_keys(spark):
    rows = spark.createDataFrame([("1", None, "lever"), ("2", None, "adzuna"), ("3", "", "lever"), ("4", "x", "jobspy"), ("5", "x", "lever"), ("6", "x", "jobspy")], "job_id string, k string, source string")
    found = {r.job_id: (r.duplicate_count, r.also_on) for r in search.collapse_reposts(rows, [F.col("k")]).collect()}
    assert found == {"1": (1, ["adzuna"]), "3": (0, []), "5": (2, ["jobspy"])}
    assert search.collapse_reposts(rows.limit(0), [F.col("k")]).count() == 0


def test_pages_end(spark):
    rows = spark.range(10).withColumn("job_id", F.col("id"))
    assert [r.id for r in search.page(rows, [F.col("id")], 2, 4).collect()] == [4, 5, 6, 7]
    for number, size in ((0, 10), (1, 201), (51, 200)):
        try:
            search.page(rows, [F.col("id")], number, size)
        except ValueError:
            continue
        raise AssertionError((number, size))


def test_saved_search_without_filters(spark):
    rows = spark.createDataFrame([(datetime(2024, 1, 1),), (datetime(2024, 1, 3),), (None,)], "ingested_at timestamp")
    found = {r.search_id: (r.total, r.new_count) for r in records.saved_counts(rows, {"a": filters.Filters(), "b": filters.Filters()}, {"a": datetime(2024, 1, 2)}, datetime(2024, 2, 1)).collect()}
    assert found == {"a": (3, 1), "b": (3, 3)}


def test_names(spark):
    rows = spark.createDataFrame([("programming_languages",), ("Cloud and DevOps",), ("ai-and_ml",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.label(F.col("t"))).collect()] == ["Programming Languages", "Cloud and DevOps", "AI and ML", "", ""]
    taken = F.array(F.lit("a.pdf"), F.lit("a (2).pdf"), F.lit("b"))
    assert spark.range(1).select(records.free_name(F.lit("a.pdf"), taken), records.free_name(F.lit("b"), taken), records.free_name(F.lit("c"), taken), records.free_name(F.lit("b"), F.array().cast("array<string>"))).first() == ("a (3).pdf", "b (2)", "c", "b")


def test_patches_and_lists_of_nothing(spark):
    rows = spark.createDataFrame([("a", "old"), ("b", None)], "k string, description string")
    found = spark.createDataFrame([("a", "new"), ("b", "x"), ("b", "yy"), ("b", "zz")], "k string, description string")
    assert {r.k: r.description for r in records.patch_longer(rows, found, ["k"]).collect()} == {"a": "old", "b": "yy"}
    assert records.patch_longer(rows, found.limit(0), ["k"]).count() == 2
    blocked = spark.createDataFrame([(" Bad.com ",), ("",)], "host string")
    urls = spark.createDataFrame([("http://bad.com/x",), ("https://BAD.com:80",), ("http://notbad.com",), (None,), ("",)], "url string")
    assert sorted(str(r.url) for r in records.not_blocked(urls, blocked).collect()) == ["", "None", "http://notbad.com"]


def test_sinks(spark, tmp_path):
    boards = spark.createDataFrame([("lever", "b"), ("lever", "a"), ("lever", "b"), ("workable", "c")], "ats string, slug string")
    path = str(tmp_path / "found.yaml")
    files.discovered_yaml(boards, path)
    assert files.read_config(path) == {"sources": {"lever": {"companies": [{"token": "a", "type": "for_profit"}, {"token": "b", "type": "for_profit"}]}, "workable": {"accounts": [{"token": "c", "type": "for_profit"}]}}}
    old, new = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(1, "y"), (2, "z"), (2, "z")], "id int, v string")
    assert [tuple(r) for r in files.missing_rows(new, old, ["id"]).collect()] == [(2, "z")]


def test_atom_and_channel_titles(spark, tmp_path):
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><title>Board</title><entry><title>Data Engineer</title><link href="https://x/1"/><updated>2024-01-02T00:00:00Z</updated><summary>s</summary><author><name>Acme</name></author><id>i</id></entry></feed>')
    (tmp_path / "rss.xml").write_text("<rss><channel><title>Board</title><item><title>Analyst</title><link>https://x/2</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><guid>g</guid></item></channel></rss>")
    atom = vendors.feed(vendors.read_atom(spark, str(tmp_path / "atom.xml"))).first()
    assert (atom.title, atom.company, atom.url, atom.source_job_id, atom.posted_date) == ("Data Engineer", "Acme", "https://x/1", "i", "2024-01-02T00:00:00Z")
    rss = vendors.feed(vendors.read_feed(spark, str(tmp_path / "rss.xml"))).first()
    assert (rss.title, rss.company, rss.url, rss.posted_date) == ("Analyst", "Board", "https://x/2", "2024-01-02 10:00:00")


def test_empty_deployment(spark):
    users, counters = spark.createDataFrame([], "id string"), spark.createDataFrame([("u", "m", "2024-01-01", 2)], "user_id string, metric string, period string, count int")
    assert [tuple(r) for r in records.deployment(users, counters, "2024-01-01").collect()] == [("users", 0)]
    assert analytics.discovery_rank(spark.createDataFrame([], "junior int, relevant int, total int")) is not None


def _profiles(spark, rows):
    empty = {c: F.lit(None).cast("string") for c in ("resume_text", "structured_resume", "resume_sections", "resume_filename", "resume_content_type", "resume_uploaded_at")}
    return spark.createDataFrame(rows, "id long, user_id long, label string").withColumns({**empty, "structured_stale": F.lit(None).cast("boolean")})


def test_labels_of_profiles(spark):
    """Numbers as a plain version gives them, without an array of an owner's labels; profiles without a label are in nobody's way."""
    r = random.Random(3)
    names = ["cv", "cv.pdf", "cv (2)", "cv (2).pdf", "cv (3).pdf", "cv (02)", "cv (1)", "cv (3)", "cv (4)", "a.b (2)", "a.b", "a (2).b", "", " (2)", "x\n", "cv (9999999999)", None]
    stored = [(k, r.choice([1, 2, None]), r.choice(names)) for k in range(90)]
    edits = [(k, -1, r.choice(names)) for k in range(0, 90, 2)]
    forms = [F.struct(F.lit(n).alias("name"), F.array(*[text.numbered_names(F.lit(n), F.lit(k)) for k in range(1, 40)]).alias("forms")) for n in names if n is not None]
    tries = {x.name: x.forms for x in spark.range(1).select(F.array(*forms)).first()[0]}
    wanted = {k: label for k, _, label in stored}
    for k, _, label in edits:
        owner = stored[k][1]
        taken = {other for j, o, other in stored if o == owner and j != k}
        if label is not None and label != stored[k][2]:
            wanted[k] = next(x for x in tries[label] if x not in taken)
    plain = lambda c: c
    out = records.update_profiles(_profiles(spark, stored), _profiles(spark, edits), plain, plain, plain)
    assert {x.id: x.label for x in out.collect()} == wanted and out.count() == 90 and sum(wanted[k] != stored[k][2] for k in wanted) > 20
    assert "collect_list" not in out._jdf.queryExecution().toString()
