import json
from datetime import datetime

from pyspark.sql import functions as F

from postmill.sources import files, vendors
from postmill.streaming import ingest

AS_OF = datetime(2024, 1, 31)
PAYLOADS = {
    "greenhouse": {"jobs": [{"id": 1, "title": "Data Engineer", "absolute_url": "https://x/1", "location": {"name": "Austin, TX"}, "content": "&lt;p&gt;Hi &amp;amp; bye&lt;/p&gt;", "updated_at": "2024-01-20T00:00:00Z"}]},
    "lever": [{"id": "a", "text": "Data Engineer", "hostedUrl": "https://x/2", "createdAt": 1704067200000, "descriptionPlain": "Intro", "lists": [{"text": "Must", "content": "<li>SQL</li>"}], "additionalPlain": "End", "categories": {"location": "Remote US"}}],
    "ashby": {"jobs": [{"id": "z", "title": "Data Engineer", "jobUrl": "https://x/3", "isListed": True, "publishedAt": "2024-01-02", "location": "NYC", "descriptionPlain": "d", "isRemote": True}, {"title": "Hidden", "jobUrl": "https://x/4", "isListed": False}]},
    "workday": {"total": 1, "jobPostings": [{"title": "Data Engineer", "externalPath": "/job/Hanoi-Vietnam/Data_1", "locationsText": "2 Locations", "postedOn": "Posted 3 Days Ago", "bulletFields": ["R1"]}]},
    "workable": {"name": "Acme", "jobs": [{"title": "Data Engineer", "url": "https://x/5", "shortcode": "S", "published_on": "2024-01-02", "city": "X", "locations": [{"city": "Boston", "region": "MA", "country": "United States", "countryCode": "US"}]}]},
    "rippling": [{"uuid": "u", "name": "Data Engineer", "url": "https://x/6", "workLocation": {"label": "Austin"}}],
    "recruitee": {"offers": [{"id": 3, "title": "Data Engineer", "created_at": "2024-01-02 10:00:00 UTC", "careers_url": "https://x/7", "description": "a", "requirements": "b", "city": "Paris", "country": "France"}]},
    "smartrecruiters": {"content": [{"id": "9", "name": "Data Engineer", "releasedDate": "2024-01-02T00:00:00Z", "company": {"name": "Co"}, "location": {"city": "Pune", "country": "in", "remote": False}}]},
    "usajobs": {"SearchResult": {"SearchResultItems": [{"MatchedObjectId": "1", "MatchedObjectDescriptor": {"PositionID": "P", "PositionTitle": "Data Engineer", "ApplyURI": ["https://x/8"], "OrganizationName": "NASA", "QualificationSummary": "q", "PositionRemuneration": [{"MinimumRange": "0", "MaximumRange": "9.5"}]}}, {"MatchedObjectDescriptor": {"PositionID": "Q", "PositionTitle": "x", "PositionURI": "u", "QualificationSummary": "US citizens only: U.S. Citizenship"}}]}},
    "simplify": [{"id": "s", "company_name": "Co", "title": "Data Engineer", "locations": ["NYC", "SF"], "url": "https://x/9", "active": True, "date_posted": 1704067200}, {"title": "Old", "url": "u", "active": False}],
    "adzuna": {"results": [{"id": "1", "title": "Data Engineer", "redirect_url": "https://x/10", "company": {"display_name": "Co"}, "location": {"display_name": "L", "area": ["UK", "London"]}, "salary_min": 0.0, "salary_max": 5.0, "created": "2024-01-02"}]},
    "remotive": {"jobs": [{"id": 4, "url": "https://x/11", "title": "Data Engineer", "company_name": "Co", "publication_date": "2024-01-02", "candidate_required_location": "USA", "description": "d", "salary": "$50k - $70,000"}]},
    "arbeitnow": {"data": [{"slug": "s", "title": "Data Engineer", "company_name": "Co", "url": "https://x/12", "created_at": 1704067200, "remote": True}]},
    "jobicy": {"jobs": [{"id": 5, "url": "https://x/13", "jobTitle": "Data Engineer", "companyName": "Co", "jobGeo": "USA", "jobExcerpt": "e"}]},
    "remoteok": [{"legal": "notice"}, {"id": "7", "position": "Data Engineer", "company": "Co", "url": "https://x/14", "date": "2024-01-02"}],
    "workingnomads": [{"url": "https://x/jobs/abc/", "title": "Data Engineer", "company_name": "Co", "pub_date": "2024-01-02"}],
    "themuse": {"page_count": 1, "results": [{"id": 6, "name": "Data Engineer", "company": {"name": "Co"}, "locations": [{"name": "Flexible / Remote"}], "contents": "c", "refs": {"landing_page": "https://x/15"}}]},
    "himalayas": {"jobs": [{"title": "Data Engineer", "applicationLink": "https://x/16", "companyName": "Co", "pubDate": 1704067200, "minSalary": 1.0, "guid": "g"}]},
    "jobrightai": {"jobList": [{"jobResult": {"jobId": "j", "jobTitle": "Data Engineer", "url": "https://x/17", "workModel": "Hybrid", "salaryDesc": "$50/hr"}, "companyResult": {"companyName": "Co"}}]},
    "jobspy": [{"job_url": "https://x/18", "title": "Data Engineer", "description": "d" * 400}],
}


def payloads(spark, vendor, payload=None):
    return spark.createDataFrame([("board", "Acme", None, "gb" if vendor == "adzuna" else None, json.dumps(PAYLOADS[vendor] if payload is None else payload))], "board string, name string, employer_type string, country string, payload string")


def test_every_vendor(spark):
    assert set(PAYLOADS) == set(vendors.VENDORS)
    rows = {}
    for vendor in PAYLOADS:
        found = vendors.parse(vendor, payloads(spark, vendor), keywords=["data engineer"]).collect()
        assert len(found) == 1, vendor
        assert found[0].title == "Data Engineer" and found[0].url, vendor
        rows[vendor] = found[0]
    assert rows["greenhouse"].description == "<p>Hi &amp; bye</p>" and rows["greenhouse"]._board_slug == "board"
    assert rows["lever"].description == "Intro\n\nMust\nSQL\n\nEnd" and rows["lever"].remote == "remote"
    assert rows["workday"].location == "Hanoi Vietnam" and rows["workable"].location == "Boston, MA, United States"
    assert rows["recruitee"].location == "Paris, France" and rows["smartrecruiters"].country == "in"
    assert rows["usajobs"].salary_min is None and rows["usajobs"].salary_max == 9.5 and rows["simplify"].new_grad_program
    assert rows["adzuna"].city == "London" and rows["adzuna"].salary_currency == "GBP"
    assert (rows["remotive"].salary_min, rows["remotive"].salary_max, rows["remotive"].salary_currency) == (50000.0, 70000.0, "USD")
    assert rows["jobrightai"].salary_min == 104000.0 and rows["jobrightai"].remote == "hybrid" and len(rows["jobspy"].description) == 280
    assert rows["workingnomads"].source_job_id == "abc" and rows["themuse"].remote == "remote"


def test_details_since_and_broken(spark):
    detail = spark.createDataFrame([("board", "/job/Hanoi-Vietnam/Data_1", json.dumps({"jobPostingInfo": {"jobDescription": "x &amp; y", "location": "Austin", "additionalLocations": ["Hanoi"], "country": {"descriptor": "United States"}}}))], "board string, id string, detail string")
    r = vendors.parse("workday", payloads(spark, "workday"), detail).first()
    assert (r.location, r.country, r.description) == ("Austin; Hanoi", "United States", "x & y")
    assert vendors.parse("ashby", payloads(spark, "ashby"), since=datetime(2024, 1, 10)).count() == 0
    broken = payloads(spark, "lever").withColumn("payload", F.lit("{not json"))
    assert vendors.parse("lever", broken).count() == 0


def test_canonical_and_stream(spark, tmp_path):
    one = vendors.canonical(vendors.parse("greenhouse", payloads(spark, "greenhouse")), AS_OF).first()
    assert (one.category, one.employment_type, one.company, one.city, one.posted_date_est) == ("data_ml_ai", "full_time", "Acme", "Austin", False)
    payloads(spark, "greenhouse").union(payloads(spark, "greenhouse")).write.json(str(tmp_path / "in"))
    tables = {}
    empty = vendors.canonical(vendors.parse("greenhouse", payloads(spark, "greenhouse").limit(0)), AS_OF)

    def write(df, number):
        tables[number] = [r.job_id for r in df.collect()]

    ingest.ingest(ingest.landed(spark, str(tmp_path / "in")), "greenhouse", lambda: empty, write, str(tmp_path / "check"), AS_OF).awaitTermination()
    assert list(tables.values()) == [[one.job_id]]


def test_files(spark, tmp_path):
    (tmp_path / "names.txt").write_text("# list\nAcme, Inc.\n\nACME\nBeta LLC\n")
    assert {r.name for r in files.name_list(spark, str(tmp_path / "names.txt")).collect()} == {"acme", "beta"}
    assert files.name_list(spark, str(tmp_path / "none.txt")).count() == 0
    table = spark.createDataFrame([("| Date | Company | Role | Link | Notes |\n|---|---|---|---|---|\n| 1 | Acme | DE | [x](https://a/b) | |",)], "body string")
    r = files.markdown_table(table, "body").collect()
    assert len(r) == 1 and r[0].url == "https://a/b" and r[0].cells[1] == "Acme"
    rows = vendors.canonical(vendors.parse("greenhouse", payloads(spark, "greenhouse")), AS_OF).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>"))
    files.export_backup(rows, str(tmp_path / "b"), "local", "m")
    assert files.import_backup(spark, str(tmp_path / "b"), 2).first().embedding == [1.0, 2.0]
    try:
        files.import_backup(spark, str(tmp_path / "b"), 4)
        raise AssertionError("a back-up of other vectors was taken")
    except ValueError:
        pass
    broken = spark.createDataFrame([("cafÃ© &eacute;",)], "s string").select(files.fix_mojibake("s").alias("a"), files.decode_entities("s").alias("b")).first()
    assert broken.a == "café &eacute;" and broken.b == "cafÃ© é"
    parts = files.resume_sections(spark.createDataFrame([("Jo\nExperience:\nA\nB\n# Skills\nSQL",)], "t string"), "t").first().sections
    assert [(p.heading, p.content) for p in parts] == [("Additional information", "Jo"), ("Experience", "A\nB"), ("Skills", "SQL")]


def test_enrichment(spark):
    rows = vendors.canonical(vendors.parse("greenhouse", payloads(spark, "greenhouse")), AS_OF)
    job = rows.first().job_id
    answer = '```json\n{"yoe_min": "3.0", "yoe_max": true, "seniority": "wizard", "skills": ["SQL", "sql", " Go "], "employer_type": "university"}\n```'
    r = vendors.enriched(rows, spark.createDataFrame([(job, answer)], "job_id string, answer string")).first()
    assert (r.yoe_min, r.yoe_max, r.seniority, r.skills, r.cap_exempt, r.enrichment_status) == (3, None, "unclear", ["sql", "go"], "likely", "done")
    m = vendors.deep_match(spark.createDataFrame([("1", "p", '{"verdict":"MAYBE","score":"999","strengths":["a","b","c","d"]}')], "job_id string, profile_id string, answer string")).first()
    assert (m.verdict, m.score, len(m.strengths)) == ("borderline", 100, 3)
