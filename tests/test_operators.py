from datetime import datetime

from pyspark.sql import functions as F

from postmill.operators import analytics, filters, search, skills, state, textmetrics, verdict
from postmill.schemas import as_postings

AS_OF = datetime(2024, 1, 31)


def postings(spark, **changes):
    row = {"job_id": "1", "source": "greenhouse", "title": "Data Engineer", "company": "Acme", "location_raw": "Austin, TX", "country": "us", "remote_mode": "onsite", "description": "We use Python and SQL.", "skills": ["Python", "SQL", "Airflow"], "yoe_min": 2, "visa_sponsorship": "yes", "seniority": "mid", "enrichment_status": "done"} | changes
    schema = "job_id string, source string, title string, company string, location_raw string, country string, remote_mode string, description string, skills array<string>, yoe_min int, visa_sponsorship string, seniority string, enrichment_status string"
    return as_postings(spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema))


PROFILE = verdict.Profile(target_titles=["Data Engineer"], skills=["python", "sql", "airflow"], seniority_max="mid", yoe_max=3)


def judge(spark, profile=PROFILE, **changes):
    return verdict.with_verdict(postings(spark, **changes), profile).first()


def test_apply_and_rejects(spark):
    good = judge(spark)
    assert (good.verdict, good.recommendable, good.matched, good.gaps) == ("apply", True, ["Python", "SQL", "Airflow"], [])
    assert good.score == 0.969
    assert "Job title is outside the profile's target roles" in judge(spark, title="Pastry Chef").red_flags
    assert "Outside target countries (Hanoi, Vietnam)" in judge(spark, location_raw="Hanoi, Vietnam").red_flags
    assert judge(spark, yoe_min=6).red_flags == ["Requires 6+ years of experience", "Requires 6+ years for a non-entry-level role"]
    assert "Internship-only role" in judge(spark, title="Data Engineer Intern", seniority="unclear").red_flags
    assert "Director role is above the mid target" in judge(spark, title="Director, Data Engineer").red_flags
    assert "Requires a security clearance" in judge(spark, description="Active security clearance required.").red_flags
    assert judge(spark, skills=["COBOL", "RPG", "JCL"]).red_flags == ["No verified overlap with the job's technical skills"]


def test_flags(spark):
    needs = verdict.Profile(target_titles=["Data Engineer"], skills=["python", "sql", "airflow"], seniority_max="mid", needs_sponsorship=True)
    quiet = judge(spark, needs, visa_sponsorship="not_mentioned")
    assert (quiet.verdict, quiet.recommendable) == ("flag", True) and quiet.red_flags == ["Sponsorship not stated - verify before applying"]
    assert judge(spark, needs, visa_sponsorship="no").verdict == "reject"
    above = judge(spark, title="Senior Data Engineer")
    assert above.red_flags[0] == "Seniority above target (senior vs mid)" and not above.recommendable


def test_skill_matching(spark):
    rows = spark.createDataFrame([("1", ["Django", "golang", "Machine Learning", "pythn", "Data Science Engineer", "R", "go", ""])], "job_id string, skills array<string>")
    r = skills.overlap(rows, ["go", "pytorch", "python", "data science"]).first()
    assert r.matched == ["golang", "Machine Learning", "pythn", "Data Science Engineer"] and r.gaps == ["Django", "R"]


def test_filters_are_subsets_and_nulls(spark):
    rows = spark.createDataFrame([(1, None, None), (2, True, 3), (3, False, 12)], "job_id long, is_active boolean, yoe_min int").withColumn("seniority", F.lit("mid"))
    assert [r.job_id for r in filters.apply(rows, filters.Filters(include_active=True), AS_OF).orderBy("job_id").collect()] == [1, 2]
    assert [r.job_id for r in filters.apply(rows, filters.Filters(experience=["mid"]), AS_OF).orderBy("job_id").collect()] == [1, 2]
    assert filters.build(filters.Filters(), AS_OF) is None


def test_facets_sum_to_total(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "s string, t string")
    found = search.facets(rows, ["s", "t"]).groupBy("facet").agg(F.sum("n").alias("n")).collect()
    assert {r.facet: r.n for r in found} == {"s": 3, "t": 3}


def test_reposts(spark):
    rows = spark.createDataFrame([("1", "jobspy", "k"), ("2", "lever", "k"), ("3", "adzuna", "k"), ("4", "lever", "k"), ("5", None, "z")], "job_id string, source string, key string")
    out = {r.job_id: r for r in search.collapse_reposts(rows, [F.col("key")]).collect()}
    assert set(out) == {"2", "5"} and out["2"].duplicate_count == 3 and out["2"].also_on == ["adzuna", "jobspy", "lever"] and out["5"].duplicate_count == 0
    again = search.collapse_reposts(spark.createDataFrame([(r.job_id, r.source, r.key) for r in out.values()], rows.schema), [F.col("key")])
    assert again.count() == 2


def test_ladder_is_monotone(spark):
    rows = spark.createDataFrame([(float(h),) for h in (1, 5, 8, 13, 20)], "age double")
    found = [search.ladder(rows, F.col("age"), [6, 12, 24], n).first() for n in (1, 3, 5, 9)]
    assert [(r.rung, r.total) for r in found] == [(6, 2), (12, 3), (24, 5), (24, 5)]


def test_merges_are_idempotent(spark):
    base, delta = spark.createDataFrame([(1, "a", "n1"), (2, "b", None)], "k int, v string, note string"), spark.createDataFrame([(2, "c", None), (3, "d", "n3")], "k int, v string, note string")
    once = state.merge_replace(base, delta, ["k"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, state.merge_replace(once, delta, ["k"]).collect())) == [(1, "a", "n1"), (2, "c", None), (3, "d", "n3")]
    kept = state.merge_coalesce(base, spark.createDataFrame([(1, "z", None)], base.schema), ["k"], ["note"])
    assert ("z", "n1") in [(r.v, r.note) for r in kept.collect()]
    assert state.insert_missing(base, delta, ["k"]).where("k = 2").first().v == "b"


def test_snapshot(spark):
    t = datetime(2024, 1, 1)
    presence = spark.createDataFrame([("g", "a", "1", t, t, None), ("g", "a", "2", t, t, None), ("g", "b", "3", t, t, None), ("g", "a", "4", t, t, t)], "ats string, board_slug string, job_id string, first_seen timestamp, last_seen timestamp, closed_at timestamp")
    seen, whole = spark.createDataFrame([("g", "a", "1"), ("g", "a", "4"), ("g", "a", "5")], "ats string, board_slug string, job_id string"), spark.createDataFrame([("g", "a")], "ats string, board_slug string")
    now = state.snapshot(presence, seen, whole, AS_OF)
    assert {r.job_id: r.closed_at for r in now.collect()} == {"1": None, "2": AS_OF, "3": None, "4": None, "5": None}


def test_funnel_of_nothing(spark):
    r = analytics.funnel(spark.createDataFrame([("strange",)], "status string")).first()
    assert r.total_applications == 0 and r.response_rate == 0.0


def test_metrics(spark):
    plain = "I fixed the pump. Then, at noon, my old neighbour came over with two enormous pumpkins and a very long story! We laughed."
    stiff = "We leverage robust synergy to empower scalable teams. We leverage robust synergy to empower scalable teams. We leverage robust synergy to empower scalable teams."
    rows = textmetrics.families(spark.createDataFrame([(1, plain), (2, stiff), (3, None)], "k int, t string"), "t").orderBy("k").collect()
    assert rows[0].composite.ai_risk_score < rows[1].composite.ai_risk_score and rows[1].buzzword.buzzword_count == 15
    assert rows[1].repetition.sent_4gram_overlap == 1.0 and rows[2].readability.word_count == 0 and rows[0].structure.sentence_count == 2
    assert rows[1].lexical.type_count == 8 and rows[1].lexical.hapax_rate == 0.0 and rows[0].readability.flesch_kincaid_grade is None


def test_eligibility_reads_whole_texts(spark, tmp_path):
    from postmill.plans.judgement import eligibility_scan

    said = "You must be a U.S. citizen. Active security clearance required."
    spark.createDataFrame([(4, "word " * 5000 + ". " + said), (8, said)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.doc_id: r for r in eligibility_scan(spark, str(tmp_path)).collect()}
    assert found[8].security_clearance == "required" and tuple(found[4])[1:4] == tuple(found[8])[1:4]


def test_similarity_of_nothing(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0])], "k int, v array<float>")
    assert [r[0] for r in rows.orderBy("k").select(search.similarity(F.col("v"), [2.0, 0.0])).collect()] == [1.0, 0.0, 0.5, 0.5]


def test_only_the_metrics_asked_for_are_computed_over_many_tasks(spark):
    rows = spark.createDataFrame([(k, "The team built reliable tools. They shipped the work on time! " * (k % 3 + 1)) for k in range(40)], "k int, t string").coalesce(1)
    fields = ["lexical.ttr", "repetition.distinct_2", "structure.sent_len_cv"]
    some, every = (textmetrics.families(rows, "t", wanted).select("k", *fields, "composite.ai_risk_score") for wanted in ([*fields, "composite"], None))
    assert sorted(some.collect()) == sorted(every.collect())
    few = textmetrics.families(rows, "t", fields[:1])
    assert "LOG2" not in few._jdf.queryExecution().optimizedPlan().toString() and few.rdd.getNumPartitions() > 1
