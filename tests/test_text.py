from datetime import datetime

import pytest
from pyspark.sql import functions as F

from postmill.functions import dates, text
from postmill.operators import eligibility, provenance, verdict

AS_OF = datetime(2024, 1, 31)


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], f"_k int, {schema}").orderBy("_k").select(*columns).collect()]


def test_normal_forms(spark):
    rows = [("Acme Corp LLC", "Data Engineer (Remote)", "NYC"), ("ACME, Inc.", "Data Engineer [Hybrid] - remote", "nyc"), (None, None, None), ("  Incense   Co. ", "On-site Nurse", "")]
    found = values(spark, rows, "c string, t string, p string", text.normalize_text(F.col("c")), text.normalize_title(F.col("t")), text.posting_id(F.col("c"), F.col("t"), F.col("p")))
    assert [f[:2] for f in found] == [("acme", "data engineer"), ("acme", "data engineer"), ("", ""), ("incense", "nurse")]
    assert found[0][2] == found[1][2] != found[2][2] and len(found[0][2]) == 16


def test_classes(spark):
    rows = [("Senior Contractor", ""), ("Internal Auditor", ""), ("Data Scientist", "this is a contract role"), ("Feedback Clerk", None), (None, None)]
    found = values(spark, rows, "t string, d string", text.category(F.col("t")), text.employment_type(F.col("t"), F.col("d")))
    assert found == [("management", "contract"), ("other", "internship"), ("data_ml_ai", "contract"), ("devops_infra", "full_time"), ("other", "full_time")]


@pytest.mark.parametrize(
    "row, wanted",
    [
        (("us", "Austin, TX", "onsite", "x"), True), (("us", "Hanoi, Vietnam", "onsite", "x"), False), (("us", None, "unknown", "Engineer - Busan, South Korea"), False), (("in", "Pune", "onsite", ""), False),
        (("de", "Berlin; Austin, TX", "onsite", ""), True), ((None, "Bangalore, Karnataka, in", "onsite", ""), False), ((None, "Remote", "remote", ""), True), ((None, "Remote - Brazil", "remote", ""), False),
        ((None, "Santa Fe, New Mexico", "onsite", ""), True), ((None, "London", "onsite", ""), False), ((None, "Chicago", "hybrid", ""), True), ((None, None, "unknown", None), False), ((None, "Remote, US only", "remote", ""), True),
    ],
)
def test_us(spark, row, wanted):
    assert values(spark, [row], "c string, l string, m string, t string", text.is_us(*[F.col(x) for x in "clmt"])) == [(wanted,)]


def test_dates(spark):
    rows = [("2024-01-05",), ("Posted 3 days ago",), ("yesterday",), ("an hour ago",), ("soon",), (None,), ("2024-01-05T10:00:00+02:00",)]
    found = values(spark, rows, "r string", dates.parse_posted(F.col("r"), AS_OF)["ts"].cast("string"), dates.parse_posted(F.col("r"), AS_OF)["estimated"])
    assert found == [("2024-01-05 00:00:00", False), ("2024-01-28 00:00:00", True), ("2024-01-30 00:00:00", True), ("2024-01-30 23:00:00", True), (None, False), (None, False), ("2024-01-05 08:00:00", False)]


def test_sponsorship(spark):
    rows = [("yes", "no", False, False, "likely"), ("no", "yes", False, True, "no"), ("not_mentioned", "likely", False, False, "likely"), ("unclear", "no", True, True, "no"), (None, None, None, None, "unknown"), ("unclear", "unknown", False, True, "likely")]
    found = values(spark, rows, "v string, e string, c boolean, h boolean, w string", provenance.sponsorship(*[F.col(x) for x in "vech"]), "w")
    assert all(a == b for a, b in found)


def test_evidence(spark):
    rows = [("We cannot offer visa sponsorship. Great team!",), ("Must be a U.S. citizen. Active security clearance required.",), ("Will you need sponsorship?",), (None,), ("<p>Sponsorship is <b>not</b> available</p>",)]
    found = values(spark, rows, "d string", eligibility.evidence(F.col("d")).alias("e"))
    assert [(r[0].visa_sponsorship, r[0].citizenship_required, r[0].security_clearance) for r in found] == [("no", False, None), (None, True, "required"), (None, False, None), (None, False, None), ("no", False, None)]
    assert found[0][0].evidence == ["We cannot offer visa sponsorship."]


def test_years(spark):
    rows = [("7+ years of experience required",), ("Over 40 years of experience in business",), ("MS + 3 years or BS + 5 years",), ("Requirements: 4 years of Python experience",), ("5-7 years experience",), (None,), ("Minimum of 2 years of relevant experience",)]
    assert [r[0] for r in values(spark, rows, "d string", verdict.stated_years(F.col("d"), None))] == [7, None, 3, 4, 5, None, 2]


def test_skills_and_names(spark):
    rows = [("K8s",), ("  C++ ",), ("LLMs",), ("Classes",), ("models",), (None,)]
    assert [r[0] for r in values(spark, rows, "s string", text.canonical_skill(F.col("s")))] == ["kubernetes", "cpp", "large language models", "classes", "models", ""]
    assert values(spark, [("cv.pdf",)], "s string", text.numbered_names(F.col("s"), F.lit(2))) == [("cv (2).pdf",)]
