"""Kept verdicts against scoring everything, with counts of what was scored."""

from dataclasses import asdict

import pytest
from postmill.operators import verdict
from postmill.operators.verdict_store import VerdictStore
from postmill.plans.queries import OTHER, PROFILE, postings
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _score(calls):
    """Pairs whose numbers have a common last digit fit; notes how many postings were asked for."""

    def score(rows, who):
        calls.append(rows.count() * who.count())
        pairs = rows.join(who, F.col("job_id") % 10 == F.col("kind") % 10)
        return pairs.select("job_id", F.col("id").alias("profile_id"), F.concat_ws("/", "title", "kind").alias("verdict"))

    return score


def _rows(frame):
    return sorted(map(tuple, frame.collect()))


def test_only_changes_are_scored(spark, tmp_path):
    calls = []
    store = VerdictStore(spark, str(tmp_path / "s"), _score(calls))
    first = spark.createDataFrame([(k, f"t{k}", k) for k in range(200)], "job_id long, title string, ingested_at int")
    people = spark.createDataFrame([("a", 3), ("b", 4), ("c", 3)], "id string, kind int")
    with pytest.raises(ValueError, match="no verdict"):
        store.read()
    whole = lambda rows, who: _rows(_score([])(rows, who))
    assert store.refresh(first, people) == {"postings": 200, "profiles": 3, "scored": 60} and calls == [600]
    assert _rows(store.read()) == whole(first, people)

    later = first.where("job_id <> 13").withColumn("title", F.when(F.col("job_id").isin(23, 24), "new").otherwise(F.col("title"))).withColumn("ingested_at", F.lit(0))
    assert store.refresh(later, people) == {"postings": 2, "profiles": 0, "scored": 3} and calls[1:] == [6]
    assert _rows(store.read()) == whole(later, people) and len(_rows(store.read())) == 58
    assert store.refresh(later, people) == {"postings": 0, "profiles": 0, "scored": 0} and len(calls) == 2
    assert _rows(store.read()) == whole(later, people)

    others = spark.createDataFrame([("a", 5), ("b", 4), ("d", 3), (None, 3)], "id string, kind int")  # one changed, one gone, one new
    assert store.refresh(first, others) == {"postings": 3, "profiles": 2, "scored": 3 + 20 + 18} and calls[2:] == [9, 2 * 197]  # a posting that is as it was once is scored again
    assert _rows(store.read()) == whole(first, others.where("id IS NOT NULL"))
    store.compact()
    assert _rows(store.read()) == whole(first, others.where("id IS NOT NULL"))
    assert store.refresh(later, others)["postings"] == 2 and _rows(store.read()) == whole(later, others.where("id IS NOT NULL"))

    anew = VerdictStore(spark, store.path, store.score, rules="2")
    assert anew.refresh(later, others)["postings"] == 199 and _rows(anew.read()) == whole(later, others.where("id IS NOT NULL"))


def test_repeated_and_empty_rows(spark, tmp_path):
    store = VerdictStore(spark, str(tmp_path / "s"), _score([]))
    rows = spark.createDataFrame([(3, "x"), (3, "x"), (3, None), (None, "y")], "job_id long, title string")
    people = spark.createDataFrame([("a", 3)], "id string, kind int")
    assert store.refresh(rows.limit(0), people.limit(0)) == {"postings": 0, "profiles": 0, "scored": 0}
    assert store.refresh(rows, people)["scored"] == 3 and len(_rows(store.read())) == 3
    assert store.refresh(rows.dropDuplicates(), people)["postings"] == 1 and len(_rows(store.read())) == 2
    assert store.refresh(rows.limit(0), people) == {"postings": 0, "profiles": 0, "scored": 0} and _rows(store.read()) == []


def test_verdicts_after_an_update_of_one_percent(spark, tmp_path):
    rows = postings(spark, SF)
    mine = {p.id: p for p in (PROFILE, OTHER)}
    people = spark.createDataFrame([(p.id, str(sorted(asdict(p).items()))) for p in mine.values()], "id string, rules string")
    store = VerdictStore(spark, str(tmp_path / "s"), lambda some, who: verdict.profile_fits(some, [mine[r.id] for r in who.select("id").collect()]))
    store.refresh(rows.withColumn("title", F.when(F.col("job_id").cast("long") % 100 == 7, "Intern").otherwise(F.col("title"))), people)
    many = rows.where("job_id % 100 = 7").count()
    assert store.refresh(rows, people) == {"postings": many, "profiles": 0, "scored": 2 * many}
    assert _rows(store.read()) == _rows(verdict.profile_fits(rows, [PROFILE, OTHER]))
