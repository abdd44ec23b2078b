"""Searches counted by the index against each search's own filter."""

import random
from dataclasses import asdict
from datetime import date, datetime, timedelta

import pytest
from postmill.operators import records, saved_searches
from postmill.operators.filters import MULTI, Filters

AS_OF = datetime(2024, 3, 1)


def _postings(spark, many):
    r = random.Random(5)
    pick = lambda *values: r.choice([None, *values])
    moment = lambda: r.choice([None, datetime(2024, 1, 1), datetime(2024, 2, 23), datetime(2024, 1, 1) + timedelta(microseconds=r.randrange(60 * 86_400_000_000))])
    rows = [
        {
            **{c: pick("yes", "unclear", "a", "b") for c in MULTI}, "source": pick("greenhouse", "adzuna", "lever"), "seniority": pick("junior", "mid", "senior", "director"), "cap_exempt": pick("likely", "no"),
            **{c: pick(True, False) for c in ("is_active", "citizenship_required", "is_recruiter_post", "new_grad_program", "known_h1b_sponsor", "known_everify")},
            "yoe_min": pick(0.0, 2.0, 3.0, 7.0, 12.0), "posted_date": moment(), "ingested_at": moment(),
        } for _ in range(many)
    ]
    return spark.createDataFrame(rows, ", ".join(f"{c} {kind}" for c, kind in saved_searches.READ.items()))


def _searches():
    r = random.Random(7)
    flag = lambda: r.random() < 0.15
    out = {"nothing": Filters(), "unknown names": Filters(experience=["x"], date_preset="x"), "empty values": Filters(any_of={"source": ["", None]}), "no such value": Filters(any_of={"source": ["zzz"]})}
    out["no time left"] = Filters(date_from=date(2024, 2, 2), date_to=date(2024, 2, 1))
    for k in range(55):
        out[f"s{k}"] = Filters(
            any_of={c: r.sample(["yes", "unclear", "a", "b", "greenhouse", "adzuna"], 3) for c in r.sample(MULTI, r.choice([0, 0, 1, 2]))}, **{f: flag() for f in saved_searches.FLAGS},
            cap_exempt=r.choice([[], [], ["likely"], ["no", "x"]]), known_h1b=flag(), known_everify=flag(), ingested_after=r.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 20, 5)]),
            experience=r.sample(["entry", "mid", "senior", "lead", "x"], r.choice([0, 0, 2])), date_preset=r.choice([None, None, "7d", "1m"]),
            date_from=r.choice([None, date(2024, 1, 1), date(2024, 2, r.randrange(1, 25))]), date_to=r.choice([None, date(2024, 2, 23), date(2024, 2, r.randrange(1, 25))]),
        )
    return out, {name: r.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 1) + timedelta(hours=r.randrange(1400))]) for name in out}


def test_index_counts_as_each_filter_does(spark):
    postings, (searches, seen) = _postings(spark, 1500), _searches()
    rows = spark.createDataFrame([{"search_id": name, **asdict(f), "last_seen": seen[name]} for name, f in searches.items()], ", ".join(f"{c} {kind}" for c, kind in saved_searches.SEARCH.items()))
    found = {r.search_id: (r.total, r.new_count) for r in saved_searches.counts(postings, rows, AS_OF).collect()}
    assert found == {r.search_id: (r.total, r.new_count) for r in records.saved_counts(postings, searches, seen, AS_OF).collect()}
    assert found["nothing"][0] == found["unknown names"][0] == found["empty values"][0] == 1500 and found["no such value"] == (0, 0) == found["no time left"]
    assert sum(0 < total < 1500 for total, _ in found.values()) > 30


def test_searches_of_empty_tables_and_missing_columns(spark):
    searches = spark.createDataFrame([("a", "7d"), ("b", None)], "search_id string, date_preset string")
    few = spark.createDataFrame([("greenhouse",)], "source string")
    assert sorted(map(tuple, saved_searches.counts(few, searches, AS_OF).collect())) == [("a", 0, 0), ("b", 1, 1)]
    assert sorted(map(tuple, saved_searches.counts(few.limit(0), searches, AS_OF).collect())) == [("a", 0, 0), ("b", 0, 0)]
    assert saved_searches.counts(few, searches.limit(0), AS_OF).collect() == []


def test_a_filter_of_no_column_is_an_error(spark):
    searches = spark.createDataFrame([("a", {"price": ["1"]})], "search_id string, any_of map<string, array<string>>")
    with pytest.raises(Exception, match="no such filter: price"):
        saved_searches.counts(_postings(spark, 5), searches, AS_OF).collect()


def test_no_pair_of_a_search_and_a_posting_is_a_row(spark, monkeypatch):
    """Chunks and parts of a few rows, equal postings, few filters kept: the counts stay, and nothing is joined with the postings."""
    for name, value in {"CHUNK": 70, "PART": 9, "MOST_KEPT": 3}.items():
        monkeypatch.setattr(saved_searches, name, value)
    few, (searches, seen) = _postings(spark, 400), _searches()
    postings = few.unionByName(few.limit(150)).unionByName(few.limit(80)).unionByName(few.limit(80))
    rows = spark.createDataFrame([{"search_id": name, **asdict(f), "last_seen": seen[name]} for name, f in searches.items()], ", ".join(f"{c} {kind}" for c, kind in saved_searches.SEARCH.items()))
    out = saved_searches.counts(postings, rows, AS_OF)
    found = {r.search_id: (r.total, r.new_count) for r in out.collect()}
    assert found == {r.search_id: (r.total, r.new_count) for r in records.saved_counts(postings, searches, seen, AS_OF).collect()}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join Inner" not in plan and plan.count("Join ") == 1
