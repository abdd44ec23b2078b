"""A merge writes only the folders that it changes."""

import json
import os
from datetime import datetime
from pathlib import Path

from pyspark.sql import functions as F

from postmill.schemas import POSTING
from postmill.sources.bucketed import BucketedTable
from postmill.streaming import ingest


def files(path) -> set[str]:
    return {str(p) for p in Path(path).rglob("*.parquet")}


def test_merges_write_what_changes(spark, tmp_path):
    rows = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.when(F.col("id") % 3 > 0, F.array(F.lit("a"))).alias("a"))
    table = BucketedTable(spark, str(tmp_path / "table"), rows.schema, ["k"], 32)
    assert table.read().count() == 0 and table.merge(rows) == 32
    before = files(tmp_path / "table")
    assert table.merge(rows.where("k < 500")) == 0 and files(tmp_path / "table") == before  # a repeated batch changes nothing
    delta = spark.createDataFrame([(7, "new", None, 2), (7, "old", None, 1), (9000, None, None, 1), (8, "v8", ["a"], 1)], "k long, v string, a array<string>, turn int")
    assert table.merge(delta, F.col("turn")) <= 2
    after = files(tmp_path / "table")
    gone, kept = before - after, before & after
    assert 1 <= len({os.path.dirname(x) for x in gone}) <= 2 and len({os.path.dirname(x) for x in kept}) >= 30
    found = {r.k: (r.v, r.a) for r in table.read().collect()}
    assert len(found) == 2001 and found[7] == ("new", None) and found[8] == ("v8", ["a"]) and found[9000] == (None, None) and found[9] == ("v9", None)
    assert table.merge(delta.limit(0)) == 0 and table.merge(delta, F.col("turn")) == 0


def test_stream_into_a_stored_table(spark, tmp_path):
    """Batches that come twice or change a posting."""
    job = lambda k, title: {"id": k, "title": title, "absolute_url": f"https://x/{k}", "location": {"name": "Austin, TX"}, "content": "d", "updated_at": "2024-01-02"}
    batches = [[job(k, f"Engineer {k}") for k in range(6)], [job(k, f"Engineer {k}") for k in range(6)], [job(3, "Engineer 3"), job(77, "Engineer 77")]]
    (tmp_path / "landed").mkdir()
    for n, jobs in enumerate(batches):
        line = {"board": "b", "name": "Acme", "employer_type": None, "country": "us", "payload": json.dumps({"jobs": jobs})}
        (tmp_path / "landed" / f"{n}.json").write_text(json.dumps(line) + "\n")
    table = BucketedTable(spark, str(tmp_path / "table"), POSTING, ["job_id"], 8)
    stream = ingest.ingest_into(ingest.landed(spark, str(tmp_path / "landed"), 1), "greenhouse", table, str(tmp_path / "state"), datetime(2024, 1, 31))
    stream.awaitTermination(120)
    assert sorted(r.title for r in table.read().collect()) == sorted(f"Engineer {k}" for k in [*range(6), 77])
