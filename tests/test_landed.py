"""The source of landed payloads: batch and stream against parsing the payloads themselves."""

import json
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from postmill.sources import landed, vendors

BOARDS = ["acme", "a/b", "..", "zürich co", "big"]


def payloads(spark, start, stop):
    begin, rows = datetime(2024, 1, 1, tzinfo=timezone.utc), []
    for k in range(start, stop):
        board = BOARDS[k % 5] if k % 2 else "big"
        jobs = [{"id": 100 * k + j, "title": f"Engineer {j}", "absolute_url": f"https://x.test/{k}/{j}", "content": "&lt;p&gt;é " * (j + k % 7), "updated_at": "2024-01-02T00:00:00Z"} for j in range(3)]
        rows.append((board, board.upper() if k % 3 else None, None, "us", json.dumps({"jobs": jobs}) if k % 11 else "broken {", begin + timedelta(microseconds=k)))
    return spark.createDataFrame(rows, "board string, name string, employer_type string, country string, payload string, landed_at timestamp")


def parsed(rows):
    return sorted(map(tuple, vendors.parse("greenhouse", rows).select("_board_slug", "source_job_id", "company", "url", "description").collect()))


def test_batch_and_stream_equal_parsing(spark, tmp_path):
    landed.register(spark)
    path, first, rest = str(tmp_path / "in"), payloads(spark, 0, 40), payloads(spark, 40, 70)
    first.write.format("landed").mode("append").save(path)
    files = lambda: sorted(str(p) for p in Path(path).rglob("*") if p.is_file())
    before = files()
    first.write.format("landed").mode("append").save(path)  # a repeated write adds nothing
    assert files() == before and len(before) == 40 and all(f.endswith(".json") for f in before)
    read = spark.read.format("landed").option("bytes", 2000).load(path)
    assert parsed(read) == parsed(first) and read.count() == 40
    by_task = read.select("board", F.spark_partition_id().alias("t")).distinct().collect()
    assert len({r.t for r in by_task if r.board == "big"}) > 3  # a large board is many tasks
    whole = spark.read.format("landed").load(path)
    assert whole.rdd.getNumPartitions() == 1 and {r.board for r in whole.select("board").distinct().collect()} == set(BOARDS)
    some = spark.read.format("landed").option("boards", json.dumps(["..", "a/b", "none"])).load(path)
    assert parsed(some) == parsed(first.where(F.col("board").isin("..", "a/b")))

    def follow(number):
        stream = spark.readStream.format("landed").load(path)
        stream.writeStream.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(str(tmp_path / "out"), format="parquet").awaitTermination()
        return spark.read.parquet(str(tmp_path / "out"))

    assert parsed(follow(1)) == parsed(first)
    rest.write.format("landed").mode("append").save(path)
    both = follow(2)
    assert parsed(both) == parsed(first.unionByName(rest)) and both.count() == 70
    assert follow(3).count() == 70


def test_files_are_opened_only_for_their_contents(spark, tmp_path):
    landed.register(spark)
    path = str(tmp_path / "in")
    payloads(spark, 0, 12).write.format("landed").mode("append").save(path)
    for p in Path(path).rglob("*.json"):
        p.write_text("not read")
    got = spark.read.format("landed").schema("landed_at timestamp, board string").load(path)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, payloads(spark, 0, 12).select("landed_at", "board").collect()))
    with pytest.raises(Exception, match="no column salary"):
        spark.read.format("landed").schema("salary string").load(path).collect()
    with pytest.raises(Exception):
        spark.read.format("landed").load(path).collect()


def test_empty_and_missing(spark, tmp_path):
    landed.register(spark)
    assert spark.read.format("landed").load(str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="needs board"):
        payloads(spark, 0, 1).withColumn("payload", F.lit(None).cast("string")).write.format("landed").mode("append").save(str(tmp_path / "bad"))
