"""The stream of boards against snapshots crawl by crawl, over several splits of the input."""

import random
from datetime import datetime, timedelta

import pytest
from postmill.operators import state
from postmill.sources.bucketed import BucketedTable
from postmill.streaming import lifecycle
from pyspark.sql import functions as F

KEYS = ["ats", "board_slug", "job_id"]


def _crawls():
    r, rows = random.Random(3), []
    for k in range(9):
        at = datetime(2024, 1, 1, 5) + timedelta(hours=7 * k, microseconds=k)
        for board in ("a", "b"):
            if r.random() < 0.8:
                rows += [("x", board, f"j{n}", at, r.choice([False, None])) for n in range(12) if r.random() < 0.6]
                rows += [rows[-1]] * (k % 2)
                if r.random() < 0.6:
                    rows.append(("x", board, r.choice([None, "all"]), at, True))
    return rows


@pytest.fixture(scope="module")
def snapshots(spark):
    table, rows = spark.createDataFrame([], lifecycle.PRESENCE), _crawls()
    for at in sorted({x[3] for x in rows}):
        seen = spark.createDataFrame([x[:3] for x in rows if x[3] == at and not x[4]], "ats string, board_slug string, job_id string")
        whole = spark.createDataFrame([x[:2] for x in rows if x[3] == at and x[4]], "ats string, board_slug string")
        table = spark.createDataFrame(state.snapshot(table, seen, whole, at).collect(), lifecycle.PRESENCE)
    return sorted(map(tuple, table.collect()), key=repr)


@pytest.mark.parametrize("split", ["ordered", "shuffled", "one batch"])
def test_any_split_ends_in_the_snapshot(spark, tmp_path, snapshots, split):
    rows = _crawls()
    if split == "shuffled":
        random.Random(8).shuffle(rows)
    rows += [("x", None, "j", rows[0][3], False), (None, "a", "j", rows[0][3], True), ("x", "a", "j", None, False), ("x", "a", None, rows[0][3], False)]  # passed over
    size = len(rows) if split == "one batch" else -(-len(rows) // 4)
    for start in range(0, len(rows), size):
        spark.createDataFrame(rows[start : start + size], lifecycle.CRAWL).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(lifecycle.CRAWL).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table = BucketedTable(spark, str(tmp_path / "table"), spark.createDataFrame([], lifecycle.PRESENCE).schema, KEYS, 4)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    lifecycle.follow_into(stream, table, str(tmp_path / "check"), 2).awaitTermination()
    assert sorted(map(tuple, table.read().select(*spark.createDataFrame([], lifecycle.PRESENCE).columns).collect()), key=repr) == snapshots
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    if split == "ordered":  # the stream goes on where it stopped: a crawl of nothing closes what was open
        end = datetime(2024, 2, 1)
        spark.createDataFrame([("x", "a", None, end, True)], lifecycle.CRAWL).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
        lifecycle.follow_into(stream, table, str(tmp_path / "check"), 2).awaitTermination()
        left = [tuple(x[:5]) + (x[5] or (end if x[1] == "a" else None),) for x in snapshots]
        assert sorted(map(tuple, table.read().collect()), key=repr) == sorted(left, key=repr)
        assert table.read().where(F.col("board_slug") == "a").where("closed_at IS NULL").count() == 0
