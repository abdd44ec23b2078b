"""Stored indexes against searches that read everything."""

import os
import random

import numpy as np
from pyspark.sql import functions as F

from postmill.operators import keyword_index, search, vector_index

SF = "/root/testdata/sf0.01"


def first(rows, k):
    return sorted(((round(r.score, 9), r.key) for r in rows), key=lambda x: (-x[0], x[1]))[:k]


def size_of(files):
    return sum(os.path.getsize(f.removeprefix("file://").removeprefix("file:")) for f in set(files))


def test_keyword_index_equals_full_search(spark, tmp_path):
    """With shards of 16 rows, so that bounds leave most out; ties, repeated words, null and empty texts."""
    draw = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    table = [(k, " ".join(draw.choice(words[: draw.choice([3, 30, 400])]) for _ in range(draw.randrange(1, 60)))) for k in range(900)]
    table += [(2000 + k, "w1 w2 same") for k in range(40)] + [(3000, None), (3001, ""), (3002, "W399 w399, É")]
    rows = spark.createDataFrame(table, "key long, text string")
    keyword_index.build(rows, "key", "text", str(tmp_path / "index"), shard=16, buckets=4)
    index = keyword_index.Index(spark, str(tmp_path / "index"))
    for query in ("w1 w2 w300 w1", "same", "é W350", "", "absent w2"):
        for k in (1, 50):
            wanted = [(round(r.score, 9), r.key) for r in search.bm25(rows, "key", "text", query).collect()] if query else []
            assert first(index.search(query, k).collect(), k) == sorted(wanted, key=lambda x: (-x[0], x[1]))[:k], (query, k)
    blocks = index.blocks(["w1", "w399"])
    assert blocks.agg(F.max("rows")).first()[0] <= 64  # a block is bounded by its shard however common its term


def test_keyword_index_reads_little(spark, tmp_path):
    """Bytes of the files that a search opens, against the index and the texts."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("key"), "text")
    keyword_index.build(rows, "key", "text", str(tmp_path / "index"), shard=64)
    index = keyword_index.Index(spark, str(tmp_path / "index"))
    blocks = index.blocks(["the", "license"])._jdf.queryExecution()
    blocks.toRdd().count()
    opened, every = blocks.executedPlan().collectLeaves().apply(0).metrics().apply("filesSize").value(), size_of(spark.read.parquet(str(tmp_path / "index/blocks")).inputFiles())
    texts = size_of(spark.read.parquet(f"{SF}/documents.parquet").inputFiles())
    print("bytes opened", opened, "of the index", every, "texts", texts)
    assert opened < every / 8 and opened < texts / 4
    plan = index.blocks(["the", "license"]).select("term", "shard", "best")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "In(term, [license,the])" in plan and "postings" not in plan.split("ReadSchema:")[1].split("\n")[0]
    empty = str(tmp_path / "none")
    keyword_index.build(rows.limit(0), "key", "text", empty)
    assert keyword_index.Index(spark, empty).search("the", 3).count() == 0


def test_vector_index(spark, tmp_path):
    """Recall at 10 of 0.95 by a part of the cells, with and without a filter; the exact way equals the full search; null and zero vectors."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label")
    odd = spark.createDataFrame([(9001, None, 1), (9002, [0.0] * 64, 1)], rows.schema)
    every = rows.unionByName(odd)
    vector_index.build(every, "vec_id", "embedding", str(tmp_path / "index"))
    index = vector_index.Index(spark, str(tmp_path / "index"))
    held = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    labels = {r.vec_id: r.label for r in rows.collect()}
    ids = sorted(held)
    units = np.stack([held[i] / np.linalg.norm(held[i]) for i in ids])
    hits, queries, labelled = 0, ids[::199], labels[ids[0]]
    for q in queries:
        order = [ids[k] for k in np.argsort(-(units @ units[ids.index(q)]), kind="stable")]
        found = [r.vec_id for r in index.nearest("vec_id", "embedding", held[q].tolist(), 10, probes=34).collect()]
        hits += len(set(found) & set(order[:10]))
    print("cells", len(index.centers), "probed", 34, "recall", hits / (10 * len(queries)))
    assert hits / (10 * len(queries)) >= 0.95
    q = queries[1]
    order = [i for i in (ids[k] for k in np.argsort(-(units @ units[ids.index(q)]), kind="stable")) if labels[i] == labelled]
    exact = index.nearest("vec_id", "embedding", held[q].tolist(), 10, F.col("label") == labelled, probes=2, exact=True)
    assert [r.vec_id for r in exact.collect()] == order[:10]
    rare = index.nearest("vec_id", "embedding", held[q].tolist(), 10, F.col("vec_id") == ids[-1], probes=1)  # hardly any row passes: all cells are read in the end
    assert [r.vec_id for r in rare.collect()] == [ids[-1]]
    assert [(r.vec_id, r.score) for r in index.nearest("vec_id", "embedding", [0.0] * 64, 1, F.col("vec_id") > 9000, exact=True).collect()] == [(9002, 0.5)]
    vector_index.build(odd.where("vec_id = 9001"), "vec_id", "embedding", str(tmp_path / "none"))
    assert vector_index.Index(spark, str(tmp_path / "none")).nearest("vec_id", "embedding", [1.0] * 64, 3).count() == 0


def test_equal_reposts_leave_one(spark):
    rows = spark.createDataFrame([("1", "lever", "k"), ("1", "lever", "k"), ("2", "adzuna", "k")], "job_id string, source string, key string")
    found = search.collapse_reposts(rows, [F.col("key")]).collect()
    assert [(r.job_id, r.duplicate_count, r.also_on) for r in found] == [("1", 2, ["adzuna", "lever"])]


def test_building_a_keyword_index_moves_no_posting_by_itself(spark, tmp_path):
    """Texts go to their shards and blocks to their folders: the rows shuffled are those two, not one a word of a text."""
    rows = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 40}" for j in range(30))) for k in range(600)], "id long, t string").coalesce(1)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("keyword-build", "build")
    keyword_index.build(rows, "id", "t", str(tmp_path / "i"), shard=100)
    stages = {s for j in tracker.getJobIdsForGroup("keyword-build") for s in tracker.getJobInfo(j).stageIds}
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)
    blocks = spark.read.parquet(str(tmp_path / "i/blocks"))
    postings = blocks.selectExpr("sum(rows)").first()[0]
    assert moved <= 600 + blocks.count() + 20 < postings
