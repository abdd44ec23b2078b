"""A stored inverted index for keyword search: the first k rows of a query without reading texts.

Postings are stored by term and by shard of rows, all shards of about equal size, so a block is bounded however common its term. Each block has the greatest
weight in it: the blocks of a shard bound its rows' scores together. Blocks lie in folders by a hash of the term, in the order of term and shard, so a search reads the
query's terms only: first the bounds, then the postings of the shards that can hold one of the first k.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .search import K1, B, tokens

#: Rows of a shard; folders of terms; shards whose numbers are pushed down to the scan, more are joined; shards of a task that builds blocks at most, about.
SHARD, BUCKETS, PUSHED, SHARDS = 1024, 64, 1000, 32


def _weight(n: Column, long: Column, mean: Column) -> Column:
    return n * (K1 + 1) / (n + K1 * (1 - B + B * long / mean))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def build(rows: DataFrame, key: str, text: str, path: str, shard: int = SHARD, buckets: int = BUCKETS) -> None:
    """Writes the index of ``rows``, each known by its ``key``, below ``path``. Null and empty texts have no postings but count as rows, as in ``search.bm25``."""
    own = tokens(F.col(text))
    totals = rows.select(F.size(own).alias("long")).agg(F.count("*").alias("rows"), F.avg("long").alias("mean")).withColumns({"shards": F.greatest(F.lit(1), F.ceil(F.col("rows") / shard)).cast("int"), "buckets": F.lit(buckets)})
    totals.write.mode("overwrite").parquet(f"{path}/totals")
    t = rows.sparkSession.read.parquet(f"{path}/totals").first()  # one row
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), t.shards // SHARDS)
    # rows go to their shards once, as texts; terms are counted and blocks made there, so no posting moves by itself
    sharded = rows.select(F.col(key).alias("key"), F.pmod(F.xxhash64(key), F.lit(t.shards)).cast("int").alias("shard"), F.col(text).alias("text")).repartition(tasks, "shard")
    said = sharded.select("shard", "key", tokens(F.col("text")).alias("t")).select("shard", "key", F.size("t").alias("long"), F.explode("t").alias("term"))
    placed = said.groupBy("shard", "key", "term", "long").agg(F.count("*").cast("int").alias("n"))
    w = _weight(F.col("n"), F.col("long"), F.lit(t.mean))
    blocks = placed.groupBy("shard", "term").agg(F.count("*").alias("rows"), F.max(w).alias("best"), F.array_sort(F.collect_list(F.struct("key", "n", "long"))).alias("postings")).select("term", "shard", "rows", "best", "postings")
    share = F.pmod(F.xxhash64("term", "shard"), F.lit(max(1, tasks // buckets)))  # so that more tasks than folders can write
    dealt = blocks.withColumn("bucket", _bucket(F.col("term"), buckets)).repartition(tasks, "bucket", share).sortWithinPartitions("bucket", "term", "shard")
    rows.sparkSession.createDataFrame([], dealt.schema).write.mode("overwrite").parquet(f"{path}/schema")  # an index of no rows has no other file that tells it
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")


@dataclass
class Index:
    """A stored index."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        self.totals = self.spark.read.parquet(f"{self.path}/totals").first()

    def blocks(self, words: list[str]) -> DataFrame:
        """The blocks of some terms; only their folders are listed for reading, and terms are pushed down to the files."""
        every = self.spark.read.schema(self.spark.read.parquet(f"{self.path}/schema").schema).parquet(f"{self.path}/blocks")
        if not words:
            return every.limit(0)
        buckets = {r.b for r in self.spark.createDataFrame([(w,) for w in words], "term string").select(_bucket(F.col("term"), self.totals.buckets).alias("b")).collect()}
        return every.where(F.col("bucket").isin(sorted(buckets)) & F.col("term").isin(words))

    def scores(self, blocks: DataFrame, idf: dict[str, float]) -> DataFrame:
        each = blocks.select("term", F.explode("postings").alias("p"))
        weights = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
        part = weights[F.col("term")] * _weight(F.col("p.n"), F.col("p.long"), F.lit(self.totals.mean))
        return each.groupBy(F.col("p.key").alias("key")).agg(F.sum(part).alias("score"))

    def search(self, query: str, k: int) -> DataFrame:
        """``key, score`` of the first ``k`` rows, as ``search.bm25`` scores them; equal scores go by key. Exact: a shard is left out only if its bound is below a kth score that is known."""
        blocks = self.blocks(sorted({w for w in re.split(r"[^\w]+", query.lower()) if w}))
        n = self.totals.rows
        idf = {r.term: math.log(1 + (n - r.many + 0.5) / (r.many + 0.5)) for r in blocks.groupBy("term").agg(F.sum("rows").alias("many")).collect()}  # a row a term of the query
        if not idf:
            return self.scores(blocks.limit(0), {"": 0.0})
        weights = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])
        bounds = blocks.select("term", "shard", "best").groupBy("shard").agg(F.sum(weights[F.col("term")] * F.col("best")).alias("bound"))
        likely = [r.shard for r in bounds.orderBy(F.desc("bound"), "shard").limit(k).collect()]
        known = self.scores(blocks.where(F.col("shard").isin(likely)), idf).orderBy(F.desc("score")).limit(k).collect()
        least = known[-1].score * (1 - 1e-12) if len(known) == k else 0.0
        left = bounds.where(F.col("bound") >= least)
        few = [r.shard for r in left.select("shard").limit(PUSHED + 1).collect()]
        kept = blocks.where(F.col("shard").isin(few)) if len(few) <= PUSHED else blocks.join(left.select("shard"), "shard", "left_semi")
        return self.scores(kept, idf).where(F.col("score") >= least).orderBy(F.desc("score"), "key").limit(k)
