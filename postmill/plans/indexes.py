"""Queries of stored indexes, which are built from the tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import keyword_index, vector_index
from ..sources.bucketed import BucketedTable
from .queries import _BM25, query, read
from .session import scratch


@query(f"SELECT doc_id, score FROM ({_BM25}) ORDER BY score DESC, doc_id LIMIT 25")
def bm25_topk(spark, d):
    path = scratch(spark, "keyword-index")
    keyword_index.build(read(spark, d, "documents"), "doc_id", "text", path)
    found = keyword_index.Index(spark, path).search("the License", 60).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "doc_id").limit(25)


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 3)
SELECT vec_id, round(greatest(0, least(1, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2)), 6) AS score FROM embeddings, q WHERE label IN (1, 4) ORDER BY 2 DESC, 1 LIMIT 15""")
def filtered_vector_topk(spark, d):
    """The exact nearest among rows of two labels, by the inverted file."""
    path, rows = scratch(spark, "vector-index"), read(spark, d, "embeddings")
    vector_index.build(rows, "vec_id", "embedding", path)
    wanted = [float(x) for x in rows.where("vec_id = 3").first().embedding]
    found = vector_index.Index(spark, path).nearest("vec_id", "embedding", wanted, 15, F.col("label").isin(1, 4), exact=True)
    return found.select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH o AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), x AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice FROM orders WHERE o_orderkey % 97 = 5)
SELECT o_orderkey, coalesce(x.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(x.o_totalprice, o.o_totalprice) AS o_totalprice FROM o FULL JOIN x USING (o_orderkey) WHERE o_orderkey % 101 <> 7 OR x.o_orderkey IS NOT NULL
UNION ALL SELECT -o_orderkey - 1, 'N', o_totalprice FROM orders WHERE o_orderkey % 101 = 7""")
def bucketed_merge(spark, d):
    """A stored table of orders after a batch of changed and new rows, which is merged twice."""
    orders = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    stored = BucketedTable(spark, scratch(spark, "orders"), orders.schema, ["o_orderkey"], 16)
    stored.merge(orders.where("o_orderkey % 101 <> 7 OR o_orderkey % 97 = 5"))
    changed = orders.where("o_orderkey % 97 = 5").selectExpr("o_orderkey", "'X' AS o_orderstatus", "o_totalprice + 1 AS o_totalprice")
    fresh = orders.where("o_orderkey % 101 = 7").selectExpr("-o_orderkey - 1 AS o_orderkey", "'N' AS o_orderstatus", "o_totalprice")
    for _ in range(2):
        stored.merge(changed.unionByName(fresh))
    return stored.read()
