"""A query of the source of landed payloads: documents as boards' responses, landed and read again as a batch and as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import landed, vendors
from .queries import query, read
from .session import scratch

#: Ids of documents to a response; so a response stays small whatever the size of its board.
SPAN = 400


@query("""
SELECT 'board ' || coalesce(source, 'none') AS board, doc_id::VARCHAR AS source_job_id, coalesce(lang, 'any') || ' engineer' AS title, 'https://example.com/' || doc_id AS url, length(coalesce(trim(text), '')) AS n_chars, sha256(coalesce(trim(text), '')) AS digest, 1::BIGINT AS by_batch, 1::BIGINT AS by_stream FROM documents""")
def landed_source(spark, d):
    """Documents as postings of their source's board: every posting with how often the batch and the stream, which follows two landings, give it."""
    path = scratch(landed.register(spark), "landings")
    item = F.struct(F.col("doc_id").alias("id"), F.concat(F.coalesce("lang", F.lit("any")), F.lit(" engineer")).alias("text"), F.concat(F.lit("https://example.com/"), "doc_id").alias("hostedUrl"), F.col("text").alias("descriptionPlain"))
    span = F.floor(F.col("doc_id") / SPAN)
    pages = read(spark, d, "documents").groupBy(F.concat(F.lit("board "), F.coalesce("source", F.lit("none"))).alias("board"), span.alias("span")).agg(F.to_json(F.sort_array(F.collect_list(item))).alias("payload"))
    pages = pages.withColumn("late", F.col("span") % 2).select("board", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("late") * 100_000_000 + F.col("span")).alias("landed_at"), "payload", "late")
    for late in range(2):
        pages.where(F.col("late") == late).drop("late").write.format("landed").mode("append").save(f"{path}/in")
        stream = spark.readStream.format("landed").load(f"{path}/in").writeStream.format("parquet").option("checkpointLocation", f"{path}/check")
        stream.trigger(availableNow=True).start(f"{path}/followed").awaitTermination()
    way = {"by_batch": spark.read.format("landed").load(f"{path}/in"), "by_stream": spark.read.parquet(f"{path}/followed")}
    told = [vendors.parse("lever", rows).select("*", *[F.lit(int(w == n)).alias(n) for n in way]) for w, rows in way.items()]
    kept = [F.col("company").alias("board"), "source_job_id", "title", "url", F.length("description").cast("long").alias("n_chars"), F.sha2("description", 256).alias("digest")]
    each = told[0].unionByName(told[1]).select(*kept, *way)
    return each.groupBy("board", "source_job_id", "title", "url", "n_chars", "digest").agg(*[F.sum(n).cast("long").alias(n) for n in way])
