"""Queries of what is kept between runs: very many saved searches, boards that are followed as a stream, verdicts that are scored again only where something changed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import saved_searches, verdict
from ..operators.verdict_store import VerdictStore
from ..sources.bucketed import BucketedTable
from ..streaming import lifecycle
from .judgement import FITS
from .queries import AS_OF, OTHER, PROFILE, postings, query, read
from .session import scratch


@query("""
WITH e AS (SELECT event_type AS remote_mode, CASE user_id % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'usajobs' WHEN 2 THEN 'adzuna' ELSE 'jobspy' END AS source, CASE event_id % 5 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' WHEN 3 THEN 'not_mentioned' END AS visa,
 CASE event_id % 6 WHEN 0 THEN 'intern' WHEN 1 THEN 'junior' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' WHEN 4 THEN 'director' END AS seniority, CASE WHEN value < 60 THEN floor(value / 4) END AS yoe, CASE WHEN event_id % 9 <> 4 THEN event_id % 9 <> 5 END AS active,
 user_id % 7 = 0 AS citizen, user_id % 10 = 3 AS recruiter, event_id % 13 = 0 AS grad, CASE user_id % 3 WHEN 0 THEN 'likely' WHEN 1 THEN 'no' END AS cap, user_id % 5 = 0 AS h1b, user_id % 6 = 0 AS everify, ts AS posted, ts + INTERVAL 1 DAY AS ingested FROM events),
s AS (SELECT c_custkey AS k, c_mktsegment AS seg, c_acctbal AS bal, CASE WHEN c_custkey % 11 > 0 THEN TIMESTAMP '2024-01-05' + INTERVAL 1 HOUR * (c_custkey % 600) END AS seen FROM customer),
p AS (SELECT k, seen, ingested FROM e, s WHERE (seg <> 'BUILDING' OR remote_mode IN ('click', 'view')) AND (seg <> 'MACHINERY' OR source = 'greenhouse') AND (seg <> 'FURNITURE' OR (source IN ('usajobs', 'jobspy') AND visa IN ('yes', 'unclear')))
 AND (k % 4 <> 0 OR active IS DISTINCT FROM false) AND (k % 5 <> 0 OR NOT citizen) AND (k % 7 <> 0 OR NOT recruiter) AND (k % 13 <> 0 OR source IN ('greenhouse', 'usajobs')) AND (k % 17 <> 0 OR (visa IN ('yes', 'unclear', 'not_mentioned') AND NOT citizen))
 AND (k % 3 <> 0 OR posted >= TIMESTAMP '2024-01-31' - INTERVAL 1080 HOUR) AND (k % 19 <> 0 OR grad OR ((yoe <= 2 OR (yoe IS NULL AND seniority IN ('intern', 'junior'))) AND seniority NOT IN ('senior', 'director'))) AND (k % 23 <> 0 OR grad)
 AND (NOT (k % 29 = 0 OR k % 31 = 0 OR k % 37 = 0) OR (k % 29 = 0 AND cap = 'likely') OR (k % 31 = 0 AND h1b) OR (k % 37 = 0 AND everify)) AND (bal < 5000 OR ingested > TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * floor(bal)::BIGINT)
 AND (k % 8 <> 1 OR (yoe >= 3 AND yoe <= 5) OR (yoe IS NULL AND seniority = 'mid') OR yoe >= 11 OR (yoe IS NULL AND seniority = 'director')) AND (k % 6 <> 1 OR posted > TIMESTAMP '2024-01-31' - INTERVAL 504 HOUR)
 AND (k % 6 <> 2 OR (posted >= DATE '2024-01-01' + (k % 25)::INT AND posted < DATE '2024-01-01' + (k % 25)::INT + 4)))
SELECT 'search ' || s.k AS search_id, count(p.k) AS total, count(p.k) FILTER (s.seen IS NULL OR p.ingested > s.seen) AS new_count FROM s LEFT JOIN p ON p.k = s.k GROUP BY s.k""")
def saved_search_index(spark, d):
    """A saved search of every customer, counted over all events as postings; each field of the filters is used by some."""
    user, event, ts = F.col("user_id"), F.col("event_id"), F.col("ts").cast("timestamp")
    postings = read(spark, d, "events").select(
        F.col("event_type").alias("remote_mode"), F.when(user % 4 == 0, "greenhouse").when(user % 4 == 1, "usajobs").when(user % 4 == 2, "adzuna").otherwise("jobspy").alias("source"),
        F.when(event % 5 == 0, "yes").when(event % 5 == 1, "no").when(event % 5 == 2, "unclear").when(event % 5 == 3, "not_mentioned").alias("visa_sponsorship"),
        F.when(event % 6 == 0, "intern").when(event % 6 == 1, "junior").when(event % 6 == 2, "mid").when(event % 6 == 3, "senior").when(event % 6 == 4, "director").alias("seniority"),
        F.when(F.col("value") < 60, F.floor(F.col("value") / 4)).alias("yoe_min"), F.when(event % 9 != 4, event % 9 != 5).alias("is_active"), (user % 7 == 0).alias("citizenship_required"), (user % 10 == 3).alias("is_recruiter_post"),
        (event % 13 == 0).alias("new_grad_program"), F.when(user % 3 == 0, "likely").when(user % 3 == 1, "no").alias("cap_exempt"), (user % 5 == 0).alias("known_h1b_sponsor"), (user % 6 == 0).alias("known_everify"),
        ts.alias("posted_date"), (ts + F.expr("interval 1 day")).alias("ingested_at"),
    )
    k, segment, balance = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_acctbal")
    lists = lambda **of: F.create_map(*[x for c, v in of.items() for x in (F.lit(c), F.array(*map(F.lit, v)))])
    first, day = F.lit("2024-01-01").cast("timestamp"), F.date_add(F.lit("2024-01-01").cast("date"), (k % 25).cast("int"))
    searches = read(spark, d, "customer").select(
        F.concat(F.lit("search "), k).alias("search_id"),
        F.when(segment == "BUILDING", lists(remote_mode=["click", "view"])).when(segment == "MACHINERY", lists(source=["greenhouse"])).when(segment == "FURNITURE", lists(source=["usajobs", "jobspy"], visa_sponsorship=["yes", "unclear"])).alias("any_of"),
        *[(k % n == 0).alias(flag) for flag, n in {"include_active": 4, "exclude_citizenship": 5, "exclude_recruiter": 7, "direct_sources_only": 13, "exclude_no_sponsorship": 17, "exclude_ghost": 3, "true_entry_only": 19, "new_grad_only": 23, "known_h1b": 31, "known_everify": 37}.items()],
        F.when(k % 29 == 0, F.array(F.lit("likely"))).alias("cap_exempt"), F.when(balance >= 5000, first + F.make_dt_interval(mins=F.floor(balance).cast("int"))).alias("ingested_after"),
        F.when(k % 8 == 1, F.array(F.lit("mid"), F.lit("lead"))).alias("experience"), F.when(k % 6 == 1, "21d").alias("date_preset"), F.when(k % 6 == 2, day).alias("date_from"), F.when(k % 6 == 2, F.date_add(day, 3)).alias("date_to"),
        F.when(k % 11 > 0, F.lit("2024-01-05").cast("timestamp") + F.make_dt_interval(hours=(k % 600).cast("int"))).alias("last_seen"),
    )
    return saved_searches.counts(postings, searches, AS_OF)


@query("""
WITH e AS (SELECT 'ats ' || (user_id % 3) AS ats, 'board ' || (user_id % 30) AS board_slug, user_id || '-' || (event_id % 4) AS job_id, date_trunc('day', ts) AS day, event_type = 'error' AS whole FROM events),
s AS (SELECT ats, board_slug, job_id, min(day) AS first_day, max(day) AS last_day FROM e WHERE NOT whole GROUP BY ALL), m AS (SELECT DISTINCT ats, board_slug, day FROM e WHERE whole)
SELECT ats, board_slug, job_id, strftime(first_day, '%Y-%m-%d') AS first_seen, strftime(last_day, '%Y-%m-%d') AS last_seen, (SELECT strftime(min(day), '%Y-%m-%d') FROM m WHERE m.ats = s.ats AND m.board_slug = s.board_slug AND day > last_day) AS closed_at FROM s""")
def board_lifecycle(spark, d):
    """Events as a stream of crawls in three batches: errors are complete crawls of a board, the others sightings."""
    user, path = F.col("user_id"), scratch(spark, "crawls")
    crawls = read(spark, d, "events").select(
        F.concat(F.lit("ats "), user % 3).alias("ats"), F.concat(F.lit("board "), user % 30).alias("board_slug"), F.concat_ws("-", user, F.col("event_id") % 4).alias("job_id"),
        F.date_trunc("day", F.col("ts").cast("timestamp")).alias("crawled_at"), (F.col("event_type") == "error").alias("complete"),
    )
    crawls.repartition(12, "crawled_at").write.parquet(f"{path}/landed")
    stream = spark.readStream.schema(lifecycle.CRAWL).option("maxFilesPerTrigger", 4).parquet(f"{path}/landed")
    table = BucketedTable(spark, f"{path}/presence", spark.createDataFrame([], lifecycle.PRESENCE).schema, ["ats", "board_slug", "job_id"], 16)
    lifecycle.follow_into(stream, table, f"{path}/checkpoint", 4).awaitTermination()
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return table.read().select("ats", "board_slug", "job_id", day("first_seen"), day("last_seen"), day("closed_at"))


@query(FITS)
def incremental_fits(spark, d):
    """The fits of ``cross_profile_fit`` by an update: verdicts of an older state, in which one posting in 100 had another title and one in 90 wasn't there, are kept where nothing changed."""
    rows, mine, k = postings(spark, d), {p.id: p for p in (PROFILE, OTHER)}, F.col("job_id").cast("long")
    people = spark.createDataFrame([(p.id, repr(p)) for p in mine.values()], "id string, rules string")
    store = VerdictStore(spark, scratch(spark, "verdicts"), lambda some, who: verdict.profile_fits(some, [mine[r.id] for r in who.select("id").collect()]))
    store.refresh(rows.where(k % 90 != 3).withColumn("title", F.when(k % 100 == 7, "Intern").otherwise(F.col("title"))), people)
    store.refresh(rows, people)
    return store.read()
