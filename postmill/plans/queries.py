"""The engine's operators on the driver's tables, and the same in DuckDB SQL.

The tables hold no postings, so each query says in its columns which table stands in for them. All reads are of whole tables.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import analytics, eligibility, filters, provenance, search, state, textmetrics, verdict

AS_OF = datetime(2024, 1, 31)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def money(c: Column | str, scale: int = 4) -> Column:
    """A sum that doesn't depend on the order of its parts."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{scale})")).cast("double")


def stamp(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events),
t AS (SELECT event_type, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY event_type)
SELECT r.event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at, user_id, value, total FROM r JOIN t USING (event_type) WHERE k = 1
""")
def latest_per_group_with_totals(spark, d):
    """The status of each source: its latest run and its total."""
    rows = read(spark, d, "events").withColumn("_v", F.col("value").cast("decimal(18,4)"))
    out = analytics.latest_with_totals(rows, "event_type", [F.col("ts").desc(), F.col("event_id").desc()], F.col("_v"))
    return out.select("event_type", "event_id", stamp("ts").alias("started_at"), "user_id", "value", F.col("total").cast("double").alias("total"))


@query("""
SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY o_orderstatus
UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
""")
def facet_counts(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return search.facets(rows, ["status", "priority"])


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderkey % 2 = 0 AND o_orderkey % 3 < 2 AND o_orderkey % 5 < 4 AND o_orderkey % 7 < 6 AND o_orderkey % 11 < 10 AND o_orderkey % 13 < 12")
def filter_multi_select(spark, d):
    """All eight columns; empty values ask for nothing."""
    digit = {"remote_mode": 2, "visa_sponsorship": 3, "company_size_bucket": 5, "employer_type": 7, "security_clearance": 11, "employment_type": 13}
    rows = read(spark, d, "orders").withColumns({"source": F.col("o_orderstatus"), "category": F.col("o_orderpriority"), **{c: (F.col("o_orderkey") % n).cast("string") for c, n in digit.items()}})
    f = filters.Filters(any_of={"source": ["F", "P", ""], "category": ["1-URGENT", "2-HIGH"], **{c: [str(k) for k in range(n - 1)] for c, n in digit.items()}})
    return filters.apply(rows, f, AS_OF).select("o_orderkey", "o_orderstatus", "o_orderpriority")


_ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderkey % 3 = 1 END AS is_active,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 5 = 1 END AS citizenship_required, CASE o_orderkey % 4 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' WHEN 2 THEN 'unclear' END AS visa_sponsorship FROM orders"""


def _orders(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(
        "o_orderkey", F.when(k % 3 == 0, None).otherwise(k % 3 == 1).alias("is_active"), F.when(k % 5 == 0, None).otherwise(k % 5 == 1).alias("citizenship_required"),
        F.when(k % 4 == 0, "yes").when(k % 4 == 1, "no").when(k % 4 == 2, "unclear").alias("visa_sponsorship"),
    )


@query(f"SELECT * FROM ({_ORDERS}) WHERE is_active IS DISTINCT FROM false AND citizenship_required = false AND visa_sponsorship IN ('yes', 'unclear', 'not_mentioned')")
def filter_null_semantics(spark, d):
    f = filters.Filters(include_active=True, exclude_citizenship=True, exclude_no_sponsorship=True)
    return filters.apply(_orders(spark, d), f, AS_OF)


@query("SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 7 DAY")
def filter_date_preset(spark, d):
    rows = read(spark, d, "events").withColumn("posted_date", F.col("ts"))
    return filters.apply(rows, filters.Filters(date_preset="7d", date_from=date(2020, 1, 1)), AS_OF).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'")
def filter_date_range(spark, d):
    rows = read(spark, d, "events").withColumn("posted_date", F.col("ts"))
    return filters.apply(rows, filters.Filters(date_preset="ever", date_from=date(2024, 1, 10), date_to=date(2024, 1, 12)), AS_OF).select("event_id")


_PARTS = "SELECT p_partkey, nullif(p_size % 14, 0) AS yoe_min, CASE p_partkey % 5 WHEN 0 THEN 'intern' WHEN 1 THEN 'junior' WHEN 2 THEN 'mid' WHEN 3 THEN 'senior' ELSE 'lead' END AS seniority, p_partkey % 7 = 0 AS new_grad_program FROM part"


def _parts(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return read(spark, d, "part").select("p_partkey", F.nullif(F.col("p_size") % 14, F.lit(0)).alias("yoe_min"), F.when(k % 5 == 0, "intern").when(k % 5 == 1, "junior").when(k % 5 == 2, "mid").when(k % 5 == 3, "senior").otherwise("lead").alias("seniority"), (k % 7 == 0).alias("new_grad_program"))


@query(f"SELECT p_partkey, yoe_min, seniority FROM ({_PARTS}) WHERE (yoe_min <= 2 OR (yoe_min IS NULL AND seniority IN ('intern', 'junior'))) OR (yoe_min BETWEEN 6 AND 10 OR (yoe_min IS NULL AND seniority = 'senior'))")
def filter_bands(spark, d):
    return filters.apply(_parts(spark, d), filters.Filters(experience=["entry", "senior", "nothing"]), AS_OF).select("p_partkey", "yoe_min", "seniority")


@query(f"SELECT p_partkey FROM ({_PARTS}) WHERE new_grad_program OR ((yoe_min <= 2 OR (yoe_min IS NULL AND seniority IN ('intern', 'junior'))) AND seniority NOT IN ('senior', 'staff', 'lead', 'principal', 'manager', 'director', 'vp', 'c_level'))")
def filter_true_entry(spark, d):
    return filters.apply(_parts(spark, d), filters.Filters(true_entry_only=True), AS_OF).select("p_partkey")


@query("""
SELECT count(*) AS total, count(*) FILTER (ts > t - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (ts > t - INTERVAL 7 DAY) AS last_7d, count(*) FILTER (ts > t - INTERVAL 14 DAY) AS last_14d,
 count(*) FILTER (ts > t - INTERVAL 21 DAY) AS last_21d, count(*) FILTER (ts > t - INTERVAL 30 DAY) AS last_1m FROM (SELECT ts, TIMESTAMP '2024-01-31 00:00:00' AS t FROM events)
""")
def stats_date_buckets(spark, d):
    return analytics.stats(read(spark, d, "events"), "ts", AS_OF)


def _age(c: str = "ts") -> Column:
    return (F.unix_micros(dates.moment(AS_OF)) - F.unix_micros(F.col(c).cast("timestamp"))) / 3.6e9


@query("""
WITH a AS (SELECT epoch(TIMESTAMP '2024-01-31') - epoch(ts) AS s FROM events), c AS (SELECT count(*) FILTER (s < 21600) AS r6, count(*) FILTER (s < 43200) AS r12, count(*) FILTER (s < 64800) AS r18, count(*) FILTER (s < 604800) AS r168 FROM a)
SELECT CASE WHEN r6 >= 10 THEN 6 WHEN r12 >= 10 THEN 12 WHEN r18 >= 10 THEN 18 ELSE 168 END AS rung, CASE WHEN r6 >= 10 THEN r6 WHEN r12 >= 10 THEN r12 WHEN r18 >= 10 THEN r18 ELSE r168 END AS total FROM c
""")
def ladder_generic(spark, d):
    return search.ladder(read(spark, d, "events"), _age(), [6, 12, 18, 168], 10)


@query("""
WITH a AS (SELECT user_id, min(epoch(TIMESTAMP '2024-01-31') - epoch(ts)) AS s FROM events WHERE event_type = 'purchase' GROUP BY user_id), c AS (SELECT count(*) FILTER (s < 86400) AS r24, count(*) FILTER (s < 604800) AS r168, count(*) FILTER (s < 2592000) AS r720 FROM a)
SELECT CASE WHEN r24 >= 20 THEN 24 WHEN r168 >= 20 THEN 168 ELSE 720 END AS rung, CASE WHEN r24 >= 20 THEN r24 WHEN r168 >= 20 THEN r168 ELSE r720 END AS total FROM c
""")
def ladder_qualified(spark, d):
    """Counts qualified rows, each user once."""
    rows = read(spark, d, "events").where("event_type = 'purchase'")
    return search.ladder(rows, _age(), [24, 168, 720], 20, F.col("user_id"))


@query("""
WITH d AS (SELECT doc_id, source, CASE WHEN doc_id % 97 > 0 THEN lower(text) END AS key FROM documents),
k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY key) AS n, min(doc_id) OVER (PARTITION BY key) AS first_id FROM d),
o AS (SELECT key, source, count(*) AS c FROM k GROUP BY key, source)
SELECT doc_id, source, n - 1 AS duplicate_count, first_id,
 coalesce((SELECT string_agg(o.source, ',' ORDER BY o.source) FROM o WHERE o.key IS NOT DISTINCT FROM k.key AND (o.source <> k.source OR o.c > 1)), '') AS also_on FROM k WHERE r = 1
""")
def repost_dedup(spark, d):
    """Documents as reposts of equal texts; those of null keys are one group."""
    rows = read(spark, d, "documents").select("doc_id", "source", F.when(F.col("doc_id") % 97 > 0, F.lower("text")).alias("key"))
    out = search.collapse_reposts(rows, [F.col("key")], position=[F.col("doc_id")])
    return out.select("doc_id", "source", F.col("duplicate_count"), F.col("first_position.p0").alias("first_id"), F.array_join("also_on", ",").alias("also_on"))


@query("SELECT o_orderkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS posted FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def browse_page_posted_desc(spark, d):
    rows = read(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").cast("timestamp").alias("posted_date"))
    return search.page(rows, search.order("posted_desc"), 3, 25).select("job_id", F.date_format("posted_date", "yyyy-MM-dd").alias("posted"))


@query("SELECT c_custkey AS job_id, nullif(c_acctbal, -1e9) AS salary_max FROM customer ORDER BY coalesce(c_acctbal, 0) DESC, c_custkey LIMIT 20")
def browse_page_salary_desc(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("job_id"), F.col("c_acctbal").alias("salary_max"))
    return search.page(rows, search.order("salary_desc"), 1, 20)


def _snapshot(spark, d) -> DataFrame:
    """Orders as listings of boards: those before 1998 are known, those of odd keys are seen again, urgent boards are complete."""
    orders = read(spark, d, "orders").select(F.col("o_orderstatus").alias("ats"), F.col("o_orderpriority").alias("board_slug"), F.col("o_orderkey").cast("string").alias("job_id"), "o_orderkey", "o_orderdate")
    then = F.col("o_orderdate").cast("timestamp")
    known = orders.where("o_orderdate < '1998-01-01'").select("ats", "board_slug", "job_id", then.alias("first_seen"), then.alias("last_seen"), F.when(F.col("o_orderkey") % 7 == 0, then).alias("closed_at"))
    return state.snapshot(known, orders.where("o_orderkey % 2 = 1"), orders.where("board_slug = '1-URGENT'"), AS_OF)


_SEEN = """
WITH k AS (SELECT o_orderstatus AS ats, o_orderpriority AS board_slug, o_orderkey::VARCHAR AS job_id, o_orderdate AS first_seen, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS closed_at FROM orders WHERE o_orderdate < '1998-01-01'),
s AS (SELECT o_orderstatus AS ats, o_orderpriority AS board_slug, o_orderkey::VARCHAR AS job_id FROM orders WHERE o_orderkey % 2 = 1)"""


@query(_SEEN + """ SELECT k.ats, k.board_slug, k.job_id, strftime(coalesce(k.closed_at, TIMESTAMP '2024-01-31'), '%Y-%m-%d') AS closed FROM k LEFT JOIN s USING (job_id)
WHERE s.job_id IS NULL AND (k.closed_at IS NOT NULL OR (k.board_slug = '1-URGENT' AND k.ats IN (SELECT o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT')))""")
def snapshot_closed(spark, d):
    return _snapshot(spark, d).where("closed_at is not null").select("ats", "board_slug", "job_id", F.date_format("closed_at", "yyyy-MM-dd").alias("closed"))


@query(_SEEN + """ SELECT coalesce(k.job_id, s.job_id) AS job_id, strftime(coalesce(k.first_seen, TIMESTAMP '2024-01-31'), '%Y-%m-%d') AS first_seen FROM k FULL JOIN s USING (job_id) WHERE s.job_id IS NOT NULL""")
def snapshot_reopened(spark, d):
    return _snapshot(spark, d).where("closed_at is null and last_seen = timestamp '2024-01-31 00:00:00'").select("job_id", F.date_format("first_seen", "yyyy-MM-dd").alias("first_seen"))


def _base_delta(spark, d) -> tuple[DataFrame, DataFrame]:
    """The first half of January's events by user and type, and the second half's."""
    events = read(spark, d, "events").withColumn("v", F.col("value").cast("decimal(18,4)"))
    keys = ["user_id", "event_type"]
    half = lambda where: events.where(where).groupBy(*keys).agg(F.sum("v").alias("v"), F.count("*").alias("n"))
    return half("ts < '2024-01-16'"), half("ts >= '2024-01-16'")


_HALVES = "WITH b AS (SELECT user_id, event_type, sum(value::DECIMAL(18,4)) AS v, count(*) AS n FROM events WHERE ts < '2024-01-16' GROUP BY ALL), x AS (SELECT user_id, event_type, sum(value::DECIMAL(18,4)) AS v, count(*) AS n FROM events WHERE ts >= '2024-01-16' GROUP BY ALL) "


@query(_HALVES + "SELECT user_id, event_type, coalesce(x.v, b.v)::DOUBLE AS v, coalesce(x.n, b.n) AS n FROM b FULL JOIN x USING (user_id, event_type)")
def upsert_replace(spark, d):
    base, delta = _base_delta(spark, d)
    return state.merge_replace(base, delta, ["user_id", "event_type"]).withColumn("v", F.col("v").cast("double"))


@query(_HALVES + "SELECT user_id, event_type, coalesce(x.n, 0) + coalesce(b.n, 0) AS n FROM b FULL JOIN x USING (user_id, event_type)")
def upsert_accumulate(spark, d):
    base, delta = _base_delta(spark, d)
    return state.merge_sum(base, delta, ["user_id", "event_type"], "n")


@query(_HALVES + "SELECT user_id, event_type, coalesce(CASE WHEN x.n % 2 = 0 THEN NULL ELSE x.v END, b.v)::DOUBLE AS v, coalesce(x.n, b.n) AS n FROM b FULL JOIN x USING (user_id, event_type)")
def upsert_coalesce(spark, d):
    base, delta = _base_delta(spark, d)
    delta = delta.withColumn("v", F.when(F.col("n") % 2 != 0, F.col("v")))
    return state.merge_coalesce(base, delta, ["user_id", "event_type"], ["v"]).withColumn("v", F.col("v").cast("double"))


@query(_HALVES + "SELECT user_id, event_type, coalesce(b.n, x.n) AS n FROM b FULL JOIN x USING (user_id, event_type)")
def insert_ignore(spark, d):
    base, delta = _base_delta(spark, d)
    return state.insert_missing(base, delta, ["user_id", "event_type"]).select("user_id", "event_type", "n")


@query("SELECT event_id FROM events WHERE NOT coalesce(coalesce(CASE WHEN event_id % 3 <> 0 THEN ts END, ts + INTERVAL 1 DAY) < TIMESTAMP '2024-01-20', false)")
def retention_purge(spark, d):
    rows = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("timestamp")).alias("posted_date"), (F.col("ts").cast("timestamp") + F.expr("interval 1 day")).alias("ingested_at"))
    return state.purge(rows, datetime(2024, 1, 20)).select("event_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def excluded_anti_join(spark, d):
    return filters.without(read(spark, d, "orders"), read(spark, d, "customer").where("c_acctbal < 0").withColumnRenamed("c_custkey", "o_custkey"), "o_custkey").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')")
def active_semi_join(spark, d):
    listed = read(spark, d, "orders").select(F.col("o_custkey").alias("job_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate").cast("timestamp")).alias("closed_at"))
    return state.listed_open(read(spark, d, "customer").withColumn("job_id", F.col("c_custkey")), listed).select("c_custkey", "c_name")


@query("SELECT s_suppkey, s_name, s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS known FROM supplier")
def lookup_flag(spark, d):
    listed = read(spark, d, "nation").where("n_regionkey = 1").select(text.normalize_text(F.concat(F.lit("Nation "), F.col("n_nationkey"), F.lit(" Inc."))).alias("name"))
    rows = read(spark, d, "supplier").withColumn("company", F.concat(F.lit("NATION "), F.col("s_nationkey"), F.lit(", LLC")))
    return provenance.flag_listed(rows, listed, "company", "known").select("s_suppkey", "s_name", "known")


_STAGED = "SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'applied' WHEN 'click' THEN 'oa' WHEN 'signup' THEN 'interview' WHEN 'purchase' THEN 'offer' ELSE 'rejected' END AS status FROM events"


def _staged(spark, d) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "applied").when(kind == "click", "oa").when(kind == "signup", "interview").when(kind == "purchase", "offer").otherwise("rejected")
    source = F.when(F.col("user_id") % 4 == 0, None).when(F.col("user_id") % 4 == 1, "greenhouse").when(F.col("user_id") % 4 == 2, "adzuna").otherwise("usajobs")
    return read(spark, d, "events").select("event_id", status.alias("status"), source.alias("source"), provenance.kind(source).alias("source_kind"))


@query(f"""
WITH e AS ({_STAGED}), c AS (SELECT count(*) AS total_applications, count(*) FILTER (status = 'applied') AS applied, count(*) FILTER (status = 'oa') AS oa, count(*) FILTER (status = 'interview') AS interview, count(*) FILTER (status = 'offer') AS offer, count(*) FILTER (status = 'rejected') AS rejected FROM e)
SELECT *, total_applications - applied AS responded, round((total_applications - applied) / total_applications, 4) AS response_rate, round((oa + interview + offer) / total_applications, 4) AS screening_rate,
 round((interview + offer) / total_applications, 4) AS interview_rate, round(offer / total_applications, 4) AS offer_rate FROM c""")
def funnel_overall(spark, d):
    return analytics.funnel(_staged(spark, d))


@query(f"""
WITH e AS (SELECT *, CASE user_id % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'greenhouse' WHEN 2 THEN 'adzuna' ELSE 'usajobs' END AS source FROM ({_STAGED}))
SELECT source, CASE source WHEN 'greenhouse' THEN 'primary' WHEN 'usajobs' THEN 'government' ELSE 'aggregator' END AS source_kind, count(*) AS applications, count(*) FILTER (status <> 'applied') AS responded, count(*) FILTER (status = 'offer') AS offers FROM e GROUP BY source""")
def funnel_by_source(spark, d):
    return analytics.funnel_by_source(_staged(spark, d), [F.col("event_id")])


@query("SELECT event_type AS metric, count(*) AS total FROM events WHERE strftime(ts, '%Y-%m-%d') >= '2024-01-15' GROUP BY event_type")
def usage_rollup(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("metric"), dates.period(F.col("ts")).alias("period"), F.lit(1).alias("count"))
    return analytics.usage(rows, "2024-01-15")


@query("""
WITH l AS (SELECT DISTINCT user_id, event_type AS metric, CASE WHEN user_id % 3 = 0 THEN NULL ELSE 2 END AS allowed FROM events), u AS (SELECT user_id, event_type AS metric, count(*) AS used FROM events WHERE strftime(ts, '%Y-%m-%d') = '2024-01-15' GROUP BY ALL)
SELECT user_id, metric, coalesce(used, 0) AS used, allowed, coalesce(coalesce(used, 0) >= allowed, false) AS breached FROM l LEFT JOIN u USING (user_id, metric)""")
def quota_breach(spark, d):
    rows = read(spark, d, "events").select("user_id", F.col("event_type").alias("metric"), dates.period(F.col("ts")).alias("period"), F.lit(1).alias("count"))
    limits = rows.select("user_id", "metric").distinct().withColumn("allowed", F.when(F.col("user_id") % 3 != 0, 2))
    return state.quota_left(rows, limits, "2024-01-15")


_NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '(\s*\b(inc|llc|ltd|corp|co|gmbh|plc|pty|pvt|sa|ag|nv|bv|ab|oy)\b)+\s*$', ''), '\s+', ' ', 'g'))"


@query(f"SELECT p_partkey, {_NORMAL.format('''p_name || ' (Remote), Inc.' ''')} AS name, {_NORMAL.format('p_name')} AS title FROM part")
def normalize_key(spark, d):
    name = F.col("p_name")
    return read(spark, d, "part").select("p_partkey", text.normalize_text(F.concat(name, F.lit(" (Remote), Inc."))).alias("name"), text.normalize_title(F.concat(name, F.lit(" (Remote) [NYC]"))).alias("title"))


@query(f"SELECT c_custkey, substr(sha256({_NORMAL.format('c_name')} || '|' || {_NORMAL.format('c_mktsegment')} || '|' || c_nationkey::VARCHAR), 1, 16) AS job_id FROM customer")
def content_hash(spark, d):
    return read(spark, d, "customer").select("c_custkey", text.posting_id(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("job_id"))


_UNESCAPED = "html"
for _reference, _sign in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "''", "&apos;": "''", "&nbsp;": " ", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&bull;": "•", "&hellip;": "…", "&copy;": "©", "&middot;": "·", "&amp;": "&"}.items():
    _UNESCAPED = f"replace({_UNESCAPED}, '{_reference}', '{_sign}')"


@query(rf"SELECT page_id, sha256(trim(regexp_replace(regexp_replace({_UNESCAPED}, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f\v\x{{0085}}\x{{00A0}}\p{{Z}}]+', ' ', 'g'))) AS text FROM pages")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.sha2(text.plain_text(F.col("html")).cast("binary"), 256).alias("text"))


@query(r"SELECT doc_id, n FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]\s+|\n+'), lambda s: regexp_matches(lower(s), 'licen[cs]e'))) AS n FROM documents) WHERE n > 0")
def sentence_evidence(spark, d):
    parts = F.filter(eligibility.sentences(F.col("text")), lambda s: F.regexp_like(F.lower(s), F.lit("licen[cs]e")))
    return read(spark, d, "documents").select("doc_id", F.size(parts).alias("n")).where("n > 0")


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(greatest(0, least(1, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2)), 6) AS score FROM embeddings, q ORDER BY 2 DESC, 1 LIMIT 20""")
def knn_topk(spark, d):
    rows = read(spark, d, "embeddings")
    query = [float(x) for x in rows.where("vec_id = 0").first().embedding]
    rounded = rows.select("vec_id", "embedding")
    return search.nearest(rounded, "vec_id", "embedding", query, 20).select("vec_id", F.round("score", 6).alias("score"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1)
SELECT doc_id, CASE WHEN embedding IS NULL THEN 0.5 ELSE round(greatest(0, least(1, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2)), 6) END AS score FROM documents LEFT JOIN embeddings ON doc_id = vec_id, q""")
def similarity_scores(spark, d):
    vectors = read(spark, d, "embeddings")
    query = [float(x) for x in vectors.where("vec_id = 1").first().embedding]
    rows = read(spark, d, "documents").join(vectors, F.col("doc_id") == F.col("vec_id"), "left")
    return rows.select("doc_id", F.round(search.similarity(F.col("embedding"), query), 6).alias("score"))


_BM25 = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS t FROM documents),
c AS (SELECT doc_id, len(t) AS l, len(list_filter(t, lambda x: x = 'license')) AS a, len(list_filter(t, lambda x: x = 'the')) AS b FROM w),
s AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score FROM c, s WHERE a > 0 OR b > 0"""


@query(_BM25)
def bm25_scores(spark, d):
    return search.bm25(read(spark, d, "documents"), "doc_id", "text", "the License").select("doc_id", F.round("score", 6).alias("score"))


@query(f"""
WITH k AS ({_BM25}), q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id AS doc_id, round((1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2, 6) AS score FROM embeddings, q),
ks AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS a FROM k), vs AS (SELECT doc_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS b FROM v)
SELECT doc_id, round(0.3 * coalesce(b, 0) + 0.7 * coalesce(a, 0), 4) AS score FROM ks FULL JOIN vs USING (doc_id)""")
def hybrid_blend(spark, d):
    vectors = read(spark, d, "embeddings")
    query = [float(x) for x in vectors.where("vec_id = 0").first().embedding]
    keyword = bm25_scores(spark, d)
    vector = vectors.select(F.col("vec_id").alias("doc_id"), F.round(search.similarity(F.col("embedding"), query), 6).alias("score"))
    return search.hybrid(keyword, vector, "doc_id", 0.3).select("doc_id", F.round("score", 4).alias("score"))


@query("""
SELECT doc_id, round((0.35 * coalesce(quality, 0) + 0.25 * (n_chars > 1000)::INT + CASE WHEN vec_id IS NOT NULL THEN 0.2 * label / 10.0 ELSE 0 END) / (CASE WHEN quality IS NOT NULL THEN 0.35 ELSE 0 END + 0.25 + CASE WHEN vec_id IS NOT NULL THEN 0.2 ELSE 0 END), 6) AS fit
FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id""")
def weighted_fit(spark, d):
    """A weighted mean over the terms that a row has."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left").join(read(spark, d, "embeddings"), F.col("doc_id") == F.col("vec_id"), "left")
    fit = textmetrics.weighted_mean([(0.35, F.col("quality").cast("double")), (0.25, (F.col("n_chars") > 1000).cast("int").cast("double")), (0.2, F.col("label") / 10.0)])
    return rows.select("doc_id", F.round(fit, 6).alias("fit"))


@query(r"""
WITH w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS t FROM documents)
SELECT doc_id, len(t) AS word_count, len(list_distinct(t)) AS type_count, round(coalesce(len(list_distinct(t)) / nullif(len(t), 0), 0), 4) AS ttr FROM w""")
def text_metrics_basic(spark, d):
    fields = ["readability.word_count", "lexical.type_count", "lexical.ttr"]
    return textmetrics.families(read(spark, d, "documents").select("doc_id", "text"), "text", fields).select("doc_id", *fields)


@query(r"""
WITH w AS (SELECT quality, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+')) AS t FROM documents JOIN labels USING (doc_id)), c AS (SELECT quality, len(t) AS n, map_values(list_aggregate(t, 'histogram')) AS f FROM w),
k AS (SELECT quality, round(coalesce(len(f) / nullif(n, 0), 0), 4)::DECIMAL(18, 4) AS ttr, round(coalesce(10000 * (list_sum(list_transform(f, lambda x: x * x)) - n)::DOUBLE / nullif(n::DOUBLE * n, 0), 0), 4)::DECIMAL(18, 4) AS yule_k FROM c),
m AS (SELECT 'ttr' AS metric, sum(ttr) FILTER (quality = 0)::DOUBLE / count(*) FILTER (quality = 0) AS before, sum(ttr) FILTER (quality = 1)::DOUBLE / count(*) FILTER (quality = 1) AS after FROM k UNION ALL SELECT 'yule_k', sum(yule_k) FILTER (quality = 0)::DOUBLE / count(*) FILTER (quality = 0), sum(yule_k) FILTER (quality = 1)::DOUBLE / count(*) FILTER (quality = 1) FROM k)
SELECT metric, round(before, 3) AS before, round(after, 3) AS after, round(after - before, 2) AS delta, CASE WHEN before IS NULL OR after IS NULL OR abs(after - before) < 1e-6 THEN 'neutral' WHEN (after > before) = (metric = 'ttr') THEN 'better' ELSE 'worse' END AS direction FROM m""")
def metric_delta(spark, d):
    """Means of two text metrics, from texts of low quality to those of high."""
    rows = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("quality", "text")
    every = textmetrics.families(rows, "text").select("quality", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"lexical.{m}").cast("decimal(18,4)").alias("v")) for m in ("ttr", "yule_k")])).alias("x"))
    mean = lambda q: F.sum(F.when(F.col("quality") == q, F.col("x.v"))).cast("double") / F.count_if(F.col("quality") == q)
    out = textmetrics.delta(every.groupBy("x.metric").agg(mean(0).alias("before"), mean(1).alias("after")), "before", "after")
    return out.select("metric", F.round("before", 3).alias("before"), F.round("after", 3).alias("after"), F.round("delta", 2).alias("delta"), "direction")


@query("SELECT user_id, strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit_window(spark, d):
    out = analytics.rate_limited(read(spark, d, "events"), "user_id", "ts", 1, 3600)
    return out.select("user_id", stamp("window_start").alias("window_start"), "n")


@query("""
SELECT l_suppkey, count(*) FILTER (l_quantity < 10) AS junior, count(*) FILTER (l_returnflag = 'R') AS relevant, count(*) AS total FROM lineitem GROUP BY l_suppkey ORDER BY junior DESC, relevant DESC, total, l_suppkey LIMIT 20""")
def discovery_rank(spark, d):
    boards = read(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_quantity") < 10).alias("junior"), F.count_if(F.col("l_returnflag") == "R").alias("relevant"), F.count("*").alias("total"))
    return boards.orderBy(*analytics.discovery_rank(boards), "l_suppkey").limit(20)


@query("SELECT c_name AS company, count(*) AS jobs FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY c_name ORDER BY jobs DESC, company LIMIT 80")
def unlisted_companies(spark, d):
    customers = read(spark, d, "customer")
    rows = read(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("company"))
    return analytics.unlisted_companies(rows, customers.where("c_nationkey = 3").select(F.upper("c_name").alias("name")))


_CASE = "CASE WHEN event_type = 'click' THEN 'greenhouse' WHEN event_type = 'view' THEN 'usajobs' WHEN event_type = 'signup' THEN 'jobspy' ELSE event_type END"


@query(f"""SELECT event_id, CASE {_CASE} WHEN 'greenhouse' THEN 'primary' WHEN 'usajobs' THEN 'government' WHEN 'jobspy' THEN 'scraper' ELSE 'aggregator' END AS source_kind, CASE {_CASE} WHEN 'greenhouse' THEN 'updated' ELSE 'posted' END AS freshness_kind,
 floor((epoch(TIMESTAMP '2024-02-28') - epoch(ts)) / 86400)::INT AS posting_age_days, CASE WHEN floor((epoch(TIMESTAMP '2024-02-28') - epoch(ts)) / 86400) > 45 THEN 'high' WHEN floor((epoch(TIMESTAMP '2024-02-28') - epoch(ts)) / 86400) > 30 THEN 'medium' ELSE 'low' END AS ghost_risk FROM events""")
def computed_columns(spark, d):
    kind = F.col("event_type")
    source = F.when(kind == "click", "greenhouse").when(kind == "view", "usajobs").when(kind == "signup", "jobspy").otherwise(kind)
    then, posted = datetime(2024, 2, 28), F.col("ts").cast("timestamp")
    return read(spark, d, "events").select("event_id", provenance.kind(source).alias("source_kind"), dates.freshness_kind(source, F.lit(False)).alias("freshness_kind"), dates.age_days_or_null(posted, then).alias("posting_age_days"), dates.ghost_risk(posted, then).alias("ghost_risk"))


_TITLES = "CASE p_partkey % 8 WHEN 0 THEN 'Junior Data Engineer' WHEN 1 THEN 'Senior Software Engineer (Contract)' WHEN 2 THEN 'DevOps Intern' WHEN 3 THEN 'Security Analyst' WHEN 4 THEN 'Product Manager, part-time' WHEN 5 THEN 'UX Designer' WHEN 6 THEN 'Machine Learning Engineer II' ELSE 'Director of Sales' END"


def _titles(spark, d) -> DataFrame:
    return read(spark, d, "part").withColumn("title", F.expr(_TITLES))


@query(f"""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'data_ml_ai' WHEN 1 THEN 'software_eng' WHEN 2 THEN 'devops_infra' WHEN 3 THEN 'security' WHEN 4 THEN 'product_mgmt' WHEN 5 THEN 'design_ux' WHEN 6 THEN 'data_ml_ai' ELSE 'management' END AS category,
 CASE p_partkey % 8 WHEN 1 THEN 'contract' WHEN 2 THEN 'internship' WHEN 4 THEN 'part_time' ELSE 'full_time' END AS employment_type, CASE p_partkey % 8 WHEN 0 THEN 'junior' WHEN 1 THEN 'senior' WHEN 2 THEN 'intern' WHEN 4 THEN 'manager' WHEN 6 THEN 'mid' WHEN 7 THEN 'director' END AS level FROM (SELECT p_partkey, {_TITLES} AS title FROM part)""")
def title_classes(spark, d):
    t = F.col("title")
    return _titles(spark, d).select("p_partkey", text.category(t).alias("category"), text.employment_type(t, F.lit(None).cast("string")).alias("employment_type"), verdict.title_seniority(t).alias("level"))


def postings(spark, d) -> DataFrame:
    """Parts as postings."""
    from ..schemas import as_postings

    k = F.col("p_partkey")
    skill = F.when(k % 4 == 0, F.array(F.lit("Python"), F.lit("Postgres"), F.lit("Airflow"))).when(k % 4 == 1, F.array(F.lit("Java"), F.lit("k8s"), F.lit("Machine Learning"))).when(k % 4 == 2, F.array(F.lit("COBOL"), F.lit("SAP"), F.lit("Excel"))).otherwise(F.array().cast("array<string>"))
    rows = _titles(spark, d).select(
        k.cast("string").alias("job_id"), F.lit("greenhouse").alias("source"), "title", F.col("p_brand").alias("company"), F.when(k % 5 == 0, "London, UK").otherwise("Austin, TX").alias("location_raw"),
        F.when(k % 3 == 0, "remote").otherwise("onsite").alias("remote_mode"), F.when(k % 6 == 0, "Must be a US citizen.").when(k % 6 == 1, "Requirements: 4+ years of experience with Python and SQL.").otherwise("We use Python, PyTorch and SQL.").alias("description"),
        F.nullif(F.col("p_size") % 7, F.lit(0)).cast("int").alias("yoe_min"), skill.alias("skills"), F.lit("done").alias("enrichment_status"), F.lit("https://example.com").alias("url"),
    )
    return as_postings(rows)


PROFILE = verdict.Profile(id="p1", label="data", target_titles=["Data Engineer", "Machine Learning Engineer"], skills=["python", "postgresql", "pytorch", "sql"], interests=["data pipelines"], seniority_max="mid", yoe_max=3)
OTHER = verdict.Profile(id="p2", label="software", target_titles=["Software Engineer"], skills=["java", "kubernetes"], seniority_max="senior", yoe_max=5, needs_sponsorship=True)
