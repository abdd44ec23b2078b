"""Queries of users' records, lists, names and texts, on tables that stand in for them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import analytics, filters, records, textmetrics
from .queries import AS_OF, query, read, stamp

_KIND = "CASE k % 4 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'usajobs' WHEN 2 THEN 'adzuna' ELSE 'jobspy' END"


def _known(spark, d) -> DataFrame:
    """Two of three customers as postings."""
    k = F.col("c_custkey")
    source = F.when(k % 4 == 0, "greenhouse").when(k % 4 == 1, "usajobs").when(k % 4 == 2, "adzuna").otherwise("jobspy")
    return read(spark, d, "customer").where("c_custkey % 3 <> 0").select(k.alias("job_id"), source.alias("source"), F.col("c_name").alias("company"), F.col("c_mktsegment").alias("title"))


@query(f"""SELECT o_orderkey, o_custkey AS job_id, source, CASE source WHEN 'greenhouse' THEN 'primary' WHEN 'usajobs' THEN 'government' WHEN 'jobspy' THEN 'scraper' ELSE 'aggregator' END AS source_kind
FROM orders LEFT JOIN (SELECT c_custkey AS k, {_KIND.replace('k %', 'c_custkey %')} AS source FROM customer WHERE c_custkey % 3 <> 0) ON k = o_custkey""")
def pipeline_with_postings(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("job_id"))
    return records.tracked(rows, _known(spark, d)).select("o_orderkey", "job_id", "source", "source_kind")


@query(f"""SELECT o_custkey AS job_id, strftime(o_orderdate, '%Y-%m-%d') AS updated_on, {_KIND.replace('k %', 'o_custkey %')} AS source FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND o_custkey % 3 <> 0""")
def postings_in_state(spark, d):
    states = read(spark, d, "orders").select(F.col("o_orderpriority").alias("profile_id"), F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return records.in_state(states, _known(spark, d), "1-URGENT", "O").select("job_id", F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"), "source")


@query("""
SELECT 'clicks' AS search_id, count(*) FILTER (event_type = 'click') AS total, count(*) FILTER (event_type = 'click' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-20') AS new_count FROM events
UNION ALL SELECT 'never seen', count(*) FILTER (user_id % 4 IN (1, 2)), count(*) FILTER (user_id % 4 IN (1, 2)) FROM events
UNION ALL SELECT 'recent', count(*) FILTER (ts > TIMESTAMP '2024-01-24'), count(*) FILTER (ts > TIMESTAMP '2024-01-24' AND ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-29') FROM events""")
def saved_search_counts(spark, d):
    rows = read(spark, d, "events").select(F.col("event_type").alias("source"), (F.col("user_id") % 4).cast("string").alias("remote_mode"), F.col("ts").alias("posted_date"), (F.col("ts") + F.expr("interval 1 day")).alias("ingested_at"))
    searches = {"clicks": filters.Filters(any_of={"source": ["click"]}), "never seen": filters.Filters(any_of={"remote_mode": ["1", "2"]}), "recent": filters.Filters(date_preset="7d")}
    return records.saved_counts(rows, searches, {"clicks": datetime(2024, 1, 20), "recent": datetime(2024, 1, 29)}, AS_OF)


_ID = "substr(sha256('customer ' || lpad({0}::VARCHAR, 9, '0') || '|' || lower({1}) || '|'), 1, 16)"


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN {_ID.format('c_custkey', 'c_mktsegment')} WHEN 1 THEN CASE WHEN c_mktsegment = 'BUILDING' THEN {_ID.format('c_custkey', 'c_mktsegment')} END END AS job_id FROM orders JOIN customer ON c_custkey = o_custkey""")
def applied_import(spark, d):
    """Orders as imported rows: those of 0 modulo 4 have the posting's address, those of 1 a company and a title, others an unknown address or nothing."""
    name, k = F.concat(F.lit("Customer "), F.lpad(F.col("c_custkey").cast("string"), 9, "0")), F.col("o_orderkey") % 4
    known = read(spark, d, "customer").select(text.posting_id(name, F.col("c_mktsegment"), F.lit(None).cast("string")).alias("job_id"), F.concat(F.lit("https://x/"), "c_custkey").alias("url"))
    company = F.concat(F.lit("CUSTOMER "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit(", Inc."))
    rows = read(spark, d, "orders").select("o_orderkey", F.when(k == 1, company).otherwise("").alias("company"), F.when(k == 1, "Building (Remote)").otherwise("").alias("title"), F.when(k == 0, F.concat(F.lit("https://x/"), "o_custkey")).when(k == 2, "https://unknown/").otherwise("").alias("url"))
    return records.applied_import(rows, known).select("o_orderkey", "job_id")


@query("""
WITH s AS (SELECT c_custkey AS id, c_nationkey AS user_id, c_mktsegment AS label, 'text ' || c_custkey AS body, CASE WHEN c_custkey % 2 = 0 THEN 'structured ' || c_custkey END AS st, CASE WHEN c_custkey % 3 = 0 THEN 'of text ' || c_custkey END AS se FROM customer),
e AS (SELECT *, id % 8 AS k FROM s),
l AS (SELECT e.id, list(o.label) AS taken FROM e JOIN s o ON o.user_id = e.user_id AND o.id <> e.id WHERE e.k = 0 GROUP BY e.id)
SELECT e.id, user_id, CASE WHEN k = 0 AND label <> 'MACHINERY' THEN coalesce(CASE WHEN NOT list_contains(taken, 'MACHINERY') THEN 'MACHINERY' END, (SELECT 'MACHINERY (' || min(n) || ')' FROM range(2, 2000) r(n) WHERE NOT list_contains(taken, 'MACHINERY (' || n || ')'))) WHEN k = 0 THEN 'MACHINERY' ELSE label END AS label,
 CASE k WHEN 1 THEN 'from new structure' WHEN 2 THEN 'from new sections' WHEN 3 THEN 'new text' ELSE body END AS resume_text, CASE k WHEN 1 THEN 'new structure' ELSE st END AS structured_resume,
 CASE k WHEN 1 THEN 'of from new structure' WHEN 2 THEN 'new sections' WHEN 3 THEN 'of new text' ELSE CASE WHEN k IN (0, 4) THEN coalesce(se, 'of ' || body) ELSE se END END AS resume_sections,
 CASE k WHEN 1 THEN false WHEN 3 THEN CASE WHEN st IS NOT NULL THEN true END END AS structured_stale, CASE WHEN k = 4 THEN 'new.pdf' ELSE 'old.pdf' END AS resume_filename FROM e LEFT JOIN l USING (id)""")
def profile_updates(spark, d):
    """Customers as profiles, of which those of 0 to 4 modulo 8 are edited: label, structure, sections, text, file."""
    k, null = F.col("c_custkey") % 8, F.lit(None).cast("string")
    body = F.concat(F.lit("text "), "c_custkey")
    rows = read(spark, d, "customer").select(
        "c_custkey", F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("user_id"), F.col("c_mktsegment").alias("label"), body.alias("resume_text"), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("structured "), "c_custkey")).alias("structured_resume"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("of "), body)).alias("resume_sections"), F.lit(None).cast("boolean").alias("structured_stale"), F.lit("old.pdf").alias("resume_filename"), null.alias("resume_content_type"), null.alias("resume_uploaded_at"),
    )
    edits = rows.where(k < 5).withColumns({
        "label": F.when(k == 0, "MACHINERY").otherwise(F.col("label")), "structured_resume": F.when(k == 1, "new structure"), "resume_sections": F.when(k == 2, "new sections").when(k == 3, "ignored"),
        "resume_text": F.when(k == 3, "new text"), "resume_filename": F.when(k == 4, "new.pdf"), "user_id": F.lit(-1),
    }).drop("c_custkey")
    out = records.update_profiles(rows.drop("c_custkey"), edits, lambda t: F.concat(F.lit("of "), t), lambda s: F.concat(F.lit("from "), s), lambda s: F.concat(F.lit("from "), s))
    return out.select("id", "user_id", "label", "resume_text", "structured_resume", "resume_sections", "structured_stale", "resume_filename")


@query("""SELECT o_orderkey, (o_orderkey % 9 < CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 5 END OR o_orderkey % 6 IN (1, 2)) AND (o_orderkey % 7 = 0 OR o_orderdate <= TIMESTAMP '1998-06-01' - INTERVAL 6 HOUR) AND o_orderkey % 4 < 2 AS needs_refill FROM orders""")
def refill_trigger(spark, d):
    k = F.col("o_orderkey")
    window = F.when(k % 6 == 0, "24h").when(k % 6 == 1, "7d").when(k % 6 == 2, "1m").when(k % 6 == 3, "6h")
    started = F.when(k % 7 != 0, F.col("o_orderdate").cast("timestamp"))
    return read(spark, d, "orders").select("o_orderkey", records.needs_refill(k % 9, window, F.when(k % 2 == 0, 3), started, k % 4, datetime(1998, 6, 1)).alias("needs_refill"))


@query("SELECT s_name AS name, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 7 END AS open_roles FROM supplier ORDER BY open_roles DESC NULLS LAST, s_name LIMIT 30")
def company_list(spark, d):
    """A page of companies; a column that may not be asked for gives the default order."""
    k = F.col("s_suppkey")
    rows = read(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(k % 4 != 0, k % 7).alias("open_roles"), F.lit("lever").alias("ats"), F.col("s_name").alias("slug"))
    return rows.orderBy(*records.company_order("name; drop table companies")).limit(30).select("name", "open_roles")


@query("SELECT event_id, event_type AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS started_at FROM events ORDER BY ts DESC, event_id LIMIT 50")
def recent_runs(spark, d):
    rows = read(spark, d, "events").select("event_id", F.col("event_type").alias("source"), F.col("ts").alias("started_at"))
    return records.listed(rows, "runs", "event_id", most=50).withColumn("started_at", stamp("started_at"))


@query("""SELECT o_orderkey, o_custkey % 3 = 0 OR o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AS up_to_date,
 CASE WHEN o_orderkey % 5 = 0 THEN CASE WHEN o_custkey % 3 = 0 THEN '' ELSE 'Candidate_Customer_' || lpad(o_custkey::VARCHAR, 9, '0') || '_' || c_mktsegment || '_Resume.docx' END ELSE 'own.docx' END AS filename FROM orders JOIN customer ON c_custkey = o_custkey""")
def tailored_documents(spark, d):
    """Orders as tailored documents: of 0 modulo 4 have no stored fingerprint, of 1 the present one, others an old one."""
    k = F.col("o_orderkey")
    now = text.fingerprint(F.col("company"), F.col("title"))
    known = _known(spark, d)
    prints = known.select(F.col("job_id").alias("_j"), now.alias("_p"))
    rows = read(spark, d, "orders").join(prints, F.col("o_custkey") == F.col("_j"), "left").select("o_orderkey", F.col("o_custkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.when(k % 4 == 0, None).when(k % 4 == 1, F.coalesce("_p", F.lit("gone"))).otherwise("old").alias("fingerprint"), F.when(k % 5 == 0, "").otherwise("own.docx").alias("filename"))
    return records.tailored_list(rows, known, now).select("o_orderkey", "up_to_date", "filename")


@query("SELECT p_partkey AS job_id, CASE WHEN p_size % 5 <> 0 THEN p_size END AS ai_risk_after FROM part ORDER BY coalesce(ai_risk_after, 999), p_partkey LIMIT 40")
def tailored_order(spark, d):
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("job_id"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("ai_risk_after"))
    return rows.orderBy(*records.tailored_order()).limit(40)


@query("""SELECT 'm' || p_partkey AS metric, (p_size - 25)::DOUBLE AS delta, CASE p_partkey % 3 WHEN 0 THEN 'better' ELSE 'worse' END AS direction FROM part WHERE p_partkey % 3 < 2 ORDER BY direction, abs(delta) DESC, metric LIMIT 6""")
def top_metric_changes(spark, d):
    k = F.col("p_partkey")
    rows = read(spark, d, "part").select(F.concat(F.lit("m"), k).alias("metric"), (F.col("p_size") - 25).cast("double").alias("delta"), F.when(k % 3 == 0, "better").when(k % 3 == 1, "worse").otherwise("neutral").alias("direction"))
    return records.top_changes(rows).select("metric", "delta", "direction")


@query("""WITH f AS (SELECT o_custkey, max(o_orderkey % 11) AS n FROM orders GROUP BY o_custkey) SELECT c_custkey, repeat(CASE WHEN coalesce(n, 0) > c_custkey % 9 THEN 'b' ELSE 'a' END, CASE WHEN coalesce(n, 0) > c_custkey % 9 THEN n ELSE c_custkey % 9 END::INT) AS description FROM customer LEFT JOIN f ON o_custkey = c_custkey""")
def longer_descriptions(spark, d):
    rows = read(spark, d, "customer").select("c_custkey", F.repeat(F.lit("a"), (F.col("c_custkey") % 9).cast("int")).alias("description"))
    found = read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.repeat(F.lit("b"), (F.col("o_orderkey") % 11).cast("int")).alias("description"))
    return records.patch_longer(rows, found, ["c_custkey"])


@query("""SELECT event_type AS metric, count(*) AS total FROM events WHERE user_id % 2 = 0 AND strftime(ts, '%Y-%m-%d') >= '2024-01-05' GROUP BY event_type UNION ALL SELECT 'users', count(DISTINCT user_id) FROM events WHERE user_id % 2 = 0""")
def deployment_rollup(spark, d):
    events = read(spark, d, "events")
    counters = events.select("user_id", F.col("event_type").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.lit(1).alias("count"))
    return records.deployment(events.where("user_id % 2 = 0").select(F.col("user_id").alias("id")).distinct(), counters, "2024-01-05")


@query("SELECT lower(c_mktsegment) AS company, count(*) AS open_roles FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1")
def board_open_roles(spark, d):
    k = F.col("c_custkey")
    return records.open_roles(read(spark, d, "customer").select(F.when(k % 5 == 0, "").when(k % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("company")))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'This tailored-resume workflow is restricted to US-based roles.' WHEN p_partkey % 7 = 0 OR p_partkey % 13 = 0 THEN 'This role has a citizenship, clearance, ITAR/EAR, or export-control requirement.'
 WHEN p_partkey % 5 = 0 THEN 'This role explicitly does not sponsor work authorization.' WHEN p_size % 8 >= 5 THEN 'This role requires 5+ years of experience and fails the early-career gate.' END AS refused,
 concat_ws('|', CASE WHEN p_size % 8 >= 2 THEN 'Reach role: the posting asks for ' || p_size % 8 || '+ years; document stays honest.' END, CASE WHEN p_partkey % 3 = 0 THEN 'Contract/temporary role: confirm OPT employment eligibility with your DSO before accepting.' END,
 CASE WHEN p_partkey % 4 = 0 OR p_partkey % 9 = 0 THEN 'Cap-exempt or likely cap-exempt employer: prioritize this role if the posting allows sponsorship.' END) AS warnings FROM part""")
def tailoring_gate(spark, d):
    k, null = F.col("p_partkey"), F.lit(None).cast("string")
    rows = read(spark, d, "part").select(
        "p_partkey", F.when(k % 11 == 0, "Canada").when(k % 2 == 0, " USA ").alias("country"), null.alias("work_auth_required"), F.when(k % 13 == 0, "ITAR rules apply").alias("restrictions"), F.lit("We use Spark.").alias("description"), (k % 7 == 0).alias("citizenship_required"),
        null.alias("security_clearance"), F.when(k % 5 == 0, "no").otherwise("yes").alias("visa_sponsorship"), (F.col("p_size") % 8).alias("yoe_min"), F.when(k % 3 == 0, "contract").otherwise("full_time").alias("employment_type"), F.when(k % 4 == 0, "likely").otherwise("no").alias("cap_exempt"),
        F.when(k % 9 == 0, "hospital").otherwise("for_profit").alias("employer_type"),
    )
    refused, warnings = records.tailoring_gate(True)
    return rows.select("p_partkey", refused.alias("refused"), F.array_join(warnings, "|").alias("warnings"))


@query(r"""
WITH t AS (SELECT doc_id, lower(text) AS l, list_transform(regexp_extract_all(text, '\d[\d,\.]*'), lambda x: replace(x, ',', '')) AS known FROM documents),
n AS (SELECT *, list_filter(['1' || doc_id, '7', '12.5%', '3,000'], lambda x: length(replace(replace(rtrim(x, '%'), ',', ''), '.', '')) >= 2 AND NOT list_contains(known, replace(rtrim(x, '%'), ',', ''))) AS bad FROM t)
SELECT doc_id, concat_ws('|', CASE WHEN NOT contains(l, 'that') AND NOT contains(l, 'license') THEN 'Unverified employer: ''That Licence license''' END, CASE WHEN NOT contains(l, 'copyright') THEN 'Unverified degree: ''Copyright, BA''' END,
 nullif(array_to_string(list_transform(bad, lambda x: 'Unverified metric ''' || x || ''' in a bullet — confirm it.'), '|'), '')) AS warnings FROM n""".replace("NOT contains(l, 'that') AND NOT contains(l, 'license')", "NOT contains(l, 'that') AND NOT contains(l, 'licence') AND NOT contains(l, 'license')"))
def fabrication_audit(spark, d):
    """A made document about each text: entities of which no longer word is in the text, and numbers that it lacks."""
    bullets = F.array(F.concat(F.lit("Led 1"), "doc_id", F.lit(" and 7 people")), F.lit("Saved 12.5% of 3,000"))
    made = [("employer", F.lit("That Licence license")), ("title", F.lit("A to Z")), ("degree", F.lit("Copyright, BA"))]
    return read(spark, d, "documents").select("doc_id", F.array_join(records.ungrounded(made, bullets, F.col("text")), "|").alias("warnings"))


@query(r"SELECT page_id FROM pages WHERE lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) NOT IN (SELECT lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) FROM pages WHERE page_id % 10 = 0)")
def not_blocked(spark, d):
    pages = read(spark, d, "pages").select("page_id", "url")
    blocked = pages.where("page_id % 10 = 0").select(F.upper(F.regexp_extract("url", r"^[a-zA-Z]+://([^/?#:]*)", 1)).alias("host"))
    return records.not_blocked(pages, blocked).select("page_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, d):
    return records.point(read(spark, d, "orders"), o_orderkey=77).select("o_orderkey", "o_custkey")


@query(r"""SELECT p_partkey, upper(p_name[1]) || replace(p_name[2:], ' ', '_')[1:0] || array_to_string(list_transform(string_split(p_name, ' '), lambda w, i: CASE WHEN i = 1 THEN w[2:] ELSE ' ' || upper(w[1]) || w[2:] END), '') || CASE WHEN p_partkey % 2 = 0 THEN ' and AI' ELSE ' of SQL' END AS label,
 'A \& B\_\{' || p_partkey || '\}–\textbackslash{}' AS latex, p_partkey % 3 <> 0 AS junior, 'Jo_' || replace(p_name, ' ', '_') || '_Role_Resume.docx' AS file FROM part""")
def presented_names(spark, d):
    k = F.col("p_partkey")
    made = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(k % 2 == 0, "-and_ai").otherwise("_of-sql"))
    return read(spark, d, "part").select(
        "p_partkey", text.label(made).alias("label"), text.latex(F.concat(F.lit("A & B_{"), k, F.lit("}—\\"))).alias("latex"), text.junior_title(F.when(k % 3 == 0, "Data Engineer III").otherwise("Leader of Data")).alias("junior"), records.file_name(F.lit("Jo"), F.col("p_name"), F.lit("!")).alias("file")
    )


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-z]+'))"


@query(rf"""
WITH w AS (SELECT doc_id, text, {_TOKENS} AS t FROM documents), c AS (SELECT *, len(t) AS n, map_values(list_aggregate(t, 'histogram')) AS f FROM w),
g AS (SELECT *, len(f) AS v, list_zip(t[1:greatest(n - 1, 0)], t[2:n]) AS two, list_zip(t[1:greatest(n - 2, 0)], t[2:greatest(n - 1, 0)], t[3:n]) AS three FROM c)
SELECT doc_id, n AS token_count, coalesce(v, 0) AS type_count, round(coalesce(len(list_filter(f, lambda x: x = 1)) / nullif(v, 0), 0), 4) AS hapax_rate, round(coalesce(len(list_filter(f, lambda x: x = 2)) / nullif(v, 0), 0), 4) AS dis_legomena_rate,
 round(coalesce(v / sqrt(nullif(n, 0)), 0), 4) AS richness_index, round(coalesce(10000 * (list_sum(list_transform(f, lambda x: x * x)) - n)::DOUBLE / nullif(n::DOUBLE * n, 0), 0), 4) AS yule_k,
 round(coalesce(list_sum(list_transform(f, lambda x: -(x::DOUBLE / n) * log2(x::DOUBLE / n))), 0), 4) AS next_token_entropy, round(len(list_distinct(two)) / greatest(len(two), 1), 4) AS distinct_2, round(len(list_distinct(three)) / greatest(len(three), 1), 4) AS distinct_3,
 length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS char_count, round(coalesce((length(text) - length(regexp_replace(text, '\p{{Nd}}+', '', 'g'))) / nullif(length(text), 0), 0), 4) AS digit_ratio,
 round((length(text) - length(regexp_replace(text, '\p{{Lu}}+', '', 'g'))) / greatest(length(text) - length(regexp_replace(text, '\p{{L}}+', '', 'g')), 1), 4) AS capitalization_ratio,
 len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^ \t\n\r\f]'))) AS paragraph_count FROM g""")
def text_metrics_all(spark, d):
    fields = [*[f"lexical.{c}" for c in ("token_count", "type_count", "hapax_rate", "dis_legomena_rate", "richness_index", "yule_k")], *[f"repetition.{c}" for c in ("next_token_entropy", "distinct_2", "distinct_3")], "readability.char_count", "character.digit_ratio", "character.capitalization_ratio", "structure.paragraph_count"]
    return textmetrics.families(read(spark, d, "documents").select("doc_id", "text"), "text", fields).select("doc_id", *fields)


@query()
def text_risk(spark, d):
    """The parts that walk a text in order, and the composite over all of them."""
    fields = ["lexical.mtld", "lexical.maas_a2", "repetition.sent_4gram_overlap", "structure.structural_burstiness", "structure.sent_len_cv"]
    out = textmetrics.families(read(spark, d, "documents").select("doc_id", "text"), "text", [*fields, "composite"])
    return out.select("doc_id", *fields, "composite.ai_risk_score", "composite.band")


@query("""SELECT c_custkey AS id, count(o_orderkey) AS profiles FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def user_summaries(spark, d):
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    profiles = read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"))
    counters = read(spark, d, "events").select("user_id", F.lit("x").alias("metric"), F.date_format("ts", "yyyy-MM-dd").alias("period"), F.lit(1).alias("count"))
    return analytics.user_summary(users, profiles, counters, "2024-01-30", "2024-01-24", "2024-01-01").select("id", "profiles")
