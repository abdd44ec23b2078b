"""Queries of verdicts, skills and evidence. Their SQL has what the rules come to for the few titles, skills and texts that the stand-in postings have."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eligibility, search, skills, verdict
from ..sources import vendors
from .queries import OTHER, PROFILE, postings, query, read

_FACTS = """
p AS (SELECT p_partkey AS k, nullif(p_size % 7, 0)::INT AS yoe FROM part),
f AS (SELECT *, k % 8 AS t, CASE WHEN k % 6 = 1 THEN greatest(coalesce(yoe, 0), 4) ELSE yoe END AS y FROM p)"""


def _rejects(outside: str, family: str, level: str) -> str:
    return f"""list_filter([CASE WHEN t IN ({outside}) THEN 'Job title is outside the profile''s target roles' END, CASE WHEN k % 6 = 0 THEN 'Requires US citizenship / GC / ITAR eligibility' END,
 CASE WHEN k % 5 = 0 THEN 'Outside target countries (London, UK)' END, CASE WHEN y >= 5 THEN 'Requires ' || y || '+ years of experience' END, CASE WHEN y >= 4 THEN 'Requires ' || y || '+ years for a non-entry-level role' END,
 CASE WHEN t = 2 THEN 'Internship-only role' END, CASE t WHEN 4 THEN 'Manager role is above the {level} target' WHEN 7 THEN 'Director role is above the {level} target' END,
 CASE WHEN t IN ({family}) THEN 'Role family is outside the profile''s target roles' END], lambda x: x IS NOT NULL)"""


_VERDICTS = f"""
WITH {_FACTS}, r AS (SELECT *, {_rejects('2, 3, 4, 5, 7', '1, 3, 4, 5', 'mid')} AS rejects FROM f), v AS (SELECT k::VARCHAR AS job_id, CASE WHEN len(rejects) > 0 OR t = 6 THEN 'reject' ELSE 'apply' END AS verdict,
 (CASE WHEN len(rejects) > 0 THEN 0 WHEN t = 6 THEN 0.5 ELSE 0.823 END)::DOUBLE AS score,
 CASE WHEN len(rejects) > 0 THEN '' ELSE concat_ws('|', 'Title matches a target role', CASE WHEN t = 0 THEN 'Strong skill overlap with profile' END, CASE WHEN y IS NOT NULL THEN 'Experience requirement is within profile range' END, 'Seniority within target range') END AS reasons,
 CASE WHEN len(rejects) > 0 THEN array_to_string(rejects, '|') WHEN t = 6 THEN 'No verified overlap with the job''s technical skills' ELSE '' END AS red_flags,
 CASE WHEN len(rejects) = 0 AND t = 0 THEN 'Python|Postgres' ELSE '' END AS matched, CASE WHEN len(rejects) > 0 THEN '' WHEN t = 0 THEN 'Airflow' ELSE 'COBOL|SAP|Excel' END AS gaps, len(rejects) = 0 AND t = 0 AS recommendable FROM r)
"""


@query(_VERDICTS + "SELECT * FROM v")
def verdicts(spark, d):
    """The flagship: every posting judged under a profile."""
    text = [F.array_join(c, "|").alias(c) for c in ("reasons", "red_flags", "matched", "gaps")]
    return verdict.with_verdict(postings(spark, d), PROFILE).select("job_id", "verdict", "score", *text, "recommendable")


FITS = (
    _VERDICTS
    + f""", o AS (SELECT *, {_rejects('2, 3, 4, 5, 7', '0, 3, 4, 5, 6', 'senior')} AS rejects FROM f)
SELECT job_id, 'p1' AS profile_id, 'data' AS label, verdict, score, recommendable FROM v
UNION ALL SELECT k::VARCHAR, 'p2', 'software', CASE WHEN len(rejects) > 0 THEN 'reject' ELSE 'flag' END, (CASE WHEN len(rejects) > 0 THEN 0 ELSE 0.823 END)::DOUBLE, len(rejects) = 0 FROM o"""
)


@query(FITS)
def cross_profile_fit(spark, d):
    return verdict.profile_fits(postings(spark, d), [PROFILE, OTHER])


@query(_VERDICTS + "SELECT job_id, verdict, score, recommendable FROM v ORDER BY CASE verdict WHEN 'apply' THEN 0 ELSE 2 END, NOT recommendable, round(score * 100) DESC, job_id LIMIT 50")
def best_matches(spark, d):
    scored = verdict.with_verdict(postings(spark, d), PROFILE)
    return scored.orderBy(*verdict.match_order()).limit(50).select("job_id", "verdict", "score", "recommendable")


@query("""SELECT p_partkey::VARCHAR AS job_id, CASE p_partkey % 4 WHEN 0 THEN 'Python|Postgres' WHEN 1 THEN 'Machine Learning' ELSE '' END AS matched,
 CASE p_partkey % 4 WHEN 0 THEN 'Airflow' WHEN 1 THEN 'Java|k8s' ELSE 'COBOL|SAP|Excel' END AS gaps FROM part WHERE p_partkey % 4 < 3""")
def skill_overlap(spark, d):
    out = skills.overlap(postings(spark, d), PROFILE.skills)
    return out.select("job_id", *[F.array_join(c, "|").alias(c) for c in ("matched", "gaps")])


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'tensorflow' WHEN 1 THEN 'rag pipelines' WHEN 2 THEN 'cicd' ELSE 'tableau' END AS skill, p_partkey % 4 < 3 AS supported FROM part""")
def skill_aliases(spark, d):
    """Aliases, and skills that the profile's imply."""
    k = F.col("p_partkey") % 4
    raw = F.when(k == 0, "TF2").when(k == 1, "RAG").when(k == 2, "GitHub Actions").otherwise("Tableau")
    rows = read(spark, d, "part").withColumn("skill", skills.text.canonical_skill(raw))
    return rows.join(skills.supported(rows.select("skill").distinct(), ["tensorflow", "rag", "ci/cd"]), "skill").select("p_partkey", "skill", "supported")


@query("""SELECT p_partkey::VARCHAR AS job_id, CASE WHEN p_partkey % 8 IN (0, 6) AND p_partkey % 7 <> 0 THEN true ELSE p_partkey % 8 = 2 AND p_partkey % 7 <> 0 END AS fits FROM part""")
def candidate_gate(spark, d):
    """The cheap gate before enrichment, by family, level and clearance."""
    rows = postings(spark, d).withColumn("security_clearance", F.when(F.col("job_id").cast("long") % 7 == 0, "required").otherwise("none"))
    return rows.select("job_id", verdict.candidate(PROFILE).alias("fits"))


_HAY = r"regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '(?i)\bu\.s\.', 'US', 'g')"


@query(rf"""
WITH t AS (SELECT doc_id, regexp_split_to_array(regexp_replace({_HAY.replace('text', "text || ' ' || added")}, '([.!?])[ \t\n\r\f]+', '\1' || chr(10), 'g'), chr(10) || '+') AS s FROM (SELECT *, CASE doc_id % 4 WHEN 1 THEN 'Note. We cannot offer visa sponsorship here. ' WHEN 2 THEN 'Must be a U.S. citizen. Active security clearance required!' WHEN 3 THEN 'Export control rules apply.' ELSE '' END AS added FROM documents)),
m AS (SELECT doc_id, list_filter(s, lambda x: regexp_matches(x, $n$__NO__$n$)) AS no, list_filter(s, lambda x: regexp_matches(x, $n$__CITIZEN__$n$)) AS citizen, list_filter(s, lambda x: regexp_matches(x, $n$__CLEAR__$n$)) AS clear FROM t)
SELECT doc_id, CASE WHEN len(no) > 0 THEN 'no' END AS visa_sponsorship, len(citizen) > 0 AS citizenship_required, CASE WHEN len(clear) > 0 THEN 'required' END AS security_clearance, least(4, len(list_distinct(list_concat(list_concat(no, citizen), clear))))::INT AS sentences FROM m
""".replace("__NO__", eligibility.lists.NO_SPONSORSHIP).replace("__CITIZEN__", eligibility.lists.CITIZENSHIP).replace("__CLEAR__", eligibility.lists.CLEARANCE))
def eligibility_scan(spark, d):
    """Whole texts, to some of which a statement is added."""
    k = F.col("doc_id") % 4
    added = F.when(k == 1, "Note. We cannot offer visa sponsorship here. ").when(k == 2, "Must be a U.S. citizen. Active security clearance required!").when(k == 3, "Export control rules apply.").otherwise("")
    return read(spark, d, "documents").select("doc_id", eligibility.told(F.concat_ws(" ", "text", added)).alias("s")).select("doc_id", "s.visa_sponsorship", "s.citizenship_required", "s.security_clearance", F.size("s.evidence").alias("sentences"))


@query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
n AS (SELECT p_partkey, round(greatest(0, least(1, (1 + list_cosine_similarity(embedding::DOUBLE[], v)) / 2)), 6) AS similarity FROM part JOIN embeddings ON vec_id = p_partkey, q WHERE p_partkey % 11 <> 0 AND p_partkey % 13 <> 0 ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, p_partkey::VARCHAR LIMIT 40)
SELECT p_partkey::VARCHAR AS job_id, similarity FROM n WHERE p_partkey % 3 <> 0""")
def resume_matches(spark, d):
    """The nearest active postings to a résumé that don't ask for citizenship, without those excluded."""
    k = F.col("job_id").cast("long")
    vectors = read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("job_id"), F.col("embedding").alias("vector"))
    rows = postings(spark, d).withColumns({"is_active": k % 11 != 0, "citizenship_required": k % 13 == 0}).join(vectors, "job_id")
    query_vector = [float(x) for x in vectors.where("job_id = '0'").first().vector]
    found = search.resume_to_jobs(rows, "vector", query_vector, 40, PROFILE, rows.where(k % 3 == 0))
    return found.select("job_id", F.round("similarity", 6).alias("similarity"))


#: By vendor: an item of its payload over k, t and u (number, title, address), what stands around the items, and what it gives beside the defaults.
_LANDED: dict[str, tuple[str, str, dict[str, str]]] = {
    "greenhouse": ("'id', k, 'title', t, 'absolute_url', u, 'location', named_struct('name', 'Austin, TX'), 'content', '&lt;p&gt;d&lt;/p&gt;', 'updated_at', '2024-01-02'", "jobs", {"description": "'<p>d</p>'"}),
    "lever": ("'id', k, 'text', t, 'hostedUrl', u, 'createdAt', 1704153600000, 'descriptionPlain', 'd', 'categories', named_struct('location', 'Remote US')", "", {"location": "'Remote US'", "remote": "'remote'", "posted_date": "'2024-01-02 00:00:00'"}),
    "ashby": ("'id', k, 'title', t, 'jobUrl', u, 'isListed', k % 2 = 0, 'publishedAt', '2024-01-02', 'location', 'Austin, TX', 'descriptionPlain', 'd', 'isRemote', true", "jobs", {"company": "board", "remote": "'remote'", "where": "k % 2 = 0"}),
    "workday": ("'title', t, 'externalPath', concat('/job/x/', k), 'locationsText', 'Austin, TX', 'postedOn', '2024-01-02', 'bulletFields', array(cast(k as string))", "jobPostings", {"url": "'https://' || board || '/job/x/' || k", "description": "NULL"}),
    "workable": ("'title', t, 'url', u, 'shortcode', k, 'published_on', '2024-01-02', 'description', 'd', 'city', 'Austin', 'state', 'TX', 'telecommuting', true", "jobs", {"location": "'Austin, TX'", "remote": "'remote'"}),
    "rippling": ("'uuid', k, 'name', t, 'url', u, 'workLocation', named_struct('label', 'Austin, TX')", "", {"company": "board", "description": "NULL", "posted_date": "NULL"}),
    "recruitee": ("'id', k, 'title', t, 'created_at', '2024-01-02 UTC', 'careers_url', u, 'description', 'd', 'requirements', 'e', 'city', 'Austin', 'country', 'TX'", "offers", {"description": "'d' || chr(10) || chr(10) || 'e'"}),
    "smartrecruiters": ("'id', cast(k as string), 'name', t, 'releasedDate', '2024-01-02', 'company', named_struct('name', 'Co'), 'location', named_struct('city', 'Austin', 'region', 'TX')", "content", {"company": "'Co'", "url": "'https://jobs.smartrecruiters.com/' || board || '/' || k", "description": "NULL"}),
    "usajobs": ("'MatchedObjectId', k, 'MatchedObjectDescriptor', named_struct('PositionTitle', t, 'PositionURI', u, 'DepartmentName', 'Dept', 'PositionLocationDisplay', 'Austin, TX', 'QualificationSummary', if(k % 2 = 0, 'd', 'U.S. citizens only'), 'PublicationStartDate', '2024-01-02')", "SearchResultItems", {"company": "'Dept'", "where": "k % 2 = 0"}),
    "simplify": ("'id', k, 'company_name', ' Co ', 'title', t, 'locations', array('Austin, TX', ''), 'url', u, 'active', true, 'sponsorship', if(k % 2 = 0, 'Other', 'Does Not Offer Sponsorship'), 'date_posted', 1704153600", "", {"company": "'Co'", "description": "NULL", "posted_date": "'2024-01-02 00:00:00'", "where": "k % 2 = 0"}),
    "adzuna": ("'id', k, 'title', t, 'redirect_url', u, 'company', named_struct('display_name', 'Co'), 'location', named_struct('display_name', 'Austin, TX'), 'created', '2024-01-02', 'description', 'd'", "results", {"company": "'Co'"}),
    "remotive": ("'id', k, 'url', u, 'title', t, 'company_name', 'Co', 'publication_date', '2024-01-02', 'candidate_required_location', 'Austin, TX', 'description', 'd'", "jobs", {"company": "'Co'", "remote": "'remote'"}),
    "arbeitnow": ("'slug', k, 'title', t, 'company_name', 'Co', 'description', 'd', 'remote', true, 'url', u, 'location', 'Austin, TX', 'created_at', 1704153600", "data", {"company": "'Co'", "remote": "'remote'", "posted_date": "'2024-01-02 00:00:00'"}),
    "jobicy": ("'id', k, 'url', u, 'jobTitle', concat(t, ' &amp; more'), 'companyName', 'Co', 'jobGeo', 'Austin, TX', 'jobExcerpt', 'd', 'pubDate', '2024-01-02'", "jobs", {"title": "t || ' & more'", "company": "'Co'", "remote": "'remote'"}),
    "remoteok": ("'id', if(k % 2 = 0, k, null), 'position', t, 'company', 'Co', 'location', 'Austin, TX', 'description', 'd', 'url', u, 'date', '2024-01-02'", "", {"company": "'Co'", "remote": "'remote'", "where": "k % 2 = 0"}),
    "workingnomads": ("'url', concat(u, '/'), 'title', t, 'description', 'd', 'company_name', 'Co', 'location', 'Austin, TX', 'pub_date', '2024-01-02'", "", {"url": "u || '/'", "company": "'Co'", "remote": "'remote'"}),
    "themuse": ("'id', k, 'name', t, 'company', named_struct('name', 'Co'), 'locations', array(named_struct('name', 'Flexible'), named_struct('name', 'Austin, TX')), 'contents', 'd', 'refs', named_struct('landing_page', u), 'publication_date', '2024-01-02'", "results", {"company": "'Co'", "location": "'Flexible; Austin, TX'", "remote": "'remote'"}),
    "himalayas": ("'title', t, 'applicationLink', u, 'companyName', 'Co', 'pubDate', 1704153600, 'guid', k, 'description', 'd'", "jobs", {"company": "'Co'", "location": "'Remote'", "remote": "'remote'", "posted_date": "'2024-01-02 00:00:00'"}),
    "jobrightai": ("'jobResult', named_struct('jobId', k, 'jobTitle', t, 'applyLink', u, 'publishTime', '2024-01-02', 'jobLocation', 'Austin, TX', 'workModel', 'Hybrid', 'jobSummary', ' d '), 'companyResult', named_struct('companyName', 'Co')", "jobList", {"company": "'Co'", "remote": "'hybrid'"}),
    "jobspy": ("'job_url', u, 'title', t, 'company', 'Co', 'location', 'Austin, TX', 'is_remote', true, 'description', repeat('d', 300), 'date_posted', '2024-01-02'", "", {"source_job_id": "NULL", "company": "'Co'", "description": "repeat('d', 280)", "remote": "'remote'"}),
}
_GIVES = {"source_job_id": "k::VARCHAR", "title": "t", "company": "'Acme ' || b", "url": "u", "description": "'d'", "location": "'Austin, TX'", "posted_date": "'2024-01-02'", "remote": "NULL"}


def _given(vendor: str) -> str:
    own = _GIVES | _LANDED[vendor][2]
    where = own.pop("where", "true")
    return f"SELECT '{vendor}' AS source, " + ", ".join(f"({v})::VARCHAR AS {k}" for k, v in own.items()) + f" FROM s WHERE {where}"


@query("WITH s AS (SELECT s_suppkey AS k, s_nationkey AS b, 'board' || s_nationkey AS board, 'Data Engineer ' || s_suppkey AS t, 'https://x/' || s_suppkey AS u FROM supplier) " + " UNION ALL ".join(map(_given, _LANDED)))
def landed_payloads(spark, d):
    """Suppliers as postings in the payloads of every vendor, a board for each nation."""
    base = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("b"), F.concat(F.lit("Data Engineer "), "s_suppkey").alias("t"), F.concat(F.lit("https://x/"), "s_suppkey").alias("u"))
    out = None
    for vendor, (item, around, _) in _LANDED.items():
        body = F.to_json(F.collect_list(F.expr(f"named_struct({item})")))
        if around:
            body = F.concat(F.lit(f'{{"{around}":'), body, F.lit("}"))
        if vendor == "usajobs":
            body = F.concat(F.lit('{"SearchResult":'), body, F.lit("}"))
        boards = base.groupBy("b").agg(body.alias("payload"))
        payloads = boards.select(F.concat(F.lit("board"), "b").alias("board"), F.concat(F.lit("Acme "), "b").alias("name"), F.lit(None).cast("string").alias("employer_type"), F.lit("us").alias("country"), "payload")
        found = vendors.parse(vendor, payloads, keywords=["data engineer"]).select("source", *_GIVES)
        out = found if out is None else out.unionByName(found)
    return out
