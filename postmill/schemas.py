"""The canonical posting, and the small tables around it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "array<string>": T.ArrayType(T.StringType()), "array<float>": T.ArrayType(T.FloatType()),
}


def _schema(fields: str) -> T.StructType:
    """``name type, ...``; Spark's own parser needs a running session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(","))])


POSTING = _schema("""
job_id string, source string, source_job_id string, title string, company string, location_raw string, city string, country string, remote_mode string, description string, url string,
salary_min double, salary_max double, salary_currency string, posted_date timestamp, posted_date_est boolean, ingested_at timestamp, is_active boolean, last_seen_at timestamp, closed_at timestamp,
yoe_min int, yoe_max int, visa_sponsorship string, work_auth_required string, restrictions string, company_size_bucket string, skills array<string>, seniority string,
citizenship_required boolean, security_clearance string, known_h1b_sponsor boolean, known_everify boolean, is_recruiter_post boolean, eligibility_evidence array<string>,
employer_type string, cap_exempt string, new_grad_program boolean, category string, employment_type string, enrichment_status string, raw_payload string, embedding array<float>
""")
PROFILE = _schema("""
id string, label string, target_titles array<string>, interests array<string>, skills array<string>, resume_text string, seniority_max string, yoe_max int, needs_sponsorship boolean,
reject_clearance boolean, reject_citizenship_only boolean, countries array<string>, excluded_companies array<string>, remote_preference string, prefer_cap_exempt boolean
""")
TABLES = {name: _schema(ddl) for name, ddl in {
    "runs": "id string, source string, started_at timestamp, finished_at timestamp, count_ingested int, count_failed int, count_seen int, count_filtered int, count_closed int, error string, status string",
    "board_job_presence": "ats string, board_slug string, job_id string, first_seen timestamp, last_seen timestamp, closed_at timestamp",
    "job_sources": "job_id string, source string, url string, posted_date timestamp",
    "users": "id string, email string, display_name string, auth_provider string, auth_subject string, plan string, limits_json string, is_admin boolean, created_at timestamp",
    "user_profiles": "id string, label string, data string, user_id string",
    "user_job_state": "profile_id string, job_id string, status string, updated_at timestamp, note string",
    "companies": "ats string, slug string, name string, careers_url string, tier string, employer_type string, size_bucket string, known_h1b_sponsor boolean, cap_exempt_hint string, open_roles int, last_checked timestamp, enabled boolean, direct_apply_only boolean, region string, site string",
    "saved_searches": "id string, data string, user_id string",
    "meta": "key string, value string",
    "resumes": "id string, profile_id string, uploaded_at timestamp, data string",
    "tailored_resumes": "profile_id string, job_id string, created_at timestamp, data string",
    "deep_match_cache": "job_id string, profile_id string, fingerprint string, data string, created_at timestamp",
    "usage_counters": "user_id string, metric string, period string, count int",
}.items()}

#: What a null reads as.
DEFAULTS = {"remote_mode": "unknown", "visa_sponsorship": "not_mentioned", "seniority": "unclear", "security_clearance": "unclear", "employer_type": "unclear", "cap_exempt": "unknown", "category": "other", "employment_type": "full_time", "enrichment_status": "pending"}
FALSE_IF_NULL = ["posted_date_est", "citizenship_required", "known_h1b_sponsor", "known_everify", "is_recruiter_post", "new_grad_program"]
ENUMS = {
    "remote_mode": ["remote", "onsite", "hybrid", "unknown"],
    "visa_sponsorship": ["yes", "no", "unclear", "not_mentioned"],
    "seniority": ["intern", "junior", "mid", "senior", "staff", "lead", "principal", "manager", "director", "vp", "c_level", "unclear"],
    "security_clearance": ["required", "preferred", "none", "unclear"],
    "employer_type": ["university", "hospital", "nonprofit", "government", "for_profit", "unclear"],
    "company_size_bucket": ["1-50", "51-200", "201-500", "501-1000", "1001-5000", "5000+"],
    "run_status": ["running", "done", "failed", "interrupted"],
    "pipeline": ["applied", "oa", "interview", "offer", "rejected"],
}


def as_postings(rows: DataFrame, *more: str) -> DataFrame:
    """The canonical columns with their types, and ``more`` as they are: missing ones are null, empty strings null, nulls read as their defaults."""
    out: list[Column] = []
    for field in POSTING.fields:
        c = F.col(field.name).cast(field.dataType) if field.name in rows.columns else F.lit(None).cast(field.dataType)
        if isinstance(field.dataType, T.StringType):
            c = F.nullif(c, F.lit(""))
        if field.name in DEFAULTS:
            c = F.coalesce(c, F.lit(DEFAULTS[field.name]))
        elif field.name in FALSE_IF_NULL:
            c = F.coalesce(c, F.lit(False))
        elif field.name == "is_active":
            c = F.coalesce(c, F.lit(True))
        elif field.name in ("skills", "eligibility_evidence"):
            c = F.coalesce(c, F.array().cast("array<string>"))
        out.append(c.alias(field.name))
    return rows.select(*out, *more)
