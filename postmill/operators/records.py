"""A user's records: pipelines, states, imports, saved searches, profile edits, tailored documents, and figures over them all."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from . import filters, provenance

#: The columns that companies may be ordered by, the first by default, and the orders of the other lists.
COMPANY_ORDERS = ["open_roles", "last_checked", "name", "tier"]
LIST_ORDERS = {
    "runs": [("started_at", "desc")], "users": [("created_at", "asc")], "user_profiles": [("label", "asc")], "resumes": [("uploaded_at", "desc")], "tailored_resumes": [("created_at", "desc")],
    "pipeline": [("updated_at", "desc")], "user_job_state": [("updated_at", "desc")], "saved_searches": [("created_at", "desc")],
}
#: Windows that count as stale, hours between two refills of a profile, and refills at a time.
STALE, COOLDOWN_HOURS, MOST_IN_FLIGHT = ["7d", "14d", "21d", "1m"], 6, 2
#: What a tailored document can't be written for, and what it warns of.
BLOCKED_WORK = r"(?i)\b(?:itar|ear|export control|u\.?s\.? person|citizen(?:ship)?|green card|required clearance|security clearance)\b"
EXEMPT_EMPLOYERS = ["university", "hospital", "nonprofit", "government"]


def tracked(pipeline: DataFrame, postings: DataFrame) -> DataFrame:
    """A pipeline's rows with the source and its kind; rows whose posting is gone stay, with a null source, for the funnel."""
    known = postings.select("job_id", "source")
    joined = pipeline.join(known, "job_id", "left")
    return joined.withColumn("source_kind", provenance.kind(F.col("source")))


def in_state(states: DataFrame, postings: DataFrame, profile_id: object, status: str) -> DataFrame:
    """The postings that a profile has in a state, with ``updated_at``, the latest first."""
    own = states.where((F.col("profile_id") == profile_id) & (F.col("status") == status)).select("job_id", "updated_at")
    return own.join(postings, "job_id").orderBy(F.col("updated_at").desc(), "job_id")


def applied_import(rows: DataFrame, postings: DataFrame) -> DataFrame:
    """Adds ``job_id`` to imported ``company, title, url``: the posting of that address, else the one that has the id of company and title; null for none."""
    by_url = postings.where("url <> ''").groupBy(F.col("url").alias("_url")).agg(F.min("job_id").alias("_by_url"))
    ids = postings.select(F.col("job_id").alias("_by_id")).distinct()
    named = F.when((F.col("company") != "") & (F.col("title") != ""), text.posting_id(F.col("company"), F.col("title"), F.lit(None).cast("string")))
    joined = rows.join(by_url, F.col("url") == F.col("_url"), "left").withColumn("_named", named).join(ids, F.col("_named") == F.col("_by_id"), "left")
    return joined.withColumn("job_id", F.coalesce("_by_url", "_by_id")).drop("_url", "_by_url", "_named", "_by_id")


def saved_counts(postings: DataFrame, searches: dict[str, filters.Filters], last_seen: dict[str, datetime | None], as_of: datetime) -> DataFrame:
    """``search_id, total, new_count``: a user's saved searches, all counted in one pass; new are postings ingested after the search was last seen, all if it never was."""
    counts = []
    for name, f in searches.items():
        match, seen = filters.build(f, as_of), last_seen.get(name)
        match = F.lit(True) if match is None else match
        fresh = match & (F.col("ingested_at") > dates.moment(seen)) if seen else match
        counts.append(F.struct(F.lit(name).alias("search_id"), F.count_if(match).alias("total"), F.count_if(fresh).alias("new_count")))
    return postings.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def needs_refill(total: Column, window: Column, target: Column, last_started: Column, in_flight: Column, as_of: datetime | Column) -> Column:
    """Whether a profile's list is to be refilled: too few results or a stale window, the cool-down over and a place free."""
    wanted = (total < F.coalesce(target, F.lit(5))) | F.coalesce(window.isin(STALE), F.lit(False))
    rested = last_started.isNull() | (dates.moment(as_of) - F.expr(f"interval {COOLDOWN_HOURS} hours") >= last_started)
    return wanted & rested & (in_flight < MOST_IN_FLIGHT)


def free_name(name: Column, taken: Column) -> Column:
    """The name, or with the first number from 2 that none of an array has."""
    tries = F.transform(F.sequence(F.lit(1), F.size(taken) + 1), lambda n: text.numbered_names(name, n))
    return F.element_at(F.filter(tries, lambda x: ~F.array_contains(taken, x)), 1)


def _free_labels(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Edits with their ``_user_id`` and ``_label``: a changed ``label`` that another profile of the owner has gets the first number that none has.

    Labels are counted by owner and name, and of each name's numbers the first gap is found once, so nothing grows with an owner's profiles but what is shuffled.
    """
    held = stored.where("label IS NOT NULL").groupBy(F.col("user_id").alias("_owner"), F.col("label").alias("_held")).agg(F.count("*").alias("_many"))
    own = held.select(F.col("_owner").alias("_of"), F.col("_held").alias("_mine"), F.col("_many").alias("_own_many"))
    numbered = held.select("_owner", *_numbered("_held", "_its_")).where("_its_turn >= 2")
    run = numbered.withColumn("_at", F.row_number().over(Window.partitionBy("_owner", "_its_base", "_its_extension").orderBy("_its_turn")) + 1)
    gaps = run.groupBy("_owner", "_its_base", "_its_extension").agg((F.max(F.when(F.col("_its_turn") == F.col("_at"), F.col("_at"))) + 1).alias("_gap")).withColumnRenamed("_owner", "_whose")

    base, extension = text.name_parts(F.col("label"))
    rows = rows.withColumns({"_base": base, "_extension": extension}).select("*", *_numbered("_label", "_had_"))
    rows = rows.join(held, F.col("_user_id").eqNullSafe(F.col("_owner")) & (F.col("label") == F.col("_held")), "left").join(own, F.col("_user_id").eqNullSafe(F.col("_of")) & (F.col("_label") == F.col("_mine")), "left")
    rows = rows.join(gaps, F.col("_user_id").eqNullSafe(F.col("_whose")) & (F.col("_base") == F.col("_its_base")) & (F.col("_extension") == F.col("_its_extension")), "left")
    left = F.when((F.col("_own_many") == 1) & (F.col("_had_base") == F.col("_base")) & (F.col("_had_extension") == F.col("_extension")) & (F.col("_had_turn") >= 2), F.col("_had_turn"))  # its own number is free again
    free = F.when(F.col("_many") > 0, text.numbered_names(F.col("label"), F.least(F.coalesce("_gap", F.lit(2)), left))).otherwise(F.col("label"))
    rows = rows.withColumn("label", F.when(F.col("label").eqNullSafe(F.col("_label")), F.col("label")).otherwise(free))
    return rows.drop("_base", "_extension", "_had_base", "_had_turn", "_had_extension", "_owner", "_held", "_many", "_of", "_mine", "_own_many", "_whose", "_its_base", "_its_extension", "_gap")


def _numbered(name: str, prefix: str) -> list[Column]:
    """What ``text.numbered_names`` made a name of: base, turn and extension; the turn is null if it made none."""
    part = lambda k: F.regexp_extract(name, r"(?s)\A(.*) \(([1-9][0-9]{0,8})\)(\.[A-Za-z0-9]{1,5})?\z", k)
    return [part(1).alias(f"{prefix}base"), F.nullif(part(2), F.lit("")).cast("int").alias(f"{prefix}turn"), part(3).alias(f"{prefix}extension")]


def update_profiles(stored: DataFrame, edits: DataFrame, derive, compose_structured, compose_sections) -> DataFrame:
    """Stored profiles after edits of equal ``id``; both have ``id, user_id, label, resume_text, structured_resume, resume_sections, structured_stale, resume_filename, resume_content_type, resume_uploaded_at``.

    A structured edit comes before a section edit, that before an edit of the raw text; what an edit leaves null keeps its stored value, owner and
    id always do. Sections that equal what the stored text derives to are no edit. A label that another profile of the owner
    has gets a number. ``derive`` makes sections of a text, ``compose_*`` a text of either kind of sections; all take and give columns.
    """
    same = lambda a, b: a.eqNullSafe(b)
    old = stored.select(F.col("id"), *[F.col(c).alias(f"_{c}") for c in stored.columns if c != "id"])
    rows = _free_labels(edits.drop("user_id").join(old, "id").withColumn("label", F.coalesce("label", "_label")), stored)
    rows = rows.withColumn("_new", F.coalesce("resume_text", "_resume_text")).withColumn("_derived", derive(text.empty(F.col("_resume_text"))))
    structured = F.col("structured_resume").isNotNull() & ~same(F.col("structured_resume"), F.col("_structured_resume"))
    given = F.col("resume_sections").isNotNull() & ~same(F.col("resume_sections"), F.col("_resume_sections")) & ~same(F.col("resume_sections"), F.col("_derived"))
    unchanged = same(F.col("_new"), F.col("_resume_text"))
    rows = rows.withColumns({"_structured": structured, "_given": given & unchanged, "_raw": ~unchanged})
    kept = F.coalesce("structured_resume", "_structured_resume")
    body = F.when(F.col("_structured"), compose_structured(F.col("structured_resume"))).when(F.col("_given"), compose_sections(F.col("resume_sections"))).otherwise(F.col("_new"))
    rows = rows.withColumn("_body", body)
    sections = F.when(F.col("_structured"), derive(F.col("_body"))).when(F.col("_given"), F.col("resume_sections")).when(F.col("_raw"), derive(text.empty(F.col("_body")))).otherwise(F.coalesce("resume_sections", "_resume_sections", derive(text.empty(F.col("_body")))))
    stale = F.when(F.col("_structured"), False).when(F.col("_raw") & ~F.col("_given") & kept.isNotNull(), True).otherwise(F.coalesce("structured_stale", "_structured_stale"))
    made = {"user_id": F.col("_user_id"), "resume_text": F.col("_body"), "structured_resume": kept, "resume_sections": sections, "structured_stale": stale}
    made |= {c: F.coalesce(c, f"_{c}") for c in ("resume_filename", "resume_content_type", "resume_uploaded_at")}
    changed = rows.select(*[made.get(c, F.col(c)).alias(c) for c in stored.columns])
    return stored.join(edits.select("id"), "id", "left_anti").select(*stored.columns).unionByName(changed)


def tailored_list(tailored: DataFrame, postings: DataFrame, fingerprint: Column) -> DataFrame:
    """Tailored documents with ``up_to_date`` and a ``filename``, the latest first. ``fingerprint`` is of a posting's columns; without a posting, or a stored fingerprint, a document counts as up to date."""
    now = postings.select(F.col("job_id").alias("_job"), fingerprint.alias("_now"), file_name(F.lit("Candidate"), F.col("company"), F.col("title")).alias("_name"))
    joined = tailored.join(now, F.col("job_id") == F.col("_job"), "left")
    current = F.coalesce(F.nullif("fingerprint", F.lit("")) == F.col("_now"), F.lit(True))
    named = F.coalesce(F.nullif("filename", F.lit("")), "_name", F.lit(""))
    return joined.withColumns({"up_to_date": current, "filename": named}).drop("_job", "_now", "_name").orderBy(F.col("created_at").desc(), "job_id")


def file_name(owner: Column, company: Column, role: Column) -> Column:
    part = lambda c, other: F.coalesce(F.nullif(F.trim(F.regexp_replace(text.empty(c), r"[^A-Za-z0-9]+", "_"), F.lit("_")), F.lit("")), F.lit(other))
    stem = F.concat_ws("_", part(owner, "Resume"), part(company, "Company"), part(role, "Role"), F.lit("Resume"))
    return F.concat(F.rtrim(F.left(stem, F.lit(175)), F.lit("_")), F.lit(".docx"))


def tailored_order(risk: str = "ai_risk_after") -> list[Column]:
    """The least risk first; an unknown one counts as 999."""
    return [F.coalesce(risk, F.lit(999)).asc(), F.col("job_id")]


def top_changes(deltas: DataFrame, most: int = 6) -> DataFrame:
    """``metric, delta, direction``: the metrics that a document moved most, the better ones first."""
    moved = deltas.where("direction <> 'neutral' and metric <> 'ai_risk_score'")
    return moved.orderBy(F.when(F.col("direction") == "better", 0).otherwise(1), F.abs(F.coalesce("delta", F.lit(0.0))).desc(), "metric").limit(most)


def patch_longer(postings: DataFrame, found: DataFrame, keys: list[str], column: str = "description") -> DataFrame:
    """Postings in which a longer text of equal ``keys`` replaces a shorter one; of several the longest, of equally long ones the least."""
    longest = found.groupBy(*keys).agg(F.min_by(column, F.struct(F.negative(F.length(column)), column)).alias("_found"))
    joined = postings.join(longest, keys, "left")
    longer = F.coalesce(F.length("_found") > F.length(text.empty(F.col(column))), F.lit(False))
    return joined.withColumn(column, F.when(longer, F.col("_found")).otherwise(F.col(column))).select(*postings.columns)


def deployment(users: DataFrame, counters: DataFrame, since: str) -> DataFrame:
    """``metric, total`` of known users' usage since a period, and a row ``users`` with their number. Storage is outside the engine."""
    own = counters.where(F.col("period") >= since).join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
    return own.groupBy("metric").agg(F.sum("count").alias("total")).unionByName(users.agg(F.lit("users").alias("metric"), F.count("*").alias("total")))


def open_roles(postings: DataFrame) -> DataFrame:
    """Open postings by the lower-cased name of their company."""
    return postings.where("company <> ''").groupBy(F.lower("company").alias("company")).agg(F.count("*").alias("open_roles"))


def company_order(name: str | None = None) -> list[Column]:
    """Companies by one of the columns that may be asked for; names upwards, all else downwards, nulls last."""
    name = name if name in COMPANY_ORDERS else COMPANY_ORDERS[0]
    return [F.col(name).asc_nulls_last() if name == "name" else F.col(name).desc_nulls_last(), F.col("ats"), F.col("slug")]


def listed(rows: DataFrame, table: str, *ties: str, most: int | None = None) -> DataFrame:
    """A table in the order of its list; ``ties`` settle equal rows."""
    by = [F.col(c).desc() if way == "desc" else F.col(c).asc() for c, way in LIST_ORDERS[table]]
    out = rows.orderBy(*by, *ties)
    return out if most is None else out.limit(most)


def tailoring_gate(needs_sponsorship: bool) -> tuple[Column, Column]:
    """Of a posting: why no document may be tailored to it, null if one may, and what to warn of."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    abroad = (F.trim(text.empty(c("country"))) != "") & ~F.lower(F.trim("country")).isin("us", "usa", "united states", "united states of america")
    said = F.concat_ws(" ", F.nullif("work_auth_required", F.lit("")), F.nullif("restrictions", F.lit("")), F.nullif("description", F.lit("")))
    bound = yes(c("citizenship_required")) | yes(c("security_clearance") == "required") | F.regexp_like(said, F.lit(BLOCKED_WORK))
    refused = (
        F.when(abroad, "This tailored-resume workflow is restricted to US-based roles.").when(bound, "This role has a citizenship, clearance, ITAR/EAR, or export-control requirement.")
        .when(F.lit(needs_sponsorship) & yes(c("visa_sponsorship") == "no"), "This role explicitly does not sponsor work authorization.").when(yes(c("yoe_min") >= 5), "This role requires 5+ years of experience and fails the early-career gate.")
    )
    warnings = F.array(
        F.when(yes(c("yoe_min") >= 2), F.concat(F.lit("Reach role: the posting asks for "), c("yoe_min"), F.lit("+ years; document stays honest."))),
        F.when(yes(c("employment_type").isin("contract", "temporary")), "Contract/temporary role: confirm OPT employment eligibility with your DSO before accepting."),
        F.when(yes(c("cap_exempt").isin("yes", "likely")) | yes(c("employer_type").isin(EXEMPT_EMPLOYERS)), "Cap-exempt or likely cap-exempt employer: prioritize this role if the posting allows sponsorship."),
    )
    return refused, F.array_compact(warnings.cast("array<string>"))


def ungrounded(entities: list[tuple[str, Column]], bullets: Column, source: Column, most: int = 12) -> Column:
    """Warnings of what a made document says and its source doesn't: entities of which no longer word is in it, and numbers of two digits or more.

    ``entities``: kind, and the column that holds it, in the document's order; ``bullets`` is an array of texts.
    """
    hay, digits = F.lower(text.empty(source)), F.lit(r"(\d[\d,\.]*)")
    known = F.transform(F.regexp_extract_all(text.empty(source), digits, 1), lambda x: F.replace(x, F.lit(","), F.lit("")))
    numbers = F.flatten(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), lambda b: F.regexp_extract_all(b, F.lit(r"(\d[\d,\.]*%?)"), 1)))
    norm = lambda x: F.replace(F.rtrim(x, F.lit("%")), F.lit(","), F.lit(""))
    made = F.filter(numbers, lambda x: (F.length(F.replace(norm(x), F.lit("."), F.lit(""))) >= 2) & ~F.array_contains(known, norm(x)))
    flags = []
    for kind, value in entities:
        words = F.regexp_extract_all(F.lower(text.empty(value)), F.lit(r"([a-z]{4,})"), 1)
        flags.append(F.when((F.size(words) > 0) & ~F.exists(words, lambda w: F.contains(hay, w)), F.concat(F.lit(f"Unverified {kind}: '"), value, F.lit("'"))))
    metric = F.transform(made, lambda x: F.concat(F.lit("Unverified metric '"), x, F.lit("' in a bullet — confirm it.")))
    return F.slice(F.concat(F.array_compact(F.array(*flags).cast("array<string>")), metric), 1, most)


def not_blocked(rows: DataFrame, blocked: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose address is on no blocked ``host``, in whatever case."""
    host = F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    hosts = blocked.select(F.lower(F.trim("host")).alias("_host")).where("_host <> ''").distinct()
    return rows.join(hosts, host == F.col("_host"), "left_anti")


def point(rows: DataFrame, **equal: object) -> DataFrame:
    """The row of an id or an address; the scan skips files and row groups that can't hold it."""
    return rows.where(reduce(Column.__and__, [F.col(k) == v for k, v in equal.items()])).limit(1)
