"""What a source and its fields say of a posting: kind, authority, sponsorship, recruiters, computed columns."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

#: Sources by kind, the kinds' authority and labels, and words of entry levels.
PRIMARY = ["greenhouse", "lever", "ashby", "workable", "workday", "rippling", "recruitee", "smartrecruiters"]
KINDS = {"primary": PRIMARY, "government": ["usajobs"], "curated": ["simplify"], "scraper": ["jobspy"]}
AUTHORITY = {"primary": 0, "government": 0, "curated": 1, "aggregator": 2, "scraper": 3}
LABELS = {"primary": "Direct employer ATS", "government": "Official government board", "curated": "Curated new-grad feed (direct apply link)", "aggregator": "Discovery source", "scraper": "Scraped discovery source"}
DIRECT = [*PRIMARY, "usajobs", "simplify"]
#: Staffing companies and the words that tell of them.
STAFFING = ["adecco", "cybercoders", "insight global", "jobot", "kforce", "manpower", "manpowergroup", "motion recruitment", "randstad", "robert half", "teksystems"]
STAFFING_WORDS = r"(?i)\b(?:staffing|recruit(?:ing|ment)|talent solutions?|executive search|employment agency|placement services?|headhunt(?:ing|ers?)?|rpo)\b"
CLIENT_WORDS = r"(?i)\b(?:on behalf of (?:our|a|the) client|(?:our|a|the) client (?:is|has|seeks|is seeking|is looking)|(?:for|with) (?:one of )?our clients|client of ours|confidential client|direct client|end client)\b"
ENTRY_WORDS = ["junior", "entry level", "entry-level", "new grad", "new-grad", "associate"]


def kind(source: Column) -> Column:
    name, out = F.lower(F.trim(text.empty(source))), F.lit("aggregator")
    for label, sources in KINDS.items():
        out = F.when(name.isin(sources), F.lit(label)).otherwise(out)
    return out


def authority(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in AUTHORITY.items() for x in pair]), kind(source))


def label(source: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), kind(source))


def cap_exempt(employer_type: Column) -> Column:
    return F.when(employer_type.isin("university", "government", "nonprofit", "hospital"), "likely").when(employer_type == "for_profit", "no").otherwise("unknown")


def sponsorship(visa: Column, exempt: Column, citizenship: Column, known: Column) -> Column:
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(citizenship) | yes(visa == "no"), "no").when(yes(visa == "yes") | yes(known) | yes(exempt.isin("yes", "likely")), "likely").otherwise("unknown")


def recruiter(company: Column, source: Column, description: Column) -> Column:
    name = text.normalize_text(company)
    staffing = name.isin(STAFFING) | F.regexp_like(name, F.lit(STAFFING_WORDS))
    return kind(source).isin("aggregator", "scraper") | (F.trim(text.empty(company)) == "") | staffing | F.regexp_like(text.empty(description), F.lit(CLIENT_WORDS))


def mislabeled_entry(title: Column, seniority: Column, yoe: Column) -> Column:
    return F.coalesce(yoe >= 3, F.lit(False)) & (F.coalesce(seniority.isin("intern", "junior"), F.lit(False)) | text.contains_any(F.lower(text.empty(title)), ENTRY_WORDS))


def with_computed(postings: DataFrame, as_of: datetime) -> DataFrame:
    """The columns that follow from others and the moment ``as_of``; they are never stored."""
    c = F.col
    return postings.withColumns({
        "sponsorship_likelihood": sponsorship(c("visa_sponsorship"), c("cap_exempt"), c("citizenship_required"), c("known_h1b_sponsor")),
        "source_kind": kind(c("source")), "source_label": label(c("source")), "freshness_kind": dates.freshness_kind(c("source"), c("posted_date_est")),
        "posting_age_days": dates.age_days_or_null(c("posted_date"), as_of), "ghost_risk": dates.ghost_risk(c("posted_date"), as_of),
        "mislabeled_entry": mislabeled_entry(c("title"), c("seniority"), c("yoe_min")),
    })


def flag_listed(rows: DataFrame, names: DataFrame, company: str, flag: str) -> DataFrame:
    """Adds ``flag``: whether the normal form of ``company`` is in ``names`` (one column, ``name``, normalised and distinct)."""
    listed = names.select(F.col("name").alias("_name"))
    joined = rows.withColumn("_key", text.normalize_text(F.col(company))).join(listed, F.col("_key") == F.col("_name"), "left")
    return joined.withColumn(flag, F.col("_name").isNotNull()).drop("_key", "_name")
