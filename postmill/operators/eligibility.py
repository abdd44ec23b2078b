"""What a posting says about visas, citizenship, clearance and defence work, with the sentences that say it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import automaton, lists, text

EVIDENCE = 4
RULES = {"no sponsorship": lists.NO_SPONSORSHIP.removeprefix("(?i)"), "citizenship": lists.CITIZENSHIP.removeprefix("(?i)"), "clearance": lists.CLEARANCE.removeprefix("(?i)")}


def sentences(plain: Column) -> Column:
    return F.split(plain, r"(?<=[.!?])\s+|\n+")


def readable(raw: Column) -> Column:
    return F.regexp_replace(text.strip_tags(raw), r"(?i)\bu\.s\.", "US")


def told(raw: Column, limit: int | None = None) -> Column:
    """``evidence`` by one pass of an automaton; only sentences of texts that hold a word of some rule are looked at."""
    plain = readable(raw) if limit is None else F.left(readable(raw), F.lit(limit))
    return text.let(automaton.matching_sentences(plain, RULES), _summary)


def _summary(own: Column) -> Column:
    says = lambda rule: F.exists(own, lambda x: F.array_contains(x["rules"], rule))
    no, citizenship, clearance = RULES
    return F.struct(F.when(says(no), "no").alias("visa_sponsorship"), says(citizenship).alias("citizenship_required"), F.when(says(clearance), "required").alias("security_clearance"), F.slice(_snippets(F.transform(own, lambda x: x["s"])), 1, EVIDENCE).alias("evidence"))


def _snippets(own: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(own, lambda s: F.rtrim(F.left(text.squeeze(s), F.lit(240)))), lambda s: s != ""))


def evidence(raw: Column, limit: int | None = 20_000) -> Column:
    """``visa_sponsorship, citizenship_required, security_clearance, evidence`` of a text. Sentences are cut only in texts that match as a whole.

    Characters after ``limit`` are not read, as in the reference; None reads all.
    """
    plain = text.strip_tags(raw)
    plain = F.regexp_replace(plain if limit is None else F.left(plain, F.lit(limit)), r"(?i)\bu\.s\.", "US")
    has = lambda t, p: F.regexp_like(t, F.lit(p))
    every = [lists.NO_SPONSORSHIP, lists.CITIZENSHIP, lists.CLEARANCE]
    any_of = lambda s: has(s, every[0]) | has(s, every[1]) | has(s, every[2])
    said = text.let(plain, lambda t: F.when(any_of(t), F.filter(sentences(t), any_of)).otherwise(F.array().cast("array<string>")))
    return text.let(said, lambda own: F.struct(
        F.when(F.exists(own, lambda s: has(s, every[0])), "no").alias("visa_sponsorship"), F.exists(own, lambda s: has(s, every[1])).alias("citizenship_required"),
        F.when(F.exists(own, lambda s: has(s, every[2])), "required").alias("security_clearance"), F.slice(_snippets(own), 1, EVIDENCE).alias("evidence"),
    ))


def contractor(company: Column) -> Column:
    """What tells that a company is a listed defence contractor; else null."""
    name = text.squeeze(F.lower(text.empty(company)))
    return F.when(name.isin(lists.DEFENCE_COMPANIES), F.concat(F.lit("defense contractor ("), company, F.lit(")")))


def defence(title: Column, description: Column, company: Column) -> Column:
    """What tells of defence work: a listed company, or the words that match; else null."""
    hay = F.left(F.concat(text.empty(title), F.lit(" "), text.strip_tags(description)), F.lit(20_000))
    return F.coalesce(contractor(company), F.nullif(F.regexp_extract(hay, lists.DEFENCE_WORDS, 0), F.lit("")))
