"""The predicate language: one ``Filters`` gives one column expression, which Spark pushes to the scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from .provenance import DIRECT

MULTI = ["remote_mode", "visa_sponsorship", "source", "company_size_bucket", "employer_type", "security_clearance", "category", "employment_type"]
#: Experience bands: bounds of the years, and the levels that stand in where they are unknown.
BANDS = {"entry": (None, 2, ["intern", "junior"]), "mid": (3, 5, ["mid"]), "senior": (6, 10, ["senior"]), "lead": (11, None, ["staff", "lead", "principal", "manager", "director", "vp", "c_level"])}
SENIOR = ["senior", "staff", "lead", "principal", "manager", "director", "vp", "c_level"]


@dataclass
class Filters:
    any_of: dict[str, list[str]] = field(default_factory=dict)
    include_active: bool = False
    exclude_citizenship: bool = False
    exclude_recruiter: bool = False
    direct_sources_only: bool = False
    exclude_no_sponsorship: bool = False
    exclude_ghost: bool = False
    true_entry_only: bool = False
    new_grad_only: bool = False
    cap_exempt: list[str] = field(default_factory=list)
    known_h1b: bool = False
    known_everify: bool = False
    ingested_after: datetime | None = None
    experience: list[str] = field(default_factory=list)
    date_preset: str | None = None
    date_from: date | None = None
    date_to: date | None = None


def band(name: str, years: Column, level: Column) -> Column | None:
    if name not in BANDS:
        return None
    low, high, levels = BANDS[name]
    inside = F.lit(True)
    if low is not None:
        inside = inside & (years >= low)
    if high is not None:
        inside = inside & (years <= high)
    return inside | (years.isNull() & level.isin(levels))


def build(f: Filters, as_of: datetime) -> Column | None:
    """All clauses joined by AND, alternatives within one by OR; None if there are none."""
    c, out = F.col, []
    for name, values in f.any_of.items():
        if name not in MULTI:
            raise ValueError(f"no such filter: {name}")
        if values := [v for v in values if v]:
            out.append(c(name).isin(values))
    if f.include_active:
        out.append(~c("is_active").eqNullSafe(False))
    if f.exclude_citizenship:
        out.append(~c("citizenship_required"))
    if f.exclude_recruiter:
        out.append(~c("is_recruiter_post"))
    if f.direct_sources_only:
        out.append(c("source").isin(DIRECT))
    if f.exclude_no_sponsorship:
        out.append(c("visa_sponsorship").isin("yes", "unclear", "not_mentioned") & ~c("citizenship_required"))
    if f.exclude_ghost:
        out.append(c("posted_date") >= dates.back(as_of, 24 * dates.GHOST_HIGH))
    if f.true_entry_only:
        young = (c("yoe_min") <= 2) | (c("yoe_min").isNull() & c("seniority").isin("intern", "junior"))
        out.append(c("new_grad_program") | (young & ~c("seniority").isin(SENIOR)))
    if f.new_grad_only:
        out.append(c("new_grad_program"))
    positive = [x for x in (c("cap_exempt").isin(f.cap_exempt) if f.cap_exempt else None, c("known_h1b_sponsor") if f.known_h1b else None, c("known_everify") if f.known_everify else None) if x is not None]
    if positive:
        out.append(reduce(Column.__or__, positive))
    if f.ingested_after:
        out.append(c("ingested_at") > dates.moment(f.ingested_after))
    bands = [b for b in (band(name, c("yoe_min"), c("seniority")) for name in f.experience) if b is not None]
    if bands:
        out.append(reduce(Column.__or__, bands))
    if (when := dates.window_of(c("posted_date"), as_of, f.date_preset, f.date_from, f.date_to)) is not None:
        out.append(when)
    return reduce(Column.__and__, out) if out else None


def apply(rows: DataFrame, f: Filters, as_of: datetime) -> DataFrame:
    predicate = build(f, as_of)
    return rows if predicate is None else rows.where(predicate)


def without(rows: DataFrame, excluded: DataFrame, key: str = "job_id") -> DataFrame:
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def companies(rows: DataFrame, **equal: object) -> DataFrame:
    """The registry's filter: columns that equal a value; null and empty values ask for nothing."""
    for name, value in equal.items():
        if value is not None and value != "":
            rows = rows.where(F.col(name) == value)
    return rows
