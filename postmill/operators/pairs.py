"""The verdicts of many postings under many profiles at once: the rules of ``verdict``, for a block of profiles as arrays.

As columns, the rules take some tenths of a millisecond a pair. Here what differs little among profiles (their roles, interests, countries and so on) is decided once for each distinct
value and posting, and the rest is arithmetic on arrays of pairs. ``facts`` are the columns of a posting that ``Block.judge`` reads; pairs that a hard rule rejects are left out,
so their texts aren't made. A test holds both forms of the rules against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Hashable, Iterable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lists
from .verdict import APPLY, RANK, STAGES, WEIGHTS, YEARS_CAP, _years_for

#: Pairs that are judged at once, values of postings under distinct lists of profiles that are held for these, and values of each kind that are kept.
PAIRS, VALUES, KEPT = 200_000, 4_000_000, 256
_NEVER, _ANY = -(10**6), 10**6
_FALSE = lambda x: f"coalesce({x}, false)"
#: What holds of a posting under every profile, as expressions over the columns of ``verdict.with_facts``.
FACTS = {
    "_name": "_name", "_firsts": "_firsts", "_words": "_words", "_families": "_families", "_abroad": _FALSE("NOT _us"), "_in": "CASE WHEN country <> '' THEN lower(trim(country)) END", "_no_visa": _FALSE("visa_sponsorship = 'no' OR _said.visa_sponsorship = 'no'"),
    "_cleared": _FALSE("security_clearance = 'required' OR _said.security_clearance = 'required'"), "_citizens": _FALSE("citizenship_required OR _said.citizenship_required"), "_years": "array(" + ", ".join(f"greatest(yoe_min, {_years_for(d)})" for d in ("cast(null AS int)", "1", "2", "3")) + ")",
    "_new_grad": _FALSE("new_grad_program"), "_early": _FALSE("seniority IN ('intern', 'junior')"), "_shown_early": _FALSE("_shown IN ('intern', 'junior')"), "_level": STAGES[0]["_level"], "_by": "lower(trim(company))", "_defence": "_defence", "_care": "map_contains_key(_hits, 'care')",
    "_special": "filter(array(" + ", ".join(f"'{x}'" for x in lists.SPECIALTIES) + "), x -> map_contains_key(_hits, concat('specialty:', x)))", "_many": "size(_listed)", "_loose": "slice(array_sort(array_distinct(transform(_listed, s -> s.raw))), 1, 8)",
    "_interests": "_interests", "_interest_words": "_interest_words", "_named": "_named", "_mode": "remote_mode", "_unread": _FALSE("enrichment_status IN ('pending', 'failed')"), "_silent": _FALSE("visa_sponsorship IN ('not_mentioned', 'unclear')"),
    "_exempt": STAGES[2]["_exempt"], "_h1b": _FALSE("known_h1b_sponsor"), "_recruits": _FALSE("is_recruiter_post"), "_employer": "employer_type",
}


def facts(semantic: str | None) -> list[Column]:
    """The columns that ``Block.judge`` reads, besides ``job_id`` and ``_targets``, the target roles that fit a posting's title."""
    return [*[F.expr(v).alias(k) for k, v in FACTS.items()], (F.col(semantic) if semantic else F.lit(None)).cast("double").alias("_similar")]


class Kinds:
    """Lists of values, one a profile: each distinct list once, as numbers of its values."""

    def __init__(self, rows: Iterable[Iterable[Hashable]]):
        kinds, self.ids, codes = {}, {}, []
        for row in rows:
            codes.append(kinds.setdefault(tuple(self.ids.setdefault(x, len(self.ids) + 1) for x in row), len(kinds)))
        self.codes, self.size = np.array(codes, np.int32), np.array([len(k) for k in kinds], np.int32)
        # value 0 is in every list and stands for nothing, so none is empty
        self.starts = np.concatenate([[0], np.cumsum(self.size + 1)[:-1]]).astype(np.int64)
        self.flat = np.array([x for k in kinds for x in (0, *k)], np.int32)

    def most(self, values: np.ndarray) -> np.ndarray:
        """For each distinct list the largest of its values' values, 0 at least."""
        return np.maximum.reduceat(values[self.flat], self.starts)

    def count(self, values: Iterable[Hashable]) -> np.ndarray:
        """For each distinct list how many of its values are among these."""
        return np.add.reduceat(self.held(values)[self.flat], self.starts, dtype=np.int32)

    def held(self, values: Iterable[Hashable]) -> np.ndarray:
        out = np.zeros(len(self.ids) + 1, bool)
        out[[self.ids[x] for x in values if x in self.ids]] = True
        return out


def _inverse(ids: dict, of: Callable[[Hashable], Iterable[str]]) -> dict[str, np.ndarray]:
    """For each word, the numbers of the values that have it."""
    out: dict[str, list[int]] = {}
    for value, k in ids.items():
        for word in of(value):
            out.setdefault(word, []).append(k)
    return {word: np.array(numbers) for word, numbers in out.items()}


def _nine(x: np.ndarray) -> np.ndarray:
    """Billionths, rounded half up as Spark rounds: by the shortest decimal."""
    scaled = x * 1e9
    out = np.floor(scaled + 0.5).astype(np.int64)
    for k in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-4):
        out[k] = int(Decimal(repr(float(x[k]))).scaleb(9).quantize(Decimal(1), ROUND_HALF_UP))
    return out


class Block:
    """Compiled profiles, each with ``_has``: which skills of postings its own ones back."""

    def __init__(self, rows: list[dict]):
        of = lambda name, kind=object: np.array([r[name] for r in rows], kind)
        number = lambda name, none: np.array([none if r[name] is None else r[name] for r in rows], np.int32)
        self.ids = of("id")
        titles = [[(t["name"], tuple(t["words"]), tuple(t["families"])) for t in r["titles"]] for r in rows]
        self.titles, self.families, self.countries, self.excluded, self.lacking, self.has = Kinds(titles), *[Kinds(r[c] for r in rows) for c in ("families", "countries", "excluded", "lacking", "_has")]
        self.roles = {}
        for role, k in self.titles.ids.items():
            self.roles.setdefault(role[0], []).append((k, frozenset(role[1]), frozenset(role[2])))
        self.interests = Kinds([(i["name"], tuple(i["words"])) for i in r["interests"]] for r in rows)
        self.interest_named, self.interest_worded = _inverse(self.interests.ids, lambda x: [x[0]]), _inverse(self.interests.ids, lambda x: set(x[1]))
        self.interest_words = np.array([1] + [max(1, len(x[1])) for x in self.interests.ids])
        self.mentions = Kinds([(m["raw"], tuple(m["names"])) for m in r["mentions"]] for r in rows)
        self.mention_named, self.mention_raw = _inverse(self.mentions.ids, lambda x: x[1]), [None, *[x[0] for x in self.mentions.ids]]
        self.backing: list[list[int]] = [[] for _ in range(len(self.has.ids) + 1)]
        for kind, (start, size) in enumerate(zip(self.has.starts, self.has.size)):
            for k in self.has.flat[start + 1 : start + 1 + size]:
                self.backing[k].append(kind)
        resumes: dict[str, int] = {}
        self.resume = np.array([-1 if r["resume"] is None else resumes.setdefault(r["resume"], len(resumes)) for r in rows], np.int32)
        self.resumes = list(resumes)
        self.has_skills, self.has_interests, self.us_only, self.needs, self.no_clearance, self.no_citizens = [of(c, bool) for c in ("has_skills", "has_interests", "us_only", "needs_sponsorship", "reject_clearance", "reject_citizenship_only")]
        self.judges = self.has_skills | (self.resume >= 0)
        self.degree, self.top, self.years = number("degree", 0), number("top", _ANY), number("yoe_max", 0)
        self.ceiling, self.remote = of("seniority_max"), of("remote")
        self.any_mode = self.remote == "any"
        modes: dict[str, int] = {}
        self.mode, self.modes = np.array([modes.setdefault(r["remote"], len(modes)) for r in rows], np.int32), modes
        self.most_jobs = max(16, VALUES // max(len(x.size) for x in (self.families, self.countries, self.excluded, self.lacking, self.interests)))
        self._known: dict = {}

    def _once(self, what: str, key: Hashable, make: Callable[[], np.ndarray]) -> np.ndarray:
        """``make()``, kept for a while: postings share names, countries and the like."""
        own = self._known.setdefault(what, {})
        if key not in own:
            if len(own) >= KEPT:
                own.clear()
            own[key] = make()
        return own[key]

    def _title(self, job: dict) -> tuple[np.ndarray, np.ndarray]:
        """The profiles with a target role that fits a posting's title, and the title's score under each."""
        name, words, families, score = job["_name"], set(job["_words"]), set(job["_families"]), np.zeros(len(self.titles.ids) + 1)
        for target in job["_targets"]:
            for k, own, kinds in self.roles.get(target, ()):
                score[k] = 1.0 if target in name or name in target else max(0.85 if families & kinds else 0.0, len(own & words) / len(own) if own else 0.0)
        best = self.titles.most(score)[self.titles.codes]
        rows = np.flatnonzero(best > 0).astype(np.int32)
        return rows, best[rows]

    def _interest(self, job: dict) -> np.ndarray:
        value = np.zeros(len(self.interests.ids) + 1)
        for word in set(job["_interest_words"]):
            if word in self.interest_worded:
                value[self.interest_worded[word]] += 1
        value /= self.interest_words
        for name in job["_interests"]:
            if name in self.interest_named:
                value[self.interest_named[name]] = 1
        return self.interests.most(value)

    def _mentioned(self, job: dict) -> np.ndarray:
        """Which names of skills a posting's text holds, by number."""
        hit = np.zeros(len(self.mentions.ids) + 1, bool)
        for name in job["_named"]:
            if name in self.mention_named:
                hit[self.mention_named[name]] = True
        return hit

    def _in_resumes(self, low: str, which: np.ndarray) -> np.ndarray:
        """Which of these résumés (numbers) hold a skill as whole words."""
        if len(re.sub(r"[^a-z0-9+#]", "", low)) < 3:
            return np.zeros(len(which), bool)
        known = self._once("resumes", low, lambda: np.full(len(self.resumes), -1, np.int8))
        for k in np.unique(which[known[which] < 0]):
            known[k] = low in self.resumes[k] and re.search(rf"(?<![a-z0-9]){re.escape(low)}(?![a-z0-9])", self.resumes[k]) is not None
        return known[which] == 1

    def _proven(self, job: dict, rows: np.ndarray) -> np.ndarray:
        """For each of a posting's skills, which of the profiles have it or name it in their résumés."""
        out = np.zeros((len(job["_firsts"]), len(rows)), bool)
        kinds, resumes = self.has.codes[rows], self.resume[rows]
        for line, skill in zip(out, job["_firsts"]):
            if skill["skill"] in self.has.ids:
                backed = np.zeros(len(self.has.size), bool)
                backed[self.backing[self.has.ids[skill["skill"]]]] = True
                line[:] = backed[kinds]
            left = np.flatnonzero(~line & (resumes >= 0))
            if len(left):
                line[left] = self._in_resumes(skill["low"], resumes[left])
        return out & self.judges[rows]

    def _table(self, jobs: list[dict], what: str, key: Callable[[dict], Hashable], make: Callable[[Hashable], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each posting the line of its key, and those lines."""
        keys: dict = {}
        at = np.array([keys.setdefault(key(j), len(keys)) for j in jobs])
        return at, np.stack([self._once(what, k, lambda k=k: make(k)) for k in keys])

    def judge(self, jobs: list[dict], texts: bool = True) -> list[dict]:
        """The verdicts of postings under the profiles whose target roles fit, but for those that a hard rule rejects: as columns, each time for some ``PAIRS`` pairs.

        Without ``texts`` only the numbers of ``matched``, ``gaps`` and ``red_flags`` are found.
        """
        out, now, size = [], [], 0
        for job in jobs:
            if job["_level"] == "intern":
                continue
            fit = self._once("title", (job["_name"], tuple(job["_families"])), lambda: self._title(job))
            if now and (size + len(fit[0]) > PAIRS or len(now) >= self.most_jobs):
                out.append(self._judged(now, texts))
                now, size = [], 0
            if len(fit[0]):
                now.append((job, fit))
                size += len(fit[0])
        if now:
            out.append(self._judged(now, texts))
        return out

    def _judged(self, met: list[tuple[dict, tuple[np.ndarray, np.ndarray]]], texts: bool) -> dict:
        jobs = [j for j, _ in met]
        a, b, title = np.repeat(np.arange(len(jobs)), [len(rows) for _, (rows, _) in met]), np.concatenate([rows for _, (rows, _) in met]), np.concatenate([score for _, (_, score) in met])
        of = lambda name, kind=bool: np.array([j[name] for j in jobs], kind)
        asked = np.array([[_NEVER if y is None else y for y in j["_years"]] for j in jobs], np.int64)
        rank = np.array([RANK.get(j["_level"], _NEVER) for j in jobs], np.int64)
        defended = np.array([j["_defence"] is not None for j in jobs])
        early, new_grad = of("_early"), of("_new_grad")

        def kept(ok: np.ndarray) -> None:
            nonlocal a, b, title
            a, b, title = a[ok], b[ok], title[ok]

        # what a hard rule rejects
        kept(~(self.needs[b] & (of("_no_visa") | defended)[a] | self.no_clearance[b] & of("_cleared")[a] | self.no_citizens[b] & of("_citizens")[a] | self.us_only[b] & of("_abroad")[a]))
        at, alien = self._table(jobs, "countries", lambda j: j["_in"], lambda x: (self.countries.size > 0) & (self.countries.count([x]) == 0) if x is not None else np.zeros(len(self.countries.size), bool))
        kept(self.us_only[b] | ~alien[at[a], self.countries.codes[b]])
        at, shut = self._table(jobs, "companies", lambda j: j["_by"], lambda x: self.excluded.count([x]) > 0)
        kept(~shut[at[a], self.excluded.codes[b]])
        at, strange = self._table(jobs, "families", lambda j: tuple(j["_families"]), lambda x: (self.families.size > 0) & (self.families.count(x) == 0) & (len(x) > 0))
        kept(~strange[at[a], self.families.codes[b]])
        y, most = asked[a, self.degree[b]], self.years[b]
        kept(~((y >= YEARS_CAP) | (y >= 4) & ~(new_grad | early)[a] | (y > most + 1) | (rank[a] > self.top[b].astype(np.int64) + 1) | (title < 0.5) | (title < 0.75) & of("_care")[a]))

        # evidence of skills
        n, g = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        listed, bounds, proofs = of("_many", np.int64), np.searchsorted(a, np.arange(len(jobs) + 1)), []
        described = (listed == 0)[a]
        for k, job in enumerate(jobs):
            s = slice(bounds[k], bounds[k + 1])
            proofs.append(None)
            if s.start == s.stop:
                continue
            if job["_many"] == 0:
                hit = self._mentioned(job)
                n[s] = np.minimum(np.add.reduceat(hit[self.mentions.flat], self.mentions.starts, dtype=np.int64)[self.mentions.codes[b[s]]], 20)
                proofs[-1] = hit
            else:
                proven = self._proven(job, b[s])
                n[s] = proven.sum(axis=0)
                g[s] = np.where(self.judges[b[s]], len(job["_firsts"]) - n[s], len(job["_loose"]))
                proofs[-1] = proven

        # the fit
        of_b = lambda x: x[b]
        needs, has_skills, judges, any_mode, has_interests = map(of_b, (self.needs, self.has_skills, self.judges, self.any_mode, self.has_interests))
        top, y, most, rank = self.top[b].astype(np.int64), asked[a, self.degree[b]], self.years[b], rank[a]
        many = np.where(described, n, listed[a])
        share = n / np.maximum(many, 1)
        skill = np.where(~judges | (many == 0), 0.5, np.where(many < 3, 0.5 + (share - 0.5) * (many / 3), share))
        lively = bounds[:-1] < bounds[1:]
        held = np.stack([self._interest(j) if alive else np.zeros(len(self.interests.size)) for j, alive in zip(jobs, lively)])
        interest = np.where(has_interests, held[a, self.interests.codes[b]], 0.5)
        seniority = np.where((rank == _NEVER) | (top == _ANY), 0.6, np.where(rank <= top, 1.0, np.where(rank == top + 1, 0.5, 0.0)))
        stated = np.array([j["_mode"] is not None and j["_mode"] != "unknown" for j in jobs])[a]
        same = np.array([self.modes.get(j["_mode"], -1) for j in jobs])[a] == self.mode[b]
        unknown = np.array([j["_mode"] == "unknown" for j in jobs])[a]
        remote = np.where(any_mode, 1.0, np.where(unknown, 0.5, np.where(same, 1.0, 0.0)))
        w, similar = WEIGHTS, of("_similar", np.float64)[a]
        absent = np.array([j["_similar"] is None for j in jobs])[a]
        plain, known = w["skills"] * skill + w["title"] * title + w["interest"] * interest + w["seniority"] * seniority + w["remote"] * remote, sum(v for k, v in w.items() if k != "semantic")
        fit = _nine(np.where(absent, plain / known, (plain + w["semantic"] * np.fmax(0.0, np.fmin(1.0, similar))) / (known + w["semantic"])))

        # flags
        exempt, shown_early = of("_exempt")[a], of("_shown_early")[a]
        positive, quiet = exempt | of("_h1b")[a], needs & of("_silent")[a]
        unstated = (y == _NEVER) & ~(new_grad[a] | shown_early | early[a])
        unfinished = unstated & of("_unread")[a]
        thin, unmatched = described & (n < 2), has_skills & ~described & (n == 0)
        curated = thin & new_grad[a] & (title >= 0.75)
        seen = np.minimum(n, 12) + np.minimum(g, 8)
        weak = ~described & (n > 0) & ((np.minimum(n, 12) / np.maximum(seen, 1) < 0.5) | (seen >= 4) & (n < 2))
        at, lacks = self._table(jobs, "special", lambda j: tuple(j["_special"]), lambda x: self.lacking.count(x) > 0)
        known_level = np.array([j["_level"] in ("junior", "mid", "unclear") for j in jobs])[a]
        close, unsaid = title >= 0.75, unstated & ~unfinished & (top <= RANK["junior"])
        yes, no = np.ones(len(a), bool), np.zeros(len(a), bool)
        flags = [  # as ``verdict.FLAGS``: when each holds, whether it forces a flag, when it blocks a recommendation
            (rank > top, True, yes), (~close, True, yes), (~has_skills, True, yes), (has_skills & curated, True, no), (has_skills & thin & ~curated, True, yes), (has_skills & weak, True, yes), (lacks[at[a], self.lacking.codes[b]], True, yes), (quiet & positive, False, no),
            (quiet & ~positive, True, no), (y > most, True, yes), (unfinished, True, yes), (unsaid, True, ~(known_level & close & (n >= 2))), (~any_mode & stated & ~same, True, yes), (of("_recruits")[a], False, no), (~needs & defended[a], False, no),
        ]
        forced, blocked = (np.logical_or.reduce([when for when, force, _ in flags if force]), np.logical_or.reduce([when & block for when, _, block in flags]))
        enough = fit >= round(APPLY * 1e9)
        score = (fit + 500_000) // 1_000_000 / 1000
        apart = ~(unmatched & (score == 0))
        columns = {
            "profile_id": self.ids[b], "job_id": np.array([j["job_id"] for j in jobs], object)[a], "verdict": np.where(unmatched, "reject", np.where(enough & ~forced, "apply", "flag")).astype(object), "score": score,
            "recommendable": ~unmatched & enough & ~blocked,
        }
        if not texts:
            columns |= {"red_flags": np.where(unmatched, 1, np.sum([when for when, _, _ in flags], axis=0)).astype(np.int32), "matched": np.where(unmatched, 0, np.minimum(n, 12)).astype(np.int32), "gaps": np.minimum(g, 8).astype(np.int32)}
        else:
            early_reasons = [title >= 1, (n > 0) & (skill >= 0.5), (y != _NEVER) & (y <= most), ~absent & (np.isnan(similar) | (similar >= 0.65)), has_interests & (interest >= 0.75), seniority >= 1, ~any_mode & (remote >= 1), exempt]
            told = self._texts(jobs, a, b, bounds, proofs, y, unmatched, early_reasons, [has_skills & described & ~thin, quiet & positive], [when for when, _, _ in flags])
            columns |= dict(zip(("reasons", "red_flags", "matched", "gaps"), zip(*told))) if told else {c: [] for c in ("reasons", "red_flags", "matched", "gaps")}
        return {k: [x for x, ok in zip(v, apart) if ok] if isinstance(v, (list, tuple)) else v[apart] for k, v in columns.items()}

    def _texts(self, jobs, a, b, bounds, proofs, y, unmatched, early, late, flags) -> list[tuple[list[str], list[str], list[str], list[str]]]:
        early, late, flags, out = np.array(early).T.tolist(), np.array(late).T.tolist(), np.array(flags).T.tolist(), []
        for k, (i, p) in enumerate(zip(a.tolist(), b.tolist())):
            job = jobs[i]
            exempt = f"Likely H-1B cap-exempt ({job['_employer']})" if job["_employer"] is not None else None
            reasons = [x for x, ok in zip((*EARLY, exempt), early[k]) if ok and x is not None]
            if job["_many"] == 0:
                kind = self.mentions.codes[p]
                start = self.mentions.starts[kind]
                own = self.mentions.flat[start : start + self.mentions.size[kind] + 1]
                matched, gaps = [self.mention_raw[x] for x in own[proofs[i][own]]][:20], []
            elif self.judges[p]:
                proven = proofs[i][:, k - bounds[i]].tolist()
                matched, gaps = [s["raw"] for s, ok in zip(job["_firsts"], proven) if ok], [s["raw"] for s, ok in zip(job["_firsts"], proven) if not ok]
            else:
                matched, gaps = [], job["_loose"]
            if unmatched[k]:
                out.append((reasons, ["No verified overlap with the job's technical skills"], [], gaps[:8]))
                continue
            lacking = ""
            if flags[k][6]:
                kind = self.lacking.codes[p]
                start, hits = self.lacking.starts[kind], self.lacking.held(job["_special"])
                own, names = self.lacking.flat[start : start + self.lacking.size[kind] + 1], [None, *self.lacking.ids]
                lacking = ", ".join(names[x] for x in own[hits[own]])
            texts = (f"Seniority above target ({job['_level']} vs {self.ceiling[p]})", *FLAGS[1:6], f"No resume evidence for central specialty: {lacking}", *FLAGS[7:9], f"Slightly above target YoE ({y[k]})", *FLAGS[10:12], f"Work mode does not match preference ({job['_mode']} vs {self.remote[p]})", FLAGS[13],
                     f"Defense/weapons domain ({job['_defence']}) — check for US-person/clearance requirements")
            out.append((reasons + [x for x, ok in zip(LATE, late[k]) if ok], [x for x, ok in zip(texts, flags[k]) if ok], matched[:12], gaps[:8]))
        return out


EARLY = ("Title matches a target role", "Strong skill overlap with profile", "Experience requirement is within profile range", "Overall resume background is semantically aligned", "Aligns with stated interests", "Seniority within target range", "Matches work-mode preference")
LATE = ("Verified profile skills are explicitly named in the job description", "Employer has a positive sponsorship signal")
#: None: made for a pair.
FLAGS = (
    None, "Title is not a close match to a target role", "Profile has no verified skills for matching", "Feed carries no skill text — verify requirements on the posting", "Job has insufficient extracted skill evidence", "Verified skill coverage is below the recommendation bar", None,
    "Confirm sponsorship policy during application", "Sponsorship not stated - verify before applying", None, "Experience requirements are unverified because enrichment is incomplete", "Experience level is not stated for this junior-targeted profile", None,
    "Recruiter/aggregator post — prefer the direct employer", None,
)


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)
