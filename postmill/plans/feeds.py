"""Verdicts of documents as postings under suppliers as profiles, and SQL that computes the rules from the tables, pair by pair.

Titles, skills, places, statements and a profile's wishes are picked by several columns of the tables, so pairs differ in many ways. The SQL joins every document with every supplier and applies
the rules with their weights to each pair; nothing in it knows an outcome.
"""

from __future__ import annotations

from ..functions import lists
from ..operators import profiles, verdict
from ..schemas import as_postings
from .queries import query, read
from .session import scratch

LEVELS = ["", "Senior ", "Junior ", "Lead ", "", "Staff ", "Sr. ", "", "Principal ", ""]
ROLES = [
    "Data Engineer", "Machine Learning Engineer", "Software Engineer", "Data Scientist", "DevOps Engineer", "Security Analyst", "Analytics Engineer", "Research Scientist", "QA Engineer", "Firmware Engineer", "Solutions Architect", "UX Designer", "Product Manager",
    "Registered Nurse", "Pharmacist", "Business Analyst", "Platform Engineer", "ML Developer", "Mechanical Engineer", "Salesforce Developer", "Data", "Android Developer", "Data Platform Engineer", "Head of Data Science", "Data Quality and Governance Specialist",
]
TAILS = ["", " II", " (Remote)", " Intern", "", " - New Grad", " III", ""]
TARGETS = ["Data Engineer", "machine learning engineer", "Software Engineer ", "Data Scientist", "platform engineer", "Security Analyst", "Data Quality Governance Lead", "UX Designer", "Registered Nurse", "ML", "Senior Data Engineer, Analytics", "Mechanical Engineer"]
SKILLS = ["Python", "postgres", "Airflow", "Java", "k8s", "Machine Learning", "COBOL", "SAP", "Excel", "kuberntes", "tensorflwo", "React.js", "Deep Learning", "Spark", "NLP", "cicd", "Data Visualization", "Rust", "PostgreSQL", "data engineering", "Go", "GitHub Actions", "Statistics", "pythn"]
OWN = ["python", "PostgreSQL", "pytorch", "SQL", "java", "kubernetes", "tensorflow", "react", "pyspark", "airflow", "excel", "rust", "statistics", "R", "tableau", "docker"]
INTERESTS = ["data pipelines", "governance", "mobile apps", "security", "xylophone", "firmware work"]
PLACES = ["Austin, TX", "London, UK", "Remote", "New York", "Bangalore, India", "San Francisco, CA; London", "Somewhere", "United States", ""]
COMPANIES = ["Acme", "Raytheon", "Globex", "Initech", "Draper", "Hooli"]
STATEMENTS = [
    "", "Requires 3+ years of experience.", "We cannot offer visa sponsorship here.", "Must be a US citizen.", "At least 5 years of Python experience.", "Active security clearance required.", "We use Python, PyTorch and kubernetes.", "You work on UAV data pipelines.",
    "MS and 2 years or BS and 4 years needed.", "Requires 4+ years of experience.", "A Rust and Excel shop.", "Export control rules (ITAR) apply.", "At least 1 years of experience.",
]
CEILINGS = ["junior", "mid", "senior", "mid", "any"]
RESUMES = ["", "Master of science. I know COBOL and SAP well.", "", "Bachelor. Firmware, swift.", "Salesforce expert"]


class Dialect:
    """Expressions of the same meaning in both engines."""

    def __init__(self, spark: bool):
        self.spark = spark

    def list(self, parts: list[str]) -> str:
        return f"array({', '.join(parts)})" if self.spark else f"[{', '.join(parts)}]"

    def pick(self, words: list[str], at: str) -> str:
        all_words = self.list(["'" + w + "'" for w in words])
        return f"element_at({all_words}, cast(({at}) % {len(words)} AS int) + 1)" if self.spark else f"list_extract({all_words}, (({at}) % {len(words)})::INT + 1)"

    def first(self, parts: list[str], n: str) -> str:
        return f"slice({self.list(parts)}, 1, cast({n} AS int))" if self.spark else f"list_slice({self.list(parts)}, 1, {n})"

    def postings(self) -> dict[str, str]:
        k, n = "doc_id", "n_chars"
        return {
            "job_id": f"cast({k} AS string)" if self.spark else f"{k}::VARCHAR", "title": f"concat({self.pick(LEVELS, n)}, {self.pick(ROLES, f'{k} * 7 + {n}')}, {self.pick(TAILS, f'{k} + {n} * 3')})", "company": self.pick(COMPANIES, f"{k} + {n}"), "location_raw": self.pick(PLACES, f"{k} * 5 + {n}"),
            "country": self.pick(["us", "", "us", "gb", ""], f"{n} * 7 + {k}"), "remote_mode": self.pick(["remote", "onsite", "hybrid", "unknown"], f"{k} + {n} * 2"), "description": f"concat(text, ' ', {self.pick(STATEMENTS, f'{k} + {n} * 5')})",
            "skills": self.first([self.pick(SKILLS, f"{k} * {i + 3} + {n} * {i + 1}") for i in range(6)], f"{n} % 7"), "yoe_min": f"nullif(cast(({k} + {n}) % 9 AS int), 5) % 5", "seniority": self.pick(["unclear", "mid", "senior", "junior", "unclear", "lead"], f"{k} * 11 + {n}"),
            "visa_sponsorship": self.pick(["not_mentioned", "yes", "no", "unclear"], f"{n} + {k} * 3"), "security_clearance": self.pick(["none", "none", "unclear", "required", "none"], f"{n} * 3 + {k}"), "citizenship_required": f"({k} * 3 + {n}) % 11 = 0",
            "new_grad_program": f"({k} + {n}) % 6 = 0", "cap_exempt": self.pick(["unknown", "yes", "no", "likely"], f"{k} + {n} * 7"), "employer_type": self.pick(["university", "for_profit"], k), "known_h1b_sponsor": f"{n} % 3 = 0",
            "enrichment_status": self.pick(["done", "pending", "done", "failed"], f"{k} * 3 + {n}"), "is_recruiter_post": f"{k} % 4 = 1", "source": "source", "url": "'https://example.com'",
        }

    def profiles(self) -> dict[str, str]:
        k, b = "s_suppkey", "s_nationkey"
        return {
            "id": f"cast({k} AS string)" if self.spark else f"{k}::VARCHAR", "label": "s_name", "target_titles": self.first([self.pick(TARGETS, f"{k} * {i + 1} + {b} * {i + 2}") for i in range(3)], f"({k} + {b}) % 4"),
            "interests": self.first([self.pick(INTERESTS, f"{k} + {b} * {i + 1} + {i}") for i in range(2)], f"{k} % 3"), "skills": self.first([self.pick(OWN, f"{k} * {i + 1} + {b} * {i + 3} + {i}") for i in range(7)], f"3 + ({k} + {b}) % 5 - (CASE WHEN {k} % 17 = 0 THEN 3 + ({k} + {b}) % 5 ELSE 0 END)"),
            "resume_text": f"nullif({self.pick(RESUMES, f'{k} + {b}')}, '')", "seniority_max": self.pick(CEILINGS, f"{k} + {b} * 3"), "yoe_max": f"cast({k} % 5 AS int)", "needs_sponsorship": f"{k} % 3 = 0", "reject_clearance": f"{k} % 4 <> 1", "reject_citizenship_only": f"{b} % 3 <> 1",
            "countries": f"CASE WHEN {k} % 5 < 3 THEN {self.list([chr(39) + 'US' + chr(39)])} WHEN {k} % 5 = 3 THEN {self.list([chr(39) + 'gb' + chr(39), chr(39) + 'us' + chr(39)])} ELSE {self.first([chr(39) + 'x' + chr(39)], '0')} END", "excluded_companies": self.list([self.pick(["GLOBEX ", "none"], k)]),
            "remote_preference": self.pick(["any", "remote", "any", "hybrid", "any"], f"{k} * 3 + {b}"),
        }


def _select(parts: dict[str, str]) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in parts.items())


def rich_postings(spark, d):
    """Documents as postings, with a column ``semantic`` that a third of them lack."""
    rows = read(spark, d, "documents").selectExpr(*[f"{v} AS {k}" for k, v in Dialect(True).postings().items()], "CASE WHEN doc_id % 3 > 0 THEN (n_chars % 101) / 100.0D END AS semantic")
    return as_postings(rows, "semantic")


def profile_table(spark, d):
    return read(spark, d, "supplier").selectExpr(*[f"{v} AS {k}" for k, v in Dialect(True).profiles().items()])


def _text(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _map(pairs: dict) -> str:
    return "MAP {" + ", ".join(f"'{k}': {v}" for k, v in pairs.items()) + "}"


def _matching(patterns: dict[str, str], of: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({of}, $r${p}$r$, 'i') THEN '{n}' END" for n, p in patterns.items()) + "], lambda x: x IS NOT NULL)"


_CARE, _PLACE = verdict.CARE.removeprefix("(?i)"), "|".join(lists.FOREIGN_PLACES + lists.FOREIGN_CITIES)
_ALIASES = _map({k: f"'{v}'" for k, v in lists.SKILL_ALIASES.items()})


def _canon(raw: str) -> str:
    s = rf"trim(regexp_replace(regexp_replace(lower({raw}), '[^a-z0-9+#./ -]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"coalesce(aliases[{s}], CASE WHEN len({s}) > 4 AND {s} LIKE '%s' AND {s} NOT LIKE '%ss' THEN aliases[{s}[:-2]] END, {s})"


#: A ratio of 0.9 for the names at hand: those of one edit or one swap have all signs but the changed ones in common.
_SAME = """(a = b OR len(list_filter(string_split(a, ' '), lambda x: NOT list_contains(string_split(b, ' '), x))) = 0 OR len(list_filter(string_split(b, ' '), lambda x: NOT list_contains(string_split(a, ' '), x))) = 0 OR (len(a) >= 4 AND len(b) >= 4 AND (contains(a, b) OR contains(b, a)))
 OR (damerau_levenshtein(a, b) = 1 AND 2.0 * (CASE WHEN len(a) = len(b) THEN len(a) - 1 ELSE least(len(a), len(b)) END) / (len(a) + len(b)) >= 0.9))"""
_IMPLIED = _map({k: _text(v) for k, v in lists.SKILL_IMPLIED_BY.items()})
_RANK = _map(lists.SENIORITY_RANK)
_NAMES: dict[str, list[str]] = {}
for _alias, _skill in lists.SKILL_ALIASES.items():
    _NAMES.setdefault(_skill, []).append(_alias)
_LONG = "len(regexp_replace(n, '[^a-z0-9+#]', '', 'g')) >= 3"
_FOUND = r"regexp_matches({0}, '(^|[^a-z0-9])' || regexp_replace({1}, '([.+#/-])', '\\\1', 'g') || '($|[^a-z0-9])')"
_FLAG = {  # when it holds, whether it forces a flag, when it blocks
    "above": ("coalesce(rank > top, false)", True, "true"), "far": ("ts < 0.75", True, "true"), "bare": ("len(pskills) = 0", True, "true"), "curated": ("len(pskills) > 0 AND thin AND new_grad_program AND ts >= 0.75", True, "false"),
    "thin": ("len(pskills) > 0 AND thin AND NOT (new_grad_program AND ts >= 0.75)", True, "true"), "weak": ("len(pskills) > 0 AND len(skills) > 0 AND n > 0 AND (least(n, 12)::DOUBLE / (least(n, 12) + least(g, 8)) < 0.5 OR (least(n, 12) + least(g, 8) >= 4 AND n < 2))", True, "true"),
    "lacking": ("len(lacking) > 0", True, "true"), "confirm": ("quiet AND positive", False, "false"), "verify": ("quiet AND NOT positive", True, "false"), "near": ("coalesce(y > yoe_max, false)", True, "true"), "unfinished": ("unstated AND enrichment_status IN ('pending', 'failed')", True, "true"),
    "unsaid": ("unstated AND enrichment_status NOT IN ('pending', 'failed') AND coalesce(top <= 1, false)", True, "NOT (level IN ('junior', 'mid', 'unclear') AND ts >= 0.75 AND n >= 2)"), "mode": ("remote_preference <> 'any' AND remote_mode <> 'unknown' AND remote_mode <> remote_preference", True, "true"),
    "recruiter": ("is_recruiter_post", False, "false"), "defence": ("NOT needs_sponsorship AND defence", False, "false"),
}
_PLAIN_TITLE, _STATEMENT = "lower(trim(title))", Dialect(False).pick(STATEMENTS, "doc_id + n_chars * 5")
FEEDS_SQL = rf"""
WITH kn AS (SELECT {_ALIASES} AS aliases, {_map({k: _text(v) for k, v in _NAMES.items()})} AS nicknames),
d0 AS (SELECT {_select(Dialect(False).postings())}, {_STATEMENT} AS st, CASE WHEN doc_id % 3 > 0 THEN (n_chars % 101) / 100.0 END AS semantic FROM documents),
d1 AS (SELECT d0.*, {_PLAIN_TITLE} AS name, regexp_extract_all({_PLAIN_TITLE}, '[a-z0-9+#]+') AS words, {_matching(lists.ROLE_FAMILIES, 'title')} AS fam, {_matching({k: p for k, (p, _) in lists.SPECIALTIES.items()}, 'title')} AS special, {_matching(lists.TITLE_SENIORITY, 'title')} AS shown, regexp_matches(title, $r${_CARE}$r$, 'i') AS care,
 lower(trim(location_raw)) AS place, regexp_matches(title, $r$\b(?:{_PLACE})\b$r$, 'i') AS away, lower(title || ' ' || description) AS hay, lower(description) AS body, list_transform(skills, lambda r: {{'raw': r, 'low': lower(r), 'c': {_canon('r')}}}) AS listed FROM d0, kn),
d AS (SELECT *, CASE WHEN len(shown) = 0 THEN CASE WHEN seniority = 'unclear' THEN 'unclear' ELSE seniority END WHEN seniority = 'unclear' OR {_RANK}[shown[1]] >= {_RANK}[seniority] THEN shown[1] ELSE seniority END AS level,
 CASE WHEN country NOT IN ('', 'us') THEN place LIKE '%;%' AND (regexp_matches(place, '(^|[^a-z])(us|usa)($|[^a-z])') OR contains(place, 'united states') OR regexp_matches(place, ',\s*({'|'.join(lists.US_STATES)})\b'))
 WHEN contains(place, 'united states') OR regexp_matches(place, '(^|[^a-z])(us|usa|america)($|[^a-z])') OR regexp_matches(place, '{'|'.join(lists.US_STATE_NAMES)}') OR (NOT regexp_matches(place, '\b(?:{_PLACE})\b') AND (regexp_matches(place, ',\s*({'|'.join(lists.US_STATES)})\b') OR regexp_matches(place, '{'|'.join(lists.US_CITIES)}'))) THEN true
 WHEN country = 'us' THEN NOT regexp_matches(place, '\b(?:{'|'.join(lists.FOREIGN_PLACES)})\b') AND NOT away WHEN remote_mode = 'remote' THEN trim(regexp_replace(regexp_replace(place, '\bremote\b', ' ', 'g'), '[^a-z ]', ' ', 'g')) IN ('{"', '".join(lists.GENERIC_REMOTE)}') AND NOT away ELSE false END AS us,
 regexp_matches(st, $r${lists.NO_SPONSORSHIP}$r$) AS no_visa, regexp_matches(st, $r${lists.CITIZENSHIP}$r$) AS citizens, regexp_matches(st, $r${lists.CLEARANCE}$r$) AS cleared, NOT citizenship_required AND (lower(company) IN ('{"', '".join(lists.DEFENCE_COMPANIES)}') OR regexp_matches(st, $r${lists.DEFENCE_WORDS}$r$)) AS defence,
 try_cast(regexp_extract(st, '([0-9]+)\+? years of', 1) AS INT) AS said_years, contains(st, 'MS and') AS by_degree, try_cast(regexp_extract(st, 'MS and ([0-9]+)', 1) AS INT) AS ms, try_cast(regexp_extract(st, 'BS and ([0-9]+)', 1) AS INT) AS bs FROM d1),
s AS (SELECT {_select(Dialect(False).profiles())} FROM supplier),
p AS (SELECT s.* EXCLUDE (skills), skills AS pskills, {_RANK}[seniority_max] AS top, list_transform(target_titles, lambda t: {{'name': lower(trim(t)), 'words': list_distinct(regexp_extract_all(lower(trim(t)), '[a-z0-9+#]+')), 'fam': {_matching(lists.ROLE_FAMILIES, 't')}}}) AS roles,
 list_distinct(list_transform(skills, lambda r: {_canon('r')})) AS own, CASE WHEN regexp_matches(coalesce(resume_text, ''), '(?i)\bmaster') THEN 2 WHEN regexp_matches(coalesce(resume_text, ''), '(?i)\bbachelor') THEN 1 END AS degree, ' ' || lower(resume_text) || ' ' AS resume,
 lower(array_to_string(target_titles, ' ') || ' ' || array_to_string(interests, ' ') || ' ' || array_to_string(skills, ' ') || ' ' || coalesce(resume_text, '')) AS corpus FROM s, kn),
t AS (SELECT d.*, p.* EXCLUDE (id), p.id AS profile_id, CASE WHEN len(list_filter(roles, lambda r: contains(name, r.name) OR contains(r.name, name))) > 0 THEN 1.0::DOUBLE ELSE list_max(list_transform(roles, lambda r: greatest(CASE WHEN list_has_any(fam, r.fam) THEN 0.85 ELSE 0 END, len(list_intersect(r.words, words))::DOUBLE / len(r.words)))) END AS ts FROM d, p WHERE len(target_titles) > 0),
x AS (SELECT *, {_RANK}[level] AS rank, greatest(yoe_min, CASE WHEN by_degree THEN CASE WHEN degree = 1 THEN bs WHEN degree = 2 THEN least(ms, bs) ELSE least(ms, bs) END ELSE said_years END) AS y, flatten(list_transform(roles, lambda r: r.fam)) AS pfam FROM t WHERE ts >= 0.75),
h AS (SELECT * FROM x WHERE NOT (needs_sponsorship AND (visa_sponsorship = 'no' OR no_visa)) AND NOT (reject_clearance AND (security_clearance = 'required' OR cleared)) AND NOT (reject_citizenship_only AND (citizenship_required OR citizens))
 AND (CASE WHEN len(countries) = 1 THEN us WHEN len(countries) = 2 THEN country IN ('', 'us', 'gb') ELSE true END) AND NOT coalesce(y >= 5, false) AND NOT coalesce(y >= 4 AND NOT new_grad_program AND seniority <> 'junior', false) AND level <> 'intern' AND lower(company) <> lower(trim(excluded_companies[1]))
 AND NOT (needs_sponsorship AND defence) AND NOT coalesce(y > yoe_max + 1, false) AND NOT coalesce(rank > top + 1, false) AND NOT (len(pfam) > 0 AND len(fam) > 0 AND NOT list_has_any(fam, pfam))),
f AS (SELECT *, list_filter(listed, lambda s, i: len(list_filter(listed[:i - 1], lambda e: e.c = s.c)) = 0) AS firsts FROM h),
sk AS (SELECT DISTINCT s.c AS c, o AS b FROM (SELECT unnest(firsts) AS s FROM f), (SELECT DISTINCT unnest(own) AS o FROM p)),
ok AS (SELECT c, list(DISTINCT b) AS holders FROM (SELECT c, b, unnest(list_concat([c], coalesce({_IMPLIED}[c], []::VARCHAR[]))) AS a FROM sk) WHERE {_SAME} GROUP BY c),
okm AS (SELECT MAP(list(c), list(holders)) AS backers FROM ok),
m AS (SELECT f.* EXCLUDE (skills), f.skills, list_transform(firsts, lambda s: list_has_any(coalesce(backers[s.c], []::VARCHAR[]), own) OR coalesce(len(regexp_replace(s.low, '[^a-z0-9+#]', '', 'g')) >= 3 AND {_FOUND.format('resume', 's.low')}, false)) AS proven,
 list_filter(pskills, lambda r, i: len(list_filter(list_filter(list_concat([lower(r), {_canon('r')}], coalesce(nicknames[{_canon('r')}], []::VARCHAR[])), lambda n: {_LONG}), lambda n: {_FOUND.format('body', 'n')})) > 0
  AND len(list_filter(pskills[:i - 1], lambda e: {_canon('e')} = {_canon('r')})) = 0) AS named FROM f, okm, kn),
c AS (SELECT *, CASE WHEN len(skills) = 0 THEN len(named) WHEN len(pskills) > 0 OR resume_text IS NOT NULL THEN len(list_filter(proven, lambda x: x)) ELSE 0 END AS n, CASE WHEN len(skills) = 0 THEN 0 WHEN len(pskills) > 0 OR resume_text IS NOT NULL THEN len(list_filter(proven, lambda x: NOT x)) ELSE least(8, len(list_distinct(skills))) END AS g,
 CASE WHEN len(skills) > 0 THEN len(skills) ELSE len(named) END AS many, list_filter(special, lambda z: len(list_filter({_map({k: _text(w) for k, (_, w) in lists.SPECIALTIES.items()})}[z], lambda w: contains(corpus, w))) = 0) AS lacking,
 needs_sponsorship AND visa_sponsorship IN ('not_mentioned', 'unclear') AS quiet, cap_exempt IN ('yes', 'likely') OR known_h1b_sponsor AS positive, y IS NULL AND NOT (new_grad_program OR seniority = 'junior' OR coalesce(shown[1] IN ('intern', 'junior'), false)) AS unstated,
 CASE WHEN len(interests) = 0 THEN 0.5 WHEN len(list_filter(interests, lambda i: contains(hay, i))) > 0 THEN 1 ELSE list_max(list_transform(interests, lambda i: len(list_intersect(string_split(i, ' '), regexp_extract_all(hay, '[a-z0-9+#]+')))::DOUBLE / len(string_split(i, ' ')))) END AS ins,
 CASE WHEN rank IS NULL OR top IS NULL THEN 0.6 WHEN rank <= top THEN 1 WHEN rank = top + 1 THEN 0.5 ELSE 0 END AS sens, CASE WHEN remote_preference = 'any' THEN 1 WHEN remote_mode = 'unknown' THEN 0.5 WHEN remote_mode = remote_preference THEN 1 ELSE 0 END AS rems FROM m),
w AS (SELECT *, len(skills) = 0 AND n < 2 AS thin, CASE WHEN (len(pskills) = 0 AND resume_text IS NULL) OR many = 0 THEN 0.5 WHEN many < 3 THEN 0.5 + (n::DOUBLE / many - 0.5) * (many / 3.0) ELSE n::DOUBLE / many END AS sks FROM c),
z AS (SELECT *, round((0.35 * sks + 0.25 * ts + 0.05 * ins + 0.10 * sens + 0.05 * rems + coalesce(0.20 * semantic, 0)) / (0.80 + CASE WHEN semantic IS NULL THEN 0 ELSE 0.20 END), 9) AS fit, len(pskills) > 0 AND len(skills) > 0 AND n = 0 AS unmatched FROM w),
v AS (SELECT *, {' OR '.join(f'({when})' for when, force, _ in _FLAG.values() if force)} AS forced, {' OR '.join(f'(({when}) AND {block})' for when, _, block in _FLAG.values() if block != 'false')} AS blocked, {' || '.join(f"CASE WHEN {when} THEN '{k} ' ELSE '' END" for k, (when, _, _) in _FLAG.items())} AS flags FROM z)
"""
_OUT = "profile_id, job_id, CASE WHEN unmatched THEN 'reject' WHEN fit >= 0.6 AND NOT forced THEN 'apply' ELSE 'flag' END AS verdict, round(fit::DECIMAL(18, 9), 3)::DOUBLE AS score, NOT unmatched AND fit >= 0.6 AND NOT blocked AS recommendable"


@query(FEEDS_SQL + f"SELECT {_OUT}, CASE WHEN unmatched THEN 0 ELSE least(12, n) END::INT AS matched, least(8, g)::INT AS gaps, CASE WHEN unmatched THEN 1 ELSE len(string_split(trim(flags), ' ')) - (trim(flags) = '')::INT END::INT AS red_flags FROM v")
def profile_feeds(spark, d):
    """Every pair of a posting and a profile that may fit, with its verdict: suppliers as profiles over documents as postings, with a semantic score for two of three."""
    return profiles.feeds(rich_postings(spark, d), profile_table(spark, d), semantic="semantic", home=scratch(spark, "feeds"), texts=False).select("profile_id", "job_id", "verdict", "score", "recommendable", "matched", "gaps", "red_flags")
