"""The automaton against regular expressions, the fuzzy join against all pairs, feeds of a table of profiles against each profile alone."""

import random
import re
import time
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from postmill.functions import automaton, lists, text
from postmill.operators import eligibility, pairs, profiles, skills, verdict
from postmill.plans import feeds
from postmill.schemas import PROFILE, as_postings

SF = "/root/testdata/sf0.001"


def test_words_that_a_pattern_needs():
    assert automaton.words_of(r"(?i)\b(?:data|ml)\s+(?:engineer|developer)s?\b") == {"engineer", "developer", "engineers", "developers"}
    assert automaton.words_of(r"colou?r[^.]{0,9}x") == {"color", "colour"} and automaton.words_of("a|bc") == {"a", "bc"}
    with pytest.raises(ValueError):
        automaton.words_of(r"\d*")


def test_automaton_equals_regular_expressions(spark):
    """On all documents and pages, with statements added to some: every rule of titles, places and evidence."""
    rules = {**verdict.TITLE_RULES, **verdict.PLACE_RULES, **eligibility.RULES, **verdict.DEFENCE_RULE}
    said = ["", "We cannot offer visa sponsorship here.", "Must be a U.S. citizen, ITAR.", "Senior Data Engineer II, Austin, TX; remote US", "Active TS/SCI required. Radar  systems.", "HEAD OF machine-learning; Sr. nurse practitioner in Berlin", "New Grad (entry level) SAP FICO consultant, co-op"]
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("text").unionByName(spark.read.parquet(f"{SF}/pages.parquet").select(F.col("html").alias("text")))
    rows = texts.withColumn("k", F.pmod(F.xxhash64("text"), F.lit(len(said)))).select(F.concat("text", F.lit(" "), F.element_at(F.array(*map(F.lit, said)), (F.col("k") + 1).cast("int"))).alias("t")).unionByName(spark.createDataFrame([(x,) for x in [*said, None]], "t string"))
    found = rows.withColumn("hits", automaton.first_matches((F.col("t"), rules)))
    native = {name: F.nullif(F.regexp_extract("t", "(?i)" + p, 0), F.lit("")) for name, p in rules.items()}
    off = found.select(*[F.count_if(~F.try_element_at("hits", F.lit(n)).eqNullSafe(native[n])).alias(n) for n in rules]).first()
    assert not any(off) and found.select(F.sum(F.size("hits"))).first()[0] > 500
    other = rows.select(eligibility.told(F.col("t")).alias("a"), eligibility.evidence(F.coalesce("t", F.lit("")), None).alias("b"))
    assert other.where("a <> b").count() == 0 and other.where("a.citizenship_required").count() > 10


def test_places_by_automaton_equal_native_rules(spark):
    place = ["Austin, TX", "London, UK", "Remote", "New York", "Bangalore, India", "San Francisco, CA; London", "Berlin; Remote US", "Somewhere", "United States", "", None, "Toronto, CA", "Remote - Americas", "U.S.; Mexico"]
    rows = spark.createDataFrame([(f"{a}{b}{c}{k}", p, country, mode, title) for a, p in enumerate(place) for b, country in enumerate(["us", "", None, "gb", "USA "]) for c, mode in enumerate(["remote", "onsite"]) for k, title in enumerate(["Engineer", "Engineer, Berlin", None])], "job_id string, location_raw string, country string, remote_mode string, title string")
    facts = verdict.with_facts(as_postings(rows), verdict.Wanted(set(), set(), set()))
    both = facts.select("_us", text.is_us(*[F.col(c) for c in ("country", "location_raw", "remote_mode", "title")]).alias("native"))
    assert both.where("_us <> native OR _us IS NULL").count() == 0 and both.where("_us").count() > 50


def test_vocabulary_edges(spark):
    rows = spark.createDataFrame([("we use c++ and go, not django; node.js", ), (None,)], "t string")
    r = rows.select(automaton.mentions(F.col("t"), ["go", "c++", "node", "use c"], True), automaton.mentions(F.col("t"), ["go", "se c"]), automaton.tokens_among(F.col("t"), ["go", "c++", "dj"])).collect()
    assert [list(x) for x in r[0]] == [["c++", "go", "node", "use c"], ["go", "se c"], ["c++", "go"]] and [list(x) for x in r[1]] == [[], [], []]


def test_fuzzy_join_equals_all_pairs(spark):
    """Also at the edge of the ratio: names with one to three edits."""
    draw = random.Random(3)
    base = sorted({*lists.SKILL_ALIASES, *lists.SKILL_ALIASES.values(), *lists.SKILL_IMPLIED_BY})

    def changed(x: str) -> str:
        signs = list(x)
        for _ in range(draw.randrange(1, 4)):
            k, kind = draw.randrange(len(signs)), draw.random()
            signs[k : k + 1] = [] if kind < 0.4 and len(signs) > 1 else [draw.choice("abcdefgh 1")] if kind < 0.7 else [signs[k], draw.choice("abcdefgh 1")]
        return " ".join("".join(signs).split())

    left = sorted({s for s in base + [changed(x) for x in base for _ in range(2)] if s})
    right = sorted({s for s in [changed(x) for x in base for _ in range(2)] + draw.sample(base, 60) if s})

    def same(a: str, b: str) -> bool:
        x, y = set(a.split(" ")), set(b.split(" "))
        return a == b or x <= y or y <= x or (len(a) >= 4 and len(b) >= 4 and (a in b or b in a)) or SequenceMatcher(None, a, b).ratio() >= 0.9

    wanted = {(a, b) for a in left for b in right if same(a, b)}
    frame = lambda x: spark.createDataFrame([(s,) for s in x], "skill string")
    assert {tuple(r) for r in skills.alike(frame(left), frame(right)).collect()} == wanted and all(skills.same(a, b) == ((a, b) in wanted) for a in left[::7] for b in right)
    assert any(SequenceMatcher(None, a, b).ratio() >= 0.9 and not (a in b or b in a) for a, b in wanted)


def test_titles_that_fit_equal_all_pairs(spark):
    draw = random.Random(5)
    names = sorted({(a + b + c).lower().strip() for a in feeds.LEVELS for b in feeds.ROLES for c in feeds.TAILS[:5] if draw.random() < 0.2} | {"", "x", "ml", "data", "html engineer"})
    roles = sorted({t.strip().lower() for t in feeds.TARGETS} | {"x", "data science manager for tools", "absent words here", "engineer"})
    words = lambda s: re.findall("[a-z0-9+#]+", s)
    title = spark.createDataFrame([(n, words(n), sorted(verdict.families_of(n))) for n in names], "_name string, _words array<string>, _families array<string>")
    target = spark.createDataFrame([(t, sorted(set(words(t))), sorted(verdict.families_of(t))) for t in roles], "target string, words array<string>, families array<string>")

    def score(n: str, t: str) -> float:
        if t in n or n in t:
            return 1.0
        return max(0.85 * bool(verdict.families_of(n) & verdict.families_of(t)), len(set(words(n)) & set(words(t))) / len(set(words(t))))

    for least in (0.5, 0.75, 0.9):
        found = {tuple(r) for r in profiles.titles_that_fit(title, target, least).collect()}
        assert found == {(n, t) for n in names if n for t in roles if score(n, t) >= least - 1e-12}, least


def test_feeds_equal_each_profile_alone(spark):
    rows, table = feeds.rich_postings(spark, SF), feeds.profile_table(spark, SF)
    odd = spark.createDataFrame([("odd", None, ["Data Engineer", None, " "], None, None, None, None, None, None, None, None, None, None, None, None)], PROFILE)
    found = {(r.profile_id, r.job_id): tuple(r)[2:] for r in profiles.feeds(rows, table.unionByName(odd, allowMissingColumns=True), semantic="semantic").collect()}
    wanted = {}
    for r in [*table.collect()[:6], *odd.collect()]:
        p = verdict.Profile(**{k: [x for x in v if x] if isinstance(v, list) else v for k, v in r.asDict().items() if v is not None})
        if p.target_titles:
            alone = verdict.judged(verdict.with_profiles(rows, [p]).withColumn("_t", F.expr(verdict.STAGES[0]["_title"])), "semantic").where("_t >= 0.75 AND NOT (verdict = 'reject' AND score = 0)")
            wanted.update({(p.id, x.job_id): tuple(x) for x in alone.select("job_id", *verdict.VERDICT).collect()})
    ids = {k[0] for k in wanted}
    assert {k: v for k, v in found.items() if k[0] in ids} == {k: v[1:] for k, v in wanted.items()} and len(wanted) > 5 and "odd" in ids


def test_one_plan_for_any_number_of_profiles(spark):
    """A thousand profiles make the plan of ten."""
    rows, table = feeds.rich_postings(spark, SF), feeds.profile_table(spark, SF)
    many = table.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("id", F.concat("id", F.lit("-"), "n")).drop("n")
    size = lambda p: len(profiles.feeds(rows, p, semantic="semantic")._jdf.queryExecution().optimizedPlan().toString())
    assert many.count() == 1000 and size(many) < 1.05 * size(table) + 1000
    assert profiles.feeds(rows, table.limit(0)).count() == 0 and profiles.feeds(rows.limit(0), table).count() == 0


def test_years_by_degree(spark):
    rows = spark.createDataFrame([("MS and 2 years or BS and 4 years needed.",)], "d string")
    assert [rows.select(verdict.stated_years(F.col("d"), r)).first()[0] for r in ("PhD", "Master of science", "Bachelor", None)] == [2, 2, 4, 2]


def test_years_after_a_cue_equal_every_look_behind(spark):
    """The most years of random statements, cues near and far before and after, against plain patterns of a second engine."""
    import regex

    number, before, after = r"(?<!\d)(\d{1,2})", rf"(?<=(?:{verdict.CUES})[\s\S]{{0,230}})", rf"(?=[\s\S]{{0,90}}?(?:{verdict.CUES}))"
    plain = [
        rf"(?:{verdict.PREFIX}){number}(?:{verdict.QUALIFIER})?{verdict.OF_EXPERIENCE}", rf"{number}{verdict.QUALIFIER}{verdict.OF_EXPERIENCE}", rf"{before}{number}{verdict.OF_EXPERIENCE}", rf"{number}{verdict.OF_EXPERIENCE}{after}",
        rf"{verdict.EXPERIENCE_OF}{number}{verdict.QUALIFIER}\s*years?\b", rf"{before}{verdict.EXPERIENCE_OF}{number}\s*years?\b", rf"{verdict.EXPERIENCE_OF}{number}\s*years?\b{after}",
    ]
    patterns, rng = [regex.compile(p, regex.I) for p in plain], random.Random(5)
    parts = ["You have", "Requirements", "degree", "proven track record", "qualification", "3 years of experience", "at least 4 years python experience", "7+ years of experience", "Experience of: 6 years", "experience 12 - 14 years", "2 years hands-on c++ data experience", "31 years of experience", "9 years", "x", "word " * 9, "word " * 17, "word " * 46]
    texts = [" ".join(rng.choices(parts, k=rng.randrange(1, 8))) for _ in range(1500)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", verdict.years_asked(F.col("t"))["most"].alias("most")).collect()
    gated = regex.compile(r"\d\s*(?:\+|[-–—]\s*\d{1,2})?\s*years?\b", regex.I)
    for r in rows:
        said = [int(m[1]) for p in patterns for m in p.finditer(r.t) if int(m[1]) <= 30]
        assert r.most == (max(said, default=None) if gated.search(r.t) else None), r.t
    assert sum(r.most is not None for r in rows) > 500 and sum(r.most is None for r in rows) > 100


def test_a_short_list_of_profiles_meets_postings_without_a_join(spark):
    rows = as_postings(spark.createDataFrame([(str(k), "Data Engineer", "Python", ["Python"]) for k in range(20)], "job_id string, title string, description string, skills array<string>"))
    quoted = verdict.Profile(id="p'\"2\\", label="Zoë\n", target_titles=["Nurse"], resume_text='says "so" \\ too')
    fits = verdict.profile_fits(rows, [verdict.Profile(id="p1", target_titles=["Data Engineer"], skills=["python"]), quoted])
    assert "Join" not in fits._jdf.queryExecution().optimizedPlan().toString()  # by a profile's number all postings would meet in one task
    assert {tuple(r) for r in fits.groupBy("profile_id", "label").count().collect()} == {("p1", "", 20), ("p'\"2\\", "Zoë\n", 20)}
    assert verdict.profile_fits(rows, []).count() == 0


def test_pairs_of_feeds_are_not_shuffled(spark):
    """Where profiles are too many to be broadcast, no exchange holds a posting's facts together with a profile."""
    rows, table = feeds.rich_postings(spark, SF), feeds.profile_table(spark, SF)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString(profiles.feeds(rows, table, semantic="semantic")._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    inputs = [line for part in plan.split("\n\n") if re.match(r"\(\d+\) Exchange", part.strip()) for line in part.split("\n") if line.startswith("Input")]
    facts = [line for line in inputs if "_firsts#" in line]
    assert facts and not any(re.search(r"\b(?:id|p|profile_id|_has)#", line) for line in facts)


def test_a_pair_of_several_fitting_roles_is_judged_once(spark, tmp_path):
    """Also where both roles share a bucket, and with tables stored first; rows of one profile id are judged by their own roles."""
    jobs = as_postings(spark.createDataFrame([(str(k), t, "Python", ["Python"]) for k, t in enumerate(["Senior Data Engineer", "Data Scientist", "Nurse", "", "Machine Learning Engineer, Data"])], "job_id string, title string, description string, skills array<string>"))
    wishes = [("a", ["Data Engineer", "Data", "Senior Data Engineer", "Data Engineer"]), ("b", ["Nurse"]), ("b", ["Data Scientist"]), ("c", []), ("d", [" "])]
    table = spark.createDataFrame([(i, t, ["python"], []) for i, t in wishes], "id string, target_titles array<string>, skills array<string>, countries array<string>")
    plain = [(r.profile_id, r.job_id) for r in profiles.feeds(jobs, table).collect()]
    stored = [(r.profile_id, r.job_id) for r in profiles.feeds(jobs, table, home=str(tmp_path / "home")).collect()]
    assert sorted(plain) == sorted(stored) and len(plain) == len(set(plain)) and {("a", "0"), ("b", "1")} <= set(plain) and not {i for i, _ in plain} & {"c", "d"}


def _odd(draw: random.Random, spark, many: int):
    """Postings and profiles with missing, empty and unknown values of every kind."""
    pick = lambda *x: draw.choice([None, *x])
    bag = lambda x, n: draw.choices(x, k=draw.randrange(n))
    titles = ["Data Engineer", "Senior Data Engineer II", " data ", "ML", "Registered Nurse, Data", "Machine Learning Engineer (Radar)", "Junior Platform Engineer", "SAP FICO Data Consultant", "Salesforce Data Engineer Intern", "Director of Data Science", "", "Firmware Engineer"]
    texts = [*feeds.STATEMENTS, "We use Python, SQL and react; radar.", "PhD and 1 year, or MS and 3 years, of experience with data pipelines and security.", "Bachelor and 0 years"]
    jobs = [{
        "job_id": str(k), "title": pick(*titles), "company": pick("Acme", " GLOBEX", "Raytheon"), "location_raw": pick(*feeds.PLACES), "country": pick("us", "gb", " ", "US "), "remote_mode": pick("remote", "hybrid", "unknown"), "description": pick(*texts), "skills": draw.choice([None, [], bag([*feeds.SKILLS, " ", "!", "R", "c++", "Python "], 9)]),
        "yoe_min": pick(0, 2, 3, 4, 6), "seniority": pick("unclear", "mid", "senior", "intern", "odd"), "visa_sponsorship": pick("no", "yes", "unclear", "not_mentioned"), "security_clearance": pick("required", "none"), "citizenship_required": pick(True, False), "new_grad_program": pick(True, False),
        "cap_exempt": pick("yes", "no", "likely"), "employer_type": pick("university"), "known_h1b_sponsor": pick(True, False), "enrichment_status": pick("done", "failed"), "is_recruiter_post": pick(True, False),
    } for k in range(many)]
    types = {f.name: f.dataType.simpleString() for f in as_postings(spark.createDataFrame([("x",)], "job_id string")).schema if f.name in jobs[0]}
    given = spark.createDataFrame([tuple(j[c] for c in types) + (pick(0.0, 0.65, 1.0, 1.7, -1.0, float("nan"), draw.random()),) for j in jobs], ", ".join(f"{k} {v}" for k, v in types.items()) + ", semantic double")
    rows = given.withColumns({c: F.lit(None).cast("string") for c in ("work_auth_required", "restrictions")})  # not by as_postings: nulls stay
    own = [{
        "id": str(k % (many // 2)), "target_titles": bag([*feeds.TARGETS, " ", "Radar", "Data"], 5), "interests": bag([*feeds.INTERESTS, " "], 4), "skills": bag([*feeds.OWN, "", "Python "], 7), "resume_text": pick("", "PhD in c++ and kubernetes.", "Master: SAP, Rust", "I know R, pythn"), "seniority_max": draw.choice(["junior", "mid", "director", "any"]),
        "yoe_max": draw.randrange(5), "needs_sponsorship": draw.random() < 0.4, "reject_clearance": draw.random() < 0.4, "reject_citizenship_only": draw.random() < 0.4, "countries": draw.choice([[], [], ["US"], ["gb", "us"], [" "], ["fr"]]), "excluded_companies": bag(["globex", "", "none"], 3), "remote_preference": draw.choice(["any", "remote", "unknown", "hybrid"]),
    } for k in range(many)]
    return rows, [verdict.Profile(**p) for p in own], spark.createDataFrame([tuple(p.get(f.name) for f in PROFILE) for p in own], PROFILE)


def test_rules_of_blocks_equal_rules_of_columns(spark, monkeypatch):
    """Every column of every pair, on odd values, with profiles in several blocks and ids that several profiles share."""
    rows, own, table = _odd(random.Random(11), spark, 90)
    both = verdict.with_profiles(rows.cache(), [p for p in own if p.target_titles])
    alone = verdict.judged(both.withColumns({"profile_id": F.col("p.id"), "_t": F.expr(verdict.STAGES[0]["_title"])}), "semantic").where("NOT (verdict = 'reject' AND score = 0)").select("_t", "profile_id", "job_id", *verdict.VERDICT).cache()
    monkeypatch.setattr(profiles, "BLOCK", 40)
    for least in (0.75, 0.5):
        wanted = sorted(map(repr, (tuple(r)[1:] for r in alone.where(f"_t >= {least}").collect())))
        found = profiles.feeds(rows, table, least, "semantic")
        assert sorted(map(repr, map(tuple, found.collect()))) == wanted and len(wanted) > 150
    size = lambda x: found.select(*[F.size(c).alias(c) if c in ("red_flags", "matched", "gaps") else c for c in x.columns])
    short = profiles.feeds(rows, table, 0.5, "semantic", texts=False)
    assert sorted(map(repr, map(tuple, short.collect()))) == sorted(map(repr, map(tuple, size(short).collect())))
    assert {r.verdict for r in short.collect()} == {"apply", "flag", "reject"}


def test_profiles_of_one_id_are_judged_by_their_own_skills(spark):
    jobs = as_postings(spark.createDataFrame([("1", "Data Engineer", ["Python", "Spark"])], "job_id string, title string, skills array<string>"))
    table = spark.createDataFrame([("a", ["Data Engineer"], s, []) for s in (["python"], ["rust"])], "id string, target_titles array<string>, skills array<string>, countries array<string>")
    assert sorted(r.matched for r in profiles.feeds(jobs, table).collect()) == [[], ["Python"]]


def test_two_million_pairs_are_judged_in_seconds():
    """As columns they took minutes."""
    own = [verdict.compiled(verdict.Profile(id=str(k), target_titles=["Data Engineer"], skills=["python", f"skill {k % 40}"], seniority_max=["mid", "any"][k % 2], yoe_max=k % 4, countries=[], resume_text=[None, "rust"][k % 2])) | {"_has": ["python"] if k % 3 else []} for k in range(4000)]
    job = {c: None for c in [*pairs.FACTS, "_similar"]} | {c: False for c in ("_abroad", "_no_visa", "_cleared", "_citizens", "_new_grad", "_early", "_shown_early", "_care", "_unread", "_silent", "_exempt", "_h1b", "_recruits")} | {c: [] for c in ("_families", "_special", "_loose", "_interests", "_interest_words", "_named")}
    job |= {"_name": "data engineer", "_words": ["data", "engineer"], "_targets": ["data engineer"], "_firsts": [{"raw": s, "skill": s, "low": s} for s in ("python", "rust", "sap")], "_many": 3, "_years": [2, 2, 2, 2], "_level": "mid"}
    begun, block = time.process_time(), pairs.Block(own)
    parts = block.judge([job | {"job_id": str(k)} for k in range(500)], texts=False)
    assert sum(len(p["score"]) for p in parts) == 500 * 3000 and time.process_time() - begun < 30  # two years are too many for profiles of none
    assert parts[0]["matched"].tolist() == [(int(i) % 3 > 0) + int(i) % 2 for i in parts[0]["profile_id"]]
