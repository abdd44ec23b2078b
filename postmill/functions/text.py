"""Text functions as native column expressions: normal forms, keys, classes and places."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lists


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: an expression that is named twice is computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def one_of(words: list[str]) -> str:
    """A pattern for any of the words, the longest first."""
    return "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.regexp_like(text, F.lit(one_of(words)))


def first_class(text: Column, classes: dict[str, list[str]], default: Column | str) -> Column:
    """The first class of which the text contains a word."""
    out = F.lit(default) if isinstance(default, str) else default
    for name, words in reversed(classes.items()):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case, no punctuation, no legal suffixes at the end, single spaces."""
    plain = F.regexp_replace(F.lower(empty(text)), r"(?U)[^\w\s]", " ")
    return squeeze(F.regexp_replace(plain, rf"(?U)(?:\s*\b(?:{'|'.join(lists.COMPANY_SUFFIXES)})\b)+\s*$", ""))


def normalize_title(title: Column) -> Column:
    bare = F.regexp_replace(empty(title), r"\([^)]*\)|\[[^\]]*\]", " ")
    return normalize_text(F.regexp_replace(bare, rf"(?iU)\b(?:{'|'.join(lists.WORK_MODE_WORDS)})\b", " "))


def posting_id(company: Column, title: Column, city: Column) -> Column:
    """16 hex digits over the normal forms: equal for reposts of a role."""
    parts = F.concat_ws("|", normalize_text(company), normalize_title(title), normalize_text(city))
    return F.substring(F.sha2(parts.cast("binary"), 256), 1, 16)


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(empty(text), "<[^>]+>", " ")


def unescape(text: Column) -> Column:
    """The character references that postings use; any other is decoded by ``sources.decode_entities``."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&bull;": "•", "&hellip;": "…", "&copy;": "©", "&middot;": "·"}
    out = empty(text)
    for reference, sign in named.items():
        out = F.replace(out, F.lit(reference), F.lit(sign))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def plain_text(text: Column) -> Column:
    return squeeze(strip_tags(unescape(text)))


def category(title: Column) -> Column:
    return first_class(F.lower(empty(title)), lists.CATEGORIES, "other")


def employment_label(raw: Column) -> Column:
    return first_class(F.lower(empty(raw)), lists.EMPLOYMENT_LABELS, "unknown")


def employment_type(title: Column, description: Column) -> Column:
    body = F.substring(F.lower(empty(description)), 1, 3000)
    return first_class(F.lower(empty(title)), lists.EMPLOYMENT_IN_TITLE, first_class(body, lists.EMPLOYMENT_IN_TEXT, "full_time"))


def new_grad(title: Column, description: Column) -> Column:
    plain = F.regexp_replace(strip_tags(unescape(description)), r"(?U)\s+", " ")
    loose = contains_any(F.lower(F.substring(plain, 1, 800)), lists.NEW_GRAD)
    return contains_any(F.lower(empty(title)), lists.NEW_GRAD) | F.regexp_like(plain, F.lit(lists.NEW_GRAD_LABEL)) | loose


def remote_mode(raw: Column) -> Column:
    return first_class(F.lower(empty(raw)), lists.REMOTE_WORDS, "unknown")


def _word(text: Column, words: list[str]) -> Column:
    return F.regexp_like(text, F.lit(rf"\b(?:{one_of(words)})\b"))


def _token(text: Column, words: list[str]) -> Column:
    """A run of letters that is one of the words."""
    return F.regexp_like(text, F.lit(rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"))


def _state_code(text: Column) -> Column:
    return F.regexp_like(text, F.lit(rf",\s*(?:{'|'.join(lists.US_STATES)})\b"))


def _foreign(text: Column) -> Column:
    return _word(text, lists.FOREIGN_PLACES + lists.FOREIGN_CITIES)


def us_signal(place: Column) -> Column:
    strong = contains_any(place, ["united states", "u.s."]) | _token(place, ["usa", "us", "america"]) | contains_any(place, lists.US_STATE_NAMES)
    return strong | (~_foreign(place) & (_state_code(place) | contains_any(place, lists.US_CITIES)))


def is_us(country: Column, location: Column, mode: Column, title: Column) -> Column:
    """Whether a posting belongs on a US board: rules on country, then place, then work mode, then title."""
    c, place, name = (F.lower(F.trim(empty(x), F.lit(" \t\r\n"))) for x in (country, location, title))
    foreign_title = (name != "") & _foreign(name)
    parts = F.filter(F.transform(F.split(place, ";"), lambda x: F.trim(x)), lambda x: x != "")
    named = lambda x: contains_any(x, ["united states", "u.s."]) | _token(x, ["usa", "us"]) | _state_code(x)
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"\bremote\b", " "), "[^a-z ]", " "), r"\s+", " "))
    signal = us_signal(place)
    return (
        F.when((c != "") & ~c.isin(lists.US_NAMES), (F.size(parts) > 1) & F.exists(parts, named))
        .when(signal, True)
        .when(c != "", F.when(_word(place, lists.FOREIGN_PLACES), False).otherwise(~foreign_title))
        .when(mode == "remote", rest.isin(lists.GENERIC_REMOTE) & ~foreign_title)
        .otherwise(False)
    )


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(empty(text)), "[^a-z0-9]", "")


def slug_variants(name: Column) -> Column:
    """The slug, and those without a legal or generic suffix; distinct, in order."""
    bare = F.regexp_replace(F.lower(empty(name)), r"[\s,]+(?:inc|llc|ltd|corp|co|technologies|technology|labs|group|holdings)\.?$", "")
    hyphened = F.regexp_replace(F.trim(F.lower(empty(name))), r"[^a-z0-9]+", "-")
    return F.array_distinct(F.filter(F.array(slug(name), slug(bare), hyphened), lambda x: x != ""))


def canonical_skill(skill: Column) -> Column:
    cleaned = squeeze(F.regexp_replace(F.lower(F.trim(empty(skill))), "[^a-z0-9+#./ -]", " "))
    aliases = F.create_map(*[F.lit(x) for pair in lists.SKILL_ALIASES.items() for x in pair])
    single = F.when((F.length(cleaned) > 4) & cleaned.endswith("s") & ~cleaned.endswith("ss"), F.try_element_at(aliases, F.substring(cleaned, F.lit(1), F.length(cleaned) - 1)))
    return F.coalesce(F.try_element_at(aliases, cleaned), single, cleaned)


def bounded_context(text: Column, limit: int, marker: str = "\n[...]\n") -> Column:
    """The text, or its first two thirds and last third of ``limit`` characters around a marker."""
    head = limit * 2 // 3
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(head)), F.lit(marker), F.right(text, F.lit(limit - head))))


def name_parts(name: Column) -> tuple[Column, Column]:
    """A name before its file extension, and that."""
    return tuple(F.regexp_extract(name, r"^(.*?)(\.[A-Za-z0-9]{1,5})?$", k) for k in (1, 2))


def numbered_names(name: Column, turn: Column) -> Column:
    """``name (2)`` for the second of a name, before a file extension."""
    base, extension = name_parts(name)
    return F.when(turn <= 1, name).otherwise(F.concat(base, F.lit(" ("), turn.cast("string"), F.lit(")"), extension))


#: Words that a label writes in a way of their own, and those that it leaves small; signs that LaTeX reads as its own.
LABEL_ACRONYMS = {
    "ai": "AI", "ml": "ML", "genai": "GenAI", "llm": "LLM", "nlp": "NLP", "api": "API", "apis": "APIs", "ui": "UI", "ux": "UX", "sql": "SQL", "aws": "AWS", "gcp": "GCP", "devops": "DevOps", "mlops": "MLOps",
    "ci": "CI", "cd": "CD", "it": "IT", "qa": "QA", "hr": "HR", "bi": "BI",
}
LABEL_SMALL_WORDS = ["and", "or", "of", "for", "the", "in", "to", "with", "&"]
LATEX = {"&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
SENIOR_MARKS = r"(?i)\b(?:founding|senior|sr|staff|principal|lead|director|head|vp|chief|manager|architect|ii|iii|iv)\b"


def junior_title(title: Column) -> Column:
    """No mark of a senior role."""
    return ~F.regexp_like(empty(title), F.lit(SENIOR_MARKS))


def label(raw: Column) -> Column:
    """``some_name`` as Some Name; a label that has capitals is left as it is."""
    plain = squeeze(F.translate(empty(raw), "_-", "  "))
    acronyms = F.create_map(*[F.lit(x) for pair in LABEL_ACRONYMS.items() for x in pair])
    words = F.transform(F.split(plain, " "), lambda w, k: F.coalesce(F.try_element_at(acronyms, w), F.when((k > 0) & w.isin(LABEL_SMALL_WORDS), w), F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1_000_000))))
    return F.when((plain == "") | (F.lower(plain) != plain) | (F.upper(plain) == plain), plain).otherwise(F.array_join(words, " "))


def latex(raw: Column) -> Column:
    """A text that LaTeX prints as it is; long dashes become shorter."""
    out = F.replace(empty(raw), F.lit("\\"), F.lit("\x00"))
    for sign, written in LATEX.items():
        out = F.replace(out, F.lit(sign), F.lit(written))
    return F.replace(F.replace(out, F.lit("\x00"), F.lit(r"\textbackslash{}")), F.lit("—"), F.lit("–"))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256), 1, length)


def keyword_match(title: Column, keywords: list[str], phrase: bool = False) -> Column:
    """Any of the keywords, or with ``phrase`` all of them joined by a space, in the title; no keywords match all."""
    wanted = [" ".join(keywords)] if phrase else keywords
    wanted = [w.lower() for w in wanted if w]
    return contains_any(F.lower(empty(title)), wanted) if wanted else F.lit(True)
