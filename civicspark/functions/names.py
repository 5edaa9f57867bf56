"""Names, roles, identifiers and labels found in text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Titles before and roles behind a person's name.
TITLES = [
    "chairperson", "chairman", "chairwoman", "vice chair", "vice-chair", "vice chairperson", "vice-chairperson", "councilmember", "council man",
    "council woman", "commissioner", "mayor", "vice mayor", "vice-mayor", "dr", "dr.", "honorable", "hon.", "the honorable", "mr", "mr.", "mrs",
    "mrs.", "ms", "ms.", "mx", "mx.", "attorney", "esq", "esq.",
]
ROLES = [
    "chair", "vice chair", "vice-chair", "councilmember", "commissioner", "attorney", "atty", "esq", "planner", "agent", "representative", "rep",
    "manager", "director", "president", "vice president", "ceo", "cfo", "member", "chairman", "chairwoman", "chairperson", "interim director",
    "assistant director", "senior planner", "associate planner", "principal planner",
]
# Legal forms behind an organisation's name.
LEGAL_FORMS = [
    r"P\.?L\.?C\.?", r"P\.?L\.?L\.?C\.?", r"P\.?C\.?", r"P\.?A\.?", r"L\.?L\.?C\.?", r"I\.?N\.?C\.?", r"L\.?T\.?D\.?", r"C\.?O\.?R\.?P\.?",
    r"L\.?L\.?P\.?", r"C\.?O\.?",
]


def _alternatives(words: list[str]) -> str:
    """Longest first, so that no word hides one it begins."""
    return "|".join(w.replace(".", "\\.").replace(" ", "\\s+") for w in sorted(words, key=lambda w: (-len(w), w)))


def _squeeze(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, "\\s+", " "))


def person_key(name: Column) -> Column:
    """A person's name without title, role and punctuation, in lower case."""
    bare = F.regexp_replace(F.trim(name), f"(?i)^(?:{_alternatives(TITLES)})(?:\\s+|$)", "")
    bare = F.regexp_replace(bare, f"(?i),\\s*(?:{_alternatives(ROLES)})\\s*$", "")
    return F.regexp_replace(_squeeze(F.regexp_replace(F.lower(_squeeze(bare)), "(?U)[^\\w\\s'-]", "")), "^the\\s+", "")


def entity_key(name: Column) -> Column:
    """An organisation's or case's name without legal form, hyphens and punctuation, in lower case."""
    bare = F.regexp_replace(_squeeze(name), rf"(?i)\s+(?:{'|'.join(LEGAL_FORMS)})\.?\s*$", "")
    bare = F.replace(F.replace(bare, F.lit("&"), F.lit(" and ")), F.lit("-"), F.lit(""))
    return F.regexp_replace(_squeeze(F.regexp_replace(F.lower(bare), "(?U)[^\\w\\s']", "")), "^the\\s+", "")


def is_firm(name: Column) -> Column:
    """Whether a name carries a legal form or a firm's word."""
    return name.rlike("(?i)\\b(?:llc|l\\.l\\.c|inc|corp|ltd|llp|company|group|associates|partners|holdings|properties|development|engineering|architects)\\b")


def hearing_kind(text: Column) -> Column:
    """CALL, HEARING, VOTE, STUDY, DEVELOPMENT or ITEM, the first that applies."""
    # Words of each kind, in order.
    up = F.upper(text)
    has = up.contains
    return (
        F.when(has("HEARING") & (has("CALL FOR") | has("SCHEDULE") | has("SET")), "CALL").when(has("HEARING") | (has("ORDINANCE") & has("INTRODUCE")), "HEARING")
        .when(has("ORDINANCE") | has("RESOLUTION"), "VOTE").when(has("STUDY") | has("DISCUSSION") | has("UPDATE"), "STUDY")
        .when(up.rlike("PLANNED AREA|GENERAL PLAN|ZONING|USE PERMIT|SUBDIVISION|PLAT"), "DEVELOPMENT").otherwise("ITEM")
    )


def verb_key(verb: Column) -> Column:
    """A verb as a lookup key."""
    return F.replace(F.lower(_squeeze(verb)), F.lit(" "), F.lit("_"))


def role_of(pattern: Column, title: Column) -> Column:
    """Canonical role from the pattern that found a name and its title; vice chair before chair."""
    # Patterns and words of each role, in order.
    t = F.lower(F.trim(title))
    by_pattern = F.when(pattern.isin("dash_name_role", "presented_by", "info_name", "eol"), "presenter").when(pattern == "line_role", "board_member").otherwise("participant")
    return (
        F.when(pattern == "applicant", "applicant").when(pattern == "staff_call", "staff").when(t.contains("vice"), "vice_chair").when(t.contains("chair"), "chair")
        .when(t.contains("commissioner"), "commissioner").when(t.contains("member"), "board_member")
        .when(t.rlike("director|manager|planner|leader|assistant|staff|president|secretary|treasurer"), "staff").when(t.contains("applicant"), "applicant").otherwise(by_pattern)
    )


def case_numbers(text: Column) -> Column:
    """Distinct case numbers like ``Z-101-26`` or ``CPA2024012``, in upper case without white space."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?i)\\b((?:CPA|GPA|ZON|Z|UP|SUP|PAD|DR|BA)-?\\d{2,4}-\\d{1,5}(?:-\\d+)?|(?:CPA|GPA|ZON)\\d{6,8})\\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.upper))


def parcel_numbers(text: Column) -> Column:
    """Distinct parcel numbers like ``123-45-678A``."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\b(\\d{3}-\\d{2}-\\d{3}[A-Z]?)\\b"), F.lit(1)))


def iso_date(text: Column) -> Column:
    """``M/D/Y`` or ``Month d, yyyy`` as an ISO date, null for neither."""
    formats = ["M/d/yyyy", "M/d/yy", "MMMM d, yyyy", "MMM d, yyyy"]
    return F.date_format(F.coalesce(*[F.try_to_date(F.trim(text), f) for f in formats]), "yyyy-MM-dd")
