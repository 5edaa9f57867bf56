"""Labels, checks and scores of meetings, names, permits and texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from civicspark.functions.text import LIFECYCLE, first_match, lifecycle


def _text(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _words(value: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(F.trim(_text(value)), r"\s+"), lambda w: w != "")


def _has(value: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.contains(value, w))


def _starts(value: Column, words: list[str]) -> Column:
    return F.exists(F.lit(words), lambda w: F.startswith(value, w))


# Titles that say no more than a meeting's type, and patterns of titles without context.
PLAIN_TITLES = ["formal", "informal", "special", "executive", "formal meeting", "informal meeting", "special meeting", "executive meeting"]
MEETING_KINDS = ["formal", "informal", "special", "executive"]
NO_CONTEXT = [r"^\d+$", r"(?i)board of supervisors", r"(?i)planning\s+and\s+zoning", r"(?i)bos\s*auditorium|gotowebinar|webinar"]


def meeting_context(title: Column) -> Column:
    """What a title says beyond body and type: ``Emergency``, what follows a slash, or the whole title; else null."""
    t = F.trim(_text(title))
    low = F.lower(t)
    after = F.trim(F.regexp_extract(t, r"/(.+)$", 1))
    rest = F.trim(F.regexp_replace(low, r"\b(?:formal|informal|special|executive|meeting)\b", ""))
    return (
        F.when((t == "") | low.isin(PLAIN_TITLES) | t.rlike("|".join(NO_CONTEXT)), None)
        .when(low.rlike(r"\bemergency\s+meeting\b"), "Emergency").when((after != "") & ~F.lower(after).isin(MEETING_KINDS), after)
        .when(low.rlike(r"\bspecial\s*/\s*."), F.trim(F.regexp_extract(low, r"\bspecial\s*/\s*(.+)", 1))).when(F.length(rest) > 3, t)
    )


def lifecycle_with_action(text: Column, action: Column) -> Column:
    """State of an item by its recorded action if that tells one, else by its text."""
    states = [(label, [f"(?i:{p})" for p in patterns]) for label, patterns in LIFECYCLE if label != "informational"]
    return F.coalesce(F.nullif(first_match(_text(action), states, "none"), F.lit("none")), lifecycle(text))


# Words of a vote or action, the first that occurs counts.
ACTIONS = ["no action", "received and filed", "approved", "adopted", "passed", "failed", "denied", "continued", "held", "postponed"]


def vote_or_action(text: Column) -> Column:
    """The first of ACTIONS that occurs as words of a text, or empty."""
    return first_match(F.lower(_text(text)), [(a, [rf"\b{a}\b"]) for a in ACTIONS], "")


# Words of organisations' names.
ORGANISATION_WORDS = [
    "llc", "inc", "plc", "ltd", "corp", "corporation", "company", "group", "firm", "partnership", "consulting", "planning", "engineering", "law ", "office",
    "pa ", "pc ", "llp", "association", "incorporated", "development", "properties", "management", "services", "architecture", "construction", "design",
    "homes", "church", "assembly of god", "university", "hospital", "district", "department", "commission", "committee", "board of", "city of", "town of",
    "county of", "architect", "attorney", "engineer", "solutions",
]


def entity_type(name: Column) -> Column:
    """``organization`` for a name with an organisation's word, a comma or one word only, else ``person``."""
    return F.when(_has(F.lower(name), ORGANISATION_WORDS) | name.contains(",") | (F.size(_words(name)) <= 1), "organization").otherwise("person")


# Legal forms behind a name, and places that a candidate's name may end with.
LEGAL_FORMS = ["PC", "PLC", "PLLC", "LLC", "Inc", "Corp", "Ltd", "Co", "PA", "LLP", "LP"]
PLACES = ["arizona", "maricopa", "phoenix", "chandler", "mesa", "glendale", "tempe", "scottsdale", "peoria", "surprise"]


def hyphenated_key(name: Column) -> Column:
    """A name in lower case without legal forms and punctuation, hyphens kept."""
    bare = F.replace(F.replace(F.trim(name), F.lit("&"), F.lit(" and ")), F.lit("."), F.lit(""))
    bare = F.regexp_replace(bare, rf"(?i)(?:\s+(?:{'|'.join(LEGAL_FORMS)}))+\s*$", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(bare), r"(?U)[^\w\s'-]", ""), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(bare, r"^the\s+", ""), r"\band\s+and\b", "and")


def candidate_key(name: Column) -> Column:
    """:func:`hyphenated_key` without the places at its end, in the order of PLACES."""
    out = hyphenated_key(name)
    for place in PLACES:
        out = F.regexp_replace(out, f" {place}$", "")
    return out


# What text that is no name begins with, and single words that are none.
GARBAGE_STARTS = [
    "recommendation", "recommends", "staff", "applicant", "owner", "attorney", "council", "notice", "meeting", "minutes", "attachment", "appealed", "occupied",
    "membership", "announcement", "memo", "office", "department", "solicited", "s and the", "s, and", ", and continue", ", the case", "by: ___",
]
GARBAGE_WORDS = ["memo", "attendance", "report", "general", "liaison", "person", "overview", "presentation", "summary"]


def is_garbage(name: Column) -> Column:
    """Whether an extracted name is a heading or a fragment of a sentence."""
    n = F.trim(_text(name))
    low = F.lower(n)
    few = (F.size(_words(n)) <= 2) & (n.rlike(r"^\p{Ll}") | low.isin(GARBAGE_WORDS))
    cut = (n.startswith(",") & (F.length(n) > 5)) | (n.startswith(".") & (F.length(n) > 2)) | n.startswith("'")
    return (n == "") | _starts(low, GARBAGE_STARTS) | few | cut


# Words that no name begins with, and names they are allowed in.
FILLERS = ["the ", "and ", "to ", "for ", "of ", "a ", "an ", "in ", "on ", "is ", "it ", "be "]
FILLER_ALLOWED = ["church", "city of", "town of", "county of", "state of"]


def is_valid_match(name: Column, longest: int = 100) -> Column:
    """Whether a matched name has 2 to ``longest`` characters and begins with no filler, but for public bodies and churches."""
    low = F.lower(_text(name))
    return F.length(low).between(2, longest) & (~_starts(low, FILLERS) | _has(low, FILLER_ALLOWED))


def is_person_name(name: Column, known_names: list[str]) -> Column:
    """Whether a name has a known first or last name and the shape of a person's name: at most three words and 35 characters, no digits, not all in capitals or all in lower case."""
    n = F.trim(_text(name))
    words = _words(n)
    shaped = (F.size(words) <= 3) & F.length(n).between(2, 35) & ~n.rlike(r"\d") & ~((F.upper(n) == n) & (F.length(n) > 4))
    lower = (F.size(words) >= 2) & F.forall(words, lambda w: w.rlike(r"^\p{Ll}"))
    return shaped & ~lower & F.arrays_overlap(F.split(F.lower(n), r"\s+"), F.lit(known_names))


def is_candidate(name: Column, keywords: list[str], generic: list[str], phrases: list[str]) -> Column:
    """Whether a phrase may name an entity.

    It has five characters and two words or more, most and at least two of them
    capitalised and none a number; it is none of the ``phrases``, and its words
    are not all ``generic`` ones, but for a last word among the ``keywords``.
    """
    n = F.trim(_text(name))
    words = _words(n)
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^\.+|\.+$", ""))
    capitals = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    known, common = F.lit(keywords), F.lit(generic)
    after, before = F.slice(plain, 2, F.greatest(F.size(plain) - 1, F.lit(0))), F.slice(plain, 1, F.greatest(F.size(plain) - 1, F.lit(0)))
    telling = F.exists(after, lambda w: (F.length(w) > 4) & ~F.array_contains(common, w) & ~F.array_contains(known, w))
    return (
        (F.length(n) >= 5) & (F.size(words) >= 2) & (capitals >= 2) & (capitals * 2 >= F.size(words)) & ~F.exists(words, lambda w: w.rlike(r"^\d+$"))
        & ~candidate_key(n).isin(phrases) & (F.array_contains(known, F.element_at(plain, F.greatest(F.size(plain), F.lit(1)))) | ~F.forall(before, lambda w: F.array_contains(common, w)))
        & ~F.forall(after, lambda w: F.array_contains(common, w)) & (telling | (F.size(words) <= 2))
    )


# Patterns of a monitor's error categories, the first counts.
MONITOR_ERRORS = [
    ("duplicate_item", ["(?i)UNIQUE constraint failed"]), ("no_items", ["(?i)No agenda items found"]), ("format_error", ["(?i)Unsupported agenda format"]),
    ("timeout", ["(?i)Timeout|timed out"]), ("db_corrupt", ["(?i)database disk image is malformed"]),
]


def monitor_error(message: Column) -> Column:
    """A monitor's category of an error; ``none`` without a message, ``unknown`` for any other."""
    return F.when(_text(message) == "", "none").otherwise(first_match(_text(message), MONITOR_ERRORS, "unknown"))


# Jurisdictions before a body's name.
JURISDICTIONS = [
    "Maricopa County", "Paradise Valley", "Queen Creek", "El Mirage", "Avondale", "Buckeye", "Chandler", "Gilbert", "Glendale", "Goodyear", "Mesa", "Peoria",
    "Phoenix", "Scottsdale", "Surprise", "Tempe",
]


def without_jurisdiction(body: Column) -> Column:
    """A body's name without its jurisdiction."""
    return F.regexp_replace(_text(body), f"^(?:{'|'.join(JURISDICTIONS)}) ", "")


def short_label(jurisdiction: Column, body: Column, short_forms: dict[str, str], most: int = 26) -> Column:
    """Jurisdiction and body in ``most`` characters, with an ellipsis if cut; the first short form whose pattern holds the body's name, or is held by it, stands for it."""
    short = F.coalesce(*[F.when(body.contains(p) | F.contains(F.lit(p), body), s) for p, s in short_forms.items()], F.substring(body, 1, 24))
    whole = F.concat_ws(" ", jurisdiction, short)
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("…"))).otherwise(whole)


# Names of county bodies and ends of city bodies' codes.
COUNTY_BODIES = {
    "bos": "Maricopa County Board of Supervisors", "pz": "Maricopa County Planning & Zoning", "adj": "Maricopa County Board of Adjustment",
    "health": "Maricopa County Board of Health", "tab": "Maricopa County Transportation Advisory Board", "ida": "Maricopa County Industrial Development Authority",
}
CODE_ENDS = {
    "CC": "City Council", "PZ": "Planning & Zoning", "PC": "Planning Commission", "DRC": "Development Review Commission", "DRB": "Development Review Commission",
    "BOA": "Board of Adjustment", "HPC": "Historic Preservation Commission", "HA": "Housing Authority", "JRC": "Joint Review Committee", "RIO": "Rio Salado CFD",
    "RMT": "Risk Management Trust", "TC": "Town Council",
}


def _looked_up(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def body_name(code: Column, names: dict[str, str] | None = None) -> Column:
    """Name of a body by its code: by ``names`` or the county's, else city and kind by the code's ends."""
    end = F.upper(F.substring_index(code, "-", -1))
    city = F.initcap(F.substring_index(code, "-", 1))
    county = F.concat(F.lit("Maricopa County "), F.upper(F.replace(F.substring(code, F.lit(4), F.length(code)), F.lit("-"), F.lit(" "))))
    return F.coalesce(
        _looked_up(COUNTY_BODIES | (names or {}), code), F.when(code.startswith("mc-"), county),
        F.when(code.contains("-"), F.concat_ws(" ", city, F.coalesce(_looked_up(CODE_ENDS, end), end))), F.initcap(code),
    )


def local_date(instant: Column, zone: str = "America/Phoenix", pattern: str = "MMMM dd, yyyy") -> Column:
    """Day of a UTC instant in a zone; empty for null."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(instant, zone), pattern), F.lit(""))


# Labels of relationships that are not their code in title case.
RELATIONSHIPS = {
    "HAS_APPLICANT": "Applicant", "HAS_ATTORNEY": "Attorney", "HAS_STAFF": "Staff", "HAS_RECOMMENDATION": "Recommendation", "HAS_VENDOR": "Vendor",
    "HAS_CONSULTANT": "Consultant", "MOTION_MADE": "Motion",
}


def relationship_label(code: Column) -> Column:
    return F.coalesce(_looked_up(RELATIONSHIPS, code), F.initcap(F.replace(code, F.lit("_"), F.lit(" "))))


# Points of topics and of development details.
TOPIC_POINTS = {
    "bonds-finance": 40, "policy-planning": 35, "infrastructure": 25, "homelessness": 30, "development-pipeline": 15, "annexation": 20, "enforcement-signals": 10,
}
DOLLAR_POINTS = [(10_000_000, 50), (1_000_000, 20), (100_000, 10), (10_000, 5)]
REPEATED = ["homeless", "shelter", "amendment", "iga with"]
DETAIL_POINTS = [("unit", 5, 8), ("lot", 5, 8), ("space", 5, 8), ("parking", 20, 10), ("acre", 2, 12), ("stor", 3, 8)]


# Measures of land use and words of districts.
LAND_USE = r"(\d+\s*(?:spaces?|parking|units?|lots?|acres?|sf|sq\s*ft|stories?))"
DISTRICTS = "(city center|downtown|historic|overlay|specific plan)"


def impact_score(topic: Column, title: Column, text: Column, body: Column) -> Column:
    """Points of a suggestion: dollar amounts, topic, body, repeated words, development details and districts."""
    all_text = F.lower(F.concat_ws(" ", _text(title), _text(text)))
    total = lambda values, points: F.aggregate(values, F.lit(0), lambda a, x: a + points(x))

    def dollars(x: Column) -> Column:
        n = F.regexp_replace(x, "[$,]", "").try_cast("decimal(38,0)")
        out = F.lit(0)
        for least, points in reversed(DOLLAR_POINTS):
            out = F.when(n >= least, points).otherwise(out)
        return out

    def details(x: Column) -> Column:
        n, unit = F.regexp_extract(x, r"^(\d+)", 1).try_cast("decimal(38,0)"), F.regexp_extract(x, r"^\d+\s*(.*)$", 1)
        out = F.lit(0)
        for word, least, points in reversed(DETAIL_POINTS):
            out = F.when(unit.startswith(word) & (n >= least), points).otherwise(out)
        return out

    repeated = F.exists(F.lit(REPEATED), lambda w: F.length(all_text) - F.length(F.replace(all_text, w, F.lit(""))) > 3 * F.length(w))
    found = F.regexp_extract_all(all_text, F.lit(LAND_USE), F.lit(1))
    districts = F.size(F.regexp_extract_all(all_text, F.lit(DISTRICTS), F.lit(1)))
    return (
        total(F.regexp_extract_all(all_text, F.lit(r"(\$[\d,]+)"), F.lit(1)), dollars) + F.coalesce(_looked_up({k: str(v) for k, v in TOPIC_POINTS.items()}, topic).cast("int"), F.lit(0))
        + F.when(body == "bos", 10).otherwise(0) + F.when(repeated, 15).otherwise(0) + total(found, details) + 5 * districts
    )


# Kinds of streets in an address.
STREETS = [
    "ST", "DR", "AVE", "RD", "BLVD", "LN", "WAY", "CIR", "TER", "PL", "CT", "PKWY", "TRL", "DRIVE", "AVENUE", "ROAD", "BOULEVARD", "STREET", "LANE", "CIRCLE",
    "TERRACE", "PLACE", "COURT", "PARKWAY", "TRAIL",
]


# Number, direction and name of a street address, and state and ZIP code behind its city.
ADDRESS_HEAD = r"\d{1,5}\s+(?:(?:N|S|E|W|NORTH|SOUTH|EAST|WEST)\b\.?\s+)?(?:[A-Z][a-zA-Z']+\.?\s+){1,3}"
ADDRESS_TAIL = r"\s*,?\s*(?:AZ|ARIZONA)?\s*,?\s*\d{5}(?:-\d{4})?"


def addresses(text: Column, cities: list[str]) -> Column:
    """Distinct street addresses with a city and ZIP code, in upper case without a period at the end, in the order of their first place."""
    pattern = rf"(?i)\b({ADDRESS_HEAD}(?:{'|'.join(STREETS)})\.?\s*,?\s*(?:{'|'.join(cities)}){ADDRESS_TAIL})\b"
    return F.array_distinct(F.transform(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(F.upper(F.trim(x)), r"\.$", "")))


# Capitalised phrases and the labels of fields.
PHRASE = r"[A-Z][A-Za-z0-9'.-]+(?:\s+[A-Z][A-Za-z0-9'.-]+){1,5}"
FIELD_LABELS = r"(?i)(?:Applicant|Attorney|Represented by|Planner|Architect|Engineer)\s*:"


def entity_density(text: Column) -> Column:
    """Capitalised phrases of two to six words, plus three for each field label."""
    return F.regexp_count(_text(text), F.lit(PHRASE)) + 3 * F.regexp_count(_text(text), F.lit(FIELD_LABELS))


# Notices that are no agenda items.
NOTICE_WORDS = ["meeting location", "board members", "mission", "webinar", "public notice", "live video feeds", "the public is invited", "accommodations for individuals"]
BOILERPLATE = r"(?i)^(?:page\s+\d+.*|copyright.*|hyland software.*|view meeting.*|agenda online.*)$"


def block_fault(text: Column) -> Column:
    """Why a block of text is no agenda item, or empty for one that is."""
    t = F.trim(_text(text), F.lit(" \t\r\n"))
    first = F.trim(F.regexp_replace(F.split(t, "\n")[0], r"\s+", " "))
    return (
        F.when(t == "", "empty raw text").when(first.rlike(r"(?i)^\d{1,2}:\d{2}\s?[AP]M\b"), "begins with time").when(first.rlike(r"^\d+\s+[A-Za-z]"), "begins with address")
        .when(first.rlike(BOILERPLATE), "boilerplate first line").when(first.rlike(r"(?i)\baudio access code\b"), "contains Audio Access code boilerplate")
        .when(~first.rlike(r"^\d+\.\s+.+"), "does not begin with numbered agenda item").when(_has(F.lower(t), NOTICE_WORDS), "contains non-agenda notice text").otherwise("")
    )


def first_language(title: Column) -> Column:
    """The part of a bilingual title before `` - `` or else `` / ``."""
    t = F.trim(F.regexp_replace(_text(title), r"\s+", " "))
    return F.trim(F.when(t.contains(" - "), F.substring_index(t, " - ", 1)).otherwise(F.substring_index(t, " / ", 1)))


# Bodies in the order in which a case meets them.
STAGES = ["planning & zoning commission", "planning & zoning", "board of adjustment", "board of supervisors", "city council"]


def civic_stage(body: Column) -> Column:
    """Place of a body in STAGES, -1 for none."""
    out = F.lit(-1)
    for place, stage in reversed(list(enumerate(STAGES))):
        out = F.when(F.lower(_text(body)).contains(stage), place).otherwise(out)
    return out


def is_skeleton(titles: Column, substantive: list[str], skeleton: list[str]) -> Column:
    """Whether an agenda has titles, and all of them are boilerplate."""
    low = F.transform(titles, lambda t: F.lower(F.trim(t)))
    return (F.size(low) > 0) & F.forall(low, lambda t: t.isin(skeleton) & ~_has(t, substantive))


# Words of a permit's class and texts, with the category that the first of them gives.
CLASS_CATEGORIES = [
    (["non-residential"], "Commercial"), (["residential", "single family", "ten or more family", "guesthouse"], "Residential"), (["commercial"], "Commercial"),
    (["industrial"], "Industrial"), (["mixed"], "Mixed-Use"), (["water", "sewer", "drainage", "paving"], "Infrastructure"), (["electrical", "plumbing", "mechanical"], "Trade"),
    (["foundation only", "hotel", "motel", "parking garage", "educational", "customer service"], "Commercial"), (["demolition"], "Demolition"),
]
TEXT_CATEGORIES = [
    (["mixed"], "Mixed-Use"), (["industrial"], "Industrial"), (["residential"], "Residential"), (["commercial", "sign"], "Commercial"),
    (["infrastructure", "street", "water", "sewer"], "Infrastructure"),
]


def _first_rule(value: Column, rules: list[tuple[list[str], str]]) -> Column:
    return F.coalesce(*[F.when(_has(value, words), label) for words, label in rules])


def permit_category(kind: Column, kind_text: Column, description: Column, permit_class: Column) -> Column:
    """Category by the permit's class, else by its type and description, else Other."""
    texts = F.concat_ws(" ", *[F.lower(F.trim(_text(c))) for c in (kind, kind_text, description)])
    return F.coalesce(_first_rule(F.lower(F.trim(_text(permit_class))), CLASS_CATEGORIES), _first_rule(texts, TEXT_CATEGORIES), F.lit("Other"))


def permit_work_type(permit_class: Column, description: Column) -> Column:
    """Kind of work by the permit's class and description; the first rule that holds counts."""
    c, d = F.lower(F.trim(_text(permit_class))), F.upper(F.trim(_text(description)))
    in_class, in_text = lambda *w: _has(c, list(w)), lambda *w: _has(d, list(w))
    rules = [
        # The rules, in their order.
        (in_class("electrical", "plumbing", "mechanical", "photovoltaic"), "Trade"),
        (c.isin("uf - underground fire", "rae - engineering revisions", "st - street lights"), "Trade"),
        (in_text("REPLACE", "PANEL UPGRADE") & in_text("PANEL"), "Trade"),
        (in_class("demolition") | d.startswith("DEMO") | in_text("SITE DEMO"), "Demolition"),
        (in_class("water", "sewer", "drainage", "paving") | in_text("SEWER", "WATER"), "Infrastructure"),
        ((c.startswith("10") & in_class("new")) | in_class("foundation only", "hotel", "motel") | (c.startswith("330") & in_class("commercial")), "New Construction"),
        (in_class("industrial or warehouse", "churches", "mobile home", "customer service"), "New Construction"),
        (in_class("guesthouse", "carport", "pool", "spa", "walls or fences", "new garage"), "Addition"),
        ((in_text("ADDITION") & ~in_text("REMOV")) | in_text("NEW ADU", "NEW GUEST HOUSE", "NEW DETACHED", "NEW SHADE", "NEW CANOP"), "Addition"),
        (d.startswith("NEW ") | d.startswith("CONSTRUCT NEW ") | (in_text("PHASED") & in_text("FOUNDATION", "CONSTRUCTION")) | in_text("AT RISK GRADING"), "New Construction"),
        (in_class("additions and alterations - non-residential", "additions or alterations - residential"), "Alteration"),
        (d.startswith("TI") | in_text("TENANT IMPROVEMENT", "REMODEL", "RENOVATION", "RENOVATE", "UPGRADE", "REPLACE", "REPAIR", "RESTORE", "INTERIOR", "INSTALL"), "Alteration"),
        (in_class("educational", "renewal", "sign", "non-structural"), "Alteration"),
        ((c.startswith("999") | c.startswith("misc")) & in_text("GRADING") & in_text("NEW", "AT RISK"), "New Construction"),
        ((c.startswith("999") | c.startswith("misc")) & in_text("DEMO"), "Demolition"),
        ((c.startswith("999") | c.startswith("misc")) & in_text("CONSTRUCT PEDESTRIAN"), "Infrastructure"),
    ]
    return F.coalesce(*[F.when(rule, label) for rule, label in rules], F.lit("Unknown"))


# Beginnings of permit codes that a table of codes may lack.
CODE_CATEGORIES = [("RV", "Plan Review"), ("R", "Residential"), ("C", "Commercial"), ("LP", "Commercial"), ("LS", "Commercial"), ("SGN", "Commercial"), ("WS", "Infrastructure"), ("EL", "Trade"), ("PL", "Trade"), ("MECH", "Trade")]
CODE_WORK = [
    ("RE", "Alteration"), ("RSE", "Alteration"), ("RS", "New Construction"), ("RM", "New Construction"), ("RV", "Plan Review"), ("R", "Alteration"), ("SGN", "Trade"),
    ("EL", "Trade"), ("PL", "Trade"), ("MECH", "Trade"), ("LP", "New Construction"), ("LS", "New Construction"), ("WS", "Infrastructure"), ("C", "New Construction"), ("BLD", "New Construction"),
]


def permit_code_kinds(code: Column, categories: dict[str, str], work_types: dict[str, str]) -> Column:
    """``category`` and ``work_type`` of a permit code: by the tables, else by the code's beginning, else null."""
    c = F.upper(F.trim(code))
    fire = c.rlike(r"^F\d+$")

    def of(table, begins, fire_label):
        known = _looked_up(table, c) if table else F.lit(None).cast("string")
        return F.coalesce(known, F.when(fire, fire_label), *[F.when(c == b if b in ("MECH", "BLD") else c.startswith(b), label) for b, label in begins])

    return F.struct(of(categories, CODE_CATEGORIES, "Commercial").alias("category"), of(work_types, CODE_WORK, "Trade").alias("work_type"))


def state_plane_point(x: Column, y: Column) -> Column:
    """(lat, lon) of state-plane feet near the projection's centre, by its linear approximation."""
    # Origin and slopes.
    lat, lon = 31.1623 + (y - 2000000) * 2.2315e-6, -113.2555 + (x - 500000) * -2.3806e-6
    return F.struct(F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))


def ring_centre(ring: Column) -> Column:
    """Mean of a polygon ring's corners ``x``, ``y``."""
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda a, p: a + p[k]) / F.nullif(F.size(ring), F.lit(0))
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def applicant_parts(field: Column) -> Column:
    """Entities of an applicant field ``Person, Firm``: name, type and role; none for ``n/a`` and initiated cases."""
    parts = F.transform(F.split(F.replace(field, F.lit(" – "), F.lit(", ")), ","), lambda x: F.trim(x))
    head, tail = parts[0], F.trim(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), ","))
    person = (entity_type(head) == "person") & F.size(_words(head)).between(2, 4) & F.forall(_words(head), lambda w: w.rlike(r"^\p{Lu}"))
    entity = lambda name, kind, role: F.struct(name.alias("name"), kind.alias("type"), role.alias("role"))
    firm = entity(tail, F.lit("organization"), F.lit("firm"))
    two = F.when(person, F.array(firm, entity(head, F.lit("person"), F.lit("attorney")))).otherwise(F.array(firm))
    one = F.array(entity(head, F.when(person, "person").otherwise("organization"), F.lit("applicant")))
    none = F.array().cast("array<struct<name:string,type:string,role:string>>")
    blank = (F.trim(_text(field)) == "") | F.lower(F.trim(field)).isin("n/a", "staff-initiated", "commission-initiated")
    return F.when(blank, none).when((F.size(parts) >= 2) & (F.length(F.element_at(parts, -1)) > 4), two).when(F.size(parts) == 1, one).otherwise(none)


# The form of a motion in summaries; a bracket ends the seconder.
SUMMARY_MOTION = r"(?i)Motion\s+to\s+(\w+(?:\s+\w+)*?)[.,]?\s+by\s+Supervisor\s+([^,]+)(?:,\s*seconded\s+by\s+Supervisor\s+([^()]+))?"


def summary_motion(text: Column) -> Column:
    """``motion``, ``mover`` and ``seconder`` of ``Motion to ... by Supervisor X, seconded by Supervisor Y``."""
    pattern = SUMMARY_MOTION
    part = lambda k: F.nullif(F.trim(F.regexp_extract(text, pattern, k)), F.lit(""))
    return F.struct(part(1).alias("motion"), part(2).alias("mover"), part(3).alias("seconder"))


# Words that show that a listed name is none.
NO_NAMES = r"(?i)(?:Nays?|Ayes|Recused|Absent|Abstain|Approve|Motion|Setting|Agenda|Road|Flood|Regular|Configuración|Audiencias|Planificación|Distrito|Control|Inundaciones):?"


def named_votes(text: Column, label: str) -> Column:
    """Names after ``Ayes:``, ``Nays:`` and the like, up to the next such label."""
    listed = F.regexp_extract(_text(text), rf"(?i)\b{label}:\s*(.*?)(?:\s*(?:Ayes|Nays?|Recused|Absent):|\s*$)", 1)
    names = F.transform(F.split(listed, ","), lambda n: F.trim(F.regexp_replace(F.regexp_replace(F.trim(n), r"\.$", ""), r"(?i)^and\s+", "")))
    return F.filter(names, lambda n: (n != "") & ~n.rlike(NO_NAMES))
