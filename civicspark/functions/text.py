"""Scalar functions of votes, meetings, names and errors as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def first_match(text: Column, banks: list[tuple[str, list[str]]], default: str) -> Column:
    """Label of the first bank of which a pattern occurs in ``text``."""
    out = F.lit(default)
    for label, patterns in reversed(banks):
        out = F.when(text.rlike("|".join(f"(?:{p})" for p in patterns)), label).otherwise(out)
    return out


def normalize_vote(vote) -> Column:
    """yes, no, abstain, absent or recused; other values in lower case, null as empty."""
    v = F.trim(F.lower(F.coalesce(_col(vote), F.lit(""))))
    return F.when(v.isin("yes", "aye"), "yes").when(v.isin("no", "nay"), "no").when(v.isin("abstain", "abstained"), "abstain").otherwise(v)


#: First words of a motion's result and their short form.
MOTION_RESULTS = {
    "approve": "approved", "appoint": "approved", "concur": "approved", "deny": "denied", "denied": "denied", "continue": "continued",
    "continued": "continued", "withdraw": "withdrawn", "accept": "accepted", "reject": "rejected",
}


def normalize_motion_result(raw) -> Column:
    """Short form by the first word; other texts stay, null and empty ones are approved."""
    text = F.trim(_col(raw))
    table = F.create_map(*[F.lit(x) for pair in MOTION_RESULTS.items() for x in pair])
    short = F.element_at(table, F.lower(F.split(text, r"\s+")[0]))
    return F.when(_col(raw).isNull() | (_col(raw) == ""), "approved").otherwise(F.coalesce(short, text))


def normalize_meeting_type(kind, title) -> Column:
    """Executive, Informal, Formal or Special, in this order; else the type given, or Unknown."""
    both = F.lower(F.concat_ws(" ", F.coalesce(_col(kind), F.lit("")), F.coalesce(_col(title), F.lit(""))))
    out = F.coalesce(F.nullif(F.trim(_col(kind)), F.lit("")), F.lit("Unknown"))
    for word in ("special", "formal", "informal", "executive"):
        out = F.when(both.contains(word), word.capitalize()).otherwise(out)
    return out


def meeting_body(title) -> Column:
    """Board of Supervisors if a title names it, else null."""
    return F.when(F.upper(_col(title)).contains("BOARD OF SUPERVISORS"), "Board of Supervisors")


def meeting_display_name(kind, date, context) -> Column:
    """``Type Meeting — Context — Mon D, YYYY``; a date that is none stays as it is."""
    name = F.trim(F.coalesce(_col(kind), F.lit("Meeting")))
    name = F.when(F.lower(name).endswith("meeting"), name).otherwise(F.concat(name, F.lit(" Meeting")))
    day = F.coalesce(F.date_format(F.try_to_date(_col(date), "yyyy-MM-dd"), "MMM d, yyyy"), _col(date))
    return F.concat_ws(" — ", name, F.nullif(_col(context), F.lit("")), day)


def is_canceled(title) -> Column:
    """Whether a title says that the meeting is canceled."""
    return F.coalesce(_col(title).rlike(r"(?i)\bCANCEL(?:LED|ED)?\b"), F.lit(False))


def c_number(text) -> Column:
    """The first C-number of a text, or empty."""
    return F.regexp_extract(F.coalesce(_col(text), F.lit("")), r"\bC-\d{2}-\d{2}-\d{3}-[A-Z0-9]+-[A-Z0-9]+\b", 0)


def c_number_parts(number) -> Column:
    """Base and revision of a C-number; the revision has at most four characters, else it is part of the base."""
    value = _col(number)
    last = F.substring_index(value, "-", -1)
    whole = (F.size(F.split(value, "-")) < 6) | (F.length(last) > 4)
    base = F.when(whole, value).otherwise(F.expr(f"substring({number}, 1, length({number}) - length(substring_index({number}, '-', -1)) - 1)") if isinstance(number, str) else value)
    return F.struct(base.alias("base"), F.when(~whole, last).alias("revision"))


#: Patterns of an item's state, first match counts.
INFORMATIONAL = [
    r"received\s+(?:and\s+)?(?:filed|placed\s+on\s+file)", r"information\s+(?:only|item|report)", r"presentation\s+only",
    r"not\s+for\s+(?:committee|board)\s+discussion", r"no\s+action\s+(?:taken|required|necessary)", r"received\s+as\s+information",
]
LIFECYCLE = [
    ("informational", INFORMATIONAL),
    ("pulled", [r"pull(?:ed|ing|s)?\s+(?:item|from|the\s+agenda)", r"(?:item|request|was|has\s+been)\s+(?:has\s+been\s+)?pull(?:ed|ing|s)\b", r"removed\s+(?:from|by)\s+(?:the\s+)?(?:agenda|consent)"]),
    ("tabled", [r"\btabl(?:e|ed|ing)\b", r"laid\s+(?:over|on\s+the\s+table)"]),
    ("continued", [
        r"continu(?:e|ed|ation|ing)\s+(?:to|until|the\s+item|consideration)", r"continued\s+(?:from|public\s+hearing)",
        r"(?:item|hearing|meeting)\s+(?:was\s+)?continued\s+(?:to|until)", r"continue\s+the\s+(?:item|hearing|matter|public\s+hearing)",
    ]),
    ("held", [
        r"\b(?:held|hold)\s+(?:over|in\s+abeyance|for\s+?(?:further|additional))",
        r"(?:held|hold)\s+(?:(?:item|case|matter|request|application)\s+)?(?:\S+\s+)?in\s+abeyance",
        r"(?:item|matter|consideration|request|application)\s+(?:was\s+)?(?:held|hold)\s+(?:over|in)",
        r"\bheld\b(?!\s+(?:in|by|at|on\s+(?:behalf|file|hold)|open|accountable))",
    ]),
    ("withdrawn", [r"withdraw(?:n|al)?\s+(?:by|from|the\s+(?:item|request))", r"(?:item|request|application)\s+(?:was\s+)?withdraw(?:n|al)"]),
    ("approved_as_amended", [
        r"approved\s+(?:as\s+)?(?:amended|modified|revised)", r"approve\s+(?:as\s+)?(?:amended|modified)", r"adopt(?:ed)?\s+(?:as\s+)?(?:amended|modified|revised)",
    ]),
    ("denied", [
        r"\b(?:denied?|denial)\b(?!\s+(?:the\s+opportunity|access|entry))", r"\bdenial\s+of\b", r"motion\s+(?:to\s+)?(?:deny|denied)\b", r"recommend(?:ation)?\s+(?:of\s+)?denial",
    ]),
    ("approved", [
        r"\b(?:approve(?:d|s)?|approval)\b(?!\s+(?:as\s+amended|as\s+modified))", r"adopt(?:ed)?\b", r"motion\s+(?:to\s+)?(?:approve|adopt|carry)", r"\bcarried\b",
        r"recommend(?:ation)?\s+(?:of\s+)?(?:\w+\s+)?approval",
    ]),
]


def lifecycle(text) -> Column:
    """State of an agenda item from its text: informational first, then eight states in order, else unknown."""
    value = F.concat(F.lit(""), F.coalesce(_col(text), F.lit("")))
    return first_match(value, [(label, [f"(?i:{p})" for p in patterns]) for label, patterns in LIFECYCLE], "unknown")


#: Words of error messages, by category in order.
ERRORS = [
    ("TRANSIENT", [
        r"5\d{2}", "timeout", "timed ?out", "connection refused", "connection reset", "connectionerror", "dns lookup", "network is unreachable",
        "econnrefused", "econnreset", "ssl", "certificate verify", "ratelimit", "rate.limit", "429", "received http 0", "temporary failure",
        "temporarily unavailable", "server error", "gateway", "service unavailable", "too many requests", "net::err_", "websocket",
    ]),
    ("CODE", [
        "typeerror", "attributeerror", "importerror", "modulenotfounderror", "keyerror", "indexerror", "valueerror", "zerodivisionerror", "assertionerror",
        "notimplementederror", "syntaxerror", "nameerror", "recursionerror", "runtimeerror", "operator does not exist", "type mismatch", "cannot import",
        "no module named", "object.*has no attribute", "unsupported operand", "invalid literal for int", "not subscriptable", "not iterable",
        "list index out of range", "not enough values to unpack", "undefinedfunction", "undefinedcolumn", "psycopg2", "database error",
        "dialect.*not supported", "sql type.*not recognized",
    ]),
    ("DATA", [
        "body not found", "unknown body", "jurisdiction.*not found", "unknown jurisdiction", "cannot determine body", "no.*body.*field", "not found in database",
        "meeting .* not found", "foreign key.*violation", "duplicate key.*violation", "unique constraint", "null value.*violation", "not-null constraint",
        "invalid input value", "relation .* not exist", "column .* not exist", "scalar.*returned more than one", "integrity.*constraint", "body.*empty",
        "meeting.*empty", "cannot.*resolve", "unable to determine", "missing.*flag", "no.*source.*flag", "could not determine", "could not resolve",
    ]),
]


def error_category(message) -> Column:
    """TRANSIENT, CODE, DATA or UNKNOWN."""
    return first_match(F.lower(F.coalesce(_col(message), F.lit(""))), ERRORS, "UNKNOWN")


def tag_error(message, category) -> Column:
    """The message with its category in brackets before it, once."""
    tag = F.concat(F.lit("["), _col(category), F.lit("]"))
    return F.when(_col(message).startswith("["), _col(message)).otherwise(F.concat_ws(" ", tag, _col(message)))


def slug(value) -> Column:
    """Lower case with runs of other characters than letters and digits as one hyphen."""
    return F.trim(F.regexp_replace(F.lower(F.trim(_col(value))), "[^a-z0-9]+", "-"), F.lit("-"))


def url_domain(url) -> Column:
    """Host of a URL without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(_col(url), r"^[a-zA-Z]+://([^/?#:]+)", 1)), r"^www\.", "")


#: Extensions of supporting documents.
EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "txt", "html"]


def file_extension(url) -> Column:
    """Extension of a URL's path if it is a known one, else empty."""
    found = F.lower(F.regexp_extract(F.split(_col(url), "[?#]")[0], r"\.([A-Za-z0-9]{1,5})$", 1))
    return F.when(found.isin(*EXTENSIONS), found).otherwise("")


def clean_control(text) -> Column:
    """Text without control characters but tab and line ends."""
    return F.regexp_replace(_col(text), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", "")


def clean_pdf_text(text) -> Column:
    """Words broken at line ends rejoined, other white space as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(text), r"(\w)-\s*\n\s*(\w)", "$1$2"), r"\s+", " "))


def length_bucket(chars) -> Column:
    """short, medium, long or very_long by code points."""
    n = _col(chars)
    return F.when(n < 500, "short").when(n < 2000, "medium").when(n < 8000, "long").otherwise("very_long")


def any_contains(text, words: list[str]) -> Column:
    """Whether any of the words occurs in the lower-case text."""
    value = F.lower(_col(text))
    return reduce(lambda a, b: a | b, [value.contains(w) for w in words])
