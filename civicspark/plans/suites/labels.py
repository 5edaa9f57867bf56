"""Labels, checks, parsers and scores over tables of cases that reach every branch."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.functions import labels as L
from civicspark.functions import names as N
from civicspark.functions import text as T
from civicspark.plans.registry import cases, query


@cases("f3_cases", "kind string, title string", [
    ("Executive/Special", None, "Executive"), ("informal", "x", "Informal"), ("Formal Meeting", "", "Formal"), ("", "Special session", "Special"), (" Retreat ", None, "Retreat"), (None, None, "Unknown"),
])
def f3_cases(kind, title):
    """Meeting types by type and title."""
    return T.normalize_meeting_type(kind, title)


@cases("f4", "title string", [
    ("Special/Election of Chairman", "Election of Chairman"), ("Emergency Meeting on Water", "Emergency"), ("4467", None), ("BOARD OF SUPERVISORS - JUNTA", None), ("Informal Meeting", None),
    ("Planning and  Zoning Commission Meeting", None), ("BOS Auditorium", None), ("Budget Retreat", "Budget Retreat"), ("Special Meeting 12", None), ("Call / Special", "Call / Special"), ("  ", None), (None, None), ("Special/Formal", "formal"),
])
def f4(title):
    """Context of a meeting's title."""
    return L.meeting_context(title)


@cases("f5", "title string", [("Board of Supervisors - Junta", "Board of Supervisors"), ("Council", None), (None, None)])
def f5(title):
    """Body named in a title."""
    return T.meeting_body(title)


@cases("f8", "body string", [("see C-86-26-102-X-00, and C-86-26-103-X-00", "C-86-26-102-X-00"), ("C-86-26-102", ""), (None, ""), ("xC-86-26-102-X-00", "")])
def f8(body):
    """First C-number of a text."""
    return T.c_number(body)


@cases("f9_cases", "body string", [
    ("Report received and placed on file; approved", "informational"), ("pulled from the agenda", "pulled"), ("pull item 5", "pulled"), ("removed from consent", "pulled"), ("laid on the table", "tabled"),
    ("continued to June", "continued"), ("held in abeyance", "held"), ("hearing held at noon", "unknown"), ("withdrawn by the applicant", "withdrawn"), ("approved as amended", "approved_as_amended"),
    ("motion to deny", "denied"), ("denied access to the lot, carried", "approved"), ("adopted", "approved"), ("nothing yet", "unknown"), (None, "unknown"),
])
def f9_cases(body):
    """States of items, all of them."""
    return T.lifecycle(body)


@cases("f10", "body string, action string", [("approved", "denied", "denied"), ("approved", " ", "approved"), ("tabled", "no vote", "tabled"), ("received and filed", None, "informational"), ("", "received and filed", "unknown")])
def f10(body, action):
    """State of an item with its recorded action."""
    return L.lifecycle_with_action(body, action)


@cases("f11", "body string", [
    ("No action; approved", "no action"), ("Received and filed", "received and filed"), ("It was APPROVED, not denied", "approved"), ("adopted", "adopted"), ("passed", "passed"), ("failed 2-3", "failed"), ("denied", "denied"),
    ("continued", "continued"), ("held", "held"), ("postponed", "postponed"), ("disapproved", ""), (None, ""),
])
def f11(body):
    """Vote or action in a text."""
    return L.vote_or_action(body)


@cases("f12_cases", "body string", [
    ("Schedule a public hearing", "CALL"), ("Public hearing on fees", "HEARING"), ("Introduce an ordinance", "HEARING"), ("Resolution 5", "VOTE"), ("Budget update", "STUDY"), ("Subdivision plat", "DEVELOPMENT"), ("Minutes", "ITEM"),
])
def f12_cases(body):
    """Kinds of hearings, all of them."""
    return N.hearing_kind(body)


@cases("f13_cases", "name string", [
    ("Vice Chair  Jane O'Neil-Smith, Planner", "jane o'neil-smith"), ("The Honorable José Ruiz", "josé ruiz"), ("dr. A. B. Lee, Vice President", "a b lee"), ("Chairman", ""), ("Maria Mayor", "maria mayor"),
])
def f13_cases(name):
    """Keys of persons' names."""
    return N.person_key(name)


@cases("f14_cases", "name string", [
    ("Smith & Jones P.L.L.C.", "smith and jones"), ("The Acme Co.", "acme"), ("Z-101-26", "z10126"), ("Acme Inc", "acme"), ("Pico", "pico"), ("Mc'Coy, Ltd", "mc'coy"), ("Delta L.L.P.", "delta"),
])
def f14_cases(name):
    """Keys of organisations' names."""
    return N.entity_key(name)


@cases("f16", "name string", [("Jane Doe", "person"), ("Doe", "organization"), ("Doe, Jane", "organization"), ("Tiffany Law Office", "organization"), ("City of Mesa", "organization"), ("Ann Marie Roe", "person")])
def f16(name):
    """Person or organisation by a name's words."""
    return L.entity_type(name)


@cases("f17", "name string", [("The Smith & Sons, P.L.L.C.", "smith and sons"), ("Well-Built Homes LLC Inc.", "well-built homes"), ("Roe and & Doe", "roe and doe"), ("Colco", "colco"), ("O'Neil Corp", "o'neil")])
def f17(name):
    """Keys that keep hyphens."""
    return L.hyphenated_key(name)


@cases("f18", "name string", [("Vista Homes of Mesa", "vista homes of"), ("Sun Group LLC Phoenix Arizona", "sun group llc"), ("Mesa", "mesa"), ("Desert Ridge", "desert ridge")])
def f18(name):
    """Keys of candidates, places at their ends removed."""
    return L.candidate_key(name)


@cases("f19", "name string", [
    ("Staff recommends", "true"), ("memo", "true"), ("smith", "true"), ("Overview", "true"), (", and others", "true"), (", x", "false"), (".5", "false"), ("'quoted", "true"), ("Vista Homes", "false"), ("", "true"), (None, "true"),
])
def f19(name):
    """Names that are headings or fragments."""
    return L.is_garbage(name)


@cases("f20", "name string", [("The City of Mesa", "true"), ("the applicant", "false"), ("A", "false"), ("Bo", "true"), ("x" * 101, "false"), ("x" * 100, "true"), ("It depends", "false"), (None, "false")])
def f20(name):
    """Matched names that may be names."""
    return L.is_valid_match(name)


@cases("f21", "name string", [
    ("Mark Freeman", "true"), ("mark freeman", "false"), ("MARK FREEMAN", "false"), ("Mark", "true"), ("Mark A B Freeman", "false"), ("Mark 2", "false"), ("Study Session", "false"), ("Freeman " + "x" * 30, "false"), (None, "false"), ("JEAN", "false"),
])
def f21(name):
    """Names that look like a person's."""
    return F.coalesce(L.is_person_name(name, ["mark", "freeman"]), F.lit(False))


@cases("f22", "name string", [
    ("Vista Homes", "true"), ("vista Homes", "false"), ("Vista 12 Homes", "false"), ("Public Hearing Notice", "false"), ("Site Plan", "false"), ("Desert Vista Plan Review", "true"), ("Abc", "false"), ("General Plan", "false"), ("Staff Site Homes", "false"),
])
def f22(name):
    """Phrases that may name an entity."""
    return L.is_candidate(name, ["homes", "group"], ["site", "plan", "staff", "public", "hearing", "notice", "review"], ["general plan"])


@cases("f23", "body string", [("Assess-\nment of  land\n\nuse", "Assessment of land use"), (" a - b ", "a - b"), (None, None)])
def f23(body):
    """Text of documents with words rejoined."""
    return T.clean_pdf_text(body)


@cases("f24_cases", "body string", [("a\x00b\tc\nd\x1fe\x0b", "ab\tc\nde"), ("plain", "plain"), (None, None)])
def f24_cases(body):
    """Text without control characters."""
    return T.clean_control(body)


@cases("f27_cases", "message string", [
    ("HTTP 503", "TRANSIENT"), ("certificate verify failed", "TRANSIENT"), ("too many requests", "TRANSIENT"), ("object x has no attribute y", "CODE"), ("psycopg2 problem", "CODE"), ("list index out of range", "CODE"),
    ("duplicate key y violation", "DATA"), ("relation t does not exist", "DATA"), ("odd", "UNKNOWN"), (None, "UNKNOWN"),
])
def f27_cases(message):
    """Categories of errors."""
    return T.error_category(message)


@cases("f28", "message string", [("UNIQUE Constraint failed: x", "duplicate_item"), ("no agenda items found", "no_items"), ("Unsupported agenda format", "format_error"), ("it timed out", "timeout"), ("database disk image is malformed", "db_corrupt"), ("x", "unknown"), ("", "none"), (None, "none")])
def f28(message):
    """A monitor's categories of errors."""
    return L.monitor_error(message)


@cases("f34", "x double, y double", [(500000.0, 2000000.0, "31.1623|-113.2555"), (682000.0, 2055000.0, "31.285033|-113.688769"), (None, 1.0, None)])
def f34(x, y):
    """State-plane feet as degrees."""
    p = L.state_plane_point(x, y)
    return F.when(p["lat"].isNotNull() & p["lon"].isNotNull(), F.concat_ws("|", p["lat"].cast("string"), p["lon"].cast("string")))


@cases("f35", "ring array<struct<x:double,y:double>>", [([(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0)], "2.0|1.0"), ([(1.5, 3.0)], "1.5|3.0"), ([], "")])
def f35(ring):
    """Centres of polygon rings."""
    c = L.ring_centre(ring)
    return F.concat_ws("|", c["x"].cast("string"), c["y"].cast("string"))


@cases("f37", "kind string, kind_text string, description string, permit_class string", [
    ("", "", "", "437 Non-Residential pool", "Commercial"), ("", "", "", "101 Single Family", "Residential"), (None, None, None, "Guesthouse", "Residential"), ("", "", "", "330 Commercial", "Commercial"),
    ("", "", "", "Industrial or warehouse", "Industrial"), ("", "", "", "Mixed", "Mixed-Use"), ("", "", "", "Paving", "Infrastructure"), ("", "", "", "Plumbing", "Trade"), ("", "", "", "Parking garage", "Commercial"),
    ("", "", "", "Demolition", "Demolition"), ("", "", "", "Photovoltaic - Residential", "Residential"), ("BLD", "Mixed-use tower", "", "", "Mixed-Use"), ("", "", "New industrial shell", "x", "Industrial"),
    ("Residential", "", "", "", "Residential"), ("Sign", "", "", "", "Commercial"), ("", "Street work", "", "", "Infrastructure"), ("BLD", "x", "y", "z", "Other"), (None, None, None, None, "Other"),
])
def f37(kind, kind_text, description, permit_class):
    """Categories of permits."""
    return L.permit_category(kind, kind_text, description, permit_class)


@cases("f38", "permit_class string, description string", [
    ("Electrical", "", "Trade"), ("ST - Street Lights", None, "Trade"), ("", "Panel upgrade of panel", "Trade"), ("", "Demo house", "Demolition"), ("Sewer", "", "Infrastructure"), ("", "new water line", "Infrastructure"),
    ("101 new house", "", "New Construction"), ("330 commercial", "", "New Construction"), ("Churches", "", "New Construction"), ("Guesthouse", "", "Addition"), ("Pool - Residential", "", "Addition"), ("", "Room addition", "Addition"),
    ("", "Addition removed", "Unknown"), ("", "New shade structure", "Addition"), ("", "New house", "New Construction"), ("", "Phased foundation", "New Construction"), ("434 additions or alterations - residential", "", "Alteration"),
    ("", "TI for shop", "Alteration"), ("", "kitchen remodel", "Alteration"), ("Educational", "", "Alteration"), ("999 other", "grading at risk", "New Construction"), ("misc", "a demo", "Demolition"), ("999", "construct pedestrian way", "Infrastructure"),
    ("999", "x", "Unknown"), (None, None, "Unknown"), ("single family residence", "", "Unknown"),
])
def f38(permit_class, description):
    """Kinds of work of permits."""
    return L.permit_work_type(permit_class, description)


@cases("f39", "code string", [
    ("blds ", "Commercial|New Construction"), ("RVX9", "Plan Review|Plan Review"), ("RSX", "Residential|New Construction"), ("REX", "Residential|Alteration"), ("RXX", "Residential|Alteration"), ("CZZ", "Commercial|New Construction"), ("LPZZ", "Commercial|New Construction"),
    ("SGNX", "Commercial|Trade"), ("F101", "Commercial|Trade"), ("FX", "|"), ("WSX", "Infrastructure|Infrastructure"), ("ELX", "Trade|Trade"), ("MECH", "Trade|Trade"), ("MECHX", "|"), (None, "|"), ("XX", "Other kind|"),
])
def f39(code):
    """Category and kind of work of permit codes: exact ones, then beginnings."""
    kinds = L.permit_code_kinds(code, {"BLDS": "Commercial", "XX": "Other kind"}, {"BLDS": "New Construction"})
    return F.concat(F.coalesce(kinds["category"], F.lit("")), F.lit("|"), F.coalesce(kinds["work_type"], F.lit("")))


@cases("f45", "day string", [("1/2/2026", "2026-01-02"), ("12/31/25", "2025-12-31"), ("March 5, 2026", "2026-03-05"), ("Mar 5, 2026", "2026-03-05"), ("2026", None), (None, None)])
def f45(day):
    """Dates in several notations."""
    return N.iso_date(day)


@cases("f47_cases", "title string", [("  Água & Más: 2026! ", "gua-m-s-2026"), ("A--b", "a-b"), ("***", ""), ("x", "x")])
def f47_cases(title):
    """Slugs."""
    return T.slug(title)


@query("f50", """WITH d AS (SELECT o_orderdate::DATE AS day, count(*) AS meetings FROM orders GROUP BY 1)
SELECT meetings, strftime(day, '%Y-%m') AS month, CAST(day AS STRING) AS day, dayofweek(day)::INT AS column_no, ((day - (date_trunc('month', day)::DATE - dayofweek(date_trunc('month', day)::DATE)::INT)) // 7)::INT AS week_no FROM d""")
def f50(t):
    """Days with meetings by month, week and weekday, weeks from Sunday."""
    days = t.orders.groupBy(F.col("o_orderdate").cast("date").alias("d")).agg(F.count("*").alias("meetings"))
    first = F.trunc("d", "month")
    sunday = F.date_sub(first, F.dayofweek(first) - 1)
    return days.select("meetings", F.date_format("d", "yyyy-MM").alias("month"), F.col("d").cast("string").alias("day"), (F.dayofweek("d") - 1).alias("column_no"), F.floor(F.date_diff("d", sunday) / 7).cast("int").alias("week_no"))


@cases("f51", "jurisdiction string, body string", [
    ("Maricopa", "Board of Supervisors", "Maricopa BOS"), ("Tempe", "City Council", "Tempe City Council"), ("Mesa", "Historic Preservation Commission of the Town", "Mesa Historic"),
    ("Fountain Hills", "Some very long committee name indeed", "Fountain Hills Some very l…"), ("Mesa", "Board", "Mesa BOS"),
])
def f51(jurisdiction, body):
    """Short labels of bodies."""
    return L.short_label(jurisdiction, body, {"Board of Supervisors": "BOS", "Historic Preservation": "Historic"})


@cases("f52", "body string", [("Avondale City Council", "City Council"), ("Maricopa County Board of Supervisors", "Board of Supervisors"), ("Industrial Development Authority", "Industrial Development Authority"), ("Mesa", "Mesa"), (None, "")])
def f52(body):
    """Bodies without their jurisdiction."""
    return L.without_jurisdiction(body)


@cases("f53", "code string", [
    ("bos", "Maricopa County Board of Supervisors"), ("tempe-cc", "Tempe City Council"), ("mesa-pc", "Mesa Planning Commission"), ("mesa-drb", "Mesa Development Review Commission"), ("gilbert-tc", "Gilbert Town Council"),
    ("mc-x-y", "Maricopa County X Y"), ("mc-audit", "Audit Advisory Committee"), ("tempe-foo", "Tempe FOO"), ("council", "Council"), (None, None),
])
def f53(code):
    """Names of bodies by code."""
    return L.body_name(code, {"mc-audit": "Audit Advisory Committee"})


@cases("f54", "instant string", [("2026-01-01 03:00:00", "December 31, 2025"), ("2026-07-04 07:00:00", "July 04, 2026"), (None, "")])
def f54(instant):
    """Days in the local zone."""
    return L.local_date(F.to_timestamp(instant))


@cases("f55", "code string", [("HAS_APPLICANT", "Applicant"), ("MOTION_MADE", "Motion"), ("MEMBER_OF", "Member Of"), ("SOME_NEW_KIND", "Some New Kind")])
def f55(code):
    """Labels of relationships."""
    return L.relationship_label(code)


@cases("f56", "topic string, title string, body_text string, body string", [
    ("bonds-finance", "Bonds of $12,000,000", "and $150,000", "bos", "110"), ("none", "x", "$9,999 only", "pz", "0"), ("annexation", "Homeless shelter", "homeless homeless homeless, homeless", None, "35"), ("x", "40 units", "2 acres, 25 parking, 3 stories, 4 lots", "x", "38"),
    ("x", "Downtown overlay", None, None, "10"), (None, None, None, None, "0"), ("infrastructure", "$1,000,000 and $10,000", "", "", "50"),
])
def f56(topic, title, body_text, body):
    """Points of story suggestions."""
    return L.impact_score(topic, title, body_text, body)


@cases("f57_cases", "body string", [("Z-101-26 and cpa2024012, z-101-26", "Z-101-26,CPA2024012"), ("SUP-12-3-4", "SUP-12-3-4"), ("XZ-101-26", ""), (None, "")])
def f57_cases(body):
    """Case numbers."""
    return F.array_join(N.case_numbers(body), ",")


@cases("f58_cases", "body string", [("APN 123-45-678A; 123-45-678A, 999-00-111", "123-45-678A,999-00-111"), ("1234-45-678", ""), (None, "")])
def f58_cases(body):
    """Parcel numbers."""
    return F.array_join(N.parcel_numbers(body), ",")


@cases("f59", "body string", [
    ("At 123 N Main St, Mesa, AZ 85001 and 123 n main st, mesa, az 85001.", "123 N MAIN ST, MESA, AZ 85001"), ("2630 W. Rio Salado Parkway, Mesa, AZ 85201", "2630 W. RIO SALADO PARKWAY, MESA, AZ 85201"), ("12 Elm Road, Nowhere 85001", ""), (None, ""),
])
def f59(body):
    """Addresses with a city."""
    return F.array_join(L.addresses(body, ["Mesa", "Tempe"]), ";")


@cases("f60_cases", "verb string", [(" Was  Approved ", "was_approved"), ("DENIED", "denied"), ("set for\nhearing", "set_for_hearing")])
def f60_cases(verb):
    """Keys of verbs."""
    return N.verb_key(verb)


@cases("f61_cases", "pattern string, title string", [
    ("applicant", "Chair", "applicant"), ("staff_call", None, "staff"), ("eol", "Vice Chair", "vice_chair"), ("eol", "Chairwoman", "chair"), ("eol", "Commissioner", "commissioner"), ("eol", "Board Member", "board_member"),
    ("eol", "City Manager", "staff"), ("eol", "The applicant", "applicant"), ("presented_by", "x", "presenter"), ("line_role", "x", "board_member"), ("other", "x", "participant"),
])
def f61_cases(pattern, title):
    """Roles, all of them."""
    return N.role_of(pattern, title)


@cases("f63", "body string", [("Jane Doe met Acme Homes Group.\nApplicant: x", "5"), ("nothing here", "0"), (None, "0"), ("Planner: A B; engineer : Bob Roe", "7")])
def f63(body):
    """Density of entity-like phrases."""
    return L.entity_density(body)


@cases("f72", "body string", [
    ("", "empty raw text"), ("  \n ", "empty raw text"), ("9:30 AM Call", "begins with time"), ("12 Main Street", "begins with address"), ("Page 3 of 4", "boilerplate first line"), ("Audio access code 5", "contains Audio Access code boilerplate"),
    ("Item one", "does not begin with numbered agenda item"), ("1. Fees\nThe PUBLIC is invited", "contains non-agenda notice text"), ("1.  Fees\nAdopt", ""), (None, "empty raw text"),
])
def f72(body):
    """Faults of raw blocks of an agenda."""
    return L.block_fault(body)


@cases("f73", "title string", [("Roads - Caminos - x", "Roads"), ("Roads / Caminos", "Roads"), ("A / B - C", "A / B"), (" Roads  and ways ", "Roads and ways"), (None, "")])
def f73(title):
    """The first language of titles."""
    return L.first_language(title)


@cases("f75", "body string", [("Planning & Zoning Commission", "0"), ("Mesa Planning & Zoning", "1"), ("Board of Adjustment", "2"), ("Maricopa Board of Supervisors", "3"), ("City Council", "4"), ("Parks", "-1"), (None, "-1")])
def f75(body):
    """Stages of a case by body."""
    return L.civic_stage(body)


@cases("e16", "field string", [
    ("Jane Doe, Acme Homes", "Acme Homes/organization/firm;Jane Doe/person/attorney"), ("Acme Homes LLC", "Acme Homes LLC/organization/applicant"), ("Jane Doe", "Jane Doe/person/applicant"), ("n/a", ""), ("Staff-Initiated", ""), (None, ""),
    ("Jane Doe – Roe, Doe Partners", "Roe,Doe Partners/organization/firm;Jane Doe/person/attorney"), ("Acme Group, The Other Firm", "The Other Firm/organization/firm"), ("Doe, Inc", ""),
])
def e16(field):
    """Entities of applicant fields."""
    return F.array_join(F.transform(L.applicant_parts(field), lambda x: F.concat_ws("/", x["name"], x["type"], x["role"])), ";")


@cases("e22", "body string", [
    ("Motion to approve the item by Supervisor Bill Gates, seconded by Supervisor Debbie Lesko (5-0)", "approve the item|Bill Gates|Debbie Lesko"), ("Motion to continue, by Supervisor Galvin", "continue|Galvin"), ("No motion", ""), (None, ""),
])
def e22(body):
    """Motions of summary pages."""
    m = L.summary_motion(body)
    return F.concat_ws("|", m["motion"], m["mover"], m["seconder"])


@cases("e22_names", "body string", [
    ("Ayes: Gates, Lesko, and Galvin. Nays: Hickman", "Gates,Lesko,Galvin|Hickman"), ("Ayes: Gates Absent: Lesko", "Gates|"), ("Nays: Motion Road, Lesko", "|Lesko"), (None, "|"),
])
def e22_names(body):
    """Names of those for and against."""
    return F.concat(F.array_join(L.named_votes(body, "Ayes"), ","), F.lit("|"), F.array_join(L.named_votes(body, "Nays?"), ","))


@cases("e35", "titles array<string>", [(["Call to order", " ADJOURNMENT "], "true"), (["Call to order", "Zoning case"], "false"), (["Something new"], "false"), ([], "false")])
def e35(titles):
    """Agendas of boilerplate only."""
    return L.is_skeleton(titles, ["zoning", "contract"], ["call to order", "adjournment"])
