"""Many known phrases at once: one automaton over all of them runs over whole texts in batches.

An Aho-Corasick automaton reads a text once, whatever the number of phrases.
Phrases are taken in blocks of bounded size, so what is broadcast does not grow
with their table; each block is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.functions import labels as B

#: Characters of phrases in an automaton; its states take about 100 bytes for each.
BLOCK_CHARS = 1_000_000

_HITS = "array<struct<phrase: string, start: int, end: int>>"


def folded(text: str) -> str:
    """Lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def hits_of(automaton, text: str) -> list[tuple[int, int]]:
    """(start, end) of the phrases that stand as whole words, longest first, without those inside taken ones.

    A word is a run of letters, digits and underscores.
    """
    low = folded(text)
    found = []
    for last, size in automaton.iter(low):
        start, end = last - size + 1, last + 1
        inside = (start and (low[start - 1].isalnum() or low[start - 1] == "_") and (low[start].isalnum() or low[start] == "_")) or (
            end < len(low) and (low[end].isalnum() or low[end] == "_") and (low[last].isalnum() or low[last] == "_")
        )
        if not inside:
            found.append((start, end))
    taken, reach = [], 0
    for start, end in sorted(found, key=lambda x: (x[0], -x[1])):
        if end > reach:  # else it lies inside the one before
            taken.append((start, end))
            reach = end
    return taken


def _blocks(phrases: DataFrame, column: str, chars: int) -> Iterator[list[str]]:
    held, size = [], 0
    distinct = phrases.select(F.lower(F.trim(column)).alias("p")).where("p <> ''").distinct()
    for row in distinct.orderBy("p").toLocalIterator():
        held.append(folded(row.p))
        size += len(row.p)
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def phrase_hits(docs: DataFrame, id_col: str, text: str, phrases: DataFrame, column: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Every place where a known phrase stands in a text: the id, phrase (lower case), start and end in characters.

    Case does not count; a phrase has to stand as whole words, and one inside a
    longer known phrase of its block is not told.  Null texts hold none, null
    and empty phrases are none.  Nothing is shuffled.
    """
    import ahocorasick  # only here, so that the rest works without it

    spark = docs.sparkSession
    passes = []
    for block in _blocks(phrases, column, block_chars):
        automaton = ahocorasick.Automaton()
        for phrase in block:
            automaton.add_word(phrase, len(phrase))
        automaton.make_automaton()
        shared = spark.sparkContext.broadcast(automaton)

        scan = F.arrow_udf(_finder(shared), _HITS)
        passes.append(docs.select(F.col(id_col), F.explode(scan(F.col(text).cast("string"))).alias("h")).select(id_col, "h.phrase", "h.start", "h.end"))
    if not passes:
        return docs.select(F.col(id_col), F.lit("").alias("phrase"), F.lit(0).alias("start"), F.lit(0).alias("end")).limit(0)
    return reduce(DataFrame.union, passes)


def _finder(shared):
    def find(values: pa.Array) -> pa.Array:
        out = []
        for value in values:
            body = value.as_py() or ""
            out.append([{"phrase": folded(body[a:b]), "start": a, "end": b} for a, b in hits_of(shared.value, body)])
        return pa.array(out, pa.list_(pa.struct([("phrase", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))

    return find


# Labels of the lines that name someone, by role, and the forms of case numbers.
ROLE_LINES = {
    "applicant": "Applicant|Applicant/Owner|Applicant/Agent|Petitioner",
    "attorney": "Attorney|Represented by|Represented By|Counsel|Representative",
    "staff": "Staff Contact|Staff|Presenter|Prepared by|Contact",
    "owner": "Owner|Property Owner|Landowner",
}
CASES = (r"(?i)\b((?:ZON|PLN|CU|SPR|CPA|MCP|SPL|USE|Z|P|CASE)[-\s]?\d{2,}[-]\d{2,})\b", r"(?i)\b(C-\d{2}-\d{2}-\d{3}-[A-Z0-9]+-[A-Z0-9]+)\b")


def document_entities(docs: DataFrame, id_col: str, text: str, organizations: DataFrame) -> DataFrame:
    """Who and what a document names: the id, name, normalized_name, entity_type, role and confidence, each name and type once.

    In this order: names on lines that begin with a label of ROLE_LINES (80),
    known organizations (95) and case numbers (95).  organizations: ``name`` and
    ``entity_type``.  Whole texts are read.
    """
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.concat(*[
        _with_role(F.regexp_extract_all(said, F.lit(rf"(?im)^\s*(?:\d+[.)]\s+)?(?:{labels})\s*:?\s*(\S[^\n]*?)\s*$"), F.lit(1)), role)
        for role, labels in ROLE_LINES.items()
    ])
    named = docs.select(id_col, F.explode(lines).alias("l")).select(id_col, F.lit(0).alias("step"), "l.name", "l.role")
    named = named.where(B.is_valid_match(F.col("name")) & ~B.is_garbage(F.col("name"))).select(id_col, "step", "name", B.entity_type(F.col("name")).alias("entity_type"), "role", F.lit(80).alias("confidence"))
    kinds = organizations.groupBy(F.lower(F.trim("name")).alias("phrase")).agg(F.min("name").alias("name"), F.min("entity_type").alias("entity_type"))
    known = phrase_hits(docs, id_col, text, organizations, "name").join(kinds, "phrase").select(id_col, F.lit(1).alias("step"), "name", "entity_type", F.lit("known_org").alias("role"), F.lit(95).alias("confidence"))
    cases = F.concat(*[F.regexp_extract_all(said, F.lit(p), F.lit(1)) for p in CASES])
    cased = docs.select(id_col, F.explode(cases).alias("name")).select(id_col, F.lit(2).alias("step"), F.upper("name").alias("name"), F.lit("case").alias("entity_type"), F.lit("reference").alias("role"), F.lit(95).alias("confidence"))
    rows = named.union(known).union(cased).withColumn("normalized_name", B.hyphenated_key(F.col("name")))
    best = rows.groupBy(id_col, "normalized_name", "entity_type").agg(F.min(F.struct("step", "role", "name", "confidence")).alias("e"))
    return best.select(id_col, "e.name", "normalized_name", "entity_type", "e.role", "e.confidence")


def _with_role(names, role: str):
    return F.transform(names, lambda x: F.struct(F.trim(x).alias("name"), F.lit(role).alias("role")))
