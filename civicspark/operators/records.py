"""Persisting meetings, cases, people and memberships, watermarks, matching, and metrics of classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.merge import first_by
from civicspark.operators.similarity_join import inside_pairs, two_words_pairs
from civicspark.operators.votes import without_vote
from civicspark.sources.shared import keep


def get_or_create_meetings(old: DataFrame, new: DataFrame, bodies: DataFrame) -> DataFrame:
    """``old`` and those of ``new`` that it lacks by ``body`` and ``meeting_id``, each with the jurisdiction of its body.

    bodies: ``body`` and ``jurisdiction_id``; a body that is not there keeps the old jurisdiction.
    """
    keys = ["body", "meeting_id"]
    added = first_by(new, keys, [F.col("meeting_date")]).select(*keys, "meeting_date", F.lit(None).cast("int").alias("jurisdiction_id")).join(old.select(*keys), keys, "left_anti")
    rows = old.select(*keys, "meeting_date", "jurisdiction_id").unionByName(added)
    found = bodies.select("body", F.col("jurisdiction_id").alias("__found"))
    return rows.join(found, "body", "left").select(*keys, "meeting_date", F.coalesce("__found", "jurisdiction_id").alias("jurisdiction_id"))


def case_rows(items: DataFrame, text: str, when: str, order: str) -> DataFrame:
    """One row for each case number of agenda items: type by its beginning, a normalised number, the first item's title and its events.

    Numbers are compared in upper case; items without one are left out.
    """
    number = F.upper(F.trim(F.col("case_number")))
    rows = items.where(F.coalesce(F.trim("case_number"), F.lit("")) != "").withColumn("case_number", number)
    cases = rows.groupBy("case_number").agg(F.min_by(F.substring(F.coalesce(text, F.lit("")), 1, 500), F.struct(when, order)).alias("description"), F.count("*").alias("events"), F.min(when).alias("first_event"))
    kind = F.coalesce(*[F.when(F.col("case_number").startswith(p), p) for p in ("CPA", "Z", "GPA")], F.lit(""))
    return cases.select("case_number", kind.alias("case_type"), F.trim(F.regexp_replace("case_number", "[^A-Z0-9]", " ")).alias("normalized_case_number"), "description", "events", "first_event")


def _parts(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.trim(F.lower(name)), r"\s+"), lambda w: w != ""))


def find_people(names: DataFrame, persons: DataFrame) -> DataFrame:
    """``name`` with the ``person_id`` it is found under, or null for a person to create.

    An equal normalised name counts first.  Else a person is found whose name
    begins or ends with a word of three letters or more of the name, full names
    before single ones, then the smallest id; if both names have several words,
    two of them must agree.
    """
    asked = names.select("name").distinct().withColumn("norm", F.trim(F.lower("name")))
    known = persons.select(F.col("id").alias("person_id"), F.col("normalized_name").alias("known"))
    exact = asked.join(known.groupBy(F.col("known").alias("norm")).agg(F.min("person_id").alias("exact_id")), "norm", "left")
    ends = known.select("*", F.explode(F.array_distinct(F.array(F.substring_index("known", " ", 1), F.substring_index("known", " ", -1)))).alias("word"))
    words = asked.select("name", "norm", F.explode(_parts(F.col("norm"))).alias("word")).where(F.length("word") >= 3)
    # of the people whom a word finds only the least counts, so a common word finds one
    single = (~F.col("known").contains(" ")).alias("single")
    ends = ends.groupBy("word").agg(F.min(F.struct(single, "person_id", "known")).alias("p")).select("word", "p.person_id", "p.known")
    best = words.join(ends, "word").groupBy("name", "norm").agg(F.min(F.struct((~F.col("known").contains(" ")).alias("single"), F.col("person_id"), F.col("known"))).alias("b"))
    a, b = _parts(F.col("norm")), _parts(F.col("b.known"))
    fits = (F.size(a) < 2) | (F.size(b) < 2) | (F.size(F.array_intersect(a, b)) >= 2)
    near = best.where(fits).select("name", F.col("b.person_id").alias("near_id"))
    return exact.join(near, "name", "left").select("name", F.coalesce("exact_id", "near_id").alias("person_id"))


def missing_memberships(attended: DataFrame, memberships: DataFrame) -> DataFrame:
    """Memberships to add: a person and body that met without one, from the first meeting on; elected for the county board."""
    keys = ["person_id", "public_body_id"]
    first = attended.groupBy(*keys, "body").agg(F.min("meeting_date").alias("term_start"))
    return first.join(memberships.select(*keys), keys, "left_anti").select(*keys, "term_start", F.when(F.col("body") == "bos", "elected").otherwise("appointed").alias("selection_method"))


def without_conflicts(target: DataFrame, incoming: DataFrame, key: list[str], unique: list[str]) -> DataFrame:
    """``target`` without rows that an incoming row's unique columns meet under another key; null unique columns meet nothing."""
    known = incoming.select(*[F.col(c).alias(f"__{c}") for c in [*key, *unique]]).distinct()
    same, other = F.lit(True), F.lit(False)
    for c in unique:
        same = same & (F.col(c) == F.col(f"__{c}"))
    for c in key:
        other = other | (F.col(c) != F.col(f"__{c}"))
    return target.join(known, same & other, "left_anti")


def suspect_memberships(memberships: DataFrame, *evidence: DataFrame) -> DataFrame:
    """Memberships whose ``person_id`` and ``public_body_id`` no table of evidence holds."""
    keys = ["person_id", "public_body_id"]
    for table in evidence:
        memberships = memberships.join(table.select(*keys).distinct(), keys, "left_anti")
    return memberships


def infer_absent(meetings: DataFrame, roster: DataFrame, votes: DataFrame, id_col: str, by: str) -> DataFrame:
    """Members of the roster of each meeting's ``by`` who cast no vote there, marked as inferred; rows with a null or empty key are left out."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    return without_vote(meetings.where(named(id_col)), roster.where(named("member_id")), votes, id_col, by).withColumn("attendance_status", F.lit("inferred_absent"))


def beyond_marks(rows: DataFrame, marks: DataFrame, group: str, id_col: str, force: bool = False) -> DataFrame:
    """Rows whose id lies beyond their group's ``mark``; all rows of groups without one, or if forced."""
    found = rows.join(marks.select(group, "mark"), group, "left")
    return (found if force else found.where(F.col("mark").isNull() | (F.col(id_col) > F.col("mark")))).drop("mark")


def moved_marks(marks: DataFrame, done: DataFrame, group: str, id_col: str) -> DataFrame:
    """Marks after the rows that were done; a mark never moves back."""
    new = done.groupBy(group).agg(F.max(id_col).alias("mark"))
    return marks.select(group, "mark").unionByName(new).groupBy(group).agg(F.max("mark").alias("mark"))


def next_checkpoint(written: DataFrame, stamp: str, skipped: str, before: str) -> DataFrame:
    """The checkpoint after a copy: the newest stamp, but the old one if a row was skipped or none was written."""
    newest = F.when(F.count_if(F.col(skipped)) == 0, F.max(stamp))
    return written.agg(F.greatest(newest, F.lit(before)).alias("checkpoint"), F.count_if(F.col(skipped)).alias("skipped"))


def match_entities(names: DataFrame, entities: DataFrame) -> DataFrame:
    """``name``, ``entity_id``, ``confidence`` and ``method`` of every entity that a name matches.

    Equal names have 0.95; a name inside another of which it has at least 0.6 of
    the length has 0.7 times that share; two common words of more than two
    letters have 0.6 times their share of both names' words.  Names of fewer than
    three letters match nothing.  Names meet by two common words, or by the
    rarest three letters of the one inside, so a word that many share makes no pairs.
    """
    asked = names.select("name").where(F.length("name") >= 3).distinct()
    known = entities.select(F.col("id").alias("entity_id"), F.col("normalized_name").alias("known")).where(F.length("normalized_name") >= 3)
    words = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: F.length(w) > 2))
    forms = known.groupBy(F.col("known").alias("other")).agg(F.collect_set("entity_id").alias("ids"))
    forms = keep(forms, "known-names")
    pairs = two_words_pairs(asked.select("name", words(F.col("name")).alias("words")), forms.select("other", words(F.col("other")).alias("words")))
    pairs = pairs.union(asked.join(forms, F.col("name") == F.col("other"), "left_semi").select("name", F.col("name").alias("other")))
    pairs = pairs.union(inside_pairs(asked, forms.select("other"), 0.6))
    turned = inside_pairs(forms.select(F.col("other").alias("name")), asked.select(F.col("name").alias("other")), 0.6)
    pairs = pairs.union(turned.select(F.col("other").alias("name"), F.col("name").alias("other"))).distinct()
    pairs = pairs.join(forms, "other").select("name", F.explode("ids").alias("entity_id"), F.col("other").alias("known"))
    share = F.least(F.length("name"), F.length("known")) / F.greatest(F.length("name"), F.length("known"))
    a, b = words(F.col("name")), words(F.col("known"))
    both = F.size(F.array_intersect(a, b))
    inside = (F.col("name").contains(F.col("known")) | F.col("known").contains(F.col("name"))) & (share >= 0.6)
    result = F.when(F.col("name") == F.col("known"), F.struct(F.lit(0.95).alias("confidence"), F.lit("exact").alias("method"))).when(
        inside, F.struct((0.7 * share).alias("confidence"), F.lit("contained").alias("method"))
    ).when(both >= 2, F.struct((0.6 * both / F.size(F.array_union(a, b))).alias("confidence"), F.lit("partial").alias("method")))
    return pairs.select("name", "entity_id", result.alias("r")).where("r is not null").select("name", "entity_id", F.round("r.confidence", 6).alias("confidence"), "r.method")


def binary_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of both classes, their mean F1, and accuracy; a share of nothing is 0."""
    hit = lambda t, p: F.count_if((F.col(truth) == t) & (F.col(predicted) == p))
    counts = rows.agg(hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(0, 0).alias("tn"), hit(1, 0).alias("fn"))
    share = lambda x, y: F.coalesce(F.try_divide(F.col(x).cast("double"), F.col(x) + F.col(y)), F.lit(0.0))
    f1 = lambda p, r: F.coalesce(F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r)), F.lit(0.0))
    found = counts.withColumns({"precision_1": share("tp", "fp"), "recall_1": share("tp", "fn"), "precision_0": share("tn", "fn"), "recall_0": share("tn", "fp")})
    found = found.withColumns({"f1_1": f1("precision_1", "recall_1"), "f1_0": f1("precision_0", "recall_0")})
    accuracy = F.coalesce(F.try_divide((F.col("tp") + F.col("tn")).cast("double"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), F.lit(0.0))
    names = ["precision_1", "recall_1", "f1_1", "precision_0", "recall_0", "f1_0"]
    return found.select("tp", "fp", "tn", "fn", *[F.round(c, 4).alias(c) for c in names], F.round((F.col("f1_1") + F.col("f1_0")) / 2, 4).alias("macro_f1"), F.round(accuracy, 4).alias("accuracy"))


def ensemble(rows: DataFrame, probabilities: list[str], weights: list[float] | None = None) -> DataFrame:
    """``rows`` with the mean and the weighted mean of probabilities, and what each of them and the majority predict."""
    weights = weights or [1.0] * len(probabilities)
    mean = sum((F.col(p) for p in probabilities[1:]), F.col(probabilities[0])) / len(probabilities)
    weighted = sum((F.col(p) * w for p, w in zip(probabilities[1:], weights[1:])), F.col(probabilities[0]) * weights[0]) / sum(weights)
    votes = sum(((F.col(p) >= 0.5).cast("int") for p in probabilities[1:]), (F.col(probabilities[0]) >= 0.5).cast("int"))
    return rows.withColumns({
        "mean_probability": mean, "mean_label": (mean >= 0.5).cast("int"), "weighted_probability": weighted, "weighted_label": (weighted >= 0.5).cast("int"),
        "majority_label": (votes * 2 > len(probabilities)).cast("int"),
    })


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    """Names of columns that both tables have, in the order of the first."""
    return [c for c in a.columns if c in b.columns]


_MEMBER = r"\s+(?:Vice\s+Mayor|Mayor|Councilmember)\s+([A-Z][\w'-]*)"


def _summary_motion(part: Column) -> Column:
    """Items, mover, seconder, tallies and those for one motion of an action summary."""
    pick = lambda pattern: F.nullif(F.trim(F.regexp_extract(part, pattern, 1)), F.lit(""))
    items = F.regexp_extract_all(F.regexp_extract(part, r"(?i)^motion\s+to\s+\w+\s+(?:agenda\s+)?items?\s+([\w,.& ]*?)\s*(?:was\s+)?made\s+by", 1), F.lit(r"(\d+[A-Z]?\d*)"), F.lit(1))
    names = F.filter(F.transform(F.split(F.regexp_extract(part, r"(?i)\bFor:\s*([^;.]*)", 1), r"\s*(?:,|\band\b)\s*"), lambda n: F.trim(n)), lambda n: n != "")
    return F.struct(
        items.alias("items"), pick(rf"(?i:made\s+by){_MEMBER}").alias("mover"), pick(rf"(?i:seconded\s+by){_MEMBER}").alias("seconder"),
        pick(r"(?i)\bAye:\s*(\d+)").cast("int").alias("ayes"), pick(r"(?i)\bNay:\s*(\d+)").cast("int").alias("nays"), names.alias("voters"),
    )


def summary_motions(text: Column) -> Column:
    """Motions of an action summary's text, as an array.

    A motion reads ``Motion to Approve Items 1, 2 made by Councilmember X and
    seconded by Councilmember Y ... Aye: 7; Nay: 0; ... For: A, B``.
    """
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "), r"(?i)(?=\bmotion\s+to\s)")
    return F.transform(F.filter(parts, lambda p: p.rlike(r"(?i)^motion\s+to\b.*\baye:")), lambda p: _summary_motion(p))


def action_summary(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each item that a motion of an action summary names; see :func:`summary_motions`."""
    motions = docs.select(id_col, F.explode(summary_motions(F.col(text))).alias("m"))
    return motions.select(id_col, F.explode("m.items").alias("item_number"), "m.mover", "m.seconder", "m.ayes", "m.nays", "m.voters")
