"""Votes, attendance and items out of minutes text, as table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.operators.line_machine import attendance, votes

# The forms of case numbers.
_CASE = r"(?i)(?:Z[-/\s]?\d{3,6}|PLN\d{4,6}|SPL\s*\d{3,6}|V[OA]\s*\d{3,6}|CASE\s*\d{4,9}|Project\s*(?:Number|#|No\.?)\s*[-:.]?\s*\d{3,9}|(?<!\w)\d{2}-\d{4,6}(?!\w))"


def motions(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """One row for each motion with its place, mover, seconder, outcome, counts and whether it was unanimous."""
    return votes(docs, id_col, text).select(id_col, "place", "mover", "seconder", "result", "yes_votes", "no_votes", "unanimous")


def roll_call(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Names of the roll, behind its headings or on lines of their own, with whether they were there."""
    return attendance(docs, id_col, text).select(id_col, "name", "present")


def numbered_items(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Items that begin a line with ``n.`` or ``n)``, where n counts on from the item before."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("place", "line"))
    marked = lines.select(id_col, "place", F.regexp_extract("line", r"^\s*(\d{1,3})[.)]\s+\S", 1).try_cast("int").alias("number"), F.regexp_extract("line", r"^\s*\d{1,3}[.)]\s+(.*)$", 1).alias("title"))
    candidates = marked.where("number is not null").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("place", "number", "title"))).alias("found"))
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<number:int,title:string>>").alias("kept"))
    folded = F.aggregate(
        "found", start,
        lambda state, x: F.when(x["number"] == state["last"] + 1, F.struct(x["number"].alias("last"), F.concat(state["kept"], F.array(F.struct(x["number"].alias("number"), x["title"].alias("title")))).alias("kept"))).otherwise(state),
    )
    return candidates.select(id_col, F.explode(folded["kept"]).alias("item")).select(id_col, "item.number", "item.title")


def events(docs: DataFrame, id_col: str, text: str, verbs: dict[str, str], around: int = 60) -> DataFrame:
    """Every verb of a lookup (verb to event type): its type, place, context, case number and confidence.

    ``start`` counts characters from 0; the first case number from 100 characters
    before the verb to 200 after it is taken; a verb within the first 15
    characters of its line has a confidence of 0.9, any other 0.7.
    """
    pattern = "(?i)\\b(?:%s)\\b" % "|".join(sorted(verbs, key=len, reverse=True))
    matched = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("__body")).withColumn("__verbs", F.regexp_extract_all("__body", F.lit(pattern), F.lit(0)))
    gaps = F.transform(F.split("__body", pattern), F.length)
    # the places follow from the lengths of the verbs and of what lies between them
    places = F.aggregate(
        F.arrays_zip(F.slice(gaps, 1, F.size("__verbs")).alias("gap"), F.col("__verbs").alias("verb")), F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,verb:string>>").alias("found")),
        lambda state, x: F.struct(
            (state["end"] + x["gap"] + F.length(x["verb"])).alias("end"),
            F.concat(state["found"], F.array(F.struct((state["end"] + x["gap"]).alias("start"), x["verb"].alias("verb")))).alias("found"),
        ),
    )["found"]
    found = matched.select(id_col, "__body", F.posexplode(places).alias("place", "at")).select(id_col, "__body", "place", "at.start", F.lower("at.verb").alias("verb"), (F.col("at.start") + F.length("at.verb")).alias("__end"))
    near = lambda before, after: F.substring("__body", F.greatest(F.col("start") - before, F.lit(0)) + 1, F.col("__end") + after - F.greatest(F.col("start") - before, F.lit(0)))
    case = F.nullif(F.upper(F.replace(F.regexp_extract(near(100, 200), _CASE, 0), F.lit(" "), F.lit(""))), F.lit(""))
    column = F.length(F.substring_index(F.substring("__body", F.lit(1), F.col("start")), "\n", -1))
    table = F.create_map(*[F.lit(x) for pair in verbs.items() for x in pair])
    return found.select(
        id_col, "place", "verb", F.element_at(table, F.col("verb")).alias("event_type"), near(around, around).alias("context"),
        "start", case.alias("case_number"), F.when(column < 15, 0.9).otherwise(0.7).alias("confidence"),
    )


def sample_by_stratum(df: DataFrame, strata: list[str], id_col: str, each: int) -> DataFrame:
    """The ``each`` rows of every stratum with the smallest hash of their id."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*strata).orderBy(F.xxhash64(id_col), id_col)
    return df.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= each).drop("__place")


def sample_quotas(counts: dict, target: int, most: int, weights: dict | None = None, other: float = 0.02) -> dict:
    """Rows to take of each group for a total of ``target``: by weight, at least one, at most ``most``; what is left goes to the largest groups."""
    weight = {g: (weights or {}).get(g, other) for g in counts}
    total = sum(weight.values())
    quota = {g: min(max(1, int(target * weight[g] / total)), n, most) for g, n in counts.items()}
    left = target - sum(quota.values())
    for g in sorted(counts, key=lambda g: (quota[g] - counts[g], str(g))):
        take = max(0, min(left, counts[g] - quota[g], most - quota[g]))
        quota[g], left = quota[g] + take, left - take
    return quota


def sample_by_quota(df: DataFrame, group: str, strata: list[str], id_col: str, target: int, most: int, weights: dict | None = None) -> DataFrame:
    """About ``target`` rows by the quotas of the groups: one row of each stratum first, then others by a hash of the id.  Groups are few."""
    from pyspark.sql.window import Window

    quota = sample_quotas({r[0]: r[1] for r in df.groupBy(group).count().collect()}, target, most, weights)
    kinds = df.schema[group].dataType.simpleString()
    wanted = df.sparkSession.createDataFrame(list(quota.items()), f"__group {kinds}, __quota long")
    h = F.xxhash64(id_col)
    placed = df.withColumn("__place", F.row_number().over(Window.partitionBy(group, *strata).orderBy(h, id_col))).where(F.col("__place") <= most)
    order = Window.partitionBy(group).orderBy(F.col("__place") > 1, *[F.when(F.col("__place") == 1, F.col(c)) for c in strata], h, id_col)
    ranked = placed.withColumn("__rank", F.row_number().over(order)).join(F.broadcast(wanted), F.col(group).eqNullSafe(F.col("__group")))
    return ranked.where("__rank <= __quota").drop("__place", "__rank", "__group", "__quota")


def split_80_10_10(df: DataFrame, id_col: str, strata: list[str] | tuple = (), buckets: int = 1024):
    """A column ``fold``: of each stratum's rows, in the order of a hash of the id, floor(0.8 n) are train, floor(0.1 n) val and the rest test.

    Rows are ranked within buckets of the hash, behind the rows of the buckets
    before, so no task has to hold a stratum.
    """
    from pyspark.sql.window import Window

    names = [f"__s{i}" for i in range(len(strata))]
    rows = df.select("*", *[F.col(c).alias(n) for c, n in zip(strata, names)], F.xxhash64(id_col).alias("__h")).withColumn("__bucket", F.pmod("__h", F.lit(buckets)))
    sizes = rows.groupBy(*names, "__bucket").agg(F.count("*").alias("__n"))
    of = Window.partitionBy(*names)
    before = F.coalesce(F.sum("__n").over(of.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*[F.col(n).alias(f"{n}_") for n in names], F.col("__bucket").alias("__bucket_"), before.alias("__before"), F.sum("__n").over(of).alias("__total"))
    match = F.col("__bucket") == F.col("__bucket_")
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"{n}_"))
    place = F.row_number().over(Window.partitionBy(*names, "__bucket").orderBy("__h", id_col)) + F.col("__before")
    train, val = F.floor(F.col("__total") * 8 / 10), F.floor(F.col("__total") / 10)
    fold = F.when(F.col("__place") <= train, "train").when(F.col("__place") <= train + val, "val").otherwise("test")
    return rows.join(sizes, match).withColumn("__place", place).select(*df.columns, fold.alias("fold"))
