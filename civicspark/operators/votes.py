"""Vote analytics: tallies, member statistics, dissent, swing votes and pairwise alignment.

Every function takes DataFrames and returns one, for all members at once.
``votes`` has ``agenda_item_vote_id``, ``member_id`` and ``raw_vote``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicspark.functions.text import normalize_vote
from civicspark.sources.shared import MOST_PARTS, bounded, parts_for

#: Attendance rows that a member needs before alignment is reported.
LEAST_ATTENDANCE = 5
#: Meetings of a chunk and of a task, about, where pairs of meetings and members are told.
CHUNK_ROWS, TASK_ROWS = 4_096, 65_536


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """``part / whole`` rounded, null where ``whole`` is 0."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), digits)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one digit."""
    return F.round(F.try_divide(100.0 * part, whole), 1)


def normalized(votes: DataFrame) -> DataFrame:
    """Votes with ``vote`` in canonical form."""
    return votes.select("agenda_item_vote_id", "member_id", normalize_vote("raw_vote").alias("vote"))


def tallies(votes: DataFrame) -> DataFrame:
    """Yes, no, abstain and all votes of each item, whether it is split, and the majority.

    ``majority`` is yes, no or tie, and null without a substantive vote.
    """
    counted = votes.groupBy("agenda_item_vote_id").agg(
        F.count_if(F.col("vote") == "yes").alias("yes_votes"), F.count_if(F.col("vote") == "no").alias("no_votes"),
        F.count_if(F.col("vote") == "abstain").alias("abstain_votes"), F.count("*").alias("total_votes"),
    )
    yes, no = F.col("yes_votes"), F.col("no_votes")
    majority = F.when(yes > no, "yes").when(no > yes, "no").when(yes > 0, "tie")
    return counted.withColumns({"is_split": (yes > 0) & (no > 0), "majority": majority})


def dated(votes: DataFrame, meetings: DataFrame, start: str | None = None, end: str | None = None, body: str | None = None) -> DataFrame:
    """Votes of meetings within inclusive ISO dates and of one body; meetings are joined only if asked for."""
    if start is None and end is None and body is None:
        return votes
    held = meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "meeting_date", "body")
    if start is not None:
        held = held.where(F.col("meeting_date") >= start)
    if end is not None:
        held = held.where(F.col("meeting_date") <= end)
    if body is not None:
        held = held.where(F.col("body") == body)
    return votes.join(held.select("agenda_item_vote_id"), "agenda_item_vote_id", "left_semi")


def member_stats(votes: DataFrame, every_vote: DataFrame, attendance: DataFrame) -> DataFrame:
    """Counts, split votes, majority agreement, dissent and attendance of each member.

    ``votes`` may be filtered; tallies come from ``every_vote``.  Ties count as
    attended splits but for neither side.
    """
    tally = tallies(every_vote)
    joined = votes.join(tally, "agenda_item_vote_id")
    vote, majority, split = F.col("vote"), F.col("majority"), F.col("is_split")
    decided = split & majority.isin("yes", "no")
    stats = joined.groupBy("member_id").agg(
        F.count("*").alias("total_votes"), F.count_if(vote == "yes").alias("yes"), F.count_if(vote == "no").alias("no"),
        F.count_if(vote == "abstain").alias("abstain"), F.count_if(split).alias("split_votes_attended"),
        F.count_if(decided & (vote == majority)).alias("with_majority"),
        F.count_if(decided & vote.isin("yes", "no") & (vote != majority)).alias("against_majority"),
    )
    present = attendance.groupBy("member_id").agg(F.count_if("present").alias("attendance_present"), F.count_if(~F.col("present")).alias("attendance_absent"))
    both = stats.join(present, "member_id", "left").fillna(0, ["attendance_present", "attendance_absent"])
    return both.withColumns({
        "attendance_rate": ratio(F.col("attendance_present"), F.col("attendance_present") + F.col("attendance_absent")),
        "dissent_rate": ratio(F.col("against_majority"), F.col("split_votes_attended")),
    })


def split_votes(votes: DataFrame) -> DataFrame:
    """Every member's vote on split items, with the majority and how the vote relates to it."""
    joined = votes.join(tallies(votes).where("is_split"), "agenda_item_vote_id")
    vote, majority = F.col("vote"), F.col("majority")
    alignment = (
        F.when(majority == "tie", "tie").when(vote == majority, "with_majority").when(vote.isin("yes", "no"), "against_majority").otherwise("not_voting")
    )
    return joined.select("agenda_item_vote_id", "member_id", "vote", "yes_votes", "no_votes", "majority", alignment.alias("alignment"))


def dissents(votes: DataFrame) -> DataFrame:
    """Split votes against the majority."""
    return split_votes(votes).where("alignment = 'against_majority'")


def majority_alignment(votes: DataFrame) -> DataFrame:
    """Unanimous and split votes of each member, and agreement with the majority on split ones."""
    joined = votes.join(tallies(votes), "agenda_item_vote_id")
    vote, majority, split = F.col("vote"), F.col("majority"), F.col("is_split")
    decided = split & majority.isin("yes", "no") & vote.isin("yes", "no")
    stats = joined.groupBy("member_id").agg(
        F.count("*").alias("total_votes"), F.count_if(~split).alias("unanimous_votes"), F.count_if(split).alias("split_votes_attended"),
        F.count_if(decided & (vote == majority)).alias("with_majority"), F.count_if(decided & (vote != majority)).alias("against_majority"),
        F.count_if(split & (vote == "abstain")).alias("abstain_on_split"),
    )
    return stats.withColumns({
        "majority_alignment_rate": ratio(F.col("with_majority"), F.col("split_votes_attended")),
        "dissent_rate": ratio(F.col("against_majority"), F.col("split_votes_attended")),
    })


def both_ways(pairs: DataFrame, a: str, b: str, parts: int, counts: list[Column]) -> DataFrame:
    """``counts`` of pairs with ``a`` before ``b``, told for (a, b) and (b, a).

    Half of the pairs are dealt and counted; few repeat within a task, so they are
    dealt before they are counted, over ``parts`` tasks, which keeps a task's table small.
    """
    found = pairs.repartition(parts, a, b).groupBy(a, b).agg(*counts)
    ways = F.explode(F.array(F.struct(F.col(a), F.col(b)), F.struct(F.col(b).alias(a), F.col(a).alias(b)))).alias("__way")
    rest = [c for c in found.columns if c not in (a, b)]
    return found.select(ways, *rest).select(f"__way.{a}", f"__way.{b}", *rest)


def pairwise_alignment(votes: DataFrame, attendance: DataFrame, least_attendance: int = LEAST_ATTENDANCE) -> DataFrame:
    """How often each ordered pair of members votes alike, overall and on split items.

    Only yes and no votes of members with enough attendance rows compare; pairs
    without a common item do not appear.  Items hold a body's few members, so the
    self-join on the item stays in proportion to the votes.
    """
    active = attendance.groupBy("member_id").count().where(F.col("count") >= least_attendance).select("member_id")
    cast = votes.where(F.col("vote").isin("yes", "no"))
    per_item = Window.partitionBy("agenda_item_vote_id")
    flagged = cast.withColumn("is_split", F.min("vote").over(per_item) != F.max("vote").over(per_item)).join(active, "member_id", "left_semi")
    other = flagged.select("agenda_item_vote_id", F.col("member_id").alias("other_member_id"), F.col("vote").alias("other_vote"))
    same = F.col("vote") == F.col("other_vote")
    pairs = flagged.join(other, "agenda_item_vote_id").where(F.col("member_id") < F.col("other_member_id"))
    found = both_ways(pairs.select("member_id", "other_member_id", same.alias("same"), "is_split"), "member_id", "other_member_id", parts_for(votes), [
        F.count("*").alias("total_comparable_votes"), F.count_if("same").alias("same_votes"), F.count_if(~F.col("same")).alias("different_votes"),
        F.count_if("is_split").alias("split_vote_comparable"), F.count_if(F.col("same") & F.col("is_split")).alias("split_vote_same"),
    ])
    return found.withColumns({
        "overall_alignment_pct": percent(F.col("same_votes"), F.col("total_comparable_votes")),
        "split_vote_alignment_pct": percent(F.col("split_vote_same"), F.col("split_vote_comparable")),
    })


def swing_votes(votes: DataFrame) -> DataFrame:
    """Votes of the prevailing side on split items that a margin of one decided."""
    close = tallies(votes).where(F.col("is_split") & (F.abs(F.col("yes_votes") - F.col("no_votes")) == 1))
    return votes.join(close, "agenda_item_vote_id").where(F.col("vote") == F.col("majority")).select("agenda_item_vote_id", "member_id", "vote", "yes_votes", "no_votes")


def vote_attributes(votes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Item attributes (split, unanimous, majority) and each vote's dissent flag.

    Without a substantive vote an item is not split, ``unanimous`` is null and the
    majority unknown; a dissent flag is null for votes that are not yes or no.
    """
    tally = tallies(votes)
    cast = F.col("yes_votes") + F.col("no_votes") > 0
    items = tally.select(
        "agenda_item_vote_id", "is_split", F.when(cast, ~F.col("is_split")).alias("unanimous"), F.coalesce("majority", F.lit("unknown")).alias("majority_position")
    )
    flagged = votes.join(items, "agenda_item_vote_id").select(
        "agenda_item_vote_id", "member_id", "vote",
        F.when(F.col("vote").isin("yes", "no"), F.col("majority_position").isin("yes", "no") & (F.col("vote") != F.col("majority_position"))).alias("is_dissent"),
    )
    return items, flagged


def _in_runs(known: DataFrame, rows: int, roster: DataFrame, id_col: str, by: str) -> DataFrame:
    """Rows of ``known``, of which there are ``rows`` at most, with each member of ``roster`` of the same ``by`` who is not in their array ``__cast``.

    The meetings of a ``by`` are dealt to chunks, and each member is told with one chunk after the other.  So a member's columns stand in runs and
    the same list of meetings comes again and again, which files pack into a small part; only meetings and votes are shuffled, no pairs.
    """
    spark = known.sparkSession
    chunks = rows // CHUNK_ROWS + 1
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, rows // TASK_ROWS + 1))
    rest = [c for c in known.columns if c not in (by, "__cast")]
    told = F.struct(*rest) if len(rest) > 1 else F.col(rest[0])
    dealt = known.select(by, F.pmod(F.xxhash64(id_col), F.lit(chunks)).alias("__chunk"), F.struct(told.alias("row"), F.coalesce("__cast", F.array().cast(known.schema["__cast"].dataType)).alias("cast")).alias("__all"))
    held = dealt.repartition(tasks, by, "__chunk").groupBy(by, "__chunk").agg(F.collect_list("__all").alias("__all"))
    held = held.select(by, F.col("__all.row").alias("__rows"), F.col("__all.cast").alias("__casts"), F.array_distinct(F.flatten("__all.cast")).alias("__voters"))
    voted = lambda k: F.coalesce(F.array_contains(F.get("__casts", k), F.col("member_id")), F.lit(False))
    left = F.when(F.array_contains("__voters", F.col("member_id")), F.filter("__rows", lambda row, k: ~voted(k))).otherwise(F.col("__rows"))
    # a column of its own, so that the explode compiles; below an inner one the planner would ask for the size of what is left, and compute it twice
    pairs = held.join(bounded(roster), by).select(*roster.columns, left.alias("__left"))
    each = pairs.select(*roster.columns, F.posexplode_outer("__left").alias("__no", "__row")).where("__no is not null")
    return each.select(*roster.columns, *(["__row.*"] if len(rest) > 1 else [F.col("__row").alias(rest[0])]))


def without_vote(meetings: DataFrame, roster: DataFrame, votes: DataFrame, id_col: str, by: str) -> DataFrame:
    """``meetings`` with each member of ``roster`` of the same ``by`` whose ``member_id`` has no vote in ``votes`` (``id_col``, ``member_id``).

    These are many more rows than either side has.  Votes come to a meeting as one
    array, so what is shuffled grows with meetings and votes only.
    """
    cast = votes.groupBy(id_col).agg(F.collect_set("member_id").alias("__cast"))
    return _in_runs(meetings.join(cast, id_col, "left"), meetings.count(), roster, id_col, by)


def infer_missing(votes: DataFrame, items: DataFrame, roster: DataFrame, by: str = "meeting_id") -> tuple[DataFrame, DataFrame]:
    """Absences and abstentions of roster members that a meeting's votable items lack.

    ``items``: ``id``, ``meeting_id``, ``motion_result``, ``vote_text`` and ``by``; ``roster``:
    ``by``, which is the meeting or its body, and ``member_id``.  Items count unless withdrawn and only if their
    text names ayes or nays.  A member without any vote at a meeting is absent;
    one with some is given an abstention for each other item.  A meeting's items with their votes are one row,
    so the members that the roster gives to each meeting are not shuffled.
    """
    votable = items.where((F.col("motion_result") != "withdrawn") & F.col("vote_text").rlike("Ayes:|Nay:")).select(F.col("id").alias("agenda_item_vote_id"), "meeting_id", F.col(by).alias("__by"))
    cast = votes.groupBy("agenda_item_vote_id").agg(F.collect_set("member_id").alias("cast"))
    held = votable.join(cast, "agenda_item_vote_id", "left").groupBy("meeting_id", "__by").agg(F.collect_list(F.struct("agenda_item_vote_id", "cast")).alias("held"))
    members = roster.select(F.col(by).alias("__by"), "member_id").distinct()
    expected = held.join(members, "__by")
    voted = lambda x: F.coalesce(F.array_contains(x["cast"], F.col("member_id")), F.lit(False))
    some = F.exists("held", voted)
    cast_any = held.select("meeting_id", "__by", F.flatten(F.filter(F.col("held")["cast"], lambda x: x.isNotNull())).alias("__cast"))
    absent = _in_runs(cast_any, items.count(), members, "meeting_id", "__by").select("meeting_id", "member_id")
    abstained = expected.where(some).select("meeting_id", F.explode(F.filter("held", lambda x: ~voted(x))["agenda_item_vote_id"]).alias("agenda_item_vote_id"), "member_id")
    return absent, abstained


def tally_label(yes: Column, no: Column) -> Column:
    """A tally like ``5-2``."""
    return F.concat_ws("-", yes.cast("string"), no.cast("string"))
