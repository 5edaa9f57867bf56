"""Vote analytics queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from civicspark.operators import votes as V
from civicspark.plans.registry import query

_NORM = """v AS (SELECT agenda_item_vote_id, member_id, CASE WHEN lower(trim(raw_vote)) IN ('yes', 'aye') THEN 'yes' WHEN lower(trim(raw_vote)) IN ('no', 'nay') THEN 'no'
  WHEN lower(trim(raw_vote)) IN ('abstain', 'abstained') THEN 'abstain' ELSE lower(trim(raw_vote)) END AS vote FROM member_votes)"""
_TALLY = _NORM + """, c AS (SELECT agenda_item_vote_id, count(*) FILTER (WHERE vote = 'yes') AS yes_votes, count(*) FILTER (WHERE vote = 'no') AS no_votes,
  count(*) FILTER (WHERE vote = 'abstain') AS abstain_votes, count(*) AS total_votes FROM v GROUP BY 1),
t AS (SELECT *, yes_votes > 0 AND no_votes > 0 AS is_split, CASE WHEN yes_votes > no_votes THEN 'yes' WHEN no_votes > yes_votes THEN 'no' WHEN yes_votes > 0 THEN 'tie' END AS majority FROM c)"""
_ATT = "a AS (SELECT member_id, count(*) FILTER (WHERE present) AS attendance_present, count(*) FILTER (WHERE NOT present) AS attendance_absent FROM meeting_members GROUP BY 1)"
_DATED = "d AS (SELECT v.* FROM v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE m.meeting_date >= '1996-01-01' AND m.meeting_date <= '1998-12-31')"


def _stats(source: str) -> str:
    return f"""SELECT x.member_id, total_votes, yes, no, abstain, split_votes_attended, with_majority, against_majority, coalesce(attendance_present, 0) AS attendance_present,
  coalesce(attendance_absent, 0) AS attendance_absent, round(attendance_present * 1.0 / nullif(attendance_present + attendance_absent, 0), 4) AS attendance_rate,
  round(against_majority * 1.0 / nullif(split_votes_attended, 0), 4) AS dissent_rate FROM (
  SELECT member_id, count(*) AS total_votes, count(*) FILTER (WHERE vote = 'yes') AS yes, count(*) FILTER (WHERE vote = 'no') AS no, count(*) FILTER (WHERE vote = 'abstain') AS abstain,
  count(*) FILTER (WHERE is_split) AS split_votes_attended, count(*) FILTER (WHERE is_split AND majority = vote) AS with_majority,
  count(*) FILTER (WHERE is_split AND majority IN ('yes', 'no') AND vote IN ('yes', 'no') AND vote <> majority) AS against_majority
  FROM {source} s JOIN t USING (agenda_item_vote_id) GROUP BY 1) x LEFT JOIN a USING (member_id)"""


@query("v1", f"WITH {_TALLY}, {_ATT} {_stats('v')}")
def v1(t):
    """Statistics of every member over all votes."""
    votes = V.normalized(t.member_votes)
    return V.member_stats(votes, votes, t.meeting_members)


@query("v1_dated", f"WITH {_TALLY}, {_ATT}, {_DATED} {_stats('d')}")
def v1_dated(t):
    """Statistics over the votes of three years; attendance is not dated."""
    votes = V.normalized(t.member_votes)
    return V.member_stats(V.dated(votes, t.meetings, "1996-01-01", "1998-12-31"), votes, t.meeting_members)


_SPLIT = """SELECT agenda_item_vote_id, member_id, vote, yes_votes, no_votes, majority, CASE WHEN majority = 'tie' THEN 'tie' WHEN vote = majority THEN 'with_majority'
  WHEN vote IN ('yes', 'no') THEN 'against_majority' ELSE 'not_voting' END AS alignment FROM v JOIN t USING (agenda_item_vote_id) WHERE is_split"""


@query("v2", f"WITH {_TALLY} {_SPLIT}")
def v2(t):
    """Votes on split items with majority and alignment."""
    return V.split_votes(V.normalized(t.member_votes))


@query("v3", f"WITH {_TALLY} SELECT * FROM ({_SPLIT}) s WHERE alignment = 'against_majority'")
def v3(t):
    """Dissents."""
    return V.dissents(V.normalized(t.member_votes))


@query("v4", f"""WITH {_NORM} SELECT v.member_id, v.agenda_item_vote_id, i.c_number, m.meeting_date, i.motion_result FROM v LEFT JOIN agenda_item_votes i ON i.id = v.agenda_item_vote_id
  LEFT JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE v.vote = 'abstain'""")
def v4(t):
    """Abstentions with their item and meeting."""
    votes = V.normalized(t.member_votes).where("vote = 'abstain'")
    items = t.agenda_item_votes.select(F.col("id").alias("agenda_item_vote_id"), "c_number", "motion_result")
    dates = t.meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "meeting_date")
    return votes.join(items, "agenda_item_vote_id", "left").join(dates, "agenda_item_vote_id", "left").select("member_id", "agenda_item_vote_id", "c_number", "meeting_date", "motion_result")


@query("v5", "SELECT mm.member_id, mm.meeting_id, m.meeting_date, coalesce(nullif(m.title, ''), m.meeting_type) AS title FROM meeting_members mm JOIN meetings m USING (meeting_id) WHERE NOT mm.present")
def v5(t):
    """Absences with the meeting's title, or its type where that is empty."""
    title = F.coalesce(F.nullif("title", F.lit("")), "meeting_type")
    return t.meeting_members.where(~F.col("present")).join(t.meetings, "meeting_id").select("member_id", "meeting_id", "meeting_date", title.alias("title"))


@query("v6", f"""WITH {_TALLY}, r AS (SELECT v.member_id, v.agenda_item_vote_id, m.meeting_date, v.vote, t.yes_votes, t.no_votes,
  row_number() OVER (PARTITION BY v.member_id ORDER BY m.meeting_date DESC, v.agenda_item_vote_id) AS place FROM v JOIN t USING (agenda_item_vote_id)
  JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id) SELECT * FROM r WHERE place <= 25""")
def v6(t):
    """The newest 25 votes of each member."""
    votes = V.normalized(t.member_votes)
    dates = t.meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "meeting_date")
    rows = votes.join(V.tallies(votes).select("agenda_item_vote_id", "yes_votes", "no_votes"), "agenda_item_vote_id").join(dates, "agenda_item_vote_id")
    order = Window.partitionBy("member_id").orderBy(F.desc("meeting_date"), "agenda_item_vote_id")
    return rows.withColumn("place", F.row_number().over(order)).where("place <= 25").select("member_id", "agenda_item_vote_id", "meeting_date", "vote", "yes_votes", "no_votes", "place")


@query("v7", f"""WITH {_TALLY} SELECT member_id, total_votes, unanimous_votes, split_votes_attended, with_majority, against_majority, abstain_on_split,
  round(with_majority * 1.0 / nullif(split_votes_attended, 0), 4) AS majority_alignment_rate, round(against_majority * 1.0 / nullif(split_votes_attended, 0), 4) AS dissent_rate FROM (
  SELECT member_id, count(*) AS total_votes, count(*) FILTER (WHERE NOT is_split) AS unanimous_votes, count(*) FILTER (WHERE is_split) AS split_votes_attended,
  count(*) FILTER (WHERE is_split AND vote = majority) AS with_majority, count(*) FILTER (WHERE is_split AND majority <> 'tie' AND vote IN ('yes', 'no') AND vote <> majority) AS against_majority,
  count(*) FILTER (WHERE is_split AND vote = 'abstain') AS abstain_on_split FROM v JOIN t USING (agenda_item_vote_id) GROUP BY 1) x""")
def v7(t):
    """Agreement with the majority on split votes."""
    return V.majority_alignment(V.normalized(t.member_votes))


_PAIRS = """p AS (SELECT a.member_id, b.member_id AS other_member_id, a.vote = b.vote AS same, t.is_split FROM v a JOIN v b ON a.agenda_item_vote_id = b.agenda_item_vote_id AND a.member_id <> b.member_id
  JOIN t ON t.agenda_item_vote_id = a.agenda_item_vote_id WHERE a.vote IN ('yes', 'no') AND b.vote IN ('yes', 'no')
  AND a.member_id IN (SELECT member_id FROM k) AND b.member_id IN (SELECT member_id FROM k)),
g AS (SELECT member_id, other_member_id, count(*) AS total_comparable_votes, count(*) FILTER (WHERE same) AS same_votes, count(*) FILTER (WHERE NOT same) AS different_votes,
  count(*) FILTER (WHERE is_split) AS split_vote_comparable, count(*) FILTER (WHERE same AND is_split) AS split_vote_same FROM p GROUP BY 1, 2)"""
_ACTIVE = "k AS (SELECT member_id FROM meeting_members GROUP BY 1 HAVING count(*) >= 5)"


@query("v8", f"""WITH {_TALLY}, {_ACTIVE}, {_PAIRS} SELECT *, round(100.0 * same_votes / total_comparable_votes, 1)::DOUBLE AS overall_alignment_pct,
  round(100.0 * split_vote_same / nullif(split_vote_comparable, 0), 1)::DOUBLE AS split_vote_alignment_pct FROM g""")
def v8(t):
    """Pairwise alignment of all members."""
    return V.pairwise_alignment(V.normalized(t.member_votes), t.meeting_members)


@query("v9", f"WITH {_TALLY} SELECT agenda_item_vote_id, member_id, vote, yes_votes, no_votes FROM v JOIN t USING (agenda_item_vote_id) WHERE is_split AND abs(yes_votes - no_votes) = 1 AND vote = majority")
def v9(t):
    """Swing votes."""
    return V.swing_votes(V.normalized(t.member_votes))


@query("v10", f"WITH {_TALLY} SELECT s.*, p.name FROM ({_SPLIT}) s JOIN persons p ON p.id = s.member_id WHERE alignment = 'against_majority' AND p.name ILIKE '%00001%'")
def v10(t):
    """Dissents of members whose name holds a text."""
    named = t.persons.where(F.col("name").ilike("%00001%")).select(F.col("id").alias("member_id"), "name")
    return V.dissents(V.normalized(t.member_votes)).join(named, "member_id")


@query("v11", f"""WITH {_TALLY}, b AS (SELECT v.* FROM v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE m.body = 'nation_0' AND m.meeting_date <= '1998-12-31')
  SELECT member_id, count(*) AS total_votes, count(*) FILTER (WHERE is_split) AS split_votes, count(*) FILTER (WHERE is_split AND majority IN ('yes', 'no') AND vote IN ('yes', 'no') AND vote <> majority) AS against_majority,
  count(*) FILTER (WHERE is_split) - count(*) FILTER (WHERE is_split AND majority IN ('yes', 'no') AND vote IN ('yes', 'no') AND vote <> majority) AS with_majority FROM b JOIN t USING (agenda_item_vote_id) GROUP BY 1""")
def v11(t):
    """Statistics of one commission; what is not against the majority counts as with it, also abstentions."""
    every = V.normalized(t.member_votes)
    votes = V.dated(every, t.meetings, end="1998-12-31", body="nation_0").join(V.tallies(every), "agenda_item_vote_id")
    vote, majority = F.col("vote"), F.col("majority")
    against = F.count_if(F.col("is_split") & majority.isin("yes", "no") & vote.isin("yes", "no") & (vote != majority))
    split = F.count_if("is_split")
    return votes.groupBy("member_id").agg(F.count("*").alias("total_votes"), split.alias("split_votes"), against.alias("against_majority"), (split - against).alias("with_majority"))


@query("v12", f"""WITH {_TALLY} SELECT agenda_item_vote_id, member_id, vote, CASE WHEN majority = 'tie' THEN 'Tie' WHEN vote = majority THEN 'Majority' WHEN vote IN ('yes', 'no') THEN 'Dissent' ELSE 'Other' END AS label
  FROM v JOIN t USING (agenda_item_vote_id) JOIN meetings m ON m.meeting_id = agenda_item_vote_id WHERE is_split AND m.body = 'nation_0'""")
def v12(t):
    """Split votes of one commission with a label."""
    votes = V.normalized(t.member_votes)
    chosen = t.meetings.where("body = 'nation_0'").select(F.col("meeting_id").alias("agenda_item_vote_id"))
    label = F.create_map(*[F.lit(x) for x in ("tie", "Tie", "with_majority", "Majority", "against_majority", "Dissent", "not_voting", "Other")])
    return V.split_votes(votes).join(chosen, "agenda_item_vote_id", "left_semi").select("agenda_item_vote_id", "member_id", "vote", label[F.col("alignment")].alias("label"))


@query("v13", f"WITH {_TALLY} SELECT agenda_item_vote_id, member_id, vote, concat(yes_votes, '-', no_votes) AS tally FROM v JOIN t USING (agenda_item_vote_id) JOIN meetings m ON m.meeting_id = agenda_item_vote_id WHERE is_split AND abs(yes_votes - no_votes) = 1 AND vote = majority AND m.body = 'nation_0'")
def v13(t):
    """Swing votes of one commission with the tally."""
    chosen = t.meetings.where("body = 'nation_0'").select(F.col("meeting_id").alias("agenda_item_vote_id"))
    swing = V.swing_votes(V.normalized(t.member_votes)).join(chosen, "agenda_item_vote_id", "left_semi")
    return swing.select("agenda_item_vote_id", "member_id", "vote", V.tally_label(F.col("yes_votes"), F.col("no_votes")).alias("tally"))


@query("v14", f"WITH {_NORM} SELECT v.member_id, v.agenda_item_vote_id, v.vote, m.meeting_date FROM v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE m.body = 'nation_0' ORDER BY m.meeting_date DESC, v.agenda_item_vote_id, v.member_id LIMIT 50")
def v14(t):
    """The newest 50 votes of one commission."""
    chosen = t.meetings.where("body = 'nation_0'").select(F.col("meeting_id").alias("agenda_item_vote_id"), "meeting_date")
    rows = V.normalized(t.member_votes).join(chosen, "agenda_item_vote_id").select("member_id", "agenda_item_vote_id", "vote", "meeting_date")
    return rows.orderBy(F.desc("meeting_date"), "agenda_item_vote_id", "member_id").limit(50)


@query("v15", "SELECT v.member_id, count(*) AS votes, min(m.meeting_date) AS first_vote, max(m.meeting_date) AS last_vote FROM member_votes v JOIN meetings m ON m.meeting_id = v.agenda_item_vote_id WHERE m.body = 'nation_0' AND m.meeting_date >= '1997-01-01' GROUP BY 1")
def v15(t):
    """Members of one commission who voted since a date."""
    chosen = t.meetings.where("body = 'nation_0' and meeting_date >= '1997-01-01'").select(F.col("meeting_id").alias("agenda_item_vote_id"), "meeting_date")
    return t.member_votes.join(chosen, "agenda_item_vote_id").groupBy("member_id").agg(F.count("*").alias("votes"), F.min("meeting_date").alias("first_vote"), F.max("meeting_date").alias("last_vote"))


@query("v16", f"""WITH {_TALLY}, k AS (SELECT DISTINCT member_id FROM v JOIN meetings m ON m.meeting_id = agenda_item_vote_id WHERE m.body = 'nation_0'),
p AS (SELECT a.member_id, b.member_id AS other_member_id, a.vote = b.vote AS same, t.is_split FROM v a JOIN v b ON a.agenda_item_vote_id = b.agenda_item_vote_id AND a.member_id < b.member_id
  JOIN t ON t.agenda_item_vote_id = a.agenda_item_vote_id JOIN meetings m ON m.meeting_id = a.agenda_item_vote_id AND m.body = 'nation_0' WHERE a.vote IN ('yes', 'no') AND b.vote IN ('yes', 'no'))
SELECT member_id, other_member_id, count(*) AS comparable, count(*) FILTER (WHERE same) AS same_votes, count(*) FILTER (WHERE is_split) AS split_comparable FROM p GROUP BY 1, 2""")
def v16(t):
    """Pairwise alignment within one commission, each pair once."""
    votes = V.dated(V.normalized(t.member_votes), t.meetings, body="nation_0").where(F.col("vote").isin("yes", "no"))
    split = Window.partitionBy("agenda_item_vote_id")
    votes = votes.withColumn("is_split", F.min("vote").over(split) != F.max("vote").over(split))
    other = votes.select("agenda_item_vote_id", F.col("member_id").alias("other_member_id"), F.col("vote").alias("other_vote"))
    pairs = votes.join(other, "agenda_item_vote_id").where("member_id < other_member_id")
    return pairs.groupBy("member_id", "other_member_id").agg(
        F.count("*").alias("comparable"), F.count_if(F.col("vote") == F.col("other_vote")).alias("same_votes"), F.count_if("is_split").alias("split_comparable")
    )


@query("v17", f"""WITH {_TALLY} SELECT agenda_item_vote_id, concat(yes_votes, '-', no_votes) AS tally, string_agg(concat(member_id, ':', vote), ',' ORDER BY member_id) AS votes
  FROM v JOIN t USING (agenda_item_vote_id) WHERE is_split GROUP BY agenda_item_vote_id, yes_votes, no_votes""")
def v17(t):
    """Split items with all their votes as one text."""
    votes = V.normalized(t.member_votes)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("member_id", "vote"))), lambda x: F.concat_ws(":", x["member_id"].cast("string"), x["vote"])), ",")
    split = V.tallies(votes).where("is_split")
    rows = votes.join(split, "agenda_item_vote_id").groupBy("agenda_item_vote_id", "yes_votes", "no_votes").agg(listed.alias("votes"))
    return rows.select("agenda_item_vote_id", V.tally_label(F.col("yes_votes"), F.col("no_votes")).alias("tally"), "votes")


@query("v18", f"""WITH {_TALLY}, b AS (SELECT m.body, t.* FROM t JOIN meetings m ON m.meeting_id = t.agenda_item_vote_id)
  SELECT body, count(*) AS items, count(*) FILTER (WHERE is_split) AS split_items, count(*) FILTER (WHERE majority = 'tie') AS ties, round(100.0 * count(*) FILTER (WHERE is_split) / count(*), 1)::DOUBLE AS split_pct,
  count(*) FILTER (WHERE is_split AND abs(yes_votes - no_votes) = 1) AS close_items, sum(total_votes)::BIGINT AS votes FROM b GROUP BY 1""")
def v18(t):
    """Summary of every body's items."""
    tally = V.tallies(V.normalized(t.member_votes)).join(t.meetings.select(F.col("meeting_id").alias("agenda_item_vote_id"), "body"), "agenda_item_vote_id")
    close = F.col("is_split") & (F.abs(F.col("yes_votes") - F.col("no_votes")) == 1)
    return tally.groupBy("body").agg(
        F.count("*").alias("items"), F.count_if("is_split").alias("split_items"), F.count_if(F.col("majority") == "tie").alias("ties"),
        V.percent(F.count_if("is_split"), F.count("*")).alias("split_pct"), F.count_if(close).alias("close_items"), F.sum("total_votes").alias("votes"),
    )


@query("v18_matrix", f"""WITH {_TALLY}, {_ACTIVE}, {_PAIRS} SELECT member_id, string_agg(concat(other_member_id, ':', round(100.0 * same_votes / total_comparable_votes, 1)::DOUBLE), ' ' ORDER BY other_member_id) AS cells
  FROM g WHERE total_comparable_votes > 0 GROUP BY 1""")
def v18_matrix(t):
    """A row of the alignment matrix for each member: the other members with their shares."""
    pairs = V.pairwise_alignment(V.normalized(t.member_votes), t.meeting_members).where("overall_alignment_pct is not null")
    cells = F.array_sort(F.collect_list(F.struct("other_member_id", "overall_alignment_pct")))
    rows = pairs.groupBy("member_id").agg(cells.alias("cells"))
    return rows.select("member_id", F.array_join(F.transform("cells", lambda x: F.concat_ws(":", x["other_member_id"].cast("string"), x["overall_alignment_pct"].cast("string"))), " ").alias("cells"))


@query("v18_pairs", f"WITH {_TALLY}, {_ACTIVE}, {_PAIRS} SELECT member_id, other_member_id, round(100.0 * same_votes / total_comparable_votes, 1)::DOUBLE AS pct FROM g")
def v18_pairs(t):
    """Alignment of all members as rows of the matrix."""
    return V.pairwise_alignment(V.normalized(t.member_votes), t.meeting_members).select("member_id", "other_member_id", F.col("overall_alignment_pct").alias("pct"))


@query("v19", f"WITH {_TALLY} SELECT agenda_item_vote_id, majority FROM t")
def v19(t):
    """Majority position of every item."""
    return V.tallies(V.normalized(t.member_votes)).select("agenda_item_vote_id", "majority")


@query("v20", f"""WITH {_TALLY} SELECT agenda_item_vote_id, is_split, CASE WHEN yes_votes + no_votes > 0 THEN NOT is_split END AS unanimous, coalesce(majority, 'unknown') AS majority_position FROM t""")
def v20(t):
    """Derived attributes of every item."""
    return V.vote_attributes(V.normalized(t.member_votes))[0]


@query("v20_dissent", f"""WITH {_TALLY} SELECT agenda_item_vote_id, member_id, vote, CASE WHEN vote IN ('yes', 'no') THEN coalesce(majority IN ('yes', 'no') AND vote <> majority, false) END AS is_dissent FROM v JOIN t USING (agenda_item_vote_id)""")
def v20_dissent(t):
    """Dissent flag of every vote."""
    return V.vote_attributes(V.normalized(t.member_votes))[1]


_MISSING = """r AS (SELECT m.meeting_id, p.id AS member_id FROM meetings m JOIN persons p ON p.public_body_id = m.public_body_id),
i AS (SELECT id, meeting_id FROM agenda_item_votes WHERE motion_result <> 'withdrawn' AND (vote_text LIKE '%Ayes:%' OR vote_text LIKE '%Nay:%')),
e AS (SELECT i.id, i.meeting_id, r.member_id, mv.member_id IS NOT NULL AS voted FROM i JOIN r USING (meeting_id) LEFT JOIN member_votes mv ON mv.agenda_item_vote_id = i.id AND mv.member_id = r.member_id)"""


@query("v21", f"WITH {_MISSING} SELECT meeting_id, member_id FROM e GROUP BY 1, 2 HAVING count(*) FILTER (WHERE voted) = 0")
def v21(t):
    """Absences inferred from missing votes."""
    items = t.agenda_item_votes.join(t.meetings.select("meeting_id", "public_body_id"), "meeting_id")
    return V.infer_missing(t.member_votes, items, t.persons.select("public_body_id", F.col("id").alias("member_id")), "public_body_id")[0]


@query("v22", "SELECT r.meeting_id, r.member_id FROM (SELECT m.meeting_id, p.id AS member_id FROM meetings m JOIN persons p ON p.public_body_id = m.public_body_id) r WHERE NOT EXISTS (SELECT 1 FROM member_votes v WHERE v.agenda_item_vote_id = r.meeting_id AND v.member_id = r.member_id)")
def v22(t):
    """Roster members without a vote at a meeting."""
    votes = t.member_votes.select(F.col("agenda_item_vote_id").alias("meeting_id"), "member_id")
    members = t.persons.select("public_body_id", F.col("id").alias("member_id"))
    return V.without_vote(t.meetings.select("meeting_id", "public_body_id"), members, votes, "meeting_id", "public_body_id").select("meeting_id", "member_id")


@query("v24", f"WITH {_TALLY} SELECT agenda_item_vote_id, yes_votes > 0 AND no_votes > 0 AS is_split FROM t")
def v24(t):
    """Split detection on an array of votes."""
    arrays = V.normalized(t.member_votes).groupBy("agenda_item_vote_id").agg(F.collect_list("vote").alias("cast"))
    has = lambda word: F.exists("cast", lambda x: x == word)
    return arrays.select("agenda_item_vote_id", (has("yes") & has("no")).alias("is_split"))


@query("v25", f"""WITH {_TALLY} SELECT agenda_item_vote_id, count(*) FILTER (WHERE majority IN ('yes', 'no') AND vote IN ('yes', 'no') AND vote <> majority) AS dissents FROM v JOIN t USING (agenda_item_vote_id) GROUP BY 1""")
def v25(t):
    """Dissents of an array of votes."""
    votes = V.normalized(t.member_votes)
    arrays = votes.groupBy("agenda_item_vote_id").agg(F.collect_list("vote").alias("cast"))
    count = lambda word: F.size(F.filter("cast", lambda x: x == word))
    return arrays.select("agenda_item_vote_id", F.when(count("yes") == count("no"), 0).otherwise(F.least(count("yes"), count("no"))).cast("long").alias("dissents"))


@query("v26", """SELECT substring(c_number, 1, length(c_number) - 3) AS base, count(*) AS revisions, string_agg(concat(substring(c_number, length(c_number) - 1, 2), '@', id), ',' ORDER BY c_number, id) AS history FROM agenda_item_votes GROUP BY 1""")
def v26(t):
    """Items of every C-number base with their revisions in order."""
    from civicspark.functions.text import c_number_parts

    rows = t.agenda_item_votes.select("id", "c_number", c_number_parts("c_number").alias("parts"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("c_number", "id", F.col("parts.revision").alias("revision")))), lambda x: F.concat_ws("@", x["revision"], x["id"].cast("string")))
    return rows.groupBy(F.col("parts.base").alias("base")).agg(F.count("*").alias("revisions"), F.array_join(listed, ",").alias("history"))


@query("v30", """SELECT person_id, public_body_id, term_start, term_end FROM (SELECT *, row_number() OVER (PARTITION BY person_id, public_body_id ORDER BY term_start DESC) AS rn FROM body_memberships) x WHERE rn = 1""")
def v30(t):
    """Latest membership of each person in each body."""
    last = t.body_memberships.groupBy("person_id", "public_body_id").agg(F.max_by(F.struct("term_start", "term_end"), "term_start").alias("m"))
    return last.select("person_id", "public_body_id", "m.term_start", "m.term_end")


@query("v31", """SELECT b.body_code, coalesce(x.id, min(p.id)) AS jurisdiction_id FROM public_bodies b LEFT JOIN public_bodies x ON x.slug = b.body_code
  LEFT JOIN public_bodies p ON starts_with(p.body_code, substring(b.body_code, 1, 3)) GROUP BY b.body_code, x.id""")
def v31(t):
    """A body's id by its exact code, else the least id of a code with the same beginning."""
    bodies = t.public_bodies.select("body_code", "slug", "id")
    exact = bodies.select(F.col("slug").alias("body_code"), F.col("id").alias("exact"))
    prefix = bodies.groupBy(F.substring("body_code", 1, 3).alias("prefix")).agg(F.min("id").alias("by_prefix"))
    rows = bodies.select("body_code", F.substring("body_code", 1, 3).alias("prefix")).join(exact, "body_code", "left").join(prefix, "prefix", "left")
    return rows.select("body_code", F.coalesce("exact", "by_prefix").alias("jurisdiction_id"))
