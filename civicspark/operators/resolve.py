"""Entity resolution: blocking, name similarity and merge maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.operators.similarity_join import alike_pairs, inside_pairs
from civicspark.sources.shared import keep


def tokens(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def same_sorted(a: Column, b: Column) -> Column:
    """Whether two token arrays hold the same tokens."""
    return F.array_sort(a) == F.array_sort(b)


def contained(a: Column, b: Column) -> Column:
    """0.85 if one name holds the other and is not four times as long, else 0."""
    shorter, longer = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((a.contains(b) | b.contains(a)) & (shorter > 0.25 * longer), 0.85).otherwise(0.0)


def acronym(name: Column) -> Column:
    """First letters of a name's words."""
    return F.array_join(F.transform(tokens(name), lambda x: F.substring(x, 1, 1)), "")


def _words(name: Column) -> Column:
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != "")


def block_keys(name: Column) -> Column:
    """Keys under which a name is compared: its first letters, its first, last and longest word, and its acronym."""
    longest = F.array_max(F.transform(tokens(name), lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))
    keys = F.array(
        F.concat(F.lit("p:"), F.substring(F.lower(name), 1, 6)), F.concat(F.lit("a:"), F.nullif(acronym(name), F.lit(""))), F.concat(F.lit("w:"), longest["w"]),
        F.concat(F.lit("f:"), F.try_element_at(_words(name), F.lit(1))), F.concat(F.lit("l:"), F.try_element_at(_words(name), F.lit(-1))),
    )
    return F.array_distinct(F.filter(keys, lambda k: k.isNotNull()))


def blocked(a: Column, b: Column) -> Column:
    """Whether two names are compared: they have a block key in common, or the tokens of one lie in the other's."""
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.arrays_overlap(block_keys(a), block_keys(b)) | ((both > 0) & (both == F.least(F.size(x), F.size(y))))


def similar_pairs(entities: DataFrame, id_col: str, name_col: str, least: float = 0.85) -> DataFrame:
    """Pairs of ids of names that are compared (see :func:`blocked`) with similarity of at least ``least``.

    The similarity is the Jaccard coefficient of the tokens, 1 for equal tokens,
    or 0.85 if one name holds the other and is not four times as long.  Names
    meet by their rare tokens and by the rarest letters of the one inside, so
    words that many names share, as legal forms, make no pairs.  The least id of
    names that differ in case at most stands for them, and is paired with each of the others.
    """
    named = entities.select(F.col(id_col).alias("id"), F.lower(F.col(name_col)).alias("name")).where("id is not null and name is not null")
    forms = keep(named.groupBy("name").agg(F.collect_set("id").alias("ids")), "forms")
    sets = keep(forms.groupBy(F.array_sort(tokens(F.col("name"))).alias("tokens")).agg(F.collect_set("name").alias("names")).where(F.size("tokens") > 0), "token-sets")
    numbered = sets.select(F.array_join("tokens", " ").alias("id"), "tokens")
    alike = alike_pairs(numbered, least)
    of_set = sets.select(F.array_join("tokens", " ").alias("key"), "names")
    across = alike.join(of_set.select(F.col("key").alias("a"), F.col("names").alias("x")), "a").join(of_set.select(F.col("key").alias("b"), F.col("names").alias("y")), "b")
    pairs = across.select(F.explode("x").alias("name"), "y").select("name", F.explode("y").alias("other"))
    within = sets.where(F.size("names") > 1).select("names", F.explode("names").alias("name")).select("name", F.explode("names").alias("other"))
    pairs = pairs.union(within)
    if least <= 0.85:
        pairs = pairs.union(inside_pairs(forms.select("name"), forms.select(F.col("name").alias("other")), 0.25))
    pairs = pairs.where("name <> other").select(F.least("name", "other").alias("name"), F.greatest("name", "other").alias("other")).distinct()
    a, b = tokens(F.col("name")), tokens(F.col("other"))
    equal = same_sorted(a, b) & (F.size(a) > 0)
    score = F.round(F.greatest(F.coalesce(jaccard(a, b), F.lit(0.0)), F.when(equal, 1.0).otherwise(0.0), contained(F.col("name"), F.col("other"))), 4)
    pairs = pairs.where(blocked(F.col("name"), F.col("other"))).withColumn("score", score).where(F.col("score") >= least)
    heads = forms.select("name", F.array_min("ids").alias("head"))
    one, two = heads.withColumnRenamed("head", "p"), heads.select(F.col("name").alias("other"), F.col("head").alias("q"))
    found = pairs.join(one, "name").join(two, "other").select("p", "q", "score")
    # a name without letters or digits is like itself by containment only
    same = forms.select(F.array_min("ids").alias("p"), F.explode("ids").alias("q"), F.when(F.size(tokens(F.col("name"))) > 0, 1.0).otherwise(0.85).alias("score"), "name")
    found = found.union(same.where((F.col("score") >= least) & (F.col("name") != "") & (F.col("p") < F.col("q"))).drop("name"))
    return found.select(F.least("p", "q").alias("id"), F.greatest("p", "q").alias("other"), "score")


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """``id`` and ``component``, the smallest id that edges ``a``, ``b`` reach.

    Every round hangs each node on the least of its neighbours' labels, then on
    that label's own, and ends in a table in the shared folder.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = keep(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("id"), F.least("a", "low").alias("component")), "labels")
    for _ in range(rounds):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("component").alias("up"))
        moved = least.join(up, "next", "left").select("id", F.least("next", F.coalesce("up", "next")).alias("component"), F.col("component").alias("was"))
        moved = keep(moved, "labels")
        labels = moved.select("id", "component")
        if moved.where("component <> was").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def merge_variations(entities: DataFrame, id_col: str, name_col: str, mentions: str, least: float = 0.85) -> DataFrame:
    """(victim, survivor) of names that are similar, directly or through others.

    Names of equal tokens, or else of equal lower case, form one class, which is
    compared once; classes are joined by connected components.
    """
    words = F.array_join(F.array_sort(tokens(F.col(name_col))), " ")
    rows = entities.where(F.col(id_col).isNotNull() & F.col(name_col).isNotNull())
    rows = rows.select(id_col, mentions, F.col(name_col).alias("__name"), F.coalesce(F.nullif(words, F.lit("")), F.concat(F.lit("="), F.lower(name_col))).alias("__class"))
    # spellings of one class may be contained in different names, so each is compared
    spelled = rows.groupBy("__class", F.lower("__name").alias("__name")).agg(F.min(id_col).alias("__id"))
    head = spelled.groupBy("__class").agg(F.min("__id").alias("__head"))
    edges = similar_pairs(spelled, "__id", "__name", least).select(F.col("id").alias("a"), F.col("other").alias("b"))
    edges = edges.union(spelled.join(head, "__class").where("__id <> __head").select(F.col("__id").alias("a"), F.col("__head").alias("b")))
    found = components(edges).select(F.col("id").alias("__head"), F.col("component").alias("__group"))
    grouped = rows.join(head, "__class").join(found, "__head", "left").withColumn("__group", F.coalesce("__group", "__head"))
    return merge_map(grouped, "__group", id_col, mentions)


def merge_map(groups: DataFrame, group: str, id_col: str, mentions: str) -> DataFrame:
    """(victim, survivor) within each group: most mentions survive, ties to the smaller id."""
    best = groups.groupBy(group).agg(F.max_by(F.col(id_col), F.struct(F.col(mentions), -F.col(id_col))).alias("survivor"))
    return groups.join(best, group).where(F.col(id_col) != F.col("survivor")).select(F.col(id_col).alias("victim"), "survivor")
