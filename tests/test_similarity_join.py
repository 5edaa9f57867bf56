"""Joins of names against brute force, and on names that share one common word."""

import random
import time

from civicspark.operators import records as R
from civicspark.operators import similarity_join as J
from civicspark.operators.resolve import similar_pairs
from pyspark.sql import functions as F


def names(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcn", k=rng.randrange(1, 6)))
    return sorted({" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(n)} | {"john", "john abc", "a", "ab", "Ünal abc", "", f"abc nab cab{seed % 2}", "cab1 abc x"})


def test_inside_equals_brute_force(spark):
    some, others = names(1, 120), names(2, 120)
    inner, outer = spark.createDataFrame([(x,) for x in some], "name string"), spark.createDataFrame([(x,) for x in others], "other string")
    for share in (0.25, 0.6):
        found = {tuple(r) for r in J.inside_pairs(inner, outer, share).collect()}
        assert found == {(a, b) for a in some for b in others if a and a in b and len(a) >= share * len(b) - 1e-9}


def test_alike_equals_brute_force(spark):
    rng = random.Random(3)
    sets = {tuple(sorted(rng.sample("abcdefghij", rng.randrange(0, 7)))) for _ in range(150)}
    rows = list(enumerate(map(list, sorted(sets))))
    table = spark.createDataFrame(rows, "id int, tokens array<string>")
    for least in (0.5, 0.66, 0.85, 1.0):
        found = {tuple(r) for r in J.alike_pairs(table, least).collect()}
        want = {(i, j) for i, x in rows for j, y in rows if i < j and x and y and len({*x} & {*y}) >= least * len({*x} | {*y}) - 1e-9}
        assert found == want


def match(name, known):
    if min(len(name), len(known)) < 3:
        return None
    a, b = ({w for w in n.split() if len(w) > 2} for n in (name, known))
    share = min(len(name), len(known)) / max(len(name), len(known))
    if name == known:
        return 0.95, "exact"
    if (name in known or known in name) and share >= 0.6:
        return round(0.7 * share, 6), "contained"
    return (round(0.6 * len(a & b) / len(a | b), 6), "partial") if len(a & b) >= 2 else None


def test_entities_equal_brute_force(spark):
    asked, known = names(4, 150), names(5, 150) + ["john abc"]
    found = R.match_entities(spark.createDataFrame([(x,) for x in [*asked, None]], "name string"), spark.createDataFrame(list(enumerate(known)), "id int, normalized_name string"))
    want = {(a, i, *match(a, b)) for a in asked for i, b in enumerate(known) if match(a, b)}
    assert {tuple(r) for r in found.collect()} == want and {m for *_, m in want} == {"exact", "contained", "partial"}


def test_people_equal_brute_force(spark):
    asked, known = names(6, 80), [n for n in names(7, 80) if n]
    want = {}
    for name in asked:
        equal = [i for i, k in enumerate(known) if k == name]
        best = min(((" " not in k, i) for i, k in enumerate(known) for w in name.split() if len(w) >= 3 and w in (k.split(" ")[0], k.split(" ")[-1])), default=None)
        near = None
        if best:
            a, b = {*name.split()}, {*known[best[1]].split()}
            near = best[1] if len(a) < 2 or len(b) < 2 or len(a & b) >= 2 else None
        want[name] = min(equal, default=near)
    asked = [n for n in asked if n == n.lower()]
    found = R.find_people(spark.createDataFrame([(x,) for x in asked], "name string"), spark.createDataFrame(list(enumerate(known)), "id int, normalized_name string"))
    assert {r["name"]: r.person_id for r in found.collect()} == {n: want[n] for n in asked}


def test_a_common_word_makes_no_pairs(spark):
    """3,000 names and entities that share a word and match nothing: seconds, not nine million pairs."""
    mine = spark.range(3_000).select(F.concat(F.lit("john a"), F.lpad(F.hex(F.xxhash64("id")), 16, "0")).alias("name"))
    theirs = spark.range(3_000).select("id", F.concat(F.lit("john b"), F.lpad(F.hex(F.xxhash64("id", F.lit(1))), 16, "0")).alias("normalized_name"))
    began = time.time()
    assert R.match_entities(mine, theirs).count() == 0
    assert R.find_people(mine, theirs).where("person_id is not null").count() == 0
    firms = spark.range(3_000).select("id", F.concat(F.lit("firm"), F.hex(F.xxhash64("id")), F.lit(" llc")).alias("name"))
    assert similar_pairs(firms, "id", "name").count() == 0
    assert time.time() - began < 90
