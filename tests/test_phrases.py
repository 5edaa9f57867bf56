"""Known phrases by one automaton, against a plain search."""

import random
import re

from civicspark.operators import phrases as P


def brute(text, phrases):
    found = []
    for phrase in {p.strip().lower() for p in phrases if p and p.strip()}:
        for m in re.finditer(f"(?={re.escape(phrase)})", P.folded(text)):
            a, b = m.start(), m.start() + len(phrase)
            word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
            if not (word(a - 1) and word(a)) and not (word(b) and word(b - 1)):
                found.append((a, b))
    return sorted(x for x in set(found) if not any(y != x and y[0] <= x[0] and x[1] <= y[1] for y in found))


def test_hits_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["ab", "Ab_c", "abc", "é", "bc", "x-y", "c"]
    phrases = sorted({" ".join(rng.choices(words, k=rng.randrange(1, 4))) for _ in range(60)})
    texts = ["".join(rng.choices([*words, " ", " ", ", ", "İ"], k=rng.randrange(60))) for _ in range(150)]
    docs = spark.createDataFrame([*enumerate(texts), (999, None), (998, "")], "doc int, text string")
    table = spark.createDataFrame([(p,) for p in [*phrases, None, "", "  ", phrases[0].upper()]], "phrase string")
    found = P.phrase_hits(docs, "doc", "text", table, "phrase").collect()
    got = {}
    for r in found:
        got.setdefault(r.doc, []).append((r.start, r.end))
        assert r.phrase == P.folded(texts[r.doc][r.start : r.end])
    assert {d: sorted(v) for d, v in got.items()} == {d: b for d, t in enumerate(texts) if (b := brute(t, phrases))}


def test_blocks_of_phrases(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc int, text string")
    table = spark.createDataFrame([(p,) for p in ("one", "two", "three", "five")], "phrase string")
    assert {tuple(r) for r in P.phrase_hits(docs, "doc", "text", table, "phrase", block_chars=4).collect()} == {(1, "one", 0, 3), (1, "two", 4, 7), (1, "three", 8, 13)}
    assert P.phrase_hits(docs, "doc", "text", table.limit(0), "phrase").count() == 0
