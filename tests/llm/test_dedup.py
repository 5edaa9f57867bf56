"""N-gram join, substring dedup and line dedup against brute force, with awkward rows."""

import hashlib
import random
import re

import pytest

from civicspark.llm import line_dedup as ld
from civicspark.llm import ngram_join as nj
from civicspark.llm import substring_dedup as sd

WORDS = r"[^\x20\x09-\x0D]+"


def corpus(seed=3, n=60):
    """Documents with copies, near copies, a shared passage and awkward texts, and clashing columns."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["Ünï", "ÉCOLE", "日本"]
    passage = " ".join(rng.choice(vocabulary) for _ in range(30))
    texts = []
    for _ in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(words))
        if rng.random() < 0.4:
            words[rng.randrange(len(words))] = "edited"
            texts.append("\t ".join(words).upper())
        if rng.random() < 0.3:
            texts.append(f"{texts[-1][:60]} {passage}\n{passage}")
    texts += [None, "", "   ", "one", "one two", "ONE two", "a b c d", "a b c d e", texts[0], texts[0], "x " * 500, "x " * 500 + "y", passage * 3]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(k, texts[i], "junk", k % 3) for k, i in enumerate(order)]
    return rows + [(None, texts[0], "null id", 1), rows[5]]


COLUMNS = "doc_id long, text string, shingle string, component int"


def shingles(text):
    words = re.findall(WORDS, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def components(rows):
    sets = {k: shingles(t) for k, t, *_ in rows if k is not None}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


@pytest.mark.parametrize(("small_group", "block_sets", "asked_ends"), [(48, 256, 100_000), (0, 5, 100_000), (1000, 5, 0)])
def test_join_equals_brute_force(spark, monkeypatch, small_group, block_sets, asked_ends):
    monkeypatch.setattr(nj, "SMALL_GROUP", small_group)
    monkeypatch.setattr(nj, "BLOCK_SETS", block_sets)
    monkeypatch.setattr(nj, "ASKED_ENDS", asked_ends)
    rows = corpus()
    found = nj.ngram_jaccard_join(spark.createDataFrame(rows, COLUMNS)).collect()
    assert len(found) == len(rows)
    want = components(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def open_rows(rng, sets=70, tokens=60):
    """Rows of open postings of random sets, and the pairs across components that reach what they need."""
    held = {a: (rng.randint(30, 45), rng.choice([1, 2, 4]), a % 9, set(rng.sample(range(tokens), rng.randint(1, 14)))) for a in range(sets)}
    lead = {t: rng.randrange(9) for t in range(tokens)}
    rows = [(a, t, n, k, c, lead[t], 1) for a, (n, k, c, own) in held.items() for t in own]
    want = {}
    for a, (na, ka, ca, x) in held.items():
        for b, (nb, kb, cb, y) in held.items():
            need = max(min(ka, kb), -(-3 * (na + nb) // 7) - max(0, -(-3 * na // 4) - ka, -(-3 * nb // 4) - kb))
            if a < b and ca != cb and 4 * min(na, nb) >= 3 * max(na, nb) and len(x & y) >= need:
                want[a, b] = len(x & y)
    return rows, want


@pytest.mark.parametrize(("small_group", "block_sets", "group_rows"), [(48, 256, 500_000), (48, 256, 5), (0, 256, 5), (0, 7, 5), (1000, 7, 20)])
def test_open_pairs_equal_brute_force(spark, monkeypatch, small_group, block_sets, group_rows):
    for name, value in (("SMALL_GROUP", small_group), ("BLOCK_SETS", block_sets), ("GROUP_ROWS", group_rows)):
        monkeypatch.setattr(nj, name, value)
    rows, want = open_rows(random.Random(block_sets))
    found = nj._open_pairs(spark.createDataFrame(rows, "a long, shingle long, n long, k long, component long, lead long, low long"), 3, 4)
    shared = {}
    for r in found.collect():
        shared[r.a, r.b] = shared.get((r.a, r.b), 0) + r.shared
        assert r.a < r.b
    assert want.items() <= shared.items()


def test_join_of_a_large_group_of_near_copies(spark):
    rng = random.Random(1)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for k in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        rows.append((k, " ".join(words), "", 0))
    found = {r.doc_id: r.component_id for r in nj.ngram_jaccard_join(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert found == {k: c for k, (_, c) in components(rows).items()}


def test_join_of_an_id_with_two_texts(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    rows = [(7, one), (7, two), (3, f"{two} more"), (9, f"{one} more")]
    found = {(r.doc_id, r.n_shingles): r.component_id for r in nj.ngram_jaccard_join(spark.createDataFrame(rows[:1] + rows[2:], "doc_id long, text string")).collect()}
    assert found == {(7, 36): 7, (3, 37): 3, (9, 37): 7}
    found = nj.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(3, 3), (7, 3), (7, 7), (9, 7)]


def test_join_of_nothing(spark):
    assert nj.ngram_jaccard_join(spark.createDataFrame([], COLUMNS)).count() == 0
    kept = nj.keep_one_per_component(spark.createDataFrame([(2, "a b", "", 0), (1, "A b", "", 0), (3, None, "", 0)], COLUMNS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def substring_reference(rows, width=13):
    first = {}
    for k, t, *_ in rows:
        words = re.findall(WORDS, t or "")
        for i in range(len(words) - width + 1) if k is not None else ():
            w = tuple(words[i : i + width])
            first[w] = min(first.get(w, k), k)
    out = []
    for k, t, *_ in rows:
        words = re.findall(WORDS, t or "")
        gone = set()
        for i in range(len(words) - width + 1) if k is not None else ():
            if first[tuple(words[i : i + width])] < k:
                gone.update(range(i, i + width))
        out.append((k, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def test_substring_dedup_equals_brute_force(spark):
    rows = corpus(5)
    found = sd.substring_dedup(spark.createDataFrame(rows, COLUMNS)).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in found), key=str) == substring_reference(rows)
    for r in found:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_substring_dedup_of_nothing(spark):
    assert sd.substring_dedup(spark.createDataFrame([], COLUMNS)).count() == 0
    with pytest.raises(ValueError):
        sd.substring_dedup(spark.createDataFrame([], COLUMNS), width=12, block=7)


def line_reference(rows, least=40, docs=5):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for k, t, *_ in rows:
        for line in (t or "").split("\n") if k is not None else ():
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(k)
    out = []
    for k, t, *_ in rows:
        lines = (t or "").split("\n")
        rest = [x for x in lines if k is None or len(holders.get(key(x), ())) < docs or max(holders[key(x)]) == k]
        out.append((k, len(lines), len(lines) - len(rest), "\n".join(rest)))
    return sorted(out, key=str)


def line_corpus():
    rng = random.Random(2)
    lines = ["shared line of more than forty characters, number one", "É" * 39, "É" * 40, "short", "  Another SHARED line of more than forty characters \r", ""]
    rows = [(k, "\n".join(rng.choice(lines) if rng.random() < 0.5 else f"own line {k} {i}" for i in range(rng.randint(1, 8))), "c", k) for k in range(40)]
    return rows + [(99, None, "c", 0), (98, "", "c", 0), (None, "\n".join(lines), "c", 0), rows[3], (97, lines[0] + "\n" + "z" * 50_000, "c", 0)]


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_line_dedup_equals_brute_force(spark, broadcast_rows):
    rows = line_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, n_lines long")
    found = ld.line_dedup(docs, broadcast_rows=broadcast_rows).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found), key=str) == line_reference(rows)
    assert {r.text for r in found if r.doc_id == 99} == {None}


def test_line_dedup_of_full_filters_stays_exact(spark, monkeypatch):
    monkeypatch.setattr(ld, "LEAST_BITS", 9)
    monkeypatch.setattr(ld, "MOST_BITS", 9)
    rows = line_corpus()
    found = ld.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, a string, b long")).collect()
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in found), key=str) == line_reference(rows)


def test_line_dedup_of_nothing(spark):
    assert ld.line_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_hashes_tell_windows_apart():
    import numpy as np
    import pyarrow as pa

    from civicspark.llm import wordhash as wh

    words = wh.split_words(pa.array(["ab c", None, "", "a bc", "  AB\tc "]), lower=True)
    assert np.diff(words.first).tolist() == [2, 0, 0, 2, 2]
    assert words.hash[0] == words.hash[4] and words.hash[0] != words.hash[2]
    assert wh.join_words(words, np.array([True, False, True, True, False, True])).to_pylist() == ["ab", "", "", "a bc", "c"]
    assert hashlib.sha256(b"").hexdigest()[:4] == "e3b0"
