"""License scan: lines and passages against license templates by the Dice coefficient of word bigrams.

A line and a template are sets of pairs of consecutive words.  A Dice value of
``t`` or more needs sizes within ``t / (2 - t)`` and ``(2 - t) / t`` of each other,
so templates outside these bounds are never compared, and of the others only
those that share a bigram.

A passage is a run of a document's words, across its lines or inside one: full
texts, wrapped notices, and notices within longer lines.  Its ends are shared
bigrams and it has at most ``(2 - t) / t`` times a template's bigrams.
"""

from __future__ import annotations

import pkgutil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm import wordhash as wh
from civicspark.llm.common import with_schema

#: White space and ASCII punctuation end a word.
MARKS = bytes(x for x in range(128) if not chr(x).isalnum() and chr(x) != "_")
#: Templates that a scan may hold; a longer list takes several scans.
MOST_TEMPLATES = 20_000
# Usual one-line notices, by SPDX identifier where there is one.
NOTICES = [
    ("all-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

#: Full texts in ``license_texts``, by the same identifiers.
TEXTS = ("Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0")
#: Shared bigrams that are laid out at once.
_ENTRIES = 4_000_000


def notices(spark: SparkSession) -> DataFrame:
    """The built-in templates: ``license_id``, ``text``."""
    return spark.createDataFrame(NOTICES, "license_id string, text string")


def full_texts(spark: SparkSession) -> DataFrame:
    """The built-in licence texts: ``license_id``, ``text``."""
    return spark.createDataFrame([(x, pkgutil.get_data(__package__, f"license_texts/{x}.txt").decode()) for x in TEXTS], "license_id string, text string")


def _line_bigrams(column: pa.Array, words: wh.Words):
    """(line of each distinct bigram, bigram hash, bigrams of each line, document and number of each line, line of each word)."""
    raw, at = wh.text_bytes(column)
    ends = np.flatnonzero(raw == 10)
    # lines are numbered through the slice: one for each document, one more for each newline
    word_line = line = np.searchsorted(ends, words.start) + words.doc
    first_line = np.searchsorted(ends, at[:-1]) + np.arange(len(at) - 1)
    total = len(ends) + len(at) - 1
    h, full = wh.windows(words, 2)
    if len(h):
        full[:-1] &= line[1:] == line[:-1]
        full[-1] = False
    h, line = h[full], line[full]
    order = np.lexsort((h, line))
    h, line = h[order], line[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (line[1:] != line[:-1])] if len(h) else np.zeros(0, bool)
    h, line = h[fresh], line[fresh]
    doc_of_line = np.repeat(np.arange(len(at) - 1), np.diff(np.r_[first_line, total]))
    return line, h, np.bincount(line, minlength=total), doc_of_line, np.arange(total) - first_line[doc_of_line], word_line


def _passages(words: wh.Words, known: np.ndarray, owner: np.ndarray, size: np.ndarray, length: np.ndarray, least: float):
    """For each template and start the best passage of at least ``least``: (first word, last word, shared bigrams, Dice, template)."""
    grams, full = wh.windows(words, 2)
    at = np.flatnonzero(full)
    low = np.searchsorted(known, grams[at], "left")
    reps = np.searchsorted(known, grams[at], "right") - low
    at, low, reps = at[reps > 0], low[reps > 0], reps[reps > 0]
    need = np.ceil(size * least / (2 - least) - 1e-9).astype(np.int64)
    most = np.floor(length * (2 - least) / least + 1e-9).astype(np.int64)
    before = {}  # for each bigram of a document the place of its last occurrence, or -1
    out = []
    doc = words.doc[at]
    held, i = np.cumsum(reps), 0
    while i < len(at):
        # whole documents
        j = max(int(np.searchsorted(held, held[i] - reps[i] + _ENTRIES, "right")), i + 1)
        j = int(np.searchsorted(doc, doc[j], "left")) if j < len(at) else j
        j = j if j > i else int(np.searchsorted(doc, doc[i], "right"))
        n = reps[i:j]
        entry = np.repeat(low[i:j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place, which = np.repeat(at[i:j], n), owner[entry]
        pair = np.repeat(doc[i:j], n) * len(size) + which
        order = np.argsort(pair, kind="stable")
        pair, place = pair[order], place[order]
        edges = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            d, k = divmod(int(pair[a]), len(size))
            p = place[a:b]
            stop = np.searchsorted(p, p + most[k])
            starts = np.flatnonzero(stop - np.arange(len(p)) >= max(need[k], 1))
            if not len(starts) or len(np.unique(grams[p])) < need[k]:
                continue
            first = int(words.first[d])
            if d not in before:
                g = grams[first : words.first[d + 1]]
                sort = np.argsort(g, kind="stable")
                last = np.full(len(g), -1)
                same = np.flatnonzero(g[sort][1:] == g[sort][:-1])
                last[sort[same + 1]] = sort[same] + first
                before = {d: last} if len(before) > 64 else before | {d: last}
            last = before[d]
            for s in starts.tolist():
                q, begin = p[s : stop[s]], int(p[s])
                both = np.cumsum(last[q - first] < begin)
                if both[-1] < need[k]:
                    continue
                every = np.cumsum(last[begin - first : q[-1] + 1 - first] < begin)[q - begin]
                dice = 2.0 * both / (every + size[k])
                best = int(dice.argmax())
                if dice[best] >= least:
                    out.append((begin, int(q[best]) + 1, int(both[best]), float(dice[best]), k))
        i = j
    return out


def license_scan(
    docs: DataFrame, templates: DataFrame | None = None, text: str = "text", id_col: str = "doc_id", least_dice: float = 0.8, passages: bool = False,
) -> DataFrame:
    """Lines of documents that match a license template: ``id_col``, ``line_no``, ``license_id``, ``dice``, ``line``.

    Each line gives its best template of at least ``least_dice``, ties to the
    smaller identifier.  Words are runs of characters other than ASCII white space
    and punctuation, with A-Z folded; a line or template of fewer than two words
    matches nothing, so null and empty texts give no row.  Repeated rows give
    their lines each time; a null id is passed on.  Other columns are not read.

    With ``passages`` templates are also sought across and inside lines, and full
    texts are built in beside the notices.  ``line`` is then the passage and
    ``line_no`` the line of its first word.  Of rows that overlap the one of most
    shared bigrams times Dice is kept; inside a matching line nothing is sought.
    """
    spark = docs.sparkSession
    built_in = notices(spark).union(full_texts(spark)) if passages else notices(spark)
    found = (templates if templates is not None else built_in).where("license_id is not null and text is not null")
    rows = sorted(found.select("license_id", "text").distinct().limit(MOST_TEMPLATES + 1).collect())
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates: scan them in parts")
    flat = pa.array([" ".join(r.text.split("\n")) for r in rows], pa.string())
    words = wh.split_words(flat, lower=True, marks=MARKS)
    owner, h, size, _, _, _ = _line_bigrams(flat, words)
    order = np.argsort(h, kind="stable")
    shared = spark.sparkContext.broadcast((h[order], owner[order], size, np.maximum(np.diff(words.first) - 1, 0), [r.license_id for r in rows]))

    def lines(line, h, n):
        """Each matching line's best template: (line, template, Dice)."""
        known, owner, size, _, names = shared.value
        low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        some = np.flatnonzero(high > low)
        reps = (high - low)[some]
        entry = np.repeat(low[some], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        at, which = np.repeat(line[some], reps), owner[entry]
        fits = (n[at] * (2 - least_dice) >= least_dice * size[which]) & (n[at] * least_dice <= (2 - least_dice) * size[which])
        pair, both = np.unique(at[fits] * len(names) + which[fits], return_counts=True)
        at, which = pair // len(names), pair % len(names)
        dice = 2.0 * both / (n[at] + size[which])
        good = dice >= least_dice
        at, which, dice = at[good], which[good], dice[good]
        order = np.lexsort((which, -dice, at))
        best = order[np.r_[True, at[order][1:] != at[order][:-1]]] if len(order) else order
        return at[best], which[best], dice[best]

    def scan(batches):
        known, owner, size, length, names = shared.value
        for batch in batches:
            for part in wh.chunks(batch, text):
                column = part.column(1)
                words = wh.split_words(column, lower=True, marks=MARKS)
                line, h, n, doc, number, word_line = _line_bigrams(column, words)
                if not len(known) or not (passages or len(h)):
                    continue
                at, which, dice = lines(line, h, n)
                extra = []
                if passages:
                    first, last = np.searchsorted(word_line, at, "left"), np.searchsorted(word_line, at, "right") - 1
                    both = dice * (n[at] + size[which]) / 2
                    ranked = [(-b * d, 0, x, y, d, k, i) for i, (b, d, x, y, k) in enumerate(zip(both.tolist(), dice.tolist(), first.tolist(), last.tolist(), which.tolist()))]
                    in_line = np.full(len(words.start), -1)
                    for i, (x, y) in enumerate(zip(first.tolist(), last.tolist())):
                        in_line[x : y + 1] = i
                    found = _passages(words, known, owner, size, length, least_dice)
                    ranked += [(-b * d, 1, x, y, d, k, -1) for x, y, b, d, k in found if in_line[x] < 0 or in_line[x] != in_line[y]]
                    taken, kept = np.zeros(len(words.start), bool), []
                    for _, _, x, y, d, k, i in sorted(ranked):
                        if not taken[x : y + 1].any():
                            taken[x : y + 1] = True
                            if i < 0:
                                extra.append((int(word_line[x]), x, y, d, k))
                            else:
                                kept.append(i)
                    kept = np.sort(np.array(kept, np.int64))
                    at, which, dice = at[kept], which[kept], dice[kept]
                texts = {d: column[d].as_py().split("\n") for d in np.unique(doc[at]).tolist()}
                shown = [texts[int(doc[k])][int(number[k])] for k in at]
                if extra:
                    at, which = np.r_[at, [e[0] for e in extra]], np.r_[which, [e[4] for e in extra]]
                    dice = np.r_[dice, [e[3] for e in extra]]
                    shown += [words.data[words.start[x] : words.end[y]].tobytes().decode() for _, x, y, _, _ in extra]
                yield {
                    "id": part.column(0).take(pa.array(doc[at])), "line_no": number[at], "license_id": [names[k] for k in which],
                    "dice": dice, "line": shown,
                }

    schema = pa.schema([("id", pa.int64()), ("line_no", pa.int64()), ("license_id", pa.string()), ("dice", pa.float64()), ("line", pa.string())])
    base = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text).cast("string").alias(text))
    return base.mapInArrow(with_schema(scan, schema), "id long, line_no long, license_id string, dice double, line string").withColumnRenamed("id", id_col)
