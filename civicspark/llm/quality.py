"""Quality classifier by Bradley-Terry pairwise ranking.

A document's features are shares taken from its whole text: of characters by
class, of words by shape, and of repeated words, lines and word triples.  From
pairs of a good and a bad document the weights are learned by logistic loss on
the difference of their features, so a document's score is its strength in the
Bradley-Terry model.  The threshold is a quantile of the scores of the labelled
rows: the share of those that are labelled bad.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civicspark.llm import wordhash as wh
from civicspark.llm.common import give_back, with_schema

#: Labelled rows that a model is fitted on, at most.
SAMPLE_ROWS = 20_000
#: Preference pairs drawn from them.
PAIRS = 120_000
#: Pairs whose differences are held at once.
PAIR_BLOCK = 10_000
#: Score at the quantile threshold.
CUT_SCORE = 0.3
_CLASSES = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!?", "|", "#$%&*@^~+=_`", ".,;:", "'\"()-", "<>{}[]\\/", " \t\r\x0b\x0c", "\n"]
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)  # the last class: bytes beyond ASCII, and others
for _k, _chars in enumerate(_CLASSES):
    _CLASS_OF[[ord(c) for c in _chars]] = _k


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1), np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct_share(h: np.ndarray, doc: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Share of distinct values of each document, and of its most frequent one."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(h)])
    n = np.maximum(1, np.bincount(doc, minlength=docs))
    most = np.zeros(docs)
    np.maximum.at(most, doc[start], size)
    return np.bincount(doc[start], minlength=docs) / n, most / n


def text_features(column: pa.Array) -> np.ndarray:
    """A row of features for each text; an empty or null text has zeros."""
    words = wh.split_words(column)
    raw, at = wh.text_bytes(column)
    docs, doc = len(at) - 1, words.doc
    kinds = _CLASS_OF[raw]
    chars = np.maximum(1, np.diff(at))
    shares = [_sums(kinds == k, at) / chars for k in range(len(_CLASSES) + 1)]
    count = np.maximum(1, np.diff(words.first))
    size = (words.end - words.start).astype(np.float64)
    per_byte = np.concatenate([np.zeros((1, 3)), np.cumsum(np.stack([kinds == 0, kinds == 1, (kinds == 3) | (kinds == 5)], 1), axis=0, dtype=np.float64)])
    upper, lower, marks = (per_byte[words.end] - per_byte[words.start]).T if len(size) else np.zeros((3, 0))
    again = np.zeros(len(size), bool)
    again[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    per_word = [(upper >= 2) & (lower == 0), (upper + lower == 0) & (marks + 1 >= size), marks >= 2, again, size > 20, size <= 2]
    shares += [_sums(x, words.first) / count for x in per_word]
    mean = _sums(size, words.first) / count
    shares += [np.minimum(mean, 40) / 40, np.sqrt(np.maximum(0, _sums(size * size, words.first) / count - mean**2)).clip(0, 40) / 40]
    distinct, most = _distinct_share(words.hash, doc, docs)
    triple, full = wh.windows(words, 3)
    distinct3, _ = _distinct_share(triple[full], doc[full], docs)
    lines = wh.split_words(column, marks=b"\n")
    line_distinct, _ = _distinct_share(lines.hash, lines.doc, docs)
    some = (np.diff(words.first) > 0).astype(np.float64)
    shares += [some - distinct, most, np.where(np.diff(words.first) >= 3, 1 - distinct3, 0), some - line_distinct]
    x = np.stack(shares, 1)
    return np.concatenate([x, np.sqrt(np.maximum(0, x)), np.minimum(1, 10 * x)], 1)


@dataclass
class QualityModel:
    """Weights of the standardised features and the score at the quantile threshold."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry strength less the threshold."""
        return ((x - self.center) / self.scale).clip(-8, 8) @ self.weights - self.threshold

    def score(self, x: np.ndarray) -> np.ndarray:
        """Strength on a scale from 0 to 1 with CUT_SCORE at the threshold."""
        z = self.strength(x).clip(-500, 500) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-z))


def fit_pairs(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, seed: int = 7) -> QualityModel:
    """Newton steps on the logistic loss of preference pairs, then the quantile of the bad rows' share.

    Without rows of both labels there is no pair: all scores are equal, and lie
    above the threshold unless every row is bad.
    """
    center, scale = (x.mean(0), np.maximum(x.std(0), 1e-3)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = ((x - center) / scale).clip(-8, 8)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return QualityModel(center, scale, w, 1.0 if len(bad) else -1.0)
    rng = np.random.default_rng(seed)
    first, second = good[rng.integers(0, len(good), PAIRS)], bad[rng.integers(0, len(bad), PAIRS)]
    for _ in range(25):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for k in range(0, PAIRS, PAIR_BLOCK):
            d = z[first[k : k + PAIR_BLOCK]] - z[second[k : k + PAIR_BLOCK]]
            p = 1 / (1 + np.exp(-(d @ w).clip(-500, 500)))
            gradient += d.T @ (p - 1) / PAIRS
            hessian += (d * (p * (1 - p))[:, None]).T @ d / PAIRS
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    scores = np.sort(z @ w)
    k = min(len(scores) - 1, max(1, len(bad)))
    return QualityModel(center, scale, w, float((scores[k - 1] + scores[k]) / 2))


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> QualityModel:
    """A model from at most ``sample_rows`` labelled rows, chosen by a hash of their id.

    Rows of a null id or a label other than 0 and 1 are left out.
    """
    usable = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("__id"), F.col(label).cast("int").alias("__y"))
    total = usable.count()
    if total > sample_rows:
        usable = usable.where(F.pmod(F.xxhash64("__id"), F.lit(total)) < sample_rows)
    chosen = F.broadcast(usable.limit(sample_rows))  # of bounded size
    rows = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).cast("string").alias("__text")).join(chosen, "__id").select("__y", "__text")

    def features(batches):
        for batch in batches:
            for part in wh.chunks(batch, "__text"):
                yield {"y": part.column(0), "x": [r.tobytes() for r in text_features(part.column(1))]}

    schema = pa.schema([("y", pa.int32()), ("x", pa.binary())])
    found = rows.mapInArrow(with_schema(features, schema), "y int, x binary").limit(2 * sample_rows).collect()
    width = text_features(pa.array([""])).shape[1]
    x = np.array([np.frombuffer(r.x) for r in found]).reshape(len(found), width)
    order = np.lexsort(x.T[:4]) if len(found) else np.zeros(0, int)  # the same whatever order rows come in
    return fit_pairs(x[order], np.array([r.y for r in found], int)[order])


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``; a column of that name is replaced.

    Every row gets a score, also a null or empty text.
    """
    names = [c for c in docs.columns if c != score]
    rows = docs.select(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            whole = pa.RecordBatch.from_arrays([column.cast(pa.string())], [text])
            found = [shared.value.score(text_features(p.column(0))) for p in wh.chunks(whole, text)]
            scores = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], [*batch.schema.names, score])
        give_back()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{schema}, `{score}` double")
