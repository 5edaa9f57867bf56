"""Mixing sources to target weights with soft membership, in DataFrame functions only.

A naive Bayes classifier of a labelled table gives every document a posterior
over domains, from its distinct words, hashed to a fixed number of places.  Non-negative
document rates are then fitted by projected gradient steps on the squared gap
between the domains' expected token totals and their targets; each step is one
aggregation over a compact table, scaled by the inverse of the totals' small
second-moment matrix, so a few steps are enough.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.llm.common import keep

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE_ROWS = 4_000
#: Places that words are hashed to.
PLACES = 4_096
#: Projected gradient steps, at most, and the relative gap at which they end.
STEPS, GAP = 20, 1e-8


def words_of(text: Column) -> Column:
    """Words of a text between spaces, newlines and tabs; none for a null text."""
    flat = text.cast("string")
    for mark in ("\n", "\t", "\r"):
        flat = F.replace(flat, F.lit(mark), F.lit(" "))
    return F.array_remove(F.split(F.coalesce(flat, F.lit("")), " "), "")


def places_of(words: Column, places: int) -> Column:
    """The distinct places of words, from 1 on."""
    return F.array_distinct(F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(places)) + 1).cast("int")))


@dataclass
class DomainModel:
    """Log weights of the domains for the places of a document's words."""

    domains: list[str]
    places: int
    base: list[float]
    weights: list[list[float]] = field(default_factory=list)  # by domain, then place

    def add_posterior(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``n_tokens`` and ``posterior``, an array in the order of ``domains``.

        Each step is a column of its own, so that no expression is computed twice.
        """
        rows = rows.withColumn("__words", words_of(F.col(text))).withColumn("n_tokens", F.size("__words").cast("long"))
        if not self.domains:
            return rows.withColumn("posterior", F.array().cast("array<double>")).drop("__words")
        rows = rows.withColumn("__places", places_of(F.col("__words"), self.places))

        def log_weight(d: int) -> Column:
            table = F.split(F.lit(",".join(map(repr, self.weights[d]))), ",").cast("array<double>")  # one literal, once the plan is optimised
            return F.aggregate("__places", F.lit(self.base[d]), lambda total, k: total + F.element_at(table, k))

        logs = [f"__log{d}" for d in range(len(self.domains))]
        rows = rows.withColumns({name: log_weight(d) for d, name in enumerate(logs)})
        rows = rows.withColumn("__top", F.greatest(*logs) if len(logs) > 1 else F.col(logs[0]))
        rows = rows.withColumns({name: F.exp(F.col(name) - F.col("__top")) for name in logs})
        rows = rows.withColumn("__sum", sum((F.col(name) for name in logs[1:]), F.col(logs[0])))
        rows = rows.withColumn("posterior", F.array(*[F.col(name) / F.col("__sum") for name in logs]))
        return rows.drop("__words", "__places", "__top", "__sum", *logs)


def fit_domains(
    docs: DataFrame, labelled: DataFrame, text: str = "text", id_col: str = "doc_id", domain: str = "domain",
    sample_rows: int = SAMPLE_ROWS, places: int = PLACES,
) -> DomainModel:
    """A naive Bayes model from at most ``sample_rows`` labelled rows, chosen by a hash of their id.

    A place counts once for each document that has words there, with a half added.
    Null ids and domains are left out; without any labelled row there is no domain.
    """
    usable = labelled.where(F.col(id_col).isNotNull() & F.col(domain).isNotNull()).select(F.col(id_col).alias("__id"), F.col(domain).cast("string").alias("__domain"))
    total = usable.count()
    if total > sample_rows:
        usable = usable.where(F.pmod(F.xxhash64("__id"), F.lit(total)) < sample_rows)
    chosen = F.broadcast(usable.distinct().limit(sample_rows))  # of bounded size
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text")).join(chosen, "__id")
    found = keep(rows.select("__domain", places_of(words_of(F.col("__text")), places).alias("places")), "labelled")
    sizes = {r["__domain"]: r["n"] for r in found.groupBy("__domain").agg(F.count("*").alias("n")).orderBy("__domain").collect()}
    domains, n = sorted(sizes), sum(sizes.values())
    if not domains:
        return DomainModel([], places, [])
    counts = found.select("__domain", F.explode("places").alias("place")).groupBy("place").agg(
        *[F.count_if(F.col("__domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    ).collect()  # as many rows as places at most
    model = DomainModel(domains, places, [])
    for k, d in enumerate(domains):
        row = [0.5] * places
        for r in counts:
            row[r["place"] - 1] += r[f"n{k}"]
        whole = math.log(sum(row))
        model.base.append(math.log(sizes[d] / n))
        model.weights.append([round(math.log(x) - whole, 4) for x in row])  # short, as plans carry them as text
    return model


def _solve(matrix: list[list[float]], vector: list[float]) -> list[float]:
    """Gaussian elimination with pivoting, for as many unknowns as there are domains."""
    n = len(vector)
    rows = [list(matrix[i]) + [vector[i]] for i in range(n)]
    for c in range(n):
        p = max(range(c, n), key=lambda r: abs(rows[r][c]))
        rows[c], rows[p] = rows[p], rows[c]
        for r in range(n):
            if r != c and rows[c][c]:
                f = rows[r][c] / rows[c][c]
                rows[r] = [x - f * y for x, y in zip(rows[r], rows[c])]
    return [rows[i][n] / rows[i][i] if rows[i][i] else 0.0 for i in range(n)]


def rate_after(mass: Column, steps: list[list[float]]) -> Column:
    """A document's rate: from 1, one projected step after the other; ``mass`` is its tokens by domain."""
    if not steps:
        return F.lit(1.0)
    table = F.array(*[F.lit(s) for s in steps])
    return F.aggregate(table, F.lit(1.0), lambda rate, step: F.greatest(F.lit(0.0), rate - _dot(mass, step)))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def fit_rates(compact: DataFrame, targets: list[float], steps: int = STEPS) -> tuple[list[list[float]], float]:
    """Steps of scaled projected gradient descent, and the gap they leave relative to the targets' norm.

    ``compact`` has ``mass``, the targets are token totals.  A step is halved
    when it does not narrow the gap; the descent ends at a gap of GAP, after
    ``steps`` steps, or where a step of a thousandth does not narrow it.
    """
    d = len(targets)
    scale = max(1e-300, math.sqrt(sum(t * t for t in targets)))
    taken: list[list[float]] = []

    def totals(path):
        rate = rate_after(F.col("mass"), path)
        rows = compact.select("mass", rate.alias("rate"))
        sums = [F.sum(F.col("rate") * F.col("mass")[k]).alias(f"e{k}") for k in range(d)]
        moments = [F.sum(F.when(F.col("rate") > 0, F.col("mass")[i] * F.col("mass")[j]).otherwise(0.0)).alias(f"h{i}_{j}") for i in range(d) for j in range(i, d)]
        row = rows.agg(*sums, *moments).first()
        gap = [(row[f"e{k}"] or 0.0) - targets[k] for k in range(d)]
        h = [[(row[f"h{min(i, j)}_{max(i, j)}"] or 0.0) for j in range(d)] for i in range(d)]
        return gap, h, math.sqrt(sum(g * g for g in gap))

    gap, h, norm = totals(taken)
    share = 1.0
    for _ in range(steps):
        if norm <= GAP * scale:
            break
        ridge = 1e-9 * max(1e-300, sum(h[i][i] for i in range(d)))
        step = _solve([[h[i][j] + (ridge if i == j else 0.0) for j in range(d)] for i in range(d)], gap)
        trial = [*taken, [share * s for s in step]]
        new = totals(trial)
        if new[2] < norm:
            taken, (gap, h, norm), share = trial, new, min(1.0, 2 * share)
        else:
            share /= 2
            if share < 1e-3:
                break
    return taken, norm / scale


@dataclass
class Mixture:
    """A fitted mixture: the classifier, the steps of the rates, the compact table they came from, and the
    relative gap that is left between the domains' expected tokens and their targets.
    """

    model: DomainModel
    steps: list[list[float]]
    compact: DataFrame
    scale: float
    gap: float

    def rated(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """``docs`` with ``n_tokens``, ``posterior`` and ``rate``; columns of these names are replaced."""
        return self._rate(self.model.add_posterior(docs.drop("n_tokens", "posterior", "rate"), text))

    def table(self) -> DataFrame:
        """The id, ``n_tokens``, ``posterior`` and ``rate`` of every document, without its text."""
        return self._rate(self.compact)

    def _rate(self, rows: DataFrame) -> DataFrame:
        tokens = F.col("n_tokens") / F.lit(self.scale)
        if not self.steps:
            return rows.withColumn("rate", F.lit(1.0))
        rows = rows.withColumn("__mass", F.transform("posterior", lambda p: p * tokens))
        return rows.withColumn("rate", F.round(rate_after(F.col("__mass"), self.steps), 9)).drop("__mass")


def mix_to_targets(
    docs: DataFrame, labelled: DataFrame, targets: dict[str, float], text: str = "text", id_col: str = "doc_id", domain: str = "domain",
    token_budget: float | None = None,
) -> Mixture:
    """Fit rates so that the domains' expected tokens are the target shares of ``token_budget``.

    The budget is the tokens there are, unless given.  Domains of the labelled
    table without a target get none; targets of unknown domains are left out and
    the others scaled up.  A document's rate is never negative, and where no
    rates meet the targets they are the nearest in least squares.  Null and empty
    texts have no tokens, a prior's posterior and rate 1; repeated rows and null
    ids are documents of their own.  An empty table gives an empty mixture.
    """
    model = fit_domains(docs, labelled, text, id_col, domain)
    rows = model.add_posterior(docs.select(id_col, text), text).select(id_col, "n_tokens", "posterior")
    compact = keep(rows, "posteriors")
    total = float(compact.agg(F.sum("n_tokens")).first()[0] or 0)
    known = sum(max(0.0, targets.get(d, 0.0)) for d in model.domains)
    if not total or not known:
        return Mixture(model, [], compact, 1.0, 0.0)
    scale = total / max(1, compact.count())
    budget = (token_budget or total) / scale
    goal = [budget * max(0.0, targets.get(d, 0.0)) / known for d in model.domains]
    tokens = F.col("n_tokens") / F.lit(scale)
    mass = compact.select(F.transform("posterior", lambda p: p * tokens).alias("mass"))
    steps, gap = fit_rates(mass, goal)
    return Mixture(model, steps, compact, scale, gap)
