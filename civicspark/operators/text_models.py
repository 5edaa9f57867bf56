"""Classifiers of texts: hashed words and letters, shapes, weighted logistic models, and a stack of them.

All of it is Spark ML on whole tables: features are computed where the rows are,
and a fit aggregates gradients over all labelled rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from civicspark.sources.shared import keep

#: Places that words, and groups of letters, are hashed to.
PLACES = 4_096
VIEWS = ("words", "letters", "shape")


def split(text: Column) -> Column:
    """The words of a text in lower case."""
    return F.filter(F.split(F.lower(text), r"(?U)[^\w]+"), lambda w: w != "")


def words(text: Column, each: Column | None = None) -> Column:
    """Words and pairs of neighbouring words in lower case; each: the words of ``text``, where they are known."""
    each = split(text) if each is None else each
    after = F.slice(each, 2, F.size(each))
    pairs = F.filter(F.zip_with(each, after, lambda a, b: F.concat_ws(" ", a, b)), lambda p: p.contains(" "))
    return F.concat(each, pairs)


def letters(text: Column, n: int = 3, each: Column | None = None) -> Column:
    """Groups of ``n`` neighbouring letters of the distinct words, each word between blanks; each: the words of ``text``, where they are known."""
    each = F.array_distinct(split(text) if each is None else each)
    cut = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + (3 - n)), lambda k: F.substring(F.concat(F.lit(" "), w, F.lit(" ")), k, F.lit(n)))
    return F.flatten(F.transform(F.filter(each, lambda w: F.length(w) >= n - 2), cut))


def shape(text: Column) -> list[Column]:
    """Numbers that describe a text's form: sizes as logarithms, and shares of kinds of characters, words and lines."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    each = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    count = F.greatest(F.size(each), F.lit(1)).cast("double")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    share = lambda pattern: F.length(F.regexp_replace(text, pattern, "")) / size
    return [
        F.log1p(size), F.log1p(count), size / count, share("[^A-Z]"), share("[^0-9]"), share(r"(?U)[\w\s]"), share(r"[^.!?]"),
        F.size(F.array_distinct(each)) / count, F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
    ]


def with_features(rows: DataFrame, text: str, places: int = PLACES, views: tuple[str, ...] = VIEWS) -> DataFrame:
    """``rows`` with vectors ``words``, ``letters`` and ``shape`` of a text, or those of them in ``views``; null is an empty text.

    Columns of these names are replaced.  Whole texts are read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    made = rows.drop(*VIEWS).withColumn("__each", split(body))  # a column of its own, so that texts are split once
    for view, terms in (("words", words), ("letters", letters)):
        if view in views:
            made = HashingTF(numFeatures=places, binary=True, inputCol="__terms", outputCol=view).transform(made.withColumn("__terms", terms(body, each=F.col("__each")))).drop("__terms")
    if "shape" in views:
        numbers = {f"__s{k}": number for k, number in enumerate(shape(body))}
        made = VectorAssembler(inputCols=list(numbers), outputCol="shape").transform(made.withColumns(numbers)).drop(*numbers)
    return made.drop("__each")


def class_weights(rows: DataFrame, label: str) -> Column:
    """A weight for each row by its class, so that all classes weigh the same."""
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row for each class
    total = sum(counts.values())
    return F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, total / (len(counts) * n))]), F.col(label))


def fit(rows: DataFrame, features: str, label: str, strength: float = 0.01) -> LogisticRegressionModel:
    """A logistic model of a vector column; classes weigh the same, rows with a null label are left out."""
    known = rows.where(F.col(label).isNotNull()).select(features, F.col(label).cast("int").alias("__label"))
    known = known.withColumn("__weight", class_weights(known, "__label"))
    return LogisticRegression(featuresCol=features, labelCol="__label", weightCol="__weight", regParam=strength, maxIter=50).fit(known)


def score(model: LogisticRegressionModel, rows: DataFrame, column: str) -> DataFrame:
    """``rows`` with the probability of class 1."""
    out = model.setProbabilityCol("__probability").setRawPredictionCol("").setPredictionCol("").transform(rows)
    return out.withColumn(column, vector_to_array("__probability")[1]).drop("__probability")


class Stack:
    """A logistic model over the probabilities of one model for each view of the features.

    The upper model learns from probabilities of rows that the lower ones did
    not learn from: rows are dealt into folds by a hash of their id, and each fold is
    scored by models of the others.  The lower models are then fitted on all rows.
    """

    def __init__(self, rows: DataFrame, id_col: str, label: str, folds: int = 3, views: tuple[str, ...] = VIEWS):
        self.views = views
        rows = keep(rows.where(F.col(label).isNotNull()).select(id_col, label, *views).withColumn("__fold", F.pmod(F.xxhash64(id_col, F.lit("fold")), F.lit(folds))), "labelled")
        outside = []
        for k in range(folds):
            scored = rows.where(F.col("__fold") == k)
            for view in views:
                scored = score(fit(rows.where(F.col("__fold") != k), view, label), scored, f"p_{view}")
            outside.append(scored.select(label, *[f"p_{view}" for view in views]))
        self.lower = {view: fit(rows, view, label) for view in views}
        self.upper = fit(self._joined(reduce(DataFrame.union, outside)), "__upper", label)

    def _joined(self, rows: DataFrame) -> DataFrame:
        odds = [F.log((F.col(f"p_{v}") + 1e-6) / (1 - F.col(f"p_{v}") + 1e-6)).alias(f"__o_{v}") for v in self.views]
        names = [f"__o_{v}" for v in self.views]
        return VectorAssembler(inputCols=names, outputCol="__upper").transform(rows.select("*", *odds)).drop(*names)

    def transform(self, rows: DataFrame, column: str = "probability") -> DataFrame:
        """``rows`` with ``p_`` and each view's name, the lower models' probabilities, and the stack's."""
        for view in self.views:
            rows = score(self.lower[view], rows, f"p_{view}")
        return score(self.upper, self._joined(rows), column).drop("__upper")
