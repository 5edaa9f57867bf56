"""Classifiers of documents, fitted on labels and held against rows they have not seen."""

from __future__ import annotations

from pyspark.sql import functions as F

from civicspark.operators import text_models as T
from civicspark.operators import topics as M
from civicspark.operators.records import binary_metrics
from civicspark.plans.registry import query
from civicspark.sources.shared import keep


def _features(t, views=T.VIEWS, scored="all"):
    """Documents with features, label and whether they are held out; written once, as fits read them many times.

    scored: ``all`` documents, or ``labelled`` ones, where no other is fitted or told of.
    """
    rows = t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    if scored == "labelled":
        rows = rows.where("quality is not null")
    rows = rows.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return keep(T.with_features(rows, "text", views=views).drop("text"), "features")


@query("f69", r"""SELECT doc_id, length(coalesce(text, '')) AS size, length(regexp_replace(coalesce(text, ''), '[^A-Z]', '', 'g')) AS capitals, length(regexp_replace(coalesce(text, ''), '[^0-9]', '', 'g')) AS digits, length(regexp_replace(coalesce(text, ''), '[^.!?]', '', 'g')) AS stops FROM documents""")
def f69(t):
    """Counts behind the shape features of whole documents."""
    body = F.coalesce("text", F.lit(""))
    numbers = T.shape(body)
    size = F.length(body)
    back = lambda x: F.round(x * F.greatest(size, F.lit(1))).cast("long")
    return t.documents.select("doc_id", size.cast("long").alias("size"), back(numbers[3]).alias("capitals"), back(numbers[4]).alias("digits"), back(numbers[6]).alias("stops"))


@query("m1")
def m1(t):
    """Probability of good quality of every document, by hashed words, fitted on labels that are not held out."""
    rows = _features(t, ("words",))
    model = T.fit(rows.where(~F.col("held_out")), "words", "quality")
    return T.score(model, rows, "probability").select("doc_id", "held_out", F.round("probability", 6).alias("probability"), (F.col("probability") >= 0.5).cast("int").alias("predicted"))


@query("m8_stack")
def m8_stack(t):
    """Metrics on held-out labels of a stack over models of words, letters and shapes."""
    rows = _features(t, scored="labelled")
    stack = T.Stack(rows.where(~F.col("held_out")), "doc_id", "quality")
    seen = stack.transform(rows.where("held_out and quality is not null")).withColumn("predicted", (F.col("probability") >= 0.5).cast("int"))
    return binary_metrics(seen, "quality", "predicted")


@query("m9")
def m9(t):
    """Shares of four topics of whole documents by language."""
    docs = t.documents.select("doc_id", "text", "lang")
    model = M.Topics(docs, "text", 4)
    found = M.shares_by(model.transform(docs, "text"), "lang")
    return found.select("lang", "topic", "documents", F.round("share", 4).alias("share"))
