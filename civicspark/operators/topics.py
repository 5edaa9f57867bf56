"""Topics of texts, and how much of each stratum they take."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.sources.shared import keep

#: Words that a model knows, the most frequent ones; its size on the driver.
VOCABULARY = 20_000


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"(?U)[^\w]+"), lambda w: F.length(w) > 1)


def _vocabulary(rows: DataFrame, words: str, least: int, most: float, size: int) -> list[str]:
    """The ``size`` most frequent words that are in ``least`` rows or more and in a share of ``most`` of all rows or less; equal ones by the alphabet.

    Words are counted as rows of an aggregate, so no text is held in memory.
    """
    once = F.transform(F.array_distinct(words), lambda w: F.struct(w.alias("word"), F.lit(1).alias("rows"), F.lit(0).alias("uses")))
    each = F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(0).alias("rows"), F.lit(1).alias("uses")))
    told = rows.select(F.explode(F.concat(once, each)).alias("w")).groupBy("w.word").agg(F.sum("w.rows").alias("rows"), F.sum("w.uses").alias("uses"))
    known = told.where(F.col("rows").between(least, most * rows.count())).orderBy(F.desc("uses"), "word").limit(size)
    return [r.word for r in known.select("word").collect()]  # ``size`` words at most


class Topics:
    """A topic model fitted on the words of all texts of ``rows``; the seed makes it the same for the same partitions.

    least: documents that a word has to be in; words in more than ``most`` of all
    documents are left out, as they belong to every topic.
    """

    def __init__(self, rows: DataFrame, text: str, topics: int, least: int = 5, most: float = 0.5, rounds: int = 20, seed: int = 1, vocabulary: int = VOCABULARY):
        words = rows.select(_words(text).alias("__words"))
        self.counts = CountVectorizerModel.from_vocabulary(_vocabulary(words, "__words", least, most, vocabulary) or [""], "__words", "__counts")  # a model has to know a word; texts hold no empty one
        counted = keep(self.counts.transform(words).select("__counts"), "word-counts")
        self.model = LDA(k=topics, maxIter=rounds, seed=seed, featuresCol="__counts", topicDistributionCol="__topics", optimizer="online", subsamplingRate=0.3).fit(counted)

    def transform(self, rows: DataFrame, text: str) -> DataFrame:
        """``rows`` with ``topics``, the share of each; null for texts without a known word."""
        found = self.model.transform(self.counts.transform(rows.withColumn("__words", _words(text))))
        shares = vector_to_array("__topics")
        total = F.aggregate(shares, F.lit(0.0), lambda a, x: a + x)
        return found.withColumn("topics", F.when(total > 0, F.transform(shares, lambda x: x / total))).drop("__words", "__counts", "__topics")

    def top_words(self, spark: SparkSession, n: int = 10) -> DataFrame:
        """``topic``, ``place``, ``word`` and ``weight`` of the ``n`` heaviest words of each topic."""
        words = self.counts.vocabulary
        rows = [(r.topic, k, words[i], float(w)) for r in self.model.describeTopics(n).collect() for k, (i, w) in enumerate(zip(r.termIndices, r.termWeights))]
        return spark.createDataFrame(rows, "topic int, place int, word string, weight double")


def shares_by(rows: DataFrame, stratum: str) -> DataFrame:
    """``documents`` with topics, and the mean ``share`` of each topic, by stratum; the shares of one that has topics sum to 1.

    A stratum without such documents has no row.
    """
    each = rows.select(stratum, F.posexplode("topics").alias("topic", "share"))  # none of a null; a condition on topics would be pushed down and infer them twice
    return each.groupBy(stratum, "topic").agg(F.count("*").alias("documents"), F.avg("share").alias("share"))
