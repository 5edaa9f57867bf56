"""Features of texts against plain Python, weighted fits, stacks on held-out rows."""

import random
import re

import pytest
from civicspark.operators import text_models as T
from civicspark.operators import topics as M
from civicspark.operators.records import binary_metrics
from pyspark.sql import functions as F


def test_words_and_letters(spark):
    texts = ["One two, TWO one", "", "a", "é-x  y", "same same same"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.words(F.col("text")).alias("w"), T.letters(F.col("text")).alias("l")).collect()
    for row in got:
        each = re.findall(r"\w+", row.text.lower())
        assert row.w == each + [f"{a} {b}" for a, b in zip(each, each[1:])]
        assert row.l == [f" {w} "[k : k + 3] for w in dict.fromkeys(each) for k in range(len(w))]


def test_null_and_empty_texts_have_features(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "A word."), (4, "x " * 50_000)], "id long, text string")
    made = {r.id: r for r in T.with_features(rows.withColumn("words", F.lit("clash")), "text", 64).collect()}
    assert made[1]["words"] == made[2]["words"] and made[1]["words"].numNonzeros() == 0 and made[1]["shape"] == made[2]["shape"]
    assert all(len(r["shape"]) == 9 and not any(x != x for x in r["shape"]) for r in made.values())
    assert abs(made[3]["shape"][3] - 1 / 7) < 1e-9 and abs(made[3]["shape"][6] - 1 / 7) < 1e-9


def planted(spark, n=600):
    """Texts of which the word tells most classes and the form tells others; one in twenty labels is wrong."""
    rng, rows = random.Random(3), []
    for k in range(n):
        label = int(rng.random() < 0.8)
        body = [f"w{rng.randrange(30)}" for _ in range(12)]
        if k % 2:
            body.insert(rng.randrange(12), "granted" if label else "refused")
        text = " ".join(body)
        text = text.upper() if not k % 2 and not label else text
        rows.append((k, text, label if rng.random() < 0.95 else 1 - label, label))
    return T.with_features(spark.createDataFrame(rows, "id long, text string, label int, truth int"), "text", 512).cache()


def test_a_stack_beats_its_parts_and_the_majority(spark):
    rows = planted(spark)
    stack = T.Stack(rows.where("id % 5 > 0"), "id", "label", folds=2)
    seen = stack.transform(rows.where("id % 5 = 0")).cache()  # of both kinds of texts
    hits = lambda c: seen.where((F.col(c) >= 0.5).cast("int") == F.col("truth")).count() / seen.count()
    assert hits("probability") >= max(hits(f"p_{v}") for v in T.VIEWS) - 0.02
    found = binary_metrics(seen.withColumn("predicted", (F.col("probability") >= 0.5).cast("int")), "truth", "predicted").first()
    assert found.macro_f1 > 0.8  # the majority alone has less than 0.46


def test_classes_weigh_the_same(spark):
    rows = spark.createDataFrame([(0,)] * 2 + [(1,)] * 6, "label int")
    sums = rows.withColumn("w", T.class_weights(rows, "label")).groupBy("label").agg(F.sum("w").alias("w")).collect()
    assert {r.label: r.w for r in sums} == pytest.approx({0: 4.0, 1: 4.0})


def test_planted_topics_are_found(spark):
    rng = random.Random(7)
    pools = [[f"{c}{k}" for k in range(12)] for c in "ab"]
    rows = [(k, " ".join(rng.choice(pools[k % 2]) for _ in range(30)), "even" if k % 2 == 0 else "odd") for k in range(120)] + [(900, None, "even"), (901, "", None)]
    docs = spark.createDataFrame(rows, "id long, text string, side string")
    model = M.Topics(docs, "text", 2, least=2, seed=5)
    shares = {(r.side, r.topic): r.share for r in M.shares_by(model.transform(docs, "text"), "side").collect()}
    assert (None, 0) not in shares  # its only text is empty
    for side in ("even", "odd"):
        assert shares[side, 0] + shares[side, 1] == pytest.approx(1.0)
    main = max((0, 1), key=lambda k: shares["even", k])
    assert shares["even", main] > 0.85 and shares["odd", 1 - main] > 0.85
    top = {(r.topic, r.word) for r in model.top_words(spark, 5).collect()}
    assert {w[0] for k, w in top if k == main} == {"a"} and {w[0] for k, w in top if k != main} == {"b"}


def test_features_of_some_views(spark):
    rows = spark.createDataFrame([(0, "One two, two"), (1, None), (2, "")], "id int, text string")
    some, whole = T.with_features(rows, "text", views=("words",)), T.with_features(rows, "text")
    assert some.columns == ["id", "text", "words"] and set(whole.columns) == {"id", "text", *T.VIEWS}
    assert sorted(some.select("id", "words").collect()) == sorted(whole.select("id", "words").collect())


def test_labelled_features_are_those_of_all(spark):
    from civicspark.plans.projection import Tables
    from civicspark.plans.suites.models import _features

    t = Tables(spark, "/root/testdata/sf0.001")
    some, whole = _features(t, scored="labelled"), _features(t).where("quality is not null")
    assert some.where("quality is null").count() == 0 and sorted(map(str, some.collect())) == sorted(map(str, whole.collect()))


def test_the_vocabulary_is_that_of_spark_and_holds_no_texts(spark):
    from pyspark.ml.feature import CountVectorizer

    rows = spark.createDataFrame([(["a", "a", "b", "e"],), (["a", "c", "b"],), (["c", "d", "d", "d"],), ([],)], "w array<string>")
    assert M._vocabulary(rows, "w", 1, 0.5, 3) == ["a", "d", "b"] and M._vocabulary(rows, "w", 2, 0.5, 9) == ["a", "b", "c"]
    assert sorted(M._vocabulary(rows, "w", 1, 0.5, 9)) == sorted(CountVectorizer(inputCol="w", outputCol="c", minDF=1.0, maxDF=0.5).fit(rows).vocabulary)


def test_a_fit_holds_no_texts_in_memory(spark, monkeypatch):
    from pyspark.ml import feature

    monkeypatch.setattr(feature.CountVectorizer, "fit", lambda *_: pytest.fail("it keeps all words of a partition as one block of memory"))
    model = M.Topics(spark.createDataFrame([("aa bb",), ("aa cc",), (None,)], "text string"), "text", 2, least=1, most=0.7)
    assert model.counts.vocabulary == ["aa", "bb", "cc"]
