"""A stored inverted index: postings by bucket of terms, with block maxima, pruned ranking, filters and headlines.

Documents are dealt into blocks of neighbouring ids.  A row of the index holds
one term's postings in one block: the documents with the places of the term,
and the most that the term can add to the score of a document of the block.
Rows are stored by bucket of the term's hash, so a query opens its terms'
buckets only; new documents are added as a generation of rows, and nothing that
is stored is written again.

A search reads first only the maxima, and scores the blocks that promise most;
then only blocks that can still reach the k-th score so far.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.operators.search import parse_query

#: Weights of fields in thousandths, as PostgreSQL's defaults.
WEIGHTS = {"A": 1000, "B": 400, "C": 200}
#: Buckets of terms.
BUCKETS = 64
#: Ids of a block.
BLOCK_IDS = 1_024
#: Blocks of a slice; a task writes one bucket of one slice.
SLICE_BLOCKS = 256
#: Blocks that are scored first.
FIRST_BLOCKS = 64
#: A place is the field's number times this, plus the number of the word.
_FIELD = 1 << 40


def words_of(text: Column) -> Column:
    """Runs of ASCII letters and digits, as they are written."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+"), lambda x: x != "")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class StoredIndex:
    """Where an index lies, and the weight class of each of its fields, in order."""

    spark: SparkSession
    path: str
    fields: dict[str, str]

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def documents(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/documents")


def postings(docs: DataFrame, id_col: str, fields: dict[str, str]) -> DataFrame:
    """Rows (term, block, top, docs, bucket): the places of a term in the documents of a block, sorted by id.

    Words are shuffled once, by bucket and slice of blocks, so a task holds one
    bucket's terms of some hundred thousand documents, however large the table is.
    """
    places = [
        docs.select(F.col(id_col).alias("id"), F.lit(number).alias("field"), F.posexplode(words_of(F.col(c))).alias("word_no", "word"))
        for number, c in enumerate(fields)
    ]
    rows = reduce(DataFrame.unionByName, places).select("id", F.lower("word").alias("term"), (F.col("field").cast("long") * _FIELD + F.col("word_no")).alias("place"))
    block = F.floor(F.col("id") / BLOCK_IDS)
    rows = rows.withColumn("bucket", _bucket(F.col("term"))).withColumn("slice", F.floor(block / SLICE_BLOCKS)).repartition("bucket", "slice")
    by_doc = rows.groupBy("bucket", "slice", "term", "id").agg(F.array_sort(F.collect_list("place")).alias("places"))
    by_doc = by_doc.withColumn("worth", _worth(F.col("places"), list(fields.values())))
    held = by_doc.groupBy("bucket", "slice", "term", block.alias("block")).agg(F.max("worth").alias("top"), F.array_sort(F.collect_list(F.struct("id", "places"))).alias("docs"))
    return held.select("term", "block", "top", "docs", "bucket")


def _worth(places: Column, classes: list[str]) -> Column:
    """Summed weights of places, in thousandths."""
    table = F.array(*[F.lit(WEIGHTS[c]) for c in classes])
    return F.aggregate(places, F.lit(0).cast("long"), lambda total, p: total + F.element_at(table, F.floor(p / _FIELD).cast("int") + 1))


def build(docs: DataFrame, id_col: str, fields: dict[str, str], path: str, attributes: tuple[str, ...] = ()) -> StoredIndex:
    """An index of new documents at a new path; ``attributes`` are kept for filters.  Ids are whole numbers, one to a document."""
    index = StoredIndex(docs.sparkSession, path, dict(fields))
    _write(index, docs, id_col, attributes, 0)
    return index


def add(index: StoredIndex, docs: DataFrame, id_col: str, attributes: tuple[str, ...] = ()) -> int:
    """Index the documents whose ids are not in the index yet, as a generation of their own; its number."""
    known = index.documents()
    new = docs.join(known.select(F.col("id").alias(id_col)), id_col, "left_anti")
    generation = known.agg(F.max("generation")).first()[0]
    generation = 0 if generation is None else generation + 1
    _write(index, new, id_col, attributes, generation)
    return generation


def _write(index: StoredIndex, docs: DataFrame, id_col: str, attributes: tuple[str, ...], generation: int) -> None:
    """Postings first: documents that are listed are indexed, and a failed write is done again by ``add``.

    A generation's folder is overwritten, so what a failed write left is gone.
    """
    rows = postings(docs, id_col, index.fields)
    rows.sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{index.path}/postings/generation={generation}")
    docs.select(F.col(id_col).alias("id"), *attributes).write.mode("overwrite").parquet(f"{index.path}/documents/generation={generation}")


def _matches(part: tuple[bool, bool, list[str]]) -> list[Column]:
    """For each word of a part, whether a row's term is one of its terms."""
    _, prefix, words = part
    return [F.col("term").startswith(w) if prefix else F.col("term") == w for w in words]


def _hits(part: tuple[bool, bool, list[str]], name: str) -> Column:
    """Places where a part begins, of the columns that hold the places of its words."""
    first, *rest = [F.col(f"{name}_{k}") for k in range(len(part[2]))]
    return F.filter(first, lambda p: reduce(lambda a, b: a & b, [F.array_contains(places, p + k) for k, places in enumerate(rest, 1)], F.lit(True)))


def _scored(rows: DataFrame, parts: list, classes: list[str], wanted: DataFrame | None) -> DataFrame:
    """id, score and places of the words of all documents in some rows that match the query."""
    docs = rows.select("term", F.explode("docs").alias("d")).select("term", "d.id", "d.places")
    if wanted is not None:
        docs = docs.join(wanted, "id", "left_semi")
    columns = [F.flatten(F.collect_list(F.when(m, F.col("places")))).alias(f"p{n}_{k}") for n, part in enumerate(parts) for k, m in enumerate(_matches(part))]
    held = docs.groupBy("id").agg(*columns)
    hits = {n: _hits(part, f"p{n}") for n, part in enumerate(parts)}
    for n, part in enumerate(parts):
        held = held.where(F.size(hits[n]) == 0 if part[0] else F.size(hits[n]) > 0)
    found = F.flatten(F.array(*[hits[n] for n, part in enumerate(parts) if not part[0]]))
    return held.select("id", found.alias("places")).select("id", _worth(F.col("places"), classes).alias("score"), F.array_sort("places").alias("places"))


def search(index: StoredIndex, query: str, k: int, where: str | Column | None = None) -> DataFrame:
    """The k best documents: id, rank (r / (r + 1)) and the places of what matched; ties by id.

    query: words, "phrases", -exclusions and prefixes*, all of which must hold.
    where: a condition on the attributes of documents, applied before ranking.
    The whole index of the terms' buckets is considered; pruning never changes
    the result.
    """
    spark = index.spark
    parts = parse_query(query)
    asked = [part for part in parts if not part[0]]
    if not asked:
        return spark.createDataFrame([], "id long, rank double, places array<long>")
    match = reduce(lambda a, b: a | b, [m for part in parts for m in _matches(part)])
    rows = index.postings().where(match)
    if not any(part[1] for part in parts):  # without prefixes the buckets are known
        named = sorted({w for part in parts for w in part[2]})
        of = spark.createDataFrame([(w,) for w in named], "term string").select(_bucket(F.col("term"))).distinct()
        rows = rows.where(F.col("bucket").isin([r[0] for r in of.collect()]))
    wanted = None if where is None else index.documents().where(where).select("id")
    classes = list(index.fields.values())

    sums = []
    for n, part in enumerate(asked):
        sums += [F.sum(F.when(m, F.col("top"))).alias(f"b{n}_{k}") for k, m in enumerate(_matches(part))]
    bounds = rows.groupBy("generation", "block").agg(*sums)
    # a phrase stands no oftener than the rarest of its words
    bound = reduce(lambda a, b: a + b, [F.least(*cols) if len(cols) > 1 else cols[0] for cols in ([F.col(f"b{n}_{k}") for k in range(len(part[2]))] for n, part in enumerate(asked))])
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in bounds.columns[2:]])
    bounds = bounds.where(whole).select("generation", "block", bound.alias("bound"))

    first = [tuple(r) for r in bounds.orderBy(F.desc("bound"), "generation", "block").limit(FIRST_BLOCKS).select("generation", "block").collect()]
    if not first:
        return spark.createDataFrame([], "id long, rank double, places array<long>")
    seeds = F.broadcast(spark.createDataFrame(first, "generation int, block long"))  # FIRST_BLOCKS rows at most
    best = _scored(rows.join(seeds, ["generation", "block"]), parts, classes, wanted).orderBy(F.desc("score"), "id").limit(k).select("score").collect()
    least = best[-1][0] if len(best) == k else 0
    left = bounds.where(F.col("bound") >= least).select("generation", "block")
    found = _scored(rows.join(left, ["generation", "block"], "left_semi"), parts, classes, wanted).orderBy(F.desc("score"), "id").limit(k)
    r = F.col("score") / 1000
    return found.select("id", F.round(r / (r + 1), 6).alias("rank"), "places")


def headlines(found: DataFrame, index: StoredIndex, docs: DataFrame, id_col: str, field: str, before: int = 5, after: int = 9) -> DataFrame:
    """``found`` with the words around the first match in a field, joined by spaces, the matches in ``<b>``; null without a match there.

    found: rows of :func:`search`, k at most, so they are what is broadcast.
    """
    number = list(index.fields).index(field)
    low = number * _FIELD
    texts = docs.select(F.col(id_col).alias("id"), words_of(F.col(field)).alias("words"))
    rows = texts.join(F.broadcast(found), "id")
    places = F.transform(F.filter("places", lambda p: (p >= low) & (p < low + _FIELD)), lambda p: (p - low).cast("int"))
    rows = rows.withColumn("at", places)
    start = F.greatest(F.get("at", F.lit(0)) - before, F.lit(0))
    cut = F.transform(F.slice("words", start + 1, before + after + 1), lambda w, i: F.when(F.array_contains("at", i + start), F.concat(F.lit("<b>"), w, F.lit("</b>"))).otherwise(w))
    return rows.select("id", "rank", F.when(F.size("at") > 0, F.array_join(cut, " ")).alias("headline"))
