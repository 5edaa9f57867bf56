"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from civicspark.llm.decontaminate import with_tilings
from civicspark.llm.html_extract import extract_main_text
from civicspark.llm.inverted_multi_index import nearest
from civicspark.llm.lexical_search import lexical_search
from civicspark.llm.licenses import NOTICES, license_scan
from civicspark.llm.line_dedup import line_dedup
from civicspark.llm.mixing import Mixture, mix_to_targets
from civicspark.llm.ngram_join import ngram_jaccard_join
from civicspark.llm.prefix_trie import sequences, trie, turn_digests
from civicspark.llm.quality import CUT_SCORE, fit_quality, score_quality
from civicspark.llm.secret_scan import count_kind, secret_scan, spelled
from civicspark.llm.substring_dedup import substring_dedup
from civicspark.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under Jaccard links of 0.75 on 5-word shingles."""
    return ngram_jaccard_join(_table(spark, sf_dir, "documents"), width=5, threshold=(75, 100)).drop("set_id")


QUERIES["op1_ngram_jaccard_join"] = op1_ngram_jaccard_join
ORACLE_SQL["op1_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS shingles FROM w
), n AS (SELECT doc_id, len(shingles) AS n FROM s),
x AS (SELECT doc_id, unnest(shingles) AS g FROM s),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT p.a, p.b FROM pairs p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE 100 * p.both >= 75 * (na.n + nb.n - p.both)
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT n.doc_id, n.n AS n_shingles, min(r.other) AS component_id FROM n JOIN reach r USING (doc_id) GROUP BY ALL
"""


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that start in a smaller document."""
    found = substring_dedup(_table(spark, sf_dir, "documents"), width=13, block=7)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


QUERIES["op2_substring_dedup"] = op2_substring_dedup
ORACLE_SQL["op2_substring_dedup"] = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i+12], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM w WHERE len(words) >= 13)
), low AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM win JOIN low USING (g) WHERE least < doc_id
), dropped AS (SELECT doc_id, list(i) AS places FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
    CASE WHEN places IS NULL THEN words
      ELSE list_filter(words, lambda x, k: NOT list_contains(places, k)) END AS rest
  FROM w LEFT JOIN dropped USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(rest, ' '), '')) AS kept_sha256 FROM kept
"""


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines of 40 or more code points that five or more documents hold."""
    found = line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=40, least_docs=5)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


QUERIES["op6_line_dedup"] = op6_line_dedup
ORACLE_SQL["op6_line_dedup"] = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (SELECT k.*, s.keeper IS NOT NULL AND s.keeper <> k.doc_id AS gone FROM k LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def held_out(id_col: str = "doc_id"):
    """Whether a document is never learned from."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    found = score_quality(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"))


QUERIES["op7_quality_classifier"] = op7_quality_classifier


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least half the words of a benchmark item in tiles of five or more words."""
    rows = with_tilings(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"), seed=5, least_coverage=0.5)
    found = rows.select("doc_id", F.explode("tilings").alias("t"))
    return found.select("doc_id", "t.item_id", "t.item_words", "t.covered", F.size("t.tiles").alias("n_tiles"))


QUERIES["op3_benchmark_decontamination"] = op3_benchmark_decontamination


def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to deduplicated archives and read back, with their record types."""
    found = archive_round_trip(_table(spark, sf_dir, "pages"), least_bytes=1000)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("refers_to_page").alias("refers_to"))


QUERIES["op4_warc_revisits"] = op4_warc_revisits
ORACLE_SQL["op4_warc_revisits"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), t AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS target FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN target = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN target <> page_id THEN target END AS refers_to
FROM t
"""


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and passages of documents whose word bigrams have a Dice coefficient of 0.8 or more with a license notice or text."""
    found = license_scan(_table(spark, sf_dir, "documents"), least_dice=0.8, passages=True)
    return found.select("doc_id", "line_no", "license_id", "dice")


QUERIES["op8_license_scan"] = op8_license_scan
_TEMPLATES = ", ".join("('" + name + "', '" + text.replace("'", "''") + "')" for name, text in NOTICES)
ORACLE_SQL["op8_license_scan"] = r"""
WITH lines AS (
  SELECT doc_id, NULL AS license_id, generate_subscripts(parts, 1) - 1 AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)
), templates AS (SELECT license_id, text AS line FROM (VALUES """ + _TEMPLATES + r""") t(license_id, text)),
every AS (
  SELECT doc_id, license_id, line_no, line FROM lines UNION ALL SELECT NULL, license_id, NULL, line FROM templates
), words AS (
  SELECT *, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM every
), grams AS (
  SELECT doc_id, license_id, line_no, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1])) AS g
  FROM words WHERE len(w) >= 2
), scored AS (
  SELECT a.doc_id, a.line_no, b.license_id, 2.0 * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)) AS dice
  FROM grams a JOIN grams b ON a.doc_id IS NOT NULL AND b.license_id IS NOT NULL
    AND len(a.g) * 1.2 >= 0.8 * len(b.g) AND len(a.g) * 0.8 <= 1.2 * len(b.g)
)
SELECT doc_id, line_no, license_id, dice::DOUBLE AS dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY dice DESC, license_id) = 1
"""


#: Target shares of the tokens by language.
LANGUAGE_TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def language_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Mixture:
    """Rates that bring the expected tokens of the languages to their targets.

    The labelled table is the languages of the documents that ``labels`` covers.
    """
    covered = _table(spark, sf_dir, "labels").select("doc_id").distinct()
    labelled = _table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("domain")).join(covered, "doc_id", "left_semi")
    return mix_to_targets(docs, labelled, LANGUAGE_TARGETS)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language posteriors and sampling rate of every document."""
    mixture = language_mixture(spark, _table(spark, sf_dir, "documents"), sf_dir)
    names = [F.round(F.col("posterior")[k], 9).alias(f"p_{d}") for k, d in enumerate(mixture.model.domains)]
    return mixture.table().select("doc_id", "n_tokens", *names, "rate")


QUERIES["op5_mixing"] = op5_mixing


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_main_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")


QUERIES["op9_html_extraction"] = op9_html_extraction


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of largest inner product found for every 20th vector."""
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


QUERIES["op10_nearest_neighbours"] = op10_nearest_neighbours


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 documents of highest score for every benchmark item."""
    return lexical_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


QUERIES["op11_ranked_search"] = op11_ranked_search
ORACLE_SQL["op11_ranked_search"] = r"""
WITH every AS (
  SELECT doc_id, NULL::BIGINT AS item_id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT NULL, item_id, min(text) FROM benchmark WHERE item_id IS NOT NULL GROUP BY item_id
), terms AS (
  SELECT doc_id, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM every
), tf AS (SELECT doc_id, term, count(*) AS tf FROM terms WHERE doc_id IS NOT NULL GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS tokens FROM n),
w AS (
  SELECT term, floor(1000 * ln((2 * (SELECT docs FROM total) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf GROUP BY term
), q AS (SELECT item_id, term, count(*) AS times FROM terms WHERE item_id IS NOT NULL GROUP BY ALL),
scale AS (SELECT doc_id, 100 - 25 + ((25 * n * (SELECT docs FROM total)) // (SELECT tokens FROM total)) AS m FROM n),
scored AS (
  SELECT q.item_id, tf.doc_id, sum(q.times * w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 12 * s.m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN scale s USING (doc_id) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document, by patterns and by the token-efficiency test."""
    found = secret_scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), least_chars=20, most_chars_per_token=2.0).drop("text")
    base = F.filter("spans", lambda s: s.kind != "random")
    return found.select(
        "doc_id",
        *[count_kind(F.col("spans"), kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex", "random")],
        F.sha2(spelled(base), 256).alias("base_sha256"),
        spelled(F.col("spans")).alias("spans"),
    )


QUERIES["op12_secret_scan"] = op12_secret_scan


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """Digests of turns with the first h of each conversation c taken from conversation c - c % 100, h = crc32(c) % 6."""
    numbered = sequences(turn_digests(turns)).select("conv_id", F.col("depth").alias("turn"), "digest", "chars")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    own = numbered.where(F.col("turn") > h)
    bases = numbered.where("conv_id % 100 = 0 AND turn <= 5").withColumnRenamed("conv_id", "base")
    wanted = numbered.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("base"), h.alias("h"))
    heads = wanted.join(bases, "base").where("turn <= h").select("conv_id", "turn", "digest", "chars")
    return heads.union(own)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations."""
    turns = _table(spark, sf_dir, "conversations")
    return trie(rebuilt_conversations(turns), turns.select("conv_id")).nodes.drop("fp", "parent_fp")


QUERIES["op13_prefix_trie"] = op13_prefix_trie
ORACLE_SQL["op13_prefix_trie"] = r"""
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, list_reduce(
    list_concat([4294967295::UBIGINT::HUGEINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: list_concat([ascii(x)::HUGEINT],
      list_transform(range(8), lambda i: (-1)::HUGEINT))))),
    lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384::HUGEINT * (c & 1)) END) AS crc
  FROM (SELECT DISTINCT conv_id FROM numbered)
), want AS (SELECT conv_id, base, (xor(crc, 4294967295::HUGEINT) % 6)::BIGINT AS h FROM convs),
sequence AS (
  SELECT w.conv_id, n.place, n.role, n.text FROM want w JOIN numbered n ON n.conv_id = w.base AND n.place <= w.h
  UNION ALL SELECT w.conv_id, n.place, n.role, n.text FROM want w JOIN numbered n ON n.conv_id = w.conv_id AND n.place > w.h
), path AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list(sha256(length(role) || ':' || role || text)) OVER w AS p
  FROM sequence WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), member AS (
  SELECT conv_id, depth, chars, p FROM path UNION ALL SELECT conv_id, 0, 0, [] FROM want
), ended AS (SELECT conv_id, arg_max(p, depth) AS p FROM member GROUP BY conv_id),
ends AS (SELECT p, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM ended GROUP BY p),
node AS (SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM member GROUP BY p, depth),
child AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT n.p[1:unnest(range(0, n.depth + 1))] AS p, (n.n_convs - 1) * n.chars AS saved, (c.p IS NULL)::BIGINT AS leaf
  FROM node n LEFT JOIN child c ON c.p = n.p
), sums AS (SELECT p, sum(saved) AS saved_tokens, sum(leaf) AS n_leaves FROM below GROUP BY p)
SELECT n.conv_id, n.depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM node n JOIN sums s ON s.p = n.p LEFT JOIN child c ON c.p = n.p LEFT JOIN ends e ON e.p = n.p
LEFT JOIN node q ON q.depth = n.depth - 1 AND q.p = n.p[1:n.depth - 1]
"""
