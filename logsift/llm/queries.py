"""Registered queries of the training-data operators: name -> (fn(spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, blocks, bloomlm, kdtree, linededup, multiset, phrases, pieces, quality, ranked, shardtree, simhash, tiling
from .common import held_out, read


def piece_model() -> str:
    """The model file of the tokenizer package (the operators take any path)."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that are not held out."""
    scored = quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), held_out("id", 4, 2).alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of all documents and what they decode to, as digests."""
    return pieces.round_trip(read(spark, sf_dir, "documents"), piece_model()).withColumnRenamed("id", "doc_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents: 3-word shingles, links at 2 or fewer differing bits."""
    dup = simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return dup.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_kd_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors, by integer inner product, of every vector whose id is divisible by 50."""
    vectors = kdtree.quantise(read(spark, sf_dir, "embeddings"))
    return kdtree.top_k(vectors, vectors.filter(F.col("id") % 50 == 0), k=5)


def op5_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    text = blocks.extract(read(spark, sf_dir, "pages"))
    return text.select("row.page_id", "row.url", F.col("main_text").alias("text"), "n_chars")


def op6_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every line of all documents, which are encoded as a whole; a token across lines goes to the line with
    most of its characters."""
    import public_tokenizers

    counts = attribution.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, "largest")
    return counts.withColumnRenamed("id", "doc_id")


def op7_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of all documents under a model of those that are not held out."""
    scored = bloomlm.score_held_out(read(spark, sf_dir, "documents"), 7, 2)
    return scored.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that at least 10 documents have."""
    kept = linededup.dedup_lines(read(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op9_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 by the hierarchical weighted hash tree (law ``key``)."""
    return shardtree.shard_documents(read(spark, sf_dir, "documents"), 24)


def op10_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items that they cover to 80 % at least, by tiles of five words or more."""
    hit = tiling.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return hit.select(F.col("id").alias("doc_id"), "item_id", "n_tiles", "covered_words", "item_words", "coverage")


def op11_range_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring of all documents for every benchmark item."""
    return ranked.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), k=10).withColumnRenamed("id", "doc_id")


def op12_multiset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return multiset.compare_edits(read(spark, sf_dir, "documents"))


def op13_misra_gries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of two to five words of each language of all documents."""
    return phrases.collocations(read(spark, sf_dir, "documents"), min_count=100, max_words=5, top=2000, contained=100)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after another."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: The SQL of op8: DuckDB's trim and translate with the same ASCII sets.
SQL_OP8 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
flagged AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id
"""

#: Vectors by row, as rows may repeat a vec_id.
SQL_OP4 = """
WITH own AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE vec_id IS NOT NULL),
flat AS (
  SELECT r, vec_id, generate_subscripts(embedding, 1) AS i, floor(256 * CAST(unnest(embedding) AS DOUBLE)) AS x FROM own),
v AS (
  SELECT r, vec_id, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM flat GROUP BY r, vec_id
  HAVING count(*) = count(x) AND bool_and(isfinite(x))),
pairs AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

#: Scores of every document that has a term of an item.
SQL_OP11 = r"""
WITH lower AS (
  SELECT 0 AS kind, doc_id AS id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
found AS (
  SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM lower WHERE t IS NOT NULL),
d AS (SELECT id, terms, CAST(len(terms) AS BIGINT) AS n FROM found WHERE kind = 0 AND len(terms) > 0),
q AS (SELECT DISTINCT id AS item_id, unnest(terms) AS term FROM found WHERE kind = 1),
tf AS (SELECT id, n, term, count(*) AS tf FROM (SELECT id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
g AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS words FROM d),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, g GROUP BY term),
s AS (
  SELECT q.item_id, tf.id AS doc_id,
         CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (100 - 90 + (90 * tf.n * g.docs) // g.words)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), g GROUP BY q.item_id, tf.id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

#: Fingerprints by unnesting paragraphs, units and bits.
SQL_OP12 = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM documents),
edited AS (
  SELECT doc_id, n_chars, text, left(text, n_chars - n_chars // 2) || left(coalesce(lead(text) OVER o, first(text) OVER o), n_chars // 2) AS edited,
         coalesce(lead(doc_id) OVER o, first(doc_id) OVER o) AS next_id
  FROM own WINDOW o AS (ORDER BY doc_id DESC)),
texts AS (
  SELECT doc_id, 0 AS kind, text FROM edited UNION ALL SELECT doc_id, 1, edited FROM edited),
units AS (
  SELECT doc_id, kind, md5(unnest(regexp_extract_all(text, '[^ \t\n\x0B\f\r.,;:!?]+(?:[ \t]+[^ \t\n\x0B\f\r.,;:!?]+){0,7}'))) AS d FROM texts),
unit_words AS (
  SELECT doc_id, kind, j, CAST(('0x' || substr(d, 1 + 8 * j, 8)) AS BIGINT) AS v FROM units, (SELECT unnest(range(4)) AS j)),
bits AS (
  SELECT doc_id, kind, 32 * j + i AS lane, sum((v >> i) & 1) AS c, count(*) AS n
  FROM unit_words, (SELECT CAST(unnest(range(32)) AS INTEGER) AS i) GROUP BY ALL),
paragraphs AS (
  SELECT doc_id, kind, sha256(p) AS d FROM (SELECT doc_id, kind, unnest(string_split(text, chr(10))) AS p FROM texts) WHERE p <> ''),
sums AS (
  SELECT doc_id, kind, j, sum(CAST(('0x' || substr(d, 1 + 8 * j, 8)) AS BIGINT)) % 4294967296 AS v
  FROM paragraphs, (SELECT unnest(range(8)) AS j) GROUP BY ALL),
lanes AS (
  SELECT doc_id, kind, list(CAST(c AS BIGINT) ORDER BY lane) AS c, CAST(max(n) AS BIGINT) AS n FROM bits GROUP BY ALL),
heads AS (
  SELECT doc_id, kind, list(CAST(v AS BIGINT) ORDER BY j) AS v FROM sums GROUP BY ALL),
vec AS (
  SELECT t.doc_id, t.kind, coalesce(l.n, 0) AS n, list_concat([coalesce(l.n, 0)], coalesce(h.v, [0, 0, 0, 0, 0, 0, 0, 0]),
         coalesce(l.c, list_transform(range(128), lambda x: 0))) AS v
  FROM texts t LEFT JOIN lanes l USING (doc_id, kind) LEFT JOIN heads h USING (doc_id, kind)),
signed AS (
  SELECT doc_id, kind, v, list_transform(v[10:], lambda c: CAST(2 * c - v[1] AS DOUBLE)) AS s,
         list_aggregate(list_transform(v, lambda x: lpad(lower(to_hex(x)), 8, '0')), 'string_agg', '') AS f
  FROM vec)
SELECT e.doc_id, e.n_chars, sha256(e.edited) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint,
       CASE WHEN a.v = b.v THEN 1.0::DOUBLE WHEN list_inner_product(a.s, a.s) * list_inner_product(b.s, b.s) = 0 THEN 0.0::DOUBLE
            ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_inner_product(a.s, b.s)) / sqrt(list_inner_product(a.s, a.s) * list_inner_product(b.s, b.s))) END AS near_edited,
       CASE WHEN a.v = c.v THEN 1.0::DOUBLE WHEN list_inner_product(a.s, a.s) * list_inner_product(c.s, c.s) = 0 THEN 0.0::DOUBLE
            ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, list_inner_product(a.s, c.s)) / sqrt(list_inner_product(a.s, a.s) * list_inner_product(c.s, c.s))) END AS near_next
FROM edited e JOIN signed a ON a.doc_id = e.doc_id AND a.kind = 0 JOIN signed b ON b.doc_id = e.doc_id AND b.kind = 1
JOIN signed c ON c.doc_id = e.next_id AND c.kind = 0
"""

#: Phrases by windows over the words of a piece, counted whole; 128-bit integers for the scores.
SQL_OP13 = r"""
WITH pieces AS (
  SELECT row_number() OVER () AS piece, lang, body FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body
    FROM documents)),
words AS (
  SELECT piece, lang, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT piece, lang, regexp_extract_all(body, '[^\x20\x09]+') AS w FROM pieces)),
g AS (
  SELECT lang, word AS p1, p1 || ' ' || lead(word, 1) OVER q AS p2, p2 || ' ' || lead(word, 2) OVER q AS p3,
         p3 || ' ' || lead(word, 3) OVER q AS p4, p4 || ' ' || lead(word, 4) OVER q AS p5
  FROM words WINDOW q AS (PARTITION BY piece ORDER BY pos)),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
f AS (
  SELECT lang, phrase, words, count(*) AS a FROM (
    SELECT lang, p1 AS phrase, 1 AS words FROM g UNION ALL SELECT lang, p2, 2 FROM g UNION ALL SELECT lang, p3, 3 FROM g
    UNION ALL SELECT lang, p4, 4 FROM g UNION ALL SELECT lang, p5, 5 FROM g)
  WHERE phrase IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT lang, phrase, a, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM f WHERE words > 1),
scored AS (
  SELECT c.lang, c.phrase, c.a, x.a AS l, y.a AS r, t.n, c.k,
         CAST((1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN total t ON t.lang = c.lang),
worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM worst o WHERE NOT EXISTS (
    SELECT 1 FROM f x WHERE x.lang = o.lang AND x.a >= o.a AND length(x.phrase) > length(o.phrase)
    AND contains(' ' || x.phrase || ' ', ' ' || o.phrase || ' '))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""

ENTRIES = {
    "op1_quality": (op1_quality, None),
    "op2_pieces": (op2_pieces, None),
    "op3_simhash": (op3_simhash, None),
    "op4_kd_tree": (op4_kd_tree, SQL_OP4),
    "op5_blocks": (op5_blocks, None),
    "op6_attribution": (op6_attribution, None),
    "op7_bloom_lm": (op7_bloom_lm, None),
    "op8_line_dedup": (op8_line_dedup, SQL_OP8),
    "op9_shard_tree": (op9_shard_tree, None),
    "op10_tiling": (op10_tiling, None),
    "op11_range_maximum": (op11_range_maximum, SQL_OP11),
    "op12_multiset": (op12_multiset, SQL_OP12),
    "op13_misra_gries": (op13_misra_gries, SQL_OP13),
    "pipeline": (pipeline, None),
}
