"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm import bpe, chat, linear, media, packing, passages, pii, setjoin, vectors
from harrow.llm.common import table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt and two masked completions for every conversation and its branch into its partner's turns."""
    return chat.format_preferences(chat.branched(table(spark, sf_dir, "conversations")))


OP1_SQL = """
WITH t AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), p AS (
  SELECT a.conv_id, a.turns AS c, list_concat(a.turns[1:a.conv_id % (len(a.turns) + 1)], coalesce(b.turns, [])[a.conv_id % (len(a.turns) + 1) + 1:]) AS r
  FROM t a LEFT JOIN t b ON b.conv_id = a.conv_id + 1 - 2 * (a.conv_id % 2)
), x AS (
  SELECT conv_id, c, r, generate_subscripts(c, 1) AS i FROM p
), n AS (
  SELECT conv_id, any_value(c) AS c, any_value(r) AS r,
    coalesce(min(CASE WHEN i > len(r) OR c[i].role <> r[i].role OR c[i].text <> r[i].text THEN i END) - 1, any_value(len(c))) AS n
  FROM x GROUP BY conv_id
), u AS (
  SELECT conv_id, 'p' AS side, unnest(c[1:n]) AS m, generate_subscripts(c[1:n], 1) AS i FROM n
  UNION ALL SELECT conv_id, 'c', unnest(c[n + 1:]), generate_subscripts(c[n + 1:], 1) FROM n
  UNION ALL SELECT conv_id, 'r', unnest(r[n + 1:]), generate_subscripts(r[n + 1:], 1) FROM n
), v AS (
  SELECT conv_id, side, i, m.role AS role, '<|im_start|>' || m.role || chr(10) || m.text || '<|im_end|>' || chr(10) AS shown FROM u
), w AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side ORDER BY i) AS past FROM v
), g AS (
  SELECT conv_id, side, string_agg(shown, '' ORDER BY i) AS shown,
    string_agg(CASE WHEN role = 'assistant' THEN CAST(past - length(shown) + 22 AS BIGINT) || ':' || CAST(past - 1 AS BIGINT) END, ',' ORDER BY i) AS mask
  FROM w GROUP BY conv_id, side
)
SELECT n.conv_id, CAST(n AS INTEGER) AS n_shared, coalesce(p.shown, '') AS prompt, coalesce(c.shown, '') AS chosen_text, coalesce(c.mask, '') AS chosen_mask,
  coalesce(r.shown, '') AS rejected_text, coalesce(r.mask, '') AS rejected_mask
FROM n LEFT JOIN g p ON p.conv_id = n.conv_id AND p.side = 'p' LEFT JOIN g c ON c.conv_id = n.conv_id AND c.side = 'c' LEFT JOIN g r ON r.conv_id = n.conv_id AND r.side = 'r'
"""


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 4-word shingle sets have a Jaccard similarity of 0.85 or more."""
    return setjoin.jaccard_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), r AS (
  SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = s.doc_id), doc_id)) AS component_id FROM s
"""


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as MPEG audio and read back."""
    found = media.store_texts(table(spark, sf_dir, "documents"), keep_media=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return linear.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens in windows of 1024."""
    return packing.pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, keep_ids=False)


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base spans, and all spans."""
    return pii.personal_data(table(spark, sf_dir, "documents")).drop("span_list")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of smaller id has too."""
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows for every vector whose id is divisible by 50."""
    rows = table(spark, sf_dir, "embeddings")
    return vectors.exact_top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the bytes decoded from them."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return linear.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_format, op2_ngram_join, op3_media, op4_quality, op5_packing, op6_personal_data, op7_passages, op8_top_k, op9_bpe, op10_toxicity)}


def oracle_sql() -> dict:
    return {"op1_chat_format": OP1_SQL, "op2_ngram_join": OP2_SQL, "op8_top_k": OP8_SQL}
