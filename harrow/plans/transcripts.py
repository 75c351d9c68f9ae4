"""Queries on conversations as transcripts, and on sections and words."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.functions.sanitize import entropy
from harrow.operators import relevance, transcript
from harrow.sources.tables import table


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.from_turns(table(spark, sf_dir, "conversations"))


def transcript_role_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, characters and estimated tokens of messages by role."""
    return transcript.role_stats(_messages(spark, sf_dir))


ROLE_SQL = "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM conversations GROUP BY role"


def transcript_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens of each conversation."""
    sized = transcript.sized(_messages(spark, sf_dir))
    return sized.groupBy("conv_id").agg(transcript.estimated_tokens(F.sum("chars")).alias("tokens"))


TOKENS_SQL = "SELECT conv_id, CAST(sum(length(text)) // 4 AS BIGINT) AS tokens FROM conversations GROUP BY conv_id"


def transcript_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest messages."""
    return transcript.largest(_messages(spark, sf_dir))


TOP_SQL = "SELECT conv_id, turn AS idx, role, length(text) AS chars FROM conversations ORDER BY chars DESC, conv_id, idx LIMIT 10"


def transcript_coverage80(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many messages hold four fifths of each conversation."""
    return transcript.coverage(_messages(spark, sf_dir))


COVERAGE_SQL = """
WITH m AS (SELECT conv_id, row_number() OVER w AS rank, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS running, sum(length(text)) OVER (PARTITION BY conv_id) AS total
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY length(text) DESC, turn))
SELECT conv_id, CAST(min(rank) AS INTEGER) AS n_messages FROM m WHERE running >= total * 0.8 GROUP BY conv_id
"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("input_tokens"), F.floor(n / 4).alias("output_tokens"), F.floor(n / 3).alias("cache_read"), F.floor(n / 10).alias("cache_create"))


def transcript_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and largest change of size from turn to turn."""
    return transcript.growth(_usage(spark, sf_dir))


GROWTH_SQL = """
WITH d AS (SELECT conv_id, turn, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS delta FROM conversations), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY delta DESC, turn) AS rank FROM d WHERE delta IS NOT NULL)
SELECT conv_id, avg(delta) AS avg_delta, CAST(max(delta) AS INTEGER) AS max_delta, max(turn) FILTER (rank = 1) AS max_turn FROM r GROUP BY conv_id
"""


def transcript_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals by turn."""
    return transcript.cumulative(_usage(spark, sf_dir)).select("conv_id", "turn", "cumulative_input_tokens", "cumulative_output_tokens")


CUMULATIVE_SQL = """
SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS cumulative_input_tokens, CAST(sum(length(text) // 4) OVER w AS BIGINT) AS cumulative_output_tokens
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)
"""


def transcript_size_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by size, empty classes included."""
    return transcript.size_histogram(transcript.sized(_messages(spark, sf_dir)))


HISTOGRAM_SQL = """
SELECT bucket, count(conv_id) AS n FROM (VALUES ('<1K', 0, 1000), ('1-5K', 1000, 5000), ('5-20K', 5000, 20000), ('20-100K', 20000, 100000), ('>100K', 100000, 1000000000)) b(bucket, low, high)
LEFT JOIN conversations ON length(text) >= low AND length(text) < high GROUP BY bucket
"""


def transcript_stage_by_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages by the stage that their age in turns would put them in."""
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    return table(spark, sf_dir, "conversations").select(transcript.stage_of(last - F.col("turn")).alias("stage")).groupBy("stage").agg(F.count("*").alias("n"))


STAGE_SQL = """
SELECT CASE WHEN age >= 5 THEN 'stub' WHEN age >= 2 THEN 'skeleton' ELSE 'full' END AS stage, count(*) AS n
FROM (SELECT max(turn) OVER (PARTITION BY conv_id) - turn AS age FROM conversations) GROUP BY ALL
"""


def transcript_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories of more than six messages cut to the first, a marker and the last four."""
    cut = transcript.trimmed(_messages(spark, sf_dir), 6, 4)
    return cut.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("idx").alias("last"))


TRIM_SQL = """
SELECT conv_id, CASE WHEN count(*) > 6 THEN 6 ELSE count(*) END AS n, CAST(max(turn) AS DOUBLE) AS last FROM conversations GROUP BY conv_id
"""


def transcript_hotspots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters by what they are spent on."""
    return transcript.hotspots(_messages(spark, sf_dir))


HOTSPOTS_SQL = """
SELECT CAST(coalesce(sum(length(text)) FILTER (role = 'user' AND length(text) >= 200), 0) AS BIGINT) AS task_messages, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS agent_text,
  CAST(0 AS BIGINT) AS agent_code, CAST(0 AS BIGINT) AS page_views, CAST(0 AS BIGINT) AS other_results, CAST(coalesce(sum(length(text)) FILTER (role = 'user' AND length(text) < 200), 0) AS BIGINT) AS nudges
FROM conversations
"""

PRICES = (("alpha", 15.0, 75.0, 1.5, 18.75), ("alpha-mini", 1.0, 5.0, 0.1, 1.25), ("beta", 2.5, 10.0, 1.25, 2.5))


def cost_by_price_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all conversations would cost at every row of a price list."""
    prices = spark.createDataFrame(list(PRICES), "model string, input_price double, output_price double, cache_read_price double, cache_write_price double")
    return transcript.cost_by_price(_usage(spark, sf_dir), prices)


_PRICE_ROWS = ", ".join(str(p) for p in PRICES)
COST_SQL = f"""
WITH u AS (SELECT sum(length(text)) AS i, sum(length(text) // 4) AS o, sum(length(text) // 3) AS r, sum(length(text) // 10) AS c FROM conversations)
SELECT model, greatest(i - r - c, 0) / 1e6 * pi + o / 1e6 * po + r / 1e6 * pr + c / 1e6 * pw AS cost FROM u, (VALUES {_PRICE_ROWS}) p(model, pi, po, pr, pw)
"""


def price_of_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of models with the price of the longest prefix in the list."""
    prices = spark.createDataFrame([p[:2] for p in PRICES], "key string, input_price double")
    names = F.element_at(F.array(*map(F.lit, ("maker:alpha-2025", "alpha-mini-x", "beta", "other:gamma", "alphabet"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", names.alias("model"))
    return transcript.with_prefix_match(rows, "model", prices, "key").groupBy("model", "input_price").agg(F.count("*").alias("n"))


MODEL_SQL = """
SELECT model, CASE WHEN bare LIKE 'alpha-mini%' THEN 1.0 WHEN bare LIKE 'alpha%' THEN 15.0 WHEN bare LIKE 'beta%' THEN 2.5 END::DOUBLE AS input_price, count(*) AS n FROM (
  SELECT model, regexp_replace(model, '^[^:]*:', '') AS bare FROM (SELECT ['maker:alpha-2025', 'alpha-mini-x', 'beta', 'other:gamma', 'alphabet'][c_custkey % 5 + 1] AS model FROM customer)) GROUP BY ALL
"""


def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each turn shares with the one before."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    pairs = table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(by)).where("before is not null").withColumn("key", F.concat_ws(":", "conv_id", "turn"))
    return relevance.multiset_similarity(pairs, "text", "before", "key")


_WORDS = r"string_split_regex({}, '[\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SIMILARITY_SQL = f"""
WITH p AS (SELECT conv_id || ':' || turn AS key, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations), q AS (SELECT * FROM p WHERE before IS NOT NULL), w AS (
  SELECT key, unnest({_WORDS.format("text")}) AS w, 0 AS side FROM q UNION ALL SELECT key, unnest({_WORDS.format("before")}) AS w, 1 AS side FROM q
), c AS (SELECT key, w, count(*) FILTER (side = 0) AS x, count(*) FILTER (side = 1) AS y FROM w WHERE w <> '' GROUP BY key, w)
SELECT q.key, coalesce(sum(least(x, y)) / sum(greatest(x, y)), 1.0) AS similarity FROM q LEFT JOIN c USING (key) GROUP BY q.key
"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections of pages, a thousand ids of a source each; the reasoning names words and ids of some. A page is
    what windows and views gather, so its size doesn't grow with the tables."""
    df = table(spark, sf_dir, "documents").withColumn("page_id", F.concat(F.col("source"), F.lit("-"), F.floor(F.col("doc_id") / 1000).cast("string")))
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("doc_id")) - 1
    rows = df.select("page_id", pos.alias("pos"), F.concat(F.lit("item-"), F.col("lang"), F.lit("-"), F.col("doc_id").cast("string")).alias("section_id"), F.col("text").alias("content"), F.lit("content").alias("role"), F.lit(0).alias("interactive_count"))
    return rows.withColumn("reasoning", F.concat(F.lit("look at item-en-1 and the thing about "), "page_id"))


def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rarity of the words at the beginning of each source's documents."""
    return relevance.token_idf(_sections(spark, sf_dir)).select("page_id", "token", F.round("idf", 9).alias("idf"))


_PAGE = "source || '-' || doc_id // 1000"
_CONTENT_TOKENS = f"list_distinct(list_filter(list_transform({_WORDS.format('left(text, 200)')}, lambda w: lower(w)), lambda w: length(w) >= 4 AND regexp_matches(w, '^\\p{{L}}+$')))"
_FIRST_TOKENS = f"list_filter(list_transform({_WORDS.format('left(text, 200)')}, lambda w: lower(w)), lambda w, i: length(w) >= 4 AND regexp_matches(w, '^\\p{{L}}+$'))"
IDF_SQL = f"""
WITH t AS (SELECT {_PAGE} AS page_id, unnest(list_distinct(list_concat(['item'], {_CONTENT_TOKENS}))) AS token FROM documents), n AS (SELECT {_PAGE} AS page_id, count(*) AS n FROM documents GROUP BY ALL)
SELECT page_id, token, round(ln(1 + any_value(n.n) / count(*)), 9) AS idf FROM t JOIN n USING (page_id) GROUP BY page_id, token
"""


def neighbor_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections by tier around those whose id is named."""
    sections = _sections(spark, sf_dir)
    referenced = sections.where(F.col("pos") % 20 == 7).select("page_id", "section_id")
    return relevance.tiers(sections, referenced).groupBy("page_id", "tier").agg(F.count("*").alias("n"))


_TIERS = f"""
WITH s AS (SELECT {_PAGE} AS page_id, row_number() OVER (PARTITION BY {_PAGE} ORDER BY doc_id) - 1 AS pos FROM documents), t AS (
  SELECT page_id, pos, CASE WHEN pos % 20 = 7 THEN 'kept' WHEN coalesce(max(CASE WHEN pos % 20 = 7 THEN 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) = 1 THEN 'neighbor' ELSE 'distant' END AS tier FROM s)
"""
TIERS_SQL = f"{_TIERS} SELECT page_id, tier, count(*) AS n FROM t GROUP BY ALL"


def omitted_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of sections of one tier."""
    sections = _sections(spark, sf_dir)
    referenced = sections.where(F.col("pos") % 20 == 7).select("page_id", "section_id")
    return relevance.runs(relevance.tiers(sections, referenced), "page_id", "pos", "tier")


RUNS_SQL = f"""{_TIERS}, c AS (SELECT *, CASE WHEN tier IS DISTINCT FROM lag(tier) OVER (PARTITION BY page_id ORDER BY pos) THEN 1 ELSE 0 END AS change FROM t), r AS (
  SELECT *, sum(change) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT page_id, tier, CAST(min(pos) AS INTEGER) AS start, CAST(max(pos) AS INTEGER) AS "end", count(*) AS n FROM r GROUP BY page_id, run, tier
"""


def section_indirect_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each source that the reasoning refers to indirectly."""
    sections = _sections(spark, sf_dir)
    return relevance.indirect_references(sections, relevance.direct_references(sections))


INDIRECT_SQL = f"""
WITH s AS (
  SELECT {_PAGE} AS page_id, row_number() OVER (PARTITION BY {_PAGE} ORDER BY doc_id) - 1 AS pos, 'item-' || lang || '-' || doc_id AS section_id, {_CONTENT_TOKENS} AS words,
    'look at item-en-1 and the thing about ' || {_PAGE} AS said, count(*) OVER (PARTITION BY {_PAGE}) AS n FROM documents
), t AS (SELECT page_id, unnest(list_distinct(list_concat(['item'], words))) AS token FROM s), f AS (
  SELECT page_id, token, ln(1 + any_value(k.n) / count(*)) AS idf FROM t JOIN (SELECT {_PAGE} AS page_id, count(*) AS n FROM documents GROUP BY ALL) k USING (page_id) GROUP BY page_id, token
), q AS (SELECT *, string_split_regex(lower(said), '\\W+') AS named FROM s WHERE NOT contains(said, section_id)), k AS (
  SELECT page_id, section_id, pos, n, named, 'id_tokens' AS source, 'item' AS token FROM q UNION ALL SELECT page_id, section_id, pos, n, named, 'content', unnest({_FIRST_TOKENS}[1:8]) FROM q JOIN documents ON section_id = 'item-' || lang || '-' || doc_id
), c AS (SELECT page_id, section_id, pos, n, source, sum(CASE WHEN list_contains(named, token) THEN idf ELSE 0 END) / sum(idf) AS score FROM k JOIN f USING (page_id, token) GROUP BY ALL), b AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, section_id ORDER BY score DESC, source DESC) AS best FROM c
), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rank FROM b WHERE best = 1 AND score > 0)
SELECT page_id, section_id, score, source FROM r WHERE rank <= least(greatest(1, floor(n * 0.2)), 15)
"""


def string_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shannon entropy of the names of parts."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([round(entropy(x), 9) for x in batch.column(1).to_pylist()], pa.float64())], names=["p_partkey", "bits"])

    return names.mapInArrow(run, "p_partkey long, bits double")


ENTROPY_SQL = """
WITH c AS (SELECT p_partkey, length(p_name) AS n, unnest(string_split(p_name, '')) AS c FROM part), k AS (SELECT p_partkey, n, c, count(*) AS k FROM c WHERE c <> '' GROUP BY ALL)
SELECT p_partkey, round(-sum(k / n * log2(k / n)), 9) AS bits FROM k GROUP BY p_partkey
"""


def full_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that differ enough from the last one analysed in full."""
    return relevance.full_analysis_needed(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"))


FULL_SQL = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
w AS (SELECT conv_id, i, w, count(*) AS n FROM (SELECT conv_id, i, unnest({_WORDS.format("text")}) AS w FROM m) WHERE w <> '' GROUP BY ALL), t AS (SELECT conv_id, i, sum(n) AS n FROM w GROUP BY ALL),
b AS (SELECT x.conv_id, x.i AS x, y.i AS y, sum(least(x.n, y.n)) AS n FROM w x JOIN w y ON x.conv_id = y.conv_id AND x.w = y.w AND x.i < y.i GROUP BY ALL),
p AS (SELECT x.conv_id, x.i AS x, y.i AS y, coalesce(b.n, 0) / nullif(coalesce(tx.n, 0) + coalesce(ty.n, 0) - coalesce(b.n, 0), 0) AS same
  FROM m x JOIN m y ON x.conv_id = y.conv_id AND x.i < y.i LEFT JOIN b ON b.conv_id = x.conv_id AND b.x = x.i AND b.y = y.i
  LEFT JOIN t tx ON tx.conv_id = x.conv_id AND tx.i = x.i LEFT JOIN t ty ON ty.conv_id = y.conv_id AND ty.i = y.i),
r AS (SELECT conv_id, i, i AS base, true AS "full" FROM m WHERE i = 1
  UNION ALL SELECT r.conv_id, r.i + 1, CASE WHEN coalesce(same, 1.0) < 0.8 THEN r.i + 1 ELSE base END, coalesce(same, 1.0) < 0.8 FROM r JOIN p ON p.conv_id = r.conv_id AND p.x = base AND p.y = r.i + 1)
SELECT conv_id, turn, "full" FROM r JOIN m USING (conv_id, i)
"""


def filtered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered view of every source."""
    sections = _sections(spark, sf_dir)
    referenced = sections.where(F.col("pos") % 20 == 7).select("page_id", "section_id")
    return relevance.filtered_view(relevance.tiers(sections, referenced)).select("page_id", F.length("view").alias("chars"))


VIEWS_SQL = f"""
WITH s AS (SELECT {_PAGE} AS page_id, row_number() OVER (PARTITION BY {_PAGE} ORDER BY doc_id) - 1 AS pos, '--- [item-' || lang || '-' || doc_id || '] content (0 interactive) ---' AS head,
  length(regexp_replace(text, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS n FROM documents), t AS (
  SELECT *, pos % 20 = 7 AS kept, coalesce(max(CASE WHEN pos % 20 = 7 THEN 1 END) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0) = 1 AS near FROM s
), b AS (
  SELECT page_id, CASE WHEN kept THEN length(head) + 1 + n WHEN near THEN length(head || chr(10) || '[omitted]') END AS chars, pos, near FROM t
), d AS (SELECT page_id, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS run FROM b WHERE NOT near), o AS (
  SELECT page_id, length('[' || count(*) || ' sections omitted]') AS chars FROM d GROUP BY page_id, run UNION ALL SELECT page_id, chars FROM b WHERE near)
SELECT page_id, CAST(sum(chars) + 2 * (count(*) - 1) AS INTEGER) AS chars FROM o GROUP BY page_id
"""


def turn_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last turn of each conversation."""
    return transcript.turn_range(_messages(spark, sf_dir))


RANGES_SQL = "SELECT conv_id, 1 AS start_turn, CAST(greatest(count(*) FILTER (role = 'assistant'), 1) AS BIGINT) AS end_turn FROM conversations GROUP BY conv_id"

QUERIES = {
    f.__name__: f
    for f in (
        transcript_role_stats, transcript_token_estimate, transcript_top10, transcript_coverage80, transcript_growth, transcript_cumulative, transcript_size_histogram, transcript_stage_by_age,
        transcript_trim, transcript_hotspots, cost_by_price_row, price_of_model, turn_similarity, token_idf, neighbor_tiers, omitted_runs, section_indirect_topk, string_entropy, full_analyses,
        filtered_views, turn_ranges,
    )
}
SQL = {
    "transcript_role_stats": ROLE_SQL, "transcript_token_estimate": TOKENS_SQL, "transcript_top10": TOP_SQL, "transcript_coverage80": COVERAGE_SQL, "transcript_growth": GROWTH_SQL,
    "transcript_cumulative": CUMULATIVE_SQL, "transcript_size_histogram": HISTOGRAM_SQL, "transcript_stage_by_age": STAGE_SQL, "transcript_trim": TRIM_SQL, "transcript_hotspots": HOTSPOTS_SQL,
    "cost_by_price_row": COST_SQL, "price_of_model": MODEL_SQL, "turn_similarity": SIMILARITY_SQL, "token_idf": IDF_SQL, "neighbor_tiers": TIERS_SQL, "omitted_runs": RUNS_SQL,
    "section_indirect_topk": INDIRECT_SQL, "string_entropy": ENTROPY_SQL, "full_analyses": FULL_SQL, "filtered_views": VIEWS_SQL, "turn_ranges": RANGES_SQL,
}
