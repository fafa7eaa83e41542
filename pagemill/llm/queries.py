"""The registered query of each operator, with SQL where DuckDB can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import identified, read_table
from pagemill.llm.embedding_dedup import near_duplicates
from pagemill.llm.hard_negatives import mine, whole_vectors
from pagemill.llm.language_model import score_documents
from pagemill.llm.lexical_search import search
from pagemill.llm.line_dedup import drop_repeated_chunks
from pagemill.llm.mixing import mix
from pagemill.llm.packing import pack_documents
from pagemill.llm.quality_rules import judge
from pagemill.llm.sentencepiece_codec import decode, encode
from pagemill.llm.sharding import assign_shards
from pagemill.llm.simhash_dedup import simhash_groups
from pagemill.llm.suffix_dedup import remove_repeats
from pagemill.llm.toxicity import THRESHOLD, classify
from pagemill.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = lambda spark, sf_dir: build(tune(spark), sf_dir)
    return build


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; null and empty texts have fingerprint zero and link, an empty table gives no rows (``simhash_groups``)."""
    return simhash_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per piece; a null or empty text is its end id alone, an empty table gives no rows (``pack_documents``)."""
    return pack_documents(read_table(spark, sf_dir, "documents"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null text is empty and keeps nothing, ties go to the smaller doc_id and earlier start (``remove_repeats``)."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["stop"] - span["start"])
    return remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text has no features, without toxic labels nothing is rejected (``classify``)."""
    scored = classify(read_table(spark, sf_dir, "documents").select("doc_id", "text"), read_table(spark, sf_dir, "labels"))
    toxic = F.col("_chain.toxic") >= THRESHOLD
    return scored.select("doc_id", F.col("_chain.quality").alias("quality_score"), F.col("_chain.toxic").alias("toxic_score"), toxic.alias("toxic"), (~toxic).alias("kept"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts and the MD5 of what is left of every document; null and empty texts have one empty line, rows without or repeating an id as in ``drop_repeated_chunks``."""
    kept = drop_repeated_chunks(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed_lines").alias("n_removed_lines"), F.col("_n_removed_chunks").alias("n_removed_chunks"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


ORACLES["op1_line_dedup"] = """
WITH lines AS (
  SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), hashed AS (
  SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines
), cuts AS (
  SELECT *, ((coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) * 1000003 + h) % 2147483647) % 3 = 0 AS ends FROM hashed
), placed AS (
  SELECT doc_id, i, line,
    coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM cuts
), chunks AS (
  SELECT doc_id, place, string_agg(line, chr(10) ORDER BY i) AS body, count(*) AS n_lines, count(*) FILTER (line <> '') AS solid
  FROM placed GROUP BY doc_id, place
), ranked AS (
  SELECT *, solid >= 2 AND row_number() OVER (PARTITION BY solid >= 2, body ORDER BY doc_id, place) > 1 AS gone FROM chunks
)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS n_removed_lines,
  count(*) FILTER (gone) AS n_removed_chunks,
  md5(coalesce(string_agg(body, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_md5
FROM ranked GROUP BY doc_id
"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null text has no bytes, a document over the limit is alone in its shard (``assign_shards``)."""
    return assign_shards(read_table(spark, sf_dir, "documents"))


ORACLES["op9_sharding"] = """
WITH sizes AS (
  SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, coalesce(octet_length(encode(text)), 0)::BIGINT AS bytes FROM documents
), deep AS (
  SELECT *, h >> (60 - depth)::INT AS prefix FROM sizes, (SELECT unnest(range(0, 41)) AS depth)
), buckets AS (
  SELECT depth, prefix, sum(bytes)::BIGINT AS shard_bytes, count(*) AS shard_docs FROM deep GROUP BY ALL
  HAVING sum(bytes) <= 16777216 OR count(*) = 1
), chosen AS (
  SELECT d.*, b.shard_bytes, b.shard_docs, row_number() OVER (PARTITION BY doc_id ORDER BY d.depth) AS k
  FROM deep d JOIN buckets b ON d.depth = b.depth AND d.prefix = b.prefix
)
SELECT doc_id, bytes, CASE depth WHEN 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, depth::INT AS shard_depth, shard_docs, shard_bytes
FROM chosen WHERE k = 1
"""


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text is its end alone, an empty table gives no rows (``score_documents``)."""
    return score_documents(read_table(spark, sf_dir, "documents")).drop("train_types")


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text has no words and fails the base rules, without labels none is trusted (``judge``)."""
    return judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null or empty text has no ids, an empty table gives no rows (``encode``)."""
    docs = read_table(spark, sf_dir, "documents")
    wanted = identified(docs.select("doc_id", "text")).select("doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    n_tokens = (F.octet_length("ids").cast("long") / 4).cast("long")
    decoded = F.crc32(decode(F.col("ids")).cast("binary")).alias("decoded")
    coded = encode(docs).select("doc_id", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "score", "n_chunks", decoded)  # narrow before the join
    return coded.join(wanted, "doc_id").select("doc_id", "n_tokens", "ids_crc32", "score", "n_chunks", (F.col("decoded") == F.col("text_crc32")).alias("round_trip"))


@query
def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per vector; null, zero or non-finite vectors and null labels link with nothing, an empty table gives no rows (``near_duplicates``)."""
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))


@query
def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document; a null text has size 0, a null source is the last one, ties in size go by id (``mix``)."""
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to ten rows per item; null and empty texts have no terms, equal scores go by doc_id (``search``)."""
    return search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op12_lexical_search"] = r"""
WITH doc_terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM doc_terms GROUP BY ALL
), lengths AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY doc_id
), totals AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM lengths
), weights AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), totals
), item_terms AS (
  SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL
), scored AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * big_n) // big_l))))::BIGINT AS score
  FROM item_terms JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (doc_id), totals
  GROUP BY ALL
), ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query
def op13_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five rows per anchor and positive; rows with a null or non-finite part take no part, equal scores go by vec_id (``mine``)."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), whole_vectors(F.col("embedding")).alias("vector"))
    return mine(vectors, F.col("vec_id") % 100 == 0)


ORACLES["op13_hard_negative_mining"] = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM positives JOIN scored USING (anchor_id)
  WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 5
"""
