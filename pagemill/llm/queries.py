"""Registered queries of the text operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import align, bpe, htmltext, lexsearch, license, linededup, media, neardup, packing, secretscan, sharding, simhash, toxicity

SHARDS = [f"shard-{k:03d}" for k in range(64)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark, sf_dir):
    return packing.pack_documents(_table(spark, sf_dir, "documents"), with_ids=False)


def op2_sharding(spark, sf_dir):
    return sharding.assign_shards(_table(spark, sf_dir, "documents").select("doc_id"), SHARDS)


def op3_toxicity(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_toxicity(docs, _table(spark, sf_dir, "labels"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return scored.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"))


def op4_line_dedup(spark, sf_dir):
    kept = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_near_dedup(spark, sf_dir):
    return neardup.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_key")


def op6_media(spark, sf_dir):
    return media.media_digests(_table(spark, sf_dir, "documents"))


def op7_bpe(spark, sf_dir):
    return bpe.token_digests(_table(spark, sf_dir, "documents"))


def op8_html_text(spark, sf_dir):
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


def op9_license_scan(spark, sf_dir):
    return license.scan_licenses(_table(spark, sf_dir, "documents"))


def op10_simhash(spark, sf_dir):
    return simhash.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return align.align_documents(_table(spark, sf_dir, "documents"))


def op12_lexical_search(spark, sf_dir):
    return lexsearch.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_secret_scan(spark, sf_dir):
    return secretscan.scan_secrets(_table(spark, sf_dir, "documents"))


def simhash_neighbours(spark, sf_dir):
    """The permuted block tables of op10 over whole documents; queries are the ids divisible by 50."""
    return simhash.neighbours_of_queries(_table(spark, sf_dir, "documents"))


def media_clips(spark, sf_dir):
    """Timed clip rows of op6's stored files."""
    return media.clip_rows(media.store_media(_table(spark, sf_dir, "documents")))


def queries() -> dict:
    from corpus_pipeline import run

    own = (op1_packing, op2_sharding, op3_toxicity, op4_line_dedup, op5_near_dedup, op6_media, op7_bpe, op8_html_text, op9_license_scan, op10_simhash, op11_alignment, op12_lexical_search, op13_secret_scan, simhash_neighbours, media_clips)
    return {f.__name__: f for f in own} | {"pipeline": run}


OP4_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line
), gone AS (
  SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10
), marked AS (
  SELECT keyed.*, gone.k IS NOT NULL AS dropped FROM keyed LEFT JOIN gone ON keyed.k = gone.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


OP12_SQL = r"""
WITH word AS (
  SELECT doc, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS doc, doc_id, text FROM documents) d
), posting AS (SELECT doc, doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
doc_len AS (SELECT doc, CAST(sum(tf) AS BIGINT) AS n FROM posting GROUP BY doc),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM doc_len),
wanted AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weight AS (
  SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * n_docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w
  FROM posting, total WHERE term IN (SELECT term FROM wanted) GROUP BY term, n_docs
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM posting JOIN weight USING (term) JOIN wanted USING (term) JOIN doc_len USING (doc), total GROUP BY item_id, doc, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return {"op4_line_dedup": OP4_SQL, "op12_lexical_search": OP12_SQL} | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
