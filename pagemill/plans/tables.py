"""Store, backup, highlight and log tables derived from the given ones, by SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.sources.staging import staged

_ITEM = """'{"id":"h' || '@' || '","text":"text ' || CAST(page_id AS STRING) || ' ' || '@' || '","color":"' || CASE WHEN page_id % 2 = 0 THEN 'yellow' ELSE 'blue' END || '","timestamp":' || CAST(page_id AS STRING) || CASE WHEN page_id % 5 = 0 THEN '' ELSE ',"rangeInfo":{"startOffset":1}' END || '}'"""
_ITEMS = [_ITEM.replace("@", str(k)) for k in range(3)]
_LIST = "CASE CAST(page_id % 4 AS INT) WHEN 0 THEN '[]' " + " ".join(f"WHEN {n} THEN '[' || " + " || ',' || ".join(_ITEMS[:n]) + " || ']'" for n in (1, 2, 3)) + " END"
_NORM = "trim(TRAILING '/' FROM split_part(split_part(url, '#', 1), '?', 1))"

STORE_SQL = f"""
SELECT profile_id, ordinal, key, value FROM (
  WITH p AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url),
  n AS (SELECT p.page_id, p.url, x.url AS next_url FROM p LEFT JOIN p x ON x.page_id = p.page_id + 1),
  q AS (SELECT page_id, url, next_url, 'p' || CAST(CAST(floor(page_id / 10) AS BIGINT) % 3 AS STRING) AS profile_id, CAST(page_id AS STRING) AS pid, {_LIST} AS list FROM n)
  SELECT profile_id, page_id * 10 + 1 AS ordinal, 'page_' || url AS key,
    CASE WHEN page_id % 16 = 9 THEN CASE WHEN page_id % 3 = 0 THEN '"x"' WHEN page_id % 3 = 1 THEN '[]' ELSE '{{"highlights":1}}' END
    ELSE '{{' || CASE WHEN page_id % 3 = 0 THEN '"remote":{{"pageId":"r' || pid || '","url":"https://remote.example/' || pid || '","title":"Title ' || pid || '","savedAt":' || pid || '}},' ELSE '' END
      || '"highlights":' || list || ',"metadata":{{"createdAt":1,"lastUpdated":' || pid || '}}}}' END AS value
  FROM q WHERE page_id % 4 <> 1 OR page_id % 16 = 9
  UNION ALL
  SELECT profile_id, page_id * 10 + 2, 'saved_' || url, '{{"pageId":"s' || pid || '","url":"https://remote.example/s' || pid || '","title":"Saved ' || pid || '","savedAt":' || pid || '}}' FROM q WHERE page_id % 3 = 1
  UNION ALL
  SELECT profile_id, page_id * 10 + 3, 'highlights_' || url, CASE WHEN page_id % 8 = 5 THEN '[]' WHEN page_id % 2 = 0 THEN list ELSE '{{"highlights":' || list || '}}' END FROM q WHERE page_id % 4 IN (1, 2)
  UNION ALL
  SELECT profile_id, page_id * 10 + 4, 'url_alias:' || url, CASE WHEN page_id % 7 = 0 THEN '"https://missing.example/' || pid || '"' WHEN page_id % 5 = 3 AND next_url IS NOT NULL THEN '"' || next_url || '"' ELSE '"' || {_NORM} || '"' END FROM q WHERE url <> {_NORM}
  UNION ALL
  SELECT profile_id, page_id * 10 + 5, 'migration_' || pid, '{{"phase":"' || CASE WHEN page_id % 20 = 0 THEN 'completed' ELSE 'failed' END || '"}}' FROM q WHERE page_id % 10 = 0
  UNION ALL
  SELECT profile_id, page_id * 10 + 6, '_v1_' || pid, '{{"old":true}}' FROM q WHERE page_id % 10 = 0
  UNION ALL
  SELECT profile_id, CAST(-1 AS BIGINT), 'config_theme', '"dark"' FROM (SELECT DISTINCT profile_id FROM q) c
) s
"""  # noqa: S608

BACKUP_SQL = f"""
SELECT profile_id, ordinal, CASE WHEN ordinal % 60 = 1 THEN key || '-new' ELSE key END AS key,
  CASE WHEN ordinal % 5 = 1 AND substr(value, 1, 1) = '{{' THEN '{{"changed":true,' || substr(value, 2) ELSE value END AS value
FROM ({STORE_SQL}) b WHERE ordinal % 6 <> 5
"""  # noqa: S608

# The store with copies of legacy lists under urls with a fragment.
COPIES_SQL = f"""
SELECT profile_id, ordinal, key, value FROM ({STORE_SQL}) a
UNION ALL SELECT profile_id, ordinal + 4, key || '#copy', value FROM ({STORE_SQL}) b WHERE substr(key, 1, 11) = 'highlights_' AND ordinal % 3 > 0
"""  # noqa: S608

LOGS_SQL = """
SELECT event_id, ts, CAST(user_id AS STRING) AS source,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' THEN 'warn' ELSE 'info' END AS level,
  event_type AS message, props AS context
FROM events
"""

VERIFICATIONS_SQL = """
SELECT event_id, ts, user_id AS remote_page_id,
  CASE WHEN event_type = 'error' THEN FALSE WHEN event_type = 'view' THEN TRUE ELSE NULL END AS page_exists
FROM events
"""

BLOCKS_SQL = """
SELECT conv_id AS page_id, turn AS pos, CASE WHEN turn % 5 = 0 THEN 'heading_3' ELSE 'paragraph' END AS type, text, role
FROM conversations
"""

SOURCES_SQL = """
SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 5 = 0 THEN 'database' WHEN p_partkey % 5 = 1 THEN 'data_source' WHEN p_partkey % 5 = 2 THEN 'user' ELSE 'page' END AS object,
  CASE WHEN p_partkey % 3 = 0 THEN 'workspace' WHEN p_partkey % 3 = 1 THEN 'page_id' ELSE 'database_id' END AS parent_type,
  CASE WHEN p_partkey % 4 = 0 THEN 'title,url' WHEN p_partkey % 4 = 1 THEN 'title,select' ELSE 'title' END AS property_types,
  p_name AS title, p_partkey AS ordinal
FROM part
"""

TABLES = ("pages", "events", "conversations", "part", "supplier", "documents")


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of a derived table over the tables in sf_dir."""
    for name in TABLES:
        if f"FROM {name}" in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)


def stored(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """derived, written once: what reads a store several times then doesn't derive it each time."""
    return staged(derived(spark, sf_dir, sql), "derived")
