"""Registered queries over metadata, icons, visible text, content tests and highlight records, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import migration as m
from pagemill.operators import pages as p
from pagemill.operators import store as s
from pagemill.plans.pages import _PLAIN
from pagemill.plans.tables import STORE_SQL, derived, stored
from pagemill.plans.web import _ROUTED, sql_norm

_N = "CAST(page_id AS STRING)"
_HEAD = f"""CASE WHEN page_id % 2 = 0 THEN '<meta property="article:author" content="B ' || {_N} || '"><meta name="author" content="A ' || {_N} || '">' ELSE '<meta name="twitter:creator" content="C ' || {_N} || '"><meta name="author" content="">' END
 || CASE WHEN page_id % 3 = 0 THEN '<meta name="twitter:description" content="t"><meta property="og:description" content="D ' || {_N} || '">' ELSE '' END
 || CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '<link rel="apple-touch-icon" sizes="180x180" href="/touch' || {_N} || '.png"><link rel="icon" type="image/svg+xml" sizes="any" href="i' || {_N} || '.svg?v=1">'
   WHEN 1 THEN '<link rel="shortcut icon" href="//cdn.example/s' || {_N} || '.ico"><link rel="apple-touch-icon-precomposed" href="https://cdn.example/p' || {_N} || '.png">' WHEN 2 THEN '<link rel="icon" href="data:image/png,x"><link rel="icon" sizes="32x32" href="https://cdn.example/a.png"><link rel="icon" sizes="64x64" href="https://cdn.example/b.png">' ELSE '' END
 || CASE WHEN page_id % 4 = 1 THEN '<meta name="twitter:image" content="https://img.example/t"><meta property="og:image" content="https://img.example/o' || {_N} || '">' ELSE '' END"""
METADATA_SQL = f"SELECT page_id, url, replace(html, '</head>', {_HEAD} || '</head>') AS html FROM pages"  # noqa: S608
ICONS_SQL = """
SELECT CAST(floor(p_partkey / 8) AS BIGINT) AS page_id, p_partkey AS ordinal, 'https://i.example/' || replace(p_name, ' ', '/') || CASE CAST(p_size % 6 AS INT) WHEN 0 THEN '.svg#x' WHEN 1 THEN '.PNG' WHEN 2 THEN '.ico?v=2' WHEN 3 THEN '.jpeg' ELSE '' END AS url,
  CASE WHEN p_size % 7 = 0 THEN 'image/SVG+xml' WHEN p_size % 7 = 1 THEN 'image/png' END AS type, CASE WHEN p_size % 3 = 0 THEN CAST(p_size * 8 AS STRING) || 'x1' WHEN p_size % 10 = 1 THEN 'any' END AS sizes,
  CAST(1 + p_partkey % 4 AS INT) AS priority, p_partkey % 4 < 2 AS apple FROM part
"""
# Highlights whose fields have other types, by id.
ITEMS_SQL = """
SELECT doc_id, '[' || CASE WHEN doc_id % 2 = 0 THEN '{"id":"h' || CAST(doc_id AS STRING) || '","text":"T' || lang || '","color":"blue","rangeInfo":{"a":1},"timestamp":' || CAST(n_chars AS STRING) || '}' ELSE '{"id":' || CAST(doc_id AS STRING) || ',"text":["x"],"color":{},"rangeInfo":"r"}' END || CASE WHEN doc_id % 3 = 0 THEN ',5,"s",null,[1],{}' ELSE '' END || ']' AS items FROM documents
"""


def b1_page_metadata(spark, d):
    t = derived(spark, d, METADATA_SQL)
    return p.extract_metadata(t, p.explode_nodes(t))


def w2_best_site_icon(spark, d):
    t = p.best_site_icon(derived(spark, d, ICONS_SQL))
    return t.select("page_id", "url", F.col("score").cast("long").alias("score"))


def f15_html_to_text(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.md5(p.html_to_text(F.col("html"))).alias("text_md5"))


def p13_content_good(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.substr("html", F.lit(1), F.col("page_id").cast("int") % 40 * 20).alias("html"))
    n = p.explode_nodes(t).groupBy("page_id").agg(F.coalesce(F.sum(F.when(F.col("tag") == "a", F.col("text_len"))), F.lit(0)).alias("links"), F.count_if(F.col("tag") == "li").alias("items"))
    j = t.join(n, "page_id", "left").select("page_id", F.char_length("html").alias("size"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("items", F.lit(0)).alias("items"))
    return j.select("page_id", p.is_content_good(F.col("size"), F.col("links"), F.col("items")).alias("good"))


def f21_normalize_highlights(spark, d):
    t = derived(spark, d, ITEMS_SQL).select("doc_id", F.posexplode(m.normalize_highlights(F.col("items"), F.lit(7.0))).alias("pos", "h"))
    return t.select("doc_id", F.col("pos").cast("long").alias("pos"), "h.id", "h.text", "h.color", "h.range_info", "h.timestamp")


def j19_upsert_highlights(spark, d):
    st = stored(spark, d, STORE_SQL)
    urls = s.route_keys(st).where("kind in ('page', 'highlights', 'saved', 'alias') and url <> ''").select("profile_id", "url").distinct()
    updates = urls.withColumn("highlights", F.concat(F.lit('[{"id":"'), F.char_length("url"), F.lit('"}]')))
    return m.upsert_highlights(st, updates, F.lit(9)).select("profile_id", "key", "action", F.md5("value").alias("value_md5"))


QUERIES = {f.__name__: f for f in (b1_page_metadata, w2_best_site_icon, f15_html_to_text, p13_content_good, f21_normalize_highlights, j19_upsert_highlights)}

_ORIGIN = "regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)"
_DIR = "regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^(.*/)', 1)"
ORACLES = {
    "b1_page_metadata": f"""SELECT page_id, url, trim({_PLAIN.format(x="regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1)")}) AS title, CASE WHEN page_id % 2 = 0 THEN 'A ' || {_N} ELSE 'C ' || {_N} END AS author, CASE WHEN page_id % 3 = 0 THEN 'D ' || {_N} END AS description,
CASE page_id % 5 WHEN 0 THEN {_ORIGIN} || {_DIR} || 'i' || {_N} || '.svg?v=1' WHEN 1 THEN regexp_extract(url, '^[a-z]+:', 0) || '//cdn.example/s' || {_N} || '.ico' WHEN 2 THEN 'data:image/png,x' ELSE {_ORIGIN} || '/favicon.ico' END AS favicon,
CASE page_id % 5 WHEN 0 THEN {_ORIGIN} || {_DIR} || 'i' || {_N} || '.svg?v=1' WHEN 1 THEN 'https://cdn.example/p' || {_N} || '.png' WHEN 2 THEN 'https://cdn.example/a.png' ELSE {_ORIGIN} || '/favicon.ico' END AS site_icon, CASE WHEN page_id % 4 = 1 THEN 'https://img.example/o' || {_N} END AS featured_image FROM pages""",
    "w2_best_site_icon": f"""WITH c AS ({ICONS_SQL}), k AS (SELECT *, lower(regexp_replace(url, '[?#].*$', '')) AS u, lower(coalesce(type, '')) AS t, CASE WHEN sizes = 'any' THEN 999 ELSE coalesce(TRY_CAST(regexp_extract(sizes, '^(\\d+)', 1) AS INT), 0) END AS z FROM c),
v AS (SELECT *, CASE WHEN ends_with(u, '.svg') OR contains(t, 'svg') THEN 1000 WHEN ends_with(u, '.png') OR contains(t, 'png') THEN 500 WHEN ends_with(u, '.ico') THEN 100 WHEN ends_with(u, '.jpeg') THEN 200 ELSE 0 END
 + CASE WHEN z = 999 THEN 500 WHEN z >= 180 AND z <= 256 THEN 300 WHEN z > 256 THEN 200 WHEN z >= 120 THEN 100 WHEN z >= 1 THEN 50 ELSE 0 END + CASE WHEN apple THEN 50 ELSE 0 END + (10 - priority) * 10 AS score FROM k)
SELECT page_id, arg_max(url, struct_pack(s := score, o := -ordinal)) AS url, CAST(max(score) AS BIGINT) AS score FROM v GROUP BY page_id""",
    "f15_html_to_text": f"SELECT page_id, md5({_PLAIN.format(x="regexp_replace(regexp_replace(html, '^[\\s\\S]*</head>', ''), '<[^>]*>', '', 'g')")}) AS text_md5 FROM pages",
    "p13_content_good": """WITH t AS (SELECT page_id, substr(html, 1, (page_id % 40 * 20)::BIGINT) AS h FROM pages), k AS (SELECT page_id, length(h) AS size, coalesce(list_sum(list_transform(regexp_extract_all(h, '<a [^>]*>([^<]*)', 1), lambda x: length(trim(x)))), 0) AS links, len(regexp_extract_all(h, '<li>')) AS items FROM t)
SELECT page_id, size >= 250 AND (items >= 8 OR links / greatest(size, 1) <= 0.25) AS good FROM k""",
    "f21_normalize_highlights": f"""WITH t AS ({ITEMS_SQL}), x AS (SELECT doc_id, unnest(range(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END)) AS pos, n_chars, lang FROM t JOIN documents USING (doc_id))
SELECT doc_id, pos, CASE WHEN pos = 1 THEN '' WHEN doc_id % 2 = 0 THEN 'h' || doc_id ELSE '' END AS id, CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN 'T' || lang ELSE '' END AS text, CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN 'blue' ELSE 'yellow' END AS color,
CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN '{{"a":1}}' ELSE '{{}}' END AS range_info, CAST(CASE WHEN pos = 0 AND doc_id % 2 = 0 THEN n_chars ELSE 7 END AS DOUBLE) AS timestamp FROM x""",
    "j19_upsert_highlights": f"""WITH {_ROUTED}, us AS (SELECT DISTINCT profile_id, url, {sql_norm('url')} AS normal FROM r WHERE kind IN ('page', 'highlights', 'saved', 'alias') AND url <> ''),
ok AS (SELECT * FROM al WHERE length(target) >= 10 AND NOT (regexp_matches(target, '^[a-z]+://[^/?#]*/*$'))),
u AS (SELECT us.*, coalesce(a.target, b.target, normal) AS stable FROM us LEFT JOIN ok a ON a.profile_id = us.profile_id AND a.url = us.normal LEFT JOIN ok b ON b.profile_id = us.profile_id AND b.url = us.url),
o AS (SELECT profile_id, stable, max(url) AS url, arg_max(normal, url) AS normal FROM u GROUP BY 1, 2),
k AS (SELECT profile_id, stable, unnest([0, 1, 2, 3]) AS rank, unnest(['page_' || stable, 'page_' || normal, 'highlights_' || stable, 'highlights_' || normal]) AS key, unnest([stable, normal, stable, normal]) AS src FROM o),
h AS (SELECT k.*, st.value FROM k JOIN st USING (profile_id, key)), b AS (SELECT profile_id, stable, arg_min(struct_pack(rank := rank, src := src, v := value), rank) AS x FROM h GROUP BY 1, 2),
w AS (SELECT o.*, x, CASE WHEN x.rank < 2 AND json_type(x.v) = 'OBJECT' THEN x.v END AS base FROM o LEFT JOIN b USING (profile_id, stable))
SELECT profile_id, 'page_' || stable AS key, 'set' AS action, md5('{{"remote":' || coalesce(json_extract(base, '$.remote')::VARCHAR, 'null') || ',"highlights":[{{"id":"' || length(url) || '"}}],"metadata":{{"createdAt":' || coalesce(json_extract_string(base, '$.metadata.createdAt'), '9') || ',"lastUpdated":9' || CASE WHEN x.rank > 0 THEN ',"migratedFrom":"' || x.src || '"' ELSE '' END || '}}}}') AS value_md5 FROM w
UNION ALL SELECT DISTINCT profile_id, key, 'remove', NULL FROM h WHERE key <> 'page_' || stable""",
}  # noqa: S608
