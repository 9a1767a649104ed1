"""Registered queries over URLs, stores and backups, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls as u
from pagemill.operators import backup as b
from pagemill.operators import store as s
from pagemill.plans.tables import BACKUP_SQL, STORE_SQL, derived, stored

_RE = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
_TRACK = ", ".join(f"'{p}'" for p in u.TRACKING_PARAMS)


def sql_norm(c: str) -> str:
    """DuckDB expression of the normal form."""
    part = lambda k: f"regexp_extract({c}, '{_RE}', {k})"
    pairs = f"list_transform(list_filter(string_split(substr({part(4)}, 2), '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({_TRACK})), lambda x: replace(CASE WHEN contains(x, '=') THEN x ELSE x || '=' END, '%20', '+'))"
    path = f"CASE WHEN {part(3)} = '' THEN '/' ELSE regexp_replace({part(3)}, '(.)/+$', '\\1') END"
    query = f"array_to_string({pairs}, '&')"
    return f"(CASE WHEN {c} IS NULL THEN '' WHEN {part(2)} = '' THEN {c} ELSE lower({part(1)}) || '://' || lower({part(2)}) || {path} || CASE WHEN {query} = '' THEN '' ELSE '?' || {query} END END)"


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def _store(spark, d):
    return stored(spark, d, STORE_SQL)


def _backup(spark, d):
    return stored(spark, d, BACKUP_SQL)


def f1_normalize_url(spark, d):
    return _pages(spark, d).select("page_id", u.normalize_url("url").alias("normal_url"))


def f2_stable_url(spark, d):
    site = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://www.hk01.com/news/"), F.col("page_id"), F.lit("/title-"), F.col("page_id"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://news.mingpao.com/article/20240101/s"), F.col("page_id"), F.lit("/some-title?utm_source=x"))).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", site.alias("u")).select("page_id", u.stable_url("u").alias("stable"))


def f3_stable_url_from_route(spark, d):
    q = F.create_map(F.lit("category"), F.lit("news"), F.lit("id"), F.col("page_id").cast("string"), F.lit("slug"), F.when(F.col("page_id") % 4 == 0, F.lit("12")).otherwise(F.lit("a-title")))
    return _pages(spark, d).select("page_id", u.stable_url_from_route(F.lit("/[category]/[id]/[slug]"), q, F.col("url")).alias("stable"))


def f4_resolve_storage_url(spark, d):
    short = F.when(F.col("page_id") % 5 == 0, F.concat(u.origin_of("url"), F.lit("/?p="), F.col("page_id")))
    return _pages(spark, d).select("page_id", u.resolve_storage_url("url", shortlink=short).alias("storage_url"))


def f5_extract_domain(spark, d):
    return _pages(spark, d).select("page_id", u.extract_domain("url").alias("domain"))


def p4_p8_url_predicates(spark, d):
    root = F.when(F.col("page_id") % 3 == 0, F.concat(u.origin_of("url"), F.lit("/"))).otherwise(F.col("url"))
    t = _pages(spark, d).select("page_id", root.alias("url"))
    return t.select("page_id", u.is_root_url("url").alias("is_root"), u.is_safe_stable_url("url").alias("is_safe"), u.is_safe_stable_url("url", True).alias("is_safe_normal"), u.is_valid_alias("url").alias("is_alias"), u.has_same_origin("url", F.concat(F.lit("https://"), u.host_of("url"), F.lit("/x"))).alias("same_https_origin"), u.is_http_url("url").alias("is_http"), u.is_remote_url("url", ["example.org"]).alias("is_remote"))


def p9_filter_restricted(spark, d):
    t = _pages(spark, d).select("page_id", F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("view-source:"), "url")).when(F.col("page_id") % 4 == 1, F.lit("about:blank")).otherwise(F.col("url")).alias("url"))
    return u.filter_restricted(t)


def w0_latest_page_per_url(spark, d):
    """Least page_id of each canonical url, and how many pages share it."""
    t = _pages(spark, d).select("page_id", u.normalize_url("url").alias("canonical"))
    return t.groupBy("canonical").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"))


def p1_filter_backup_keys(spark, d):
    return s.filter_backup_keys(_store(spark, d)).select("profile_id", "key")


def p2_route_keys(spark, d):
    return s.route_keys(_store(spark, d)).select("profile_id", "key", "kind", "url")


def p3_corrupted_pages(spark, d):
    return s.route_keys(_store(spark, d)).where("kind = 'page'").select("profile_id", "url", s.is_corrupted_page(F.col("value")).alias("corrupted"))


def j1_resolve_canonical(spark, d):
    st = _store(spark, d)
    urls = s.route_keys(st).where("kind in ('page', 'highlights', 'saved')").select("profile_id", "url").distinct()
    return s.resolve_canonical(urls, s.aliases(st))


def j2_lookup_highlights(spark, d):
    st = _store(spark, d)
    urls = s.route_keys(st).where("url is not null").select("profile_id", "url")
    return s.lookup_highlights(urls, st).select("profile_id", "url", "found_key", F.json_array_length("highlights").cast("long").alias("n"))


def j3_unify_page_state(spark, d):
    t = s.unify_page_state(_store(spark, d))
    return t.select("profile_id", "url", F.col("remote.page_id").alias("remote_page_id"), F.col("remote.title").alias("title"), F.json_array_length("highlights").cast("long").alias("n_highlights"))


def u1_all_highlights(spark, d):
    return s.all_highlights(_store(spark, d)).select("profile_id", "url", F.json_array_length("highlights").cast("long").alias("n"))


def u2_all_saved_urls(spark, d):
    return s.all_saved_urls(_store(spark, d))


def w1_group_owner(spark, d):
    return s.pick_group_owner(_store(spark, d)).select("profile_id", "canonical", "owner_url", "owner_kind", F.col("n_highlights").cast("long").alias("n_highlights"))


def t1_unsynced_pages(spark, d):
    return s.unsynced_pages(_store(spark, d)).select("profile_id", "url", "title", F.col("n_highlights").cast("long").alias("n_highlights"), "last_updated", F.col("place").cast("long").alias("place"))


def t2_order_keys(spark, d):
    """Keys of each profile with their natural-order place by digit runs."""
    from pyspark.sql import Window as W

    t = _store(spark, d).where("key like 'migration%' or key like '_v1%'")
    return t.select("profile_id", "key", F.row_number().over(W.partitionBy("profile_id").orderBy(s.order_key("key"), "key")).cast("long").alias("place"))


def j4_diff_backup(spark, d):
    return b.diff_backup(_backup(spark, d), _store(spark, d)).select("profile_id", "key", "status")


def j5_import_plan(spark, d):
    return b.import_plan("overwrite-all", _backup(spark, d), _store(spark, d)).select("profile_id", "key", "action", "status")


def a12_import_counts(spark, d):
    return b.import_counts(b.import_plan("new-only", _backup(spark, d), _store(spark, d)))


def u4_keys_only_local(spark, d):
    return b.keys_only_local(_store(spark, d), _backup(spark, d))


def u5_shared_keys(spark, d):
    return b.shared_keys(_backup(spark, d), _store(spark, d))


def a1_storage_health(spark, d):
    return b.storage_health(_store(spark, d))


def a2_cleanup_plan(spark, d):
    return b.cleanup_plan(_store(spark, d)).select("profile_id", "key", "size", "reason")


def a2_cleanup_summary(spark, d):
    return b.cleanup_summary(_store(spark, d))


def j8_find_orphans(spark, d):
    return b.find_orphans(_store(spark, d)).select("profile_id", "key")


QUERIES = {f.__name__: f for f in (f1_normalize_url, f2_stable_url, f3_stable_url_from_route, f4_resolve_storage_url, f5_extract_domain, p4_p8_url_predicates, p9_filter_restricted, w0_latest_page_per_url, p1_filter_backup_keys, p2_route_keys, p3_corrupted_pages, j1_resolve_canonical, j2_lookup_highlights, j3_unify_page_state, u1_all_highlights, u2_all_saved_urls, w1_group_owner, t1_unsynced_pages, t2_order_keys, j4_diff_backup, j5_import_plan, a12_import_counts, u4_keys_only_local, u5_shared_keys, a1_storage_health, a2_cleanup_plan, a2_cleanup_summary, j8_find_orphans)}

# ---- DuckDB

_HOST = "lower(regexp_extract({c}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_ORIGIN = "lower(regexp_extract({c}, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1))"
_PATH = "CASE WHEN regexp_extract({c}, '" + _RE + "', 3) = '' THEN '/' ELSE regexp_extract({c}, '" + _RE + "', 3) END"
_ROUTED = f"""st AS ({STORE_SQL}), r AS (
  SELECT *, CASE WHEN key LIKE 'page\\_%' ESCAPE '\\' THEN 'page' WHEN key LIKE 'highlights\\_%' ESCAPE '\\' THEN 'highlights' WHEN key LIKE 'saved\\_%' ESCAPE '\\' THEN 'saved'
    WHEN key LIKE 'url\\_alias:%' ESCAPE '\\' THEN 'alias' WHEN starts_with(key, 'migration_') OR starts_with(key, '_v1_') OR starts_with(key, '_backup_') THEN 'leftover'
    WHEN starts_with(key, 'config_') OR contains(key, 'notion') THEN 'config' ELSE 'other' END AS kind,
  CASE WHEN starts_with(key, 'page_') THEN substr(key, 6) WHEN starts_with(key, 'highlights_') THEN substr(key, 12) WHEN starts_with(key, 'saved_') THEN substr(key, 7) WHEN starts_with(key, 'url_alias:') THEN substr(key, 11) END AS url
  FROM st), al AS (SELECT profile_id, url, json_extract_string(value, '$') AS target FROM r WHERE kind = 'alias' AND url <> '' AND json_type(value) = 'VARCHAR' AND json_extract_string(value, '$') <> ''),
bad AS (SELECT *, NOT (json_type(value) = 'OBJECT' AND coalesce(json_type(value, '$.highlights'), '') = 'ARRAY') AS corrupted FROM r WHERE kind = 'page'),
leg AS (SELECT *, CASE WHEN json_type(value) = 'ARRAY' THEN json_array_length(value) WHEN json_type(value) = 'OBJECT' AND json_type(value, '$.highlights') = 'ARRAY' THEN json_array_length(value, '$.highlights') END AS n FROM r WHERE kind = 'highlights')"""
_SIZE = "(strlen(to_json([key])::VARCHAR) + strlen(value) + 1)"
_CLEAN = f"""items AS (
  SELECT profile_id, key, {_SIZE} AS size, 'corrupted' AS reason FROM bad WHERE corrupted
  UNION ALL SELECT profile_id, key, {_SIZE}, 'empty' FROM bad WHERE NOT corrupted AND json_array_length(value, '$.highlights') = 0 AND coalesce(json_extract_string(value, '$.remote.pageId'), '') = ''
  UNION ALL SELECT profile_id, key, {_SIZE}, 'corrupted' FROM leg WHERE n IS NULL
  UNION ALL SELECT profile_id, key, {_SIZE}, 'orphan' FROM leg WHERE n = 0 AND NOT EXISTS (SELECT 1 FROM r x WHERE x.kind = 'saved' AND x.url = leg.url AND x.profile_id = leg.profile_id) AND NOT EXISTS (SELECT 1 FROM bad x WHERE NOT x.corrupted AND x.url = leg.url AND x.profile_id = leg.profile_id)
  UNION ALL SELECT profile_id, key, {_SIZE}, 'orphan' FROM r a WHERE kind = 'alias' AND NOT EXISTS (SELECT 1 FROM r x WHERE x.kind IN ('page', 'highlights', 'saved') AND x.url = json_extract_string(a.value, '$') AND x.profile_id = a.profile_id)
  UNION ALL SELECT profile_id, key, {_SIZE}, 'leftover' FROM r WHERE kind = 'leftover')"""
_DIFF = f"""st AS ({STORE_SQL}), bk AS (SELECT * FROM ({BACKUP_SQL}) z WHERE starts_with(key, 'page_') OR starts_with(key, 'highlights_') OR starts_with(key, 'saved_') OR starts_with(key, 'url_alias:')),
d AS (SELECT bk.profile_id, bk.key, CASE WHEN st.key IS NULL THEN 'new' WHEN st.value = bk.value THEN 'identical' ELSE 'conflict' END AS status FROM bk LEFT JOIN st ON st.profile_id = bk.profile_id AND st.key = bk.key),
gone AS (SELECT profile_id, key FROM st WHERE (starts_with(key, 'page_') OR starts_with(key, 'highlights_') OR starts_with(key, 'saved_') OR starts_with(key, 'url_alias:')) AND NOT EXISTS (SELECT 1 FROM ({BACKUP_SQL}) y WHERE y.profile_id = st.profile_id AND y.key = st.key))"""
_ROOTED = "(SELECT page_id, CASE WHEN page_id % 3 = 0 THEN " + _ORIGIN.format(c="url") + " || '/' ELSE url END AS url FROM pages)"
_IS_ROOT = "(" + _PATH.format(c="url") + " = '/' AND NOT regexp_matches(url, '^[^?#]*\\?[^#]'))"
_LOOKUP = f"""okal AS (SELECT profile_id, url, target FROM al WHERE length(target) >= 10 AND regexp_matches(target, '^https?://[^/?#]+/.+')),
us AS (SELECT DISTINCT profile_id, url, {sql_norm('url')} AS norm FROM r WHERE url IS NOT NULL),
k AS (SELECT us.profile_id, us.url, us.norm, coalesce(a.target, c.target, us.norm) AS stable FROM us LEFT JOIN okal a ON a.profile_id = us.profile_id AND a.url = us.norm LEFT JOIN okal c ON c.profile_id = us.profile_id AND c.url = us.url),
w AS (SELECT profile_id, url, 0 AS rank, 'page_' || stable AS key FROM k UNION ALL SELECT profile_id, url, 1, 'page_' || norm FROM k UNION ALL SELECT profile_id, url, 2, 'highlights_' || stable FROM k UNION ALL SELECT profile_id, url, 3, 'highlights_' || norm FROM k),
held AS (SELECT profile_id, key, json_array_length(value, '$.highlights') AS n FROM bad WHERE NOT corrupted UNION ALL SELECT profile_id, key, n FROM leg WHERE n IS NOT NULL),
best AS (SELECT w.profile_id, w.url, arg_min(w.key, rank) AS found_key, arg_min(n, rank) AS n FROM w JOIN held ON held.profile_id = w.profile_id AND held.key = w.key GROUP BY ALL)"""
_OWNERS = """cand AS (SELECT x.profile_id, x.ordinal, x.key, x.kind, x.url, x.value, x.n, coalesce(al.target, x.url) AS canonical FROM (
    SELECT profile_id, ordinal, key, kind, url, value, json_array_length(value, '$.highlights') AS n FROM bad WHERE NOT corrupted AND json_extract_string(value, '$.remote') IS NULL
    UNION ALL SELECT profile_id, ordinal, key, kind, url, value, n FROM leg WHERE n IS NOT NULL) x LEFT JOIN al ON al.profile_id = x.profile_id AND al.url = x.url WHERE x.n > 0 AND NOT """ + _IS_ROOT.replace("url", "x.url") + """),
own AS (SELECT *, row_number() OVER (PARTITION BY profile_id, canonical ORDER BY CASE WHEN kind = 'page' AND url = canonical THEN 0 WHEN kind = 'page' THEN 1 ELSE 2 END, ordinal, key) AS rn FROM cand)"""

ORACLES = {
    "f1_normalize_url": f"SELECT page_id, {sql_norm('url')} AS normal_url FROM pages",
    "f2_stable_url": "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://www.hk01.com/news/' || page_id WHEN page_id % 3 = 1 THEN 'https://news.mingpao.com/article/20240101/s' || page_id END AS stable FROM pages",
    "f3_stable_url_from_route": "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN " + _ORIGIN.format(c="url") + " || '/news/' || page_id END AS stable FROM pages",
    "f4_resolve_storage_url": "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN " + _ORIGIN.format(c="url") + " || '/?p=' || page_id ELSE " + sql_norm("url") + " END AS storage_url FROM pages",
    "f5_extract_domain": "SELECT page_id, " + _HOST.format(c="url") + " AS domain FROM pages",
    "p4_p8_url_predicates": f"SELECT page_id, {_IS_ROOT} AS is_root, NOT {_IS_ROOT.replace('url', 'n')} AS is_safe, NOT {_IS_ROOT.replace('url', 'n')} AND n = url AS is_safe_normal, length(url) >= 10 AND NOT {_IS_ROOT.replace('url', 'n')} AS is_alias, starts_with(url, 'https://') AS same_https_origin, TRUE AS is_http, starts_with(url, 'https://') AND ({_HOST.format(c='url')} = 'example.org' OR ends_with({_HOST.format(c='url')}, '.example.org')) AS is_remote FROM (SELECT *, {sql_norm('url')} AS n FROM {_ROOTED} x) y",
    "p9_filter_restricted": "SELECT page_id, url FROM pages WHERE page_id % 4 > 1",
    "w0_latest_page_per_url": f"SELECT {sql_norm('url')} AS canonical, min(page_id) AS page_id, count(*) AS n_pages FROM pages GROUP BY 1",
    "p1_filter_backup_keys": f"WITH {_ROUTED} SELECT profile_id, key FROM r WHERE kind IN ('page', 'highlights', 'saved', 'alias')",
    "p2_route_keys": f"WITH {_ROUTED} SELECT profile_id, key, kind, url FROM r",
    "p3_corrupted_pages": f"WITH {_ROUTED} SELECT profile_id, url, corrupted FROM bad",
    "j1_resolve_canonical": f"WITH {_ROUTED}, us AS (SELECT DISTINCT profile_id, url FROM r WHERE kind IN ('page', 'highlights', 'saved')) SELECT us.profile_id, us.url, coalesce(al.target, us.url) AS canonical FROM us LEFT JOIN al ON al.profile_id = us.profile_id AND al.url = us.url",
    "j2_lookup_highlights": f"WITH {_ROUTED}, {_LOOKUP} SELECT us.profile_id, us.url, best.found_key, CAST(best.n AS BIGINT) AS n FROM us LEFT JOIN best ON best.profile_id = us.profile_id AND best.url = us.url",
    "j3_unify_page_state": f"""WITH {_ROUTED}, u AS (SELECT profile_id, url FROM r WHERE kind = 'page' AND json_type(value) = 'OBJECT' UNION SELECT profile_id, url FROM r WHERE kind = 'saved' UNION SELECT profile_id, url FROM leg WHERE n > 0),
      j AS (SELECT u.profile_id, u.url, p.value AS pv, s.value AS sv, leg.n AS ln FROM u LEFT JOIN r p ON p.kind = 'page' AND json_type(p.value) = 'OBJECT' AND p.profile_id = u.profile_id AND p.url = u.url LEFT JOIN r s ON s.kind = 'saved' AND s.profile_id = u.profile_id AND s.url = u.url LEFT JOIN leg ON leg.n > 0 AND leg.profile_id = u.profile_id AND leg.url = u.url)
      SELECT profile_id, url, coalesce(json_extract_string(pv, '$.remote.pageId'), json_extract_string(sv, '$.pageId')) AS remote_page_id, coalesce(json_extract_string(pv, '$.remote.title'), json_extract_string(sv, '$.title')) AS title,
      CAST(CASE WHEN json_type(pv, '$.highlights') = 'ARRAY' AND json_array_length(pv, '$.highlights') > 0 THEN json_array_length(pv, '$.highlights') ELSE coalesce(ln, 0) END AS BIGINT) AS n_highlights FROM j""",
    "u1_all_highlights": f"WITH {_ROUTED} SELECT profile_id, url, CAST(json_array_length(value, '$.highlights') AS BIGINT) AS n FROM bad WHERE NOT corrupted UNION ALL SELECT profile_id, url, CAST(n AS BIGINT) FROM leg WHERE n IS NOT NULL AND NOT EXISTS (SELECT 1 FROM bad WHERE NOT corrupted AND bad.profile_id = leg.profile_id AND bad.url = leg.url)",
    "u2_all_saved_urls": f"WITH {_ROUTED} SELECT profile_id, url FROM r WHERE kind = 'saved' UNION SELECT profile_id, url FROM r WHERE kind = 'page' AND json_extract_string(value, '$.remote') IS NOT NULL",
    "w1_group_owner": f"WITH {_ROUTED}, {_OWNERS} SELECT profile_id, canonical, url AS owner_url, kind AS owner_kind, CAST(n AS BIGINT) AS n_highlights FROM own WHERE rn = 1",
    "t1_unsynced_pages": f"""WITH {_ROUTED}, {_OWNERS}, o AS (SELECT own.*, s.key AS skey FROM own LEFT JOIN r s ON s.kind = 'saved' AND s.profile_id = own.profile_id AND s.url = own.url WHERE rn = 1 AND (own.kind = 'page' OR s.key IS NULL)),
      l AS (SELECT profile_id, url, {_HOST.format(c='url')} AS title, CAST(n AS BIGINT) AS n_highlights, coalesce(CAST(json_extract_string(value, '$.metadata.lastUpdated') AS DOUBLE), 0) AS last_updated, ordinal FROM o),
      m AS (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY last_updated DESC, ordinal) AS place FROM l) SELECT profile_id, url, title, n_highlights, last_updated, place FROM m WHERE place <= 10""",
    "t2_order_keys": f"WITH {_ROUTED} SELECT profile_id, key, row_number() OVER (PARTITION BY profile_id ORDER BY CASE WHEN starts_with(key, '_v1') THEN 0 ELSE 1 END, CAST(regexp_extract(key, '([0-9]+)$', 1) AS BIGINT)) AS place FROM r WHERE kind = 'leftover'",
    "j4_diff_backup": f"WITH {_DIFF} SELECT * FROM d",
    "j5_import_plan": f"WITH {_DIFF} SELECT profile_id, key, CASE WHEN status = 'identical' THEN 'skip' ELSE 'write' END AS action, status FROM d UNION ALL SELECT profile_id, key, 'remove', 'local' FROM gone",
    "a12_import_counts": f"WITH {_DIFF} SELECT profile_id, count_if(status = 'new') AS n_new, 0::BIGINT AS n_overwrite, count_if(status = 'identical') AS n_identical, count_if(status = 'conflict') AS n_conflict_skipped, 0::BIGINT AS n_removed, count_if(status = 'new') > 0 AS has_work FROM d GROUP BY 1",
    "u4_keys_only_local": f"WITH {_DIFF} SELECT * FROM gone",
    "u5_shared_keys": f"WITH {_DIFF} SELECT DISTINCT profile_id, key FROM d WHERE status <> 'new'",
    "a1_storage_health": f"""WITH {_ROUTED}, {_CLEAN}, al1 AS (SELECT profile_id, sum({_SIZE} - 2) + count(*) + 1 AS used FROM r GROUP BY 1)
      SELECT profile_id, CAST(used AS BIGINT) AS used_bytes, round(used / 1048576.0, 2) AS used_mb, round(least(used / 104857600.0 * 100, 100.0), 1) AS percentage,
      (SELECT count(*) FROM bad WHERE NOT corrupted AND bad.profile_id = a.profile_id) + (SELECT count(*) FROM leg WHERE n IS NOT NULL AND leg.profile_id = a.profile_id AND NOT EXISTS (SELECT 1 FROM bad WHERE NOT corrupted AND bad.profile_id = leg.profile_id AND bad.url = leg.url)) AS pages,
      CAST(coalesce((SELECT sum(json_array_length(value, '$.highlights')) FROM bad WHERE NOT corrupted AND bad.profile_id = a.profile_id), 0) + coalesce((SELECT sum(n) FROM leg WHERE leg.profile_id = a.profile_id AND NOT EXISTS (SELECT 1 FROM bad WHERE NOT corrupted AND bad.profile_id = leg.profile_id AND bad.url = leg.url)), 0) AS BIGINT) AS highlights,
      (SELECT count(*) FROM r WHERE kind = 'config' AND r.profile_id = a.profile_id) AS configs, (SELECT count(*) FROM r WHERE kind = 'leftover' AND r.profile_id = a.profile_id) AS migration_keys,
      CAST(coalesce((SELECT sum(size) FROM items WHERE reason = 'leftover' AND items.profile_id = a.profile_id), 0) AS BIGINT) AS migration_bytes, (SELECT count(*) FROM r WHERE kind = 'saved' AND r.profile_id = a.profile_id) AS legacy_saved,
      (SELECT count(*) FROM items WHERE reason = 'corrupted' AND items.profile_id = a.profile_id) AS corrupted FROM al1 a""",
    "a2_cleanup_plan": f"WITH {_ROUTED}, {_CLEAN} SELECT * FROM items",
    "a2_cleanup_summary": f"WITH {_ROUTED}, {_CLEAN} SELECT profile_id, reason, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM items GROUP BY profile_id, reason UNION ALL SELECT profile_id, NULL, count(*), CAST(sum(size) AS BIGINT) FROM items GROUP BY profile_id",
    "j8_find_orphans": f"WITH {_ROUTED}, {_CLEAN} SELECT profile_id, key FROM items WHERE reason = 'orphan'",
}
