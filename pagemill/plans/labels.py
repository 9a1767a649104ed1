"""Registered queries over images, labels, titles and lists of highlights, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import images as im
from pagemill.functions import text as tx
from pagemill.operators import images as io
from pagemill.operators import migration as m
from pagemill.operators import pages as p
from pagemill.operators import store as s
from pagemill.operators import sync as y
from pagemill.operators import textsearch as ts
from pagemill.plans.tables import STORE_SQL, derived, stored

# Every page gets images at its end: by place, their markup, the url they come to, and their status.
_ID = "CAST(page_id AS STRING)"
IMAGES = [
    (f"""'<a href="https://img.example/full/' || {_ID} || '.jpg"><img src="/thumb.gif"></a>'""", f"'https://img.example/full/' || {_ID} || '.jpg'", "accepted"),
    (f"""'<img srcset="https://img.example/a' || {_ID} || '.png 300w, https://img.example/b' || {_ID} || '.png 800w">'""", f"'https://img.example/b' || {_ID} || '.png'", "accepted"),
    (f"""'<img data-src="http://img.example/uploads/' || {_ID} || '?w=1&amp;w=2" width="600" height="400">'""", f"'https://img.example/uploads/' || {_ID} || '?w=1'", "accepted"),
    (f"""'<img src="https://img.example/s' || {_ID} || '.jpg" width="100" height="50">'""", f"'https://img.example/s' || {_ID} || '.jpg'", "small"),
    (f"""'<img src="https://cdn.signed.example/' || {_ID} || '.png?token-hash=a">'""", f"'https://cdn.signed.example/' || {_ID} || '.png?token-hash=a'", "temporary"),
    ("""'<img src="data:image/png;base64,x"><img>'""", "CAST(NULL AS STRING)", "no_source"),
    (f"""'<picture><source srcset="https://img.example/full/' || {_ID} || '.jpg 2x"><img src="/blank.png"></picture>'""", f"'https://img.example/full/' || {_ID} || '.jpg'", "duplicate"),
]
_SHOWN = [f"page_id % {k + 2} <> 1" for k in range(len(IMAGES))]  # pages that have the image of that place
PAGES_SQL = "SELECT page_id, url, html || " + " || ".join(f"CASE WHEN {c} THEN {x[0]} ELSE '' END" for c, x in zip(_SHOWN, IMAGES)) + " AS html FROM pages"  # noqa: S608
SIGNED = ["signed.example"]


def _images(spark, d):
    return io.extract_images(p.element_table(derived(spark, d, PAGES_SQL)), SIGNED)


def b8_extract_images(spark, d):
    return _images(spark, d).select("page_id", "url", "status")


def a9_image_metrics(spark, d):
    return io.image_metrics(_images(spark, d))


def w6_select_images(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos"), F.col("l_partkey").cast("string").alias("url"), "l_returnflag")
    return io.select_images(t.where("l_returnflag = 'N'"), t.withColumn("gallery", (F.col("page_id") % 5 == 0) & (F.col("pos") == 2)))


def f6_p10_image_urls(spark, d):
    n = F.col("page_id")
    raw = (
        F.when(n % 8 == 0, F.concat(F.lit(" //img.example/a b/"), n, F.lit(".jpg"))).when(n % 8 == 1, F.concat(F.lit("https://site.example/_next/image?url=%2Fmedia%2F"), n, F.lit(".png&w=640")))
        .when(n % 8 == 2, F.concat(F.lit("https://proxy.example/gw/?u=http%3A%2F%2Fimg.example%2F"), n, F.lit(".webp"))).when(n % 8 == 3, F.concat(F.lit("https://img.example/(x)/"), n, F.lit(".png?a=1&a=2&b=")))
        .when(n % 8 == 4, F.concat(F.lit("https://www.inmediahk.net/files/"), n, F.lit("?itok=q"))).when(n % 8 == 5, F.concat(F.lit("/static/"), n)).when(n % 8 == 6, F.concat(F.lit("ftp://img.example/"), n, F.lit(".png"))).otherwise("data:image/png;base64,x")
    )
    t = spark.read.parquet(f"{d}/pages.parquet").select("page_id", raw.alias("raw")).withColumn("clean", im.clean_image_url(F.col("raw")))
    return t.select("page_id", "clean", im.is_valid_image_url(F.col("raw"), F.col("clean")).alias("valid"))


def f24_classify_error(spark, d):
    n = F.col("event_id") % 12
    texts = ["Rate limit hit", "Request timed out", "fetch failed", "Invalid API key", "Permission denied", "Image upload refused", "Database access denied", "database is gone", "Internal server error", "保存失敗", "odd", "Object Not Found"]
    message = F.coalesce(*(F.when(n == k, F.lit(x)) for k, x in enumerate(texts)))
    code = F.when(F.col("event_id") % 7 == 0, "validation_error").when(F.col("event_id") % 7 == 1, F.col("event_type"))
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", tx.classify_error(code, message).alias("error"))


def f22_f28_highlight_style(spark, d):
    n = F.col("p_partkey")
    background = F.when(n % 5 == 0, "rgb(212, 237, 218)").when(n % 5 == 1, "#cce7ff").when(n % 5 == 2, "#f8d7da").when(n % 5 == 3, "#123456")
    style = F.when(n % 4 == 0, "COLOR_SYNC").when(n % 4 == 1, "COLOR_TEXT").when(n % 4 == 2, "BOLD").otherwise("NONE")
    t = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", style.alias("style"), tx.map_color(background).alias("color"))
    return t.select("p_partkey", "color", tx.highlight_annotation(F.col("style"), F.col("color")).alias("annotation"))


def f23_code_language(spark, d):
    n = F.col("p_partkey")
    hint = F.coalesce(*(F.when(n % 6 == k, F.lit(x)) for k, x in enumerate([" PY ", "c++", "tsx", "yml", "klingon"])))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", tx.map_code_language(hint).alias("language"))


def f16_f17_f26_titles(spark, d):
    t = F.col("text")
    made = tx.format_title(F.lit("{title} - {lang} {date}"), {"title": F.substr(t, F.lit(1), F.lit(12)), "lang": F.col("lang"), "date": F.lit(None).cast("string")})
    named = tx.is_title_consistent(F.when(F.col("doc_id") % 3 == 0, "abc").when(F.col("doc_id") % 3 == 1, F.substr(t, F.lit(3), F.lit(30))).otherwise("no such title here"), t)
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", made.alias("title"), named.alias("consistent"), tx.truncate(t, 50).alias("preview"))


def f18_f19_icons_and_srcsets(spark, d):
    n = F.col("p_partkey")
    size = F.when(n % 4 == 0, "any").when(n % 4 == 1, F.concat(n, F.lit("x16"))).when(n % 4 == 2, "large")
    srcset = F.when(n % 3 == 0, F.concat(F.lit("/a"), n, F.lit(".png 1x, /b"), n, F.lit(".png 2x"))).when(n % 3 == 1, F.concat(F.lit("/a.png 300w, /b"), n, F.lit(".png 200w"))).otherwise("/a.png, data:image/png;base64,x")
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", p.parse_icon_size(size).cast("long").alias("icon_size"), p.best_srcset_url(srcset).alias("best_url"))


def p19_f31_f29_destinations(spark, d):
    n = F.col("o_orderkey")
    page = F.when(n % 4 != 0, F.concat(F.lit("ab-"), n))
    saved, wanted = F.when(n % 3 == 0, "work"), F.when(n % 2 == 0, "work").otherwise("default")
    often = F.when(n % 5 == 0, "daily").when(n % 5 == 1, "weekly").otherwise("monthly")
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", y.needs_new_page(page, saved, wanted).alias("new_page"), tx.remote_url(page, F.when(n % 7 == 0, "https://r.example/x"), "https://remote.example/").alias("remote_url"), y.next_eligible_at(often, F.col("o_orderdate").cast("timestamp")).cast("date").cast("string").alias("next_day"))


# Highlights of a store of which some wait for their range and some have failed.
FLAGGED_SQL = f"""SELECT profile_id, ordinal, key, replace(replace(value, '"id":"h1"', '"id":"h1","migrationFailed":true'), '"color":"blue"', '"color":"blue","needsRangeInfo":true') AS value FROM ({STORE_SQL}) f"""  # noqa: S608


def a13_pending_lists(spark, d):
    t = m.pending_lists(stored(spark, d, FLAGGED_SQL))
    return t.select("profile_id", "url", *(F.col(c).cast("long").alias(c) for c in ("total", "pending", "failed")))


def p20_drop_failed_highlights(spark, d):
    t = m.drop_failed_highlights(s.all_highlights(stored(spark, d, FLAGGED_SQL)))
    return t.select("profile_id", "url", F.col("n_removed").cast("long").alias("n_removed"), F.json_array_length("highlights").cast("long").alias("n_kept"))


def j15_merge_unique_images(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    image = lambda k: F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("https://img.example/"), F.col(k) % 3))
    rows = lambda k: t.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("pos"), F.when(image(k).isNull(), "paragraph").otherwise("image").alias("type"), image(k).alias("image_url"))
    return p.merge_unique_images(rows("l_partkey").where("pos < 4"), rows("l_suppkey"))


def j14_find_text(spark, d):
    """The start of each document's text in the text written twice: the first time without context, the second with."""
    t = spark.read.parquet(f"{d}/documents.parquet").where("doc_id is not null and text is not null").select(F.col("doc_id").alias("page_id"), "text")
    own = F.substr("text", F.lit(1), F.lit(40))
    q = t.select("page_id", F.explode(F.array(*(F.struct(F.lit(k).alias("query_id"), own.alias("text"), before.alias("prefix"), F.lit(None).cast("string").alias("suffix")) for k, before in (("first", F.lit(None).cast("string")), ("second", F.lit("|")))))).alias("q")).select("page_id", "q.*")
    return ts.find_text_in_pages(t.select("page_id", F.concat("text", F.lit("|"), "text").alias("text")), q).select("page_id", "query_id", "start")


def j20_w12_migrate_inline(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("page_id"), "text")
    part = lambda a, n: F.substr("text", F.lit(a), F.lit(n))
    bare = F.regexp_extract(F.to_json(F.array(part(1, 20))), r"^\[([\s\S]*)\]$", 1)
    items = F.array(bare, F.lit('{"content":"|never in a text|","color":"#fff3cd"}'), F.to_json(F.struct(part(5, 12).alias("text"), F.lit("#cce7ff").alias("bgColor"))), F.lit("7"))
    m_ = ts.migrate_inline(t.select("page_id", F.posexplode(items).alias("pos", "item")), t, F.lit(100))
    return m_.select("page_id", "id", "color", F.col("start").isNotNull().alias("found"))


def j10_batch_migrate(spark, d):
    st = stored(spark, d, STORE_SQL)
    pairs = s.route_keys(st).where("kind in ('page', 'highlights')").select("profile_id", F.col("url").alias("legacy_url")).distinct()
    stable = F.when(F.char_length("legacy_url") % 4 > 0, F.concat(F.lit("https://stable.example/p/"), F.char_length("legacy_url")))
    t = m.batch_migrate(st, pairs.withColumn("stable_url", stable))
    return t.select("profile_id", "legacy_url", "status", "reason", "report_url", F.col("n_highlights").cast("long").alias("n_highlights"), F.col("n_pending").cast("long").alias("n_pending"), F.regexp_count("highlights", F.lit('"needsRangeInfo":true')).cast("long").alias("n_marked"))


QUERIES = {f.__name__: f for f in (b8_extract_images, a9_image_metrics, w6_select_images, f6_p10_image_urls, f24_classify_error, f22_f28_highlight_style, f23_code_language, f16_f17_f26_titles, f18_f19_icons_and_srcsets, p19_f31_f29_destinations, a13_pending_lists, p20_drop_failed_highlights, j15_merge_unique_images, j14_find_text, j20_w12_migrate_inline, j10_batch_migrate)}

_ROWS = " UNION ALL ".join(f"SELECT page_id, {x[1]} AS url, '{'duplicate' if x[2] == 'duplicate' else x[2]}' AS status, {_SHOWN[0]} AS has_first FROM pages WHERE {c}" for c, x in zip(_SHOWN, IMAGES))
_ROWS += f" UNION ALL SELECT page_id, NULL, 'no_source', TRUE FROM pages WHERE {_SHOWN[5]}"  # the place of no source has two elements
_IMG = f"(SELECT page_id, url, CASE WHEN status = 'duplicate' AND NOT has_first THEN 'accepted' ELSE status END AS status FROM ({_ROWS}) r)"
_LISTS = f"""st AS ({FLAGGED_SQL}), pg AS (SELECT profile_id, substr(key, 6) AS url, json_extract(value, '$.highlights') AS l FROM st WHERE starts_with(key, 'page_') AND json_type(value) = 'OBJECT' AND coalesce(json_type(value, '$.highlights'), '') = 'ARRAY'),
lg AS (SELECT profile_id, substr(key, 12) AS url, CASE WHEN json_type(value) = 'ARRAY' THEN value::JSON ELSE json_extract(value, '$.highlights') END AS l FROM st WHERE starts_with(key, 'highlights_')),
al AS (SELECT * FROM pg UNION ALL SELECT * FROM lg WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.profile_id = lg.profile_id AND pg.url = lg.url)),
n AS (SELECT profile_id, url, CAST(json_array_length(l) AS BIGINT) AS total, CAST(len(list_filter(json_extract(l, '$[*]'), lambda x: coalesce(json_extract_string(x, '$.migrationFailed'), '') = 'true')) AS BIGINT) AS failed,
  CAST(len(list_filter(json_extract(l, '$[*]'), lambda x: coalesce(json_extract_string(x, '$.migrationFailed'), '') <> 'true' AND coalesce(json_extract_string(x, '$.needsRangeInfo'), '') = 'true')) AS BIGINT) AS pending FROM al)"""
_MOVES = f"""st AS ({STORE_SQL}), lg AS (SELECT profile_id, substr(key, 12) AS url, CASE WHEN json_type(value) = 'ARRAY' THEN value::JSON WHEN json_type(value, '$.highlights') = 'ARRAY' THEN json_extract(value, '$.highlights') END AS l FROM st WHERE starts_with(key, 'highlights_')),
pg AS (SELECT profile_id, substr(key, 6) AS url, json_extract(value, '$.highlights') AS l FROM st WHERE starts_with(key, 'page_') AND json_type(value) = 'OBJECT' AND json_type(value, '$.highlights') = 'ARRAY'),
us AS (SELECT profile_id, url FROM lg UNION SELECT profile_id, substr(key, 6) FROM st WHERE starts_with(key, 'page_')),
k AS (SELECT us.*, lg.l, coalesce(json_array_length(lg.l), 0) AS n, coalesce(json_array_length(pg.l), 0) AS held, CASE WHEN length(us.url) % 4 > 0 THEN 'https://stable.example/p/' || length(us.url) END AS stable FROM us LEFT JOIN lg ON lg.profile_id = us.profile_id AND lg.url = us.url LEFT JOIN pg ON pg.profile_id = us.profile_id AND pg.url = us.url),
f AS (SELECT profile_id, stable, min(url) AS first_url FROM k WHERE stable IS NOT NULL AND (n > 0 OR held > 0) GROUP BY 1, 2)"""
ORACLES = {
    "j14_find_text": """WITH t AS (SELECT doc_id AS page_id, text, length(text) - length(ltrim(text, ' ' || chr(9) || chr(10) || chr(13))) AS lead FROM documents WHERE doc_id IS NOT NULL AND trim(substr(text, 1, 40), ' ' || chr(9) || chr(10) || chr(13)) <> '')
      SELECT page_id, 'first' AS query_id, lead AS start FROM t UNION ALL SELECT page_id, 'second', CASE WHEN lead > 0 THEN lead ELSE length(text) + 1 END FROM t""",
    "j20_w12_migrate_inline": """WITH t AS (SELECT doc_id, trim(coalesce(substr(text, 1, 20), ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AS a, trim(coalesce(substr(text, 5, 12), ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AS b FROM documents)
      SELECT doc_id AS page_id, 'h100' AS id, 'yellow' AS color, a AS found FROM t UNION ALL SELECT doc_id, 'h101', 'yellow', FALSE FROM t UNION ALL SELECT doc_id, 'h102', 'blue', b FROM t UNION ALL SELECT doc_id, 'h103', 'yellow', FALSE FROM t""",
    "j10_batch_migrate": f"""WITH {_MOVES} SELECT k.profile_id, url AS legacy_url, CASE WHEN n > 0 THEN 'success' ELSE 'skipped' END AS status, CASE WHEN l IS NULL THEN 'no_data' WHEN n = 0 THEN 'no_highlights' END AS reason, CASE WHEN n > 0 AND k.stable IS NOT NULL AND f.first_url = url THEN k.stable ELSE url END AS report_url, CAST(n AS BIGINT) AS n_highlights,
      CASE WHEN n > 0 THEN CAST(len(list_filter(json_extract(l, '$[*]'), lambda x: json_extract(x, '$.rangeInfo') IS NULL)) AS BIGINT) ELSE 0 END AS n_pending, CASE WHEN n > 0 THEN CAST(len(list_filter(json_extract(l, '$[*]'), lambda x: json_extract(x, '$.rangeInfo') IS NULL)) AS BIGINT) END AS n_marked FROM k LEFT JOIN f ON f.profile_id = k.profile_id AND f.stable = k.stable""",
    "b8_extract_images": f"SELECT * FROM {_IMG} q",
    "a9_image_metrics": f"SELECT page_id, count(*) AS candidates, count_if(status <> 'no_source') AS url_valid, count_if(status = 'small') AS filtered_by_size, count_if(status = 'temporary') AS temporary, count_if(status = 'accepted') AS final FROM {_IMG} q GROUP BY page_id",
    "w6_select_images": """WITH t AS (SELECT l_orderkey AS page_id, l_linenumber AS pos, CAST(l_partkey AS VARCHAR) AS url, l_returnflag FROM lineitem), c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) AS rn FROM t WHERE l_returnflag = 'N'),
      n AS (SELECT page_id, count(*) AS n FROM c GROUP BY 1), e AS (SELECT t.*, row_number() OVER (PARTITION BY page_id ORDER BY pos, url) AS rn, page_id % 5 = 0 AND max(CASE WHEN pos = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id) = 1 AS g FROM t),
      b AS (SELECT page_id, 0 AS k, pos, url FROM c WHERE rn <= 6 UNION ALL SELECT e.page_id, 1, pos, url FROM e LEFT JOIN n ON n.page_id = e.page_id WHERE coalesce(n, 0) < 2 AND rn <= CASE WHEN g THEN 6 ELSE 2 END)
      SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k, pos, url) AS place, url, CASE WHEN k = 0 THEN 'content' ELSE 'extra' END AS part FROM b""",
    "f6_p10_image_urls": "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://img.example/a%20b/' || page_id || '.jpg' WHEN 1 THEN 'https://site.example/media/' || page_id || '.png' WHEN 2 THEN 'https://img.example/' || page_id || '.webp' WHEN 3 THEN 'https://img.example/%28x%29/' || page_id || '.png?a=1&b=' WHEN 4 THEN 'https://www.inmediahk.net/files/' || page_id WHEN 5 THEN '/static/' || page_id END AS clean, page_id % 8 < 6 AS valid FROM pages",
    "f24_classify_error": "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN CASE WHEN event_id % 12 = 5 THEN 'IMAGE_VALIDATION_ERROR' ELSE 'VALIDATION_ERROR' END WHEN event_id % 7 = 1 AND event_type <> '' THEN upper(event_type) ELSE ['RATE_LIMITED', 'TIMEOUT', 'NETWORK_ERROR', 'INVALID_API_KEY_FORMAT', 'INTEGRATION_FORBIDDEN', 'VALIDATION_ERROR', 'DATABASE_ACCESS_DENIED', 'MISSING_DATA_SOURCE', 'INTERNAL_SERVER_ERROR', '保存失敗', 'UNKNOWN_ERROR', 'MISSING_PAGE_ID'][event_id % 12 + 1] END AS error FROM events",
    "f22_f28_highlight_style": "WITH c AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'green' WHEN 1 THEN 'blue' WHEN 2 THEN 'red' ELSE 'yellow' END AS color FROM part) SELECT p_partkey, color, CASE p_partkey % 4 WHEN 0 THEN color || '_background' WHEN 1 THEN color WHEN 2 THEN 'bold' END AS annotation FROM c",
    "f23_code_language": "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'python' WHEN 1 THEN 'c++' WHEN 2 THEN 'typescript' WHEN 3 THEN 'yaml' END AS language FROM part",
    "f16_f17_f26_titles": """SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN '{title}' ELSE substr(text, 1, 12) END || ' - ' || CASE WHEN coalesce(lang, '') = '' THEN '{lang}' ELSE lang END || ' {date}' AS title,
      CASE WHEN doc_id % 3 = 0 OR coalesce(text, '') = '' THEN TRUE WHEN doc_id % 3 = 1 THEN length(trim(substr(text, 3, 30), ' ')) <= 4 OR contains(lower(text), lower(substr(trim(substr(text, 3, 30), ' '), 1, 15))) ELSE contains(lower(text), 'no such title h') END AS consistent,
      CASE WHEN length(text) > 50 THEN substr(text, 1, 50) || '…' ELSE text END AS preview FROM documents""",
    "f18_f19_icons_and_srcsets": "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 999 WHEN 1 THEN p_partkey ELSE 0 END AS icon_size, CASE p_partkey % 3 WHEN 0 THEN '/b' || p_partkey || '.png' ELSE '/a.png' END AS best_url FROM part",
    "p19_f31_f29_destinations": "SELECT o_orderkey, o_orderkey % 4 = 0 OR (o_orderkey % 3 = 0) <> (o_orderkey % 2 = 0) AS new_page, CASE WHEN o_orderkey % 4 <> 0 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'https://r.example/x' ELSE 'https://remote.example/ab' || o_orderkey END END AS remote_url, CAST(CAST(o_orderdate AS DATE) + CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 ELSE 30 END AS VARCHAR) AS next_day FROM orders",
    "a13_pending_lists": f"WITH {_LISTS} SELECT profile_id, url, total, pending, failed FROM n WHERE pending > 0 OR failed > 0",
    "p20_drop_failed_highlights": f"WITH {_LISTS} SELECT profile_id, url, failed AS n_removed, total - failed AS n_kept FROM n WHERE total IS NOT NULL",
    "j15_merge_unique_images": """WITH x AS (SELECT l_orderkey AS page_id, l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN 'https://img.example/' || (l_suppkey % 3) END AS image_url FROM lineitem), c AS (SELECT l_orderkey AS page_id, 'https://img.example/' || (l_partkey % 3) AS image_url FROM lineitem WHERE l_linenumber % 2 = 0 AND l_linenumber < 4),
      f AS (SELECT page_id, image_url, min(pos) AS pos FROM x WHERE image_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.page_id = x.page_id AND c.image_url = x.image_url) GROUP BY 1, 2)
      SELECT page_id, pos, 'paragraph' AS type, image_url FROM x WHERE image_url IS NULL UNION ALL SELECT page_id, pos, 'image', image_url FROM f""",
}
