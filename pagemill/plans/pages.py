"""Registered queries over pages, blocks and documents, with their DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import blocks as bl
from pagemill.operators import pages as p
from pagemill.plans.tables import BLOCKS_SQL, derived


# Pages with figures, styled runs, links and nested lists, by page_id.
_ID = "CAST(page_id AS STRING)"
RICH_PAGES_SQL = f"""
SELECT page_id, url, CASE CAST(page_id % 4 AS INT) WHEN 0 THEN html WHEN 1 THEN replace(html, '</a></li><li>', '</a><ul><li>')
  WHEN 2 THEN replace(replace(replace(html, '<article>', '<article><figure><img src="https://img.example/' || {_ID} || '.jpg" alt="x"><figcaption> Fig ' || {_ID} || ' </figcaption></figure><hr>'), '<h1>', '<h4>'), '</h1>', '</h4>')
  ELSE replace(replace(replace(html, '.</p>', '.<em> Em</em><a href="https://l.example/' || {_ID} || '">Link</a></p>'), '<ul>', '<ol>'), '</ul>', '</ol>') END AS html FROM pages
"""  # noqa: S608
# Pages with code, technical containers, images, videos and advertisements, by page_id.
METRICS_SQL = f"""
SELECT page_id, replace(replace(html, '<article>', '<article class="post">' || CASE WHEN page_id % 2 = 0 THEN '<pre><code>c</code></pre>' ELSE '' END || CASE WHEN page_id % 3 = 0 THEN '<div class="x markdown-body"></div>' ELSE '' END || CASE WHEN page_id % 5 = 0 THEN '<img><img><video></video><iframe src="https://www.youtube.com/e"></iframe><iframe src="/x"></iframe>' ELSE '' END),
  '<footer>', CASE WHEN page_id % 7 = 0 THEN '<p class="ads">a</p><p class="advert">b</p><i class="sidebar x"></i>' ELSE '' END || '<footer>') AS html FROM pages
"""  # noqa: S608
BLANK_RUNS_SQL = "SELECT conv_id AS page_id, turn AS pos, CASE CAST(turn % 4 AS INT) WHEN 0 THEN ' ' WHEN 1 THEN '  ' || text || ' ' ELSE text || ' ' END AS text FROM conversations WHERE turn % 4 = 0 OR conv_id % 3 > 0"


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def b0_explode_nodes(spark, d):
    return p.explode_nodes(_pages(spark, d)).groupBy("tag").agg(F.count("*").alias("n"), F.countDistinct("page_id").alias("n_pages"))


def a8_page_metrics(spark, d):
    return p.page_metrics(p.explode_nodes(derived(spark, d, METRICS_SQL)))


def p16_select_extractor(spark, d):
    pg = _pages(spark, d)
    meta = p.classify_documentation(F.col("url"), F.lit(""))
    m = p.page_metrics(p.explode_nodes(pg)).join(pg.select("page_id", meta.alias("doc")), "page_id").withColumns({"is_doc_site": F.col("doc.is_doc"), "has_technical_content": F.col("doc.is_technical")})
    return p.select_extractor(p.page_complexity(m)).select("page_id", "extractor", "confidence", "fallback_required", F.array_join("reasons", ",").alias("reasons"))


def p14_classify_documentation(spark, d):
    url = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://docs.")).when(F.col("page_id") % 3 == 1, F.regexp_replace("url", "/(en|fr|de|es)/", "/guide/")).otherwise(F.col("url"))
    return _pages(spark, d).select("page_id", p.classify_documentation(url, F.lit(None).cast("string")).alias("c")).select("page_id", "c.host", "c.path", "c.is_doc", "c.is_technical")


def b1_extract_metadata(spark, d):
    pg = _pages(spark, d)
    return p.extract_metadata(pg, p.explode_nodes(pg)).select("page_id", "title")


def b5_html_to_blocks(spark, d):
    b = bl.html_to_blocks(derived(spark, d, RICH_PAGES_SQL))
    styles = lambda r: F.concat(*(F.when(r[x], x[0]).otherwise("") for x in bl.STYLES), F.coalesce(r["link"], F.lit("")))
    return b.select("page_id", "pos", "parent_pos", "depth", "type", F.md5(p.block_text()).alias("text_md5"), F.array_join(F.transform("rich_text", styles), "|").alias("styles"), "image_url", "caption")


def w7_batch_blocks(spark, d):
    return p.batch_blocks(derived(spark, d, BLOCKS_SQL), 3).select("page_id", "pos", "batch", "n_batches", "with_page")


def w8_highlight_section(spark, d):
    t = derived(spark, d, BLOCKS_SQL).withColumn("text", F.when(F.col("type") == "heading_3", F.lit("Highlights")).otherwise(F.col("text")))
    return p.highlight_section(t, "Highlights").select("page_id", "pos", "type")


def w9_merge_runs(spark, d):
    t = derived(spark, d, BLOCKS_SQL).withColumn("style", F.floor(F.col("pos") / 2))
    return p.merge_runs(t, ["style"]).select("page_id", F.col("run").cast("long").alias("run"), "style", "first_pos", F.md5("text").alias("text_md5"))


def w10_truncate_runs(spark, d):
    t = bl.truncate_runs(derived(spark, d, BLANK_RUNS_SQL), 300)
    return t.select("page_id", "pos", F.char_length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def f12_split_text(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(p.split_text(F.col("text"))).alias("pos", "chunk"))
    return t.select("doc_id", "pos", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def f13_chunk_fixed(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.posexplode(p.chunk_fixed(F.col("text"))).alias("pos", "chunk"))
    return t.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("chunk").alias("chunk_md5"))


def f14_text_to_paragraphs(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"))
    return t.select("doc_id", F.size(p.text_to_paragraphs(F.col("text"))).cast("long").alias("n_paragraphs"))


def j13_match_highlights(spark, d):
    pg = _pages(spark, d)
    blocks = bl.html_to_blocks(pg).select("page_id", "pos", p.block_text().alias("text"))
    own = blocks.where(F.char_length("text") >= 60)
    hl = own.select("page_id", F.concat(F.lit("h"), "pos").alias("id"), F.substr("text", F.lit(11), F.lit(25)).alias("text"), F.substr("text", F.lit(1), F.lit(10)).alias("prefix"), F.substr("text", F.lit(36), F.lit(20)).alias("suffix"))
    return p.match_highlights(blocks, hl)


def a7_technical_terms(spark, d):
    t = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", tx.technical_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.col("t.term_count").cast("long").alias("term_count"), F.col("t.word_count").cast("long").alias("word_count"), "t.is_technical")


QUERIES = {f.__name__: f for f in (b0_explode_nodes, a8_page_metrics, p16_select_extractor, p14_classify_documentation, b1_extract_metadata, b5_html_to_blocks, w7_batch_blocks, w8_highlight_section, w9_merge_runs, w10_truncate_runs, f12_split_text, a7_technical_terms, f13_chunk_fixed, f14_text_to_paragraphs, j13_match_highlights)}

_B = f"b AS ({BLOCKS_SQL})"
_N = lambda pattern: f"len(regexp_extract_all(b, '{pattern}'))"
# References of the pages as HTML reads them: each counts without its semicolon too, as where a title is cut within one.
_PLAIN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '&quot;?', '\"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g')"
_ELEMENT = "<li><a [^>]*>[^<]*|<h[14]>[^<]*|<p>(?:<b>)?[^<]+(?:<em> Em</em>)?|<figure>|<hr>"
_DOC = f"h AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS hst, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS pth FROM u), c AS (SELECT page_id, regexp_matches(hst, '{p.DOC_HOST}') AS host, regexp_matches(pth, '{p.DOC_PATH}') AS path, regexp_matches(url, '{p.TECH_URL}') AS tech FROM h)"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"
ORACLES = {
    "f12_split_text": f"""WITH RECURSIVE m AS (SELECT [chr(10) || chr(10), chr(10), '。', '.', '？', '?', '！', '!'] AS marks),
s AS (SELECT doc_id, 0 AS n, coalesce(text, '') AS rest, NULL::VARCHAR AS chunk, length(text) > 2000 AS long FROM documents
UNION ALL SELECT doc_id, n + 1, CASE WHEN length(rest) <= 2000 THEN NULL ELSE {_STRIP("substr(rest, cutoff + 1)")} END, CASE WHEN length(rest) <= 2000 THEN rest ELSE {_STRIP("substr(rest, 1, cutoff)")} END, long FROM (
  SELECT *, coalesce(list_filter(list_transform(marks, lambda x: CASE WHEN contains(substr(rest, 1, 1999 + length(x)), x) THEN length(substr(rest, 1, 1999 + length(x))) - instr(reverse(substr(rest, 1, 1999 + length(x))), x) + 1 - CASE WHEN length(substr(rest, 1, 1999 + length(x))) - instr(reverse(substr(rest, 1, 1999 + length(x))), x) + 1 - length(x) > 1000 THEN 0 ELSE 9999999 END ELSE -1 END), lambda y: y > 0)[1],
    CASE WHEN contains(substr(rest, 1, 2000), ' ') AND length(substr(rest, 1, 2000)) - instr(reverse(substr(rest, 1, 2000)), ' ') > 1000 THEN length(substr(rest, 1, 2000)) - instr(reverse(substr(rest, 1, 2000)), ' ') ELSE 2000 END) AS cutoff FROM s, m WHERE rest IS NOT NULL AND (n = 0 OR rest <> '')) q)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INT) AS pos, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM s WHERE chunk IS NOT NULL AND (chunk <> '' OR NOT coalesce(long, FALSE))""",
    "a8_page_metrics": f"""SELECT page_id, {_N('<div class="ad">')} + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS ad_elements, {_N("<(nav|footer|header|aside)>")} + CASE WHEN page_id % 7 = 0 THEN 1 ELSE 0 END AS nav_elements, {_N("<(article|main|section)[ >]")} AS content_elements, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END AS code_blocks,
CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS markdown_containers, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END AS images, CASE WHEN page_id % 5 = 0 THEN 2 ELSE 0 END AS videos, CAST(length(trim({_PLAIN.format(x="regexp_replace(regexp_extract(b, '<body>([\\s\\S]*)', 1), '<[^>]*>', '', 'g')")})) AS BIGINT) AS text_length FROM (SELECT page_id, html AS b FROM ({METRICS_SQL}) m) t""",
    "j13_match_highlights": f"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '[\\s\\S]*</head>', ''), '{_ELEMENT}')) AS x, generate_subscripts(regexp_extract_all(regexp_replace(html, '[\\s\\S]*</head>', ''), '{_ELEMENT}'), 1) - 1 AS pos FROM pages),
b AS (SELECT page_id, pos, substr(trim({_PLAIN.format(x="regexp_extract(x, '>([^<>]+)', 1)")}), 1, 2000) AS raw, regexp_replace(raw, '\\s+', ' ', 'g') AS f FROM e),
h AS (SELECT page_id, 'h' || pos AS id, trim(regexp_replace(substr(raw, 11, 25), '\\s+', ' ', 'g')) AS t, regexp_replace(substr(raw, 1, 10), '\\s+', ' ', 'g') AS p, regexp_replace(substr(raw, 36, 20), '\\s+', ' ', 'g') AS s FROM b WHERE length(raw) >= 60),
c AS (SELECT h.*, b.pos, b.f, unnest(list_filter(range(length(b.f)), lambda k: substr(b.f, k + 1, length(t)) = t)) AS k FROM h JOIN b ON b.page_id = h.page_id AND t <> '' AND contains(b.f, t)),
d AS (SELECT *, substr(f, greatest(0, k - length(p)) + 1, least(k, length(p))) AS l, substr(f, k + length(t) + 1, length(s)) AS r FROM c),
g AS (SELECT *, CASE WHEN p = '' THEN 0 WHEN ends_with(l, p) THEN 2 WHEN ends_with(l, right(p, 10)) THEN 1 ELSE 0 END + CASE WHEN s = '' THEN 0 WHEN starts_with(r, s) THEN 2 WHEN starts_with(r, substr(s, 1, 10)) THEN 1 ELSE 0 END AS score FROM d),
o AS (SELECT page_id, id, pos, any_value(length(t)) AS n, count(*) AS hits, max(score) AS best, arg_min(k, struct_pack(a := -score, b := k)) AS k, any_value(p || s) AS context FROM g GROUP BY 1, 2, 3),
w AS (SELECT *, row_number() OVER (PARTITION BY page_id, id ORDER BY pos) AS rn FROM o WHERE CASE WHEN hits = 1 THEN n >= 50 OR context = '' OR best > 0 ELSE best > 0 OR context = '' END)
SELECT page_id, id AS highlight_id, CAST(pos AS INT) AS pos, CAST(k AS INT) AS start, CAST(n AS INT) AS length FROM w WHERE rn = 1""",
    "b0_explode_nodes": "WITH t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[\\s>/]', 1)) AS tag FROM pages) SELECT tag, count(*) AS n, count(DISTINCT page_id) AS n_pages FROM t GROUP BY tag",
    "b1_extract_metadata": f"SELECT page_id, trim({_PLAIN.format(x="regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1)")}) AS title FROM pages",
    "p14_classify_documentation": f"WITH u AS (SELECT page_id, lower(CASE WHEN page_id % 3 = 0 THEN replace(url, '://', '://docs.') WHEN page_id % 3 = 1 THEN regexp_replace(url, '/(en|fr|de|es)/', '/guide/', 'g') ELSE url END) AS url FROM pages), {_DOC} SELECT page_id, host, path, host OR path OR tech AS is_doc, tech AS is_technical FROM c",
    "p16_select_extractor": f"""WITH u AS (SELECT page_id, lower(url) AS url FROM pages), {_DOC},
m AS (SELECT page_id, {_N('<div class="ad">')} AS ads, {_N("<(nav|footer|header|aside)>")} AS nav, {_N("<(article|main|section)>")} AS content, length(trim({_PLAIN.format(x="regexp_replace(regexp_extract(b, '<body>([\\s\\S]*)', 1), '<[^>]*>', '', 'g')")})) AS n FROM (SELECT page_id, html AS b FROM pages) t),
f AS (SELECT m.*, host OR path OR tech OR ads <= 2 AND nav <= 3 AND content >= 1 AS clean, tech, ads > 3 AS has_ads, nav > 5 OR content > 0 AND nav / greatest(content, 1) > 3 AS busy, n > 5000 AS long_form FROM m JOIN c USING (page_id)),
g AS (SELECT *, has_ads OR busy OR long_form AS readable FROM f)
SELECT page_id, CASE WHEN readable THEN 'readability' ELSE 'markdown' END AS extractor,
CAST(greatest(0, least(100, CASE WHEN readable THEN 50 + CASE WHEN has_ads THEN 20 ELSE 0 END + CASE WHEN busy THEN 15 ELSE 0 END + CASE WHEN long_form THEN 10 ELSE 0 END - CASE WHEN clean AND NOT has_ads THEN 15 ELSE 0 END
ELSE 50 + CASE WHEN clean THEN 20 ELSE 0 END + CASE WHEN tech THEN 15 ELSE 0 END END)) AS INT) AS confidence, n < 500 OR has_ads AND tech AS fallback_required,
CASE WHEN readable THEN concat_ws(',', CASE WHEN has_ads THEN 'ads' END, CASE WHEN busy THEN 'complex layout' END, CASE WHEN long_form THEN 'long form' END) ELSE concat_ws(',', CASE WHEN clean THEN 'clean page' END, CASE WHEN tech THEN 'technical content' END) END AS reasons FROM g""",
    "w7_batch_blocks": f"WITH {_B}, k AS (SELECT page_id, pos, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM b) SELECT page_id, pos, rn // 3 AS batch, CAST(ceil(n / 3.0) AS BIGINT) AS n_batches, rn < 3 AS with_page FROM k",
    "w8_highlight_section": f"WITH {_B}, s AS (SELECT page_id, min(pos) AS a FROM b WHERE type = 'heading_3' GROUP BY 1), e AS (SELECT b.page_id, min(pos) AS z FROM b JOIN s ON s.page_id = b.page_id WHERE type = 'heading_3' AND pos > a GROUP BY 1) SELECT b.page_id, b.pos, b.type FROM b JOIN s ON s.page_id = b.page_id LEFT JOIN e ON e.page_id = b.page_id WHERE pos >= a AND (z IS NULL OR pos < z)",
    "w9_merge_runs": f"WITH {_B}, k AS (SELECT *, pos // 2 AS style FROM b) SELECT page_id, dense_rank() OVER (PARTITION BY page_id ORDER BY style) AS run, style, min(pos) AS first_pos, md5(string_agg(text, '' ORDER BY pos)) AS text_md5 FROM k GROUP BY page_id, style",
    "w10_truncate_runs": f"""WITH r AS ({BLANK_RUNS_SQL}), m AS (SELECT *, min(CASE WHEN trim(text) <> '' THEN pos END) OVER p AS a, max(CASE WHEN trim(text) <> '' THEN pos END) OVER p AS z FROM r WINDOW p AS (PARTITION BY page_id)),
k AS (SELECT page_id, pos, CASE WHEN a IS NULL OR pos < a OR pos > z THEN '' WHEN a = z THEN trim(text) WHEN pos = a THEN ltrim(text) WHEN pos = z THEN rtrim(text) ELSE text END AS text FROM m),
c AS (SELECT page_id, pos, substr(text, 1, CAST(greatest(0, 300 - coalesce(sum(length(text)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS BIGINT)) AS t FROM k),
e AS (SELECT page_id, pos, CASE WHEN sum(length(t)) OVER (PARTITION BY page_id) = 0 AND pos = min(pos) OVER (PARTITION BY page_id) THEN ' ' ELSE t END AS t FROM c) SELECT page_id, pos, length(t) AS n_chars, md5(t) AS text_md5 FROM e WHERE t <> ''""",
    "b5_html_to_blocks": f"""WITH r AS ({RICH_PAGES_SQL}), e AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '[\\s\\S]*</head>', ''), '{_ELEMENT}')) AS x, generate_subscripts(regexp_extract_all(regexp_replace(html, '[\\s\\S]*</head>', ''), '{_ELEMENT}'), 1) - 1 AS pos FROM r),
k AS (SELECT page_id, CAST(pos AS INT) AS pos, page_id % 4 = 1 AND starts_with(x, '<li') AS nest, CASE WHEN starts_with(x, '<li') THEN CASE WHEN page_id % 4 = 3 THEN 'numbered' ELSE 'bulleted' END || '_list_item' WHEN starts_with(x, '<h1') THEN 'heading_1' WHEN starts_with(x, '<fig') THEN 'image' WHEN x = '<hr>' THEN 'divider' ELSE 'paragraph' END AS type,
  x LIKE '%<b>%' OR x LIKE '<h4%' AS bold, contains(x, '<em> Em</em>') AS em, trim({_PLAIN.format(x="regexp_extract(x, '>([^<>]+)', 1)")}) AS t FROM e)
SELECT page_id, pos, CASE WHEN nest AND pos > 0 THEN least(pos, 2) - 1 END AS parent_pos, CASE WHEN nest THEN least(pos, 2) ELSE 0 END AS depth, type, md5(CASE WHEN type IN ('image', 'divider') THEN '' WHEN em THEN substr(t || ' EmLink', 1, 2000) ELSE substr(t, 1, 2000) END) AS text_md5,
  CASE WHEN type IN ('image', 'divider') THEN '' WHEN bold THEN 'b' ELSE '' END || CASE WHEN em AND length(t) < 2000 THEN '|i' || CASE WHEN length(t) < 1997 THEN '|https://l.example/' || {_ID} ELSE '' END ELSE '' END AS styles,
  CASE WHEN type = 'image' THEN 'https://img.example/' || {_ID} || '.jpg' END AS image_url, CASE WHEN type = 'image' THEN 'Fig ' || {_ID} END AS caption FROM k""",
    "f13_chunk_fixed": "WITH k AS (SELECT doc_id, text, unnest(range(least(100, CAST(ceil(length(text) / 2000.0) AS BIGINT)))) AS pos FROM documents) SELECT doc_id, pos, md5(substr(text, pos * 2000 + 1, 2000)) AS chunk_md5 FROM k",
    "f14_text_to_paragraphs": "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ' || chr(9) || chr(13) || chr(11) || chr(12))) >= 10)) AS BIGINT) AS n_paragraphs FROM documents",
    "a7_technical_terms": "WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), n AS (SELECT doc_id, CAST(len(regexp_extract_all(lower(x), '\\b(?:" + "|".join(tx.TECHNICAL_WORDS) + ")\\b')) + len(regexp_extract_all(x, '\\bGo\\b')) + len(regexp_extract_all(lower(x), '(?:^|[^a-z0-9_])c\\+\\+(?:$|[^a-z0-9])')) AS BIGINT) AS term_count, CAST(len(regexp_extract_all(x, '[^\\x00-\\x20\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+')) AS BIGINT) AS word_count FROM t) SELECT doc_id, term_count, word_count, term_count > 10 OR term_count / greatest(word_count, 1)::DOUBLE > 0.02 AS is_technical FROM n",
}
