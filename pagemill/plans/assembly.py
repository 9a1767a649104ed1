"""Registered queries over main content, styled highlights, lead blocks and payloads, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import assembly as a
from pagemill.operators import content as c
from pagemill.operators import pages as p
from pagemill.operators import structured as st
from pagemill.plans.tables import BLOCKS_SQL, derived

# Pages whose article stands in another container, by page_id.
_SWAPS = [("<article>", "</article>"), ('<div class="x post-content">', "</div>"), ("<section>", "</section>"), ("<center>", "</center>"), ('<div class="node__content"><div class="field--name-field-body">', "</div></div>")]
CONTAINERS_SQL = "SELECT page_id, url, CASE CAST(page_id % 5 AS INT) " + " ".join(f"WHEN {k} THEN replace(replace(html, '<article>', '{x}'), '</article>', '{y}')" for k, (x, y) in enumerate(_SWAPS)) + " END AS html FROM pages"  # noqa: S608
TECHNICAL_SQL = """SELECT page_id, replace(CASE WHEN page_id % 2 = 0 THEN replace(html, '<div class="ad">', '<div class="prose md-content">') ELSE html END, '<footer>', CASE WHEN page_id % 3 = 0 THEN '<footer id="readme">' ELSE '<footer>' END) AS html FROM pages"""
SPANS_SQL = f"""
SELECT page_id, pos, 10 AS start, 25 AS length, 'a' AS annotation FROM ({BLOCKS_SQL}) x UNION ALL
SELECT page_id, pos, 5, 10, 'b' FROM ({BLOCKS_SQL}) y UNION ALL
SELECT page_id, pos, 60, 20, 'c' FROM ({BLOCKS_SQL}) z WHERE page_id % 2 = 1
"""  # noqa: S608
LEAD_BLOCKS_SQL = f"""
SELECT page_id, pos, CASE WHEN pos % 3 = 2 THEN 'image' WHEN pos % 2 = 0 THEN 'heading_1' ELSE 'paragraph' END AS type, CASE WHEN pos % 3 = 2 THEN NULL ELSE text END AS text,
  CASE WHEN pos % 3 = 2 THEN 'https://img.example/' || CAST(page_id AS STRING) || '.jpg' END AS image_url FROM ({BLOCKS_SQL}) b
"""  # noqa: S608
LEADS_SQL = f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN min(CASE WHEN pos = 0 THEN text END) WHEN page_id % 3 = 1 THEN 'Title ' || CAST(page_id AS STRING) END AS title,
  CASE WHEN page_id % 4 > 0 THEN 'https://img.example/' || CAST(page_id AS STRING) || '.jpg' END AS featured_image FROM ({BLOCKS_SQL}) b GROUP BY page_id
UNION ALL SELECT DISTINCT -1 - page_id, 'No blocks', NULL FROM ({BLOCKS_SQL}) c WHERE page_id % 10 = 0
"""  # noqa: S608
PAYLOAD_PAGES_SQL = """
SELECT page_id, CASE WHEN page_id % 7 > 0 THEN url END AS url, CASE WHEN page_id % 5 > 0 THEN 'Title ' || CAST(page_id AS STRING) ELSE '' END AS title, 'src' || CAST(page_id % 2 AS STRING) AS source_id, CASE WHEN page_id % 2 = 0 THEN 'page' ELSE 'database' END AS source_type,
  CASE WHEN page_id % 3 = 0 THEN url || '/icon.png' END AS site_icon,
  CASE CAST(page_id % 4 AS INT) WHEN 0 THEN url || '/cover.jpg' WHEN 1 THEN 'https://a.signed.example/c.png?token-hash=1' WHEN 2 THEN 'data:image/png;base64,x' END AS cover_image FROM pages
"""
PAYLOAD_BLOCKS_SQL = f"SELECT CAST(floor(page_id / 40) AS BIGINT) AS page_id, (page_id % 40) * 1000 + pos AS pos, type, text FROM ({BLOCKS_SQL}) b"  # noqa: S608
_N = "CAST(page_id AS STRING)"
_LIST = f"""'[{{"blockType":"heading","text":"Title ' || {_N} || '"}},{{"blockType":"text","text":"Text <b>' || {_N} || '</b>"}},{{"blockType":"text"}},{{"blockType":"image","image":{{"url":"https://img.example/' || {_N} || '"}}}},{{"blockType":"odd","text":" x "}}]'"""
DATA_SQL = f"""
SELECT page_id, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN '{{"props":{{"pageProps":{{"pageData":{{"blocks":3}},"post":{{"blocks":' || {_LIST} || '}}}}}}}}'
  WHEN 1 THEN '{{"initialArticle":{{"body":"<p>Body ' || {_N} || '</p>"}},"props":{{"pageProps":{{"post":{{"body":"later"}}}}}}}}'
  WHEN 2 THEN '{{"props":{{"pageProps":{{"article":{{"content":{{"model":{{"blocks":' || {_LIST} || '}}}}}}}}}}}}'
  WHEN 3 THEN '{{"other":{{"blocks":[]}}}}' WHEN 4 THEN '{{"broken":' END AS data FROM pages
"""  # noqa: S608
RUNS = [(1, 20), (21, 30), (51, 2**30)]


def _nodes(spark, d, sql):
    return p.element_table(derived(spark, d, sql))


def _rich(blocks):
    """blocks with their text in up to three runs of 20, 30 and the other characters."""
    none = F.lit(None).cast("string").alias("annotation")
    runs = F.array(*(F.struct(F.substr("text", F.lit(x), F.lit(n)).alias("content"), F.lit(f"s{x}").alias("style"), none) for x, n in RUNS))
    return blocks.withColumn("rich_text", F.filter(runs, lambda r: r["content"] != ""))


def _pieces(blocks, *columns):
    t = blocks.select("page_id", F.col("pos").cast("long").alias("pos"), *columns, F.posexplode("rich_text").alias("piece", "r"))
    return t.select("page_id", "pos", *columns, F.col("piece").cast("long").alias("piece"), F.md5("r.content").alias("content_md5"), "r.annotation")


def b2_main_container(spark, d):
    return c.main_container(_nodes(spark, d, CONTAINERS_SQL)).select("page_id", "strategy", "tag")


def w3_best_content_container(spark, d):
    t = c.subtree_counts(_nodes(spark, d, "SELECT page_id, html FROM pages"), ("p", "img", "a"), ("article", "section", "main", "div"))
    return c.best_content_container(t).select("page_id", "tag", "score", "emergency")


def b4_markdown_container(spark, d):
    return c.markdown_container(_nodes(spark, d, TECHNICAL_SQL)).select("page_id", "tag")


def w5_style_spans(spark, d):
    return _pieces(a.style_spans(_rich(derived(spark, d, BLOCKS_SQL)), derived(spark, d, SPANS_SQL), ["style"]))


def b9_merge_highlights(spark, d):
    blocks = derived(spark, d, BLOCKS_SQL).withColumn("text", F.regexp_replace("text", r"\s+", " "))
    colors = F.when(F.col("pos") % 2 == 0, "green").otherwise("blue")
    hl = blocks.where(F.char_length("text") >= 60).select("page_id", F.concat(F.lit("h"), F.col("pos").cast("string")).alias("id"), F.col("pos").alias("ordinal"), F.substr("text", F.lit(11), F.lit(25)).alias("text"), colors.alias("color"), *(F.lit(None).cast("string").alias(x) for x in ("prefix", "suffix")))
    return _pieces(a.merge_highlights(_rich(blocks), hl, "COLOR_SYNC", ["style"]), "type")


def b13_assemble_blocks(spark, d):
    t = a.assemble_blocks(derived(spark, d, LEAD_BLOCKS_SQL), derived(spark, d, LEADS_SQL), include_title=True)
    return t.select("page_id", F.col("pos").cast("long").alias("pos"), "type", F.md5("text").alias("text_md5"), "image_url")


def b10_build_page_payload(spark, d):
    t = a.build_page_payload(derived(spark, d, PAYLOAD_PAGES_SQL), derived(spark, d, PAYLOAD_BLOCKS_SQL), ["signed.example"])
    texts = F.array_join(F.transform("children", lambda x: F.coalesce(x["text"], F.lit(""))), "|")
    return t.select("page_id", F.col("parent.type").alias("parent_type"), F.col("parent.id").alias("parent_id"), "properties.title", "properties.url", "icon", "cover", F.size("children").cast("long").alias("n_children"), F.md5(texts).alias("children_md5"))


def f27_json_first_path(spark, d):
    t = derived(spark, d, DATA_SQL).select("page_id", st.json_first_path(F.col("data")).alias("f"))
    return t.select("page_id", "f.path")


def b7_structured_to_blocks(spark, d):
    t = derived(spark, d, DATA_SQL).select("page_id", st.json_first_path(F.col("data")).alias("f"))
    return st.structured_to_blocks(t.select("page_id", "f.article")).withColumn("pos", F.col("pos").cast("long"))


QUERIES = {f.__name__: f for f in (b2_main_container, w3_best_content_container, b4_markdown_container, w5_style_spans, b9_merge_highlights, b13_assemble_blocks, b10_build_page_payload, f27_json_first_path, b7_structured_to_blocks)}

_LEN = lambda x: f"length(trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&(?:quot|copy|middot|amp);?', 'x', 'g')))"
_TEXTS = f"""t AS (SELECT page_id, regexp_extract(html, '<article>([\\s\\S]*)</article>', 1) AS body, regexp_extract(html, '<div class="ad">([\\s\\S]*?)</div>', 1) AS ad, len(regexp_extract_all(html, '<li>')) AS n_li FROM pages),
l AS (SELECT *, {_LEN("body")} AS n, {_LEN("ad")} AS n_ad FROM t)"""
_CHARS = "ch AS (SELECT page_id, pos, text, unnest(range(length(text))) AS k FROM b)"
_RUN = "CASE WHEN k < 20 THEN 0 WHEN k < 50 THEN 1 ELSE 2 END"
_CUT = """e AS (SELECT *, CASE WHEN lag(k) OVER w IS NULL OR run <> lag(run) OVER w OR span IS DISTINCT FROM lag(span) OVER w THEN 1 ELSE 0 END AS cut FROM m WINDOW w AS (PARTITION BY page_id, pos ORDER BY k)),
f AS (SELECT *, sum(cut) OVER (PARTITION BY page_id, pos ORDER BY k) - 1 AS piece FROM e),
pieces AS (SELECT page_id, pos, CAST(piece AS BIGINT) AS piece, md5(substr(min(text), min(k) + 1, count(*))) AS content_md5, min(annotation) AS annotation FROM f GROUP BY page_id, pos, piece)"""
ORACLES = {
    "b2_main_container": f"WITH {_TEXTS}, s AS (SELECT page_id, CASE WHEN page_id % 5 = 4 THEN 'drupal' WHEN page_id % 5 = 1 AND n >= 250 THEN 'cms' WHEN page_id % 5 = 0 AND n >= 250 THEN 'article' WHEN page_id % 5 = 2 AND n >= 250 THEN 'generic' WHEN n_ad >= 125 OR n >= 125 AND page_id % 5 <> 3 THEN 'emergency' WHEN n_li >= 4 THEN 'list' END AS strategy, n_ad FROM l) "
    "SELECT page_id, strategy, CASE WHEN strategy IN ('drupal', 'cms') THEN 'div' WHEN strategy = 'article' THEN 'article' WHEN strategy = 'list' THEN 'ul' WHEN strategy = 'emergency' AND n_ad >= 125 THEN 'div' WHEN page_id % 5 = 2 THEN 'section' WHEN page_id % 5 = 0 THEN 'article' ELSE 'div' END AS tag FROM s WHERE strategy IS NOT NULL",
    "w3_best_content_container": f"WITH {_TEXTS}, s AS (SELECT page_id, n, n_ad, n + 50 * len(regexp_extract_all(body, '<p>')) + 30 * len(regexp_extract_all(body, '<img')) - 25 * len(regexp_extract_all(body, '<a ')) AS a, n_ad - 25 * len(regexp_extract_all(ad, '<a ')) AS d FROM l) SELECT page_id, CASE WHEN n >= 250 OR n_ad < 125 THEN 'article' ELSE 'div' END AS tag, CAST(CASE WHEN n >= 250 OR n_ad < 125 THEN a ELSE d END AS BIGINT) AS score, n < 250 AS emergency FROM s WHERE n >= 125 OR n_ad >= 125",
    "b4_markdown_container": "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'div' ELSE 'footer' END AS tag FROM pages WHERE page_id % 2 = 0 OR page_id % 3 = 0",
    "w5_style_spans": f"WITH b AS ({BLOCKS_SQL}), {_CHARS}, m AS (SELECT *, {_RUN} AS run, CASE WHEN k >= 5 AND k < 15 THEN 'b' WHEN k >= 10 AND k < 35 THEN 'a' WHEN page_id % 2 = 1 AND k >= 60 AND k < 80 THEN 'c' END AS span, span AS annotation FROM ch), {_CUT} SELECT * FROM pieces",
    "b9_merge_highlights": f"""WITH b AS (SELECT page_id, pos, type, regexp_replace(text, '\\s+', ' ', 'g') AS text FROM ({BLOCKS_SQL}) x),
h AS (SELECT page_id, pos AS hp, substr(text, 11, 25) AS t, CASE WHEN pos % 2 = 0 THEN 'green' ELSE 'blue' END AS color FROM b WHERE length(text) >= 60),
hit AS (SELECT h.page_id, hp, color, arg_min(struct_pack(pos := b.pos, s := instr(b.text, trim(t)) - 1, e := instr(b.text, trim(t)) - 1 + length(trim(t))), b.pos) AS x FROM h JOIN b ON b.page_id = h.page_id AND contains(b.text, trim(t)) GROUP BY ALL),
{_CHARS}, cov AS (SELECT ch.page_id, ch.pos, k, min(struct_pack(s := x.s, e := x.e, a := color || '_background')) AS span FROM ch JOIN hit ON hit.page_id = ch.page_id AND x.pos = ch.pos AND k >= x.s AND k < x.e GROUP BY ALL),
m AS (SELECT ch.*, {_RUN} AS run, span, span.a AS annotation FROM ch LEFT JOIN cov USING (page_id, pos, k)), {_CUT},
last AS (SELECT page_id, max(pos) + 1 AS nx FROM b GROUP BY 1)
SELECT b.page_id, CAST(b.pos AS BIGINT) AS pos, type, piece, content_md5, annotation FROM pieces JOIN b USING (page_id, pos)
UNION ALL SELECT DISTINCT h.page_id, CAST(nx AS BIGINT), 'heading_3', 0, md5('{a.SECTION}'), 'default' FROM h JOIN last USING (page_id)
UNION ALL SELECT h.page_id, CAST(nx + row_number() OVER (PARTITION BY h.page_id ORDER BY hp) AS BIGINT), 'paragraph', 0, md5(t), color FROM h JOIN last USING (page_id)""",
    "b13_assemble_blocks": f"""WITH b AS ({LEAD_BLOCKS_SQL}), l AS ({LEADS_SQL}), o AS (
SELECT page_id, 2 AS part, pos, type, text, image_url FROM b
UNION ALL SELECT page_id, 2, 0, 'paragraph', '{a.NO_BLOCKS}', NULL FROM l WHERE page_id NOT IN (SELECT page_id FROM b)
UNION ALL SELECT page_id, 0, 0, 'image', NULL, featured_image FROM l WHERE featured_image IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.page_id = l.page_id AND b.type = 'image' AND b.image_url = featured_image)
UNION ALL SELECT page_id, 1, 0, 'heading_1', substr(title, 1, 2000), NULL FROM l WHERE title IS NOT NULL AND title <> '' AND NOT EXISTS (SELECT 1 FROM b WHERE b.page_id = l.page_id AND b.type = 'heading_1' AND b.text = substr(title, 1, 2000)))
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY part, pos) - 1 AS pos, type, md5(text) AS text_md5, image_url FROM o""",
    "b10_build_page_payload": f"""WITH b AS ({PAYLOAD_BLOCKS_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM b), g AS (SELECT page_id, count(*) AS n, string_agg(coalesce(text, ''), '|' ORDER BY pos) AS t FROM k WHERE rn <= 100 GROUP BY 1)
SELECT p.page_id, CASE WHEN p.page_id % 2 = 0 THEN 'page_id' ELSE 'data_source_id' END AS parent_type, source_id AS parent_id, CASE WHEN title = '' THEN '{a.UNTITLED}' ELSE title END AS title, CASE WHEN p.page_id % 2 = 1 THEN coalesce(url, '') END AS url, site_icon AS icon,
CASE WHEN p.page_id % 4 = 0 THEN cover_image END AS cover, coalesce(n, 0) AS n_children, md5(coalesce(t, '')) AS children_md5 FROM ({PAYLOAD_PAGES_SQL}) p LEFT JOIN g ON g.page_id = p.page_id""",
    "f27_json_first_path": "SELECT page_id, CASE CAST(page_id % 6 AS INT) WHEN 0 THEN 'props.pageProps.post' WHEN 1 THEN 'initialArticle' WHEN 2 THEN 'props.pageProps.article' END AS path FROM pages",
    "b7_structured_to_blocks": """WITH l AS (SELECT page_id, unnest([0, 1, 2, 3]) AS pos, CAST(page_id AS VARCHAR) AS n FROM pages WHERE page_id % 6 IN (0, 2))
SELECT page_id, pos, CASE pos WHEN 0 THEN 'heading_2' WHEN 2 THEN 'image' ELSE 'paragraph' END AS type, CASE pos WHEN 0 THEN 'Title ' || n WHEN 1 THEN 'Text ' || n WHEN 2 THEN '' ELSE 'x' END AS text, CASE WHEN pos = 2 THEN 'https://img.example/' || n END AS image_url FROM l
UNION ALL SELECT page_id, 0, 'paragraph', 'Body ' || CAST(page_id AS VARCHAR), NULL FROM pages WHERE page_id % 6 = 1""",
}  # noqa: S608
