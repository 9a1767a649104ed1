"""Registered queries over whole-page extraction and structured data, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import assembly as a
from pagemill.operators import markup as mk
from pagemill.operators import pages as p
from pagemill.operators import payload as pl
from pagemill.operators import structured as st
from pagemill.plans.pages import _PLAIN
from pagemill.plans.tables import BLOCKS_SQL, derived
from pagemill.plans.web import sql_norm

_N = "CAST(page_id AS STRING)"
# An article of four blocks in a page's data; its page and asPath as given.
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_ARTICLE = f"""'{{"title":"","blocks":[{{"blockType":"heading","text":"Head ' || {_N} || '"}},{{"blockType":"text","text":"One <b>' || {_N} || '</b>"}},{{"blockType":"text","text":"Two"}},{{"blockType":"image","image":{{"url":"https://img.example/' || {_N} || '.jpg"}}}}]}}'"""
_NEXT = lambda page, path: f"""'<script id="__NEXT_DATA__">{{"page":"{page}","asPath":"' || {path} || '?q=1","props":{{"pageProps":{{"post":' || {_ARTICLE} || '}}}}}}</script></head>'"""
# A push of two lines, the second an array whose fourth entry holds the article; and one that isn't JSON. ~ stands for a backslash.
_PUSHED = f"""replace('<script>self.__next_f.push([0]);self.__next_f.push([1,"x"])</script><script>self.__next_f.push([1,"1:I[7]~n2:[~"$~",~"p~",null,{{~"props~":{{~"pageProps~":{{~"post~":' || replace({_ARTICLE}, '"', '~"') || '}}}}}}]~n"]);self.__next_f.push(oops)</script></head>', '~', chr(92))"""
_CASE = f"""CASE CAST(page_id % 10 AS INT)
  WHEN 1 THEN replace(replace(html, '<article>', '<div class="x post-content">'), '</article>', '</div>') WHEN 2 THEN replace(replace(html, '<article>', '<section>'), '</article>', '</section>')
  WHEN 3 THEN replace(replace(html, '<article>', '<center>'), '</article>', '</center>') WHEN 4 THEN replace(replace(html, '<article>', '<div class="node__content"><div class="field--name-field-body">'), '</article>', '</div></div>')
  WHEN 5 THEN replace(html, '</head>', {_NEXT("/[id]", _PATH)}) WHEN 6 THEN replace(html, '<footer>', '<footer><img src="https://img.example/' || {_N} || '.jpg"><img src="https://img.example/' || {_N} || '-b.png">')
  WHEN 7 THEN replace(html, '<article>', '<div class="prose"><h2><a class="x anchor" href="#d">#</a>Doc</h2><div class="code-example"><header><p>no</p></header></div><form><p>no</p></form><p data-clipboard-target="q">no</p></div><article>') WHEN 8 THEN replace(html, '</head>', CASE WHEN page_id % 20 = 8 THEN {_NEXT("/", _PATH)} ELSE {_NEXT("/[id]", "'/elsewhere'")} END)
  WHEN 9 THEN replace(html, '</head>', {_PUSHED}) ELSE html END"""
CLIP_SQL = f"SELECT page_id, url, {_CASE} AS html FROM pages"  # noqa: S608


def b6_extract_structured(spark, d):
    pages = derived(spark, d, CLIP_SQL)
    nodes = p.explode_nodes(pages)
    t = st.extract_structured(p.extract_metadata(pages, nodes), st.page_data(nodes))
    return t.select("page_id", "source", "path", F.get_json_object("article", "$.blocks[0].text").alias("first_text"))


# Articles of every format, by page_id; the texts are the pages' own urls and ids.
_MODEL = f"""'{{"type":"text","model":{{"blocks":[{{"type":"paragraph","model":{{"blocks":[{{"type":"fragment","model":{{"text":" In ' || {_N} || '"}}}},{{"model":{{"blocks":[{{"text":"side"}},{{"model":{{"text":" "}}}}]}}}}]}}}},{{"type":"introduction","model":{{"text":"' || url || '"}}}},{{"type":"list","model":{{"text":"no"}}}}]}}}}'"""
FORMATS_SQL = f"""
SELECT page_id, CASE CAST(page_id % 5 AS INT)
WHEN 0 THEN '{{"blocks":[{{"type":"headline","model":{{"blocks":[{{"model":{{"text":"Head ' || {_N} || '"}}}}]}}}},{{"type":"byline","model":{{"text":"x"}}}},' || {_MODEL} || ',{{"type":"image","model":{{"blocks":[{{"type":"caption","model":{{"text":"Cap"}}}},{{"type":"rawImage","model":{{"locator":"l' || {_N} || '","originCode":"cps"}}}}]}}}},{{"type":"odd","model":{{"text":"Odd"}}}},{{"type":"image","model":{{"blocks":[]}}}}]}}'
WHEN 1 THEN '{{"blocks":[],"storyAtoms":[{{"type":"text","tagName":"H2","content":"<i>A</i> &amp; ' || {_N} || '"}},{{"type":"text","content":" <b> </b>"}},{{"type":"image","size":{{"original":{{"url":"' || url || '"}}}},"caption":"C"}},{{"type":"video"}},{{"type":"text","tagName":"blockquote","content":"Q"}}]}}'
WHEN 2 THEN '{{"teaser":["T1","' || {_N} || '"],"content":{{"model":{{"blocks":[{{"blockType":"text","htmlTokens":[[{{"content":"a"}},{{"content":"' || {_N} || '"}}],[{{"content":" "}}],[{{}}, {{"content":"z"}}]]}},{{"blockType":"list","ordered":true,"items":["<b>one</b>","' || {_N} || '"]}},{{"blockType":"list","items":["u"]}},{{"blockType":"code","text":"c"}},{{"blockType":"quote"}},{{"blockType":"image","image":{{"cdnUrl":"","url":"' || url || '","caption":"K"}}}},{{"blockType":"image"}}]}}}}}}'
WHEN 3 THEN '{{"teaser":["Lead"],"body":"<p>One ' || {_N} || '</p><p>Two<br/>Three</p>"}}' ELSE '{{"content":"text alone"}}' END AS article FROM pages
"""  # noqa: S608


def b7_structured_formats(spark, d):
    return st.structured_to_blocks(derived(spark, d, FORMATS_SQL))


# Pages that a gate refuses or empties, by page_id.
GATED_SQL = "SELECT page_id, CASE WHEN page_id % 7 = 1 THEN NULL WHEN page_id % 7 = 2 THEN '' WHEN page_id % 7 = 3 THEN '<div><script>x</script><br></div>' WHEN page_id % 7 = 4 THEN replace(html, '<article>', '<article><pre><code class=\"x\">a &lt; b &amp;&amp; c</code></pre><a title=\"t\" href=\" javascript:x()\">j</a><a href=\"https://l.example/?a=1&amp;b=2\">l</a>') ELSE html END AS html FROM pages"


def f30_gate_html(spark, d):
    t = mk.gate_html(derived(spark, d, GATED_SQL), most=9000)
    return t.select("page_id", "success", "reason", F.md5("html").alias("html_md5"))


def s6_block_requests(spark, d):
    t = p.block_requests(derived(spark, d, BLOCKS_SQL), 3)
    return t.select("page_id", "batch", "n_batches", "with_page", F.md5(F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["pos"], x["type"], x["text"])), "|")).alias("children_md5"))


def b11_extract_pages(spark, d):
    t = pl.extract_pages(derived(spark, d, CLIP_SQL))
    return t.select("page_id", "canonical", "title", "kind", "strategy", "status", F.col("n_blocks").cast("long").alias("n_blocks"), F.col("n_batches").cast("long").alias("n_batches"), "lead_image", F.array_join("extra_images", " ").alias("extra_images"))


def b11_page_blocks(spark, d):
    t = pl.clip_pages(derived(spark, d, CLIP_SQL))[1]
    return t.select("page_id", "pos", "type", F.md5(p.block_text()).alias("text_md5"), "image_url")


QUERIES = {f.__name__: f for f in (b6_extract_structured, b7_structured_formats, f30_gate_html, s6_block_requests, b11_extract_pages, b11_page_blocks)}

_LEN = lambda x: f"length(trim(regexp_replace(regexp_replace({x}, '<[^>]*>', '', 'g'), '&(?:quot|copy|middot|amp);?', 'x', 'g')))"
_TITLE = f"trim({_PLAIN.format(x="regexp_extract(html, '<title>([\\s\\S]*?)</title>', 1)")})"
_DOC = f"(regexp_matches(lower(url), '{p.TECH_URL}') OR regexp_matches(lower({_TITLE}), '{p.TECH_TITLE}') OR regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/:?#]*)', 1), '{p.DOC_HOST}') OR regexp_matches(regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^?#]*)', 1), '{p.DOC_PATH}'))"
_ELEMENT = "<h1>[^<]*|<p>(?:<b>)?[^<]+"
_CLIP = f"""own AS (SELECT max(page_id) AS page_id FROM pages WHERE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) NOT IN ('', '/') OR contains(url, '?') GROUP BY {sql_norm('url')}),
t AS (SELECT page_id, url, html, {_TITLE} AS title, regexp_extract(html, '<article>([\\s\\S]*)</article>', 1) AS body, regexp_extract(html, '<div class="ad">([\\s\\S]*?)</div>', 1) AS ad, len(regexp_extract_all(html, '<li>')) AS n_li,
  length(trim({_PLAIN.format(x="regexp_replace(regexp_extract(html, '<body>([\\s\\S]*)', 1), '<[^>]*>', '', 'g')")})) AS n_text, page_id % 10 AS k FROM pages JOIN own USING (page_id)),
l AS (SELECT *, {_LEN("body")} AS n, {_LEN("ad")} AS n_ad FROM t),
s AS (SELECT *, CASE WHEN k IN (5, 9) THEN 'props.pageProps.post' WHEN k = 7 AND n_text + 10 <= 5000 THEN 'technical' WHEN k = 4 THEN 'drupal' WHEN k = 1 AND n >= 250 THEN 'cms' WHEN k NOT IN (1, 2, 3) AND n >= 250 THEN 'article' WHEN k = 2 AND n >= 250 THEN 'generic' WHEN n_ad >= 125 OR n >= 125 AND k <> 3 THEN 'emergency' WHEN n_li >= 4 THEN 'list' END AS strategy FROM l),
e AS (SELECT *, strategy IN ('drupal', 'cms', 'article', 'generic') OR strategy = 'emergency' AND n_ad < 125 AS whole FROM s),
c AS (SELECT *, CASE WHEN k IN (5, 9) THEN 4 WHEN strategy = 'technical' THEN 1 WHEN whole THEN len(regexp_extract_all(body, '{_ELEMENT}')) WHEN strategy = 'list' THEN n_li ELSE 0 END AS n_own, k = 6 AND strategy IS NOT NULL AS led FROM e)"""
ORACLES = {
    "b6_extract_structured": f"SELECT page_id, CASE WHEN page_id % 10 = 5 THEN 'pages' ELSE 'app' END AS source, 'props.pageProps.post' AS path, 'Head ' || {_N} AS first_text FROM pages WHERE page_id % 10 IN (5, 9)",
    "b7_structured_formats": f"""SELECT page_id, CAST(generate_subscripts(xs, 1) - 1 AS INT) AS pos, unnest(xs).t AS type, unnest(xs).x AS text, unnest(xs).u AS image_url FROM (SELECT page_id, CASE CAST(page_id % 5 AS INT)
WHEN 0 THEN [{{'t': 'heading_1', 'x': 'Head ' || {_N}, 'u': NULL}}, {{'t': 'paragraph', 'x': 'In ' || {_N} || 'side', 'u': NULL}}, {{'t': 'paragraph', 'x': url, 'u': NULL}}, {{'t': 'image', 'x': 'Cap', 'u': 'https://ichef.bbci.co.uk/ace/ws/1024/cps/l' || {_N} || '.webp'}}, {{'t': 'paragraph', 'x': 'Odd', 'u': NULL}}]
WHEN 1 THEN [{{'t': 'heading_2', 'x': 'A & ' || {_N}, 'u': NULL}}, {{'t': 'image', 'x': 'C', 'u': url}}, {{'t': 'quote', 'x': 'Q', 'u': NULL}}]
WHEN 2 THEN [{{'t': 'quote', 'x': 'T1' || chr(10) || {_N}, 'u': NULL}}, {{'t': 'paragraph', 'x': 'a' || {_N}, 'u': NULL}}, {{'t': 'paragraph', 'x': 'z', 'u': NULL}}, {{'t': 'numbered_list_item', 'x': 'one', 'u': NULL}}, {{'t': 'numbered_list_item', 'x': {_N}, 'u': NULL}}, {{'t': 'bulleted_list_item', 'x': 'u', 'u': NULL}}, {{'t': 'paragraph', 'x': 'c', 'u': NULL}}, {{'t': 'quote', 'x': '', 'u': NULL}}, {{'t': 'image', 'x': 'K', 'u': url}}]
WHEN 3 THEN [{{'t': 'quote', 'x': 'Lead', 'u': NULL}}, {{'t': 'paragraph', 'x': 'One ' || {_N} || chr(10) || chr(10) || 'Two' || chr(10) || 'Three', 'u': NULL}}] END AS xs FROM pages) q WHERE xs IS NOT NULL""",
    "s6_block_requests": f"WITH b AS ({BLOCKS_SQL}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS rn, count(*) OVER (PARTITION BY page_id) AS n FROM b) SELECT page_id, rn // 3 AS batch, CAST(ceil(max(n) / 3.0) AS BIGINT) AS n_batches, rn // 3 = 0 AS with_page, md5(string_agg(pos || ':' || type || ':' || text, '|' ORDER BY pos)) AS children_md5 FROM k GROUP BY page_id, rn // 3",
    "f30_gate_html": f"""WITH t AS ({GATED_SQL}), b AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '^[\\s\\S]*</head>', ''), '<!--[\\s\\S]*?-->|</?(body|html|nav|b|br|footer|div)( [^>]*)?>', '', 'g'), '([^>])<p>', '\\1</p><p>', 'g'), '([^>])</article>', '\\1</p></article>', 'g') AS x FROM t),
d AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '</?article>', '', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g') AS x FROM b),
k AS (SELECT page_id, html, replace(replace(replace(replace(replace(regexp_replace(x, '&(amp|lt);?', chr(1) || '\\1;', 'g'), '&', '&amp;'), chr(1), '&'), ' class="x"', ''), ' title="t"', ''), ' href=" javascript:x()"', '') AS y FROM d),
r AS (SELECT *, CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN length(html) > 9000 THEN 'too_long' WHEN page_id % 7 = 3 THEN 'sanitized_empty' END AS reason FROM k)
SELECT page_id, reason IS NULL AS success, reason, md5(CASE WHEN reason IS NULL THEN y ELSE '' END) AS html_md5 FROM r""",
    "b11_extract_pages": f"""WITH {_CLIP} SELECT page_id, {sql_norm('url')} AS canonical, title, CASE WHEN k IN (5, 9) THEN 'nextjs' WHEN strategy = 'technical' THEN 'markdown' WHEN strategy IS NOT NULL THEN 'html' END AS kind, strategy, CASE WHEN strategy IS NULL THEN 'failed' ELSE 'success' END AS status,
CAST(greatest(1, n_own + CASE WHEN led THEN 1 ELSE 0 END) AS BIGINT) AS n_blocks, CAST(ceil(greatest(1, n_own + CASE WHEN led THEN 1 ELSE 0 END) / 100.0) AS BIGINT) AS n_batches, CASE WHEN led THEN 'https://img.example/' || {_N} || '.jpg' END AS lead_image, CASE WHEN led THEN 'https://img.example/' || {_N} || '-b.png' ELSE '' END AS extra_images FROM c""",
    "b11_page_blocks": f"""WITH {_CLIP}, w AS (SELECT page_id, led, CASE WHEN whole THEN regexp_extract_all(body, '{_ELEMENT}') WHEN strategy = 'list' THEN regexp_extract_all(html, '<li><a [^>]*>[^<]*') ELSE [] END AS xs FROM c),
x AS (SELECT page_id, led, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS pos FROM w)
SELECT page_id, CAST(pos + CASE WHEN led THEN 1 ELSE 0 END AS INT) AS pos, CASE WHEN x LIKE '<h1%' THEN 'heading_1' WHEN x LIKE '<li%' THEN 'bulleted_list_item' ELSE 'paragraph' END AS type, md5(substr(trim({_PLAIN.format(x="regexp_extract(x, '>([^<>]+)', 1)")}), 1, 2000)) AS text_md5, NULL AS image_url FROM x
UNION ALL SELECT page_id, 0, 'image', md5(''), 'https://img.example/' || {_N} || '.jpg' FROM c WHERE led
UNION ALL SELECT page_id, 0, 'heading_2', md5('Doc'), NULL FROM c WHERE strategy = 'technical'
UNION ALL SELECT page_id, 0, 'paragraph', md5(CASE WHEN strategy IS NULL THEN '{pl.NO_CONTENT}' ELSE '{a.NO_BLOCKS}' END), NULL FROM c WHERE n_own = 0 AND NOT led
UNION ALL SELECT page_id, pos, type, md5(text), img FROM c, (SELECT page_id AS pid, unnest([0, 1, 2, 3]) AS pos, unnest(['heading_2', 'paragraph', 'paragraph', 'image']) AS type, unnest(['Head ' || {_N}, 'One ' || {_N}, 'Two', '']) AS text, unnest([NULL, NULL, NULL, 'https://img.example/' || {_N} || '.jpg']) AS img FROM pages) q WHERE pid = page_id AND k IN (5, 9)""",
}  # noqa: S608
