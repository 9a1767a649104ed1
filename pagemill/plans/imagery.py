"""Registered queries over images around links, pictures and noscripts, covers and image blocks, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import images as io
from pagemill.operators import pages as p
from pagemill.plans.tables import derived

_N = "CAST(page_id AS STRING)"
SIGNED = ["signed.example"]
# Images of each page by their place: markup, url, status, alt. Which of them a page has depends on its id and its url.
IMAGES = [
    (f"""'<a href="https://img.example/full/' || {_N} || '.jpg"><span><em><img src="/thumb.gif" alt=" A ' || {_N} || ' "></em></span></a>'""", f"'https://img.example/full/' || {_N} || '.jpg'", "accepted", f"' A ' || {_N} || ' '"),
    (f"""'<a href="/page"><div><img src="https://img.example/l' || {_N} || '.png" width="600px" height=" 299.5"></div></a>'""", f"'https://img.example/l' || {_N} || '.png'", "small", "NULL"),
    (f"""'<picture><source media="x"><div><source srcset="https://img.example/p' || {_N} || '.webp 2x, https://img.example/q.webp"></div><b><img src="/blank.png"></b></picture>'""", f"'https://img.example/p' || {_N} || '.webp'", "accepted", "NULL"),
    (f"""'<div><img class="lazy"><p><noscript><img src="https://img.example/n' || {_N} || '.jpg"></noscript></p></div>'""", f"'https://img.example/n' || {_N} || '.jpg'", "accepted", "NULL"),
    ("""'<div><img class="lazy"><noscript><img src="/page"></noscript></div>'""", "NULL", "invalid", "NULL"),
    (f"""'<p><img alt="Sign" data-src="https://cdn.signed.example/' || {_N} || '.png?token-time=1"></p>'""", f"'https://cdn.signed.example/' || {_N} || '.png?token-time=1'", "temporary", "'Sign'"),
    (f"""'<p><img src="https://img.example/full/' || {_N} || '.jpg" data-width="900" data-height="800"></p>'""", f"'https://img.example/full/' || {_N} || '.jpg'", "duplicate", "NULL"),
    ("""'<p><img></p>'""", "NULL", "no_source", "NULL"),
]
_SHOWN = [f"(page_id + length(url)) % {k + 2} <> 1" for k in range(len(IMAGES))]
_END = " || ".join(f"CASE WHEN {c} THEN {x[0]} ELSE '' END" for c, x in zip(_SHOWN, IMAGES))
PAGES_SQL = f"SELECT page_id, html || '<section>' || {_END} || '</section>' AS html FROM pages"  # noqa: S608
# Covers: by a meta element, by places in the page, in a side column (not counted), signed (not counted).
_HEAD = f"""CASE CAST(length(url) % 4 AS INT) WHEN 0 THEN '<meta property="og:image" content="https://img.example/og' || {_N} || '.jpg">' WHEN 1 THEN '<meta property="og:image" content="https://cdn.signed.example/o.png?token-hash=1"><meta name="twitter:image" content="https://img.example/tw' || {_N} || '.jpg">' ELSE '' END"""
_HERO = f"""CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '<div class="hero-image x"><i><img src="https://img.example/hero' || {_N} || '.jpg"></i></div>' WHEN 1 THEN '<aside><div class="cover-image"><img src="https://img.example/side.jpg"></div></aside><div class="hero"><img src="https://img.example/dh' || {_N} || '.jpg"></div>'
  WHEN 2 THEN '<div class="post"><div><u><img src="https://img.example/post' || {_N} || '.jpg"></u></div></div>' WHEN 3 THEN '<header><img src="/none.gif"></header><img class="d-block w-100" src="https://img.example/own' || {_N} || '.jpg">' ELSE '' END"""
COVERS_SQL = f"SELECT page_id, replace(replace(html, '</head>', {_HEAD} || '</head>'), '<article>', {_HERO} || '<article>') AS html FROM pages"  # noqa: S608


def _images(spark, d):
    return io.extract_images(p.element_table(derived(spark, d, PAGES_SQL)), SIGNED)


def b8_image_sources(spark, d):
    return _images(spark, d).select("page_id", "url", "status", "alt")


def b8_image_blocks(spark, d):
    t = io.image_blocks(_images(spark, d))
    text = F.array_join(F.transform("rich_text", lambda r: F.concat(r["content"], F.coalesce(r["link"], F.lit("")))), "|")
    return t.select("page_id", "pos", "type", text.alias("text"), "image_url")


def b8_cover_images(spark, d):
    return io.cover_images(p.element_table(derived(spark, d, COVERS_SQL)), SIGNED)


def a9_cover_metrics(spark, d):
    nodes = p.element_table(derived(spark, d, COVERS_SQL))
    covers = io.cover_images(nodes, SIGNED)
    t = io.image_metrics(io.extract_images(nodes, SIGNED, covers), covers)
    return t.select("page_id", *(F.col(c).cast("long").alias(c) for c in ("candidates", "url_valid", "final")), "has_cover")


QUERIES = {f.__name__: f for f in (b8_image_sources, b8_image_blocks, b8_cover_images, a9_cover_metrics)}

_ROWS = " UNION ALL ".join(f"SELECT page_id, {k} AS place, {u} AS url, " + (f"CASE WHEN {_SHOWN[0]} THEN 'duplicate' ELSE 'accepted' END" if s == "duplicate" else f"'{s}'") + f" AS status, {alt} AS alt FROM pages WHERE {c}" for k, (c, (_, u, s, alt)) in enumerate(zip(_SHOWN, IMAGES)))
_OWN = f"""CASE CAST(page_id % 5 AS INT) WHEN 0 THEN 'https://img.example/hero' || {_N} || '.jpg' WHEN 1 THEN 'https://img.example/dh' || {_N} || '.jpg' WHEN 2 THEN 'https://img.example/post' || {_N} || '.jpg' WHEN 3 THEN 'https://img.example/own' || {_N} || '.jpg' END"""
_COVERS = f"""SELECT page_id, CASE CAST(length(url) % 4 AS INT) WHEN 0 THEN 'https://img.example/og' || {_N} || '.jpg' WHEN 1 THEN 'https://img.example/tw' || {_N} || '.jpg' ELSE {_OWN} END AS cover,
CASE CAST(length(url) % 4 AS INT) WHEN 0 THEN 'og:image' WHEN 1 THEN 'twitter:image' ELSE CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '.hero-image' WHEN 1 THEN 'div.hero' WHEN 2 THEN 'first div of .post' WHEN 3 THEN 'own .d-block.w-100' END END AS place FROM pages"""
ORACLES = {
    "b8_image_sources": f"SELECT page_id, url, status, alt FROM ({_ROWS}) q",
    "b8_image_blocks": f"""WITH r AS ({_ROWS}), k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos FROM r WHERE status IN ('accepted', 'temporary'))
SELECT page_id, CAST(pos AS INT) AS pos, CASE status WHEN 'temporary' THEN 'paragraph' ELSE 'image' END AS type, CASE status WHEN 'temporary' THEN '{io.PLACEHOLDER[0]}「Sign」{io.PLACEHOLDER[3]}|{io.PLACEHOLDER[4]}' || url ELSE '' END AS text, CASE status WHEN 'accepted' THEN url END AS image_url FROM k""",
    "b8_cover_images": f"SELECT * FROM ({_COVERS}) c WHERE cover IS NOT NULL",
    "a9_cover_metrics": f"""WITH c AS ({_COVERS}), n AS (SELECT page_id, cover, CASE page_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 0 END AS candidates, CASE page_id % 5 WHEN 4 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS url_valid, starts_with(coalesce(place, ''), 'o') AND place <> 'og:image' OR place LIKE '%hero%' OR place LIKE 'first%' AS own FROM c)
SELECT page_id, CAST(candidates AS BIGINT) AS candidates, CAST(url_valid AS BIGINT) AS url_valid, CAST(url_valid - CASE WHEN own AND url_valid > 0 THEN 1 ELSE 0 END AS BIGINT) AS final, cover IS NOT NULL AS has_cover FROM n WHERE candidates > 0 OR cover IS NOT NULL""",
}  # noqa: S608
