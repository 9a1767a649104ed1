"""Images of pages: one source for each image element, what becomes of it, counts, and which of them go with a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.images import clean_image_urls, is_valid_image_url
from pagemill.functions.urls import is_temporary_image_url
from pagemill.operators.pages import best_srcset_url

# Attributes that may hold an image's URL, in the order they are tried; least size; limits a page.
SOURCE_ATTRIBUTES = [
    "src", "data-src", "data-lazy-src", "data-original", "data-srcset", "data-lazy-srcset", "data-original-src", "data-actualsrc", "data-src-original", "data-echo", "data-href", "data-large", "data-bigsrc", "data-full-src",
    "data-hi-res-src", "data-large-src", "data-zoom-src", "data-image-src", "data-img-src", "data-real-src", "data-lazy", "data-url", "data-image", "data-img", "data-fallback-src", "data-origin",
]
MIN_WIDTH, MIN_HEIGHT = 550, 300
MOST_CONTENT, MOST_EXTRA, MOST_GALLERY, ENOUGH_CONTENT = 6, 2, 6, 2


# Where a page's cover stands, in the order it is looked for: an ancestor's tag or class, or the image's own class.
COVER_ANCESTORS = [
    ".field--name-field-image", ".field-name-field-image", ".cover-image", ".post-thumbnail", ".entry-thumbnail", "header", ".article-header", ".entry-header", ".page-header", "figure.featured", ".featured-media",
    ".wp-block-post-featured-image", ".featured-image", ".hero-image", "div.hero", "figure.image",
]
COVER_ORDER = [
    ".field--name-field-image", ".field-name-field-image", ".cover-image", ".post-thumbnail", ".entry-thumbnail", "own .wp-post-image", "header", ".article-header", ".entry-header", ".page-header", "figure.featured", ".featured-media",
    ".wp-block-post-featured-image", ".featured-image", ".hero-image", "div.hero", "first in article", "first figure of .article", "first figure of .post", "first div of .post", "own .d-block.w-100", "figure.image",
]
PLACEHOLDER = ("🖼️ Patreon 圖片", "「", "」", "（暫存連結，可能無法在 Notion 中顯示）：", "原始連結")
MOST_NOSCRIPT = 2000  # characters of a URL in a noscript


def _classes(a: Column) -> Column:
    return F.filter(F.split(F.coalesce(a["class"], F.lit("")), r"\s+"), lambda c: c != "")


def _within(cond: Column, over: W) -> Column:
    """Whether an element stands in one that cond is true of; over: its page's earlier elements."""
    return F.coalesce(F.max(F.when(cond, F.col("last_id"))).over(over) >= F.col("node_id"), F.lit(False))


def _nearest(cond: Column, value: Column, over: W) -> Column:
    """value of the last earlier element of cond, if it is still open here."""
    found = F.last(F.when(cond, F.struct("last_id", value.alias("v"))), True).over(over)
    return F.when(found["last_id"] >= F.col("node_id"), found["v"])


def _first_number(*texts: Column) -> Column:
    """The first positive number that one of the texts begins with; else 0."""
    n = lambda t: F.nullif(F.regexp_extract(t, r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))
    return F.coalesce(*(n(t) for t in texts), F.lit(0))


def _sources(nodes: DataFrame, tags: tuple[str, ...] = ("img",)) -> DataFrame:
    """(page_id, node_id, url, written, alt, width, height, attrs) of each img: the first valid URL of the nearest link around it,
    its srcset, its attributes in their order, and the sources of the nearest picture around it; else what the first noscript
    beside or below its parent has, valid or not (written). Images in a noscript are no images of the page."""
    tag, a = F.col("tag"), F.col("attrs")
    page = W.partitionBy("page_id")
    before = page.orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    after = page.orderBy(F.desc("node_id")).rowsBetween(W.unboundedPreceding, -1)
    t = nodes.withColumns({"_quiet": _nearest(tag == "noscript", F.col("node_id"), before), "_link": _nearest(tag == "a", a["href"], before), "_picture": _nearest(tag == "picture", F.col("node_id"), before)})
    t = t.withColumn("_next", F.last(F.when(tag == "noscript", F.col("node_id")), True).over(after))
    keys = ["page_id", "node_id"]
    pictures = t.where((tag == "source") & F.col("_picture").isNotNull() & (F.coalesce(a["srcset"], F.lit("")) != "")).groupBy("page_id", "_picture").agg(F.array_sort(F.collect_list(F.struct("node_id", best_srcset_url(a["srcset"]).alias("u")))).alias("_sources"))
    src = F.trim(F.coalesce(a["src"], F.lit("")))
    told = t.where((tag == "img") & F.col("_quiet").isNotNull() & src.rlike(r"^(?!(?i:data|blob|javascript):)[^\"']{1," + str(MOST_NOSCRIPT) + "}$")).groupBy("page_id", F.col("_quiet").alias("_next")).agg(F.min_by(src, F.col("node_id")).alias("_told"))
    parents = t.where(F.col("_next") <= F.col("last_id")).select("page_id", F.col("node_id").alias("parent_id"), "_next").join(told, ["page_id", "_next"]).drop("_next")
    own = t.where(tag.isin(*tags) & F.col("_quiet").isNull()).join(pictures, ["page_id", "_picture"], "left").join(parents, ["page_id", "parent_id"], "left")
    srcset = F.coalesce(a["srcset"], a["data-srcset"], a["data-lazy-srcset"])
    tried = F.concat(F.array(F.trim("_link"), best_srcset_url(srcset), *(a[k] for k in SOURCE_ATTRIBUTES)), F.transform(F.coalesce("_sources", F.array().cast("array<struct<node_id:int,u:string>>")), lambda x: x["u"]), F.array("_told"))
    j = own.select(*keys, a["alt"].alias("alt"), _first_number(a["width"], a["data-width"], a["data-resolved-width"]).alias("width"), _first_number(a["height"], a["data-height"], a["data-resolved-height"]).alias("height"), "attrs", "_told", F.array_compact(tried).alias("raw"))
    j = j.withColumn("clean", clean_image_urls(F.col("raw")))
    both = F.arrays_zip("raw", "clean")
    return j.withColumn("url", F.try_element_at(F.filter(both, lambda x: is_valid_image_url(x["raw"], x["clean"])), F.lit(1))["clean"]).select(*keys, "url", F.col("_told").alias("written"), "alt", "width", "height", "attrs")


def extract_images(nodes: DataFrame, temporary_hosts: list[str], covers: DataFrame | None = None) -> DataFrame:
    """(page_id, node_id, url, status, alt) of each img of explode_nodes' rows; covers: (page_id, cover) of cover_images.

    The url is the first valid one of the sources that _sources names. status: no_source; invalid (a noscript names no valid
    url); cover (it is the page's cover); temporary (signed, will expire); small (both sizes are known, by the element's attributes
    or their data- forms, and one is too little); duplicate of an earlier accepted one of the page; accepted. A page without
    images has no row. Links, pictures and noscripts around an image are found by windows over its page."""
    j = _sources(nodes)
    cover = F.lit(False)
    if covers is not None:
        j = j.join(covers.select("page_id", "cover"), "page_id", "left")
        cover = F.coalesce(F.col("url") == F.col("cover"), F.lit(False))
    small = (F.col("width") > 0) & (F.col("height") > 0) & ((F.col("width") < MIN_WIDTH) | (F.col("height") < MIN_HEIGHT))
    none = F.when(F.col("written").isNotNull(), "invalid").otherwise("no_source")
    status = F.when(F.col("url").isNull(), none).when(cover, "cover").when(is_temporary_image_url("url", temporary_hosts), "temporary").when(small, "small").otherwise("accepted")
    j = j.withColumn("status", status)
    nth = F.row_number().over(W.partitionBy("page_id", "url", "status").orderBy("node_id"))
    return j.select("page_id", "node_id", "url", F.when((F.col("status") == "accepted") & (nth > 1), "duplicate").otherwise(F.col("status")).alias("status"), "alt")


def cover_images(nodes: DataFrame, temporary_hosts: list[str]) -> DataFrame:
    """(page_id, cover, place) of the pages with a cover: the og:image or the twitter:image, by the first such meta element, else the first
    image at each place of COVER_ORDER. A place counts if its first image has a valid url that is not temporary and doesn't stand in a
    side column."""
    tag, a = F.col("tag"), F.col("attrs")
    named = [a["property"] == "og:image", a["name"] == "twitter:image"]
    metas = nodes.where(tag == "meta").groupBy("page_id").agg(*(F.min_by(F.coalesce(a["content"], F.lit("")), F.when(n, F.col("node_id"))).alias(f"m{k}") for k, n in enumerate(named)))
    metas = metas.select("page_id", F.posexplode(F.array("m0", "m1")).alias("rank", "raw")).where("raw is not null").withColumn("url", clean_image_urls(F.array("raw"))[0])
    metas = metas.where(is_valid_image_url(F.col("raw"), F.col("url"))).select("page_id", "rank", "url", F.element_at(F.array(F.lit("og:image"), F.lit("twitter:image")), F.col("rank") + 1).alias("place"))
    classes, role = _classes(a), F.coalesce(a["role"], F.lit(""))
    has = lambda name: F.array_contains(classes, name)
    page = W.partitionBy("page_id")
    before = page.orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)

    def matches(selector: str) -> Column:
        name, _, cls = selector.partition(".")
        return (tag == name if name else F.lit(True)) & (has(cls) if cls else F.lit(True))

    first = F.row_number().over(W.partitionBy("page_id", "parent_id", "tag").orderBy("node_id")) == 1
    blocks = nodes.where(has("article") | has("post")).select("page_id", F.col("node_id").alias("parent_id"), has("article").alias("_article"), has("post").alias("_post"))
    t = nodes.withColumn("_first", first).join(blocks, ["page_id", "parent_id"], "left")
    side = (tag == "aside") | (role == "complementary") | has("sidebar") | has("side-bar") | F.coalesce(a["class"], F.lit("")).contains("rhs")
    of = lambda flag: F.coalesce(F.col(flag), F.lit(False)) & F.col("_first")
    inside = {s: _within(matches(s), before) for s in COVER_ANCESTORS}
    inside |= {"first in article": _within(tag == "article", before) & F.col("_first"), "first figure of .article": _within(of("_article") & (tag == "figure"), before), "first figure of .post": _within(of("_post") & (tag == "figure"), before), "first div of .post": _within(of("_post") & (tag == "div"), before)}
    inside |= {"own .wp-post-image": has("wp-post-image"), "own .d-block.w-100": has("d-block") & has("w-100")}
    places = F.array_compact(F.array(*(F.when(inside[s], F.lit(k)) for k, s in enumerate(COVER_ORDER))))
    t = t.withColumns({"_places": places, "_side": _within(side, before)}).where(tag == "img")
    at = t.select("page_id", "node_id", "_side", F.explode("_places").alias("k")).groupBy("page_id", "k").agg(F.min_by(F.struct("node_id", "_side"), F.col("node_id")).alias("x")).select("page_id", "k", "x.node_id", F.col("x._side").alias("_side"))
    found = at.where(~F.col("_side")).join(_sources(nodes).select("page_id", "node_id", "url"), ["page_id", "node_id"]).where("url is not null")
    dom = found.select("page_id", (F.col("k") + 2).alias("rank"), "url", F.element_at(F.array(*map(F.lit, COVER_ORDER)), F.col("k") + 1).alias("place"))
    every = metas.unionByName(dom).where(~is_temporary_image_url("url", temporary_hosts))
    return every.groupBy("page_id").agg(F.min_by(F.struct("url", "place"), F.col("rank")).alias("c")).select("page_id", F.col("c.url").alias("cover"), "c.place")


def image_blocks(images: DataFrame) -> DataFrame:
    """(page_id, pos, type, rich_text, image_url) of extract_images' accepted rows, and of the temporary ones as a paragraph that
    links to them, in page order from 0; rich_text is an array of content and link."""
    temporary, alt = F.col("status") == "temporary", F.trim(F.coalesce("alt", F.lit("")))
    head, opening, closing, tail, label = map(F.lit, PLACEHOLDER)
    text = F.concat(head, F.when(alt != "", F.concat(opening, alt, closing)).otherwise(""), tail)
    run = lambda content, link: F.struct(content.alias("content"), link.cast("string").alias("link"))
    rich = F.when(temporary, F.array(run(text, F.lit(None)), run(label, F.col("url")))).otherwise(F.array().cast("array<struct<content:string,link:string>>"))
    pos = F.row_number().over(W.partitionBy("page_id").orderBy("node_id")) - 1
    t = images.where(F.col("status").isin("accepted", "temporary"))
    return t.select("page_id", pos.alias("pos"), F.when(temporary, "paragraph").otherwise("image").alias("type"), rich.alias("rich_text"), F.when(~temporary, F.col("url")).alias("image_url"))


def image_metrics(images: DataFrame, covers: DataFrame | None = None) -> DataFrame:
    """Counts a page of extract_images' rows: candidates, with a valid url, too small, temporary, accepted; with covers
    (cover_images' rows) also has_cover, and the pages that have a cover alone."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    out = images.groupBy("page_id").agg(F.count("*").alias("candidates"), F.count_if(~F.col("status").isin("no_source", "invalid")).alias("url_valid"), is_("small").alias("filtered_by_size"), is_("temporary").alias("temporary"), is_("accepted").alias("final"))
    if covers is None:
        return out
    counts = [c for c in out.columns if c != "page_id"]
    j = out.join(covers.select("page_id", F.lit(True).alias("has_cover")), "page_id", "full")
    return j.select("page_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("has_cover", F.lit(False)).alias("has_cover"))


def select_images(content: DataFrame, extra: DataFrame) -> DataFrame:
    """(page_id, place, url, part) of content(page_id, pos, url) and extra(page_id, pos, url, gallery).

    At most six images of the content; extras only for pages of fewer than two, at most two of them, or six if the page
    has a gallery image. place numbers a page's images from 1, the content's first."""
    w = W.partitionBy("page_id")
    both = content.select("page_id", "pos", "url", F.lit(0).alias("part"), F.lit(False).alias("gallery")).unionByName(extra.select("page_id", "pos", "url", F.lit(1).alias("part"), F.coalesce("gallery", F.lit(False)).alias("gallery")))
    both = both.withColumns({"n": F.count_if(F.col("part") == 0).over(w), "g": F.coalesce(F.bool_or("gallery").over(w), F.lit(False)), "rn": F.row_number().over(W.partitionBy("page_id", "part").orderBy("pos", "url"))})
    kept = F.when(F.col("part") == 0, F.col("rn") <= MOST_CONTENT).otherwise((F.col("n") < ENOUGH_CONTENT) & (F.col("rn") <= F.when(F.col("g"), MOST_GALLERY).otherwise(MOST_EXTRA)))
    t = both.where(kept)
    return t.select("page_id", F.row_number().over(w.orderBy("part", "pos", "url")).cast("long").alias("place"), "url", F.when(F.col("part") == 0, "content").otherwise("extra").alias("part"))
