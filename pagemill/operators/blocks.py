"""Content blocks of pages, by windows over element and text rows: one parse, one shuffle by page for all windows.

Rows come from ``explode_nodes(pages, texts=True)``: ``seq`` numbers a page's elements and texts in page order, and what an element
holds has the numbers after its own up to ``last_seq``. Whether a row stands within an element of some kind is then whether the
largest last_seq of those before it reaches its seq. An element that takes all it holds (a heading, a paragraph, inline content of a list
item) is called a sink; the outermost one counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.html import SILENT
from pagemill.functions.text import map_code_language
from pagemill.operators.images import MOST_CONTENT, extract_images
from pagemill.operators.pages import explode_nodes
from pagemill.sources.staging import staged

# Elements that become blocks or styles, blocks that may not stand in list items, where a code language is named.
HEADINGS = {"h1": "heading_1", "h2": "heading_2", "h3": "heading_3", "h4": "paragraph", "h5": "paragraph", "h6": "paragraph"}
SINKS = [*HEADINGS, "p", "blockquote", "pre", "img", "figure", "hr"]
INLINE = ["a", "b", "strong", "i", "em", "u", "s", "code", "span", "br"]
STYLES = {"bold": ["b", "strong"], "italic": ["i", "em"], "strikethrough": ["s", "del", "strike"], "underline": ["u", "ins"], "code": ["code", "kbd", "samp", "tt"]}
UNSAFE_IN_LISTS = ["code", "image", "bookmark", "embed", "video", "pdf", "file", "audio", "equation", "divider", "table", "callout", "quote", "heading_1", "heading_2", "heading_3"]
LANGUAGE_ATTRIBUTES, LANGUAGE_CLASSES = ["data-language", "data-lang", "language", "lang"], ["language-", "lang-"]
DEFAULT_LANGUAGE = "javascript"
MOST_TEXT = 2000
BLANKS = "\\s\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{feff}"  # what trimming takes away

RUN = "struct<content:string,link:string,bold:boolean,italic:boolean,strikethrough:boolean,underline:boolean,code:boolean>"
_BEFORE, _UPTO = (W.unboundedPreceding, -1), (W.unboundedPreceding, 0)


def _page(*keys: str) -> W:
    return W.partitionBy("page_id", *keys).orderBy("seq")


def _holds(cond: Column, over: W) -> Column:
    """Whether a row stands within one of the elements of cond that the window has."""
    return F.coalesce(F.max(F.when(cond, F.col("last_seq"))).over(over) >= F.col("seq"), F.lit(False))


def trimmed(text: Column, start: bool | Column = True, end: bool | Column = True) -> Column:
    """text without its outer blanks, on the sides asked for."""
    left = F.regexp_replace(text, f"^[{BLANKS}]+", "")
    text = left if start is True else F.when(start, left).otherwise(text)
    right = F.regexp_replace(text, f"[{BLANKS}]+$", "")
    return right if end is True else F.when(end, right).otherwise(text)


def clean_runs(runs: DataFrame, keys: list[str], limit: int = MOST_TEXT) -> DataFrame:
    """runs(*keys, run, content, code, ...) trimmed and cut to ``limit`` characters a key, by run.

    Blank runs outside the first and the last that aren't blank get no content, those two lose their outer blanks; where a
    run is code nothing is trimmed, unless all is blank. Runs past the limit get no content."""
    every = W.partitionBy(*keys)
    order = every.orderBy("run")
    blank = ~F.col("content").rlike(f"[^{BLANKS}]")
    t = runs.withColumns({"_first": F.min(F.when(~blank, F.col("run"))).over(every), "_last": F.max(F.when(~blank, F.col("run"))).over(every), "_code": F.coalesce(F.bool_or("code").over(every), F.lit(False))})
    outside = F.col("_first").isNull() | (F.col("run") < F.col("_first")) | (F.col("run") > F.col("_last"))
    inner = trimmed(F.col("content"), F.col("run") == F.col("_first"), F.col("run") == F.col("_last"))
    t = t.withColumn("content", F.when(F.col("_code") & F.col("_first").isNotNull(), F.col("content")).when(outside, "").otherwise(inner))
    before = F.coalesce(F.sum(F.char_length("content")).over(order.rowsBetween(*_BEFORE)), F.lit(0))
    return t.withColumn("_before", before).withColumn("content", F.substr("content", F.lit(1), F.greatest(F.lit(0), limit - F.col("_before")).cast("int"))).select(*runs.columns)


def truncate_runs(runs: DataFrame, limit: int = MOST_TEXT) -> DataFrame:
    """runs(page_id, pos, text, ...) trimmed and cut so that a page's runs hold ``limit`` characters together: clean_runs by pos.
    Empty runs go; a page of blanks alone keeps one run, its first, of one blank."""
    t = runs.withColumnsRenamed({"pos": "run", "text": "content"})
    t = t if "code" in runs.columns else t.withColumn("code", F.lit(False))
    t = clean_runs(t, ["page_id"], limit).withColumn("_n", F.sum(F.char_length("content")).over(W.partitionBy("page_id")))
    t = t.withColumn("content", F.when((F.col("_n") == 0) & (F.row_number().over(W.partitionBy("page_id").orderBy("run")) == 1), " ").otherwise(F.col("content")))
    return t.where("content <> ''").withColumnsRenamed({"run": "pos", "content": "text"}).select(*runs.columns)


def located(rows: DataFrame) -> DataFrame:
    """rows that a page shows, with ``sink`` (the outermost sink around a row or itself: seq, last_seq, tag, node_id, parent_id, of_item)
    or null, and ``owner``, the element whose block takes the row's text.

    Scripts and the like go with all they hold; so do elements hidden by their style, unless they stand in a sink."""
    tag, upto, before = F.col("tag"), _page().rowsBetween(*_UPTO), _page().rowsBetween(*_BEFORE)
    shown = rows.withColumn("_silent", _holds(tag.isin(*SILENT), upto)).where(~F.col("_silent"))
    of_item = (F.col("parent_tag") == "li") & tag.isin("#text", "p", *INLINE)
    sink = tag.isin(*SINKS) | of_item
    t = shown.withColumns({"_of_item": of_item, "_sink": sink}).withColumn("_inside", _holds(F.col("_sink"), before))
    style = F.lower(F.coalesce(F.col("attrs")["style"], F.lit("")))
    hidden = style.rlike(r"display\s*:\s*none|visibility\s*:\s*hidden") & ~F.col("_inside") & ~F.col("_of_item")
    t = t.withColumn("_gone", _holds(hidden, upto)).where(~F.col("_gone"))
    top = F.struct("seq", "last_seq", "tag", "node_id", "parent_id", F.col("_of_item").alias("of_item"))
    t = t.withColumn("sink", F.last(F.when(F.col("_sink") & ~F.col("_inside"), top), True).over(upto))
    t = t.withColumn("sink", F.when(F.col("sink.last_seq") >= F.col("seq"), F.col("sink")))
    owner = F.when(F.col("sink.of_item"), F.col("sink.parent_id")).otherwise(F.col("sink.node_id"))
    return t.withColumn("owner", owner).drop("_silent", "_of_item", "_sink", "_inside", "_gone")


def _with_facts(t: DataFrame) -> DataFrame:
    """located rows with what their sink holds: whether text, its first code, caption and image; and each row's styles and link."""
    tag, whole = F.col("tag"), W.partitionBy("page_id", "sink.seq")
    upto = whole.orderBy("seq").rowsBetween(*_UPTO)
    first = lambda name: F.min(F.when(tag == name, F.struct("seq", "last_seq"))).over(whole)
    image = F.min(F.when(tag == "img", F.struct("seq", "node_id", F.col("attrs")["alt"].alias("alt")))).over(whole)
    t = t.withColumns({"_has_text": F.bool_or((tag == "#text") & F.col("text").rlike(f"[^{BLANKS}]")).over(whole), "_code": first("code"), "_caption": first("figcaption"), "_image": image, "_code_attrs": F.min_by("attrs", F.when(tag == "code", F.col("seq"))).over(whole)})
    within = (F.col("seq") > F.col("sink.seq")) | F.col("sink.of_item")
    styles = {name: _holds(tag.isin(*tags) & within, upto) for name, tags in STYLES.items()}
    href = F.col("attrs")["href"]
    link = F.max(F.when((tag == "a") & within & href.rlike("(?i)^https?://"), F.struct("last_seq", href.alias("href")))).over(upto)
    t = t.withColumns({**styles, "_link": link})
    return t.withColumn("link", F.when(F.col("_link.last_seq") >= F.col("seq"), F.col("_link.href")))


def _inside(name: str) -> Column:
    return F.col(name).isNotNull() & (F.col("seq") > F.col(f"{name}.seq")) & (F.col("seq") <= F.col(f"{name}.last_seq"))


def rich_texts(t: DataFrame) -> DataFrame:
    """(page_id, owner, rich_text) of the texts of _marked rows: equal neighbours joined, trimmed and cut."""
    sign, plain = ["link", *STYLES], F.col("_sink_tag") == "pre"
    texts = t.where((F.col("tag") == "#text") & ~F.col("_sink_tag").isin("img", "figure", "hr") & (~plain | F.col("_of_code")))
    texts = texts.select("page_id", "owner", "seq", "text", F.when(~plain, F.col("link")).alias("link"), *(F.when(plain, False).otherwise(F.col(s)).alias(s) for s in STYLES))
    order = _page("owner")
    new = ~F.coalesce(F.struct(*sign).eqNullSafe(F.lag(F.struct(*sign)).over(order)), F.lit(False))
    texts = texts.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(order.rowsBetween(*_UPTO)))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")
    runs = clean_runs(texts.groupBy("page_id", "owner", "run", *sign).agg(content.alias("content")), ["page_id", "owner"])
    g = runs.groupBy("page_id", "owner").agg(F.array_sort(F.collect_list(F.struct("run", F.struct("content", *sign).alias("r")))).alias("rs"))
    return g.select("page_id", "owner", F.filter(F.transform("rs", lambda x: x["r"]), lambda r: r["content"] != "").cast(f"array<{RUN}>").alias("rich_text"))


def _language(code: Column, pre: Column) -> Column:
    """The first supported language that the attributes or classes of the code, then of the pre around it, name."""

    def hints(attrs: Column) -> Column:
        classes = F.filter(F.split(F.lower(F.coalesce(attrs["class"], F.lit(""))), r"\s+"), lambda c: reduce(Column.__or__, (c.startswith(x) for x in LANGUAGE_CLASSES)))
        return F.concat(F.array(*(attrs[a] for a in LANGUAGE_ATTRIBUTES)), F.transform(classes, lambda c: F.regexp_replace(c, "^(" + "|".join(LANGUAGE_CLASSES) + ")", "")))

    named = F.transform(F.array_compact(F.concat(hints(code), hints(pre))), map_code_language)
    return F.coalesce(F.try_element_at(F.array_compact(named), F.lit(1)), F.lit(DEFAULT_LANGUAGE))


def _nested(blocks: DataFrame) -> DataFrame:
    """blocks with parent_pos and depth. A list item takes the blocks in it as children, unless one of them may not stand in a
    list item or the item is two levels deep already: then they follow it on its own level."""
    item = F.col("type").endswith("_list_item")
    unsafe = blocks.where(F.col("item_id").isNotNull()).groupBy("page_id", F.col("item_id").alias("node_id")).agg(F.bool_or(F.col("type").isin(*UNSAFE_IN_LISTS)).alias("_unsafe"))
    t = blocks.join(unsafe, ["page_id", "node_id"], "left").withColumn("_takes", item & ~F.coalesce("_unsafe", F.lit(False)))
    t = t.withColumn("pos", F.row_number().over(_page()) - 1)
    for level, keys in (("_outer", ()), ("_second", ("_outer.pos",))):
        over = _page(*keys).rowsBetween(*_BEFORE)
        takes = F.col("_takes") if not keys else F.col("_takes") & F.col("_outer").isNotNull()
        t = t.withColumn("_held", _holds(takes, over))
        t = t.withColumn(level, F.last(F.when(takes & ~F.col("_held"), F.struct("pos", "last_seq")), True).over(over))
        t = t.withColumn(level, F.when(F.col(f"{level}.last_seq") >= F.col("seq"), F.col(level)))
    depth = F.when(F.col("_outer").isNull(), 0).when(F.col("_second").isNull(), 1).otherwise(2)
    return t.withColumns({"parent_pos": F.coalesce("_second.pos", "_outer.pos"), "depth": depth})


def _marked(t: DataFrame) -> DataFrame:
    """The rows of t that are blocks, with their type, and the texts that have an owner."""
    tag, own = F.col("tag"), F.col("sink.seq") == F.col("seq")
    lone = (F.col("sink.tag") == "p") & ~F.col("_has_text") & F.col("_image").isNotNull() & ~F.col("sink.of_item")
    kind = (
        F.when((tag == "img") & lone, "image").when(F.col("sink").isNull() & (tag == "li"), F.when(F.col("parent_tag") == "ol", "numbered_list_item").otherwise("bulleted_list_item"))
        .when(~own | F.col("sink.of_item"), None).when(tag.isin(*HEADINGS), F.create_map(*(F.lit(x) for kv in HEADINGS.items() for x in kv))[tag])
        .when((tag == "p") & ~lone, "paragraph").when(tag == "blockquote", "quote").when(tag == "pre", "code").when(tag.isin("img", "figure"), "image").when(tag == "hr", "divider")
    )
    alt = F.when(tag == "figure", F.col("_image.alt")).when(tag == "img", F.col("attrs")["alt"])
    picture = F.when(tag == "figure", F.col("_image.node_id")).when(tag == "img", F.col("node_id"))
    language = F.when(tag == "pre", _language(F.coalesce("_code_attrs", "attrs"), F.col("attrs")))
    t = t.withColumns({"type": kind, "_sink_tag": F.col("sink.tag"), "_alt": alt, "picture": picture, "language": language})
    t = t.where(F.col("type").isNotNull() | (tag == "#text") & F.col("owner").isNotNull())
    return t.select("page_id", "seq", "last_seq", "node_id", "item_id", "tag", "type", "picture", "_alt", "language", "owner", "_sink_tag", F.when(tag == "#text", F.col("text")).alias("text"), "link", *STYLES, F.when(F.col("_code").isNull(), True).otherwise(_inside("_code")).alias("_of_code"), F.coalesce(_inside("_caption"), F.lit(False)).alias("_of_caption"))


def blocks_of_rows(rows: DataFrame, temporary_hosts: list[str] | None = None) -> DataFrame:
    """(page_id, pos, parent_pos, depth, type, rich_text, language, image_url, caption), a row a content block, of the rows of
    ``explode_nodes(pages, texts=True)``.

    Headings 1 to 3 stay, 4 to 6 are bold paragraphs; a paragraph of images alone gives these; list items hold their inline
    content and paragraphs, other blocks in them are children or follow; text right under a container gives nothing. A page
    keeps its first six images with a valid url; figures have their caption. Text is trimmed and cut at 2000 characters; a block
    of blanks is one blank. A page without blocks has no row."""
    t = staged(_marked(_with_facts(located(rows))), "blocks")
    found = t.where("type is not null").withColumnRenamed("picture", "_picture")
    captions = t.where((F.col("tag") == "#text") & F.col("_of_caption") & (F.col("_sink_tag") == "figure")).groupBy("page_id", F.col("owner").alias("node_id"))
    captions = captions.agg(trimmed(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "")).alias("_text"))
    urls = extract_images(rows.where(F.col("node_id").isNotNull()), temporary_hosts or []).select("page_id", F.col("node_id").alias("_picture"), "url")
    found = found.drop("owner", "_sink_tag", "text", "link", *STYLES, "_of_code", "_of_caption")
    b = found.join(rich_texts(t).withColumnRenamed("owner", "node_id"), ["page_id", "node_id"], "left").join(urls, ["page_id", "_picture"], "left").join(captions, ["page_id", "node_id"], "left")
    image, needs_text = F.col("type") == "image", F.col("type").isin("heading_1", "heading_2", "heading_3", "paragraph", "quote")
    b = b.where(F.when(image, F.col("url").isNotNull()).when(needs_text, F.col("rich_text").isNotNull()).otherwise(True))
    b = b.withColumn("_nth", F.sum(F.when(image, 1).otherwise(0)).over(_page().rowsBetween(*_UPTO))).where(~image | (F.col("_nth") <= MOST_CONTENT))
    none = F.array().cast(f"array<{RUN}>")
    blank = F.array(F.struct(F.lit(" ").alias("content"), F.lit(None).cast("string").alias("link"), *(F.lit(False).alias(s) for s in STYLES))).cast(f"array<{RUN}>")
    rich = F.when(F.size(F.coalesce("rich_text", none)) > 0, F.col("rich_text")).otherwise(blank)
    rich = F.when(F.col("tag").isin("h4", "h5", "h6"), F.transform(rich, lambda r: r.withField("bold", F.lit(True)))).otherwise(rich)
    caption = F.when(image, F.coalesce(F.nullif("_text", F.lit("")), F.nullif("_alt", F.lit(""))))
    b = _nested(b.withColumns({"rich_text": F.when(F.col("type").isin("image", "divider"), none).otherwise(rich), "image_url": F.when(image, F.col("url")), "caption": caption}))
    return b.select("page_id", "pos", "parent_pos", "depth", "type", "rich_text", "language", "image_url", "caption")


def html_to_blocks(pages: DataFrame, temporary_hosts: list[str] | None = None) -> DataFrame:
    """blocks_of_rows of pages(page_id, html), which are parsed once; null and empty pages have no rows."""
    return blocks_of_rows(staged(explode_nodes(pages, texts=True), "rows"), temporary_hosts)
