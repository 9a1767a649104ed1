"""Putting pages together: styled highlights in blocks, highlight sections, lead blocks, and the payload of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import highlight_annotation
from pagemill.functions.urls import is_http_url, is_temporary_image_url
from pagemill.operators.pages import BATCH, block_text, match_highlights, split_text

# The heading of the highlights' section, the title of a page without one, the text of a page without blocks.
SECTION = "📝 頁面標記"
UNTITLED = "未命名頁面"
NO_BLOCKS = "Content extraction completed but no blocks were generated."
MOST = 2000


def effective_spans(spans: Column) -> Column:
    """spans (array of start, end, annotation) by start, each begun where those before it have ended; empty ones go."""
    s = F.array_sort(spans)
    ended = lambda i: F.coalesce(F.array_max(F.transform(F.slice(s, 1, i), lambda x: x["end"])), F.lit(0))
    cut = F.transform(s, lambda x, i: F.struct(F.greatest(x["start"], ended(i)).alias("start"), x["end"].alias("end"), x["annotation"].alias("annotation")))
    return F.filter(cut, lambda x: x["start"] < x["end"])


def style_spans(blocks: DataFrame, spans: DataFrame, style: list[str]) -> DataFrame:
    """blocks whose ``rich_text`` (array of content and the fields of ``style``) is split where spans(page_id, pos, start,
    length, annotation) begin and end; each piece has its run's style and the annotation of its span, or null.

    Of spans that overlap the first by start (then end) keeps its place. Blocks without spans keep their runs, empty ones
    too. Spans go to their blocks by one join; the splitting is an expression."""
    s = spans.groupBy("page_id", "pos").agg(effective_spans(F.collect_list(F.struct("start", (F.col("start") + F.col("length")).alias("end"), "annotation"))).alias("_spans"))
    j = blocks.join(s, ["page_id", "pos"], "left").withColumn("_spans", F.coalesce("_spans", F.array().cast("array<struct<start:int,end:int,annotation:string>>")))
    runs = F.transform("rich_text", lambda r, i: F.struct(r.alias("r"), F.aggregate(F.slice("rich_text", 1, i), F.lit(0), lambda a, x: a + F.char_length(x["content"])).alias("off")))
    piece = lambda r, content, note: F.struct(content.alias("content"), *(r[x].alias(x) for x in style), note.cast("string").alias("annotation"))

    def split(x: Column) -> Column:
        r, off, n = x["r"], x["off"], F.char_length(x["r"]["content"])
        within = lambda c: F.greatest(F.lit(0), F.least(n, c - off))
        cuts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), n), F.transform("_spans", lambda e: within(e["start"])), F.transform("_spans", lambda e: within(e["end"])))))
        places = F.arrays_zip(F.slice(cuts, F.lit(1), F.size(cuts) - 1).alias("a"), F.slice(cuts, F.lit(2), F.size(cuts) - 1).alias("z"))
        note = lambda a: F.try_element_at(F.filter("_spans", lambda e: (e["start"] <= off + a) & (e["end"] > off + a)), F.lit(1))["annotation"]
        return F.transform(places, lambda p: piece(r, F.substr(r["content"], p["a"] + 1, p["z"] - p["a"]), note(p["a"])))

    plain = F.transform("rich_text", lambda r: piece(r, r["content"], F.lit(None)))
    return j.withColumn("rich_text", F.when(F.size("_spans") == 0, plain).otherwise(F.flatten(F.transform(runs, split)))).select(*blocks.columns)


def highlight_blocks(highlights: DataFrame, title: str = SECTION) -> DataFrame:
    """(page_id, pos, type, content, color): a heading_3 for each page with highlights(page_id, id, ordinal, text, color), then
    a paragraph for each piece of at most 2000 characters of each highlight, in order; pos from 0."""
    t = highlights.select("page_id", "ordinal", "id", F.coalesce("color", F.lit("default")).alias("color"), F.posexplode(split_text(F.col("text"), MOST)).alias("piece", "content"))
    order = W.partitionBy("page_id").orderBy("ordinal", "id", "piece")
    body = t.select("page_id", F.row_number().over(order).alias("pos"), F.lit("paragraph").alias("type"), "content", "color")
    head = highlights.select("page_id").distinct().select("page_id", F.lit(0).alias("pos"), F.lit("heading_3").alias("type"), F.lit(title).alias("content"), F.lit("default").alias("color"))
    return head.unionByName(body)


def merge_highlights(blocks: DataFrame, highlights: DataFrame, style: str, run_style: list[str], title: str = SECTION) -> DataFrame:
    """(page_id, pos, type, rich_text): blocks with each highlight styled in the first block that holds it, and the section of
    all highlights after the last block. ``style`` is COLOR_SYNC, COLOR_TEXT, BOLD or NONE (blocks stay plain)."""
    b = blocks.select("page_id", "pos", "type", "rich_text")
    found = match_highlights(b.select("page_id", "pos", block_text().alias("text")), highlights)
    notes = highlights.select("page_id", F.col("id").alias("highlight_id"), highlight_annotation(F.lit(style), F.col("color")).alias("annotation"))
    spans = found.join(notes, ["page_id", "highlight_id"]).where(F.col("annotation").isNotNull())
    styled = style_spans(b, spans.select("page_id", "pos", "start", "length", "annotation"), run_style)
    last = b.groupBy("page_id").agg((F.max("pos") + 1).alias("_next"))
    kind = styled.schema["rich_text"].dataType.elementType
    fields = {"content": F.col("content"), "annotation": F.col("color")}
    rich = F.array(F.struct(*(fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in kind)))
    section = highlight_blocks(highlights, title).join(last, "page_id", "left").select("page_id", (F.col("pos") + F.coalesce("_next", F.lit(0))).alias("pos"), "type", rich.alias("rich_text"))
    return styled.unionByName(section)


def assemble_blocks(blocks: DataFrame, metadata: DataFrame, include_title: bool = False, include_image: bool = True) -> DataFrame:
    """(page_id, pos, type, text, image_url), a page's rows numbered from 0, for the pages of metadata(page_id, title,
    featured_image): the image, then the title as heading_1, each unless missing or among the page's blocks; then blocks
    (page_id, pos, type, text, image_url), or one paragraph saying that there are none."""
    own = blocks.select("page_id", F.lit(2).alias("part"), F.col("pos").cast("long").alias("pos"), "type", "text", "image_url").join(metadata.select("page_id"), "page_id", "left_semi")
    lead = lambda part, kind, text, image: metadata.select("page_id", F.lit(part).alias("part"), F.lit(0).cast("long").alias("pos"), F.lit(kind).alias("type"), text.alias("text"), image.alias("image_url"))
    none = F.lit(None).cast("string")
    out = own.unionByName(lead(2, "paragraph", F.lit(NO_BLOCKS), none).join(own.select("page_id"), "page_id", "left_anti"))
    if include_image:
        image = lead(0, "image", none, F.col("featured_image")).where(F.coalesce("image_url", F.lit("")) != "")
        out = out.unionByName(image.join(own.where("type = 'image'").select("page_id", "image_url"), ["page_id", "image_url"], "left_anti"))
    if include_title:
        title = lead(1, "heading_1", F.substr(F.col("title"), F.lit(1), F.lit(MOST)), none).where(F.coalesce("text", F.lit("")) != "")
        out = out.unionByName(title.join(own.where("type = 'heading_1'").select("page_id", "text"), ["page_id", "text"], "left_anti"))
    at = F.row_number().over(W.partitionBy("page_id").orderBy("part", "pos")) - 1
    return out.select("page_id", at.alias("pos"), "type", "text", "image_url")


def build_page_payload(pages: DataFrame, blocks: DataFrame, signed_hosts: list[str]) -> DataFrame:
    """(page_id, parent, properties, icon, cover, children) of pages(page_id, url, title, source_id, source_type, site_icon,
    cover_image): a page's parent is a page or a data source, which has a url too; covers are http and not temporary; the
    first hundred blocks, by pos, are children. No page's other blocks are gathered."""
    rn = F.row_number().over(W.partitionBy("page_id").orderBy("pos"))
    rest = [c for c in blocks.columns if c not in ("page_id", "pos")]
    kids = blocks.withColumn("_rn", rn).where(F.col("_rn") <= BATCH).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("_rn", F.struct(*rest).alias("b")))).alias("k"))
    j = pages.join(kids.select("page_id", F.transform("k", lambda x: x["b"]).alias("children")), "page_id", "left")
    under = F.col("source_type") == "page"
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED))
    cover = F.when(is_http_url("cover_image") & ~is_temporary_image_url("cover_image", signed_hosts), F.col("cover_image"))
    kind = blocks.select(F.array(F.struct(*rest)).alias("c")).schema["c"].dataType
    return j.select(
        "page_id", F.struct(F.when(under, "page_id").otherwise("data_source_id").alias("type"), F.col("source_id").alias("id")).alias("parent"),
        F.struct(title.alias("title"), F.when(~F.coalesce(under, F.lit(False)), F.coalesce("url", F.lit(""))).alias("url")).alias("properties"), F.nullif("site_icon", F.lit("")).alias("icon"), cover.alias("cover"),
        F.coalesce("children", F.array().cast(kind)).alias("children"),
    )
