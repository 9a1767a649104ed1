"""Whole-page extraction: the newest version of each page, read once; its article from structured data or else from the element that
holds it; images; one row a page and its blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import filter_restricted, is_root_url, resolve_storage_url
from pagemill.operators.assembly import NO_BLOCKS, UNTITLED
from pagemill.operators.blocks import RUN, STYLES, blocks_of_rows
from pagemill.operators.content import main_container, markdown_container
from pagemill.operators.images import extract_images, select_images
from pagemill.operators.markup import without_noise
from pagemill.operators.pages import BATCH, classify_documentation, explode_nodes, extract_metadata, page_complexity, page_metrics, select_extractor
from pagemill.operators.structured import LEAST_BLOCKS, extract_structured, page_data, structured_to_blocks
from pagemill.sources.staging import staged

# Fixed value: the text of a page whose content could not be found.
NO_CONTENT = "擷取內容失敗。頁面可能為空白或受保護。"


def latest_pages(pages: DataFrame) -> DataFrame:
    """One page a canonical url, the one of the greatest page_id; restricted and root urls are left out. Only ids are
    shuffled for the choice; the pages come back by a semi-join on page_id."""
    c = filter_restricted(pages).withColumn("canonical", resolve_storage_url("url")).where(~is_root_url("canonical"))
    chosen = c.groupBy("canonical").agg(F.max("page_id").alias("page_id"))
    return c.join(chosen.select("page_id"), "page_id", "left_semi")


def _run(text: Column) -> Column:
    return F.array(F.struct(text.alias("content"), F.lit(None).cast("string").alias("link"), *(F.lit(False).alias(s) for s in STYLES))).cast(f"array<{RUN}>")


def content_choice(nodes: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, kind, strategy, node_id, last_id, heading_id): the element whose blocks are a page's content. Of pages(page_id, url, title) that
    ask for the markdown extractor it is the first technical container; of all others, and where there is none, the main one."""
    doc = classify_documentation(F.col("url"), F.col("title"))
    metrics = page_metrics(nodes).join(pages.select("page_id", doc.alias("doc")), "page_id").withColumns({"is_doc_site": F.col("doc.is_doc"), "has_technical_content": F.col("doc.is_technical")})
    wanted = select_extractor(page_complexity(metrics)).where("extractor = 'markdown'").select("page_id")
    technical = markdown_container(nodes).join(wanted, "page_id", "left_semi")
    none = F.lit(None).cast("int")
    technical = technical.select("page_id", F.lit("markdown").alias("kind"), F.lit("technical").alias("strategy"), "node_id", "last_id", none.alias("heading_id"))
    rest = main_container(nodes).join(technical.select("page_id"), "page_id", "left_anti")
    return technical.unionByName(rest.select("page_id", F.lit("html").alias("kind"), "strategy", "node_id", "last_id", "heading_id"))


def content_rows(rows: DataFrame, choice: DataFrame) -> DataFrame:
    """The rows of explode_nodes(pages, texts=True) within each page's chosen element, and within the heading before it, if any; of technical
    containers without their noise."""
    at = rows.where(F.col("node_id").isNotNull()).select("page_id", "node_id", F.struct("seq", "last_seq").alias("at"))
    spans = choice.select("page_id", "kind", F.explode(F.array_compact(F.array("node_id", "heading_id"))).alias("node_id")).join(at, ["page_id", "node_id"])
    spans = spans.groupBy("page_id").agg(F.first("kind").alias("_kind"), F.sort_array(F.collect_list("at")).alias("spans"))  # one or two
    j = rows.join(spans, "page_id").where(F.exists("spans", lambda x: F.col("seq").between(x["seq"], x["last_seq"])))
    return without_noise(j, F.col("_kind") == "markdown").drop("spans", "_kind")


def _clipped(pages: DataFrame, temporary_hosts: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """extract_pages' table with _n, the number of blocks of the content, and these blocks."""
    hosts = temporary_hosts or []
    latest = latest_pages(pages)
    rows = staged(explode_nodes(latest, texts=True), "rows")
    nodes = rows.where(F.col("node_id").isNotNull()).drop("seq", "last_seq", "parent_tag", "item_id")
    meta = staged(extract_metadata(latest, nodes).join(latest.select("page_id", "canonical"), "page_id"), "metadata")
    articles = staged(extract_structured(meta, page_data(nodes)), "articles")
    told = structured_to_blocks(articles)
    enough = told.groupBy("page_id").count().where(F.col("count") >= LEAST_BLOCKS).select("page_id")
    choice = staged(content_choice(nodes, meta).join(enough, "page_id", "left_anti"), "choice")
    image = F.col("type") == "image"
    told = told.join(enough, "page_id", "left_semi").select(
        "page_id", (F.row_number().over(W.partitionBy("page_id").orderBy("pos")) - 1).alias("pos"), F.lit(None).cast("int").alias("parent_pos"), F.lit(0).alias("depth"), "type",
        F.when(image, F.array().cast(f"array<{RUN}>")).otherwise(_run(F.col("text"))).alias("rich_text"), F.lit(None).cast("string").alias("language"), "image_url", F.when(image, F.nullif("text", F.lit(""))).alias("caption"),
    )
    own = staged(told.unionByName(blocks_of_rows(content_rows(rows, choice), hosts)), "content")
    shown = own.where(image & F.col("image_url").isNotNull()).select("page_id", "pos", F.col("image_url").alias("url"))
    others = extract_images(nodes, hosts).where("status = 'accepted'").select("page_id", F.col("node_id").alias("pos"), "url").join(shown.select("page_id", "url"), ["page_id", "url"], "left_anti")
    known = articles.select("page_id").join(enough, "page_id", "left_semi").union(choice.select("page_id"))
    others = others.join(known, "page_id", "left_semi").withColumn("gallery", F.lit(False))
    extra = select_images(shown, others).where("part = 'extra'").groupBy("page_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "url"))), lambda x: x["url"]).alias("urls"))
    none = shown.select("page_id").distinct().withColumn("_has", F.lit(True))
    extra = extra.join(none, "page_id", "left").select("page_id", F.when(F.col("_has").isNull(), F.col("urls")[0]).alias("lead_image"), F.when(F.col("_has").isNull(), F.slice("urls", 2, 1_000)).otherwise(F.col("urls")).alias("extra_images"))
    counts = own.groupBy("page_id").agg(F.count("*").alias("_n"))
    named = articles.join(enough, "page_id", "left_semi").select("page_id", F.lit("nextjs").alias("kind"), F.col("path").alias("strategy")).unionByName(choice.select("page_id", "kind", "strategy"))
    j = meta.join(named, "page_id", "left").join(counts, "page_id", "left").join(extra, "page_id", "left")
    n = F.greatest(F.lit(1), F.coalesce("_n", F.lit(0)) + F.when(F.col("lead_image").isNotNull(), 1).otherwise(0))
    out = j.select("page_id", "canonical", F.coalesce(F.nullif("title", F.lit("")), F.lit(UNTITLED)).alias("title"), "kind", "strategy", F.when(F.col("kind").isNull(), "failed").otherwise("success").alias("status"), n.alias("n_blocks"), F.ceil(n / BATCH).alias("n_batches"), "lead_image", F.coalesce("extra_images", F.array().cast("array<string>")).alias("extra_images"), F.coalesce("_n", F.lit(0)).alias("_n"))
    return out, own


def clip_pages(pages: DataFrame, temporary_hosts: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The pages' table of extract_pages, and their blocks: page_id, pos and the columns of blocks_of_rows, with the lead image in
    front and the paragraph of a page without blocks."""
    out, own = _clipped(pages, temporary_hosts)
    out = staged(out, "pages")
    lead = F.when(F.col("lead_image").isNotNull(), 1).otherwise(0)
    moved = own.join(out.select("page_id", lead.alias("_lead")), "page_id").withColumns({"pos": F.col("pos") + F.col("_lead"), "parent_pos": F.col("parent_pos") + F.col("_lead")}).drop("_lead")
    text = lambda c: c.cast("string")
    added = lambda kind, rich, url: [F.lit(0).alias("pos"), F.lit(None).cast("int").alias("parent_pos"), F.lit(0).alias("depth"), F.lit(kind).alias("type"), rich.alias("rich_text"), text(F.lit(None)).alias("language"), text(url).alias("image_url"), text(F.lit(None)).alias("caption")]
    first = out.where("lead_image is not null").select("page_id", *added("image", F.array().cast(f"array<{RUN}>"), F.col("lead_image")))
    message = F.when(F.col("status") == "failed", NO_CONTENT).otherwise(NO_BLOCKS)
    fallback = out.where("_n = 0 and lead_image is null").select("page_id", *added("paragraph", _run(message), F.lit(None)))
    return out.drop("_n"), moved.unionByName(first).unionByName(fallback)


def extract_pages(pages: DataFrame, temporary_hosts: list[str] | None = None) -> DataFrame:
    """(page_id, canonical, title, kind, strategy, status, n_blocks, n_batches, lead_image, extra_images) of the latest pages of
    pages(page_id, url, html).

    kind is nextjs, markdown or html; status is success, or failed without content. An article in structured data with three
    blocks or more comes first, then the technical or main container. A page whose content has no image gets its first
    other image in front; up to two in all, or two more of a page with one image, are taken. A page without blocks has one
    paragraph that says so. Each page is parsed once; all branches read the written rows."""
    return _clipped(pages, temporary_hosts)[0].drop("_n")
