"""Markup from element and text rows: subtrees pruned by intervals, and allow-listed HTML written again by an ordered aggregate.

Rows come from ``explode_nodes(pages, texts=True)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.pages import explode_nodes
from pagemill.sources.staging import staged

# Elements and attributes that gated HTML keeps, schemes of its links, elements whose content goes with them.
KEPT_TAGS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "ul", "ol", "li", "blockquote", "pre", "code", "a"]
KEPT_ATTRIBUTES = ["href"]
SAFE_URI = r"(?i)^https?:|^data:(?:image/(?:jpeg|png|gif|webp|svg\+xml)|application/pdf)[;,]|^(?![a-z][-a-z0-9+.]*:)"
DROPPED_WHOLE = ["annotation-xml", "audio", "colgroup", "desc", "foreignobject", "head", "iframe", "math", "mi", "mn", "mo", "ms", "mtext", "noembed", "noframes", "noscript", "plaintext", "script", "style", "svg", "template", "thead", "title", "video", "xmp"]
MOST_HTML = 100_000
# What is no content of a technical page: elements, classes, ids, and classes within others.
NOISE_TAGS = ["script", "iframe", "object", "embed", "noscript", "style", "meta", "link", "base", "form", "button", "input", "select", "textarea"]
NOISE_CLASSES = ["clipboard-button", "copy-button", "octicon-copy", "anchor", "blob-num", "google-auto-placed", "zeroclipboard-container", "language-label", "lang-label"]
NOISE_IDS = ["carbonads"]


def _has_class(name: str) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+", " "), F.lit(" ")).contains(f" {name} ")


def _within(cond: Column) -> Column:
    """Whether a row stands within an element of cond, or is one."""
    page = W.partitionBy("page_id").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return F.coalesce(F.max(F.when(cond, F.col("last_seq"))).over(page) >= F.col("seq"), F.lit(False))


def prune(rows: DataFrame, gone: Column) -> DataFrame:
    """rows without the elements that gone is true of, and without all that these hold."""
    return rows.withColumn("_gone", _within(F.coalesce(gone, F.lit(False)))).where(~F.col("_gone")).drop("_gone")


def without_noise(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """rows of technical containers without buttons, toolbars, line numbers, anchors and labels; where: of which rows (all)."""
    tag, a = F.col("tag"), F.col("attrs")
    named = [_has_class(c) for c in NOISE_CLASSES] + [a["id"] == i for i in NOISE_IDS]
    code = F.map_contains_key(a, F.lit("data-code-text")) & (tag == "span")
    noise = tag.isin(*NOISE_TAGS) | F.map_contains_key(a, F.lit("data-clipboard-target")) | ((tag == "pre") & F.map_contains_key(a, F.lit("hidden"))) | code
    for x in named:
        noise = noise | F.coalesce(x, F.lit(False))
    noise = F.coalesce(noise, F.lit(False)) | (tag == "header") & F.col("_example")
    t = rows.withColumn("_example", _within(_has_class("code-example")))
    return prune(t, noise if where is None else noise & where).drop("_example")


def _escaped(text: Column, quotes: bool = False) -> Column:
    out = text
    for sign, name in (("&", "&amp;"), ("\xa0", "&nbsp;"), *((('"', "&quot;"),) if quotes else (("<", "&lt;"), (">", "&gt;")))):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def write_markup(rows: DataFrame, tags: list[str], attributes: list[str]) -> DataFrame:
    """(page_id, html) of rows: the elements of tags with their attributes, all texts, other elements unwrapped; what the elements of
    DROPPED_WHOLE hold goes. Links of unsafe schemes lose their address. An element's end stands after all that it holds."""
    t = prune(rows, F.col("tag").isin(DROPPED_WHOLE))
    a = F.col("attrs")
    value = lambda name: F.regexp_replace(a[name], r"[\x00-\x20\xa0]", "")
    shown = [F.when(a[n].isNotNull() & (value(n).rlike(SAFE_URI) if n in ("href", "src") else F.lit(True)), F.concat(F.lit(f' {n}="'), _escaped(a[n], quotes=True), F.lit('"'))).otherwise("") for n in attributes]
    event = lambda at, after, order, text: F.struct(at.alias("at"), F.lit(after).alias("after"), order.alias("order"), text.alias("text"))
    opened = event(F.col("seq"), 0, F.lit(0), F.concat(F.lit("<"), F.col("tag"), *shown, F.lit(">")))
    closed = event(F.col("last_seq"), 1, -F.col("seq"), F.concat(F.lit("</"), F.col("tag"), F.lit(">")))
    is_text = F.col("tag") == "#text"
    events = F.when(is_text, F.array(event(F.col("seq"), 0, F.lit(0), _escaped(F.col("text"))))).when(F.col("tag").isin(tags), F.array(opened, closed))
    e = t.select("page_id", F.explode(events).alias("e"))
    return e.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["text"]), "").alias("html"))


def gate_html(pages: DataFrame, most: int = MOST_HTML) -> DataFrame:
    """(page_id, success, reason, html) of pages(page_id, html): refused as empty (null or ''), too_long, or sanitized_empty; else
    the HTML with the fourteen kept elements and links alone. page_id names a row; reason is null on success, html '' otherwise."""
    size = F.char_length(F.coalesce("html", F.lit("")))
    marked = pages.select("page_id", "html", F.when(size == 0, "empty").when(size > most, "too_long").alias("reason"))
    rows = staged(explode_nodes(marked.where("reason is null"), texts=True), "rows")
    written = write_markup(rows, KEPT_TAGS, KEPT_ATTRIBUTES).withColumnRenamed("html", "kept")
    j = marked.select("page_id", "reason").join(written, "page_id", "left")
    kept = F.coalesce("kept", F.lit(""))
    reason = F.coalesce("reason", F.when(kept == "", "sanitized_empty"))
    return j.select("page_id", reason.isNull().alias("success"), reason.alias("reason"), F.when(reason.isNull(), kept).otherwise("").alias("html"))
