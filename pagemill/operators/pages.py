"""Page extraction: element tables, blocks, metadata, complexity, and the relational work on blocks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions import html as h
from pagemill.functions.urls import host_of, origin_of, path_of, scheme_of
from pagemill.sources.staging import staged

NODES = "page_id long, node_id int, parent_id int, tag string, attrs map<string,string>, text_len int, text string, last_id int"
TEXTS = ", seq int, last_seq int, parent_tag string, item_id int"
BATCH = 100
PIECE_CHARS = 1 << 18  # characters of pages that a task turns into rows at a time, however many come in one Arrow batch
PIECE_TEXTS = 100  # the same for texts
# Patterns of documentation sites.
DOC_HOST = r"\.github\.io$|^docs?\.|\.readthedocs\.io$|\.gitbook\.io$|^wiki\.|^api\.|^developer\.|^guide\."
_DOC_PATH = r"/docs?/|/documentation/|/guide/|/manual/|/api/|/reference/|/cli/"
DOC_PATH = _DOC_PATH + r"|/wiki/|/getting-started/|/tutorial/"
TECH_URL = _DOC_PATH + r"|/commands?/|github\.io.*docs|\.github\.io"
TECH_TITLE = "documentation|commands?|reference|guide|manual|cli|api"


def explode_nodes(pages: DataFrame, texts: bool = False) -> DataFrame:
    """One row an element: page_id, node_id, parent_id, tag, attrs, text_len, text where the element holds text alone,
    and last_id: the elements below it have the ids after its own up to that.

    With texts, also a row for each text (tag #text, no node_id), and for all rows seq, last_seq, parent_tag and item_id: see
    functions.html.page_rows. A null page has no rows."""
    read = h.page_rows if texts else h.element_rows
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.int32(), pa.string(), pa.int32(), *([pa.int32(), pa.int32(), pa.string(), pa.int32()] if texts else [])]
    schema = NODES + (TEXTS if texts else "")
    names = [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]):
        rows, size = [], 0
        for b in batches:
            for page, text in zip(*b.columns):
                page, text = page.as_py(), text.as_py()
                rows += [(page, *r[:3], None if r[3] is None else list(r[3].items()), *r[4:]) for r in read(text)]
                size += len(text or "")
                if size >= PIECE_CHARS and rows:
                    yield made(rows)
                    rows, size = [], 0
        if rows:
            yield made(rows)

    return pages.select("page_id", "html").mapInArrow(run, schema)


def element_table(pages: DataFrame) -> DataFrame:
    """explode_nodes' rows, written once: what reads them in several branches then doesn't read each page again in each."""
    return staged(explode_nodes(pages), "elements")


def html_to_text(html: Column) -> Column:
    """Visible text of an HTML string; '' for null."""
    return _visible(html)


@F.arrow_udf(T.StringType())
def _visible(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for a in pages:
        for at in range(0, len(a), PIECE_TEXTS):
            yield pa.array([h.visible_text(x.as_py()) for x in a.slice(at, PIECE_TEXTS)], pa.string())


def block_text(rich_text: str = "rich_text") -> Column:
    return F.array_join(F.transform(rich_text, lambda r: r["content"]), "")


def page_metrics(nodes: DataFrame) -> DataFrame:
    """Counts a page: ads, nav, content, code, markdown containers, images, videos, and the text length of the body."""
    cls = F.concat(F.lit(" "), F.coalesce(F.col("attrs")["class"], F.lit("")), F.lit(" "))
    has = lambda *names: cls.rlike(" (?:" + "|".join(names) + ") ")
    tag = F.col("tag")
    src = F.coalesce(F.col("attrs")["src"], F.lit(""))
    c = F.count_if
    return nodes.groupBy("page_id").agg(
        c(has("ad", "ads", "advertisement", "sponsor")).alias("ad_elements"), c(tag.isin("nav", "header", "footer", "aside") | has("sidebar", "navigation")).alias("nav_elements"),
        c(tag.isin("article", "main", "section") | has("content", "post", "entry")).alias("content_elements"), c(tag.isin("pre", "code") | has("highlight", "codehilite")).alias("code_blocks"),
        c(has("markdown-body", "markdown")).alias("markdown_containers"), c(tag == "img").alias("images"),
        c((tag == "video") | (tag == "iframe") & src.rlike("youtube|vimeo")).alias("videos"), F.coalesce(F.max(F.when(tag == "body", F.col("text_len"))), F.lit(0)).cast("long").alias("text_length"),
    )


def classify_documentation(url: Column, title: Column) -> Column:
    """A struct of host, path, tech_url, tech_title, is_doc, is_technical."""
    u, t = F.coalesce(F.lower(url), F.lit("")), F.lower(F.coalesce(title, F.lit("")))
    host, path, tech, named = host_of(u).rlike(DOC_HOST), path_of(u).rlike(DOC_PATH), u.rlike(TECH_URL), t.rlike(TECH_TITLE)
    return F.struct(host.alias("host"), path.alias("path"), tech.alias("tech_url"), named.alias("tech_title"), (host | path | tech | named).alias("is_doc"), (tech | named).alias("is_technical"))


def page_complexity(metrics: DataFrame) -> DataFrame:
    """metrics (with is_doc_site and has_technical_content) with the complexity flags."""
    c = F.col
    return metrics.withColumns(
        {
            "is_clean": c("is_doc_site") | ((c("ad_elements") <= 2) & (c("nav_elements") <= 3) & (c("content_elements") >= 1)),
            "has_markdown_features": (c("code_blocks") >= 3) | (c("markdown_containers") > 0),
            "has_ads": c("ad_elements") > 3,
            "is_complex_layout": (c("nav_elements") > 5) | (c("content_elements") > 0) & (c("nav_elements") / F.greatest(c("content_elements"), F.lit(1)) > 3),
            "is_long_form": c("text_length") > 5000,
            "has_rich_media": (c("images") > 10) | (c("videos") > 2),
        }
    )


def select_extractor(complexity: DataFrame) -> DataFrame:
    """complexity with extractor, confidence (0 to 100), fallback_required and reasons."""
    c = F.col
    forced = c("markdown_containers") > 0
    readability = c("has_ads") | c("is_complex_layout") | c("has_rich_media") | c("is_long_form")
    n = lambda cond, k: F.when(cond, k).otherwise(0)
    md = 50 + n(c("is_clean"), 20) + n(c("has_markdown_features"), 15) + n(c("has_technical_content"), 15) - n(c("has_ads"), 25) - n(c("is_complex_layout"), 15)
    rd = 50 + n(c("has_ads"), 20) + n(c("is_complex_layout"), 15) + n(c("has_rich_media"), 10) + n(c("is_long_form"), 10) - n(c("is_clean") & ~c("has_ads"), 15)
    reason = lambda cond, text: F.when(cond, text)
    reasons = F.when(forced, F.array(F.lit("markdown container"))).when(readability, F.array_compact(F.array(reason(c("has_ads"), "ads"), reason(c("is_complex_layout"), "complex layout"), reason(c("has_rich_media"), "rich media"), reason(c("is_long_form"), "long form")))).otherwise(F.array_compact(F.array(reason(c("is_clean"), "clean page"), reason(c("has_markdown_features"), "markdown features"), reason(c("has_technical_content"), "technical content"))))
    return complexity.withColumns(
        {
            "extractor": F.when(forced | ~readability, "markdown").otherwise("readability"),
            "confidence": F.when(forced, 95).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.when(readability, rd).otherwise(md)))),
            "fallback_required": F.when(forced, False).otherwise((c("text_length") < 500) | c("has_ads") & c("has_technical_content")),
            "reasons": reasons,
        }
    )


def is_content_good(html_len: Column, link_len: Column, n_li: Column) -> Column:
    """HTML of 250 characters or more, and eight list items or a link share of a quarter at most."""
    return (html_len >= 250) & ((n_li >= 8) | (link_len / F.greatest(html_len, F.lit(1)) <= 0.25))


def absolute_url(href: Column, base: Column) -> Column:
    """href as seen from base: as it is, on its scheme, from its root, or beside it."""
    path = F.regexp_extract(path_of(base), r"^(.*/)", 1)
    return F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), href).when(href.startswith("//"), F.concat(scheme_of(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(origin_of(base), href)).otherwise(F.concat(origin_of(base), path, href))


def icon_score(url: Column, kind: Column, size: Column, priority: Column, apple: Column) -> Column:
    """A site icon's score: its format, its size, whether it is a touch icon, and ten for each place before the tenth."""
    plain = F.lower(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#][\s\S]*$", ""))
    return icon_format_score(plain, F.lower(F.coalesce(kind, F.lit("")))) + icon_size_score(F.coalesce(size, F.lit(0))) + F.when(apple, 50).otherwise(0) + (10 - priority) * 10


def best_site_icon(candidates: DataFrame) -> DataFrame:
    """(page_id, url, score) of the best of candidates(page_id, ordinal, url, type, sizes, priority, apple): the highest icon_score, the first on
    ties."""
    score = icon_score(F.col("url"), F.col("type"), parse_icon_size(F.col("sizes")), F.col("priority"), F.col("apple"))
    g = candidates.groupBy("page_id").agg(F.max_by(F.struct("url", score.alias("score")), F.struct(score, -F.col("ordinal"))).alias("x"))
    return g.select("page_id", "x.url", "x.score")


def extract_metadata(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, url, title, author, description, favicon, site_icon, featured_image): the first of each field's
    candidates in its order of preference; the icon of the best icon_score. Icons are absolute; a page without any has its site's
    /favicon.ico."""
    a, tag, url = F.col("attrs"), F.col("tag"), F.col("url")
    name = F.lower(F.coalesce(a["name"], a["property"], F.lit("")))
    meta = lambda *names: F.min(F.when((tag == "meta") & name.isin(*names) & (F.coalesce(a["content"], F.lit("")) != ""), F.struct(F.array_position(F.array(*(F.lit(x) for x in names)), name).alias("rank"), "node_id", a["content"].alias("v"))))
    rel, href = F.lower(F.coalesce(a["rel"], F.lit(""))), F.coalesce(a["href"], F.lit(""))
    rank = lambda rels: F.array_position(F.array(*map(F.lit, rels)), rel)
    icon = (tag == "link") & rel.isin(SITE_ICONS) & (F.trim(href) != "") & ~href.startswith("data:")
    score = icon_score(href, a["type"], parse_icon_size(a["sizes"]), rank(SITE_ICONS), rel.startswith("apple"))
    first = lambda name: F.min(F.when(tag == name, F.struct("node_id", F.col("text").alias("v"))))
    g = nodes.groupBy("page_id").agg(
        first("title").alias("title"), first("h1").alias("h1"), meta("author", "article:author", "twitter:creator").alias("author"), meta("description", "og:description", "twitter:description").alias("description"),
        F.min(F.when((tag == "link") & rel.isin(FAVICONS) & (href != ""), F.struct(rank(FAVICONS).alias("rank"), "node_id", href.alias("v")))).alias("favicon"),
        F.max(F.when(icon, F.struct(score.alias("score"), (-rank(SITE_ICONS)).alias("rank"), (-F.col("node_id")).alias("first"), href.alias("v")))).alias("icon"), meta("og:image", "twitter:image").alias("image"),
    )
    j = pages.select("page_id", "url").join(g, "page_id", "left")
    usual = F.concat(origin_of(url), F.lit("/favicon.ico"))
    title = F.coalesce(F.nullif(F.trim("title.v"), F.lit("")), F.trim("h1.v"), F.lit(""))
    return j.select("page_id", "url", title.alias("title"), F.col("author.v").alias("author"), F.col("description.v").alias("description"), F.coalesce(absolute_url(F.col("favicon.v"), url), usual).alias("favicon"), F.coalesce(absolute_url(F.col("icon.v"), url), usual).alias("site_icon"), F.col("image.v").alias("featured_image"))


def parse_icon_size(s: Column) -> Column:
    """any is 999, WxH is W, leading digits count; else 0."""
    s = F.lower(F.trim(F.coalesce(s, F.lit(""))))
    return F.when(s == "any", 999).otherwise(F.coalesce(F.nullif(F.regexp_extract(s, r"^(\d+)", 1), F.lit("")).cast("int"), F.lit(0)))


# Scores of icons by format and size; links that name a page's icon, in the order they are looked for.
SITE_ICONS = ["apple-touch-icon", "apple-touch-icon-precomposed", "icon", "shortcut icon"]
FAVICONS = ["icon", "shortcut icon", "apple-touch-icon"]


def icon_format_score(url: Column, kind: Column) -> Column:
    return F.when(url.endswith(".svg") | url.contains("image/svg") | kind.contains("svg"), 1000).when(url.endswith(".png") | kind.contains("png"), 500).when(url.endswith(".ico") | kind.contains("ico"), 100).when(url.endswith(".jpg") | url.endswith(".jpeg") | kind.contains("jpeg"), 200).otherwise(0)


def icon_size_score(size: Column) -> Column:
    return F.when(size == 999, 500).when(size.between(180, 256), 300).when(size > 256, 200).when(size >= 120, 100).when(size >= 1, 50).otherwise(0)


def batch_blocks(blocks: DataFrame, size: int = BATCH) -> DataFrame:
    """blocks with batch (from 0), n_batches and with_page (the first batch goes with the page's creation)."""
    w = W.partitionBy("page_id")
    t = blocks.withColumn("_rn", F.row_number().over(w.orderBy("pos")) - 1).withColumn("batch", F.floor(F.col("_rn") / size))
    return t.withColumn("n_batches", F.ceil(F.count("*").over(w) / size)).withColumn("with_page", F.col("batch") == 0).drop("_rn")


def block_requests(blocks: DataFrame, size: int = BATCH) -> DataFrame:
    """(page_id, batch, n_batches, with_page, children): a row a request of at most ``size`` blocks, its children in order."""
    rest = [c for c in blocks.columns if c != "page_id"]
    g = batch_blocks(blocks, size).groupBy("page_id", "batch", "n_batches", "with_page").agg(F.array_sort(F.collect_list(F.struct("pos", F.struct(*rest).alias("b")))).alias("k"))
    return g.select("page_id", "batch", "n_batches", "with_page", F.transform("k", lambda x: x["b"]).alias("children"))


def highlight_section(blocks: DataFrame, title: str) -> DataFrame:
    """The first heading_3 with the title, and what follows it up to the next heading of any level."""
    w = W.partitionBy("page_id").orderBy("pos")
    head = (F.col("type") == "heading_3") & (F.col("text") == title)
    t = blocks.withColumn("_start", F.min(F.when(head, F.col("pos"))).over(W.partitionBy("page_id"))).where("pos >= _start")
    t = t.withColumn("_heads", F.sum(F.when(F.col("type").startswith("heading_"), 1).otherwise(0)).over(w))
    return t.where("_heads = 1").drop("_start", "_heads")


def merge_runs(runs: DataFrame, style: list[str]) -> DataFrame:
    """runs(page_id, pos, text, *style) with equal neighbours joined: page_id, run, first_pos, text, *style."""
    w = W.partitionBy("page_id").orderBy("pos")
    new = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.struct(*style).eqNullSafe(F.lag(F.struct(*style)).over(w))).cast("int"))
    t = runs.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return t.groupBy("page_id", "run", *style).agg(F.min("pos").alias("first_pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


def text_to_paragraphs(text: Column, least: int = 10) -> Column:
    """Parts between blank lines, trimmed, without those shorter than ``least``."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n", -1), lambda p: F.trim(p, F.lit(" \t\n\r\x0b\x0c"))), lambda p: F.char_length(p) >= least)


def chunk_fixed(text: Column, size: int = 2000, most: int = 100) -> Column:
    """Slices of a fixed size, at most ``most`` of them; none for null and ''."""
    n = F.least(F.lit(most), F.ceil(F.char_length(text) / size)).cast("int")
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(text, k * size + 1, F.lit(size))))


def split_text(text: Column, limit: int = 2000) -> Column:
    """Chunks of at most ``limit`` characters, broken after the last sentence end or at the last blank beyond half."""

    def cut(t: str | None) -> list[str]:
        if not t or len(t) <= limit:
            return [t or ""]
        out, a, z = [], 0, len(t)  # what is left is t[a:z]
        while a < z:
            if z - a <= limit:
                out.append(t[a:z])
                break
            for mark in ("\n\n", "\n", "。", ".", "？", "?", "！", "!"):
                k = t.rfind(mark, a, a + limit - 1 + len(mark)) - a
                if k > limit * 0.5:
                    at = k + len(mark)
                    break
            else:
                k = t.rfind(" ", a, a + limit) - a
                at = k if k > limit * 0.5 else limit
            out.append(t[a : a + at].strip())
            a += at
            while a < z and t[a].isspace():
                a += 1
            while a < z and t[z - 1].isspace():
                z -= 1
        return [x for x in out if x]

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in texts:
            for at in range(0, len(b), PIECE_TEXTS):
                yield pa.array([cut(x.as_py()) for x in b.slice(at, PIECE_TEXTS)], pa.list_(pa.string()))

    return run(text)


def match_highlights(blocks: DataFrame, highlights: DataFrame) -> DataFrame:
    """(page_id, highlight_id, pos, start, length): where a highlight's text stands in a block, white space made single.

    One candidate counts if the text has 50 characters, there is no context, or the context scores; of several the best
    score wins, the first on ties, and none with context but without a score. A highlight goes to its first block.
    Pairs are made within a page only, after a containment test."""
    squeeze = lambda c: F.regexp_replace(c, r"\s+", " ")
    b = blocks.select("page_id", "pos", squeeze(F.col("text")).alias("_full"))
    t = highlights.select("page_id", F.col("id").alias("highlight_id"), F.trim(squeeze(F.col("text"))).alias("_t"), squeeze(F.coalesce("prefix", F.lit(""))).alias("_p"), squeeze(F.coalesce("suffix", F.lit(""))).alias("_s"))
    j = b.join(t, "page_id").where((F.col("_t") != "") & F.contains("_full", F.col("_t")))

    def place(full: str, text: str, prefix: str, suffix: str) -> int:
        found, at = [], full.find(text)
        while at >= 0:
            left, right = full[max(0, at - len(prefix)) : at], full[at + len(text) : at + len(text) + len(suffix)]
            side = lambda c, whole, part: 0 if not c else 2 if whole else 1 if part else 0
            found.append((side(prefix, left.endswith(prefix), left.endswith(prefix[-10:])) + side(suffix, right.startswith(suffix), right.startswith(suffix[:10])), -at))
            at = full.find(text, at + 1)
        score, at = max(found)
        context = bool(prefix or suffix)
        ok = (len(text) >= 50 or not context or score > 0) if len(found) == 1 else (score > 0 or not context)
        return -at if ok else -1

    @F.arrow_udf(T.IntegerType())
    def offset(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for b in batches:
            for at in range(0, len(b[0]), PIECE_TEXTS):
                yield pa.array([place(*x) for x in zip(*(c.slice(at, PIECE_TEXTS).to_pylist() for c in b))], pa.int32())

    hit = j.select("page_id", "highlight_id", "pos", offset("_full", "_t", "_p", "_s").alias("start"), F.char_length("_t").alias("length")).where("start >= 0")
    return hit.groupBy("page_id", "highlight_id").agg(F.min(F.struct("pos", "start", "length")).alias("m")).select("page_id", "highlight_id", "m.pos", "m.start", "m.length")


def merge_unique_images(content: DataFrame, extra: DataFrame) -> DataFrame:
    """extra(page_id, pos, type, image_url) without images that the page's content has, or that came earlier in extra."""
    images = F.col("type") == "image"
    new = extra.where(images).join(content.where(images).select("page_id", "image_url"), ["page_id", "image_url"], "left_anti")
    first = new.withColumn("_rn", F.row_number().over(W.partitionBy("page_id", "image_url").orderBy("pos"))).where("_rn = 1").drop("_rn")
    return extra.where(~images).unionByName(first.select(*extra.columns))


def best_srcset_url(srcset: Column) -> Column:
    """The candidate of the largest width (times 1000) or density, the first on ties; without any, the last that isn't data."""
    entries = F.filter(F.transform(F.split(srcset, r",\s+"), lambda e: F.trim(e)), lambda e: e != "")

    def metric(e):
        d = F.regexp_extract(e, r"\s([\d.]+)[wx]$", 1)
        return F.when(d == "", 0.0).when(e.endswith("w"), d.try_cast("double") * 1000).otherwise(d.try_cast("double"))

    url = lambda e: F.regexp_extract(e, r"^(\S+)", 1)
    best = F.array_max(F.transform(entries, lambda e, i: F.struct(metric(e).alias("m"), (-i).alias("i"), url(e).alias("u"))))
    plain = F.filter(entries, lambda e: ~e.startswith("data:"))
    return F.when(best["m"] > 0, best["u"]).otherwise(url(F.try_element_at(plain, F.lit(-1))))
