"""Articles in pages' structured data: the first known path with usable content, and its blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.text import is_title_consistent
from pagemill.functions.urls import bound, path_of
from pagemill.sources.staging import staged

# Where articles stand in pages' data, in the order they are tried, and the kinds of their blocks.
ARTICLE_PATHS = [
    "props.pageProps.pageData", "pageData.pageState.article.data.contentMeta", "props.pageData.pageState.article.data.contentMeta", "props.pageData.pageState.article.data", "pageData.pageState.article.data",
    "props.pageData.pageState.article", "pageData.pageState.article", "initialArticle.data", "initialArticle", "props.initialProps.pageProps.article", "props.pageProps.article", "props.pageProps.post", "props.pageProps.content", "props.pageProps.data",
]
BLOCK_TYPES = {
    "text": "paragraph", "paragraph": "paragraph", "image": "image", "heading": "heading_2", "heading1": "heading_1", "heading2": "heading_2", "heading3": "heading_3", "heading_1": "heading_1", "heading_2": "heading_2",
    "heading_3": "heading_3", "quote": "quote", "blockquote": "quote", "list": "bulleted_list_item", "code": "code",
}


SKIPPED_MODELS = ["byline", "relatedContent", "wsoj", "include", "social-embed"]
IMAGE_BASE = "https://ichef.bbci.co.uk/ace/ws/1024"
ATOM_TAGS = {"h1": "heading_1", "h2": "heading_2", "h3": "heading_3", "blockquote": "quote"}
ENTITIES = {"&nbsp;": "\xa0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}
MOST_TEXT = 200_000  # characters of a block, a hundred runs of 2000
MOST_JSON = 2 * 1024 * 1024
LEAST_BLOCKS = 3
PUSH = "self.__next_f.push("


def _is(v: Column, path: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")).startswith(kind), F.lit(False))


def json_first_path(json: Column, paths: list[str] = ARTICLE_PATHS) -> Column:
    """A struct of path and article (JSON text) of the first path whose node has blocks, content, a body, markup or story atoms
    of the right type; null where there is none, and for null, broken and too large JSON."""
    arrays, strings = ("$.blocks", "$.content.model.blocks", "$.storyAtoms"), ("$.content", "$.body", "$.markup")

    def usable(node: Column) -> Column:
        tests = [_is(node, k, "ARRAY") for k in arrays] + [_is(node, k, "STRING") for k in strings]
        return reduce(lambda a, b: a | b, tests)

    nodes = lambda v: F.array(*(F.struct(F.lit(p).alias("path"), F.try_variant_get(v, f"$.{p}", "variant").alias("node")) for p in paths))
    found = bound(F.try_parse_json(json), lambda v: F.try_element_at(F.filter(nodes(v), lambda x: usable(x["node"])), F.lit(1)))
    return bound(found, lambda x: F.when(x.isNotNull(), F.struct(x["path"].alias("path"), F.to_json(x["node"]).alias("article"))))


def _plain(text: Column) -> Column:
    """Text of a piece of HTML: no tags, the usual character references read, outer white space off."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", "")
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(out, F.lit(" \t\n\r\f\x0b\xa0"))


def _get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _many(v: Column, path: str) -> Column:
    return _get(v, path, "array<variant>")


def _filled(v: Column, path: str) -> Column:
    return F.coalesce(F.size(_many(v, path)) > 0, F.lit(False))


def nested_texts(units: DataFrame) -> DataFrame:
    """(page_id, at, text) of units(page_id, at, model): the model's own text, trimmed, or else the texts of its blocks one after another,
    each found in the same way. The tree is unfolded a level at a time, with the places on the way as the sort key, until no level is left."""
    level = units.select("page_id", "at", F.array().cast("array<int>").alias("path"), "model")
    done = []
    while True:
        v = F.try_parse_json("model")
        t = level.select("page_id", "at", "path", F.trim(F.when(_is(v, "$.text", "STRING"), _get(v, "$.text"))).alias("text"), F.transform(F.coalesce(_many(v, "$.blocks"), F.array().cast("array<variant>")), lambda x: F.to_json(F.coalesce(_get(x, "$.model", "variant"), x))).alias("kids"))
        t = staged(t, "texts")
        own = F.coalesce(F.col("text"), F.lit("")) != ""
        done.append(t.where(own).select("page_id", "at", "path", "text"))
        level = t.where(~own & (F.size("kids") > 0)).select("page_id", "at", "path", F.posexplode("kids").alias("k", "model")).select("page_id", "at", F.array_append("path", F.col("k")).alias("path"), "model")
        if level.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    return found.groupBy("page_id", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "").alias("text"))


def _model_blocks(blocks: DataFrame) -> DataFrame:
    """(page_id, at, type, text, image_url) of blocks(page_id, pos, b) of the kind that holds a type and a model."""
    b = blocks.select("page_id", "pos", _get(F.col("b"), "$.type").alias("kind"), F.to_json(_get(F.col("b"), "$.model", "variant")).alias("model"))
    b = b.where(F.col("kind").isNotNull() & F.col("model").isNotNull() & (F.col("model") != "null") & ~F.col("kind").isin(SKIPPED_MODELS))
    kids = F.posexplode(F.coalesce(_many(F.try_parse_json("model"), "$.blocks"), F.array().cast("array<variant>"))).alias("k", "v")
    parts = b.where(F.col("kind") == "text").select("page_id", "pos", kids).where(_get(F.col("v"), "$.type").isin("paragraph", "introduction"))
    none = F.lit(None).cast("string").alias("image_url")
    parts = parts.select("page_id", F.array("pos", "k").alias("at"), F.lit("paragraph").alias("type"), F.to_json(F.coalesce(_get(F.col("v"), "$.model", "variant"), F.parse_json(F.lit("{}")))).alias("model"), none)
    first = lambda kind: F.try_element_at(F.filter(_many(F.try_parse_json("model"), "$.blocks"), lambda x: _get(x, "$.type") == kind), F.lit(1))
    where = b.where(F.col("kind") == "image").select("page_id", "pos", first("rawImage").alias("raw"), first("caption").alias("caption"))
    url = F.concat(F.lit(IMAGE_BASE + "/"), _get(F.col("raw"), "$.model.originCode"), F.lit("/"), _get(F.col("raw"), "$.model.locator"), F.lit(".webp"))
    images = where.select("page_id", F.array("pos").alias("at"), F.lit("image").alias("type"), F.coalesce(F.to_json(_get(F.col("caption"), "$.model", "variant")), F.lit("{}")).alias("model"), url.alias("image_url")).where("image_url is not null")
    kind = F.when(F.col("kind") == "headline", "heading_1").when(F.col("kind") == "subheadline", "heading_2").otherwise("paragraph")
    rest = b.where(~F.col("kind").isin("text", "image")).select("page_id", F.array("pos").alias("at"), kind.alias("type"), "model", none)
    units = parts.unionByName(images).unionByName(rest)
    t = units.join(nested_texts(units), ["page_id", "at"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    return t.where((F.col("type") == "image") | (F.col("text") != "")).select("page_id", "at", "type", "text", "image_url")


def structured_to_blocks(articles: DataFrame) -> DataFrame:
    """(page_id, pos, type, text, image_url) of articles(page_id, article): a row for each block of ``blocks``, or of
    ``content.model.blocks``, numbered from 0; an image's text is its caption.

    Blocks of the kind with a type and a model are unfolded by nested_texts. Of an article without blocks the story atoms count, or the
    body or markup as one paragraph. A teaser comes first as a quote. Lists and groups of tokens give a row an entry; unknown kinds
    are paragraphs, and paragraphs without text and images without a url go. Null and broken JSON give no rows."""
    v = F.try_parse_json("article")
    many = F.when(_filled(v, "$.blocks"), _many(v, "$.blocks")).otherwise(F.coalesce(_many(v, "$.content.model.blocks"), F.array().cast("array<variant>")))
    body = F.coalesce(*(F.when(_is(v, f"$.{k}", "STRING"), _get(v, f"$.{k}")) for k in ("body", "markup")))
    t = articles.select("page_id", many.alias("many"), _many(v, "$.storyAtoms").alias("atoms"), body.alias("body"), F.when(_filled(v, "$.teaser"), _get(v, "$.teaser", "array<string>")).alias("teaser"))
    modelled = F.exists("many", lambda x: _is(x, "$.type", "STRING") & _is(x, "$.model", "OBJECT") & (F.coalesce(_get(x, "$.blockType"), F.lit("")) == ""))
    t = t.withColumn("kind", F.when(modelled, "model").when(F.size("many") > 0, "blocks").when(F.size("atoms") > 0, "atoms").otherwise("body"))
    b = t.where("kind in ('model', 'blocks')").select("page_id", "kind", F.posexplode("many").alias("pos", "b"))
    none, row = F.lit(None).cast("string"), ("page_id", "at", "type", "text", "image_url")
    g = lambda path: _get(F.col("b"), path)
    kinds = F.create_map(*(F.lit(x) for kv in BLOCK_TYPES.items() for x in kv))
    own = b.where("kind = 'blocks'").withColumn("bt", g("$.blockType"))
    group = lambda x: F.array_join(F.transform(F.coalesce(_get(x, "$", "array<variant>"), F.array().cast("array<variant>")), lambda y: F.coalesce(_get(y, "$.content"), F.lit(""))), "")
    listed = F.when((F.col("bt") == "list") & _many(F.col("b"), "$.items").isNotNull(), F.transform(_get(F.col("b"), "$.items", "array<string>"), _plain))
    tokens = F.when((F.col("bt") == "text") & _many(F.col("b"), "$.htmlTokens").isNotNull(), F.filter(F.transform(_many(F.col("b"), "$.htmlTokens"), group), lambda x: F.trim(x) != ""))
    summary = F.when((F.col("bt") == "summary") & _many(F.col("b"), "$.summary").isNotNull(), F.array(F.array_join(_get(F.col("b"), "$.summary", "array<string>"), "\n")))
    ordered = F.lower(F.coalesce(g("$.ordered"), F.lit("")))
    kind = F.when(summary.isNotNull(), "quote").when(tokens.isNotNull(), "paragraph").when(listed.isNotNull(), F.when(ordered.isin("", "false", "0"), "bulleted_list_item").otherwise("numbered_list_item"))
    mapped = F.coalesce(kinds[F.col("bt")], F.lit("paragraph"))
    single = F.when(mapped.isin("image", "heading_1", "heading_2", "heading_3", "quote"), mapped).otherwise("paragraph")
    text = F.when(single == "image", F.coalesce(g("$.image.caption"), F.lit(""))).otherwise(_plain(g("$.text")))
    entries = own.select("page_id", "pos", F.coalesce(kind, single).alias("type"), kind.isNotNull().alias("many"), F.posexplode(F.coalesce(summary, tokens, listed, F.array(text))).alias("k", "text"), F.coalesce(F.nullif(g("$.image.cdnUrl"), F.lit("")), F.nullif(g("$.image.url"), F.lit(""))).alias("image_url"))
    entries = entries.where(F.when(F.col("type") == "image", F.col("image_url").isNotNull()).otherwise(F.col("many") | (F.col("type") != "paragraph") | (F.col("text") != "")))
    entries = entries.select("page_id", F.array("pos", "k").alias("at"), "type", "text", F.when(F.col("type") == "image", F.col("image_url")).alias("image_url"))
    a = t.where("kind = 'atoms'").select("page_id", F.posexplode("atoms").alias("pos", "b"))
    tag = F.lower(F.coalesce(F.nullif(g("$.tagName"), F.lit("")), F.lit("p")))
    url = F.coalesce(*(F.nullif(g(p), F.lit("")) for p in ("$.url", "$.size.resized.url", "$.size.original.url", "$.size.lightbox.url")))
    is_image = g("$.type") == "image"
    a = a.where(g("$.type").isin("text", "image")).select("page_id", F.array("pos").alias("at"), F.when(is_image, "image").otherwise(F.coalesce(F.create_map(*(F.lit(x) for kv in ATOM_TAGS.items() for x in kv))[tag], F.lit("paragraph"))).alias("type"), F.when(is_image, F.coalesce(g("$.caption"), F.lit(""))).otherwise(_plain(g("$.content"))).alias("text"), F.when(is_image, url).alias("image_url"))
    a = a.where(F.when(F.col("type") == "image", F.col("image_url").isNotNull()).otherwise(F.col("text") != ""))
    lines = F.regexp_replace(F.regexp_replace(F.col("body"), "(?i)</p>", "\n\n"), r"(?i)<br\s*/?>", "\n")
    whole = t.where("kind = 'body'").select("page_id", F.array(F.lit(0)).alias("at"), F.lit("paragraph").alias("type"), _plain(lines).alias("text"), none.alias("image_url")).where("text <> ''")
    teasers = t.where("teaser is not null and kind in ('blocks', 'body')").select("page_id", F.array(F.lit(-1)).alias("at"), F.lit("quote").alias("type"), F.array_join("teaser", "\n").alias("text"), none.alias("image_url"))
    out = entries.unionByName(_model_blocks(b.where("kind = 'model'")).select(*row)).unionByName(a).unionByName(whole).unionByName(teasers)
    pos = F.row_number().over(W.partitionBy("page_id").orderBy("at")) - 1
    return out.select("page_id", pos.alias("pos"), "type", F.substr("text", F.lit(1), F.lit(MOST_TEXT)).alias("text"), "image_url")


def page_data(nodes: DataFrame) -> DataFrame:
    """(page_id, source, place, data): the structured data (JSON text) of pages' scripts, of explode_nodes' rows.

    ``pages``: the first element of the id __NEXT_DATA__, if its text is JSON of 2 MB or less. Of other pages ``app``, a row for each
    object that scripts without an id and a source push in their lines, by place: script, push, line. A line's data follow
    its first colon; of an array the fourth entry counts, if it is an object with content, else the first such object."""
    script, a = F.col("tag") == "script", F.col("attrs")
    first = nodes.where(a["id"] == "__NEXT_DATA__").groupBy("page_id").agg(F.min_by(F.coalesce("text", F.lit("")), "node_id").alias("data"))
    first = first.where((F.char_length("data").between(1, MOST_JSON)) & F.try_parse_json("data").isNotNull())
    none = F.lit(None).cast("int")
    own = first.select("page_id", F.lit("pages").alias("source"), F.struct(none.alias("script"), none.alias("push"), none.alias("line")).alias("place"), "data")
    pushed = nodes.where(script & a["id"].isNull() & a["src"].isNull() & F.contains("text", F.lit(PUSH))).join(first.select("page_id"), "page_id", "left_anti")
    pushes = pushed.select("page_id", "node_id", F.posexplode(F.slice(F.split("text", r"self\.__next_f\.push\(", -1), F.lit(2), F.greatest(F.lit(0), F.size(F.split("text", r"self\.__next_f\.push\(", -1)) - 1))).alias("push", "part"))
    pushes = pushes.select("page_id", "node_id", "push", F.try_variant_get(F.try_parse_json(F.regexp_extract("part", r"^([\s\S]*)\)", 1)), "$[1]", "variant").alias("sent"))
    text = F.when(F.schema_of_variant("sent") == "STRING", F.try_variant_get("sent", "$", "string"))
    whole = F.when(F.schema_of_variant("sent").rlike("^(OBJECT|ARRAY)"), F.array(F.concat(F.lit("0:"), F.to_json("sent"))))
    lines = pushes.select("page_id", "node_id", "push", F.posexplode(F.coalesce(whole, F.split(text, "\n", -1))).alias("line", "row"))
    sent = F.try_parse_json(F.when(F.regexp_extract("row", r"^[^:]*:([\s\S]*)$", 1).rlike(r"^[{\[]"), F.regexp_extract("row", r"^[^:]*:([\s\S]*)$", 1)))
    full = lambda v: F.coalesce(F.schema_of_variant(v).rlike("^OBJECT<.+>$"), F.lit(False))
    items = F.try_variant_get("v", "$", "array<variant>")
    fourth = F.try_element_at(items, F.lit(4))
    chosen = F.when(items.isNull(), F.col("v")).when(full(fourth), fourth).otherwise(F.coalesce(F.try_element_at(F.filter(items, full), F.lit(1)), F.col("v")))
    rows = lines.withColumn("v", sent).where(F.col("v").isNotNull())
    app = rows.select("page_id", F.lit("app").alias("source"), F.struct(F.col("node_id").alias("script"), "push", "line").alias("place"), F.to_json(chosen).alias("data"))
    return own.unionByName(app)


def extract_structured(pages: DataFrame, data: DataFrame) -> DataFrame:
    """(page_id, source, path, article) of pages(page_id, url, title) whose page_data holds an article at a known path: the first
    one by place. Data of another page are left out: data of the page / under another path, data whose asPath isn't
    the page's path, and ``pages`` data whose article has a title that isn't the page's."""
    found = data.select("page_id", "source", "place", "data", json_first_path(F.col("data")).alias("f"), F.try_parse_json("data").alias("v")).where("f is not null")
    best = found.groupBy("page_id").agg(F.min_by(F.struct("source", "data", "f", F.try_variant_get("v", "$.page", "string").alias("page"), F.try_variant_get("v", "$.asPath", "string").alias("as_path")), "place").alias("b")).select("page_id", "b.*")
    j = pages.select("page_id", "url", "title").join(best, "page_id")
    here = path_of("url")
    elsewhere = (F.col("page") == "/") & (here != "/") | (F.coalesce("as_path", F.lit("")) != "") & (F.try_url_decode(F.substring_index("as_path", "?", 1)) != F.try_url_decode(here))
    named = F.try_variant_get(F.try_parse_json("f.article"), "$.title", "string")
    other = (F.coalesce(named, F.lit("")) != "") & ~is_title_consistent(named, F.col("title"))
    stale = (F.col("source") == "pages") & (F.coalesce(elsewhere, F.lit(False)) | F.coalesce(other, F.lit(False)))
    return j.where(~stale).select("page_id", "source", "f.path", "f.article")
