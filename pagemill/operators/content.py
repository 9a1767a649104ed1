"""The element that holds a page's main content, chosen by ranks over element rows (page_id, node_id, last_id, ...).

An element's subtree is the ids from node_id to last_id, so that counts below an element are differences of running counts:
one shuffle by page, no walk over ancestors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Selectors of content systems, of article structures and of technical pages, in the order they are tried.
CMS_SELECTORS = [
    ".entry-content", ".post-content", ".article-content", ".content-area", ".single-content", ".main-content", ".txt4", ".page-content", ".content-wrapper", ".article-wrapper", ".post-wrapper", ".content-body", ".article-text",
    ".post-text", ".content-main", ".article-main", ".mobile-content", ".m-content", ".content", ".text-content", ".article-detail", ".post-detail", ".detail-content", ".news-content", ".story-content",
]
ARTICLE_SELECTORS = [
    'article[role="main"]', "article.post", "article.article", "article.content", "article.entry", ".post-body", ".article-body", ".entry-body", ".news-body", ".story-body", ".content-text", ".article-container", ".post-container",
    ".content-container", "article", "main article", ".article", ".post", ".entry", ".news", ".story", "#content", "#main-content", "#article-content", "#post-content", "#article", "#post", "#main",
]
TECHNICAL_SELECTORS = [".markdown-body", ".docs-content", ".documentation", ".gitbook-root", ".md-content", ".prose", "#readme"]
LEAST_TEXT = 250


def _selected(nodes: DataFrame, selectors: list[str]) -> DataFrame:
    """(page_id, rank, e): the first element of each selector that a page has; e holds node_id, last_id, tag, text_len."""
    before = W.partitionBy("page_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, -1)
    in_main = F.coalesce(F.max(F.when(F.col("tag") == "main", F.col("last_id"))).over(before) >= F.col("node_id"), F.lit(False)) 
    nodes = nodes.withColumn("_in_main", in_main if "main article" in selectors else F.lit(False))
    tag, a = F.col("tag"), F.col("attrs")
    classes = F.filter(F.split(F.coalesce(a["class"], F.lit("")), r"\s+"), lambda c: c != "")
    own = F.array_compact(F.array(tag, F.concat(F.lit("#"), a["id"]), F.when((tag == "article") & (a["role"] == "main"), 'article[role="main"]'), F.when((tag == "article") & F.col("_in_main"), "main article")))
    words = F.concat(own, F.transform(classes, lambda c: F.concat(F.lit("."), c)), F.transform(classes, lambda c: F.concat(tag, F.lit("."), c)))
    hits = F.array_intersect(words, F.array(*(F.lit(s) for s in selectors)))
    t = nodes.select("page_id", F.struct("node_id", "last_id", "tag", "text_len").alias("e"), F.explode(hits).alias("hit"))
    return t.groupBy("page_id", F.array_position(F.array(*(F.lit(s) for s in selectors)), F.col("hit")).alias("rank")).agg(F.min("e").alias("e"))


def subtree_counts(nodes: DataFrame, tags: tuple[str, ...], of: tuple[str, ...]) -> DataFrame:
    """Elements of the tags ``of`` with n_<tag>: how many elements of each of ``tags`` they hold, themselves left out."""
    w = W.partitionBy("page_id").orderBy("node_id").rowsBetween(W.unboundedPreceding, 0)
    t = nodes.withColumns({f"_c_{x}": F.sum((F.col("tag") == x).cast("long")).over(w) for x in tags})
    ends = t.select("page_id", F.col("node_id").alias("last_id"), *(F.col(f"_c_{x}").alias(f"_e_{x}") for x in tags))
    j = t.where(F.col("tag").isin(*of)).join(ends, ["page_id", "last_id"])
    return j.select(*nodes.columns, *((F.col(f"_e_{x}") - F.col(f"_c_{x}")).alias(f"n_{x}") for x in tags))


def best_content_container(candidates: DataFrame) -> DataFrame:
    """(page_id, node_id, last_id, tag, score, emergency): of candidates(page_id, node_id, last_id, tag, text_len, n_p, n_img,
    n_a) with 250 characters or more the one of the best score over 0 (text + 50 p + 30 img - 25 a), the first on ties; else,
    as an emergency, the first with half as many. A later candidate never holds an earlier one, since ids are in page order."""
    score = F.col("text_len") + 50 * F.col("n_p") + 30 * F.col("n_img") - 25 * F.col("n_a")
    e = F.struct("node_id", "last_id", "tag", score.cast("long").alias("score"))
    g = candidates.groupBy("page_id").agg(
        F.max_by(e, F.when((F.col("text_len") >= LEAST_TEXT) & (score > 0), F.struct(score, -F.col("node_id")))).alias("best"),
        F.min(F.when(F.col("text_len") >= LEAST_TEXT / 2, e)).alias("first"),
    )
    return g.where("best is not null or first is not null").select("page_id", F.coalesce("best", "first").alias("e"), F.col("best").isNull().alias("emergency")).select("page_id", "e.*", "emergency")


def largest_list(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, last_id, tag, heading_id): the list of four items or more with the best score (10 an item, one for
    ten characters up to 500), and the heading just before it, if any."""
    t = subtree_counts(nodes, ("li",), ("ul", "ol")).where("n_li >= 4")
    score = 10 * F.col("n_li") + F.least(F.lit(500), F.floor(F.col("text_len") / 10))
    best = t.groupBy("page_id").agg(F.max_by(F.struct("node_id", "last_id", "tag", "parent_id"), F.struct(score, -F.col("node_id"))).alias("e")).select("page_id", "e.*")
    heads = nodes.where(F.col("tag").isin("h1", "h2", "h3")).select("page_id", "parent_id", (F.col("last_id") + 1).alias("node_id"), F.col("node_id").alias("heading_id"))
    return best.join(heads, ["page_id", "parent_id", "node_id"], "left").select("page_id", "node_id", "last_id", "tag", "heading_id")


def main_container(nodes: DataFrame) -> DataFrame:
    """(page_id, strategy, node_id, last_id, tag, heading_id), one row for each page that has main content: the body field of
    a Drupal node, else the first of the selectors whose first element has 250 characters (cms, article), else the best
    container (generic, emergency), else the largest list."""
    cms = len(CMS_SELECTORS)
    field = _selected(nodes, [".node__content", ".field--name-field-body"]).groupBy("page_id").agg(F.max(F.when(F.col("rank") == 1, F.col("e"))).alias("n"), F.max(F.when(F.col("rank") == 2, F.col("e"))).alias("b"))
    none = F.lit(None).cast("int").alias("heading_id")
    row = lambda t, k, name, heading=none: t.select("page_id", F.struct(F.lit(k).alias("k"), name.alias("strategy"), "node_id", "last_id", "tag", heading).alias("c"))
    drupal = field.where("b.node_id > n.node_id AND b.node_id <= n.last_id").select("page_id", "b.*")
    named = _selected(nodes, CMS_SELECTORS + ARTICLE_SELECTORS).where(F.col("e.text_len") >= LEAST_TEXT).groupBy("page_id").agg(F.min(F.struct("rank", "e")).alias("m")).select("page_id", "m.rank", "m.e.*")
    generic = best_content_container(subtree_counts(nodes, ("p", "img", "a"), ("article", "section", "main", "div")))
    all_rows = row(drupal, 0, F.lit("drupal")).unionByName(row(named, 1, F.when(F.col("rank") <= cms, "cms").otherwise("article")))
    all_rows = all_rows.unionByName(row(generic, 2, F.when(F.col("emergency"), "emergency").otherwise("generic"))).unionByName(row(largest_list(nodes), 3, F.lit("list"), F.col("heading_id")))
    return all_rows.groupBy("page_id").agg(F.min("c").alias("c")).select("page_id", "c.strategy", "c.node_id", "c.last_id", "c.tag", "c.heading_id")


def markdown_container(nodes: DataFrame) -> DataFrame:
    """(page_id, node_id, last_id, tag): the first element of the first technical selector that the page has."""
    return _selected(nodes, TECHNICAL_SELECTORS).groupBy("page_id").agg(F.min(F.struct("rank", "e")).alias("m")).select("page_id", "m.e.node_id", "m.e.last_id", "m.e.tag")
