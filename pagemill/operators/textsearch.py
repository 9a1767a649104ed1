"""Search of highlight texts in page texts, and the migration of inline highlights by it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.functions.text import map_color
from pagemill.operators.store import is_object, json_at

# Characters of context looked at on each side, and how many of them make a part.
WINDOW, PART = 64, 10
_HIT = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("length", T.IntegerType())])


def _side(given: str, beside: str, before: bool) -> int:
    """2 if the context stands right beside a hit, 1 if its nearest part is near, else 0."""
    if not given:
        return 0
    given, beside = given.lower(), beside.lower()
    if beside.endswith(given) if before else beside.startswith(given):
        return 2
    near, part = (beside[-WINDOW // 2 :], given[-PART:]) if before else (beside[: WINDOW // 2], given[:PART])
    return int(part in near)


def _find(text: str | None, words: str | None, prefix: str | None, suffix: str | None) -> tuple[int, int] | None:
    if not text or not words or not words.strip():
        return None
    best, top = None, -1
    for hit in re.finditer(r"\s+".join(map(re.escape, words.split())), text, re.IGNORECASE):
        a, z = hit.span()
        score = _side(prefix, text[max(0, a - WINDOW) : a], True) + _side(suffix, text[z : z + WINDOW], False)
        if score > top:
            best, top = (a, z - a), score
        if top == 2 * bool(prefix) + 2 * bool(suffix):
            break
    return best


@F.pandas_udf(_HIT)
def _hits(text: pd.Series, words: pd.Series, prefix: pd.Series, suffix: pd.Series) -> pd.DataFrame:
    found = [_find(*x) or (None, None) for x in zip(text, words, prefix, suffix)]
    return pd.DataFrame(found, columns=["start", "length"]).astype("Int32")


def find_text_in_pages(pages: DataFrame, queries: DataFrame) -> DataFrame:
    """(page_id, query_id, start, length) for pages(page_id, text) and queries(page_id, query_id, text, prefix, suffix).

    Case doesn't count, any white space stands for any other. Of several hits the one whose context fits best counts, the
    first on ties and without context. Blank queries, null texts and queries without a hit have no row."""
    q = queries.select("page_id", "query_id", F.col("text").alias("words"), "prefix", "suffix").where(F.trim(F.coalesce("words", F.lit(""))) != "")
    j = q.join(pages.select("page_id", "text"), "page_id").withColumn("hit", _hits("text", "words", "prefix", "suffix"))
    return j.where("hit.start is not null").select("page_id", "query_id", "hit.start", "hit.length")


def assign_highlight_ids(items: DataFrame, base: Column) -> DataFrame:
    """items(page_id, pos, ...) with id: h and base plus the place among all of the page's items, from 0."""
    place = F.row_number().over(W.partitionBy("page_id").orderBy("pos")) - 1
    return items.withColumn("id", F.concat(F.lit("h"), (base + place).cast("string")))


def migrate_inline(items: DataFrame, pages: DataFrame, base: Column) -> DataFrame:
    """items(page_id, pos, item) with id, text, color, and start and length in the page; null where it failed.

    An item is the JSON of a string, or of an object with text or content, and color, bgColor or backgroundColor. Blank
    texts, other JSON, null, and texts that the page doesn't hold fail."""
    item = F.col("item")
    whole = json_at(item, "$")
    pick = lambda *names: F.coalesce(*(F.nullif(json_at(item, f"$.{n}"), F.lit("")) for n in names))
    text = F.when(F.ltrim(item).startswith('"'), whole).when(is_object(item), pick("text", "content"))
    color = F.when(is_object(item), map_color(pick("color", "bgColor", "backgroundColor"))).otherwise("yellow")
    t = assign_highlight_ids(items.select("page_id", "pos", "item"), base).withColumns({"text": text, "color": color})
    found = find_text_in_pages(pages, t.select("page_id", F.col("id").alias("query_id"), "text", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("suffix")))
    return t.join(found.withColumnRenamed("query_id", "id"), ["page_id", "id"], "left").select("page_id", "pos", "id", "text", "color", "start", "length")


def inline_counts(migrated: DataFrame) -> DataFrame:
    """(page_id, n_success, n_failed) of migrate_inline's rows."""
    return migrated.groupBy("page_id").agg(F.count("start").alias("n_success"), F.count_if(F.col("start").isNull()).alias("n_failed"))
