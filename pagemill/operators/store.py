"""Operators over the key-value store: (profile_id, ordinal, key, value) with JSON text values.

``ordinal`` is the insertion order within a profile. All results are per profile; null values count as
JSON null. Keys that repeat within a profile are the caller's mistake: each row is then treated on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import bound, extract_domain, is_root_url, is_valid_alias, normalize_url

# Key prefixes.
PAGE, SAVED, HIGHLIGHTS, ALIAS = "page_", "saved_", "highlights_", "url_alias:"
LEFTOVERS = ["migration_", "_v1_", "_backup_"]
CONFIG_PREFIX, CONFIG_WORD = "config_", "notion"


def _starts(prefix: str) -> Column:
    return F.col("key").startswith(prefix)


def json_at(value: Column | str, path: str) -> Column:
    """The node at a path as text; null for JSON null, missing nodes and malformed values."""
    return F.get_json_object(F.col(value) if isinstance(value, str) else value, path)


def is_object(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\s*\{"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(value.rlike(r"^\s*\["), F.lit(False))


def string_value(value: Column) -> Column:
    """The text of a JSON string, null for other values."""
    return F.when(value.rlike(r'^\s*"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])


def filter_backup_keys(store: DataFrame) -> DataFrame:
    """Rows of user data: page, highlights, saved and alias keys."""
    return store.where(_starts(PAGE) | _starts(HIGHLIGHTS) | _starts(SAVED) | _starts(ALIAS))


def route_keys(store: DataFrame) -> DataFrame:
    """store with ``kind`` (page, highlights, saved, alias, leftover, config, other) and ``url``, the key without
    its prefix (null for leftover, config and other keys)."""
    kind, url = F.lit("other"), F.lit(None).cast("string")
    kind = F.when(_starts(CONFIG_PREFIX) | F.contains("key", F.lit(CONFIG_WORD)), "config").otherwise(kind)
    leftover = F.lit(False)
    for p in LEFTOVERS:
        leftover = leftover | _starts(p)
    kind = F.when(leftover, "leftover").otherwise(kind)
    for name, prefix in (("alias", ALIAS), ("saved", SAVED), ("highlights", HIGHLIGHTS), ("page", PAGE)):
        kind = F.when(_starts(prefix), name).otherwise(kind)
        url = F.when(_starts(prefix), F.substr("key", F.lit(len(prefix) + 1))).otherwise(url)
    return store.select("*", kind.alias("kind"), url.alias("url"))


def is_corrupted_page(value: Column) -> Column:
    """Not an object, or its highlights aren't an array."""
    return ~(is_object(value) & is_array(json_at(value, "$.highlights")))


def highlight_list(value: Column) -> Column:
    """The highlights of a legacy value, as JSON text: the bare array, or the object's highlights; else null."""
    inner = json_at(value, "$.highlights")
    return F.when(is_array(value), value).when(is_object(value) & is_array(inner), inner)


_RECORD = "pageId string, id string, url string, notionUrl string, title string, savedAt string, timestamp string, lastVerifiedAt string, remote string, highlights string, metadata string"
_REMOTE = "pageId string, url string, title string, savedAt string, lastVerifiedAt string"


def _remote_of_saved(o: Column, now: Column) -> Column:
    at = F.coalesce(o["savedAt"].try_cast("double"), o["timestamp"].try_cast("double"), now.cast("double"))
    return F.struct(F.coalesce(o["pageId"], o["id"], F.lit("")).alias("page_id"), F.coalesce(o["url"], o["notionUrl"], F.lit("")).alias("url"), F.coalesce(o["title"], F.lit("")).alias("title"), at.alias("saved_at"), o["lastVerifiedAt"].try_cast("double").alias("last_verified_at"))


def _remote_of_page(r: Column) -> Column:
    return F.struct(r["pageId"].alias("page_id"), r["url"].alias("url"), r["title"].alias("title"), r["savedAt"].try_cast("double").alias("saved_at"), r["lastVerifiedAt"].try_cast("double").alias("last_verified_at"))


def unify_page_state(store: DataFrame, now: Column | None = None) -> DataFrame:
    """One row a profile and url: profile_id, url, remote, highlights (JSON array text), last_updated.

    Page rows are the base; ``remote`` comes from a saved row with an id only where the page has none; highlights
    from a legacy row only where the list is empty and the legacy one isn't; urls with legacy rows alone are
    added. One aggregate by url replaces three joins, so the store is shuffled once."""
    now = now if now is not None else F.lit(0.0)
    r = route_keys(store).where(F.col("kind").isin("page", "saved", "highlights") & (F.col("url") != ""))
    v, o = F.col("value"), F.col("_record")
    r = r.withColumn("_record", F.when(is_object(v), F.from_json(v, _RECORD)))  # each value is parsed once, its remote page once more
    r = r.withColumns({"_remote": F.from_json(o["remote"], _REMOTE), "_updated": F.get_json_object(o["metadata"], "$.lastUpdated").try_cast("double"), "_list": F.when(is_array(o["highlights"]), o["highlights"])})
    page_ok = (F.col("kind") == "page") & o.isNotNull()
    saved_ok = (F.col("kind") == "saved") & o.isNotNull() & (F.coalesce(o["pageId"], o["id"], F.lit("")) != "")
    legacy = F.when(is_array(v), v).otherwise(F.col("_list"))
    legacy_ok = (F.col("kind") == "highlights") & (F.json_array_length(legacy) > 0)
    rows = r.select(
        "profile_id", "url",
        F.when(page_ok, F.struct("ordinal", F.when(o["remote"].isNotNull(), _remote_of_page(F.col("_remote"))).alias("remote"), F.coalesce("_list", F.lit("[]")).alias("highlights"), F.col("_updated").alias("updated"))).alias("page"),
        F.when(saved_ok, F.struct("ordinal", _remote_of_saved(o, now).alias("remote"))).alias("saved"),
        F.when(legacy_ok, F.struct("ordinal", legacy.alias("highlights"))).alias("legacy"),
    ).where("page is not null or saved is not null or legacy is not null")
    one = rows.groupBy("profile_id", "url").agg(F.max("page").alias("page"), F.min("saved").alias("saved"), F.min("legacy").alias("legacy"))
    listed = F.when(F.coalesce(F.json_array_length("page.highlights"), F.lit(0)) > 0, F.col("page.highlights"))
    return one.select("profile_id", "url", F.coalesce("page.remote", "saved.remote").alias("remote"), F.coalesce(listed, F.col("legacy.highlights"), F.lit("[]")).alias("highlights"), F.col("page.updated").alias("last_updated"))


def aliases(store: DataFrame) -> DataFrame:
    """(profile_id, url, target): alias rows whose value is a string of one character or more."""
    r = route_keys(store).where((F.col("kind") == "alias") & (F.col("url") != ""))
    return r.select("profile_id", "url", string_value(F.col("value")).alias("target")).where("target <> ''")


def resolve_canonical(urls: DataFrame, alias_rows: DataFrame) -> DataFrame:
    """urls(profile_id, url, ...) with ``canonical``: the alias's target, or the url itself."""
    a = alias_rows.select("profile_id", "url", F.col("target").alias("_target"))
    return urls.join(a, ["profile_id", "url"], "left").withColumn("canonical", F.coalesce("_target", "url")).drop("_target")


def lookup_highlights(urls: DataFrame, store: DataFrame) -> DataFrame:
    """(profile_id, url, found_key, highlights) for urls(profile_id, url): the first of the page and legacy keys of the
    stable url (a valid alias of the normal form, else of the raw url) and of the normal form that holds a list."""
    a = aliases(store).where(is_valid_alias("target"))
    u = urls.select("profile_id", "url").distinct().withColumn("norm", normalize_url("url"))
    by = lambda name, out: a.select("profile_id", F.col("url").alias(name), F.col("target").alias(out))
    u = u.join(by("norm", "_by_norm"), ["profile_id", "norm"], "left").join(by("url", "_by_raw"), ["profile_id", "url"], "left")
    u = u.withColumn("stable", F.coalesce("_by_norm", "_by_raw", "norm"))
    held_list = lambda v: F.when(_starts(PAGE), F.when(is_object(v) & is_array(json_at(v, "$.highlights")), json_at(v, "$.highlights"))).otherwise(highlight_list(v))
    keys = F.array(*(F.concat(F.lit(p), c) for p in (PAGE, HIGHLIGHTS) for c in ("stable", "norm")))
    wanted = u.select("profile_id", "url", F.posexplode(keys).alias("rank", "key"))
    held = store.select("profile_id", "key", bound(F.col("value"), held_list).alias("list")).where("list is not null")
    best = wanted.join(held, ["profile_id", "key"]).groupBy("profile_id", "url").agg(F.min(F.struct("rank", "key", "list")).alias("b"))
    return u.select("profile_id", "url").join(best, ["profile_id", "url"], "left").select("profile_id", "url", F.col("b.key").alias("found_key"), F.col("b.list").alias("highlights"))


def all_highlights(store: DataFrame) -> DataFrame:
    """(profile_id, url, highlights): lists of page and legacy rows, the page's where both have one."""
    r = route_keys(store).where(F.col("kind").isin("page", "highlights"))
    v = F.col("value")
    lists = r.select("profile_id", "url", (F.col("kind") != "page").alias("legacy"), F.when(F.col("kind") == "page", F.when(~is_corrupted_page(v), json_at(v, "$.highlights"))).otherwise(highlight_list(v)).alias("highlights")).where("highlights is not null")
    return lists.groupBy("profile_id", "url").agg(F.min(F.struct("legacy", "highlights"))["highlights"].alias("highlights"))


def all_saved_urls(store: DataFrame) -> DataFrame:
    """Distinct (profile_id, url) of pages with a remote page and of saved rows."""
    r = route_keys(store)
    return r.where((F.col("kind") == "saved") | (F.col("kind") == "page") & json_at("value", "$.remote").isNotNull()).select("profile_id", "url").distinct()


def pick_group_owner(store: DataFrame) -> DataFrame:
    """One row a canonical url: profile_id, canonical, owner_url, owner_kind, n_highlights, ordinal, value.

    Owners are, in order: an unsynced page with highlights at the canonical url, such a page at any url of the group,
    the first legacy row with highlights. Root urls never own."""
    r = route_keys(store).where(F.col("kind").isin("page", "highlights"))
    v = F.col("value")
    page = F.col("kind") == "page"
    listed = F.when(page, F.when(~is_corrupted_page(v), json_at(v, "$.highlights"))).otherwise(highlight_list(v))
    c = resolve_canonical(r.withColumn("n_highlights", F.coalesce(F.json_array_length(listed), F.lit(0))), aliases(store))
    c = c.where((F.col("n_highlights") > 0) & ~is_root_url("url") & (~page | json_at("value", "$.remote").isNull()))
    rank = F.when(page & (F.col("url") == F.col("canonical")), 0).when(page, 1).otherwise(2)
    w = W.partitionBy("profile_id", "canonical").orderBy(rank, "ordinal", "key")
    return c.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("profile_id", "canonical", F.col("url").alias("owner_url"), F.col("kind").alias("owner_kind"), "n_highlights", "ordinal", "value")


def unsynced_pages(store: DataFrame, limit: int = 10, offset: int = 0) -> DataFrame:
    """A profile-wise page of the unsynced list, newest first: profile_id, url, title, n_highlights, last_updated."""
    owners = pick_group_owner(store)
    saved = route_keys(store).where(F.col("kind") == "saved").select("profile_id", F.col("url").alias("owner_url"), F.coalesce(json_at("value", "$.title"), F.lit("")).alias("_saved_title"))
    o = owners.join(saved, ["profile_id", "owner_url"], "left").where((F.col("owner_kind") == "page") | F.col("_saved_title").isNull())
    blank = lambda c: F.nullif(c, F.lit(""))
    title = F.coalesce(blank(json_at("value", "$.remote.title")), blank(json_at("value", "$.metadata.title")), blank(json_at("value", "$.title")), extract_domain("owner_url"))
    updated = F.coalesce(json_at("value", "$.metadata.lastUpdated").cast("double"), F.lit(0.0))
    w = W.partitionBy("profile_id").orderBy(F.desc("last_updated"), "ordinal")
    listed = o.select("profile_id", F.col("owner_url").alias("url"), title.alias("title"), "n_highlights", updated.alias("last_updated"), "ordinal")
    return listed.withColumn("place", F.row_number().over(w)).where((F.col("place") > offset) & (F.col("place") <= offset + limit)).drop("ordinal")


def order_key(key: Column | str) -> Column:
    """A sort key for natural order: digit runs are compared as numbers of up to 30 digits."""
    key = F.col(key) if isinstance(key, str) else key
    padded = F.regexp_replace(F.regexp_replace(key, r"(\d+)", "000000000000000000000000000000$1"), r"0*(\d{30})", "$1")
    return padded


def order_keys(keys: DataFrame, column: str = "key") -> DataFrame:
    """keys in natural order under the root collation; ties by the raw key."""
    return keys.orderBy(F.collate(order_key(column), "UNICODE"), column)
