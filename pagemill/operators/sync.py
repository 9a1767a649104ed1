"""Snapshots of page state, their restoration, and decisions about syncing and saving."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.operators.store import ALIAS, HIGHLIGHTS, PAGE, SAVED, aliases, is_array, is_object, json_at, route_keys, unify_page_state

HIGHLIGHT = "id string, text string, color string, rangeInfo string, timestamp double, updatedAt double"


def highlight_rows(state: DataFrame) -> DataFrame:
    """(profile_id, page_key, pos, highlight_id, text, color, range_info, created_at, updated_at) of a unified state."""
    items = F.from_json("highlights", "array<string>")
    h = state.select("profile_id", F.col("url").alias("page_key"), F.posexplode(items).alias("pos", "h"))
    at = lambda name: json_at("h", f"$.{name}")
    return h.select("profile_id", "page_key", "pos", F.coalesce(at("id"), F.lit("")).alias("highlight_id"), F.coalesce(at("text"), F.lit("")).alias("text"), at("color").alias("color"), F.when(is_object(at("rangeInfo")), at("rangeInfo")).alias("range_info"), at("timestamp").cast("double").alias("created_at"), at("updatedAt").cast("double").alias("updated_at"))


def saved_state_rows(state: DataFrame) -> DataFrame:
    return state.where("remote is not null").select("profile_id", F.col("url").alias("page_key"), F.col("remote.page_id").alias("remote_page_id"), F.col("remote.url").alias("remote_url"), F.col("remote.title").alias("title"), F.col("remote.saved_at").alias("saved_at"), F.col("remote.last_verified_at").alias("last_verified_at"))


def filter_reachable_aliases(alias_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Aliases whose target is a page_key of pages, in the same profile."""
    keys = pages.select("profile_id", F.col("page_key").alias("target")).distinct()
    return alias_rows.join(keys, ["profile_id", "target"], "left_semi").select("profile_id", "url", "target")


def build_snapshot(store: DataFrame, now: Column | None = None) -> dict[str, DataFrame]:
    """highlights, saved_states, url_aliases and metadata of every profile. Empty pages are left out.

    The payload hash is a SHA-256 of the pages' hashes in order of their key, in two levels: of each of 256 buckets of keys,
    and of the buckets, so that a large profile is shared by tasks. Equal states have equal hashes."""
    state = unify_page_state(store, now)
    highlights, saved = highlight_rows(state), saved_state_rows(state)
    pages = highlights.select("profile_id", "page_key").unionByName(saved.select("profile_id", "page_key"))
    kept = filter_reachable_aliases(aliases(store), pages)
    one = state.where((F.json_array_length("highlights") > 0) | F.col("remote").isNotNull())
    hashed = one.select("profile_id", "url", F.sha2(F.to_json(F.struct("url", "remote", "highlights")), 256).alias("h"), F.json_array_length("highlights").alias("n"), F.col("remote").isNotNull().alias("s"))
    ordered = lambda by: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "h"))), lambda x: x["h"]), ""), 256)
    bucket = F.substr(F.sha2("url", 256), F.lit(1), F.lit(2)).alias("bucket")
    level = hashed.groupBy("profile_id", bucket).agg(F.count("*").alias("pages"), F.sum("n").alias("n_highlights"), F.count_if("s").alias("n_saved_states"), ordered("url").alias("h"))
    meta = level.groupBy("profile_id").agg(F.sum("pages").alias("pages"), F.sum("n_highlights").alias("n_highlights"), F.sum("n_saved_states").alias("n_saved_states"), ordered("bucket").alias("payload_hash"))
    return {"highlights": highlights, "saved_states": saved, "url_aliases": kept, "metadata": meta}


def change_fingerprint(length: Column, updated_at: Column) -> Column:
    """The cheap mark of a change: length:updatedAt."""
    return F.concat_ws(":", length.cast("string"), F.coalesce(updated_at.cast("string"), F.lit("")))


def snapshot_summary(highlights: DataFrame, saved_states: DataFrame) -> DataFrame:
    """A row a profile: distinct page keys over both tables, and the number of highlights."""
    keys = highlights.select("profile_id", "page_key", F.lit(1).alias("h")).unionByName(saved_states.select("profile_id", "page_key", F.lit(0).alias("h")))
    by_page = keys.groupBy("profile_id", "page_key").agg(F.sum("h").alias("h"))
    return by_page.groupBy("profile_id").agg(F.count("*").alias("page_count"), F.sum("h").alias("highlight_count"))


def apply_snapshot(highlights: DataFrame, saved_states: DataFrame, url_aliases: DataFrame, store: DataFrame, now: Column) -> DataFrame:
    """(profile_id, key, value, action): what a restore writes and removes.

    Each page of the snapshot gets its saved state, or keeps the local one; its highlights replace the local list if it
    has any. Page rows are mirrored to saved and highlights rows. Aliases that the snapshot doesn't hold, or whose
    target it lacks, are removed. Rows with an empty page key are left out."""
    item = F.struct(F.col("highlight_id").alias("id"), "text", "color", F.col("range_info").alias("rangeInfo"), F.col("created_at").alias("timestamp"), F.col("updated_at").alias("updatedAt"))
    h = highlights.where("page_key <> ''").groupBy("profile_id", "page_key").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x["item"])).alias("new_list"))  # one page's list
    remote = F.to_json(F.struct(F.col("remote_page_id").alias("pageId"), F.col("remote_url").alias("url"), "title", F.coalesce("saved_at", now.cast("double")).alias("savedAt"), F.col("last_verified_at").alias("lastVerifiedAt")))
    s = saved_states.where("page_key <> ''").select("profile_id", "page_key", remote.alias("new_remote"))
    local = route_keys(store).where("kind = 'page'").select("profile_id", F.col("url").alias("page_key"), json_at("value", "$.remote").alias("old_remote"), F.when(is_array(json_at("value", "$.highlights")), json_at("value", "$.highlights")).alias("old_list"))
    pages = h.join(s, ["profile_id", "page_key"], "full_outer").join(local, ["profile_id", "page_key"], "left")
    pages = pages.select("profile_id", "page_key", F.coalesce("new_remote", "old_remote").alias("r"), F.coalesce("new_list", "old_list", F.lit("[]")).alias("l"))
    stamp = F.concat(F.lit('"metadata":{"createdAt":'), now.cast("string"), F.lit(',"lastUpdated":'), now.cast("string"), F.lit(',"migratedFrom":"snapshot"}'))
    body = F.concat(F.lit('{"remote":'), F.coalesce("r", F.lit("null")), F.lit(',"highlights":'), F.col("l"), F.lit(","), stamp, F.lit("}"))
    rows = F.array(F.struct(F.concat(F.lit(PAGE), "page_key").alias("key"), body.alias("value")), F.struct(F.concat(F.lit(SAVED), "page_key").alias("key"), F.col("r").alias("value")), F.struct(F.concat(F.lit(HIGHLIGHTS), "page_key").alias("key"), F.when(F.json_array_length("l") > 0, F.col("l")).alias("value")))
    written = pages.select("profile_id", F.explode(rows).alias("w")).where("w.value is not null").select("profile_id", "w.key", "w.value", F.lit("write").alias("action"))
    kept = filter_reachable_aliases(url_aliases.where("url <> '' and target <> ''"), pages.select("profile_id", "page_key"))
    alias_rows = kept.select("profile_id", F.concat(F.lit(ALIAS), "url").alias("key"), F.expr("substr(to_json(array(target)), 2, length(to_json(array(target))) - 2)").alias("value"), F.lit("write").alias("action"))
    gone = store.where(F.col("key").startswith(ALIAS)).select("profile_id", "key").join(alias_rows.select("profile_id", "key"), ["profile_id", "key"], "left_anti")
    return written.unionByName(alias_rows).unionByName(gone.select("profile_id", "key", F.lit(None).cast("string").alias("value"), F.lit("remove").alias("action")))


def auto_sync_decision(meta: DataFrame, now: Column) -> DataFrame:
    """meta with should_run and reason; the first rule that hits names the reason. Columns: logged_in,
    connection_email, frequency, dirty_revision, last_uploaded_revision, needs_manual_review, next_eligible_at."""
    c = F.col
    present = c("frequency").isNotNull() | c("connection_email").isNotNull() | c("dirty_revision").isNotNull()
    reason = (
        F.when(~present, "missing_metadata").when(c("logged_in") == F.lit(False), "account_not_logged_in")
        .when(F.coalesce("connection_email", F.lit("")) == "", "drive_not_connected").when(c("frequency") == "off", "frequency_off")
        .when(c("dirty_revision") <= c("last_uploaded_revision"), "not_dirty").when(c("needs_manual_review"), "needs_manual_review")
        .when(c("next_eligible_at") > now, "not_yet_eligible").otherwise("all_conditions_met")
    )
    return meta.withColumn("reason", reason).withColumn("should_run", F.col("reason") == "all_conditions_met")


def next_eligible_at(frequency: Column, now: Column) -> Column:
    """now plus one day, seven days, or else thirty."""
    days = F.when(frequency == "daily", 1).when(frequency == "weekly", 7).otherwise(30)
    return (now.cast("timestamp") + F.make_dt_interval(days)).cast("timestamp")


def save_status(saved: DataFrame, checks: DataFrame, now_ms: Column, ttl_ms: int = 60_000) -> DataFrame:
    """saved(page_key, remote_page_id, last_verified_at) with status, can_save, can_sync, by
    checks(remote_page_id, page_exists, confirmed): unsaved, saved, unverified_saved, deletion_pending, deleted_remote."""
    j = saved.join(checks.select("remote_page_id", "page_exists", "confirmed"), "remote_page_id", "left")
    fresh = now_ms - F.coalesce("last_verified_at", F.lit(0.0)) < ttl_ms
    status = (
        F.when(F.coalesce("remote_page_id", F.lit("")) == "", "unsaved").when(fresh, "saved").when(F.col("page_exists").isNull(), "unverified_saved")
        .when(F.col("page_exists"), "saved").when(F.col("confirmed"), "deleted_remote").otherwise("deletion_pending")
    )
    out = j.withColumn("status", status)
    return out.withColumn("can_save", F.col("status").isin("unsaved", "deleted_remote")).withColumn("can_sync", F.col("status").isin("saved", "unverified_saved"))


def verify_saved(saved: DataFrame, remote_pages: DataFrame) -> DataFrame:
    """saved with ``presence``: exists, missing, or unknown where remote_pages(remote_page_id, page_exists) says nothing."""
    j = saved.join(remote_pages.select("remote_page_id", F.col("page_exists").alias("_e")), "remote_page_id", "left")
    return j.withColumn("presence", F.when(F.col("_e").isNull(), "unknown").when(F.col("_e"), "exists").otherwise("missing")).drop("_e")


def needs_new_page(page_id: Column, saved_profile: Column, profile: Column) -> Column:
    """No remote page, or one saved under another destination profile (none means the default one)."""
    return (F.coalesce(page_id, F.lit("")) == "") | (F.coalesce(saved_profile, F.lit("default")) != F.coalesce(profile, F.lit("default")))


def rank_sources(items: DataFrame, limit: int = 100, preserve_order: bool = False) -> DataFrame:
    """items(object, parent_type, property_types, ordinal, ...) with ``place``: pages, databases and data sources without
    saved web pages, workspace pages first, then sources with a url, category pages, other sources, other pages."""
    has_url = F.array_contains(F.split(F.coalesce("property_types", F.lit("")), ","), "url")
    is_db = F.col("object").isin("database", "data_source")
    saved_page = (F.col("object") == "page") & F.col("parent_type").isin("database_id", "data_source_id") & has_url
    valid = items.where(F.col("object").isin("page", "database", "data_source") & ~F.coalesce(saved_page, F.lit(False)))
    bucket = F.when(is_db & has_url, 1).when(is_db, 3).when(F.col("parent_type") == "workspace", 0).when(F.col("parent_type") == "page_id", 2).otherwise(4)
    order = ["ordinal"] if preserve_order else ["_bucket", "ordinal"]
    top = valid.withColumn("_bucket", bucket).orderBy(*order).limit(limit)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).drop("_bucket")  # of at most ``limit`` rows


def search_sources(items: DataFrame, query: str) -> DataFrame:
    """Items whose title or id holds the query, whatever the case; a blank query gives all."""
    q = query.strip().lower()
    return items if not q else items.where(F.contains(F.lower("title"), F.lit(q)) | F.contains(F.lower("id"), F.lit(q)))
