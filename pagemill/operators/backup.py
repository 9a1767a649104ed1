"""Backups: comparison with the local store, import plans, health and cleanup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.store import aliases, filter_backup_keys, highlight_list, is_array, is_corrupted_page, json_at, route_keys, string_value

REFERENCE_BYTES = 100 * 1024 * 1024
MODES = ("overwrite-all", "new-only", "new-and-overwrite")


def canonical_json(value: Column | str) -> Column:
    """JSON text with object keys sorted at every level; arrays keep their order. Malformed text stays as it is."""
    value = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.to_json(F.try_parse_json(value)), value)


def diff_backup(backup: DataFrame, local: DataFrame) -> DataFrame:
    """(profile_id, key, value, status) of the backup's user rows: new, conflict or identical.

    Only hashes of the canonical values of the local side are shuffled; rows whose hashes are equal are identical."""
    digest = F.sha2(canonical_json("value"), 256)
    b = filter_backup_keys(backup).select("profile_id", "key", "value", digest.alias("_b"))
    own = local.select("profile_id", "key", digest.alias("_l"))
    status = F.when(F.col("_l").isNull(), "new").when(F.col("_l") == F.col("_b"), "identical").otherwise("conflict")
    return b.join(own, ["profile_id", "key"], "left").select("profile_id", "key", "value", status.alias("status"))


def keys_only_local(local: DataFrame, backup: DataFrame) -> DataFrame:
    """Local user keys that the backup lacks."""
    return filter_backup_keys(local).select("profile_id", "key").join(backup.select("profile_id", "key"), ["profile_id", "key"], "left_anti")


def shared_keys(backup: DataFrame, local: DataFrame) -> DataFrame:
    return filter_backup_keys(backup).select("profile_id", "key").intersect(local.select("profile_id", "key"))


def import_plan(mode: str, backup: DataFrame, local: DataFrame) -> DataFrame:
    """(profile_id, key, value, action, status): write, remove or skip. An unknown mode raises.

    overwrite-all writes what is new or differs and removes local user keys the backup lacks, but does nothing for
    a profile without backup rows; new-only skips conflicts; new-and-overwrite removes nothing."""
    if mode not in MODES:
        raise ValueError(f"unknown import mode: {mode}")
    d = diff_backup(backup, local)
    writes = F.col("status") == "new" if mode == "new-only" else F.col("status").isin("new", "conflict")
    plan = d.select("profile_id", "key", F.when(writes, F.col("value")).alias("value"), F.when(writes, "write").otherwise("skip").alias("action"), "status")
    if mode == "overwrite-all":
        told = filter_backup_keys(backup).select("profile_id").distinct()
        gone = keys_only_local(local, filter_backup_keys(backup)).join(told, "profile_id", "left_semi")
        plan = plan.unionByName(gone.select("profile_id", "key", F.lit(None).cast("string").alias("value"), F.lit("remove").alias("action"), F.lit("local").alias("status")))
    return plan


def import_counts(plan: DataFrame) -> DataFrame:
    """A row a profile: n_new, n_overwrite, n_identical, n_conflict_skipped, n_removed, has_work."""
    is_ = lambda status, action=None: F.count_if((F.col("status") == status) & (F.lit(True) if action is None else F.col("action") == action))
    return plan.groupBy("profile_id").agg(is_("new").alias("n_new"), is_("conflict", "write").alias("n_overwrite"), is_("identical").alias("n_identical"), is_("conflict", "skip").alias("n_conflict_skipped"), F.count_if(F.col("action") == "remove").alias("n_removed"), (F.count_if(F.col("action") != "skip") > 0).alias("has_work"))


def entry_size(key: Column | str = "key", value: Column | str = "value") -> Column:
    """UTF-8 bytes of {"key":value} as JSON."""
    quoted = F.to_json(F.array(F.col(key) if isinstance(key, str) else key))
    return (F.octet_length(quoted) + F.octet_length(F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit("null"))) + 1).cast("long")


def cleanup_plan(store: DataFrame) -> DataFrame:
    """(profile_id, key, url, size, reason) of rows that can go: corrupted, empty, orphan, leftover.

    One pass by url pairs page, saved and legacy rows; aliases find their targets by one semi-join."""
    r = route_keys(store)
    v, kind = F.col("value"), F.col("kind")
    size = entry_size()
    pages = r.where(kind == "page")
    page_items = pages.select("profile_id", "key", "url", size.alias("size"), F.when(is_corrupted_page(v), "corrupted").when((F.json_array_length(json_at(v, "$.highlights")) == 0) & (F.coalesce(json_at(v, "$.remote.pageId"), F.lit("")) == ""), "empty").alias("reason"))
    good = pages.where(~is_corrupted_page(v)).select("profile_id", "url").distinct()
    saved = r.where(kind == "saved").select("profile_id", "url").distinct()
    legacy = r.where(kind == "highlights").select("profile_id", "key", "url", size.alias("size"), highlight_list(v).alias("_list"))
    broken = legacy.where("_list is null").select("profile_id", "key", "url", "size", F.lit("corrupted").alias("reason"))
    alone = legacy.where(F.json_array_length("_list") == 0).join(saved, ["profile_id", "url"], "left_anti").join(good, ["profile_id", "url"], "left_anti").select("profile_id", "key", "url", "size", F.lit("orphan").alias("reason"))
    target = string_value(v)
    alias_rows = r.where(kind == "alias").select("profile_id", "key", size.alias("size"), target.alias("url"))
    targets = r.where(kind.isin("page", "highlights", "saved")).select("profile_id", "url").distinct()
    lost = alias_rows.where("url <> ''").join(targets, ["profile_id", "url"], "left_anti").unionByName(alias_rows.where("url is null or url = ''"))
    left = r.where(kind == "leftover").select("profile_id", "key", "url", size.alias("size"), F.lit("leftover").alias("reason"))
    return page_items.where("reason is not null").unionByName(broken).unionByName(alone).unionByName(lost.select("profile_id", "key", "url", "size", F.lit("orphan").alias("reason"))).unionByName(left)


def cleanup_summary(store: DataFrame) -> DataFrame:
    """(profile_id, reason, n, bytes), with a total row of null reason for each profile."""
    return cleanup_plan(store).rollup("profile_id", "reason").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).where("profile_id is not null")


def find_orphans(store: DataFrame) -> DataFrame:
    return cleanup_plan(store).where("reason = 'orphan'").select("profile_id", "key", "url")


def storage_health(store: DataFrame) -> DataFrame:
    """A row a profile: used_bytes, used_mb, percentage, pages, highlights, configs, migration_keys, migration_bytes,
    legacy_saved, corrupted. Legacy lists count only where no sound page row has their url."""
    r = route_keys(store)
    v, kind = F.col("value"), F.col("kind")
    entry = entry_size() - 2  # without the braces
    by_url = r.select("profile_id", "kind", F.coalesce("url", "key").alias("url"), entry.alias("entry"), entry_size().alias("size"), (is_corrupted_page(v) & (kind == "page")).alias("bad_page"), F.when(kind == "page", F.json_array_length(json_at(v, "$.highlights"))).alias("n_page"), F.when(kind == "highlights", F.json_array_length(highlight_list(v))).alias("n_legacy"), (kind.isin("highlights") & highlight_list(v).isNull()).alias("bad_legacy"))
    c = F.count_if
    sound = (F.col("kind") == "page") & ~F.col("bad_page")
    urls = by_url.groupBy("profile_id", "url").agg(
        F.sum("entry").alias("bytes"), F.count("*").alias("entries"), c(sound).alias("pages"), F.sum(F.when(sound, F.col("n_page"))).alias("n_page"),
        c(F.col("n_legacy").isNotNull()).alias("legacy"), F.sum("n_legacy").alias("n_legacy"), c(F.col("kind") == "config").alias("configs"),
        c(F.col("kind") == "leftover").alias("left"), F.sum(F.when(F.col("kind") == "leftover", F.col("size"))).alias("left_bytes"),
        c(F.col("kind") == "saved").alias("saved"), c(F.col("bad_page") | F.col("bad_legacy")).alias("bad"),
    )
    alone = F.col("pages") == 0
    total = urls.groupBy("profile_id").agg(
        (F.sum("bytes") + F.sum("entries") + 1).alias("used_bytes"),
        (F.sum("pages") + F.sum(F.when(alone, F.col("legacy")).otherwise(0))).alias("pages"),
        (F.coalesce(F.sum("n_page"), F.lit(0)) + F.coalesce(F.sum(F.when(alone, F.col("n_legacy"))), F.lit(0))).alias("highlights"),
        F.sum("configs").alias("configs"), F.sum("left").alias("migration_keys"), F.coalesce(F.sum("left_bytes"), F.lit(0)).alias("migration_bytes"),
        F.sum("saved").alias("legacy_saved"), F.sum("bad").alias("corrupted"),
    )
    return total.select("profile_id", "used_bytes", F.round(F.col("used_bytes") / (1024 * 1024), 2).alias("used_mb"), F.round(F.least(F.col("used_bytes") / REFERENCE_BYTES * 100, F.lit(100.0)), 1).alias("percentage"), "pages", "highlights", "configs", "migration_keys", "migration_bytes", "legacy_saved", "corrupted")
