"""Migration of legacy records to stable urls, scans of what is left, and deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import bound, is_root_url, is_valid_alias, normalize_url
from pagemill.operators.store import ALIAS, HIGHLIGHTS, PAGE, SAVED, aliases, all_highlights, highlight_list, is_array, is_object, json_at, route_keys, unify_page_state

STATE_PREFIX = "migration_"


def items_of(value: Column) -> Column:
    """A list's highlights as JSON texts; null where it isn't a list."""
    return F.from_json(value, "array<string>")


def is_legacy_format(value: Column) -> Column:
    """Whether any highlight of a page or legacy value lacks rangeInfo."""
    bare = F.coalesce(items_of(highlight_list(value)), F.array().cast("array<string>"))
    return F.exists(bare, lambda h: json_at(h, "$.rangeInfo").isNull())


def migration_scan(store: DataFrame) -> DataFrame:
    """A row a profile: total_highlights, legacy_count, needs_migration, over the highlights_ rows."""
    r = route_keys(store).where("kind = 'highlights'")
    n = F.coalesce(F.json_array_length(highlight_list(F.col("value"))), F.lit(0))
    return r.groupBy("profile_id").agg(F.sum(n).alias("total_highlights"), F.count_if(is_legacy_format(F.col("value"))).alias("legacy_count")).withColumn("needs_migration", F.col("legacy_count") > 0)


def migration_items(store: DataFrame) -> DataFrame:
    """(profile_id, url, n_highlights) of the highlights_ rows in a legacy format."""
    r = route_keys(store).where("kind = 'highlights'").where(is_legacy_format(F.col("value")))
    return r.select("profile_id", "url", F.json_array_length(highlight_list(F.col("value"))).alias("n_highlights"))


def migration_status(store: DataFrame) -> DataFrame:
    """A row a profile: completed, failed, pending, by the phase of the migration_ rows."""
    phase = F.coalesce(json_at("value", "$.phase"), F.lit(""))
    r = store.where(F.col("key").startswith(STATE_PREFIX))
    return r.groupBy("profile_id").agg(F.count_if(phase == "completed").alias("completed"), F.count_if(phase == "failed").alias("failed"), F.count_if(~phase.isin("completed", "failed")).alias("pending"))


def completed_migration_keys(store: DataFrame) -> DataFrame:
    return store.where(F.col("key").startswith(STATE_PREFIX) & (json_at("value", "$.phase") == "completed")).select("profile_id", "key")


def pending_lists(store: DataFrame) -> DataFrame:
    """(profile_id, url, total, pending, failed) where a highlight waits for its range or has failed."""
    failed = lambda h: F.coalesce(json_at(h, "$.migrationFailed") == "true", F.lit(False))
    waits = lambda h: F.coalesce(json_at(h, "$.needsRangeInfo") == "true", F.lit(False)) & ~failed(h)
    counts = lambda x: F.struct(F.size(x).alias("total"), F.size(F.filter(x, waits)).alias("pending"), F.size(F.filter(x, failed)).alias("failed"))
    t = all_highlights(store).select("profile_id", "url", bound(items_of(F.col("highlights")), counts).alias("n"))
    return t.select("profile_id", "url", "n.*").where("pending > 0 or failed > 0")


def drop_failed_highlights(state: DataFrame) -> DataFrame:
    """state with the failed highlights gone from ``highlights``, and n_removed."""
    stays = lambda h: ~F.coalesce(json_at(h, "$.migrationFailed") == "true", F.lit(False))
    shrink = lambda x: bound(F.filter(x, stays), lambda kept: F.struct((F.size(x) - F.size(kept)).alias("n_removed"), F.concat(F.lit("["), F.array_join(kept, ","), F.lit("]")).alias("highlights")))
    t = state.withColumn("_kept", bound(items_of(F.col("highlights")), shrink))
    return t.withColumns({"n_removed": F.col("_kept.n_removed"), "highlights": F.col("_kept.highlights")}).drop("_kept")


def batch_summary(details: DataFrame, by: list[str]) -> DataFrame:
    """n_success, n_failed (whatever isn't a success) and the label success, failed or partial."""
    t = details.groupBy(*by).agg(F.count_if(F.col("status") == "success").alias("n_success"), F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("n_failed"))
    return t.withColumn("label", F.when(F.col("n_failed") == 0, "success").when(F.col("n_success") == 0, "failed").otherwise("partial"))


def same_remote_page(id_a: Column, url_a: Column, id_b: Column, url_b: Column) -> Column:
    """By page id where both have one, else by url without query, fragment and trailing slash; else null."""
    bare = lambda u: F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"/+$", "")
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.when(given(id_a) & given(id_b), F.replace(id_a, F.lit("-"), F.lit("")) == F.replace(id_b, F.lit("-"), F.lit(""))).when(given(url_a) & given(url_b), bare(url_a) == bare(url_b))


def same_highlights(there: Column, moved: Column) -> Column:
    """Whether two lists of highlights (arrays of JSON texts, the first not empty) are equivalent: equally long, and, where all have
    ids, the same ids with the same items whatever their order; else the same items in the same order."""
    ids = lambda xs: F.transform(xs, lambda h: F.coalesce(json_at(h, "$.id"), F.lit("")))
    named = lambda xs: F.forall(xs, lambda h: F.coalesce(json_at(h, "$.id"), F.lit("")) != "")
    by_id = (F.size(F.array_distinct(ids(moved))) == F.size(there)) & F.forall(there, lambda h: F.array_contains(moved, h))
    return (F.size(there) == F.size(moved)) & F.when(named(there) & named(moved), by_id).otherwise(there == moved)


def migrate_to_stable(store: DataFrame, pairs: DataFrame, format_converter: Callable[[Column], Column] | None = None) -> DataFrame:
    """pairs(profile_id, legacy_url, stable_url) with ``outcome`` and what the stable page then holds: remote_page_id, highlights.

    refused: an empty, equal or root target, or nothing to move; moved: the stable page had no highlights (its own
    remote page wins); cleaned: its highlights are equivalent; kept or supplemented: they differ, and the stable page
    takes the legacy remote page only where it has none; conflict says that both have other remote pages.
    format_converter maps the legacy highlights (JSON array text) to what is moved; what isn't an array then counts as empty.

    Pairs that share a stable url are taken in their order (column ordinal where pairs has it, then legacy_url), each meeting what those
    before it left: the first list that isn't empty stays, and so does the first remote page that a pair other than a cleaned
    one brings. That is two running values of a window, so a stable url with very many legacy ones is streamed."""
    state = unify_page_state(store).select("profile_id", "url", "remote", "highlights")
    side = lambda name: state.select("profile_id", F.col("url").alias(f"{name}_url"), F.col("remote").alias(f"{name}_remote"), F.col("highlights").alias(f"{name}_list"))
    j = pairs.join(side("legacy"), ["profile_id", "legacy_url"], "left").join(side("stable"), ["profile_id", "stable_url"], "left")
    listed = F.coalesce("legacy_list", F.lit("[]"))
    moved = format_converter(listed) if format_converter else listed
    j = j.withColumns({"moved": F.coalesce(items_of(moved), F.array().cast("array<string>")), "own": F.coalesce(items_of(F.col("stable_list")), F.array().cast("array<string>"))})
    refused = (F.coalesce("stable_url", F.lit("")) == "") | (F.coalesce("legacy_url", F.lit("")) == "") | (F.col("stable_url") == F.col("legacy_url")) | is_root_url("stable_url") | (F.col("legacy_remote").isNull() & (F.json_array_length(listed) == 0))
    j = j.withColumn("refused", F.coalesce(refused, F.lit(True)))
    order = [F.col("ordinal")] if "ordinal" in pairs.columns else []
    before = W.partitionBy("profile_id", "stable_url").orderBy(*order, "legacy_url").rowsBetween(W.unboundedPreceding, -1)
    brings = ~F.col("refused") & (F.size("moved") > 0)
    j = j.withColumn("there", F.when(F.size("own") > 0, F.col("own")).otherwise(F.coalesce(F.first(F.when(brings, F.col("moved")), True).over(before), F.array().cast("array<string>"))))
    empty = F.size("there") == 0
    j = j.withColumn("cleaned", ~F.col("refused") & ~empty & F.coalesce(same_highlights(F.col("there"), F.col("moved")), F.lit(False)))
    gives = F.when(~F.col("refused") & ~F.col("cleaned"), F.col("legacy_remote"))
    j = j.withColumn("known", F.coalesce("stable_remote", F.first(gives, True).over(before)))
    lacks = F.col("known").isNull() & F.col("legacy_remote").isNotNull()
    outcome = F.when(F.col("refused"), "refused").when(empty, "moved").when(F.col("cleaned"), "cleaned").when(lacks, "supplemented").otherwise("kept")
    differ = same_remote_page(F.col("known.page_id"), F.col("known.url"), F.col("legacy_remote.page_id"), F.col("legacy_remote.url")) == F.lit(False)
    accepted = outcome != "refused"
    remote = F.when(accepted, F.when(outcome == "cleaned", F.col("known")).otherwise(F.coalesce("known", "legacy_remote")))
    result = F.when(accepted, F.when(outcome == "moved", F.col("moved")).otherwise(F.col("there")))
    out = j.withColumns({"outcome": outcome, "remote": remote, "highlights": F.concat(F.lit("["), F.array_join(result, ","), F.lit("]")), "conflict": F.coalesce(differ, F.lit(False)) & (outcome == "kept")})
    return out.select("profile_id", *(["ordinal"] if order else []), "legacy_url", "stable_url", "outcome", F.col("remote.page_id").alias("remote_page_id"), "highlights", "conflict", "remote")


def migration_writes(store: DataFrame, moves: DataFrame) -> DataFrame:
    """(profile_id, key, action, value) of migrate_to_stable's rows: the page row of each stable url whose page changes, as the last of its
    pairs leaves it, saying which url it was moved from first; an alias row for each pair that wasn't refused; and the removal of
    the legacy rows of pairs that were moved or cleaned."""
    taken = moves.where("outcome <> 'refused'")
    at = F.struct(*(["ordinal"] if "ordinal" in moves.columns else []), "legacy_url")
    changes = F.col("outcome").isin("moved", "supplemented")
    last = taken.groupBy("profile_id", "stable_url").agg(F.max_by(F.struct("remote", "highlights"), at).alias("x"), F.min_by("legacy_url", F.when(F.col("outcome") == "moved", at)).alias("first_url"), F.bool_or(changes).alias("changed")).where("changed")
    r = F.col("x.remote")
    remote = F.when(r.isNotNull(), F.to_json(F.struct(r["page_id"].alias("pageId"), r["url"].alias("url"), r["title"].alias("title"), r["saved_at"].cast("long").alias("savedAt")))).otherwise("null")
    own = route_keys(store).where("kind = 'page'").where(is_object(F.col("value"))).select("profile_id", F.col("url").alias("stable_url"), json_at("value", "$.metadata").alias("metadata"))
    meta = F.coalesce("metadata", F.when(F.col("first_url").isNotNull(), F.to_json(F.struct(F.col("first_url").alias("migratedFrom")))), F.lit("{}"))
    pages = last.join(own, ["profile_id", "stable_url"], "left").select("profile_id", F.concat(F.lit(PAGE), "stable_url").alias("key"), F.lit("set").alias("action"), F.concat(F.lit('{"remote":'), remote, F.lit(',"highlights":'), F.col("x.highlights"), F.lit(',"metadata":'), meta, F.lit("}")).alias("value"))
    quoted = F.regexp_extract(F.to_json(F.array("stable_url")), r"^\[(.*)\]$", 1)
    names = taken.select("profile_id", F.concat(F.lit(ALIAS), "legacy_url").alias("key"), F.lit("set").alias("action"), quoted.alias("value")).distinct()
    old = taken.where(F.col("outcome").isin("moved", "cleaned")).select("profile_id", F.explode(F.array(*(F.concat(F.lit(x), "legacy_url") for x in (PAGE, SAVED, HIGHLIGHTS)))).alias("key")).distinct()
    gone = store.select("profile_id", "key").join(old, ["profile_id", "key"], "left_semi").select("profile_id", "key", F.lit("remove").alias("action"), F.lit(None).cast("string").alias("value"))
    return pages.unionByName(names).unionByName(gone)


def collect_deletion_keys(pages: DataFrame, store: DataFrame) -> DataFrame:
    """(profile_id, url, key): for each of pages(profile_id, url), the existing keys of its group: page and legacy keys of
    its stable, normal and own url, and of every other url whose alias leads to the same stable url."""
    a = aliases(store)
    good = a.where(is_valid_alias("target")).select("profile_id", "url", "target")
    p = pages.select("profile_id", "url").distinct().join(good, ["profile_id", "url"], "left").withColumn("stable", F.coalesce("target", normalize_url("url")))
    own = p.select("profile_id", "url", F.explode(F.array_distinct(F.array("stable", normalize_url("url"), "url"))).alias("member"))
    back = p.select("profile_id", "url", F.col("stable").alias("target")).join(a.withColumnRenamed("url", "member"), ["profile_id", "target"]).select("profile_id", "url", "member")
    members = own.unionByName(back).distinct()
    keys = members.select("profile_id", "url", F.explode(F.array(F.concat(F.lit(PAGE), "member"), F.concat(F.lit(HIGHLIGHTS), "member"))).alias("key"))
    there = store.where("value is not null and value <> 'null'").select("profile_id", "key")
    return keys.join(there, ["profile_id", "key"], "left_semi").select("profile_id", "url", "key")


def clear_plan(contract: DataFrame, store: DataFrame, delete: bool = False) -> DataFrame:
    """(profile_id, key, action, value) for contract(profile_id, url): the page row is set to empty highlights if it has a
    remote page and removed otherwise; legacy rows are removed. With delete, whatever exists is removed."""
    c = contract.select("profile_id", F.explode(F.array(F.concat(F.lit(PAGE), "url"), F.concat(F.lit(HIGHLIGHTS), "url"))).alias("key")).distinct()
    j = store.select("profile_id", "key", "value").join(c, ["profile_id", "key"], "left_semi")
    page = F.col("key").startswith(PAGE)
    keep = page & json_at("value", "$.remote").isNotNull() & F.lit(not delete)
    body = F.concat(F.lit('{"remote":'), json_at("value", "$.remote"), F.lit(',"highlights":[],"metadata":'), F.coalesce(json_at("value", "$.metadata"), F.lit("{}")), F.lit("}"))
    skip = page & ~is_object(F.col("value")) & F.lit(not delete)
    return j.where(~skip).select("profile_id", "key", F.when(keep, "set").otherwise("remove").alias("action"), F.when(keep, body).alias("value"))


def clear_remote(store: DataFrame, deletions: DataFrame) -> DataFrame:
    """(profile_id, key, action, value) after deletions(profile_id, url, expected_page_id): page rows lose their remote page
    and keep their highlights (rows without any go), saved rows go; a row that holds another remote page than
    expected is left alone. A null expectation matches any."""
    r = route_keys(store).where("kind in ('page', 'saved')").join(deletions.select("profile_id", "url", "expected_page_id"), ["profile_id", "url"])
    held = F.when(F.col("kind") == "page", json_at("value", "$.remote.pageId")).otherwise(F.coalesce(json_at("value", "$.pageId"), json_at("value", "$.id")))
    r = r.where(F.col("expected_page_id").isNull() | held.eqNullSafe(F.col("expected_page_id")))
    listed = json_at("value", "$.highlights")
    keep = (F.col("kind") == "page") & is_array(listed) & (F.json_array_length(listed) > 0)
    body = F.concat(F.lit('{"remote":null,"highlights":'), listed, F.lit(',"metadata":'), F.coalesce(json_at("value", "$.metadata"), F.lit("{}")), F.lit("}"))
    return r.select("profile_id", "key", F.when(keep, "set").otherwise("remove").alias("action"), F.when(keep, body).alias("value"))


def propose_aliases(urls: DataFrame, store: DataFrame) -> DataFrame:
    """urls(profile_id, url, stable_url) whose stable url differs and has highlights, a remote page, or a legacy row."""
    page = route_keys(store).where("kind = 'page'").where((F.json_array_length(json_at("value", "$.highlights")) > 0) | json_at("value", "$.remote").isNotNull())
    evidence = page.select("profile_id", F.col("url").alias("stable_url")).unionByName(route_keys(store).where("kind = 'highlights'").select("profile_id", F.col("url").alias("stable_url"))).distinct()
    return urls.where("url <> stable_url").join(evidence, ["profile_id", "stable_url"], "left_semi").select("profile_id", "url", "stable_url")


def upsert_highlights(store: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """(profile_id, key, action, value) for updates(profile_id, url, highlights): the list is written to the page row of the stable
    url (a valid alias of the normal form, else of the raw url, else the normal form).

    That row is kept otherwise. Where it is missing, the first other row in lookup order gives the rest and migratedFrom names its url: the
    page of the normal form, the legacy rows of the stable url and of the normal form. A page of the normal form beside a stable one, and the
    legacy rows, are removed. Of several updates of one page the last by url counts."""
    a = aliases(store).where(is_valid_alias("target"))
    u = updates.withColumn("normal", normalize_url("url"))
    u = u.join(a.toDF("profile_id", "normal", "_t1"), ["profile_id", "normal"], "left").join(a.toDF("profile_id", "url", "_t2"), ["profile_id", "url"], "left").withColumn("stable", F.coalesce("_t1", "_t2", "normal"))
    one = u.groupBy("profile_id", "stable").agg(F.max_by(F.struct("normal", "highlights"), F.col("url")).alias("x")).select("profile_id", "stable", "x.*")
    order = [F.struct(F.lit(k).alias("rank"), F.concat(F.lit(prefix), who).alias("key"), F.col(who).alias("from")) for k, (prefix, who) in enumerate(((PAGE, "stable"), (PAGE, "normal"), (HIGHLIGHTS, "stable"), (HIGHLIGHTS, "normal")))]
    keys = one.select("profile_id", "stable", F.explode(F.array(*order)).alias("k")).select("profile_id", "stable", "k.*")
    held = keys.join(store.where("value is not null and value <> 'null'").select("profile_id", "key", "value"), ["profile_id", "key"])
    best = held.groupBy("profile_id", "stable").agg(F.min_by(F.struct("rank", "from", F.when(is_object(F.col("value")), F.col("value")).alias("value")), F.col("rank")).alias("b"))
    j = one.join(best, ["profile_id", "stable"], "left")
    base = F.when(F.col("b.rank") < 2, F.col("b.value"))
    moved = F.when(F.col("b.rank") > 0, F.concat(F.lit(',"migratedFrom":'), F.regexp_extract(F.to_json(F.array("b.from")), r"^\[(.*)\]$", 1))).otherwise("")
    body = F.concat(F.lit('{"remote":'), F.coalesce(json_at(base, "$.remote"), F.lit("null")), F.lit(',"highlights":'), "highlights", F.lit(',"metadata":{"createdAt":'), F.coalesce(json_at(base, "$.metadata.createdAt"), now.cast("string")), F.lit(',"lastUpdated":'), now.cast("string"), moved, F.lit("}}"))
    written = j.select("profile_id", F.concat(F.lit(PAGE), "stable").alias("key"), F.lit("set").alias("action"), body.alias("value"))
    gone = held.where(F.col("key") != F.concat(F.lit(PAGE), "stable")).select("profile_id", "key").distinct().select("profile_id", "key", F.lit("remove").alias("action"), F.lit(None).cast("string").alias("value"))
    return written.unionByName(gone)


def highlight_counts(state: DataFrame, preview: int = 3) -> DataFrame:
    """state with n_highlights, the first few texts, and how many remain."""
    items = items_of(F.col("highlights"))
    return state.select("profile_id", "url", F.size(items).alias("n_highlights"), F.transform(F.slice(items, 1, preview), lambda h: F.coalesce(json_at(h, "$.text"), F.lit(""))).alias("preview"), F.greatest(F.lit(0), F.size(items) - preview).alias("n_remaining"))


def normalize_highlights(value: Column, now: Column) -> Column:
    """A JSON array text of highlights as structs: items that aren't objects are dropped; fields of the wrong type get
    '', yellow, {} and now."""
    kind = lambda v, p: F.coalesce(F.schema_of_variant(F.try_variant_get(v, p, "variant")), F.lit(""))
    text = lambda v, p, other: F.when(kind(v, p) == "STRING", F.try_variant_get(v, p, "string")).otherwise(other)

    def fields(h: Column) -> Column:
        at = F.when(kind(h, "$.timestamp").rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), F.try_variant_get(h, "$.timestamp", "double")).otherwise(now.cast("double"))
        place = F.when(kind(h, "$.rangeInfo").startswith("OBJECT"), F.to_json(F.try_variant_get(h, "$.rangeInfo", "variant"))).otherwise("{}")
        return F.struct(text(h, "$.id", "").alias("id"), text(h, "$.text", "").alias("text"), text(h, "$.color", "yellow").alias("color"), place.alias("range_info"), at.alias("timestamp"))

    return F.transform(F.transform(F.filter(items_of(value), is_object), F.try_parse_json), fields)


def needs_range(items: Column) -> Column:
    """A JSON list's items, each with needsRangeInfo: whether it has no rangeInfo; a JSON list again."""

    def mark(h):
        value = F.when(json_at(h, "$.rangeInfo").isNull(), "true").otherwise("false")
        known = F.regexp_replace(h, F.lit('"needsRangeInfo":(true|false)'), F.concat(F.lit('"needsRangeInfo":'), value))
        new = F.concat(F.substr(h, F.lit(1), F.char_length(h) - 1), F.when(h == "{}", "").otherwise(","), F.lit('"needsRangeInfo":'), value, F.lit("}"))
        return F.when(json_at(h, "$.needsRangeInfo").isNotNull(), known).otherwise(new)

    return F.concat(F.lit("["), F.array_join(F.transform(items_of(items), mark), ","), F.lit("]"))


def batch_migrate(store: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(profile_id, legacy_url, stable_url or null) with what becomes of each url's legacy list: (profile_id,
    legacy_url, status, reason, report_url, n_highlights, n_pending, highlights).

    skipped, for no_data or no_highlights; else success: moved to the stable url where nothing stands there yet, of
    several urls by the first with highlights; converted in place otherwise. n_pending counts items without rangeInfo."""
    legacy = route_keys(store).where("kind = 'highlights'").select("profile_id", F.col("url").alias("legacy_url"), highlight_list(F.col("value")).alias("list"))
    moves = migrate_to_stable(store, pairs.where("stable_url is not null"), needs_range).select("profile_id", "legacy_url", "stable_url", "outcome")
    j = pairs.join(legacy, ["profile_id", "legacy_url"], "left").join(moves, ["profile_id", "legacy_url", "stable_url"], "left")
    waits = lambda h: json_at(h, "$.rangeInfo").isNull()
    counts = lambda x: F.struct(F.size(x).alias("n"), F.size(F.filter(x, waits)).alias("waits"))
    j = j.withColumn("_n", bound(items_of(F.coalesce("list", F.lit("[]"))), counts))
    reason = F.when(F.col("list").isNull(), "no_data").when(F.col("_n.n") == 0, "no_highlights")
    done = reason.isNull()
    return j.select("profile_id", "legacy_url", F.when(done, "success").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(done & (F.col("outcome") == "moved"), F.col("stable_url")).otherwise(F.col("legacy_url")).alias("report_url"), F.when(done, F.col("_n.n")).otherwise(0).alias("n_highlights"), F.when(done, F.col("_n.waits")).otherwise(0).alias("n_pending"), F.when(done, needs_range(F.col("list"))).alias("highlights"))
