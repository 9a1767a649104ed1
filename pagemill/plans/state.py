"""Registered queries over snapshots, migrations, sync decisions, sources and logs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import logs as lg
from pagemill.operators import migration as m
from pagemill.operators import store as s
from pagemill.operators import sync as y
from pagemill.plans.tables import COPIES_SQL, LOGS_SQL, SOURCES_SQL, STORE_SQL, VERIFICATIONS_SQL, derived, stored
from pagemill.plans.web import _LOOKUP, _ROUTED, _store, sql_norm  # noqa: F401


# What stands after each document's text, and what becomes of it, by doc_id.
SECRETS = [
    ("see https://u:p@H.example/x?token=1&a=2#f, ok", "see https://h.example/x?token=[REDACTED_TOKEN]&a=2, ok"), ("Authorization: Bearer abc.def-1== x", "Authorization: [REDACTED_AUTH_HEADER] x"), ("eyJab.cd.ef!", "[REDACTED_JWT]!"),
    ("a sk-abcdefghij0123456789K b", "a [REDACTED_API_KEY] b"), ("my secret_9aZ_", "my [REDACTED_TOKEN]_"), ("id 0123abcd-0123-4567-89ab-0123456789ab.", "id 0123abcd***."), ("", ""),
]
SECRETS_SQL = "SELECT doc_id, coalesce(text, '') || ' ' || CASE CAST(doc_id % 7 AS INT) " + " ".join(f"WHEN {k} THEN '{x}'" for k, (x, _) in enumerate(SECRETS)) + " END AS text FROM documents"  # noqa: S608


STACKS_SQL = """SELECT doc_id, replace('Error: ' || coalesce(substr(text, 1, 60), '') || '~ at f (/home/u ser/app/s' || CAST(doc_id AS STRING) || '.js:1:2)~ at file:///opt/a/b.mjs:3~ at chrome-extension://abcdefgh' || lower(lang) || '/x/y.js~C:/Users/me/z.ts:9', '~', chr(10)) AS stack FROM documents"""


def a3_snapshot_highlights(spark, d):
    h = y.build_snapshot(_store(spark, d))["highlights"]
    return h.select("profile_id", "page_key", F.col("pos").cast("long").alias("pos"), "highlight_id", "text", "color", F.col("range_info").isNotNull().alias("has_range"), "created_at")


def a3_snapshot_saved_states(spark, d):
    return y.build_snapshot(_store(spark, d))["saved_states"].select("profile_id", "page_key", "remote_page_id", "remote_url", "title")


def a3_snapshot_metadata(spark, d):
    return y.build_snapshot(_store(spark, d))["metadata"].select("profile_id", "pages", "n_highlights", "n_saved_states")


def j7_reachable_aliases(spark, d):
    return y.build_snapshot(_store(spark, d))["url_aliases"]


def a4_snapshot_summary(spark, d):
    snap = y.build_snapshot(_store(spark, d))
    return y.snapshot_summary(snap["highlights"], snap["saved_states"])


def j6_apply_snapshot(spark, d):
    """Every profile's snapshot restored over the next profile's rows."""
    st = _store(spark, d)
    snap = y.build_snapshot(st)
    onto = lambda t: t.withColumn("profile_id", F.concat(F.lit("p"), ((F.substr("profile_id", F.lit(2)).cast("int") + 1) % 3).cast("string")))
    return y.apply_snapshot(onto(snap["highlights"]), onto(snap["saved_states"]), onto(snap["url_aliases"]), st, F.lit(1000).cast("long")).select("profile_id", "key", "action")


def p12_a5_migration_scan(spark, d):
    return m.migration_scan(_store(spark, d))


def a5_migration_items(spark, d):
    return m.migration_items(_store(spark, d)).select("profile_id", "url", F.col("n_highlights").cast("long").alias("n_highlights"))


def a6_migration_status(spark, d):
    return m.migration_status(_store(spark, d))


def a6_completed_keys(spark, d):
    return m.completed_migration_keys(_store(spark, d))


def a11_highlight_counts(spark, d):
    t = m.highlight_counts(s.unify_page_state(_store(spark, d)))
    return t.select("profile_id", "url", F.col("n_highlights").cast("long").alias("n_highlights"), F.array_join("preview", "|").alias("preview"), F.col("n_remaining").cast("long").alias("n_remaining"))


def a14_batch_summary(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "P", "skipped").otherwise(F.when(F.col("o_custkey") % 3 == 0, "success").otherwise("failed"))
    return m.batch_summary(orders.select("o_custkey", status.alias("status")), ["o_custkey"])


def f25_same_remote_page(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    a, b = F.when(F.col("page_id") % 3 > 0, F.concat(F.lit("ab-"), F.col("page_id"))), F.when(F.col("page_id") % 4 > 0, F.concat(F.lit("ab"), F.col("page_id") - F.col("page_id") % 2))
    return t.select("page_id", m.same_remote_page(a, F.col("url"), b, F.concat(F.col("url"), F.lit("/"))).alias("same"))


def _moves(spark, d):
    st = stored(spark, d, COPIES_SQL)
    pairs = s.route_keys(st).where("kind in ('page', 'highlights', 'saved')").groupBy("profile_id", F.col("url").alias("legacy_url")).agg(F.min("ordinal").alias("ordinal"))
    plain = F.regexp_replace("legacy_url", r"[?#].*$|/$", "")
    shared = F.concat(F.lit("https://stable.example/p/"), F.char_length("legacy_url") % 7)
    stable = F.when(plain != F.col("legacy_url"), plain).when(F.char_length("legacy_url") % 5 > 0, shared).otherwise("")
    return st, m.migrate_to_stable(st, pairs.withColumn("stable_url", stable))


def j9_migrate_to_stable(spark, d):
    return _moves(spark, d)[1].select("profile_id", "legacy_url", "stable_url", "outcome", "remote_page_id", "conflict", F.md5("highlights").alias("highlights_md5"))


def j9_migration_writes(spark, d):
    return m.migration_writes(*_moves(spark, d)).select("profile_id", "key", "action", F.md5("value").alias("value_md5"))


def j11_deletion_keys(spark, d):
    st = _store(spark, d)
    return m.collect_deletion_keys(s.route_keys(st).where("kind = 'page'").select("profile_id", "url"), st)


def j12_clear_plan(spark, d):
    st = _store(spark, d)
    return m.clear_plan(s.route_keys(st).where("kind in ('page', 'highlights')").select("profile_id", "url"), st).select("profile_id", "key", "action", F.md5("value").alias("value_md5"))


def j12_delete_plan(spark, d):
    st = _store(spark, d)
    return m.clear_plan(s.route_keys(st).where("kind = 'alias'").select("profile_id", "url"), st, delete=True)


def j17_propose_aliases(spark, d):
    st = _store(spark, d)
    urls = s.route_keys(st).where("kind = 'alias'").select("profile_id", "url", s.string_value(F.col("value")).alias("stable_url"))
    return m.propose_aliases(urls, st)


def j18_clear_remote(spark, d):
    """A third of the urls expect no page in particular, a third the page row's, a third another one."""
    st = _store(spark, d)
    r = s.route_keys(st)
    held = r.where("kind = 'page'").select("profile_id", "url", s.json_at("value", "$.remote.pageId").alias("held"))
    expected = F.when(F.char_length("url") % 3 == 1, F.col("held")).when(F.char_length("url") % 3 == 2, "other")
    gone = r.where("kind in ('page', 'saved')").select("profile_id", "url").distinct().join(held, ["profile_id", "url"], "left").select("profile_id", "url", expected.alias("expected_page_id"))
    return m.clear_remote(st, gone).select("profile_id", "key", "action", F.md5("value").alias("value_md5"))


def p18_auto_sync(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    meta = c.select(k.alias("profile"), (k % 7 > 0).alias("logged_in"), F.when(k % 5 > 0, F.lit("a@b.c")).alias("connection_email"), F.when(k % 4 == 0, "off").otherwise("daily").alias("frequency"), (k % 10).alias("dirty_revision"), F.lit(3).cast("long").alias("last_uploaded_revision"), (k % 11 == 0).alias("needs_manual_review"), (k % 13).cast("long").alias("next_eligible_at"))
    return y.auto_sync_decision(meta, F.lit(6)).select("profile", "reason", "should_run")


def p17_save_status(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    saved = c.select(F.col("k").alias("page_key"), F.when(F.col("k") % 6 > 0, F.col("k").cast("string")).alias("remote_page_id"), F.when(F.col("k") % 5 == 0, F.lit(95_000.0)).otherwise(F.lit(1.0)).alias("last_verified_at"))
    checks = c.where("k % 4 > 0").select(F.col("k").cast("string").alias("remote_page_id"), (F.col("k") % 4 == 1).alias("page_exists"), (F.col("k") % 8 < 4).alias("confirmed"))
    return y.save_status(saved, checks, F.lit(100_000)).select("page_key", "status", "can_save", "can_sync")


def j16_verify_saved(spark, d):
    v = derived(spark, d, VERIFICATIONS_SQL)
    last = v.groupBy("remote_page_id").agg(F.max_by("page_exists", "event_id").alias("page_exists"))
    return y.verify_saved(spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("remote_page_id")), last)


def t3_rank_sources(spark, d):
    return y.rank_sources(derived(spark, d, SOURCES_SQL)).select("id", F.col("place").cast("long").alias("place"))


def t4_search_sources(spark, d):
    return y.search_sources(derived(spark, d, SOURCES_SQL), " RED ").select("id", "title")


def a10_log_repeats(spark, d):
    return lg.log_repeats(derived(spark, d, LOGS_SQL))


def w11_suppress_repeats(spark, d):
    return lg.suppress_repeats(derived(spark, d, LOGS_SQL)).select("source", "event_id", "level", "message", "repeat_count")


def w13_log_tail(spark, d):
    return lg.log_tail(derived(spark, d, LOGS_SQL), 5).select("source", "event_id")


def f8_mask_string(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", lg.mask_string(F.when(F.col("c_custkey") % 9 > 0, F.substr("c_name", F.lit(1), F.col("c_custkey").cast("int") % 19))).alias("masked"))


def f9_redact_text(spark, d):
    t = derived(spark, d, SECRETS_SQL).select("doc_id", lg.redact_text(F.col("text")).alias("r"))
    return t.select("doc_id", F.md5("r").alias("redacted_md5"), F.regexp_count("r", F.lit(r"\*\*\*[A-Za-z.]{4}")).cast("long").alias("n_masked"))


def f11_redact_stack(spark, d):
    return derived(spark, d, STACKS_SQL).select("doc_id", F.md5(lg.redact_stack(F.col("stack"))).alias("stack_md5"))


def f7_sanitize_url(spark, d):
    t = spark.read.parquet(f"{d}/pages.parquet")
    u = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("https://user:pw@"), F.regexp_extract("url", "://([^?#]*)", 1), F.lit("?api_key=1&x=2&utm_term=3"))).when(F.col("page_id") % 4 == 1, F.lit("file:///home/x")).otherwise(F.col("url"))
    return t.select("page_id", lg.sanitize_url(u).alias("safe_url"))


QUERIES = {f.__name__: f for f in (a3_snapshot_highlights, a3_snapshot_saved_states, a3_snapshot_metadata, j7_reachable_aliases, a4_snapshot_summary, j6_apply_snapshot, p12_a5_migration_scan, a5_migration_items, a6_migration_status, a6_completed_keys, a11_highlight_counts, a14_batch_summary, f25_same_remote_page, j9_migrate_to_stable, j9_migration_writes, j11_deletion_keys, j12_clear_plan, j12_delete_plan, j17_propose_aliases, j18_clear_remote, p18_auto_sync, p17_save_status, j16_verify_saved, t3_rank_sources, t4_search_sources, a10_log_repeats, w11_suppress_repeats, w13_log_tail, f8_mask_string, f9_redact_text, f11_redact_stack, f7_sanitize_url)}

# ---- DuckDB
_STATE = """state AS (
  SELECT u.profile_id, u.url, p.value AS pv, s.value AS sv, leg.value AS lv FROM (
    SELECT profile_id, url FROM r WHERE kind = 'page' AND json_type(value) = 'OBJECT' UNION SELECT profile_id, url FROM r WHERE kind = 'saved' UNION SELECT profile_id, url FROM leg WHERE n > 0) u
  LEFT JOIN r p ON p.kind = 'page' AND json_type(p.value) = 'OBJECT' AND p.profile_id = u.profile_id AND p.url = u.url
  LEFT JOIN r s ON s.kind = 'saved' AND s.profile_id = u.profile_id AND s.url = u.url
  LEFT JOIN leg ON leg.n > 0 AND leg.profile_id = u.profile_id AND leg.url = u.url),
uni AS (SELECT profile_id, url, CASE WHEN json_type(pv, '$.remote') = 'OBJECT' THEN json_extract(pv, '$.remote') WHEN sv IS NOT NULL THEN sv::JSON END AS remote,
  CASE WHEN json_type(pv, '$.highlights') = 'ARRAY' AND json_array_length(pv, '$.highlights') > 0 THEN json_extract(pv, '$.highlights') WHEN json_type(lv) = 'ARRAY' THEN lv::JSON WHEN lv IS NOT NULL THEN json_extract(lv, '$.highlights') ELSE '[]'::JSON END AS hl FROM state),
hi AS (SELECT profile_id, url AS page_key, unnest(range(json_array_length(hl)::BIGINT)) AS pos, hl FROM uni),
hrow AS (SELECT profile_id, page_key, pos, json_extract(hl, '$[' || pos || ']') AS h FROM hi),
keyed AS (SELECT profile_id, page_key FROM hrow UNION SELECT profile_id, url FROM uni WHERE remote IS NOT NULL),
reach AS (SELECT al.* FROM al SEMI JOIN keyed ON keyed.profile_id = al.profile_id AND keyed.page_key = al.target)"""
_LOG = f"lg AS (SELECT *, coalesce(json_extract_string(context, '$.action'), '') AS action FROM ({LOGS_SQL}) q)"

# The unified state of the copies' store, and the fold over the pairs of each stable url; lists as JSON texts.
_FOLD = f"""{_ROUTED.replace(STORE_SQL, COPIES_SQL)},
us AS (SELECT profile_id, url, min(ordinal) AS ordinal FROM r WHERE kind IN ('page', 'highlights', 'saved') GROUP BY 1, 2),
pg AS (SELECT * FROM r WHERE kind = 'page' AND json_type(value) = 'OBJECT'), sv AS (SELECT * FROM r WHERE kind = 'saved'),
lists AS (SELECT us.profile_id, us.url, coalesce(CASE WHEN json_type(pg.value, '$.highlights') = 'ARRAY' AND json_array_length(pg.value, '$.highlights') > 0 THEN json_extract(pg.value, '$.highlights')::VARCHAR END,
  CASE WHEN leg.n > 0 THEN (CASE WHEN json_type(leg.value) = 'ARRAY' THEN leg.value ELSE json_extract(leg.value, '$.highlights')::VARCHAR END) END, '[]') AS l,
  coalesce(json_extract_string(pg.value, '$.remote.pageId'), json_extract_string(sv.value, '$.pageId')) AS pid, coalesce(json_extract_string(pg.value, '$.remote.title'), json_extract_string(sv.value, '$.title')) AS title,
  coalesce(json_extract_string(pg.value, '$.remote.url'), json_extract_string(sv.value, '$.url')) AS rurl, coalesce(json_extract_string(pg.value, '$.remote.savedAt'), json_extract_string(sv.value, '$.savedAt')) AS ts,
  pg.value IS NOT NULL OR sv.value IS NOT NULL OR leg.n > 0 AS known FROM us LEFT JOIN pg ON pg.profile_id = us.profile_id AND pg.url = us.url LEFT JOIN sv ON sv.profile_id = us.profile_id AND sv.url = us.url LEFT JOIN leg ON leg.profile_id = us.profile_id AND leg.url = us.url),
pr AS (SELECT profile_id, ordinal, url, CASE WHEN p <> url THEN p WHEN length(url) % 5 > 0 THEN 'https://stable.example/p/' || (length(url) % 7) ELSE '' END AS stable FROM (SELECT *, regexp_replace(url, '[?#].*$|/$', '') AS p FROM us) q),
j AS (SELECT pr.*, a.l AS l, a.pid, a.rurl, a.title, a.ts, coalesce(b.l, '[]') AS own, b.pid AS spid, b.rurl AS srurl, b.title AS stitle, b.ts AS sts, pr.stable = '' OR pr.stable = pr.url OR regexp_matches(pr.stable, '^[a-z]+://[^/?#]*/?$') OR a.pid IS NULL AND a.l = '[]' AS refused
  FROM pr JOIN lists a ON a.profile_id = pr.profile_id AND a.url = pr.url LEFT JOIN lists b ON b.profile_id = pr.profile_id AND b.url = pr.stable),
k AS (SELECT *, CASE WHEN own <> '[]' THEN own ELSE coalesce(first(CASE WHEN NOT refused AND l <> '[]' THEN l END IGNORE NULLS) OVER w, '[]') END AS there FROM j WINDOW w AS (PARTITION BY profile_id, stable ORDER BY ordinal, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, NOT refused AND there <> '[]' AND there = l AS cleaned FROM k),
e AS (SELECT *, CASE WHEN spid IS NOT NULL THEN struct_pack(pid := spid, rurl := srurl, title := stitle, ts := sts) ELSE first(CASE WHEN NOT refused AND NOT cleaned AND pid IS NOT NULL THEN struct_pack(pid := pid, rurl := rurl, title := title, ts := ts) END IGNORE NULLS) OVER w END AS held FROM c WINDOW w AS (PARTITION BY profile_id, stable ORDER BY ordinal, url ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, CASE WHEN refused THEN 'refused' WHEN there = '[]' THEN 'moved' WHEN cleaned THEN 'cleaned' WHEN held IS NULL AND pid IS NOT NULL THEN 'supplemented' ELSE 'kept' END AS outcome FROM e),
g AS (SELECT *, CASE WHEN NOT refused THEN CASE WHEN outcome = 'cleaned' THEN held ELSE coalesce(held, CASE WHEN pid IS NOT NULL THEN struct_pack(pid := pid, rurl := rurl, title := title, ts := ts) END) END END AS rem, CASE WHEN NOT refused THEN CASE WHEN outcome = 'moved' THEN l ELSE there END END AS res FROM f)"""
_MAIL = r"\b[\w%+.-]+@[\d.A-Za-z-]+\.[A-Za-z]{2,}\b"
_SAFE = " ".join(f"WHEN {k} THEN '{y}'" for k, (_, y) in enumerate(SECRETS))
ORACLES = {
    "f11_redact_stack": f"""SELECT doc_id, md5('Error: ' || regexp_replace(coalesce(substr(text, 1, 60), ''), '(?:[A-Za-z]:)?(?:[/][^\\s/():]+)+[/]([^\\s/():]+)', '\\1', 'g') || chr(10) || ' at f (u sers' || doc_id || '.js:1:2)' || chr(10) || ' at b.mjs:3' || chr(10) || ' at chrome-extension:/y.js' || chr(10) || 'z.ts:9') AS stack_md5 FROM documents""",
    "f9_redact_text": f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, CASE doc_id % 7 {_SAFE} END AS tail FROM documents), p AS (SELECT *, string_split_regex(x, '{_MAIL}') AS parts, regexp_extract_all(x, '{_MAIL}') AS found FROM t),
r AS (SELECT doc_id, array_to_string(list_transform(range(len(parts)), lambda i: parts[i + 1] || coalesce(substr(found[i + 1], 1, 1) || '***' || right(found[i + 1], 4), '')), '') || ' ' || tail AS r FROM p) SELECT doc_id, md5(r) AS redacted_md5, CAST(len(regexp_extract_all(r, '\\*\\*\\*[A-Za-z.]{{4}}')) AS BIGINT) AS n_masked FROM r""",
    "j9_migrate_to_stable": f"WITH {_FOLD} SELECT profile_id, url AS legacy_url, stable AS stable_url, outcome, rem.pid AS remote_page_id, outcome = 'kept' AND coalesce(held.pid <> pid, FALSE) AS conflict, md5(res) AS highlights_md5 FROM g",
    "j9_migration_writes": f"""WITH {_FOLD}, t AS (SELECT * FROM g WHERE NOT refused), z AS (SELECT profile_id, stable, arg_max(struct_pack(rem := rem, res := res), struct_pack(o := ordinal, u := url)) AS x, arg_min(CASE WHEN outcome = 'moved' THEN url END, CASE WHEN outcome = 'moved' THEN struct_pack(o := ordinal, u := url) END) AS first_url, bool_or(outcome IN ('moved', 'supplemented')) AS changed FROM t GROUP BY 1, 2)
SELECT z.profile_id, 'page_' || stable AS key, 'set' AS action, md5('{{"remote":' || CASE WHEN x.rem IS NULL THEN 'null' ELSE '{{"pageId":"' || x.rem.pid || '","url":"' || x.rem.rurl || '","title":"' || x.rem.title || '","savedAt":' || x.rem.ts || '}}' END || ',"highlights":' || x.res || ',"metadata":' || coalesce(json_extract(pg.value, '$.metadata')::VARCHAR, CASE WHEN first_url IS NOT NULL THEN '{{"migratedFrom":"' || first_url || '"}}' END, '{{}}') || '}}') AS value_md5
FROM z LEFT JOIN pg ON pg.profile_id = z.profile_id AND pg.url = z.stable WHERE changed
UNION ALL SELECT DISTINCT profile_id, 'url_alias:' || url, 'set', md5('"' || stable || '"') FROM t
UNION ALL SELECT DISTINCT r.profile_id, r.key, 'remove', NULL FROM t JOIN r ON r.profile_id = t.profile_id AND r.key IN ('page_' || t.url, 'saved_' || t.url, 'highlights_' || t.url) WHERE outcome IN ('moved', 'cleaned')""",
    "a3_snapshot_highlights": f"WITH {_ROUTED}, {_STATE} SELECT profile_id, page_key, pos, json_extract_string(h, '$.id') AS highlight_id, json_extract_string(h, '$.text') AS text, json_extract_string(h, '$.color') AS color, json_type(h, '$.rangeInfo') IS NOT NULL AS has_range, CAST(json_extract_string(h, '$.timestamp') AS DOUBLE) AS created_at FROM hrow",
    "a3_snapshot_saved_states": f"WITH {_ROUTED}, {_STATE} SELECT profile_id, url AS page_key, json_extract_string(remote, '$.pageId') AS remote_page_id, json_extract_string(remote, '$.url') AS remote_url, json_extract_string(remote, '$.title') AS title FROM uni WHERE remote IS NOT NULL",
    "a3_snapshot_metadata": f"WITH {_ROUTED}, {_STATE} SELECT profile_id, count(*) AS pages, CAST(sum(json_array_length(hl)) AS BIGINT) AS n_highlights, count(remote) AS n_saved_states FROM uni WHERE remote IS NOT NULL OR json_array_length(hl) > 0 GROUP BY 1",
    "j7_reachable_aliases": f"WITH {_ROUTED}, {_STATE} SELECT profile_id, url, target FROM reach",
    "a4_snapshot_summary": f"WITH {_ROUTED}, {_STATE} SELECT profile_id, count(*) AS page_count, CAST((SELECT count(*) FROM hrow WHERE hrow.profile_id = keyed.profile_id) AS BIGINT) AS highlight_count FROM keyed GROUP BY profile_id",
    "j6_apply_snapshot": f"""WITH {_ROUTED}, {_STATE}, nx AS (SELECT profile_id AS src, 'p' || ((CAST(substr(profile_id, 2) AS INTEGER) + 1) % 3) AS profile_id FROM (SELECT DISTINCT profile_id FROM r)),
      nh AS (SELECT profile_id AS src, page_key, count(*) AS n FROM hrow GROUP BY 1, 2), rem AS (SELECT DISTINCT profile_id AS src, url AS page_key FROM uni WHERE remote IS NOT NULL),
      pg AS (SELECT nx.profile_id, k.page_key, nh.n AS nh, rem.src IS NOT NULL AS s FROM (SELECT DISTINCT profile_id AS src, page_key FROM keyed) k JOIN nx USING (src) LEFT JOIN nh USING (src, page_key) LEFT JOIN rem USING (src, page_key)),
      full_pg AS (SELECT pg.*, l.value AS lv FROM pg LEFT JOIN r l ON l.kind = 'page' AND l.profile_id = pg.profile_id AND l.url = pg.page_key),
      wr AS (SELECT profile_id, 'page_' || page_key AS key FROM full_pg UNION ALL SELECT profile_id, 'saved_' || page_key FROM full_pg WHERE s OR json_type(lv, '$.remote') = 'OBJECT'
        UNION ALL SELECT profile_id, 'highlights_' || page_key FROM full_pg WHERE nh > 0 OR json_array_length(lv, '$.highlights') > 0
        UNION ALL SELECT nx.profile_id, 'url_alias:' || url FROM reach JOIN nx ON nx.src = reach.profile_id)
      SELECT profile_id, key, 'write' AS action FROM wr UNION ALL SELECT r.profile_id, r.key, 'remove' FROM r LEFT JOIN wr ON wr.profile_id = r.profile_id AND wr.key = r.key WHERE r.kind = 'alias' AND wr.key IS NULL""",
    "p12_a5_migration_scan": f"WITH {_ROUTED}, o AS (SELECT *, CASE WHEN json_type(value) = 'ARRAY' THEN value::JSON ELSE json_extract(value, '$.highlights') END AS hl FROM leg), c AS (SELECT profile_id, n, (SELECT count(*) FROM range(n::BIGINT) t(k) WHERE json_type(json_extract(hl, '$[' || k || ']'), '$.rangeInfo') IS NULL) > 0 AS old FROM o) SELECT profile_id, CAST(sum(n) AS BIGINT) AS total_highlights, count_if(old) AS legacy_count, count_if(old) > 0 AS needs_migration FROM c GROUP BY 1",
    "a5_migration_items": f"WITH {_ROUTED}, p AS (SELECT min(page_id) AS page_id, url FROM pages GROUP BY url) SELECT leg.profile_id, leg.url, CAST(n AS BIGINT) AS n_highlights FROM leg JOIN p ON p.url = leg.url WHERE n > 0 AND page_id % 5 = 0",
    "a6_migration_status": f"WITH {_ROUTED} SELECT profile_id, count_if(json_extract_string(value, '$.phase') = 'completed') AS completed, count_if(json_extract_string(value, '$.phase') = 'failed') AS failed, 0::BIGINT AS pending FROM r WHERE starts_with(key, 'migration_') GROUP BY 1",
    "a6_completed_keys": f"WITH {_ROUTED} SELECT profile_id, key FROM r WHERE starts_with(key, 'migration_') AND json_extract_string(value, '$.phase') = 'completed'",
    "a11_highlight_counts": f"WITH {_ROUTED}, {_STATE} SELECT profile_id, url, CAST(json_array_length(hl) AS BIGINT) AS n_highlights, coalesce((SELECT string_agg(json_extract_string(h, '$.text'), '|' ORDER BY pos) FROM hrow WHERE hrow.profile_id = uni.profile_id AND hrow.page_key = uni.url AND pos < 3), '') AS preview, greatest(0, CAST(json_array_length(hl) AS BIGINT) - 3) AS n_remaining FROM uni",
    "a14_batch_summary": "SELECT o_custkey, count_if(ok) AS n_success, count_if(NOT ok) AS n_failed, CASE WHEN count_if(NOT ok) = 0 THEN 'success' WHEN count_if(ok) = 0 THEN 'failed' ELSE 'partial' END AS label FROM (SELECT o_custkey, o_orderstatus = 'F' OR (o_orderstatus <> 'P' AND o_custkey % 3 = 0) AS ok FROM orders) t GROUP BY 1",
    "f25_same_remote_page": "SELECT page_id, CASE WHEN page_id % 3 > 0 AND page_id % 4 > 0 THEN page_id % 2 = 0 ELSE regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '/+$', '') = regexp_replace(split_part(split_part(url || '/', '?', 1), '#', 1), '/+$', '') END AS same FROM pages",
    "j11_deletion_keys": f"""WITH {_ROUTED}, {_LOOKUP}, pg AS (SELECT profile_id, url FROM r WHERE kind = 'page'), p AS (SELECT pg.profile_id, pg.url, {sql_norm('pg.url')} AS norm, coalesce(o.target, {sql_norm('pg.url')}) AS stable FROM pg LEFT JOIN okal o ON o.profile_id = pg.profile_id AND o.url = pg.url),
      mem AS (SELECT profile_id, url, stable AS member FROM p UNION SELECT profile_id, url, norm FROM p UNION SELECT profile_id, url, url FROM p UNION SELECT p.profile_id, p.url, al.url FROM p JOIN al ON al.profile_id = p.profile_id AND al.target = p.stable),
      ks AS (SELECT profile_id, url, 'page_' || member AS key FROM mem UNION SELECT profile_id, url, 'highlights_' || member FROM mem) SELECT ks.* FROM ks SEMI JOIN r ON r.profile_id = ks.profile_id AND r.key = ks.key""",
    "j12_clear_plan": f"""WITH {_ROUTED}, k AS (SELECT *, kind = 'page' AND json_type(value, '$.remote') = 'OBJECT' AS kept FROM r WHERE kind = 'highlights' OR (kind = 'page' AND json_type(value) = 'OBJECT'))
SELECT profile_id, key, CASE WHEN kept THEN 'set' ELSE 'remove' END AS action, CASE WHEN kept THEN md5('{{"remote":' || json_extract(value, '$.remote')::VARCHAR || ',"highlights":[],"metadata":' || json_extract(value, '$.metadata')::VARCHAR || '}}') END AS value_md5 FROM k""",
    "j12_delete_plan": f"WITH {_ROUTED}, a AS (SELECT DISTINCT profile_id, url FROM r WHERE kind = 'alias') SELECT r.profile_id, r.key, 'remove' AS action, NULL AS value FROM r SEMI JOIN a ON a.profile_id = r.profile_id AND r.key IN ('page_' || a.url, 'highlights_' || a.url)",
    "j17_propose_aliases": f"WITH {_ROUTED}, ev AS (SELECT profile_id, url FROM bad WHERE json_type(value, '$.remote') = 'OBJECT' OR (NOT corrupted AND json_array_length(value, '$.highlights') > 0) UNION SELECT profile_id, url FROM leg) SELECT al.profile_id, al.url, al.target AS stable_url FROM al SEMI JOIN ev ON ev.profile_id = al.profile_id AND ev.url = al.target WHERE al.url <> al.target",
    "j18_clear_remote": f"""WITH {_ROUTED}, x AS (SELECT r.*, CASE length(r.url) % 3 WHEN 1 THEN (SELECT any_value(json_extract_string(q.value, '$.remote.pageId')) FROM r q WHERE q.kind = 'page' AND q.profile_id = r.profile_id AND q.url = r.url) WHEN 2 THEN 'other' END AS expected,
  CASE WHEN kind = 'page' THEN json_extract_string(value, '$.remote.pageId') ELSE json_extract_string(value, '$.pageId') END AS held, coalesce(kind = 'page' AND json_type(value, '$.highlights') = 'ARRAY' AND json_array_length(value, '$.highlights') > 0, FALSE) AS kept FROM r WHERE kind IN ('page', 'saved'))
SELECT profile_id, key, CASE WHEN kept THEN 'set' ELSE 'remove' END AS action, CASE WHEN kept THEN md5('{{"remote":null,"highlights":' || json_extract(value, '$.highlights')::VARCHAR || ',"metadata":' || coalesce(json_extract(value, '$.metadata')::VARCHAR, '{{}}') || '}}') END AS value_md5 FROM x WHERE expected IS NULL OR expected IS NOT DISTINCT FROM held""",
    "p18_auto_sync": "SELECT c_custkey AS profile, reason, reason = 'all_conditions_met' AS should_run FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'account_not_logged_in' WHEN c_custkey % 5 = 0 THEN 'drive_not_connected' WHEN c_custkey % 4 = 0 THEN 'frequency_off' WHEN c_custkey % 10 <= 3 THEN 'not_dirty' WHEN c_custkey % 11 = 0 THEN 'needs_manual_review' WHEN c_custkey % 13 > 6 THEN 'not_yet_eligible' ELSE 'all_conditions_met' END AS reason FROM customer) t",
    "p17_save_status": "SELECT page_key, status, status IN ('unsaved', 'deleted_remote') AS can_save, status IN ('saved', 'unverified_saved') AS can_sync FROM (SELECT c_custkey AS page_key, CASE WHEN c_custkey % 6 = 0 THEN 'unsaved' WHEN c_custkey % 5 = 0 THEN 'saved' WHEN c_custkey % 4 = 0 THEN 'unverified_saved' WHEN c_custkey % 4 = 1 THEN 'saved' WHEN c_custkey % 8 < 4 THEN 'deleted_remote' ELSE 'deletion_pending' END AS status FROM customer) t",
    "j16_verify_saved": f"WITH v AS (SELECT remote_page_id, arg_max_null(page_exists, event_id) AS e FROM ({VERIFICATIONS_SQL}) x GROUP BY 1) SELECT c_custkey AS remote_page_id, CASE WHEN e IS NULL THEN 'unknown' WHEN e THEN 'exists' ELSE 'missing' END AS presence FROM customer LEFT JOIN v ON v.remote_page_id = c_custkey",
    "t3_rank_sources": f"""WITH x AS (SELECT *, contains(',' || property_types || ',', ',url,') AS has_url, object IN ('database', 'data_source') AS db FROM ({SOURCES_SQL}) q), v AS (SELECT id, ordinal, CASE WHEN db AND has_url THEN 1 WHEN db THEN 3 WHEN parent_type = 'workspace' THEN 0 WHEN parent_type = 'page_id' THEN 2 ELSE 4 END AS b FROM x WHERE object <> 'user' AND NOT (object = 'page' AND parent_type = 'database_id' AND has_url)), n AS (SELECT id, row_number() OVER (ORDER BY b, ordinal) AS place FROM v) SELECT * FROM n WHERE place <= 100""",
    "t4_search_sources": f"SELECT id, title FROM ({SOURCES_SQL}) q WHERE contains(lower(title), 'red') OR contains(lower(id), 'red')",
    "a10_log_repeats": f"WITH {_LOG} SELECT source, message, action, count(*) AS n, greatest(0, count(*) - 10) AS suppressed, count(*) >= 30 AS anomaly FROM lg GROUP BY 1, 2, 3",
    "w11_suppress_repeats": f"""WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY source, message, action ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY source, message, action) AS n FROM lg)
      SELECT source, event_id, level, message, CASE WHEN rn = 10 AND n > 10 THEN n END AS repeat_count FROM k WHERE rn <= 10 UNION ALL SELECT source, event_id, 'warn', '[ANOMALY] message looped 30× in buffer: "' || message || '"', 30 FROM k WHERE rn = 30""",
    "w13_log_tail": f"WITH {_LOG}, k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, event_id DESC) AS rn FROM lg) SELECT source, event_id FROM k WHERE rn <= 5",
    "f8_mask_string": "SELECT c_custkey, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 19 = 0 THEN '[empty]' WHEN length(x) <= 8 THEN '***' ELSE left(x, 4) || '***' || right(x, 4) END AS masked FROM (SELECT c_custkey, substr(c_name, 1, CAST(c_custkey % 19 AS INT)) AS x FROM customer) t",
    "f7_sanitize_url": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'https://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END || '?api_key=[REDACTED_TOKEN]&x=2' WHEN page_id % 4 = 1 THEN 'file://[local-file]' ELSE lower(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) || CASE WHEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '://[^/?#]*([^?#]*)', 1) END || CASE WHEN array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: NOT starts_with(x, 'utm_')), '&') = '' THEN '' ELSE '?' || array_to_string(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: NOT starts_with(x, 'utm_')), '&') END END AS safe_url FROM pages",
}
