import json

import pytest
from pyspark.sql import functions as F

from pagemill.operators import backup as b
from pagemill.operators import migration as m
from pagemill.operators import store as s
from pagemill.operators import sync as y
from pagemill.sources import files

STORE = "profile_id string, ordinal long, key string, value string"


def make(spark, rows, profile="p"):
    return spark.createDataFrame([(profile, k, key, v if isinstance(v, str) or v is None else json.dumps(v)) for k, (key, v) in enumerate(rows)], STORE)


MIXED = [
    ("page_http://a/1", {"remote": {"pageId": "r1", "title": "T"}, "highlights": [], "metadata": {"lastUpdated": 3}}),
    ("saved_http://a/1", {"pageId": "other"}), ("highlights_http://a/1", [{"id": "h1", "text": "x"}]), ("page_http://a/2", None), ("page_http://a/3", []), ("page_", {"highlights": []}),
    ("saved_http://a/4", {"id": "s4", "notionUrl": "u"}), ("saved_http://a/5", {"title": "no id"}), ("highlights_http://a/6", {"highlights": [{"id": "h6"}]}), ("highlights_http://a/7", []),
    ("url_alias:http://a/old", '"http://a/1"'), ("url_alias:http://a/x", '""'), ("url_alias:http://a/y", "5"), ("migration_1", {}), ("config_x", 1), ("my_notion_key", 2), ("else", 3),
]


def test_unified_state(spark):
    got = {r["url"]: (r["remote"] and r["remote"]["page_id"], json.loads(r["highlights"])) for r in s.unify_page_state(make(spark, MIXED)).collect()}
    assert got == {"http://a/1": ("r1", [{"id": "h1", "text": "x"}]), "http://a/4": ("s4", []), "http://a/6": (None, [{"id": "h6"}])}


def test_routes_and_aliases(spark):
    kinds = {r["key"]: r["kind"] for r in s.route_keys(make(spark, MIXED)).collect()}
    assert [kinds[k] for k in ("page_", "migration_1", "config_x", "my_notion_key", "else")] == ["page", "leftover", "config", "config", "other"]
    assert [(r["url"], r["target"]) for r in s.aliases(make(spark, MIXED)).collect()] == [("http://a/old", "http://a/1")]


LOOKUPS = {  # rows besides the alias of http://s.org/raw/ to http://s.org/stable: what is found
    "stable page": ([("page_http://s.org/stable", {"highlights": [{"id": 1}]}), ("page_http://s.org/raw", {"highlights": [{"id": 2}]})], "page_http://s.org/stable"),
    "empty list is a hit": ([("page_http://s.org/stable", {"highlights": []}), ("highlights_http://s.org/raw", [1])], "page_http://s.org/stable"),
    "normal page before legacy": ([("page_http://s.org/raw", {"highlights": [{"id": 2}]}), ("highlights_http://s.org/stable", [1])], "page_http://s.org/raw"),
    "legacy": ([("highlights_http://s.org/raw", {"highlights": [1]})], "highlights_http://s.org/raw"),
    "broken page": ([("page_http://s.org/stable", {"highlights": 3}), ("highlights_http://s.org/stable", [1])], "highlights_http://s.org/stable"),
    "none": ([], None),
}


@pytest.mark.parametrize("case", LOOKUPS)
def test_lookup(spark, case):
    rows, found = LOOKUPS[case]
    store = make(spark, [*rows, ("url_alias:http://s.org/raw/", '"http://s.org/stable"')])
    urls = spark.createDataFrame([("p", "http://s.org/raw/")], "profile_id string, url string")
    assert s.lookup_highlights(urls, store).first()["found_key"] == found


def test_diff_and_plans(spark):
    local = make(spark, [("page_a", {"x": 1, "y": [1, 2]}), ("page_b", {"x": 1}), ("page_c", {}), ("token", "1")])
    backup = make(spark, [("page_a", '{"y": [1, 2], "x": 1}'), ("page_b", {"x": 2}), ("page_n", {}), ("secret", "1")])
    assert {(r["key"], r["status"]) for r in b.diff_backup(backup, local).collect()} == {("page_a", "identical"), ("page_b", "conflict"), ("page_n", "new")}
    acts = lambda mode, bk=backup: {(r["key"], r["action"]) for r in b.import_plan(mode, bk, local).collect()}
    assert acts("overwrite-all") == {("page_a", "skip"), ("page_b", "write"), ("page_n", "write"), ("page_c", "remove")}
    assert acts("new-only") == {("page_a", "skip"), ("page_b", "skip"), ("page_n", "write")}
    assert acts("new-and-overwrite") == {("page_a", "skip"), ("page_b", "write"), ("page_n", "write")}
    assert acts("overwrite-all", backup.where("false")) == set()
    with pytest.raises(ValueError):
        b.import_plan("other", backup, local)
    r = b.import_counts(b.import_plan("new-only", backup, local)).first()
    assert (r["n_new"], r["n_overwrite"], r["n_identical"], r["n_conflict_skipped"], r["has_work"]) == (1, 0, 1, 1, True)


def test_health_and_cleanup(spark):
    store = make(spark, MIXED)
    r = b.storage_health(store).first()
    assert (r["pages"], r["highlights"], r["configs"], r["migration_keys"], r["legacy_saved"], r["corrupted"]) == (4, 1, 2, 1, 3, 2)
    reasons = {x["key"]: x["reason"] for x in b.cleanup_plan(store).collect()}
    assert reasons == {"page_http://a/2": "corrupted", "page_http://a/3": "corrupted", "page_": "empty", "highlights_http://a/7": "orphan", "url_alias:http://a/x": "orphan", "url_alias:http://a/y": "orphan", "migration_1": "leftover"}
    total = [x for x in b.cleanup_summary(store).collect() if x["reason"] is None]
    assert len(total) == 1 and total[0]["n"] == 7


def test_snapshot_round_trip(spark, tmp_path):
    store = make(spark, MIXED)
    snap = y.build_snapshot(store)
    files.write_snapshot(snap, f"{tmp_path}/snap")
    back = files.read_snapshot(spark, f"{tmp_path}/snap")
    assert back["metadata"].first()["pages"] == 3 and [r["url"] for r in back["url_aliases"].collect()] == ["http://a/old"]
    summary = y.snapshot_summary(back["highlights"], back["saved_states"]).first()
    assert (summary["page_count"], summary["highlight_count"]) == (3, 2)
    local = make(spark, [("page_http://a/1", {"highlights": [{"id": "local"}], "remote": None}), ("url_alias:http://gone", '"http://a/1"'), ("page_http://mine", {"highlights": []})])
    acts = {r["key"]: (r["action"], r["value"]) for r in y.apply_snapshot(back["highlights"], back["saved_states"], back["url_aliases"], local, F.lit(9).cast("long")).collect()}
    assert acts["url_alias:http://gone"] == ("remove", None) and acts["url_alias:http://a/old"] == ("write", '"http://a/1"')
    assert [x["id"] for x in json.loads(acts["page_http://a/1"][1])["highlights"]] == ["h1"] and json.loads(acts["page_http://a/1"][1])["remote"]["pageId"] == "r1"
    assert "page_http://mine" not in acts and acts["saved_http://a/4"][0] == "write"
    other = y.build_snapshot(make(spark, MIXED[::-1]))["metadata"].first()
    assert other["payload_hash"] == back["metadata"].first()["payload_hash"]


MOVES = {
    "move": ([("highlights_L", [{"id": "1"}])], "moved"), "equal": ([("page_L", {"highlights": [{"id": "1"}]}), ("page_S", {"highlights": [{"id": "1"}]})], "cleaned"),
    "nothing": ([], "refused"), "kept": ([("page_L", {"remote": {"pageId": "a"}, "highlights": [{"id": "1"}]}), ("page_S", {"remote": {"pageId": "b"}, "highlights": [{"id": "2"}]})], "kept"),
    "supplement": ([("page_L", {"remote": {"pageId": "a"}, "highlights": [{"id": "1"}]}), ("page_S", {"highlights": [{"id": "2"}]})], "supplemented"),
}


@pytest.mark.parametrize("case", MOVES)
def test_migration(spark, case):
    rows, outcome = MOVES[case]
    store = make(spark, [(k.replace("_L", "_http://e.org/a/title").replace("_S", "_http://e.org/a"), v) for k, v in rows])
    pairs = spark.createDataFrame([("p", "http://e.org/a/title", "http://e.org/a")], "profile_id string, legacy_url string, stable_url string")
    r = m.migrate_to_stable(store, pairs).first()
    assert r["outcome"] == outcome and r["conflict"] == (case == "kept")


def test_migration_of_urls_that_share_a_target(spark):
    store = make(spark, [("highlights_http://e.org/a/1", [{"id": "1"}]), ("highlights_http://e.org/a/2", [{"id": "2"}])])
    pairs = spark.createDataFrame([("p", f"http://e.org/a/{k}", "http://e.org/a") for k in (1, 2)] + [("p", "http://e.org/a/1", "http://e.org/")], "profile_id string, legacy_url string, stable_url string")
    got = {(r["legacy_url"][-1], r["stable_url"]): r["outcome"] for r in m.migrate_to_stable(store, pairs).collect()}
    assert got == {("1", "http://e.org/a"): "moved", ("2", "http://e.org/a"): "kept", ("1", "http://e.org/"): "refused"}


def test_pending_and_failed(spark):
    store = make(spark, [("page_u", {"highlights": [{"needsRangeInfo": True}, {"needsRangeInfo": True, "migrationFailed": True}, {}]}), ("highlights_v", [{}])])
    assert [(r["url"], r["total"], r["pending"], r["failed"]) for r in m.pending_lists(store).collect()] == [("u", 3, 1, 1)]
    r = m.drop_failed_highlights(s.unify_page_state(store).where("url = 'u'")).first()
    assert r["n_removed"] == 1 and len(json.loads(r["highlights"])) == 2


def test_upserts(spark):
    store = make(spark, [("page_http://e.org/b", {"remote": {"pageId": "r"}, "highlights": []}), ("highlights_http://e.org/b", [1]), ("url_alias:http://e.org/old", '"http://e.org/b"')])
    up = spark.createDataFrame([("p", "http://e.org/old", '[{"id":"n"}]')], "profile_id string, url string, highlights string")
    acts = {r["key"]: (r["action"], r["value"]) for r in m.upsert_highlights(store, up, F.lit(5)).collect()}
    assert acts["highlights_http://e.org/b"][0] == "remove" and json.loads(acts["page_http://e.org/b"][1])["remote"] == {"pageId": "r"}


def test_backup_files(spark, tmp_path):
    d = tmp_path / "b"
    d.mkdir()
    (d / "good.json").write_text(json.dumps({"version": "1", "timestamp": "t", "data": {"page_a": {"x": 1}, "n": 2}}))
    for name, bad in {"proto": '{"version":"1","timestamp":"t","data":{"a":{"__proto__":1}}}', "cut": '{"version":', "list": '{"version":"1","timestamp":"t","data":[]}', "number": '{"version":1,"timestamp":"t","data":{}}'}.items():
        (d / f"{name}.json").write_text(bad)
    store, rejects = files.read_backup(spark, str(d))
    assert sorted((r["profile_id"], r["key"], r["value"]) for r in store.collect()) == [("good", "n", "2"), ("good", "page_a", '{"x":1}')]
    assert {r["profile_id"] for r in rejects.collect()} == {"proto", "cut", "list", "number"}
    (d / "spelt.json").write_text('{"version":"1","timestamp":"t","data":{"a":{"\\u005f_proto__":1}}}')
    assert "spelt" in {r["profile_id"] for r in files.read_backup(spark, str(d))[1].collect()}


def test_backups_survive_a_round_trip(spark, tmp_path):
    rows = [("p", "page_http://e.org/a", '{"highlights":[{"id":"1","text":"a \\"b\\" é"}]}'), ("p", "url_alias:http://e.org/b", '"http://e.org/a"'), ("q", "page_x", "[1,2.5,null,true]"), ("q", "secret", "1"), ("q", "page_none", None)]
    store = spark.createDataFrame([(p, k, key, v) for k, (p, key, v) in enumerate(rows)], "profile_id string, ordinal long, key string, value string")
    files.write_backup(store, f"{tmp_path}/out", "2020", "1")
    back, rejects = files.read_backup(spark, f"{tmp_path}/out")
    assert rejects.count() == 0
    assert sorted((r["profile_id"], r["key"], r["value"]) for r in back.collect()) == [x for x in sorted(rows, key=lambda x: x[:2]) if x[1] not in ("secret", "page_none")]
    assert {r["status"] for r in b.diff_backup(back, store).collect()} == {"identical"}


def test_empty_store(spark):
    none = make(spark, MIXED).where("false")
    assert s.unify_page_state(none).count() == b.cleanup_plan(none).count() == b.storage_health(none).count() == s.pick_group_owner(none).count() == 0
