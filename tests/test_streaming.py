import json

import pytest

from pagemill.streaming import jobs


def _run(spark, df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LOGS = "event_id long, ts timestamp, source string, level string, message string, context string"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def _logs(spark, tmp_path, batches):
    """The rows of the job over batches of (event_id, ts, source, message), a file each."""
    for rows in batches:
        data = [(i, t, s, "info", m, json.dumps({"action": "a"})) for i, t, s, m in rows]
        spark.createDataFrame(data, LOGS.replace("timestamp", "string")).selectExpr("event_id", "timestamp(ts) as ts", "source", "level", "message", "context").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(LOGS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    return _run(spark, jobs.stream_log_suppression(stream), f"logs_{len(batches)}_{len(batches[0])}")


def at(second):
    return f"2024-01-01 {second // 3600:02d}:{second // 60 % 60:02d}:{second % 60:02d}"


def test_log_suppression(spark, tmp_path):
    """Sources of 9 to 45 repeats in two batches; a late entry of another source lets the idle ones tell their repeat counts."""
    counts = {f"s{n}": n for n in (9, 10, 11, 29, 30, 45)}
    rows = [(1000 * j + k, at(k), s, "m") for j, (s, n) in enumerate(counts.items()) for k in range(n)]
    first, second = [r for r in rows if r[0] % 1000 < 20], [r for r in rows if r[0] % 1000 >= 20]
    got = _logs(spark, tmp_path, [first, second, [(9000, at(5 * 3600), "late", "m")], [(9001, at(9 * 3600), "late", "x")]])
    plain = {s: sum(r["source"] == s and r["level"] == "info" and r["repeat_count"] is None for r in got) for s in counts}
    assert plain == {s: min(n, 10) for s, n in counts.items()}
    assert {r["source"] for r in got if r["level"] == "warn"} == {"s30", "s45"}
    told = {r["source"]: (r["event_id"] % 1000, r["repeat_count"]) for r in got if r["level"] == "info" and r["repeat_count"] is not None}
    assert told == {f"s{n}": (9, n) for n in (11, 29, 30, 45)}


def test_log_ring_evicts(spark, tmp_path):
    """Five hundred other entries push a suppressed message out: its repeat count is told, and it starts anew."""
    rows = [(k, at(k), "s", "m") for k in range(12)] + [(100 + k, at(100 + k), "s", f"x{k}") for k in range(500)] + [(700, at(700), "s", "m")]
    got = _logs(spark, tmp_path, [rows])
    of_m = [(r["event_id"], r["repeat_count"]) for r in got if r["message"] == "m"]
    assert sorted(of_m, key=str) == sorted([(k, None) for k in range(10)] + [(9, 12), (700, None)], key=str)


def test_deletion_confirmation(spark, tmp_path):
    at = lambda minute, second=0: f"2024-01-01 00:{minute:02d}:{second:02d}"
    rows = [(1, at(0), 1, False), (2, at(5), 1, False), (3, at(0), 2, False), (4, at(5, 1), 2, False), (5, at(0), 3, False), (6, at(1), 3, True), (7, at(2), 3, False), (8, at(0), 4, None)]
    schema = "event_id long, ts timestamp, remote_page_id long, page_exists boolean"
    spark.createDataFrame(rows, "event_id long, ts string, remote_page_id long, page_exists boolean").selectExpr("event_id", "timestamp(ts) as ts", "remote_page_id", "page_exists").write.parquet(f"{tmp_path}/in")
    got = _run(spark, jobs.stream_deletion_confirmation(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), "deletions")
    assert {(r["event_id"], r["status"]) for r in got} == {(1, "pending"), (2, "deleted"), (3, "pending"), (4, "pending"), (5, "pending"), (7, "pending")}


def test_store_upserts(spark, tmp_path):
    schema = "profile_id string, ordinal long, key string, value string"
    first = [("p", 1, "page_http://a/x", '{"remote":{"pageId":"1"},"highlights":[{"id":"h"}],"metadata":{"lastUpdated":5}}'), ("p", 2, "saved_http://a/y", '{"pageId":"s","title":"T"}')]
    first += [("p", 10 + k, f"page_http://b/{k}", '{"highlights":[],"metadata":{"lastUpdated":1}}') for k in range(40)]
    second = [("p", 3, "page_http://a/x", '{"remote":{"pageId":"2"},"highlights":[],"metadata":{"lastUpdated":9}}'), ("p", 4, "highlights_http://a/y", '[{"id":"k"}]'), ("p", 5, "config_theme", '"dark"')]
    third = [("p", 6, "page_http://a/x", '{"remote":{"pageId":"0"},"highlights":[{"id":"old"}],"metadata":{"lastUpdated":2}}')]
    assert jobs.read_store_table(spark, f"{tmp_path}/out").count() == 0
    for n, part in enumerate((first, second, third)):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.stream_store_upserts(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", buckets=8).awaitTermination(120)
        if n == 0:
            files = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "out/data/batch=0").glob("bucket=*")}
    table = jobs.read_store_table(spark, f"{tmp_path}/out")
    got = {r["url"]: r for r in table.collect()}
    assert len(got) == 42 and got["http://a/x"]["remote"]["page_id"] == "2" and json.loads(got["http://a/x"]["highlights"]) == [{"id": "h"}]
    assert json.loads(got["http://a/y"]["highlights"]) == [{"id": "k"}] and got["http://a/y"]["remote"]["page_id"] == "s"
    left = {p.name: sorted(f.name for f in p.glob("*.parquet")) for p in (tmp_path / "out/data/batch=0").glob("bucket=*")}
    assert 0 < len(left) < len(files) and all(files[k] == v for k, v in left.items())  # untouched buckets stay as they were; old ones go
    assert sorted(p.name for p in (tmp_path / "out/manifest").glob("*.json")) == ["1.json", "2.json"]
    before = sorted(map(str, table.collect()))
    jobs.merge_store_batch(f"{tmp_path}/out", 8)(spark.createDataFrame(second, schema), 2)  # a batch that runs again
    assert sorted(map(str, jobs.read_store_table(spark, f"{tmp_path}/out").collect())) == before
