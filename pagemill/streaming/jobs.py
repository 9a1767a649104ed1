"""Keyed streaming jobs: log suppression, deletion confirmation, and store upserts."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators.logs import ANOMALY_AT, CAPACITY, SUPPRESS_AFTER, truncate_entries
from pagemill.operators.store import HIGHLIGHTS, PAGE, SAVED, json_at, route_keys, unify_page_state

STORE_PAGES = "profile_id string, url string, remote struct<page_id:string,url:string,title:string,saved_at:double,last_verified_at:double>, highlights string, last_updated double"
CONFIRM_MS = 5 * 60 * 1000
LATE = "10 minutes"
IDLE = 60 * 60 * 1000  # ms of event time without an entry after which a source's state goes
LOG_OUT = "source string, event_id long, level string, message string, repeat_count long"
_COUNT = "kept int, repeated long, told boolean, event_id long, level string"


class LogSuppression(StatefulProcessor):
    """A source's state: ``ring``, a list of the fingerprints of its last CAPACITY kept entries, and ``counts``, a map from fingerprint to how
    many of these it has, the repeat count of the last one (0 without repeats), whether its anomaly was told, and the last one's id and level.

    A repeat count is told, as a row of that last entry, when the entry gets a successor or leaves the ring, or when the source has been
    idle; an event-time timer, moved on by each batch, then drops the source's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ring = handle.getListState("ring", "fp string")
        self.counts = handle.getMapState("counts", "fp string", _COUNT)

    def _told(self, source: str, fp: str, c: list) -> list[tuple]:
        return [(source, c[3], c[4], json.loads(fp)[0], c[1])] if c[1] else []

    def _write(self, source: str, fp: str, event_id: int, level: str) -> list[tuple]:
        """Puts an entry into the ring; the repeat counts that are told by that."""
        out = []
        if len(self._ring) == CAPACITY:
            old = self._ring.popleft()
            c = self._get(old)
            c[0] -= 1
            if c[0] <= 0:
                out += self._told(source, old, c)
                self._known[old] = None
        c = self._get(fp) or [0, 0, False, event_id, level]
        out += self._told(source, fp, c)
        self._known[fp] = [c[0] + 1, 0, c[2], event_id, level]
        self._ring.append(fp)
        return out

    def _get(self, fp: str) -> list | None:
        if fp not in self._known:
            self._known[fp] = list(self.counts.getValue((fp,))) if self.counts.containsKey((fp,)) else None
        return self._known[fp]

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        self._ring = deque(x[0] for x in self.ring.get()) if self.ring.exists() else deque()
        self._known: dict[str, list | None] = {}  # what this batch has read or changed of the counts
        last = 0
        for b in rows:
            out = []
            for r in b.sort_values(["ts", "event_id"]).itertuples():
                fp = json.dumps([r.message, r.action])
                last = max(last, int(r.ts.timestamp() * 1000))
                c = self._get(fp)
                if c is None or c[0] < SUPPRESS_AFTER:
                    out += self._write(key[0], fp, r.event_id, r.level)
                    out.append((key[0], r.event_id, r.level, r.message, None))
                    continue
                c[1] = (c[1] or c[0]) + 1
                if c[1] == ANOMALY_AT and not c[2]:
                    c[2] = True
                    text = f'[ANOMALY] message looped {ANOMALY_AT}× in buffer: "{r.message[:200]}"'
                    out += self._write(key[0], json.dumps([text, ""]), r.event_id, "warn")
                    out.append((key[0], r.event_id, "warn", text, ANOMALY_AT))
            yield _log_frame(out)
        self.ring.put([(fp,) for fp in self._ring])
        for fp, c in self._known.items():
            if c is not None:
                self.counts.updateValue((fp,), tuple(c))
            elif self.counts.containsKey((fp,)):
                self.counts.removeKey((fp,))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(max(last + IDLE, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [x for (fp,), c in self.counts.iterator() for x in self._told(key[0], fp, list(c))]
        self.ring.clear()
        self.counts.clear()
        yield _log_frame(out)

    def close(self) -> None:
        pass


def _log_frame(rows: list[tuple]) -> pd.DataFrame:
    t = pd.DataFrame(rows, columns=["source", "event_id", "level", "message", "repeat_count"])
    return t.astype({"event_id": "int64", "repeat_count": "Int64"})


def stream_log_suppression(logs: DataFrame) -> DataFrame:
    """Per source: the first ten entries of a fingerprint among the last 500 kept, one anomaly at the thirtieth, and what LogSuppression tells
    of repeats; counts start anew once a fingerprint has left the ring. Long entries are cut first. Entries more than ten minutes late
    may be left out. The session's state store must be RocksDB's (spark.sql.streaming.stateStore.providerClass)."""
    cut = truncate_entries(logs).withColumn("action", F.coalesce(json_at("context", "$.action"), F.lit("")))
    rows = cut.withWatermark("ts", LATE).select(F.coalesce("source", F.lit("")).alias("source"), "event_id", "ts", F.coalesce("level", F.lit("")).alias("level"), F.coalesce("message", F.lit("")).alias("message"), "action")
    return rows.groupBy("source").transformWithStateInPandas(LogSuppression(), LOG_OUT, "append", "eventTime")


CONFIRM_OUT = "remote_page_id long, event_id long, status string"


def _confirm(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """State: when the page was first found missing, in milliseconds."""
    first = state.get[0] if state.exists and not state.hasTimedOut else None
    out = []
    for b in batches:
        for r in b.sort_values(["ts", "event_id"]).itertuples():
            if r.missing:
                at = int(r.ts.timestamp() * 1000)
                if first is not None and at - first <= CONFIRM_MS:
                    out.append((key[0], r.event_id, "deleted"))
                    first = None
                else:
                    out.append((key[0], r.event_id, "pending"))
                    first = at
            else:
                first = None
    if first is None:
        if state.exists:
            state.remove()
    else:
        state.update((first,))
        state.setTimeoutTimestamp(max(first + CONFIRM_MS + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(out, columns=["remote_page_id", "event_id", "status"])


def stream_deletion_confirmation(checks: DataFrame) -> DataFrame:
    """Per remote page: a first missing result is pending; a second within five minutes confirms the deletion, a later one
    starts anew; any other result clears. Results more than ten minutes late may be left out."""
    rows = checks.withWatermark("ts", LATE).select("remote_page_id", "event_id", "ts", F.coalesce(~F.col("page_exists"), F.lit(False)).alias("missing"))
    return rows.groupBy("remote_page_id").applyInPandasWithState(_confirm, CONFIRM_OUT, "first long", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_batch(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The page rows (profile_id, url, remote, highlights, last_updated) after a batch of store changes.

    Changed rows are built into page rows. The row of the greater last_updated wins field by field, an existing row
    on ties; non-empty highlights of the winner are kept, else the other's are taken."""
    relevant = changes.where(F.col("key").startswith(PAGE) | F.col("key").startswith(SAVED) | F.col("key").startswith(HIGHLIGHTS))
    newest = relevant.withColumn("_rn", F.row_number().over(W.partitionBy("profile_id", "key").orderBy(F.desc("ordinal")))).where("_rn = 1").drop("_rn")
    built = unify_page_state(newest).withColumn("_new", F.lit(1))
    both = current.withColumn("_new", F.lit(0)).unionByName(built)
    order = F.struct(F.coalesce("last_updated", F.lit(-1.0)).alias("t"), (-F.col("_new")).alias("n"))
    listed = F.when(F.json_array_length("highlights") > 0, F.struct(order.alias("o"), "highlights"))
    held = F.when(F.col("remote").isNotNull(), F.struct(order.alias("o"), "remote"))
    g = both.groupBy("profile_id", "url").agg(F.max(listed)["highlights"].alias("h"), F.max_by("remote", order).alias("r"), F.max("last_updated").alias("last_updated"), F.count(held).alias("_n"))
    return g.select("profile_id", "url", F.col("r").alias("remote"), F.coalesce("h", F.lit("[]")).alias("highlights"), "last_updated")


BUCKETS = 64
KEPT_VERSIONS = 2  # manifests, and the files they name, that readers may still use


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function that makes its paths."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    return hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()), hadoop.Path


def _manifests(spark: SparkSession, path: str) -> list[int]:
    """The batches that have a manifest, rising."""
    fs, at = _files(spark, path)
    found = fs.globStatus(at(f"{path}/manifest/*.json"))
    return sorted(int(x.getPath().getName()[:-5]) for x in found or [])


def _manifest(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """Of each bucket that has rows: the batch that wrote its files."""
    text = spark.read.text(f"{path}/manifest/{batch}.json", wholetext=True).first()[0]
    return {int(k): v for k, v in json.loads(text).items()}


def _move_manifest(spark: SparkSession, path: str, batch: int, versions: dict[int, int]) -> None:
    """Writes a manifest beside its place and renames it, so that it is there as a whole or not at all."""
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{path}/manifest"))
    out = fs.create(at(f"{path}/manifest/_{batch}.tmp"), True)
    out.write(bytearray(json.dumps(versions).encode()))
    out.close()
    fs.rename(at(f"{path}/manifest/_{batch}.tmp"), at(f"{path}/manifest/{batch}.json"))


def _bucket_files(spark: SparkSession, path: str, versions: dict[int, int], schema) -> DataFrame:
    paths = [f"{path}/data/batch={v}/bucket={b}" for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_store_table(spark: SparkSession, path: str) -> DataFrame:
    """The page rows of the last manifest of a table that stream_store_upserts keeps."""
    done = _manifests(spark, path)
    return _bucket_files(spark, path, _manifest(spark, path, done[-1]) if done else {}, STORE_PAGES)


def merge_store_batch(path: str, buckets: int = BUCKETS):
    """A foreachBatch function that merges store changes into the table at path.

    Rows lie in buckets of (profile_id, url). A batch reads and writes the buckets that it touches alone, under its own number, and then moves a new
    manifest into place; a batch that has one already is left out, so that running it twice changes nothing. Files that the last KEPT_VERSIONS
    manifests don't name are removed."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = _manifests(spark, path)
        if done and done[-1] >= batch_id:
            return
        old = _manifest(spark, path, done[-1]) if done else {}
        batch.persist()
        of = F.pmod(F.xxhash64("profile_id", "url"), F.lit(buckets)).cast("int")
        touched = sorted(r[0] for r in route_keys(batch).where("url is not null").select(of.alias("b")).distinct().collect())  # at most ``buckets``
        current = _bucket_files(spark, path, {b: v for b, v in old.items() if b in set(touched)}, STORE_PAGES)
        merged = upsert_batch(current, batch).withColumn("bucket", of)
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/batch={batch_id}")
        fs, at = _files(spark, path)
        written = {int(x.getPath().getName().split("=")[1]) for x in fs.globStatus(at(f"{path}/data/batch={batch_id}/bucket=*")) or []}
        new = {b: v for b, v in old.items() if b not in set(touched)} | {b: batch_id for b in written}
        _move_manifest(spark, path, batch_id, new)
        batch.unpersist()
        kept = [*done, batch_id][-KEPT_VERSIONS:]
        named = {(v, b) for k in kept for b, v in (new if k == batch_id else _manifest(spark, path, k)).items()}
        for x in fs.globStatus(at(f"{path}/data/batch=*/bucket=*")) or []:
            v, b = (int(p.split("=")[1]) for p in (x.getPath().getParent().getName(), x.getPath().getName()))
            if (v, b) not in named:
                fs.delete(x.getPath(), True)
        for k in done:
            if k not in kept:
                fs.delete(at(f"{path}/manifest/{k}.json"), False)

    return merge


def stream_store_upserts(changes: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, **trigger):
    """Starts the job that merges each micro-batch of changes(profile_id, ordinal, key, value) into the table at path: see merge_store_batch; read it
    by read_store_table."""
    write = changes.writeStream.foreachBatch(merge_store_batch(path, buckets)).option("checkpointLocation", checkpoint)
    return write.trigger(**(trigger or {"availableNow": True})).start()
