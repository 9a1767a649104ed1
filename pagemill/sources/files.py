"""Sources and sinks: pages, backups, snapshots and block batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.pages import block_requests
from pagemill.operators.store import filter_backup_keys

FORBIDDEN = r'"(?:__proto__|constructor|prototype)"\s*:'


def read_pages(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Pages; dealt out by page_id where a number of partitions is given, so that large pages spread."""
    pages = spark.read.parquet(path)
    return pages.repartition(partitions, "page_id") if partitions else pages


def read_backup(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(store rows, rejects) of backup files, one file a profile: profile_id is the file's name, or that of its folder
    profile_id=... where write_backup has written it.

    A file is an object with text ``version`` and ``timestamp`` and an object ``data``; names that reach into prototypes,
    however they are spelt, reject it at any depth, and so does malformed JSON. Values stay JSON: texts keep their quotes."""
    name = F.input_file_name()
    profile = F.coalesce(F.nullif(F.regexp_extract(name, r"/profile_id=([^/]+)/[^/]*$", 1), F.lit("")), F.regexp_extract(name, r"([^/]+?)(?:\.[^./]*)?$", 1))
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(profile.alias("profile_id"), "value")
    v = F.try_parse_json("value")
    is_text = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING"
    is_map = F.schema_of_variant(F.try_variant_get(v, "$.data", "variant")).startswith("OBJECT")
    plain = F.to_json(v)  # names without escapes
    marked = files.withColumn("_ok", F.coalesce(v.isNotNull() & ~plain.rlike(FORBIDDEN) & is_text("$.version") & is_text("$.timestamp") & is_map, F.lit(False)))
    data = F.from_json(F.get_json_object("value", "$.data"), "map<string,variant>")
    store = marked.where("_ok").select("profile_id", F.posexplode(data).alias("pos", "key", "value")).select("profile_id", F.col("pos").cast("long").alias("ordinal"), "key", F.to_json("value").alias("value"))
    return store, marked.where("not _ok").select("profile_id", "value")


def write_backup(store: DataFrame, path: str, timestamp: str, version: str) -> None:
    """User rows as backups, a folder a profile: one object with timestamp, version and data. A profile's data is one JSON
    text by the format, bounded by what a browser stores for it. Rows without a value are left out."""
    text = lambda x: F.expr(f"substr(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    member = F.concat(text("key"), F.lit(":"), F.col("value"))
    rows = filter_backup_keys(store).where("value is not null").groupBy("profile_id").agg(F.array_join(F.array_sort(F.collect_list(member)), ",").alias("data"))
    head = F.to_json(F.struct(F.lit(timestamp).alias("timestamp"), F.lit(version).alias("version")))
    rows.select("profile_id", F.concat(F.rtrim(head, F.lit("}")), F.lit(',"data":{'), "data", F.lit("}}")).alias("value")).write.partitionBy("profile_id").text(path)


def write_snapshot(snapshot: dict[str, DataFrame], path: str) -> None:
    for name, part in snapshot.items():
        part.write.parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of a snapshot; a missing table raises."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("highlights", "saved_states", "url_aliases", "metadata")}


def read_snapshot_files(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, rejects) of snapshots as JSON, one file a profile, whose name is the profile_id: the tables highlights (profile_id, pos, item),
    saved_states (the same) and url_aliases (profile_id, url, target), and metadata (profile_id, metadata); items are JSON texts.

    A snapshot is an object with an object ``payload`` that holds the arrays ``saved_states`` and ``highlights`` and, if at all, an
    object ``url_aliases``; other files and malformed JSON are rejects (profile_id, reason, value)."""
    profile = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1)
    files = spark.read.text(path, wholetext=True).select(profile.alias("profile_id"), "value", F.try_parse_json("value").alias("v"))
    kind = lambda p: F.coalesce(F.schema_of_variant(F.try_variant_get("v", p, "variant")), F.lit(""))
    reason = (
        F.when(F.col("v").isNull(), "malformed").when(~F.schema_of_variant("v").startswith("OBJECT"), "no object").when(~kind("$.payload").startswith("OBJECT"), "no payload")
        .when(~kind("$.payload.saved_states").startswith("ARRAY"), "no saved_states").when(~kind("$.payload.highlights").startswith("ARRAY"), "no highlights")
        .when(~kind("$.payload.url_aliases").rlike("^(OBJECT.*)?$"), "url_aliases is no object")
    )
    marked = files.withColumn("reason", reason)
    good = marked.where("reason is null")
    items = lambda name: good.select("profile_id", F.posexplode(F.try_variant_get("v", f"$.payload.{name}", "array<variant>")).alias("pos", "x")).select("profile_id", "pos", F.to_json("x").alias("item"))
    names = good.select("profile_id", F.explode(F.from_json(F.to_json(F.try_variant_get("v", "$.payload.url_aliases", "variant")), "map<string,string>")).alias("url", "target"))
    meta = good.select("profile_id", F.to_json(F.try_variant_get("v", "$.metadata", "variant")).alias("metadata"))
    return {"highlights": items("highlights"), "saved_states": items("saved_states"), "url_aliases": names, "metadata": meta}, marked.where("reason is not null").select("profile_id", "reason", "value")


def write_block_batches(blocks: DataFrame, path: str, size: int = 100) -> None:
    """One JSON row a request of at most ``size`` blocks, in order: files in order of their names and rows in a file are sorted by page and
    batch, so that a sender that reads them one after another keeps each page's order."""
    requests = block_requests(blocks, size)
    requests.repartitionByRange("page_id", "batch").sortWithinPartitions("page_id", "batch").write.json(path)
