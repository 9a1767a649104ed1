"""Logs: redaction, repeat suppression, tails and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions.urls import bound, TRACKING_PARAMS

SUPPRESS_AFTER, ANOMALY_AT, CAPACITY, ENTRY_LIMIT = 10, 30, 500, 25_000
REDACTED = "[REDACTED_TOKEN]"
# Query keys whose values are secrets, and parts that make a longer key one.
SECRET_KEYS = ["token", "access_token", "refresh_token", "id_token", "code", "session", "session_id", "key", "api_key", "apikey", "password", "passwd", "auth", "secret", "authorization", "authorization_token", "bearer", "private_token", "credential", "credentials"]
SECRET_PARTS = ["token", "secret", "auth", "password", "passwd", "credential", "credentials"]


def mask_string(s: Column, start: int = 4, end: int = 4) -> Column:
    """[empty] for null and '', *** for what is too short to show anything, else head***tail."""
    n = F.char_length(s)
    return F.when(s.isNull() | (s == ""), "[empty]").when(n <= start + end, "***").otherwise(F.concat(F.substr(s, F.lit(1), F.lit(start)), F.lit("***"), F.substr(s, n - end + 1)))


def _is_secret(key: Column) -> Column:
    k = F.lower(F.replace(key, F.lit("."), F.lit("_")))
    parts = F.filter(F.split(k, "[_-]+"), lambda p: p != "")
    return k.isin(SECRET_KEYS) | ((F.size(parts) > 1) & F.exists(parts, lambda p: p.isin(SECRET_PARTS)))


def sanitize_url(url: Column) -> Column:
    """A URL fit for logs: no user, tracking parameters and fragment; secret values replaced. [empty-url] and
    [invalid-url] stand for what is none, file://[local-file] for local files."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    host = F.lower(F.regexp_extract(url, r"^[^:]+://(?:[^/?#]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    pairs = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING_PARAMS))
    shown = F.transform(pairs, lambda p: F.when(F.contains(p, F.lit("=")) & _is_secret(F.substring_index(p, "=", 1)), F.concat(F.substring_index(p, "=", 1), F.lit(f"={REDACTED}"))).when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    query = F.array_join(shown, "&")
    made = F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url.isNull() | (url == ""), "[empty-url]").when(scheme == "file", "file://[local-file]").when((scheme == "") | (host == "") | host.rlike(r"\s"), "[invalid-url]").otherwise(made)


# What is made safe in a text; an edge of a word counts ASCII letters alone.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
URLS, MAILS = r"https?://[^\s\"',]+", _EDGE + r"[\w%+.-]+@[\d.A-Za-z-]+\.[A-Za-z]{2,}" + _EDGE
REPLACED = [
    (r"(?:Bearer|Basic)\s+[\w+./~-]+=*", "[REDACTED_AUTH_HEADER]"),
    (_EDGE + r"eyJ[\w-]*\.[\w-]*\.[\w-]*" + _EDGE + r"(?!\.[\w-])", "[REDACTED_JWT]"),
    (_EDGE + r"(?:sk|ghp|gho|xoxb|xoxp|key)-[\dA-Za-z]{20,}" + _EDGE, "[REDACTED_API_KEY]"),
    (r"secret_[\dA-Za-z]+", "[REDACTED_TOKEN]"),
]
UUIDS = _EDGE + r"([\dA-Fa-f]{8})-[\dA-Fa-f]{4}-[\dA-Fa-f]{4}-[\dA-Fa-f]{4}-[\dA-Fa-f]{12}" + _EDGE


def _each(text: Column, pattern: str, sign: str, change) -> Column:
    """text with change of every match of pattern; texts without sign hold none."""

    def mixed(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(f"({pattern})"), F.lit(1))
        parts = F.struct(F.split(t, pattern, -1).alias("between"), found.alias("found"))
        return bound(parts, lambda x: F.array_join(F.transform(x["between"], lambda y, i: F.concat(y, F.when(i < F.size(x["found"]), change(F.get(x["found"], i))).otherwise(""))), ""))

    return bound(text, lambda t: F.when(F.contains(t, F.lit(sign)), mixed(t)).otherwise(t))


def redact_text(s: Column) -> Column:
    """Text with URLs, authorization headers, JWTs, API keys, secret_ tokens, e-mail addresses and UUIDs made safe, in
    that order. Null reads as empty; a mail address keeps its first character and its last four. Each step is worked out once."""
    out = _each(F.coalesce(s.cast("string"), F.lit("")), URLS, "://", sanitize_url)
    for pattern, name in REPLACED:
        out = F.regexp_replace(out, pattern, name)
    out = _each(out, MAILS, "@", lambda m: mask_string(m, 1, 4))
    return F.regexp_replace(out, UUIDS, "$1***")


def redact_stack(s: Column) -> Column:
    """Stack traces line by line: directories are dropped before file names, extension ids masked."""
    line = lambda x: F.regexp_replace(F.regexp_replace(x, r"chrome-extension://[a-z]{8,}", "chrome-extension://[id]"), r"(?:file://)?(?:[A-Za-z]:)?(?:[\\/][^\s\\/():]+)+[\\/]([^\s\\/():]+)", "$1")
    return F.array_join(F.transform(F.split(F.coalesce(s, F.lit("")), "\n", -1), line), "\n")


def _action(context: Column) -> Column:
    return F.coalesce(F.get_json_object(context, "$.action"), F.lit(""))


def log_repeats(logs: DataFrame) -> DataFrame:
    """(source, message, action, n, suppressed, anomaly): how often each fingerprint came, how many were over the first
    ten, and whether it reached thirty."""
    g = logs.groupBy("source", "message", _action(F.col("context")).alias("action")).agg(F.count("*").alias("n"))
    return g.withColumn("suppressed", F.greatest(F.lit(0).cast("long"), F.col("n") - SUPPRESS_AFTER)).withColumn("anomaly", F.col("n") >= ANOMALY_AT)


def suppress_repeats(logs: DataFrame) -> DataFrame:
    """The first ten entries of each source's fingerprint, in order of ts; the tenth carries repeat_count where there are more;
    an extra warn entry stands where the count reaches thirty. Counts come from a partial aggregate; only the first
    thirty of a fingerprint are kept after ranking."""
    keys = ["source", "message", "_action"]
    t = logs.withColumn("_action", _action(F.col("context")))
    total = t.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = t.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy("ts", "event_id"))).where(F.col("_rn") <= ANOMALY_AT)
    j = ranked.join(total, keys)
    columns = ["source", "ts", "event_id"]
    kept = j.where(F.col("_rn") <= SUPPRESS_AFTER).select(*columns, "level", "message", F.when((F.col("_rn") == SUPPRESS_AFTER) & (F.col("_n") > SUPPRESS_AFTER), F.col("_n")).alias("repeat_count"))
    odd = j.where(F.col("_rn") == ANOMALY_AT).select(*columns, F.lit("warn").alias("level"), F.concat(F.lit(f'[ANOMALY] message looped {ANOMALY_AT}× in buffer: "'), F.substr("message", F.lit(1), F.lit(200)), F.lit('"')).alias("message"), F.lit(ANOMALY_AT).cast("long").alias("repeat_count"))
    return kept.unionByName(odd)


def log_tail(logs: DataFrame, n: int = CAPACITY) -> DataFrame:
    """The newest n entries of each source."""
    w = W.partitionBy("source").orderBy(F.desc("ts"), F.desc("event_id"))
    return logs.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def truncate_entries(logs: DataFrame, limit: int = ENTRY_LIMIT) -> DataFrame:
    """Messages and contexts cut so that no entry is longer than the limit; ``truncated`` tells which were."""
    long = F.char_length(F.coalesce("message", F.lit(""))) + F.char_length(F.coalesce("context", F.lit(""))) > limit
    return logs.withColumn("truncated", long).withColumn("context", F.when(F.col("truncated"), F.lit('{"truncated":true}')).otherwise(F.col("context"))).withColumn("message", F.when(F.col("truncated"), F.substr("message", F.lit(1), F.lit(limit - 350))).otherwise(F.col("message")))


def write_logs(logs: DataFrame, path: str, how: str = "json") -> None:
    """json: one object a line; tsv: timestamp, level, message by tabs, missing fields left out. Others raise."""
    if how == "json":
        logs.write.json(path)
    elif how == "tsv":
        logs.select(F.concat_ws("\t", F.col("ts").cast("string"), "level", "message")).write.text(path)
    else:
        raise ValueError(f"unknown format: {how}")
