"""SimHash fingerprints, with DataFrame functions only.

Terms are runs of three words (fewer in shorter texts); each occurrence votes on the 64 bits of its hash, so a
term weighs as often as it occurs. Votes are counted by a plain aggregate: two bits share a long as 32-bit
counters, which no text that fits a row can fill, summed before the shuffle, so a text sends one row. Neighbours within a Hamming radius are found by
permuted block tables: of six blocks three at least agree within radius 3, so each of the 20 choices of
three blocks is a table keyed by those bits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import staged

TERM_WORDS, BITS, LANE = 3, 64, 32
RADIUS = 3
_BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]  # first bit, bits


def term_hashes(text: Column) -> Column:
    """64-bit hashes of the terms of a text: of each word and the two after it, as far as there are any.
    Punctuation at an end makes an empty word there, so every text has a term."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")

    def terms(w):
        starts = F.slice(w, 1, F.greatest(F.lit(1), F.size(w) - (TERM_WORDS - 1)))
        return F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + k) for k in range(1, TERM_WORDS))))

    return F.transform(F.array(words), terms)[0]  # binds the words, so they are split once


def fingerprint_longs(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and ``bits``, a long of 64 majority votes, for each distinct value of keys."""
    hashes = rows.select(*keys, F.explode(term_hashes(F.col(text))).alias("h"))
    votes = [F.sum(F.shiftrightunsigned("h", k).bitwiseAND(F.lit(1 | 1 << LANE))).alias(f"v{k}") for k in range(LANE)]
    summed = hashes.groupBy(*keys).agg(F.count("*").alias("n"), *votes)
    bits = F.lit(0).cast("long")
    for k in range(LANE):
        for j in range(2):
            count = F.shiftrightunsigned(f"v{k}", j * LANE).bitwiseAND(F.lit((1 << LANE) - 1))
            one = 1 << (k + j * LANE)
            bits = bits.bitwiseOR(F.when(count * 2 > F.col("n"), F.lit(one - 2**64 if one == 2**63 else one).cast("long")).otherwise(F.lit(0).cast("long")))
    return summed.select(*keys, bits.alias("bits"))


def as_text(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


@dataclass(frozen=True)
class Range:
    """Ids from ``first`` to ``last`` (of null ids, both None) in ``cuts`` buckets numbered from ``base``: of even width or,
    where there is one id only, by the hash of the text."""

    first: int | None
    last: int | None
    cuts: int
    base: int = 0

    @property
    def width(self) -> int:
        return -(-(self.last - self.first + 1) // self.cuts)

    def bucket(self, tie: str = "0") -> Column:
        """The bucket of doc_id, which is in the range; tie: a long hash of the text."""
        whole = lambda x: f"cast({x} as decimal(21,0))"
        if self.cuts == 1:
            return F.lit(self.base).cast("long")
        if self.first == self.last:
            return F.expr(f"{self.base}L + ({whole(tie)} + {whole(repr(str(2**63)))}) div {whole(repr(str(-(-(2**64) // self.cuts))))}")
        return F.expr(f"{self.base}L + ({whole('doc_id')} - {whole(repr(str(self.first)))}) div {whole(repr(str(self.width)))}")


def id_ranges(ids: DataFrame, buckets: int) -> list[Range]:
    """Ranges of doc_id, nulls first, that give buckets of at most about twice the mean number of rows: even cuts, of which
    those that hold more are cut again. ids is read once for each depth; only counts of full buckets reach the driver."""
    all_ = ids.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    most = max(1, -(-all_["n"] // buckets))
    ready = [Range(None, None, -(-all_["nulls"] // most))] if all_["nulls"] else []
    todo = [] if all_["lo"] is None else [Range(all_["lo"], all_["hi"], min(all_["hi"] - all_["lo"] + 1, -(-(all_["n"] - all_["nulls"]) // most)))]
    while todo:
        of = F.lit(None).cast("struct<k:int,cut:long>")
        for k, r in enumerate(todo):
            of = F.when(F.col("doc_id").between(F.lit(r.first).cast("long"), F.lit(r.last).cast("long")), F.struct(F.lit(k).alias("k"), r.bucket().alias("cut"))).otherwise(of)
        full = ids.select(of.alias("at")).where("at is not null").groupBy("at").agg(F.count("*").alias("n")).where(F.col("n") > 2 * most).select("at.*", "n").collect()
        deeper = []
        for k, r in enumerate(todo):
            at = r.first
            for cut, n in sorted((x["cut"], x["n"]) for x in full if x["k"] == k):
                lo, hi = r.first + cut * r.width, min(r.last, r.first + (cut + 1) * r.width - 1)
                if lo > at:
                    ready.append(Range(at, lo - 1, -(-(lo - at) // r.width)))
                (ready if lo == hi else deeper).append(Range(lo, hi, -(-n // most) if lo == hi else min(hi - lo + 1, -(-n // most))))
                at = hi + 1
            if at <= r.last:
                ready.append(Range(at, r.last, -(-(r.last - at + 1) // r.width)))
        todo = deeper
    out, base = [], 0
    for r in sorted(ready, key=lambda r: (r.first is not None, r.first)):
        out.append(replace(r, base=base))
        base += r.cuts
    return out


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, place, doc_id, text, next_bucket, next_place, next_text): each row's successor by ascending
    doc_id, the last row's being the first. Null text is empty; null ids come first; ties go by a hash of the text.

    Ids are cut into ranges of bounded numbers of rows (repeated rows of one id and text stay together). A window runs
    within each range, and the first row of the next range that has rows is added to it as a last row, so no range
    sees more than its own rows and one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    bucket = F.lit(0).cast("long")
    for r in reversed(id_ranges(rows.select("doc_id"), buckets)):
        inside = F.col("doc_id").isNull() if r.first is None else F.col("doc_id") <= r.last
        bucket = F.when(inside, r.bucket("tie")).otherwise(bucket)
    rows = rows.withColumn("bucket", bucket)
    order = ["doc_id", "tie", "text"]
    heads = rows.groupBy("bucket").agg(F.min(F.struct(*order)).alias("head"))  # one row a range
    in_order = W.orderBy("bucket")
    ids = rows.select("bucket").distinct()
    ring = ids.select("bucket", F.coalesce(F.lead("bucket").over(in_order), F.first("bucket").over(in_order)).alias("from"))
    ends = heads.join(F.broadcast(ring.toDF("to", "bucket")), "bucket").select("head.*", F.col("to").alias("bucket"), F.lit(1).alias("added"), F.col("bucket").alias("of"))
    both = rows.select(*order, "bucket", F.lit(0).alias("added"), F.col("bucket").alias("of")).unionByName(ends)
    w = W.partitionBy("bucket").orderBy("added", F.asc_nulls_first("doc_id"), "tie", "text")
    next_row = F.lead(F.struct("text", "of", "added")).over(w)
    out = both.select("*", F.row_number().over(w).alias("place"), next_row.alias("next")).where("added = 0")
    return out.select("bucket", "place", "doc_id", "text", F.col("next.of").alias("next_bucket"), F.when(F.col("next.added") == 1, F.lit(1)).otherwise(F.col("place") + 1).alias("next_place"), F.col("next.text").alias("next_text"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The edited text has its last quarter replaced by the start of the next document's text.

    Repeated rows give a row each (their successor is their copy). An empty table gives no rows; a single
    row is its own successor. Texts of any length are taken whole; columns of docs other than doc_id and text play no part."""
    spark = docs.sparkSession
    rows = with_next(docs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    keys = ["bucket", "place", "doc_id", "next_bucket", "next_place"]
    two = rows.select(*keys, n.cast("long").alias("n_chars"), F.sha2(edited, 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), edited.alias("t")))).alias("v"))
    two = two.select(*keys, "n_chars", "edited_sha256", "v.which", F.col("v.t").alias("text"))
    prints = fingerprint_longs(two, [*keys, "n_chars", "edited_sha256", "which"])
    both = staged(prints.groupBy("bucket", "place").agg(*(F.first(c).alias(c) for c in [*keys[2:], "n_chars", "edited_sha256"]), F.max(F.when(F.col("which") == 0, F.col("bits"))).alias("own"), F.max(F.when(F.col("which") == 1, F.col("bits"))).alias("edit")), "prints")
    following = both.select(F.col("bucket").alias("next_bucket"), F.col("place").alias("next_place"), F.col("own").alias("next_own"))
    return both.join(following, ["next_bucket", "next_place"]).select("doc_id", "n_chars", "edited_sha256", as_text(F.col("own")).alias("fingerprint"), as_text(F.col("edit")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("edit")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): one row for each distinct doc_id and text; null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    return fingerprint_longs(rows.dropDuplicates(["doc_id", "copy"]), ["doc_id", "copy"]).select("doc_id", "bits")


def block_key(bits: Column, blocks: tuple[int, ...]) -> Column:
    """The bits of the chosen blocks, moved to the front in order: the key of one permuted table."""
    key = F.lit(0).cast("long")
    for b in blocks:
        first, size = _BLOCKS[b]
        key = F.shiftleft(key, size).bitwiseOR(F.shiftrightunsigned(bits, first).bitwiseAND(F.lit((1 << size) - 1)))
    return key


def fingerprint_neighbours(prints: DataFrame, queries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query_bits, bits, distance) for each distinct query fingerprint and all distinct fingerprints within
    ``radius`` (at most 3) of it, itself included if present. Fingerprints are distinct first, so that groups
    of copies are one row; a pair that meets in several tables is kept in the first only."""
    if not 0 <= radius <= 3:
        raise ValueError("six blocks guarantee radius 3 at most")
    chosen = list(combinations(range(len(_BLOCKS)), 3))
    tables = lambda d, name: d.select(F.col("bits").alias(name)).where("bits is not null").distinct().select(name, F.posexplode(F.array(*(block_key(F.col(name), c) for c in chosen))).alias("table", "key"))
    met = tables(queries, "query_bits").join(tables(prints, "bits"), ["table", "key"])
    met = met.withColumn("distance", F.bit_count(F.col("bits").bitwiseXOR(F.col("query_bits")))).where(F.col("distance") <= radius)
    agree = F.array(*(block_key(F.col("bits"), c) == block_key(F.col("query_bits"), c) for c in chosen))
    return met.where(F.col("table") == F.array_position(agree, True) - 1).select("query_bits", "bits", "distance")


def neighbours_of_queries(docs: DataFrame, radius: int = RADIUS, every: int = 50) -> DataFrame:
    """(doc_id, fingerprint, near_fingerprint, distance): for each row whose id is divisible by ``every``, all distinct
    fingerprints of docs within ``radius`` of its own, itself included."""
    prints = staged(document_fingerprints(docs), "fingerprints")
    asked = prints.where(F.col("doc_id") % every == 0)
    found = fingerprint_neighbours(prints, asked, radius)
    return asked.join(found, asked["bits"] == found["query_bits"]).select("doc_id", as_text(F.col("query_bits")).alias("fingerprint"), as_text(found["bits"]).alias("near_fingerprint"), "distance")
