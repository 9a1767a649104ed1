"""Byte-level BPE encoding and decoding in overlapping chunks.

Long texts are cut into chunks that overlap. Each chunk is pre-tokenised on its own; where two neighbours agree
on a pre-token boundary inside their overlap, both scans go on alike from there, and the text is cut. The
pieces between cuts are encoded in parallel and put together again by document. Where an overlap has no common
boundary (one endless word, say), the two chunks stay one piece. Texts of one chunk need no shuffle.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import parts

RANKS = "byte_bpe_50k.tiktoken"
CHUNK, OVERLAP = 32_768, 512  # code points
SENT = 256  # rows that are encoded, or decoded, before they are sent on


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _pattern():
    return regex.compile(public_tokenizers.PATTERN)


def encode_bytes(enc: tiktoken.Encoding, text: str) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return np.asarray(enc.encode_ordinary(text), dtype="<u4").tobytes()


def boundaries(text: str, start: int, stop: int) -> set[int]:
    """Ends of the pre-tokens of text within [start, stop), without those that reach the text's end."""
    return {e for m in _pattern().finditer(text) if start <= (e := m.end()) < min(stop, len(text))}


def _ends(chunks: Iterator[pa.RecordBatch]):
    """(row, chunk, head, tail): boundaries within a chunk's overlap with the one before and the one after,
    as places in the text."""
    for b in chunks:
        row, n, start, last, text = (c.to_pylist() for c in b.columns)
        heads, tails = [], []
        for s, is_last, t in zip(start, last, text):
            heads.append([s + x for x in sorted(boundaries(t[: 2 * OVERLAP], 1, OVERLAP))] if s else [])
            tails.append([] if is_last else [s + x for x in sorted(boundaries(t, CHUNK, CHUNK + OVERLAP))])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))], names=["row", "chunk", "head", "tail"])


def _chunks(chunk: int):
    """(row, chunk, start, last, part): a text's overlapping chunks, cut one after another."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for row, text in ((b.column(0)[k].as_py(), b.column(1)[k].as_py()) for k in range(b.num_rows)):  # one text at a time
                n = max(1, -(-(len(text) - OVERLAP) // chunk))
                for k in range(0, n, 64):
                    at = range(k, min(k + 64, n))
                    parts = [text[x * chunk : None if x == n - 1 else (x + 1) * chunk + OVERLAP] for x in at]
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(at)), pa.array(at, pa.int32()), pa.array([x * chunk for x in at], pa.int64()), pa.array([x == n - 1 for x in at]), pa.array(parts, pa.string())], names=["row", "chunk", "start", "last", "part"])

    return run


def _pieces(batches: Iterator[pa.RecordBatch]):
    """(row, doc_id, times, pos, piece): what lies between a text's edges."""
    for b in batches:
        for row, doc, times, text, edges in (tuple(c[k].as_py() for c in b.columns) for k in range(b.num_rows)):
            spans = list(zip(edges, [*edges[1:], len(text)]))
            for k in range(0, len(spans), 64):
                own = [text[x:y] for x, y in spans[k : k + 64]]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(own)), pa.array([doc] * len(own), pa.int64()), pa.array([times] * len(own), pa.int64()), pa.array(range(k, k + len(own)), pa.int32()), pa.array(own, pa.string())], names=["row", "doc_id", "times", "pos", "piece"])


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        for b in (x.slice(k, SENT) for x in batches for k in range(0, x.num_rows, SENT)):
            out = [encode_bytes(enc, t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.binary())], names=[*b.schema.names[:-1], "ids"])

    return run


def encode_texts(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, ids): ids of each text as bytes of little-endian unsigned 32-bit integers.

    Null and empty texts give no ids; repeated rows each give a row, null doc_ids too."""
    path = public_tokenizers.path(ranks)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    short = rows.where(F.char_length("text") <= chunk + OVERLAP).mapInArrow(_encoded(path), "doc_id long, ids binary")
    # a row's key: equal rows are one row here, and come back as often as they were
    long = rows.where(F.char_length("text") > chunk + OVERLAP).groupBy("doc_id", F.sha2("text", 256).alias("row")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    key = F.concat_ws("-", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "row")
    long = long.withColumn("row", key)
    spread = lambda t, *keys: t.repartition(parts(docs.sparkSession), *keys)  # a text's chunks and pieces are dealt to all tasks
    chunks = spread(long.select("row", "text").mapInArrow(_chunks(chunk), "row string, chunk int, start long, last boolean, part string"), "row", "chunk")
    ends = chunks.mapInArrow(_ends, "row string, chunk int, head array<long>, tail array<long>")
    by_text = W.partitionBy("row").orderBy("chunk")  # a few rows a text
    cuts = ends.withColumn("next", F.lead("head").over(by_text)).select("row", F.array_min(F.array_intersect("tail", "next")).alias("cut")).where("cut is not null")
    cuts = cuts.groupBy("row").agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", F.array().cast("array<long>")))
    pieces = long.join(cuts, "row", "left").select("row", "doc_id", "times", "text", edges.alias("edges"))
    pieces = spread(pieces.select("row", "doc_id", "times", "text", "edges").mapInArrow(_pieces, "row string, doc_id long, times long, pos int, piece string"), "row", "pos")
    coded = pieces.mapInArrow(_encoded(path), "row string, doc_id long, times long, pos int, ids binary")
    whole = coded.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("times").alias("times"), F.array_sort(F.collect_list(F.struct("pos", F.hex("ids").alias("hex")))).alias("s"))
    whole = whole.select("doc_id", F.unhex(F.array_join(F.transform("s", lambda x: x["hex"]), "")).alias("ids"), F.explode(F.array_repeat(F.lit(1), F.col("times").cast("int")))).select("doc_id", "ids")
    return short.unionByName(whole)


def decode_ids(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """(doc_id, ids, decoded): the concatenated raw bytes of the ids."""
    path = public_tokenizers.path(ranks)

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        for b in batches:
            back = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(back, pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def token_digests(docs: DataFrame, ranks: str = RANKS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding every text."""
    path = public_tokenizers.path(ranks)

    def run(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        for b in (x.slice(k, SENT) for x in batches for k in range(0, x.num_rows, SENT)):
            ids = b.column(1).to_pylist()
            back = [hashlib.sha256(enc.decode_bytes(np.frombuffer(x, "<u4").tolist())).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode_texts(docs, ranks, chunk).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
