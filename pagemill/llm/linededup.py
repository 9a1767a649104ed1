"""Line dedup: drop repeated lines by a sorted sweep over line hashes.

Lines become (hash, document, position) rows; texts stay where they are. The rows are range-partitioned
by hash *and document*, so that a line found in a third of all documents is spread over many tasks, sorted
by hash, document and position, and swept once. Only the runs at the ends of a task's range can go on in
another task; their partial counts (two rows a task) are summed and settle the rows left open. Of a run that is
still undecided after HELD rows (few documents with very many equal lines) the rows are left open too, so that a
task holds no more than that and one batch. What comes back is one zlib-compressed keep bitmap per document that loses lines.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import frugal, staged

BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DROP, OPEN, PARTIAL = 0, 1, 2
HELD = 10_000
NO_ID = -(2**63)  # stands for a null doc_id
_SWEPT = "kind int, doc long, copy long, pos int, n_lines int, h1 long, h2 long, n long, task int"


def line_rows(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc, copy, n_lines, pos, h1, h2) of each line whose key has min_chars code points or more.

    Null text counts as one empty line. ``copy`` is a hash of the text: rows that share a doc_id and a text
    are one document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.translate(F.trim(F.col("line"), F.lit(BLANKS)), UPPER, LOWER)
    return (
        docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text).alias("copy"), F.split(text, "\n", -1).alias("lines"))
        .select("doc", "copy", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("pos", "line"))
        .select("doc", "copy", "n_lines", "pos", key.alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("doc", "copy", "n_lines", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"))
    )


def _sweep(min_docs: int | None):
    """Streams one task's sorted rows. min_docs None: all but the first of each hash go."""

    def frame(kind, rows, n=0):
        return pd.DataFrame({"kind": np.int32(kind), "doc": rows["doc"], "copy": rows["copy"], "pos": rows["pos"], "n_lines": rows["n_lines"], "h1": rows["h1"], "h2": rows["h2"], "n": n, "task": TaskContext.get().partitionId()})

    @frugal
    def sweep(batches):
        held = None  # rows of the running hash, as long as they are undecided and few
        spilled = False  # undecided rows of the running hash are out already, to be settled by its count
        first = now = last_doc = tail = None
        seen, first_told = 0, False
        for batch in batches:
            if not len(batch):
                continue
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            h, docs = rows[["h1", "h2"]].to_numpy(), rows["doc"].to_numpy()
            head = (h[0, 0], h[0, 1])
            new_hash = np.r_[True, (h[1:] != h[:-1]).any(axis=1)]
            if first is None:
                first = head
            if min_docs is None:
                drop = ~new_hash
                if head == now:
                    drop[0] = True
                elif now is None:
                    yield frame(OPEN, rows.iloc[[0]])
            else:
                new_doc = new_hash | np.r_[True, docs[1:] != docs[:-1]]
                counts = np.add.reduceat(new_doc.astype(np.int64), np.flatnonzero(new_hash))
                run = np.cumsum(new_hash) - 1
                if head == now and held is None:  # rows that went before have counted already
                    counts[0] += seen - (docs[0] == last_doc)
                if now == first != head and not first_told:
                    first_told = True
                    yield frame(PARTIAL, tail, seen)
                elif spilled and head != now:
                    yield frame(PARTIAL, tail, seen)
                spilled = spilled and head == now
                drop = (counts >= min_docs)[run]
                last_run = run == run[-1]
                if head == first and not last_run[0]:
                    first_told = True
                    yield frame(PARTIAL, rows.iloc[[0]], counts[0])
                    if not drop[0]:
                        yield frame(OPEN, rows[run == 0])
                elif spilled and not last_run[0]:
                    yield frame(PARTIAL, rows.iloc[[0]], counts[0])
                spilled = spilled and last_run[0]
                held = None if drop[-1] else rows[last_run].reset_index(drop=True)
                if held is not None and (spilled or len(held) > HELD):
                    yield frame(OPEN, held)
                    held, spilled = None, True
                seen, last_doc = int(counts[-1]), docs[-1]
            if drop.any():
                yield frame(DROP, rows[drop])
            now, tail = (h[-1, 0], h[-1, 1]), rows.iloc[[-1]]
        if now is not None:
            yield frame(PARTIAL, tail, seen)
            if held is not None:
                yield frame(OPEN, held)

    return sweep


def dropped_lines(docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1) -> DataFrame:
    """(doc, copy, n_lines, pos) of the lines to drop.

    min_docs N: every line whose key is in N documents or more goes, everywhere. None: of the lines with one
    key the first by document and position stays. Empty tables give no rows; a null doc_id counts as one
    document; repeated rows count once."""
    rows = line_rows(docs, min_chars)
    order = ["h1", "h2", "doc", "copy", "pos"]
    rows = rows.repartitionByRange("h1", "h2", "doc").sortWithinPartitions(*order)
    swept = staged(rows.mapInPandas(_sweep(min_docs), _SWEPT), "lines")
    left = swept.where(F.col("kind") == OPEN)
    ends = swept.where(F.col("kind") == PARTIAL)  # two rows a task, and one for each run of over HELD rows
    if min_docs is None:
        first = ends.groupBy("h1", "h2").agg(F.min("task").alias("first_task"))
        settled = left.join(F.broadcast(first), ["h1", "h2"]).where("first_task < task")
    else:
        over = ends.groupBy("h1", "h2").agg(F.sum("n").alias("docs")).where(F.col("docs") >= min_docs)
        settled = left.join(over.select("h1", "h2"), ["h1", "h2"], "left_semi")
    columns = ["doc", "copy", "n_lines", "pos"]
    return swept.where(F.col("kind") == DROP).select(*columns).unionByName(settled.select(*columns))


@F.pandas_udf(T.BinaryType())
def _bitmap(n_lines: pd.Series, gone: pd.Series) -> pd.Series:
    def one(n, g):
        keep = np.ones(int(n), np.uint8)
        keep[np.asarray(g, dtype=np.int64)] = 0
        return zlib.compress(np.packbits(keep).tobytes(), 6)

    return pd.Series([one(n, g) for n, g in zip(n_lines, gone)], dtype=object)


@F.pandas_udf(T.StringType())
def _kept_text(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    def one(t, b):
        if b is None or t is None:
            return t
        lines = t.split("\n")
        keep = np.unpackbits(np.frombuffer(zlib.decompress(b), np.uint8), count=len(lines))
        return "\n".join(x for x, k in zip(lines, keep) if k)

    return pd.Series([one(t, b) for t, b in zip(text, bitmap)], dtype=object)


def keep_bitmaps(docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, copy, n_dropped, keep_bitmap): for each document that loses lines, a zlib-compressed bitmap
    with one bit a line, 1 for lines that stay. Documents that lose nothing have no row."""
    gone = dropped_lines(docs, min_docs, min_chars).groupBy("doc", "copy").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return gone.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "copy", F.size("gone").cast("long").alias("n_dropped"), _bitmap("n_lines", "gone").alias("keep_bitmap"))


def dedup_lines(docs: DataFrame, min_docs: int | None = 10, min_chars: int = 1) -> DataFrame:
    """docs with ``text`` cut to the lines that stay (null becomes empty), ``n_chars`` following it where that
    column is present, and the extra columns n_lines and n_dropped, which take the place of columns so named."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    maps = keep_bitmaps(docs, min_docs, min_chars).toDF("_pm_doc", "_pm_copy", "_pm_dropped", "_pm_bits")
    own = docs.withColumns({"text": text, "_pm_key": F.xxhash64(text)})
    joined = own.join(maps, own["doc_id"].cast("long").eqNullSafe(maps["_pm_doc"]) & (own["_pm_key"] == maps["_pm_copy"]), "left")
    cut = _kept_text(F.when(F.col("_pm_bits").isNotNull(), F.col("text")), F.col("_pm_bits"))
    out = joined.withColumns({"n_lines": F.size(F.split("text", "\n", -1)).cast("long"), "n_dropped": F.coalesce("_pm_dropped", F.lit(0)).cast("long"), "_pm_cut": cut})
    out = out.withColumn("text", F.coalesce("_pm_cut", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast("long"))
    return out.select(*docs.columns, *(c for c in ("n_lines", "n_dropped") if c not in docs.columns))
