"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

A round takes one class of piece lengths. Open gaps and pieces are range-sorted by size together and every
task sweeps its range once, large sizes first: a gap is pushed on a stack, a piece takes the top, which is
its successor, the smallest gap left that holds it. Pieces and gaps that a task can't pair are numbered, and
two counts a task settle which ranks meet across tasks. Pieces that want the same gap are told apart by
rank. Then the gaps are updated and the next round runs; pieces that fit nowhere open new sequences.
"""

from __future__ import annotations

import json
import zlib
from array import array
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagemill.llm.common import frugal, parts, staged, task_row_ids

CAPACITY = 2048
SEPARATOR = 0
TOKENIZER = "word_bpe_49k.json"
CACHED_WORDS = 400_000  # words a task remembers; beyond, it forgets all and goes on

_loaded: dict[str, WordIds] = {}


END = "\0"  # stands for the end of a word in the merge ranks


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class WordIds:
    """Ids of texts by a word BPE, as bytes of little-endian unsigned 32-bit integers.

    The tokenizer's pre-tokens never hold white space, so what stands between white space is encoded once
    and remembered. New words of Latin-1 letters are split by the tokenizer file's pattern and merged all at once by
    its merges, written as ranks; all else (other scripts, texts with zero bytes, with four control characters that are
    white space to str.split only, or with what may be a special token's name) goes through the tokenizer itself."""

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _byte_letters()
        suffix = model["end_of_word_suffix"]
        as_bytes = lambda t: bytes(letters[c] for c in t.removesuffix(suffix)) + END.encode() * t.endswith(suffix)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order = [*letters, *(c + suffix for c in letters), *(a + b for a, b in merges)]
        self.id_of = np.array([model["vocab"][t] for t in order], dtype="<u4")
        self.ends = np.array([t.endswith(suffix) for t in order])
        self.bpe = tiktoken.Encoding("own", pat_str="[^\0]+\0", mergeable_ranks={as_bytes(t): k for k, t in enumerate(order)}, special_tokens={})
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] + "|\\n").findall
        # white space to str.split only, the end mark, and how the tokens begin that may be in a text by name
        self.odd = ["\0", "\x1c", "\x1d", "\x1e", "\x1f", *{t["content"][:2] for t in spec["added_tokens"]}]
        self.known: dict[str, bytes] = {}

    def _plain(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _learn(self, new: list[str]) -> None:
        other = [c for c in new if not c.isascii() and max(c) > "\xff"]
        if other:
            self.known.update((c, array("I", e.ids).tobytes()) for c, e in zip(other, self.tok.encode_batch_fast(other, add_special_tokens=False)))
            away = set(other)
            new = [c for c in new if c not in away]
        if not new:
            return
        said = self.words("\n".join(new).lower() + "\n")  # pieces of words, and a line end after each word
        breaks = np.flatnonzero(np.array(said, object) == "\n")
        ids = np.array(self.bpe.encode_ordinary((END.join(said) + END).replace("\n" + END, "")), np.int64)
        ends = np.r_[0, 1 + np.flatnonzero(self.ends[ids])]
        at = (4 * ends[np.r_[0, breaks - np.arange(len(breaks))]]).tolist()
        ids = self.id_of[ids].tobytes()
        self.known.update((c, ids[x:y]) for c, x, y in zip(new, at, at[1:]))

    def encode(self, texts: list[str]) -> list[bytes]:
        odd = [any(c in t for c in self.odd) for t in texts]
        split = [[] if o else t.split() for t, o in zip(texts, odd)]
        flat = list(chain.from_iterable(split))
        words = set(flat)
        if len(self.known) + len(words) > CACHED_WORDS:
            self.known.clear()
        self._learn(list(words.difference(self.known)))
        found = list(map(self.known.__getitem__, flat))
        ends = list(accumulate(map(len, split)))
        return [self._plain(t) if o else b"".join(found[z - len(s) : z]) for t, s, o, z in zip(texts, split, odd, ends)]


def _word_ids(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """(piece_key, doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and a separator, cut
    every ``capacity`` ids. Null and empty texts are the separator alone; repeated rows are packed each."""
    schema = "piece_key long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    @frugal
    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words, keys = _word_ids(public_tokenizers.path(tokenizer)), task_row_ids()
        end = np.asarray([SEPARATOR], dtype="<u4").tobytes()
        step = 4 * capacity
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    out = []
                    for doc, ids in zip(part.column(0).to_pylist(), words.encode(part.column(1).to_pylist())):
                        ids += end
                        for n, b in enumerate(range(0, len(ids), step)):
                            piece = ids[b : b + step]
                            out.append((next(keys), doc, n, b // 4, len(piece) // 4, zlib.crc32(piece)) + (piece,) * with_ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out), types)], names=names)
        finally:
            words.known.clear()  # a worker goes on to other stages

    import pyarrow as pa

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = ["piece_key", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(cut, schema)


_PAIRED = "kind int, piece_key long, length long, sequence_id long, task int, place long"
PAIR, PIECE_LEFT, GAP_LEFT = 0, 1, 2


@frugal
def _successors(batches):
    """One task's sweep over (size desc, gaps before pieces)."""
    task = TaskContext.get().partitionId()
    stack: list[int] = []
    n_left = 0
    for b in batches:
        pair, left = [], []
        for key, size, is_piece in zip(b["key"].tolist(), b["size"].tolist(), b["is_piece"].tolist()):
            if not is_piece:
                stack.append(key)
            elif stack:
                pair.append((PAIR, key, size, stack.pop(), task, 0))
            else:
                left.append((PIECE_LEFT, key, size, 0, task, n_left))
                n_left += 1
        yield pd.DataFrame(pair + left, columns=["kind", "piece_key", "length", "sequence_id", "task", "place"])
    yield pd.DataFrame([(GAP_LEFT, 0, 0, g, task, k) for k, g in enumerate(stack)], columns=["kind", "piece_key", "length", "sequence_id", "task", "place"])


def _across(counts: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(piece task, first place, last place, gap task, sum of the two places) of what meets across tasks.
    counts: by task, in order of size, how many pieces and gaps are left. Linear in the number of tasks."""
    stack, met = [], []
    for task in sorted(counts):
        pieces, gaps = counts[task]
        at = 0
        while at < pieces and stack:
            other, n = stack.pop()
            m = min(n, pieces - at)
            met.append((task, at, at + m - 1, other, at + n - 1))
            at += m
            if n > m:
                stack.append((other, n - m))
        if gaps:
            stack.append((task, gaps))
    return met


def _match(gaps: DataFrame, pieces: DataFrame, low: int, high: int) -> tuple[DataFrame, int]:
    """(piece_key, length, sequence_id), and how many rows that is: each piece at most once; a gap once for each slot it offers.
    A gap offers slots of size high, and what is over as a slot of its own if a piece can be as short."""
    spark = gaps.sparkSession
    whole, rest = F.floor(F.col("gap") / high), F.col("gap") % high
    slots = gaps.where(F.col("gap") > low).select("sequence_id", F.when(whole == 0, F.array("gap")).when(rest > low, F.concat(F.array_repeat(F.lit(high).cast("long"), whole.cast("int")), F.array(rest))).otherwise(F.concat(F.array((high + rest).cast("long")), F.array_repeat(F.lit(high).cast("long"), whole.cast("int") - 1))).alias("s"))
    both = slots.select(F.col("sequence_id").alias("key"), F.explode("s").alias("size"), F.lit(False).alias("is_piece")).unionByName(pieces.select(F.col("piece_key").alias("key"), F.col("length").alias("size"), F.lit(True).alias("is_piece")))
    both = both.withColumn("tie", F.xxhash64("key", "is_piece"))
    order = [F.desc("size"), F.asc("is_piece"), F.asc("tie"), F.asc("key")]
    swept = staged(both.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(_successors, _PAIRED), "sweep")
    counts = swept.groupBy("task").agg(*(F.count_if(F.col("kind") == k).alias(n) for k, n in ((PAIR, "pairs"), (PIECE_LEFT, "pieces"), (GAP_LEFT, "gaps")))).collect()  # one row a task
    met = _across({r["task"]: (r["pieces"], r["gaps"]) for r in counts})
    n = sum(r["pairs"] for r in counts) + sum(last - first + 1 for _, first, last, _, _ in met)
    found = swept.where(F.col("kind") == PAIR).select("piece_key", "length", "sequence_id")
    if not met:
        return found, n
    meets = F.broadcast(spark.createDataFrame(met, "task int, low long, high long, other int, total long"))  # two rows a task at most
    want = swept.where(F.col("kind") == PIECE_LEFT).join(meets, "task").where("place between low and high").select("piece_key", "length", F.col("other").alias("task"), (F.col("total") - F.col("place")).alias("place"))
    have = swept.where(F.col("kind") == GAP_LEFT).select("sequence_id", "task", "place")
    return found.unionByName(want.join(have, ["task", "place"]).select("piece_key", "length", "sequence_id")), n


def _open_new(capacity: int):
    @frugal
    def fill(batches):
        now, room = None, 0
        for b in batches:
            ids = []
            for key, length in zip(b["piece_key"].tolist(), b["length"].tolist()):
                if length > room:
                    now, room = key, capacity
                room -= length
                ids.append(now)
            yield b.assign(sequence_id=ids)[["piece_key", "length", "sequence_id"]]

    return fill


_PLACED = "piece_key long, length long, sequence_id long"


def best_fit(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(piece_key, length, sequence_id, offset) for pieces(piece_key, length), 1 <= length <= capacity.

    piece_key is unique; a sequence has the key of its first piece as its id. All pieces are placed, with
    offsets gapless from 0. An empty table gives no rows. Pieces of equal length are told apart by key."""
    spark = pieces.sparkSession
    bounds = [(capacity >> 1, capacity)]
    while bounds[-1][0] > capacity // 32:
        bounds.append((bounds[-1][0] >> 1, bounds[-1][0]))
    bounds[-1] = (0, bounds[-1][1])
    of_class = lambda lo, hi: (F.col("length") > lo) & (F.col("length") <= hi)
    n = pieces.agg(*(F.count_if(of_class(lo, hi)).alias(f"c{k}") for k, (lo, hi) in enumerate(bounds))).first()
    pieces = pieces.select("piece_key", "length")
    first = pieces.where(of_class(*bounds[0])).withColumn("sequence_id", F.col("piece_key"))
    placed = [first.withColumn("round", F.lit(0))]
    gaps = first.select("sequence_id", (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0")
    turn = 0
    for k, (lo, hi) in enumerate(bounds[1:], 1):
        todo, left = pieces.where(of_class(lo, hi)), n[f"c{k}"]
        while left:
            turn += 1
            found, m = _match(gaps, todo, lo, hi)
            if m:
                placed.append(found.withColumn("round", F.lit(turn)))
                taken = found.groupBy("sequence_id").agg(F.sum("length").alias("taken"))
                gaps = staged(gaps.join(taken, "sequence_id", "left").select("sequence_id", (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap")).where("gap > 0"), "gaps")
                left -= m
                todo = staged(todo.join(found.select("piece_key"), "piece_key", "left_anti"), "todo") if left else todo
            elif left:
                order = [F.desc("length"), F.asc("piece_key")]
                new = staged(todo.repartitionByRange(max(1, min(parts(spark), left // 500)), *order).sortWithinPartitions(*order).mapInPandas(_open_new(capacity), _PLACED), "new")
                placed.append(new.withColumn("round", F.lit(turn)))
                gaps = staged(gaps.unionByName(new.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("gap")).where("gap > 0")), "gaps")
                left = 0
    every = placed[0]
    for p in placed[1:]:
        every = every.unionByName(p)
    in_order = W.partitionBy("sequence_id").orderBy("round", "piece_key").rowsBetween(W.unboundedPreceding, -1)  # at most ``capacity`` rows
    return every.select("piece_key", "length", "sequence_id", F.coalesce(F.sum("length").over(in_order), F.lit(0)).cast("long").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, with_ids: bool = True) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]."""
    pieces = staged(token_pieces(docs, tokenizer, capacity, with_ids), "pieces", batch="4m")
    places = best_fit(pieces, capacity).select("piece_key", "sequence_id", "offset")
    return pieces.join(places, "piece_key").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed ids of each sequence in one array of bytes; needs with_ids."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # a sequence's pieces: bounded by the capacity
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_join(F.transform(one, lambda x: F.hex(x["ids"])), "").alias("hex")).select("sequence_id", "length", F.unhex("hex").alias("ids"))
