"""Cross-tokenizer alignment by pointer jumping.

Two tokenizers cut the same bytes into tokens. Every token points to its farthest-right overlapping token: the other
tokenizer's token that holds its last byte, if that one ends later. Where both end together the first tokenizer's
token is a terminal and points to itself. Successors are doubled until nothing changes, so each token knows the terminal of its
component after as many rounds as the logarithm of the longest chain; tokens of one terminal are a group.

Both tokenizers start afresh at a single space between two characters that aren't white space: no token goes over it. Texts are
cut there into segments; equal segments of a batch are tokenised once, and all its tokens jump together. A long text is taken in
parts; only one without such spaces is a single segment. Links (pairs of tokens that end together) are counted for each text, and over the corpus by a partial and a
final count of id pairs; the counts return to the texts by a broadcast table of up to BROADCAST_PAIRS pairs, or beyond it by a join
whose frequent pairs are spread over SALTS parts.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm.bpe import encoder
from pagemill.llm.common import staged

BYTE_BPE, BYTE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
PART_CHARS = 4_000_000  # code points of text that are cut into segments and aligned at a time
PLAIN_CHARS, PLAIN_BELOW = 64, "\u0250"  # what is merged by ranks: short segments of Latin letters
BROADCAST_PAIRS = 4_000_000  # rows of three numbers
SALTS = 32
_CUT = re.compile(r"(?<=\S) (?=\S)")
_TEXTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
_DONE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of byte-level BPE stands for: printable ones are themselves, the others come in order from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of every id.

    The first one's vocabulary also stands as ranks: short segments of Latin letters are merged by those, faster and with the same
    ids; all others by the library itself."""

    def __init__(self, a_path: str, a_ranks: str, b_path: str):
        self.a, self.b, self.ranks = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), encoder(a_ranks)
        self.a.encode_special_tokens = True
        letters = byte_letters()
        tokens = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(tokens.values()) + 1)
        for t, i in tokens.items():
            self.a_bytes[i] = bytes(letters[c] for c in t)
        piece = lambda i: bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()
        self.b_bytes = [piece(i) for i in range(self.b.get_piece_size())]
        self.signed = [f"{sign}{k}" for first, each in ((";", self.a_bytes), ("|", self.b_bytes)) for k in range(len(each)) for sign in (",", first)]
        self.a_size, self.b_size = (np.array([len(x) for x in each]) for each in (self.a_bytes, self.b_bytes))

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of a space and each segment; the second tokenizer adds the space itself."""
        plain = [len(s) <= PLAIN_CHARS and max(s, default="") < PLAIN_BELOW for s in segments]
        rest = self.a.encode_batch_fast([" " + s for s, p in zip(segments, plain) if not p], add_special_tokens=False)
        rest, merge = iter(rest), self.ranks.encode_ordinary
        return [merge(" " + s) if p else next(rest).ids for s, p in zip(segments, plain)], self.b.encode(segments, num_threads=1)


@functools.cache
def tokenizers(a_path: str, a_ranks: str, b_path: str) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    return Tokenizers(a_path, a_ranks, b_path)


def terminals(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the tokens of both sides, by their rising ends over the same bytes: the terminal token (a place on side a) of
    each one's component."""
    n = len(a_end)
    of_a, of_b = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)  # the other side's token with the last byte
    to = np.concatenate([np.where(b_end[of_a] > a_end, n + of_a, np.arange(n)), of_b])
    while True:
        further = to[to]
        if (further == to).all():
            return to[:n], to[n:]
        to = further


def pair_code(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b.astype(np.int64)


class Segments:
    """Alignments of distinct segments: counts of tokens and groups, each one's groups as text with a ; before each,
    its linked pairs one after another.

    ``whole`` is false where a tokenizer's bytes aren't those of the segment; such a segment has no tokens."""

    def __init__(self, tok: Tokenizers, segments: list[str]):
        ids_a, ids_b = tok.encode(segments)
        raw = [(" " + s).encode() for s in segments]
        self.whole = np.ones(len(segments), bool)
        while True:
            self.n_a, self.n_b = (np.fromiter(map(len, ids), np.int64, len(ids)) for ids in (ids_a, ids_b))
            a, b = (np.fromiter(chain.from_iterable(ids), np.int64) for ids in (ids_a, ids_b))
            a_end, b_end = np.cumsum(tok.a_size[a]), np.cumsum(tok.b_size[b])
            ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
            last = lambda end, n: np.r_[0, end][np.cumsum(n)]
            same = (last(a_end, self.n_a) == ends).all() and (last(b_end, self.n_b) == ends).all()
            text = b"".join(raw)
            if same and b"".join(map(tok.a_bytes.__getitem__, a.tolist())) == text == b"".join(map(tok.b_bytes.__getitem__, b.tolist())):
                break
            self.whole = np.array([b"".join(tok.a_bytes[i] for i in x) == r == b"".join(tok.b_bytes[i] for i in y) for x, y, r in zip(ids_a, ids_b, raw)], bool)
            ids_a, ids_b, raw = ([x if w else x[:0] for x, w in zip(each, self.whole)] for each in (ids_a, ids_b, raw))
        group_a, group_b = terminals(a_end, b_end)
        last_a, last_b = np.unique(group_a), np.flatnonzero(np.r_[group_b[1:] != group_b[:-1], [True] * (len(b) > 0)].astype(bool))
        self.pairs = pair_code(a[last_a], b[last_b])  # a group's last tokens are its one link
        self.start = np.searchsorted(a_end[last_a], np.r_[0, ends], side="right")  # a group of a segment ends within it
        # all ids in the order of the groups' text, each with the sign before it: ; of a group, | of its second side, else ,
        first_a, first_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        first_a[np.r_[0, last_a + 1][: len(last_a)]] = first_b[np.r_[0, last_b + 1][: len(last_b)]] = True
        group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
        place_a, place_b = np.arange(len(a)) + np.r_[0, last_b + 1][group_a], np.arange(len(b)) + (last_a + 1)[group_b]
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a], codes[place_b] = 2 * a + first_a, 2 * (b + len(tok.a_bytes)) + first_b
        signed, to = list(map(tok.signed.__getitem__, codes.tolist())), np.r_[0, np.cumsum(self.n_a + self.n_b)].tolist()
        self.groups = ["".join(signed[x:y]) for x, y in zip(to, to[1:])]
        self.n_groups = np.diff(self.start)

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        """The pairs of segments, in order."""
        n = self.n_groups[at]
        return self.pairs[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def parts_of(text: str, size: int) -> Iterator[str]:
    """A text cut between segments into parts of about size code points."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.end()
    yield text[at:]


class _Document:
    def __init__(self, doc):
        self.doc, self.digest, self.sums, self.pairs, self.times, self.whole = doc, hashlib.sha256(), [0, 0, 0], np.zeros(0, np.int64), np.zeros(0, np.int64), True

    def add(self, found: Segments, at: np.ndarray) -> None:
        self.whole = self.whole and bool(found.whole[at].all())
        if not self.whole:
            return
        text = "".join([found.groups[k] for k in at.tolist()]).encode()
        self.digest.update(text if self.sums[0] else text[1:])
        self.sums = [x + int(y[at].sum()) for x, y in zip(self.sums, (found.n_a, found.n_b, found.n_groups))]
        pairs, times = np.unique(found.pairs_of(at), return_counts=True)
        if len(self.pairs):
            pairs, to = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
            times = np.bincount(to, weights=np.concatenate([self.times, times])).astype(np.int64)
        self.pairs, self.times = pairs, times

    def row(self) -> tuple:
        if not self.whole or not self.sums[0]:
            return self.doc, 0, 0, 0, 0, "", [], []
        return self.doc, *self.sums, int(self.times.sum()), self.digest.hexdigest(), self.pairs, self.times


def _align(*paths: str):
    def run(batches: Iterator[pa.RecordBatch]):
        tok = tokenizers(*paths)
        names, kinds = [x.split()[0] for x in _TEXTS.split(", ")], [pa.int64()] * 5 + [pa.string()] + [pa.list_(pa.int64())] * 2

        def work(held: list[tuple[_Document, str]]) -> None:
            cut = [_CUT.split(part) for _, part in held]
            number = {s: k for k, s in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            found = Segments(tok, list(number))
            for (doc, _), segments in zip(held, cut):
                doc.add(found, np.fromiter(map(number.__getitem__, segments), np.int64, len(segments)))

        for b in batches:
            docs, held, size = [], [], 0
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                docs.append(_Document(doc))
                for part in parts_of(text, PART_CHARS) if text else ():
                    held.append((docs[-1], part))
                    size += len(part)
                    if size >= PART_CHARS:
                        work(held)
                        held, size = [], 0
            if held:
                work(held)
            rows = [d.row() for d in docs]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return run


def aligned_texts(docs: DataFrame, files: tuple[str, str, str] = (BYTE_BPE, BYTE_RANKS, PIECES)) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): each text's alignment; its distinct linked pairs, coded as
    a * 2**32 + b, and how often it holds each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_align(*map(public_tokenizers.path, files)), _TEXTS)


def pair_counts(texts: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each pair, and whether no pair of its second id has more."""
    each = texts.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    top = F.max("n").over(W.partitionBy(F.expr("pair & 4294967295")))  # at most a row a first id
    return each.select("pair", "n", (F.col("n") == top).alias("best"))


def _look_up(table: tuple[np.ndarray, np.ndarray, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]):
        pair, n, best = table
        for b in batches:
            out, links = [], [b.column(k) for k in (6, 7)]
            for k in range(b.num_rows):
                codes, times = (np.asarray(c[k].values) for c in links)
                at = np.searchsorted(pair, codes)
                out.append((int(times[best[at]].sum()), int((n[at] * times).sum())) if len(codes) else (0, 0))
            own = [pa.array([o[j] for o in out], pa.int64()) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *own, b.column(5)], names=[x.split()[0] for x in _DONE.split(", ")])

    return run


def _joined(texts: DataFrame, table: DataFrame) -> DataFrame:
    keyed = texts.withColumn("row", F.monotonically_increasing_id())  # of a written table
    salted = keyed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"), F.pmod("row", F.lit(SALTS)).alias("salt"))
    spread = table.select("pair", "n", "best", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    sums = salted.join(spread.hint("merge"), ["pair", "salt"]).groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return keyed.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def align_documents(docs: DataFrame, files: tuple[str, str, str] = (BYTE_BPE, BYTE_RANKS, PIECES), broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of docs.

    Null and empty texts, and texts that a tokenizer doesn't give back byte for byte, have zeros and an empty
    groups_sha256. Repeated rows and null ids have a row each, and their links count each time; empty tables give no rows;
    other columns don't matter."""
    texts = staged(aligned_texts(docs, files), "aligned")
    table = staged(pair_counts(texts), "pairs")
    if table.count() > broadcast_pairs:
        return _joined(texts, table)
    rows = table.select("pair", "n", "best").toArrow().sort_by("pair")
    return texts.mapInArrow(_look_up((rows["pair"].to_numpy(), rows["n"].to_numpy(), rows["best"].to_numpy())), _DONE)
