"""Ranked lexical search by the Best Position Algorithm.

Each document is read once into postings: its length and the counts of those of its terms that items ask for. Postings are
dealt over tasks by document, and a task takes them in chunks of a bounded size. A chunk has one impact list a term,
falling by impact, and serves an item so: the item's lists are read side by side; every document met is looked up at once in
all of the item's lists (direct access), which also marks its positions there as seen; a list's best position is the end
of its unbroken run of seen positions, often far beyond the last one read. No unseen document can score more than the sum
of the impacts that follow the best positions, so reading stops when that sum is strictly below the k-th score (documents
that equal it may still win by their id).

A sixteenth of the postings is searched first; its k-th rows are floors for all the rest, so that a task sends few
rows and stops early, whatever the number of tasks. Both parts count: the result is exact.

Items are taken in blocks whose terms a task can hold; each block meets all documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import staged

# Fixed values of the ranking: a term, and the scale of weights and saturations.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WEIGHT_UNIT, FULL, SATURATION, LENGTH_SHARE = 1000, 1_000_000_000, 20, 50

BLOCK_TERMS = 1_000_000  # terms of all items of a block, with repeats
CHUNK_POSTINGS = 1_000_000  # postings that a task holds at a time
SLICE = 4_000_000  # bytes of a long text that are split into words at a time
FIRST_PARTS = 16  # one part of so many is searched first
DEPTH = 64  # positions of each list read in the first round; doubled in each one after
NO_ID = -(2**63)  # stands for a null doc_id

_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_POSTINGS = "doc_id long, n long, terms array<int>, tf array<long>"
_FOUND = "item int, doc_id long, score long"


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of each item; rows of one item_id are one item, null texts have no terms."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    each = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(F.regexp_extract_all(text, F.lit(TERM), 0)).alias("term"))
    return each.groupBy("item_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))


def count_terms(raw: bytes) -> tuple[int, Counter]:
    """How many terms a text (UTF-8) has, and of each how often."""
    plain, n, counts, at = raw.translate(_BYTES), 0, Counter(), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE) if len(plain) - at > SLICE else -1
        words = plain[at : end if end >= 0 else len(plain)].split()
        n += len(words)
        counts.update(words)
        at = end if end >= 0 else len(plain)
    return n, counts


def _count(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]):
        number = {t.encode(): k for k, t in enumerate(vocabulary)}
        for b in batches:
            ids, lengths, terms, tf = [], [], [], []
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1)):
                n, counts = count_terms(raw.as_py())
                if n:
                    known = sorted((number[t], counts[t]) for t in counts.keys() & number.keys())
                    ids.append(doc)
                    lengths.append(n)
                    terms.append([k for k, _ in known])
                    tf.append([c for _, c in known])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return run


def postings(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, n, terms, tf) of each document with a term: its length, the vocabulary's terms in it and their counts."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(_count(vocabulary), _POSTINGS)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.floor(WEIGHT_UNIT * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)


def length_norms(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if LENGTH_SHARE * int(n.max(initial=0)) * n_docs < 2**63:
        return 100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // n_terms
    return np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(x) * n_docs // n_terms for x in n], np.int64)


class ImpactLists:
    """A chunk's impact lists one after another, each falling by impact, and where each document stands in them."""

    def __init__(self, size: np.ndarray, terms: np.ndarray, tf: np.ndarray, norm: np.ndarray, weight: np.ndarray):
        doc = np.repeat(np.arange(len(size)), size)
        impact = weight[terms] * (FULL * tf // (1000 * tf + SATURATION * norm[doc]))
        order = np.lexsort((-impact, terms))
        self.term, self.impact, self.doc = terms[order], impact[order], doc[order]
        self.start = np.searchsorted(self.term, np.arange(len(weight) + 1))
        self.end = self.start[1:].copy()  # what has no impact needn't be read
        nothing = np.bincount(terms[impact == 0], minlength=len(weight)) if len(terms) else 0
        self.end -= nothing
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))
        self.first = np.r_[0, np.cumsum(size)]
        self.seen, self.met, self.asked = np.zeros(len(order), bool), np.zeros(len(size), bool), np.zeros(len(weight), bool)

    def look_up(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Direct access: scores of docs over the asked terms, and their positions in those terms' lists."""
        n = self.first[docs + 1] - self.first[docs]
        at = np.repeat(self.first[docs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        position, of = self.position[at], np.repeat(np.arange(len(docs)), n)
        own = self.asked[self.term[position]]
        position, of = position[own], of[own]
        # sums stay far below 2**53, so doubles are exact
        return np.bincount(of, weights=self.impact[position], minlength=len(docs)).astype(np.int64), position

    def best(self, terms: np.ndarray, k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents (at least all that can be among the k best with a score of floor or more), their scores, and how
        many positions were read."""
        terms = terms[self.end[terms] > self.start[terms]]
        begin, end = self.start[terms].tolist(), self.end[terms].tolist()
        best, total, depth, read = list(begin), sum(end) - sum(begin), DEPTH, 0
        self.asked[terms] = True
        docs, scores, marked = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        kth, found = floor, 0
        while True:
            limit = sum(int(self.impact[b]) for b, e in zip(best, end) if b < e)
            if limit == 0 or limit < kth:
                break
            if 2 * (depth * len(terms) + read) > total:
                depth = total  # most of it is to be read anyway
            spans = [(b, min(b + depth, e)) for b, e in zip(best, end) if b < e]
            read += sum(e - b for b, e in spans)
            new = np.concatenate([self.doc[b:e] for b, e in spans])
            new = np.unique(new[~self.met[new]])
            self.met[new] = True
            score, position = self.look_up(new)
            self.seen[position] = True
            marked.append(position)
            docs.append(new)
            scores.append(score)
            found += len(new)
            for j, (b, e) in enumerate(zip(best, end)):
                while b < e:  # over the seen positions, a window at a time
                    window = self.seen[b : min(b + 4 * DEPTH, e)]
                    step = int(window.argmin())
                    if not window[step]:
                        b += step
                        break
                    b += len(window)
                best[j] = b
            if found >= k:
                every = np.concatenate(scores)
                docs, scores = [np.concatenate(docs)], [every]
                kth = max(floor, int(np.partition(every, len(every) - k)[len(every) - k]))
            depth *= 2
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        self.asked[terms] = False
        self.met[docs] = False
        for position in marked:
            self.seen[position] = False
        good = scores >= max(kth, 1)
        return docs[good], scores[good], read


def _search(asked: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int, floors: dict[int, tuple[int, int]]):
    """A task's k best documents of each item, of those that come before the item's floor (score, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]):
        top: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def chunk(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held).combine_chunks()
            ids, n = t["doc_id"].to_numpy(), t["n"].to_numpy()
            terms, tf = pa.concat_arrays(t["terms"].chunks), pa.concat_arrays(t["tf"].chunks)
            lists = ImpactLists(np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tf.flatten().to_numpy(), length_norms(n, n_docs, n_terms), weight)
            for item, own in enumerate(asked):
                floor, floor_doc = floors.get(item, (0, 0))
                before = top.get(item)
                least = max(floor, int(before[1][-1])) if before is not None and len(before[1]) == k else floor
                docs, scores, _ = lists.best(own, k, least)
                docs = ids[docs]
                if floor:
                    good = (scores > floor) | ((scores == floor) & (docs < floor_doc))
                    docs, scores = docs[good], scores[good]
                if len(docs):
                    if before is not None:
                        docs, scores = np.r_[before[0], docs], np.r_[before[1], scores]
                    order = np.lexsort((docs, -scores))[:k]
                    top[item] = docs[order], scores[order]

        held, size = [], 0
        for b in batches:
            for x in (b.slice(a, 4096) for a in range(0, b.num_rows, 4096)):
                more = len(x.column(2).flatten())
                if held and size + more > CHUNK_POSTINGS:
                    chunk(held)
                    held, size = [], 0
                held.append(x)
                size += more
        if held:
            chunk(held)
        for item, (docs, scores) in sorted(top.items()):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), item), pa.int32()), pa.array(docs, pa.int64()), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 50, block_terms: int = BLOCK_TERMS, first_parts: int = FIRST_PARTS) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k documents of highest score above 0, equal scores by doc_id.

    Null and empty texts, of documents and items, have no terms. Each row of docs is a document, repeated rows too; of
    equal ones either may take the earlier rank. A null doc_id comes before all others. Rows of one item_id are one item.
    Empty tables give no rows; other columns don't matter."""
    spark = docs.sparkSession
    asked = staged(item_terms(items), "items")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms)
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).sort("item_id").collect()  # bounded by block_terms
        vocabulary = sorted({t for r in own for t in r["terms"]})
        number = {t: j for j, t in enumerate(vocabulary)}
        lists = [np.array([number[t] for t in r["terms"]], np.int64) for r in own]
        table = staged(postings(docs, vocabulary), "postings")
        n_docs, n_terms = table.agg(F.count("*"), F.sum("n")).first()
        if not n_docs or not own:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in table.select(F.explode("terms").alias("term")).groupBy("term").count().toLocalIterator():  # at most a row a term of the block
            df[r["term"]] = r["count"]
        weight, parts = weights(df, n_docs), F.pmod(F.xxhash64("doc_id"), F.lit(first_parts))
        head = staged(_top(table.where(parts == 0).mapInArrow(_search(lists, weight, n_docs, n_terms, k, {}), _FOUND), k), "ranked").drop("rank")
        kth = _top(head, k).where(F.col("rank") == k).collect()  # a row an item
        floors = {r["item"]: (r["score"], r["doc_id"]) for r in kth}
        rest = table.where(parts != 0).mapInArrow(_search(lists, weight, n_docs, n_terms, k, floors), _FOUND)
        names = spark.createDataFrame([(j, r["item_id"]) for j, r in enumerate(own)], "item int, item_id long")
        ranked = _top(head.unionByName(rest), k).join(names, "item")
        out = out.unionByName(ranked.select("item_id", "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"))
    return out
