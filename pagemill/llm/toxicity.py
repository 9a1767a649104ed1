"""Toxicity by class-conditional Kneser-Ney models over bytes.

A class's model gives each byte of a text (in lower case) a probability after the five bytes before it: the interpolated
Kneser-Ney estimate from the class's own counts of 6-byte expressions, which backs off to the class's continuation counts
after four and three bytes, and from there to a continuation model after one byte that both classes share. A rare
expression is thus judged by the shared counts and says little for either class. A text's evidence is the largest
difference of the two classes' log-likelihoods a byte over a passage of PASSAGE bytes, so one insult in a long text shows; a
logistic fit makes it a probability.

Counts cover every labelled row that may be learned from. Expressions are exact; their table is written in shards whose
number grows with the text. A shard holds all expressions with the same third to fifth byte, so that all counts of one
history and of its shorter forms are in it. A table of up to BROADCAST_EXPRESSIONS is sent to all tasks; a larger one is
never held whole: texts are dealt into chunks of a bounded size, a chunk's distinct expressions meet the shards,
and their ratios come back to the chunk. Both ways give the same scores.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill.llm.common import frugal, id_remainder, parts, staged

ORDER, PASSAGE = 6, 10
CHUNK_CHARS, LEAST_CHUNKS = 16_000_000, 64
SHARD_CHARS, LEAST_SHARDS = 64_000_000, 48  # text for which the table gets another shard
HELD_ROWS, BUFFER = 2_000_000, 1_000_000  # a task's own counts before it sends them; expressions before they are summed
SCORED = 250_000  # expressions that a task scores at a time, but for a longer text
DISCOUNT = 0.75
CALIBRATION_FOLD = 4  # of 1..4: held back from the counts while the logistic fit is made
BROADCAST_LABELS = 2_000_000  # rows of two numbers; beyond, documents and labels are joined by a shuffle
BROADCAST_EXPRESSIONS = 4_000_000
LOW, SPAN, STEPS = -5, 20, 400  # histogram of the evidence
MASK = {5: (1 << 40) - 1, 4: (1 << 32) - 1}  # of the last bytes of an expression


def expressions(text: str) -> np.ndarray:
    """Codes of the 6-byte expressions of a text, in order: each byte after the five before it."""
    raw = (" " + text.lower() + " ").encode("utf-8", "replace")
    b = np.frombuffer(raw.ljust(ORDER, b" "), np.uint8).astype(np.int64)
    two = (b[:-1] << 8) | b[1:]
    return (two[:-4] << 32) | (two[2:-2] << 16) | two[4:]


def evidence(ratio: np.ndarray) -> float:
    """The largest mean log-likelihood difference over PASSAGE bytes in a row, or over a shorter text's own."""
    s = np.r_[0.0, np.cumsum(ratio, dtype=np.float64)]
    w = min(PASSAGE, len(ratio))
    return float((s[w:] - s[:-w]).max() / w)


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Numbers (int64 or float32) as compressed planes of bytes; rising ones by their steps."""
    x = np.ascontiguousarray(np.diff(x, prepend=0) if rising else x)
    return zlib.compress(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def unpack(z: bytes, rising: bool = False, kind=np.int64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    x = np.ascontiguousarray(np.frombuffer(zlib.decompress(z), np.uint8).reshape(size, -1).T).view(kind).ravel()
    return np.cumsum(x) if rising else x


def by_shard(g: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, places in g) of each shard that has expressions; the order of g is kept."""
    middle = (g >> 8) & 0xFFFFFF
    of = ((middle.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)) % np.uint64(shards)
    order = np.argsort(of, kind="stable")
    edges = np.searchsorted(of[order], np.arange(shards + 1, dtype=np.uint64))
    return [(k, order[x:y]) for k, (x, y) in enumerate(zip(edges, edges[1:])) if y > x]


def summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, rising, and their sums."""
    order = np.argsort(codes)
    codes = codes[order]
    at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[at], np.add.reduceat(n[order], at) if len(at) else n


_COUNTS = "shard int, codes binary, n binary"
_TABLE = "shard int, g binary, counts binary, size long, pairs array<struct<pair:int,part:int,all:int>>"


def _count(shards: int):
    """A task's partial counts of (expression, whether it is of the calibration rows, class)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]):
        codes, n, held, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def send():
            for k, at in by_shard(codes >> 2, shards):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack(codes[at], True)], pa.binary()), pa.array([pack(n[at])], pa.binary())], names=["shard", "codes", "n"])

        def add():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return summed(np.concatenate([codes, u]), np.concatenate([n, c]))

        for b in batches:
            for doc, text, toxic in zip(*(c.to_pylist() for c in b.columns)):
                g = expressions(text)
                held.append((g << 2) | (2 * (id_remainder(doc) == CALIBRATION_FOLD) + (toxic == 1)))
                size += len(g)
                if size >= BUFFER:
                    codes, n = add()
                    held, size = [], 0
                    if len(codes) >= HELD_ROWS:
                        yield from send()
                        codes, n = codes[:0], n[:0]
        if held:
            codes, n = add()
        yield from send()

    return run


def _endings(g: np.ndarray) -> np.ndarray:
    """How many distinct 4-byte expressions end in each pair of bytes."""
    return np.bincount(np.unique(g & MASK[4]) & 0xFFFF, minlength=1 << 16)


@frugal
def _merge(table: pa.Table) -> pa.Table:
    """One shard of the table: expressions; their counts (class, and class among the calibration rows); endings."""
    codes, n = summed(np.concatenate([unpack(z, True) for z in table["codes"].to_pylist()]), np.concatenate([unpack(z) for z in table["n"].to_pylist()]))
    g, at = np.unique(codes >> 2, return_inverse=True)
    counts = np.zeros((4, len(g)), np.int64)
    np.add.at(counts, (codes & 3, at), n)
    part, every = _endings(g[counts[:2].sum(axis=0) > 0]), _endings(g)
    pairs = [{"pair": k, "part": int(part[k]), "all": int(every[k])} for k in np.flatnonzero(every).tolist()]
    kind = pa.list_(pa.struct([("pair", pa.int32()), ("part", pa.int32()), ("all", pa.int32())]))
    return pa.table({"shard": pa.array([table["shard"][0].as_py()], pa.int32()), "g": pa.array([pack(g, True)], pa.binary()), "counts": pa.array([pack(counts.ravel())], pa.binary()), "size": pa.array([len(g)], pa.int64()), "pairs": pa.array([pairs], kind)})


def _find(keys: np.ndarray, values: np.ndarray, ask: np.ndarray) -> np.ndarray:
    """The values of rising keys, 0 for those that aren't there."""
    if not len(keys):
        return np.zeros(len(ask))
    at = np.minimum(np.searchsorted(keys, ask), len(keys) - 1)
    return np.where(keys[at] == ask, values[at], 0).astype(np.float64)


class Level:
    """Interpolated estimates from counts n of distinct rising expressions: of the last byte after the others."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.n = keys, n
        after = keys >> 8
        at = np.flatnonzero(np.r_[True, after[1:] != after[:-1]]) if len(keys) else np.zeros(0, np.int64)
        self.history, self.total, self.kinds = after[at], np.add.reduceat(n, at) if len(at) else n, np.diff(np.r_[at, len(keys)])

    def given(self, ask: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of ask; lower: those of the next shorter history, which stand where this one was never seen."""
        c, total, kinds = _find(self.keys, self.n, ask), _find(self.history, self.total, ask >> 8), _find(self.history, self.kinds, ask >> 8)
        return np.where(total > 0, (np.maximum(c - DISCOUNT, 0) + DISCOUNT * kinds * lower) / np.maximum(total, 1), lower)


def shared_model(endings: np.ndarray) -> np.ndarray:
    """P(byte | byte before), by pair, of the continuation counts of both classes."""
    n = endings.reshape(256, 256).astype(np.float64)
    one = (n > 0).sum(axis=0)
    lowest = (np.maximum(one - DISCOUNT, 0) + DISCOUNT * (one > 0).sum() / 256) / one.sum() if one.any() else np.full(256, 1 / 256)
    total, kinds = n.sum(axis=1, keepdims=True), (n > 0).sum(axis=1, keepdims=True)
    return np.where(total > 0, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * lowest) / np.maximum(total, 1), lowest).ravel()


class Models:
    """Both classes' models of a shard, or of several shards whose expressions are in rising order."""

    def __init__(self, g: np.ndarray, counts: list[np.ndarray], shared: np.ndarray):
        self.shared, self.levels, self.known = shared, [], g
        for c in counts:
            own = g[c > 0]
            five, n5 = np.unique(own & MASK[5], return_counts=True)
            four, n4 = np.unique(five & MASK[4], return_counts=True)
            self.levels.append((Level(four, n4.astype(np.int32)), Level(five, n5.astype(np.int32)), Level(own, c[c > 0])))
        self.known_ratio = np.concatenate([self._worked_out(g[a : a + SCORED]) for a in range(0, len(g), SCORED)]) if len(g) else np.zeros(0, np.float32)

    def probabilities(self, ask: np.ndarray, toxic: bool) -> np.ndarray:
        """P(last byte | the five before it) of each expression."""
        four, five, six = self.levels[toxic]
        p = four.given(ask & MASK[4], self.shared[ask & 0xFFFF])
        return six.given(ask, five.given(ask & MASK[5], p))

    def _worked_out(self, ask: np.ndarray) -> np.ndarray:
        return (np.log(self.probabilities(ask, True)) - np.log(self.probabilities(ask, False))).astype(np.float32)

    def ratio(self, ask: np.ndarray) -> np.ndarray:
        """log P(toxic) - log P(ordinary) of each expression; those of the table are worked out once."""
        if not len(self.known):
            return self._worked_out(ask)
        at = np.minimum(np.searchsorted(self.known, ask), len(self.known) - 1)
        out, new = self.known_ratio[at], self.known[at] != ask
        out[new] = self._worked_out(ask[new])
        return out


def _models(shards: list[tuple[bytes, bytes]], model: str, shared: np.ndarray) -> Models:
    """The models of packed shards (g, counts); ``part`` leaves the calibration rows out."""
    g, c = [], [[], []]
    for z, n in shards:
        g.append(unpack(z, True))
        n = unpack(n).reshape(4, -1)
        for k in range(2):
            c[k].append((n[k] if model == "part" else n[k] + n[k + 2]).astype(np.int32))
    g = np.concatenate(g) if g else np.zeros(0, np.int64)
    order = np.argsort(g)
    return Models(g[order], [np.concatenate(x)[order] if x else np.zeros(0, np.int32) for x in c], shared)


def _distinct(texts: list[str]) -> np.ndarray:
    u, held, size = np.zeros(0, np.int64), [], 0
    for t in texts:
        held.append(expressions(t))
        size += len(held[-1])
        if size >= BUFFER:
            u, held, size = np.unique(np.concatenate([u, *held])), [], 0
    return np.unique(np.concatenate([u, *held]))


def with_evidence_by_broadcast(docs: DataFrame, table: DataFrame, model: str, shared: np.ndarray, column: str, made) -> DataFrame:
    """docs with made(evidence of text) as column. The table has at most BROADCAST_EXPRESSIONS; a task unpacks it once and
    lets it go at its end."""
    sent = docs.sparkSession.sparkContext.broadcast([(r["g"], r["counts"]) for r in table.select("g", "counts").collect()])

    @frugal
    def scores(batches):
        models = _models(sent.value, model, shared)
        for batch in batches:
            out, texts, a = [], batch.tolist(), 0
            while a < len(texts):
                z, size = a, 0
                while z < len(texts) and (z == a or size < SCORED):
                    size += len(texts[z])
                    z += 1
                own = [expressions(t) for t in texts[a:z]]
                u = np.unique(np.concatenate(own))
                ratio = models.ratio(u)
                out += [evidence(ratio[np.searchsorted(u, g)]) for g in own]
                a = z
            yield pd.Series(made(np.array(out, np.float64)))

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from scores(batches)

    return docs.select(*(c for c in docs.columns if c != column), score(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias(column))


def with_evidence_by_shuffle(docs: DataFrame, table: DataFrame, model: str, shared: np.ndarray, column: str, made, n_chunks: int, n_shards: int) -> DataFrame:
    """docs with made(evidence of text) as column; texts meet the table in chunks."""
    own = [c for c in docs.columns if c != column]
    plain = isinstance(docs.schema["text"].dataType, T.StringType) and column != "text"  # then the text isn't sent twice
    text_col, text = "text" if plain else "_pm_text", F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(text, F.col("doc_id").cast("string"))
    dealt = docs.select(*own, *([] if plain else [text.alias(text_col)]), F.pmod(key, F.lit(n_chunks)).cast("int").alias("_pm_chunk")).repartition(parts(docs.sparkSession), "_pm_chunk")

    @frugal
    def distinct(chunk: pa.Table) -> pa.Table:
        u = _distinct([t or "" for t in chunk[text_col].to_pylist()])
        cut = by_shard(u, n_shards)
        return pa.table({"chunk": pa.array([chunk["_pm_chunk"][0].as_py()] * len(cut), pa.int32()), "shard": pa.array([k for k, _ in cut], pa.int32()), "g": pa.array([pack(u[at], True) for _, at in cut], pa.binary())})

    @frugal
    def look(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return none
        models = _models(list(zip(shard["g"].to_pylist(), shard["counts"].to_pylist())), model, shared)
        back = [pack(models.ratio(unpack(z, True))) for z in asked["g"].to_pylist()]
        return pa.table({"chunk": asked["chunk"].cast(pa.int32()), "shard": asked["shard"].cast(pa.int32()), "r": pa.array(back, pa.binary())})

    @frugal
    def score(chunk: pa.Table, back: pa.Table) -> pa.Table:
        texts = [t or "" for t in chunk[text_col].to_pylist()]
        u, came = _distinct(texts), dict(zip(back["shard"].to_pylist(), back["r"].to_pylist()))
        ratio = np.zeros(len(u), np.float32)
        for k, at in by_shard(u, n_shards):
            ratio[at] = unpack(came[k], kind=np.float32)
        e = np.array([evidence(ratio[np.searchsorted(u, expressions(t))]) for t in texts], np.float64)
        return chunk.select(own).append_column(column, pa.array(made(e), pa.float64()))

    asked = dealt.groupBy("_pm_chunk").applyInArrow(distinct, "chunk int, shard int, g binary")
    none = pa.table({"chunk": pa.array([], pa.int32()), "shard": pa.array([], pa.int32()), "r": pa.array([], pa.binary())})
    back = asked.groupBy("shard").cogroup(table.select("shard", "g", "counts").groupBy("shard")).applyInArrow(look, "chunk int, shard int, r binary")
    schema = T.StructType([*docs.select(*own).schema.fields, T.StructField(column, T.DoubleType())])
    return dealt.groupBy("_pm_chunk").cogroup(back.groupBy("chunk")).applyInArrow(score, schema)


def fit_logistic(bins: np.ndarray) -> tuple[float, float]:
    """(slope, middle) from a histogram (bin, class) of the evidence, by Newton steps with a small ridge."""
    x = LOW + (np.arange(STEPS) + 0.5) * SPAN / STEPS
    n, y = bins.sum(axis=1), bins[:, 1]
    if not y.sum() or y.sum() == n.sum():
        return 1.0, 3.0
    w = np.array([1.0, -3.0])
    design = np.c_[x, np.ones(STEPS)]
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (y - n * p) - 0.01 * np.array([w[0], 0])
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.01, 1e-9])
        step = np.linalg.solve(hess, grad)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return (float(w[0]), float(-w[1] / w[0])) if w[0] > 0.05 else (1.0, 3.0)


def learn_table(learn: DataFrame, n_shards: int) -> tuple[DataFrame, dict[str, np.ndarray], int]:
    """The written table of expressions in learn(doc_id, text, toxic), the shared models by model, and its size."""
    table = staged(learn.mapInArrow(_count(n_shards), _COUNTS).groupBy("shard").applyInArrow(_merge, _TABLE), "expressions")
    endings = {m: np.zeros(1 << 16) for m in ("part", "all")}
    for r in table.select(F.inline("pairs")).groupBy("pair").agg(F.sum("part").alias("part"), F.sum("all").alias("all")).collect():  # 65,536 rows at most
        for m, n in endings.items():
            n[r["pair"]] = r[m]
    return table, {m: shared_model(n) for m, n in endings.items()}, table.agg(F.sum("size")).first()[0] or 0


def score_toxicity(docs: DataFrame, labels: DataFrame, score_col: str = "score") -> DataFrame:
    """docs with a score from 0 to 1; higher means label 1 is likelier. The text alone is scored, whole and of any
    length; null reads as empty. Every row gets a score, repeated rows the same; an empty table gives no rows. A column of
    docs named score_col is replaced, and all others are passed on, whatever their names.

    Learns from rows of labels with toxic 0 or 1 whose id has remainder 1 to 4, and whose text is in docs. Counts come
    from all of them; the logistic fit from scores that a model without the calibration rows gives to those rows.
    Without both classes, scores come from fixed values."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n_shards, n_chunks = max(LEAST_SHARDS, -(-chars // SHARD_CHARS)), max(LEAST_CHUNKS, -(-chars // CHUNK_CHARS))
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_pm_id")).agg(F.max("toxic").cast("int").alias("_pm_toxic"))
    learn = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(remainder != 0)
    small = labels.count() <= BROADCAST_LABELS
    learn = learn.join(F.broadcast(known) if small else known, learn["doc_id"] == known["_pm_id"]).select("doc_id", "text", F.col("_pm_toxic").alias("toxic"))
    learn = learn if small else staged(learn, "labelled")  # the shuffled join is done once for both passes
    table, shared, size = learn_table(learn, n_shards)

    def with_evidence(rows, model, column, made=lambda e: e, chunks=n_chunks):
        if size <= BROADCAST_EXPRESSIONS:
            return with_evidence_by_broadcast(rows, table, model, shared[model], column, made)
        return with_evidence_by_shuffle(rows, table, model, shared[model], column, made, chunks, n_shards)

    held = with_evidence(learn.where(remainder == CALIBRATION_FOLD), "part", "e", chunks=n_chunks // 4)
    held = held.select(F.greatest(F.lit(0), F.least(F.lit(STEPS - 1), ((F.col("e") - LOW) * STEPS / SPAN).cast("int"))).alias("bin"), "toxic")
    seen = np.zeros((STEPS, 2))
    for r in held.groupBy("bin", "toxic").agg(F.count("*").alias("n")).collect():
        seen[r["bin"], r["toxic"]] = r["n"]
    slope, middle = fit_logistic(seen)
    logistic = lambda e: 1 / (1 + np.exp(-np.clip(slope * (e - middle), -40, 40)))
    out = with_evidence(docs, "all", score_col, logistic)
    return out.select(*docs.columns, *([] if score_col in docs.columns else [score_col]))
