"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are runs of five words. The weight of one is its count in the text times its idf, which comes from
the document frequencies of all shingles in all distinct texts: 1 for a shingle of one text, and less by up to
DAMPED with the logarithm of the frequency, in 255 steps. (An idf that falls to 0 would tear apart the near copies of
a group that holds a large share of the corpus.) Texts are dealt into chunks of a bounded size; a chunk sends its
distinct shingles to shards, whose number grows with the text, and their frequencies come back.

A shingle of one text can't be shared, so a text with less than THRESHOLD of its weight in others is in no pair and
goes no further. The others get 36 weighted samples, which make 12 bands. The most central member of a band bucket
(the one that meets most others over all bands) is its head and is compared with the other members by whole vectors;
verified pairs (weighted Jaccard of 0.8 or more) join their classes. Members that are still apart from their head
may be similar to other members of it. What a head's members have in common, within it or beyond it, is found by an
aggregate; a member with too little of it is in no such pair; the others are compared as bitmaps, in blocks of rows,
and a block sends one link a row and class. So no bucket is expanded into its pairs, none is capped, and no link that
a band has brought together is lost.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import frugal, parts, staged

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 3
DAMPED = 0.25
CHUNK_CHARS, LEAST_CHUNKS = 8_000_000, 64
SHARD_CHARS, LEAST_SHARDS = 8_000_000, 64  # text for which the frequencies get another shard
BATCH_CHARS, BATCH_TEXTS = 1_000_000, 50_000
HASH_BITS = 56  # of a shingle; the upper byte holds its level
X_ROWS, Y_ROWS = 4096, 32768  # rows of a block within one head
CELLS = 2_000_000  # of a bitmap matrix that is held at a time

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_TABLE_BITS = 16
_HASH = np.uint64((1 << HASH_BITS) - 1)
IDF = np.r_[1.0, 1 - DAMPED * (np.arange(255) + 0.5) / 255]  # by level


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 2**64)
    out = []
    for b in (_BASE, inverse):
        p = np.full(1 << bits, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


@functools.cache
def _constants() -> tuple[np.ndarray, ...]:
    """Random variables of the sampling, by hash place: r and c of Gamma(2, 1), beta uniform; and multipliers."""
    rng = np.random.default_rng(20)
    n = 1 << _TABLE_BITS
    r, c, beta = rng.gamma(2, 1, n), rng.gamma(2, 1, n), rng.random(n)
    return r, np.log(c), beta, rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Floats as unsigned integers of the same order, in the upper half of 64 bits."""
    b = x.astype(np.float32).view(np.uint32)
    return np.where(b >> 31, ~b, b | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash of HASH_BITS, count) of the distinct shingles of each text, in order of document and hash.

    Words are runs of letters and digits in lower case. A text of fewer than five words, or none, has one
    shingle of all its words."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    b = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    power, inverse = _powers(max(20, int(len(b)).bit_length()))
    inside = _IN_WORD[b]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    total = np.r_[np.uint64(0), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)])]
    word = _mix((total[end] - total[start]) * inverse[start])
    doc = np.searchsorted(np.cumsum([len(x) + 1 for x in raw]), start, side="right")
    n = len(word) - WORDS + 1
    parts_h, parts_d = [], []
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(WORDS):
            h = h * np.uint64(_BASE) + word[k : k + n]
        whole = doc[:n] == doc[WORDS - 1 :]
        parts_h.append(_mix(h[whole]))
        parts_d.append(doc[:n][whole])
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    for k in np.flatnonzero(count < WORDS).tolist():
        h = np.uint64(count[k])
        for w in word[first[k] : first[k] + count[k]]:
            h = _mix(np.array([h ^ w]) * np.uint64(_BASE))[0]
        parts_h.append(np.array([h], np.uint64))
        parts_d.append(np.array([k]))
    h, d = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((parts_h, np.uint64), (parts_d, np.int64)))
    h = h >> np.uint64(64 - HASH_BITS)
    order = np.argsort(h)
    order = order[np.argsort(d[order].astype(np.uint16), kind="stable")]  # BATCH_TEXTS fit 16 bits
    h, d = h[order], d[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
    return d[new], h[new], np.diff(np.r_[new, len(h)])


def levels_of(df: np.ndarray, n_texts: int) -> np.ndarray:
    """The level of document frequencies, 0 for 1: its logarithm in 255 steps up to that of n_texts."""
    share = np.log(np.maximum(df, 1)) / np.log(max(n_texts, 2))
    return np.where(df > 1, 1 + np.minimum(254, (255 * share).astype(np.int64)), 0).astype(np.uint8)


def band_hashes(d: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int) -> np.ndarray:
    """(documents, BANDS) hashes of consistent weighted samples; each document has a shingle."""
    r, log_c, beta, multipliers = _constants()
    starts = np.searchsorted(d, np.arange(n_docs))
    low = h & np.uint64(0xFFFFFFFF)
    log_w = np.log(w)
    out = np.zeros((n_docs, BANDS), np.uint64)
    for j, m in enumerate(multipliers):
        at = ((h * m) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        t = np.floor(log_w / r[at] + beta[at])
        turn = (t.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
        key = _ordered(log_c[at] - r[at] * (t - beta[at]) - r[at]) | (low ^ turn)
        best = np.minimum.reduceat(key, starts)
        out[:, j // ROWS] = _mix(out[:, j // ROWS] * np.uint64(_BASE) + best + np.uint64(j + 1))
    return out


def pack(u: np.ndarray) -> bytes:
    """Rising numbers as their first one and steps of as few bytes as the largest step takes."""
    steps = np.diff(u, prepend=u[:1])
    width = max(1, -(-int(steps.max()).bit_length() // 8))
    return bytes([width]) + u[:1].tobytes() + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(z: bytes) -> np.ndarray:
    steps = np.zeros(((len(z) - 9) // z[0], 8), np.uint8)
    steps[:, : z[0]] = np.frombuffer(z, np.uint8, offset=9).reshape(-1, z[0])
    return np.cumsum(steps.view(np.uint64).ravel(), dtype=np.uint64) + np.frombuffer(z, np.uint64, 1, 1)


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about BATCH_CHARS characters."""
    a = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if (size > BATCH_CHARS or k - a == BATCH_TEXTS) and k > a:
            yield a, k
            a, size = k, len(t)
    if a < len(texts):
        yield a, len(texts)


def _own(chunk: pa.Table, other: pa.Table) -> tuple[list[bytes], list[str]]:
    """Keys and texts of a chunk, each text once and without those that are kept in another chunk's row."""
    away = other.filter(pc.is_valid(other["key"]))
    away = set(zip(away["key"].to_pylist(), away["doc_id"].to_pylist()))
    own = {k: t for k, doc, t in zip(chunk["key"].to_pylist(), chunk["doc_id"].to_pylist(), chunk["text"].to_pylist()) if (k, doc) not in away}
    return list(own), list(own.values())


def _ask(n_shards: int):
    """A chunk's distinct shingles, each with how many of the chunk's texts hold it, by shard: ranges of hashes."""
    edges = np.array([(k << HASH_BITS) // n_shards for k in range(n_shards + 1)], np.uint64)

    @frugal
    def ask(chunk: pa.Table, copies: pa.Table) -> pa.Table:
        _, texts = _own(chunk, copies)
        held = [shingles(texts[a:z])[1] for a, z in _slices(texts)]
        u, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        at = np.searchsorted(u, edges).tolist()
        rows = []
        for k, (x, y) in enumerate(zip(at, at[1:])):
            if y > x:
                more = np.flatnonzero(n[x:y] > 1)
                rows.append((k, pack(u[x:y]), np.r_[more, n[x:y][more]].astype("<u4").tobytes()))
        c = list(zip(*rows)) or [[]] * 3
        number = chunk["chunk"][0].as_py() if chunk.num_rows else 0
        return pa.table({"chunk": pa.array([number] * len(rows), pa.int32()), "shard": pa.array(c[0], pa.int32()), "g": pa.array(c[1], pa.binary()), "more": pa.array(c[2], pa.binary())})

    return ask


def _frequencies(n_texts: int):
    """The levels of one shard's shingles, for each chunk that has asked."""

    @frugal
    def answer(asked: pa.Table) -> pa.Table:
        own = [unpack(z) for z in asked["g"].to_pylist()]
        n = []
        for h, z in zip(own, asked["more"].to_pylist()):
            one, more = np.ones(len(h), np.int64), np.frombuffer(z, "<u4")
            one[more[: len(more) // 2]] = more[len(more) // 2 :]
            n.append(one)
        h = np.concatenate(own)
        order = np.argsort(h)
        h = h[order]
        new = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        level = levels_of(np.add.reduceat(np.concatenate(n)[order], new), n_texts)
        back = np.empty(len(h), np.uint8)
        back[order] = np.repeat(level, np.diff(np.r_[new, len(h)]))
        cut = np.split(back, np.cumsum([len(x) for x in own])[:-1])
        return pa.table({"chunk": asked["chunk"].cast(pa.int32()), "shard": asked["shard"].cast(pa.int32()), "g": pa.array([zlib.compress(x.tobytes(), 1) for x in cut], pa.binary())})

    return answer


_NODES = "key binary, bands array<long>, w double, h binary"


@frugal
def _sign(chunk: pa.Table, back: pa.Table) -> pa.Table:
    """(key, bands, weight, tokens) of the texts that may be similar to others. Tokens are what others have too:
    level and hash of a shingle, once for each time that it occurs, rarest first."""
    keys, texts = _own(chunk, back)
    found = [shingles(texts[a:z]) for a, z in _slices(texts)]
    levels = back.filter(pc.is_valid(back["shard"])).sort_by("shard")["g"].to_pylist()
    level = np.frombuffer(b"".join(zlib.decompress(z) for z in levels), np.uint8)
    u = np.unique(np.concatenate([h for _, h, _ in found])) if found else np.zeros(0, np.uint64)
    out_key, out_bands, out_w, out_h = [], [], [], []
    for (a, z), (d, h, c) in zip(_slices(texts), found):
        lv = level[np.searchsorted(u, h)]
        w = c * IDF[lv]
        whole, shared = np.bincount(d, w, z - a), np.bincount(d, w * (lv > 0), z - a)
        may = np.flatnonzero(shared >= THRESHOLD * whole * (1 - 1e-9))
        if not len(may):
            continue
        number = np.full(z - a, -1)
        number[may] = np.arange(len(may))
        own = number[d] >= 0
        d, h, c, lv, w = number[d[own]], h[own], c[own], lv[own], w[own]
        out_bands.append(band_hashes(d, h, w, len(may)).view(np.int64))
        d, h, c, lv = (x[lv > 0] for x in (d, h, c, lv))
        turn = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
        d, h, lv = (np.repeat(x, c) for x in (d, h, lv))
        again = turn > 0
        h[again] = _mix(h[again] + turn[again].astype(np.uint64) * np.uint64(_BASE)) & _HASH
        token = (lv.astype(np.uint64) << np.uint64(HASH_BITS)) | h
        token = token[np.lexsort((token, d))]
        edges = np.searchsorted(d, np.arange(len(may) + 1)).tolist()
        out_h += [token[x:y].tobytes() for x, y in zip(edges, edges[1:])]
        out_key += [keys[a + k] for k in may.tolist()]
        out_w += whole[may].tolist()
    bands = np.concatenate(out_bands).ravel() if out_bands else np.zeros(0, np.int64)
    cells = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bands) + 1, BANDS), pa.int32()), pa.array(bands))
    return pa.table({"key": pa.array(out_key, pa.binary()), "bands": cells, "w": pa.array(out_w, pa.float64()), "h": pa.array(out_h, pa.binary())})


def compare(ha: bytes, wa: float, hb: bytes, wb: float) -> tuple[float, float, bytes, bytes]:
    """Weighted Jaccard of a head a and a member b; and of b: the weight of what a has too, the bitmap of a's tokens
    that it has, and its tokens beyond a."""
    a, b = np.frombuffer(ha, np.uint64), np.frombuffer(hb, np.uint64)
    at = np.minimum(np.searchsorted(a, b), max(len(a) - 1, 0))
    same = a[at] == b if len(a) else np.zeros(len(b), bool)
    both = float(IDF[(b[same] >> np.uint64(HASH_BITS)).astype(np.int64)].sum())
    held = np.zeros(len(a), np.uint8)
    held[at[same]] = 1
    return both / (wa + wb - both), both, np.packbits(held).tobytes(), b[~same].tobytes()


_COMPARED = "a binary, b binary, similarity double, inside double, held binary, beyond array<long>, w double, levels binary"


@frugal
def _compare_all(batches: Iterator[pa.RecordBatch]):
    """Of (a, b, ha, wa, hb, wb); levels are those of the head's tokens, in their order."""
    for r in batches:
        c = [r.column(k) for k in range(6)]
        got = [compare(*(x[k].as_py() for x in c[2:])) for k in range(r.num_rows)]
        levels = [zlib.compress(np.frombuffer(x.as_py(), np.uint8)[7::8].tobytes(), 1) for x in c[2]]
        s, inside, held, beyond = list(zip(*got)) or [[]] * 4
        ends = pa.array(np.cumsum([0, *(len(x) // 8 for x in beyond)]), pa.int32())
        beyond = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(beyond), np.int64)))
        yield pa.RecordBatch.from_arrays([c[0], c[1], pa.array(s, pa.float64()), pa.array(inside, pa.float64()), pa.array(held, pa.binary()), beyond, c[5], pa.array(levels, pa.binary())], names=[x.split()[0] for x in _COMPARED.split(", ")])


def _matrix(t: pa.Table, a: int, z: int, n_head: int, extra: np.ndarray) -> np.ndarray:
    """Rows a to z as 0 and 1 over the head's tokens and the extra ones."""
    part = t.slice(a, z - a).combine_chunks()
    out = np.zeros((part.num_rows, n_head + len(extra)))
    out[:, :n_head] = np.unpackbits(np.frombuffer(b"".join(part["held"].to_pylist()), np.uint8).reshape(part.num_rows, -1), axis=1)[:, :n_head]
    beyond = [x or () for x in part["beyond"].to_pylist()]
    token = np.array([v for x in beyond for v in x], np.int64)
    if len(token):
        row, at = np.repeat(np.arange(part.num_rows), [len(x) for x in beyond]), np.minimum(np.searchsorted(extra, token), max(len(extra) - 1, 0))
        known = extra[at] == token if len(extra) else np.zeros(len(token), bool)
        out[row[known], n_head + at[known]] = 1
    return out


@frugal
def _within(x: pa.Table, y: pa.Table) -> pa.Table:
    """Links (a, b) between rows of x and y, members of one head: for each row of x one of each other class in y, if
    any. What two rows share is a product of matrices over the head's tokens and those that x's rows have beyond it."""
    out = []
    if x.num_rows and y.num_rows:
        levels = np.frombuffer(zlib.decompress(x["levels"][0].as_py()), np.uint8)
        names = pa.concat_arrays([*x["label"].chunks, *y["label"].chunks]).dictionary_encode().indices.to_numpy()
        lx, ly = names[: x.num_rows], names[x.num_rows :]
        wx, wy = x["w"].to_numpy(), y["w"].to_numpy()
        kx, ky = x["b"].to_pylist(), y["b"].to_pylist()
        extra = np.unique(np.array([v for t in x["beyond"].to_pylist() for v in t or ()], np.int64))
        worth = IDF[np.r_[levels, extra.view(np.uint64) >> np.uint64(HASH_BITS)].astype(np.int64)]
        step, need = max(8, CELLS // 8 // max(len(worth), 1)), THRESHOLD / (1 + THRESHOLD)
        told = set()
        for i in range(0, x.num_rows, step):
            left = _matrix(x, i, i + step, len(levels), extra) * worth
            for j in range(0, y.num_rows, step):
                both = left @ _matrix(y, j, j + step, len(levels), extra).T
                hit = (both >= need * (wx[i : i + step, None] + wy[None, j : j + step]) * (1 - 1e-12)) & (lx[i : i + step, None] != ly[None, j : j + step])
                for p in np.flatnonzero(hit.any(axis=1)).tolist():
                    q = np.flatnonzero(hit[p])
                    name, first = np.unique(ly[j + q], return_index=True)
                    for m, k in zip(name.tolist(), (j + q[first]).tolist()):
                        if (i + p, m) not in told:
                            told.add((i + p, m))
                            out.append((kx[i + p], ky[k]))
    c = list(zip(*out)) or [[]] * 2
    return pa.table({"a": pa.array(c[0], pa.binary()), "b": pa.array(c[1], pa.binary())})


def links_within_heads(told: DataFrame) -> DataFrame:
    """Links (a, b) between members of one head that are apart from it and members of other classes.

    told: a (the head), b, label, apart, inside, held, beyond, w, levels. Tokens beyond the head are kept where another
    member has them too. A member without THRESHOLD of its weight in those and in the head can't be similar to another.
    The rest are dealt into blocks of a bounded size, so a hot head is shared by many tasks; a block gives one link a
    row and class."""
    heads = told.groupBy("a").agg(F.max("apart").alias("some")).where("some").select("a")
    open_ = staged(told.join(heads, "a"), "open")
    tokens = open_.select("a", "b", "apart", F.explode("beyond").alias("token"))
    common = tokens.groupBy("a", "token").agg(F.count("*").alias("n"), F.max("apart").alias("some")).where("n > 1 and some").select("a", "token")
    idf = F.lit(1.0) - F.lit(DAMPED / 255) * (F.shiftrightunsigned("token", HASH_BITS) - 0.5)
    extra = tokens.join(common, ["a", "token"]).groupBy("a", "b").agg(F.collect_list("token").alias("beyond"), F.sum(idf).alias("more"))
    rows = open_.drop("beyond").join(extra, ["a", "b"], "left").where(F.col("inside") + F.coalesce("more", F.lit(0.0)) >= F.col("w") * (THRESHOLD * (1 - 1e-9)))
    rows = staged(rows.select("a", "b", "label", "apart", "held", "beyond", "w", "levels"), "members")
    size = rows.groupBy("a").agg(F.count_if("apart").alias("nx"), F.count("*").alias("ny")).where("nx > 0 and ny > 1")
    size = size.select("a", F.ceil(F.col("nx") / X_ROWS).cast("int").alias("xs"), F.ceil(F.col("ny") / Y_ROWS).cast("int").alias("ys"))
    place = lambda n: F.pmod(F.xxhash64("b"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = rows.join(size, "a")
    x = dealt.where("apart").select("a", "b", "label", "held", "beyond", "w", "levels", place("xs").alias("x"), every("ys").alias("y"))
    y = dealt.select("a", "b", "label", "held", "beyond", "w", place("ys").alias("y"), every("xs").alias("x")).toDF("a", "b", "label", "held", "beyond", "w", "y", "x")
    return x.groupBy("a", "x", "y").cogroup(y.groupBy("a", "x", "y")).applyInArrow(_within, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for the nodes of edges(a, b): label is the least node of the component. Each step takes the least
    label among neighbours and then the label's own label, so stars end in two steps and chains in few."""
    both = staged(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    label = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        up = label.select(F.col("node").alias("least"), F.col("label").alias("above"))
        after = staged(step.join(up, "least", "left").select("node", F.least("least", "above").alias("new"), "label"), "labels")
        if not after.where("new != label").limit(1).count():
            return label
        label = after.select("node", F.col("new").alias("label"))


def _joined(label: DataFrame, links: DataFrame) -> DataFrame:
    """label(key, label) with the classes of linked (a, b) made one."""
    of = lambda side: label.select(F.col("key").alias(side), F.col("label").alias(f"l{side}"))
    edges = staged(links.join(of("a"), "a").join(of("b"), "b").where("la != lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct(), "links")
    if not edges.limit(1).count():
        return label
    new = components(edges).withColumnRenamed("label", "to")
    return staged(label.join(new, label["label"] == new["node"], "left").select("key", F.coalesce("to", "label").alias("label")), "label")


def candidates(rows: DataFrame, ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, bands, w, h) of the distinct texts that have THRESHOLD of their weight in common with others.

    rows: doc_id, key, text. ids: doc_id and key of the same rows, and chars. texts: key, least (its least doc_id), copies."""
    size = texts.agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).first()
    n_chunks, n_shards = max(LEAST_CHUNKS, -(-(size["chars"] or 0) // CHUNK_CHARS)), max(LEAST_SHARDS, -(-(size["chars"] or 0) // SHARD_CHARS))
    chunk = F.pmod(F.xxhash64("doc_id", "key"), F.lit(n_chunks)).cast("int").alias("chunk")
    dealt = rows.select("doc_id", "key", "text", chunk).repartition(parts(rows.sparkSession), "chunk")
    repeated = ids.join(texts.where("copies > 1").select("key", "least"), "key").where("not (doc_id <=> least)")
    copies = staged(repeated.select("doc_id", "key", chunk).distinct(), "copies")
    asked = dealt.groupBy("chunk").cogroup(copies.groupBy("chunk")).applyInArrow(_ask(n_shards), "chunk int, shard int, g binary, more binary")
    back = asked.groupBy("shard").applyInArrow(_frequencies(size["n"]), "chunk int, shard int, g binary")
    back = back.unionByName(copies, allowMissingColumns=True)
    return staged(dealt.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_sign, _NODES), "nodes")


def classes_of(nodes: DataFrame) -> DataFrame:
    """(key, label) of the nodes that share a band bucket with another; equal labels are one class."""
    banded = nodes.select("key", F.posexplode("bands").alias("band", "hash"))
    full = banded.groupBy("band", "hash").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(banded.join(full, ["band", "hash"]).select(F.xxhash64("band", "hash").alias("bucket"), "key", "n"), "buckets")
    # how central a text is: how many it meets over all bands
    central = staged(met.groupBy("key").agg(F.sum("n").alias("central")), "central")
    heads = met.join(central, "key").groupBy("bucket").agg(F.max(F.struct("central", "key"))["key"].alias("a"))
    side = lambda s: nodes.select(F.col("key").alias(s), F.col("h").alias(f"h{s}"), F.col("w").alias(f"w{s}"))
    pairs = staged(met.join(heads, "bucket").where("a <> key").select("a", F.col("key").alias("b")).distinct(), "pairs")
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ha", "wa", "hb", "wb")
    done = staged(both.mapInArrow(_compare_all, _COMPARED), "compared")
    label = _joined(central.select("key", F.col("key").alias("label")), done.where(F.col("similarity") >= THRESHOLD).select("a", "b"))
    of_head, of_member = label.toDF("a", "la"), label.toDF("b", "label")
    told = done.drop("similarity").join(of_head, "a").join(of_member, "b").withColumn("apart", F.col("la") != F.col("label")).drop("la")
    return _joined(label, staged(links_within_heads(staged(told, "told")), "within"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, class_id (the least doc_id of its class), ``copy`` (the text's md5) and
    ``class_key``, the class's own key: two classes may have one class_id where an id has several texts or is null.

    Equal texts are in one class; classes are joined by links of weighted Jaccard similarity 0.8 or more. Null reads
    as empty, and all texts without a word are one class. Null doc_ids take part; a class of those alone has a null
    class_id. Empty tables give no rows; repeated rows each give a row. Texts of any length are taken whole; columns of
    docs other than doc_id and text, whatever their names, play no part."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("key"), text.alias("text"))
    ids = staged(rows.select("doc_id", "key", F.char_length("text").cast("long").alias("chars")), "ids")
    texts = staged(ids.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("chars").alias("chars")), "texts")
    nodes = candidates(rows, ids.select("doc_id", "key"), texts)
    label = classes_of(nodes)
    by_text = texts.select("key", "least").join(label, "key", "left").select("key", "least", F.coalesce("label", "key").alias("label"))
    by_text = staged(by_text, "labelled")
    least = by_text.groupBy("label").agg(F.min("least").alias("class_id"))
    class_of = by_text.join(least, "label").select("key", "class_id", "label")
    return ids.select("doc_id", "key").join(class_of, "key").select("doc_id", "class_id", F.lower(F.hex("key")).alias("copy"), F.lower(F.hex("label")).alias("class_key"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each class: that of the least doc_id; of repeated rows one stays."""
    classes = near_duplicate_classes(docs)
    first = classes.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("class_key", "doc_id", "copy").agg(F.count("*").alias("n"))
    kept = staged(first.groupBy("class_key").agg(F.min(F.struct("copy", "doc_id", "n")).alias("r")).select("r.*"), "kept")
    own = docs.withColumn("_pm_copy", F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    kept_keys = kept.select(F.col("doc_id").alias("_pm_id"), F.col("copy").alias("_pm_key"))
    out = own.join(kept_keys, own["doc_id"].cast("long").eqNullSafe(kept_keys["_pm_id"]) & (own["_pm_copy"] == kept_keys["_pm_key"]), "left_semi")
    if kept.where("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id", "_pm_copy"])
    return out.drop("_pm_copy")
