import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from pagemill.llm import linededup as d

STRIP = " \t\n\x0b\x0c\r"


def brute(texts, min_docs):
    key = lambda x: x.strip(STRIP).translate(str.maketrans(d.UPPER, d.LOWER))
    found = defaultdict(set)
    for i, t in texts:
        for x in (t or "").split("\n"):
            found[key(x)].add(i)
    return [(i, [x for x in (t or "").split("\n") if not (key(x) and len(found[key(x)]) >= min_docs)], len((t or "").split("\n"))) for i, t in texts]


@pytest.mark.parametrize("min_docs", [1, 2, 10])
def test_against_brute_force(docs, min_docs):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"], r["n_lines"], r["n_dropped"]) for r in d.dedup_lines(docs, min_docs).collect())
    want = sorted((i is None, i or 0, "\n".join(kept), n, n - len(kept)) for i, kept, n in brute([(r["doc_id"], r["text"]) for r in docs.collect()], min_docs))
    assert got == want


def test_columns_and_counts_follow(docs):
    out = d.dedup_lines(docs, 10)
    assert out.columns[: len(docs.columns)] == docs.columns
    assert all(r["n_chars"] == len(r["text"]) and r["pos"] == 7 for r in out.collect())


def test_bitmaps_without_text(docs):
    maps = d.keep_bitmaps(docs, 10)
    assert "text" not in maps.columns
    for r in maps.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r["keep_bitmap"]), np.uint8), count=4)
        assert bits.tolist() == [0, 1, 0, 1] and r["n_dropped"] == 2


def test_first_occurrence(spark):
    rows = [(k, f"a\nb{k % 5}\nc") for k in range(60)]
    out = {r["doc_id"]: r["text"] for r in d.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), None).collect()}
    assert out[0] == "a\nb0\nc" and all(out[k] == f"b{k}" for k in range(1, 5)) and all(out[k] == "" for k in range(5, 60))


@pytest.mark.parametrize("min_docs", [None, 3, 5, 7])
@pytest.mark.parametrize("cut", [1, 2, 3, 5, 50])
@pytest.mark.parametrize("held", [0, 2, 10_000])
def test_sweep_over_any_cut_of_batches_and_tasks(monkeypatch, min_docs, cut, held):
    monkeypatch.setattr(d, "HELD", held)
    rng = np.random.default_rng(cut)
    rows = sorted({(int(rng.integers(0, 6)), int(rng.integers(0, 8)), int(rng.integers(0, 3))) for _ in range(70)})
    table = pd.DataFrame([(doc, 0, pos, 3, h, h) for h, doc, pos in rows], columns=["doc", "copy", "pos", "n_lines", "h1", "h2"])
    whole = [k for k in range(1, len(rows)) if rows[k][:2] != rows[k - 1][:2]]  # ranges keep a line's document together
    edges = [0, *(min(k for k in whole if k >= e) for e in (15, 16, 34)), len(table)]
    out = []
    for task, (a, z) in enumerate(zip(edges, edges[1:])):
        monkeypatch.setattr(d.TaskContext, "get", staticmethod(lambda task=task: type("T", (), {"partitionId": lambda self: task})()))
        part = table.iloc[a:z]
        out += list(d._sweep(min_docs)(part.iloc[k : k + cut].reset_index(drop=True) for k in range(0, len(part), cut)))
    out = pd.concat(out)
    gone = set(map(tuple, out[out.kind == d.DROP][["h1", "doc", "pos"]].values.tolist()))
    ends, left = out[out.kind == d.PARTIAL], out[out.kind == d.OPEN]
    if min_docs is None:
        first = ends.groupby("h1").task.min()
        gone |= {(r.h1, r.doc, r.pos) for r in left.itertuples() if first.get(r.h1, 99) < r.task}
        want = {r for k, r in enumerate(rows) if k and rows[k - 1][0] == r[0]}
    else:
        over = ends.groupby("h1").n.sum()
        gone |= {(r.h1, r.doc, r.pos) for r in left.itertuples() if over.get(r.h1, 0) >= min_docs}
        docs = {h: {x[1] for x in rows if x[0] == h} for h, _, _ in rows}
        want = {r for r in rows if len(docs[r[0]]) >= min_docs}
    assert gone == want


def test_empty(no_docs):
    assert d.dedup_lines(no_docs).count() == 0


def test_digest(docs):
    r = d.dedup_lines(docs.where("doc_id = 1"), 10).first()
    assert hashlib.sha256(r["text"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest() and r["n_lines"] == 1


def test_one_document_of_many_equal_lines(spark):
    rows = [(1, "x\n" * 60_000 + "y"), (2, "x"), (3, "z\n" * 60_000 + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (2, 3, 4):
        got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in d.dedup_lines(df, least).collect()}
        assert got == {i: ("\n".join(k), n - len(k)) for i, k, n in brute(rows, least)}
