import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import lexsearch as L

ITEMS = "item_id long, text string, doc_id long, score long"


def terms(text):
    return re.findall(L.TERM, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Rows (item_id, rank, doc_id, score) by scoring every document for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in wanted.items():
        scored = []
        for i, c in counts:
            m = 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in own & c.keys())
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        scored.sort(key=lambda x: x[:3])
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(scored[:k], 1)]
    return out


def got(df):
    return [(r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()]


def key(r):
    return (r[0] is not None, r[0] or 0, r[1])


@pytest.fixture(scope="module")
def corpus():
    """Frequent and rare words, copies in number (ties), a very common word, a null id."""
    rng = random.Random(5)
    words = [f"w{k}é" if k % 3 else f"W{k}" for k in range(60)]
    pick = lambda n: " ".join(words[min(int(rng.expovariate(0.12)), 59)] for _ in range(n))
    texts = [pick(rng.randint(1, 60)) + rng.choice([".", " THE the", "\x00the", ""]) for _ in range(260)]
    texts += [texts[3]] * 40 + [None, "", "  ", "the"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7]), (None, texts[9]), (8, texts[3])]
    items = [(k, pick(rng.randint(1, 12)) + " the") for k in range(12)] + [(20, None), (21, ""), (22, "absent"), (3, "extra w1é"), (None, texts[3])]
    return docs, items


@pytest.mark.parametrize("block_terms,chunk,first_parts", [(10**6, 10**6, 16), (20, 300, 3), (10**6, 50, 1)])
def test_search_is_brute_force(spark, corpus, monkeypatch, block_terms, chunk, first_parts):
    monkeypatch.setattr(L, "CHUNK_POSTINGS", chunk)
    docs, items = corpus
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, item_id int").repartition(3)
    got_rows = got(L.search(d, spark.createDataFrame([(*x, 5, 6) for x in items], ITEMS), 10, block_terms, first_parts))
    assert sorted(got_rows, key=key) == sorted(brute(docs, items, 10), key=key)


def test_reading_stops_early_and_stays_exact():
    """Rare terms in a few documents: the best positions run ahead, and most positions are never read."""
    rng = np.random.default_rng(2)
    n, vocabulary = 20_000, 40
    size = rng.integers(1, 12, n)
    terms_, tf = np.concatenate([rng.choice(vocabulary, s, replace=False) for s in size]), rng.integers(1, 9, size.sum())
    norm = rng.integers(50, 150, n)
    weight = np.r_[np.full(vocabulary // 2, 9000), np.full(vocabulary // 2, 40)]
    lists = L.ImpactLists(size, terms_, tf, norm, weight)
    doc = np.repeat(np.arange(n), size)
    impact = weight[terms_] * (10**9 * tf // (1000 * tf + 20 * norm[doc]))
    early = 0
    for _ in range(20):
        own = rng.choice(vocabulary, 5, replace=False)
        every = np.bincount(doc, weights=impact * np.isin(terms_, own), minlength=n).astype(np.int64)
        docs, scores, read = lists.best(own, 10)
        kth = np.sort(every)[-10]
        assert set(np.flatnonzero(every >= kth)) <= set(docs) and (every[docs] == scores).all()
        early += read < sum(lists.end[t] - lists.start[t] for t in own) / 2
        assert not lists.seen.any() and not lists.met.any() and not lists.asked.any()
        docs, scores, less = lists.best(own, 10, int(kth))
        assert set(np.flatnonzero(every >= kth)) <= set(docs) and less <= read
    assert early > 5


def test_very_long_text_and_empty_tables(spark, no_docs, monkeypatch):
    text = "Ab cd-ef ñandú " * 5000
    whole = L.count_terms(text.encode())
    monkeypatch.setattr(L, "SLICE", 1000)
    assert L.count_terms(text.encode()) == whole == (20_000, Counter({b"ab": 5000, b"cd": 5000, b"ef": 5000, "ñandú".encode(): 5000}))
    items = spark.createDataFrame([(1, "ab", 0, 0)], ITEMS)
    assert L.search(no_docs, items).count() == 0
    assert L.search(spark.createDataFrame([(1, text)], "doc_id long, text string"), items.where("false")).count() == 0
    assert got(L.search(spark.createDataFrame([(4, text)], "doc_id long, text string"), items)) == brute([(4, text)], [(1, "ab")], 50)
    assert L.length_norms(np.array([2**40]), 2**40, 2**45).tolist() == [50 + 50 * 2**35]
