import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pagemill.llm import align as A

FILES = (A.BYTE_BPE, A.BYTE_RANKS, A.PIECES)


@pytest.fixture(scope="module")
def tok():
    return A.tokenizers(*map(public_tokenizers.path, FILES))


@pytest.fixture(scope="module")
def whole(tok):
    """Alignment of a whole text by both libraries and a merge of their ends: (n_a, n_b, groups, links), None without tokens."""
    first = Tokenizer.from_file(public_tokenizers.path(A.BYTE_BPE))
    first.encode_special_tokens = True

    def align(text):
        a, b = first.encode(" " + (text or ""), add_special_tokens=False).ids, tok.b.encode(text or "")
        sides = [[tok.a_bytes[i] for i in a], [tok.b_bytes[i] for i in b]]
        if not text or any(b"".join(x) != (" " + text).encode() for x in sides):
            return None
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in sides]
        groups, links, at = [], [], [0, 0]
        for e in sorted(set(ends[0]) & set(ends[1])):
            to = [side.index(e, k) + 1 for side, k in zip(ends, at)]
            groups.append("|".join(",".join(map(str, ids[x:y])) for ids, x, y in zip((a, b), at, to)))
            links.append((a[to[0] - 1], b[to[1] - 1]))
            at = to
        return len(a), len(b), groups, links

    return align


def brute(align, docs):
    found = [(i, align(t)) for i, t in docs]
    n = Counter(p for _, f in found if f for p in f[3])
    top = {}
    for (_, b), c in n.items():
        top[b] = max(top.get(b, 0), c)
    return [(i, 0, 0, 0, 0, 0, 0, "") if f is None else (i, f[0], f[1], len(f[2]), len(f[3]), sum(n[p] == top[p[1]] for p in f[3]), sum(n[p] for p in f[3]), hashlib.sha256(";".join(f[2]).encode()).hexdigest()) for i, f in found]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "\t", "é", "日", "▁", "<s>", "<|endoftext|>", "<0x41>", "'s", " '", "23", "😀", " ", "​", "ﬁ", "the", " of", "\x00", "\x1c", "́", "Ω", " К", "...", "\r"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(0, 50))) for _ in range(n)]


@pytest.mark.parametrize("part", [4_000_000, 30])
def test_segments_align_as_whole_texts_do(whole, monkeypatch, part):
    monkeypatch.setattr(A, "PART_CHARS", part)
    texts = odd_texts(3000) + ["word " * 400, "x" * 5000, " lead", "trail ", "▁"]
    run = A._align(*map(public_tokenizers.path, FILES))
    rows = pa.Table.from_batches(list(run(iter(pa.table({"d": range(len(texts)), "t": texts}).to_batches(max_chunksize=700))))).to_pylist()
    for text, r in zip(texts, rows):
        want = whole(text)
        if want is None:
            assert (r["n_a"], r["groups_sha256"], r["pairs"]) == (0, "", []), text
            continue
        got = Counter({(p >> 32, p & 0xFFFFFFFF): n for p, n in zip(r["pairs"], r["times"])})
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], got) == (want[0], want[1], len(want[2]), len(want[3]), Counter(want[3])), text
        assert r["groups_sha256"] == hashlib.sha256(";".join(want[2]).encode()).hexdigest(), text


def test_pointers_converge_over_long_chains():
    """Ends that never meet before the last byte: one component, found in a logarithm of its tokens."""
    a, b = np.arange(2, 20_002, 2), np.r_[np.arange(1, 20_000, 2), 20_000]
    to_a, to_b = A.terminals(a, b)
    assert set(to_a.tolist()) == set(to_b.tolist()) == {9_999}
    to_a, to_b = A.terminals(np.array([1, 4, 6]), np.array([1, 3, 4, 5, 6]))
    assert to_a.tolist() == [0, 1, 2] and to_b.tolist() == [0, 1, 1, 2, 2]


@pytest.mark.parametrize("broadcast_pairs", [A.BROADCAST_PAIRS, 0])
def test_documents_by_brute_force(spark, docs, whole, broadcast_pairs):
    got = A.align_documents(docs, broadcast_pairs=broadcast_pairs)
    want = brute(whole, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_table(no_docs):
    assert A.align_documents(no_docs).count() == A.align_documents(no_docs, broadcast_pairs=-1).count() == 0
