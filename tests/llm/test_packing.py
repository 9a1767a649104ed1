import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import packing as p


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeéthn ß's.,!1\n")), max_size=40))
def test_ids_equal_the_tokenizers(text):
    t = Tokenizer.from_file(public_tokenizers.path(p.TOKENIZER)) if "t" not in _CACHE else _CACHE["t"]
    _CACHE["t"] = t
    words = p._word_ids(public_tokenizers.path(p.TOKENIZER))
    assert np.frombuffer(words.encode([text])[0], "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


_CACHE: dict = {}


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|startoftext|>", "x<|endoftext|>y <|EndOfText|> <| endoftext|>", "<|", "a\x1cb \0 c", "n\u0303 ñ Ünïcode ŻÓŁW word's WORD'S", "\n \n"])
def test_ids_of_odd_texts(tok, text):
    words = p._word_ids(public_tokenizers.path(p.TOKENIZER))
    got = words.encode([text, "plain words", text])
    want = np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert got == [want, np.array(tok.encode("plain words", add_special_tokens=False).ids, "<u4").tobytes(), want]


def test_whole_words_of_the_vocabulary(tok):
    letters = p._byte_letters()
    words = p._word_ids(public_tokenizers.path(p.TOKENIZER))
    plain = []
    for t in list(tok.get_vocab())[::7]:
        if t.endswith("</w>"):
            try:
                plain.append(bytes(letters[c] for c in t[:-4]).decode())
            except (KeyError, UnicodeDecodeError):
                continue
    got = words.encode(plain)
    for x, ids in zip(plain, got):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(x, add_special_tokens=False).ids


def test_pieces_and_places(docs, tok):
    rows = [r.asDict() for r in p.pack_documents(docs).collect()]
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    assert sum(r["piece"] == 0 for r in rows) == docs.count()
    by_doc = {}
    for (i, t), n in texts.items():
        ids = np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4")
        for k in range(0, len(ids), 2048):
            by_doc.setdefault(i, Counter())[(k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))] += n
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], Counter())[(r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        assert zlib.crc32(r["ids"]) == r["ids_crc32"]
    assert got == by_doc
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_sequences_hold_the_ids(docs):
    packed = p.pack_documents(docs)
    for r in p.sequences(packed).collect():
        assert len(r["ids"]) == 4 * r["length"]


def _best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, g in enumerate(gaps) if g >= n]
        if fits:
            k = min(fits, key=lambda k: gaps[k])
            gaps[k] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", [1, 2])
def test_as_few_sequences_as_the_serial_form(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 2049, 300), rng.integers(1, 200, 300), np.full(50, 700)]).tolist()
    pieces = spark.createDataFrame(list(enumerate(lengths)), "piece_key long, length long")
    placed = p.best_fit(pieces).collect()
    assert sorted(r["piece_key"] for r in placed) == list(range(len(lengths)))
    assert len({r["sequence_id"] for r in placed}) <= _best_fit_decreasing(lengths, 2048) * 1.03 + 1


def test_places_across_tasks():
    assert p._across({0: (2, 3), 1: (1, 0), 2: (4, 1)}) == [(1, 0, 0, 0, 2), (2, 0, 1, 0, 1)]


def test_empty(no_docs):
    assert p.pack_documents(no_docs).count() == 0
