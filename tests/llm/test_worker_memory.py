"""What a worker holds goes with its task, and is made in bounded pieces."""

import ctypes

import numpy as np
import pytest
import public_tokenizers
import pyarrow as pa

from pagemill.llm import common, linededup, neardup, packing, toxicity


class Frame:
    """Stands for a DataFrame and keeps the function that a task would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


def test_words_go_with_the_task(spark):
    texts = [" ".join(f"word{k}x{i}" for i in range(50)) for k in range(300)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(300), pa.int64()), "text": texts})
    run, words = packing.token_pieces(Frame()).run, packing._word_ids(public_tokenizers.path(packing.TOKENIZER))
    made = [x for b in run(iter([batch, batch])) for x in b.column("ids").to_pylist()]
    assert made[:300] == made[300:] == [x + b"\0\0\0\0" for x in map(words._plain, texts)]
    assert not words.known
    early = run(iter([batch, batch]))  # a task that is ended before its input
    next(early)
    early.close()
    assert not words.known


def test_known_expressions_are_worked_out_in_pieces(monkeypatch):
    sizes, whole = [], toxicity.Models._worked_out
    monkeypatch.setattr(toxicity.Models, "_worked_out", lambda self, ask: (sizes.append(len(ask)), whole(self, ask))[1])
    g, shared = np.arange(600_000, dtype=np.int64) * 7, np.full(1 << 16, 1 / 256)
    m = toxicity.Models(g, [np.full(len(g), 2, np.int32), (np.arange(len(g)) % 3).astype(np.int32)], shared)
    assert sum(sizes) == len(g) and max(sizes) <= 250_000
    assert np.array_equal(m.known_ratio, whole(m, g))


def held_mb():
    with open("/proc/self/smaps_rollup") as f:
        return sum(int(x.split()[1]) for x in f if x.startswith(("Pss_Anon", "Pss_Shmem"))) / 1024


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="needs glibc")
def test_memory_is_given_back():
    def hoard(_):
        return [np.ones(8000) for _ in range(1500)][-1]  # the last one keeps the heap from shrinking by itself

    before = held_mb()
    kept = hoard(0)
    assert held_mb() > before + 50
    kept = [kept, common.frugal(hoard)(0)]
    assert len(kept) == 2 and held_mb() < before + 25


def test_every_task_function_gives_back():
    made = [toxicity._count(4), toxicity._merge, neardup._ask(4), neardup._frequencies(4), neardup._sign, neardup._compare_all, neardup._within, packing._successors, packing._open_new(8), linededup._sweep(10)]
    assert all(hasattr(f, "__wrapped__") for f in made)
