import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import neardup as n
from pagemill.llm import toxicity as t
from tests.llm.conftest import DOCS, rows


def texts(seed, count, words=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7))) for _ in range(900)]
    return rng, vocab, [" ".join(rng.choice(vocab) for _ in range(rng.randint(10, words))) for _ in range(count)]


def brute_classes(pairs, threshold=0.8):
    words = lambda x: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (x or "").lower())
    bags = [Counter(zip(*[words(x)[k:] for k in range(5)])) or Counter({tuple(words(x)): 1}) for _, x in pairs]
    distinct = list({x or "": b for (_, x), b in zip(pairs, bags)}.values())
    df = Counter(s for b in distinct for s in b)
    idf = lambda s: n.IDF[n.levels_of(np.array([df[s]]), len(distinct))[0]]
    weighted = [{s: c * idf(s) for s, c in b.items()} for b in bags]
    up = list(range(len(pairs)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(weighted):
        for j in range(i):
            b = weighted[j]
            low = sum(min(a[s], b[s]) for s in a.keys() & b.keys())
            if low >= threshold * (sum(a.values()) + sum(b.values()) - low):
                up[top(i)] = top(j)
    classes = defaultdict(set)
    for k in range(len(pairs)):
        classes[top(k)].add(k)
    return {frozenset(c) for c in classes.values()}


def got_classes(df):
    out = defaultdict(set)
    for r in n.near_duplicate_classes(df).collect():
        out[r["class_id"]].add(r["doc_id"])
        assert r["class_id"] == min(out[r["class_id"]] | {r["class_id"]})
    return {frozenset(c) for c in out.values()}


def test_classes_against_brute_force(spark):
    rng, vocab, base = texts(1, 60)
    data = list(base)
    for x in base[:25]:  # copies with one or a few words changed
        w = x.split()
        for k in range(rng.choice([1, 1, 2, 4])):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        data += [" ".join(w), x.upper() + "!!"]
    data += [None, "", " ", "a b", "a b", "A, b."]
    df = spark.createDataFrame(rows(data), DOCS)
    assert got_classes(df) == brute_classes(list(enumerate(data)))


def test_hot_group_of_near_copies_is_one_class(spark):
    rng, vocab, base = texts(2, 40)
    long = " ".join(rng.choice(vocab) for _ in range(400)).split()
    near = []
    for _ in range(30):
        w = list(long)
        w[rng.randrange(len(w))] = rng.choice(vocab)
        near.append(" ".join(w))
    data = base + near + [near[0]] * 20
    df = spark.createDataFrame(rows(data), DOCS)
    assert got_classes(df) == brute_classes(list(enumerate(data)))
    kept = n.drop_near_duplicates(df)
    assert kept.count() == len(base) + 1 and kept.columns == df.columns


def test_repeated_rows_null_ids_and_empty_tables(spark, docs, no_docs):
    assert n.near_duplicate_classes(docs).count() == docs.count()
    assert n.near_duplicate_classes(no_docs).count() == 0
    kept = n.drop_near_duplicates(docs)
    assert kept.where("doc_id = 3").count() == 1 and kept.where("doc_id in (0, 1, 2, 6)").count() == 1


def test_unlike_texts_of_null_ids_or_of_one_id_are_kept(spark):
    _, _, base = texts(7, 8)
    alike = base[4] + " tail" if len(base[4].split()) > 45 else base[4]
    df = spark.createDataFrame(rows([base[0], base[1], base[1], base[2], base[3], base[4], alike], [None, None, None, None, 5, 5, 9]), DOCS)
    classes = n.near_duplicate_classes(df).collect()
    assert len({r["class_key"] for r in classes}) == 5 and len({r["class_key"] for r in classes if r["class_id"] == 5}) == 2
    kept = sorted((r["doc_id"] or 0, r["text"]) for r in n.drop_near_duplicates(df).collect())
    assert kept == sorted([(0, base[0]), (0, base[1]), (0, base[2]), (5, base[3]), (5, base[4])])


def test_sampling_agrees_as_often_as_the_weighted_similarity():
    rng = np.random.default_rng(0)
    hits, want = 0, []
    for _ in range(60):
        h = np.sort(rng.integers(0, 2**56, 60, dtype=np.uint64))
        wa, wb = rng.integers(1, 5, 60) * rng.uniform(0.7, 1, 60), rng.integers(1, 5, 60) * rng.uniform(0.7, 1, 60)
        want.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
        d = np.zeros(60, np.int64)
        a, b = n.band_hashes(d, h, wa, 1)[0], n.band_hashes(d, h, wb, 1)[0]
        hits += (a == b).mean()
    assert abs(hits / 60 - np.mean(np.array(want) ** n.ROWS)) < 0.08


def test_links_within_a_hot_head_and_beyond_it(spark, monkeypatch):
    """Copies at many distances from one text: some are similar to others of the group only, some to none."""
    monkeypatch.setattr(n, "X_ROWS", 7)
    monkeypatch.setattr(n, "Y_ROWS", 11)
    monkeypatch.setattr(n, "CELLS", 4000)
    rng, vocab, base = texts(12, 10)
    long = [" ".join(rng.choice(vocab) for _ in range(300)).split() for _ in range(2)]
    data = list(base)
    for w0 in long:
        spots = sorted(rng.sample(range(0, 300, 12), 9))
        for k in range(60):
            w = list(w0)
            for s in rng.sample(spots, rng.randint(1, 6)):
                w[s] = rng.choice(vocab[:4])
            data.append(" ".join(w if k % 5 else w[: rng.randint(240, 300)]))
    df = spark.createDataFrame(rows(data), DOCS)
    assert got_classes(df) == brute_classes(list(enumerate(data)))


def test_numbers_survive_packing():
    rng = np.random.default_rng(3)
    for size, top in ((1, 2**56), (2, 2), (3000, 2**56), (5000, 2**13)):
        u = np.unique(rng.integers(0, top, size, dtype=np.uint64))
        assert (n.unpack(n.pack(u)) == u).all()


def test_hashes_and_counts_of_shingles():
    got = n.shingles(["a b c d e f", "", "A b, c D e a b c d e", "x y"])
    assert got[0].tolist() == [0, 0, 1, *[2] * 5, 3] and sorted(got[2][3:8].tolist()) == [1, 1, 1, 1, 2]
    assert len(set(got[1].tolist())) == 8 and got[1].max() < 2**56


def test_recall_of_rows_with_ids_divisible_by_fifty(spark):
    """Every pair of a query and a row at plain similarity 0.85 or more is in one class, on the driver's smallest documents."""
    import os

    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    df = spark.read.parquet(path)
    all_rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    classes = {r["doc_id"]: r["class_key"] for r in n.near_duplicate_classes(df).collect()}
    words = lambda x: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", x.lower())
    bags = {i: Counter(zip(*[words(x)[k:] for k in range(5)])) for i, x in all_rows}
    pairs = hits = 0
    for q in (i for i, _ in all_rows if i % 50 == 0):
        for i, b in bags.items():
            low = sum((bags[q] & b).values())
            if i != q and b and low >= 0.85 * (sum(bags[q].values()) + sum(b.values()) - low):
                pairs += 1
                hits += classes[q] == classes[i]
    assert hits >= 0.9 * pairs


def test_components(spark):
    edges = [(k, k + 1) for k in range(12)] + [(20, 30), (30, 25), (40, 41)]
    got = {r["node"]: r["label"] for r in n.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(13)}, 20: 20, 25: 20, 30: 20, 40: 40, 41: 40}


def test_toxic_words_are_learned_and_clean_rows_left(spark):
    rng, vocab, base = texts(4, 600, 80)
    bad = ["zorgle", "vexmoop", "quibbark"]
    data, labels = [], []
    for k, x in enumerate(base):
        w = x.split()
        toxic = k % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        data.append(" ".join(w))
        labels.append((k, int(toxic), 1))
    data += [None, ""]
    docs = spark.createDataFrame(rows(data), DOCS)
    out = {r["doc_id"]: r for r in t.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, text int")).collect()}
    assert len(out) == len(data) and all(0 <= r["score"] <= 1 for r in out.values())
    held = [k for k, _, _ in labels if t.id_remainder(k) == 0]
    assert np.mean([(out[k]["score"] >= 0.5) == (k % 5 == 0) for k in held]) > 0.97
    assert out[600]["score"] == out[601]["score"] < 0.5


def test_the_shuffled_join_gives_the_same_scores(spark, monkeypatch):
    _, _, base = texts(6, 80)
    docs = spark.createDataFrame(rows(base), DOCS)
    labels = spark.createDataFrame([(k, k % 3 // 2) for k in range(80)], "doc_id long, toxic int")
    a = sorted((r["doc_id"], r["score"]) for r in t.score_toxicity(docs, labels).collect())
    monkeypatch.setattr(t, "BROADCAST_LABELS", 0)
    assert a == sorted((r["doc_id"], r["score"]) for r in t.score_toxicity(docs, labels).collect())


def brute_kneser_ney(texts, ask, shared):
    """log P(last byte | five before) by dictionaries, for one class's texts; shared: P(byte | byte before) by pair."""
    raw = [(" " + x.lower() + " ").encode() for x in texts]
    six = Counter(x[k : k + 6] for x in raw for k in range(len(x) - 5))
    five = Counter(g[1:] for g in six)
    four = Counter(g[1:] for g in five)

    def p(g):
        level = {6: six, 5: five, 4: four}.get(len(g))
        if level is None:
            return shared[g[-2] * 256 + g[-1]]
        lower = p(g[1:] if len(g) > 4 else g[-2:])
        after = {s[-1]: n for s, n in level.items() if s[:-1] == g[:-1]}
        if not after:
            return lower
        return (max(level[g] - t.DISCOUNT, 0) + t.DISCOUNT * len(after) * lower) / sum(after.values())

    return [np.log(p(g)) for g in ask]


def test_probabilities_against_dictionaries(spark):
    rng = np.random.default_rng(8)
    data = [("".join(rng.choice(list("abcé "), 60)), k % 2) for k in range(24)]
    learn = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(data)], "doc_id long, text string, toxic int").repartition(3)
    table, shared, size = t.learn_table(learn, 5)
    packed = [(r["g"], r["counts"]) for r in table.collect()]
    raw = [(" " + x.lower() + " ").encode() for x, _ in data] + [b"abcabcabd", b"zzzzzzz", b"caab xq"]
    ask = sorted({x[k : k + 6] for x in raw for k in range(len(x) - 5)})
    codes = np.array([int.from_bytes(g, "big") for g in ask], np.int64)
    assert size == len({x[k : k + 6] for x in raw[:-3] for k in range(len(x) - 5)})
    models = {"all": t._models(packed, "all", shared["all"]), "part": t._models(packed, "part", shared["part"])}
    for name, m in models.items():
        use = [(x, y) for k, (x, y) in enumerate(data) if name == "all" or t.id_remainder(k) != t.CALIBRATION_FOLD]
        pairs = Counter(g[2:] for g in {r[k : k + 4] for x, _ in use for r in [(" " + x.lower() + " ").encode()] for k in range(2, len(r) - 3)})
        want = t.shared_model(np.array([pairs[bytes([a, b])] for a in range(256) for b in range(256)]))
        assert np.allclose(want, shared[name])
        for y in (0, 1):
            assert np.allclose(np.log(m.probabilities(codes, y)), brute_kneser_ney([x for x, k in use if k == y], ask, want))
    # what a shard says alone is what all say together
    for k, at in t.by_shard(codes, 5):
        alone = t._models([(r["g"], r["counts"]) for r in table.where(f"shard = {k}").collect()], "all", shared["all"])
        assert np.allclose(alone.ratio(codes[at]), models["all"].ratio(codes[at]))


def test_probabilities_of_a_history_sum_to_one():
    m = t.shared_model(np.random.default_rng(1).integers(0, 3, 65536))
    assert np.allclose(m.reshape(256, 256).sum(axis=1), 1)
    models = t.Models(np.sort(t.expressions("some text to learn from, some more of it")), [np.ones(len(t.expressions("some text to learn from, some more of it")), np.int32)] * 2, m)
    ask = (t.expressions("some text")[2] >> 8 << 8) + np.arange(256)
    assert np.isclose(models.probabilities(ask, True).sum(), 1)


@pytest.mark.parametrize("what", ["BROADCAST_EXPRESSIONS"])
def test_the_shuffled_table_gives_the_same_scores(spark, docs, monkeypatch, what):
    _, _, base = texts(6, 80)
    more = spark.createDataFrame(rows([*base, "x" * 300_000, None]), DOCS).unionByName(docs.limit(9))
    labels = spark.createDataFrame([(k, k % 3 // 2) for k in range(80)], "doc_id long, toxic int")
    scores = lambda: sorted((r["doc_id"], r["text"] or "", r["pos"]) for r in t.score_toxicity(more, labels, "pos").withColumn("pos", t.F.round("pos", 9)).collect())
    a = scores()
    monkeypatch.setattr(t, what, 0)
    assert a == scores() and len(a) == 91


def test_labels_of_held_out_rows_do_not_matter(spark):
    _, _, base = texts(5, 80)
    docs = spark.createDataFrame(rows(base), DOCS)
    score = lambda flip: sorted((r["doc_id"], r["score"]) for r in t.score_toxicity(docs, spark.createDataFrame([(k, (k % 3 == 0) ^ (flip and t.id_remainder(k) == 0)) for k in range(80)], "doc_id long, toxic boolean").selectExpr("doc_id", "int(toxic) as toxic")).collect())
    assert score(False) == score(True)


@pytest.mark.parametrize("kind", ["none", "one class", "null"])
def test_scores_without_two_classes(spark, docs, no_docs, kind):
    rows_ = {"none": [], "one class": [(k, 0) for k in range(30)], "null": [(None, 1), (3, None)]}[kind]
    labels = spark.createDataFrame(rows_, "doc_id long, toxic int")
    assert t.score_toxicity(docs, labels).where("score between 0 and 1").count() == docs.count()
    assert t.score_toxicity(no_docs, labels).count() == 0
