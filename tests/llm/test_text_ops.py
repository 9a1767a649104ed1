import base64
import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pagemill.llm import bpe, htmltext, license, media, sharding, simhash
from pagemill.llm.htmltext import extract_text, main_text


def test_media_round_trip(docs):
    for r, m in zip(sorted(docs.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["text"] or "")), sorted(media.media_digests(docs).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_bytes"]))):
        if r["doc_id"] == 3:
            continue
        p = media.payload_of((r["text"] or "").encode())
        assert (m["n_bytes"], m["payload_bytes"], m["payload_sha256"]) == (len((r["text"] or "").encode()), len(p), hashlib.sha256(p).hexdigest())


@pytest.mark.parametrize("frames", [1, 2, 41])
def test_frames_fast_and_by_symbol(frames):
    p = np.random.default_rng(frames).integers(0, 256, 192 * frames, dtype=np.uint8).tobytes()
    m = media.write_avi(p)
    assert media.read_frames(m).tobytes() == p
    start, size = media.frame_spans(m)
    assert b"".join(media.decode_frame(m[s : s + n]).tobytes() for s, n in zip(start, size)) == p


def test_frames_of_another_table_are_read():
    """One DHT of plain four-bit codes: the symbol-wise reader must do."""
    body = b"\xff\xd8" + b"\xff\xc4\x00\x1c\x00" + bytes([0, 0, 0, 9] + [0] * 12) + bytes(range(9)) + media._FRAME + media._SCAN
    bits = "0000" * 192
    data = int(bits, 2).to_bytes(96, "big")
    assert (media.decode_frame(body + data + media.JPEG_END) == 128).all()


def test_shots_and_clips(spark):
    frames = np.concatenate([np.full((20, 12, 16), 10), np.full((15, 12, 16), 200)]).astype(np.uint8)
    assert media.shot_starts(frames)[0].tolist() == [0, 20]
    t = spark.createDataFrame([(1, bytearray(media.write_avi(frames.tobytes()))), (2, None)], "doc_id long, media binary")
    got = [(r["clip"], r["start_ms"], r["end_ms"], r["mean_level"]) for r in media.clip_rows(t).collect()]
    assert sorted(got) == [(0, 0, 800, 10.0), (1, 800, 1400, 200.0)]


def test_files_without_frames_and_empty_tables(spark, no_docs):
    starts, hist = media.shot_starts(np.zeros((0, 12, 16), np.uint8))
    assert len(starts) == 0 and hist.shape == (0, media.BINS)
    m = media.write_avi(b" " * 192)
    start, size = media.frame_spans(m)
    assert len(start) == 1
    assert media.media_digests(no_docs).count() == bpe.token_digests(no_docs).count() == license.scan_licenses(no_docs).count() == 0
    assert media.clip_rows(media.store_media(no_docs)).count() == simhash.neighbours_of_queries(no_docs).count() == 0


@pytest.fixture(scope="module")
def enc():
    with open(public_tokenizers.path(bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk", [bpe.CHUNK, 1000])
def test_bpe_equals_the_whole_text(docs, enc, chunk, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, bytes(r["ids"])) for r in bpe.encode_texts(docs, chunk=chunk).collect())
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, np.array(enc.encode_ordinary(r["text"] or ""), "<u4").tobytes()) for r in docs.collect())
    assert got == want


def test_bpe_decodes(docs):
    back = sorted(r["decoded"].decode() for r in bpe.decode_ids(bpe.encode_texts(docs)).collect())
    assert back == sorted(r["text"] or "" for r in docs.collect())


def test_shards_differ_by_one_slot_and_move_little():
    names = [f"s{k}" for k in range(7)]
    table = sharding.lookup_table(names, 1009)
    counts = [table.count(n) for n in names]
    assert max(counts) - min(counts) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != "s6") < 0.15 * 1009
    slots, at = [None] * 1009, {n: 0 for n in names}
    while None in slots:  # brute force: whole preference lists
        for n in names:
            if None in slots:
                o, s = sharding.preference(n, 1009)
                k = next((o + j * s) % 1009 for j in range(1009) if slots[(o + j * s) % 1009] is None)
                slots[k] = n
                at[n] += 1
    assert slots == table


def test_shards_refuse_bad_input():
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_every_row_gets_a_shard(docs, no_docs):
    out = sharding.assign_shards(docs, ["a", "b", "c"], size=101)
    assert out.count() == docs.count() and out.where("shard is null").count() == 0
    assert out.groupBy("doc_id").agg({"shard": "max"}).count() == docs.select("doc_id").distinct().count()
    assert sharding.assign_shards(no_docs, ["a"], size=101).count() == 0


PAGE = """<html><head><title>T</title><script>var x = "</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></ul></nav>
<div class="ad">buy this, now, please, it is very, very cheap and good</div><div id="cookie-notice">we use cookies</div>
<article><header><h1>Head &amp; line</h1></header><p><b>First</b> para, with
   more&nbsp;words and, well, commas.<br><p>Second one&#33;<ul><li>item <a href="/x">link</a></ul></article>
<section class="comments"><p>a comment, long enough to count, surely, as one, I think</p></section><footer>&copy; foot</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Head & line First para, with more words and, well, commas. Second one! item link"


@pytest.mark.parametrize("page,text", [(None, ""), ("", ""), ("plain, text", "plain, text"), ("<p>short", "short"), ("<body><nav>x</nav><div><p>Only &lt;this&gt; stays</p></div>", "Only <this> stays"), ("<article>a<p>b<!-- c --></p>d</article", "a b d"), ("<div hidden>x</div><p>y" + "<b>" * 300 + "z", "yz")])
def test_main_text_of_odd_pages(page, text):
    assert main_text(page) == text


def test_pages_in_pages_out(spark):
    t = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (None, None, None, 2)], "page_id long, url string, html string, text int")
    rows = extract_text(t).collect()
    assert len(rows) == 3 and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert extract_text(t.where("false")).count() == 0


def test_simhash_against_brute_force(spark, docs):
    """Votes of the same hashes, counted in Python."""
    from pyspark.sql import functions as F

    hashes = docs.where("doc_id is not null").select("doc_id", "text", simhash.term_hashes(F.coalesce("text", F.lit(""))).alias("h")).dropDuplicates(["doc_id", "text"]).collect()
    want = set()
    for r in hashes:
        bits = sum(1 << b for b in range(64) if 2 * sum((h & (2**64 - 1)) >> b & 1 for h in r["h"]) > len(r["h"]))
        want.add((r["doc_id"], bits))
    got = {(r["doc_id"], r["bits"] & (2**64 - 1)) for r in simhash.document_fingerprints(docs).where("doc_id is not null").collect()}
    assert got == want


def test_edited_text(spark, docs, no_docs):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    rows = rows.where("not (doc_id = 3 and text is null)").collect()
    texts = [r["text"] or "" for r in sorted(rows, key=lambda r: r["doc_id"])]
    got = {r["doc_id"]: r for r in simhash.edited_fingerprints(spark.createDataFrame(rows, docs.schema)).collect()}
    for k, t in enumerate(texts):
        c, n = len(t) // 4, len(t)
        e = t[: n - c] + texts[(k + 1) % len(texts)][:c]
        assert got[k]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest() and got[k]["n_chars"] == n
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
        if c == 0:
            assert got[k]["fingerprint"] == got[k]["edited_fingerprint"]
    assert simhash.edited_fingerprints(docs).count() == docs.count()
    assert simhash.edited_fingerprints(no_docs).count() == 0


def test_buckets_of_uneven_ids_are_bounded(spark):
    """A far-off id, a dense run, many null ids and one id on many texts."""
    ids = [*range(400), 2**62, -(2**62), *[None] * 300, *[77] * 200]
    t = spark.createDataFrame([(i, f"text {k} of {k % 7}") for k, i in enumerate(ids)], "doc_id long, text string")
    rows = simhash.with_next(t, 40).collect()
    sizes = {}
    for r in rows:
        sizes[r["bucket"]] = sizes.get(r["bucket"], 0) + 1
    assert len(rows) == len(ids) and max(sizes.values()) <= 4 * len(ids) / 40
    order = sorted(rows, key=lambda r: (r["bucket"], r["place"]))
    assert all((a["next_bucket"], a["next_place"], a["next_text"]) == (b["bucket"], b["place"], b["text"]) for a, b in zip(order, [*order[1:], order[0]]))
    got = [r["doc_id"] for r in order]
    assert got == sorted(got, key=lambda i: (i is not None, i))


def test_fingerprint_of_a_very_long_text(spark):
    """More votes for a bit than 21 bits count: of 5,000,000 words nearly all terms are one."""
    t = spark.range(1).selectExpr("id as doc_id", "concat(repeat('a ', 5000000), 'b') as text").unionByName(spark.createDataFrame([(1, "a a a a a")], "doc_id long, text string"))
    got = {r["doc_id"]: r["bits"] for r in simhash.document_fingerprints(t).collect()}
    assert got[0] == got[1]


def test_registered_neighbours(spark):
    t = spark.createDataFrame([(0, "some words of a text"), (1, "some words of a text"), (50, "other words of it"), (3, None), (None, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["distance"]) for r in simhash.neighbours_of_queries(t).collect())
    assert got == [(0, 0), (50, 0)]


def test_all_neighbours_within_the_radius(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(-(2**63), 2**63, 20).tolist()
    near = [b ^ sum(1 << int(k) for k in rng.choice(63, n, replace=False)) for b in base for n in (0, 1, 2, 3, 4)]
    t = spark.createDataFrame([(x,) for x in base + near + base], "bits long")
    dist = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    every = set(base + near)
    for radius in (0, 2, 3):
        got = [(r["query_bits"], r["bits"], r["distance"]) for r in simhash.fingerprint_neighbours(t, t, radius).collect()]
        want = {(a, b, dist(a, b)) for a in every for b in every if dist(a, b) <= radius}
        assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("line,name,changed", [("Released under the MIT License.", "MIT", 0), ("x licensed under the apache license, version 2.0 y", "Apache-2.0", 0), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0", 0), ("This work was licensed under the GNU General Public License, version 3.", "GPL-3.0", 1), ("This work is licensed under the GNU General Public License, version 4.", None, 0), ("a driving license is needed", None, 0)])
def test_license_blocks(line, name, changed):
    found = license.scan_block(line)
    assert (found and (found[0], found[5])) == (name and (name, changed))


def test_license_places(spark, docs):
    text = "intro\nReleased under the MIT License.\nLicensed under CC BY 4.0.\nend"
    t = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string")
    got = license.scan_licenses(t).collect()
    assert len(got) == 4 and {text[r["start"] : r["start"] + r["length"]] for r in got} == {"Released under the MIT License", "Licensed under CC BY 4.0"}
    assert license.scan_licenses(docs).count() == 0


def test_wrapped_notices_and_several_in_a_line(spark):
    mit = license.TEMPLATES["MIT"][2].split()
    wrapped = "/*\n" + "\n".join(" * " + " ".join(mit[k : k + 11]) for k in range(0, len(mit), 11)) + "\n */"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following\nconditions are met:"
    dual = "Released under the MIT License. Some words stand here. Licensed under the Apache License, Version 2.0. " + "more words " * 3000 + "Released under the MIT License."
    t = spark.createDataFrame([(1, wrapped), (2, "This\n" + bsd), (3, dual), (4, "x\nThis Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["license"], r["exact"]) for r in license.scan_licenses(t).collect())
    assert [(d, name, exact) for d, _, name, exact in got] == [(1, "MIT", True), (2, "BSD-3-Clause", True), (3, "MIT", True), (3, "Apache-2.0", True), (3, "MIT", True), (4, "MPL-2.0", True)]


@pytest.mark.parametrize("name", ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-3.0", "MPL-2.0", "ISC", "Unlicense"])
def test_whole_license_texts(name):
    text = max(license.TEMPLATES[name], key=len)
    found = license.scan_text("Copyright (c) 2020 A. Person\n\n" + text + "\n\nother words")
    assert [(x[0], x[5]) for x in found] == [(name, 0)]


@pytest.mark.parametrize("text,name", [("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: AGPL-3.0-only", "AGPL-3.0"), ("This Source Code Form is subject to the conditions of the Mozilla Public License, v. 2.0.", "MPL-2.0"), ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", None)])
def test_names_are_whole_words(text, name):
    assert [x[0] for x in license.scan_text(text)] == [name] * bool(name)


SENTENCE = "<p>This is a long paragraph of the article, with commas, and enough words to count.</p>"


@pytest.mark.parametrize(
    ("page", "n_chars"),
    [
        (f"<body><form><div id=nav><a href=x>menu</a></div><div>{SENTENCE * 3}</div></form></body>", 242),  # the whole page is a form
        (f"<body><article>{SENTENCE}<form><p>Subscribe to our newsletter for news, each week.</p></form></article></body>", 80),
        (f"<body><article><div class='share-price report'>{SENTENCE}</div><div class='share-buttons'>Tell all your friends, please</div></article></body>", 80),
        (f"<body><div class='with-sidebar'><div class='page-overlay'><main>{SENTENCE}</main></div><div class='sidebar'>{SENTENCE}</div></div><div id=comments><article>{SENTENCE}</article></div></body>", 80),
        (f"<body><article>{SENTENCE}<div class='siteFooter'>All rights are reserved, of course, by us</div></article></body>", 80),
    ],
)
def test_html_doubtful_elements(page, n_chars):
    assert len(htmltext.main_text(page)) == n_chars


def test_html_deep_pages_take_linear_time():
    page = "<div>" * 100_000 + SENTENCE + "</div>" * 100_000
    began = time.monotonic()
    assert len(htmltext.main_text(page)) == 80
    assert time.monotonic() - began < 30


def test_names_with_numbers_and_joined_words():
    body = "<p>" + "The article says a good deal, and says it at some length. " * 6 + "</p>"
    for name in ("commentlist", "comments2", "respond-box1", "relatedlinks"):
        assert main_text(f'<body><article>{body}<ol class="{name}"><li>A reader says that it is long, and says so twice over.</li></ol></article></body>').endswith("some length.")
    for name in ("nav2", "menulist", "sidebar_3", "footerlinks"):
        assert main_text(f'<body><div id="{name}">Home and more</div><p>short</p></body>') == "short"
    for name in ("commentary", "address", "h2", "navy", "item-12", "wp-content"):
        assert "Kept words" in main_text(f'<body><article>{body}<div class="{name}">Kept words</div></article></body>')
