import json

from pagemill.operators import markup as mk
from pagemill.operators import pages as p
from pagemill.sources import files


def test_gate_html(spark):
    rows = [
        (1, None), (2, ""), (3, "x" * 50), (4, "<div><script>a</script></div>"), (5, '<H2 id="a">T &amp; <b>b</b></H2><p onclick="x">one<p>two <a href="java\nscript:x" title="t">j</a><a href="/r?a=1&amp;b=&quot;">r</a>'),
        (6, "<ul><li>a<ul><li>b</ul></ul><svg><p>no</p></svg>\xa0<img src='x'>"),
    ]
    got = {r["page_id"]: (r["success"], r["reason"], r["html"]) for r in mk.gate_html(spark.createDataFrame(rows, "page_id long, html string"), 140).collect()}
    assert got[1] == got[2] == (False, "empty", "") and got[4] == (False, "sanitized_empty", "") and got[3] == (True, None, "x" * 50)
    assert got[5] == (True, None, '<h2>T &amp; b</h2><p>one</p><p>two <a>j</a><a href="/r?a=1&amp;b=&quot;">r</a></p>')
    assert got[6] == (True, None, "<ul><li>a<ul><li>b</li></ul></li></ul>&nbsp;")
    long = mk.gate_html(spark.createDataFrame([(1, "y" * 100_001)], "page_id long, html string")).first()
    assert (long["success"], long["reason"]) == (False, "too_long")
    assert mk.gate_html(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_noise_of_technical_containers(spark):
    html = '<div>a<span class="anchor x">#</span><pre hidden>p</pre><pre>q</pre><form>f<p>g</p></form><div class="code-example"><header>h</header>c</div><header>k</header><i data-clipboard-target="y">d</i></div>'
    rows = p.explode_nodes(spark.createDataFrame([(1, html), (2, html)], "page_id long, html string"), texts=True)
    texts = lambda t: {i: "".join(r["text"] for r in t.where("tag = '#text'").orderBy("page_id", "seq").collect() if r["page_id"] == i) for i in (1, 2)}
    assert texts(mk.without_noise(rows)) == {1: "aqck", 2: "aqck"}
    assert texts(mk.without_noise(rows, rows["page_id"] == 2)) == {1: "a#pqfghckd", 2: "aqck"}


def test_snapshot_files_and_rejects(spark, tmp_path):
    good = {"metadata": {"n": 1}, "payload": {"highlights": [{"id": "a"}, 5], "saved_states": [], "url_aliases": {"u": "v"}}}
    cases = {"ok": good, "bare": {"payload": {"highlights": [], "saved_states": [{"k": 1}]}}, "list": [], "nothing": {}, "text": {"payload": "x"}, "nohl": {"payload": {"saved_states": []}}, "nosv": {"payload": {"highlights": [], "saved_states": {}}}, "alias": {"payload": {"highlights": [], "saved_states": [], "url_aliases": []}}}
    for name, value in cases.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value))
    (tmp_path / "broken.json").write_text("{")
    tables, rejects = files.read_snapshot_files(spark, str(tmp_path))
    assert {r["profile_id"]: r["reason"] for r in rejects.collect()} == {"list": "no object", "nothing": "no payload", "text": "no payload", "nohl": "no highlights", "nosv": "no saved_states", "alias": "url_aliases is no object", "broken": "malformed"}
    assert sorted((r["profile_id"], r["pos"], r["item"]) for r in tables["highlights"].collect()) == [("ok", 0, '{"id":"a"}'), ("ok", 1, "5")]
    assert [tuple(r) for r in tables["saved_states"].collect()] == [("bare", 0, '{"k":1}')] and [tuple(r) for r in tables["url_aliases"].collect()] == [("ok", "u", "v")]
    assert {r["profile_id"]: r["metadata"] for r in tables["metadata"].collect()} == {"ok": '{"n":1}', "bare": None}


def test_block_requests_are_written_in_order(spark, tmp_path):
    blocks = spark.range(1000).selectExpr("id % 7 as page_id", "cast(id div 7 as int) as pos", "'paragraph' as type", "concat('t', id) as text")
    files.write_block_batches(blocks.repartition(5), f"{tmp_path}/out", size=50)
    rows = [json.loads(x) for f in sorted((tmp_path / "out").glob("part-*.json")) for x in f.read_text().splitlines()]
    assert [(r["page_id"], r["batch"]) for r in rows] == [(i, b) for i in range(7) for b in range(3)]
    assert all([c["pos"] for c in r["children"]] == list(range(50 * r["batch"], 50 * r["batch"] + len(r["children"]))) and len(r["children"]) <= 50 for r in rows)
