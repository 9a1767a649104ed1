"""Image URLs, image elements, error classes, text search and migrations on small written cases."""

from pyspark.sql import functions as F

from pagemill.functions import images as im
from pagemill.functions import text as tx
from pagemill.operators import images as io
from pagemill.operators import migration as m
from pagemill.operators import pages as p
from pagemill.operators import textsearch as ts


def test_clean_image_url():
    cases = {
        "//e.org/a b.png": "https://e.org/a%20b.png", "http://E.org/é.png?x=1&x=2#f": "https://e.org/%C3%A9.png?x=1#f", "https://e.org/a%20b.png": "https://e.org/a%20b.png",
        "https://e.org/_next/image?url=https%3A%2F%2Fi.org%2Fa.png&w=1": "https://i.org/a.png", "https://e.org/photo.php?u=https%3A%2F%2Fi.org%2Fa.png": "https://i.org/a.png", "/up/../a.png": "/up/../a.png",
        "https://x.inmediahk.net/a.png?itok=1&b=2": "https://x.inmediahk.net/a.png?b=2", "https://e.org/(a)'.png": "https://e.org/%28a%29%27.png", "ftp://e.org/a.png": None, "data:image/png;base64,x": None, "": None, None: None,
        "https://e.org/100%.png": "https://e.org/100%.png", "https://[bad/a.png": None,
    }
    assert {k: im._clean(k) for k in cases} == cases
    nested = "https://i.org/a.png"
    for _ in range(3):
        nested = "https://e.org/gw/?u=" + im.quote(nested, safe="")
    assert im._clean(nested) == "https://i.org/a.png"


def test_valid_image_url(spark):
    cases = {"https://e.org/a.png": True, "http://e.org/media/1": True, "https://e.org/media/1.js": False, "https://e.org/a.gif": False, "https://e.org/blank.png": False, "https://e.org/page": False, "/img/a": True, "data:image/png,x": False, "https://e.org/" + "a" * 2000 + ".png": False, "": False, None: False}
    rows = spark.createDataFrame([(k,) for k in cases], "url string").select("url", im.is_valid_image_url(F.col("url")).alias("ok")).collect()
    assert {r.url: r.ok for r in rows} == cases


def test_extract_images(spark):
    html = "<picture><source><source srcset='https://e.org/p.png 1x'><img></picture><a href='/page'><img data-image='https://e.org/d.png'></a><img src='https://e.org/d.png'><img src='https://e.org/s.png' width='10' height='900'><img width='x'>"
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>"), (3, None)], "page_id long, html string")
    got = io.extract_images(p.explode_nodes(pages), ["s.example"])
    assert [(r.page_id, r.url, r.status) for r in got.orderBy("node_id").collect()] == [(1, "https://e.org/p.png", "accepted"), (1, "https://e.org/d.png", "accepted"), (1, "https://e.org/d.png", "duplicate"), (1, "https://e.org/s.png", "small"), (1, None, "no_source")]
    assert io.image_metrics(got).collect()[0].asDict() == {"page_id": 1, "candidates": 5, "url_valid": 4, "filtered_by_size": 1, "temporary": 0, "final": 2}


def test_select_images(spark):
    content = spark.createDataFrame([(1, k, f"c{k}") for k in range(8)] + [(2, 0, "c")], "page_id long, pos int, url string")
    extra = spark.createDataFrame([(i, k, f"e{k}", g) for i, g in ((1, True), (2, False), (3, None), (4, True)) for k in range(8)], "page_id long, pos int, url string, gallery boolean")
    got = io.select_images(content, extra).groupBy("page_id").agg(F.count_if(F.col("part") == "content").alias("c"), F.count_if(F.col("part") == "extra").alias("e"), F.max("place").alias("n"))
    assert {tuple(r) for r in got.collect()} == {(1, 6, 0, 6), (2, 1, 2, 3), (3, 0, 2, 2), (4, 0, 6, 6)}
    assert io.select_images(content.limit(0), extra.limit(0)).count() == 0


def test_classify_error(spark):
    cases = [("validation_error", "an image"), ("validation_error", None), ("object_x", "y"), (None, "Could not establish connection. Receiving end does not exist."), (None, "access denied"), (None, "service unavailable"), (None, "service"), (None, None), (None, "標註失敗")]
    rows = spark.createDataFrame(cases, "code string, message string").select(tx.classify_error(F.col("code"), F.col("message"))).collect()
    assert [r[0] for r in rows] == ["IMAGE_VALIDATION_ERROR", "VALIDATION_ERROR", "OBJECT_X", "CONTENT_SCRIPT_NOT_READY", "TAB_RESTRICTED_PAGE", "INTERNAL_SERVER_ERROR", "UNKNOWN_ERROR", "UNKNOWN_ERROR", "標註失敗"]


def test_find_text():
    text = "a Fox  ran\nfar. The fox ran far, then the fox ran home"
    assert ts._find(text, " fox ran ", None, None) == (2, 8)
    assert ts._find(text, "fox ran", "The ", None) == (20, 7) and ts._find(text, "fox ran", None, " home") == (42, 7)
    assert ts._find(text, "fox ran", "zz", "zz") == (2, 8)
    assert ts._find(text, "a.b", None, None) is None and ts._find(None, "x", None, None) is None and ts._find(text, " ", None, None) is None


def test_migrate_inline(spark):
    items = [(1, 0, '"fox ran"'), (1, 1, '{"content":"far.","bgColor":"#cce7ff"}'), (1, 2, "[1]"), (1, 3, None), (1, 4, "{bad"), (2, 0, '"x"')]
    t = ts.migrate_inline(spark.createDataFrame(items, "page_id long, pos int, item string"), spark.createDataFrame([(1, "Fox\tran far."), (3, "x")], "page_id long, text string"), F.lit(5)).orderBy("page_id", "pos").collect()
    assert [(r.id, r.color, r.start, r.length) for r in t] == [("h5", "yellow", 0, 7), ("h6", "blue", 8, 4), ("h7", "yellow", None, None), ("h8", "yellow", None, None), ("h9", "yellow", None, None), ("h5", "yellow", None, None)]


def test_batch_migrate(spark):
    rows = [("highlights_https://e.org/a", '[{"id":"1"},{"id":"2","rangeInfo":{"a":1},"needsRangeInfo":true},{}]'), ("highlights_https://e.org/b", '[{"id":"3"}]'), ("highlights_https://e.org/c", "[]")]
    store = spark.createDataFrame([("p", k, key, v) for k, (key, v) in enumerate(rows)], "profile_id string, ordinal int, key string, value string")
    pairs = spark.createDataFrame([("p", f"https://e.org/{x}", to) for x, to in (("a", "https://e.org/s"), ("b", "https://e.org/s"), ("c", None), ("d", None))], "profile_id string, legacy_url string, stable_url string")
    got = [tuple(r) for r in m.batch_migrate(store, pairs).orderBy("legacy_url").select("status", "reason", "report_url", "n_highlights", "n_pending", "highlights").collect()]
    assert got == [
        ("success", None, "https://e.org/s", 3, 2, '[{"id":"1","needsRangeInfo":true},{"id":"2","rangeInfo":{"a":1},"needsRangeInfo":false},{"needsRangeInfo":true}]'), ("success", None, "https://e.org/b", 1, 1, '[{"id":"3","needsRangeInfo":true}]'),
        ("skipped", "no_highlights", "https://e.org/c", 0, 0, None), ("skipped", "no_data", "https://e.org/d", 0, 0, None),
    ]
