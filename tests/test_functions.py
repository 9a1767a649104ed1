import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as h
from pagemill.functions import urls as u
from pagemill.operators import logs as lg
from pagemill.operators import pages as p
from pagemill.operators import sync as y
from pagemill.operators.backup import canonical_json


def column(spark, values, make, kind="string"):
    t = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r["out"] for r in t.select("k", make(F.col("v")).alias("out")).orderBy("k").collect()]


NORMAL = {
    None: "", "": "", "not a url": "not a url", "http://": "http://", "/a/b": "/a/b", "https://Ex.COM": "https://ex.com/", "https://ex.com/a/": "https://ex.com/a",
    "https://ex.com//": "https://ex.com/", "https://ex.com/a?utm_source=x&b=1#top": "https://ex.com/a?b=1", "https://ex.com/a?utm_source=x": "https://ex.com/a",
    "https://ex.com:443/a": "https://ex.com/a", "http://ex.com:8080/a/?q": "http://ex.com:8080/a?q=", "https://ex.com/?a=x%20y&gclid=3": "https://ex.com/?a=x+y", "http://m.ex.com/Ä|b": "http://m.ex.com/Ä|b",
    "https://U:p@ex.com/a": "https://U:p@ex.com/a",
}


def test_normalize_url(spark):
    assert column(spark, list(NORMAL), u.normalize_url) == list(NORMAL.values())


def test_normal_form_is_stable(spark):
    assert column(spark, list(NORMAL.values()), u.normalize_url) == list(NORMAL.values())


STABLE = {
    "https://www.hk01.com/news/123/some-title?utm_term=a": "https://www.hk01.com/news/123", "https://hk01.com/news/123": None, "https://xhk01.com/news/123/t": None,
    "https://news.mingpao.com/article/2024/s1/title": "https://news.mingpao.com/article/2024/s1", "https://news.mingpao.com/article/2024/s1": None, None: None, "nope": None,
}


def test_stable_url(spark):
    assert column(spark, list(STABLE), u.stable_url) == list(STABLE.values())


@pytest.mark.parametrize(
    "page,query,want",
    [
        ("/[category]/[id]/[slug]", {"category": "新聞", "id": "9", "slug": "a-b"}, "https://e.org/新聞/9"),
        ("/[category]/[id]/[slug]", {"category": "c", "id": "9", "slug": "77"}, None),
        ("/[id]/[name]", {"id": "9", "name": "標題"}, "https://e.org/9"),
        ("/posts/[slug]", {"slug": "x"}, None),
        ("/plain", {"slug": "x"}, None),
        (None, {"slug": "x"}, None),
    ],
)
def test_route(spark, page, query, want):
    t = spark.createDataFrame([(page, query, "https://e.org/any")], "page string, query map<string,string>, url string")
    assert t.select(u.stable_url_from_route("page", "query", "url").alias("s")).first()["s"] == want


def test_url_predicates(spark):
    values = [None, "", "https://e.org", "https://e.org/", "https://e.org/?p=1", "https://e.org/post", "ftp://e.org/x", "bad", "https://e.org/?utm_source=a", "https://e.org/a/"]
    assert column(spark, values, u.is_root_url) == [True, True, True, True, False, False, False, False, False, False]
    assert column(spark, values, u.is_safe_stable_url) == [False, False, False, False, True, True, False, False, False, True]
    assert column(spark, values, lambda c: u.is_safe_stable_url(c, True)) == [False, False, False, False, True, True, False, False, False, False]
    assert column(spark, ["https://a.b.org./x", "http://b.org/", "https://xb.org/", None], lambda c: u.is_remote_url(c, ["b.org"])) == [True, False, False, False]
    assert column(spark, ["https://a.org:443/x", "http://a.org/x", None], lambda c: u.has_same_origin(c, F.lit("https://a.org/y"))) == [True, False, False]


RAW = {
    None: "", "": "", "see https://u:p@e.org/a?token=abc&x=1#f now": "see https://e.org/a?token=[REDACTED_TOKEN]&x=1 now", "Authorization: Bearer abc.def-1==": "Authorization: [REDACTED_AUTH_HEADER]",
    "eyJabc.def.ghi and eyJab.c": "[REDACTED_JWT] and eyJab.c", "sk-abcdefghij0123456789xyz": "[REDACTED_API_KEY]", "secret_abc123 x": "[REDACTED_TOKEN] x", "mail john.doe@mail.example.com!": "mail j***.com!",
    "id 123e4567-e89b-12d3-a456-426614174000.": "id 123e4567***.",
}


def test_redaction(spark):
    assert column(spark, list(RAW), lg.redact_text) == list(RAW.values())


def test_masks_and_stacks(spark):
    assert column(spark, [None, "", "12345678", "123456789"], lg.mask_string) == ["[empty]", "[empty]", "***", "1234***6789"]
    assert column(spark, [None, "at f (/home/x/y/app.js:1:2)\nat g"], lg.redact_stack) == ["", "at f (app.js:1:2)\nat g"]


def test_canonical_json(spark):
    assert column(spark, ['{"b":1,"a":{"d":[2,1],"c":null}}', "[1, 2]", "{bad"], canonical_json) == ['{"a":{"c":null,"d":[2,1]},"b":1}', "[1,2]", "{bad"]


def test_text_cuts(spark):
    long = "A first sentence. " + "w" * 30 + ". tail " + "z" * 30
    assert column(spark, [None, "", "short", long], lambda c: p.split_text(c, 60)) == [[""], [""], ["short"], ["A first sentence. " + "w" * 30 + ".", "tail " + "z" * 30]]
    assert column(spark, [None, "", "abcde"], lambda c: p.chunk_fixed(c, 2, 2)) == [[], [], ["ab", "cd"]]
    assert column(spark, [None, "a\n\n  long enough text \n\n\nagain long enough"], p.text_to_paragraphs) == [[], ["long enough text", "again long enough"]]
    assert column(spark, ["any", "180x180", "32", "", None, "x"], p.parse_icon_size) == [999, 180, 32, 0, 0, 0]
    assert column(spark, ["a.jpg 1x, b.jpg 2x", "a.jpg 300w, b.jpg 900w, c.jpg 900w", "data:x, d.jpg", None], p.best_srcset_url) == ["b.jpg", "b.jpg", "d.jpg", None]


def test_next_eligible(spark):
    got = column(spark, ["daily", "weekly", "x"], lambda c: F.date_format(y.next_eligible_at(c, F.lit("2024-01-30 10:00:00")), "yyyy-MM-dd"))
    assert got == ["2024-01-31", "2024-02-06", "2024-02-29"]


def test_odd_pages():
    for page in (None, "", "<", "<p>open", "</div>", "<b>" * 200):
        assert isinstance(h.page_rows(page), list) and isinstance(h.element_rows(page), list)


def test_deep_pages():
    n = 100_000
    rows = h.element_rows("<div>" * n + " x <script>no</script>\n")
    assert len(rows) == n + 1 and rows[0][4] == 1 and rows[-1][4] == 2
    assert len(h.element_rows("<i>" + "</b>" * n)) == 1
    rows = h.page_rows("<div>" * n + "x")
    assert len(rows) == n + 1 and rows[0][7:9] == (1, n + 1)


def test_match_highlights(spark):
    blocks = spark.createDataFrame([(1, 0, "x cat  sat. cat sat!"), (1, 1, "the cat sat"), (2, 0, "cat sat")], "page_id long, pos int, text string")
    hl = spark.createDataFrame([(1, "a", "cat sat", "sat. ", "!"), (1, "b", "dog", "", ""), (2, "c", "cat\nsat", "zz", ""), (1, "d", "the cat", "", "")], "page_id long, id string, text string, prefix string, suffix string")
    got = {(r["page_id"], r["highlight_id"]): (r["pos"], r["start"]) for r in p.match_highlights(blocks, hl).collect()}
    assert got == {(1, "a"): (0, 11), (1, "d"): (1, 0)}
