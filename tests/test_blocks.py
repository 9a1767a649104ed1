import time

import pytest

from pagemill.functions import html as h
from pagemill.operators import blocks as B

PAGE = """<html><head><title>T</title><script>var a='<p>x</p>'</script></head><body>loose<h1> One <b>two</b></h1><h5>five</h5><p>par <a href="https://x.example/a">link <i>it</i></a> end</p><p> </p><p></p>
<p> <img src="https://i.example/pic.jpg" alt="A"> <img src="https://i.example/pic2.png"></p><div style="display: none"><p>hid</p></div><p>a <span style="display:none">kept</span><br>b</p><blockquote>q <ul><li>in q</li></ul></blockquote>
<ul><li>a<ul><li>b<ol><li>c<ul><li>d <b>dd</b></li></ul></li></ol></li></ul></li><li>u<pre>  x = 1
</pre></li><li><p>pp</p><div>gone<p>kid</p></div></li><li></li></ul><pre class="language-py">out <code data-lang="rb"> y = 2 </code> z</pre><pre class="lang-nope"></pre><figure><img src="https://i.example/f.jpg" alt="alt"><figcaption> Cap <b>x</b> </figcaption></figure>
<hr><ol><li>n1<li>n2</ol><p>keep <code> c </code> </p><img src="data:image/png;base64,x"></body></html>"""


def rows(spark, *pages):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    return B.html_to_blocks(df).orderBy("page_id", "pos").collect()


def runs(r):
    return "|".join(x["content"] + ("<" + ",".join(s for s in B.STYLES if x[s]) + ">" if any(x[s] for s in B.STYLES) else "") + (f"({x['link']})" if x["link"] else "") for x in r["rich_text"])


@pytest.fixture(scope="module")
def page(spark):
    return rows(spark, PAGE)


def test_blocks_in_order(page):
    assert [(r["type"], runs(r), r["parent_pos"], r["depth"]) for r in page] == [
        ("heading_1", "One |two<bold>", None, 0), ("paragraph", "five<bold>", None, 0), ("paragraph", "par |link (https://x.example/a)|it<italic>(https://x.example/a)| end", None, 0), ("paragraph", " ", None, 0),
        ("image", "", None, 0), ("image", "", None, 0), ("paragraph", "a keptb", None, 0), ("quote", "q in q", None, 0),
        ("bulleted_list_item", "a", None, 0), ("bulleted_list_item", "b", 8, 1), ("numbered_list_item", "c", 9, 2), ("bulleted_list_item", "d |dd<bold>", 9, 2),
        ("bulleted_list_item", "u", None, 0), ("code", "x = 1", None, 0), ("bulleted_list_item", "pp", None, 0), ("paragraph", "kid", 14, 1), ("bulleted_list_item", " ", None, 0),
        ("code", "y = 2", None, 0), ("code", " ", None, 0), ("image", "", None, 0), ("divider", "", None, 0), ("numbered_list_item", "n1", None, 0), ("numbered_list_item", "n2", None, 0), ("paragraph", "keep | c <code>| ", None, 0),
    ]
    assert [r["pos"] for r in page] == list(range(len(page)))


def test_languages_images_captions(page):
    assert [r["language"] for r in page if r["type"] == "code"] == ["javascript", "ruby", "javascript"]
    assert [(r["image_url"], r["caption"]) for r in page if r["type"] == "image"] == [("https://i.example/pic.jpg", "A"), ("https://i.example/pic2.png", None), ("https://i.example/f.jpg", "Cap x")]
    assert all(r["image_url"] is None and r["caption"] is None for r in page if r["type"] != "image")


def test_limits_odd_and_deep_pages(spark):
    image = "".join(f'<img src="https://i.example/{k}.jpg">' for k in range(9))
    long = "<p> " + "x" * 1500 + "<b>" + "y" * 700 + "</b>tail</p>"
    got = rows(spark, None, "", "<", "<p>open", image, long, "<ul><li>a" * 2000, "<div>" * 50_000 + "<p> x ")
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append(r)
    assert sorted(by) == [3, 4, 5, 6, 7]
    assert [runs(r) for r in by[3]] == ["open"] and len(by[4]) == 6
    assert [len(x["content"]) for x in by[5][0]["rich_text"]] == [1500, 500]
    assert [(r["parent_pos"], r["depth"]) for r in by[6][:4]] == [(None, 0), (0, 1), (1, 2), (1, 2)] and {r["depth"] for r in by[6][3:]} == {2} and len(by[6]) == 2000
    assert [runs(r) for r in by[7]] == ["x"]


def test_rows_number_elements_and_texts():
    got = [(r[2], r[0], r[7], r[8], r[9], r[10]) for r in h.page_rows("<ul>x<li>a<b>c</b></li></ul>y")]
    assert got == [("ul", 1, 1, 6, "#root", None), ("#text", None, 2, 2, "ul", None), ("li", 2, 3, 6, "ul", None), ("#text", None, 4, 4, "li", 2), ("b", 3, 5, 6, "li", 2), ("#text", None, 6, 6, "b", 2), ("#text", None, 7, 7, "#root", None)]
    began = time.time()
    assert len(h.page_rows("<p>x " * 50_000)) == 100_000 and time.time() - began < 20


def test_truncate_runs(spark):
    runs_of = lambda data, n: [tuple(r) for r in B.truncate_runs(spark.createDataFrame(data, "page_id long, pos int, text string"), n).orderBy("page_id", "pos").collect()]
    data = [(1, 0, " \u00a0"), (1, 1, "  ab "), (1, 2, "cd  "), (1, 3, "\n"), (2, 0, " "), (2, 1, ""), (3, 0, "abcdef"), (3, 1, "gh")]
    assert runs_of(data, 5) == [(1, 1, "ab "), (1, 2, "cd"), (2, 0, " "), (3, 0, "abcde")]
    coded = spark.createDataFrame([(1, 0, "  x ", True), (1, 1, " y ", False)], "page_id long, pos int, text string, code boolean")
    assert [r["text"] for r in B.truncate_runs(coded).orderBy("pos").collect()] == ["  x ", " y "]
