"""Main containers, styled spans, lead blocks, payloads and structured articles on small written tables."""

from pyspark.sql import functions as F

from pagemill.operators import assembly as a
from pagemill.operators import content as c
from pagemill.operators import pages as p
from pagemill.operators import structured as st

RICH = "page_id long, pos int, type string, rich_text array<struct<content:string,style:string,annotation:string>>"


def nodes(spark, *pages):
    return p.explode_nodes(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string"))


def test_main_containers(spark):
    text = "word " * 60
    rows = c.main_container(
        nodes(
            spark,
            f"<article>short</article><main><article><p>{text}</p></article></main>",
            f"<h2>List</h2><ul>{'<li>one item</li>' * 4}</ul><ol>{'<li>x</li>' * 3}</ol>",
            f"<div class='a  entry-content'>short</div><div class='content'>{text}</div>",
            f"<div class='node__content'><div class='field--name-field-body'>x</div></div><article>{text}</article>",
            f"<div><div>{text}<a>1</a></div></div><div>{text}{text}</div>",
            "<p>nothing</p>",
            None,
        )
    )
    got = {r["page_id"]: (r["strategy"], r["tag"], r["heading_id"] is not None) for r in rows.collect()}
    assert got == {0: ("article", "article", False), 1: ("list", "ul", True), 2: ("cms", "div", False), 3: ("drupal", "div", False), 4: ("generic", "div", False)}
    assert c.markdown_container(nodes(spark, "<p id=readme>x</p><div class='prose'>y</div>", "<p>z</p>")).select("page_id", "tag").collect() == [(0, "div")]


def test_spans_that_overlap_and_runs_without_text(spark):
    blocks = spark.createDataFrame([(1, 0, "paragraph", [("abcde", "x", None), ("", "x", None), ("fghij", "y", None)]), (1, 1, "paragraph", [("", "x", None)]), (2, 0, "divider", None)], RICH)
    spans = spark.createDataFrame([(1, 0, 3, 4, "one"), (1, 0, 3, 4, "one"), (1, 0, 4, 2, "within"), (1, 0, 6, 90, "two"), (3, 0, 0, 1, "lost")], "page_id long, pos int, start int, length int, annotation string")
    got = {(r["page_id"], r["pos"]): r["rich_text"] for r in a.style_spans(blocks, spans, ["style"]).collect()}
    assert [tuple(x) for x in got[1, 0]] == [("abc", "x", None), ("de", "x", "one"), ("fg", "y", "one"), ("hij", "y", "two")]
    assert [tuple(x) for x in got[1, 1]] == [("", "x", None)] and got[2, 0] is None


def test_highlights_of_pages_with_and_without_blocks(spark):
    blocks = spark.createDataFrame([(1, 4, "paragraph", [("a marked word", "x", None)])], RICH)
    hl = spark.createDataFrame([(1, "h", 0, "marked", "red", None, None), (2, "k", 0, "y" * 2500, None, None, None)], "page_id long, id string, ordinal int, text string, color string, prefix string, suffix string")
    for style, note in (("BOLD", "bold"), ("NONE", None)):
        got = sorted((r["page_id"], r["pos"], r["type"], [(x["content"][:20], x["annotation"]) for x in r["rich_text"]]) for r in a.merge_highlights(blocks, hl, style, ["style"]).collect())
        first = [("a ", None), ("marked", note), (" word", None)] if note else [("a marked word", None)]
        assert got[0] == (1, 4, "paragraph", first) and got[1:3] == [(1, 5, "heading_3", [(a.SECTION, "default")]), (1, 6, "paragraph", [("marked", "red")])]
        assert [x[:3] for x in got[3:]] == [(2, 0, "heading_3"), (2, 1, "paragraph"), (2, 2, "paragraph")]


def test_lead_blocks_and_payload_of_empty_tables(spark):
    blocks = spark.createDataFrame([], "page_id long, pos long, type string, text string, image_url string")
    meta = spark.createDataFrame([(1, None, ""), (2, "T" * 3000, "https://a/b.png")], "page_id long, title string, featured_image string")
    got = sorted((r["page_id"], r["pos"], r["type"], len(r["text"] or "")) for r in a.assemble_blocks(blocks, meta, include_title=True).collect())
    assert got == [(1, 0, "paragraph", len(a.NO_BLOCKS)), (2, 0, "image", 0), (2, 1, "heading_1", 2000), (2, 2, "paragraph", len(a.NO_BLOCKS))]
    pages = spark.createDataFrame([(1, None, None, "s", None, "", None)], "page_id long, url string, title string, source_id string, source_type string, site_icon string, cover_image string")
    r = a.build_page_payload(pages, blocks, []).first()
    assert (r["parent"]["type"], r["properties"]["title"], r["properties"]["url"], r["icon"], r["cover"], r["children"]) == ("data_source_id", a.UNTITLED, "", None, None, [])


def test_structured_articles(spark):
    rows = [(1, '{"initialArticle":{"content":5,"body":"<b>x</b>"}}'), (2, "{"), (3, None), (4, '{"props":{"pageProps":{"post":{"blocks":[]},"content":{"body":"later"}}}}'), (5, '{"initialArticle":{"body":{"a":1}}}'), (6, "[1]")]
    t = spark.createDataFrame(rows, "page_id long, data string").select("page_id", st.json_first_path(F.col("data")).alias("f"))
    assert {r["page_id"]: r["path"] for r in t.select("page_id", "f.path").collect()} == {1: "initialArticle", 2: None, 3: None, 4: "props.pageProps.post", 5: None, 6: None}
    got = st.structured_to_blocks(t.select("page_id", "f.article")).collect()
    assert [tuple(r) for r in got] == [(1, 0, "paragraph", "x", None)]
