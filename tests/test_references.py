"""Queries and their SQL read references without a semicolon, and bare ampersands, by one rule."""

import duckdb
import pytest

from pagemill.plans import registry
from tests.test_queries import plain

TEXT = "Cut&amp;s of &copy and &quot;words&quot that &middot; a reader &amp;quot; sees, "
ENDS = ["&amp", "&am", "&a", "&", "&quot", "&quo", "&copy", "&middot", "&amp;", "x"]


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    rows = []
    for i in range(140):
        title = f"A title of the page &amp;&amp; {i} that holds sixty characters or more{ENDS[i % 10]}"
        html = f'<html><head><title>{title}</title></head><body><nav><ul><li><a href="/1">Menu one</a></li><li><a href="/2">Two</a></li></ul></nav><div class="ad">Ad {i}</div><article><h1>{title}</h1><p>{TEXT * (i % 7)}end.</p></article><footer>&copy; 2020 x &middot; y</footer></body></html>'
        rows.append((i, f"https://www.site.example/en/{i}", html))
    d = str(tmp_path_factory.mktemp("cut"))
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{d}/pages.parquet/*.parquet'")
    return d, c


@pytest.mark.parametrize("name", ["a8_page_metrics", "b11_extract_pages", "b11_page_blocks", "b1_extract_metadata", "b1_page_metadata", "b5_html_to_blocks", "f15_html_to_text", "f30_gate_html", "j13_match_highlights", "w3_best_content_container"])
def test_references_without_semicolon(spark, cut_pages, name):
    d, con = cut_pages
    got = registry.QUERIES[name](spark, d)
    rel = con.execute(registry.ORACLES[name])
    names = [x[0] for x in rel.description]
    want = sorted(tuple(plain(r[names.index(c)]) for c in got.columns) for r in rel.fetchall())
    assert want and sorted(tuple(plain(x) for x in r) for r in got.collect()) == want
