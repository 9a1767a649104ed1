"""Python helpers hold a bounded piece of what a task gets, however large its Arrow batches are."""

import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as h
from pagemill.functions import images as im
from pagemill.operators import pages as p
from pagemill.plans import registry
from pagemill.sources.staging import staged


class Frame:
    """Stands for a DataFrame and keeps the function that a task would run."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, schema):
        self.run = run
        return self


@pytest.mark.parametrize("texts", [False, True])
def test_rows_come_in_pieces(texts):
    html = "<p>" + "x" * 10_000 + "</p><b>y</b>"
    batch = pa.RecordBatch.from_pydict({"page_id": pa.array(range(200), pa.int64()), "html": [html] * 199 + [None]})
    made = list(p.explode_nodes(Frame(), texts).run(iter([batch, batch])))
    assert max(b.num_rows for b in made) <= 4 * (1 + p.PIECE_CHARS // len(html))
    assert sum(b.num_rows for b in made) == 2 * 199 * (4 if texts else 2)
    assert [x for b in made for x in b.column(0).to_pylist()] == [i for _ in range(2) for i in range(199) for _ in range(4 if texts else 2)]


def test_trees_go_at_once(monkeypatch):
    class Held(h.Node):
        __slots__ = ()

    monkeypatch.setattr(h, "Node", Held)
    gc.disable()
    try:
        for read in (h.element_rows, h.page_rows, h.visible_text):
            read("<div><p>a<b>c</b></p></div>")
            assert not [o for o in gc.get_objects() if type(o) is Held]
    finally:
        gc.enable()


@pytest.mark.parametrize("n", [1, 250, 2501])
def test_columns_over_pieces(spark, n):
    """More rows than a piece, of whole batches and of parts, come back at their own rows."""
    t = spark.range(0, n, 1, 2).withColumn("t", F.when(F.col("id") % 7 > 0, F.concat(F.lit("<p>&amp;"), F.col("id").cast("string"), F.lit("</p>"))))
    got = t.select("id", p.html_to_text(F.col("t")).alias("x"), p.split_text(F.col("t")).alias("s"), im.clean_image_urls(F.when(F.col("t").isNotNull(), F.array(F.concat(F.lit("http://a.example/"), "id"), F.lit(None).cast("string")))).alias("u")).collect()
    for r in got:
        some = r["id"] % 7 > 0
        assert r["x"] == (f"&{r['id']}" if some else "")
        assert r["s"] == ([f"<p>&amp;{r['id']}</p>"] if some else [""])
        assert r["u"] == ([f"https://a.example/{r['id']}", None] if some else None)
    assert len(got) == n


def test_long_texts_are_split_in_linear_time(spark):
    text = "ab cd. " * 3_000_000 + " \n "
    parts = spark.createDataFrame([(text,)], "t string").select(F.explode(p.split_text(F.col("t"))).alias("c")).agg(F.count("*"), F.max(F.char_length("c")), F.sum(F.char_length(F.replace("c", F.lit(" "))))).first()
    assert parts[1] <= 2000 and parts[2] == 5 * 3_000_000


def test_tables_are_written_from_bounded_batches(spark):
    """A task that gets 60 rows of a megabyte doesn't get them in one Arrow batch, and the session's own bound is kept."""
    rows = lambda batches: (pa.RecordBatch.from_pydict({"n": pa.array([b.num_rows], pa.int64()), "mb": pa.array([b.nbytes >> 20], pa.int64())}) for b in batches)
    wide = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("t")).mapInArrow(rows, "n long, mb long")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    got = staged(wide, "wide").agg(F.sum("n"), F.max("mb")).first()
    assert got[0] == 60 and got[1] <= 10
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


@pytest.mark.parametrize("name", ["b8_image_sources", "b8_image_blocks", "b8_cover_images", "a9_cover_metrics", "a9_image_metrics", "b8_extract_images", "b2_main_container", "w3_best_content_container", "b4_markdown_container"])
def test_pages_are_read_once(spark, name):
    """Branches of a plan read the written elements, not the pages."""
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "staged/elements-" in plan
