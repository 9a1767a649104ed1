from pyspark.sql import functions as F

from pagemill.functions import text as t
from tests.test_functions import column


def test_labels(spark):
    assert column(spark, ["#d4edda", "rgb(248, 215, 218)", "x", None], t.map_color) == ["green", "red", "yellow", "yellow"]
    assert column(spark, [" JS ", "python", "klingon", "", None], t.map_code_language) == ["javascript", "python", None, None, None]
    assert column(spark, ["COLOR_SYNC", "COLOR_TEXT", "BOLD", "NONE", None], lambda c: t.highlight_annotation(c, F.lit("pink"))) == ["yellow_background", "yellow", "bold", None, None]
    assert column(spark, ["a-b", "", None], lambda c: t.remote_url(c, F.lit(None).cast("string"), "https://r.example/")) == ["https://r.example/ab", None, None]


def test_titles(spark):
    assert column(spark, [None, "News", "A long headline here", "Other headline than that"], lambda c: t.is_title_consistent(c, F.lit("a LONG headline here | Site"))) == [True, True, True, False]
    assert column(spark, ["{title} - {url} {x}", None], lambda c: t.format_title(c, {"title": F.lit("T"), "url": F.lit("")})) == ["T - {url} {x}", None]
    assert column(spark, ["abc", "abcd", None], lambda c: t.truncate(c, 3)) == ["abc", "abc…", None]


def test_technical_terms(spark):
    got = column(spark, ["Go use the API, c++ and Java　now", "plain words only", "go gopher c++x", None, ""], lambda c: F.concat_ws("/", t.technical_terms(c)["term_count"].cast("string"), t.technical_terms(c)["word_count"].cast("string")))
    assert got == ["4/8", "0/3", "0/3", "0/0", "0/0"]
