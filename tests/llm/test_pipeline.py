import corpus_pipeline
from pagemill.llm import queries
from tests.llm.conftest import DOCS, rows
from tests.llm.test_models import texts


def test_stages_take_effect(spark, tmp_path):
    rng, vocab, base = texts(9, 300, 70)
    data = [x + "\nthe same line everywhere" if k % 2 else x for k, x in enumerate(base)]
    toxic = set(range(0, 300, 6))
    data = [x + " zorgle vexmoop zorgle" if k in toxic else x for k, x in enumerate(data)]
    data += [data[1], "more " + data[7], None]
    spark.createDataFrame(rows(data), DOCS).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        seen.append(spark.read.parquet(f"{tmp_path}/{name}"))
    clean, lines, unique, packed = seen[1:]
    assert all(t.columns == docs.columns for t in (clean, lines, unique))
    left = {r["doc_id"] for r in clean.collect()}
    assert len(toxic & left) <= 0.1 * len(toxic) and len(left - toxic) >= 0.98 * (303 - len(toxic))
    assert lines.where("text like '%the same line%'").count() == 0 and lines.count() == clean.count()
    ids = {r["doc_id"] for r in unique.collect()}
    assert {300, 301}.isdisjoint(ids) and {1, 7} <= ids
    assert packed.where("piece = 0").count() == unique.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_registered():
    names = set(queries.queries())
    assert "pipeline" in names and len([x for x in names if x.startswith("op")]) == 13
    assert set(queries.oracle_sql()) <= names
