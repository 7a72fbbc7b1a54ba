import corpus_pipeline
from marlstone.llm.common import documents

DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = documents(spark, DIR)
    columns, left = docs.columns, docs.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"]
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, docs, DIR)
        out.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == documents(spark, DIR).dtypes
            assert docs.count() <= left
            left = docs.count()
    ids = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/3").select("doc_id").collect()}
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == ids and len(ids) == left > 50


def test_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
