import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm.set_join import keep_one


def test_stages_in_order(spark, documents, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "mixture", "tokens"]
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{i}")
        docs = seen[name] = spark.read.parquet(f"{tmp_path}/{i}")
        if i < 4:
            assert docs.dtypes == documents.dtypes
    ids = {name: {r["doc_id"] for r in df.collect()} for name, df in seen.items()}
    assert not ids["language"] & {120, 121, 122} and len(ids["language"]) > 60
    assert ids["lines"] == ids["language"]
    assert seen["lines"].where("n_chars <> char_length(text)").count() == 0
    assert ids["near_duplicates"] < ids["lines"] and not ids["near_duplicates"] & {100, 101, 102, 103, 104}
    again = keep_one(seen["near_duplicates"])
    assert again.count() == seen["near_duplicates"].count()
    assert ids["mixture"] <= ids["near_duplicates"]
    most = seen["mixture"].groupBy("doc_id", "text").count().agg(F.max("count")).first()[0]
    assert most <= 2
    assert seen["tokens"].count() == seen["mixture"].count()
    assert seen["tokens"].where("not decodes or n_tokens < 1").count() == 0


@pytest.mark.parametrize("kind", ["clashing", "empty"])
def test_odd_tables(spark, request, tmp_path, kind):
    table = request.getfixturevalue(kind)
    table.select(*[c for c in table.columns if c not in ("ID", "N")]).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (kind == "empty")
