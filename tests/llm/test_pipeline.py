"""The pipeline's stages on awkward tables, and its decisions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import AWKWARD, SCHEMA, invented


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    texts = [(i, t, "en", s, n) for i, t, _, s, n in invented(200, 3, 60)]
    rows = texts + [(500 + i, t, "en", s, n) for i, t, _, s, n in texts[:20]] + [(900, None, "en", "s1", 0), (901, "12 !!", "en", "s1", 0)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0) for i, *_ in texts], "doc_id bigint, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_keeps_the_columns_and_handles_awkward_rows(spark, folder, tmp_path):
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        awkward = spark.createDataFrame(AWKWARD, SCHEMA).withColumns({n: F.lit(n) for n in ("score", "shard", "mix_id", "component_id")})
        found = stage(spark, awkward, folder)
        found.write.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert found.columns == awkward.columns, name
        assert stage(spark, awkward.limit(0), folder).count() == 0


def test_decisions_take_effect(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
    assert not {900, 901} & set(kept[0]) and len(kept[0]) == 220
    assert kept[1] == kept[0]
    assert not set(range(500, 520)) & set(kept[2]) and len(kept[2]) >= 190
    assert set(kept[3]) <= set(kept[2]) and kept[4] == kept[3]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == kept[4]
