"""The pipeline's stages on their own and together, and the registered queries."""

import pytest

import corpus_pipeline
from tests.llm.conftest import SCHEMA, row, sentence


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory, corpus_rows):
    import random

    r = random.Random(20)
    item = sentence(r, 30)
    extra = [row(900, f"{sentence(r, 30)} {item} {sentence(r, 30)}"), row(901, "SHOUTING ALL THE WAY " * 20), row(902, f'{sentence(r, 20)} token = "0123456789abcdef0123456789abcdef"'), row(903, None)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(corpus_rows + extra, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), SCHEMA)
        assert docs.columns == SCHEMA.fieldNames()
        seen[name] = {x["doc_id"]: x["text"] for x in docs.collect()}
    assert 901 not in seen["quality"] and {900, 902, 903} <= set(seen["quality"])
    assert len(seen["near_duplicates"]) < len(seen["quality"]) and {900, 902, 903} <= set(seen["near_duplicates"])
    assert set(seen["near_duplicates"]) - set(seen["decontaminate"]) == {900}
    assert "[SECRET]" in seen["secrets"][902] and set(seen["secrets"]) == set(seen["decontaminate"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {x["doc_id"] for x in packed} == set(seen["secrets"])


def test_run_is_the_stages_one_after_the_other(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and 900 not in {x["doc_id"] for x in out} and 901 not in {x["doc_id"] for x in out}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, folder, odd, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, empty, folder).count() == 0
    assert stage(spark, odd, folder).count() > 0


def test_every_operator_has_its_query():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
