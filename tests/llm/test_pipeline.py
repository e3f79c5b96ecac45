"""The pipeline stage by stage, and every query of the package on the small tables."""

import pytest

import corpus_pipeline
from stopwise.llm import packing
from stopwise.llm.common import stored
from stopwise.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_gives_rows(spark, folder, name):
    assert QUERIES[name](spark, folder).count() > 0


def test_stages_keep_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    whole = packing.encoder(packing.tokenizer_path()).whole
    tokens = sum(len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert last.agg({"length": "sum"}).first()[0] == tokens
    assert corpus_pipeline.run(spark, folder).count() == last.count()
