import corpus_pipeline
from tests.llm.helpers import SCHEMA


def test_stages_chain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sf, size = "/root/testdata/sf0.001", docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
            assert out.dtypes == docs.dtypes, name
        assert out.count() > size // 3
        docs = out


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_oracles_of_the_operators(spark, sf_dir):
    from tessel.llm.queries import QUERIES, SQL
    from tests.oracle import connect, same

    con = connect(sf_dir)
    for name, sql in SQL.items():
        same(QUERIES[name](spark, sf_dir), con, sql)
