from formweave.llm.common import table


def test_stages(spark, tmp_path):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    columns, n = docs.columns, docs.count()
    for k, (name, stage) in enumerate(p.STAGES):
        docs = stage(spark, docs, sf)
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(p.STAGES) - 1:
            assert docs.columns == columns
        if k < 3:
            assert docs.count() <= n
            n = docs.count()
    assert docs.count() > 0 and "shard" in docs.columns
