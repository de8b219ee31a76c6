import corpus_pipeline


def test_stages_on_small_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    assert len(corpus_pipeline.STAGES) == 5
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(i))
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if i < 4:
            assert docs.columns == columns
        if i == 2:  # one document of each group is left
            assert docs.groupBy("text").count().where("count > 1 and length(text) > 100").count() == 0
    total = before.count()
    assert docs.select("sequence_id", "offset").distinct().count() == docs.count() >= total


def test_empty_documents_go_through(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    assert docs.count() == 0


def test_near_duplicates_of_four_fifths_go(spark):
    """Pairs with a likeness of 0.80 and 0.82, below op5's threshold; bands follow the threshold."""
    from latentia.llm import near_dedup

    rows = []
    for i in range(40):
        w = [f"d{i}w{j}" for j in range(94)]  # 90 shingles, of which 9 or 10 fall out
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: -9 - i % 2] + [f"d{i}x{j}" for j in range(9 + i % 2)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()) == list(range(0, 80, 2))
    assert near_dedup.near_groups(df).where("not kept").count() == 0
    assert [near_dedup.band_rows(t) for t in (80, 85)] == [4, 5]
