import corpus_pipeline as pipeline


def test_stages_on_odd_documents(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(10, 1, 0), (16, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "pack":
                assert out.columns == docs.columns
            assert out.count() <= 3 * docs.count() + 100


def test_exact_and_near_leave_one_of_each_group(spark, odd_docs, tmp_path):
    exact = pipeline.exact(spark, odd_docs, str(tmp_path))
    ids = sorted(r["doc_id"] for r in exact.collect() if r["doc_id"])
    assert ids.count(10) == 1 and 11 not in ids and 12 in ids
    near = sorted(r["doc_id"] for r in pipeline.near(spark, exact, str(tmp_path)).collect() if r["doc_id"])
    assert 10 in near and 12 not in near and 20 not in near


def test_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert rows and all(sum(n for _, n in x) <= 2048 for x in by.values())
