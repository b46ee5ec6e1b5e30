import corpus_pipeline
from tallymark.llm import queries


def test_every_operator_has_its_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES if k.startswith("op")) == list(range(1, 11))
    assert "pipeline" in queries.QUERIES and len(corpus_pipeline.STAGES) == 5


def test_stages_take_effect(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, before, sf_dir).cache()
        assert after.columns == docs.columns
        assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "substring dedup":
            assert after.count() == before.count()
        else:  # on its own each filter rejects something here; after the rules the classifier may have nothing left to reject
            assert 0 < stage(spark, docs, sf_dir).count() < docs.count()
        before = after
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    short = docs.where("size(filter(split(text, '[ \\\\x09-\\\\x0D]+'), w -> w <> '')) < 20")
    clean = labels.where("quality = 1").join(docs, "doc_id", "left_semi").join(short, "doc_id", "left_anti")
    two = corpus_pipeline.STAGES[1][1](spark, corpus_pipeline.STAGES[0][1](spark, docs, sf_dir), sf_dir)
    assert clean.join(two, "doc_id", "left_anti").count() <= 0.1 * clean.count()


def test_run_packs_every_kept_document(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").cache()
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024").count() == 0
    assert out.where("piece = 0").count() == out.select("doc_id").distinct().count()


def test_empty_table(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0


def test_tiny_texts_alone_in_their_partition(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, text in enumerate(["", "a", "ab", " ", None]):
        tiny = spark.createDataFrame([(10_000 + k, text, "en", "web", 0)], docs.schema)
        docs = docs.unionByName(tiny)  # a partition of its own, so a slice of its own in every scan
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    more = spark.createDataFrame([(10_000 + k, 0, 0) for k in range(5)], labels.schema)
    labels.unionByName(more).write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        assert 0 < stage(spark, docs, str(tmp_path)).count() < docs.count()
