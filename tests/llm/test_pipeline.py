import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.tables import awkward, empty, jaccard_labels


def test_stages_follow_each_other_and_keep_what_they_should(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "n-gram Jaccard join", "PII", "best-fit packing"]
    kept = corpus_pipeline.without_toxic(spark, docs, sf_dir).cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    lost = docs.join(kept, "doc_id", "left_anti").join(labels, "doc_id")
    assert kept.columns == docs.columns and lost.where("toxic = 0").count() <= 0.02 * docs.count()
    unique = corpus_pipeline.without_copies(spark, kept, sf_dir).cache()
    plain = F.regexp_replace("text", "[ \t-\r]+", " ")
    assert unique.count() == kept.select(plain).distinct().count()
    near = corpus_pipeline.without_near_copies(spark, unique, sf_dir).cache()
    want = jaccard_labels({r.doc_id: r.text for r in unique.collect()}, 5, 80, 100)
    assert {r.doc_id for r in near.collect()} == {i for i, (_, c) in want.items() if i == c}
    clean = corpus_pipeline.without_personal_data(spark, near, sf_dir).cache()
    assert clean.columns == docs.columns and clean.count() == near.count()
    assert clean.where(F.col("text").rlike("[a-z0-9]@mail[0-9]+[.]example[.]com")).count() == 0
    pieces = corpus_pipeline.packed(spark, clean, sf_dir)
    assert pieces.select("doc_id").distinct().count() == clean.count()


def test_run_equals_the_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    want = corpus_pipeline.packed(spark, docs, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_stages_take_awkward_and_empty_tables(spark, sf_dir):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns
            out.count()
        corpus_pipeline.packed(spark, docs, sf_dir).count()
