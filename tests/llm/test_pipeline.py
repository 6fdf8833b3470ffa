"""Each stage of the pipeline on its own input, against what its decisions must come to."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from ledgerline.llm import dedup, mixing  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    clean = corpus_pipeline.drop_toxic(spark, docs, FOLDER).cache()
    assert clean.columns == columns and 0.8 * rows < clean.count() <= rows
    once = corpus_pipeline.drop_near_copies(spark, clean, FOLDER).cache()
    classes = dedup.classes(clean)
    assert {r.doc_id for r in once.collect()} == {r.class_id for r in classes.collect()}
    private = corpus_pipeline.redact_pii(spark, once, FOLDER).cache()
    assert private.count() == once.count() and private.columns == columns
    assert private.filter(F.col("text").rlike(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+")).count() == 0
    mixed = corpus_pipeline.mix_sources(spark, private, FOLDER).cache()
    chosen, sized = mixing.mix(private)
    assert mixed.columns == columns
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == chosen.taken(sized).agg(F.sum("taken")).first()[0]
    packed = corpus_pipeline.pack_sequences(spark, mixed, FOLDER)
    assert packed.filter("piece = 0").count() == mixed.count()
    fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert fill.filter("n > 4096 or n <> end").count() == 0
