"""Every stage of the pipeline on odd tables: empty, nulls, repeated rows, further columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

LABELS = "doc_id long, quality int, toxic int"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row string, node int, x int, kept boolean, block int"
GOOD = "The quick brown fox jumps over the lazy dog while seventeen other animals watch it from behind a small green hedge nearby and cheer. "


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)] + [(None, 1, 0), (3, None, None)], LABELS).write.parquet(str(path / "labels.parquet"))
    more = ("i", "r", 1, 2, True, 3)
    rows = [(k, GOOD + f"Number {k} is here with words of its own {k * 7} {k * 11}.", "en" if k % 2 else None, "s", 9, *more) for k in range(1, 30)]
    rows += [(31, None, "en", "s", None, *more), (32, "", "en", "s", 0, *more), (33, "### $$$", "fr", "s", 7, *more), rows[0], (None, GOOD + "No id here but words enough.", "en", None, 1, *more), (None, None, None, None, None, *more), (34, GOOD + 'password = "hunter2222x"', "en", "s", 1, *more)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(path / "documents.parquet"))
    return str(path)


@pytest.mark.parametrize("k", range(5))
def test_stage_cases(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = stage(spark, docs, folder)
    n = out.count()
    if k < 4:
        assert out.columns == docs.columns and 0 < n <= docs.count()
    assert stage(spark, docs.limit(0), folder).count() == 0
    if name == "quality_rules":
        assert out.where("text is null OR text = ''").count() == 0 and out.where("doc_id = 1").count() == 2 and out.where("doc_id is null").count() == 1
    if name == "near_dedup":
        assert out.where("text is null OR text = ''").count() == 1 and out.where("doc_id = 1").count() == 1
    if name == "secret_scan":
        assert n == docs.count() and out.where("text is null").count() == 2 and out.where(F.contains("text", F.lit("hunter"))).count() == 0
        assert out.where("text is null AND n_chars is not null").count() == 0
        plain = stage(spark, docs.drop("n_chars"), folder)
        assert plain.columns == docs.drop("n_chars").columns and plain.count() == n
    if name == "packing":
        assert out.agg(F.count_distinct(F.coalesce("doc_id", F.lit(-1)))).first()[0] == 34 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_stages_without_labels(spark, folder, tmp_path):
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.apply_quality_classifier(spark, docs, str(tmp_path)).count() == docs.count()
    assert 0 < corpus_pipeline.apply_quality_rules(spark, docs, str(tmp_path)).count() < docs.count()


def test_whole_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
