"""Every operator on nulls, empty and repeated rows, odd texts, extra columns with clashing names, and empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from trajlake.llm import bpe_codec, embedding_dedup, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, secrets, sharding, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, id string, node int, text_crc32 long, row string, key int, kept boolean, block int, stratum string, n_words int"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    long = "word " * 3000 + "x" * 20000
    texts = [None, "", "", " \t\n", "one", "one two three", "é日🙂 \x0b\x1c ok", "same text here again and again " * 10, "same text here again and again " * 10, long, "Tok en=  password: hunter2222", "a\n\na\na b c d e f g h a b c d e f g h"]
    rows = [(k, t, None if k % 3 else "en", "z", 1, 2, "r", 3, True, 4, "s", 5) for k, t in enumerate(texts)]
    rows += [rows[4], (None, "no id", "en", *rows[0][3:]), (None, None, None, *rows[0][3:])]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 0, 0), (1, 1, 0), (2, None, None), (None, 1, 0), (7, 1, 0), (7, 1, 0), (9, 0, 1)], LABELS)


OPERATORS = {
    "near_dedup": lambda d, x: near_dedup.near_duplicates(d),
    "token_counts": lambda d, x: token_counts.token_counts(d, PIECES),
    "quality_rules": lambda d, x: quality_rules.quality_rules(d, x),
    "secrets": lambda d, x: secrets.digest(secrets.scan(d)),
    "bpe_codec": lambda d, x: bpe_codec.encode_digests(d, WORDS, long_text=1000),
    "sharding": lambda d, x: sharding.shuffle_shards(d, 5),
    "quality_classifier": lambda d, x: quality_classifier.classify(d, x),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, labels, name):
    out = OPERATORS[name](docs, labels).collect()
    assert len(out) == docs.count()
    empty = OPERATORS[name](docs.limit(0), labels.limit(0))
    assert empty.collect() == []


def test_lm_scoring_cases(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    out = lm_scoring.score_documents(stored, lm_scoring.training_rows())
    assert out.count() == docs.count()
    assert out.where("n_tokens = 1").count() == docs.where("text is null OR trim(translate(text, '\t\n', '  ')) = ''").count()
    untrained = lm_scoring.score_documents(stored, F.lit(False)).agg(F.max("n_known"), F.max("train_tokens")).first()
    assert tuple(untrained) == (0, 0)
    stored.limit(0).write.parquet(str(tmp_path / "e"))
    assert lm_scoring.score_documents(spark.read.parquet(str(tmp_path / "e")), lm_scoring.training_rows()).collect() == []


def test_packing_cases(docs):
    out = packing.pack(docs, WORDS, window=64, step=4)
    sums = out.groupBy("id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("id = 0").first()
    assert (sums["n"], sums["t"]) == (1, 1)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count("*").alias("k"), F.sum("offset").alias("o")).where("n > 64").count() == 0
    assert packing.pack(docs.limit(0), WORDS).collect() == []


def test_embedding_cases(spark):
    schema = "vec_id long, embedding array<float>, label int, node int, v int, label2 int"
    a, b = [1.0, 0.0, 0.0], [0.99, 0.05, 0.0]
    rows = [(1, a, 0), (2, b, 0), (3, a, 0), (4, a, 1), (5, a, None), (6, None, 0), (7, [0.0, 0.0, 0.0], 0), (8, [1.0, None, 0.0], 0), (9, [float("nan"), 1.0, 0.0], 0), (10, [1.0, 0.0], 0), (11, a, 0), (11, a, 0), (None, b, 0), (12, [], 0), (13, [float("inf"), 0.0, 0.0], 0)]
    frame = spark.createDataFrame([(*r, 9, 9, 9) for r in rows], schema)
    out = sorted((r["id"] if r["id"] is not None else -1, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicate_vectors(frame).collect())
    group = {1, 2, 3, 11, -1}
    for i, n, c, kept in out:
        assert (n, c) == ((5, 1) if i in group else (0, i)), i
        assert kept == (i == c)
    assert embedding_dedup.near_duplicate_vectors(frame.limit(0)).collect() == []


def test_filters_keep_columns(docs, labels):
    for out in (near_dedup.keep_one(docs), quality_rules.keep_good(docs, labels), quality_classifier.keep_good(docs, labels), secrets.redact(docs)):
        assert out.columns == docs.columns
        assert out.count() <= docs.count()
    kept = near_dedup.keep_one(docs).select("doc_id", "text").collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [0, 3, 4, 5, 6, 7, 9, 10, 11]
    assert [r["text"] for r in kept if r["doc_id"] is None] == ["no id"]
