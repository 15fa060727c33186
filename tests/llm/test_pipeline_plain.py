"""The pipeline stage by stage against plain versions, on the smallest given table: rules in SQL, near-duplicates by all
pairs, base secrets by regular expressions, packing by the tokenizers library."""

import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trajlake.llm import oracle, quality_classifier
from trajlake.llm.queries import word_tokenizer

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """The rows after each stage, written and read again as run() does."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append(docs)
    return out


def texts(frame):
    return {r["doc_id"]: r["text"] for r in frame.select("doc_id", "text").collect()}


def test_rules_keep_what_the_sql_keeps(staged):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = {r[0] for r in con.execute(f"SELECT doc_id FROM ({oracle.ORACLE_SQL['op3_quality_rules']}) WHERE kept").fetchall()}
    assert set(texts(staged[0])) == want


def test_classifier_drops_what_scores_low(spark, staged):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    features = quality_classifier.document_features(staged[0])
    model = quality_classifier.fit(features, quality_classifier.training_labels(labels))
    scores = {r["id"]: r["x"] for r in features.collect()}
    want = {i for i, x in scores.items() if model is None or float(model.score(np.array([x]))[0]) >= 0.5}
    assert set(texts(staged[1])) == want


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def test_near_duplicates_leave_one_of_each_group(staged):
    before, after = texts(staged[1]), texts(staged[2])
    sets = {i: shingles(t or "") for i, t in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    assert set(after) <= set(before) and all(after[i] == before[i] for i in after)
    kept = sorted(after)
    assert max((alike(a, b) for k, a in enumerate(kept) for b in kept[:k]), default=0) < 0.9
    for gone in set(before) - set(after):
        assert max(alike(gone, i) for i in before if i != gone) >= 0.6
    equal = defaultdict(set)
    for i, t in before.items():
        equal[t].add(i)
    assert all(len(group & set(after)) <= 1 for group in equal.values())


def test_base_secrets_are_masked_and_nothing_else_is_lost(staged):
    before, after = texts(staged[2]), {r["doc_id"]: (r["text"], r["n_chars"]) for r in staged[3].collect()}
    assert set(before) == set(after)
    for i, text in before.items():
        masked, n = after[i]
        assert n == len(masked)
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                assert m[2] not in masked
        for pattern, least in ((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)):
            assert not [m for m in re.findall(pattern, masked) if len(m) >= least]
        place = 0
        for part in masked.split("[SECRET]"):  # what is left stands in the text, in order
            place = text.index(part, place) + len(part)


def test_packing_holds_every_id_once(staged):
    docs, pieces = texts(staged[3]), defaultdict(list)
    rows = staged[4].collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
    tokenizer = Tokenizer.from_file(word_tokenizer())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    assert set(pieces) == set(docs)
    for i, text in docs.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048


def test_run_gives_the_last_stage(spark, staged):
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = corpus_pipeline.run(spark, DATA).select(*columns)
    assert got.count() == staged[4].count()
    whole = lambda frame: {r["doc_id"]: r["n"] for r in frame.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert whole(got) == whole(staged[4])
