"""The factorization machine: its terms and sums against plain loops, held-out labels, odd tables."""

import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajlake.llm import queries, toxicity
from trajlake.llm.textops import as_strings

DATA = "/root/testdata/sf0.1"
SCHEMA = "doc_id long, text string, lang string, source string, id string, y int, toxic int, terms string, index int, shard int"
LABELS = "doc_id long, quality int, toxic int"


def plain_terms(text):
    """(word or stem, level) pairs of a text, each once."""
    words = [w for w in re.split(rb"[^0-9A-Za-z\x80-\xff]+", text.lower().encode()) if w]
    out = set()
    for kind, counts in (("w", Counter(words)), ("s", Counter(w[: toxicity.STEM] for w in words if len(w) > toxicity.STEM))):
        out |= {(kind, k, level) for k, n in counts.items() for level in range(min(n, toxicity.LEVELS))}
    return out


TEXTS = ["", "one", "One ONE one one two", "stupid$$$ a-b; stupid", "réeuxou réeuxvi RÉEUX réeux", "no\nlines\n\tétat 日本語テキスト 🙂 zz", "x" * 3000 + " x", " ".join(f"w{k % 40}" for k in range(500))]


def test_terms_are_those_of_plain_loops():
    found, at = toxicity.terms(as_strings(pa.array([None, *TEXTS])))
    names = {}
    for k, text in enumerate(["", *TEXTS]):
        own = set(found[at[k] : at[k + 1]].tolist())
        assert len(own) == at[k + 1] - at[k] == len(plain_terms(text))
        one, _ = toxicity.terms(as_strings(pa.array([text])))
        assert set(one.tolist()) == own
    for text in TEXTS:  # the same term is the same number in every text, others differ
        for term in plain_terms(text):
            names.setdefault(term, set())
    everything = set().union(*[plain_terms(t) for t in TEXTS])
    assert len(set(found.tolist())) == len(everything)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    model = toxicity.ToxicModel(np.arange(30), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    rows = [[], [3], [1, 5, 7, 29], list(range(12))]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    got = model.margin(np.array([i for r in rows for i in r], np.int64), at)
    for value, r in zip(got, rows, strict=True):
        want = 0.3 + sum(model.weights[i] for i in r) + sum(model.factors[i] @ model.factors[j] for i in r for j in r if i < j)
        assert abs(value - want) < 1e-9


def test_learns_a_pair_that_no_weights_can_tell(spark):
    """Toxic: an insult with a group, or a greeting without one.  Any sum of weights gives one of the four cases away."""
    cases = [("insult group", 1)] * 4 + [("insult", 0)] * 3 + [("group greeting", 0)] * 2 + [("greeting", 1)]
    rows = [(k, f"{cases[k % 10][0]} filler{k % 3}", "en", "s", "z", 1, 2, "t", 3, 4) for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 0, cases[k % 10][1]) for k in range(3000)], LABELS)
    model = toxicity.fit(docs, toxicity.training_labels(labels))
    out = toxicity.score(docs, model).collect()
    held = [r for r in out if zlib.crc32(str(r["id"]).encode()) % 3 == 1]
    assert np.mean([(r["score"] >= 0.5) == cases[r["id"] % 10][1] for r in held]) > 0.99
    model.factors[:] = 0
    weights = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r["id"]).encode()) % 3 == 1]
    assert np.mean([(r["score"] >= 0.5) == cases[r["id"] % 10][1] for r in weights]) <= 0.91


def test_odd_rows(spark):
    texts = [None, "", "stupid " * 5, "fine words here", "fine words here", "é日🙂", "stupid idiot " * 20_000]
    rows = [(k if k < 6 else None, t, "en", "s", "z", 1, 1, "t", 1, 2) for k, t in enumerate(texts)]
    rows += [rows[3], *[(100 + k, "you stupid thing" if k % 5 == 0 else "a nice day", "en", "s", "z", 1, 0, "t", 1, 2) for k in range(200)]]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    marks = [(100 + k, 1, int(k % 5 == 0)) for k in range(200)] + [(100, 1, 1), (101, 0, 1), (None, 1, 1), (2, None, None), (3, 1, 7)]
    labels = spark.createDataFrame(marks, LABELS)
    out = toxicity.toxicity(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r["id"]: r for r in out}
    assert by[0]["score"] == by[1]["score"] and all(0 <= r["score"] <= 1 for r in out)
    assert by[None]["predicted"] == by[2]["predicted"] == 1 and by[3]["predicted"] == by[5]["predicted"] == 0
    assert len({r["score"] for r in out if r["id"] in (3, 4)}) == 1
    again = {r["id"]: r["score"] for r in toxicity.toxicity(docs.repartition(1), labels.repartition(1)).collect()}
    assert all(abs(again[r["id"]] - r["score"]) < 1e-12 for r in out)
    for some in (labels.limit(0), labels.where("toxic = 1")):
        assert {r["score"] for r in toxicity.toxicity(docs, some).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).collect() == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_held_out_labels(spark):
    out = queries.op13_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = out.where("held_out").join(labels, "doc_id").select("score", "predicted", F.col("toxic").alias("y")).collect()
    toxic = [r for r in rows if r["y"] == 1]
    clean = [r for r in rows if r["y"] == 0]
    assert len(toxic) > 100 and sum(r["predicted"] for r in toxic) / len(toxic) > 0.85
    assert sum(r["predicted"] for r in clean) / len(clean) < 0.005
