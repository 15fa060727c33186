"""The backoff automaton against a model written out with tuples and dictionaries."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import lm_scoring


def tokens_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words] + [None]  # None: the end


def brute_force(rows):
    """{row number: (n_tokens, n_known, base, score)}; rows: (id, text, trains)."""
    one, two, three, starts = (collections.Counter() for _ in range(4))
    for _, text, trains in rows:
        if trains:
            padded = ["<start>", *tokens_of(text)]
            starts["<start>"] += 1
            one.update(padded[1:])
            two.update(zip(padded, padded[1:]))
            three.update(zip(padded, padded[1:], padded[2:]))
    n, v = sum(one.values()), len(one)
    history = one + starts
    c2, c3 = lm_scoring.CONCENTRATION

    def p1(w):
        return (one[w] + 1) / (n + v + 1)

    def p2(h, w):
        return (two[(h, w)] + c2 * p1(w)) / (history[h] + c2)

    def p3(g, h, w):
        return (three[(g, h, w)] + c3 * p2(h, w)) / (two[(g, h)] + c3)

    out = {}
    for k, (_, text, _) in enumerate(rows):
        padded = ["<start>", *tokens_of(text)]
        score = math.log10(p2("<start>", padded[1])) + sum(math.log10(p3(*padded[i - 2 : i + 1])) for i in range(2, len(padded)))
        base = sum(math.log10((one[w] + 1) / (n + 1 * (v + 1))) for w in padded[1:])
        out[k] = (len(padded) - 1, sum(one[w] > 0 for w in padded[1:]), n, base, score)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    vocabulary = ["the", "The", "of", "and", "é", "cat", "sat", "on", "mat", "🙂"] + [f"w{k}" for k in range(60)]
    weights = [30, 5, 20, 20, 5, 5, 5, 5, 5, 2] + [1] * 60
    texts = [" ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 60))) for _ in range(150)]
    texts += texts[:12] + [None, "", " \t\n", "the cat sat on the mat\n" * 400, "only once in here"]
    return [(k, t, zlib.crc32(str(k).encode()) % 7 != 2) for k, t in enumerate(texts)]


@pytest.mark.parametrize("shard_tokens, lane", [(10**6, 512), (700, 3)])
def test_scores_equal_brute_force(spark, rows, monkeypatch, shard_tokens, lane):
    monkeypatch.setattr(lm_scoring.Automaton.walk, "__defaults__", (lane,))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string").repartition(5)
    out = lm_scoring.score_documents(docs, lm_scoring.training_rows(), shard_tokens=shard_tokens).collect()
    want = brute_force(rows)
    assert len(out) == len(rows)
    for r in out:
        n, known, train, base, score = want[r["id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["trains"]) == (n, known, train, rows[r["id"]][2])
        assert r["base_score"] == pytest.approx(base, abs=1e-8)
        assert r["score"] == pytest.approx(score, abs=1e-8)


def test_probabilities_of_a_state_add_up_to_one(rows):
    """Arcs and failure arcs of every reachable state, over a block that holds the whole vocabulary."""
    import pyarrow as pa

    texts = [t or "" for _, t, _ in rows] + [" ".join({w for _, t, _ in rows for w in (t or "").split()})]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([True] * len(texts))], names=["id", "text", "trains"])

    class Context:
        @staticmethod
        def partitionId():
            return 0

    original = lm_scoring.TaskContext.get
    lm_scoring.TaskContext.get = staticmethod(lambda: Context)
    try:
        (row,) = next(iter(lm_scoring._tokenise([batch]))).to_pylist()
    finally:
        lm_scoring.TaskContext.get = original
    block = lm_scoring.Block(row)
    counts = np.frombuffer(row["word_counts"], np.int64)
    together = np.bincount(block.pair, minlength=len(block.word))
    block.trigrams(block.bigrams()[0])
    seen = collections.Counter()
    for a, n in zip(block.begin.tolist(), block.lengths.tolist(), strict=True):
        seen.update((block.pair[i - 1], block.token[i]) for i in range(a + 1, a + n))
    joint = np.array([seen[(c, t)] for c, t in zip(block.context.tolist(), block.third.tolist(), strict=True)])
    words = np.flatnonzero(np.arange(len(block.words)) != block.start)
    n, v = int(counts[words].sum()), int((counts[words] > 0).sum())
    model = lm_scoring.Automaton(block, counts, together, joint, n, v, (2.0, 3.0))
    for state in [*np.unique(model.next).tolist()[::3], model.first]:
        weight, _ = model.step(np.full(len(words), state), words)
        rest, at = 1.0, state  # what the failure arcs leave to the root, whose own rest is for unknown words
        while at:
            rest, at = rest * 10 ** model.fail_weight[at], model.fail_to[at]
        assert (10**weight).sum() == pytest.approx(1 - rest / (n + v + 1), abs=1e-9)


def test_long_text_is_one_walk(spark):
    text = "the cat sat on the mat and so on " * 120_000 + "x" * 1_000_000  # about 5 MB
    docs = spark.createDataFrame([(0, text), (1, text), (2, "the cat")], "doc_id long, text string")
    out = {r["id"]: r for r in lm_scoring.score_documents(docs, F.lit(True)).collect()}
    assert out[0]["n_tokens"] == out[0]["n_known"] == 120_000 * 9 + 2
    assert out[0]["score"] == out[1]["score"] > out[0]["base_score"]
