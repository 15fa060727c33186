"""Vector codes against a plain version in Python's own integers."""

import hashlib
import math
import os
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajlake.llm import vector_codes

DATA = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, id string, code int, error double, n int, v int, label_error int"


def plain(rows, entries=256, rounds=4):
    """rows: (id, vector, label) -> sorted (id, code, error, label_error, sha)."""
    out = []
    fine = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    sums = {}
    for length in {len(r[1]) for r in fine}:
        width = -(-length // 4)
        own = sorted((r for r in fine if len(r[1]) == length), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        cut = lambda v: [math.floor(1024 * Fraction(x)) for x in v] + [0] * (4 * width - length)  # noqa: E731, B023
        parts = [[cut(r[1])[p * width : (p + 1) * width] for p in range(4)] for r in own]
        book = [[list(v[p]) for v in parts[:entries]] for p in range(4)]

        def nearest(x, entries):
            far = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in entries]
            return far.index(min(far)), min(far)

        for _ in range(rounds):
            for p in range(4):
                found = [nearest(v[p], book[p])[0] for v in parts]
                for k in range(len(book[p])):
                    mine = [v[p] for v, f in zip(parts, found, strict=True) if f == k]
                    if mine:
                        book[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        sha = hashlib.sha256(",".join(str(c) for part in book for e in part for c in e).encode()).hexdigest()
        for r, v in zip(own, parts, strict=True):
            got = [nearest(v[p], book[p]) for p in range(4)]
            error = min(2**63 - 1, sum(g[1] for g in got))
            sums[r[2]] = sums.get(r[2], 0) + error
            out.append((r[0], "".join(f"{g[0]:02x}" for g in got), error, r[2], sha))
    return sorted(((i, c, e, min(2**63 - 1, sums[b]), s) for i, c, e, b, s in out), key=str)


def given(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2.0, 3, 4, 5) for r in rows], SCHEMA).repartition(3)


def result(frame, **more):
    return sorted((tuple(r) for r in vector_codes.compress(frame, **more).collect()), key=str)


def test_equals_plain_version(spark):
    rng = random.Random(3)
    rows = [(k, [rng.gauss(0, 0.3) for _ in range(8)], rng.choice([0, 0, 0, 1, None])) for k in rng.sample(range(1000), 150)]
    assert result(given(spark, rows), entries=20) == plain(rows, 20)
    assert result(given(spark, rows[:9])) == plain(rows[:9])


def test_odd_rows(spark):
    a, b = [0.5, -0.25, 0.001, -0.001, 1.0], [0.5, -0.25, 0.002, -0.001, 1.0]
    rows = [(1, a, 0), (2, a, None), (2, b, None), (2, b, None), (None, b, 0), (None, a, 1), (3, None, 0), (4, [1.0, None], 0), (5, [float("nan"), 1.0], 0), (6, [float("inf"), 1.0], 0), (7, [], 0), (8, [0.25], 2), (9, [0.75], 2), (10, a, 0)]
    assert result(given(spark, rows), entries=3) == plain(rows, 3)
    assert vector_codes.compress(given(spark, rows).limit(0)).collect() == []
    assert vector_codes.compress(given(spark, rows).where("vec_id in (3, 4, 5, 6)")).collect() == []


def test_large_components_stay_exact(spark):
    rows = [(1, [1e6, 0.0, 3e5, 1.0], 0), (2, [1e6 + 1, 0.5, -3e5, 1.0], 0), (3, [0.1, 0.2, 0.3, 0.4], 0), (4, [2.0**40, 0.2, 0.3, 0.4], 0), (5, [-(2.0**45), 0.2, 0.3, 0.4], 1)]
    assert result(given(spark, rows), entries=2, rounds=2) == plain(rows, 2, 2)
    most = result(given(spark, [*rows, (6, [1e308, -1e308, 0.0, 0.0], 1)]), entries=2)
    assert len(most) == 6 and max(r[2] for r in most) == 2**63 - 1


def test_repeats_count_and_ties_go_to_the_lower_entry(spark):
    rows = [(k, [0.5, 0.5, 0.5, 0.5], 0) for k in range(300)]
    out = vector_codes.compress(given(spark, rows))
    assert {(r["code"], r["error"]) for r in out.collect()} == {("00000000", 0)}


def test_very_long_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(k, rng.normal(0, 1, 5_000).tolist(), k % 2) for k in range(12)]
    assert result(given(spark, rows), entries=4, rounds=1) == plain(rows, 4, 1)


def test_decode_is_within_the_error(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(0, 0.2, 8).tolist(), 0) for k in range(60)]
    frame = vector_codes.usable(given(spark, rows), "vec_id", "embedding", "label")
    book = vector_codes.fit(frame, 8, 16)
    back = vector_codes.decode(vector_codes.encode(frame, book, 8), book, 8).collect()
    whole = {r[0]: np.floor(np.array(r[1]) * 1024) for r in rows}
    for r in back:
        assert round(float(((np.array(r["v"]) * 1024 - 0.5 - whole[r["id"]]) ** 2).sum())) == r["error"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_table(spark):
    table = spark.read.parquet(f"{DATA}/embeddings.parquet")
    rows = [tuple(r) for r in table.select("vec_id", F.col("embedding").cast("array<double>"), "label").collect()]
    assert result(table) == plain(rows)
