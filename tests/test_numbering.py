"""Orders of whole tables: keys with a long common head, repeats and nulls, and strata of very different sizes."""

import random

import pytest
from pyspark.sql import functions as F

from trajlake.operators import numbering, sampling


@pytest.fixture
def uncoalesced(spark):
    names = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_keys_with_a_common_head_are_dealt_over_all_tasks(spark, uncoalesced):
    rows = spark.range(100_000).select(F.format_string("Customer#%012d", F.pmod(F.col("id") * 7919, F.lit(100_000))).alias("k"))
    parts = [r["n"] for r in numbering._dealt(rows, ["k"]).groupBy("_part").agg(F.count("*").alias("n")).collect()]
    assert len(parts) == 8 and max(parts) < 2 * 100_000 / 8
    out = numbering.numbered(rows, ["k"], "place")
    assert out.where(F.col("place") != F.substring("k", -12, 12).cast("long")).count() == 0 and out.count() == 100_000


def test_sums_and_places_with_nulls_and_repeats(spark, uncoalesced):
    rng = random.Random(4)
    data = [(rng.choice([None, "a", "b", *[f"k{k}" for k in range(30)]]), k, rng.randrange(100)) for k in range(600)]
    rows = spark.createDataFrame(data, "k string, id long, v long").repartition(5)
    want, total = {}, 0
    for n, (k, i, v) in enumerate(sorted(data, key=lambda r: (r[0] is not None, r[0] or "", r[1]))):
        total += v
        want[i] = (n + 3, total)
    got = {r["id"]: r["place"] for r in numbering.numbered(rows, ["k", "id"], "place", first=3).collect()}
    sums = {r["id"]: r["s"] for r in numbering.running_sum(rows, ["k", "id"], F.col("v"), "s").collect()}
    assert {i: (got[i], sums[i]) for i in got} == want
    same = numbering.numbered(rows.select(F.lit(1).alias("one")), ["one"], "place")  # every key is equal
    assert sorted(r["place"] for r in same.collect()) == list(range(600))
    assert numbering.numbered(rows.limit(0), ["k"], "place").collect() == []


def test_strata_and_turns_equal_plain_ranks(spark, uncoalesced):
    data = [(f"r{k}", "big" if k % 50 else "small") for k in range(3000)] + [("x", None), ("y", "other")]
    rows = spark.createDataFrame(data, "id string, s string")
    key = lambda i: __import__("hashlib").md5(f"{i}:9".encode()).hexdigest()
    for shares in ({"big": 40, "small": 7}, {"big": 5000, "small": 0, "none": 3}, {"none": 1}):
        want = {i for s, n in shares.items() for i in sorted([i for i, t in data if t == s], key=lambda i: (key(i), i))[:n]}
        assert {r["id"] for r in sampling.stratified_sample(rows, "s", shares, "id", 9).collect()} == want
    groups = {}
    for i, s in sorted(d for d in data if d[1]):
        groups.setdefault(s, []).append(i)
    want, k = {}, 0
    while any(groups.values()):
        for s in sorted(groups):
            if groups[s]:
                want[groups[s].pop(0)] = k
                k += 1
    assert {r["id"]: r["place"] for r in sampling.turn_order(rows.where("s is not null"), "s", "id").collect()} == want
