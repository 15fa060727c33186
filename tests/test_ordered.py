"""Ordered folds on shuffled streams in chunks and batches of any size against the batch operators."""

import random

import pytest
from pyspark.sql import functions as F

from trajlake.operators import inject
from trajlake.streaming import ordered


@pytest.fixture
def state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    ordered.use_ordered_state(spark)
    yield
    spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drive(spark, frame, tmp, name):
    frame.writeStream.format("parquet").option("path", str(tmp / name)).option("checkpointLocation", str(tmp / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(str(tmp / name))


def feed(spark, tmp, rows, schema, files):
    """Rows dealt over files so that a batch of one file may hold any part of an hour, in any order."""
    rng = random.Random(files)
    hours = {}
    for r in rows:
        hours.setdefault(r[1] // 3600, []).append(r)
    batches = []
    for _, part in sorted(hours.items()):
        rng.shuffle(part)
        cut = max(1, len(part) // files)
        batches += [part[k : k + cut] for k in range(0, len(part), cut)]
    last = max(r[1] for r in rows) + 100 * 3600
    batches.append([("end", last, 0, False)])
    for k, part in enumerate(batches):
        frame = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_seconds("ts")).coalesce(1)
        frame.write.mode("append").parquet(str(tmp / "in"))
    stream_schema = schema.replace("ts long", "ts timestamp")
    return spark.readStream.schema(stream_schema).option("maxFilesPerTrigger", 2).parquet(str(tmp / "in"))


@pytest.mark.parametrize(("files", "chunk"), [(1, 10_000), (2, 7)])
def test_breaker_in_any_chunks(spark, tmp_path, state, files, chunk):
    rng = random.Random(5)
    rows = []
    for source in "ab":
        for seq in range(300):
            failed = 40 <= seq < 130 if source == "a" else rng.random() < 0.7
            rows.append((source, 1_700_000_000 + seq * 30, seq, failed))
    want, run = {}, {}
    for source, _, seq, failed in rows:
        n, opened = run.get(source, (0, False))
        n = n + 1 if failed else 0
        run[source] = (n, opened or n >= 50)
        want[source, seq] = run[source]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(chunk))
    try:
        stream = feed(spark, tmp_path, rows, "source string, ts long, seq long, failed boolean", files)
        out = drive(spark, ordered.breaker_states(stream, 50, "2 hours"), tmp_path, "out").where("source <> 'end'").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(out) == len(rows)
    assert {(r["source"], r["seq"]): (r["consecutive"], r["open"]) for r in out} == want
    assert [k for k, v in want.items() if v[1] and k[0] == "a"][0] == ("a", 89)


def test_injection_makes_the_choices_of_the_fold(spark, tmp_path, state):
    rng = random.Random(9)
    rows = [(f"t{k}", 1_700_000_000 + seq * 120 + k, seq, rng.random() < 0.6) for k in range(5) for seq in range(40)]
    stream = feed(spark, tmp_path, rows, "task_id string, ts long, seq long, wish boolean", 2)
    out = drive(spark, ordered.injected_calls(stream, 9, 2, "2 hours", "30 hours"), tmp_path, "out").where("task_id <> 'end'")
    got = {r["task_id"]: r["m"] for r in out.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "made"))), lambda x: x["made"]).alias("m")).collect()}
    table = spark.createDataFrame(rows, "task_id string, ts long, seq long, wish boolean")
    fold = table.groupBy("task_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "wish"))), lambda x: x["wish"]).alias("w")).select("task_id", inject.online_injection(F.col("w"), 9, 2).alias("m"))
    assert got == {r["task_id"]: r["m"] for r in fold.collect()}


def test_an_idle_key_starts_anew(spark, tmp_path, state):
    rows = [("t", 1_700_000_000 + k, k, True) for k in range(4)] + [("other", 1_700_000_000 + 40 * 3600, 0, False)] + [("t", 1_700_000_000 + 80 * 3600 + k, 10 + k, True) for k in range(4)]
    stream = feed(spark, tmp_path, rows, "task_id string, ts long, seq long, wish boolean", 1)
    out = drive(spark, ordered.injected_calls(stream, 3, 9, "1 hour", "20 hours"), tmp_path, "out").where("task_id = 't'")
    assert {r["seq"]: r["made"] for r in out.collect()} == {0: True, 1: True, 2: True, 3: False, 10: True, 11: True, 12: True, 13: False}
