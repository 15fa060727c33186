"""Jobs that are killed between any two steps, and the error database's runs."""

import pytest
from pyspark.sql import functions as F

from trajlake.operators import errors
from trajlake.sources import schemas
from trajlake.streaming import commits, error_log, resume

RESULT = "domain string, task_id string, trial int, answer string"


class Killed(Exception):
    pass


@pytest.fixture
def killer(monkeypatch):
    """Kills the n-th time that one of the job's steps begins (or has just ended)."""
    state = {"left": -1}

    def counted(owner, name):
        plain = getattr(owner, name)

        def step(*args, **kwargs):
            for after in (False, True):
                if after:
                    out = plain(*args, **kwargs)
                state["left"] -= 1
                if state["left"] == 0:
                    raise Killed(name)
            return out

        monkeypatch.setattr(owner, name, step)

    counted(commits.CommitLog, "has")
    counted(commits.CommitLog, "commit")
    counted(resume, "completed")
    counted(resume.readers, "pending")
    return state


def test_no_result_doubled_or_lost_wherever_it_is_killed(spark, tmp_path, killer):
    batches = [spark.createDataFrame([("d", f"t{k}", 0) for k in part], schemas.CHECKPOINT) for part in ([1, 2, 2], [3, 4], [2, 5])]
    kills = 0
    out = str(tmp_path / "out")
    for number, batch in enumerate(batches):
        for when in (1, 3, 5, 7, 8, None):
            killer["left"] = when or -1
            try:
                resume.work_once(batch, f"q-{number}", lambda todo: todo.withColumn("answer", F.concat("task_id", F.lit("!"))), out)
            except Killed:
                kills += 1
    killer["left"] = -1
    assert kills >= 9
    got = sorted(tuple(r) for r in resume.results(spark, out, RESULT).collect())
    assert got == [("d", f"t{k}", 0, f"t{k}!") for k in range(1, 6)]
    assert resume.completed(spark, out).count() == 5
    assert resume.sweep(spark, out) and not resume.sweep(spark, out)
    assert resume.results(spark, out, RESULT).count() == 5


def test_a_stream_goes_on_after_a_crash_and_on_a_new_checkpoint(spark, tmp_path):
    spark.createDataFrame([("d", f"t{k}", 0) for k in range(9)], schemas.CHECKPOINT).repartition(3).write.parquet(str(tmp_path / "in"))
    tries = {"n": 0}

    def work(todo):
        tries["n"] += 1
        if tries["n"] == 2:
            raise Killed("work")
        return todo.withColumn("answer", F.lit("x"))

    def run(checkpoint):
        stream = spark.readStream.schema(schemas.CHECKPOINT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        resume.run_and_checkpoint(stream, work, str(tmp_path / "out"), str(tmp_path / checkpoint)).awaitTermination()

    with pytest.raises(Exception, match="work"):
        run("ck")
    assert 0 < resume.results(spark, str(tmp_path / "out"), RESULT).count() < 9
    run("ck")
    run("another")
    rows = resume.results(spark, str(tmp_path / "out"), RESULT)
    assert rows.count() == rows.dropDuplicates(["task_id"]).count() == 9


def messages(spark, part, n):
    return spark.range(n).select(F.lit("d").alias("domain"), (F.col("id") % 2).cast("string").alias("tool"), F.concat(F.lit("Error: #W"), (F.col("id") + part * 7).cast("string")).alias("message"), (F.col("id") + part * 100).alias("seq"))


def test_runs_are_merged_by_size_and_nothing_is_lost(spark, tmp_path):
    path, log = str(tmp_path / "db"), commits.CommitLog(spark, str(tmp_path / "db"))
    everything, live = None, []
    for k in range(9):
        batch = messages(spark, k, 10)
        everything = batch if everything is None else everything.unionByName(batch)
        for _ in range(2):  # a batch that comes again changes nothing
            error_log.append(batch, "q", k, path, fanout=2)
        live.append(len(log.read(log.names()[-1])["runs"]))
    want = errors.error_examples(everything)
    assert sorted(map(tuple, error_log.examples(spark, path).select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert live == [1, 1, 2, 1, 2, 2, 3, 1, 2]  # as the ones in the number of batches
    state = log.read(log.names()[-1])
    assert len(log.names()) == 2 and len(commits.folders(spark, f"{path}/runs")) <= len(state["runs"]) + live[-2]
    assert sorted(r["tool"] for r in error_log.error_db(spark, path).collect()) == ["0", "1"]


def test_a_killed_append_is_done_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "db")
    error_log.append(messages(spark, 0, 10), "q", 0, path)
    plain = commits.CommitLog.commit
    monkeypatch.setattr(commits.CommitLog, "commit", lambda *a: (_ for _ in ()).throw(Killed("commit")))
    with pytest.raises(Killed):
        error_log.append(messages(spark, 1, 10), "q", 1, path)
    monkeypatch.setattr(commits.CommitLog, "commit", plain)
    assert error_log.examples(spark, path).count() == 10
    for _ in range(2):
        error_log.append(messages(spark, 1, 10), "q", 1, path)
    assert error_log.examples(spark, path).agg(F.sum("n")).first()[0] == 20
    assert len(commits.folders(spark, f"{path}/runs")) == 2
