"""Files of runs that appear whole or not at all."""

import pytest
from pyspark.sql import functions as F

from trajlake.sources import sinks


def runs(spark, values, bad=False):
    rows = spark.createDataFrame([(r, d, v) for r, d, v in values], "run string, domain string, v int")
    return rows.withColumn("v", F.when(F.col("v") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("v")).cast("int")) if bad else rows


def read(spark, path):
    return sorted((str(r["run"]), r["domain"], r["v"]) for r in spark.read.json(path).collect())


FIRST = [("1", "a", 1), ("1", "b", 2), ("2", "a", 3)]
SECOND = [("1", "a", 9), ("3", "a", 7)]


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "runs")
    with pytest.raises(Exception, match="killed"):
        sinks.write_runs(runs(spark, FIRST, bad=True), path, "run", "domain")
    assert not (tmp_path / "runs").exists() or list((tmp_path / "runs").iterdir()) == []
    assert sinks.write_runs(runs(spark, FIRST), path, "run", "domain") == ["run=1/domain=a", "run=1/domain=b", "run=2/domain=a"]
    assert read(spark, path) == FIRST
    with pytest.raises(Exception, match="killed"):
        sinks.write_runs(runs(spark, [("1", "a", 2)], bad=True), path, "run", "domain")
    assert read(spark, path) == FIRST
    sinks.write_runs(runs(spark, SECOND), path, "run", "domain")
    assert read(spark, path) == [("1", "a", 9), ("1", "b", 2), ("2", "a", 3), ("3", "a", 7)]


@pytest.mark.parametrize("step", range(1, 6))
def test_killed_between_renames(spark, tmp_path, monkeypatch, step):
    path, count = str(tmp_path / "runs"), {"n": 0}
    sinks.write_runs(runs(spark, FIRST), path, "run", "domain")
    plain = sinks._store

    def counted(spark, at):
        count["n"] += "/run=" in at
        if count["n"] > step:
            raise KeyboardInterrupt
        return plain(spark, at)

    monkeypatch.setattr(sinks, "_store", counted)
    try:
        sinks.write_runs(runs(spark, SECOND), path, "run", "domain")
    except KeyboardInterrupt:
        pass
    monkeypatch.setattr(sinks, "_store", plain)
    sinks.restore_runs(spark, path, 2)
    got = read(spark, path)
    assert got in ([*FIRST], [("1", "a", 9), *FIRST[1:]], [("1", "a", 9), *FIRST[1:], ("3", "a", 7)])
    assert not any(p.name.startswith("_work") for p in (tmp_path / "runs").iterdir())
    assert sinks.restore_runs(spark, path, 2) == []
