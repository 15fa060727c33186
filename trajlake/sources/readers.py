"""Readers of result files, tasks, tool schemas, JSONL records, domain databases and configuration.

All data goes through Spark's readers, so any store that Spark reads will do; only configuration and TOML databases,
which are small by nature, are read as text by the driver.
"""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from trajlake.functions.text import one_json_object
from trajlake.operators.metrics import effective_reward
from trajlake.operators.numbering import numbered
from trajlake.sources import schemas
from trajlake.sources.bigjson import SplitJson


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def eval_results(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON results: one row for each file, with the file's path."""
    return spark.read.json(path, schema=schemas.EVAL_FILE, multiLine=True).withColumn("path", F.col("_metadata.file_path"))


def _from_path(rows: DataFrame) -> DataFrame:
    """Model from the folder and domain from the words of the file name; summaries are left out."""
    name = F.element_at(F.split("path", "/"), -1)
    tokens = F.split(F.regexp_replace(name, r"\.json$", ""), "_")
    domain = F.coalesce(*[F.when(F.array_contains(tokens, d), F.lit(d)) for d in schemas.DOMAINS], F.element_at(tokens, -1))
    return rows.where(~name.startswith("summary")).withColumns({"model": F.element_at(F.split("path", "/"), -2), "domain": domain})


def eval_directory(spark: SparkSession, root: str) -> DataFrame:
    """``root/<model>/*.json`` without summaries; model from the folder, domain from the words of the file name."""
    return _from_path(eval_results(spark, f"{root}/*/*.json"))


def split_directory(spark: SparkSession, root: str) -> DataFrame:
    """As ``eval_directory``, for files of any size: a row for each task and simulation (key, position, text, beside path,
    model and domain), read by as many tasks as the files have ranges.  ``simulations`` and ``result_tasks`` take it."""
    elements = SplitJson(spark, f"{root}/*/*.json").elements
    return _from_path(elements.where(F.col("key").isin("tasks", "simulations")).select(F.col("file").alias("path"), "key", "position", "text"))


def _members(results: DataFrame, key: str, kind: str, *keep: str) -> DataFrame:
    """(keep, position, x) for each element of a results file's array, from whole files or split ones."""
    if key in results.columns:
        return results.select(*keep, F.posexplode(key).alias("position", "x"))
    return results.where(F.col("key") == key).select(*keep, F.col("position").cast("int").alias("position"), F.from_json("text", kind).alias("x"))


def simulations(results: DataFrame, *keep: str) -> DataFrame:
    """A row for each simulation; its reward is the top-level one unless that is null or zero.  Both places of the
    action checks are read."""
    sims = _members(results, "simulations", schemas.SIMULATION, *keep).withColumnRenamed("x", "s")
    reward = effective_reward(F.col("s.reward"), F.col("s.reward_info.reward"))
    checks = F.coalesce("s.reward_info.action_checks", "s.reward_info.action_reward_info.action_checks")
    return sims.select(*keep, "position", "s.task_id", reward.alias("reward"), "s.termination_reason", checks.alias("action_checks"), "s.messages")


def result_tasks(results: DataFrame, *keep: str) -> DataFrame:
    """A row for each (task, key): a task is found by its id and by its position; a position wins over an id."""
    tasks = _members(results, "tasks", schemas.EVAL_TASK, *keep).withColumnRenamed("x", "t")
    keys = F.array(F.struct(F.col("t.id").alias("key"), F.lit(0).alias("priority")), F.struct(F.col("position").cast("string").alias("key"), F.lit(1).alias("priority")))
    spread = tasks.select(*keep, "position", "t", F.explode(keys).alias("k")).select(*keep, "position", "t", "k.key", "k.priority")
    return spread.groupBy(*keep, "key").agg(F.max_by("t", F.struct("priority", "position")).alias("task"))


def jsonl_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Any bad line fails the read."""
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def _checked_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines (value, ...) that are not blank, with ``record``: null unless the line is one JSON object of the schema."""
    options = {"columnNameOfCorruptRecord": "_bad"}
    filled = lines.where(F.trim("value") != "").withColumn("_r", F.from_json("value", f"{schema}, _bad string", options))
    return filled.withColumn("record", F.when(F.col("_r._bad").isNull() & one_json_object(F.trim("value")), F.col("_r"))).drop("_r")


def jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Good lines only, which hold one object each and nothing behind it; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return _checked_lines(spark.read.text(path), schema).where("record is not null").select("record.*").drop("_bad")


def jsonl_with_rejects(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines with file and number).

    Lines are numbered within each file: a line's number in its split, and the lines of the file's splits before it, of
    which there is one number a split.  No task numbers a whole file."""
    from pyspark.sql import Window

    place = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), place.alias("place"))
    good = _checked_lines(lines, schema).where("record is not null").select("record.*").drop("_bad")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("place"))
    numbered_lines = lines.withColumn("line", own).join(offsets, ["file", "block"]).withColumn("line", (F.col("line") + F.col("offset")).cast("int"))
    bad = _checked_lines(numbered_lines, schema).where("record is null").select("file", "line", F.col("value").alias("text"))
    return good, bad


def tasks(spark: SparkSession, path: str, split: bool = False) -> DataFrame:
    """Tasks from a JSON array (``.json``) or JSON lines (``.jsonl``); with ``split`` one array is read by many tasks."""
    if split and not path.endswith(".jsonl"):
        kind = "struct<" + ", ".join(f"{name}:{rest}" for name, rest in (f.split(" ", 1) for f in schemas.TASK.split(", "))) + ">"
        return SplitJson(spark, path).elements.select(F.from_json("text", kind).alias("t")).select("t.*")
    return spark.read.json(path, schema=schemas.TASK, multiLine=not path.endswith(".jsonl"))


def task_path(spark: SparkSession, path: str, domain: str, default: str | None = None) -> str | None:
    """A file itself; in a folder the domain's task file, else its records; else the default."""
    if path.endswith((".json", ".jsonl")):
        return path if _exists(spark, path) else default
    for candidate in (f"{path}/{domain}/synthetic_tasks_{domain}.json", f"{path}/{domain}/synthetic_data.jsonl"):
        if _exists(spark, candidate):
            return candidate
    return default


def replicated_tasks(rows: DataFrame, positions: list[str] | None = None, trials: int = 1, order: str = "id") -> DataFrame:
    """Tasks at the given positions (as text, all if None), each ``trials`` times."""
    placed = numbered(rows, [order], "position")
    chosen = placed if positions is None else placed.where(F.col("position").cast("string").isin(positions))
    return chosen.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(trials - 1))))


def task_prefix(rows: DataFrame, n: int, order: str = "id") -> DataFrame:
    """The first ``n`` tasks in order (the limit is the feature)."""
    return rows.orderBy(order).limit(n)


def seed_tasks(spark: SparkSession, path: str, must_exist: bool = False) -> DataFrame:
    if not _exists(spark, path):
        if must_exist:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schemas.TASK)
    return tasks(spark, path)


def tool_schema(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(domain, tool, param, required) of the items that describe a function; a tool without parameters has one row
    with a null parameter."""
    rows = spark.read.json(path, schema=schemas.TOOL_FILE, multiLine=True).where("function.name is not null")
    params = F.map_keys("function.parameters.properties")
    spread = rows.select(F.lit(domain).alias("domain"), F.col("function.name").alias("tool"), F.explode_outer(params).alias("param"), F.coalesce("function.parameters.required", F.array().cast("array<string>")).alias("_r"))
    return spread.select("domain", "tool", "param", F.coalesce(F.array_contains("_r", F.col("param")), F.lit(False)).alias("required"))


def whole_text(spark: SparkSession, path: str) -> str | None:
    """A small text file through Spark's reader; None if it is missing."""
    if not _exists(spark, path):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def domain_database(spark: SparkSession, folder: str, overlay: bool = False) -> dict[str, DataFrame]:
    """Tables of ``db.json``, else of ``db.toml``; with ``overlay`` the JSON file's tables, and those it lacks from TOML.

    A container may be a mapping (its keys become column ``key``) or a list; values stay JSON text in ``value``.  JSON is
    taken apart by Spark, and only the containers' names reach the driver; TOML files, small by nature, are read by the
    driver."""
    out: dict[str, DataFrame] = {}
    has_json, has_toml = _exists(spark, f"{folder}/db.json"), _exists(spark, f"{folder}/db.toml")
    if not has_json and not has_toml:
        raise FileNotFoundError(folder)
    if has_json:
        whole = spark.read.text(f"{folder}/db.json", wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
        names = whole.select(F.explode_outer(F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].alias("name"), F.substring(F.ltrim(e["value"]), 1, 1).alias("head"))))).select("col.*").collect()
        for name, head in names:
            text = F.col("m")[name]
            if head == "{":
                out[name] = whole.select(F.explode(F.from_json(text, "map<string,string>")).alias("key", "value"))
            elif head == "[":
                out[name] = whole.select(F.posexplode(F.from_json(text, "array<string>")).alias("at", "value")).select(F.col("at").cast("string").alias("key"), "value")
    if has_toml and (overlay or not has_json):
        for name, container in tomllib.loads(whole_text(spark, f"{folder}/db.toml") or "").items():
            if isinstance(container, dict | list) and name not in out:
                pairs = container.items() if isinstance(container, dict) else enumerate(container)
                out[name] = spark.createDataFrame([(str(k), json.dumps(v, default=str)) for k, v in pairs], "key string, value string")
    return out


def error_db(spark: SparkSession, path: str) -> DataFrame:
    """The template table; empty where it is missing or cannot be read."""
    try:
        return spark.read.schema(schemas.ERROR_DB).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schemas.ERROR_DB)


def completed(spark: SparkSession, path: str) -> DataFrame:
    """Keys that earlier runs have completed."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schemas.CHECKPOINT)
    return spark.read.schema(schemas.CHECKPOINT).parquet(path)


def pending(work: DataFrame, done: DataFrame) -> DataFrame:
    return work.join(done, ["domain", "task_id", "trial"], "left_anti")


def expand(settings: Any, environment: dict[str, str] | None = None) -> Any:
    """Settings with ``${NAME}`` and ``${NAME:-default}`` filled in from the environment (no value, no default: empty).

    The settings' JSON text is filled in as a whole and parsed again: a default stands there as JSON already, a value of
    the environment is escaped first.  What JSON does not know, such as a date, becomes text."""
    known = os.environ if environment is None else environment

    def filled(found: re.Match[str]) -> str:
        name, _, default = found["variable"].partition(":-")
        return json.dumps(known[name])[1:-1] if name in known else default

    return json.loads(re.sub(r"\$\{(?P<variable>\w+(:-[^}]*)?)\}", filled, json.dumps(settings, default=str)))


def settings(spark: SparkSession, path: str, environment: dict[str, str] | None = None) -> dict[str, Any]:
    """A YAML (or JSON) file of settings with its variables filled in.  JSON needs nothing; YAML needs the ``yaml`` package."""
    text = whole_text(spark, path)
    if text is None:
        raise FileNotFoundError(path)
    if path.endswith(".json"):
        return expand(json.loads(text), environment)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("YAML settings need the yaml package; JSON works without it") from missing
    return expand(yaml.safe_load(text) or {}, environment)


# The names of the settings below and their defaults are those of the settings files.
class _Config:
    """Settings from a mapping: overrides that are not None win, unknown keys are refused."""

    @classmethod
    def load(cls, value: dict[str, Any], **overrides: Any):
        given = expand(value) | {k: v for k, v in overrides.items() if v is not None}
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**given)


@dataclass
class RunConfig(_Config):
    """Settings of a run, with their defaults."""

    domains: list[str] = field(default_factory=lambda: list(schemas.DOMAINS))
    num_tasks: int | None = None
    num_trials: int = 1
    num_runs: int = 1
    max_turns: int = 80
    max_calls: int = 25
    max_repeats: int = 3
    quality_threshold: float = 0.7
    error_rate: float = 0.3
    max_errors: int = 2
    seed: int = 42
    output_dir: str = "output"


@dataclass
class ModelConfig(_Config):
    """A model behind an interface."""

    base_url: str
    model_id: str
    max_tokens: int = 4096
    api_key: str | None = None
    extra_body: dict[str, Any] | None = None


@dataclass
class EvalConfig(_Config):
    """Settings of an evaluation; ``agent`` and ``user`` may be given as mappings."""

    task_name: str
    agent: ModelConfig
    user: ModelConfig
    domains: list[str] = field(default_factory=lambda: list(schemas.DOMAINS))
    num_trials: int = 1
    num_runs: int = 1
    max_concurrency: int = 64
    eval_batch_size: int = 15
    num_tasks: int | None = None
    output_dir: str = "eval_results"
    synthetic_testset_dir: str | None = None
    compute_extended_metrics: bool = True
    also_test_native: bool = False
    native_num_runs: int = 4
    synthetic_num_runs: int | None = None
    save_trajectories: bool = True

    def __post_init__(self) -> None:
        for name in ("agent", "user"):
            given = getattr(self, name)
            if isinstance(given, dict):
                setattr(self, name, ModelConfig.load(given))
        if self.synthetic_num_runs is None:
            self.synthetic_num_runs = self.num_runs


@dataclass
class GenerationConfig(_Config):
    """Settings of task generation."""

    model: str = "default"
    api_base: str = "http://localhost:8000/v1"
    api_key: str | None = None
    task_designer_temperature: float = 0.7
    scenario_writer_temperature: float = 0.8
    criteria_writer_temperature: float = 0.6
    num_tasks: int = 100
    max_concurrent: int = 10
    seed: int | None = None
    complexity_weights: dict[str, float] = field(default_factory=lambda: {"simple": 0.3, "medium": 0.5, "complex": 0.2})
    min_reason_length: int = 30
    min_task_instructions_length: int = 50
    require_all_actions: bool = True


# End of fixed values.


def redacted(value: Any) -> Any:
    """A nested setting without its secrets, for writing it down."""
    if isinstance(value, dict):
        return {k: "***" if re.search(r"key|token|secret|password", str(k), re.I) and v else redacted(v) for k, v in value.items()}
    return [redacted(v) for v in value] if isinstance(value, list) else value
