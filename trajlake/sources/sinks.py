"""Writers.  Each is one Spark write; only reports of bounded size are put together by the driver."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, is_dataclass
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.sources.readers import redacted
from trajlake.storage import remove


def write_jsonl(rows: DataFrame, path: str, append: bool = False, ascii_only: bool = False) -> None:
    """JSON lines in UTF-8; with ``ascii_only`` other characters become ``\\u`` escapes."""
    mode = "append" if append else "overwrite"
    if not ascii_only:
        rows.write.mode(mode).json(path)
        return
    line = F.to_json(F.struct("*"))
    units = F.transform(F.regexp_extract_all(line, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(F.octet_length(c) == 1, c).otherwise(F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "([0-9a-f]{4})", r"\\u$1")))
    rows.select(F.array_join(units, "").alias("value")).write.mode(mode).text(path)


def write_accepted_rejected(rows: DataFrame, reason: str, folder: str) -> DataFrame:
    """Rows without a reason, rows with one, and counts by the reason's head; returns the counts.  The input is computed
    once: the rows are kept, on disk where memory does not suffice, until all three are written."""
    kept = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        kept.where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").json(f"{folder}/accepted")
        kept.where(F.col(reason).isNotNull()).write.mode("overwrite").json(f"{folder}/rejected")
        stats = kept.groupBy(F.coalesce(F.substring_index(reason, ":", 1), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))
        stats.write.mode("overwrite").json(f"{folder}/stats")
    finally:
        kept.unpersist()
    return rows.sparkSession.read.schema(stats.schema).json(f"{folder}/stats")


def write_partitioned(rows: DataFrame, path: str, *keys: str) -> None:
    """A folder for each combination of keys (task, run, domain, attempt); rows are brought together by key first, so
    that a task writes few files, and salted so that a frequent key is not one task."""
    salted = rows.repartition(*[F.col(k) for k in keys], F.pmod(F.xxhash64(F.to_json(F.struct(*rows.columns))), F.lit(16)))
    salted.write.mode("overwrite").partitionBy(*keys).json(path)


def _store(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _leaves(store: Any, at: Any, depth: int) -> list[str]:
    """Paths ``depth`` folders below a folder, as text from there; what begins with a dot or an underscore is passed over."""
    names = [f.getPath() for f in store.listStatus(at)]
    shown = [p for p in names if not p.getName().startswith(("_", "."))]
    return [p.getName() for p in shown] if depth == 1 else [f"{p.getName()}/{rest}" for p in shown for rest in _leaves(store, p, depth - 1)]


def write_runs(rows: DataFrame, path: str, *keys: str) -> list[str]:
    """``write_partitioned``, so that a run's folder appears whole or not at all; the folders written, in order.

    All runs are written to a folder beside them first; a failure there leaves nothing.  Then each is put in its place by
    a rename, one run after the other; a run that is there already is exchanged.  ``restore_runs`` ends what a crash
    between the renames has left: each run is then the old or the new one, and whole."""
    spark = rows.sparkSession
    work = f"{path}/_work-{uuid.uuid4().hex}"
    try:
        write_partitioned(rows, work, *keys)
    except BaseException:
        remove(spark, work)
        raise
    source, store = _store(spark, work)
    runs = sorted(_leaves(store, source, len(keys)))
    for run in runs:
        place, old = _store(spark, f"{path}/{run}")[0], _store(spark, f"{work}/_old/{run}")[0]
        store.mkdirs(place.getParent())
        if store.exists(place):
            store.mkdirs(old.getParent())
            store.rename(place, old)
        if not store.rename(_store(spark, f"{work}/{run}")[0], place):
            raise RuntimeError(f"run {run} could not be put in its place")
    remove(spark, work)
    return runs


def restore_runs(spark: SparkSession, path: str, keys: int = 1) -> list[str]:
    """After a crash in ``write_runs``: puts back runs that had left their place when nothing had come instead, and deletes
    the rest of the work; the runs put back."""
    top, store = _store(spark, path)
    back = []
    for folder in [f.getPath() for f in store.listStatus(top)] if store.exists(top) else []:
        if folder.getName().startswith("_work-"):
            old = _store(spark, f"{path}/{folder.getName()}/_old")[0]
            for run in _leaves(store, old, keys) if store.exists(old) else []:
                place = _store(spark, f"{path}/{run}")[0]
                if not store.exists(place):
                    store.rename(_store(spark, f"{path}/{folder.getName()}/_old/{run}")[0], place)
                    back.append(run)
            remove(spark, f"{path}/{folder.getName()}")
    return sorted(back)


def write_failed(rows: DataFrame, path: str, sft_path: str | None = None) -> None:
    """Failed trajectories with their metadata; optionally the plain training form too."""
    meta = F.struct("task_id", "attempt", "reward", "termination")
    failed = rows.where(F.coalesce("reward", F.lit(0.0)) <= 0).select("messages", "tools", meta.alias("metadata"))
    failed.write.mode("append").json(path)
    if sft_path:
        failed.select("messages", "tools").write.mode("append").json(sft_path)


def write_concatenated(parts: list[DataFrame], path: str) -> None:
    """Parts one after the other, in the order given (files keep the order of their names)."""
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is not None:
        out.write.mode("overwrite").json(path)


def save_checkpoint(done: DataFrame, path: str) -> None:
    done.select("domain", "task_id", F.col("trial").cast("int").alias("trial")).write.mode("append").parquet(path)


def summary_json(domains: DataFrame, overall: DataFrame, scores: DataFrame) -> str:
    """The summary of an evaluation, with number lists on one line; its size is that of a few rows per domain."""
    body: dict[str, Any] = {
        "domains": {r["domain"]: {k: v for k, v in r.asDict().items() if k != "domain"} for r in domains.orderBy("domain").collect()},
        "overall": overall.first().asDict(),
        "scores": {},
    }
    for r in scores.orderBy("domain", "run_id").collect():
        body["scores"].setdefault(r["domain"], []).append(r["score"])
    lines = json.dumps(body | {"scores": "@scores"}, indent=2, ensure_ascii=False)
    listed = ",\n".join(f'    "{k}": {json.dumps(v)}' for k, v in body["scores"].items())
    return lines.replace('"@scores"', "{\n" + listed + "\n  }")


def statistics_json(domains: DataFrame, overall: DataFrame, key: str = "domain") -> str:
    """Statistics of each domain and of all, as JSON; as many rows as domains."""
    body = {"domains": {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in domains.orderBy(key).collect()}, "overall": overall.first().asDict()}
    return json.dumps(body, indent=2, ensure_ascii=False, default=str)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A small text to a file of any store that Spark writes."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_config(spark: SparkSession, config: Any, path: str) -> None:
    """A copy of settings beside a run's results, without its secrets, as JSON."""
    value = asdict(config) if is_dataclass(config) else config
    write_text(spark, json.dumps(redacted(value), indent=2, ensure_ascii=False), path)


def write_analyses(rows: DataFrame, path: str) -> None:
    """Analyses and contrasts (kind, task_id, attempt, reward, analysis) in a folder for each kind and task."""
    write_partitioned(rows, path, "kind", "task_id")


def markdown_table(rows: DataFrame, columns: list[str], title: str, most: int = 100) -> str:
    """A report table; where there are more than ``most`` rows its last line says how many are left out."""
    found = rows.select(*columns).limit(most + 1).collect()
    head = f"## {title}\n\n| {' | '.join(columns)} |\n|{'---|' * len(columns)}\n"
    body = "".join("| " + " | ".join("" if r[c] is None else str(r[c]) for c in columns) + " |\n" for r in found[:most])
    return head + body + (f"\n{rows.count() - most} more rows are not shown.\n" if len(found) > most else "")


def failure_report(statistics: DataFrame, terminations: DataFrame, actions: DataFrame, title: str, top: int = 10) -> str:
    """A report of an evaluation: the domains from the worst on, why runs ended, and the actions that failed most.

    ``statistics``, ``terminations`` and ``actions`` as the functions of ``operators.reports`` return them."""
    parts = [f"# {title}\n"]
    parts.append(markdown_table(statistics.orderBy("success_rate", "domain"), ["domain", "success_rate", "successful_tasks", "failed_tasks", "avg_steps", "max_steps_tasks"], "Domains"))
    parts.append(markdown_table(terminations.orderBy("domain", F.desc("n"), "termination_reason"), ["domain", "termination_reason", "n"], "How runs ended"))
    for column in ("missing", "wrong_parameters"):
        worst = actions.where(F.col(column) > 0).orderBy(F.desc(column), "domain", "action").limit(top)
        parts.append(markdown_table(worst, ["domain", "action", column], f"Top {top} actions by {column.replace('_', ' ')}"))
    return "\n".join(parts)


def text_report(metrics: dict[str, Any], title: str = "Metrics") -> str:
    width = max((len(k) for k in metrics), default=0)
    return "\n".join([title, "=" * len(title), *[f"{k.ljust(width)}  {v:.2f}" if isinstance(v, float) else f"{k.ljust(width)}  {v}" for k, v in metrics.items()]])
