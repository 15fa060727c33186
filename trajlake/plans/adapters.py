"""The driver's tables in the shapes that the operators take.

Each adapter is a view definition; ``SQL`` holds the same view in SQL for the comparison engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CALLS = ("click", "purchase", "signup")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as simulations: domain, source, run_id, task_id, reward, is_error."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(
        F.col("lang").alias("domain"), "source", F.pmod("doc_id", F.lit(3)).cast("int").alias("run_id"), F.col("doc_id").alias("task_id"), F.col("quality").cast("double").alias("reward"), (F.col("toxic") == 1).alias("is_error")
    )


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the messages of a user's trajectory: calls, user texts and error results."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type").isin(*CALLS), "call").when(F.col("event_type") == "error", "result").otherwise("text")
    role = F.when(F.col("event_type").isin(*CALLS), "assistant").when(F.col("event_type") == "error", "tool").otherwise("user")
    call = F.concat(F.lit('<tool_call>{"name": "'), F.col("event_type"), F.lit('", "arguments": '), F.col("props"), F.lit("}</tool_call>"))
    result = F.concat(F.lit('{"name": "event", "result": "Error: event '), F.col("event_id").cast("string"), F.lit(' failed"}'))
    content = F.when(kind == "call", call).when(kind == "result", result).otherwise(F.concat(F.lit("view "), F.col("event_id").cast("string")))
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").alias("traj_id"), (F.row_number().over(w) - 1).alias("idx"), "event_id", F.col("event_type").alias("name"), "props", kind.alias("kind"), role.alias("role"), content.alias("content"), (kind == "result").alias("is_error")
    )


def conversation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("traj_id"), F.col("turn").alias("idx"), "role", F.col("text").alias("content"))


def order_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the expected actions of an order: name, quantity (whole), and whether it was really called."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("name"), F.col("l_quantity").cast("long").alias("quantity"), F.round(F.col("l_discount") * 100).cast("long").alias("discount"), (F.col("l_quantity") > 25).alias("called")
    )


def native_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as native messages: calls with ids, results by the id of the call before them, user texts, of which every
    seventh is a call of the user's side."""
    rows = event_messages(spark, sf_dir)
    so_far = Window.partitionBy("traj_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    own = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    call = lambda name, args: F.array(F.struct(own.alias("id"), name.alias("name"), args.alias("arguments")))
    user_call = (F.col("kind") == "text") & (F.col("event_id") % 7 == 0)
    last = F.last(F.when(F.col("kind") == "call", own), ignorenulls=True).over(so_far)
    return rows.select(
        "traj_id", "idx", "event_id", "role",
        F.when(F.col("kind") == "result", F.concat(F.lit("Error: event "), F.col("event_id").cast("string"), F.lit(" failed"))).when(F.col("kind") == "text", F.col("content")).alias("content"),
        F.when(F.col("kind") == "result", last).alias("tool_call_id"),
        F.when(F.col("kind") == "call", call(F.col("name"), F.col("props"))).when(user_call, call(F.lit("self"), F.lit("{}"))).alias("tool_calls"),
    )


SQL = {
    "lab": """SELECT d.lang AS domain, d.source, CAST(d.doc_id % 3 AS INTEGER) AS run_id, d.doc_id AS task_id, CAST(l.quality AS DOUBLE) AS reward, l.toxic = 1 AS is_error
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "evt": """SELECT user_id AS traj_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_id, event_type AS name, props,
 CASE WHEN event_type IN ('click','purchase','signup') THEN 'call' WHEN event_type = 'error' THEN 'result' ELSE 'text' END AS kind,
 CASE WHEN event_type IN ('click','purchase','signup') THEN 'assistant' WHEN event_type = 'error' THEN 'tool' ELSE 'user' END AS role,
 CASE WHEN event_type IN ('click','purchase','signup') THEN '<tool_call>{"name": "' || event_type || '", "arguments": ' || props || '}</tool_call>'
      WHEN event_type = 'error' THEN '{"name": "event", "result": "Error: event ' || CAST(event_id AS VARCHAR) || ' failed"}'
      ELSE 'view ' || CAST(event_id AS VARCHAR) END AS content,
 event_type = 'error' AS is_error FROM events""",
    "conv": "SELECT conv_id AS traj_id, turn AS idx, role, text AS content FROM conversations",
    "ord": """SELECT l_orderkey AS task_id, l_linenumber AS pos, l_returnflag || l_linestatus AS name, CAST(l_quantity AS BIGINT) AS quantity,
 CAST(round(l_discount * 100) AS BIGINT) AS discount, l_quantity > 25 AS called FROM lineitem""",
}
_SO_FAR = "OVER (PARTITION BY traj_id ORDER BY idx ROWS UNBOUNDED PRECEDING)"
SQL["nat"] = f"""SELECT *, kind = 'text' AND event_id % 7 = 0 AS ucall, 'Error: event ' || event_id || ' failed' AS err,
 coalesce(last_value(CASE WHEN kind = 'call' THEN name END IGNORE NULLS) {_SO_FAR}, 'unknown') AS call_name FROM ({SQL["evt"]})"""
