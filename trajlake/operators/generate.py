"""Tasks made from patterns and parameters, and dimension tables for varied ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.functions.text import fill_template, has_placeholder
from trajlake.operators.sampling import pick_weighted, shuffle_key, uniform, weighted_value


def patterns(tasks: DataFrame) -> DataFrame:
    """(task_id, reason, tools, n_actions, frequency) from tasks (task_id, reason, actions array<struct<name>>)."""
    total = tasks.count()
    return tasks.select("task_id", "reason", F.transform("actions", lambda a: a["name"]).alias("tools"), F.size("actions").alias("n_actions"), F.lit(1 / max(1, total)).alias("frequency"))


def parameter_space(table: DataFrame, columns: list[str]) -> DataFrame:
    """(param, value, n) over the named columns in one pass; nulls and empty values do not count."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("param"), F.col(c).cast("string").alias("value")) for c in columns]))
    return table.select(pairs.alias("p")).select("p.*").where("value is not null AND value <> ''").groupBy("param", "value").agg(F.count("*").alias("n"))


def parameter_draws(space: DataFrame, n: int, seed: int) -> DataFrame:
    """(draw, params map): for each of ``n`` draws one value of every parameter, weighted by its count.

    Values are given their interval of [0, 1) within the parameter; draws find it by hash bucket."""
    running = Window.partitionBy("param").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("n").over(Window.partitionBy("param"))
    spans = space.withColumns({"high": F.sum("n").over(running) / total, "low": (F.sum("n").over(running) - F.col("n")) / total})
    buckets = 256
    spans = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("low") * buckets), F.least(F.floor(F.col("high") * buckets), F.lit(buckets - 1)))))
    spark = space.sparkSession
    params = space.select("param").distinct()
    draws = spark.range(n).select(F.col("id").alias("draw")).join(F.broadcast(params))
    draws = draws.withColumn("_u", uniform(F.concat_ws(":", F.col("draw").cast("string"), "param"), seed)).withColumn("_b", F.floor(F.col("_u") * buckets))
    found = draws.join(spans, ["param", "_b"]).where((F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high")))
    return found.groupBy("draw").agg(F.map_from_entries(F.collect_list(F.struct("param", "value"))).alias("params"))


def instantiate(templates: DataFrame, draws: DataFrame, seed: int) -> DataFrame:
    """A task for each draw: a template picked by hash, filled with the draw's parameters.

    ``templates``: template_id (0, 1, ... without gaps), text."""
    n = templates.count()
    picked = draws.withColumn("template_id", F.pmod(F.conv(F.substring(shuffle_key("draw", seed), 1, 8), 16, 10).cast("long"), F.lit(max(1, n))))
    return picked.join(templates, "template_id").select("draw", "template_id", fill_template(F.col("text"), F.col("params")).alias("text"))


def placeholders_left(arguments: Column) -> Column:
    """Whether a map of arguments still holds a placeholder."""
    return F.exists(F.map_values(arguments), has_placeholder)


def persona_table(spark: SparkSession) -> DataFrame:
    """Our own personas for varied users: (persona, patience, formality, weight)."""
    rows = [("hurried traveller", 1, 2, 3), ("careful planner", 5, 4, 3), ("first-time caller", 4, 3, 2), ("regular customer", 3, 2, 4), ("upset customer", 1, 1, 2), ("bargain hunter", 3, 2, 2), ("business client", 2, 5, 3), ("helper for someone else", 4, 4, 1)]
    return spark.createDataFrame(rows, "persona string, patience int, formality int, weight int")


# Scenarios of varied tasks and their weights; overrides of two personas and one party size.
DATE_SPANS = {"near_future": (1, 7, 0.2), "optimal_window": (14, 45, 0.5), "far_future": (90, 180, 0.3)}
CABINS = {"basic_economy": 0.3, "economy": 0.5, "business": 0.2}
PARTIES = {"1": 0.60, "2": 0.20, "3": 0.10, "4": 0.07, "5": 0.03}
COMPLEXITIES = {"simple": 0.3, "medium": 0.5, "complex": 0.2}
# End of fixed values.


def diverse_configs(spark: SparkSession, n: int, routes: DataFrame, personas: DataFrame, base_date: str, seed: int) -> DataFrame:
    """(config, persona, complexity, date, origin, destination, cabin, passengers) for ``n`` varied tasks.

    ``routes``: origin, destination, weight.  ``personas``: persona, weight, cabins and party (arrays that a persona is
    bound to, or null).  Dates lie a drawn number of days after ``base_date``."""
    u = lambda k: uniform(F.col("config"), seed + k)
    rows = spark.range(n).select(F.col("id").alias("config"), F.lit(1).alias("_all"))
    rows = pick_weighted(rows, personas.withColumn("_all", F.lit(1)), ("_all",), "weight", "persona", "config", seed)
    named = routes.select(F.lit(1).alias("_all"), F.concat_ws(">", "origin", "destination").alias("_route"), "origin", "destination", "weight")
    rows = pick_weighted(rows, named, ("_all",), "weight", "_route", "config", seed + 1)
    span = weighted_value({k: w for k, (_, _, w) in DATE_SPANS.items()}, u(2))
    days = F.lit(0)
    for name, (low, high, _) in DATE_SPANS.items():
        days = F.when(span == name, F.lit(low) + F.floor(u(3) * (high - low + 1)).cast("int")).otherwise(days)
    bound = lambda c, free, k: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.get(F.col(c), F.floor(u(k) * F.size(c)).cast("int"))).otherwise(free)
    return rows.select(
        "config", "persona", weighted_value(COMPLEXITIES, u(4)).alias("complexity"), dated(F.to_date(F.lit(base_date)), days).alias("date"), "origin", "destination",
        bound("cabins", weighted_value(CABINS, u(5)), 6).alias("cabin"), bound("party", weighted_value(PARTIES, u(7)), 8).cast("int").alias("passengers"),
    )


def dated(base: Column, days: Column) -> Column:
    """A date ``days`` after an explicit base date, as text."""
    return F.date_format(F.date_add(base, days), "yyyy-MM-dd")


def assembled_task(task: DataFrame) -> DataFrame:
    """The file form of a task: actions without compare_args, null fields present, notes as text."""
    actions = F.transform("actions", lambda a, i: F.struct(F.concat(F.col("id"), F.lit("_"), i.cast("string")).alias("action_id"), a["name"].alias("name"), a["arguments"].alias("arguments"), F.lit(None).cast("string").alias("info")))
    scenario = F.struct("persona", F.struct("domain", "reason_for_call", "known_info", "unknown_info", "task_instructions").alias("instructions"))
    criteria = F.struct(actions.alias("actions"), F.col("communicate_info"), F.col("nl_assertions"), F.col("reward_basis"))
    return task.select("id", F.struct("purpose", F.lit(None).cast("string").alias("relevant_policies"), F.col("notes").cast("string").alias("notes")).alias("description"), scenario.alias("user_scenario"), F.lit(None).cast("string").alias("initial_state"), criteria.alias("evaluation_criteria"), F.lit(None).cast("string").alias("annotations"))
