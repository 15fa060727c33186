"""Queries in SQL alone, over the functions that ``trajlake.sql`` registers, and over files that Spark derives from the tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake import sql
from trajlake.functions import text
from trajlake.functions.text import CONNECTION_WORDS, ERROR_WORDS, any_of
from trajlake.plans.adapters import conversation_messages, event_messages, table
from trajlake.plans.registry import query
from trajlake.sources import readers
from trajlake.sources.bigjson import SplitJson
from trajlake.storage import application_dir


def _views(spark: SparkSession, **frames: DataFrame) -> None:
    sql.register(spark)
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


@query("SELECT traj_id, count(*) AS n_calls, string_agg(name, ',' ORDER BY idx) AS names FROM evt WHERE kind = 'call' GROUP BY traj_id", "evt")
def sql_tool_calls(spark, d):
    """A lateral join with the table function ``tool_calls``, in SQL."""
    _views(spark, trajlake_messages=event_messages(spark, d).select("traj_id", "idx", "content"))
    return spark.sql("""SELECT m.traj_id, count(*) AS n_calls, array_join(transform(array_sort(collect_list(struct(m.idx, t.position, t.name))), c -> c.name), ',') AS names
 FROM trajlake_messages m, LATERAL tool_calls(m.content) t GROUP BY m.traj_id""")


@query(
    f"""WITH m AS (SELECT 'event' AS origin, role, content FROM evt UNION ALL SELECT 'conversation', role, content FROM conv),
 r AS (SELECT *, content LIKE '{{%' AS j, coalesce(starts_with(json_extract_string(CASE WHEN content LIKE '{{%' THEN content ELSE '{{}}' END, '$.result'), 'Error:'), false) AS e FROM m)
 SELECT origin, role, count(*) AS n, count(*) FILTER (regexp_matches(lower(content), '{any_of(ERROR_WORDS)}')) AS loose, count(*) FILTER (CASE WHEN j THEN e ELSE contains(content, 'Error:') END) AS response,
 count(*) FILTER (e) AS strict, count(*) FILTER (contains(content, 'Error:')) AS anywhere, count(*) FILTER (regexp_matches(lower(content), '{any_of(CONNECTION_WORDS)}')) AS connection FROM r GROUP BY ALL""",
    "evt", "conv",
)
def sql_error_predicates(spark, d):
    """The four error predicates and the connection errors, counted over the messages of events and conversations."""
    origin = lambda rows, name: rows.select(F.lit(name).alias("origin"), "role", "content")
    _views(spark, trajlake_all_messages=origin(event_messages(spark, d), "event").unionByName(origin(conversation_messages(spark, d), "conversation")))
    return spark.sql("""SELECT origin, role, count(*) AS n, count_if(has_error_word(content)) AS loose, count_if(is_error_response(content)) AS response,
 count_if(is_error_result(content)) AS strict, count_if(contains_error(content)) AS anywhere, count_if(is_connection_error(content)) AS connection FROM trajlake_all_messages GROUP BY origin, role""")


@query(
    """SELECT p_partkey, contains(lower(p_name), lower(split_part(p_name, ' ', 1))) AS by_word, p_size = p_partkey % 50 AS by_number, abs(p_retailprice - round(p_retailprice)) < 0.25 AS by_tolerance,
 (1 + (p_partkey % 2 = 0)::INT) / 2.0::DOUBLE AS score, p_name || ' costs {price} and is of ' || p_brand AS filled FROM part"""
)
def sql_argument_match(spark, d):
    """Matching and templates of ``part``'s texts and numbers."""
    _views(spark, trajlake_part=table(spark, d, "part"))
    return spark.sql("""SELECT p_partkey, values_match(upper(split_part(p_name, ' ', 1)), concat(' ', p_name)) AS by_word, values_match(CAST(p_size AS STRING), CAST(p_partkey % 50 AS STRING)) AS by_number,
 values_match(CAST(p_retailprice AS STRING), CAST(round(p_retailprice) AS STRING), 0.25D) AS by_tolerance,
 parameter_score(map('brand', p_brand, 'half', CAST(p_partkey AS STRING)), map('brand', lower(p_brand), 'half', CAST(p_partkey + p_partkey % 2 AS STRING))) AS score,
 fill_template('{name} costs {price} and is of {brand}', map('name', p_name, 'brand', p_brand)) AS filled FROM trajlake_part""")


@query(
    f"""SELECT doc_id, regexp_matches(lower(coalesce(text, '')), '{any_of(ERROR_WORDS)}') AS error_word, regexp_matches(lower(coalesce(text, '')), '{any_of(CONNECTION_WORDS)}') AS connection,
 (contains(text, '<') AND contains(text, '>')) OR (contains(text, '{{{{') AND contains(text, '}}}}')) OR (upper(text) = text AND contains(text, '_') AND length(text) > 10) AS placeholder,
 contains(text, '[STOP]') OR contains(text, '###STOP###') OR contains(text, '###TRANSFER###') OR contains(text, '###OUT-OF-SCOPE###') AS stops FROM documents WHERE text NOT LIKE '[%'"""
)
def document_predicates(spark, d):
    """Words of errors and connections, placeholders and stop signals in whole texts that are no list."""
    c = F.col("text")
    rows = table(spark, d, "documents").where(~c.startswith("["))
    return rows.select("doc_id", text.has_error_word(c).alias("error_word"), text.is_connection_error(c).alias("connection"), text.has_placeholder(c).alias("placeholder"), text.has_stop_signal(c).alias("stops"))


@query(
    """WITH o AS (SELECT conv_id, turn, to_json({'role': role, 'text': text}) AS j FROM conversations)
 SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN length(j) END AS ends, CASE WHEN turn % 4 < 3 THEN md5(j) END AS digest FROM o"""
)
def first_objects(spark, d):
    """The first object of a text with nothing, words, or a second object behind it; none where it is cut off."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.to_json(F.struct("role", "text")).alias("j"))
    kind = F.col("turn") % 4
    content = F.when(kind == 0, F.col("j")).when(kind == 1, F.concat("j", F.lit(' and "more} {'))).when(kind == 2, F.concat("j", "j")).otherwise(F.expr("left(j, length(j) - 2)"))
    return rows.select("conv_id", "turn", text.first_object(content).alias("o")).select("conv_id", "turn", F.col("o.end").cast("long").alias("ends"), F.md5("o.text").alias("digest"))


def _result_files(lines: DataFrame) -> DataFrame:
    """Every partition's simulations as one JSON file of results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, n = '{"info": {"agent_info": {"llm": "m"}}, "tasks": [], "simulations": [', 0
        for batch in batches:
            for line in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [head + line if not n else "," + line]})
                n += 1
        yield pa.RecordBatch.from_pydict({"value": ["]}" if n else head + "]}"]})

    return lines.mapInArrow(run, "value string")


@query("SELECT conv_id::VARCHAR AS task_id, count(*) AS n_messages, sum(length(text))::BIGINT AS chars, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def split_result_files(spark, d):
    """Conversations written as large JSON result files and read back in ranges, elements cut by their brackets."""
    message = F.struct("turn", "role", F.col("text").alias("content"))
    sims = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(message)).alias("messages"))
    lines = sims.select(F.to_json(F.struct(F.col("conv_id").cast("string").alias("task_id"), F.lit(1.0).alias("reward"), "messages")).alias("value"))
    path = f"{application_dir(spark)}/results-{uuid.uuid4().hex}"
    _result_files(lines).write.text(path)
    found = readers.simulations(SplitJson(spark, path).elements)
    told = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
    return found.select("task_id", F.size("messages").cast("long").alias("n_messages"), F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.length(m["content"])).alias("chars"), F.md5(told).alias("digest"))
