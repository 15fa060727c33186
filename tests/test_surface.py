"""The SQL functions against the column functions, and the first object of a text against Python's decoder."""

import json

import pytest
from pyspark.sql import functions as F

from trajlake import sql
from trajlake.functions import matching, text
from trajlake.operators import reports

CONTENTS = [
    None, "", "Error: x", "no error here", '{"result": "Error: y"}', '{"result": "fine Error: y"}', '{"result": "Error: y"} {"result": 1}', '{"result": "Error', "Tool Not Found", "HTTP 503", "[STOP] now", "order #W12 on 2024-01-01 for mia_li_22",
    '<tool_call>{"name": "a", "arguments": {"x": 1}}</tool_call> and <tool_call>\n {"name": "b"}</tool_call><tool_call>bad</tool_call>', '<tool_call>{"arguments": {}}</tool_call>', '{"a": {"b": ["}", "\\"{"]}} rest', '{"a": 1',
]


def test_sql_functions_say_what_the_column_functions_say(spark):
    assert "tool_calls" in sql.register(spark)
    rows = spark.createDataFrame([(k, c) for k, c in enumerate(CONTENTS)], "k int, c string")
    rows.createOrReplaceTempView("surface_contents")
    for name, fn in {
        "has_error_word": text.has_error_word, "is_error_response": text.is_error_response, "is_error_result": text.is_error_result, "contains_error": text.contains_error, "is_recoverable": text.is_recoverable,
        "is_connection_error": text.is_connection_error, "has_stop_signal": text.has_stop_signal, "error_template": text.error_template, "one_json_object": text.one_json_object, "response_result": text.response_result,
    }.items():
        both = rows.select("k", fn(F.col("c")).alias("want")).join(spark.sql(f"SELECT k, {name}(c) AS got FROM surface_contents"), "k")
        assert both.where("NOT (want <=> got)").collect() == [], name
    values = spark.createDataFrame([(a, b) for a in (None, "A ", "1", "1.0004", "abc", "") for b in (None, "a", "1.0", "xabcx", " ")], "a string, b string")
    values.createOrReplaceTempView("surface_values")
    both = spark.sql("SELECT a, b, values_match(a, b) AS got, values_match(a, b, 1e-9) AS strict FROM surface_values")
    assert both.where(~F.col("got").eqNullSafe(matching.values_match(F.col("a"), F.col("b")))).collect() == []
    assert both.where(~F.col("strict").eqNullSafe(matching.values_match(F.col("a"), F.col("b"), 1e-9))).collect() == []
    maps = spark.sql("SELECT map('a', '1', 'b', 'x') AS e, map('a', '1.0', 'c', 'x') AS a UNION ALL SELECT map(), map('a', '1') UNION ALL SELECT map('a', '1'), NULL")
    maps.createOrReplaceTempView("surface_maps")
    got = [r["s"] for r in spark.sql("SELECT parameter_score(e, a) AS s FROM surface_maps").collect()]
    assert got == [r["s"] for r in maps.select(matching.parameter_score(F.col("e"), F.col("a")).alias("s")).collect()] == [0.5, 1.0, 0.0]
    assert spark.sql("SELECT fill_template('{a} {b} {c}', map('a', 'x', 'b', NULL)) AS t").first()["t"] == "x  {c}"


def test_tool_calls_join_laterally(spark):
    sql.register(spark)
    spark.createDataFrame([(k, c) for k, c in enumerate(CONTENTS)], "k int, c string").createOrReplaceTempView("surface_contents")
    joined = spark.sql("SELECT s.k, t.* FROM surface_contents s, LATERAL tool_calls(s.c) t")
    assert sorted((r["k"], r["position"], r["name"], r["arguments"]) for r in joined.collect()) == [(12, 0, "a", '{"x":1}'), (12, 1, "b", None)]
    assert "Python" not in joined._jdf.queryExecution().executedPlan().toString()


OBJECTS = [
    '{"a": 1}', '{"a": 1} {"b": 2}', '{"a": {"b": [1, {"c": "}"}]}} tail }', '{"a": "\\"}{"}x', '{}', '{}{}', '{"a": 1', '{"a": "x', '{"a": [1}', ' {"a": 1}', "[1]", "", '{"a": tru}', '{"a": "\\\\"}\\', '{"é🙂": "日本"}{', '{"a":\n1}\n', "{", "}", '{"a": "' + "x" * 5000 + '"} y', "{" * 50, '{"k": [[[[{"z": [{}]}]]]]}]',
]


def test_first_object_is_that_of_a_decoder(spark):
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([*OBJECTS, None])], "k int, c string")
    got = {r["k"]: r["o"] for r in rows.select("k", text.first_object(F.col("c")).alias("o")).collect()}
    for k, c in enumerate(OBJECTS):
        try:
            end = json.JSONDecoder().raw_decode(c)[1] if c.startswith("{") else None
        except ValueError:
            end = None
        assert (got[k] and got[k]["end"]) == end, c
        assert got[k] is None or got[k]["text"] == c[:end]
    assert got[len(OBJECTS)] is None


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_chunks_of_responses_are_bounded(spark, size):
    data = [("a" if k % 3 else None, "t", k % 5, k) for k in range(200)]
    rows = spark.createDataFrame(data, "domain string, task string, model int, n int").repartition(6)
    out = reports.response_chunks(rows, ["domain", "task"], ["model", "n"], size).collect()
    for domain in ("a", None):
        chunks = sorted((r["chunk"], [tuple(x) for x in r["responses"]]) for r in out if r["domain"] == domain)
        assert [c for c, _ in chunks] == list(range(len(chunks))) and all(len(x) == size for _, x in chunks[:-1])
        assert [x for _, part in chunks for x in part] == sorted((m, n) for d, _, m, n in data if d == domain)
