"""The engine's functions in Spark SQL.

``register`` makes them temporary functions of a session, written in SQL, so that a query over any table or view can use
them and Catalyst sees through them; there is no Python in them.  They say the same as the column functions of
``trajlake.functions``.

    SELECT c.traj_id, t.position, t.name FROM messages c, LATERAL tool_calls(c.content) t WHERE NOT is_error_response(c.content)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from trajlake.functions.text import CONNECTION_WORDS, ERROR_WORDS, ID_TEMPLATES, NOT_RECOVERABLE, RECOVERABLE, STOP_SIGNALS, any_of


def _raw(text: str) -> str:
    """A literal in which backslashes count as themselves."""
    return 'r"' + text + '"' if '"' not in text else "r'" + text + "'"


def _error_template() -> str:
    out = "message"
    for pattern, name in ID_TEMPLATES:
        out = f"regexp_replace({out}, {_raw(pattern)}, {_raw(name)})"
    return out


def _match(expected: str, actual: str, tolerance: str) -> str:
    """``values_match`` of two expressions; a lambda's variables cannot be handed to a function, so it is written out."""
    a, b = f"trim(lower({expected}))", f"trim(lower({actual}))"
    x, y = f"try_cast({a} AS DOUBLE)", f"try_cast({b} AS DOUBLE)"
    return f"""CASE WHEN {expected} IS NULL OR {actual} IS NULL THEN {expected} IS NULL AND {actual} IS NULL
 WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN abs({x} - {y}) < {tolerance} ELSE {a} = {b} OR contains({a}, {b}) OR contains({b}, {a}) END"""


_CALLS = f"regexp_extract_all(coalesce(content, ''), {_raw('(?s)<tool_call>(.*?)</tool_call>')}, 1)"
_CALL = "'name string, arguments string'"

#: Name, parameters, result and body of each scalar function; later ones use earlier ones.
SCALARS = (
    ("one_json_value", "content STRING", "BOOLEAN", "coalesce(try_parse_json(content) IS NOT NULL AND json_array_length(concat('[', content, ',0]')) = 2, false)"),
    ("one_json_object", "content STRING", "BOOLEAN", "coalesce(startswith(content, '{'), false) AND one_json_value(content)"),
    ("response_result", "content STRING", "STRING", "CASE WHEN one_json_object(content) THEN get_json_object(content, '$.result') END"),
    ("has_error_word", "content STRING", "BOOLEAN", f"rlike(lower(coalesce(content, '')), {_raw(any_of(ERROR_WORDS))})"),
    ("is_error_response", "content STRING", "BOOLEAN", "CASE WHEN startswith(coalesce(content, ''), '{') THEN coalesce(startswith(response_result(content), 'Error:'), false) ELSE contains(coalesce(content, ''), 'Error:') END"),
    ("is_error_result", "content STRING", "BOOLEAN", "coalesce(startswith(response_result(content), 'Error:'), false)"),
    ("contains_error", "content STRING", "BOOLEAN", "contains(coalesce(response_result(content), content, ''), 'Error:')"),
    ("is_recoverable", "message STRING", "BOOLEAN", f"CASE WHEN rlike(lower(coalesce(message, '')), {_raw(NOT_RECOVERABLE)}) THEN false ELSE rlike(lower(coalesce(message, '')), {_raw(RECOVERABLE)}) END"),
    ("is_connection_error", "message STRING", "BOOLEAN", f"rlike(lower(coalesce(message, '')), {_raw(any_of(CONNECTION_WORDS))})"),
    ("has_stop_signal", "content STRING", "BOOLEAN", f"rlike(coalesce(content, ''), {_raw(any_of(STOP_SIGNALS))})"),
    ("error_template", "message STRING", "STRING", _error_template()),
    ("fill_template", "template STRING, vals MAP<STRING, STRING>", "STRING", "aggregate(map_entries(vals), template, (t, e) -> replace(t, concat('{', e.key, '}'), coalesce(e.value, '')))"),
    ("values_match", "expected STRING, actual STRING, tolerance DOUBLE DEFAULT 0.001", "BOOLEAN", _match("expected", "actual", "tolerance")),
    (
        "parameter_score", "expected MAP<STRING, STRING>, actual MAP<STRING, STRING>", "DOUBLE",
        f"""CASE WHEN cardinality(expected) = 0 THEN 1.0D WHEN actual IS NULL THEN 0.0D
 ELSE aggregate(map_keys(expected), 0, (n, k) -> n + CASE WHEN map_contains_key(actual, k) AND {_match("element_at(expected, k)", "element_at(actual, k)", "0.001")} THEN 1 ELSE 0 END) / cardinality(expected) END""",
    ),
)

#: Table functions, for lateral joins.
TABLES = (
    (
        "tool_calls", "content STRING", "TABLE (position INT, name STRING, arguments STRING)",
        f"""SELECT c.pos, c.call.name, c.call.arguments FROM (
 SELECT posexplode(filter(transform({_CALLS}, x -> from_json(trim(x), {_CALL})), c -> c.name IS NOT NULL)) AS (pos, call)) c""",
    ),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; their names."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, parameters, result, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    return [f[0] for f in (*SCALARS, *TABLES)]
