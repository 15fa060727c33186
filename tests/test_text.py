"""Column functions on small cases."""

import pytest
from pyspark.sql import functions as F

from trajlake.functions import matching, scoring, text


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_first_call_and_all_calls(spark):
    body = 'hi <tool_call>{"name": "a", "arguments": {"x": {"y": 1}}}</tool_call> and <tool_call>\n{"name": "b", "arguments": {}}\n</tool_call><tool_call>{bad</tool_call>'
    assert value(spark, text.first_tool_call(F.lit(body)))["name"] == "a"
    assert [c["name"] for c in value(spark, text.all_tool_calls(F.lit(body)))] == ["a", "b"]
    assert value(spark, text.first_tool_call(F.lit('<tool_call>{"name": "a"}</tool_call>'))) is None
    assert value(spark, text.all_tool_calls(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(
    ("content", "loose", "response", "strict", "contains"),
    [
        ('{"name": "t", "result": "Error: no such user"}', True, True, True, True),
        ('{"name": "t", "result": "all is well"}', False, False, False, False),
        ("text with Error: inside", True, True, False, True),
        ("User NOT FOUND", True, False, False, False),
        ("{broken Error:", True, False, False, True),
        ("", False, False, False, False),
        (None, False, False, False, False),
    ],
)
def test_error_predicates(spark, content, loose, response, strict, contains):
    c = F.lit(content).cast("string")
    got = [value(spark, f(c)) for f in (text.has_error_word, text.is_error_response, text.is_error_result, text.contains_error)]
    assert got == [loose, response, strict, contains]


def test_cleaning(spark):
    assert value(spark, text.remove_think_tags(F.lit(" a<think>x\ny</think>\n\n\n\nb<thought>z</thought> \n"))) == "a\n\nb"
    assert value(spark, text.cut_analysis(F.lit("keep \n## Success Analysis\nx ## Error Analysis"))) == "keep"
    assert value(spark, text.cut_analysis(F.lit("keep"))) == "keep"
    assert value(spark, text.strip_code_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, text.outer_object(F.lit('x {"a": {}} y'))) == '{"a": {}}'
    assert value(spark, text.clean_system_prompt(F.lit("p\n## Contrast Analysis q"))) == "p"


def test_templates(spark):
    message = "Order #W12 of mia_li_22 for ABCDEF on 2024-05-01: HAT12, 1234567890 and 7"
    once = value(spark, text.error_template(F.lit(message)))
    assert once == "Order {order_id} of {user_id} for {reservation_id} on {date}: {flight_number}, {product_id} and {amount}"
    assert value(spark, text.error_template(F.lit(once))) == once
    assert value(spark, text.fill_template(F.lit("{a}-{b}"), F.create_map(F.lit("a"), F.lit("1")))) == "1-{b}"


def test_recoverable(spark):
    assert value(spark, text.is_recoverable(F.lit("Missing 1 required positional argument"))) is True
    assert value(spark, text.is_recoverable(F.lit("validation error: user not found"))) is False
    assert value(spark, text.is_recoverable(F.lit(None).cast("string"))) is False


@pytest.mark.parametrize(("a", "b", "same"), [("10", "10.0005", True), ("10", "1", False), (" Abc", "abc ", True), ("abc", "xabcx", True), ("", "any", True), ("a", None, False)])
def test_values_match(spark, a, b, same):
    assert value(spark, matching.values_match(F.lit(a), F.lit(b).cast("string"))) is same


def test_parameter_scores(spark):
    e = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("x"))
    assert value(spark, matching.parameter_score(e, F.create_map(F.lit("a"), F.lit("1.0")))) == 0.5
    assert value(spark, matching.json_parameter_score(F.lit('{"a": [1, "B"], "b": {"c": 1}}'), F.lit('{"a": ["b", 1], "b": {"c": 2}}'))) == 0.5
    assert value(spark, matching.json_parameter_score(F.lit("{}"), F.lit("{}"))) == 1.0
    assert value(spark, matching.json_parameter_score(F.lit("{"), F.lit("{}"))) == 0.0
    assert value(spark, matching.strict_json(F.lit('{"a": 1}{"b": 2}'))) is False


def test_grades(spark):
    assert [value(spark, scoring.reward_tier(F.lit(r))) for r in (0.95, 0.9, 0.75, 0.6, 0.59)] == ["PLATINUM", "GOLD", "SILVER", "BRONZE", "FAILED"]
    assert value(spark, scoring.final_reward(F.lit(0.2), F.lit(1.0), F.lit(0.5))) == 0.75
    assert value(spark, scoring.final_reward(F.lit(0.2), F.lit(None).cast("double"), F.lit(None).cast("double"))) == 0.2
    assert value(spark, scoring.difficulty_weight(F.lit(4), F.lit(True), F.lit(True), F.lit(3), F.lit(1.0))) == 5.0
    assert value(spark, scoring.adjusted_max_steps(F.lit(100), F.lit(True), F.lit(True))) == 180
