"""Expected against actual calls: fuzzy value equality and parameter scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trajlake.functions.text import once, one_element, one_json_value


def values_match(expected: Column, actual: Column, tolerance: float = 0.001) -> Column:
    """Fuzzy equality of scalars given as text: equal, equal without case and outer blanks, one inside the other, or
    numbers closer than ``tolerance``.  Numbers are decided by their difference alone.  Null matches only null."""
    a, b = F.trim(F.lower(expected)), F.trim(F.lower(actual))
    x, y = a.try_cast("double"), b.try_cast("double")
    words = (a == b) | F.contains(a, b) | F.contains(b, a)
    out = F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) < tolerance).otherwise(words)
    return F.when(expected.isNull() | actual.isNull(), expected.isNull() & actual.isNull()).otherwise(out)


def parameter_score(expected: Column, actual: Column) -> Column:
    """Share of the expected map's keys whose value matches; 1 for no expected keys, 0 for a null actual map."""
    keys = F.map_keys(expected)
    hit = F.filter(keys, lambda k: F.map_contains_key(actual, k) & values_match(F.element_at(expected, k), F.element_at(actual, k)))
    return F.when(F.size(keys) == 0, 1.0).when(actual.isNull(), 0.0).otherwise(F.size(hit) / F.size(keys))


def list_values_match(expected: Column, actual: Column) -> Column:
    """Lists as sets of lower-cased text, of equal length."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(x))))
    return (F.size(expected) == F.size(actual)) & (as_set(expected) == as_set(actual))


def json_values(text: Column) -> Column:
    """A JSON object's values by key, as variants in any order; null where ``json_map`` is null.  The text is parsed once."""
    return F.when(one_element(text), F.try_parse_json(text).try_cast("map<string,variant>"))


def json_map(text: Column) -> Column:
    """A JSON object's values by key, each as JSON text with its quotes, keys in the order of the text; null for anything
    else, so for several objects in a row or a repeated key."""
    parts = F.struct(json_values(text).alias("values"), F.json_object_keys(text).alias("keys"))

    def whole(v: Column) -> Column:
        by_key = F.map_from_arrays(v["keys"], F.transform(v["keys"], lambda k: F.coalesce(F.to_json(F.try_element_at(v["values"], k)), F.lit("null"))))
        return F.when(v["values"].isNotNull(), by_key)

    return once(parts, whole)


def _quoted(value: Column) -> Column:
    return F.startswith(value, F.lit('"'))


def bare(value: Column) -> Column:
    """JSON text without the quotes of a string."""
    return F.when(_quoted(value), F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]).otherwise(value)


def json_values_match(expected: Column, actual: Column, tolerance: float = 0.001) -> Column:
    """``values_match`` for JSON texts, whose types decide: strings by equality without case and outer blanks or one
    inside the other, numbers by their difference, lists of equal length as sets of lower-cased texts, all else by
    lower-cased text."""
    a, b = F.trim(F.lower(bare(expected))), F.trim(F.lower(bare(actual)))
    x, y = expected.try_cast("double"), actual.try_cast("double")
    number = lambda v: v.rlike("^-?[0-9]")
    as_list = lambda v: F.from_json(v, "array<string>")
    both = lambda test: test(expected) & test(actual)
    lists = F.coalesce(list_values_match(as_list(expected), as_list(actual)), F.lit(False)) | (a == b)
    return (
        F.when(expected == actual, F.lit(True))
        .when(both(_quoted), (a == b) | F.contains(a, b) | F.contains(b, a))
        .when(both(number), F.abs(x - y) < tolerance)
        .when(both(lambda v: F.startswith(v, F.lit("["))), lists)
        .otherwise(a == b)
    )


def json_parameter_score(expected: Column, actual: Column) -> Column:
    """``parameter_score`` for arguments as JSON text, with nested values: 1 for no expected arguments, 0 where the actual
    ones are no object."""

    def score(v: Column) -> Column:
        want, got = v["want"], v["got"]
        hit = F.filter(F.map_keys(want), lambda k: F.map_contains_key(got, k) & json_values_match(F.element_at(want, k), F.element_at(got, k)))
        return F.when(want.isNull() | got.isNull(), 0.0).otherwise(F.size(hit) / F.size(want))

    both = F.struct(json_map(expected).alias("want"), json_map(actual).alias("got"))
    nothing = expected.isNull() | (F.regexp_replace(expected, r"\s", "") == "{}")
    return F.when(nothing, 1.0).otherwise(once(both, score))


def strict_json(text: Column) -> Column:
    """Whether the whole text is one JSON value."""
    return one_json_value(text)


def arguments_match(expected: Column, actual: Column, compare: Column) -> Column:
    """Whether an actual call's arguments (JSON text) agree with the expected ones in every name of ``compare``: the name
    is there, and where a value is expected it is that value.  A null ``compare`` compares nothing."""

    def agrees(v: Column) -> Column:
        want, got = v["want"], v["got"]
        same = lambda k: F.map_contains_key(got, k) & F.coalesce(F.try_element_at(want, k) == F.try_element_at(got, k), ~F.map_contains_key(want, k), F.lit(True))
        return F.coalesce(F.forall(compare, same), F.lit(False))

    both = F.struct(json_map(expected).alias("want"), json_map(actual).alias("got"))
    return F.when(compare.isNull(), F.lit(True)).otherwise(once(both, agrees))


def first_difference(correct: Column, wrong: Column) -> Column:
    """The first argument, in the order of the correct ones, that both maps have with different values; else the first of
    the wrong ones."""
    differing = F.filter(F.map_keys(correct), lambda k: F.map_contains_key(wrong, k) & (F.element_at(correct, k) != F.element_at(wrong, k)))
    return F.coalesce(F.get(differing, F.lit(0)), F.get(F.map_keys(wrong), F.lit(0)))
