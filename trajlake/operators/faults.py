"""Making wrong calls with their error messages, and recoveries: by rules over the error database and template tables.

Arguments are maps from name to JSON text (``matching.json_map``), so a changed value keeps the others as they were.
Every choice is by the hash of a row's key, so it is the same on any cluster.  Template tables are small and given by
the caller: (kind, domain, tool, text), a null domain or tool standing for any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.functions.matching import bare, first_difference, json_map
from trajlake.functions.text import fill_template, first_tool_call, format_safe, is_recoverable, once, remove_think_tags, strip_text, text_or_empty
from trajlake.operators.inject import ERROR_MESSAGES, recovery_thought
from trajlake.operators.sampling import pick_weighted, uniform
from trajlake.operators.training import CALL_CLOSE, CALL_OPEN, _string, call_text

# Weights of the kinds of errors, words that mark errors of a kind in the database, changes of numbers.
KIND_WEIGHTS = {"parameter": 0.35, "business": 0.30, "state": 0.15, "hallucination": 0.20}
PARAMETER_WORDS = ("not found", "invalid", "missing", "validation")
STATE_WORDS = ("cannot be", "must be", "not allowed", "invalid state", "suspended", "pending", "closed", "cancelled", "delivered", "non-pending", "non-delivered", "already")
DELTAS, FACTORS = (-100, -50, -10, 10, 50, 100), (0.5, 0.8, 1.2, 1.5)
# End of fixed values.

#: Own sentences of a recovery by kind of error; callers may give others.
RECOVERIES = (
    ("parameter", "The value '{wrong_value}' for {param} was wrong; it should be '{correct_value}'. I will retry with that."),
    ("business", "The request broke a rule ({error}). I will work out the right values and retry."),
    ("state", "This is not possible in the present state ({error}). I will check the state and go on from there."),
    ("hallucination", "There is no tool '{wrong_tool}'; the right one is '{correct_tool}'. I will use it."),
)


def pick(options: Column, mode: Column) -> Column:
    """An element of an array by a non-negative number; null of an empty one."""
    return F.when(F.size(options) > 0, F.get(options, F.pmod(mode, F.size(options)).cast("int")))


def draw(key: Column, seed: int) -> Column:
    """A whole number below 2**31 from key and seed."""
    return F.floor(uniform(key, seed) * 2147483648.0).cast("long")


# --- wrong values --------------------------------------------------------------------------------------------------------


def corrupt_string(value: Column, mode: Column) -> Column:
    """A wrong text: without its last character or its last two, with dashes for underscores or an ending, its first
    half, or marked as invalid; always another text."""
    n = F.length(value)
    head = lambda k: F.substr(value, F.lit(1), F.greatest(k, F.lit(0)))
    ways = (
        head(n - 1),
        F.when(n > 2, head(n - 2)).otherwise(head(n - 1)),
        F.when(F.contains(value, F.lit("_")), F.replace(value, F.lit("_"), F.lit("-"))).otherwise(F.concat(value, F.lit("_typo"))),
        head(F.floor(n / 2).cast("int")),
        F.concat(F.lit("invalid_"), head(F.lit(5))),
    )
    way = F.pmod(mode, F.lit(len(ways)))
    out = ways[-1]
    for k, w in enumerate(ways[:-1]):
        out = F.when(way == k, w).otherwise(out)
    out = F.when(out == value, head(n - 1)).otherwise(out)
    return F.when(n <= 1, F.concat(value, F.lit("_typo"))).otherwise(out)


def corrupt_value(value: Column, mode: Column) -> Column:
    """A wrong value of the same kind, as JSON text: texts as above, whole numbers moved, others scaled, lists without
    their last element, objects without one key; what has nothing to lose stays."""
    number = value.try_cast("double")
    whole = value.rlike("^-?[0-9]+$")
    moved = (value.try_cast("long") + F.element_at(F.array(*map(F.lit, DELTAS)), (F.pmod(mode, F.lit(len(DELTAS))) + 1).cast("int"))).cast("string")
    scaled = (number * F.element_at(F.array(*map(F.lit, FACTORS)), (F.pmod(mode, F.lit(len(FACTORS))) + 1).cast("int"))).cast("string")
    fields = json_map(value)
    lost = pick(F.map_keys(fields), mode)
    return (
        F.when(F.startswith(value, F.lit('"')), _string(corrupt_string(bare(value), mode)))
        .when(whole, moved)
        .when(number.isNotNull(), scaled)
        .when(F.startswith(value, F.lit("[")), shorter_list(value))
        .when(F.startswith(value, F.lit("{")), render(F.map_filter(fields, lambda k, v: k != lost)))
        .otherwise(value)
    )


def elements(value: Column) -> Column:
    """The elements of a JSON list as JSON texts."""
    return F.transform(F.try_parse_json(value).try_cast("array<variant>"), lambda x: F.coalesce(F.to_json(x), F.lit("null")))


def as_list(items: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


def shorter_list(value: Column) -> Column:
    """A list without its last element; an empty one stays empty."""
    items = elements(value)
    return as_list(F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0))))


def render(arguments: Column) -> Column:
    """A map of JSON texts as a JSON object."""
    return F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(arguments), lambda e: F.concat(_string(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))


def _is_number(value: Column) -> Column:
    return value.rlike("^-?[0-9]")


def _scaled_amounts(value: Column, factor: float) -> Column:
    """A list of objects with every ``amount`` scaled to a whole number."""

    def one(item: Column) -> Column:
        amount = F.get_json_object(item, "$.amount").try_cast("double")
        changed = F.transform_values(json_map(item), lambda k, v: F.when((k == "amount") & amount.isNotNull(), F.floor(amount * factor).cast("long").cast("string")).otherwise(v))
        return F.when(amount.isNotNull(), render(changed)).otherwise(item)

    return as_list(F.transform(elements(value), one))


def wrong_arguments(arguments: Column, error: Column, mode: Column) -> Column:
    """Arguments that fit an error message.

    A payment's amount: amounts four fifths of what they were.  Something missing: one argument less.  Numbers that do
    not match: lists one shorter.  A balance: amounts half as much again.  Anything else, or where this changes nothing:
    one argument corrupted (for what was not found an id, number or code if there is one).  No arguments: none."""
    low = F.lower(text_or_empty(error))
    has = lambda *words: F.forall(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    names = F.map_keys(arguments)
    money = lambda k: F.lower(k).rlike("amount|payment")
    scale = lambda v, f: F.floor(v.try_cast("double") * f).cast("long").cast("string")
    paid = F.transform_values(arguments, lambda k, v: F.when(money(k) & _is_number(v), scale(v, 0.8)).when(money(k) & F.startswith(v, F.lit("[")), _scaled_amounts(v, 0.8)).otherwise(v))
    dearer = F.transform_values(arguments, lambda k, v: F.when(F.contains(F.lower(k), F.lit("amount")) & _is_number(v), scale(v, 1.5)).otherwise(v))
    fewer = F.transform_values(arguments, lambda k, v: F.when(F.startswith(v, F.lit("[")) & (F.json_array_length(v) > 1), shorter_list(v)).otherwise(v))
    less = F.map_filter(arguments, lambda k, v: k != pick(names, mode))
    identifiers = F.filter(names, lambda k: F.lower(k).rlike("id|number|code"))
    target = F.when(has("not found") & (F.size(identifiers) > 0), F.get(identifiers, F.lit(0))).otherwise(pick(names, mode))
    spoilt = F.transform_values(arguments, lambda k, v: F.when(k == target, corrupt_value(v, mode)).otherwise(v))
    fitted = F.when(has("payment", "amount"), paid).when(has("missing"), less).when(has("number", "match"), fewer).when(F.contains(low, F.lit("balance")) | F.contains(low, F.lit("insufficient")), dearer).otherwise(spoilt)
    return F.when(F.size(names) > 0, once(fitted, lambda f: F.when(F.map_entries(f) == F.map_entries(arguments), spoilt).otherwise(f)))


# --- errors ------------------------------------------------------------------------------------------------------------------


def choose_templates(points: DataFrame, db: DataFrame, seed: int, wanted: Column | None = None) -> DataFrame:
    """``points`` (key, domain, tool, ...) with ``template``: one of the errors the database has for the domain's tool, in
    proportion to its count; null where there is none that is ``wanted`` (recoverable ones if not given)."""
    usable = db.where(is_recoverable(F.col("error")) if wanted is None else wanted).select("domain", "tool", F.col("error").alias("template"), "count")
    return pick_weighted(points, usable, ("domain", "tool"), "count", "template", "key", seed, small=True)


def rule_errors(points: DataFrame, db: DataFrame, seed: int) -> DataFrame:
    """An error for each call: (key, domain, tool, arguments, wrong, error, recovery, template), arguments and wrong as JSON
    text; template is null where the error is not of the database.

    A recoverable template of the database, filled with the call's arguments; else one argument corrupted and one of the
    three messages for it.  Calls without arguments, or whose arguments are no object, get none.  ``points``: key, domain,
    tool, arguments as JSON text."""
    chosen = choose_templates(points, db, seed).withColumns({"_a": json_map(F.col("arguments")), "_m": draw(F.col("key"), seed + 1)})
    chosen = chosen.where(F.size("_a") > 0)
    fill = fill_template(F.col("template"), F.transform_values("_a", lambda k, v: bare(v)))
    param = pick(F.map_keys("_a"), F.col("_m"))
    spoilt = F.transform_values("_a", lambda k, v: F.when(k == param, corrupt_value(v, F.col("_m"))).otherwise(v))
    wrong = F.when(F.col("template").isNull(), spoilt).otherwise(wrong_arguments(F.col("_a"), F.col("template"), F.col("_m")))
    step = chosen.withColumns({"_param": param, "_wrong": wrong})
    value = bare(F.element_at("_wrong", F.col("_param")))
    message = F.replace(F.replace(pick(F.array(*map(F.lit, ERROR_MESSAGES)), F.col("_m")), F.lit("{param}"), F.col("_param")), F.lit("{wrong}"), text_or_empty(value))
    thought = F.concat(F.lit("The value '"), text_or_empty(value), F.lit("' for "), F.col("_param"), F.lit(" was wrong; it should be '"), bare(F.element_at("_a", F.col("_param"))), F.lit("'. I will correct it and retry."))
    error = F.when(F.col("template").isNull(), message).otherwise(fill)
    return step.select("key", "domain", "tool", "arguments", render(F.col("_wrong")).alias("wrong"), error.alias("error"), F.when(F.col("template").isNull(), thought).otherwise(recovery_thought(fill)).alias("recovery"), "template")


def _options(templates: DataFrame, kind: str) -> DataFrame:
    """Texts of a kind by domain and tool, as sorted arrays (the tables are small by nature)."""
    return templates.where(F.col("kind") == kind).groupBy("domain", "tool").agg(F.array_sort(F.collect_set("text")).alias(f"_{kind}"))


def with_templates(points: DataFrame, templates: DataFrame) -> DataFrame:
    """``points`` (domain, tool) with the texts of business errors and hallucinated names of their tool, and of the state
    errors of their domain."""
    of_tool = lambda kind: F.broadcast(_options(templates, kind).where("tool is not null"))
    states = _options(templates, "state").groupBy("domain").agg(F.array_sort(F.flatten(F.collect_list("_state"))).alias("_state"))
    out = points.join(of_tool("business"), ["domain", "tool"], "left").join(of_tool("hallucination"), ["domain", "tool"], "left")
    return out.join(F.broadcast(states), "domain", "left")


def error_kind(available: dict[str, Column], u: Column) -> Column:
    """A kind of error by weight among those at hand (booleans by kind); ``u`` in [0, 1)."""
    weight = {k: F.when(available[k], F.lit(w)).otherwise(F.lit(0.0)) for k, w in KIND_WEIGHTS.items()}
    total = sum(weight.values(), F.lit(0.0))
    out, reached = F.lit(None).cast("string"), F.lit(0.0)
    steps = []
    for k in KIND_WEIGHTS:
        reached = reached + weight[k]
        steps.append((k, reached))
    for k, high in reversed(steps):
        out = F.when((u * total < high) & available[k], F.lit(k)).otherwise(out)
    return out


def typed_errors(points: DataFrame, db: DataFrame, templates: DataFrame, seed: int) -> DataFrame:
    """An error of one of four kinds for each call: (key, domain, tool, arguments, kind, wrong_tool, wrong, error).

    parameter: always at hand; a database error about parameters, else a message for a corrupted argument.
    business: where the tool has such templates; arguments changed to fit.  state: where the database has state errors
    of the tool; the call is right, only its time is not.  hallucination: where the tool has names it is mistaken for.
    The kind is drawn by weight among those at hand.  A call without arguments has no parameter or business error."""
    of = lambda words: F.lower(F.col("error")).rlike("|".join(words))
    found = choose_templates(points, db, seed, of(PARAMETER_WORDS)).withColumnRenamed("template", "_db_parameter")
    found = choose_templates(found, db, seed + 1, of(STATE_WORDS)).withColumnRenamed("template", "_db_state")
    rows = with_templates(found, templates).withColumns({"_a": json_map(F.col("arguments")), "_m": draw(F.col("key"), seed + 2)})
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    found = F.struct(some("_a").alias("a"), some("_business").alias("business"), F.col("_db_state").isNotNull().alias("state"), some("_hallucination").alias("hallucination"), uniform(F.col("key"), seed + 3).alias("u"))
    at_hand = lambda v: {"parameter": v["a"], "business": v["a"] & v["business"], "state": v["state"], "hallucination": v["hallucination"]}
    rows = rows.withColumn("kind", once(found, lambda v: error_kind(at_hand(v), v["u"]))).where("kind is not null")
    values = F.transform_values("_a", lambda k, v: bare(v))
    param = pick(F.map_keys("_a"), F.col("_m"))
    spoilt = F.transform_values("_a", lambda k, v: F.when(k == param, corrupt_value(v, F.col("_m"))).otherwise(v))
    business = pick(F.col("_business"), F.col("_m"))
    template = F.when(F.col("kind") == "parameter", F.col("_db_parameter")).when(F.col("kind") == "business", business).when(F.col("kind") == "state", F.col("_db_state"))
    rows = rows.withColumns({"_t": template, "_param": param, "_name": pick(F.col("_hallucination"), F.col("_m"))})
    wrong = F.when((F.col("kind") == "parameter") & F.col("_t").isNull(), spoilt).when(F.col("kind").isin("parameter", "business"), wrong_arguments(F.col("_a"), F.col("_t"), F.col("_m"))).otherwise(F.col("_a"))
    rows = rows.withColumn("_wrong", wrong)
    own = F.replace(F.replace(pick(F.array(*map(F.lit, ERROR_MESSAGES)), F.col("_m")), F.lit("{param}"), F.col("_param")), F.lit("{wrong}"), text_or_empty(F.substring(bare(F.element_at("_wrong", F.col("_param"))), 1, 50)))
    filled = fill_template(fill_template(F.col("_t"), values), F.transform_values("_wrong", lambda k, v: bare(v)))
    message = F.when(F.col("kind") == "hallucination", F.concat(F.lit("Tool '"), F.col("_name"), F.lit("' not found."))).when(F.col("_t").isNull(), own).otherwise(filled)
    return rows.select(
        "key", "domain", "tool", "arguments", "kind", F.when(F.col("kind") == "hallucination", F.col("_name")).otherwise(F.col("tool")).alias("wrong_tool"), F.when(F.col("_wrong").isNotNull(), render(F.col("_wrong"))).otherwise(F.col("arguments")).alias("wrong"), F.concat(F.lit("Error: "), message).alias("error")
    )


# --- recoveries -----------------------------------------------------------------------------------------------------------------


def recoveries(errors: DataFrame, sentences: tuple[tuple[str, str], ...] = RECOVERIES, seed: int = 0) -> DataFrame:
    """``typed_errors`` with ``recovery``: a sentence of the error's kind about the first argument that differs, and the right
    call behind it."""
    table: dict[str, list[str]] = {}
    for kind, text in sentences:
        table.setdefault(kind, []).append(text)
    options = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    both = F.struct(json_map(F.col("arguments")).alias("right"), json_map(F.col("wrong")).alias("wrong"))
    differing = once(both, lambda v: once(first_difference(v["right"], v["wrong"]), lambda p: F.struct(p.alias("param"), F.try_element_at(v["wrong"], p).alias("wrong"), F.try_element_at(v["right"], p).alias("right"))))
    shown = lambda value, default: F.coalesce(F.substring(once(value, bare), 1, 50), F.lit(default))
    values = once(differing, lambda v: F.create_map(
        F.lit("param"), F.coalesce(v["param"], F.lit("parameter")), F.lit("wrong_value"), shown(v["wrong"], "incorrect"), F.lit("correct_value"), shown(v["right"], "correct"), F.lit("error"), F.substring(F.col("error"), 1, 100), F.lit("wrong_tool"), F.col("wrong_tool"), F.lit("correct_tool"), F.col("tool")
    ))
    text = pick(F.coalesce(F.try_element_at(options, F.col("kind")), options[sentences[0][0]]), draw(F.col("key"), seed))
    call = F.concat(F.lit(CALL_OPEN), call_text(F.col("tool"), F.col("arguments")), F.lit(CALL_CLOSE))
    return errors.withColumn("recovery", F.concat(format_safe(text, values), F.lit("\n"), call))


def answered_recovery(answer: Column, tool: Column, arguments: Column) -> Column:
    """A generated recovery made safe: its thought, without think blocks and fences, and its call if that names the right
    tool and has an object of arguments, else the right call."""
    clean = remove_think_tags(answer)
    call = first_tool_call(clean)
    fine = (call["name"] == tool) & json_map(call["arguments"]).isNotNull()
    thought = strip_text(F.replace(F.substring_index(clean, CALL_OPEN, 1), F.lit("```"), F.lit("")))
    said = F.when(thought == "", F.lit("I will correct this and retry.")).otherwise(thought)
    used = F.when(F.coalesce(fine, F.lit(False)), call["arguments"]).otherwise(arguments)
    return F.when(strip_text(text_or_empty(answer)) != "", F.concat(said, F.lit(f"\n{CALL_OPEN}"), call_text(tool, used), F.lit(CALL_CLOSE)))


def varied_persona(persona: Column, key: Column, variants: dict[str, tuple[str, ...]], seed: int, share: float = 0.5, default: str = "Polite and patient customer") -> Column:
    """A persona in other words: of the first keyword it holds, with probability ``share``, a variant; the default for none."""
    low = F.lower(text_or_empty(persona))
    out = persona
    for word, texts in reversed(variants.items()):
        out = F.when(F.contains(low, F.lit(word)), F.when(uniform(key, seed) < share, pick(F.array(*map(F.lit, texts)), draw(key, seed + 1))).otherwise(persona)).otherwise(out)
    return F.when(text_or_empty(persona) == "", F.lit(default)).otherwise(out)


def chosen_points(points: DataFrame, most: int, rate: float, seed: int) -> DataFrame:
    """``inject.choose_points`` with a row for each trajectory: (traj_id, points array), null where none was taken."""
    from trajlake.operators.inject import choose_points

    taken = choose_points(points, most, rate, seed).groupBy("traj_id").agg(F.array_sort(F.collect_list("idx")).alias("points"))
    return points.select("traj_id").distinct().join(taken, "traj_id", "left")


def numbered_segments(segments: DataFrame, decisions: DataFrame, key: str = "traj_id") -> DataFrame:
    """Segments and decisions of a trajectory side by side, by their order (``place``): the first with the first."""
    w = Window.partitionBy(key).orderBy("place")
    number = lambda rows: rows.withColumn("_n", F.row_number().over(w)).drop("place")
    return number(segments).join(number(decisions), [key, "_n"]).withColumnRenamed("_n", "number")
