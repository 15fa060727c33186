"""Column functions over message text: tool calls, error predicates, clean-up, templates.  All built-in, JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CALL_SCHEMA = "name string, arguments string"

# The words, headings and patterns below are part of the data formats and must stay as they are.
ERROR_WORDS = ("error", "not found", "invalid", "failed", "does not exist", "no such", "cannot", "unable to", "exception")
NOT_RECOVERABLE = r"not found|does not exist|tool.*not found|cannot be"
RECOVERABLE = r"missing.*required.*argument|unexpected keyword argument|validation error|invalid.*format|should be|payment.*does not add up|number.*does not match|should match|balance.*not enough|insufficient"
CONNECTION_WORDS = ("connection", "timeout", "refused", "unavailable", "503", "502", "500", "network", "socket", "eof")
STOP_SIGNALS = ("[STOP]", "###STOP###", "###TRANSFER###", "###OUT-OF-SCOPE###")
ANALYSIS_CUTS = ("## Error Analysis", "## Success Analysis", "## Contrast Analysis")
ANALYSIS_MARKERS = ("## Error Analysis", "## Success Analysis", "## Contrast Analysis", "### Why It Failed", "### Key Differences", "### Correct Steps")
PROMPT_CUTS = ("## Error Analysis", "## Contrast Analysis")
THINK_TAGS = ("think", "thinking", "thought")
ID_TEMPLATES = (
    (r"\b[a-z]+_[a-z]+_\d+\b", "{user_id}"),
    (r"#W\d+", "{order_id}"),
    (r"\b[A-Z]{6}\b", "{reservation_id}"),
    (r"HAT\d+", "{flight_number}"),
    (r"P\d+", "{phone_number}"),
    (r"C\d+", "{customer_id}"),
    (r"\b\d{10}\b", "{product_id}"),
    (r"\d{4}-\d{2}-\d{2}", "{date}"),
    (r"\b\d+\b", "{amount}"),
)
# End of fixed values.


def once(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.transform(F.array(value), fn)[0]


def any_of(words: tuple[str, ...]) -> str:
    """A pattern that finds any of the words; regular expression signs in them count as themselves."""
    import re

    return "|".join(re.escape(w).replace("\\ ", " ") for w in words)


def text_or_empty(content: Column) -> Column:
    return F.coalesce(content, F.lit(""))


def first_tool_call(content: Column) -> Column:
    """(name, arguments JSON) of the first ``<tool_call>{...}</tool_call>``; null if there is none or it lacks a name or arguments."""
    raw = F.regexp_extract(content, r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>", 1)
    call = F.from_json(raw, CALL_SCHEMA)
    return F.when(call["name"].isNotNull() & call["arguments"].isNotNull(), call)


def all_tool_calls(content: Column) -> Column:
    """All calls of a message in order; texts that do not parse are skipped."""
    raw = F.regexp_extract_all(text_or_empty(content), F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    return F.filter(F.transform(raw, lambda x: F.from_json(F.trim(x), CALL_SCHEMA)), lambda c: c["name"].isNotNull())


def render_tool_call(name: Column, arguments: Column) -> Column:
    """The text form of a call; ``arguments`` is JSON text and keeps its key order."""
    return F.concat(F.lit('<tool_call>{"name": "'), name, F.lit('", "arguments": '), arguments, F.lit("}</tool_call>"))


def render_tool_response(name: Column, result: Column) -> Column:
    return F.concat(F.lit('{"name": "'), name, F.lit('", "result": "'), result, F.lit('"}'))


def one_json_value(content: Column) -> Column:
    """Whether the whole text is one JSON value.

    The built-in parsers accept whatever follows the first value, so the text must also be the first of exactly two
    elements of a list.  An object with a repeated key does not count."""
    return F.coalesce(F.try_parse_json(content).isNotNull() & one_element(content), F.lit(False))


def one_element(content: Column) -> Column:
    """Whether a text is the first of exactly two elements of a list."""
    return F.json_array_length(F.concat(F.lit("["), content, F.lit(",0]"))) == 2


def one_json_object(content: Column) -> Column:
    return F.coalesce(F.startswith(content, F.lit("{")), F.lit(False)) & one_json_value(content)


def response_result(content: Column) -> Column:
    """``result`` of a tool message that is one JSON object; null otherwise, so for several objects in a row."""
    return F.when(one_json_object(content), F.get_json_object(content, "$.result"))


def tool_response(content: Column, need_name: bool = False) -> Column:
    """(name, result) of a tool message that is one JSON object, with a name if ``need_name``; null otherwise."""
    parts = F.struct(F.get_json_object(content, "$.name").alias("name"), F.get_json_object(content, "$.result").alias("result"))
    fine = one_json_object(content)
    return F.when(fine & F.get_json_object(content, "$.name").isNotNull() if need_name else fine, parts)


def first_object(content: Column) -> Column:
    """(text, end) of the JSON object that a text begins with, whatever follows it; null if it begins with none, is cut off
    inside it, or what its brackets enclose is no JSON (or has a key twice).  ``end`` is the number of characters.

    The text is read as tokens, which are whole strings, single brackets, and what lies between; a fold carries the place
    and the depth, and the object ends where the depth comes back to zero."""
    tokens = F.regexp_extract_all(content, F.lit(r'(?s)"(?:[^"\\]|\\.)*+"|[{}\[\]]|[^"{}\[\]]++|"'), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"))

    def step(s: Column, token: Column) -> Column:
        at = s["at"] + F.length(token)
        depth = s["depth"] + F.when(token.isin("{", "["), 1).when(token.isin("}", "]"), -1).otherwise(0)
        return F.struct(at.alias("at"), depth.alias("depth"), F.when(s["end"] > 0, s["end"]).when((depth == 0) & token.isin("}", "]"), at).otherwise(0).alias("end"))

    end = F.aggregate(tokens, start, step)["end"]
    found = once(end, lambda e: F.when(e > 0, F.struct(F.substring(content, F.lit(1), e).alias("text"), e.alias("end"))))
    whole = once(found, lambda f: F.when(F.try_parse_json(f["text"]).isNotNull(), f))
    return F.when(F.startswith(content, F.lit("{")), whole)


def plausible_response(content: Column) -> Column:
    """Whether a tool message may stand in training data: any text that does not begin like an object; a text whose first
    object parses, whatever follows it; or one that was cut off behind the keys of a result."""
    content = text_or_empty(content)
    has = lambda key: F.contains(content, F.lit(f'"{key}"'))
    cut_off = has("name") & (has("result") | has("error"))
    return (content != "") & (~F.startswith(content, F.lit("{")) | F.try_parse_json(content).isNotNull() | cut_off)


def well_formed_calls(content: Column) -> Column:
    """At least one call, and every call one JSON object with a name and arguments."""
    raw = F.regexp_extract_all(text_or_empty(content), F.lit(r"(?s)<tool_call>\s*(\{.*?\})\s*</tool_call>"), F.lit(1))
    whole = lambda x: one_json_object(x) & F.get_json_object(x, "$.name").isNotNull() & F.get_json_object(x, "$.arguments").isNotNull()
    return (F.size(raw) > 0) & F.forall(raw, whole)


def has_error_word(content: Column) -> Column:
    """The loose predicate: any error word in any case; empty or null is no error."""
    return F.lower(text_or_empty(content)).rlike(any_of(ERROR_WORDS))


def is_error_response(content: Column) -> Column:
    """JSON: its result starts with ``Error:``; other text: contains it."""
    content = text_or_empty(content)
    return F.when(F.startswith(content, F.lit("{")), F.coalesce(F.startswith(response_result(content), F.lit("Error:")), F.lit(False))).otherwise(F.contains(content, F.lit("Error:")))


def is_error_result(content: Column) -> Column:
    """Only a JSON object whose result starts with ``Error:``."""
    return F.coalesce(F.startswith(response_result(text_or_empty(content)), F.lit("Error:")), F.lit(False))


def contains_error(content: Column) -> Column:
    """Result, or the raw text where there is none, contains ``Error:``."""
    content = text_or_empty(content)
    return F.contains(F.coalesce(response_result(content), content), F.lit("Error:"))


def tool_result_preview(content: Column, size: int = 200) -> Column:
    return F.substring(text_or_empty(content), 1, size)


def strip_text(content: Column) -> Column:
    """Without white space at both ends, line breaks included."""
    return F.regexp_replace(content, r"^\s+|\s+$", "")


def remove_think_tags(content: Column) -> Column:
    """Drop think blocks, squeeze three or more line breaks to two, strip."""
    out = content
    for tag in THINK_TAGS:
        out = F.regexp_replace(out, rf"(?s)<{tag}>.*?</{tag}>", "")
    return strip_text(F.regexp_replace(out, "\n{3,}", "\n\n"))


def without_analysis(messages: Column) -> Column:
    """(role, content, ...) messages: an assistant's text ends at the first analysis heading; what is empty then goes."""
    marked = lambda m: (m["role"] == "assistant") & has_analysis(m["content"])
    cut = F.transform(messages, lambda m: m.withField("content", F.when(marked(m), cut_analysis(m["content"])).otherwise(m["content"])))
    flags = F.transform(messages, lambda m: F.coalesce(marked(m), F.lit(False)))
    kept = F.filter(F.arrays_zip(cut.alias("m"), flags.alias("cut")), lambda x: ~(x["cut"] & (F.coalesce(x["m"]["content"], F.lit("")) == "")))
    return F.transform(kept, lambda x: x["m"])


def cut_analysis(content: Column) -> Column:
    """Text before the earliest analysis heading, stripped."""
    places = [F.nullif(F.locate(h, content), F.lit(0)) for h in ANALYSIS_CUTS]
    first = F.least(*places)
    return strip_text(F.when(first.isNotNull(), F.substr(content, F.lit(1), first - 1)).otherwise(content))


def clean_system_prompt(prompt: Column) -> Column:
    """The prompt before the analysis that was added to it, stripped."""
    out = prompt
    for heading in PROMPT_CUTS:
        out = F.substring_index(out, heading, 1)
    return strip_text(out)


def has_analysis(content: Column) -> Column:
    return text_or_empty(content).rlike(any_of(ANALYSIS_MARKERS))


def error_template(message: Column) -> Column:
    """Identifiers and numbers replaced by placeholders, one pattern after the other in the fixed order."""
    out = message
    for pattern, name in ID_TEMPLATES:
        out = F.regexp_replace(out, pattern, name)
    return out


def fill_template(template: Column, values: Column) -> Column:
    """``{key}`` replaced by its value in the map; placeholders without a value stay."""
    return F.aggregate(F.map_entries(values), template, lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))


def is_recoverable(message: Column) -> Column:
    """Deny words first, then allow words, else false."""
    low = F.lower(text_or_empty(message))
    return F.when(low.rlike(NOT_RECOVERABLE), F.lit(False)).when(low.rlike(RECOVERABLE), F.lit(True)).otherwise(F.lit(False))


def is_connection_error(message: Column) -> Column:
    return F.lower(text_or_empty(message)).rlike(any_of(CONNECTION_WORDS))


def has_stop_signal(content: Column) -> Column:
    return text_or_empty(content).rlike(any_of(STOP_SIGNALS))


def strip_code_fence(content: Column) -> Column:
    """Without a leading fence, with or without ``json``, and a trailing one."""
    return strip_text(F.regexp_replace(F.regexp_replace(strip_text(content), r"^```(json)?\s*", ""), r"\s*```$", ""))


def outer_object(content: Column) -> Column:
    """From the first ``{`` to the last ``}``; empty if there is none."""
    return F.regexp_extract(content, r"(?s)(\{.*\})", 1)


def outer_array(content: Column) -> Column:
    return F.regexp_extract(content, r"(?s)(\[.*\])", 1)


def sentence_count(reply: Column) -> Column:
    return F.size(F.filter(F.split(text_or_empty(reply), r"\."), lambda s: F.trim(s) != ""))


def reply_too_long(reply: Column, sentences: int = 5, chars: int = 300) -> Column:
    return (sentence_count(reply) > sentences) | (F.length(text_or_empty(reply)) > chars)


def has_placeholder(value: Column) -> Column:
    """A text with ``<`` and ``>``, or ``{{`` and ``}}``, or one of more than ten characters without lower case and with
    an underscore.  A list (as JSON text) has one if an element has ``<`` and ``>``."""
    both = lambda text, a, b: F.contains(text, F.lit(a)) & F.contains(text, F.lit(b))
    shouted = (F.upper(value) == value) & F.contains(value, F.lit("_")) & (F.length(value) > 10)
    listed = F.exists(F.from_json(value, "array<string>"), lambda x: both(x, "<", ">"))
    single = both(value, "<", ">") | both(value, "{{", "}}") | shouted
    return F.coalesce(F.when(F.startswith(value, F.lit("[")), F.coalesce(listed, F.lit(False))).otherwise(single), F.lit(False))


def fill_with_defaults(template: Column, values: Column, defaults: Column) -> Column:
    """``{key}`` replaced by its value, else by its default, else by ``unknown``."""
    filled = fill_template(fill_template(template, values), defaults)
    return F.regexp_replace(filled, r"\{\w+\}", "unknown")


#: What ``format_safe`` says where a template could not be filled.
SAFE_SENTENCE = "Something went wrong with that call; I will correct it and retry with the right parameters."


def format_safe(template: Column, values: Column) -> Column:
    """``fill_template``, or a fixed sentence if a placeholder is left."""
    return once(fill_template(template, values), lambda filled: F.when(filled.rlike(r"\{\w+\}"), F.lit(SAFE_SENTENCE)).otherwise(filled))


def without_model_prefix(name: Column) -> Column:
    """A model's name without the provider in front of it."""
    return F.element_at(F.split(name, "/"), -1)


def domain_of_path(path: Column) -> Column:
    out = F.when(F.contains(path, F.lit("airline")), "airline").when(F.contains(path, F.lit("retail")), "retail")
    return out.when(F.contains(path, F.lit("telecom")), "telecom").otherwise("unknown")


def transcript(messages: Column) -> Column:
    """``role: content`` lines of an array of (role, content) messages."""
    return F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), text_or_empty(m["content"]))), "\n")


def context_tail(messages: Column, k: int = 6, chars: int = 200) -> Column:
    """The last ``k`` messages, each cut to ``chars`` characters."""
    return F.transform(F.slice(messages, F.greatest(F.lit(1), F.size(messages) - (k - 1)), k), lambda m: F.struct(m["role"].alias("role"), F.substring(text_or_empty(m["content"]), 1, chars).alias("content")))
