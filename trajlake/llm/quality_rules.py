"""Quality rules whose cutoffs carry a finite-sample guarantee; DataFrame functions only.

A rule compares one statistic of the text with a cutoff.  For every stratum (the language) and rule, a fixed grid
of cutoffs is walked from the most lenient to the strictest.  A cutoff is certified while the exact binomial tail
P(Binomial(n, budget) <= false rejections) on the labelled holdout stays at or below delta / (strata x rules): the
grid is fixed in advance, so testing in order needs no further correction (fixed-sequence testing), and Bonferroni
covers rules and strata.  ``budget`` is alpha / rules, so all rules together reject at most a share ``alpha`` of a
stratum's good documents, in every stratum at once, with confidence 1 - delta.  Among certified cutoffs the one
that rejects the most bad documents, less ``WORTH`` for each good one, is used; a rule that gains nothing stays off.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import materialize

#: Most false rejections allowed, as a share of a stratum's good documents, over all rules.
ALPHA = 0.05
#: Most risk that any stratum breaks that promise.
DELTA = 0.05
#: Bad documents that must go for each good one that goes too.
WORTH = 5
#: Rules: the statistic and its cutoffs from lenient to strict; a text fails where the statistic exceeds the cutoff.
RULES = {
    "symbols_per_word": (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.2, 0.1),
    "capital_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2),
    "duplicate_line_share": (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1),
    "repeated_word_share": (0.9, 0.7, 0.5, 0.3, 0.25, 0.2, 0.15, 0.1),
    "long_words": (40.0, 30.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0),
    "short_words": (-1.5, -2.0, -2.5, -3.0, -3.5, -4.0),
}
WORD_BREAK = "[\\x20\\x09-\\x0D]+"
WINDOW = 8


def _once(value: Column, body) -> Column:
    """``body`` of a value that is computed once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def _covered_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more in the text, the first occurrence included."""

    def of_hashes(h: Column) -> Column:
        windows = F.when(F.size(h) >= WINDOW, F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
        return _once(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(repeated(w)))

    def repeated(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, k: F.coalesce(same(x, k), F.get(s, k - 1)["h"] == x["h"], F.get(s, k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"]))

        start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(_once(placed, twice), start, lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["at"])).alias("n")), lambda acc: acc["n"])

    return _once(F.transform(words, lambda w: F.xxhash64(w)), of_hashes)


def _counts(text: Column) -> dict[str, Column]:
    """The counts the rules need (all long), in structs by what they are taken from; null text: no words."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    measures = _once(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _covered_words(w).alias("n_repeat_words"),
        ),
    )
    line_counts = _once(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    count_of = lambda pattern: (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")
    return {"_w": measures, "_l": line_counts, "n_symbols": count_of("[#*$%&|<>]+"), "n_capitals": count_of("[A-Z]+")}


#: The counts, by their places among the columns of ``_counts``.
COUNTS = ("_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words", "n_capitals")


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """One row for each document: id, stratum (null: empty string), the counts of the rules."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    kept = docs.select(F.col(id_col).alias("doc_id"), stratum.alias("stratum"), F.col(text_col).alias("text"))
    return kept.withColumns(_counts(F.col("text"))).select("doc_id", "stratum", *COUNTS)


def rule_values() -> dict[str, Column]:
    """The statistic of each rule, from the counts."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbols_per_word": ratio("n_symbols", "n_words"),
        "capital_share": ratio("n_capitals", "word_chars"),
        "duplicate_line_share": ratio("n_dup_lines", "n_lines"),
        "repeated_word_share": ratio("n_repeat_words", "n_words"),
        "long_words": ratio("word_chars", "n_words"),
        "short_words": -ratio("word_chars", "n_words"),
    }


def _log_gamma(x: Column) -> Column:
    """ln(Gamma(x)) for x >= 1: Stirling's series at x + 8, brought back by the recurrence."""
    y = x + 8.0
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    steps = F.log(x)
    for k in range(1, 8):
        steps = steps + F.log(x + float(k))
    return series - steps


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k); sums downwards from k and leaves out only terms far below a double's precision."""
    n, k = n.cast("double"), k.cast("double")
    import math

    top = _log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    reach = F.least(k, 40 * F.sqrt(n) + 60).cast("int")
    odds = (1 - p) / p

    def sum_down(v: Column) -> Column:
        start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

        def step(acc: Column, j: Column) -> Column:
            term = acc["term"] * (v["k"] - j + 1) / (v["n"] - v["k"] + j) * odds
            return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

        steps = F.when(v["reach"] >= 1, F.sequence(F.lit(1), v["reach"])).otherwise(F.array().cast("array<int>"))
        return F.least(F.lit(1.0), F.exp(v["top"]) * F.aggregate(steps, start, step, lambda acc: acc["total"]))

    value = _once(F.struct(n.alias("n"), k.alias("k"), top.alias("top"), reach.alias("reach")), sum_down)
    return F.when(k >= n * p, F.lit(1.0)).when(n <= 0, F.lit(1.0)).otherwise(value)


def certified_cutoffs(statistics: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """(stratum, rule, cutoff) of the rules in force.  ``labels``: doc_id, quality 0/1; a label that is null or repeated
    with another value does not count.  One aggregation over the labelled rows; what follows has strata x grid rows."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_q")).where("quality = _q").drop("_q")
    values = statistics.select("doc_id", "stratum", *[v.alias(k) for k, v in rule_values().items()]).join(marks, "doc_id")
    grid = [(rule, i, float(cut)) for rule, cuts in rules.items() for i, cut in enumerate(cuts)]
    counts = ["count_if(quality = 1) AS n_good"]
    for rule, i, cut in grid:
        counts += [f"count_if({rule} > {cut}D AND quality = {q}) AS {rule}_{i}_{q}" for q in (0, 1)]
    wide = values.groupBy("stratum").agg(*map(F.expr, counts))
    points = ", ".join(f"struct('{rule}' AS rule, {i} AS step, {cut}D AS cutoff, {rule}_{i}_1 AS false_rejects, {rule}_{i}_0 AS bad_rejects)" for rule, i, cut in grid)
    counted = wide.withColumn("strata", F.count("*").over(_all()))  # before the points are spread
    long = counted.select("stratum", "n_good", "strata", F.explode(F.expr(f"array({points})")).alias("p")).select("stratum", "n_good", "strata", "p.*")
    p_value = binomial_tail(F.col("n_good"), F.col("false_rejects"), alpha / len(rules))
    tested = long.withColumn("passes", p_value <= F.lit(delta) / (F.col("strata") * len(rules)))
    from pyspark.sql import Window

    walk = Window.partitionBy("stratum", "rule").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("bad_rejects") - WORTH * F.col("false_rejects")
    certified = tested.withColumn("certified", F.min("passes").over(walk)).where("certified").where(gain > 0)
    return certified.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, -F.col("step"))).alias("cutoff"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(1))


def _wide(cutoffs: DataFrame, rules: dict[str, tuple[float, ...]]) -> DataFrame:
    """A row for each stratum, a column for each rule's cutoff."""
    return cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"_c_{r}") for r in rules])


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def judge(statistics: DataFrame, cutoffs: DataFrame, rules: dict[str, tuple[float, ...]] = RULES) -> DataFrame:
    """``statistics`` with base_failed, rules_failed (array of rule names) and kept."""
    fails = F.array_compact(F.array(*[F.when(v > F.col(f"_c_{r}"), F.lit(r)) for r, v in rule_values().items() if r in rules]))
    joined = statistics.join(_wide(cutoffs, rules), "stratum", "left").withColumns({"base_failed": _base_failed(), "rules_failed": fails})
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("rules_failed") == 0)).drop(*[f"_c_{r}" for r in rules])


def quality_rules(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """Judge every document.  One row for each input row, repeated ids and null ids included.

    Null and empty texts have no words and fail the base rule.  A stratum without enough labels gets no cutoffs, so
    only the base rule applies there; so it is with an empty ``labels``.  Columns of ``docs`` other than the three
    named are not read, whatever their names.
    """
    statistics = materialize(document_statistics(docs, id_col, text_col, stratum_col))
    return judge(statistics, certified_cutoffs(statistics, labels, alpha, delta))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns as they were.

    Every text is measured once: rows are written with their counts, the cutoffs are taken from the counts of labelled
    rows, and the rows are read again.  No text is shuffled.  The cases are those of ``quality_rules``."""
    stratum = F.coalesce(F.col("row")[stratum_col].cast("string"), F.lit("")) if stratum_col else F.lit("")
    packed = docs.select(F.struct("*").alias("row")).withColumn("stratum", stratum)
    measured = materialize(packed.withColumns(_counts(F.col("row")[text_col])).select("row", F.col("row")[id_col].alias("doc_id"), "stratum", *COUNTS))
    cutoffs = materialize(certified_cutoffs(measured.drop("row"), labels, alpha, delta))
    return judge(measured, cutoffs).where("kept").select("row.*")
