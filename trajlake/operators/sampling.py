"""Sampling and mixing, deterministic by hash: the same rows for the same seed on any cluster.

Order is md5 of key and seed, so samples nest: the first n of a larger sample are the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajlake.operators.numbering import numbered, running_sum


def shuffle_key(key: str | Column, seed: int) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def uniform(key: str | Column, seed: int) -> Column:
    """A number in [0, 1) from key and seed: the first 32 bits of the hash."""
    return F.conv(F.substring(shuffle_key(key, seed), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample_without_replacement(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    return rows.orderBy(shuffle_key(key, seed), key).limit(n)


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    return rows.orderBy(shuffle_key(key, seed), key)


def cumulative_shares(rows: DataFrame, weight: str, key: str) -> DataFrame:
    """Rows of positive weight with (low, high), their interval on [0, 1) in proportion to the weight, in key order; by a
    running sum that no single task holds."""
    positive = rows.where(F.col(weight) > 0)
    total = positive.agg(F.sum(weight).alias("t")).first()["t"]
    if not total:
        return positive.withColumns({"low": F.lit(0.0), "high": F.lit(0.0)})
    summed = running_sum(positive, [key], F.col(weight), "high")
    return summed.withColumns({"low": (F.col("high") - F.col(weight)) / F.lit(total), "high": F.col("high") / F.lit(total)})


def sample_with_replacement(rows: DataFrame, n: int, weight: str, key: str, seed: int) -> DataFrame:
    """``n`` weighted draws: (draw, columns of the row drawn).  Draws and intervals meet in buckets of [0, 1), so the
    range join is an equi-join.  Without any positive weight up to ``n`` rows are taken uniformly, each once."""
    spark = rows.sparkSession
    buckets = 1024
    if rows.where(F.col(weight) > 0).isEmpty():
        taken = sample_without_replacement(rows, n, key, seed)
        rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(shuffle_key(key, seed), key)) - 1  # at most n rows
        return taken.select(rank.cast("long").alias("draw"), "*")
    shares = cumulative_shares(rows, weight, key)
    spans = shares.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("low") * buckets), F.least(F.floor(F.col("high") * buckets), F.lit(buckets - 1)))))
    draws = spark.range(n).select(F.col("id").alias("draw"), uniform(F.col("id"), seed).alias("_u")).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    return draws.join(spans, "_bucket").where((F.col("_u") >= F.col("low")) & (F.col("_u") < F.col("high"))).drop("_bucket", "_u", "low", "high")


def pick_weighted(rows: DataFrame, options: DataFrame, keys: tuple[str, ...], weight: str, order: str, row_key: str, seed: int, buckets: int = 64, small: bool = False) -> DataFrame:
    """``rows`` with the other columns of ``options``: one option of the row's keys, in proportion to its weight, by the hash
    of the row's key; nulls where the keys have none.

    Options (a dimension: few for each key) get intervals of [0, 1) in the order of ``order``; rows find theirs in buckets.
    ``small``: there are few in all, so they go to the rows, which stay where they are however few keys they have."""
    w = Window.partitionBy(*keys).orderBy(order)
    total = F.sum(weight).over(Window.partitionBy(*keys))
    high = F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0))
    spans = options.where(F.col(weight) > 0).withColumns({"_high": high / total, "_low": (high - F.col(weight)) / total})
    spans = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("_low") * buckets), F.least(F.floor(F.col("_high") * buckets), F.lit(buckets - 1))))).drop(weight)
    drawn = rows.withColumn("_u", uniform(row_key, seed)).withColumn("_bucket", F.floor(F.col("_u") * buckets))
    at = [F.col(f"r.{k}") == F.col(f"o.{k}") for k in (*keys, "_bucket")]
    inside = (F.col("r._u") >= F.col("o._low")) & (F.col("r._u") < F.col("o._high"))
    more = [c for c in spans.columns if c not in (*keys, "_bucket", "_low", "_high")]
    joined = drawn.alias("r").join((F.broadcast(spans) if small else spans).alias("o"), [*at, inside], "left")
    return joined.select(*[F.col(f"r.{c}").alias(c) for c in rows.columns], *[F.col(f"o.{c}").alias(c) for c in more])


def hash_prefix(rows: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """The first ``n`` rows in hash order, as ``sample_without_replacement``, but left where they are: rows below a threshold
    of the hash that surely holds fewer than ``n`` are taken by a filter, and only those near it are ranked."""
    total = rows.count()
    if n >= total:
        return rows
    share = n / total
    margin = 8 * (share * (1 - share) / total) ** 0.5 + 8 / total
    low, high = max(0.0, share - margin), min(1.0, share + margin)
    u = uniform(key, seed)
    below = rows.where(u < low)
    near = rows.where((u >= low) & (u < high))
    return below.unionByName(near.orderBy(shuffle_key(key, seed), key).limit(max(0, n - below.count())))


def ratio_merge(real: DataFrame, synthetic: DataFrame, ratio: float, key: str, seed: int) -> DataFrame:
    """A mix of both with ``ratio`` of the total from ``real``: each side gives what its share asks for, or all it has."""
    n_real, n_synthetic = real.count(), synthetic.count()
    total = n_real + n_synthetic
    if not n_real or not n_synthetic:
        return real.unionByName(synthetic, allowMissingColumns=True)
    want = min(int(total * ratio), n_real), min(int(total * (1 - ratio)), n_synthetic)
    return hash_prefix(real, want[0], key, seed).unionByName(hash_prefix(synthetic, want[1], key, seed), allowMissingColumns=True)


def scaling_subsets(rows: DataFrame, scales: tuple[int, ...], key: str, seed: int) -> DataFrame:
    """(scale, key) of nested subsets; scales beyond the table are left out.  Places in hash order are running counts of
    ranges of the hash, so no single task ranks the table."""
    n = rows.count()
    fitting = [s for s in scales if s <= n]
    if not fitting:
        return rows.select(F.lit(0).alias("scale"), key).limit(0)
    ranked = numbered(rows.select(key, shuffle_key(key, seed).alias("_h")), ["_h", key], "_rank", first=1)
    return ranked.select(F.explode(F.array(*map(F.lit, fitting))).alias("scale"), key, "_rank").where("_rank <= scale").drop("_rank")


def stratified_sample(rows: DataFrame, stratum: str, shares: dict[str, int], key: str, seed: int) -> DataFrame:
    """Up to ``shares[s]`` rows of each stratum: those of the smallest hashes.

    A threshold on the hash, chosen by the stratum's size, lets through a few more rows than are wanted; only those are
    ranked, so no task sorts a stratum.  Where chance has let through too few, the threshold is raised."""
    sizes = {r["s"]: r["n"] for r in rows.where(F.col(stratum).isin(*shares)).groupBy(F.col(stratum).alias("s")).agg(F.count("*").alias("n")).collect()}
    bounds = {s: min(1.0, (n + 6 * n**0.5 + 20) / sizes[s]) for s, n in shares.items() if s in sizes}
    if not bounds:
        return rows.limit(0)
    named = lambda values: F.element_at(F.create_map(*[x for s, v in values.items() for x in (F.lit(s), F.lit(v))]), F.col(stratum))
    u = uniform(key, seed)
    while True:
        near = rows.where(F.col(stratum).isin(*bounds)).where(u < named(bounds))
        if all(b == 1.0 for b in bounds.values()):
            break
        found = {r["s"]: r["n"] for r in near.groupBy(F.col(stratum).alias("s")).agg(F.count("*").alias("n")).collect()}
        short = [s for s, b in bounds.items() if b < 1.0 and found.get(s, 0) < shares[s]]
        if not short:
            break
        bounds |= {s: min(1.0, 2 * bounds[s]) for s in short}
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(shuffle_key(key, seed), key))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= named({s: shares[s] for s in bounds})).drop("_rank")


def sampled_configs(patterns: DataFrame, weights: dict[str, float], n: int, stratum: str, key: str, seed: int) -> DataFrame:
    """``n`` draws (draw, wanted, columns of a pattern): a stratum by weight, then one of its patterns uniformly; of all
    patterns where the stratum has none."""
    spark = patterns.sparkSession
    total, reached = sum(weights.values()), 0.0
    wanted = F.lit(None).cast("string")
    highs = []
    for name, w in weights.items():
        reached += w / total
        highs.append((name, reached))
    for name, high in reversed(highs):
        wanted = F.when(uniform(F.col("draw"), seed) < high, F.lit(name)).otherwise(F.lit(highs[-1][0]) if name == highs[-1][0] else wanted)
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("wanted", wanted)
    one = F.lit(1.0)
    own = patterns.withColumns({"_stratum": F.col(stratum), "_one": one})
    all_of = patterns.withColumns({"_stratum": F.lit("*"), "_one": one})
    present = patterns.select(F.col(stratum).alias("_s")).distinct()
    keyed = draws.join(present, F.col("wanted") == F.col("_s"), "left").select("draw", "wanted", F.coalesce("_s", F.lit("*")).alias("_stratum"))
    return pick_weighted(keyed, own.unionByName(all_of), ("_stratum",), "_one", key, "draw", seed + 1).drop("_stratum")


def category_sample(apis: DataFrame, seed: int, most_categories: int = 3, large: tuple[int, int] = (5, 10), small: tuple[int, int] = (2, 5)) -> DataFrame:
    """Rows (category, api) of one to three categories: of one 5 to 10, of the others 2 to 5; all of a smaller category.

    Categories are few; which of them, and how many of each, is by hash."""
    sizes = [(r["category"], r["n"]) for r in apis.groupBy("category").agg(F.count("*").alias("n")).orderBy("category").collect()]
    if not sizes:
        return apis.limit(0)
    order = sorted(sizes, key=lambda c: (_digest(f"{c[0]}:{seed}"), c[0]))
    take = 1 + _digest(f"categories:{seed}") % min(most_categories, len(order))
    special = _digest(f"special:{seed}") % take
    wanted = {}
    for k, (name, n) in enumerate(order[:take]):
        low, high = large if k == special else small
        wanted[name] = n if n < low else low + _digest(f"{name}:count:{seed}") % (min(high, n) - low + 1)
    return stratified_sample(apis, "category", wanted, "api", seed)


def _digest(text: str) -> int:
    import hashlib

    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def proportional_allocation(groups: DataFrame, total: int, key: str) -> DataFrame:
    """``total`` over the groups evenly, the remainder to the first ones in key order."""
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(key))
    n = F.count("*").over(Window.partitionBy(F.lit(1)))
    return groups.withColumns({"_p": place, "_n": n}).withColumn("allocated", F.floor(F.lit(total) / F.col("_n")) + (F.col("_p") <= F.pmod(F.lit(total), F.col("_n"))).cast("int")).drop("_p", "_n")


def repeat_by_weight(rows: DataFrame, weight: Column) -> DataFrame:
    """Every row ``weight`` times, with its copy number from 1; a weight below 1 drops it."""
    return rows.withColumn("_w", weight.cast("int")).where("_w >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_w")))).drop("_w")


def bernoulli(rows: DataFrame, rate: float, key: str, seed: int) -> DataFrame:
    return rows.where(uniform(key, seed) < rate)


def error_count(key: str, most: int, seed: int) -> Column:
    """1..most errors for a trajectory."""
    return (F.floor(uniform(key, seed) * most) + 1).cast("int")


def endpoint(task_number: Column, endpoints: int) -> Column:
    return F.pmod(task_number, F.lit(endpoints))


def turn_order(rows: DataFrame, group: str, order: str, name: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, when the groups take turns in alphabetical order.

    A row's place follows from its number in its group and the sizes of all groups (few); the numbers come from the order
    of all rows by group, which no group's size makes one task's."""
    sizes = [(r[group], r["n"]) for r in rows.groupBy(group).agg(F.count("*").alias("n")).orderBy(group).collect()]
    before = sum((F.least(F.lit(n), F.col("_n") - 1) for _, n in sizes), F.lit(0))
    same = sum((((F.lit(n) >= F.col("_n")) & (F.lit(g) < F.col(group))).cast("int") for g, n in sizes), F.lit(0))
    starts, reached = [], 0
    for g, n in sizes:
        starts += [F.lit(g), F.lit(reached)]
        reached += n
    if not sizes:
        return rows.withColumn(name, F.lit(0).cast("long"))
    placed = numbered(rows, [group, order], "_all", first=1)
    return placed.withColumn("_n", F.col("_all") - F.element_at(F.create_map(*starts), F.col(group))).withColumn(name, (before + same).cast("long")).drop("_n", "_all")


#: The data sets of the experiments, by the parts that they hold.
EXPERIMENTS = {
    "main": ("real", "synthetic"),
    "no_iterative": ("no_iterative",),
    "no_contrast": ("no_contrast",),
    "no_error_injection": ("no_error_injection",),
    "no_multi_agent": ("no_multi_agent",),
    "base_real_only": ("base_real_only",),
    "correct_only": ("only_correct",),
    "mixed_correct_error": ("correct_error_mix",),
    "full_contrastive": ("correct_recovery_pair",),
}


def experiment_mix(parts: dict[str, DataFrame], variants: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(dataset, rows of its parts): every variant is a union of named parts; parts that are not there are passed over."""
    frames = [parts[p].withColumn("dataset", F.lit(v)).withColumn("part", F.lit(p)) for v, names in (variants or EXPERIMENTS).items() for p in names if p in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def weighted_value(options: dict[str, float], u: Column) -> Column:
    """One of the names by weight; ``u`` in [0, 1)."""
    total, reached = sum(options.values()), 0.0
    steps = []
    for name, w in options.items():
        reached += w / total
        steps.append((name, reached))
    out = F.lit(steps[-1][0])
    for name, high in reversed(steps[:-1]):
        out = F.when(u < high, F.lit(name)).otherwise(out)
    return out
