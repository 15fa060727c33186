"""A join of many rows with a table of unique keys, some of which a large share of the rows may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if more than one row in so many has it; there are fewer hot keys than this, whatever the tables' size.
HOT_SHARE = 10_000
#: Rows of a key that one task may get in any case.
HOT_ROWS = 500


def is_hot(count: str, total: int, share: int = HOT_SHARE, least: int = HOT_ROWS) -> Column:
    """Whether a key that ``count`` of ``total`` rows ask for is hot: more than ``least``, and more than one in ``share``."""
    return (F.col(count) * share > total) & (F.col(count) > least)


def attach(rows: DataFrame, found: DataFrame, keys: list[str], count: str, total: int, share: int = HOT_SHARE, least: int = HOT_ROWS, some_hot: bool = True) -> DataFrame:
    """``rows`` with the other columns of ``found``, which has a row for each combination of ``keys`` and says in
    ``count`` how many of the ``total`` rows ask for it.  Null keys match each other; rows without a match are dropped.

    Hot keys, fewer than ``share`` of them, are broadcast, so that no task gets all rows of one; the others are shuffled.
    ``some_hot``: false if the caller knows that there are none, which makes the plan smaller.
    """
    hot = found.where(is_hot(count, total, share, least))
    cold = found.where(~is_hot(count, total, share, least))
    others = [c for c in found.columns if c not in (*keys, count)]
    names = {k: f"_{k}_2" for k in keys}

    def side(part: DataFrame) -> DataFrame:
        return part.select(*[F.col(k).alias(names[k]) for k in keys], *others)

    def same():
        out = F.lit(True)
        for k, other in names.items():
            out = out & F.col(k).eqNullSafe(F.col(other))
        return out

    if not some_hot:
        return rows.join(side(found), same()).drop(*names.values())
    often = rows.join(F.broadcast(side(hot)), same()).drop(*names.values())
    seldom = rows.join(F.broadcast(side(hot).select(*names.values())), same(), "left_anti").join(side(cold), same()).drop(*names.values())
    return often.unionByName(seldom)
