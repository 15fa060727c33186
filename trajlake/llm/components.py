"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from trajlake.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: long); a component is named by its smallest node.

    Every step is a grouped minimum and a join.  A round writes its links together with the number of those that it
    moved; the rounds end when none moved, which is when every component is a star (their number grows with the
    logarithm of the longest chain).  Nothing but that number reaches the driver.  Rows with a null end are ignored;
    repeated links and links of a node to itself change nothing; no links give no rows.
    """
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, moved = materialize(ends), 1
    while moved:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: the larger neighbours of a node go to its lowest neighbour
        large = both.where("v > u").join(lowest, "u").groupBy(F.col("v").alias("u"), F.col("m").alias("v")).agg(F.max(F.col("m") != F.col("u")).alias("moved"))
        # small star: a node's smaller neighbours go to the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.max("moved").alias("any"))
        ahead = F.col("v") != F.col("m")
        pair = F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"), F.lit(True).alias("moved"))
        own = F.struct(F.col("u"), F.col("m").alias("v"), (F.col("moved") | ahead).alias("moved"))
        small = large.join(low, "u").select(F.explode(F.when(ahead, F.array(own, pair)).otherwise(F.array(own))).alias("e"))
        stars = small.select("e.*").groupBy("u", "v").agg(F.max("moved").alias("moved"))
        seen = Observation()
        after = materialize(stars, seen, F.count_if("moved").alias("moved"))
        moved = seen.get.get("moved", 0)
        discard(edges)
        edges = after.select("u", "v") if not moved else after
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def block_stars(links: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index, of a column, row that stands for its component) for all rows and columns of a boolean matrix that have
    links, but for the rows that stand for others; with ``same`` rows and columns are the same nodes.

    Components grow by whole sets of rows and columns, so a dense block takes a few steps whatever its number of links."""
    rows, cols = links.any(axis=1), np.zeros(links.shape[1], bool)
    found = [np.zeros((0, 3), np.int64)]
    for first in np.flatnonzero(rows).tolist():
        if not rows[first]:
            continue
        rows[first] = False
        ahead = np.array([first])
        while len(ahead):
            reached = links[ahead].any(axis=0)
            if same:
                ahead = np.flatnonzero(reached & rows)
            else:
                fresh = np.flatnonzero(reached & ~cols)
                cols[fresh] = True
                found.append(np.stack([fresh, np.ones_like(fresh), np.full_like(fresh, first)], axis=1))
                ahead = np.flatnonzero(rows & links[:, fresh].any(axis=1)) if len(fresh) else fresh
            rows[ahead] = False
            found.append(np.stack([ahead, np.zeros_like(ahead), np.full_like(ahead, first)], axis=1))
    out = np.concatenate(found)
    return out[:, 0], out[:, 1].astype(bool), out[:, 2]


def forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Indices of edges (a[k], b[k]) that span the same components, by union-find."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(k)
    return kept
