"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one survivor per group.

Vectors are compared only within their label.  Equal vectors are collapsed first.  Spherical k-means, fitted on a
bounded sample, gives every vector a home cell.  A cell's vectors are packed into blocks, one row each, by their angle
to the centre in steps of the link's angle (a shell), and by hash where a shell is large.

Every block meets every other of its label once, but for what cannot hold a link.  Blocks of one cell must lie in the
same or neighbouring shells, by the triangle inequality.  Of blocks of two cells only the guests meet: a link is no longer
than its chord, so the distances of its ends from the plane between the two centres add up to no more than that; a
vector farther from it than the chord less the least distance on the other side has no partner there.  With guests no
link is lost at a cell's border, and none is stored: a label's blocks are dealt into lots, and two lots meet in one
task, so a block is moved once for each lot of its label.  What meets is compared in single precision with room for its
rounding, then what may be a link in double precision; only counts of links and the stars of their components are
returned, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import discard, hash_sample, materialize, scratch, union_all
from trajlake.llm.components import block_stars, connected_components, forest

COSINE = 0.93
#: Vectors that k-means is fitted on (about; at most twice as many), the bytes they may take, and those a cell is fitted on.
SAMPLE = 20_000
SAMPLE_BYTES = 32 << 20
FITTED_ROWS = 8
#: Vectors of one label in a cell, about; in a block; and in a lot: an eighth of the label's within these bounds.
CELL_ROWS = 2_000
BLOCK_ROWS = 1_000
LOT_ROWS = (16_000, 64_000)
#: Tasks in which lots meet, at most; rows whose cosines with all centres are held at once.
MEETINGS = 4_000
NEAR_ROWS = 1_000
ROUNDS = 8


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no finite row is lost to a square's range."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def spherical_kmeans(x: np.ndarray, cells: int, seed: int = 13, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of ``x`` (unit rows), at most ``cells`` of them."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    centres = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        home = np.concatenate([np.argmax(x[k : k + NEAR_ROWS] @ centres.T, axis=1) for k in range(0, len(x), NEAR_ROWS)])
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1)
        fresh = size > 1e-9
        centres[fresh] = sums[fresh] / size[fresh, None]
    return centres


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector as array<double>) of the rows that can link."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine & F.exists("v", lambda x: x != 0.0))


def _shells(near: np.ndarray, cosine: float) -> np.ndarray:
    """Steps of the link's angle from a centre, for cosines with it."""
    return (np.arccos(np.clip(near, -1, 1)) / (np.arccos(cosine) * (1 + 1e-9) + 1e-12)).astype(np.int32)


def _assign(centres: np.ndarray, cosine: float):
    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, NEAR_ROWS):
                batch = whole.slice(k, NEAR_ROWS)
                near = unit(np.asarray(batch.column("v").flatten()).reshape(batch.num_rows, -1)) @ centres.T
                home = np.argmax(near, axis=1)
                own = [pa.array(home.astype(np.int32)), pa.array(_shells(near[np.arange(len(near)), home], cosine))]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("node", "label", "copies", "v")], *own], names=["node", "label", "copies", "v", "cell", "shell"])

    return run


PACK = "label string, cell int, shell int, n int, single boolean, nodes binary, copies binary, vectors binary"


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    """A block's vectors in one row, in single precision where that loses nothing."""
    first, x = group.iloc[0], np.stack(group["v"].to_list())
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    single = bool((short == x).all())
    parts = [group["node"].to_numpy(np.int64).tobytes(), group["copies"].to_numpy(np.int64).tobytes(), (short if single else x).tobytes()]
    return pd.DataFrame([(first["label"], first["cell"], first["shell"], len(group), single, *parts)], columns=[c.split()[0] for c in PACK.split(", ")])


class _Block:
    """A packed block, its unit vectors, and the numbers of links found."""

    def __init__(self, row, d: int):
        self.cell, self.shell = int(row.cell), int(row.shell)
        self.nodes, self.copies = np.frombuffer(row.nodes, np.int64), np.frombuffer(row.copies, np.int64)
        self.x = unit(np.frombuffer(row.vectors, np.float32 if row.single else np.float64).reshape(-1, d).astype(float))
        self.short = self.x.astype(np.float32)
        self.counts = np.zeros(len(self.nodes), np.int64)


def _may_link(x: _Block, y: _Block, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Rows of two blocks that may have links with the other's; null for none."""
    if x.cell == y.cell:
        return None if abs(x.shell - y.shell) > 1 else (np.arange(len(x.nodes)), np.arange(len(y.nodes)))
    plane = centres[x.cell] - centres[y.cell]
    chord = (np.sqrt(2 - 2 * cosine) + 1e-7) * np.linalg.norm(plane) + 1e-7  # rounding may only let more rows pass
    on, off = x.x @ plane, -(y.x @ plane)
    rows, columns = np.flatnonzero(on + off.min() <= chord), np.flatnonzero(off + on.min() <= chord)
    return (rows, columns) if len(rows) and len(columns) else None


def _meet(x: _Block, y: _Block, centres: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Counts the links of two blocks (of one, if they are the same) and returns links that span their components."""
    met = _may_link(x, y, centres, cosine)
    if met is None:
        return None
    rows, columns = met
    slack = 1e-5 + 2e-7 * x.x.shape[1]
    maybe = x.short[rows] @ y.short[columns].T >= np.float32(cosine - slack)
    if x is y:
        np.fill_diagonal(maybe, False)
    if not maybe.any():
        return None
    some, others = maybe.any(axis=1), maybe.any(axis=0)
    if x is y:  # rows and columns stay the same ones, and the product symmetric
        rows = columns = rows[some | others]
        units = x.x[rows]
        links = units @ units.T >= cosine
        np.fill_diagonal(links, False)
    else:
        rows, columns = rows[some], columns[others]
        links = x.x[rows] @ y.x[columns].T >= cosine
    x.counts[rows] += links @ y.copies[columns]
    if x is not y:
        y.counts[columns] += x.copies[rows] @ links
    index, column, stands = block_stars(links, x is y)
    other = y.nodes[columns]
    own = x.nodes[rows]
    return np.where(column, other[np.minimum(index, len(other) - 1)], own[np.minimum(index, len(own) - 1)]), own[stands]


def _meeting(centres: np.ndarray, cosine: float):
    """All blocks of a lot against each other, or those of one lot against those of another."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        d = centres.shape[1]
        lots = [[_Block(row, d) for row in side.itertuples()] for _, side in group.groupby("lot")]
        alone = group["lot_a"].iloc[0] == group["lot_b"].iloc[0]
        stars = []
        if alone or len(lots) == 2:
            for k, x in enumerate(lots[0]):
                found = [m for m in (_meet(x, y, centres, cosine) for y in (lots[0][k:] if alone else lots[1])) if m]
                if found:
                    a, b = (np.concatenate(c) for c in zip(*found, strict=True))
                    spans = forest(a, b)
                    stars.append((a[spans], b[spans]))
        nodes, counts = (np.concatenate(c) for c in zip(*[(x.nodes, x.counts) for lot in lots for x in lot], strict=True))
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*stars, strict=True) if stars else ((), ())))
        linked = counts > 0
        return pd.DataFrame({"node": np.concatenate([nodes[linked], a]), "n": np.concatenate([counts[linked], np.zeros(len(a), np.int64)]), "other": np.concatenate([np.full(int(linked.sum()), -1), b])})

    return run


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", sample: int = SAMPLE, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Rows with a null label, and vectors that are null, zero, or hold null or non-finite components, link with nothing.
    Vectors of different lengths never link; finite components may be of any size.  Repeated rows with one id count as
    several vectors of that id; a null id gets component_id from its partners, or null.  A vector as near to two centres
    is at home in the first; a cosine of exactly the threshold is a link.  An empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    with scratch() as kept:
        rows = usable(vectors, id_col, vector_col, label_col)
        grouped = rows.groupBy("label", "v").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
        nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()))
        sizes = nodes.groupBy(F.size("v").alias("d"), "label").agg(F.count("*").alias("n")).withColumn("lots", _lots("n"))
        sizes = sizes.groupBy("d").agg(F.max("n").alias("n"), F.sum(F.col("lots") * (F.col("lots") + 1) / 2).alias("meetings")).orderBy("d").collect()
        links = [_links_of(nodes.where(F.size("v") == r["d"]), r["d"], r["n"], int(min(r["meetings"], MEETINGS)), cosine, sample, cell_rows, block_rows) for r in sizes]
        if links:
            found = union_all(links)
            counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
            classes = connected_components(found.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
            named = nodes.join(counts, "node", "left").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
            heads = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
            named = materialize(named.join(heads, "component").select("label", "v", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        else:
            named = nodes.select("label", "v", F.col("first_id").alias("component_id"), (F.col("copies") - 1).alias("n_links"))
        kept += [named if links else nodes]
    plain = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    key = lambda: F.xxhash64(F.col("label"), F.col("v"))
    named = named.select(key().alias("key"), F.col("label").alias("label2"), F.col("v").alias("v2"), "component_id", "n_links")
    joined = plain.withColumn("own_key", key()).join(named, (F.col("own_key") == F.col("key")) & (F.col("label") == F.col("label2")) & (F.col("v") == F.col("v2")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _lots(n: str) -> Column:
    """Number of lots of a label with ``n`` vectors."""
    rows = F.least(F.greatest(F.col(n) / 8, F.lit(LOT_ROWS[0])), F.lit(LOT_ROWS[1]))
    return F.ceil(F.col(n) / rows).cast("int")


def _links_of(nodes: DataFrame, d: int, n: int, meetings: int, cosine: float, sample: int, cell_rows: int, block_rows: int) -> DataFrame:
    """(node, n, other) of nodes with ``d`` components, at most ``n`` of a label: numbers of links, and links that span the
    components."""
    sample = max(FITTED_ROWS, min(sample, SAMPLE_BYTES // (8 * d)))
    picked = hash_sample(nodes, "node", sample).select("v").collect()  # bounded by rows and by bytes
    centres = spherical_kmeans(unit(np.array([r["v"] for r in picked], float)), max(1, min(-(-n // cell_rows), len(picked) // FITTED_ROWS)))
    placed = nodes.select("node", F.col("label").cast("string").alias("label"), "copies", "v").mapInArrow(_assign(centres, cosine), "node long, label string, copies long, v array<double>, cell int, shell int")
    placed = materialize(placed)
    parts = placed.groupBy("label", "cell", "shell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    dealt = placed.join(parts, ["label", "cell", "shell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    packed = dealt.select("node", "label", "copies", "v", "cell", "shell", "part").groupBy("label", "cell", "shell", "part").applyInPandas(_pack, PACK)
    lots = placed.groupBy("label").agg(F.count("*").alias("in_label")).select("label", _lots("in_label").alias("lots"))
    lotted = packed.join(lots, "label").withColumn("lot", F.pmod(F.xxhash64("nodes"), F.col("lots")).cast("int"))
    partners = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda k: F.struct(F.least("lot", k).alias("lot_a"), F.greatest("lot", k).alias("lot_b")))
    copied = lotted.select("label", "lot", F.explode(partners).alias("at"), *[c.split()[0] for c in PACK.split(", ")[1:]]).select("at.*", "*").drop("at")
    dealt_lots = copied.repartition(meetings, "label", "lot_a", "lot_b")
    out = materialize(dealt_lots.groupBy("label", "lot_a", "lot_b").applyInPandas(_meeting(centres, cosine), "node long, n long, other long"))
    discard(placed)
    return out
