"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

1. A pass over all texts counts the document frequency of every five-word shingle in a count-mean-min sketch of fixed
   size (its resolution is relative to the corpus, so it serves any size).  A shingle weighs its count in the text
   times ``1 + ln((N+1)/(df+1)) / ln(N+1)``: from 1 for one that all texts share to 2 for one of its own.
2. A second pass draws ``BANDS x ROWS`` samples of each text by improved consistent weighted sampling (Ioffe 2010),
   whose chance of agreement is the weighted Jaccard similarity, and hashes them band by band.
3. Exact copies are collapsed first; then texts that share a band are candidates.  A bucket is not expanded into its
   pairs: its members are compared with one pivot, the member with the most company over all bands (the likely
   original).  Members that no link to a pivot brings into the pivot's class are then compared with all other members
   of their buckets, block by block as products of matrices that return a spanning forest, so no link found by the
   bands is lost and no pairs are made.  Texts whose total weights alone rule out the similarity never meet.
4. Candidates are verified on their whole texts by weighted Jaccard similarity of at least 0.8 (exact for the weights
   that the sketch gives); links make components.  A pivot's candidates are dealt over as many tasks as their bytes
   need before any text moves.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import TEXT_ROWS, discard, materialize, scratch, tree_sums
from trajlake.llm.components import connected_components, forest
from trajlake.llm.textops import as_strings, blocks, grams, hashes, mix, spans

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
#: The sketch: rows and cells of each; and the cells that travel together.
DEPTH, CELLS, CHUNK = 3, 1 << 16, 1 << 13
#: Pooled draws (r, beta, c) of the sampler; a shingle picks one for each sample by hash.
POOL = 1 << 16
#: Bytes of a pivot's candidate texts, and their number, for one comparison group.
TASK_BYTES, TASK_TEXTS = 4 << 20, 128
#: Texts, and bytes of them, in a block of a group that its pivot did not settle.
BLOCK_TEXTS, BLOCK_TEXT_BYTES = 128, 2 << 20
U64 = np.uint64


def shingle_sets(texts: pa.Array):
    """(first row, number of texts, text index, 48-bit shingle, count) of the distinct shingles, in blocks of texts."""
    for first, raw, offsets in blocks(texts):
        for a in range(0, len(offsets) - 1, 1 << 15):
            part = offsets[a : a + (1 << 15) + 1]
            piece = raw[part[0] : part[-1]]
            part = part - part[0]
            starts, ends, at = spans(piece, part)
            g, begin = grams(hashes(piece, starts, ends), at, SHINGLE)
            n = len(part) - 1
            keys = (np.repeat(np.arange(n, dtype=U64), np.diff(begin)) << U64(48)) | (g >> U64(16))
            keys.sort()
            fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
            counts = np.diff(np.concatenate([fresh, [len(keys)]]))
            keys = keys[fresh]
            yield first + a, n, (keys >> U64(48)).astype(np.int64), keys & U64((1 << 48) - 1), counts


def _cell(shingles: np.ndarray, row: int) -> np.ndarray:
    odd = U64((0xD6E8FEB86659FD93 * (2 * row + 3)) & (2**64 - 1) | 1)
    return ((shingles * odd) >> U64(44)).astype(np.int64) & (CELLS - 1)


class Frequencies:
    """The corpus' sketch: document counts of shingles."""

    def __init__(self, n_docs: int, cells: np.ndarray):
        self.n_docs, self.cells = n_docs, cells.astype(np.float64)
        self.total = self.cells.sum(axis=1, keepdims=True)

    def weights(self, shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
        found = []
        for row in range(DEPTH):
            load = self.cells[row][_cell(shingles, row)]
            found.append(load - (self.total[row, 0] - load) / (CELLS - 1))
        df = np.clip(np.median(found, axis=0), 1, max(1, self.n_docs))
        return counts * (1 + np.log((self.n_docs + 1) / (df + 1)) / np.log(self.n_docs + 2))


def document_frequencies(docs: DataFrame) -> Frequencies:
    """One pass over (id, text); partitions send their cells in chunks, which are added up before they reach the driver
    (DEPTH x CELLS numbers, whatever the corpus)."""

    def count(batches):
        cells = np.zeros((DEPTH, CELLS), np.int64)
        n = 0
        for batch in batches:
            n += batch.num_rows
            for _, _, _, shingles, _ in shingle_sets(as_strings(batch.column("text"))):
                for row in range(DEPTH):
                    cells[row] += np.bincount(_cell(shingles, row), minlength=CELLS)
        if n:
            chunks = [c.tobytes() for c in cells.reshape(-1, CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(chunks)), pa.int32()), pa.array([np.array([n]).tobytes(), *chunks], pa.binary())], names=["key", "sums"])

    found = tree_sums(docs.select("text").mapInArrow(count, "key int, sums binary"), "int64").collect()
    rows = {r["key"]: np.frombuffer(r["sums"], np.int64) for r in found}
    if not rows:
        return Frequencies(0, np.zeros((DEPTH, CELLS)))
    n = int(rows.pop(-1)[0])
    return Frequencies(n, np.concatenate([rows[k] for k in sorted(rows)]).reshape(DEPTH, CELLS))


class Sampler:
    """Improved consistent weighted sampling with pooled draws; one 32-bit tag for each sample."""

    def __init__(self, samples: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.r = rng.gamma(2.0, 1.0, POOL).astype(np.float32) + np.float32(1e-3)
        self.beta = rng.uniform(0, 1, POOL).astype(np.float32)
        self.log_c = np.log(rng.gamma(2.0, 1.0, POOL) + 1e-12).astype(np.float32)
        self.odd = rng.integers(1, 2**63, samples, dtype=U64) * U64(2) + U64(1)

    def tags(self, doc: np.ndarray, n: int, shingles: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts that have shingles, tags [those texts, samples])."""
        present, begin = np.unique(doc, return_index=True)
        out = np.zeros((len(present), len(self.odd)), np.uint32)
        if not len(present):
            return present, out
        log_w = np.log(weights).astype(np.float32)
        low = shingles & U64(0xFFFFFFFF)
        wide = (shingles << U64(16)) | U64(1)
        for k, odd in enumerate(self.odd):
            at = ((wide * odd) >> U64(48)).astype(np.int32)
            r, beta = self.r[at], self.beta[at]
            t = np.floor(log_w / r + beta)
            value = self.log_c[at] - r * (t - beta + np.float32(1)) + np.float32(64)
            key = np.maximum(value, np.float32(1e-3)).view(np.uint32).astype(U64) << U64(32)
            key |= (low + t.astype(np.int64).view(U64) * U64(0x9E3779B1)) & U64(0xFFFFFFFF)
            out[:, k] = (np.minimum.reduceat(key, begin) & U64(0xFFFFFFFF)).astype(np.uint32)
        return present, out


def signatures(docs: DataFrame, frequencies: Frequencies) -> DataFrame:
    """(id, digest, size, weight, bands array<long>): bands is empty, and weight (of all shingles) 0, for a text without words."""

    def run(batches):
        sampler = Sampler(BANDS * ROWS)
        for batch in batches:
            texts = as_strings(batch.column("text"))
            bands: list = [[]] * batch.num_rows
            total = np.zeros(batch.num_rows)
            for first, n, doc, shingles, counts in shingle_sets(texts):
                weights = frequencies.weights(shingles, counts)
                total[first : first + n] = np.bincount(doc, weights, n)
                present, tags = sampler.tags(doc, n, shingles, weights)
                grouped = tags.reshape(len(tags), BANDS, ROWS).astype(U64)
                h = np.arange(BANDS, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15)
                for row in range(ROWS):
                    h = mix(h ^ (grouped[:, :, row] + U64(0x632BE59BD9B4E019)))
                for d, keys in zip(present.tolist(), h.view(np.int64), strict=True):
                    bands[first + d] = keys
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("digest"), batch.column("size"), pa.array(total), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "digest", "size", "weight", "bands"],
            )

    measured = docs.select("id", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").cast("long").alias("size"), "text")
    return measured.mapInArrow(run, "id long, digest binary, size long, weight double, bands array<long>")


def _compare(frequencies: Frequencies):
    def sets(texts) -> list[tuple[np.ndarray, np.ndarray]]:
        out: list = [(np.zeros(0, U64), np.zeros(0))] * len(texts)
        for first, n, doc, shingles, counts in shingle_sets(as_strings(pa.array(texts, pa.large_string()))):
            weights = frequencies.weights(shingles, counts)
            at = np.searchsorted(doc, np.arange(n + 1))
            for d in range(n):
                out[first + d] = (shingles[at[d] : at[d + 1]], weights[at[d] : at[d + 1]])
        return out

    def run(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(pivots):
            (mine, own), whole = sets(list(pivots["pivot"][:1]))[0], None
            whole = own.sum()
            for a in range(0, len(members), 64):  # few sets at a time
                some = members.iloc[a : a + 64]
                for (other, weights), x, p in zip(sets(list(some["member"])), some["x"], some["p"], strict=True):
                    k = np.searchsorted(mine, other)
                    k[k == len(mine)] = 0
                    same = mine[k] == other if len(mine) else np.zeros(len(other), bool)
                    both = np.minimum(own[k[same]], weights[same]).sum() if same.any() else 0.0
                    union = whole + weights.sum() - both
                    found.append((x, p, both / union if union else 0.0))
        return pd.DataFrame(found, columns=["x", "p", "sim"])

    return run


def verify(pairs: DataFrame, texts: DataFrame, frequencies: Frequencies) -> DataFrame:
    """(x, p, sim) for the pairs (x, p, size of x); ``texts``: (id, text) of all documents that occur in them.

    A pivot's pairs are dealt by x over as many lots as their texts need; texts join the lots, never the bare pivot."""
    load = materialize(pairs.groupBy("p").agg(F.greatest(F.ceil(F.count("*") / TASK_TEXTS), F.ceil(F.sum("size") / TASK_BYTES), F.lit(1)).cast("int").alias("salts")))
    salted = pairs.join(load, "p").select("x", "p", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int").alias("salt"))
    members = salted.join(texts.select(F.col("id").alias("x"), F.col("text").alias("member")), "x")
    pivots = load.join(texts.select(F.col("id").alias("p"), F.col("text").alias("pivot")), "p")
    pivots = pivots.select(F.col("p").alias("pivot_id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("pivot_salt"), "pivot")
    return members.groupBy("p", "salt").cogroup(pivots.groupBy("pivot_id", "pivot_salt")).applyInPandas(_compare(frequencies), "x long, p long, sim double")


def _units(texts: pd.Series, frequencies: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, element, weight): a shingle that occurs n times is n elements, so that common elements give the sum
    of the smaller weights."""
    docs, elements, weights = [np.zeros(0, np.int64)], [np.zeros(0, U64)], [np.zeros(0)]
    for first, _, doc, shingles, counts in shingle_sets(as_strings(pa.array(list(texts), pa.large_string()))):
        unit = frequencies.weights(shingles, counts) / counts
        number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        docs.append(first + np.repeat(doc, counts))
        elements.append(np.repeat(shingles, counts) + (number.astype(U64) << U64(48)))
        weights.append(np.repeat(unit, counts))
    return np.concatenate(docs), np.concatenate(elements), np.concatenate(weights)


def _cross(frequencies: Frequencies, similarity: float, columns: int = 4096):
    def run(loose: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"a": [], "b": []}).astype("int64")
        if not len(loose) or not len(others):
            return none
        d1, e1, w1 = _units(loose["text_y"], frequencies)
        d2, e2, w2 = _units(others["text_x"], frequencies)
        total1, total2 = np.bincount(d1, w1, len(loose)), np.bincount(d2, w2, len(others))
        shared = np.intersect1d(e1, e2)
        common = np.zeros((len(loose), len(others)))
        c1, c2 = np.searchsorted(shared, e1), np.searchsorted(shared, e2)
        in1 = np.append(shared, U64(0))[c1] == e1 if len(shared) else np.zeros(len(e1), bool)
        in2 = np.append(shared, U64(0))[c2] == e2 if len(shared) else np.zeros(len(e2), bool)
        d1, c1, w1, d2, c2 = d1[in1], c1[in1], w1[in1], d2[in2], c2[in2]
        o1, o2 = np.argsort(c1, kind="stable"), np.argsort(c2, kind="stable")
        d1, c1, w1, d2, c2 = d1[o1], c1[o1], w1[o1], d2[o2], c2[o2]
        for at in range(0, len(shared), columns):  # bounded parts of the two matrices
            width = min(columns, len(shared) - at)
            x, y = np.zeros((len(loose), width)), np.zeros((len(others), width))
            a, b = np.searchsorted(c1, [at, at + width])
            x[d1[a:b], c1[a:b] - at] = w1[a:b]
            a, b = np.searchsorted(c2, [at, at + width])
            y[d2[a:b], c2[a:b] - at] = 1
            common += x @ y.T
        union = total1[:, None] + total2[None, :] - common
        ids, partners = loose["y"].to_numpy(), others["x"].to_numpy()
        linked = (common >= similarity * union) & (union > 0) & (ids[:, None] != partners[None, :])
        i, j = np.nonzero(linked)
        kept = forest(ids[i], partners[j])
        return pd.DataFrame({"a": ids[i[kept]], "b": partners[j[kept]]})

    return run


def remaining_links(placed: DataFrame, links: DataFrame, texts: DataFrame, frequencies: Frequencies, similarity: float) -> DataFrame:
    """Links (a, b) between the members of a pivot's buckets that the pivots' links leave apart.

    Every node takes the label of the linked pivot with the most company (a pivot may be its own), so equal labels mean
    one class.  Members whose label is not their pivot's meet the pivot's whole group, in blocks of ``BLOCK_TEXTS`` texts
    or ``BLOCK_TEXT_BYTES`` and only where the classes of total weight allow the similarity; a block pair is a few
    matrix products and returns a spanning forest of its links."""
    own = placed.select(F.col("p").alias("node"), "p", F.col("p_company").alias("company")).distinct()
    linked = placed.join(links.select(F.col("a").alias("node"), F.col("b").alias("p")), ["node", "p"], "left_semi").select("node", "p", F.col("p_company").alias("company"))
    labels = own.unionByName(linked).groupBy("node").agg(F.max_by("p", F.struct("company", "p")).alias("label"))
    labels = materialize(labels)
    members = placed.join(labels, "node", "left").join(labels.select(F.col("node").alias("p"), F.col("label").alias("p_label")), "p")
    step = math.log(1 / similarity) * (1 + 1e-9)
    members = members.select("p", "node", "size", F.floor(F.log("weight") / step).cast("int").alias("k"), (~F.col("label").eqNullSafe(F.col("p_label"))).alias("apart"))
    blocks_for = lambda n, size: F.greatest(F.ceil(n / BLOCK_TEXTS), F.ceil(size / BLOCK_TEXT_BYTES), F.lit(1)).cast("int")
    tallies = members.groupBy("p", "k").agg(F.count_if("apart").alias("n_apart"), blocks_for(F.count_if("apart"), F.sum(F.when(F.col("apart"), F.col("size")).otherwise(0))).alias("rows"), blocks_for(F.count("*"), F.sum("size")).alias("cols"))
    groups = tallies.groupBy("p").agg(F.sum("n_apart").alias("n_apart"), F.map_from_entries(F.collect_list(F.struct("k", F.struct("n_apart", "rows", "cols")))).alias("tally")).where("n_apart > 0")
    groups = materialize(groups.drop("n_apart"))  # a plain table, so that Spark can split the join where one pivot has many members
    met = materialize(members.join(groups, "p"))
    at = lambda k: F.try_element_at("tally", k)
    near = F.explode(F.array(*[F.col("k") + d for d in (-1, 0, 1)]))
    block = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = met.where("apart").select("*", near.alias("k2")).where(at(F.col("k2")).isNotNull())
    left = left.select("p", "node", "k", "k2", block(at(F.col("k"))["rows"]).alias("r"), spread(at(F.col("k2"))["cols"]).alias("c"))
    right = met.select("*", near.alias("k1")).where(at(F.col("k1"))["n_apart"] > 0)
    right = right.select("p", "node", "k1", "k", spread(at(F.col("k1"))["rows"]).alias("r"), block(at(F.col("k"))["cols"]).alias("c"))
    left = left.join(texts.select(F.col("id").alias("node"), F.col("text").alias("text_y")), "node").withColumnRenamed("node", "y")
    right = right.join(texts.select(F.col("id").alias("node"), F.col("text").alias("text_x")), "node")
    right = right.select(F.col("p").alias("p_"), "k1", F.col("k").alias("k_"), F.col("r").alias("r_"), F.col("c").alias("c_"), F.col("node").alias("x"), "text_x")
    return left.groupBy("p", "k", "k2", "r", "c").cogroup(right.groupBy("p_", "k1", "k_", "r_", "c_")).applyInPandas(_cross(frequencies, similarity), "a long, b long")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, class_id, kept) for each row: class_id is the smallest id of the document's class, kept marks its one
    survivor, digest is the MD5 of the text.

    Null counts as empty text; equal texts, empty ones too, are one class; a text without words links with nothing
    else.  Of repeated rows one is kept.  A row with a null id is in the class of its text, and is kept only if no row
    of the class has an id (class_id is null then).  Texts of any length are compared whole; a tie between pivots goes
    to the lower node.  An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    with scratch() as kept:
        frequencies = document_frequencies(base)
        signed = materialize(signatures(base, frequencies), batch_rows=TEXT_ROWS)
        last = F.lit(2**63 - 1)
        distinct = signed.groupBy("digest").agg(F.min("id").alias("first_id"), F.first("bands").alias("bands"), F.max("size").alias("size"), F.max("weight").alias("weight"))
        nodes = materialize(distinct.withColumn("node", F.monotonically_increasing_id()))
        placed = candidates(nodes, similarity)
        texts = candidate_texts(base, nodes, placed)
        pairs = placed.where("fits").select(F.col("node").alias("x"), "p", "size")
        checked = materialize(verify(pairs, texts, frequencies))
        links = checked.where(F.col("sim") >= similarity).select(F.col("x").alias("a"), F.col("p").alias("b"))
        more = materialize(remaining_links(placed, links, texts, frequencies, similarity))
        classes = connected_components(links.unionByName(more))
        named = nodes.select("node", "digest", "first_id").join(classes, "node", "left").withColumn("component", F.coalesce("component", "node"))
        heads = named.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min_by("node", F.struct(F.coalesce("first_id", last), "node")).alias("head"))
        named = materialize(named.join(heads, "component").select("digest", "first_id", "class_id", (F.col("node") == F.col("head")).alias("leads")))
        kept += [signed, named]
    copies = signed.groupBy("digest", "id").agg(F.count("*").cast("int").alias("copies")).join(named, "digest")
    stays = F.col("leads") & F.col("id").eqNullSafe(F.col("first_id"))
    return copies.withColumn("stays", stays).select("id", "digest", "class_id", F.posexplode(F.sequence(F.lit(1), "copies")).alias("k", "_n"), "stays").select("id", "digest", "class_id", (F.col("stays") & (F.col("k") == 0)).alias("kept"))


def candidates(nodes: DataFrame, similarity: float) -> DataFrame:
    """(p, node, size, weight, p_company, fits): the members of the buckets of each pivot, but for the pivot itself, once.

    fits: the total weights allow the similarity.  A bucket's rows meet its pivot in a join of two plain tables, which
    Spark splits where one bucket is very large."""
    rows = nodes.select("node", "size", "weight", F.explode("bands").alias("b"))
    sizes = rows.groupBy("b").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(rows.join(sizes, "b"))
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    best = shared.join(company, "node").groupBy("b").agg(F.max_by(F.struct("node", "weight", "company"), F.struct("company", -F.col("node"))).alias("best"))
    pivots = materialize(best.select("b", F.col("best.node").alias("p"), F.col("best.weight").alias("p_weight"), F.col("best.company").alias("p_company")))
    fits = F.least("weight", "p_weight") >= similarity * (1 - 1e-9) * F.greatest("weight", "p_weight")
    met = shared.join(pivots, "b").where("node <> p").select("p", "node", "size", "weight", "p_company", fits.alias("fits"))
    placed = materialize(met.distinct())
    discard(shared, pivots)
    return placed


def candidate_texts(base: DataFrame, nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, text) of the nodes that have candidates, one text each, written once for all comparisons."""
    has = placed.select(F.explode(F.array("node", "p")).alias("node")).distinct()
    wanted = nodes.join(has, "node", "left_semi").select("node", "digest", F.col("first_id").alias("want"))
    keyed = base.withColumn("digest", F.unhex(F.md5("text")))
    found = keyed.join(wanted, [keyed["id"].eqNullSafe(wanted["want"]), keyed["digest"] == wanted["digest"]]).select(F.col("node").alias("id"), "text")
    return materialize(found.dropDuplicates(["id"]))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class, all its columns as they were."""
    kept = near_duplicates(docs, similarity, id_col, text_col).where("kept").select(F.col("id").alias("_id"), F.col("digest").alias("_digest"))
    packed = docs.select(F.struct("*").alias("row"))
    keyed = packed.select("row", F.col("row")[id_col].alias("_own"), F.unhex(F.md5(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")))).alias("_key"))
    joined = keyed.join(kept, [keyed["_own"].eqNullSafe(kept["_id"]), keyed["_key"] == kept["_digest"]], "left_semi")
    repeats = docs.groupBy(F.col(id_col).alias("_id")).count().where("count > 1").limit(1).count()  # ids only: no text moves
    return (joined.dropDuplicates(["_own", "_key"]) if repeats else joined).select("row.*")
