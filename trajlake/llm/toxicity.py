"""Toxicity: a factorization machine over hashed terms.

A text's terms are its words and their stems, each at up to three levels (it occurs once, twice, three times or more),
hashed to 64 bits: there is no vocabulary and next to no collision.  A factorization machine scores a set of terms by

    bias + sum of w[i] + sum over pairs of <v[i], v[j]>,

so two terms can be worse (or more harmless) together than their weights say: an insult beside a mention of a group, a
stem that comes again.  The sum over pairs costs as much as the terms, as it is (|sum v|^2 - sum |v|^2) / 2.

Learning takes a bounded sample of the labelled texts.  Spark counts their terms and keeps those that tell most about
the label.  Every round, each shard of the sample goes on from the common parameters by stochastic steps, and the
shards' results are averaged; shards are dealt by the hash of the id, so results do not depend on partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import TEXT_ROWS, crc_mod, discard, hash_sample, materialize
from trajlake.llm.textops import as_strings, blocks, hashes, mix

#: Labelled texts that the model is fitted on, about (at most twice as many), chosen by the hash of their id.
FIT_ROWS = 60_000
#: Terms that the model keeps at most, the texts of the sample that a term must occur in, and the least chi-squared
#: statistic of its texts' labels against the sample's share (15: once in 10,000 terms by chance).
TERMS = 20_000
LEAST = 3
CHI = 15.0
#: Factors of a term; rounds of averaging, passes over a shard in each, texts of a shard and of a step.
FACTORS = 8
ROUNDS = 8
EPOCHS = 3
SHARD_ROWS = 8_000
BATCH = 32
#: First rates of the weights and of the factors, and the decay of both.
RATE = 0.4
FACTOR_RATE = 0.04
DECAY = 1e-6
THRESHOLD = 0.7
#: Bytes of a stem; levels of a term's count.
STEM = 6
LEVELS = 3

U64 = np.uint64
_SALTS = np.random.Generator(np.random.PCG64(20250131)).integers(0, 2**64, 2 * LEVELS, dtype=U64)
_INNER = np.zeros(256, bool)
_INNER[128:] = True
_INNER[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of letters, digits and bytes beyond ASCII, and the text of each."""
    inner = _INNER[raw]
    begins, ends = inner.copy(), inner.copy()
    begins[1:] &= ~inner[:-1]
    ends[:-1] &= ~inner[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begins[cuts] = inner[cuts]
    ends[cuts - 1] = inner[cuts - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def _levels(doc: np.ndarray, keys: np.ndarray, salts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for each text and key, and again for its second and third occurrence."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    level = np.arange(len(keys)) - first
    on = level < LEVELS
    return doc[on], mix(keys[on] ^ salts[level[on]])


def terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Terms of each text (as signed 64-bit numbers), and for each text the index of its first one, with the total."""
    found, counts = [np.zeros(0, np.int64)], []
    lowered = pc.utf8_lower(texts)
    for _, raw, offsets in blocks(lowered):
        n = len(offsets) - 1
        if not len(raw):
            counts.append(np.zeros(n, np.int64))
            continue
        starts, ends, doc = _words(raw, offsets)
        long = ends - starts > STEM
        parts = [_levels(doc, hashes(raw, starts, ends, lower=False), _SALTS[:LEVELS]), _levels(doc[long], hashes(raw, starts[long], starts[long] + STEM, lower=False), _SALTS[LEVELS:])]
        doc, keys = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(doc, kind="stable")
        found.append(keys[order].view(np.int64))
        counts.append(np.bincount(doc, minlength=n))
    return np.concatenate(found), np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))]).astype(np.int64)


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows at[k] .. at[k+1]-1 of ``values``."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    return total[at[1:]] - total[at[:-1]]


@dataclass
class ToxicModel:
    """Kept terms (sorted), and the machine's bias, weights and factors."""

    keys: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def known(self, found: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the terms that the model keeps, and the new text boundaries."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
        k = np.minimum(np.searchsorted(self.keys, found), len(self.keys) - 1)
        hit = self.keys[k] == found
        return k[hit], np.concatenate([[0], np.cumsum(hit)])[at]

    def margin(self, index: np.ndarray, at: np.ndarray) -> np.ndarray:
        v = self.factors[index]
        pairs = _sums(v, at)
        return self.bias + _sums(self.weights[index], at) + 0.5 * (pairs**2 - _sums(v**2, at)).sum(axis=1)

    def score(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.known(*terms(texts))), -30, 30)))


def train(model: ToxicModel, rows: list[np.ndarray], y: np.ndarray, seed: int) -> ToxicModel:
    """Stochastic steps (each coordinate's rate falls with its own gradients) on texts given as indexes of terms."""
    w, v, b = model.weights.copy(), model.factors.copy(), model.bias
    gw, gv, gb = np.full(w.shape, 1e-6), np.full(v.shape, 1e-6), 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for first in range(0, len(order), BATCH):
            pick = order[first : first + BATCH]
            index = np.concatenate([rows[k] for k in pick])
            sizes = np.array([len(rows[k]) for k in pick])
            at = np.concatenate([[0], np.cumsum(sizes)])
            vi = v[index]
            pairs = _sums(vi, at)
            margin = b + _sums(w[index], at) + 0.5 * (pairs**2 - _sums(vi**2, at)).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[pick]) / len(pick)
            each = np.repeat(slope, sizes)
            used, place = np.unique(index, return_inverse=True)
            dw = np.bincount(place, each, len(used)) + DECAY * w[used]
            step = each[:, None] * (np.repeat(pairs, sizes, axis=0) - vi)
            dv = np.stack([np.bincount(place, step[:, f], len(used)) for f in range(v.shape[1])], axis=1) + DECAY * v[used]
            db = slope.sum()
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= FACTOR_RATE * dv / np.sqrt(gv[used])
            b -= RATE * db / np.sqrt(gb)
    return ToxicModel(model.keys, float(b), w, v)


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, y, text) of at most twice ``size`` labelled texts; of rows with one id, the least text."""
    marks = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("y"), F.max("toxic").alias("_y")).where("y = _y AND doc_id is not null")
    picked = hash_sample(marks, "doc_id", size).select(F.col("doc_id").cast("long").alias("_id"), F.col("y").cast("double").alias("y"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(picked), F.col("id") == F.col("_id")).groupBy("id", "y").agg(F.min("text").alias("text"))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, at = terms(as_strings(batch.column("text")))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.LargeListArray.from_arrays(pa.array(at), pa.array(found)).cast(pa.list_(pa.int64()))], names=["id", "y", "terms"])


def _learner(model: ToxicModel, seed: int):
    def learn(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        own = train(model, [np.asarray(i, np.int64) for i in group["index"]], group["y"].to_numpy(), seed)
        return pd.DataFrame({"shard": [group["shard"].iloc[0]], "bias": [own.bias], "weights": [own.weights.tobytes()], "factors": [own.factors.tobytes()]})

    return learn


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = FIT_ROWS, seed: int = 11) -> ToxicModel | None:
    """The machine learnt from ``labels`` (doc_id, toxic 0/1; training rows only); None if one of the classes is missing.

    An id with two different labels is left out."""
    rows = materialize(_sample(docs, labels, id_col, text_col, size).mapInArrow(_term_rows, "id long, y double, terms array<long>"), batch_rows=TEXT_ROWS)
    n, toxic = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or not 0 < toxic < n:
        discard(rows)
        return None
    share = toxic / n
    counted = rows.select("y", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("y").alias("a")).where(F.col("n") >= LEAST)
    chi = F.pow(F.col("a") - F.col("n") * share, F.lit(2)) / (F.col("n") * (share * (1 - share)))
    kept = counted.select("term", chi.alias("chi")).where(F.col("chi") > CHI).orderBy(F.desc("chi"), "term").limit(TERMS).select("term").toPandas()["term"]
    keys = np.sort(kept.to_numpy(np.int64))
    model = ToxicModel(keys, float(np.log(share / (1 - share))), np.zeros(len(keys)), np.random.default_rng(seed).normal(0, 0.02, (len(keys), FACTORS)))
    shards = -(-n // SHARD_ROWS)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = ToxicModel(keys, 0.0, np.zeros(0), np.zeros((0, 0)))
        for batch in batches:
            column = batch.column("terms")
            index, at = empty.known(np.asarray(column.flatten()), np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(column)))]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("y"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(index, pa.int32()))], names=["id", "y", "index"])

    shard = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard")
    indexed = materialize(rows.mapInArrow(known, "id long, y double, index array<int>").select("id", "y", "index", shard), batch_rows=TEXT_ROWS)
    for turn in range(ROUNDS):
        found = sorted(indexed.groupBy("shard").applyInPandas(_learner(model, seed + 1_000 * turn), "shard int, bias double, weights binary, factors binary").collect(), key=lambda r: r["shard"])
        model = ToxicModel(keys, float(np.mean([r["bias"] for r in found])), sum(np.frombuffer(r["weights"]) for r in found) / len(found), sum(np.frombuffer(r["factors"]) for r in found).reshape(-1, FACTORS) / len(found))
    discard(rows, indexed)
    return model


def score(docs: DataFrame, model: ToxicModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row; without a model every score is 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS * (FACTORS + 2) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_strings(batch.column("text"))
            found = shared.value.score(texts) if shared.value else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels a model may see: rows whose crc32(doc_id as text) mod 3 is not 1."""
    return labels.where(crc_mod("doc_id", 3) != 1)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, learnt from ``labels`` outside the held-out third.

    Null and empty texts, and texts without a known term, score what the bias alone gives.  Whole texts are read, however
    long; equal texts get equal scores; a score of exactly the threshold is predicted 1.  Repeated rows and null ids give a
    row each.  Without usable labels, or with labels of one kind only, every score is 0.5.  An empty table gives an empty
    result.  Other columns are never read, whatever their names."""
    return score(docs, fit(docs, training_labels(labels), id_col, text_col), id_col, text_col)
