"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics come from the text alone.  A Gaussian kernel over them (standardised) is approximated by random Fourier
features; every partition sums its normal equations, the sums are added up by row of the matrix, and the driver
solves one system of fixed size.  A part of the training rows is kept for calibration: their raw scores are counted
in bins and fitted by pool-adjacent-violators, so a score is an estimate of the probability of label 1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import TEXT_ROWS, crc_mod, discard, materialize, tree_sums
from trajlake.llm.textops import as_strings, blocks, hashes, spans

#: Random Fourier features, the kernel's width in standard deviations, and the ridge penalty for each training row.
FEATURES = 256
WIDTH = 3.0
RIDGE = 1e-4
#: Bins of the raw score for calibration, over this range.
BINS = 400
RANGE = (-0.5, 1.5)
THRESHOLD = 0.7
NAMES = (
    "log_bytes", "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "exclaims", "other_marks", "controls", "high_bytes",
    "lines_per_word", "unique_words", "long_words", "short_words", "word_spread", "capital_words", "letters",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_CLASSES = (
    ("upper", _class(_LETTERS.upper())), ("digits", _class("0123456789")), ("symbols", _class("#*$%&|<>")), ("stops", _class(".,;:")), ("exclaims", _class("!?")),
    ("other_marks", _class("@/\\_=+-~^`'\"()[]{}")), ("controls", _class("".join(map(chr, [*range(9), *range(14, 32), 127])))), ("high_bytes", np.arange(256) >= 128), ("letters", _class(_LETTERS)),
)


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``NAMES`` for each text; an empty text has zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    for first, raw, offsets in blocks(texts):
        n = len(offsets) - 1
        size = np.diff(offsets)
        starts, ends, at = spans(raw, offsets)
        words = np.diff(at)
        row = {}
        for name, members in _CLASSES:
            total = np.concatenate([[0], np.cumsum(members[raw], dtype=np.int32)])
            row[name] = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1)
        lines = np.concatenate([[0], np.cumsum(raw == 10, dtype=np.int32)])
        lengths = ends - starts
        doc = np.repeat(np.arange(n), words)
        per = np.maximum(words, 1)
        mean = np.bincount(doc, lengths, n) / per
        row |= {"log_bytes": np.log1p(size), "log_words": np.log1p(words), "word_bytes": mean}
        row["word_spread"] = np.sqrt(np.maximum(0, np.bincount(doc, lengths.astype(float) ** 2, n) / per - mean**2))
        row["lines_per_word"] = (lines[offsets[1:]] - lines[offsets[:-1]]) / per
        row["long_words"] = np.bincount(doc, lengths >= 16, n) / per
        row["short_words"] = np.bincount(doc, lengths <= 2, n) / per
        row["capital_words"] = np.bincount(doc, (raw[starts] >= 65) & (raw[starts] <= 90), n) / per if len(starts) else np.zeros(n)
        h = hashes(raw, starts, ends)
        order = np.lexsort((h, doc))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
        row["unique_words"] = np.bincount(doc[order], fresh, n) / per
        out[first : first + n] = np.stack([row[k] for k in NAMES], axis=1)
    return out


def document_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<double>) for each row; null text as empty."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for batch in batches:
            x = statistics(as_strings(batch.column("text")))
            flat = pa.array(x.reshape(-1))
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, flat)], names=["id", "x"])

    return base.mapInArrow(run, "id long, x array<double>")


@dataclass
class QualityModel:
    """Standardisation, random projection, ridge weights and the calibration curve."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    values: np.ndarray
    seed: int

    def fourier(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, 1 / WIDTH, (len(self.mean), FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))], axis=1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.fourier(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return np.clip((1 - 1e-6) * np.interp(raw, self.points, self.values) + 1e-6 * (np.clip(raw, *RANGE) - RANGE[0]) / (RANGE[1] - RANGE[0]), 0, 1)


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing fit with the least weighted squares."""
    levels: list[list[float]] = []
    for v, w in zip(values, weights, strict=True):
        levels.append([v, w, 1])
        while len(levels) > 1 and levels[-2][0] >= levels[-1][0]:
            b, a = levels.pop(), levels.pop()
            levels.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]])
    return np.concatenate([np.full(int(n), v) for v, _, n in levels]) if levels else np.zeros(0)


def fit(features: DataFrame, labels: DataFrame, seed: int = 5) -> QualityModel | None:
    """Train on the labelled rows of ``features`` (id, x); ``labels``: doc_id, quality 0/1, training rows only.

    A document with two different labels is left out; None if one of the classes is missing."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("_y")).where("y = _y")
    rows = materialize(features.join(marks, features["id"] == marks["doc_id"]).select("id", "x", F.col("y").cast("double").alias("y"), (F.pmod(F.xxhash64("id"), F.lit(4)) == 0).alias("calibrates")))
    d = len(NAMES)
    sums = rows.where("not calibrates").select(F.count("*").alias("n"), F.sum("y").alias("good"), *[F.avg(F.col("x")[k]).alias(f"m{k}") for k in range(d)], *[F.stddev_pop(F.col("x")[k]).alias(f"s{k}") for k in range(d)]).first()
    if not sums["n"] or not 0 < sums["good"] < sums["n"]:
        return None
    scale = np.array([sums[f"s{k}"] for k in range(d)])
    model = QualityModel(np.array([sums[f"m{k}"] for k in range(d)]), np.where(scale > 1e-9, scale, 1.0), np.zeros(FEATURES + 1), np.array([0.0, 1.0]), np.array([0.0, 1.0]), seed)

    def partial(batches):
        total = None
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            z = model.fourier(x)
            part = z.T @ np.concatenate([z, np.asarray(batch.column("y"))[:, None]], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([t.tobytes() for t in total], pa.binary())], names=["key", "sums"])

    parts = tree_sums(rows.where("not calibrates").select("x", "y").mapInArrow(partial, "key int, sums binary"), "float64")
    whole = np.stack([np.frombuffer(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["key"])])
    model.weights = np.linalg.solve(whole[:, :-1] + RIDGE * sums["n"] * np.eye(FEATURES + 1), whole[:, -1])

    def raw(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, d)
            bins = np.clip(((model.raw(x) - RANGE[0]) / (RANGE[1] - RANGE[0]) * BINS).astype(np.int32), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int32()), batch.column("y")], names=["bin", "y"])

    counted = rows.where("calibrates").select("x", "y").mapInArrow(raw, "bin int, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("bin").collect()
    if len(counted) > 1:
        n, good = np.array([r["n"] for r in counted], float), np.array([r["good"] for r in counted], float)
        rate = float(good.sum() / n.sum())
        model.points = RANGE[0] + (np.array([r["bin"] for r in counted]) + 0.5) * (RANGE[1] - RANGE[0]) / BINS
        model.values = pool_adjacent((good + rate) / (n + 1), n)
    discard(rows)
    return model


def score_features(features: DataFrame, model: QualityModel | None) -> DataFrame:
    """(id, score, predicted); without a model every score is 0.5."""

    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(-1, len(NAMES))
            score = model.score(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["id", "score", "predicted"])

    return features.mapInArrow(run, "id long, score double, predicted int")


def training_labels(labels: DataFrame) -> DataFrame:
    """The labels a model may see: rows whose crc32(doc_id as text) mod 4 is not 2."""
    return labels.where(crc_mod("doc_id", 4) != 2)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every row, learnt from ``labels`` outside the held-out quarter.

    Null and empty texts have statistics of zero and get a score like any other; long ones are measured whole.  Equal
    statistics get equal scores, and a score of exactly the threshold is predicted 1.  Repeated rows and null ids give a
    row each.  Without usable labels the score is 0.5 throughout.  An empty table gives an empty result.
    """
    features = materialize(document_features(docs, id_col, text_col), batch_rows=TEXT_ROWS)
    return score_features(features, fit(features, training_labels(labels)))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, all columns as they were; learnt as in ``classify``.

    Texts are measured twice, for the model and for the verdict: writing and reading whole rows with their statistics
    between the two was measured to cost more.  Without usable labels nothing is rejected; an empty table gives an empty
    result."""
    features = materialize(document_features(docs, id_col, text_col), batch_rows=TEXT_ROWS)
    model = fit(features, training_labels(labels))
    discard(features)
    if model is None:
        return docs

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.score(statistics(as_strings(batch.column(batch.schema.get_field_index(text_col)))))
                yield batch.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
