"""Packing documents into fixed windows by non-negative least squares over length combinations.

Documents are tokenised and closed by an end id; whole windows are split off from the front, and what is left (1 to
2047 tokens) forms the histogram, in classes of ``STEP`` tokens.  All combinations of up to ``DEPTH`` classes that
fill a window exactly are enumerated; non-negative least squares finds how often to repeat each so that together
they use up the histogram.  Counts are rounded down, and a greedy best fit packs what the rounding and the
combinations leave over.  The driver sees only the histogram and the patterns (their number depends on the window,
not on the data); pieces find their places by their rank within their class, in the executors.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajlake.llm.common import TEXT_ROWS, materialize
from trajlake.llm.wordbpe import MEMO_RUNS, encode_column, encoder

WINDOW = 2048
#: Tokens of a length class; a window has WINDOW / STEP units.
STEP = 8
#: Most pieces of an enumerated combination.
DEPTH = 3
END_ID = 1


def combinations(units: int, depth: int) -> np.ndarray:
    """Columns: how often each class 1..units occurs in each combination of at most ``depth`` classes that sums to ``units``."""
    found: list[tuple[int, ...]] = [(units,)]
    shallow: list[tuple[int, ...]] = [(a,) for a in range(1, units)]
    for _ in range(depth - 1):
        found += [(*c, units - sum(c)) for c in shallow if units - sum(c) >= c[-1]]
        shallow = [(*c, b) for c in shallow for b in range(c[-1], units - sum(c))]
    out = np.zeros((units + 1, len(found)))
    for k, c in enumerate(found):
        for a in c:
            out[a, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, most: int = 3000) -> np.ndarray:
    """argmin |a x - b| over x >= 0, by the active-set method of Lawson and Hanson."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(most):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= tolerance:
            break
        active[best] = True
        while True:
            on = np.flatnonzero(active)
            part = a[:, on]
            try:
                trial = np.linalg.solve(part.T @ part, part.T @ b)
            except np.linalg.LinAlgError:  # dependent combinations
                trial = np.linalg.lstsq(part, b, rcond=None)[0]
            if (trial > tolerance * 1e-3).all():
                x[:] = 0
                x[on] = trial
                break
            low = trial <= tolerance * 1e-3
            ratio = x[on][low] / np.maximum(x[on][low] - trial[low], 1e-300)
            step = float(ratio.min()) if len(ratio) else 0.0
            x[on] += step * (trial - x[on])
            off = on[low & (x[on] <= tolerance * 1e-2)]
            if not len(off):
                off = on[low][[int(np.argmin(ratio))]]
            x[off] = 0
            active[off] = False
            if not active.any():
                break
    return x


def pack_histogram(counts: np.ndarray, depth: int = DEPTH) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns ([(class, times)] with the largest class first, repeats) that use each class exactly ``counts`` times.

    ``counts[c]``: pieces of class c; a window has ``len(counts) - 1`` units."""
    units = len(counts) - 1
    left = counts.astype(np.int64).copy()
    plan: list[tuple[list[tuple[int, int]], int]] = []
    if left[1:].sum():
        columns = combinations(units, depth)
        columns = columns[:, ~((columns > 0) & (left[:, None] == 0)).any(axis=0)]
        if columns.shape[1]:
            repeats = np.floor(nnls(columns, left.astype(float)) + 1e-6).astype(np.int64)
            for k in np.flatnonzero(repeats):
                used = np.flatnonzero(columns[:, k])[::-1]
                times = int(min(repeats[k], *(left[c] // int(columns[c, k]) for c in used)))
                if times > 0:
                    plan.append(([(int(c), int(columns[c, k])) for c in used], times))
                    for c in used:
                        left[c] -= times * int(columns[c, k])
    while left[1:].any():  # greedy best fit; each round uses up a class, so there are few rounds at any size
        room, pattern = units, []
        while room and left[1 : room + 1].any():
            c = 1 + int(np.flatnonzero(left[1 : room + 1])[-1])
            fit = int(min(room // c, left[c]))
            pattern.append((c, fit))
            left[c] -= fit
            room -= fit * c
        again = int(min(left[c] // n for c, n in pattern))
        for c, n in pattern:
            left[c] -= again * n
        plan.append((pattern, 1 + again))
    return plan


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int, step: int, id_col: str, text_col: str, end_id: int, memo_runs: int = MEMO_RUNS) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its class in its partition."""

    def run(batches):
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        enc, end = encoder(tokenizer_path, memo_runs), int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            ids, texts = batch.column("id").to_pylist(), batch.column("text").to_pylist()
            for doc_id, raw in zip(ids, encode_column(enc, texts), strict=True):
                raw += end
                total = len(raw) // 4
                for start in range(0, total, window):
                    piece = raw[4 * start : 4 * (start + window)]
                    length = len(piece) // 4
                    kind = -(-length // step)
                    rows.append((doc_id, start, length, zlib.crc32(piece), total, part, kind, seen[kind]))
                    seen[kind] += 1
            columns = list(zip(*rows, strict=True)) or [()] * 8
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "kind", "rank"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, part int, kind int, rank long")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, step: int = STEP, depth: int = DEPTH, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, memo_runs: int = MEMO_RUNS) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Null and empty texts are a document of the end id alone.  Repeated rows, and ids that are null or repeated, are
    packed like any others.  An empty table gives an empty result.  Other columns are ignored.  ``memo_runs``: what the encoder of a worker
    remembers; it trades memory for speed and changes nothing else.
    """
    spark = docs.sparkSession
    pieces = materialize(cut_documents(docs, tokenizer_path, window, step, id_col, text_col, end_id, memo_runs), batch_rows=TEXT_ROWS)
    per_part = pieces.groupBy("part", "kind").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = materialize(per_part.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    units = window // step
    counts = np.zeros(units + 1, np.int64)
    for row in bases.groupBy("kind").agg(F.sum("n").alias("n")).collect():  # at most ``units`` rows
        counts[row["kind"]] = row["n"]
    plan = pack_histogram(counts, depth)
    first_sequence = np.concatenate([[0], np.cumsum([n for _, n in plan])]).astype(np.int64)
    places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # class -> (first rank, pattern, times)
    given = np.zeros(units + 1, np.int64)
    for p, (pattern, repeats) in enumerate(plan):
        for c, times in pattern:
            places[c].append((int(given[c]), p, times))
            given[c] += repeats * times
    lookup = {c: tuple(np.array(v, np.int64).T) for c, v in places.items()}

    def place(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            rank = pdf["rank"].to_numpy() + pdf["base"].to_numpy()
            kinds = pdf["kind"].to_numpy()
            sequence, slot = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for c in np.unique(kinds):
                on = np.flatnonzero(kinds == c)
                firsts, patterns, times = lookup[int(c)]
                k = np.searchsorted(firsts, rank[on], "right") - 1
                inside = rank[on] - firsts[k]
                sequence[on] = first_sequence[patterns[k]] + inside // times[k]
                slot[on] = inside % times[k]
            out = pdf[["id", "start", "length", "ids_crc32", "doc_tokens", "kind"]].assign(sequence_id=sequence, slot=slot)
            out["id"] = pd.array(batch.column("id").to_pylist(), dtype="Int64")
            yield pa.RecordBatch.from_pandas(out, preserve_index=False)

    placed = pieces.join(bases.drop("n"), ["part", "kind"]).select("id", "start", "length", "ids_crc32", "doc_tokens", "kind", "rank", "base")
    placed = placed.mapInArrow(place, "id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("kind"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).select("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
