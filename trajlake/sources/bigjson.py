"""One large JSON file read by many tasks.

A file of results is one JSON object with long arrays in it; Spark's whole-file reader makes it one row in one task.
Here its text is read in the ranges in which Spark splits any text file, cut at closing braces, and in two passes:

1. Each range is summed up without knowing where in the file it lies.  The one thing that decides what a character means
   is whether the range begins inside a text; so there are two small summaries, one for each case: how far the nesting
   goes up or down, whether the range ends inside a text, and how many containers and commas there are at each
   relative depth.  Putting the summaries of the ranges before it together (sums over one row for each range) tells each
   range its own case, depth, and how many containers and elements come before it.
2. Each range then cuts its text at the commas of the level where the elements are.  Elements inside one range are done;
   one that lies across a border comes in pieces, which are joined by their number.

No task holds more of a file than its range and one element.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajlake.storage import dropped, written

#: Depth that Spark's parser reads: a range's summary needs no relative depths beyond.
DEEPEST = 1_000
#: Ranges whose states are broadcast; beyond that they are joined by a shuffle.
BROADCAST_RANGES = 1_000_000

_STEP = np.zeros(256, np.int64)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
_MARK = _STEP != 0
_MARK[ord(",")] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True

SUMMARY = "file long, block long, parity int, delta0 long, delta1 long, first string, marks array<struct<inside:int,depth:long,opens:long,commas:long>>"
PIECES = "file long, block long, head boolean, m long, c long, whole boolean, opener string, text binary"


def _text(spark: SparkSession, path: str) -> DataFrame:
    """(v, file, block): the text up to each closing brace, with its file (a hash: rows are many and names long) and range."""
    rows = spark.read.text(path, lineSep="}")
    return rows.select(F.col("value").cast("binary").alias("v"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _names(spark: SparkSession, path: str) -> DataFrame:
    """(file, name) of the files, without reading them."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_path").alias("name"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(file, range, first row, bytes with the closing braces put back) for rows of one range that follow each other."""
    n = batch.num_rows
    if not n:
        return
    which, block = np.asarray(batch.column("file")), np.asarray(batch.column("block"))
    cuts = np.flatnonzero((which[1:] != which[:-1]) | (block[1:] != block[:-1])) + 1
    column = batch.column("v").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), n], strict=True):
        raw = data[offsets[start] : offsets[stop]]
        yield int(which[start]), int(block[start]), start, np.insert(raw, offsets[start + 1 : stop + 1] - offsets[start], ord("}"))


def _quotes(raw: np.ndarray) -> np.ndarray:
    """Number of quotation marks up to and with each byte, without escaped ones (a range begins behind a brace)."""
    quote = raw == ord('"')
    slash = raw == ord("\\")
    if slash.any():
        last = np.maximum.accumulate(np.where(slash, -1, np.arange(len(raw))))
        at = np.flatnonzero(quote)
        run = at - 1 - np.where(at > 0, last[np.maximum(at - 1, 0)], -1)
        quote[at[run % 2 == 1]] = False
    return np.cumsum(quote)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, parity, delta, first, marks = None, 0, [0, 0], None, {}

    def row() -> pa.RecordBatch:
        found = [{"inside": h, "depth": d, "opens": o, "commas": c} for (h, d), (o, c) in marks.items()]
        kind = pa.list_(pa.struct([("inside", pa.int32()), ("depth", pa.int64()), ("opens", pa.int64()), ("commas", pa.int64())]))
        return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([parity], pa.int32()), pa.array([delta[0]], pa.int64()), pa.array([delta[1]], pa.int64()), pa.array([first], pa.string()), pa.array([found], kind)], names=["file", "block", "parity", "delta0", "delta1", "first", "marks"])

    for batch in batches:
        for file, block, _, raw in _runs(batch):
            if (file, block) != now:
                if now is not None:
                    yield row()
                now, parity, delta, first, marks = (file, block), 0, [0, 0], None, defaultdict(lambda: [0, 0])
            if first is None and not _BLANK[raw].all():
                first = chr(raw[int(np.argmin(_BLANK[raw]))])
            quotes = _quotes(raw)
            at = np.flatnonzero(_MARK[raw])
            within = (quotes[at] + parity) & 1
            for inside in (0, 1):
                own = at[within == inside]
                step = _STEP[raw[own]]
                depth = delta[inside] + np.cumsum(step)
                for k, sign in enumerate((1, 0)):
                    for d, n in zip(*np.unique(depth[(step == sign) & (depth <= 2) & (depth >= -DEEPEST)], return_counts=True), strict=True):
                        marks[inside, int(d)][k] += int(n)
                if len(own):
                    delta[inside] = int(depth[-1])
            parity = (parity + int(quotes[-1])) & 1 if len(raw) else parity
    if now is not None:
        yield row()


def _states(text: DataFrame) -> DataFrame:
    """(file, block, inside, depth, level, m, c): how each range begins; a row for each range."""
    ranges = text.mapInArrow(_summaries, SUMMARY)
    in_file = Window.partitionBy("file").orderBy("block")
    before, everything = in_file.rowsBetween(Window.unboundedPreceding, -1), in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    known = ranges.withColumn("inside", F.pmod(F.coalesce(F.sum("parity").over(before), zero), F.lit(2)).cast("int"))
    known = known.withColumn("depth", F.coalesce(F.sum(F.when(F.col("inside") == 0, F.col("delta0")).otherwise(F.col("delta1"))).over(before), zero))
    known = known.withColumn("level", F.when(F.first("first", ignorenulls=True).over(everything) == "[", 1).otherwise(2))
    counted = known.withColumn("own", F.get(F.filter("marks", lambda x: (x["inside"] == F.col("inside")) & (x["depth"] == F.col("level") - F.col("depth"))), F.lit(0)))
    sums = [F.coalesce(F.sum(F.coalesce(F.col(f"own.{name}"), zero)).over(before), zero).alias(short) for name, short in (("opens", "m"), ("commas", "c"))]
    return counted.select("file", "block", "inside", "depth", "level", *sums)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of elements and of what lies between the containers of elements ("heads")."""
    now, out = None, []
    inside = depth = level = m = c = 0
    begun, done, buffer = True, False, []

    def piece(ended: bool, opener: str | None = None) -> None:
        head = depth < level
        out.append((*now, head, m + 1 if head else m, c, begun and ended, opener, b"".join(buffer)))

    def flush() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.binary()]
        made = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in PIECES.split(", ")])
        out.clear()
        return made

    for batch in batches:
        for file, block, start, raw in _runs(batch):
            if (file, block) != now:
                if now is not None and not done:
                    piece(False)
                now = (file, block)
                inside, depth, level, m, c = (batch.column(k)[start].as_py() for k in ("inside", "depth", "level", "m", "c"))
                begun, done, buffer = block == 0, block > 0 and depth <= 0, []
            quotes = _quotes(raw)
            at = np.flatnonzero(_MARK[raw])
            at = at[((quotes[at] + inside) & 1) == 0]
            inside = (inside + int(quotes[-1])) & 1 if len(raw) else inside
            if done:
                continue
            step = _STEP[raw[at]]
            depths = depth + np.cumsum(step)
            opens, closes = (step == 1) & (depths == level), (step == -1) & (depths == level - 1)
            events = np.flatnonzero(opens | closes | ((step == 0) & (depths == level)) | ((step == -1) & (depths == 0)))
            text, last = raw.tobytes(), 0
            for e in events.tolist():
                position = int(at[e])
                buffer.append(text[last:position])
                depth = int(depths[e] - step[e])
                piece(True, chr(raw[position]) if opens[e] else None)
                depth, last, begun, buffer = int(depths[e]), position + 1, True, []
                if opens[e]:
                    m += 1
                elif step[e] == 0:
                    c += 1
                elif depth <= 0:
                    done = True
                    break
            if not done:
                buffer.append(text[last:])
                depth = int(depths[-1]) if len(depths) else depth
        if out:
            yield flush()
    if now is not None and not done:
        piece(False)
    if out:
        yield flush()


class SplitJson:
    """The parts of large JSON files (a path, folder or pattern): objects whose members are arrays, objects or plain
    values, or arrays of elements.

    ``elements`` (file, key, kind, position, text): every element of a root's array members (kind ``[``), every entry of
    its object members (kind ``{``, the text is ``"name": value``); of a root that is an array, its elements (key null).
    ``values`` (file, key, value): the members that are neither.  Positions count from 0.  Empty containers have no rows.
    Malformed files give whatever their brackets make of them, as the parser of the elements then says.

    The pieces are computed once, when the object is made, and kept in the shared folder until ``close``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        text = _text(spark, path)
        states = written(_states(text))
        few = states.count() <= BROADCAST_RANGES
        if few:
            placed = text.join(F.broadcast(states), ["file", "block"])
        else:
            placed = text.withColumn("place", F.monotonically_increasing_id()).join(states, ["file", "block"]).sortWithinPartitions("file", "block", "place")
        self._pieces = written(placed.mapInArrow(_cut, PIECES))
        dropped(states)
        parts = self._pieces.where("not whole").groupBy("file", "head", "m", "c").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("p"), F.max("opener").alias("opener"))
        joined = parts.select("file", "head", "m", "c", "opener", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["text"])).cast("string").alias("text"))
        whole = self._pieces.where("whole").select("file", "head", "m", "c", "opener", F.col("text").cast("string").alias("text")).unionByName(joined)
        name = F.regexp_extract("text", r'"((?:[^"\\]|\\.)*)"\s*:\s*$', 1)
        heads = whole.where("head").join(_names(spark, path), "file").select("file", "name", "m", F.col("c").alias("c0"), F.col("opener").alias("kind"), "text", F.when(F.col("text").rlike(r":\s*$"), F.from_json(F.concat(F.lit('["'), name, F.lit('"]')), "array<string>")[0]).alias("key"))
        items = whole.where(~F.col("head") & F.col("text").rlike(r"\S")).select("file", "m", "c", F.trim("text").alias("text"))
        self.elements = items.join(heads.where("kind is not null").select("file", "name", "m", "c0", "kind", "key"), ["file", "m"]).select(F.col("name").alias("file"), "key", "kind", (F.col("c") - F.col("c0")).alias("position"), "text")
        plain = F.regexp_replace(F.regexp_replace("text", r'"(?:[^"\\]|\\.)*"\s*:\s*$', ""), r"^[\s\x{FEFF}]*[{,]|,\s*$", "")
        self.values = heads.select(F.col("name").alias("file"), F.explode(F.from_json(F.concat(F.lit("{"), plain, F.lit("}")), "map<string,string>")).alias("key", "value"))

    def close(self) -> None:
        dropped(self._pieces)
