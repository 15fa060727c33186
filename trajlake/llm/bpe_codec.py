"""Whole-text BPE encoding and decoding, equal to the tokenizers library id for id.

A short text is encoded in its task.  A text of more than ``LONG_TEXT`` characters is cut into segments at blanks, and
runs without blanks into pre-tokens and those into parts; segments and parts are encoded in parallel by other tasks,
and one row for each text then joins them by tree concatenation (see ``wordbpe``).  So the work of a single huge text
is spread, and only its ids meet in one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajlake.llm.wordbpe import LONG_RUN, WordBpe, encode_column, encoder, tree_concat

#: Characters beyond which a text is spread over tasks.
LONG_TEXT = 1 << 16
#: Characters of a segment, about.
SEGMENT = 1 << 14


class _Pieces:
    """Ids as decimal text, and tokens, of encoded bytes; for whole runs from a memo."""

    def __init__(self, enc: WordBpe):
        self.enc = enc
        self.numbers = np.array([str(k) for k in range(len(enc.tokens))], object)
        self.words = np.array(enc.tokens, object)

    def ids(self, raw: bytes) -> np.ndarray:
        return np.frombuffer(raw, "<u4")

    def id_text(self, raw: bytes) -> bytes:
        return " ".join(self.numbers[self.ids(raw)].tolist()).encode()

    def decoded(self, raw: bytes) -> bytes:
        """As decode(ids, skip_special_tokens=False) of a file without a decoder: tokens with blanks between."""
        return " ".join(self.words[self.ids(raw)].tolist()).encode()


_pieces: dict[str, _Pieces] = {}


def pieces_of(path: str) -> _Pieces:
    if path not in _pieces:
        _pieces[path] = _Pieces(encoder(path))
    return _pieces[path]


def _digest_rows(path: str):
    def run(batches):
        p = pieces_of(path)
        for batch in batches:
            counts, ids, texts = [], [], []
            for raw in encode_column(p.enc, batch.column("text").to_pylist()):
                counts.append(len(raw) // 4)
                ids.append(hashlib.sha256(p.id_text(raw)).hexdigest())
                texts.append(hashlib.sha256(p.decoded(raw)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def cut_text(enc: WordBpe, text: str, segment: int = SEGMENT) -> list[tuple[int, int, str]]:
    """(unit, part, text): unit -1 is a segment to encode as text; else a part of pre-token ``unit`` of a long run."""
    out: list[tuple[int, int, str]] = []
    unit, at = 0, 0
    flat = text.replace("\n", " ")
    while at < len(flat):
        end = min(len(flat), at + segment)
        if end < len(flat):
            blank = flat.rfind(" ", at, end)
            if blank < 0:
                blank = flat.find(" ", end)
            end = len(flat) if blank < 0 else blank + 1
        piece = flat[at:end]
        if len(piece) <= max(segment, LONG_RUN):
            out.append((-1, 0, piece))
        else:
            for is_unit, parts in enc.cut_run(piece.rstrip(" ")):
                if is_unit and len(parts) > 1:
                    out += [(unit, k, p) for k, p in enumerate(parts)]
                    unit += 1
                elif is_unit:
                    out.append((-2, 0, parts[0]))
                else:
                    out.append((-1, 0, parts[0]))
        at = end
    return out


def _segments(path: str):
    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        enc = encoder(path)
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                cut = cut_text(enc, text)
                unit, piece, texts = zip(*cut, strict=True)
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 40) + row] * n), pa.array([doc_id] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(unit, pa.int64()), pa.array(texts, pa.string())],
                    names=["row", "id", "at", "unit", "text"],
                )
                row += 1

    return run


def _encode_segments(path: str):
    def run(batches):
        enc = encoder(path)
        for batch in batches:
            units, texts = batch.column("unit").to_pylist(), batch.column("text").to_pylist()
            plain = encode_column(enc, [t for u, t in zip(units, texts, strict=True) if u == -1])
            coded = [next(plain) if u == -1 else np.array(enc.encode_unit(t), "<u4").tobytes() for u, t in zip(units, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("row", "id", "at", "unit")], pa.array(coded, pa.binary())], names=["row", "id", "at", "unit", "ids"])

    return run


def _assemble(path: str):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        p = pieces_of(path)
        group = group.sort_values("at", ignore_index=True)
        out: list[bytes] = []
        open_unit, parts = -1, []

        def close():
            if parts:
                out.append(np.array(tree_concat([np.frombuffer(x, "<u4").tolist() for x in parts], p.enc.texts, p.enc.encode_unit), "<u4").tobytes())
                parts.clear()

        for unit, raw in zip(group["unit"], group["ids"], strict=True):
            if unit != open_unit or unit < 0:
                close()
            open_unit = unit
            if unit >= 0:
                parts.append(raw)
            else:
                out.append(raw)
        close()
        raw = b"".join(out)
        return pd.DataFrame({"id": pd.array([group["id"].iloc[0]], dtype="Int64"), "n_tokens": [len(raw) // 4], "ids_sha256": [hashlib.sha256(p.id_text(raw)).hexdigest()], "decoded_sha256": [hashlib.sha256(p.decoded(raw)).hexdigest()]})

    return run


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every text, for use as training input; see ``encode_digests`` for the cases."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            ids = [np.frombuffer(raw, "<u4").astype(np.int32) for raw in encode_column(enc, batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(ids, pa.list_(pa.int32()))], names=["id", "ids"])

    return base.mapInArrow(run, "id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(id, text) from (id, ids), as the library's decode without skipping special tokens; null ids give empty text."""

    def run(batches):
        words = pieces_of(tokenizer_path).words
        for batch in batches:
            texts = [" ".join(words[np.asarray(ids or [], np.int64)].tolist()) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return encoded.select("id", "ids").mapInArrow(run, "id long, text string")


def encode_digests(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", long_text: int = LONG_TEXT) -> DataFrame:
    """For each row: id, n_tokens, and SHA-256 of the ids and of the decoded text.

    Null counts as empty text (no ids; digests of nothing).  Repeated rows and null ids give a row each; an empty
    table an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    short = base.where(F.length("text") <= long_text).mapInArrow(_digest_rows(tokenizer_path), schema)
    cut = base.where(F.length("text") > long_text).mapInArrow(_segments(tokenizer_path), "row long, id long, at long, unit long, text string")
    spread = cut.repartition("row", "at").mapInArrow(_encode_segments(tokenizer_path), "row long, id long, at long, unit long, ids binary")
    joined = spread.groupBy("row").applyInPandas(_assemble(tokenizer_path), schema)
    return short.unionByName(joined)
