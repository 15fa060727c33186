"""Token counts under a unigram vocabulary: Viterbi that keeps only the best score and the piece count.

Aho-Corasick enumerates every vocabulary piece that ends at each place; dynamic programming over the places keeps the
best score and, with it, the number of pieces.  No segmentation is built.  The rules are those of the tokenizers
library's Unigram model in double precision: a path replaces another only if its score is strictly higher, and
pieces are tried from the earliest start, so among equals the earliest start (the longest last piece) stays; a
character that is no piece itself costs the lowest score less 10, a run of such characters counts as one unknown
piece, or byte for byte where the vocabulary has all its bytes.  Every word, also an empty one between two blanks,
starts with ``U+2581``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_MARK = "▁"
UNKNOWN_PENALTY = 10.0
BYTE_PIECE = re.compile("<0x[0-9A-F]{2}>")
#: Words that a task remembers before it starts again, and the longest of them: together they bound its memory.
MEMO_WORDS = 1_000_000
MEMO_CHARACTERS = 64


def read_vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """Pieces with scores, and the unknown id, of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(k), model.get_score(k)) for k in range(model.get_piece_size())], model.unk_id()


class UnigramCounter:
    """Counts pieces of words; ``vocabulary``: (piece, score), ids are positions."""

    def __init__(self, vocabulary: list[tuple[str, float]], unknown: int = 0, memo_words: int = MEMO_WORDS):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.automaton.add_word(piece, (len(piece), float(score)))
        self.automaton.make_automaton()
        self.unknown_score = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.bytes = frozenset(int(p[3:5], 16) for p, _ in vocabulary if BYTE_PIECE.fullmatch(p))
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.memo: dict[str, int] = {}
        self.memo_words = memo_words

    def count_word(self, word: str) -> int:
        """Pieces of one word, its mark included; time and memory in proportion to its length.

        A place keeps its best score, its pieces and, inside a run of unknown characters, the pieces before the run,
        the run's bytes and whether the vocabulary has them all.  No piece reaches back further than the longest one,
        so only that many places are kept."""
        ring = self.longest + 1
        best, pieces = [0.0] * ring, [0] * ring
        runs: list[tuple[int, int, bool] | None] = [None] * ring  # pieces before the run, its bytes, all known
        found = self.automaton.iter(word)
        ahead = next(found, None)
        for end, character in enumerate(word):
            matches = []
            while ahead is not None and ahead[0] == end:
                matches.append(ahead[1])
                ahead = next(found, None)
            matches.sort(key=lambda m: -m[0])
            if not matches or matches[-1][0] != 1:
                matches.append((0, self.unknown_score))
            here, top = (end + 1) % ring, None
            for length, score in matches:
                start = (end + 1 - (length or 1)) % ring
                total = best[start] + score
                if top is None or total > top:
                    top = total
                    if length:
                        result = pieces[start] + 1, None
                    else:  # the run of unknown characters begins or goes on
                        before, size, known = runs[start] or (pieces[start], 0, bool(self.bytes))
                        raw = character.encode()
                        run = before, size + len(raw), known and self.bytes.issuperset(raw)
                        result = before + (run[1] if run[2] else 1), run
            best[here] = top
            pieces[here], runs[here] = result
        return pieces[len(word) % ring]

    def count(self, text: str) -> int:
        if not text:
            return 0
        words = text.replace(SPACE_MARK, " ").split(" ")
        words = words if words[0] else words[1:]  # the mark before the first word is there already
        memo = self.memo
        try:
            return sum(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > self.memo_words:
                memo = self.memo = {}
            total = 0
            for w in words:
                n = memo.get(w)
                if n is None:
                    n = self.count_word(SPACE_MARK + w)
                    if len(w) <= MEMO_CHARACTERS:
                        memo[w] = n
                total += n
            return total


_here: dict[str, UnigramCounter] = {}


def counter(path: str) -> UnigramCounter:
    if path not in _here:
        _here[path] = UnigramCounter(*read_vocabulary(path))
    return _here[path]


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) for each row; null counts as empty text (no tokens).

    Texts of any length are counted whole, in time and memory in proportion to them.  Equal scores are decided as the
    library decides them (see above).  Repeated rows and null ids give a row each, an empty table an empty result; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        c = counter(vocabulary_path)
        for batch in batches:
            counts = np.fromiter((c.count(t) if t else 0 for t in batch.column("text").to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts)], names=["id", "n_tokens"])

    return base.mapInArrow(run, "id long, n_tokens long")
