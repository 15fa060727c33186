"""Encoding with a word-end BPE tokenizer file of the tokenizers library, exactly as that library does.

Text between blanks encodes by itself, so its result is remembered (a bounded memo for each task).  Text without a
blank can be any length: its pre-tokens beyond ``LEAF`` bytes are encoded by tree concatenation.  Halves are encoded
apart; around each join a growing window is encoded again until it starts with the left side's tokens and ends with
the right side's, and then replaces what lies between.  Two neighbouring tokens that stand together in one encoding
may stand together in any, so agreement on both sides makes the whole exact; a window that reaches an end needs no
agreement there.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Bytes of a pre-token that are encoded in one piece; longer ones are cut in halves.
LEAF = 2048
#: Characters of a blank-free run that the library gets in one piece.
LONG_RUN = 8192
#: Runs that one generation of a task's memo holds, and by its bytes: there are two generations, the one that
#: is being filled and the one before it, so frequent runs stay known while memory stays bounded.
MEMO_RUNS = 1_000_000
#: Bytes that a generation may hold for each run of its limit.
MEMO_BYTES_A_RUN = 100


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def join_tokens(left: list[int], right: list[int], texts: list[str], encode) -> list[int]:
    """Tokens of the joined text from those of its two parts.  ``texts``: each id's own text; ``encode``: of a text."""
    if not left or not right:
        return left or right
    reach = 8
    while True:
        i, j = max(0, len(left) - reach), min(len(right), reach)
        head = "".join(texts[t] for t in left[i:])
        window = encode(head + "".join(texts[t] for t in right[:j]))
        if i == 0 or window[:2] == left[i : i + 2]:
            if j == len(right):
                return left[:i] + window
            places, at = {}, len(head)
            for n in range(j):
                places[at] = n
                at += len(texts[right[n]])
            at = 0
            for m, t in enumerate(window):
                n = places.get(at)
                if n is not None and right[n : n + 2] == window[m : m + 2] and n + 2 <= j and m + 2 <= len(window):
                    return left[:i] + window[:m] + right[n:]
                at += len(texts[t])
        reach *= 2


def tree_concat(parts: list[list[int]], texts: list[str], encode) -> list[int]:
    """Join the tokens of successive parts pairwise, level by level."""
    while len(parts) > 1:
        parts = [join_tokens(parts[k], parts[k + 1], texts, encode) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else []


class WordBpe:
    """A tokenizer file with the memo of one task."""

    def __init__(self, path: str, memo_runs: int = MEMO_RUNS):
        self.tok = load(path)
        self.memo_runs = memo_runs
        size = self.tok.get_vocab_size()
        self.tokens = [self.tok.id_to_token(k) or "" for k in range(size)]
        self.texts = [t.removesuffix("</w>") for t in self.tokens]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.ids: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}
        self.held = 0  # bytes in the generation that is being filled

    def encode_unit(self, unit: str) -> list[int]:
        """Tokens of one pre-token, or of a part of one, without cutting it."""
        return [t.id for t in self.tok.model.tokenize(unit)]

    def cut_run(self, run: str) -> list[tuple[bool, list[str]]]:
        """A long run as successive items (is one pre-token, its parts); a special token's string is an item of its own."""
        items: list[tuple[bool, list[str]]] = []
        for piece in self.split_special.split(run) if self.split_special else [run]:
            if piece in self.special:
                items.append((False, [piece]))
            elif piece:
                text = self.tok.normalizer.normalize_str(piece) if self.tok.normalizer else piece
                for unit, _ in self.tok.pre_tokenizer.pre_tokenize_str(text):
                    items.append((True, [unit[k : k + LEAF] for k in range(0, len(unit), LEAF)]))
        return items

    def encode_run(self, run: str) -> list[int]:
        """Tokens of a run without blanks, by tree concatenation where it is long."""
        if len(run) <= LONG_RUN:
            return self.tok.encode(run, add_special_tokens=False).ids
        out: list[int] = []
        for is_unit, parts in self.cut_run(run):
            out += tree_concat([self.encode_unit(p) for p in parts], self.texts, self.encode_unit) if is_unit else [self.tok.token_to_id(parts[0])]
        return out

    def learn(self, runs: list[str]) -> None:
        """Put the runs that are not yet known into the memo."""
        known = self.ids
        new = [r for r in dict.fromkeys(runs) if r not in known]
        for run in [r for r in new if len(r) > LONG_RUN]:
            known[run] = np.array(self.encode_run(run), "<u4").tobytes()
            self.held += 4 * len(run) + len(known[run])
        new = [r for r in new if len(r) <= LONG_RUN]
        for k in range(0, len(new), 4096):
            some = new[k : k + 4096]
            done = self.tok.encode(" ".join(some), add_special_tokens=False)
            starts = np.cumsum([0] + [len(r) + 1 for r in some])
            at = np.searchsorted(np.fromiter((o[0] for o in done.offsets), np.int64, len(done)), starts).tolist()
            raw = memoryview(np.array(done.ids, "<u4").tobytes())
            known.update((r, bytes(raw[4 * a : 4 * b])) for r, a, b in zip(some, at, at[1:], strict=False))
            self.held += int(starts[-1]) + len(raw)

    def runs(self, text: str) -> list[str]:
        return text.replace("\n", " ").split(" ")

    def encode_bytes(self, runs: list[str]) -> bytes:
        """Ids of a text given as its runs: unsigned 32-bit little-endian."""
        try:
            return b"".join(map(self.ids.__getitem__, runs))
        except KeyError:
            self.learn(runs)
            return b"".join(map(self.ids.__getitem__, runs))

    def encode_text(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(self.runs(text)), "<u4")

    def learn_all(self, texts: list[list[str]]) -> None:
        """Learn what many texts need at once; a single call of the library then covers them."""
        if len(self.ids) > self.memo_runs or self.held > MEMO_BYTES_A_RUN * self.memo_runs:
            self.before, self.ids, self.held = self.ids, {"": b""}, 0
        known, before = self.ids, self.before
        missing = {r for runs in texts for r in runs if r not in known}
        again = [r for r in missing if r in before]
        known.update((r, before[r]) for r in again)
        self.held += sum(map(len, again)) * 5
        if len(again) < len(missing):
            self.learn([r for r in missing if r not in before])


_here: dict[tuple[str, int], WordBpe] = {}


def encoder(path: str, memo_runs: int = MEMO_RUNS) -> WordBpe:
    """The encoder of this worker process; its memo serves all tasks that run here."""
    if (path, memo_runs) not in _here:
        _here[path, memo_runs] = WordBpe(path, memo_runs)
    return _here[path, memo_runs]


def encode_column(enc: WordBpe, texts: list[str | None], group: int = 256):
    """For each text its ids as bytes; null counts as empty."""
    for k in range(0, len(texts), group):
        runs = [enc.runs(t or "") for t in texts[k : k + group]]
        enc.learn_all(runs)
        for r in runs:
            yield enc.encode_bytes(r)
