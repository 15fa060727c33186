"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

The patterns find assignments, access keys and hexadecimal strings.  The models cover the rest: candidate strings
(runs of ``[A-Za-z0-9_+/=-]``) are scored under a first-order Markov model of random strings and one of ordinary
identifiers, both smoothed by single characters; a candidate whose ratio reaches the cutoff is a secret.
The models are trained from labelled samples: random strings are the values that the patterns find in the whole of the
sampled texts, with seeded strings over the usual alphabets; identifiers are the other words of the sampled texts, also
joined as names in code are.  A quarter of the sampled texts is held out: the cutoff is the least ratio that at most a
share ``FALSE_RATE`` of its ordinary strings reaches (and never below ln(1 / FALSE_RATE), which by Markov's inequality
bounds that share under the model itself).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajlake.llm.common import discard, hash_sample, materialize, tree_sums

#: Fixed patterns of the base: kind, expression, least length of what is measured.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{20,}", re.ASCII)
#: Documents whose texts give the labelled samples (about; at most twice as many), and words taken from each.
SAMPLE_DOCS = 2_000
SAMPLE_WORDS = 400
#: Random strings added to those that the patterns find.
RANDOM_STRINGS = 4_000
#: Share of held-out ordinary strings that may pass for secrets, and the bins of log-likelihood ratios they are counted in.
FALSE_RATE = 1e-4
RATIO_BINS = np.arange(-400.0, 400.25, 0.25)
LEAST_LENGTH = 20
#: Weight of single characters in the smoothing of a pair.
BACKOFF = 5.0

_OTHER, _DIGIT = re.compile(r"[^A-Za-z0-9_+/=-]"), re.compile(r"[0-9]")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_+/=-"
_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


@dataclass
class SecretModel:
    """Log-likelihood ratios, random against ordinary, of character pairs, and the least ratio of a secret.

    recall and false_rate: of held-out pattern values and ordinary strings of ``LEAST_LENGTH`` characters or more, the
    shares that reach the cutoff (nan where there are none)."""

    ratio: np.ndarray
    cutoff: float = -float(np.log(FALSE_RATE))
    recall: float = float("nan")
    false_rate: float = float("nan")

    def score(self, text: str) -> tuple[float, float]:
        """Log-likelihood ratio of the whole string, and for each character pair on average."""
        codes = _CODE[np.frombuffer(text.encode("ascii"), np.uint8)]
        pairs = self.ratio[codes[:-1], codes[1:]]
        return float(pairs.sum()), float(pairs.mean())

    def is_secret(self, text: str) -> bool:
        """At least as likely to be random as the cutoff asks; a tie with it counts."""
        return self.score(text)[0] >= self.cutoff

    def histogram(self, strings: list[str]) -> np.ndarray:
        """Counts of the strings' ratios by bin."""
        scores = [self.score(s)[0] for s in strings]
        return np.histogram(np.clip(scores, RATIO_BINS[0], RATIO_BINS[-1]), RATIO_BINS)[0]

    def calibrated(self, random: np.ndarray, ordinary: np.ndarray) -> SecretModel:
        """With the cutoff for these held-out counts of ratios."""
        above = lambda counts: np.append(counts[::-1].cumsum()[::-1], 0)  # noqa: E731  strings at or above each bin edge
        cutoff = self.cutoff
        if ordinary.sum():
            fine = above(ordinary) <= FALSE_RATE * ordinary.sum()
            cutoff = max(cutoff, float(RATIO_BINS[np.argmax(fine)]))
        share = lambda counts: float(counts[RATIO_BINS[:-1] >= cutoff].sum() / counts.sum()) if counts.sum() else float("nan")
        return SecretModel(self.ratio, cutoff, share(random), share(ordinary))


def _pair_counts(strings: list[str]) -> np.ndarray:
    """Character pairs inside the strings; other characters part them."""
    size = len(_ALPHABET)
    codes = _CODE[np.frombuffer("\n".join(strings).encode("ascii", "replace"), np.uint8) & 127]
    both = (codes[:-1] >= 0) & (codes[1:] >= 0)
    return np.bincount(codes[:-1][both] * size + codes[1:][both], minlength=size * size).reshape(size, size).astype(float)


def random_strings(n: int, seed: int = 11) -> list[str]:
    """Seeded strings over the alphabets that keys use."""
    rng = np.random.default_rng(seed)
    alphabets = (_ALPHABET[:62], _ALPHABET, "0123456789abcdef", _ALPHABET[:26] + "0123456789", _ALPHABET[26:62])
    return ["".join(rng.choice(list(alphabets[k % len(alphabets)]), int(rng.integers(20, 48)))) for k in range(n)]


def plain_forms() -> list[str]:
    """Ordinary strings that are no words: numbers, dates, times, versions, rules of one character, the alphabet."""
    numbers = [str(k * 7919 + 13) * (1 + k % 3) for k in range(1, 1500)]
    dates = [f"20{y:02d}-{m:02d}-{d:02d}" + t for y in range(10, 30) for m in range(1, 13) for d in (3, 17, 28) for t in ("", "T00-00-00", "_12-30-45")]
    return numbers + dates + [c * 24 for c in "-_=+/"] * 40 + ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"] * 20


def train(random: list[str], ordinary: list[str]) -> SecretModel:
    """A model of the given samples; every fourth string is held out for the cutoff."""
    kept = lambda strings: [s for k, s in enumerate(strings) if k % 4]
    held = lambda strings: [s for s in strings[::4] if len(s) >= LEAST_LENGTH and not _OTHER.search(s)]
    model = _train(_pair_counts(kept(random)), _pair_counts(kept(ordinary)))
    return model.calibrated(model.histogram(held(random)), model.histogram(held(ordinary)))


def _train(random: np.ndarray, ordinary: np.ndarray) -> SecretModel:
    def model(counts):
        single = counts.sum(axis=0) + 1.0
        single /= single.sum()
        return np.log((counts + BACKOFF * single[None, :]) / (counts.sum(axis=1, keepdims=True) + BACKOFF))

    return SecretModel(model(random) - model(ordinary))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns, as (kind, start, end)."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def model_spans(text: str, base: list[tuple[str, int, int]], model: SecretModel) -> list[tuple[str, int, int]]:
    """Candidates outside the patterns' spans that the models call secret."""
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the furthest end among the spans so far
    found = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())  # spans that start before the candidate ends
        if (not before or reach[before - 1] <= m.start()) and model.is_secret(m.group()):
            found.append(("markov", m.start(), m.end()))
    return found


def pattern_values(text: Column) -> Column:
    """The strings that the patterns find anywhere in a text: an assignment's value, an access key, a hexadecimal string.
    A hexadecimal string that an assignment's value is or holds counts once."""
    java = lambda p, flags="": F.lit(flags + p.pattern)
    assigned = F.filter(F.regexp_extract_all(text, java(ASSIGN, "(?i)"), F.lit(2)), lambda v: F.length(v) >= ASSIGN_LEAST)
    rest = F.regexp_replace(text, F.lit("(?i)" + ASSIGN.pattern.replace("-]+)", f"-]{{{ASSIGN_LEAST},}})")), F.lit(" "))
    access = F.filter(F.regexp_extract_all(rest, java(ACCESS), F.lit(0)), lambda v: F.length(v) >= ACCESS_LEAST)
    return F.concat(assigned, access, F.regexp_extract_all(rest, java(HEX), F.lit(0)))


def _samples(words: list[str], values: list[str]) -> tuple[list[str], list[str]]:
    """Random and ordinary strings of one text."""
    random = [v for v in values if len(v) >= LEAST_LENGTH and any(c.isdigit() for c in v)]
    plain = []
    for word in words:
        if len(word) >= LEAST_LENGTH and base_spans(word):
            continue
        word = _OTHER.sub("", word)
        if len(word) > 1 and not _DIGIT.search(word):
            plain.append(word)
    names = []
    for k in range(0, len(plain) - 2, 3):  # words joined as in names: snake_case, camelCase, kebab-case, paths, CONSTANTS
        three = plain[k : k + 3]
        snake = "_".join(three)
        names += [snake.lower(), three[0].lower() + three[1].capitalize() + three[2].capitalize(), "-".join(three), "/".join(three), snake.upper(), snake.lower() + "_2024"]
    return random, plain + names


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_words: int = SAMPLE_WORDS) -> SecretModel:
    """Train on about ``sample_docs`` texts (at most twice as many): all values of the patterns in them, and ``sample_words``
    words spread over each; fewer or none leave the seeded strings and the smoothing to decide.

    Tasks count character pairs and ratios; only those tables of fixed size reach the driver."""
    words = F.split("text", "[\\x20\\x09-\\x0D]+")
    stride = lambda w: F.greatest(F.lit(1), F.ceil(F.size(w) / sample_words).cast("int"))
    chosen_of = lambda w, step: F.filter(w, lambda x, i: i % step == 0)
    spread = F.transform(F.array(F.struct(words.alias("w"), stride(words).alias("s"))), lambda v: chosen_of(v["w"], v["s"]))[0]  # split once a text
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 0, F.lit(False))
    sample = materialize(hash_sample(base, "id", sample_docs).where("text is not null").select(held.alias("held"), spread.alias("w"), pattern_values(F.col("text")).alias("v")))

    def counted(of):
        def run(batches):
            total = [0.0, 0.0]
            for batch in batches:
                for w, v in zip(batch.column("w").to_pylist(), batch.column("v").to_pylist(), strict=True):
                    total = [t + of(strings) for t, strings in zip(total, _samples(w, v), strict=True)]
            if not np.isscalar(total[0]):
                yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array([np.asarray(t, float).tobytes() for t in total], pa.binary())], names=["key", "sums"])

        return run

    def sums(rows: DataFrame, of, start: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        found = {r["key"]: np.frombuffer(r["sums"]) for r in tree_sums(rows.select("w", "v").mapInArrow(counted(of), "key int, sums binary"), "float64").collect()}
        return [own + found[k].reshape(own.shape) if k in found else own for k, own in enumerate(start)]

    seeded, forms = random_strings(RANDOM_STRINGS), plain_forms()
    kept = lambda strings: [s for k, s in enumerate(strings) if k % 4]
    model = _train(*sums(sample.where("not held"), _pair_counts, (_pair_counts(kept(seeded)), _pair_counts(kept(forms)))))
    long = lambda strings: [s for s in strings if len(s) >= LEAST_LENGTH and not _OTHER.search(s)]
    model = model.calibrated(*sums(sample.where("held"), lambda strings: model.histogram(long(strings)), (np.zeros(len(RATIO_BINS) - 1), model.histogram(long(forms[::4])).astype(float))))
    discard(sample)
    return model


def scan(docs: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: id, spans array<struct<kind, start, end>> by start, in code points, end exclusive.

    Null and empty texts have no spans; repeated rows, null ids and other columns do not matter; an empty table gives
    an empty result.  Texts are scanned whole, in time in proportion to their length; spans that start together are
    ordered by kind as listed.
    """
    model = model or fit(docs, id_col, text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                spans = ordered(spans + model_spans(text, spans, model))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, kind)], names=["id", "spans"])

    return base.mapInArrow(run, "id long, spans array<struct<kind:string,start:long,end:long>>")


def digest(scanned: DataFrame) -> DataFrame:
    """The registered query's columns from the operator's spans."""
    text_of = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:3]))
    return scanned.select("id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, model: SecretModel | None = None, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret in its text replaced by ``mask``; rows, other columns and null texts stay as they are.

    Overlapping spans are replaced by one mask."""
    model = model or fit(docs, id_col, text_col)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    spans = base_spans(text)
                    end, parts = 0, []
                    for _, a, b in ordered(spans + model_spans(text, spans, model)):
                        if a >= end:
                            parts += [text[end:a], mask]
                        end = max(end, b)
                    text = "".join(parts) + text[end:]
                out.append(text)
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(out, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)
