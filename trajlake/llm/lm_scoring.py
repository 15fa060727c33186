"""Language-model scores from a weighted backoff automaton over smoothed n-grams of orders one to three.

The states are the root, which has no history, every word (and the start of a text) and every bigram that occurs in the
training texts.  With c for training counts and h' for a history without its first word, the model is hierarchical with
Dirichlet smoothing, P(w | h) = (c(h w) + B P(w | h')) / (c(h) + B), and as an automaton:

* the root has an arc for every word, weighing log10 of its add-one probability (unknown words share one);
* a state h has an arc for every h w that occurs, weighing log10 P(w | h), which leads to the longest end of h w that is
  a state;
* a state's failure arc leads to the state of the next shorter history and weighs log10(B / (c(h) + B)).

A text is traversed once from left to right: the walk carries a state, takes failure arcs until there is an arc for the
next word, takes that and adds up the weights.  All texts of a block walk side by side.  A long text walks in several
lanes; a lane reads the two words before its own first, after which it is in the state that the whole walk would be in.

The automaton grows with the corpus, so no task ever holds it.  Texts become blocks of tokens, written once.  Every
block sends its distinct words, bigrams and trigrams, with its training counts, to the shards that own them by hash; a
shard adds up the counts of all blocks and returns to each block what it asked for.  So a block gets exactly the part of
the automaton that its texts can reach, a frequent history is spread over all shards, and an n-gram is asked for once a
block.  The number of shards follows the number of tokens.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trajlake.llm.common import crc_mod, free_shuffles, materialize
from trajlake.llm.textops import as_strings, blocks, hashes, mix, spans

U64 = np.uint64
END, START = U64(0x5E17D4A1C3B29F07), U64(0x1C0FFEE5D15EA5E1)
ODD = U64(0x9E3779B97F4A7C15)
#: Weight of the shorter history's probability against the counts of a history, for bigrams and trigrams; chosen by the score of
#: held-out texts of sf0.1, log10 a token: -3.43, with (5, 5) -3.81, with absolute discounts -3.69, with words alone -4.19.
CONCENTRATION = (400.0, 20.0)
#: Bits that tell a shard's n-grams apart; the bits above them choose the shard.
NAME_BITS = 40
#: Bytes of text that make one block, about (a longer text is one block), and tokens that make one shard.
BLOCK_BYTES = 6 << 20
SHARD_TOKENS = 500_000
#: Rows of texts, and blocks, that a Python worker gets at once.
TEXT_BATCH, BLOCK_BATCH = 500, 1
#: Tokens of a lane of the walk.
LANE = 512


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


BLOCK = "block long, n_texts long, n_tokens long, n_words long, ids binary, no_id binary, trains binary, lengths binary, words binary, word_counts binary, bytes0 binary, bytes1 binary, bytes2 binary, bytes3 binary"
_BLOCK = [(n, pa.binary() if t == "binary" else pa.int64()) for n, t in (c.split() for c in BLOCK.split(", "))]


def _tokenise(batches):
    """Blocks: the rows' ids and lengths, the distinct word hashes with their training counts, and tokens as their indices."""
    block, held, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        texts = as_strings(batch.column("text"))
        held.append((batch.column("id"), batch.column("trains").to_numpy(zero_copy_only=False), *_tokens(texts)))
        size += texts.nbytes
        if size >= BLOCK_BYTES:
            yield _block(held, block)
            block, held, size = block + 1, [], 0
    if size or held:
        yield _block(held, block)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text's end included, and the tokens of each text; a megabyte at a time."""
    found, lengths = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for _, raw, offsets in blocks(texts):
        starts, ends, at = spans(raw, offsets)
        n = np.diff(at) + 1
        tokens = np.full(len(starts) + len(n), END, U64)
        inside = np.ones(len(tokens), bool)
        inside[np.cumsum(n) - 1] = False
        tokens[inside] = hashes(raw, starts, ends)
        found.append(tokens)
        lengths.append(n)
    return np.concatenate(found), np.concatenate(lengths)


def _block(held: list[tuple], block: int) -> pa.RecordBatch:
    ids = pa.concat_arrays([h[0] for h in held])
    trains, tokens, lengths = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
    places, found = pd.factorize(np.append(tokens, START))
    order = np.argsort(-np.bincount(places), kind="stable")  # frequent words get small numbers, whose bytes pack well
    rank = np.empty(len(found), np.uint32)
    rank[order] = np.arange(len(found), dtype=np.uint32)
    words, index = found[order], rank[places[:-1]]
    counts = np.bincount(index, np.repeat(trains, lengths), len(words)).astype(np.int64)
    counts[words == START] = trains.sum()
    planes = index.view(np.uint8).reshape(-1, 4).T
    parts = [ids.fill_null(0).to_numpy().astype(np.int64), np.asarray(ids.is_null()), trains.astype(bool), lengths, words, counts, *planes]
    return _batch([(block, len(ids), len(index), len(words), *[p.tobytes() for p in parts])], _BLOCK)


class Block:
    """Tokens of a block, its distinct bigrams, and what it asks the shards for."""

    def __init__(self, row):
        read = lambda name, kind: np.frombuffer(row[name], kind)
        self.words = read("words", U64)
        self.token = np.stack([read(f"bytes{k}", np.uint8) for k in range(4)], axis=1).view(np.uint32)[:, 0].astype(np.int64)
        self.lengths = read("lengths", np.int64)
        self.trains = np.repeat(read("trains", bool), self.lengths).astype(np.float64)
        self.begin = np.cumsum(self.lengths) - self.lengths
        self.start = int(np.flatnonzero(self.words == START)[0])
        history = np.empty_like(self.token)
        history[1:] = self.token[:-1]
        history[self.begin] = self.start
        codes, self.pair = np.unique(history * len(self.words) + self.token, return_inverse=True)
        self.history, self.word = codes // len(self.words), codes % len(self.words)

    def bigrams(self) -> tuple[np.ndarray, np.ndarray]:
        """Names and training counts of the distinct bigrams."""
        names = mix(self.words[self.history] * ODD + self.words[self.word])
        return names, np.bincount(self.pair, self.trains, len(self.word))

    def trigrams(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names and training counts of the distinct trigrams; ``names``: of the bigrams.  A trigram is its first bigram
        (``context``), its last word (``third``) and its last bigram (``second``)."""
        inner = np.ones(len(self.token), bool)
        inner[self.begin] = False
        at = np.flatnonzero(inner)
        size = len(self.words)
        codes, index = np.unique(self.pair[at - 1] * size + self.token[at], return_inverse=True)
        self.context, self.third = codes // size, codes % size
        self.second = np.zeros(len(codes), np.int64)
        self.second[index] = self.pair[at]
        return mix(names[self.context] * ODD + self.words[self.third]), np.bincount(index, self.trains[at], len(codes))


def gram_order(names: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block asks for its n-grams, by shard, and their shards in that order."""
    shard = (names >> U64(NAME_BITS)) % U64(shards)
    shard = shard.astype(np.uint16 if shards <= 1 << 16 else np.int64)  # small numbers are sorted by radix
    order = np.argsort(shard, kind="stable")
    return order, shard[order].astype(np.int64)


def gram_requests(block: int, names: np.ndarray, counts: np.ndarray, shards: int) -> list[tuple]:
    order, shard = gram_order(names, shards)
    keys, counts = names[order] & U64((1 << NAME_BITS) - 1), counts[order].astype(np.uint32)
    low, high = keys.astype(np.uint32), (keys >> U64(32)).astype(np.uint8)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1)) if len(shard) else np.zeros(1, int)
    return [(int(shard[a]), block, low[a:b].tobytes(), high[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def gram_counts(names: np.ndarray, shards: int, rows: pd.DataFrame) -> np.ndarray:
    """The corpus' counts of a block's n-grams from the shards' answers."""
    out = np.empty(len(names), np.int64)
    out[gram_order(names, shards)[0]] = np.concatenate([np.zeros(0, np.int64), *[unpacked(b) for b in rows.sort_values("shard")["counts"]]])
    return out


REQUEST = "shard int, block long, low binary, high binary, counts binary"
_REQUEST = [("shard", pa.int32()), ("block", pa.int64()), *[(n, pa.binary()) for n in ("low", "high", "counts")]]
ANSWER = "block long, shard int, counts binary"


def _word_requests(shards: int):
    def run(batches):
        for batch in batches:
            for block, words, counts in zip(*[batch.column(n).to_pylist() for n in ("block", "words", "word_counts")], strict=True):
                order, cuts = word_order(np.frombuffer(words, U64), shards)
                words, counts = np.frombuffer(words, U64)[order], np.frombuffer(counts, np.int64)[order]
                rows = [(k, block, words[a:b].tobytes(), counts[a:b].tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
                yield _batch(rows, [("shard", pa.int32()), ("block", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])

    return run


def word_order(words: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block asks for its words, and where each shard's begin."""
    shard = (mix(words) % U64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1))


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts in sum (exact below 2 ** 53), and for each key the sum."""
    distinct, inverse = np.unique(keys, return_inverse=True)
    total = np.bincount(inverse, counts, len(distinct)).astype(np.int64)
    return distinct, total, total[inverse]


def _word_answers(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks for every block's words; the row of block -1 has the shard's tokens and distinct words."""
    words = [np.frombuffer(b, U64) for b in group["words"]]
    distinct, total, answer = _sums(np.concatenate(words), np.concatenate([np.frombuffer(b, np.int64) for b in group["counts"]]))
    token = distinct != START
    shard = int(group["shard"].iloc[0])
    parts = np.split(answer, np.cumsum([len(w) for w in words])[:-1])
    out = [(int(b), shard, packed(a), 0, 0) for b, a in zip(group["block"], parts, strict=True)]
    out.append((-1, shard, b"", int(total[token].sum()), int((total[token] > 0).sum())))
    return pd.DataFrame(out, columns=["block", "shard", "counts", "n", "v"])


def _gram_answers(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all blocks for every block's n-grams."""
    low = [np.frombuffer(b, np.uint32) for b in group["low"]]
    keys = np.concatenate(low).astype(U64)
    keys |= np.concatenate([np.frombuffer(b, np.uint8) for b in group["high"]]).astype(U64) << U64(32)
    answer = _sums(keys, np.concatenate([np.frombuffer(b, np.uint32) for b in group["counts"]]))[2]
    parts = np.split(answer, np.cumsum([len(x) for x in low])[:-1])
    return pd.DataFrame({"block": group["block"], "shard": group["shard"], "counts": [packed(a) for a in parts]})


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes that hold them, behind one byte that says how many each takes."""
    width = next(w for w in (1, 2, 4, 8) if not len(counts) or int(counts.max()) < 1 << (8 * w - (w == 8)))
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class Automaton:
    """The part of the model that a block's texts can reach, in arrays.

    State 0 is the root, 1 + w that of the word w, 1 + len(words) + g that of the bigram g."""

    def __init__(self, block: Block, counts: np.ndarray, together: np.ndarray, joint: np.ndarray, n_tokens: int, vocabulary: int, weights: tuple[float, float] = CONCENTRATION):
        """``counts`` of words, ``together`` of bigrams and ``joint`` of trigrams are the corpus' own."""
        size, pairs = len(block.words), len(block.word)
        self.size = size
        b2, b3 = weights
        self.root = (counts + 1.0) / (n_tokens + vocabulary + 1.0)
        history = counts[block.history]
        p2 = (together + b2 * self.root[block.word]) / (history + b2)
        p3 = (joint + b3 * p2[block.second]) / (together[block.context] + b3)
        word_state = np.where((counts > 0) & (block.words != END), np.arange(size) + 1, 0)  # nothing follows the end
        pair_state = np.where((together > 0) & (word_state[block.word] > 0), 1 + size + np.arange(pairs), word_state[block.word])
        two, three = np.flatnonzero(together > 0), np.flatnonzero(joint > 0)
        keys = np.concatenate([(1 + block.history[two]) * size + block.word[two], (1 + size + block.context[three]) * size + block.third[three]])  # in order
        self.keys = np.append(keys, -1)
        self.weight = np.append(np.log10(np.concatenate([p2[two], p3[three]])), 0.0)
        self.next = np.append(np.concatenate([pair_state[two], pair_state[block.second[three]]]), 0)
        self.root_weight, self.root_next = np.log10(self.root), word_state
        self.fail_weight = np.log10(np.concatenate([[1.0], b2 / (counts + b2), b3 / (together + b3)]))
        self.fail_to = np.concatenate([np.zeros(1 + size, np.int64), word_state[block.word]])
        self.first = int(word_state[block.start])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading ``word`` in ``state``, and the states it leads to."""
        state, weight, after = state.copy(), np.zeros(len(state)), np.zeros(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            rooted = state[todo] == 0
            done = todo[rooted]
            weight[done] += self.root_weight[word[done]]
            after[done] = self.root_next[word[done]]
            todo = todo[~rooted]
            key = state[todo] * self.size + word[todo]
            at = np.searchsorted(self.keys[:-1], key)
            hit = self.keys[at] == key
            done, arc = todo[hit], at[hit]
            weight[done] += self.weight[arc]
            after[done] = self.next[arc]
            todo = todo[~hit]
            weight[todo] += self.fail_weight[state[todo]]
            state[todo] = self.fail_to[state[todo]]
        return weight, after

    def walk(self, tokens: np.ndarray, lengths: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The weight of every token; texts of ``lengths`` lie one behind the other in ``tokens``."""
        per = -(-lengths // lane)
        text = np.repeat(np.arange(len(lengths)), per)
        number = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        begin = (np.cumsum(lengths) - lengths)[text] + number * lane
        size = np.minimum(lane, lengths[text] - number * lane)
        run_in = np.where(number > 0, 2, 0)
        begin, size = begin - run_in, size + run_in
        order = np.argsort(-size, kind="stable")
        begin, size, run_in = begin[order], size[order], run_in[order]
        state = np.where(run_in > 0, 0, self.first)
        out = np.zeros(len(tokens))
        active = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")  # lanes longer than each step
        for k, n in enumerate(active.tolist()):
            place = begin[:n] + k
            weight, state[:n] = self.step(state[:n], tokens[place])
            own = k >= run_in[:n]
            out[place[own]] = weight[own]
        return out


def _gram_requests(shards: int, order: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                names, counts = block.bigrams()
                if order == 3:
                    names, counts = block.trigrams(names)
                rows = gram_requests(row["block"], names, counts, shards)
                for a in range(0, len(rows), 256):
                    yield _batch(rows[a : a + 256], _REQUEST)

    return run


SCORES = "id long, trains boolean, n_tokens long, n_known long, base_score double, score double"


def _traverse(word_shards: int, shards: int, n_tokens: int, vocabulary: int):
    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})]
        for _, row in rows.iterrows():
            block = Block(row)
            of = lambda kind: answers[answers["kind"] == kind]
            counts = np.empty(len(block.words), np.int64)
            counts[word_order(block.words, word_shards)[0]] = np.concatenate([unpacked(b) for b in of(1).sort_values("shard")["counts"]])
            names, _ = block.bigrams()
            together = gram_counts(names, shards, of(2))
            joint = gram_counts(block.trigrams(names)[0], shards, of(3))
            model = Automaton(block, counts, together, joint, n_tokens, vocabulary)
            weights = model.walk(block.token, block.lengths)
            add = lambda x: np.add.reduceat(x, block.begin)  # noqa: E731, B023
            ids = pd.array(np.frombuffer(row["ids"], np.int64), "Int64")
            ids[np.frombuffer(row["no_id"], bool)] = pd.NA
            known = (counts[block.token] > 0).astype(np.int64)
            out.append(pd.DataFrame({"id": ids, "trains": np.frombuffer(row["trains"], bool), "n_tokens": block.lengths, "n_known": add(known), "base_score": add(model.root_weight[block.token]), "score": add(weights)}))
        return pd.concat(out[1:], ignore_index=True) if len(out) > 1 else out[0]

    return run


def score_documents(docs: DataFrame, trains: Column, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """(id, trains, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    ``trains``: true for the rows to learn from (null: false).  Null and empty texts have the end as their one token.
    Texts of any length are scored whole (one text is never split over blocks).  Repeated rows are texts of their own;
    null ids give a row each; an empty table gives an empty result; other columns are ignored.  With no training rows
    every token is unknown.  The rows may come in any partitioning: they are read once.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.coalesce(trains, F.lit(False)).alias("trains"))
    seen = Observation()
    source = materialize(base.mapInArrow(_tokenise, BLOCK), seen, F.sum("n_tokens").alias("tokens"), F.sum("n_words").alias("words"), batch_rows=TEXT_BATCH, compression="zstd")
    shards_for = lambda n: max(1, -(-int(n or 0) // shard_tokens))
    shards, word_shards = shards_for(seen.get.get("tokens")), shards_for(seen.get.get("words"))
    asked = source.select("block", "words", "word_counts").mapInArrow(_word_requests(word_shards), "shard int, block long, words binary, counts binary")
    words = materialize(asked.groupBy("shard").applyInPandas(_word_answers, f"{ANSWER}, n long, v long"), batch_rows=BLOCK_BATCH, compression="zstd")
    free_shuffles(spark)
    totals = words.where("block = -1").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = int(totals["n"] or 0), int(totals["v"] or 0)
    answers = words.where("block >= 0").select(F.col("block").alias("of_block"), "shard", F.lit(1).alias("kind"), "counts")
    columns = source.select("block", "lengths", "trains", "words", *[f"bytes{k}" for k in range(4)])
    for order in (2, 3):
        found = materialize(columns.mapInArrow(_gram_requests(shards, order), REQUEST).groupBy("shard").applyInPandas(_gram_answers, ANSWER), batch_rows=BLOCK_BATCH, compression="zstd")
        free_shuffles(spark)
        answers = answers.unionByName(found.select(F.col("block").alias("of_block"), "shard", F.lit(order).alias("kind"), "counts"))
    scored = source.drop("word_counts").groupBy("block").cogroup(answers.groupBy("of_block")).applyInPandas(_traverse(word_shards, shards, n, v), SCORES)
    return scored.withColumn("train_tokens", F.lit(n).cast("long"))


def training_rows(id_col: str = "doc_id") -> Column:
    """Rows to learn from: crc32(doc_id as text) mod 7 is not 2."""
    return crc_mod(id_col, 7) != 2
