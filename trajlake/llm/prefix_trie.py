"""Prefix trie of conversations: what a shared beginning saves, for every beginning that occurs.

A node is a distinct sequence of first turns.  Its key is a digest: SHA-256 pieces of every turn's place, role and text,
combined by exclusive or along the conversation, so that the keys of all beginnings of one conversation, of any length,
come from one ordered pass, and a node's key and its parent's lie in the same row.  Nodes are groups of equal keys.

Leaves and savings of whole subtrees are rolled up by pointer jumping: a node knows its ancestor 1, 2, 4, ... steps
above; in the round of step s every node gets what the nodes exactly s below it have gathered, and then looks up its
ancestor's ancestor.  After as many rounds as the binary logarithm of the greatest depth, all sums are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from trajlake.llm.common import discard, materialize, scratch
from trajlake.llm.keyed import attach, is_hot
from trajlake.llm.running import ranked

#: Characters of joined ids that travel as one row.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def ranked_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, depth, content, n_chars): the turns of each conversation, numbered from 1.

    Turns come by number, null first; equal numbers by the digest of role and text.  Null roles and texts are empty.
    Rows without an id belong to no conversation and are left out."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    content = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).alias("turn"), content.alias("content"), F.length(text).cast("long").alias("n_chars"))
    return ranked(turns.where("id is not null"), "id", ["turn", "content"]).select("id", F.col("rank").alias("depth"), "content", "n_chars")


def rebuilt(turns: DataFrame, block: int = 100, shares: int = 6) -> tuple[DataFrame, DataFrame]:
    """Turns and ids (id) of conversations that take their first turns from another one.

    Conversation c begins with the first h = crc32(decimal c) mod ``shares`` turns of conversation c - c mod ``block``
    (fewer if that has fewer or does not exist) and goes on with its own turns after its first h."""
    sizes = materialize(turns.groupBy("id").agg(F.max("depth").alias("n")))
    h = F.pmod(F.crc32(F.col("id").cast("string")), F.lit(shares))
    ids = sizes.select("id", "n", h.alias("h"), (F.col("id") - F.col("id") % block).alias("base"))
    leads = sizes.select(F.col("id").alias("base"), F.col("n").alias("base_n"))  # at most ``block`` conversations ask for one
    ids = materialize(ids.join(leads, "base", "left").select("id", "n", "h", "base", F.least("h", F.coalesce("base_n", F.lit(0))).alias("lead")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    own = attach(turns, ids.select("id", "n", "h", "lead"), ["id"], "n", total).where("depth > h").select("id", (F.col("depth") - F.col("h") + F.col("lead")).alias("depth"), "content", "n_chars")
    starts = turns.where(F.col("depth") < shares).select(F.col("id").alias("base"), "depth", "content", "n_chars")
    lent = ids.where("lead > 0").select("id", "base", "lead").join(starts, "base").where("depth <= lead").select("id", "depth", "content", "n_chars")
    return own.unionByName(lent), ids.select("id")


def _lane(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, 15), 16, 10).cast("long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of each node (rows come by node and id) joined to pieces of bounded length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        p1, p2, ids = (np.asarray(batch.column(c)) for c in ("p1", "p2", "id"))
        texts = batch.column("id").cast(pa.string()).to_pylist()
        cuts = np.flatnonzero((p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])) + 1
        begins, ends = [], []
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True):
            begins += range(start, stop, PIECE // 20)  # a long has at most 20 characters
            ends += [*range(start + PIECE // 20, stop, PIECE // 20), stop]
        yield pa.RecordBatch.from_arrays([pa.array(p1[begins]), pa.array(p2[begins]), pa.array(ids[begins]), pa.array([",".join(texts[a:b]) for a, b in zip(begins, ends, strict=True)])], names=["p1", "p2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces in order, fed one after the other."""
    now, state = None, None
    for batch in batches:
        keys, sums = [], []
        for *key, ids in zip(*[batch.column(c).to_pylist() for c in ("p1", "p2", "ids")], strict=True):
            if key != now:
                if now is not None:
                    keys.append(now)
                    sums.append(state.hexdigest())
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(sums)], names=["p1", "p2", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([state.hexdigest()])], names=["p1", "p2", "ends_sha256"])


def _end_digests(ends: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256) of the conversations (p1, p2, id) that end in a node, by rising id.

    A node of very many ends lies in many ranges; what meets in one task is a row for each piece of them."""
    pieces = ends.repartitionByRange("p1", "p2", "id").sortWithinPartitions("p1", "p2", "id").mapInArrow(_joined, "p1 long, p2 long, first long, ids string")
    return pieces.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").drop("first").mapInArrow(_hashed, "p1 long, p2 long, ends_sha256 string")


def roll_up(nodes: DataFrame) -> DataFrame:
    """(p1, p2, n_leaves, saved_tokens) of nodes (p1, p2, depth, q1, q2, leaf, saved; the root has depth 0 and key 0, 0):
    sums of ``leaf`` and ``saved`` over each subtree.

    Every round is a grouped sum, a join of unique keys, and a look-up of the ancestors' ancestors in which those that
    very many nodes share are broadcast.  A round's table is written and its predecessor deleted."""
    state = nodes.select("p1", "p2", "depth", F.col("q1").alias("a1"), F.col("q2").alias("a2"), F.col("leaf").alias("leaves"), "saved")
    deepest, total = nodes.agg(F.max("depth"), F.count("*")).first()
    step, last = 1, None
    while step <= (deepest or 0):
        gathered = state.where(F.col("depth") >= step).groupBy("a1", "a2").agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"), F.count("*").alias("_asked"))
        gathered = gathered.withColumnsRenamed({"a1": "p1", "a2": "p2"})
        grown = state.join(gathered, ["p1", "p2"], "left").select(
            "p1", "p2", "depth", "a1", "a2", (F.col("leaves") + F.coalesce("_leaves", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("_saved", F.lit(0))).alias("saved"), F.coalesce("_asked", F.lit(0)).alias("asked")
        )
        seen = Observation()
        grown = materialize(grown, seen, F.count_if(is_hot("asked", total)).alias("hot"))
        if last is not None:
            discard(last)
        last, step = grown, 2 * step
        keep = grown.drop("asked")
        none = F.lit(None).cast("long")
        near = keep.where(F.col("depth") < step).withColumns({"a1": none, "a2": none})
        at_root = keep.where(F.col("depth") == step).withColumns({"a1": F.lit(0).cast("long"), "a2": F.lit(0).cast("long")})
        above = grown.where("asked > 0").select(F.col("p1").alias("a1"), F.col("p2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"), "asked")
        far = attach(keep.where(F.col("depth") > step), above, ["a1", "a2"], "asked", total, some_hot=seen.get.get("hot", 1) > 0).drop("a1", "a2").withColumnsRenamed({"b1": "a1", "b2": "a2"})
        state = near.unionByName(at_root).unionByName(far)
    return state.select("p1", "p2", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"))


def trie(turns: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The nodes of conversations given as turns (id, depth from 1 without gaps, content, n_chars).

    ``ids`` (id, unique): all conversations, of which some may have no turn; without it, those that have turns.  Columns:
    conv_id (smallest member), depth, parent_conv_id (the root's is null), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  No conversation, no node."""
    digest = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.hex("content")), 256)
    bound = turns.withColumn("_d", digest).select("id", "depth", "n_chars", _lane(F.col("_d"), 1).alias("e1"), _lane(F.col("_d"), 16).alias("e2"), _lane(F.col("_d"), 1).alias("p1"), _lane(F.col("_d"), 16).alias("p2"))
    with scratch() as kept:
        paths = ranked(bound, "id", ["depth"], ["p1", "p2"])
        last = paths.groupBy("id").agg(F.max(F.struct("depth", "p1", "p2")).alias("last")).select("id", "last.p1", "last.p2")
        zero = F.lit(0).cast("long")
        ends = materialize(last if ids is None else ids.join(last, "id", "left").select("id", F.coalesce("p1", zero).alias("p1"), F.coalesce("p2", zero).alias("p2")))
        top = ends.agg(F.min("id").alias("conv_id"), F.count("*").alias("n_convs")).first()
        upper = [F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("e2")).alias("q2")]
        nodes = paths.select("id", "depth", "n_chars", "p1", "p2", *upper).groupBy("p1", "p2", "depth").agg(F.min("id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
        root = ends.sparkSession.createDataFrame([(0, 0, 0, top["conv_id"], top["n_convs"], 0)] if top["n_convs"] else [], "p1 long, p2 long, depth long, conv_id long, n_convs long, n_chars long")
        nodes = materialize(nodes.unionByName(root.withColumns({"q1": F.lit(None).cast("long"), "q2": F.lit(None).cast("long")})))
        children = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
        nodes = materialize(nodes.join(children, ["p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
        saved = (F.col("n_convs") - 1) * F.col("n_chars")
        sums = roll_up(nodes.select("p1", "p2", "depth", "q1", "q2", (F.col("n_children") == 0).cast("long").alias("leaf"), saved.alias("saved")))
        parents = nodes.where("n_children > 0 AND depth > 0").select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
        deep = attach(nodes.where("depth > 1").withColumnRenamed("n_children", "own_children"), parents, ["q1", "q2"], "n_children", nodes.count()).withColumnRenamed("own_children", "n_children")
        shallow = nodes.where("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(top["conv_id"]).cast("long")))
        named = deep.unionByName(shallow).join(sums, ["p1", "p2"]).join(_end_digests(ends), ["p1", "p2"], "left")
        out = materialize(named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")))
        kept.append(out)
    return out


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The prefix trie of a table of turns, as ``trie`` returns it.

    Turns are ordered by number, null first, equal ones by the digest of role and text; null roles and texts are empty;
    repeated rows are turns of their own.  Conversations and turns may be of any length: a conversation's turns are dealt
    over tasks, texts are read once for their digest and length.  Rows without an id are left out, other columns are
    ignored whatever their names, an empty table gives an empty result."""
    return trie(ranked_turns(conversations, id_col, turn_col, role_col, text_col))


def rebuilt_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """As ``prefix_trie``, of the conversations that ``rebuilt`` makes; those left without a turn are members of the root."""
    with scratch() as kept:
        out = trie(*rebuilt(ranked_turns(conversations, id_col, turn_col, role_col, text_col)))
        kept.append(out)
    return out
