"""The prefix trie against plain dictionaries of tuples."""

import hashlib
import os
import random
import zlib
from collections import defaultdict

import pytest

from trajlake.llm import keyed, prefix_trie, running

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, id string, depth int, p1 int, content string, n_chars int, rank int"


def turn_key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def original(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, turn_key(role or "", text or ""), role or "", text or ""))
    return {c: [t[3:] for t in sorted(v)] for c, v in convs.items()}


def plain_rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)
    out = []
    sums = {}
    for n in sorted(members, key=len, reverse=True):
        own = (len(members[n]) - 1) * len(n[-1][1]) if n else 0
        sums[n] = (sum(sums[k][0] for k in children[n]) or 1, own + sum(sums[k][1] for k in children[n]))
    for n, who in members.items():
        sha = hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(children[n]), *sums[n], sha))
    return sorted(out, key=str)


def given(spark, rows):
    return spark.createDataFrame([(*r, "z", 1, 2, "c", 3, 4) for r in rows], SCHEMA).repartition(5)


def shown(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(7)
    rows = []
    for c in rng.sample(range(400), 120):
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice("ab") * rng.choice([1, 3])))
    convs = original(rows)
    assert shown(prefix_trie.prefix_trie(given(spark, rows))) == plain_trie(convs)
    assert shown(prefix_trie.rebuilt_trie(given(spark, rows))) == plain_trie(plain_rebuilt(convs))


def test_odd_rows(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, "", "é🙂"), (2, None, "user", "first"), (2, 0, "", ""), (3, 5, "user", "first"), (3, 5, "user", "first"), (None, 1, "user", "x"), (-7, 1, "a", "b"), (100, 1, "u", "x"), (101, 1, "u", "y"), (205, 1, "only", "turn"), (2**62, -3, "user", "first")]
    convs = original(rows)
    assert shown(prefix_trie.prefix_trie(given(spark, rows))) == plain_trie(convs)
    assert shown(prefix_trie.rebuilt_trie(given(spark, rows))) == plain_trie(plain_rebuilt(convs))
    assert prefix_trie.rebuilt_trie(given(spark, rows).limit(0)).collect() == []


def test_role_and_text_do_not_run_together(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "1:ab", ""), (4, 0, "", "1:ab")]
    assert shown(prefix_trie.prefix_trie(given(spark, rows))) == plain_trie(original(rows))


def test_hot_keys_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(keyed.is_hot, "__defaults__", (keyed.HOT_SHARE, 1))
    monkeypatch.setattr(keyed.attach, "__defaults__", (keyed.HOT_SHARE, 1, True))
    rows = [(c, t, "user", f"t{c % (t + 1)}") for c in range(60) for t in range(5)]
    assert shown(prefix_trie.rebuilt_trie(given(spark, rows))) == plain_trie(plain_rebuilt(original(rows)))


def test_one_very_long_conversation_and_many_copies(spark):
    long = [(1, t, "user", f"t{t % 7}") for t in range(700)]
    rows = long + [(2, t, "user", f"t{t % 7}") for t in range(650)] + [(c, 0, "user", "same") for c in range(1000, 1900)] + [(c, 1, "user", "end") for c in range(1000, 1300)]
    assert shown(prefix_trie.prefix_trie(given(spark, rows))) == plain_trie(original(rows))


def test_pieces_of_a_node_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 60)
    rows = [(c, 0, "user", "same") for c in range(95, 300)]
    ends = spark.createDataFrame([(1, 2, c) for c in range(95, 300)] + [(1, 3, 7), (-1, 2, 8)], "p1 long, p2 long, id long").repartition(4)
    found = {(r["p1"], r["p2"]): r["ends_sha256"] for r in prefix_trie._end_digests(ends).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert found == {(1, 2): sha(range(95, 300)), (1, 3): sha([7]), (-1, 2): sha([8])}
    assert shown(prefix_trie.prefix_trie(given(spark, rows))) == plain_trie(original(rows))


def test_ranks_and_xors_go_on_across_partitions(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice([None, *range(50)]), rng.getrandbits(62)) for g in [5] * 900 + [1, 2, 3] * 40]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = running.ranked(spark.createDataFrame(rows, "g long, o long, x long").repartition(7).selectExpr("*", "x AS y"), "g", ["o", "x"], ["y"]).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    by = defaultdict(list)
    for g, o, x in rows:
        by[g].append((o is not None, o or 0, x))
    want = []
    for g, members in by.items():
        total = 0
        for k, (there, o, x) in enumerate(sorted(members)):
            total ^= x
            want.append((g, o if there else None, x, total, k + 1))
    assert sorted(map(str, want)) == sorted(str((r["g"], r["o"], r["x"], r["y"], r["rank"])) for r in out)


def test_attach_gives_hot_and_other_keys_alike(spark):
    rows = spark.createDataFrame([(k,) for k in [1] * 50 + [None] * 30 + [2, 3]], "k long")
    found = rows.groupBy("k").count().selectExpr("k", "count AS n", "coalesce(k, -1) * 10 AS v")
    for share, least in ((1, 0), (3, 0), (10_000, 0), (10_000, 1), (10_000, 1000)):
        out = keyed.attach(rows, found, ["k"], "n", 82, share, least)
        assert sorted((r["k"] or -1, r["v"]) for r in out.collect()) == sorted([(1, 10)] * 50 + [(-1, -10)] * 30 + [(2, 20), (3, 30)])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_given_table(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    convs = original([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert shown(prefix_trie.rebuilt_trie(table)) == plain_trie(plain_rebuilt(convs))
