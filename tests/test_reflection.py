"""Reflection loops, judges and analyses by scripted providers, against plain loops."""

import json
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from trajlake.functions import text
from trajlake.operators import inject, reflection, reports

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests


class Halving:
    """Halves the reply while it is longer than its target (the number it begins with); logs each question."""

    def __init__(self, log):
        self.log = log

    def open(self):
        pass

    @staticmethod
    def better(reply):
        target = int(reply.split()[0]) if reply.split() and reply.split()[0].isdigit() else None
        words = reply.split()
        return None if target is None or len(words) <= target else " ".join(words[: max(target, len(words) // 2)])

    def answer(self, prompts):
        out = []
        for p in prompts:
            reply = p.split("Reply: ", 1)[1]
            with open(self.log, "a") as f:
                f.write(reply[:6].split()[0] + "\n" if reply.strip() else "empty\n")
            out.append("no idea" if reply.startswith("stuck") else json.dumps({"improved_response": self.better(reply)}))
        return out


def plain(reply, most):
    iterations = asked = 0
    faults = lambda r: len(r) > 300 or sum(bool(s.strip()) for s in r.split(".")) > 5 or not r.strip()
    for turn in range(1, most + 1):
        asked += 1
        wrong = faults(reply)
        better = None if reply.startswith("stuck") else Halving.better(reply)
        if better and better != reply:
            reply, iterations = better, turn
        elif not wrong:
            break
    return reply, iterations, not faults(reply), asked


def test_reflection_equals_a_plain_loop_and_asks_no_row_too_often(spark, tmp_path):
    replies = ["fine", "5 " + "w " * 7, "3 " + "word " * 100, "2 " + "w " * 300, "stuck " + "x" * 400, "stuck but fine", "", "9 a. b. c. d. e. f. g", "1 " + "w " * 5000]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(replies)], "k int, reply string").repartition(3)
    log = tmp_path / "asked"
    out = {r["k"]: (r["reply"], r["iterations"], r["valid"]) for r in reflection.reflected(rows, "reply", Halving(str(log)), most=4).collect()}
    want = [plain(r, 4) for r in replies]
    assert [out[k] for k in range(len(replies))] == [w[:3] for w in want]
    assert len(log.read_text().split()) == sum(w[3] for w in want)


class Scripted:
    def open(self):
        pass

    def answer(self, prompts):
        out = []
        for p in prompts:
            if "Does the agent convey" in p:
                item = p.split("Information: ")[1].split("\n")[0]
                out.append(None if item == "lost" else json.dumps({"conveyed": item.startswith("implied")}))
            elif "Reword the response" in p:
                response = p.split("Response: ")[1].split("\nAfter: ")[0]
                out.append(json.dumps({"fixed_response": response.replace("Sorry. ", "").replace("get", "got") + ("" if "Before: user: hi" in p else "?")}))
            else:
                out.append("" if "mute" in p else ("## Error Analysis\nown" if "an error" in p or " error " in p.split("\n")[0] else "body"))
        return out


def test_information_is_found_word_for_word_or_asked(spark):
    rows = spark.createDataFrame([(1, "It costs 5 EUR", ["costs 5 eur", "implied a", "other", "lost"]), (2, "x", []), (3, None, ["implied"])], "k int, transcript string, items array<string>")
    out = {r["k"]: (r["told"], r["share"]) for r in reflection.information_told(rows, "k", "transcript", "items", Scripted(), 1).collect()}
    assert out == {1: ([True, True, False, False], 0.5), 2: ([], 1.0), 3: ([True], 1.0)}


def test_continuity_keeps_calls(spark):
    call = text.render_tool_call
    messages = [(1, 0, "user", "hi"), (1, 1, "assistant", "wrong"), (1, 2, "user", "no!"), (1, 3, "assistant", "Sorry. Done"), (1, 4, "user", "thanks")]
    messages += [(2, 0, "system", "s"), (2, 1, "assistant", "bad"), (2, 2, "assistant", '<tool_call>{"name": "get", "arguments": {}}</tool_call>')]
    rows = spark.createDataFrame(messages, "traj_id int, idx int, role string, content string")
    segments = spark.createDataFrame([(1, 1, 3, None), (2, 1, 2, None)], "traj_id int, start_idx int, fix_idx int, corrected string")
    fixed = reflection.continued(rows, segments, Scripted())
    got = {r["traj_id"]: r["corrected"] for r in fixed.collect()}
    assert got == {1: "Done", 2: messages[-1][3]} and call is not None
    pruned = inject.prune_segments(rows, fixed).where("traj_id = 1").orderBy("idx").collect()
    assert [r["content"] for r in pruned] == ["hi", "Done", "thanks"]


def test_three_kinds_of_analysis(spark):
    attempts = spark.createDataFrame([("a", 1, 0.0, "t1"), ("a", 2, 1.0, "t2"), ("a", 3, 1.0, "t3"), ("b", 1, None, "t4"), ("c", 1, 1.0, "mute")], "task_id string, attempt int, reward double, transcript string")
    out = reflection.attempt_analyses(attempts, Scripted(), 1).collect()
    assert sorted((r["kind"], r["task_id"], r["attempt"]) for r in out) == [("contrast", "a", 1), ("error", "a", 1), ("error", "b", 1), ("success", "a", 2), ("success", "a", 3)]
    for r in out:
        assert r["messages"][1]["content"].count(reflection.HEADINGS[r["kind"]]) == 1
    contrast = next(r for r in out if r["kind"] == "contrast")["messages"][0]["content"]
    assert "Failed:\nt1" in contrast and "Solved:\nt2" in contrast


def test_a_broken_injection_is_rejected(spark):
    good = '<tool_call>{"name": "get", "arguments": {"a": 1}}</tool_call>'
    messages = [(t, k, role, c) for t in (1, 2, 3) for k, (role, c) in enumerate([("system", "s"), ("user", "u"), ("assistant", good), ("tool", '{"name": "get", "result": "r"}'), ("assistant", "bye")])]
    rows = spark.createDataFrame(messages, "traj_id int, idx int, role string, content string")
    error = '{"name": "get", "result": "Error: no"}'
    injected = spark.createDataFrame([(1, 2, good, error, good), (2, 2, "<tool_call>{broken</tool_call>", error, good)], "traj_id int, idx int, wrong string, error string, recovery string")
    kept, rejected = inject.splice_checked(rows, injected)
    assert {(r["traj_id"], r["n"]) for r in kept.groupBy("traj_id").agg(F.count("*").alias("n")).collect()} == {(1, 7), (3, 5)}
    assert [tuple(r) for r in rejected.collect()] == [(2, "bad tool call")]


def test_iterations_as_a_table(spark):
    records = spark.createDataFrame([(1, [2, 1, 3]), (2, []), (3, None)], "k int, iterations_used array<int>")
    assert [tuple(r) for r in reports.correction_iterations(records, "k").orderBy("place").collect()] == [(1, 0, 2), (1, 1, 1), (1, 2, 3)]
