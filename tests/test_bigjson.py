"""Large JSON files in ranges of a few hundred bytes against Python's parser."""

import json
import random

import pytest

from trajlake.sources import bigjson, readers

NASTY = ['a{b}c', '}}}}', '"quoted" {', "back\\slash\\", '\\"}', '[{"x":1},{"y":[2]}]', "é🙂 {", "", "line\nbreak,}", '\\\\"', "," * 9, "{" * 30, "u\u0007"]


@pytest.fixture(params=[150, 1 << 20])
def small_ranges(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def body(seed):
    rng = random.Random(seed)
    value = lambda depth: rng.choice([rng.choice(NASTY), rng.random(), None, True] if depth > 3 else [rng.choice(NASTY), [value(depth + 1) for _ in range(rng.randrange(4))], {rng.choice(NASTY) + str(k): value(depth + 1) for k in range(rng.randrange(4))}])
    return {
        "version": 3, "note": 'has "quotes", {braces}\\', "info": {"agent": {"llm": "m}"}, "list": [1, [2, 3]]}, "tasks": [{"id": str(k), "v": value(0)} for k in range(rng.randrange(12))],
        "flag": None, "empty": [], "none": {}, "sim\"ulations": [{"n": k, "v": value(0)} if k % 7 else k for k in range(25)], "last": -1.5e3,
    }


@pytest.mark.parametrize("indent", [None, 1])
def test_object_files_in_any_ranges(spark, tmp_path, small_ranges, indent):
    for seed in range(2):
        (tmp_path / f"f{seed}.json").write_text(json.dumps(body(seed), indent=indent, ensure_ascii=bool(seed % 2)) + "\n" * seed)
    split = bigjson.SplitJson(spark, f"{tmp_path}/*.json")
    got = split.elements.collect()
    values = {(r["file"][-7:], r["key"]): r["value"] for r in split.values.collect()}
    split.close()
    for seed in range(2):
        want, name = body(seed), f"f{seed}.json"
        for key, member in want.items():
            own = sorted((r["position"], r["text"]) for r in got if r["file"].endswith(name) and r["key"] == key)
            assert [p for p, _ in own] == list(range(len(own)))
            if isinstance(member, list):
                assert [json.loads(t) for _, t in own] == member
            elif isinstance(member, dict):
                assert json.loads("{" + ",".join(t for _, t in own) + "}") == member
            else:
                assert own == [] and (values[name, key] is None if member is None else json.loads(values[name, key]) == member if not isinstance(member, str) else values[name, key] == member)
    assert {r["kind"] for r in got if r["key"] == "info"} == {"{"}


def test_array_files(spark, tmp_path, small_ranges):
    want = [{"id": k, "text": NASTY[k % len(NASTY)], "more": [NASTY, {"a": [1, {"b": 2}]}]} for k in range(16)]
    (tmp_path / "tasks.json").write_text("\n " + json.dumps(want))
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "blank.json").write_text("  \n")
    got = bigjson.SplitJson(spark, str(tmp_path)).elements.orderBy("position").collect()
    assert [json.loads(r["text"]) for r in got] == want
    assert [r["position"] for r in got] == list(range(16))


def test_results_equal_the_whole_file_reader(spark, tmp_path, small_ranges):
    folder = tmp_path / "model_a"
    folder.mkdir()
    for name, n in (("run_retail_1", 9), ("run_airline_2", 3)):
        sims = [{"task_id": str(k), "reward": k % 3, "termination_reason": NASTY[k], "messages": [{"role": "user", "content": NASTY[-k]}, {"role": "assistant", "tool_calls": [{"id": "c", "name": "get", "arguments": {"a": {"b": "}"}}}]}]} for k in range(n)]
        (folder / f"{name}.json").write_text(json.dumps({"info": {"agent_info": {"llm": "m"}}, "tasks": [{"id": str(k), "user_scenario": {"persona": NASTY[k]}} for k in range(n)], "simulations": sims}, separators=(",", ":")))  # Spark keeps an element's own blanks inside nested values, the whole-file reader drops them
    (folder / "summary_1.json").write_text('{"tasks": [], "simulations": []}')
    whole = readers.eval_directory(spark, str(tmp_path))
    split = readers.split_directory(spark, str(tmp_path))
    for make in (readers.simulations, readers.result_tasks):
        a, b = (sorted(map(str, make(rows, "model", "domain").collect())) for rows in (whole, split))
        for x, y in zip(a, b, strict=True):
            assert x == y
        assert len(a) > 10
    path = str(folder / "tasks.json")
    (folder / "tasks.json").write_text(json.dumps([{"id": str(k), "description": {"purpose": NASTY[k]}} for k in range(12)]))
    assert sorted(map(str, readers.tasks(spark, path, split=True).collect())) == sorted(map(str, readers.tasks(spark, path).collect()))
