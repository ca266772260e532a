import json

import pytest

from tessera.llm import tool_calls
from tessera.llm.common import materialise

SCHEMAS = {"find": {"q": ("string", True), "n": ("integer", False), "w": ("number", False)}, "go": {"at": ("object", True), "on": ("boolean", False), "ids": ("array", False)}, "none": {}}
CALL = "conv_id long, turn long, call_id string, name string, arguments string, needs array<string>, status string"
RESULT = "conv_id long, turn long, call_id string, content string"


def run(spark, calls, results):
    df = tool_calls.linked(spark.createDataFrame([(*c, "x") for c in calls], CALL), spark.createDataFrame(results, RESULT), SCHEMAS)
    return {(r["conv_id"], r["call_id"]): r for r in df.collect()}


def test_links_statuses_and_records(spark):
    got = run(
        spark,
        [(1, 1, "a", "find", '{ "n": 3, "q": "x\\"é\\n" }', []), (1, 3, "b", "find", '{"q": "y"}', ["a"]), (1, 5, "a", "find", '{"q": "again"}', []), (2, 1, "a", "none", "{}", None), (None, 1, "a", "none", "{}", []), (1, 1, None, "none", "{}", [])],
        [(1, 2, "a", "first"), (1, 9, "a", "second"), (1, 4, "z", None), (2, 0, "b", "")],
    )
    assert {k: (r["status"], r["level"]) for k, r in got.items()} == {(1, "a"): ("linked", 0), (1, "b"): ("unanswered", 1), (1, "z"): ("orphan", None), (2, "a"): ("unanswered", 0), (2, "b"): ("orphan", None)}
    assert all(r["problems"] is None for r in got.values())
    a = got[1, "a"]
    assert (a["turn"], a["result_turn"]) == (1, 2)
    assert a["record"] == '{"arguments":{"n":3,"q":"x\\"é\\n"},"id":"a","name":"find","result":"first"}'
    for r in got.values():
        assert r["record"] == json.dumps(json.loads(r["record"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


@pytest.mark.parametrize(
    "name, arguments, want",
    [
        ("find", '{"q": 1}', "type:q"), ("find", "{}", "missing:q"), ("find", '{"q": "a", "n": 1.5}', "type:n"), ("find", '{"q": "a", "w": 2}', None), ("find", '{"q": "a", "w": 2.5, "z": 0, "y": 1}', "extra:y,extra:z"),
        ("find", "[1]", "missing:q,not_object"), ("find", "{bad", "missing:q,not_object"), ("find", None, "missing:q,not_object"), ("find", '{"q": null}', "type:q"), ("what", "{}", "unknown_tool"),
        ("go", '{"at": {"x": 1}, "on": true, "ids": [1]}', None), ("go", '{"at": [], "on": 1}', "type:at,type:on"), ("none", '{"a": 1}', "extra:a"), (None, "{}", "unknown_tool"),
    ],
)
def test_validation(spark, name, arguments, want):
    assert run(spark, [(1, 1, "a", name, arguments, [])], [])[1, "a"]["problems"] == want


def test_order_is_topological(spark):
    calls = [(1, 9 - i, f"c{i}", "none", "{}", [f"c{i - 1}"] if i else []) for i in range(8)] + [(1, 20, "d", "none", "{}", ["c3", "c5", "c3"]), (1, 21, "x", "none", "{}", ["y"]), (1, 22, "y", "none", "{}", ["x"]), (1, 23, "z", "none", "{}", ["x"]), (1, 24, "u", "none", "{}", ["nowhere", "c0"]), (1, 25, "s", "none", "{}", ["s"])]
    got = run(spark, calls, [])
    assert {k: r["level"] for (_, k), r in got.items()} == {**{f"c{i}": i for i in range(8)}, "d": 6, "x": None, "y": None, "z": None, "u": 1, "s": None}
    assert got[1, "u"]["problems"] == "reference:nowhere"


def test_long_chains_take_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(tool_calls, "materialise", lambda df, label: made.append(label) or materialise(df, label))
    n = 2000
    calls = [(1, i, f"c{i}", "none", "{}", [f"c{i - 1}"] if i else []) for i in range(n)] + [(2, i, f"c{i}", "none", "{}", [f"c{(i + 1) % 50}"]) for i in range(50)]
    calls += [(1, n + i, f"d{i}", "none", "{}", [f"c{i}", f"d{i - 1}" if i else f"c{n - 1}"]) for i in range(3)] + [(1, 3000, "e", "none", "{}", ["d2"])]
    got = {k: r["level"] for k, r in run(spark, calls, []).items()}
    assert got == {**{(1, f"c{i}"): i for i in range(n)}, **{(2, f"c{i}"): None for i in range(50)}, **{(1, f"d{i}"): n + i for i in range(3)}, (1, "e"): n + 3}
    assert len(made) < 30


def test_empty_tables(spark):
    assert run(spark, [], []) == {}


@pytest.mark.parametrize(
    "given, want, problems",
    [
        ('{"q": "a", "n": 1.0}', '{"n":1,"q":"a"}', None), ('{"q": "a", "n": 1e2}', '{"n":100,"q":"a"}', None), ('{"q": "a", "n": -0.0}', '{"n":0,"q":"a"}', None),
        ('{"q": "1.0, \\" 1e2 \\\\", "w": 2.50}', '{"q":"1.0, \\" 1e2 \\\\","w":2.5}', None), ('{"q": "a", "w": 15e-1}', '{"q":"a","w":1.5}', None), ('{"q": "a", "w": 100000000000000000000}', '{"q":"a","w":100000000000000000000}', None),
        ('{"q": "a", "w": 1e20}', '{"q":"a","w":100000000000000000000}', None), ('{"q": "a", "z": [1.0, {"k.0": [2.5e3, "3.0"]}, -7.0]}', '{"q":"a","z":[1,{"k.0":[2500,"3.0"]},-7]}', "extra:z"),
        ('{"q": "a", "q": "b"}', "null", "missing:q,not_object"), ('{"q": "a", "n": 1e-3}', '{"n":0.001,"q":"a"}', "type:n"),
        ('{"q": "a", "w": 1e400}', "null", "missing:q,not_object"), ('{"q": "a", "w": -1.5E+0999}', "null", "missing:q,not_object"), ('{"q": "a", "z": [' + "9" * 400 + "]}", "null", "missing:q,not_object"),
        ('{"q": "1e400 \\\" 1e999", "w": 1}', '{"q":"1e400 \\\" 1e999","w":1}', None), ('{"q": "Infinity", "w": 1e40}', '{"q":"Infinity","w":1' + "0" * 40 + "}", None),
        ('{"q": "a", "w": 12345678901234567890.5}', '{"q":"a","w":12345678901234567890.5}', None), ('{"q": "a", "w": 12345678901234567890.00}', '{"q":"a","w":12345678901234567890}', None),
        ('{"q": "a", "w": -1.25e38}', '{"q":"a","w":-125' + "0" * 36 + "}", None), ('{"q": "a", "w": 0.0001}', '{"q":"a","w":1.0E-4}', None), ('{"q": "a", "w": 1e-4}', '{"q":"a","w":1.0E-4}', None), ('{"q": "a", "w": 0.00}', '{"q":"a","w":0}', None),
    ],
)
def test_numbers_by_value(spark, given, want, problems):
    got = run(spark, [(1, 1, "a", "find", given, [])], [])[1, "a"]
    assert got["record"] == '{"arguments":' + want + ',"id":"a","name":"find","result":null}' and got["problems"] == problems
