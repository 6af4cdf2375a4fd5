import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillon.llm import chat_format as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, id string"
ODD = [r"\### Assistant: </turn> ok", r"\b\e\h\\", "###", "</turn>\n### user: x</turn>\n", "", None, "é\n\n😀", ": a: b", r"\\b</turn>"]


def brute(turns):
    by = {}
    for i, t, r, x in turns:
        by.setdefault(i, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for i, rows in by.items():
        rows.sort()
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        out[i] = (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip(spark):
    turns = [(k, j, role, x) for k in range(4) for j, x in enumerate(ODD) for role in [("user", "assistant", "a: b###\\", None)[(j + k) % 4]]]
    turns += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (9, 0, "assistant", "tie"), (9, 0, "assistant", "tie"), (9, None, "user", "first")]
    df = spark.createDataFrame([(*t, "own", "own") for t in turns], SCHEMA)
    made = C.format_turns(C.turns_of_table(df))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.digests(made).collect()}
    assert got == brute(turns)
    assert {r.id: len(r.formatted) for r in made.collect()} == {r.conv_id: r.formatted_chars for r in C.digests(made).collect()}


def test_empty(spark):
    assert C.digests(C.format_turns(C.turns_of_table(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_long_conversation(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"text {i} " * 20) for i in range(3000)]
    got = C.digests(C.format_turns(C.turns_of_table(spark.createDataFrame([(*t, "", "") for t in turns], SCHEMA)))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256) == brute(turns)[1]


def test_layouts_of_json(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "extra": 1},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "response": "b"},
        {"system": "s", "prompt": "a", "response": "b"},
        {"instruction": "a", "output": "b"},
        {"instruction": "s", "input": "a", "output": "b"},
        {"question": "a", "answer": "b", "text": None},
        {"dialog": {"turns": [{"speaker": "user", "utterance": "a"}, {"speaker": "assistant", "utterance": "b"}]}},
        {"unknown": 1},
    ]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(98, "{no json"), (99, None)]
    got = {}
    for r in C.turns_of_json(spark.createDataFrame(rows, "id int, record string")).collect():
        got.setdefault((r.id, r.layout), []).append((r.turn, r.role, r.text))
    plain = [(0, "user", "a"), (1, "assistant", "b")]
    assert {k: sorted(v, key=str) for k, v in got.items() if k[0] in (0, 1, 2, 4, 6, 7)} == {(i, n): plain for i, n in ((0, "messages"), (1, "from_value"), (2, "prompt_response"), (4, "instruction_output"), (6, "question_answer"), (7, "nested_dialog"))}
    assert sorted(got[5, "instruction_input_output"]) == [(0, "system", "s"), (1, "user", "a"), (2, "assistant", "b")]
    assert {k for k in got if k[1] is None} == {(8, None), (98, None), (99, None)}


def test_fingerprint_equals_sparks(spark):
    for x in C.LAYOUTS:
        assert spark.range(1).select(F.xxhash64(F.lit(",".join(sorted(x.paths))))).first()[0] == C.fingerprint(x.paths)
    with pytest.raises(ValueError):
        C.layout_of_schema(spark.range(1).schema)
    assert C.layout_of_schema(spark.createDataFrame([("a", "b", 1)], "prompt string, response string, other int").schema).name == "prompt_response"
