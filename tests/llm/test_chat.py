"""Chat formatting: layouts, escapes, the loss mask, hard rows."""

import hashlib
import json
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment string, loss string, prompt string, n long"


def hard_rows():
    bits = [*chat.CONTROL, "\\", "\\-", "\\n", "\n", "<", "<|", "|>", "[", "/INST]", "é", "𝄞", " ", "a", "-", "n"]
    r, rows = np.random.default_rng(0), []
    for c in range(40):
        for t in range(int(r.integers(1, 7))):
            text = "".join(r.choice(bits, int(r.integers(0, 12))))
            rows.append((c, t, str(r.choice(["user", "assistant", "system", "tool\nx", "<|im_end|>\\n", ""])), text))
    rows += [(50, i, ("user", "assistant")[i % 2], f"turn {i} </s>") for i in range(300)]  # several segments
    rows += [(51, 0, "user", None), (51, 1, None, "x"), (51, None, "assistant", "late"), (None, 0, "assistant", "no conversation")]
    rows += [(52, 0, "user", "twice")] * 2 + [(53, 0, "assistant", "long " * 50_000)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "seg", "loss", "p", 3) for r in rows], SCHEMA)


def wanted(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted([(t is None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c])
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_digests_of_hard_rows(spark):
    rows = hard_rows()
    chats = chat.write_chats(chat.format_chats(chat.canonical_turns(frame(spark, rows).repartition(7))))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(chats).collect()}
    assert got == wanted(rows)
    assert chats.filter("conv_id = 50").count() == 5


def test_no_control_string_is_left_inside(spark):
    chats = chat.format_chats(chat.canonical_turns(frame(spark, hard_rows()))).collect()
    controls = "|".join(map(re.escape, chat.CONTROL))
    for r in chats:
        assert all(m in (chat.START, chat.END) for m in re.findall(controls, r.formatted))
        assert len(re.findall(re.escape(chat.START), r.formatted)) == len(re.findall(re.escape(chat.END) + "\n", r.formatted)) > 0
        for s in r.loss:  # a span is one assistant text: after the header, up to the end mark
            assert r.formatted[: s.start].endswith(f"{chat.START}assistant\n") and r.formatted[s.start + s.length :].startswith(chat.END)


RECORDS = [
    ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "a", "weight": 1}], "id": 7}, ["system:s", "user:u", "assistant:a"]),
    ({"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}], "system": "s"}, ["system:s", "user:u", "assistant:a"]),
    ({"dialogue": [{"speaker": "user", "utterance": "u"}, {"speaker": "bot", "utterance": "a"}]}, ["user:u", "assistant:a"]),
    ({"instruction": "i", "input": "x", "output": "o"}, ["user:i\n\nx", "assistant:o"]),
    ({"instruction": "i", "output": "o"}, ["user:i", "assistant:o"]),
    ({"history": [["a", "b"], ["c", "d"]], "query": "q", "response": "r"}, ["user:a", "assistant:b", "user:c", "assistant:d", "user:q", "assistant:r"]),
    ({"query": "q", "response": "r"}, ["user:q", "assistant:r"]),
    ({"prompt": "p", "completion": "c"}, ["user:p", "assistant:c"]),
    ({"system": "s", "prompt": "p", "response": "c"}, ["system:s", "user:p", "assistant:c"]),
    ({"question": "q", "context": "c", "answer": ""}, ["user:c\n\nq", "assistant:"]),
    ({"prompt": "p", "completion": "c", "answer": "not a layout of its own"}, ["user:p", "assistant:c"]),
    ({"messages": [None, {"role": None, "content": "x"}, {"role": "user", "content": None}]}, [":x", "user:"]),
    ({"title": "no layout"}, None),
    ("not json", None),
    (None, None),
    ({"messages": []}, None),
]


def test_layouts_of_json_records(spark):
    rows = [(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, (r, _) in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = {}
    for r in chat.canonical_turns(df, json_col="record").orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert got == {i: t for i, (_, t) in enumerate(RECORDS) if t is not None}
    lost = chat.unmapped(df, json_col="record").collect()
    assert {r.conv_id for r in lost} == {i for i, (_, t) in enumerate(RECORDS) if t is None}


def test_layouts_of_typed_frames(spark):
    m = spark.createDataFrame([(1, [("user", "u", 1), ("assistant", "a", 2)], 0.5)], "conv_id long, messages array<struct<role string, content string, n int>>, score double")
    assert [(r.role, r.text) for r in chat.canonical_turns(m).orderBy("turn").collect()] == [("user", "u"), ("assistant", "a")]
    p = spark.createDataFrame([(1, "p", "c", None, None), (2, None, None, "i", "o")], "conv_id long, prompt string, completion string, instruction string, output string")
    assert {(r.conv_id, r.role, r.text) for r in chat.canonical_turns(p).collect()} == {(1, "user", "p"), (1, "assistant", "c"), (2, "user", "i"), (2, "assistant", "o")}


def test_fingerprints_agree_between_schema_and_rows(spark):
    df = spark.createDataFrame([(json.dumps({"output": "o", "instruction": "i", "zzz": 1}),)], "record string")
    mark = df.select(chat.row_fingerprint(F.from_json("record", chat.record_schema()))[1].alias("f")).first()["f"]
    typed = spark.createDataFrame([("i", "o")], "instruction string, output string")
    assert mark == chat.fingerprint(list(chat.schema_paths(typed.schema))) and chat.fingerprints()[mark] == "instruction"
    marks = [m for lay in chat.LAYOUTS for m in [chat.fingerprint(lay.paths())]]
    assert len(set(marks)) == len(chat.LAYOUTS)


@pytest.mark.parametrize("kind", ["rows", "json"])
def test_empty(spark, kind):
    df = spark.createDataFrame([], SCHEMA)
    turns = chat.canonical_turns(df) if kind == "rows" else chat.canonical_turns(df, json_col="prompt")
    assert chat.digests(chat.write_chats(chat.format_chats(turns))).count() == 0
