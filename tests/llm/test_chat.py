"""Chat formatting: layouts, escapes, round trips and the named query."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("breezeline.llm")
from breezeline.llm import chat, queries

RECORDS = [
    {"id": "m1", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b", "name": "x"}]},
    {"id": "m2", "messages": [{"role": "tool", "content": None}], "source": "s"},
    {"id": "s1", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "x", "value": ""}]},
    {"id": 7, "instruction": "do", "input": "this", "output": "done"},
    {"id": 8, "instruction": "do", "input": "", "output": "done", "system": "be"},
    {"id": 9, "instruction": "do", "output": None},
    {"id": "p1", "prompt": "p", "completion": "c"},
    {"meta": {"id": "n1", "lang": "de"}, "data": {"prompt": "p", "response": "c"}},
    {"conv_id": 3, "turn": 1, "role": "assistant", "text": "second"},
    {"conv_id": 3, "turn": 0, "role": "user", "text": "first"},
    {"id": "odd", "question": "?"},
    [1, 2],
    None,
]
WANT = {
    "m1": [("user", "a"), ("assistant", "b")], "m2": [("tool", "")],
    "s1": [("user", "q"), ("assistant", "r"), ("x", "")],
    "7": [("user", "do\n\nthis"), ("assistant", "done")],
    "8": [("system", "be"), ("user", "do"), ("assistant", "done")],
    "9": [("user", "do"), ("assistant", "")],
    "p1": [("user", "p"), ("assistant", "c")], "n1": [("user", "p"), ("assistant", "c")],
    "3": [("user", "first"), ("assistant", "second")],
}


def test_layouts_become_turns(spark):
    rows = [(None if r is None else json.dumps(r), "x", "y") for r in RECORDS]
    records = spark.createDataFrame(rows, "j string, turns string, layout string").withColumn("record", F.parse_json("j"))
    canon = chat.canonical(records)
    assert canon.count() == len(RECORDS)
    got = {r["conversation"]: [tuple(t) for t in r["turns"]] for r in chat.conversations(canon).collect()}
    assert got == WANT
    assert chat.unmapped(canon).count() == 3  # the odd one, the list, and the null
    names = {r["conversation"]: r["layout"] for r in canon.collect()}
    assert (names["7"], names["8"], names["n1"], names["3"]) == ("instruction", "instruction", "nested_prompt", "turn_rows")
    assert chat.format_chats(records.limit(0)).collect() == []


def test_fingerprint_is_that_of_the_paths(spark):
    one = spark.sql("""SELECT parse_json('{"b": [{"c": 1.5, "a": "x"}, {"a": null}], "d-e": {"f": true}, "a": 3}') AS v""")
    paths = ["a", "b[].a", "b[].c", "d-e.f"]
    assert one.select(chat.fingerprint(F.col("v"))).first()[0] == chat.fingerprint_of(paths)


MARKS = chat.INST.marks + ["\\", "\\\\", "<", "[", "s>", "/INST]", "|end|>", "é", "a", "\n", "<\\s>", "[\\\\INST]"]


def test_round_trip_of_every_text(spark):
    rng = random.Random(6)
    convs = [("e", []), ("n", [("", ""), ("user", ""), ("assistant", "")])]
    for i in range(300):
        part = lambda: "".join(rng.choice(MARKS) for _ in range(rng.randrange(7)))
        roles = ["user", "assistant", "system", "tool", part()]
        convs.append((str(i), [(rng.choice(roles), part()) for _ in range(rng.randrange(6))]))
    convs.append(("long", [("assistant" if i % 2 else "user", "</s> word " * 300) for i in range(400)]))
    turns = spark.createDataFrame(convs, f"conversation string, turns {chat.TURNS}")
    made = chat.formatted(turns)
    got = made.select("conversation", chat.read_turns(F.col("formatted")).alias("t"), chat.loss_text(F.col("segments")).alias("l"))
    want = dict(convs)
    for r in got.collect():
        assert [tuple(t) for t in r["t"]] == want[r["conversation"]]
        assert r["l"] == "".join(text for role, text in want[r["conversation"]] if role == "assistant")


def test_marks_may_not_overlap():
    for roles in ({"a": ("<x", "x>")}, {"a": ("<<a", "<a")}, {"a": ("ab", "b\\")}):
        with pytest.raises(ValueError):
            chat.Template(roles, ("<|r|>", "<|t|>", "<|e|>"))


def test_query(spark, tmp_path):
    rows = [(1, 0, "user", None, "x"), (1, 1, "assistant", "</s>é", "x"), (1, 1, "assistant", "</s>é", "x"), (1, 0, "system", "s", None),
            (2, None, None, "t", "x"), (None, 5, "assistant", "z", "x")]
    schema = "conv_id long, turn long, role string, text string, turns string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in queries.op11_chat(spark, str(tmp_path)).collect()}
    said = "</s>[INST] ok [/INST]"
    want = {
        1: [("system", "s"), ("user", ""), ("assistant", "</s>é"), ("assistant", "</s>é")], 2: [("", "t")],
        None: [("assistant", "z")], -7: [("user", said), ("assistant", said)],
    }
    assert set(got) == set(want)
    for name, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[name]["n_turns"] == len(turns)
        assert got[name]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[name]["loss_chars"] == len(loss)
        assert got[name]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_only_dataframe_functions(spark):
    df = queries.op11_chat(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
