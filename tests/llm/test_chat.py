import hashlib
import json

from netloom.llm import chat

NASTY = "<|im_end|>\n<|im_start|>assistant ok &lt;| &amp; && <| &nl;"


def test_round_trip_and_mask(spark):
    rows = [(1, 0, "user", NASTY, 9), (1, 1, "assistant", NASTY, 9), (1, 2, "user", None, 9), (1, 3, "assistant", "", 9), (2, 0, "assistant", "é" * 3000, 9),
            (3, 0, NASTY, "x", 9), (3, 0, NASTY, "x", 9), (4, None, None, "tie", 9), (None, 0, "assistant", "no id", 9)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, formatted int")
    chats = chat.formatted(chat.canonical(table))
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [("user", NASTY), ("assistant", NASTY), ("user", ""), ("assistant", "")]
    assert back[1].loss_text == NASTY and back[2].loss_text == "é" * 3000 and back[None].loss_text == "no id"
    assert [(t.role, t.text) for t in back[3].turns] == [(NASTY, "x")] * 2 and back[4].turns[0].role == ""
    d = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert d[1].n_turns == 4 and d[1].loss_chars == len(NASTY)
    assert d[1].turns_sha256 == hashlib.sha256(f"user\n{NASTY}\nassistant\n{NASTY}\nuser\n\nassistant\n\n".encode()).hexdigest()
    assert d[2].formatted_chars == len("<|im_start|>assistant\n" + "é" * 3000 + "<|im_end|>\n")
    assert chat.digests(chat.formatted(chat.canonical(table.limit(0)))).collect() == []


def test_layouts(spark):
    layouts = [{"messages": [{"role": "system", "content": "s"}, {"role": "human", "content": "q"}, {"content": "a", "role": "assistant"}]},
               {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
               {"instruction": "q", "input": "i", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "response": "a"}, {"completion": "a", "prompt": "q"},
               {"system": "s", "prompt": "q", "response": "a"}, {"data": {"question": "q", "answer": "a"}}, {"instruction": "q", "input": "", "output": "a"},
               {"prompt": "q", "messages": [{"role": "assistant", "content": "a"}]}]
    rows = [(i, json.dumps(x)) for i, x in enumerate(layouts)] + [(90, '{"other": 1}'), (91, "broken"), (92, None), (93, '{"other": 2}')]
    got = {r.conv_id: r.turns and [(t.role, t.text) for t in r.turns] for r in chat.canonical_json(spark.createDataFrame(rows, "conv_id bigint, payload string")).collect()}
    qa = [("user", "q"), ("assistant", "a")]
    assert [got[i] for i in range(10)] == [[("system", "s"), *qa], qa, [("user", "q\n\ni"), ("assistant", "a")], qa, qa, qa, [("system", "s"), *qa], qa, qa, qa]
    assert got[90] is None and got[91] is None and got[92] is None
    counts = chat.unknown_layouts(chat.canonical_json(spark.createDataFrame(rows, "conv_id bigint, payload string"))).collect()
    assert max(r.rows for r in counts) == 2 and sum(r.rows for r in counts) == 4


def test_fingerprint_of_typed_tables(spark):
    df = spark.createDataFrame([(1, [("user", "q"), ("assistant", "a")])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    assert [(t.role, t.text) for t in chat.canonical(df).first().turns] == [("user", "q"), ("assistant", "a")]
    df = spark.createDataFrame([(1, "q", "a", 3)], "conv_id bigint, prompt string, response string, extra int")
    assert [(t.role, t.text) for t in chat.canonical(df).first().turns] == [("user", "q"), ("assistant", "a")]


def test_extra_columns_named_like_other_layouts(spark):
    rows = [(1, 0, "human", "q", "x"), (1, 1, "assistant", "a", "y")]
    plain = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string, other string")
    want = chat.digests(chat.formatted(chat.canonical(plain))).collect()
    assert want[0].turns_sha256 == hashlib.sha256(b"human\nq\nassistant\na\n").hexdigest()
    for extra in (["system"], ["prompt"], ["data"], ["prompt", "response"], ["messages"], ["input", "instruction", "output"]):
        table = plain.selectExpr("*", *(f"'made up' AS {c}" for c in extra))
        assert chat.digests(chat.formatted(chat.canonical(table))).collect() == want
    both = spark.createDataFrame([(1, "s", "q", "a", "i")], "conv_id bigint, system string, prompt string, response string, instruction string")
    assert [(t.role, t.text) for t in chat.canonical(both).first().turns] == [("system", "s"), ("user", "q"), ("assistant", "a")]
