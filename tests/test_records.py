import pytest
from pyspark.sql import functions as F

from millrace.functions import records
from millrace.functions.text import rstrip, strip


@pytest.fixture(scope="module")
def show(spark):
    def run(lines, *columns):
        df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").withColumn("v", F.parse_json("line"))
        return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]

    return run


def test_conversations_pairs_and_tools(show):
    lines = [
        '{"conversations":[{"from":"human","value":"question"},{"from":"gpt","value":"answer"}]}',
        '{"text":"beta document"}',
        '{"messages":null,"conversations":[{"role":"user","content":"x"}],"prompt":"p","output":"o"}',
        '{"messages":[{"role":null,"content":"a"},{"content":""},{"role":" System "},7,{"role":"assistant","content":null,"tool_calls":[{"id":"c"}],"name":"n"}]}',
        '{"instruction":"do","input":null,"answer":true}',
    ]
    got = [r[0] for r in show(lines, records.pretrain_text(F.col("v")))]
    assert got[0] == "<|user|>\nquestion\n<|assistant|>\nanswer"
    assert got[1] == "beta document"
    assert got[2] == "<|user|>\np\n<|assistant|>\no"
    assert got[3] == '<|none|>\na\n<|system|>\n\n<|assistant|>\n<|json_start|>{"name":"n"}<|json_end|>\n<|tool_call|>[{"id":"c"}]<|tool_call_end|>'
    assert got[4] == "<|user|>\ndo\nNone\n<|assistant|>\nTrue"


def test_pairs_stop_at_the_last_assistant_turn(show):
    lines = ['{"messages":[{"role":"user","content":"a"},{"role":"bot","content":"b"},{"role":"user","content":"c"}]}', '{"messages":[{"role":"user","content":"a"}],"question":"q","completion":"c"}', '{"input":"i"}']
    got = [r[0] for r in show(lines, records.sft_pair(F.col("v")))]
    assert [(g.prompt, g.response) for g in got] == [("<|user|>\na", "b"), ("q", "c"), ("i", None)]


def test_preferences(show):
    talk = lambda t: f'[{{"role":"user","content":"question"}},{{"role":"assistant","content":"{t}"}}]'
    lines = [f'{{"chosen":{talk("answer")},"rejected":{talk("bad")}}}', '{"prompt":"p","winner":"w","loser":"l"}']
    got = [r[0] for r in show(lines, records.dpo_triplet(F.col("v")))]
    assert [tuple(g) for g in got] == [("<|user|>\nquestion", "answer", "bad"), ("p", "w", "l")]


def test_prompt_format_and_stripping(spark):
    df = spark.createDataFrame([("<|user|>\nx \x1f",), ("say <|assistant|>　",)], "p string")
    assert [r[0] for r in df.select(records.format_prompt(F.col("p"))).collect()] == ["<|user|>\nx\n<|assistant|>\n", "<|user|>\nsay <|assistant|>\n<|assistant|>\n"]
    df = spark.createDataFrame([("\x1c \x85　a b\t\n\x1f",)], "p string")
    assert tuple(df.select(strip("p"), rstrip("p")).first()) == ("a b", "\x1c \x85　a b")
