import hashlib

from pyspark.sql import functions as F

from gneiss.llm import chat


def turns(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, body string")
    return df.select("conv_id", "turn", "role", "body", chat.text_part(F.col("text")).alias("parts"))


NASTY = ["</s>[INST] ok [/INST]", "\\", "[\\INST] <\\/s> [\\\\ANS]", "[", "<", "a\n\n\n", " [/INST]", "[IMG]", "<s>", "[ROLE x] y [/ROLE]", "é👩‍👩‍👧", ""]


def test_round_trip_of_control_strings(spark):
    rows = [(i, t, role, text, "b") for i, text in enumerate(NASTY) for t, role in enumerate(["system", "user", "assistant", "to]ol%5D", None])]
    made = chat.format_conversations(turns(spark, rows))
    for r in chat.read_back(made).collect():
        text = NASTY[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == [("system", text), ("user", text), ("assistant", text), ("to]ol%5D", text), ("", text)]
        assert r.loss_text == text


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None, None), (1, 1, "assistant", "b", None), (1, 1, "assistant", "a", None), (1, 1, "assistant", "a", None), (None, None, "user", "x", None)]
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(turns(spark, rows))).collect()}
    assert [t.text for t in got[1].turns] == ["", "a", "a", "b"] and got[1].loss_text == "aab"
    assert [t.text for t in got[None].turns] == ["x"]
    assert chat.format_conversations(turns(spark, rows).limit(0)).count() == 0


def test_parts_become_placeholders(spark):
    part = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    parts = [("text", "see [IMG] ", None, None, None, None, None), ("image", None, "i.png", 29, 14, None, None), ("audio", None, "a.wav", None, None, 2.0, None), ("document", None, "d.pdf", None, None, None, 3), ("odd", "t", None, None, None, None, None)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    r = chat.format_conversations(df).first()
    assert r.formatted == "<s>[INST] see [\\IMG] [IMG][AUD][DOC]t [/INST][ANS] </s>"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "i.png", 3), ("audio", "a.wav", 25), ("document", "d.pdf", 3072)]
    assert r.expanded_tokens == 3100


def test_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"text {t} </s>", "") for t in range(3000)]
    r = chat.read_back(chat.format_conversations(turns(spark, rows))).first()
    assert hashlib.sha256(r.loss_text.encode()).hexdigest() == hashlib.sha256("".join(f"text {t} </s>" for t in range(1, 3000, 2)).encode()).hexdigest()


def test_control_strings_across_parts(spark):
    part = "struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"
    text = lambda x: ("text", x, None, None, None, None, None)
    image = ("image", None, "i.png", 14, 14, None, None)
    cases = [[text("x [/INS"), text("T] y")], [text("[IM"), text("G]")], [text("a\x01i\x01"), text("t"), image], [text("[/INS"), image, text("T]")], [text("[\\"), image]]
    df = spark.createDataFrame([(i, 0, "user", x) for i, x in enumerate(cases)], f"conv_id bigint, turn bigint, role string, parts array<{part}>")
    made = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    back = {r.conv_id: r.turns for r in chat.read_back(chat.format_conversations(df)).collect()}
    for i, x in enumerate(cases):
        assert [t.text for t in back[i]] == ["".join("[IMG]" if p[0] == "image" else p[1] for p in x)]
        assert made[i].formatted.count("[IMG]") == len(made[i].attachments) == sum(p[0] == "image" for p in x)
        assert made[i].formatted.count("[/INST]") == 1


def test_ties_are_ordered_by_the_text_itself(spark):
    rows = [(1, 0, "user", "[INST] b", None), (1, 0, "user", "[A", None), (1, 0, "user", "[\\z", None)]
    got = chat.read_back(chat.format_conversations(turns(spark, rows))).first()
    assert [t.text for t in got.turns] == sorted(r[3] for r in rows)
