import random

from pyspark.sql import functions as F

from ledgerloom.llm import chat

CONV = "conv_id bigint, turn bigint, role string, text string"
PARTS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "|", "[ESC]", "\\", "\\0", "\\1", "\\2", "<", "[", "/", "a", "é", "😀", "\n", " ", ""]


def conversations():
    rng = random.Random(8)
    say = lambda: "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 6)))
    out = {}
    for c in range(400):
        roles = ["user", "assistant", "system", "tool", "<</SYS>>", "", "u|[INST]"]
        out[c] = [(rng.choice(roles[:3] if c % 2 else roles), say()) for _ in range(rng.randint(1, 6))]
    out[500] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    out[501] = [("assistant", "x" * 20000)]
    return out


def frame(spark, convs):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, CONV)


def test_round_trip(spark):
    convs = conversations()
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(frame(spark, convs))).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert got[500]["formatted"].startswith("[ESC]")
    assert got[501]["formatted"] == "<s>" + "x" * 20000 + "</s>"


def test_loss_spans_cover_what_was_said(spark):
    convs = conversations()
    rows = chat.format_conversations(frame(spark, convs)).withColumn("spans", chat.loss_spans(F.col("formatted")))
    undo = lambda s: s.replace("\\1", "<").replace("\\2", "[").replace("\\0", "\\")
    for r in rows.collect():
        cut = [r["formatted"][s["start"] : s["end"]] for s in r["spans"]]
        if r["formatted"].startswith("[ESC]"):
            cut = [undo(x) for x in cut]
        assert cut == [t for role, t in convs[r["conv_id"]] if role == "assistant"]


def test_text_outside_the_grammar_is_refused(spark):
    bad = ["x", "[INST]a[/INST] ", "<s>a", "[INST]a[/INST]b</s>", "<<SYS>>a"]
    rows = spark.createDataFrame([(b,) for b in bad], "f string")
    assert rows.where(chat.parse(F.col("f")).isNotNull()).count() == 0


def test_nulls_ties_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", None), (1, None, None, "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b"), (None, 0, "user", "c")], CONV).withColumn("turns", F.lit("x"))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.read_back(chat.format_conversations(rows)).collect()}
    assert got == {1: [("", "a"), ("user", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "c")]}
    assert chat.read_back(chat.format_conversations(rows.where("false"))).count() == 0
