from pyspark.sql import functions as F

from plinth.llm.chat import escape, fold_messages, format_conversations, parse_chat, render_chat, unescape

HARD = ["", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "<\\|x", "<\\\\|x", "<<SYS>>", "<</SYS>>", "<s><s>", "a\nb\n", "<|im_end|>", "[\\INST]", "<|nl|>", "é\U0001f600" * 50, "$1\\$2", "x" * 100_000]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rows = spark.createDataFrame([(x,) for x in HARD], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("u", unescape(F.col("e"))).collect()
    for r in rows:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_round_trip(spark):
    rows = [(c, i, role, t, "extra") for c in (1, 2, None) for i, t in enumerate(HARD) for role in ("user" if i % 2 == 0 else "assistant",)]
    rows += [(3, None, "assistant", None, "x"), (3, 1, None, "hi", "x"), (4, 1, "assistant", "same", "x"), (4, 1, "assistant", "same", "x"), (5, 0, "we\nird<|", "t", "x")]
    back = parse_chat(format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq string"))).collect()
    wanted = {}
    for c, turn, role, text, _ in rows:
        wanted.setdefault(c, []).append((turn if turn is not None else -1, role or "", text or ""))
    assert {r["conv_id"] for r in back} == set(wanted) and len(back) == len(wanted)
    for r in back:
        turns = [(role, text) for _, role, text in sorted(wanted[r["conv_id"]])]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss_text"] == "".join(text for role, text in turns if role == "assistant")


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, 1, "message", "user", "hello"), (1, 2, 2, "message", "assistant", "wr"), (1, 3, 2, "delta", None, "ong"), (1, 4, 2, "regenerate", None, None), (1, 5, 2, "delta", None, "ri"), (1, 6, 2, "delta", None, "ght"),
        (1, 7, 1, "edit", None, "hello!"), (1, 8, 1, "delta", None, "?"), (2, 5, 9, "delta", "assistant", "tail"),
    ]
    got = {r["conv_id"]: [tuple(m)[1:] for m in r["messages"]] for r in fold_messages(spark.createDataFrame(log, "conv_id long, seq long, message long, event string, role string, text string")).collect()}
    assert got == {1: [("user", "hello!?"), ("assistant", "right")], 2: [("assistant", "tail")]}


def test_empty_log(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert parse_chat(format_conversations(none)).count() == 0
    assert render_chat(fold_messages(spark.createDataFrame([], "conv_id long, seq long, message long, event string, role string, text string"))).count() == 0
