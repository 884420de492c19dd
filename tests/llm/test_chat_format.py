import hashlib

from pyspark.sql import functions as F

from driftrank.llm import chat_format as C

HARD = ["</s>[INST] ok [/INST]", "\\l \\\\b \\e", "<turn>", "<end><role>x</role>", "", None, " a\n", "\\", "日本 <<SYS>>", "]>"]


def test_round_trip(spark):
    rows = []
    for c, roles in enumerate((["user", "assistant"], ["assistant"], ["system", "user", "user", "tool", "assistant", "assistant"],
                               ["<role>", None, "", "user"], ["user"] * 40)):
        for k in range(max(len(roles), 12)):
            rows.append((c, k, roles[k % len(roles)], HARD[k % len(HARD)]))
    rows += [(None, 1, "user", "n"), (None, None, "assistant", "first"), (9, 3, "user", "b"), (9, 3, "user", "a"),
             (9, 3, "assistant", "z"), (9, 3, "user", "a"), (10, 0, "user", None), (11, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    chats = C.formatted(df)
    got = {r["conv_id"]: r for r in C.digests(chats).collect()}
    plain = {r["conv_id"]: r["formatted"] for r in chats.collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((t[1] is not None, t[1] or 0, t[2] or "", t[3] or "") for t in rows if t[0] == conv)
        text = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["formatted_chars"] == len(plain[conv])
        merged = 1 + sum(a[2] != b[2] for a, b in zip(turns, turns[1:]))
        assert plain[conv].count(C.TURN) == len(turns) - merged


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.digests(C.formatted(df)).count() == 0
    one = spark.createDataFrame([(1, 0, "user", "x", "y", 3)], "conv_id long, turn long, role string, text string, formatted string, turns int")
    assert C.formatted(one).collect()[0]["formatted"] == "[INST]x[/INST]"


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.digests(C.formatted(df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None
