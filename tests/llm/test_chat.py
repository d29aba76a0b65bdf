"""Chat formatting against a plain Python form, odd rows with checked values, and long conversations."""

import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from quayside.llm import chat

CONTROL = re.compile(r"([<\[])(\\*)(/?(?:s>|turn>|sys>|INST\]))")


def by_hand(turns):
    """(formatted, spans, loss text) of (turn, role, text) rows."""
    escape = lambda x: CONTROL.sub(r"\1\\\2\3", x)
    rows = sorted((t is not None, t or 0, r or "", x or "") for t, r, x in turns)
    out, spans, loss, was = "", [], "", None
    for i, (_, _, role, text) in enumerate(rows):
        out += "<turn>" if i and role == was else "<s>" + escape(role.replace("\\", "\\s").replace("\n", "\\n")) + "\n"
        if role == "assistant":
            spans.append((len(out), len(escape(text))))
            loss += text
        out += escape(text)
        if i + 1 == len(rows) or rows[i + 1][2] != role:
            out += "</s>"
        was = role
    return out, spans, loss, [(r, x) for *_, r, x in rows]


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as formatted", "1 as place", "2 as block", "3 as loss", "4 as length", "5 as start")
    chats = chat.format_chats(df)
    made = {r.conv_id: r for r in chats.collect()}
    back = {r.conv_id: r for r in chat.read_back(chats).collect()}
    want = {}
    for c, *rest in rows:
        want.setdefault(c, []).append(rest)
    assert made.keys() == back.keys() == want.keys()
    for c, turns in want.items():
        formatted, spans, loss, said = by_hand(turns)
        assert made[c].formatted == formatted and [tuple(x) for x in made[c].loss] == spans
        assert [tuple(t) for t in back[c].turns] == said and back[c].loss_text == loss and back[c].formatted_chars == len(formatted)


def test_formats_as_by_hand(spark):
    r = random.Random(4)
    bits = ["<s>", "</s>", "<turn>", "\\", "[INST]", "[\\/INST]", "a", " ", "\n", "<sys>", "🙂", "é", "<\\s>", ""]
    role = lambda: r.choice(["user", "assistant", "assistant", None, "", "sys<s>tem", "a\nb\\n", "assistant\n"])
    text = lambda: r.choice([None, "".join(r.choice(bits) for _ in range(r.randint(0, 6)))])
    rows = [(r.choice([None, 0, 1, 2, 3, -7]), r.choice([None, 0, 1, 2, 3, 4, 9]), role(), text()) for _ in range(300)]
    check(spark, rows + rows[:40])


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(1, None, None, None)])
    check(spark, [(1, 0, "assistant", "")] * 3)


def test_query_adds_its_conversation(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    (row,) = chat.op5_chat(spark, str(tmp_path)).collect()
    said = "</s>[INST] ok [/INST]"
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-7, 2, len(said))
    assert row.turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest() and row.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_time_grows_with_the_conversation(spark):
    took = []
    for n in (1_000, 30_000, 120_000):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.lit("some text").alias("text"))
        t = time.perf_counter()
        (got,) = chat.read_back(chat.format_chats(rows)).select(F.size("turns"), F.length("loss_text")).collect()
        took.append(time.perf_counter() - t)
        assert tuple(got) == (n, 9 * (n - (n + 2) // 3))
    assert took[2] < 8 * took[1] + 2
