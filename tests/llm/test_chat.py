import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mosaiq.llm import chat
from mosaiq.llm.queries import op9_chat_formatting


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    turns = {}
    for r in sorted(table, key=lambda r: (r.conv_id, r.turn)):
        turns.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    odd = r"\### Assistant: </turn> ok"
    turns[-7] = [("user", odd), ("assistant", odd)]
    rows = op9_chat_formatting(spark, sf_dir).collect()
    assert len(rows) == len(turns)
    for r in rows:
        t = turns[r.conv_id]
        trained = "".join(x for role, x in t if role == "assistant")
        told = "".join(f"{role}\n{x}\n" for role, x in t)
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(t), hashlib.sha256(told.encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest())


PARTS = st.lists(st.sampled_from(["\\", "<", ">", "\n", "</turn>", "\n</turn>\n", "<turn role=", ">\n", "\\b", "\\l", "x", "é", ""]), max_size=6).map("".join)


def test_round_trip_of_control_strings(spark):
    cases = []

    @given(st.lists(st.tuples(PARTS, PARTS), min_size=1, max_size=4))
    @settings(max_examples=120, deadline=None, database=None)
    def gather(turns):
        cases.append(turns)

    gather()
    rows = [(k, t, role, text) for k, turns in enumerate(cases) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.formatted(chat.chained(df)).select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.trained_text(F.col("formatted"), F.col("mask")).alias("m")).collect()
    for r in made:
        assert [(t.role, t.text) for t in r.t] == cases[r.conv_id] and r.m == "".join(x for role, x in cases[r.conv_id] if role == "assistant")


def test_reply_trees(spark):
    #   1 - 2 - 3      scores: the branch to 5 is best, then 3, then 4
    #        \- 4
    #   \- 5
    rows = [(1, 1, None, 0.0), (1, 2, 1, 1.0), (1, 3, 2, 1.0), (1, 4, 2, 0.5), (1, 5, 1, 9.0), (2, 1, 7, 0.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0)]
    df = spark.createDataFrame([(c, i, p, s, "user", f"m{i}") for c, i, p, s in rows], "conv_id long, id long, parent long, score double, role string, text string")
    got = {(r.conv_id, r.rank): [t.text for t in r.t] for r in chat.formatted(df).select("conv_id", "rank", chat.read_back(F.col("formatted")).alias("t")).collect()}
    assert got == {(1, 1): ["m1", "m5"], (1, 2): ["m1", "m2", "m3"], (1, 3): ["m1", "m2", "m4"], (2, 1): ["m1"]}
    assert chat.formatted(df, best=1).count() == 2


def test_odd_rows(spark):
    long = "y" * 100_000
    rows = [(1, k, "assistant", str(k)) for k in range(37)] + [(2, None, None, None), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (3, 0, "user", "t"), (3, 0, "user", "t"), (4, 0, "assistant", long), (5, 0, "user", "")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, id string, score string")
    got = {r.conv_id: r for r in chat.formatted(chat.chained(df)).select("conv_id", chat.read_back(F.col("formatted")).alias("t"), chat.trained_text(F.col("formatted"), F.col("mask")).alias("m")).collect()}
    assert [t.text for t in got[1].t] == [str(k) for k in range(37)] and [(t.role, t.text) for t in got[2].t] == [("", "")]
    assert [t.text for t in got[None].t] == ["a", "b"] and len(got[3].t) == 2 and got[4].m == long and got[5].m == ""
    assert chat.formatted(chat.chained(df.where("false"))).count() == 0
