import random

import duckdb
import pytest

from arborlake.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def reply_tree(rows):
    """Turn -> (thread, depth, position) by walking each conversation's replies depth first."""
    kids, out = {}, {}
    for t, parent in sorted(rows.items()):
        kids.setdefault(parent, []).append(t)
    for root in kids.get(None, []):
        stack, n = [(root, 0)], 0
        while stack:
            t, depth = stack.pop()
            out[t] = (root, depth, n)
            n += 1
            stack += [(k, depth + 1) for k in reversed(kids.get(t, []))]
    return out


def test_links_threads_and_contents(spark):
    rows = [
        (1, 0, "user", "How are you?\nSecond  line here"), (1, 1, "assistant", "Fine."), (1, 2, "user", "On Monday Ann wrote:\n> how ARE you?\n> second line here\nSame here"), (1, 3, "user", ">> How are you?\n>> Second line here\n> Same here\nok"),
        (1, 4, "user", "> Fine.\nGood to hear"), (1, 5, "user", "> second line here\nwhich one"), (1, 6, "user", "ok"), (1, 7, "user", "> no one said this\nhm"), (2, 5, None, None), (2, 9, "user", "after a gap"), (None, 1, "user", "x"), (3, None, "user", "y"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS content", "1 AS position")
    out = {(r.conv_id, r.turn): r for r in chat.format_chat(df).collect()}
    assert [out[1, t].reply_to for t in range(8)] == [None, 0, 0, 2, 1, 0, 5, 6]
    assert [out[1, t].content for t in (2, 3, 4)] == ["Same here", "ok", "Good to hear"] and out[1, 7].n_linked == 0
    assert [(out[1, t].depth, out[1, t].position) for t in range(8)] == [(0, 0), (1, 1), (1, 3), (2, 4), (2, 2), (1, 5), (2, 6), (3, 7)]
    assert out[2, 5].formatted == "<|unknown|>\n\n<|end|>" and (out[2, 9].thread, out[2, 5].thread) == (9, 5)
    assert (out[None, 1].thread, out[None, 1].position, out[3, None].position) == (1, 0, 0)
    again = chat.format_chat(df.union(df))
    assert again.count() == 24
    (text,) = [r.text for r in chat.assemble(again).collect() if r.conv_id == 1]
    assert [line for line in text.split("\n") if not line.startswith("<|")] == ["How are you?", "Second  line here", "Fine.", "Good to hear", "Same here", "ok", "which one", "ok", "hm"]
    assert [r.n_messages for r in chat.assemble(again, 3).filter("conv_id = 1").orderBy("part").collect()] == [3, 3, 2]
    assert chat.format_chat(df.limit(0)).count() == 0 and chat.assemble(chat.format_chat(df.limit(0))).count() == 0


@pytest.mark.parametrize("stride", [1024, 4])
def test_random_conversations_equal_brute_force_and_sql(spark, monkeypatch, stride):
    monkeypatch.setattr(chat, "STRIDE", stride)
    rng = random.Random(21)
    words = ["ok", "yes it is", "thanks", "no it is not", "see the file please"]
    rows = []
    for c in range(6):
        for t in range(60 if c == 0 else 12):
            if rng.random() < 0.1:
                continue
            lines = [rng.choice(["", "", "> ", ">> ", ">"]) + rng.choice(words) for _ in range(rng.randint(1, 4))]
            rows.append((c, t, rng.choice(["user", "assistant", None]), "\n".join(lines)))
    found = chat.format_chat(spark.createDataFrame(rows, SCHEMA))
    out = found.toPandas()
    for c in range(6):
        mine = out[out.conv_id == c]
        parents = {int(r.turn): None if r.reply_to != r.reply_to else int(r.reply_to) for r in mine.itertuples()}
        assert {int(r.turn): (r.thread, r.depth, r.position) for r in mine.itertuples()} == reply_tree(parents)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(queries.ORACLE_SQL["op10_chat"]).fetchall()
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_long_and_star_shaped_conversations(spark):
    rows = [(1, 0, "u", "common line here")] + [(1, t, "u", "> common line here\nx") for t in range(1, 1500)] + [(2, t, "u", "a") for t in range(3000)] + [(3, t, "u", "> a b c d" if t == 40 else "a b c d") for t in range(300)]
    out = chat.format_chat(spark.createDataFrame(rows, SCHEMA).repartition(4)).toPandas().set_index(["conv_id", "turn"])
    assert (out.loc[1].sort_index().position.to_numpy() == range(1500)).all() and out.loc[1].depth.max() == 1
    assert (out.loc[2].sort_index().depth.to_numpy() == range(3000)).all()
    assert (out.loc[3].sort_index().depth.to_numpy() == range(300)).all()


def test_no_python_in_the_plan(spark):
    plan = chat.format_chat(spark.createDataFrame([(1, 0, "u", "a"), (1, 1, "u", "> a\nb")], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
