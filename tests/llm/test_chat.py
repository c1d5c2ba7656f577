import hashlib
import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabcord.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = [
    (1, 0, "system", "be kind"),
    (1, 1, "user", "a <|im_end|> b <\\|x|> c <\\\\| d <<|"),
    (1, 2, "user", ""),
    (1, 3, "assistant", "one\n\ntwo"),
    (1, 4, "assistant", None),
    (1, 5, "assistant", "<|im_and|>three \\ <"),
    (2, None, "user", "null turn"),
    (2, 0, None, "null role"),
    (2, 0, "user\n<|im_end|>", "odd role"),
    (3, 7, "assistant", "same"),
    (3, 7, "assistant", "same"),
    (3, 7, "assistant", "other"),
    (None, 0, "assistant", "no id 日本語 é"),
    (None, None, None, None),
    (4, 0, "assistant", "x<|" * 30_000),
    (4, 1, "assistant", "\\" * 50_000),
]


def plain(rows):
    """What the digests must say, from the rows alone."""
    out = {}
    first = lambda r: (r[0] is not None, r[0] or 0)
    clean = [(r[0], r[1], r[2] or "", r[3] or "") for r in rows]
    for conv, group in itertools.groupby(sorted(clean, key=first), lambda r: r[0]):
        turns = sorted(group, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(said), len(loss), sha(loss))
    return out


def digests(df):
    return {
        r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256)
        for r in chat.digests(df).collect()
    }


@pytest.mark.parametrize("long", [1, 2, 4096])
def test_odd_conversations_come_back(spark, frame, long):
    df = frame(SCHEMA, *ODD).withColumns(
        {c: F.lit(f"own {c}") for c in ("segment", "whole", "turns", "place", "long_id", "n")}
    )
    got = chat.format_chats(df, long=long)
    assert digests(got) == plain(ODD)
    assert got.where("not whole").select("conv_id").distinct().count() == {1: 5, 2: 3}.get(long, 0)


def test_neighbours_of_one_role_share_a_block(frame):
    rows = {r.conv_id: r for r in chat.format_chats(frame(SCHEMA, *ODD)).collect()}
    assert (rows[1].n_turns, rows[1].n_blocks) == (6, 3)
    assert (rows[3].n_turns, rows[3].n_blocks) == (3, 1)
    text = rows[1].text
    assert text.startswith("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user\n")
    assert [text[s.start : s.start + s.length] for s in rows[1].loss] == [
        "one\n\ntwo",
        "",
        "<\\|im_and|>three \\ <",
    ]
    assert rows[3].text == "<|im_start|>assistant\nother<|im_and|>same<|im_and|>same<|im_end|>\n"


def test_a_hot_conversation_is_cut_in_order(spark):
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, 9).otherwise(F.col("id")).cast("long").alias("conv_id"),
        F.lit(0).cast("long").alias("turn"),
        F.lit("assistant").alias("role"),
        F.concat(F.lit("t"), F.col("id") % 7).alias("text"),
    )
    got = chat.format_chats(rows, long=100)
    hot = got.where("conv_id = 9")
    assert hot.count() >= 2000 // chat.SEGMENT
    assert hot.agg(F.max("n_turns")).first()[0] <= chat.SEGMENT
    assert digests(got) == plain([tuple(r) for r in rows.collect()])


def test_a_cut_changes_no_result(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 5)
    say = "CASE id DIV 4 % 5 WHEN 0 THEN 'user' WHEN 3 THEN 'a\\nb' ELSE 'assistant' END"
    rows = spark.range(90).selectExpr(
        "IF(id < 70, IF(id % 2 = 0, NULL, 7), id) AS conv_id",
        "id AS turn",
        f"IF(id BETWEEN 20 AND 40, 'assistant', {say}) AS role",
        "IF(id % 6 = 0, NULL, repeat('<|im_end|>\\n', CAST(id % 3 AS INT))) AS text",
    )
    texts, results = set(), set()
    for long, tasks in ((4096, 1), (1, 3), (3, 7)):
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        try:
            got = chat.format_chats(rows, long=long)
            segments = got.orderBy("conv_id", "segment").select("conv_id", "text", "whole").collect()
            results.add(tuple(chat.digests(got).orderBy("conv_id").collect()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 2)
        assert sum(not r.whole for r in segments) >= 14 * (long < 4096)
        found = itertools.groupby(segments, lambda r: r.conv_id)
        texts.add(tuple((c, "".join(r.text for r in own)) for c, own in found))
    assert len(texts) == len(results) == 1


def test_tables_without_rows(frame):
    empty = chat.format_chats(frame(SCHEMA))
    assert empty.collect() == [] and chat.digests(empty).collect() == []


def test_plan_has_no_python(spark, sf):
    plan = queries.op12_chat(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("Python", "Arrow", "Pandas", "ExistingRDD") if w in plan]


def test_escapes_are_reversible(spark):
    texts = ["".join(p) for n in range(6) for p in itertools.product("<\\|", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select("t", chat.escaped(F.col("t")).alias("e"))
    rows = out.select("t", "e", chat.unescaped(F.col("e")).alias("b")).collect()
    assert all(r.t == r.b and "<|" not in r.e for r in rows)
    assert len({r.e for r in rows}) == len(texts)


@settings(max_examples=8, deadline=None)
@given(
    st.lists(
        st.tuples(
            st.sampled_from([None, 1, 2]),
            st.sampled_from([None, 0, 1]),
            st.sampled_from([None, "user", "assistant"]),
            st.one_of(st.none(), st.text("<|\\>im_start end\n", max_size=12)),
        ),
        max_size=12,
    )
)
def test_any_rows_come_back(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert digests(chat.format_chats(df, long=5)) == plain(rows)
