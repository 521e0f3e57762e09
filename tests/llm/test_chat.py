from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm.chat_format import (
    END, START, context_text, escape, escape_role, expand_examples, format_conversations, formatted_text, read_turns, unescape, unescape_role,
)

SCHEMA = "conv_id long, turn long, role string, text string, segments string, example int"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


ROWS = [
    (1, 0, "user", "hello"), (1, 1, "assistant", "hi <|im_end|>"), (1, 2, "user", None), (1, 3, "assistant", "\\ <\\| <|"),
    (2, 0, "assistant", ""), (2, 0, "assistant", ""), (2, 0, None, "tie"), (3, None, "system", "a\nb\n"), (3, 1, "us\ner\\n", "x"),
    (None, 0, "user", "no id"), (None, 1, "assistant", "still"), (4, 5, "user", "only"),
]


def test_round_trip_and_examples(spark):
    formatted = format_conversations(turns(spark, ROWS))
    back = {r[0]: [tuple(t) for t in r[1]] for r in formatted.select("conv_id", read_turns(formatted_text(F.col("segments")))).collect()}
    assert back == {
        1: [("user", "hello"), ("assistant", "hi <|im_end|>"), ("user", ""), ("assistant", "\\ <\\| <|")],
        2: [("", "tie"), ("assistant", ""), ("assistant", "")], 3: [("system", "a\nb\n"), ("us\ner\\n", "x")],
        None: [("user", "no id"), ("assistant", "still")], 4: [("user", "only")],
    }
    examples = context_text(expand_examples(formatted), formatted)
    got = {(r.conv_id, r.example): (r.context, r.reply) for r in examples.collect()}
    first = f"{START}user\nhello{END}\n{START}assistant\n"
    assert got[1, 0] == (first, "hi <\\|im_end|>")
    assert got[1, 1] == (first + f"hi <\\|im_end|>{END}\n{START}user\n{END}\n{START}assistant\n", "\\\\ <\\\\| <\\|")
    assert set(got) == {(1, 0), (1, 1), (2, 0), (2, 1), (None, 0)}


def test_empty_table_and_one_long_conversation(spark):
    assert format_conversations(turns(spark, ROWS).limit(0)).count() == 0
    long = [(9, n, "assistant" if n % 2 else "user", f"t{n}") for n in range(4000)]
    formatted = format_conversations(turns(spark, long))
    assert expand_examples(formatted).count() == 2000
    last = expand_examples(formatted).orderBy(F.col("example").desc()).first()
    assert (last.reply, last.context_segments) == ("t3999", 3 * 3999 + 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="<|\\n\n>/aim_start end", max_size=12), min_size=40, max_size=60))
def test_escapes_are_reversible(texts):
    from pyspark.sql import SparkSession

    frame = SparkSession.getActiveSession().createDataFrame([(t,) for t in texts], "t string")
    out = frame.select("t", unescape(escape(F.col("t"))).alias("u"), unescape_role(escape_role(F.col("t"))).alias("r"), escape(F.col("t")).alias("e"),
                       escape_role(F.col("t")).alias("er")).collect()
    assert all(r.t == r.u == r.r and "<|" not in r.e and "<|" not in r.er and "\n" not in r.er for r in out)


def test_examples_hold_their_masked_context(spark):
    formatted = format_conversations(turns(spark, ROWS))
    whole = {r[0]: [s.text for s in r[1]] for r in formatted.select("conv_id", "segments").collect()}
    rows = expand_examples(formatted).collect()
    assert len(rows) == 5
    for r in rows:
        assert [s.text for s in r.segments] == whole[r.conv_id][:r.context_segments + 1]
        assert [s.loss for s in r.segments] == [False] * r.context_segments + [True]
        assert r.segments[-1].text == r.reply
    assert sorted((str(r.conv_id), r.example) for r in rows if r.last) == [("1", 1), ("2", 1), ("None", 0)]


def test_query_reads_the_conversation_from_its_examples(spark, monkeypatch):
    from fieldloom.llm import queries

    rows = lambda: {r.conv_id: r for r in queries.op10(spark, "/root/testdata/sf0.001").collect()}
    want = rows()

    def cut(formatted):
        # examples that lose their first context segment
        out = expand_examples(formatted)
        return out.withColumn("segments", F.slice("segments", F.lit(2), F.size("segments")))

    monkeypatch.setattr(queries, "expand_examples", cut)
    assert rows()[-1].turns_sha256 != want[-1].turns_sha256


def test_roles_like_the_marks_are_reversible(one):
    roles = ["<|/", "<|=", "<\\|/", "\\<|/\n", "<\\\\|=\\n", "/<|", "\\\n"]
    assert one(lambda c: unescape_role(escape_role(c)), roles) == roles
