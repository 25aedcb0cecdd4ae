import duckdb
from pyspark.sql import functions as F

from panelyard.llm import chat
from panelyard.session import shared_path
from tests.llm.fixtures import SF

ROWS = [(1, 0, "user", "[INST] hi [/INST]"), (1, 1, "assistant", "<s>"), (2, 0, "user", "plain"), (2, 1, "assistant", "a < b [x]"), (3, 0, "[INST]", "[/INST] "), (3, 1, "assistant", r"<\s> [\\/INST] </s> <</s"), (4, 0, None, None)]


def test_every_control_string_is_escaped_as_in_sql(spark):
    path = shared_path(spark, "case")
    spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path.removeprefix('file://')}/conversations.parquet/*.parquet'")
    found = con.execute(chat.OP1_SQL)
    columns = [d[0] for d in found.description]
    got = chat.op1_chat_format(spark, path).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(found.fetchall())


def test_formatted_text_holds_control_strings_of_the_template_only(spark):
    rows = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    formatted = {r.conv_id: r.formatted for r in chat.format_conversations(rows).collect()}
    assert formatted[1] == r"<s>[INST] user [/INST] [\INST] hi [\/INST]</s><s>[INST] assistant [/INST] <\s></s>"
    assert formatted[2] == "<s>[INST] user [/INST] plain</s><s>[INST] assistant [/INST] a < b [x]</s>"


def test_round_trip_of_every_text_and_edge_cases(spark):
    hard = ["", "\\", "\\\\", "</s>", "<\\/s>", "<\\\\/s>", "[/INST]", " [/INST] ", "[INST] [/INST]</s><s>[INST] x [/INST] y</s>", "<s", "s>", "a\n\n\tb ", "é日😀</s>", "x" * 200_000 + "</s>", "$1\\$2", "[[INST]]", "<<s>/s>"]
    rows = [(1, i, role, text, "c", "t", 0) for i, text in enumerate(hard) for role in ("user", "assistant", "</s>")]
    rows += [(2, None, "user", "b", "c", "t", 0), (2, 0, "user", "a", "c", "t", 0), (2, 0, "user", "a", "c", "t", 0), (2, 0, "assistant", "z", "c", "t", 0), (None, 1, None, None, "c", "t", 0), (None, 0, "user", "x", "c", "t", 0)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, turns string, ts int")
    done = {r.conv_id: r for r in chat.format_conversations(frame).withColumn("read", chat.parse(F.col("formatted"))).collect()}
    for conv, r in done.items():
        mine = sorted([x for x in rows if x[0] == conv], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.read] == [(x[2] or "", x[3] or "") for x in mine] == [(t.role, t.text) for t in r.turns]
        assert "".join(s.text for s in r.segments) == r.formatted and r.formatted.count("</s>") == len(mine)
        assert sum(s.in_loss for s in r.segments) == sum(x[2] == "assistant" for x in mine)
    assert chat.format_conversations(frame.where("false")).collect() == []


def test_main_path_has_no_python(spark):
    plan = chat.op1_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
