"""Chat formatting with a grammar that is read back.

Template: every turn is ``<s>[INST] role [/INST] text</s>``. The parser splits at ``</s>``, takes the role up to the
first ``[/INST]`` and removes one level of escaping. A backslash goes into each control string of a role or text (and into
those that hold backslashes already, so that the escaping can be undone exactly), whether or not the parser would be misled by
it. Then the whole conversation is read back and compared with its source. One round of escaping is always enough, since
removal is its exact inverse; a conversation that still differed would raise.

Everything is a built-in function on one row per conversation; the only shuffle gathers the turns of a conversation.

Defined cases: a null text or role is empty; turns go by turn number (null first), ties by role and text, repeated rows
are kept; rows with a null conv_id are one conversation of their own; no rows give no rows; further columns are ignored. A conversation is one
text, whose digests are taken of the whole, so all its turns meet in one row: its length is bounded by what a string and an array hold (2 GB).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, BEGIN, END = "[INST] ", " [/INST] ", "<s>", "</s>"
LOSS_ROLE = "assistant"
#: A control string, or one that escaping has made of it; groups: first character, backslashes, rest.
CONTROL, ESCAPED = r"([<\[])(\\*)(/?s>|/?INST\])", r"([<\[])\\(\\*)(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(CONTROL), F.lit(r"$1\\$2$3"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(ESCAPED), F.lit("$1$2$3"))


def _head(role: Column) -> Column:
    return F.concat(F.lit(BEGIN + OPEN), role, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Turns of a formatted conversation, as an array of (role, text)."""
    pieces = F.split(formatted, F.lit(END), F.lit(-1))
    start = len(BEGIN + OPEN) + 1

    def turn(piece: Column) -> Column:
        rest = F.substring(piece, F.lit(start), F.length(piece))
        role = F.substring_index(rest, CLOSE, 1)
        text = F.substring(rest, F.length(role) + len(CLOSE) + 1, F.length(rest))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def format_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: conv_id, turns (source), segments (text, in_loss), formatted.

    The concatenated segments are the formatted text; in_loss marks those that a model is trained on.
    """
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    gathered = rows.select(F.col(conv_col).alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    source = gathered.select("conv_id", F.transform("ts", lambda t: F.struct(t.role.alias("role"), t.text.alias("text"))).alias("turns"))

    def written(t: Column) -> Column:
        return F.struct(escape(t.role).alias("role"), escape(t.text).alias("text"), t.role.alias("by"))

    def segments(t: Column) -> Column:
        return F.array(
            F.struct(_head(t.role).alias("text"), F.lit(False).alias("in_loss")),
            F.struct(t.text.alias("text"), (t.by == LOSS_ROLE).alias("in_loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("in_loss")),
        )

    rendered = source.withColumn("segments", F.flatten(F.transform(F.transform("turns", written), segments))).withColumn(
        "formatted", F.array_join(F.col("segments.text"), "")
    )
    same = parse(F.col("formatted")) == F.col("turns")
    return rendered.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation doesn't survive its round trip"))))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's digests of all conversations and of conversation -7, read back from the formatted text."""
    own = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text")
    )
    done = format_conversations(own.unionByName(extra))
    turns = done.withColumn("turns", parse(F.col("formatted")))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.in_loss), lambda s: unescape(s.text)), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(r, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') er, regexp_replace(t, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g') et from rows)
select conv_id, count(*) n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  cast(coalesce(sum(length(t)) filter (where r = 'assistant'), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  cast(sum(length(er) + length(et) + 23) as bigint) formatted_chars
from e group by conv_id
"""
