"""Relational chat formatting with Spark expressions only.

A conversation's rows are sorted as (turn, role, text); adjacent turns of one role are aggregated into one block, and the
blocks are concatenated:

    <s>role\\ntext<turn>text</s>

In texts and roles, the control strings <s> </s> <turn> <sys> </sys> [INST] [/INST] get a backslash behind their first
character (one more, if they have some), which is undone when reading back; so none of them occurs in a formatted text
but as a mark. In roles, line breaks and backslashes are escaped too. The loss mask is an array of (start, length) in
code points of the formatted text, one for each assistant turn, without marks.

Null text or role: empty. A null turn sorts first; ties are ordered by role, then text. Rows with a null conv_id form
one conversation. Repeated rows are turns of their own. An empty table gives no rows; other columns play no part. A
conversation becomes one value, so it must fit in a task; time is linear in its length but for the sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

OPEN, TURN, CLOSE = "<s>", "<turn>", "</s>"
_CONTROL = r"(/?(?:s>|turn>|sys>|INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, loss: array<struct<start,length>>."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))
    # Windows, and what groups by conversation behind them, need one exchange; each looks at a turn once, so time is linear in a
    # conversation's length but for the sort.
    w = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    turns = turns.withColumn("place", F.row_number().over(w)).withColumn("was", F.lag("role").over(w)).withColumn("next", F.lead("role").over(w))
    opens = ~F.col("role").eqNullSafe(F.col("was"))
    closes = ~F.col("role").eqNullSafe(F.col("next"))
    before = F.when(opens, F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n"))).otherwise(F.lit(TURN))
    turns = turns.select("conv_id", "place", "role", opens.cast("int").alias("opens"), before.alias("before"), escape(F.col("text")).alias("text"), F.when(closes, F.lit(CLOSE)).otherwise(F.lit("")).alias("behind"))
    up = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head, body = F.length("before"), F.length("text")
    turns = turns.withColumn("block", F.sum("opens").over(up)).withColumn("end", F.sum((head + body + F.length("behind")).cast("long")).over(up))
    span = F.struct((F.col("end") - F.length("behind") - body).alias("start"), body.cast("long").alias("length"))
    # Adjacent turns of a role become one block, and the blocks one text.
    piece = F.struct("place", F.concat("before", "text", "behind").alias("x"), F.when(F.col("role") == "assistant", span).alias("loss"))
    blocks = turns.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    blocks = blocks.select("conv_id", F.struct("block", F.array_join("turns.x", "").alias("x"), F.array_compact("turns.loss").alias("loss")).alias("b"))
    chats = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("blocks"))
    return chats.select("conv_id", F.array_join("blocks.x", "").alias("formatted"), F.flatten("blocks.loss").alias("loss"))


#: Between marks, and behind them; a mark stays at the end of what is before it.
_MARKS = "(?<=<s>)|(?<=<turn>)|(?<=</s>)"


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, turns: array<struct<role,text>> as they were, loss_text: the text under the loss mask, unescaped; formatted_chars. Read from the formatted texts and the masks alone."""
    none = lambda t: F.lit(None).cast(t)
    parts = F.transform(F.split("formatted", _MARKS), lambda x: F.struct(x.alias("x"), none("long").alias("start"), none("long").alias("length")))
    spans = F.transform("loss", lambda s: F.struct(none("string").alias("x"), s["start"].cast("long").alias("start"), s["length"].cast("long").alias("length")))
    rows = chats.select("conv_id", F.length("formatted").cast("long").alias("chars"), F.posexplode(F.concat(parts, spans)).alias("place", "p")).select("conv_id", "chars", "place", "p.*").where("x is null or x <> ''")
    # The parts come first, then the spans. A block's first part is its opening mark alone; its turns end with <turn> or </s>.
    w = Window.partitionBy("conv_id").orderBy("place")
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("end", F.sum(F.length("x").cast("long")).over(up)).withColumn("was", F.lag("x").over(w)).where(f"x is null or x <> '{OPEN}'")
    first = F.col("was") == OPEN
    mark = F.when(F.endswith("x", F.lit(TURN)), len(TURN)).otherwise(len(CLOSE))
    head = F.when(first, F.instr("x", F.lit("\n"))).otherwise(0)
    size = F.length("x") - head - mark
    role = F.last(F.when(first, F.substring_index("x", "\n", 1)), ignorenulls=True).over(up)
    rows = rows.select("conv_id", "chars", F.coalesce("start", F.col("end") - mark - size).alias("start"), "length", F.when(F.col("x").isNotNull(), F.struct("place", role.alias("role"), F.substring(F.col("x"), head + 1, size).alias("text"))).alias("t"))
    # A span of the mask and the turn that it covers meet at their place in the text; a turn's text is taken as far as the span goes.
    met = rows.groupBy("conv_id", "start").agg(F.max("t").alias("t"), F.max("length").alias("length"), F.max("chars").alias("chars"))
    turn = F.struct("t.place", unescape_role(F.col("t.role")).alias("role"), unescape(F.col("t.text")).alias("text"), F.when(F.col("length").isNotNull(), unescape(F.substring(F.col("t.text"), F.lit(1), F.col("length").cast("int")))).alias("loss"))
    turns = met.where("t is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.max("chars").alias("formatted_chars"))
    return turns.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"), F.array_join("turns.loss", "").alias("loss_text"), "formatted_chars")


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = format_chats(rows.unionByName(more))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = read_back(chats)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: The loss and the turns follow from the rows; only formatted_chars depends on the template.
OP5_SQL = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o as (
  select *, lag(role) over w as prev, lead(role) over w as next, row_number() over w as i, count(*) over (partition by conv_id) as n
  from r window w as (partition by conv_id order by turn nulls first, role, text)
), p as (
  select *, case when i = 1 or prev <> role then 4 + length(replace(replace(role, '\', '\s'), chr(10), '\n')) else 6 end
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|turn>|sys>|INST\]))', '\1\\\2\3', 'g'))
    + case when i = n or next <> role then 4 else 0 end as chars
  from o
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from p group by conv_id
"""
