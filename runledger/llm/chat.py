"""Relational chat formatting: DataFrame expressions only.

One conversation becomes one string::

    ### <role>: <text></part><text></turn>\\n

with one block per run of adjacent turns of one role (their texts are merged,
parted by ``</part>``).  Inside texts a backslash becomes ``\\b``, a ``#``
before ``##`` becomes ``\\h`` and the ``<`` of ``</turn>`` or ``</part>``
becomes ``\\l``; afterwards no control string is left in a text and every
backslash belongs to one of the three codes, so ``unescape`` is exact.  In role
names a colon becomes ``\\c`` and a line feed ``\\n`` as well.

The loss mask is a list of (start, end) code-point ranges of the string, one
for each assistant text, without headers and marks.

Defined cases: a null text is empty, a null role is an empty role name, turns
are ordered by (turn, role, text) with nulls first, repeated rows are repeated
turns, rows with a null id form one conversation, an empty table gives no row;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runledger.llm.common import read

TURN_END = "</turn>\n"
PART = "</part>"
HEAD = "### "


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\b"))
    out = F.regexp_replace(out, "#(?=##)", r"\\h")
    return F.regexp_replace(out, "<(?=/(turn|part)>)", r"\\l")


def unescape(text: Column) -> Column:
    for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\c", ":"), ("\\n", "\n"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def escape_role(role: Column) -> Column:
    out = F.replace(escape(role), F.lit(":"), F.lit("\\c"))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_mask array<struct<start, end>>.

    One shuffle: the window and the aggregate share the hash on conv_id.
    Offsets come from a running sum, so a long conversation costs time in
    proportion to its length.
    """
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    t = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(
        F.col("turn").asc_nulls_first(), "role", "text")
    t = t.select(
        "conv_id", "role", escape("text").alias("body"),
        F.row_number().over(order).alias("pos"),
        F.coalesce(F.lag("role").over(order) != F.col("role"), F.lit(True)).alias("opens"),
        F.coalesce(F.lead("role").over(order) != F.col("role"), F.lit(True)).alias("closes"),
    )
    head = F.when(F.col("opens"), F.concat(F.lit(HEAD), escape_role(F.col("role")), F.lit(": "))
                  ).otherwise(F.lit(PART))
    t = t.withColumn("head", head).withColumn(
        "piece", F.concat("head", "body", F.when(F.col("closes"), TURN_END).otherwise("")))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(
        Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece").cast("long")).over(before), F.lit(0)) \
        + F.length("head")
    t = t.select("conv_id", F.struct(
        "pos", "piece", (F.col("role") == "assistant").alias("loss"),
        start.cast("long").alias("start"),
        (start + F.length("body")).cast("long").alias("end")).alias("t"))
    g = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return g.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("ts", lambda x: x["loss"]),
                    lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))
                    ).alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>."""
    blocks = F.split(formatted, TURN_END)
    blocks = F.slice(blocks, F.lit(1), F.size(blocks) - 1)

    def turns(block):
        colon = F.instr(block, ": ")
        role = unescape(F.substring(block, F.lit(len(HEAD) + 1), colon - (len(HEAD) + 1)))
        rest = F.substring(block, colon + 2, F.length(block))
        return F.transform(F.split(rest, PART),
                           lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(
        formatted, (m["start"] + 1).cast("int"), (m["end"] - m["start"]).cast("int")))), "")


EXTRA = r"\### Assistant: </turn> ok"


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA).alias("text"))
    out = format_conversations(turns.unionByName(extra))
    out = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                     masked_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(told, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


# The same digests from the rows; the length follows from the template.
ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
w as (
  select *, row_number() over o as pos,
    coalesce(lag(role) over o <> role, true) as opens,
    coalesce(lead(role) over o <> role, true) as closes,
    -- escapes add one character for each backslash, each # before ## and each mark
    length(text) + (length(text) - length(replace(text, '\', '')))
      + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
      + len(regexp_extract_all(text, '</(turn|part)>')) as body
  from t window o as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256,
  sum(body + case when opens then length(role) + 6 else 7 end
      + case when closes then 8 else 0 end)::bigint as formatted_chars
from w group by conv_id
"""
