"""Chat formatting of typed content parts, in DataFrame operations only.

A turn is a list of parts: text, image, audio or document. A visitor, one expression per type, flattens the parts into
one string: text is escaped, the others become numbered placeholders that stand for a number of tokens, and their
references go to a list of attachments. Each turn is then

    <s>[role] text</s>

Inside roles and texts ``<``, ``[``, ``]`` and the escape character are written with other characters, so no control
string (nor one of another template, such as ``[/INST]``) can arise there, and the output can be read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafvoice.llm.tables import table

BEGIN, AFTER_ROLE, END = "<s>[", "] ", "</s>"
#: The escape character comes first, so that its own escapes aren't escaped again.
ESCAPES = (("\\", "\\-"), ("<", "\\l"), ("[", "\\b"), ("]", "\\e"))
#: Tokens that a unit of a part stands for: an image tile, a second of audio, a page.
TOKENS_PER = {"image": 256, "audio": 25, "document": 512}
CONTENT = "array<struct<type: string, text: string, ref: string, units: int>>"
LEARNT = "assistant"


def escape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES), text)


def text_part(text: Column) -> Column:
    """A plain text as content; null is the empty text."""
    return F.array(F.struct(
        F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def _content(parts: Column) -> Column:
    return F.coalesce(parts, F.array().cast(CONTENT))


def visit(parts: Column) -> Column:
    """Content as one escaped string. A null part, type or text is the empty text; an unknown type is shown as text."""
    def one(p: Column, i: Column) -> Column:
        text = F.coalesce(escape(p["text"]), F.lit(""))
        return reduce(lambda c, k: F.when(p["type"] == k, F.concat(F.lit(f"<{k}:"), i.cast("string"), F.lit(">"))).otherwise(c), TOKENS_PER, text)
    return F.array_join(F.transform(_content(parts), one), "")


def attachments(parts: Column) -> Column:
    """Place, type, reference and expanded number of tokens of each part that isn't text."""
    def one(p: Column, i: Column) -> Column:
        per = reduce(lambda c, k: F.when(p["type"] == k, F.lit(TOKENS_PER[k])).otherwise(c), TOKENS_PER, F.lit(None).cast("int"))
        return F.struct(i.alias("place"), p["type"].alias("type"), p["ref"].alias("ref"), (per * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens"))
    return F.filter(F.transform(_content(parts), one), lambda a: a["tokens"].isNotNull())


def format_chats(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_mask, attachments`` of each conversation of ``turns`` (conv_id, turn, role, content).

    Turns are ordered by number, null first; equal numbers by role and text. ``loss_mask`` lists start (from 0) and length
    in code points of what is learnt: the assistants' texts. ``attachments`` names turn, place, type, reference and
    tokens. Rows with a null conv_id are one conversation; a null role is an empty name. A conversation becomes one
    string, so its turns meet in one row; nothing larger does.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), visit(F.col("content")).alias("text"), attachments(F.col("content")).alias("files"))
    head = F.concat(F.lit(BEGIN), escape(F.col("role")), F.lit(AFTER_ROLE))
    rows = rows.withColumn("piece", F.concat(head, "text", F.lit(END))).withColumn("head", F.length(head)).withColumn("size", F.length("text"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    by = Window.partitionBy("conv_id").orderBy(*order)
    rows = rows.withColumn("begin", F.sum(F.length("piece")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.length("piece"))
    item = F.struct(F.row_number().over(by).alias("at"), "turn", "role", "piece", (F.col("begin") + F.col("head")).alias("start"), "size", "files")
    whole = rows.select("conv_id", item.alias("item")).groupBy("conv_id").agg(F.sort_array(F.collect_list("item")).alias("items"))
    learnt = F.filter("items", lambda x: x["role"] == LEARNT)
    files = F.transform("items", lambda x: F.transform(x["files"], lambda f: F.struct(
        x["turn"].alias("turn"), f["place"].alias("place"), f["type"].alias("type"), f["ref"].alias("ref"), f["tokens"].alias("tokens"))))
    return whole.select(
        "conv_id", F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(learnt, lambda x: F.struct(x["start"].cast("int").alias("start"), x["size"].alias("length"))).alias("loss_mask"),
        F.flatten(files).alias("attachments"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns (role, text), learnt`` from ``formatted`` and ``loss_mask``: turns are split at the control strings,
    what is learnt is cut out by the mask; both unescaped. Placeholders stay as they are."""
    def turn(s: Column) -> Column:
        at = F.instr(s, F.lit(AFTER_ROLE))
        role = s.substr(F.lit(len(BEGIN) + 1), at - F.lit(len(BEGIN) + 1))
        return F.struct(unescape(role).alias("role"), unescape(s.substr(at + F.lit(len(AFTER_ROLE)), F.length(s))).alias("text"))
    pieces = F.split("formatted", F.lit(END), -1)
    return formatted.select(
        "conv_id", "formatted", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"),
        F.array_join(F.transform("loss_mask", lambda m: unescape(F.col("formatted").substr(m["start"] + 1, m["length"]))), "").alias("learnt"))


def op6_chat_formatting(spark, sf_dir):
    """Every conversation, and one whose texts are control strings, formatted and read back."""
    own = spark.createDataFrame(
        [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    read = read_chats(format_chats(turns.withColumn("content", text_part(F.col("text")))))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_OWN = "</s>[INST] ok [/INST]"
OP6_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{_OWN}'), (-7, 1, 'assistant', '{_OWN}')
), sized as (
  select *, 4 + 2 + 4
    + length(role) + len(regexp_extract_all(role, '[\\\\<\\[\\]]'))
    + length(text) + len(regexp_extract_all(text, '[\\\\<\\[\\]]')) as chars
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id"""
