"""Chat formatting: typed content parts become one text with a loss mask.

A turn holds parts in order: text, image, audio or document.  A visitor over
the parts turns texts into escaped text and the others into numbered
placeholders, notes each attachment's reference and adds up the tokens that
placeholders expand to.  Turns are then set into the template

    ### role: content</turn>

Control strings inside contents are broken by a backslash (``</turn>`` to
``<\\/turn>``) after every backslash has been doubled, so that no control string
is left in a content, splitting at ``</turn>`` is safe, and undoing both steps
in reverse gives the content back.  Everything is DataFrame functions.

Defined results: a null text, role, reference or part list is empty; turns of
a conversation go by (turn, role, content), null turns first; rows with a null
conversation id are one conversation; repeated rows are turns of their own;
parts of an unknown kind are treated as documents, and their placeholders say
so; a conversation becomes one row, so it has to fit a task; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks turns and placeholders, and how each is broken.
CONTROLS = (("</turn>", "<\\/turn>"), ("### ", "#\\## "), ("<|", "<\\|"))
HEAD, COLON, END = "### ", ": ", "</turn>\n"
#: Tokens that a placeholder stands for, where a part does not say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
PART = "struct<kind:string,text:string,ref:string,tokens:int>"


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, broken in CONTROLS:
        text = F.replace(text, F.lit(plain), F.lit(broken))
    return text


def unescaped(text: Column) -> Column:
    for plain, broken in CONTROLS[::-1]:
        text = F.replace(text, F.lit(broken), F.lit(plain))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def _role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit(COLON), F.lit(":\\ "))


def _unrole(role: Column) -> Column:
    return unescaped(F.replace(role, F.lit(":\\ "), F.lit(COLON)))


def text_part(text: Column) -> Column:
    return F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def visited(parts: Column) -> tuple[Column, Column, Column]:
    """Content with placeholders, attachments in order and tokens they expand to."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    other = F.filter(parts, lambda p: ~_is_text(p))

    def tokens(p: Column) -> Column:
        usual = F.coalesce(*[F.when(p["kind"] == k, F.lit(n)) for k, n in EXPANDED.items()], F.lit(EXPANDED["document"]))
        return F.coalesce(p["tokens"], usual)

    def kind(p: Column) -> Column:
        return F.when(p["kind"].isin(*EXPANDED), p["kind"]).otherwise("document")

    attachments = F.transform(other, lambda p, i: F.struct(i.alias("place"), p["kind"].alias("kind"), F.coalesce(p["ref"], F.lit("")).alias("ref"), tokens(p).alias("tokens")))
    # the number of a placeholder is how many attachments come before it
    pieces = F.transform(
        parts,
        lambda p, i: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), kind(p), F.lit(":"), F.size(F.filter(F.slice(parts, F.lit(1), i), lambda x: ~_is_text(x))).cast("string"), F.lit("|>"))
        ),
    )
    expanded = F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return F.array_join(pieces, ""), attachments, expanded


def formatted(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts_col: str = "parts", trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss, attachments, expanded_tokens), a row a conversation.

    ``loss`` holds (start, length) of each content under the loss mask, in code
    points of ``formatted``.
    """
    content, attachments, expanded = visited(F.col(parts_col))
    role = F.coalesce(F.col(role_col), F.lit(""))
    x = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), content.alias("content"), attachments.alias("attachments"), expanded.alias("expanded"))
    x = x.withColumn("head", F.concat(F.lit(HEAD), _role(F.col("role")), F.lit(COLON)))
    x = x.withColumn("piece", F.concat("head", "content", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")
    x = x.withColumn("place", F.row_number().over(order))
    x = x.withColumn("from", F.sum(F.char_length("piece")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.char_length("piece"))
    span = F.struct((F.col("from") + F.char_length("head")).alias("start"), F.char_length("content").cast("long").alias("length"))
    rows = F.sort_array(F.collect_list(F.struct("place", "piece", F.when(F.col("role") == trained_role, span).alias("span"), "attachments", "expanded")))
    x = x.groupBy("conv_id").agg(rows.alias("rows"))
    return x.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["span"].isNotNull()), lambda r: r["span"]).alias("loss"),
        F.flatten(F.transform("rows", lambda r: r["attachments"])).alias("attachments"),
        F.aggregate("rows", F.lit(0).cast("long"), lambda a, r: a + r["expanded"]).alias("expanded_tokens"),
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, content)."""
    turns = F.filter(F.split(text, END), lambda s: s != "")
    bare = lambda s: F.substring(s, len(HEAD) + 1, 2**31 - 1)
    escaped_role = lambda s: F.substring_index(bare(s), COLON, 1)
    return F.transform(
        turns,
        lambda s: F.struct(
            _unrole(escaped_role(s)).alias("role"),
            unescaped(F.substr(s, F.char_length(escaped_role(s)) + len(HEAD) + len(COLON) + 1)).alias("content"),
        ),
    )


def op7_chat_formatting(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = F.lit("\\### Assistant: </turn> ok")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), tricky.alias("text"))
    out = formatted(turns.unionByName(more).withColumn("parts", F.array(text_part(F.col("text")))))
    back = out.withColumn("turns", read_back(F.col("formatted")))
    loss = F.array_join(F.transform("loss", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    back = back.withColumn("learnt", loss)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e AS (
  SELECT *, replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), '<|', '<\|') AS et,
         replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '#\## '), '<|', '<\|'), ': ', ':\ ') AS er
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, et)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, et) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(4 + length(er) + 2 + length(et) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
