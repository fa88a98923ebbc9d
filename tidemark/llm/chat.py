r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline

A backslash makes the next character literal; ``###`` and ``</turn>`` may stand in a role or text
only when broken by one, and ``: `` likewise in a role.  Each turn is first written as it is and
reparsed.  Where the recovered turn differs from its source (control strings, backslashes) the turn
is escaped and reparsed again; a turn or a whole conversation that still differed would be an error,
so the output always parses back to its source.

Turns are laid out by one window over the conversation (running length), which gives the spans of
the loss mask; the same shuffle then joins a conversation's turns into its text.  A conversation is
one output row and so lives in one task; nothing wider than a conversation is ever gathered.

Defined results.  A null text or role counts as empty.  Rows go by turn, nulls last, then role,
then text, so that ties and repeated rows (all of them kept) have one order.  A null id is a
conversation of its own.  An empty table gives an empty table.  Only the four columns named are
read, so others cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"
MARK = "###"


def escape(c: Column, role: bool = False) -> Column:
    r"""Backslashes doubled, control strings broken by a backslash."""
    c = F.regexp_replace(c, r"\\", r"\\\\")
    c = F.regexp_replace(c, r"</(?=turn>)", r"<\\/")
    c = F.regexp_replace(c, r"#(?=##)", r"#\\")
    return F.regexp_replace(c, r":(?= )", r":\\") if role else c


def unescape(c: Column) -> Column:
    return F.when(F.instr(c, "\\") > 0, F.regexp_replace(c, r"(?s)\\(.)", "$1")).otherwise(c)


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted conversation; null where it does not parse.

    Functions of an array's element are not shared between expressions, so each step computes one
    thing and hands it on: the segments, their bodies, where the role ends, the turn.
    """
    parts = F.split(formatted, END + "\n", -1)
    head = MARK + " "
    bodies = F.transform(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        lambda s: F.when(F.startswith(s, F.lit(head)), F.substring(s, len(head) + 1, 1 << 30)),
    )
    placed = F.transform(bodies, lambda b: F.struct(b.alias("b"), F.instr(b, ": ").alias("at")))

    def turn(x: Column) -> Column:
        b, at = x["b"], x["at"]
        good = (at > 0) & ~F.contains(b, F.lit(MARK)) & ~F.contains(b, F.lit(END))
        role, text = F.substr(b, F.lit(1), at - 1), F.substr(b, at + 2)
        return F.when(good, F.struct(role.alias("role"), text.alias("text")))

    turns = F.transform(placed, turn)
    whole = F.when((F.element_at(parts, -1) == "") & ~F.exists(turns, lambda t: t.isNull()), turns)
    return F.transform(
        whole, lambda t: F.struct(unescape(t["role"]).alias("role"), unescape(t["text"]).alias("text"))
    )


def _written(role: Column, text: Column) -> Column:
    return F.concat(F.lit(MARK + " "), role, F.lit(": "), text, F.lit(END + "\n"))


def _same(segment: str) -> Column:
    """Whether a written turn parses back to exactly its own role and text."""
    back = parse(F.col(segment))
    return F.coalesce(
        (F.size(back) == 1)
        & (F.element_at(back, 1)["role"] == F.col("role"))
        & (F.element_at(back, 1)["text"] == F.col("text")),
        F.lit(False),
    )


def format_chats(
    rows: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """``id_col, formatted, loss, layout``, one row per conversation.

    ``loss`` holds the code-point spans (end exclusive) in ``formatted`` of the loss role's texts,
    in order, as they are written there; ``layout`` says for every turn where it begins (``at``) and,
    for the loss role, the same span.
    """
    own = rows.select(
        F.col(id_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    plain = own.withColumn("plain", _written(F.col("role"), F.col("text"))).withColumn("is_plain", _same("plain"))
    written = (
        plain.withColumn("role_out", F.when(F.col("is_plain"), F.col("role")).otherwise(escape(F.col("role"), True)))
        .withColumn("text_out", F.when(F.col("is_plain"), F.col("text")).otherwise(escape(F.col("text"))))
        .withColumn(
            "segment", F.when(F.col("is_plain"), F.col("plain")).otherwise(_written(F.col("role_out"), F.col("text_out")))
        )
        .withColumn("n", F.char_length("segment").cast("long"))
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    placed = (
        written.withColumn("ord", F.row_number().over(order))
        .withColumn("at", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
        .withColumn("start", F.col("at") + F.char_length("role_out") + len(MARK) + 3)
    )
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.char_length("text_out")).alias("end"))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct("ord", "segment", F.when(F.col("role") == loss_role, span).alias("span"), "role", "text", "at")
            )
        ).alias("turns")
    )
    formatted = F.array_join(F.transform("turns", lambda t: t["segment"]), "")
    whole = whole.withColumn("formatted", formatted)
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    checked = F.when(F.coalesce(parse(F.col("formatted")) == source, F.lit(False)), F.col("formatted")).otherwise(
        F.raise_error(F.lit("a conversation does not parse back to its source"))
    )
    spans = F.transform(F.filter("turns", lambda t: t["span"].isNotNull()), lambda t: t["span"])
    layout = F.transform("turns", lambda t: F.struct(t["at"].alias("at"), t["span"].alias("span")))
    return whole.select(F.col("conv_id").alias(id_col), checked.alias("formatted"), spans.alias("loss"), layout.alias("layout"))


def masked(formatted: Column, layout: Column) -> Column:
    """The text under the loss mask of a formatted conversation, unescaped, texts end to end.

    The string is cut into its turns once and each span read in its own turn, so that a conversation
    takes time in proportion to its length.
    """
    parts = F.split(formatted, END + "\n", -1)
    cut = F.zip_with(
        F.slice(parts, F.lit(1), F.size(parts) - 1),
        layout,
        lambda part, t: F.substr(part, (t["span"]["start"] - t["at"]).cast("int") + 1, (t["span"]["end"] - t["span"]["start"]).cast("int")),
    )
    return F.array_join(F.transform(cut, unescape), "")


def parse_chats(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """``id_col, ord, role, text``: the turns of formatted conversations, ``ord`` from 0."""
    return formatted.select(id_col, F.posexplode(parse(F.col("formatted")))).select(
        id_col, F.col("pos").alias("ord"), "col.role", "col.text"
    )


EXTRA = r"\### Assistant: </turn> ok"


def op7_chat_formatting(spark, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA).alias("text"),
    )
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    out = format_chats(rows.unionByName(extra))
    back = out.withColumn("turns", parse(F.col("formatted"))).withColumn("lost", masked(F.col("formatted"), F.col("layout")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("lost").cast("long").alias("loss_chars"),
        F.sha2(F.col("lost").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
    SELECT *, len(regexp_extract_all(text, '\\')) + len(regexp_extract_all(text, '</turn>'))
              + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0) AS extra
    FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + length(text) + extra + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
