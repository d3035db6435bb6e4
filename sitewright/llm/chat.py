r"""Chat formatting by a grammar round trip, with DataFrame functions only.

Grammar: ``conversation := turn*``, ``turn := "### " role ": " text "</turn>\n"``.
The parser splits at ``</turn>``, takes the role up to the first colon and
refuses a text that holds ``###``; it takes one backslash out of each
``#\..\#`` and ``<\..\/turn>``. Each turn is first rendered as it is and
parsed again; where the recovered turn differs from its source, its text is
escaped by one more backslash in those places and parsed again. As the escape
is injective the second round is always identical; a conversation that still
differs raises an error instead of leaving wrong output.

Results: null texts and roles are empty; turns sort by (turn, role, text), null
turns first; equal rows stay as turns of their own; a null conv_id is a
conversation of its own; an empty table gives an empty one; other columns are
ignored. A conversation is one output row, so it must fit a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "</turn>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"#(\\*)(?=#)", r"#\\$1")
    return F.regexp_replace(text, r"<(\\*)(?=/turn>)", r"<\\$1")


def unescape(text: Column) -> Column:
    text = F.regexp_replace(text, r"#\\(\\*)(?=#)", "#$1")
    return F.regexp_replace(text, r"<\\(\\*)(?=/turn>)", "<$1")


def _role_out(role: Column) -> Column:
    for raw, coded in (("\\", "\\s"), (":", "\\c"), ("\n", "\\n"), ("#", "\\h"), ("<", "\\l")):
        role = F.replace(role, F.lit(raw), F.lit(coded))
    return role


def _role_in(role: Column) -> Column:
    for coded, raw in (("\\l", "<"), ("\\h", "#"), ("\\n", "\n"), ("\\c", ":"), ("\\s", "\\")):
        role = F.replace(role, F.lit(coded), F.lit(raw))
    return role


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), _role_out(role), F.lit(": "), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns of rendered text as array<struct<role, text>>; a malformed block gives a null text."""
    blocks = F.slice(F.split(formatted, END), 1, F.size(F.split(formatted, END)) - 1)

    def turn(block: Column) -> Column:
        body = F.regexp_replace(block, r"^\n", "")
        colon = F.instr(body, ":")
        text = F.substring(body, colon + 2, F.length(body))
        good = body.startswith("### ") & ~F.contains(text, F.lit("###"))
        return F.struct(_role_in(F.substring(body, F.lit(5), colon - 5)).alias("role"), F.when(good, unescape(text)).alias("text"))

    return F.transform(blocks, turn)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row per conversation: formatted, loss_spans array<struct<start, end>> in code points, n_turns.

    A span holds an assistant turn's escaped text: from ``start``, before ``end``.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = parse(_render(F.col("role"), F.col("text"))).eqNullSafe(F.array(F.struct("role", "text")))
    rows = rows.withColumn("out", F.when(plain, F.col("text")).otherwise(escape(F.col("text"))))
    rows = rows.withColumn("block", _render(F.col("role"), F.col("out")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumns({
        "nth": F.row_number().over(order),
        "stop": F.sum(F.length("block").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - (len(END) + 1),
    })
    rows = rows.withColumn("start", F.col("stop") - F.length("out"))
    one = F.sort_array(F.collect_list(F.struct("nth", "block", "start", "stop", "role", "text")))
    rows = rows.groupBy("conv_id").agg(one.alias("all"))
    spans = F.transform(F.filter("all", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["start"].alias("start"), t["stop"].alias("end")))
    out = rows.select(
        "conv_id", F.size("all").cast("long").alias("n_turns"), F.concat_ws("", F.transform("all", lambda t: t["block"])).alias("formatted"),
        spans.alias("loss_spans"), F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"),
    )
    same = parse(F.col("formatted")).eqNullSafe(F.col("source"))
    return out.withColumn("formatted", F.when(same, F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation does not survive the round trip")))).drop("source")


def digests(turns: DataFrame) -> DataFrame:
    """What can be read back from the formatted conversations alone."""
    f = format_conversations(turns)
    f = f.withColumns({
        "back": parse(F.col("formatted")),
        "loss": F.concat_ws("", F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))),
    })
    said = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return f.select(
        "conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
