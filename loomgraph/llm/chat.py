"""Chat formatting from an event log, with DataFrame functions only.

A log row is an event on one turn of one conversation: ``message`` (the turn's first text, with its
role), ``delta`` (text appended), ``edit`` (the text so far replaced) or ``regenerate`` (the text so
far dropped; later deltas build it anew, its own text first). The log is partitioned by conversation
once; everything after uses that partitioning. Folding takes, for each turn, the last event that
resets its text, and joins that event's text and the later deltas in order of ``seq``.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In texts and roles ``&``,
``<`` and ``[`` are written ``&amp; &lt; &#91;`` (in roles also the newline, ``&#10;``), so no control
string of this or any bracketed template can come from a text, and the text is read back exactly.

One conversation is one output string, so its turns do meet in one row; nothing else is gathered. Places of
turns are running sums of a window, and a text is split once to be read back, so a long conversation
costs no more for each of its turns than a short one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import parallelism

START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def rows_to_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one ``message`` each, with the turn as sequence."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, role, text)`` of a log ``(conv_id, turn, seq, kind, role, text)``.

    Null texts add nothing; a null role is taken from the turn's other events, else empty; rows of
    unknown or null kind count as deltas. Several ``message`` events of one turn stand as messages of
    their own (repeated rows are repeated turns), ordered by seq, role and text; deltas, edits and
    regenerations belong to the message before them in seq, or open one if there is none. Null
    conversations form one conversation. Other columns are ignored; an empty log gives no rows.
    """
    e = events.select("conv_id", "turn", "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    e = e.repartition(parallelism(events.sparkSession), "conv_id")
    rank = F.when(F.col("kind") == "message", 0).otherwise(1)
    order = [F.col("seq").asc_nulls_first(), rank, F.col("role").asc_nulls_first(), "text"]
    upto = Window.partitionBy("conv_id", "turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = Window.partitionBy("conv_id", "turn").orderBy(*order)
    e = e.withColumn("at", F.row_number().over(place)).withColumn("message", F.sum((F.col("kind") == "message").cast("int")).over(upto))
    whole = Window.partitionBy("conv_id", "turn", "message")
    reset = F.max(F.when(F.col("kind").isin("message", "edit", "regenerate"), F.col("at"))).over(whole)
    e = e.withColumn("reset", F.coalesce(reset, F.lit(0))).withColumn("who", F.coalesce(F.max("role").over(whole), F.lit("")))
    e = e.where(F.col("at") >= F.col("reset"))
    parts = F.sort_array(F.collect_list(F.struct("at", "text")))
    return e.groupBy("conv_id", "turn", "message").agg(F.first("who").alias("role"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id, formatted`` and ``loss_spans``, the code-point ranges
    ``(start, length)`` of ``formatted`` that hold the texts of ``loss_role``, each also as the number of its
    turn (from 0) and the place ``at`` in what follows that turn's opening mark, so that a reader who has
    split the text need not count from its start again."""
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("&#10;"))
    m = messages.select("conv_id", "turn", "message", role.alias("r"), escaped(F.col("text")).alias("t"), (F.col("role") == loss_role).alias("loss"))
    m = m.withColumn("size", (F.length("r") + F.length("t") + len(START) + len(END) + 1).cast("long"))
    order = Window.partitionBy("conv_id").orderBy("turn", "message", "r", "t", "loss")
    m = m.withColumn("no", F.row_number().over(order) - 1).withColumn("head", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    turns = F.sort_array(F.collect_list(F.struct("no", "r", "t", "loss", "head")))
    c = m.groupBy("conv_id").agg(turns.alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(F.lit(START), x["r"], F.lit("\n"), x["t"], F.lit(END))), "")
    own = F.filter("turns", lambda x: x["loss"])
    spans = F.transform(own, lambda x: F.struct((x["head"] + len(START) + F.length(x["r"]) + 1).alias("start"), F.length(x["t"]).cast("long").alias("length"), x["no"].alias("turn"), (F.length(x["r"]) + 1).alias("at")))
    return c.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def _shown(formatted: Column) -> Column:
    """What follows each turn's opening mark."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>")))


def parse(formatted: Column) -> Column:
    """The turns ``array<struct<role, text>>`` that a formatted conversation holds."""
    shown = _shown(formatted)
    role = lambda x: F.substring_index(x, "\n", 1)
    body = lambda x: F.substr(x, F.length(role(x)) + 2, F.length(x) - F.length(role(x)) - 1 - len(END))
    return F.transform(shown, lambda x: F.struct(unescaped(F.replace(role(x), F.lit("&#10;"), F.lit("\n"))).alias("role"), unescaped(body(x)).alias("text")))


def digest(rendered: DataFrame) -> DataFrame:
    """What can be read back from the rendered text alone, and from its loss mask."""
    turns = rendered.select("conv_id", "formatted", "loss_spans", _shown(F.col("formatted")).alias("shown"))
    turns = turns.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.transform("loss_spans", lambda s: unescaped(F.substr(F.get("shown", s["turn"]), s["at"] + 1, s["length"].cast("int")))).alias("learned"))
    learned = F.array_join("learned", "")
    return turns.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
