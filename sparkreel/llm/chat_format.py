"""Chat formatting: conversations rebuilt from event logs, then rendered with a loss mask.

Method: event-sourced reconstruction. A log has one row per event: ``conv_id``,
``seq``, ``turn``, ``role``, ``kind`` and ``text``. Events are partitioned by
conversation, sorted by sequence and folded: ``message`` starts a turn,
``delta`` appends to it, ``edit`` replaces what the turn says so far, and
``regenerate`` starts the turn anew and drops all later turns written before
it. The final messages are rendered in turn order.

Only built-in functions: nothing here runs Python on the executors. The fold is
made of window functions that sort and spill within one partitioning by
conversation, so the whole operator shuffles the log once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template. A turn is OPEN role BODY text CLOSE.
OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    r"""``text`` without any ``<``: a backslash becomes ``\b`` and ``<`` becomes ``\l``, so no control string can occur."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    """The inverse of ``escaped``."""
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def as_events(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows as a log with one ``message`` per row. Rows of one turn follow each other by role and text."""
    return turns.select(
        "conv_id", F.col("turn").alias("seq"), "turn", "role", F.lit("message").alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
    )


def rebuilt(log: DataFrame) -> DataFrame:
    """The final messages of a log: conv_id, turn, pos, role, text.

    Null roles and texts count as empty, unknown kinds as ``message``, null turns come first, events of one sequence
    number are taken by kind, role and text. Each ``message`` is a message of its own: where one turn has several they
    all stay, in order (``pos``); the other kinds act on the turn's newest message, and a ``delta`` or ``edit`` without one starts it. A
    ``regenerate`` at sequence s drops the messages of its turn and the events of later turns that came before s. Other columns are not read.
    """
    e = log.select(
        "conv_id", "seq", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"),
    )
    e = e.withColumn("kind", F.when(F.col("kind").isin("delta", "edit", "regenerate"), F.col("kind")).otherwise("message"))
    redo = F.when(F.col("kind") == "regenerate", F.col("seq"))
    own = W.partitionBy("conv_id", "turn")
    earlier = W.partitionBy("conv_id").orderBy("turn").rangeBetween(W.unboundedPreceding, -1)
    # one shuffle serves all windows and groups: each has conv_id among its keys
    e = e.repartition("conv_id").withColumns({"own_redo": F.max(redo).over(own), "past_redo": F.max(redo).over(earlier)})
    e = e.filter(
        (F.col("own_redo").isNull() | (F.col("seq") >= F.col("own_redo")))
        & (F.col("past_redo").isNull() | (F.col("seq") > F.col("past_redo")))
    )
    order = [F.col("seq").asc_nulls_first(), "kind", "role", "text"]
    so_far = own.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = F.when(F.col("kind").isin("message", "regenerate") | (F.row_number().over(own.orderBy(*order)) == 1), 1).otherwise(0)
    e = e.withColumn("starts", starts).withColumn("pos", F.sum("starts").over(so_far))
    e = e.withColumn("n", F.row_number().over(own.orderBy(*order)))
    parts = e.groupBy("conv_id", "turn", "pos").agg(
        F.min_by("role", "n").alias("role"),
        F.max(F.when(F.col("kind") != "delta", F.col("n"))).alias("reset"),
        F.sort_array(F.collect_list(F.struct("n", "text"))).alias("parts"),
    )
    kept = F.filter("parts", lambda p: F.col("reset").isNull() | (p["n"] >= F.col("reset")))
    return parts.select("conv_id", "turn", "pos", "role", F.array_join(F.transform(kept, lambda p: p["text"]), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, role, text) as one row per conversation: conv_id, formatted, loss.

    ``loss`` is the loss mask: spans struct<start, end> of code points of ``formatted``, the escaped text of each
    assistant message. A conversation is one training example, so its turns come together in one row.
    """
    turn = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(BODY), escaped(F.col("text")), F.lit(CLOSE))
    m = messages.select(
        "conv_id",
        F.struct(
            "turn", "pos", F.col("role"), turn.alias("out"), (F.col("role") == LOSS_ROLE).alias("loss"),
            (F.length(escaped(F.col("role"))) + len(OPEN) + len(BODY)).alias("head"), F.length(turn).alias("chars"),
        ).alias("m"),
    )
    m = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("m"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + x["chars"]).alias("at"),
        F.when(x["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["head"]).alias("start"), (acc["at"] + x["chars"] - len(CLOSE)).alias("end")))))
        .otherwise(acc["spans"]).alias("spans"),
    )
    return m.select(
        "conv_id",
        F.array_join(F.transform("m", lambda x: x["out"]), "").alias("formatted"),
        F.aggregate("m", zero, step, lambda acc: acc["spans"]).alias("loss"),
    )


def read_back(formatted: Column) -> Column:
    """The messages, array<struct<role, text>>, that ``formatted`` holds."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    body = lambda p: F.locate(BODY, p)
    return F.transform(parts, lambda p: F.struct(
        unescaped(F.substring(p, F.lit(len(OPEN) + 1), body(p) - len(OPEN) - 1)).alias("role"),
        unescaped(F.substring(p, body(p) + len(BODY), F.length(p))).alias("text"),
    ))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
