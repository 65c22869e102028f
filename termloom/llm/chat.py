"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events ``(conv_id, seq, turn, kind, role, text)``:

* ``message`` sets a turn's text (and drops the deltas it had),
* ``delta`` appends to it,
* ``edit`` sets it and discards every later turn as it stood,
* ``regenerate`` empties it, likewise, for the deltas that follow.

The fold needs no loop: a turn's text is the concatenation of its events from its last message, edit
or regeneration on, as far as they come after the last edit or regeneration of any earlier turn.
Both bounds are window maxima, so the log is exchanged once, by conversation, and sorted by sequence;
everything stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "edit", "regenerate", "delta")


def events_of(conversations: DataFrame) -> DataFrame:
    """A log for a table (conv_id, turn, role, text) of final messages, as a chat server would have written it.

    Assistant turns begin as a draft, are regenerated and stream in line by line; other turns are
    sent and then edited into their text.  Rows of the same conversation and turn are written one after
    the other, in the order of role and text, each with sequence numbers of its own.
    """
    c = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, draft = F.lit(None).cast("string"), F.substring_index("text", " ", 1)
    streamed = F.concat(
        F.array(event("message", F.col("role"), draft), event("regenerate", none, none)),
        F.transform(F.split("text", "(?<=\n)"), lambda x: event("delta", none, x)),
    )
    sent = F.array(event("message", F.col("role"), draft), event("edit", none, F.col("text")))
    log = F.when(F.col("role") == "assistant", streamed).otherwise(sent)
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    c = c.where("conv_id IS NOT NULL AND turn IS NOT NULL").withColumn("log", log)
    c = c.withColumn("base", F.coalesce(F.sum(F.size("log").cast("bigint")).over(before), F.lit(0)))
    return c.select("conv_id", "turn", "base", F.posexplode("log").alias("i", "e")).select("conv_id", (F.col("base") + F.col("i")).alias("seq"), "turn", "e.kind", "e.role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of the messages that stand at the end of each log.

    Rows with a null conv_id, seq or turn, and those of an unknown kind, are passed over; a null text
    is empty.  Rows that repeat an event in all columns are one event, delivered twice.  Other events
    with the same seq apply in the order message, edit, regenerate, delta, then by turn, role and
    text.  A message's role is the last that its turn's events name, ``user`` if none does.  A message
    may be empty; a turn that was discarded and not written again is absent.
    """
    kind = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    e = events.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("seq").cast("bigint").alias("seq"), F.col("turn").cast("bigint").alias("turn"),
        kind.alias("kind"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL AND seq IS NOT NULL AND turn IS NOT NULL AND kind > 0")
    order = ["seq", "kind", "turn", "role", "text"]
    log = Window.partitionBy("conv_id").orderBy(*order)
    same = F.struct(*order)
    e = e.withColumn("again", F.lag(same).over(log).eqNullSafe(same)).withColumn("n", F.row_number().over(log)).where("NOT again")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn")
    e = e.withColumn("cut", F.coalesce(F.max(F.when(F.col("kind").isin(2, 3), F.col("n"))).over(earlier), F.lit(0)))
    e = e.withColumn("base", F.coalesce(F.max(F.when(F.col("kind") < 4, F.col("n"))).over(own), F.lit(0)))
    live = (F.col("n") >= F.col("base")) & (F.col("n") > F.col("cut"))
    parts = F.array_sort(F.collect_list(F.when(live, F.struct("n", "text"))))
    role = F.max_by("role", F.when(F.col("role").isNotNull(), F.col("n")))
    return (
        e.groupBy("conv_id", "turn")
        .agg(F.coalesce(role, F.lit("user")).alias("role"), parts.alias("parts"))
        .where(F.size("parts") > 0)
        .select("conv_id", "turn", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_messages, n_chars, text): each conversation as one marked-up text, by turn.

    ``<|`` within a role or a text becomes ``< |``, so no text can pose as markup.
    """
    tame = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit(START), tame(F.col("role")), F.lit("\n"), tame(F.col("text")), F.lit(END + "\n"))
    all_lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return (
        messages.groupBy("conv_id")
        .agg(F.count("*").alias("n_messages"), F.array_join(F.transform(all_lines, lambda x: x["line"]), "").alias("text"))
        .select("conv_id", "n_messages", F.length("text").cast("bigint").alias("n_chars"), "text")
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """``render(fold(events_of(conversations)))``.

    Rows with a null conv_id or turn are passed over; a null text is empty, a null role ``user``.
    Rows of the same conversation and turn are versions of one message: the last by role (a null one
    first), then by text, stands, so rows that repeat count once.  Texts of any length are kept whole.  An
    empty table gives no rows; further columns are not read.
    """
    return render(fold(events_of(conversations)))


SQL = """
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_messages, CAST(sum(length(line)) AS BIGINT) AS n_chars,
       string_agg(line, '' ORDER BY turn) AS text
FROM (SELECT conv_id, turn, '<|im_start|>' || replace(coalesce(role, 'user'), '<|', '< |') || chr(10)
             || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS line
      FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role DESC NULLS LAST, coalesce(text, '') DESC) AS nth
            FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL) WHERE nth = 1) t
GROUP BY conv_id
"""
