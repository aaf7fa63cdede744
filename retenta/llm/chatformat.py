"""Chat logs to formatted training text, and back.

A log has one event per row: conv_id, seq (order within the conversation),
message (which message of the conversation it is about), kind, role and text:

- ``open`` begins a message and gives its role;
- ``delta`` appends streamed text;
- ``edit`` replaces all the text that the message has so far;
- ``regenerate`` throws it away, new deltas follow.

Events of different messages may be interleaved. A message's text is folded from
its events in the order of seq. Everything before its last edit or regeneration can't
show in it, so those events go before any are gathered: a message that was
regenerated without end costs one aggregate, and what meets in a row is the final text alone.

The template writes ``<turn ROLE>TEXT</turn>`` and a line end for each turn. In roles
and texts a backslash becomes ``\\b``, ``<`` becomes ``\\l`` and ``>`` ``\\g``, so no control string can
occur in either, and every rendered turn can be read back exactly. Assistant texts are under the loss mask.

Nulls: null texts and roles are empty, rows without conv_id are one conversation;
equal turn numbers go by role, then text; repeated turns are turns of their own. A message without an
``open`` has an empty role. An empty log gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .turns import in_order, joined_sha256

#: The role under the loss mask, and the escapes of the template, in the order in which they are written.
LEARNED = "assistant"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g")]
#: Of the stand-in log: characters of a delta, and the seq numbers that one turn may take.
DELTA, SPAN = 200, 1 << 24
EVENTS = "conv_id long, seq long, message long, kind string, role string, text string"
#: The conversation that the query adds: its id, and what both its rows say.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def events_of(conversations: DataFrame) -> DataFrame:
    """A log that leads to the given turns: texts come in deltas; by hash, some turns are first drafted and
    regenerated, some edited right after the draft, some edited only after the next turn has begun."""
    turns = in_order(conversations).select("conv_id", "at", F.coalesce("role", F.lit("")).alias("role"),
                                           F.coalesce("text", F.lit("")).alias("text"))
    way = F.pmod(F.xxhash64("conv_id", "at"), F.lit(5))
    draft = F.concat(F.lit("draft "), F.substring("text", 1, DELTA))

    def event(kind: str, text: Column, role: Column | None = None, late: int = 0) -> Column:
        return F.struct(F.lit(kind).alias("kind"), (role if role is not None else F.lit(None).cast("string")).alias("role"),
                        text.cast("string").alias("text"), F.lit(late).alias("late"))

    def deltas(text: Column) -> Column:
        return F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda piece: event("delta", piece))

    none, opened = F.lit(None), F.array(event("open", F.lit(None), F.col("role")))
    told = (F.when(way == 0, F.concat(opened, F.array(event("delta", draft), event("regenerate", none)), deltas(F.col("text"))))
            .when(way == 1, F.concat(opened, F.array(event("delta", draft), event("edit", F.col("text")))))
            .when(way == 2, F.concat(opened, F.array(event("delta", draft), event("edit", F.col("text"), late=SPAN + SPAN // 2))))
            .otherwise(F.concat(opened, deltas(F.col("text")))))
    seq = F.col("at") * SPAN + F.col("step") + F.col("e.late")
    return (turns.select("conv_id", "at", F.posexplode(told).alias("step", "e"))
            .select("conv_id", seq.alias("seq"), F.col("at").alias("message"), "e.kind", "e.role", "e.text"))


def folded(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, at = seq of the first event, role, text) of a log."""
    log = written(events.select("conv_id", "seq", "message", "kind", "role", "text"), "events")
    resets = F.col("kind").isin("edit", "regenerate")
    heads = log.groupBy("conv_id", "message").agg(
        F.min("seq").alias("at"), F.max(F.when(resets, F.col("seq"))).alias("since"),
        F.min_by("role", F.when(F.col("kind") == "open", F.col("seq"))).alias("role"))
    heads = written(heads, "messages")
    same = F.col("e.conv_id").eqNullSafe(F.col("h.conv_id")) & F.col("e.message").eqNullSafe(F.col("h.message"))
    live = (log.filter("kind <> 'open' and text is not null").alias("e")
            .join(heads.filter("since is not null").alias("h"), same, "left")
            .filter("h.since is null or e.seq >= h.since").select("e.conv_id", "e.message", "e.seq", "e.text"))
    texts = live.groupBy("conv_id", "message").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    same = F.col("h.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("h.message").eqNullSafe(F.col("t.message"))
    return heads.alias("h").join(texts.alias("t"), same, "left").select(
        "h.conv_id", "h.at", F.coalesce("h.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def rendered(messages: DataFrame) -> DataFrame:
    """Each message as a piece of its conversation's formatted text, in the order of ``at``, with the loss mask: the
    characters ``loss_from`` (from 0) to ``loss_to`` (exclusive) of the piece."""
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    piece = F.concat(F.lit("<turn "), role, F.lit(">"), text, F.lit("</turn>\n"))
    begin = F.length(role) + len("<turn ") + 1
    end = begin + F.when(F.col("role") == LEARNED, F.length(text)).otherwise(0)
    return messages.select("conv_id", "at", piece.alias("piece"), begin.alias("loss_from"), end.alias("loss_to"))


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, at, role, text and ``loss`` (the text under the mask, null if none) from rendered pieces alone."""
    masked = F.when(F.col("loss_to") > F.col("loss_from"), F.substring("piece", F.col("loss_from") + 1, F.col("loss_to") - F.col("loss_from")))
    inside = F.split(F.expr("substring(piece, 7, length(piece) - 14)"), ">", 2)   # between "<turn " and "</turn>\\n"
    return pieces.select("conv_id", "at", unescaped(inside[0]).alias("role"), unescaped(inside[1]).alias("text"), unescaped(masked).alias("loss"), F.length("piece").alias("chars"))


def report(conversations: DataFrame) -> DataFrame:
    """All conversations and the added one through log, fold and template, and what reading the result back gives."""
    extra = conversations.sparkSession.createDataFrame(
        [(EXTRA_ID, i, role, EXTRA_TEXT) for i, role in enumerate(("user", LEARNED))], "conv_id long, turn long, role string, text string")
    turns = conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    pieces = written(rendered(folded(events_of(turns))), "formatted")
    back = written(read_back(pieces), "read-back")
    counts = back.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.coalesce(F.sum(F.length("loss")), F.lit(0)).cast("long").alias("loss_chars"),
                                         F.sum("chars").cast("long").alias("formatted_chars"))
    whole = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    turns_sha = joined_sha256(back, ["conv_id"], ["at"], whole, "", "turns_sha256")
    loss_sha = joined_sha256(back, ["conv_id"], ["at"], F.col("loss"), "", "loss_sha256")
    for part in (turns_sha, loss_sha):
        part = part.withColumnRenamed("conv_id", "c")
        counts = counts.join(part, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return counts.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
