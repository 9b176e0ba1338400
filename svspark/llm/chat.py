"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events (conv_id, seq, message, kind, role, text).  For each message, events in
order of seq are folded: ``start`` sets role and text, ``delta`` appends, ``edit``
replaces the text, ``regenerate`` empties it for the deltas that follow, ``delete``
removes the message until a later ``start`` or ``regenerate``.  Messages are folded and rendered one by one (a task holds one
message's events), and a conversation only joins its rendered messages.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts and roles a control string gets
one backslash more after its first character, whatever number it has there; so
taking one away restores the text, and no text can hold a control string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may follow the first character of a control string.
CONTROLS = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\])"
OPEN, MID, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROLS, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROLS, r"$1$2$3")


def _role(role: Column) -> Column:
    """Roles hold no line end when rendered."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    """Pairs of backslashes are found from the left, so no stand-in character is needed."""
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of finished rows (conv_id, turn, role, text): a start and a delta for each row."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("tie")).alias("message"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    start = rows.groupBy("conv_id", "message").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    copies = start.select("conv_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "message", "text")
    message = F.struct("message.turn", "message.role", "message.tie", "copy")
    event = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("start").alias("kind"), F.lit("").alias("text")), F.struct(F.lit(1).alias("part"), F.lit("delta").alias("kind"), F.col("text"))))
    log = copies.select("conv_id", message.alias("message"), F.col("message.role").alias("role"), event.alias("e"))
    return log.select("conv_id", F.col("e.part").alias("seq"), "message", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log.

    Ties in seq are folded in the order start, regenerate, edit, delta, delete, then by text; a null text is empty;
    an unknown kind changes nothing; a message without a start keeps the role of its first event.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, ("start", "regenerate", "edit", "delta", "delete"))), F.col("kind")), F.lit(0))
    event = F.struct("seq", rank.alias("rank"), F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    logs = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))

    def turn(state: Column, e: Column) -> Column:
        starts = e["kind"] == "start"
        parts = F.when(starts | (e["kind"] == "edit"), F.array(e["text"])).when(e["kind"] == "regenerate", F.array().cast("array<string>")).when(e["kind"] == "delta", F.concat(state["parts"], F.array(e["text"]))).otherwise(state["parts"])
        alive = F.when(e["kind"] == "delete", F.lit(False)).when(starts | (e["kind"] == "regenerate"), F.lit(True)).otherwise(state["alive"])
        return F.struct(F.when(starts | state["role"].isNull(), e["role"]).otherwise(state["role"]).alias("role"), parts.alias("parts"), alive.alias("alive"))

    empty = F.struct(F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("parts"), F.lit(True).alias("alive"))
    done = logs.select("conv_id", "message", F.aggregate("log", empty, turn).alias("m"))
    return done.where("m.alive").select("conv_id", "message", F.col("m.role").alias("role"), F.array_join("m.parts", "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans (start, length) in characters of the texts of ``loss_role``."""
    shown = messages.select(
        "conv_id",
        "message",
        F.concat(F.lit(OPEN), _role(F.col("role")), F.lit(MID)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == loss_role).alias("loss"),
    )
    piece = F.struct("message", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.length("head").alias("skip"), F.length("body").alias("n"), "loss")
    whole = shown.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))

    def place(state: Column, p: Column) -> Column:
        spans = F.when(p["loss"], F.concat(state["spans"], F.array(F.struct((state["at"] + p["skip"]).alias("start"), p["n"].alias("length"))))).otherwise(state["spans"])
        return F.struct((state["at"] + F.length(p["piece"])).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), F.aggregate("pieces", zero, place)["spans"].alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """Read turns and loss texts back from (conv_id, formatted, loss_spans): (conv_id, turns, loss_text)."""
    pieces = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda p: p != "")
    bodies = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, F.length(p)))

    turns = F.transform(bodies, lambda b: F.struct(_role_back(F.substring_index(b, MID, 1)).alias("role"), unescape(F.substring(b, F.length(F.substring_index(b, MID, 1)) + 2, F.length(b))).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formatted conversations (conv_id, formatted, loss_spans) of an event log.

    Defined cases: null texts and roles are empty; equal rows are separate turns; a null conv_id is one
    conversation; an empty log gives no rows; other columns are ignored.
    """
    return render(fold(events), loss_role)
