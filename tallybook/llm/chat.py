"""Chat formatting from an event log, in DataFrame functions only.

Events are (conv_id, seq, message, kind, role, text). Folded in order of `seq`: a `delta` appends its
text to the message, an `edit` replaces what the message held, a `regenerate` discards the message
and all later ones seen so far, to be built anew by what follows. The fold is expressed by what
comes later in the log: an event counts unless a later regenerate names its message or an earlier
one, or a later edit its own. So no state grows along a conversation: windows sort and spill.

Rendering: ``<role>``, a line break, the text, a line break, ``</turn>``, a line break. In roles and
texts ``\\ < > #`` are written ``\\b \\l \\g \\h``, so no text can hold a control string and the way
back is exact. Each turn carries its place in the output and the part under the loss mask (the text
of assistant turns). One output row is one conversation, the unit a trainer reads.

Defined cases: null text and null role are empty; null `conv_id` is a conversation of its own; a
null `seq` comes first; events equal in sequence number are ordered by message, kind, role, text;
an event repeated in every column is a redelivery and counts once; a conversation whose messages
were all discarded gives no row; an empty log gives none; other columns are not read. In a table of
finished turns every row is a turn: ties and repeats count, and a null turn comes last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.session import store

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"), ("#", "\\h"))
END = "\n</turn>\n"
ORDER = ("seq", "message", "kind", "role", "text")


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as a log: one delta for each row, a message of its own.

    Rows are in order of turn (null last), role and text, so tied turns stay apart; a repeated row
    is a turn as well, not a redelivery.
    """
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_last("turn"), "role", "text")
    place = F.row_number().over(order).cast("long")
    return conversations.select(
        "conv_id", place.alias("seq"), place.alias("message"), F.lit("delta").alias("kind"), "role", "text"
    )


def service_log(turns: DataFrame) -> DataFrame:
    """The log a chat service would have left of finished turns (as of `events_of`); it folds back to them.

    Each text is streamed in up to three deltas. Before every third turn the message holds a draft
    that an edit replaces; before every second answer stands another answer, with a message after
    it, that a regeneration discards; the first piece of every fifth turn is delivered twice. Rows of
    a turn leave in descending order of `seq`.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length("body") / 3).cast("int")
    turns = turns.select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), text.alias("body"),
        (F.col("seq") * 16).alias("base"),
    )
    edited = F.col("message") % 3 == 0
    again = (F.col("role") == "assistant") & (F.col("message") % 2 == 0)
    twice = F.col("message") % 5 == 0

    def event(place: int, kind: Column | str, text: Column, where: Column, message: Column | None = None) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        made = F.struct(
            (F.col("base") + place).alias("seq"), (F.col("message") if message is None else message).alias("message"),
            kind.alias("kind"), F.col("role").alias("role"), text.alias("text"),
        )
        return F.when(where, made)

    piece = [
        F.substring("body", F.lit(1), third), F.substring("body", third + 1, third),
        F.substring("body", third * 2 + 1, F.length("body")),
    ]
    draft = F.concat(F.lit("(draft) "), piece[0])
    first = event(8, F.when(edited, F.lit("edit")).otherwise(F.lit("delta")), piece[0], F.lit(True))
    events = F.array(
        event(10, "delta", piece[2], piece[2] != ""), event(9, "delta", piece[1], piece[1] != ""),
        first, F.when(twice, first),
        event(6, "delta", draft, edited),
        event(4, "regenerate", F.lit(""), again),
        event(3, "delta", draft, again, F.col("message") + 1),
        event(2, "delta", draft, again),
    )
    return turns.select("conv_id", F.explode(F.array_compact(events)).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """Final messages: (conv_id, message, role, text)."""
    events = events.select(
        "conv_id", "seq", "message", "kind",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    latest_first = Window.partitionBy("conv_id").orderBy(*[F.desc_nulls_last(c) for c in ORDER])
    later = latest_first.rowsBetween(Window.unboundedPreceding, -1)
    same = F.lag(F.struct(*ORDER)).over(latest_first).eqNullSafe(F.struct(*ORDER))
    discarded_from = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    marked = events.select("*", discarded_from.alias("cut"), F.coalesce(same, F.lit(False)).alias("again"))
    live = marked.where(
        (F.col("kind") != "regenerate") & ~F.col("again") & F.coalesce(F.col("message") < F.col("cut"), F.lit(True))
    )
    later_in_message = (
        Window.partitionBy("conv_id", "message")
        .orderBy(*[F.desc_nulls_last(c) for c in ORDER])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    live = live.withColumn("edits", F.count(F.when(F.col("kind") == "edit", 1)).over(later_in_message)).where("edits = 0")
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text")))
    return (
        live.groupBy("conv_id", "message")
        .agg(parts.alias("parts"))
        .select(
            "conv_id", "message", F.col("parts")[0]["role"].alias("role"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the output and, per turn, start, loss_start, loss_end in code points."""
    head = F.concat(F.lit("<"), escape(F.col("role")), F.lit(">\n"))
    body = escape(F.col("text"))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body")).select(
        "conv_id", "message", "role", F.concat("head", "body", F.lit(END)).alias("rendered"),
        F.length("head").alias("head_chars"), F.length("body").alias("body_chars"),
    )
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("message")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("rendered").cast("long")).over(before), F.lit(0).cast("long"))
    loss = F.when(F.col("role") == "assistant", F.col("body_chars")).otherwise(0)
    placed = turns.withColumn("start", start).select(
        "conv_id",
        F.struct(
            "message", "rendered", "start",
            (F.col("start") + F.col("head_chars")).alias("loss_start"),
            (F.col("start") + F.col("head_chars") + loss).alias("loss_end"),
        ).alias("turn"),
    )
    return (
        placed.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("turn")).alias("turns"))
        .select(
            "conv_id",
            F.array_join(F.transform("turns", lambda t: t["rendered"]), "").alias("formatted"),
            F.transform(
                "turns",
                lambda t: F.struct(
                    t["start"].alias("start"), t["loss_start"].alias("loss_start"), t["loss_end"].alias("loss_end")
                ),
            ).alias("turns"),
        )
    )


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def parse(formatted: DataFrame) -> DataFrame:
    """Turns read back from the output: (conv_id, position, role, text, loss_text)."""
    pieces = F.split("formatted", END)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    turns = formatted.select("conv_id", F.posexplode(F.arrays_zip(pieces.alias("piece"), F.col("turns").alias("at"))))
    piece, at = F.col("col.piece"), F.col("col.at")
    head = F.instr(piece, ">\n")
    masked = F.substring(piece, (at["loss_start"] - at["start"] + 1).cast("int"), (at["loss_end"] - at["loss_start"]).cast("int"))
    return turns.select(
        "conv_id", F.col("pos").alias("position"),
        unescape(F.substring(piece, F.lit(2), head - 2)).alias("role"),
        unescape(F.substring(piece, head + 2, F.length(piece))).alias("text"),
        unescape(masked).alias("loss_text"),
    )


PLANTED = "\\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    extra = spark.createDataFrame(
        [(-7, 0, "user", PLANTED), (-7, 1, "assistant", PLANTED)], "conv_id long, turn long, role string, text string"
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = store(format_chats(service_log(events_of(rows))), "chats")
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    back = (
        parse(out)
        .groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("position", line.alias("line"), "loss_text"))).alias("t"),
            F.sum(F.length("loss_text")).alias("loss_chars"), F.count("*").alias("n_turns"),
        )
        .select(
            F.col("conv_id").alias("id"), "n_turns",
            F.sha2(F.array_join(F.transform("t", lambda x: x["line"]), ""), 256).alias("turns_sha256"),
            "loss_chars",
            F.sha2(F.array_join(F.transform("t", lambda x: x["loss_text"]), ""), 256).alias("loss_sha256"),
        )
    )
    sizes = out.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"))
    return back.join(sizes, back["id"].eqNullSafe(sizes["conv_id"])).drop("id")


SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\\### Assistant: </turn> ok'),
                                  (-7, 1, 'assistant', '\\### Assistant: </turn> ok')) v(conv_id, turn, role, text))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + 2 * length(role || text) - length(translate(role || text, '\\<>#', '')))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
