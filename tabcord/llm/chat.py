"""Chat formatting in DataFrame expressions: one text per conversation, with a loss mask.

The turns of a conversation are collected as structs and sorted; neighbours of
one role become one block, whose texts are parted by a mark; blocks are
concatenated.  A text cannot imitate a mark: every ``<``, backslashes, ``|`` in
it gets one backslash more, so escaped texts never hold ``<|``, and taking one
away again gives the text back.  :func:`read_back` undoes the whole format.

Conversations of more than :data:`LONG` turns are not collected whole: their
turns are sorted across tasks, stored, and cut into segments by the place of a
row in the stored files, so a conversation that holds a third of all rows (or
all rows without an id) is formatted by many tasks.  A cut does not show: a
segment that begins inside a block goes on with it, and names its role in
``inside``, so the texts of the segments, one after the other, are the text that
one task would have made of the conversation.

Defined results.  Null texts and roles count as empty; a null conversation id is
a conversation; turns are ordered by turn (null first), role and text, so ties
and repeated rows have one order and all are kept.  An empty table gives no rows.  Long texts are
kept whole: a task holds one segment.  Other columns of the table are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import materialise

START, END, AND, LINE = "<|im_start|>", "<|im_end|>\n", "<|im_and|>", "<|im_line|>"

#: The role whose texts are learned.
LEARNED = "assistant"
#: Turns above which a conversation is cut into segments, and turns of a segment.
LONG, SEGMENT = 4096, 512
#: Most long conversations that are sent to every task; more are found by a join of both tables.
SENT = 100_000


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*+)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*+)\|", "<$1|")


def _role_out(role: Column) -> Column:
    """A role as it stands in the first line of a block."""
    return F.replace(escaped(role), F.lit("\n"), F.lit(LINE))


def _role_in(line: Column) -> Column:
    return unescaped(F.replace(line, F.lit(LINE), F.lit("\n")))


def blocks_of(turns: Column) -> Column:
    """Runs of one role in an array of (role, text): (role, array of texts)."""
    n = F.size(turns)
    starts = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda i: (i == 0) | (F.get(turns, i)["role"] != F.get(turns, i - 1)["role"]),
    )
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(n))
    return F.zip_with(
        starts,
        F.slice(ends, -F.size(starts), F.size(starts)),
        lambda a, b: F.struct(
            F.get(turns, a)["role"].alias("role"),
            F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("texts"),
        ),
    )


def _spans(blocks: Column, goes_on: Column) -> Column:
    """Where the learned texts stand: (start, length) in code points, from 0.

    If a segment goes on with a block, its text begins with a mark instead of a head.
    """
    kind = "struct<at:bigint,found:array<struct<start:bigint,length:bigint>>>"

    def text(state: Column, size: Column, learned: Column) -> Column:
        span = F.struct(state["at"].alias("start"), size.cast("long").alias("length"))
        found = F.when(learned, F.concat(state["found"], F.array(span))).otherwise(state["found"])
        at = state["at"] + size + len(AND)
        return F.struct(at.alias("at"), found.alias("found")).cast(kind)

    def block(state: Column, b: Column) -> Column:
        head = state["at"] + len(START) + F.length(b["role"]) + 1
        opened = F.struct(head.alias("at"), state["found"].alias("found")).cast(kind)
        learned = b["role"] == LEARNED
        done = F.aggregate(b["texts"], opened, lambda s, t: text(s, F.length(t), learned))
        at = done["at"] - len(AND) + len(END)
        return F.struct(at.alias("at"), done["found"].alias("found")).cast(kind)

    # the head of the first block is counted by block(), so that of an open one is taken off here
    unheaded = len(AND) - len(START) - 1 - F.length(F.get(blocks, F.lit(0))["role"])
    nothing = F.struct(
        F.when(goes_on, unheaded).otherwise(0).cast("long").alias("at"),
        F.array().cast("array<struct<start:bigint,length:bigint>>").alias("found"),
    ).cast(kind)
    return F.aggregate(blocks, nothing, block)["found"]


def render(segments: DataFrame) -> DataFrame:
    """Segments with sorted ``turns`` (escaped) to their ``text`` and ``loss`` spans.

    ``before`` and ``after`` are the roles of the turns beside the segment (null:
    none); a block that reaches over the border is opened and ended once.
    """
    merged = segments.withColumn("blocks", blocks_of(F.col("turns")))
    size, none = F.size("blocks"), F.lit(False)
    goes_on = F.coalesce(F.get("blocks", F.lit(0))["role"] == F.col("before"), none)
    stays_open = F.coalesce(F.get("blocks", size - 1)["role"] == F.col("after"), none)
    body = F.transform(
        "blocks",
        lambda b, i: F.concat(
            F.when((i == 0) & goes_on, AND).otherwise(F.concat(F.lit(START), b["role"], F.lit("\n"))),
            F.array_join(b["texts"], AND),
            F.when((i == size - 1) & stays_open, "").otherwise(END),
        ),
    )
    return merged.select(
        "conv_id",
        "segment",
        "whole",
        F.when(goes_on, F.col("before")).alias("inside"),
        F.size("turns").cast("long").alias("n_turns"),
        (size - goes_on.cast("int")).cast("long").alias("n_blocks"),
        F.array_join(body, "").alias("text"),
        _spans(F.col("blocks"), goes_on).alias("loss"),
    )


def _cut(rows: DataFrame) -> DataFrame:
    """Segments of long conversations, from their rows in order over many files."""
    keys = ("conv_id", "turn", "role", "text")
    stored = materialise(rows.repartitionByRange(*keys).sortWithinPartitions(*keys), "long_turns")
    name = F.col("_metadata.file_name")
    part, piece = (F.regexp_extract(name, r"^part-(\d+).*?(?:-c(\d+))?\.", i) for i in (1, 2))
    placed = stored.select(
        "conv_id",
        "role",
        "text",
        F.col("_metadata.row_index").alias("place"),
        part.cast("long").alias("part"),
        F.coalesce(piece.try_cast("long"), F.lit(0)).alias("piece"),
    )
    order = F.struct("part", "piece", F.floor(F.col("place") / SEGMENT).alias("number"))
    placed = placed.withColumn("segment", order)
    # one row per segment tells its neighbours where a block goes on
    ends = placed.groupBy("conv_id", "segment").agg(
        F.min_by("role", "place").alias("first"), F.max_by("role", "place").alias("last")
    )
    beside = Window.partitionBy("conv_id").orderBy("segment")
    borders = ends.select(
        "conv_id",
        "segment",
        F.lag("last").over(beside).alias("before"),
        F.lead("first").over(beside).alias("after"),
    )
    turn = F.struct("place", "role", "text")
    found = (
        placed.select("conv_id", "segment", turn.alias("turn"))
        .unionByName(borders, allowMissingColumns=True)
        .groupBy("conv_id", "segment")
        .agg(
            F.sort_array(F.collect_list("turn")).alias("turns"),
            F.max("before").alias("before"),
            F.max("after").alias("after"),
        )
    )
    return found.select(
        "conv_id",
        "segment",
        F.lit(False).alias("whole"),
        "before",
        "after",
        F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"),
    )


def format_chats(
    conversations: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    long: int = LONG,
) -> DataFrame:
    """Formatted segments: conv_id, segment (their order), whole, inside, n_turns, n_blocks, text, loss.

    A conversation of at most ``long`` turns is one segment, marked ``whole``.
    ``loss`` has the (start, length) of each learned text inside ``text``;
    ``n_blocks`` counts the blocks that begin there.  How a conversation is cut
    changes neither its texts, put together, nor its counts.
    """

    def own(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    empty = F.lit("")
    rows = conversations.select(
        own(conv_col).alias("conv_id"),
        own(turn_col).alias("turn"),
        _role_out(F.coalesce(own(role_col), empty)).alias("role"),
        escaped(F.coalesce(own(text_col), empty)).alias("text"),
    )
    sizes = conversations.groupBy(own(conv_col).alias("long_id")).agg(F.count(F.lit(1)).alias("n"))
    many = materialise(sizes.where(F.col("n") > long).select("long_id"), "long_conversations")
    n_many = many.count()
    if 0 < n_many <= SENT:
        many = F.broadcast(many)
    same = F.col("conv_id").eqNullSafe(F.col("long_id"))
    light = rows.join(many, same, "left_anti") if n_many else rows
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    first = F.struct(*(F.lit(0).cast("long").alias(c) for c in ("part", "piece", "number")))
    segments = (
        light.groupBy("conv_id")
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            first.alias("segment"),
            F.lit(True).alias("whole"),
            F.lit(None).cast("string").alias("before"),
            F.lit(None).cast("string").alias("after"),
            F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns"),
        )
    )
    if n_many:
        segments = segments.unionByName(_cut(rows.join(many, same, "left_semi")))
    return render(segments)


def read_back(formatted: DataFrame) -> DataFrame:
    """Add ``turns`` (role, text) parsed from ``text``, and ``learned``: the texts under the mask."""

    def said(line: Column, body: Column) -> Column:
        # no text ends like a block: the marks are escaped in it
        ended = F.endswith(body, F.lit(END))
        body = F.substr(body, F.lit(1), F.length(body) - F.when(ended, len(END)).otherwise(0))
        return F.transform(
            F.split(body, AND.replace("|", r"\|"), -1),
            lambda t: F.struct(_role_in(line).alias("role"), unescaped(t).alias("text")),
        )

    def block(part: Column) -> Column:
        line = F.substring_index(part, "\n", 1)
        return said(line, F.substr(part, F.length(line) + 2))

    parts = F.split("text", START.replace("|", r"\|"), -1)
    opened = F.transform(F.slice(parts, 2, F.size(parts)), block)
    going_on = F.array(said(F.col("inside"), F.substr(F.get(parts, F.lit(0)), F.lit(len(AND) + 1))))
    return formatted.withColumns(
        {
            "turns": F.flatten(
                F.when(F.col("inside").isNull(), opened).otherwise(F.concat(going_on, opened))
            ),
            "learned": F.transform(
                "loss",
                lambda s: unescaped(
                    F.substr("text", (s["start"] + 1).cast("int"), s["length"].cast("int"))
                ),
            ),
        }
    )


def digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each conversation, from what :func:`read_back` finds.

    The digest of a conversation is one hash of its whole text, so the segments
    of a long one meet here; those of the others need no further shuffle.
    """
    parsed = read_back(formatted).select(
        "conv_id",
        "segment",
        "whole",
        F.size("turns").cast("long").alias("n_turns"),
        "n_blocks",
        F.array_join(
            F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))),
            "",
        ).alias("turns"),
        F.array_join("learned", "").alias("learned"),
        F.length("text").cast("long").alias("chars"),
    )

    def out(df: DataFrame) -> DataFrame:
        return df.select(
            "conv_id",
            "n_turns",
            F.sha2("turns", 256).alias("turns_sha256"),
            F.length("learned").cast("long").alias("loss_chars"),
            F.sha2("learned", 256).alias("loss_sha256"),
            F.col("chars").alias("formatted_chars"),
            "n_blocks",
        )

    cut = parsed.where(~F.col("whole"))
    own = F.sort_array(F.collect_list(F.struct("segment", "turns", "learned")))
    joined = cut.groupBy("conv_id").agg(
        *(F.sum(c).alias(c) for c in ("n_turns", "n_blocks", "chars")), own.alias("own")
    )
    return out(parsed.where("whole")).unionByName(
        out(
            joined.withColumns(
                {
                    "turns": F.array_join(F.col("own.turns"), ""),
                    "learned": F.array_join(F.col("own.learned"), ""),
                }
            )
        )
    )
