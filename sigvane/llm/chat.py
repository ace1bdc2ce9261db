"""Multi-party perspective rotation of conversations, in column expressions only.

For every participant the dialogue is rendered once with that speaker as the assistant and everybody else as a named
user; system turns open no perspective and stay system turns.  A turn is rendered as a ChatML block

    <|im_start|>assistant\n...<|im_end|>\n      <|im_start|>user name=NAME\n...<|im_end|>\n

and the mask lists the character spans to learn from: each assistant block's content with its end mark.  Marks inside
contents and names are broken by a blank, so a text cannot open or close a turn.

``perspectives`` renders the whole dialogue for everybody who speaks anywhere in it.  Turns are numbered by rank, whatever
their numbers, and a rendering comes as rows of ``segment_turns`` turns each (``part`` 0, 1, ...).  The texts of a
conversation and speaker, put together by ``part``, are the rendering; ``starts_at`` is where the segment begins in
it, and the mask counts from the rendering's start.  So no row holds more than ``segment_turns`` turns and no task a
whole long conversation; the result has as many turns as the dialogue times its speakers.

Defined results: a null text is empty, a null role is ``unknown``, a null turn counts as 0; equal rows count once;
different rows with one turn number follow by role, then text; a null conversation id is one conversation; a
conversation with system turns only gives no row; an empty table gives none.  Other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigvane.operators.ordering import null_safe_join, prefix_sums

START, END = "<|im_start|>", "<|im_end|>"
PART_TURNS = 256


def _plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(START), F.lit("<|im_start |>")), F.lit(END), F.lit("<|im_end |>"))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        _plain(F.coalesce("role", F.lit("unknown"))).alias("role"), _plain(F.coalesce("text", F.lit(""))).alias("text"),
    )


def _name(role: Column) -> Column:
    return F.when(role == "system", "system").otherwise(F.concat(F.lit("user name="), role))


def _rendered(seen: DataFrame, keys: list[str], at: Column, offset: str) -> DataFrame:
    """``keys``, n_turns, text and mask of rows with ``turns`` and ``speaker``; positions of type ``offset`` from ``at``."""

    def head(turn: Column) -> Column:
        name = F.when(turn["role"] == F.col("speaker"), "assistant").otherwise(_name(turn["role"]))
        return F.concat(F.lit(START), name, F.lit("\n"))

    blocks = F.transform("turns", lambda t: F.struct(head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("speaker")).alias("ours")))
    rendered = seen.withColumn("blocks", blocks)

    def measured(state: Column, block: Column) -> Column:
        start = state["at"] + F.length(block["head"])
        end = start + F.length(block["body"])
        return F.struct((end + 1).alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), block["ours"].alias("ours")))).alias("spans"))

    nothing = F.struct(at.cast(offset).alias("at"), F.expr(f"CAST(array() AS array<struct<start: {offset}, end: {offset}, ours: boolean>>)").alias("spans"))
    spans = F.aggregate("blocks", nothing, measured, lambda s: F.filter(s["spans"], lambda span: span["ours"]))
    return rendered.select(
        *keys, F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"], F.lit("\n"))), "").alias("text"),
        F.transform(spans, lambda span: F.struct(span["start"].alias("start"), span["end"].alias("end"))).alias("mask"),
    )


def perspectives(turns: DataFrame, segment_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, speaker, starts_at, n_turns, text and mask (array of struct start, end): every participant, all turns."""
    rows = _turns(turns).distinct()
    speakers = rows.where("role <> 'system'").select("conv_id", F.col("role").alias("speaker")).distinct()
    ranked = prefix_sums(rows, ["conv_id"], ["turn", "role", "text"])
    ranked = ranked.select("conv_id", F.floor(F.col("before") / segment_turns).cast("long").alias("part"), "turn", "role", "text")
    segments = ranked.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # A block's length with its speaker as a user, and what the name "assistant" makes of it.
    length = F.length(_name(F.col("role"))) + F.length("text") + F.lit(len(START) + len(END) + 2)
    lengths = ranked.groupBy("conv_id", "part").agg(F.sum(length).alias("length"))
    own = ranked.groupBy("conv_id", "part", F.col("role").alias("speaker")).agg(F.count(F.lit(1)).alias("own"))
    grid = null_safe_join(null_safe_join(lengths, speakers, ["conv_id"]), own, ["conv_id", "part", "speaker"], "left")
    change = F.lit(len("assistant")) - F.length(_name(F.col("speaker")))
    # One narrow row per segment and speaker.
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = F.coalesce(F.sum(F.col("length") + change * F.coalesce("own", F.lit(0))).over(earlier), F.lit(0))
    placed = grid.select("conv_id", "part", "speaker", starts.alias("starts_at"))
    seen = null_safe_join(placed, segments, ["conv_id", "part"])
    return _rendered(seen, ["conv_id", "part", "speaker", "starts_at"], F.col("starts_at"), "long")

