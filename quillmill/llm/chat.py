"""Multi-party dialogues rendered from the perspective of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.llm.common import numbered
from quillmill.operators.scale import null_safe_key, salted_join
from quillmill.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
OWN_HEAD = START + "assistant\n"


def seen_head(who: Column, system: tuple[str, ...]) -> Column:
    """The head of a turn that is not the participant's own."""
    name = F.regexp_replace(F.coalesce(who, F.lit("unknown")), r"[<>|\s]", "_")
    shown = F.when(F.coalesce(who.isin(*system), F.lit(False)), F.lit("system")).otherwise(
        F.concat(F.lit("user name="), name))
    return F.concat(F.lit(START), shown, F.lit("\n"))


def perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: tuple[str, ...] = ("system",),
    turns_per_row: int = 256,
) -> DataFrame:
    """Render every dialogue once per participant, who speaks as the assistant.

    Participants are the speakers of a dialogue other than ``system`` and NULL. For each of
    them a turn becomes a head, the text and an end mark: the head says ``assistant`` if it
    is the participant's, ``system`` for system turns, else ``user name=...`` with
    the speaker's name (angle brackets, bars and spaces in it as underscores; NULL speaks
    as ``unknown``). The mask covers what the participant has to learn: the texts and end
    marks of its own turns.

    Returns rows (conv, participant, part, first_turn, n_turns, char_start, rendered, mask,
    n_target): a dialogue of more than ``turns_per_row`` turns goes on in further parts, so
    no task ever holds a dialogue of any length; parts joined in order are the whole
    rendering. ``mask`` lists ``start:end`` code points of the whole rendering, end exclusive;
    ``n_target`` counts those of the part.

    Turns go by (turn, speaker, text), NULLs first; equal rows are kept as turns of their
    own. A NULL text is empty; a dialogue without participants gives no rows; a NULL
    dialogue id is a dialogue of its own. Other columns are not used.
    """
    base = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"),
        F.col(speaker).cast("string").alias("who"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("said"),
    )
    placed = numbered(base, ["c"], ["t", "who", "said"], [], "chat-turns").select(
        null_safe_key("c").alias("code"), "c", F.expr(f"__idx div {turns_per_row}").alias("part"),
        "__idx", "who", "said",
    )
    # Where a part begins in the rendering of a participant follows from lengths alone: those
    # of its turns as others see them, and what the heads of the participant's own turns differ.
    mine = F.coalesce(F.col("who").isNotNull() & ~F.col("who").isin(*system), F.lit(False))
    lengths = materialize(
        placed.groupBy("code", "part", "who").agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.length(seen_head(F.col("who"), system)) + F.length("said") + len(END))
            .alias("length"),
        ).select("*", (F.col("n") * (len(OWN_HEAD) - F.length(seen_head(F.col("who"), system))))
                 .alias("own")),
        "chat-lengths",
    )
    whole = materialize(
        lengths.groupBy("code", "part").agg(F.sum("length").alias("length")), "chat-parts")
    people = lengths.where(mine).select("code", F.col("who").alias("participant")).distinct()
    sized = salted_join(whole, people, ["code"], ["part"]).join(
        lengths.where(mine).select("code", "part", F.col("who").alias("participant"), "own"),
        ["code", "part", "participant"], "left",
    ).withColumn("length", (F.col("length") + F.coalesce("own", F.lit(0))).cast("bigint"))
    offsets = numbered(
        sized.select("code", "participant", "part", "length"), ["code", "participant"], ["part"],
        ["length"], "chat-offsets",
    ).select("code", "part", "participant", F.col("__before_length").cast("bigint").alias("char_start"))
    parts = placed.groupBy("code", "part").agg(
        F.first("c").alias("c"),
        F.sort_array(F.collect_list(F.struct("__idx", "who", "said"))).alias("turns"),
    )
    # A part is bounded, whatever the dialogue, and so is what any key joins here.
    each = parts.join(offsets, ["code", "part"])

    def render(t: Column) -> Column:
        own = F.coalesce(t["who"] == F.col("participant"), F.lit(False))
        return F.struct(
            F.when(own, F.lit(OWN_HEAD)).otherwise(seen_head(t["who"], system)).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"),
            own.alias("own"),
        )

    rendered = each.select(
        "c", "participant", "part", "char_start", F.size("turns").alias("n"),
        F.expr("turns[0].__idx").alias("first_turn"), F.transform("turns", render).alias("r"),
    )
    # Parts are of bounded length, so this fold is bounded too.
    spans = F.aggregate(
        "r",
        F.struct(F.lit(0).cast("bigint").alias("at"),
                 F.array().cast("array<struct<s:bigint,e:bigint>>").alias("own")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("at"),
            F.when(
                t["own"],
                F.concat(acc["own"], F.array(F.struct(
                    (acc["at"] + F.length(t["head"])).alias("s"),
                    (acc["at"] + F.length(t["head"]) + F.length(t["body"])).alias("e"),
                ))),
            ).otherwise(acc["own"]).alias("own"),
        ),
    )
    local = rendered.select(
        "c", "participant", "part", "char_start", "n", "first_turn",
        F.array_join(F.transform("r", lambda t: F.concat(t["head"], t["body"])), "")
        .alias("rendered"),
        spans.alias("spans"),
    )
    return local.select(
        F.col("c").alias(conv), "participant", F.col("part").cast("int").alias("part"),
        "first_turn", F.col("n").alias("n_turns"), "char_start", "rendered",
        F.array_join(
            F.transform(
                "spans.own",
                lambda s: F.concat_ws(
                    ":", (s["s"] + F.col("char_start")).cast("string"),
                    (s["e"] + F.col("char_start")).cast("string"),
                ),
            ), ",",
        ).alias("mask"),
        F.aggregate("spans.own", F.lit(0).cast("bigint"), lambda a, s: a + s["e"] - s["s"])
        .alias("n_target"),
    )
