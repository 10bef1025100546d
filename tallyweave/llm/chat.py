"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue, the dialogue is rendered with that participant as assistant and all others as users with
their names; loss masks cover what the assistant says. The rendering comes as a row per perspective and turn, with its place
in the whole, so that a dialogue of any length is spread over tasks: lengths run within blocks of turns, blocks
run over the dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweave.llm.shared import SPACE, SPACE_CHARS

#: Turn numbers of a block: a window holds one block of a dialogue and perspective.
BLOCK_TURNS = 256

# The template: fixed strings around a turn.
HEAD, NAME, TAIL = "<|im_start|>", " name=", "<|im_end|>\n"
#: Marks inside of a text or a name, which would forge a turn, get a space behind their first character.
MARKS = r"<\|(im_start|im_end)\|>"
#: Roles that only give the scene: they are rendered as they are in every perspective and have none of their own.
SCENE = ("system",)
#: A turn without a role is spoken by this one.
UNNAMED = "unknown"


def escaped(text: Column) -> Column:
    """The text without marks of the template."""
    return F.regexp_replace(text, MARKS, "< |$1|>")


def speaker_of(role: Column) -> Column:
    """The participant of a role: trimmed, white space inside as underscore, marks escaped; ``UNNAMED`` for null and blank."""
    name = escaped(F.regexp_replace(F.btrim(role, F.lit(SPACE_CHARS)), f"[{SPACE}]+", "_"))
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(UNNAMED)).otherwise(name)


def participants(turns: DataFrame, conv: str, speaker: str) -> DataFrame:
    """(conv, perspective) of each participant of each dialogue, the scene left out."""
    return turns.where(~F.col(speaker).isin(*SCENE)).select(conv, F.col(speaker).alias("perspective")).distinct()


def rotated(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each perspective of a dialogue and each of its turns, in rendering order by ``position``.

    Columns: the dialogue's key, perspective, position (0 first), turn, speaker, ``as_role`` (assistant, user or system),
    ``segment`` (the rendered turn), ``segment_start`` (in the whole rendering), ``mask_start`` and ``mask_end`` (the loss
    mask: content and end mark of the assistant's turns, in the whole rendering; null for others), offsets in code points.

    Turns order by number, nulls last, then speaker and text, so ties and repeated rows have a place each. A
    null text is an empty turn, marks of the template inside of texts and names are escaped; a null dialogue key is a dialogue of its own. A dialogue of the scene alone has no
    perspective and no rows. Empty tables give an empty result; other columns are not read.
    """
    turns = df.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), speaker_of(F.col(f"`{role}`")).alias("speaker"), escaped(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("text"))
    block = F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS).cast("long"), F.lit((1 << 63) - 1)).alias("block")
    sides = participants(turns, "conv", "speaker").select(F.col("conv").alias("c"), "perspective")
    own = F.col("speaker") == F.col("perspective")
    as_role = F.when(own, "assistant").when(F.col("speaker").isin(*SCENE), F.col("speaker")).otherwise("user")
    head = F.concat(F.lit(HEAD), "as_role", F.when(F.col("as_role") == "user", F.concat(F.lit(NAME), "speaker")).otherwise(F.lit("")), F.lit("\n"))
    rows = turns.join(sides, F.col("conv").eqNullSafe(F.col("c"))).drop("c").select("*", block).withColumn("as_role", as_role)
    rows = rows.withColumn("head", head).withColumn("segment", F.concat("head", "text", F.lit(TAIL)))
    # running place and length: within a block, then over the blocks
    one = Window.partitionBy("conv", "perspective", "block").orderBy(F.col("turn").asc_nulls_last(), "speaker", "text")
    before = one.rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.select("*", (F.row_number().over(one) - 1).alias("n_in"), F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)).alias("len_in"))
    sums = rows.groupBy("conv", "perspective", "block").agg(F.count("*").alias("n"), F.sum(F.length("segment").cast("long")).alias("len"))
    earlier = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_base"), F.coalesce(F.sum("len").over(earlier), F.lit(0)).alias("len_base"))
    met = inside.join(bases, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    start = F.col("len_base") + F.col("len_in")
    masked = F.col("as_role") == "assistant"
    return met.select(
        F.col("conv").alias(conv), "perspective", (F.col("n_base") + F.col("n_in")).alias("position"), F.col("turn").alias(turn), "speaker", "as_role", "segment", start.alias("segment_start"),
        F.when(masked, start + F.length("head")).alias("mask_start"), F.when(masked, start + F.length("segment")).alias("mask_end"),
    )


def renderings(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Whole renderings, for dialogues that fit a row: (key, perspective, rendered, masks) from ``rotated`` rows."""
    part = F.sort_array(F.collect_list(F.struct("position", "segment", "mask_start", "mask_end")))
    got = rows.groupBy(conv, "perspective").agg(part.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return got.select(conv, "perspective", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("rendered"), masks.alias("masks"))
