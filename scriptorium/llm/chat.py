"""Chat formatting by multi-party perspective rotation.

Every participant of a dialogue gets a rendering of all of it: that speaker's turns are
the assistant's, all other participants are users that carry their names, and context
turns (system) stay as they are. The loss mask covers what the assistant says.

A rendering is kept in parts of a bounded number of turn numbers, so that a dialogue with a
third of all turns is no single row or task; offsets count through the whole rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Turn numbers in one part.
PART = 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _clean(text: Column) -> Column:
    """Text that cannot be taken for the format's own marks: a zero-width space goes after `<` in them."""
    for mark in (OPEN, CLOSE):
        text = F.replace(text, F.lit(mark), F.lit(mark[0] + "​" + mark[1:]))
    return text


def rotate(turns: DataFrame, *, context: tuple[str, ...] = ("system",), part: int = PART, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per dialogue, perspective and part: (conv_id, assistant, part, char_start, n_turns, text, masks).

    text: for each turn `<|im_start|>ROLE[ name=NAME]\\nTEXT<|im_end|>\\n`; masks: spans
    (start, end) in code points of `text` that the assistant says, its closing mark
    included; char_start: where the part begins in the dialogue's whole rendering.

    Turns go by number, then speaker, then text; repeated rows are rendered as often as they
    come. A null text is empty, a null speaker is the participant "unknown", a null turn
    number sorts first (in a part of its own, null), a null dialogue id is one dialogue. A
    dialogue with context turns alone has no participant and gives no row, nor does an empty
    table. Further columns are ignored. Marks inside texts and names are broken up.
    """
    speaker = F.coalesce(F.col(speaker_col), F.lit("unknown"))
    base = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), _clean(speaker).alias("speaker"),
        speaker.isin(*context).alias("context"), _clean(F.coalesce(F.col(text_col), F.lit(""))).alias("said"),
        F.floor(F.col(turn_col).cast("long") / part).alias("part"),
    )
    people = base.where(~F.col("context")).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("assistant")).distinct()
    seen = base.join(people, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    own = ~F.col("context") & (F.col("speaker") == F.col("assistant"))
    role = F.when(F.col("context"), F.concat(F.col("speaker"), F.lit("\n"))).when(own, F.lit("assistant\n")).otherwise(F.concat(F.lit("user name="), F.col("speaker"), F.lit("\n")))
    said = F.struct("turn", "speaker", "said", F.concat(F.lit(OPEN), role).alias("head"), own.alias("own"))
    parts = seen.groupBy("conv_id", "assistant", "part").agg(F.array_sort(F.collect_list(said)).alias("turns"))
    whole = lambda t: F.concat(t["head"], t["said"], F.lit(CLOSE + "\n"))
    sizes = F.transform("turns", lambda t: F.length(whole(t)))
    laid = parts.withColumn("text", F.array_join(F.transform("turns", whole), "")).withColumn("sizes", sizes)
    # where each turn begins: a running sum over the part's (bounded) turns
    begins = F.aggregate("sizes", F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    spans = F.transform(F.arrays_zip("turns", "begins"), lambda z: F.when(z["turns"]["own"], F.struct((z["begins"] + F.length(z["turns"]["head"])).alias("start"), (z["begins"] + F.length(z["turns"]["head"]) + F.length(z["turns"]["said"]) + len(CLOSE)).alias("end"))))
    laid = laid.withColumn("begins", F.slice(begins, 1, F.size("turns"))).withColumn("masks", F.filter(spans, lambda s: s.isNotNull()))
    before = W.partitionBy("conv_id", "assistant").orderBy(F.col("part").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text").cast("long")).over(before), F.lit(0).cast("long"))
    return laid.select("conv_id", "assistant", "part", start.alias("char_start"), F.size("turns").cast("long").alias("n_turns"), "text", "masks")
