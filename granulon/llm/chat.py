"""Chat formatting: logged conversations that are snapshots of longer ones collapse into those, and the rest is rendered.

A turn's hash covers its place, role and text; the hash of a prefix is the running sum of its turns' hashes, so one window pass
gives every prefix of every conversation. Conversations of equal whole hash and length are copies, of which the smallest id
stays; one whose whole hash is a shorter prefix's of another is a snapshot, and an anti-join drops it. Only (length, hash)
keys meet, each once, so a first turn or conversation in a third of all logs makes no hot key. Everything is DataFrame functions.

Defined results: turns are ordered by turn (null first), then role, then text; repeated rows are repeated turns; a null role or text differs
from an empty one in the hash and renders as empty; rows without conv_id are ignored; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granulon.llm.common import materialise

#: The public chat markup.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns and n_copies of the conversations that are no other's prefix, one for each group of copies."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("conv_id is not null")
    rows = rows.withColumn("n", F.row_number().over(order))
    hashed = rows.select("conv_id", "n", *(F.xxhash64(F.lit(s), "n", F.col("role").isNull(), "role", F.col("text").isNull(), "text").alias(f"h{s}") for s in (0, 1)))
    so_far = W.partitionBy("conv_id").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    halves = [F.sum(F.shiftrightunsigned(f"h{s}", 32) if up else F.col(f"h{s}").bitwiseAND(F.lit(0xFFFFFFFF))).over(so_far).alias(f"p{s}{int(up)}") for s in (0, 1) for up in (True, False)]
    key = ["n", "p01", "p00", "p11", "p10"]
    prefixes = hashed.select("conv_id", "n", *halves).withColumn("last", F.lead("n").over(W.partitionBy("conv_id").orderBy("n")).isNull())
    whole = prefixes.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    inner = prefixes.where("not last").select(*key).distinct()
    return whole.join(inner, key, "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"), "n_copies")


def render(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of the maximal conversations."""
    kept = materialise(maximal(turns, conv, turn, role, text), "maximal")
    part = F.concat(F.lit(OPEN), F.coalesce(F.col(role), F.lit("")), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit(CLOSE))
    # only what stays is gathered and rendered
    rows = turns.join(kept.select(F.col("conv_id").alias("_kept")), F.col(conv) == F.col("_kept"), "left_semi").select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.col(text).alias("x"), part.alias("p")).alias("s"))
    texts = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s.p), "").alias("rendered"))
    return kept.join(texts, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
