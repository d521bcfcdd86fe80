"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

Logs often hold a conversation again after each turn. The hash of a conversation's first turns is the running XOR of
its turns' 128-bit hashes, each over the turn's place in the conversation, its role and its text, so it is taken in
parts: per chunk of turns, then over chunks. The place is counted, so writers that number turns in other ways (from 0
or 1, with gaps) still meet. A conversation whose whole hash is that of a longer one's proper prefix goes by an anti-join; of equal
conversations the one with the lowest identifier stays. What stays is rendered.

Only hashes meet in the joins, after distinct, so a first turn or a conversation that a third of the log shares is one
row there. A long conversation's prefixes are computed in chunks of `CHUNK` turn numbers.

Defined cases: a null identifier is a conversation of its own; a null turn comes first; null roles and texts render
empty; a row that repeats within a conversation counts once; several rows of one turn render by role, then text;
empty texts are turns; an opening marker inside a role or text is rendered with a backslash, so it cannot pass for a
turn; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 1024
#: Fixed template markers.
OPEN, MIDDLE, CLOSE, ESCAPED = "<|", "|>\n", "\n", "<\\|"


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def prefixes(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, n (rows up to the turn), a, b (hash of them), last (whether it is the last turn)."""
    rows = turns_of(conversations).select("conv_id", "turn", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "text", "role").alias("b")).distinct()
    one = rows.groupBy("conv_id", "turn").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.count("*").alias("n"))
    one = one.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))

    # A turn's place among the conversation's turns, whatever numbers the writer gave them.
    chunks = one.groupBy("conv_id", "chunk").agg(F.count("*").alias("turns"), F.sum("n").alias("n"), F.max("turn").alias("top"))
    before = chunks.select(
        F.col("conv_id").alias("c"), F.col("chunk").alias("k"), zero(F.sum("turns").over(earlier)).alias("t0"), zero(F.sum("n").over(earlier)).alias("n0"),
        F.max("top").over(Window.partitionBy("conv_id")).alias("top"),
    )
    run = one.select("conv_id", "turn", "chunk", "a", "b", F.row_number().over(inside).alias("t1"), F.sum("n").over(inside).alias("n1"))
    placed = run.join(before, same).select("conv_id", "turn", "chunk", "a", "b", (F.col("t0") + F.col("t1")).alias("place"), (F.col("n0") + F.col("n1")).alias("n"), (F.col("turn") == F.col("top")).alias("last"))
    hashed = placed.withColumn("a", F.xxhash64("place", "a", "n")).withColumn("b", F.xxhash64("n", "b", "place"))

    sums = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    carried = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), zero(F.bit_xor("a").over(earlier)).alias("a0"), zero(F.bit_xor("b").over(earlier)).alias("b0"))
    upto = hashed.select("conv_id", "turn", "chunk", "n", "last", F.bit_xor("a").over(inside).alias("a1"), F.bit_xor("b").over(inside).alias("b1"))
    xor = lambda x, y: F.col(x).bitwiseXOR(F.col(y))
    return upto.join(carried, same).select("conv_id", "turn", "n", xor("a0", "a1").alias("a"), xor("b0", "b1").alias("b"), "last")


def maximal(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no longer one begins with."""
    p = prefixes(conversations)
    lowest = F.min(F.struct(F.col("conv_id").isNull(), "conv_id"))["conv_id"].alias("conv_id")
    whole = p.where("last").groupBy("n", "a", "b").agg(lowest)
    inner = p.where("not last").select("n", "a", "b").distinct()
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, rendered for each maximal conversation."""
    kept = maximal(conversations).select(F.col("conv_id").alias("kept_id"), "n_turns")
    turns = turns_of(conversations)
    rows = turns.join(kept, turns["conv_id"].eqNullSafe(kept["kept_id"])).groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    plain = lambda c: F.replace(c, F.lit(OPEN), F.lit(ESCAPED))
    line = lambda t: F.concat(F.lit(OPEN), plain(t["role"]), F.lit(MIDDLE), plain(t["text"]), F.lit(CLOSE))
    return rows.select("conv_id", "n_turns", F.array_join(F.transform("turns", line), "").alias("rendered"))
