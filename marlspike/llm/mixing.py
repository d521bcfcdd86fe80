"""Mixing sources to target weights.

Sources, ordered by code point with null last, take the weights in turn and share all words in that proportion; no
source gives more than `most` times its words, and what it cannot give is shared among the others by weight. Each
source then gives whole epochs, and in the last epoch the documents before its cut.

Documents have a hash-random key (MD5 of the identifier). The key's leading digits range-partition each source; range
totals, pre-aggregated before the shuffle, and their prefix sums say in which range the budget ends. Sums are taken in
levels: first over the 256 ranges of two digits, then over the 256 ranges inside the one that holds the cut, and so on,
so no window holds more rows of a source than that. Only the documents of the last range are sorted to find the exact
cut; it holds a few times `range_rows` rows at most, however large a source is. Texts are never shuffled: the plan has
one row per source. The targets are set in one task over one row per source; sources are taken to be few.

The document at the cut gives the words that are left, so a source's taken words equal its target rounded down.

Defined cases: null and empty texts have size 0 and take 0; a null source is a source of its own; rows with equal
identifiers in one source share a key and, at the cut, share what is left in proportion, rounded down; an empty table
gives an empty result; other columns do not matter to `taken`, and `mixed` keeps them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from marlspike.llm.text import WORD_RE
from marlspike.session import discard, materialize

UP_TO = (Window.unboundedPreceding, Window.currentRow)
#: Hexadecimal digits of the key by which ranges get finer at once: a window has 16 ** STEP rows of a source at most.
STEP = 2


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def key_of(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row per source.

    Water-filling: by rising room per weight, a source is full if its room is within its share of what the fuller
    ones leave; the first that is not fixes the share for the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights) + 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn)).withColumn("room", F.col("source_size") * most)
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("share", F.col("left") / F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    s = s.withColumn("place", F.row_number().over(by_room)).withColumn("full", F.col("room") <= F.col("weight") * F.col("share"))
    level = F.min(F.when(~F.col("full"), F.struct("place", "share"))).over(everything)["share"]
    target = F.when(F.col("full"), F.col("room").cast("double")).otherwise(F.col("weight") * level)
    return s.select("source", "source_size", target.alias("target"))


def plan(slim: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, range_rows: int = 2_000) -> DataFrame:
    """One row per source: source, source_size, target, epochs, cut, cut_left, cut_size.

    `slim` has columns source, size, key. Documents with a key below `cut` are taken once more than `epochs`; those
    at it (cut_size words) share cut_left words.
    """
    sources = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    aims = targets(sources.select("source", "source_size"), weights, most)
    whole = F.floor("target")
    aims = aims.withColumn("epochs", F.coalesce(F.expr("floor(target) div nullif(source_size, 0)"), F.lit(0))).withColumn("last", whole - F.col("epochs") * F.col("source_size"))
    aims = materialize(aims, "aims")
    rows = slim.count()
    digits = max(1, math.ceil(math.log(max(1, rows / range_rows), 16)))
    part = F.substring("key", 1, digits)
    ranges = materialize(slim.groupBy("source", part.alias("part")).agg(F.sum("size").alias("part_size")), "ranges")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    # Down the digits of the key: of the ranges in the one that holds a source's cut, `STEP` digits finer each time.
    hit, spent = aims.select("source", F.lit("").alias("part"), F.col("last").alias("inside")), []
    for upto in [*range(STEP, digits, STEP), digits]:
        fine = F.substring("part", 1, upto)
        inner = ranges.join(hit.select(F.col("source").alias("_s"), F.col("part").alias("_p"), "inside"), F.col("source").eqNullSafe(F.col("_s")) & F.startswith("part", "_p"))
        sums = inner.groupBy("source", fine.alias("part")).agg(F.sum("part_size").alias("part_size"), F.first("inside").alias("inside"))
        through = sums.withColumn("through", F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(*UP_TO)))
        found = through.where("through >= inside and through - part_size < inside")
        hit = materialize(found.select("source", "part", (F.col("inside") - F.col("through") + F.col("part_size")).alias("inside")), "hit")
        spent.append(hit)
    near = slim.withColumn("part", part)
    near = near.join(hit, same(near, hit) & (near["part"] == hit["part"])).select(near["source"], "key", "size", "inside")
    keys = near.groupBy("source", "key").agg(F.sum("size").alias("cut_size"), F.first("inside").alias("inside"))
    by_key = Window.partitionBy("source").orderBy("key").rowsBetween(*UP_TO)
    keys = keys.withColumn("upto", F.sum("cut_size").over(by_key)).where("upto >= inside and upto - cut_size < inside")
    cuts = keys.select(F.col("source").alias("cut_source"), F.col("key").alias("cut"), (F.col("inside") - F.col("upto") + F.col("cut_size")).alias("cut_left"), "cut_size")
    out = aims.join(cuts, aims["source"].eqNullSafe(cuts["cut_source"]), "left").drop("cut_source", "last")
    made = materialize(out, "plan")
    discard(aims, ranges, *spent)
    return made


def taken(size: Column, key: Column) -> Column:
    """Words taken of a document, from its size, its key and its source's row of the plan."""
    at_cut = F.expr("cut_left") * size
    extra = F.when(key < F.col("cut"), size).when(key == F.col("cut"), F.floor(at_cut / F.col("cut_size"))).otherwise(0)
    return (F.col("epochs") * size + extra).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), key_of(F.col(id_col)).alias("key"))
    slim = materialize(slim, "sizes")
    p = plan(slim, weights, most).withColumnRenamed("source", "plan_source")
    joined = slim.join(p, slim["source"].eqNullSafe(p["plan_source"]))
    return joined.select("doc_id", "source", "size", "source_size", "target", taken(F.col("size"), F.col("key")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: a row of `docs` for each time it is taken, the last one cut after its words; n_chars follows."""
    slim = materialize(docs.select("source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("key")), "sizes")
    p = plan(slim, weights, most).select(F.col("source").alias("_plan_source"), "epochs", "cut", "cut_left", "cut_size")
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("_row"))
    whole = whole.select("_row", size_of(F.col("_row.text")).alias("_size"), key_of(F.col("_row.doc_id")).alias("_key"))
    joined = whole.join(p, F.col("_row.source").eqNullSafe(F.col("_plan_source")))
    counted = joined.select("_row", "_size", taken(F.col("_size"), F.col("_key")).alias("_taken"))
    parts = F.expr("concat(array_repeat(_size, cast(_taken div _size as int)), if(_taken % _size > 0, array(_taken % _size), array()))")
    each = counted.where("_taken > 0").select("_row", "_size", F.explode(parts).alias("_words"))
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(WORD_RE), F.lit(0))
    text = F.when(F.col("_words") == F.col("_size"), F.col("_row.text")).otherwise(F.array_join(F.slice(words, 1, F.col("_words").cast("int")), " "))
    cut = each.select("_row", text.alias("_text"))
    fresh = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return cut.select(*[fresh.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names])
