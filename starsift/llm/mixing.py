"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots. Slot i stands at the golden-ratio point frac(i * phi) of [0, 1); the
cumulative targets of the sources cut [0, 1) into intervals, and the slot goes to the source in whose
interval its point lies, so every stretch of the sequence has each source nearly at its weight. The
k-th slot of a source takes the k-th block of equal word count of that source's shuffled documents;
after the last document a second pass begins, shuffled anew. What the mix takes of a document is what
its blocks' slots take: :func:`sequence` is the mix, and all else is derived from it.

The points give a source its share of slots to within a few. The last slot of a source is cut where
its target is met and slots beyond it stay empty; a source that the points left short gets the blocks
that it lacks, LATE at most, behind the other slots. Nothing is drawn at random: orders come from MD5 of
pass and document id.

Ranks and running sums over a source go by two levels (parts of a source, then rows of a part), so
a source that holds a third of all rows is no single task's work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starsift.operators.rank import prefix_sums
from starsift.storage import written

#: Slots of the schedule on smaller corpora; words of a block at most, so that on larger ones the slots grow with the mix.
SLOTS, WIDTH = 1 << 17, 1024
#: Points lie on a grid of 2 ** 31, on which the step from one to the next is the golden ratio's fraction; whole numbers stay exact at any length.
GRID, GOLDEN = 1 << 31, 1327217885
#: Slots of a part when slots are ranked; cells for each source, at least, into which [0, 1) is cut to find a point's source.
PART, CELLS = 2048, 2
#: Blocks that a source may get behind the other slots. The points of an interval are its share of all to within less.
LATE = 8
#: Hexadecimal digits of the MD5 order that name a part of a source.
DIGITS = 3
#: The weights, in turn, of the sources in order; how much of all sizes the mix takes; passes at most.
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, PASSES = 1.5, 2


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 09 to 0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) for the sources of (source, size).

    Sources by code point, null last, weigh 5, 2, 1 in turn and share SHARE of all sizes; a target
    stops at PASSES times its source's size, and the excess goes to the others by weight. With all
    capped sources at their caps, the rest have level * weight; the level is found by taking
    sources as capped in order of cap / weight. Only one row per source is ordered here.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").isNull(), "source")
    weights = F.array(*map(F.lit, WEIGHTS))
    cap = (F.col("source_size") * PASSES).cast("double")
    rows = sources.withColumn("nth", F.row_number().over(named) - 1).withColumn("weight", F.element_at(weights, (F.col("nth") % len(WEIGHTS) + 1).cast("int"))).withColumn("cap", cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "nth")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    rows = (
        rows.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.sum("source_size").over(every) * SHARE - F.col("capped")) / F.col("open"))
        # The first source in this order whose cap is not below level * weight stays open, and so do all after it.
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(every))
    )
    return rows.select("source", "source_size", F.least("cap", F.coalesce(F.col("level.level") * F.col("weight"), F.col("cap"))).alias("target"), "nth")


def _levels(rows: DataFrame, size: str, part: str, order: list[str], into: str) -> DataFrame:
    """``rows`` with the sum of ``size`` over all rows of the source that come before, as ``into``."""
    sums = rows.groupBy("nth", part).agg(F.sum(size).alias("part_size"))
    earlier = Window.partitionBy("nth").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("nth", part, F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("nth", part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in_part", F.coalesce(F.sum(size).over(within), F.lit(0))).join(sums, ["nth", part]).withColumn(into, F.col("in_part") + F.col("part_start")).drop("in_part", "part_start")


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, nth, rank): the source of each slot and the slot's rank within its source, from 0.

    ``sources``, which is read more than once, has nth and target, of which whole words count. Points
    meet intervals by cells of [0, 1): an equality join on the cell, then the exact bounds. There are
    more cells than sources, so however the intervals lie, pairs looked at are a few for each point.
    """
    due = sources.select("nth", F.round("target").cast("long").alias("due")).filter("due > 0")
    size = due.agg(F.count("*").alias("n"), F.sum("due").alias("all")).first()
    if not size["n"]:
        return sources.select(F.lit(0).cast("long").alias("slot"), "nth", F.lit(0).cast("long").alias("rank")).limit(0)
    cells = 1 << max(10, (CELLS * size["n"]).bit_length())
    bounds = prefix_sums(written(due, "due"), [F.asc("nth")], {"upto": F.col("due")})
    bounds = bounds.select("nth", ((F.col("upto") - F.col("due")) / size["all"]).alias("low"), (F.col("upto") / size["all"]).alias("high"))
    bounds = bounds.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    points = sources.sparkSession.range(slots).withColumnRenamed("id", "slot").withColumn("point", (F.col("slot") % GRID) * GOLDEN % GRID / GRID)
    dealt = points.withColumn("cell", F.floor(F.col("point") * cells)).join(bounds, "cell").filter("point >= low AND point < high")
    dealt = dealt.select("slot", "nth", F.floor(F.col("slot") / PART).alias("part"), F.lit(1).cast("long").alias("one"))
    return _levels(dealt, "one", "part", ["slot"], "rank").select("slot", "nth", "rank")


def block_width(total: float, slots: int = SLOTS) -> int:
    """Words of a block where the mix has ``total``."""
    return min(WIDTH, max(1, math.ceil(total / slots)))


def sequence(sources: DataFrame, slots: int, width: int) -> DataFrame:
    """(slot, nth, block, words): the mix, a row for each slot that takes words, in the order of slots.

    A slot takes ``width`` words of its source's block, or what is left of the target. Slots from
    ``slots`` on are those behind the schedule.
    """
    due = sources.select("nth", F.round("target").cast("long").alias("due")).filter("due > 0").withColumn("blocks", F.ceil(F.col("due") / width))
    dealt = written(schedule(sources, slots), "schedule")
    kept = dealt.join(due, "nth").filter("rank < blocks").select("slot", "nth", F.col("rank").cast("long").alias("block"), "due")
    met = dealt.groupBy("nth").agg(F.count("*").alias("met"))
    short = due.join(met, "nth", "left").withColumn("met", F.coalesce("met", F.lit(0))).filter("met < blocks")
    short = short.withColumn("late", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("blocks") - F.col("met"), F.lit(LATE)) - 1)))
    # The first late block of each source, then the second of each, and so on.
    place = F.lit(slots) + F.col("late") * (1 << 40) + F.col("nth")
    late = short.select(place.cast("long").alias("slot"), "nth", (F.col("met") + F.col("late")).alias("block"), "due")
    return kept.unionByName(late).select("slot", "nth", "block", F.least(F.lit(width), F.col("due") - F.col("block") * width).alias("words"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, slots: int = SLOTS) -> DataFrame:
    """(row, doc_id, size, source_size, target, taken, taken_1, slot_1, taken_2, slot_2) for every row of ``docs``.

    ``taken_k`` are the words that the mix takes of the document in pass k, from its beginning, and
    ``slot_k`` the first slot that takes some (null if none does); at most one document of a source and
    pass is taken in part. ``taken`` is the sum. Very long texts are counted whole. A null or empty
    text has size 0 and is never taken; null is a source like others; repeated rows each count; an
    empty table gives no rows. ``row_col`` names a column that tells rows apart; without it rows are
    numbered here.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    sized = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("content"))
    sized = written(sized, "sizes")
    sources = written(targets(sized), "targets")
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    width = block_width(total, slots)
    # Spark broadcasts the sources only where the written table is under its threshold.
    own = sized.join(sources.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("source", "named")
    passes = own.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.lit(PASSES))))
    passes = passes.withColumn("key", F.md5(F.concat_ws("|", F.col("pass"), F.col("doc_id").cast("string")))).withColumn("part", F.concat(F.col("pass").cast("string"), F.substring("key", 1, DIGITS)))
    # Parts sort by pass first, so the second pass begins where the first ends.
    placed = _levels(passes, "size", "part", ["key", "size", "content", "row"], "start")
    end = F.col("start") + F.col("size")
    pieces = placed.select("row", "nth", "pass", "start", end.alias("end"), F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"(start + size - 1) div {width}"))).alias("block"))
    taken = pieces.join(sequence(sources, math.ceil(total / width), width), ["nth", "block"])
    part = F.greatest(F.least("end", F.col("block") * width + F.col("words")) - F.greatest("start", F.col("block") * width), F.lit(0))
    taken = taken.withColumn("part", part).filter("part > 0")
    own_pass = lambda k, c: F.when(F.col("pass") == k, F.col(c))
    sums = taken.groupBy("row").agg(*(f(own_pass(k, c)).alias(f"{name}_{k}") for k in range(1, PASSES + 1) for f, c, name in ((F.sum, "part", "taken"), (F.min, "slot", "slot"))))
    out = own.select("row", "doc_id", "size", "source_size", "target").join(sums, "row", "left")
    out = out.withColumns({f"taken_{k}": F.coalesce(f"taken_{k}", F.lit(0)) for k in range(1, PASSES + 1)})
    return out.withColumn("taken", sum((F.col(f"taken_{k}") for k in range(2, PASSES + 1)), F.col("taken_1")))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", length_col: str = "n_chars", slot_col: str | None = None) -> DataFrame:
    """The documents of the mix: a row for each document and pass that the mix takes words of.

    A document taken in part keeps its first words, joined by single spaces. ``length_col``, where
    there is one, follows the text. Columns are those of ``docs``, whatever their names, and as
    ``slot_col``, if given, the first slot that takes words of the row: in that order the rows are the
    mix. Texts without words, null ones among them, are never taken; very long texts are taken whole or
    to the word; repeated rows each count; an empty table stays empty.
    """
    types = dict(docs.dtypes)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    numbered = written(docs.select(F.monotonically_increasing_id().alias("mix_row"), row), "numbered")
    plain = numbered.select("mix_row", *(F.col(f"own.`{c}`").alias(n) for c, n in ((id_col, "mix_id"), (text_col, "mix_text"), (source_col, "mix_source"))))
    shares = mix(plain, "mix_id", "mix_text", "mix_source", "mix_row").filter("taken > 0")
    takes = F.explode(F.array(*(F.struct(F.col(f"taken_{k}").alias("words"), F.col(f"slot_{k}").alias("slot")) for k in range(1, PASSES + 1)))).alias("take")
    shares = shares.select(F.col("row").alias("mix_row"), F.col("size").alias("mix_size"), takes).filter("take.words > 0")
    part, text = F.col("take.words") < F.col("mix_size"), F.col(f"own.`{text_col}`")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.col("take.words").cast("int")), " ")
    out = {c: F.col(f"own.`{c}`") for c in docs.columns}
    out[text_col] = F.when(part, cut).otherwise(text)
    if length_col in types:
        out[length_col] = F.when(part, F.length(cut).cast(types[length_col])).otherwise(out[length_col])
    if slot_col:
        out[slot_col] = F.col("take.slot")
    return numbered.join(shares, "mix_row").select(*(c.alias(name) for name, c in out.items()))
