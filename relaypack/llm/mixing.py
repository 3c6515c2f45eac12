"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies; its whole part is certain. The fraction is drawn by Pareto order
sampling: a document's rank is (u / (1 - u)) / (p / (1 - p)), with u a hash of its id and p the fraction, and each
source takes the documents of lowest rank while they fit what is left of its target. One that does not fit is skipped
and the draw goes on down the order. If the target is still missed by more than ``FINE`` of it, documents below their
most copies get one more, in the same order, while they fit; at last one more copy may go over the target if that
leaves the sum nearer to it.

Expected copies rise with a document's length class (``length_tilt`` for each doubling), so that inclusion is unequal
within a source too, and never exceed ``most`` copies.

Nulls: a null text has size 0 and takes 0 words; a null source is a source of its own and comes last. Documents of a
source without words have target 0. Equal ranks (repeated rows) go by id, then by a hash of the text, then by the row's
place in the input, so equal rows are drawn one by one. An empty table gives an empty result. Extra columns are ignored.

Sources may be many: their sizes, weights, targets and expected copies stay in tables, and only sums over all of them go to
the driver. The targets are found by raising the share that one unit of weight gets until no more source is full; a round is a sum over the
table of sources. Tables of a row a source are broadcast up to ``FEW`` rows (5 MB) and joined as Spark chooses beyond; the results are the same.
Documents of one source are never sorted together: their words are summed by bins of the rank, finer bins are
taken in the bin where the target falls, and only the last bin's documents are ordered. This is repeated with the
documents that fit the gap, until none does. A round is a few jobs over narrow rows and takes a document or more of each
source with a gap; targets of a thousand times the longest document need no more than one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relaypack.llm.common import WORD, materialize

BINS = 1024
#: A gap of no more than this part of its target is left.
FINE = 0.001
#: Sources whose tables are broadcast.
FEW = 50_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def weighed(spark: SparkSession, sums: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight`` to a row a source (source, n): weights repeat in the order of code points, null last. No task sorts all sources."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # bytes of UTF-8 are in the order of code points
    dealt = materialize(spark, sums.withColumn("null", F.col("source").isNull()).repartitionByRange(parts, "null", "source").withColumn("part", F.spark_partition_id()), "sources")
    counts = dealt.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = counts.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("null", "source")) - 1 + F.col("before")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return dealt.join(before, "part").select("source", "n", weight.alias("weight"))


def targets(spark: SparkSession, sums: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target of a row a source (source, n): ``share`` times all sizes by weight; no target above ``most`` times
    its source's size, the excess is shared anew."""
    known = materialize(spark, weighed(spark, sums, weights), "weights")
    total = known.agg(F.sum("n")).first()[0] or 0
    each = 0.0
    while True:
        full = F.lit(each) * F.col("weight") > most * F.col("n")
        of_full, of_free = known.agg(F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not of_free:
            break
        was, each = each, (share * total - most * (of_full or 0)) / of_free
        if each <= was:
            break
    goal = F.when(F.lit(each) * F.col("weight") > most * F.col("n"), most * F.col("n")).otherwise(F.lit(each) * F.col("weight"))
    return known.select("source", F.col("n").alias("source_size"), goal.cast("double").alias("target"))


def copies(classes: DataFrame, most: float, tilt: float) -> DataFrame:
    """Adds ``e``, a document's expected copies, to (source, class, n, target): proportional to 1 + tilt * class, ``most`` at most, target words
    in all. Higher classes are full first."""
    factor = 1 + tilt * F.col("class")
    down = Window.partitionBy("source").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    below = F.sum(factor * F.col("n")).over(Window.partitionBy("source").orderBy("class").rowsBetween(Window.unboundedPreceding, 0))
    tried = classes.withColumn("each", F.when(F.col("n") > 0, (F.col("target") - most * above) / below))
    free = F.min(F.when(F.col("each") * factor < most, F.struct((-F.col("class")).alias("c"), F.col("each").alias("each")))).over(Window.partitionBy("source"))
    tried = tried.withColumn("free", free)
    e = F.when(F.col("n") == 0, 0.0).when(F.col("free").isNull() | (F.col("class") > -F.col("free.c")), most).otherwise(F.greatest(F.lit(0.0), F.col("free.each") * factor))
    return tried.withColumn("e", e).drop("each", "free")


def mix(spark: SparkSession, docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, length_tilt: float = 0.02, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row of ``docs`` (doc_id, text, source)."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    sized = docs.select("doc_id", "source", word_count("text").alias("size"), F.xxhash64("text").alias("tie"), u.alias("u"), F.monotonically_increasing_id().alias("row"))
    sized = materialize(spark, sized.withColumn("class", F.when(F.col("size") > 0, F.floor(F.log2("size"))).otherwise(-1).cast("int")), "sizes")
    classes = materialize(spark, sized.groupBy("source", "class").agg(F.sum("size").alias("n")), "classes")
    goals = targets(spark, classes.groupBy("source").agg(F.sum("n").alias("n")), weights, share, most)
    few = goals.count() <= FEW
    held = classes.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    expected = copies(held, most, length_tilt).withColumn("whole", F.floor("e").cast("int"))
    rest = F.col("target") - F.sum(F.col("whole") * F.col("n")).over(Window.partitionBy("source"))
    plan = expected.select(F.col("source").alias("s"), F.col("class").alias("c"), "source_size", "target", "whole", (F.col("e") - F.col("whole")).alias("p"), rest.alias("rest"))
    known = sized.join(F.broadcast(plan) if few else plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("c"))).drop("s", "c")
    # x = rank / (1 + rank) lies in (0, 1) and is as the rank in order
    odds, inclusion = F.col("u") / (1 - F.col("u")), F.col("p") / (1 - F.col("p"))
    x = F.when(F.col("p") > 0, odds / (odds + inclusion))
    state = known.select("doc_id", "source", "size", "source_size", "target", "tie", "row", "whole", x.alias("x"), F.col("whole").alias("held"), F.col("rest").alias("gap"))
    state = materialize(spark, state, "drawn")
    # y orders the first copies of the draw before all further ones
    undrawn = F.col("x").isNotNull() & (F.col("held") == F.col("whole"))
    y = F.when(undrawn, F.col("x") / 2).otherwise(0.5 + F.coalesce("x", F.lit(1.0)) / 2)
    bin_ = F.least(F.floor(F.col("y") * BINS), F.lit(BINS - 1))
    fine = F.least(F.floor((F.col("y") * BINS - bin_) * BINS), F.lit(BINS - 1))
    room = F.col("gap") + 0.5  # targets are no whole numbers
    open_ = (F.col("gap") > FINE * F.col("target")) & (F.col("size") > 0) & (undrawn | (F.col("held") + 1 <= most))
    able = open_ & (F.col("size") < room)

    def edge(frame: DataFrame, bin_col: Column, below: Column) -> DataFrame:
        """Per source: the bin where the words reach the target, and the words below it."""
        w = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        summed = frame.groupBy("source", bin_col.alias("bin")).agg(F.sum("size").alias("n"), F.first("room").alias("room"), F.first(below).alias("below"))
        upto = F.col("below") + F.sum("n").over(w)
        found = summed.withColumn("upto", upto).where("upto >= room").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("n")).alias("below"))).alias("e"))
        return found.select(F.col("source").alias("s"), F.col("e.bin").alias("edge"), F.col("e.below").alias("words"))

    def marked(frame: DataFrame, at: DataFrame, names: tuple[str, str]) -> DataFrame:
        at = at.withColumnsRenamed({"edge": names[0], "words": names[1]})
        at = F.broadcast(at) if few else at
        return frame.join(at, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")

    w = Window.partitionBy("source").orderBy("y", "doc_id", "tie", "row")
    key = F.struct("y", "doc_id", "tie", "row")
    while True:
        fits = state.where(able).withColumns({"y": y, "room": room})
        if fits.isEmpty():
            break
        first = marked(fits, materialize(spark, edge(fits, bin_, F.lit(0)), "bins"), ("edge1", "words1"))
        inside = first.where(bin_ == F.col("edge1"))
        second = marked(first, materialize(spark, edge(inside, fine, F.col("words1")), "bins"), ("edge2", "words2"))
        last = second.where((bin_ == F.col("edge1")) & (fine == F.col("edge2")))
        upto = F.col("words2") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))
        reach = last.withColumn("upto", upto).where("upto >= room").groupBy("source").agg(F.min(key).alias("end"))
        ends = materialize(spark, reach.withColumnRenamed("source", "s"), "ends")
        # no end: all that fit are taken
        ended = state.withColumn("y", y).join(F.broadcast(ends) if few else ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        took = able & (F.col("end").isNull() | (key < F.col("end")))
        ended = materialize(spark, ended.withColumn("took", F.coalesce(took, F.lit(False))).drop("y", "end"), "took")
        used = materialize(spark, ended.where("took").groupBy(F.col("source").alias("s")).agg(F.sum("size").alias("used")), "used")
        state = ended.join(F.broadcast(used) if few else used, F.col("source").eqNullSafe(F.col("s")), "left")
        state = state.withColumns({"held": F.col("held") + F.col("took").cast("int"), "gap": F.col("gap") - F.coalesce("used", F.lit(0))}).drop("s", "used", "took")
    # nothing fits now: a copy that leaves the sum nearer to the target
    off = F.abs(F.col("size") - F.col("gap"))
    found = state.where(open_ & (off < F.col("gap"))).groupBy("source").agg(F.min(F.struct(off.alias("off"), "x", "doc_id", "tie", "row")).alias("p"))
    picks = materialize(spark, found.select(F.col("source").alias("s"), F.col("p.row").alias("pick")), "picks")
    done = state.join(F.broadcast(picks) if few else picks, F.col("source").eqNullSafe(F.col("s")), "left")
    done = done.withColumn("held", F.col("held") + F.coalesce(F.col("row") == F.col("pick"), F.lit(False)).cast("int"))
    return done.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("held")).cast("long").alias("taken"), "source", "tie")
