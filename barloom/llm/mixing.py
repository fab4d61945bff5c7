"""Mix sources to target weights by Pareto order sampling.

Every source gets a target number of words. Its documents are taken as often as target / size goes
whole, for certain. The rest is filled by a Pareto sample of one further copy: a document's
inclusion probability is proportional to its words, those that would exceed 1 are certain and taken
out of the proportion, and the probabilities' words add up to the rest. The sample has a fixed number
of documents, the sum of the probabilities: those with the least random odds divided by their
inclusion odds. A few documents at the end of it are then added or left out where that brings the
source's words nearer to its target.

Nothing is sorted whole: certain sizes are found on the table of different sizes, and ranks fall
into fine steps, of which only the one where a source's sample ends is ordered.

Defined cases: a null or empty text has size 0; a null source is a source, last in order; a null
id draws like any other id; rows that repeat an id and a text draw one number, so all or none of
them get the further copy; a source without words gets the target 0; other columns are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import BLANK, NO_ID, keep

#: Steps that a source's ranks fall into.
STEPS = 4096


def word_count(text) -> F.Column:
    """Runs of characters outside BLANK."""
    return F.coalesce(F.size(F.array_remove(F.split(text, f"[{BLANK}]+"), "")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int], most: float) -> DataFrame:
    """Add target to (source, source_size): shares of all words by weight, at most `most` times a size.

    Weights repeat over the sources in code point order, null last. What a source can't take goes
    to the others by weight; each pass settles every source above its limit, until none is.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rows = sources.withColumn("weight", F.get(cycle, ((F.row_number().over(order) - 1) % len(weights)).cast("int")))
    rows = keep(rows, "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        held = F.lit(most) * F.col("source_size") <= F.lit(level) * F.col("weight")
        free, fixed = rows.agg(F.sum(F.when(~held, F.col("weight"))), F.sum(F.when(held, F.lit(most) * F.col("source_size")))).first()
        now = (total - (fixed or 0.0)) / free if free else level
        if now <= level:
            break
        level = now
    return rows.withColumn("target", F.least(F.lit(most) * F.col("source_size"), F.lit(level) * F.col("weight")).cast("double")).drop("weight")


def proportions(sizes: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, unit, members): inclusion probabilities are least(1, unit * size), their words add up to room; members: their sum.

    From the greatest size down: with those above a size certain, unit follows from the rest; the
    first size that it doesn't make certain ends the search.
    """
    table = sizes.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))  # a row for each different size
    above, upto = down.rowsBetween(Window.unboundedPreceding, -1), down.rowsBetween(0, Window.unboundedFollowing)
    words, square = F.col("n") * F.col("size").cast("double"), F.col("n") * F.col("size").cast("double") * F.col("size")
    table = table.withColumns({"certain": F.coalesce(F.sum(words).over(above), F.lit(0.0)), "count": F.coalesce(F.sum("n").over(above), F.lit(0)), "squares": F.sum(square).over(upto), "words": F.sum(words).over(upto)})
    table = table.join(sources.select(F.col("source").alias("s"), "room"), F.col("source").eqNullSafe(F.col("s"))).where("room > 0")
    table = table.withColumn("unit", F.greatest((F.col("room") - F.col("certain")) / F.col("squares"), F.lit(0.0)))
    first = table.where("unit * size <= 1").groupBy("source").agg(F.max_by(F.struct("unit", "count", "words"), "size").alias("f"))
    return first.select("source", "f.unit", F.round(F.col("f.count") + F.col("f.unit") * F.col("f.words")).cast("long").alias("members"))


def mix(
    docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", with_row: bool = False, closing: int = 4
) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) of every document, and its whole row as a struct if asked for.

    closing: documents that may be added to or left out of a source's sample at the end.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text).alias("h")]
    sizes = keep(docs.select(*thin), "sizes")
    sources = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = keep(sources.withColumn("sure", F.floor(ratio + 1e-12).cast("long")).withColumn("room", F.col("target") - F.col("sure") * F.col("source_size")), "targets")
    drawn = proportions(sizes, sources)
    sources = keep(sources.join(drawn.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"), "proportions")

    def ranked(rows: DataFrame) -> DataFrame:
        """rank: odds by inclusion odds as q / (1 + q), 0 for certain documents, 1 for those that can't be drawn; key orders a source's documents."""
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "h"), 11).cast("double") + 0.5) / float(1 << 53)
        p = F.coalesce(F.least(F.col("unit") * F.col("size"), F.lit(1.0)), F.lit(0.0))
        rank = F.when(F.col("p") >= 1, 0.0).when(F.col("p") <= 0, 1.0).otherwise(F.col("u") * (1 - F.col("p")) / (F.col("u") * (1 - F.col("p")) + (1 - F.col("u")) * F.col("p")))
        out = rows.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumns({"u": u, "p": p}).withColumn("rank", rank)
        return out.withColumn("key", F.struct("rank", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "h"))

    each = ranked(sizes).where("members > 0 AND p > 0").withColumn("step", F.floor(F.col("rank") * STEPS).cast("int"))
    steps = each.groupBy("source", "members", "step").agg(F.count("*").alias("n"))
    steps = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("step")))  # STEPS + 1 rows a source
    ends = steps.where("upto >= members").groupBy("source").agg(F.min(F.struct("step", (F.col("members") - F.col("upto") + F.col("n")).alias("nth"))).alias("end")).select(F.col("source").alias("s"), F.col("end.step").alias("last"), F.col("end.nth").alias("nth"))
    edge = each.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("step") == F.col("last")))
    edge = edge.withColumn("place", F.row_number().over(Window.partitionBy("source", "step").orderBy("key"))).where("place = nth")
    edge = keep(edge.select(F.col("source").alias("s"), F.col("key").alias("edge")), "edges")

    def picked(rows: DataFrame) -> DataFrame:
        out = ranked(rows).join(edge, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
        return out.withColumn("extra", F.coalesce((F.col("p") > 0) & (F.col("key") <= F.col("edge")), F.lit(False)).cast("long"))

    # documents that change sides, one a source and round, where one brings the sum nearer
    sample = keep(picked(sizes).select("source", "size", "p", "key", "sure", "extra", "room"), "sample")
    gaps = sample.groupBy("source").agg((F.first("room") - F.sum(F.col("extra") * F.col("size"))).alias("gap"))
    flips = None
    for _ in range(closing):
        free = sample.where((F.col("size") > 0) & (F.col("p") < 1) & (F.col("sure") < most)).withColumn("delta", F.when(F.col("extra") == 1, -F.col("size")).otherwise(F.col("size")))
        if flips is not None:
            free = free.join(flips.select(F.col("source").alias("s"), F.col("key").alias("k")), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")), "left_anti")
            moved = flips.groupBy("source").agg(F.sum("delta").alias("moved"))
            left = gaps.join(moved.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", (F.col("gap") - F.coalesce("moved", F.lit(0))).alias("gap"))
        else:
            left = gaps
        near = free.join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).withColumn("miss", F.abs(F.col("gap") - F.col("delta"))).where(F.col("miss") < F.abs("gap"))
        best = near.groupBy("source").agg(F.min(F.struct("miss", "key", "delta")).alias("b")).select("source", F.col("b.key").alias("key"), F.col("b.delta").alias("delta"))
        flips = keep(best if flips is None else flips.unionByName(best), "flips")  # a row for each source and round
    rows = docs.select(*thin, F.struct(*docs.columns).alias("row")) if with_row else sizes
    out = picked(rows)
    if flips is not None:
        out = out.join(flips.select(F.col("source").alias("s"), F.col("key").alias("k"), "delta"), F.col("source").eqNullSafe(F.col("s")) & (F.col("key") == F.col("k")), "left")
        out = out.withColumn("extra", F.when(F.col("delta").isNull(), F.col("extra")).otherwise(1 - F.col("extra")))
    out = out.withColumn("copies", F.col("sure") + F.col("extra"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if with_row else []))
