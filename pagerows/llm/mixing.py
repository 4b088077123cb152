"""Mixing sources to target weights by Pareto order sampling.

Sources share a number of words by weight; no source gives more than twice its words, and what that leaves over is shared
again. Within a source a document's expected copies grow with the bit length of its size, up to two, so that they
add up to the source's target: their whole part is certain. The fraction that remains is the inclusion probability
of one more copy; documents are ranked by their random odds divided by their inclusion odds, and the least ones are
taken until the words that the source still lacks are there. So the sample's size is fixed in words, not in documents.

All of it is DataFrame functions over (id, source, size, row) rows; texts are read once, to be counted. A source of any
size is ranked over many tasks: running totals are made within ranges, ranges are added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, ranked, small

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: After the first pass that many more go through the documents left that still fit.
FILLS = 2

WORD = r"[^\x20\x09-\x0D]+"


def chance(id_col: Column) -> Column:
    """A number in (0, 1) for each id, always the same one; rows with a null id have one for all."""
    digits = F.substring(F.sha2(F.coalesce(id_col.cast("string"), F.lit("")), 256), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``sources(source, words)`` -> with ``target``: ``share`` of all words by weight, the weights repeating over the sources
    in order of name (null last), none above ``most`` times its words, the excess shared again by weight. Only sums come
    to the driver, one set for each round of sharing."""
    order = ranked(sources.select(F.lit(0).alias("all"), F.col("source").isNull().alias("last"), "source", "words"), "all", ["last", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    named = cut(order.select("source", "words", weight.alias("weight"), (most * F.col("words")).alias("bound")))
    total = share * (named.agg(F.sum("words")).first()[0] or 0)
    level, held = 0.0, -1
    while True:
        above = F.lit(level) * F.col("weight") > F.col("bound")
        n, bound, free = named.agg(
            F.coalesce(F.sum(above.cast("int")), F.lit(0)), F.coalesce(F.sum(F.when(above, F.col("bound"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0))
        ).first()
        if n == held or free == 0:
            break
        level, held = (total - bound) / free, n
    return named.select("source", "words", F.least(F.lit(level) * F.col("weight"), F.col("bound").cast("double")).alias("target"))


def copies(classes: DataFrame, most: int = MOST) -> DataFrame:
    """``classes(source, target, value, words)``, values over 0 -> with ``expected``, the copies of each of its documents: ``c *
    value`` up to ``most``, where c makes the source's expected words its target. A source has as many classes as
    sizes have bit lengths."""
    down = Window.partitionBy("source").orderBy(F.col("value").desc())
    over = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    under = F.sum(F.col("value") * F.col("words")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    c = (F.col("target") - most * over) / under
    tried = classes.withColumn("c", c).withColumn("c", F.when(F.col("c") * F.col("value") <= most, F.col("c")))
    # of the classes that may be the largest one below the bound, the largest; none: all have the bound
    chosen = tried.withColumn("c", F.first("c", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return chosen.withColumn("expected", F.coalesce(F.least(F.col("c") * F.col("value"), F.lit(float(most))), F.lit(float(most)))).drop("c")


def mix(
    documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, fills: int = FILLS,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """``(id, size, source_size, target, taken)``, a row for each document: its words, those of its source, what the source is to
    give, and the words that the mix takes of the document, copies counted.

    Documents without words take none. A null source is a source, the last; null ids have one random number, and rank by
    size. Repeated rows stand for themselves. Without rows or words nothing is taken. Reruns agree, but which of several rows
    equal in id, source and size is taken once more may differ. A source misses its target by less than the least
    document left that didn't fit in the last pass."""
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = documents.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    value = F.when(F.col("size") > 0, F.length(F.bin("size"))).otherwise(0).cast("long")
    rows = rows.withColumn("value", value)
    classes = cut(rows.groupBy("source", "value").agg(F.sum("size").alias("words")))
    goals = cut(targets(classes.groupBy("source").agg(F.sum("words").alias("words")), weights, share, most))
    named = classes.where("value > 0").join(goals.select(F.col("source").alias("s"), "target"), F.expr("source <=> s")).drop("s")
    shares = cut(copies(named, most).withColumn("whole", F.floor("expected")).select("source", "value", "words", "target", "whole", (F.col("expected") - F.floor("expected")).alias("odds")))
    lacking = shares.groupBy("source").agg((F.max("target") - F.sum(F.col("whole") * F.col("words"))).alias("gap"))

    s = small(shares.select(F.col("source").alias("s"), F.col("value").alias("v"), "whole", "odds"))
    u = chance(F.col("id"))
    key = F.when(F.col("odds") > 0, (u / (1 - u)) / (F.col("odds") / (1 - F.col("odds"))))
    dealt = rows.join(s, F.expr("source <=> s and value = v"), "left").select("id", "source", "size", "row", F.coalesce("whole", F.lit(0)).alias("whole"), key.alias("key"))
    order = ["source", "key", "id", "size", "row"]
    spots = dealt.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    spots = cut(spots.drop("row").withColumn("part", F.shiftright("at", 33)).withColumn("more", F.lit(False)))
    gaps = lacking
    for _ in range(1 + fills):
        g = small(cut(gaps.select(F.col("source").alias("s"), "gap")))
        fit = F.when(~F.col("more") & F.col("key").isNotNull() & (F.col("size") <= F.col("gap")), F.col("size")).otherwise(0)
        flow = spots.join(g, F.expr("source <=> s"), "left").drop("s").withColumn("fit", fit)
        parts = flow.groupBy("source", "part").agg(F.sum("fit").alias("sum"))
        earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        base = small(cut(parts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))))
        within = F.sum("fit").over(Window.partitionBy("source", "part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        summed = flow.withColumn("within", within).join(base, F.expr("source <=> s and part = p"))
        taken = F.col("more") | ((F.col("fit") > 0) & (F.col("within") + F.col("before") <= F.col("gap")))
        spots = cut(summed.withColumn("more", taken).select(*spots.columns))
        won = spots.groupBy("source").agg(F.sum(F.when(F.col("more"), F.col("size")).otherwise(0)).alias("won"))
        gaps = lacking.join(won.withColumnRenamed("source", "s"), F.expr("source <=> s")).select("source", (F.col("gap") - F.col("won")).alias("gap"))
    t = small(goals.select(F.col("source").alias("s"), F.col("words").alias("source_size"), "target"))
    return spots.join(t, F.expr("source <=> s")).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("more").cast("long"))).alias("taken")
    )
