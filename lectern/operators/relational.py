"""Joins and ranks whose plain forms don't spread: substring and range joins, and a rank over all rows.

Substrings meet by q-grams and points meet intervals by bins, so both are equality joins with a check behind; a rank over
all rows is a range-partitioned sort with offsets. None compares every row with every other, sends a side of unknown size to all tasks,
or brings all rows to one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.sources.store import scratch

#: Length of the grams by which substrings meet.
GRAM = 3
#: Least width of a bin, as a power of two.
FINEST = -20


def _grams(c: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    last = F.length(c) - n + 1
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def contains_join(hay: DataFrame, needles: DataFrame, hay_col: str, needle_col: str) -> DataFrame:
    """(hay_col, needle_col): the different strings of needles that lie in the different strings of hay.

    A needle is looked for by its gram that the fewest hay strings have; one shorter than a gram is its own gram. Empty and null
    strings lie in nothing.
    """
    h = hay.select(F.col(hay_col).alias("__h")).where("__h <> ''").distinct()
    n = needles.select(F.col(needle_col).alias("__n")).where("__n <> ''").distinct()
    every = h.select("__h", F.explode_outer(F.concat(*[_grams(F.col("__h"), k) for k in range(1, GRAM + 1)])).alias("__g")).where("__g is not null")
    common = every.groupBy("__g").agg(F.count(F.lit(1)).alias("__c"))
    own = n.select("__n", F.explode_outer(F.when(F.length("__n") < GRAM, F.array("__n")).otherwise(_grams(F.col("__n"), GRAM))).alias("__g"))
    rarest = own.join(common, "__g", "left").groupBy("__n").agg(F.min(F.struct(F.coalesce("__c", F.lit(0)).alias("c"), F.col("__g").alias("g"))).alias("__m"))
    asked = rarest.where("__m.c > 0").select("__n", F.col("__m.g").alias("__g"))  # a gram that no hay string has ends the search
    return every.join(asked, "__g").where(F.instr("__h", F.col("__n")) > 0).select(F.col("__h").alias(hay_col), F.col("__n").alias(needle_col))


def touching(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """(left_col, right_col): pairs of strings of which one lies in the other."""
    return contains_join(left, right, left_col, right_col).unionByName(contains_join(right, left, right_col, left_col)).distinct()


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, keys: tuple[str, ...] = (), first: str | None = None) -> DataFrame:
    """points with each interval low <= point <= high and equal keys; with `first` only the interval with the least value there.

    An interval's level is the power of two not below its length, so it lies in two bins of that width at most, however long it
    is; a point stands in one bin of every level that the intervals have. Columns other than keys must differ in name; rows of points that repeat are joined each.
    """
    kinds = dict(points.dtypes + intervals.dtypes)
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6) if kinds[c].startswith(("timestamp", "date")) else F.col(c).cast("double")
    length = number(high) - number(low)
    level = F.when(length > 0, F.greatest(F.ceil(F.log2(length)), F.lit(FINEST))).otherwise(F.lit(FINEST)).cast("int")
    spans = intervals.where(F.col(low) <= F.col(high)).withColumn("__level", level)
    width = F.pow(F.lit(2.0), F.col("__level"))
    spans = spans.withColumn("__bin", F.explode(F.sequence(F.floor(number(low) / width), F.floor(number(high) / width))))
    levels = [r[0] for r in spans.select("__level").distinct().collect()]  # exponents of doubles: some hundred at most
    placed = points.where(F.col(point).isNotNull()).withColumn("__level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")))
    placed = placed.withColumn("__bin", F.floor(number(point) / width))
    if first is not None:
        placed = placed.withColumn("__row", F.xxhash64(*[F.col(c) for c in points.columns]))
    # both sides grow with their tables: neither is sent whole to the driver and all tasks, however small it is when packed
    found = placed.join(spans.hint("merge"), [*keys, "__level", "__bin"]).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high)))
    if first is None:
        return found.drop("__level", "__bin")
    own = [c for c in points.columns]
    best = found.groupBy(*own).agg(F.min_by(F.struct(*[c for c in intervals.columns if c not in keys]), F.struct(F.col(first))).alias("__i"))
    return best.select(*own, "__i.*")


def stabbed(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, least: str) -> DataFrame:
    """(point, n, least): for each different point how many intervals low <= point <= high hold it, and the least value of a column of theirs; points in none are left out.

    Intervals aren't joined with all their points. Time is cut into about as many bins as there are points. The bins inside of an interval are put together from
    few aligned runs of 1, 2, 4, ... bins, and every run is summed over its intervals; in the two bins at its ends, intervals are summed by
    the end that lies there. A point then meets the runs it lies in and the ends in its bin: rows grow with intervals plus points. Points must be finite.
    """
    kinds = dict(points.dtypes + intervals.dtypes)
    number = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6) if kinds[c].startswith(("timestamp", "date")) else F.col(c).cast("double")
    asked = points.select(point).where(F.col(point).isNotNull()).distinct()
    first, last, n = asked.agg(F.min(number(point)), F.max(number(point)), F.count(F.lit(1))).first()
    first, last = first or 0.0, last or 0.0
    width = max((last - first) / max(n, 1), 2.0**FINEST)
    place = lambda c: F.floor((c - F.lit(first)) / F.lit(width)).cast("long")
    end = int((last - first) // width) + 2  # no point has this bin
    own = intervals.where(F.col(low) <= F.col(high)).select(F.col(low).alias("__a"), F.col(high).alias("__b"), F.col(least).alias("__v"), number(low).alias("__x"), number(high).alias("__y"))
    own = own.where((F.col("__y") >= first) & (F.col("__x") <= last))
    own = own.select("__a", "__b", "__v", place(F.greatest("__x", F.lit(first - width))).alias("__i"), place(F.least("__y", F.lit(last + width))).alias("__j"))
    summed = lambda df, *keys: df.groupBy(*keys).agg(F.sum("__n").alias("__n"), F.min("__v").alias("__v"))
    one = F.lit(1).cast("long").alias("__n")
    none = lambda c: F.lit(None).cast(intervals.schema[c].dataType)
    apart = F.col("__i") < F.col("__j")
    level = lambda k: F.lit(k).cast("int").alias("__level")
    ends = summed(own.where(apart).select("__i", "__a", one, "__v"), "__i", "__a").select(level(0), F.col("__i").alias("__bin"), "__a", none(high).alias("__b"), "__n", "__v")
    ends = ends.unionByName(summed(own.where(apart).select("__j", "__b", one, "__v"), "__j", "__b").select(level(0), F.col("__j").alias("__bin"), none(low).alias("__a"), "__b", "__n", "__v"))
    ends = ends.unionByName(summed(own.where(~apart).select("__i", "__a", "__b", one, "__v"), "__i", "__a", "__b").select(level(0), F.col("__i").alias("__bin"), "__a", "__b", "__n", "__v"))
    # bins l to r - 1 lie inside; of the runs of 2 ** k bins from l to r, an odd first and an odd last one belong to no longer run
    inside = own.select((F.greatest("__i", F.lit(-1)) + 1).alias("__l"), F.least("__j", F.lit(end)).alias("__r"), "__v").where("__l < __r")
    inside = summed(inside.select("__l", "__r", one, "__v"), "__l", "__r")
    levels = list(range(end.bit_length() + 1))
    up = lambda k: -F.shiftright(-F.col("__l"), k)
    down = lambda k: F.shiftright(F.col("__r"), k)
    runs = []
    for k in levels:
        some = up(k) < down(k)
        runs.append(F.when(some & (up(k) % 2 == 1), F.struct(level(k), up(k).alias("__bin"))))
        runs.append(F.when(some & (down(k) % 2 == 1), F.struct(level(k), (down(k) - 1).alias("__bin"))))
    made = inside.select("__n", "__v", F.explode(F.filter(F.array(*runs), lambda x: x.isNotNull())).alias("__run")).select("__run.*", "__n", "__v")
    made = summed(made, "__level", "__bin").select("__level", "__bin", none(low).alias("__a"), none(high).alias("__b"), "__n", "__v")
    placed = asked.select(point, F.explode(F.transform(F.array(*map(F.lit, levels)), lambda k: F.struct(k.alias("__level"), place(number(point)).alias("__at")))).alias("__run"))
    placed = placed.select(point, F.col("__run.__level").alias("__level"), F.expr("shiftright(__run.__at, __run.__level)").alias("__bin"))
    # neither side is sent whole to all tasks
    found = placed.join(ends.unionByName(made).hint("merge"), ["__level", "__bin"])
    found = found.where((F.col("__a").isNull() | (F.col(point) >= F.col("__a"))) & (F.col("__b").isNull() | (F.col(point) <= F.col("__b"))))
    return found.groupBy(point).agg(F.sum("__n").alias("n"), F.min("__v").alias("least"))


def rank_all(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the rank, from 1, of every row in the whole order, which must end in a unique key.

    Rows are sorted over range partitions and written once, as bounds drawn anew would deal them otherwise; a row's rank is its place in its part
    behind the sizes of the parts before.
    """
    spark = df.sparkSession
    at = scratch(spark)
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    placed.select("*", F.shiftright("__id", 33).cast("int").alias("__part"), F.col("__id").bitwiseAND((1 << 33) - 1).alias("__place")).drop("__id").write.parquet(at)
    rows = spark.read.parquet(at)
    sizes = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    # a row for each partition
    return rows.join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__place") + 1).drop("__part", "__place", "__before")
