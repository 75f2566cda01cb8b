"""The partial-sort family as tables: the smaller value stays per key, the m smallest are pulled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from waymark.staging import stage


def insert(pairs: DataFrame) -> DataFrame:
    """key, value: the least value of each key."""
    return pairs.groupBy("key").agg(F.min("value").alias("value"))


def merge(left: DataFrame, right: DataFrame) -> DataFrame:
    return insert(left.unionByName(right))


def prepend(held: DataFrame, ahead: DataFrame) -> DataFrame:
    """Pairs put ahead take the place of the same key's, the least of them if a key comes twice."""
    new = insert(ahead).withColumnRenamed("value", "new")
    return held.join(new, "key", "full").select("key", F.coalesce("new", "value").alias("value"))


def pull(held: DataFrame, m: int) -> DataFrame:
    """The m smallest by (value, key), and the least value left behind as `bound` (null if nothing is)."""
    taken = held.orderBy("value", "key").limit(m)
    last = taken.agg(F.max(F.struct("value", "key")).alias("last"))
    rest = held.join(F.broadcast(last), F.struct("value", "key") > F.col("last")).agg(F.min("value").alias("bound"))  # one row each
    return taken.join(F.broadcast(rest), F.lit(True))


def separator(held: DataFrame, bound: DataFrame) -> DataFrame:
    """One past the greatest key that stands at the bound (bound: one row)."""
    return held.join(F.broadcast(bound), F.col("value") == F.col("bound")).agg((F.max("key") + 1).alias("separator"))


def pivots(members: DataFrame) -> DataFrame:
    """grp, pivot: each group's member of least (value, key)."""
    return members.groupBy("grp").agg(F.min_by("key", F.struct("value", "key")).alias("pivot"))


def band(value: Column, low: float, middle: float, high: float) -> Column:
    """[middle, high) is inserted, [low, middle) put ahead, less is rescued, the rest lies beyond."""
    return F.when((value >= middle) & (value < high), "insert").when((value >= low) & (value < middle), "prepend").when(value < high, "rescue").otherwise("beyond")


def less_pair(value: Column, key: Column, bound: Column, bound_key: Column) -> Column:
    """(value, key) < (bound, bound_key); a null bound_key stands below every key: values below the bound only."""
    return (value < bound) | ((value == bound) & F.coalesce(key < bound_key, F.lit(False)))


def region_fraction(size: Column, frontier: Column) -> Column:
    """The sorted region's share of the frontier; 0 where there is no frontier."""
    return F.when(frontier > 0, size / frontier).otherwise(0.0)


def merge_smaller(left: DataFrame, right: DataFrame, m: int, other_m: int) -> DataFrame:
    """merge() with the structures' block sizes: one that isn't empty must come from smaller blocks."""
    if other_m >= m and right.head(1):
        raise ValueError("only a structure of smaller blocks can be merged")
    return merge(left, right)


def pull_each(held: DataFrame, by: list[str], m: int, order: list[str] | None = None) -> DataFrame:
    """Of each group the m smallest rows in the order of (value, key), or of `order` (a label struct, say), with `bound`:
    the first of those columns in the row behind them, null if there is none.

    A task hands on m + 1 rows of a group at most: ranks that are filtered are limited before the exchange too."""
    order = order or ["value", "key"]
    ranked = held.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_nth") <= m + 1)
    bound = F.max(F.when(F.col("_nth") == m + 1, F.col(order[0]))).over(Window.partitionBy(*by))
    return ranked.withColumn("bound", bound).filter(F.col("_nth") <= m).drop("_nth")


#: Parts into which a round of kth() cuts each group's range, and rows of a group that its last step sorts.
BINS, FEW = 1024, 4096


def kth(pairs: DataFrame, by: str, k: int) -> DataFrame:
    """by, value, key: the kth smallest (value, key) of each group of pairs(by, value, key), from 1; groups of fewer rows
    have none. value and key are numbers that aren't null; equal pairs count each.

    Selection without a sort: a round counts each group's rows in BINS parts of the range that is left (a partial count
    before the exchange, least and greatest value of each part beside it) and goes on with the part that holds the kth. Once all
    values are equal the keys decide in the same way. A part with both the least and the greatest is never the whole range,
    so that every round narrows it; at FEW rows or fewer, or a single pair, a group is done."""
    rows = pairs.select(by, "value", "key").filter(F.col("value").isNotNull() & F.col("key").isNotNull())
    ends = [f(c).alias(f"{n}_{c}") for c in ("value", "key") for n, f in (("low", F.min), ("high", F.max))]
    found, names = None, [f"{n}_{c}" for c in ("value", "key") for n in ("low", "high")]
    open_ = stage(rows.groupBy(by).agg(F.count("*").alias("n"), *ends).filter(F.col("n") >= k).withColumn("k", F.lit(k).cast("long")), "ranges")
    spread = F.col("low_value") < F.col("high_value")
    while open_.head(1):
        single = ~spread & (F.col("low_key") == F.col("high_key"))
        inside = (F.col("value").between(F.col("low_value"), F.col("high_value"))) & (spread | F.col("key").between(F.col("low_key"), F.col("high_key")))
        few = open_.filter(~single & (F.col("n") <= FEW))
        picked = few.select(by, "k", *names).join(rows, by).filter(inside).groupBy(by, "k").agg(F.sort_array(F.collect_list(F.struct("value", "key"))).alias("all"))
        done = open_.filter(single).select(by, F.col("low_value").alias("value"), F.col("low_key").alias("key"))
        done = stage(done.unionByName(picked.select(by, F.get("all", F.col("k").cast("int") - 1).alias("one")).select(by, "one.value", "one.key")), "found")
        found = done if found is None else found.unionByName(done)
        rest = open_.filter(~single & (F.col("n") > FEW))
        if not rest.head(1):
            break
        part = lambda c: F.least(F.lit(BINS - 1), F.floor((F.col(c) - F.col(f"low_{c}")) * BINS / (F.col(f"high_{c}") - F.col(f"low_{c}")))).cast("int")
        bins = rest.select(by, *names).join(rows, by).filter(inside).withColumn("bin", F.when(spread, part("value")).otherwise(part("key")))
        counts = bins.groupBy(by, "bin").agg(F.count("*").alias("n"), *ends)
        upto = F.sum("n").over(Window.partitionBy(by).orderBy("bin"))  # BINS rows a group at most
        at = counts.withColumn("upto", upto).join(rest.select(by, "k"), by).filter((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k")))
        open_ = stage(at.select(by, "n", *names, (F.col("k") - F.col("upto") + F.col("n")).alias("k")), "ranges")
    return found if found is not None else rows.limit(0)
