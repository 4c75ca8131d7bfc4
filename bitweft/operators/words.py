"""Dictionaries, cumulative tables and word models as aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitweft.session import Workspace


def dictionary(tokens: DataFrame, keys: list[str], key: str) -> DataFrame:
    """For tokens(<keys order>, key): key, key_id in first-seen order, key_count.

    Ids come from the order of first places: a grouped minimum, then a rank over the distinct keys only. A null key is a
    key like any other; ties in first place (one token list with equal keys) do not occur, as places are distinct."""
    first = tokens.groupBy(key).agg(F.min(F.struct(*keys)).alias("first"), F.count(F.lit(1)).alias("key_count"))
    # Dense ids without one sorted task: the rows of a range partitioning by first place are written with their partition
    # and place, so that the offsets of the partitions come from the very rows that get them.
    ws = Workspace(tokens.sparkSession, "dictionary")
    dealt = first.repartitionByRange("first").sortWithinPartitions("first").withColumn("__p", F.spark_partition_id()).withColumn("__r", F.monotonically_increasing_id())
    dealt = ws.put(dealt.select(key, "key_count", "__p", (F.col("__r") - F.shiftleft(F.col("__p").cast("long"), 33)).alias("__i")), "sorted")
    sizes = dealt.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row per partition, so the window is as small as their number
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    return dealt.join(F.broadcast(offsets), "__p").select(key, (F.col("__i") + F.col("__o")).alias("key_id"), "key_count")


def cumulative(counts: DataFrame, group: list[str], symbol: str, count: str) -> DataFrame:
    """group, symbol, count, low, high, total, escape: prefix sums by symbol; the escape is the singletons and one."""
    w = Window.partitionBy(*group)
    run = w.orderBy(symbol).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.select(*group, symbol, count, (F.sum(count).over(run) - F.col(count)).alias("low"), F.sum(count).over(run).alias("high"), F.sum(count).over(w).alias("total"), (F.sum(F.when(F.col(count) == 1, 1).otherwise(0)).over(w) + 1).alias("escape"))


def back_off(pairs: DataFrame, singles: DataFrame, targets: DataFrame) -> DataFrame:
    """targets(prev, word): bits by order 1, then order 0, then `length + 1` characters at 8 bits.

    An escape costs types / (count + types) of its level; a word of order 1 is not excluded from order 0."""
    one = pairs.groupBy("prev").agg(F.sum("n").alias("n1"), F.count(F.lit(1)).alias("t1"))
    zero = singles.agg(F.sum("n").alias("n0"), F.count(F.lit(1)).alias("t0"))
    out = targets.join(one, "prev", "left").join(pairs.select("prev", "word", F.col("n").alias("c1")), ["prev", "word"], "left").join(singles.select("word", F.col("n").alias("c0")), "word", "left").crossJoin(F.broadcast(zero))
    first = F.when(F.col("c1").isNotNull(), -F.log2(F.col("c1") / (F.col("n1") + F.col("t1")))).when(F.col("t1").isNotNull(), -F.log2(F.col("t1") / (F.col("n1") + F.col("t1")))).otherwise(F.lit(0.0))
    second = F.when(F.col("c1").isNotNull(), F.lit(0.0)).when(F.col("c0").isNotNull(), -F.log2(F.col("c0") / (F.col("n0") + F.col("t0")))).otherwise(-F.log2(F.col("t0") / (F.col("n0") + F.col("t0"))))
    spelled = F.when(F.col("c1").isNull() & F.col("c0").isNull(), 8.0 * (F.char_length("word") + 1)).otherwise(F.lit(0.0))
    return out.select("prev", "word", (first + second + spelled).alias("bits"))
