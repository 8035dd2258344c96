"""Row numbers within a key without a task per key, and the k-th free number of a set of taken ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import WorkDir

#: rows of piece sizes up to which they are broadcast (some 100 bytes each)
MOST_PIECES = 50_000
#: numbers that share a block when ranges meet the rows they hold
BLOCK = 64


def with_numbers(df: DataFrame, keys: list[str], order: list[str], work: WorkDir, name: str, column: str) -> DataFrame:
    """``df`` with ``column``: its number from 0 in the order of ``order`` (total within a key).

    Rows are range-partitioned and sorted by key and order, and written with their place.  A key that spans partitions has one
    row of sizes for each, and the sizes before a partition shift its places.  No task holds a key.
    """
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    rows = work.materialize(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
                            .withColumns({"__piece": F.spark_partition_id(), "__place": place}), f"{name}/numbered")
    before = Window.partitionBy(*keys).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = work.materialize(
        rows.groupBy(*keys, "__piece").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__held"))
        .withColumn("__before", F.coalesce(F.sum("__held").over(before), F.lit(0))).drop("__held"), f"{name}/pieces")
    if pieces.count() <= MOST_PIECES:
        pieces = F.broadcast(pieces)
    return (rows.join(pieces, [*keys, "__piece"]).withColumn(column, F.col("__place") - F.col("__first") + F.col("__before"))
            .drop("__piece", "__place", "__first", "__before"))


def free_numbers(rows: DataFrame, taken: DataFrame, keys: list[str], rank: str, column: str, work: WorkDir, name: str) -> DataFrame:
    """``rows`` with ``column``: the ``rank``-th (from 1) of the numbers from 2 on that are not ``taken`` in its key.

    ``taken``: keys and ``n``.  Before the i-th taken number t lie t - 1 - i free ones (its *depth*), so the free number of rank m
    is m + 1 plus the taken numbers of a depth under m.  Taken numbers thus cut the ranks into ranges of one shift each; ranks and
    ranges meet by block, so a row sees the ranges of ``BLOCK`` ranks, however many numbers are taken.
    """
    mine = taken.where("n >= 2").select(*keys, F.col("n").cast("long").alias("n")).distinct()
    mine = mine.join(rows.select(*keys).distinct(), keys, "left_semi")
    sorted_ = work.materialize(with_numbers(mine, keys, ["n"], work, name, "__i")
                               .select(*keys, (F.col("__i") + 1).alias("i"), (F.col("n") - 2 - F.col("__i")).alias("depth")), f"{name}/depths")
    # range j: ranks over the depth of the j-th taken number up to that of the next; range 0 lies before the first
    after = sorted_.select(*keys, (F.col("i") - 1).alias("i"), F.col("depth").alias("till"))
    start = sorted_.where("i = 1").select(*keys, F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("depth"))
    ranges = sorted_.unionByName(start).join(after, [*keys, "i"], "left")
    last = rows.groupBy(*keys).agg(F.max(rank).alias("__last"))
    ranges = (ranges.join(last, keys).withColumn("till", F.least(F.coalesce("till", "__last"), "__last")).where("till > depth")
              .withColumn("__block", F.explode(F.sequence(F.expr(f"depth div {BLOCK}"), F.expr(f"(till - 1) div {BLOCK}"))))
              .select(*keys, "__block", F.col("depth").alias("__lo"), F.col("till").alias("__hi"), F.col("i").alias("__shift")))
    got = rows.withColumn("__block", F.expr(f"({rank} - 1) div {BLOCK}"))
    r, g = got.alias("r"), ranges.alias("g")
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in [*keys, "__block"]]
    inside = (F.col(f"r.{rank}") > F.col("g.__lo")) & (F.col(f"r.{rank}") <= F.col("g.__hi"))
    cond = inside
    for c in same:
        cond = cond & c
    return r.join(g, cond, "left").select(
        *[F.col(f"r.{c}") for c in rows.columns], (F.col(f"r.{rank}") + 1 + F.coalesce("g.__shift", F.lit(0))).alias(column))
