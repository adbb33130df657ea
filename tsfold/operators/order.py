"""Dense positions inside groups without putting a group in one task.

``row_number() OVER (PARTITION BY g ORDER BY k)`` sorts a whole group in one
task; a project holding a third of all rows would sit on one core. Instead:

1. store the rows once with a row number (range partitioning samples its
   input, which must not compute it a second time), and range-partition the
   narrow keys alone on (g, k), sorted inside partitions -- a hot group is
   split over many range partitions by its order key, and long texts stay
   where they are;
2. ``monotonically_increasing_id`` then encodes (partition index, row index
   inside the partition) in sorted order; the result is stored so ids
   and range bounds stay fixed across the following jobs;
3. per (partition, group): row count and first local index -- at most
   #partitions + #groups narrow rows;
4. per group, a running sum of those counts over partition index gives each
   (partition, group) its offset; this window holds at most #partitions rows
   per group;
5. position = offset + (local index - first local index) + 1; it joins the
   stored rows by their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored as _stored

_LOCAL_BITS = 33


def dense_rank_within(df: DataFrame, group: list[str], order: list, out: str = "pos",
                      partitions: int | None = None, whole: bool = False) -> DataFrame:
    """``whole``: rows without long texts are sorted as they are, not joined again to their keys."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    stored = _stored(df.withColumn("_rid", F.monotonically_increasing_id()), "ranked")
    wide = len(df.columns) > len(keys) and not whole
    ranged = _stored(
        (stored.select(*keys, "_rid") if wide else stored.drop("_rid"))
        .repartitionByRange(n, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_mid", F.monotonically_increasing_id()), "ranks")
    ranged = ranged.withColumn("_pid", F.shiftright("_mid", _LOCAL_BITS)).withColumn(
        "_loc", F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    )
    cnt = ranged.groupBy("_pid", *group).agg(
        F.count(F.lit(1)).alias("_n"), F.min("_loc").alias("_first")
    )
    w = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offs = cnt.select("_pid", *group, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    placed = ranged.join(offs, ["_pid", *group]).withColumn(
        out, (F.col("_off") + F.col("_loc") - F.col("_first") + 1).cast("bigint"))
    if not wide:
        return placed.drop("_mid", "_pid", "_loc", "_first", "_off")
    return stored.join(placed.select("_rid", out), "_rid").drop("_rid")
