"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialize


def numbered(df: DataFrame, order: list[str], name: str, start: int = 0, partitions: int | None = None) -> DataFrame:
    """`df` with `name`, the place of each row in `order`, from `start`.

    Rows are partitioned by range, sorted where they are and written; a partition's numbers begin after those of the
    partitions before it, whose counts (a row per partition) are all that is brought together.  They are written first, as
    ranges are drawn from a sample and may be others when they are drawn again."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    low = F.lit((1 << 33) - 1)
    placed = materialize(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(low)))
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("__part", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    # One row per partition: the bound is the number of partitions.
    return placed.join(F.broadcast(before), "__part").withColumn(name, F.col("__at") + F.col("__before") + start).drop("__part", "__at", "__before")
