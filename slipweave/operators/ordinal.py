"""Global positions without a one-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.shared import materialize

_LOCAL = (1 << 33) - 1


def with_ordinal(frame: DataFrame, *order, name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Adds the 0-based position in `order`; a column called `name` is replaced.

    Range-partition and sort, number rows inside each partition, then add the
    counts of the partitions before. Only one row per partition meets in the
    final window. The sorted rows are written first: sampling could cut the
    ranges elsewhere in a second evaluation. Rows travel as one struct, so their
    columns may have any names.
    """
    n = partitions or int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = frame.repartitionByRange(n, *order).sortWithinPartitions(*order)
    cut = materialize(cut.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("id")), "ordinal")
    cut = cut.withColumn("part", F.shiftright("id", 33))
    sizes = cut.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("id").bitwiseAND(F.lit(_LOCAL))
    kept = [F.col("row")[c].alias(c) for c in frame.columns if c != name]
    return cut.join(F.broadcast(before), "part").select(*kept, place.alias(name))
