"""Numbering of all rows in an order without bringing them to one task.

Rows are sorted by range over partitions; each counts its rows, and the counts of the partitions before
it (one number a partition, the only thing that is added up in one place) are its offset. Pages after a
known row need no number at all: the row's key tells where to go on.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.frames import kept


def numbered(rows, order, name="urut", parts=None):
    """The rows with their number from 1 in an order that must be total.

    `order` are columns or sort expressions. The sorted rows are checkpointed: partition numbers hold for a
    second reading, and the range bounds are sampled once. Empty tables give no rows.
    """
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = kept(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__own", F.monotonically_increasing_id()))
    counts = sorted_.groupBy("__part").agg(F.count("*").alias("__n"), F.min("__own").alias("__first"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("__part", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # one row a partition
    out = sorted_.join(F.broadcast(offsets), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__own") - F.col("__first") + 1).drop("__part", "__own", "__before", "__first")


def after(rows, keys, last):
    """Rows behind a row in an order of columns. keys: (column, ascending); last: the row's values, None: from the start.

    A pushed-down filter: earlier pages are not sorted or counted again. Nulls come first when ascending, last when descending.
    """
    if last is None:
        return rows
    out, equal = F.lit(False), F.lit(True)
    for (c, up), v in zip(keys, last, strict=True):
        column, value = F.col(c), F.lit(v)
        if v is None:
            behind = column.isNotNull() if up else F.lit(False)
        else:
            behind = (column > value) if up else (column < value) | column.isNull()
        out, equal = out | (equal & F.coalesce(behind, F.lit(False))), equal & column.eqNullSafe(value)
    return rows.where(out)


def page(rows, keys, size, last=None):
    """The next `size` rows behind a row."""
    order = [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]
    return after(rows, keys, last).orderBy(*order).limit(size)
