"""Exact percentiles of groups of any size.

Values are counted first, so a group is a list of distinct values with counts. These are sorted by
group and value over range partitions; a large group spans several. What stands before a partition's
share of a group is the sum of the shares before it (one row a partition and group), and within a
partition a running sum says which ranks each value covers. Only the values that cover a wanted rank
meet by group. So no task holds more than a range partition, whatever share of the rows a group has.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.frames import kept


def runs_of(rows, group, value, parts=None):
    """Distinct values with their number `__n`, dealt by range over `__part`; nulls are left out."""
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    counts = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("__n"))
    return kept(counts.repartitionByRange(parts, *group, value).withColumn("__part", F.spark_partition_id()))


def percentiles(rows, group, value, shares, parts=None):
    """The group columns and, for each name in `shares`, that exact percentile of a numeric column, between neighbours in proportion.

    Equals percentile(value, share). Null groups are groups; groups without a value give no row.
    """
    runs = runs_of(rows, group, value, parts)
    share = runs.groupBy("__part", *group).agg(F.sum("__n").alias("__own"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    share = share.withColumns({"__before": F.coalesce(F.sum("__own").over(before), F.lit(0)), "__all": F.sum("__own").over(whole)}).drop("__own")
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in ("__part", *group)]
    sums = Window.partitionBy("__part", *group).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    covered = runs.withColumn("__sum", F.sum("__n").over(sums))
    covered = covered.join(share, same(covered, share)).select(*(covered[c] for c in group), F.col(value).cast("double").alias("__v"), (F.col("__before") + F.col("__sum") - F.col("__n")).alias("__from"), (F.col("__before") + F.col("__sum")).alias("__to"), "__all")
    at = {name: F.lit(float(q)) * (F.col("__all") - 1) for name, q in shares.items()}
    holds = lambda rank: (F.col("__from") <= rank) & (rank < F.col("__to"))
    wanted = F.lit(False)
    for place in at.values():
        wanted = wanted | holds(F.floor(place)) | holds(F.ceil(place))
    pick = lambda rank: F.max(F.when(holds(rank), F.col("__v")))
    ends = covered.where(wanted).groupBy(*group).agg(*(x for name, place in at.items() for x in (pick(F.floor(place)).alias(f"__lo_{name}"), pick(F.ceil(place)).alias(f"__hi_{name}"), F.max(place).alias(f"__at_{name}"))))
    between = lambda n: F.when(F.col(f"__lo_{n}") == F.col(f"__hi_{n}"), F.col(f"__lo_{n}")).otherwise((F.ceil(f"__at_{n}") - F.col(f"__at_{n}")) * F.col(f"__lo_{n}") + (F.col(f"__at_{n}") - F.floor(f"__at_{n}")) * F.col(f"__hi_{n}"))
    return ends.select(*group, *(between(n).alias(n) for n in shares))
