"""An append-only log of contact changes, partitioned by day, and what is read from it.

A run over captured cards writes one folder of the log: each change with the time of the run, under
its day. The stored businesses come back with the new values and a bumped checked time. Reads ask
for a time from which on they need rows, so only the folders of those days are listed and read.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.operators.ledger import contact_changes

LOG = "place_key string, field string, lama string, baru string, changed_at timestamp, hari date"
FIELDS = ("telepon", "website", "email")


def appended(changes, at, path):
    """Changes (place_key, field, lama, baru) written to the log with the time `at`; a rerun of the same time replaces nothing but its own day."""
    rows = changes.select("place_key", "field", "lama", "baru", F.lit(at).cast("timestamp").alias("changed_at"))
    rows.withColumn("hari", F.to_date("changed_at")).write.mode("append").partitionBy("hari").parquet(path)


def log(spark, path):
    """The whole log; filters on `hari` prune its folders."""
    return spark.read.schema(LOG).parquet(path)


def refreshed(businesses, cards, at):
    """(businesses after a run over cards at that time, changes): changed fields take the new value, checked ones the time.

    Null, blank, `-` and `n/a` change nothing; a business that the run did not meet keeps its times.
    """
    fields = [f for f in FIELDS if f in businesses.columns]
    changes = contact_changes(cards, businesses, fields)
    new = changes.groupBy("place_key").agg(*(F.max(F.when(F.col("field") == f, F.col("baru"))).alias(f"_{f}") for f in fields))
    met = cards.where("place_key <> ''").select("place_key").distinct().withColumn("_met", F.lit(True))
    both = businesses.join(new, "place_key", "left").join(met, "place_key", "left")
    kept = [F.coalesce(f"_{c}", c).alias(c) if c in fields else F.when(F.col("_met"), F.lit(at)).otherwise(F.col(c)).alias(c) if c == "last_checked_at" else F.col(c) for c in businesses.columns]
    return both.select(*kept), changes


def since(changes, at, days):
    """Changes of the last `days` days before a time: whole folders first, then the exact time."""
    start = F.lit(at).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS")
    return changes.where((F.col("hari") >= F.to_date(start)) & (F.col("changed_at") >= start))


def newest_first():
    return [F.desc("changed_at"), F.asc("place_key"), F.asc("field"), F.asc("baru")]


def latest(changes, n):
    """The n latest changes of all, numbered; only n rows of each task are compared."""
    top = changes.orderBy(*newest_first()).limit(n)
    return top.withColumn("n", F.row_number().over(Window.orderBy(*newest_first())))  # n rows


def latest_of_each(changes, n):
    """The n latest changes of each business, numbered."""
    w = Window.partitionBy("place_key").orderBy(*newest_first())
    return changes.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n)


def detail(businesses, changes, n=20):
    """Each business with its latest n changes, newest first, as one array; none is an empty one."""
    rows = latest_of_each(changes, n).groupBy("place_key").agg(F.array_sort(F.collect_list(F.struct("n", "field", "lama", "baru", "changed_at"))).alias("riwayat"))
    return businesses.join(rows, "place_key", "left").withColumn("riwayat", F.coalesce("riwayat", F.array().cast(rows.schema["riwayat"].dataType)))


def changed_in(changes, at=X.AS_OF, days=30):
    """How many businesses changed in the last days; each counts once."""
    return since(changes, at, days).agg(F.count_distinct("place_key").alias("n"))
