"""Incremental rules as Structured Streaming jobs over file sources; the batch forms are the truth."""

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from marketlens.functions.frames import checkpoint_folder, each
from marketlens.operators import ledger
from marketlens.operators.greedy import seconds
from marketlens.sources.tables import table
from marketlens.sources.views import view, with_views


def folder(spark):
    """A new folder under the shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"


def source(spark, sf_dir, name):
    """A table as a stream of its files; the pattern lets it be one file or a folder."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parq[u]et")


def finish(query):
    query.awaitTermination()
    if query.exception():
        raise query.exception()


LAST = "product_key string, seq long, harga long, terjual long"


def price_changes(observations, at):
    """The change-only price history of a stream of observations, written below `at`; returns the query.

    A batch and the last recorded row of each product are sorted together once, so products cost no call of their
    own; changes and the new last rows go to the folder of the batch, which a repeated batch overwrites. Only the
    last rows, one a product, are carried on, so a batch costs its rows and one row a product.
    """
    valid = observations.where("coalesce(harga, 0) <> 0").select("product_key", "seq", "harga", F.coalesce("terjual", F.lit(0)).cast("long").alias("terjual"))
    order = Window.partitionBy("product_key").orderBy(F.desc("old"), "seq", "harga", "terjual")

    def apply(batch, n):
        session = batch.sparkSession
        last = session.read.schema(LAST).parquet(f"{at}/n={n - 1}/part=last") if n else session.createDataFrame([], LAST)
        both = last.withColumn("old", F.lit(True)).unionByName(batch.withColumn("old", F.lit(False)))
        both = both.withColumns({"_h": F.lag("harga").over(order), "_t": F.lag("terjual").over(order), "_end": F.lead("old").over(order).isNull()})
        changed = ~F.col("old") & F.coalesce((F.col("_h") != F.col("harga")) | (F.col("_t") != F.col("terjual")), F.lit(True))
        parts = F.array_compact(F.array(F.when(changed, "change"), F.when(F.col("_end"), "last")))
        rows = each(both, ["product_key", "seq", "harga", "terjual"], parts, "part")
        empty = session.createDataFrame([], LAST)
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{at}/n={n}")
        for part in ("change", "last"):  # folders of parts without rows
            empty.write.mode("append").parquet(f"{at}/n={n}/part={part}")

    return valid.writeStream.foreachBatch(apply).option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start()


def q_price_changes(spark, d):
    rows = source(spark, d, "lineitem")
    obs = rows.select(F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("product_key"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.when(F.col("l_linenumber") % 7 == 0, 0).when(F.col("l_orderkey") % 41 == 0, F.lit(None)).otherwise(100000 + 5000 * (F.col("l_orderkey") % 3)).cast("long").alias("harga"), (F.col("l_quantity").cast("long") % 2).alias("terjual"))
    at = folder(spark)
    finish(price_changes(obs, at))
    return changes(spark, at)


def changes(spark, at):
    """The history that price_changes() wrote below a folder."""
    return spark.read.schema(LAST).parquet(f"{at}/n=*/part=change")


def _admit(span):
    """Events later than the last admitted one by more than the span; state is that one's time, kept as long as it matters."""

    def admit(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat([b[["t", "event_id"]] for b in batches]).sort_values(["t", "event_id"], ignore_index=True)
        t, keep, at = rows["t"].to_numpy(), [], 0 if last is None else int(np.searchsorted(rows["t"].to_numpy(), last + span, "right"))
        while at < len(t):
            keep.append(at)
            last = int(t[at])
            at = int(np.searchsorted(t, last + span, "right"))
        ends = (last + span + 1) * 1000 if last is not None else 0
        if ends > state.getCurrentWatermarkMs():
            state.update((last,))
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy()[keep]}).astype({"user_id": "Int64", "event_id": "int64"})

    return admit


def admissions(events, days=182, late="1 day"):
    """Admitted events (user_id, event_id) of a stream (user_id, ts, event_id) with a memory of `days`.

    A timer drops a user's state when the memory ends, so state holds users of the last `days` only. Rows may
    come `late` behind the newest one of the batches before; later ones are dropped. A batch sorts a user's rows, so its
    size (files a trigger) bounds a task. With rows in the order of time, batches and restarts change nothing.
    """
    rows = events.where("ts is not null and event_id is not null").withWatermark("ts", late)
    rows = rows.select("user_id", "ts", seconds(F.col("ts")).alias("t"), F.col("event_id").cast("long").alias("event_id"))
    return rows.groupBy("user_id").applyInPandasWithState(_admit(days * 86400), "user_id long, event_id long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def q_admission(spark, d):
    """Admitted events of every user with a memory of seven days: the greedy rule over a stream."""
    e = source(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    at = folder(spark)
    finish(admissions(e, 7).writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start())
    return spark.read.parquet(f"{at}/out")


def upserted(spark, d, feed_of):
    """A feed upserted batch by batch into the current table, each version in a new path."""
    at = folder(spark)
    ledger_columns = ["place_key", "nama_bisnis", "telepon", "times_seen", "last_scraped_at"]
    view(spark, d, "businesses").select(*ledger_columns).write.parquet(f"{at}/v-1")

    def apply(batch, n):
        feed = feed_of(batch).select("place_key", F.col("c_custkey").alias("seq"), F.col("c_name").alias("nama_bisnis"), F.col("c_mktsegment").alias("telepon"))
        ledger.upsert(spark.read.parquet(f"{at}/v{n - 1}"), feed, "place_key", ["seq"]).write.parquet(f"{at}/v{n}")

    query = source(spark, d, "customer").writeStream.foreachBatch(apply).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    finish(query)
    return spark.read.parquet(f"{at}/v{query.lastProgress['batchId']}")


def q_upsert(spark, d):
    """All customers as a feed into all businesses: pairs share an even key, every fifth is new."""
    key = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("baru:"), "c_custkey")).otherwise(F.concat(F.lit("cid:"), F.col("c_custkey") - F.col("c_custkey") % 2))
    return upserted(spark, d, lambda rows: rows.withColumn("place_key", key))


def build():
    return {
        "st1_price_changes": (q_price_changes, ledger.build()["snp1_price_history"][1]),
        "st2_admission": (q_admission, ledger.build()["ded5_greedy_admission"][1]),
        "st3_upsert_feed": (q_upsert, with_views("WITH f AS (SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('baru:', c_custkey::VARCHAR) ELSE concat('cid:', (c_custkey - c_custkey % 2)::VARCHAR) END AS place_key, last(c_name ORDER BY c_custkey) AS nama_bisnis, last(c_mktsegment ORDER BY c_custkey) AS telepon, count(*) AS n FROM customer GROUP BY 1) SELECT coalesce(b.place_key, f.place_key) AS place_key, coalesce(f.nama_bisnis, b.nama_bisnis) AS nama_bisnis, coalesce(f.telepon, b.telepon) AS telepon, CASE WHEN n IS NULL THEN b.last_scraped_at ELSE '2024-01-15 00:00:00' END AS last_scraped_at, (coalesce(b.times_seen, 0) + coalesce(n, 0))::BIGINT AS times_seen FROM v_businesses b FULL JOIN f ON b.place_key = f.place_key", "businesses")),
    }
