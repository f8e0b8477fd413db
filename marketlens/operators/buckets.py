"""A current table kept in buckets of key hashes, so that a feed rewrites only the buckets of its keys.

The table is a folder of Parquet files partitioned by bucket. Each upsert writes the new rows of the
touched buckets as a version beside the old one, then a small manifest that names the version of every
bucket. Readers take a manifest, so a lost executor or a job that ends half-way leaves the last complete state;
no path is read and overwritten. The score of a business is computed at the write, for rows without one.
"""

from pyspark.sql import functions as F

from marketlens.operators.ledger import upsert

BUCKETS = 64


def bucket(key, buckets=BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _files(spark, path):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark, path):
    """Version of each bucket in the latest manifest, and the manifest's number; ({}, -1) for a new table."""
    fs, p = _files(spark, f"{path}/manifest")
    found = [int(s.getPath().getName()[1:]) for s in fs.listStatus(p)] if fs.exists(p) else []
    done = [n for n in found if fs.exists(_files(spark, f"{path}/manifest/v{n}/_SUCCESS")[1])]
    if not done:
        return {}, -1
    rows = spark.read.parquet(f"{path}/manifest/v{max(done)}").collect()  # one row a bucket
    return {r["bucket"]: r["version"] for r in rows}, max(done)


def _commit(spark, path, state, number):
    rows = spark.createDataFrame(sorted(state.items()), "bucket int, version int")
    rows.coalesce(1).write.parquet(f"{path}/manifest/v{number}")


def read(spark, path, only=None):
    """The current rows, of all buckets or some; only their folders are listed."""
    state, _ = versions(spark, path)
    at = [f"{path}/data/version={v}/bucket={b}" for b, v in sorted(state.items()) if only is None or b in only]
    fs = _files(spark, path)[0]
    at = [x for x in at if fs.exists(_files(spark, x)[1])]
    schema = spark.read.parquet(f"{path}/schema").schema
    return spark.read.schema(schema).parquet(*at) if at else spark.createDataFrame([], schema)


def create(rows, path, key, buckets=BUCKETS):
    """A table from its first rows; each bucket is written once, by one task."""
    spark = rows.sparkSession
    rows.limit(0).write.parquet(f"{path}/schema")
    rows.withColumn("bucket", bucket(key, buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/data/version=0")
    _commit(spark, path, dict.fromkeys(range(buckets), 0), 0)


def upserted(spark, path, feed, key, order, keep=(), first=(), now=None, buckets=BUCKETS, score=None):
    """Upsert a feed; returns the buckets that were rewritten. score: frame -> frame with missing scores filled.

    Only buckets that hold a key of the feed are read and written. Blank keys take no part. Columns keep their types.
    """
    state, number = versions(spark, path)
    feed = feed.where(F.coalesce(F.col(key), F.lit("")) != "")
    touched = sorted(r["b"] for r in feed.select(bucket(key, buckets).alias("b")).distinct().collect())  # at most one row a bucket
    if not touched:
        return []
    current = read(spark, path, set(touched))
    new = upsert(current, feed, key, order, keep=keep, first=first, **({"now": now} if now else {}))
    new = score(new) if score else new
    number += 1
    kinds = [F.col(f.name).cast(f.dataType).alias(f.name) for f in current.schema.fields]
    new.select(*kinds, bucket(key, buckets).alias("bucket")).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{path}/data/version={number}")
    _commit(spark, path, state | dict.fromkeys(touched, number), number)
    return touched
