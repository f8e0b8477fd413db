"""Reading tables, checkpoints and sizes shared by the text operators."""

import contextlib
import ctypes
import math
import os
import tempfile

import pyarrow as pa
from pyspark.sql import functions as F


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark, sf_dir, name):
    """A table of the collection, read by Spark so that any file system works.

    Rows with texts are long: where the session has Spark's own default, Arrow batches hold fewer rows,
    so that a batch takes a few MB in the executor and again in its Python worker.
    """
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark):
    """The shared folder for checkpoints and tables; a new one only where none is configured."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        own = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="marketlens-", dir=os.environ.get("TMPDIR")))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df):
    """The frame written to the shared checkpoint folder, so lost executors lose none of it."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def text_bytes(docs, column="text"):
    """Total bytes of a text column."""
    return docs.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0


def parts_for(total, each, least=64):
    """How many parts of about `each` bytes a total makes; at least `least`, so that small inputs are dealt out too."""
    return int(max(least, math.ceil(total / each)))


def lean(work):
    """An Arrow task over batches that gives freed memory back to the system at its end.

    Python workers live on between tasks; what their allocators keep would add up over stages.
    """

    def run(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            release()

    return run


def lean_group(work):
    """As lean(), for a function of one group."""

    def run(rows):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return work(rows)
        finally:
            release()

    return run


def lean_pair(work):
    """As lean(), for a function of two cogrouped groups."""

    def run(rows, others):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            return work(rows, others)
        finally:
            release()

    return run


def release():
    """Return free pages of this process to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def held_out(doc_id):
    """Rows kept apart from all learning: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sized(df, rows, text=None):
    """The frame with a broadcast hint if it is small enough, else as it is; and its count.

    Small is at most `rows` rows and, where it has a text column, 64 bytes of text for each of them.
    """
    got = df.agg(F.count("*").alias("n"), (F.sum(F.octet_length(text)) if text else F.lit(0)).alias("size")).first()
    return (F.broadcast(df) if got["n"] <= rows and (got["size"] or 0) <= 64 * rows else df), got["n"]


def row_keys(docs):
    """Two columns that name a row by doc_id and text, null-safe; equal rows share them."""
    return docs.withColumns({"__row_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__row_text": F.xxhash64("text")})


def labelled_sample(docs, labels, column, most):
    """(text, y) of at most `most` labelled documents that may teach, in hash order of their ids.

    The ids are picked from the labels alone, so only the picked documents' texts move.
    """
    ids = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = ids.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "y").agg(F.max("text").alias("text")).select("text", "y")


def each(rows, keep, column, name):
    """One row per element of an array. Outer form, then a filter: for the plain form the optimizer
    infers a filter on the array's size, which it pushes down and so builds the array anew in it,
    with everything it is made of, for every element.
    """
    return rows.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())
