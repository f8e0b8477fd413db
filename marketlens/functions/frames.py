"""Small frame helpers."""

import os
import tempfile

from pyspark.sql import functions as F

SMALL = 50_000  # rows up to which a side of a join is broadcast


def each(rows, keep, column, name):
    """One row per array element. The outer form keeps the optimizer from inferring a filter on the
    array's size, which it would push down and so compute the array twice.
    """
    return rows.select(*keep, F.explode_outer(column).alias(name)).where(F.col(name).isNotNull())


def bound(rows, keep, **columns):
    """The kept columns and new ones that are computed once a row: neither filters nor uses further up copy an
    expression through a generator, as they do through a projection.
    """
    return rows.select(*keep, F.inline_outer(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def checkpoint_folder(spark):
    """The session's shared folder for checkpoints and tables; one of its own only where none is set, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="marketlens-", dir=os.environ.get("TMPDIR")))
    return context._jsc.sc().getCheckpointDir().get()


def small(df, rows=SMALL):
    """The frame, kept and counted, with a broadcast hint if it has at most `rows` rows: what joins it is neither dealt by its key nor sorted."""
    df = kept(df)
    return F.broadcast(df) if df.count() <= rows else df


def kept(df):
    """The frame written once to the shared checkpoint folder: what reads it several times computes it once."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()
