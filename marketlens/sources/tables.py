"""The given tables."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark, sf_dir, name):
    """A table, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
