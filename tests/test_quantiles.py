"""Exact percentiles against Spark's own, with a group that holds half of all rows."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions.quantiles import percentiles, runs_of

SHARES = {"p0": 0, "p10": 0.1, "p25": 0.25, "median": 0.5, "p75": 0.75, "p100": 1}


def rows_of(spark, n=4000):
    g = F.when(F.col("id") % 2 == 0, "hot").when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 60))
    return spark.range(n).select(g.alias("g"), (F.col("id") % 3).alias("h"), F.when(F.col("id") % 11 > 0, F.col("id") * 7919 % 2003).alias("v"))


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_percentiles(spark, parts):
    rows = rows_of(spark)
    for group in (["g"], ["g", "h"]):
        got = percentiles(rows, group, "v", SHARES, parts)
        want = rows.where("v is not null").groupBy(*group).agg(*(F.percentile("v", F.lit(q)).alias(n) for n, q in SHARES.items()))
        key = lambda r: str(r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_few_rows(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None), ("c", 1), ("c", 1), ("d", 1), ("d", 2)], "g string, v int")
    got = {r.g: (r.p25, r.median) for r in percentiles(rows, ["g"], "v", {"p25": 0.25, "median": 0.5}).collect()}
    assert got == {"a": (5, 5), "c": (1, 1), "d": (1.25, 1.5)}
    assert percentiles(rows.limit(0), ["g"], "v", SHARES).count() == 0


def test_a_large_group_is_spread(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 60)).alias("g"), F.col("id").alias("v"))
    sizes = [r["count"] for r in runs_of(rows, ["g"], "v", 8).groupBy("__part").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 20000 / 8
