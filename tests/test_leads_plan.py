"""What keeps lead details cheap: rows of a small file are dealt out, and a reason map is built once a row."""

from pyspark.sql import functions as F

from marketlens.functions import scoring
from marketlens.operators import leads

DIR = "/root/testdata/sf0.001"


def test_details_are_spread_and_built_once(spark):
    plan = leads.q_details(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("map_from_entries") == 1 and "Repartition" in plan


def test_host_in_is_one_expression_on_whole_domains(spark):
    hosts = ["a.com", "x.a.com", "xa.com", "a.com.id", "axcom", "", "b.co.id", "a.com\n"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").select("h", scoring.host_in(F.col("h"), ["a.com", "b.co.id"]).alias("y"))
    assert {r.h for r in rows.collect() if r.y} == {"a.com", "x.a.com", "b.co.id"}
    assert "OR" not in str(scoring.host_in(F.col("h"), ["a.com", "b.co.id"])).upper().split("RLIKE")[0]
