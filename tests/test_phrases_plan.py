"""Phrases come from the kept table of store titles: a title that many products share is taken apart once."""

from marketlens.operators import lexicon


def test_phrases_come_from_store_titles(spark):
    plan = lexicon.q_phrases(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" in plan or "Scan ExistingRDD" in plan
    assert "sum(jumlah" in plan and "regexp_replace" not in plan
