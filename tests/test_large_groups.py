"""What a group that holds most of the rows costs: its rows are counted or marked, not brought to one place."""

from pyspark.sql import functions as F

from marketlens.functions import frames
from marketlens.operators import matching, pricing, variants

KIND = "product_key string, store_id string, nama_produk string, harga long, is_own int, sumber string"


def products(spark, n=3000):
    rows = [(f"p{i}", f"s{i % 7}", "Intel i7 12700K" if i % 10 else f"Intel i{i % 3 + 3} 12400F Box", 1000 + 100 * (i % 5) if i % 11 else 90_000, int(i % 9 == 0), "api") for i in range(n)]
    return spark.createDataFrame(rows, KIND)


def recorded(monkeypatch, module):
    seen = []

    def kept(df):
        seen.append((df.columns, df._jdf.queryExecution().executedPlan().toString(), out := frames.kept(df)))
        return out

    monkeypatch.setattr(module, "kept", kept)
    return seen


def test_summary_sorts_no_rows_by_group(spark, monkeypatch):
    rows = variants.split_lines(variants.grouped(products(spark)), [])
    seen = recorded(monkeypatch, variants)
    got = variants.summary(rows, ["kunci"]).collect()
    assert sum(r.n + r.n_pencilan for r in got) == 3000
    lines = [line for _, plan, _ in seen for line in plan.splitlines() if "store_id" in line]
    assert lines and not [line for line in lines if "Sort" in line or "langka" in line]


def test_statistics_join_counts_only(spark, monkeypatch):
    rows = products(spark).withColumn("varian", F.lit("satu"))
    seen = recorded(monkeypatch, pricing)
    got = pricing.statistics(rows, "varian").first()
    rivals = sorted(r.harga for r in rows.where("is_own = 0").collect())
    used = [h for h in rivals if h < 90_000]
    assert (got.n, got.n_pencilan, got.min, got.maks) == (len(used), len(rivals) - len(used), 1000, 1400)
    assert got.median == int((used[(len(used) - 1) // 2] + used[len(used) // 2]) / 2)
    assert [out.count() for _, _, out in seen] == [6]  # one row a price


def test_search_ranks_rows_without_arrays(spark, monkeypatch):
    seen = recorded(monkeypatch, matching)
    got = matching.search(spark, ["intel i7 12700k"], products(spark)).collect()
    assert len(got) == matching.TOP and all(r.models == ["12700k"] for r in got) and sorted(r.urut for r in got) == list(range(1, matching.TOP + 1))
    ranked = [columns for columns, _, _ in seen if "urut" in columns]
    assert ranked and not {"models", "tokens"} & set(ranked[0])
