"""Deletion scopes and fee overlay on small tables with nulls."""

import pytest

from marketlens.operators.pricing import fees
from marketlens.operators.retention import deletion


@pytest.fixture(scope="module")
def tables(spark):
    day = "product_key string, run_id string, captured_at date"
    return {
        "riwayat": spark.createDataFrame([("a", "r1", None), ("b", "r2", None), (None, None, None)], day),
        "produk": spark.createDataFrame([("a", "s1"), ("b", None)], "product_key string, store_id string"),
        "etalase": spark.createDataFrame([("s1:x", "s1")], "id string, store_id string"),
        "toko": spark.createDataFrame([("s1",), ("s2",)], "id string"),
        "run": spark.createDataFrame([("r1",)], "run_id string"),
    }


@pytest.mark.parametrize(
    ("scope", "value", "gone"),
    [
        ("run", "r1", {"riwayat": 1, "run": 1}), ("store", "s1", {"riwayat": 1, "produk": 1, "etalase": 1, "toko": 1}), ("produk", "b", {"riwayat": 1, "produk": 1}),
        ("riwayat", "2020-01-01", {"riwayat": 0}), ("produk_semua", None, {"riwayat": 3, "produk": 2}), ("semua", None, {"riwayat": 3, "produk": 2, "etalase": 1, "toko": 2, "run": 1}),
    ],
)
def test_scopes(tables, scope, value, gone):
    assert {t: f.where("hapus").count() for t, f in deletion(tables, scope, value).items()} == gone


def test_unknown_scope(tables):
    with pytest.raises(ValueError):
        deletion(tables, "lead")


def test_fees(spark):
    shops = spark.createDataFrame([("shopee",), ("tokopedia",), ("lain",), (None,)], "platform string")
    typed = spark.createDataFrame([("shopee", 1.5, None)], "platform string, persen double, tetap int")
    assert {r.platform: (r.persen, r.tetap) for r in fees(shops, typed).collect()} == {"shopee": (1.5, 5000), "tokopedia": (6.5, 5000), "lain": (0.0, 0), None: (0.0, 0)}
