"""Deletion by scope, and the counters of what is stored."""

from pyspark.sql import functions as F

from marketlens.operators.stores import SHELF_EVENTS, events
from marketlens.sources.views import view, with_views

SCOPES = ("run", "store", "produk", "riwayat", "produk_semua", "semua")


def deletion(tables, scope, value=None):
    """The tables that a deletion touches, each row with `hapus`: whether it goes.

    tables: riwayat, produk, etalase, toko, run. The scopes run, store and produk take a name,
    riwayat takes the first day that stays; rows whose key is null stay. Costs and fees that users typed are no part of it.
    """
    named = lambda t, c: tables[t].withColumn("hapus", F.coalesce(F.col(c) == F.lit(value), F.lit(False)))
    if scope == "run":
        return {t: named(t, "run_id") for t in ("riwayat", "run")}
    if scope == "store":
        keys = tables["produk"].where(F.col("store_id") == value).select("product_key", F.lit(True).alias("hapus")).distinct()
        history = tables["riwayat"].join(keys, "product_key", "left").withColumn("hapus", F.coalesce("hapus", F.lit(False)))
        return {"riwayat": history, "produk": named("produk", "store_id"), "etalase": named("etalase", "store_id"), "toko": named("toko", "id")}
    if scope == "produk":
        return {t: named(t, "product_key") for t in ("riwayat", "produk")}
    if scope == "riwayat":
        return {"riwayat": tables["riwayat"].withColumn("hapus", F.coalesce(F.col("captured_at") < F.lit(value).cast("date"), F.lit(False)))}
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope}")
    return {t: tables[t].withColumn("hapus", F.lit(True)) for t in (("riwayat", "produk") if scope == "produk_semua" else tables)}


def q_del1(spark, d):
    """Rows removed and left per scope and touched table."""
    history = view(spark, d, "product_obs").select("product_key", "run_id", "captured_at")
    tables = {
        "riwayat": history, "produk": view(spark, d, "products").select("product_key", "store_id"),
        "etalase": events(spark, d, SHELF_EVENTS).where("panen is null").select("id", F.substring_index("id", ":", 1).alias("store_id")).distinct(),
        "toko": view(spark, d, "stores").select("id"), "run": history.select("run_id").distinct(),
    }
    values = {"run": "run-3", "store": "st-3", "produk": tables["produk"].agg(F.min("product_key")).first()[0], "riwayat": "1996-01-01"}
    out = None
    for scope in SCOPES:
        for name, rows in deletion(tables, scope, values.get(scope)).items():
            one = rows.agg(F.count_if("hapus").alias("dihapus"), F.count_if(~F.col("hapus")).alias("tersisa"))
            one = one.select(F.lit(scope).alias("cakupan"), F.lit(name).alias("tabel"), "dihapus", "tersisa")
            out = one if out is None else out.unionByName(one)
    return out


def q_agg2(spark, d):
    """The eight counters of stored data."""
    p, s = view(spark, d, "products"), view(spark, d, "stores")
    o = view(spark, d, "price_obs").agg(F.count("*").alias("riwayat"), F.countDistinct("run_id").alias("run"))
    a = s.agg(F.count("*").alias("toko"), F.count_if(F.expr("is_own = 1")).alias("toko_sendiri"))
    filled = F.expr("is_own = 1 and cast(harga * 0.8 as bigint) > 0")
    b = p.agg(F.count("*").alias("produk"), F.count_if(F.expr("is_own = 1")).alias("produk_sendiri"), F.count_if(filled).alias("modal_terisi"))
    e = events(spark, d, SHELF_EVENTS).where("panen is null").agg(F.countDistinct("id").alias("etalase"))
    return a.crossJoin(b).crossJoin(o).crossJoin(e)


def build():
    count = "count(*) FILTER (WHERE {0}) AS dihapus, count(*) FILTER (WHERE NOT ({0})) AS tersisa FROM {1}"
    del1 = " UNION ALL ".join(
        f"SELECT '{scope}' AS cakupan, '{name}' AS tabel, {count.format(gone, source)}"
        for scope, name, gone, source in [
            ("run", "riwayat", "run_id = 'run-3'", "v_product_obs"), ("run", "run", "run_id = 'run-3'", "r"),
            ("store", "riwayat", "product_key IN (SELECT product_key FROM v_products WHERE store_id = 'st-3')", "v_product_obs"), ("store", "produk", "store_id = 'st-3'", "v_products"),
            ("store", "etalase", "starts_with(id, 'st-3:')", "e"), ("store", "toko", "id = 'st-3'", "v_stores"),
            ("produk", "riwayat", "product_key = (SELECT k FROM least_key)", "v_product_obs"), ("produk", "produk", "product_key = (SELECT k FROM least_key)", "v_products"),
            ("riwayat", "riwayat", "captured_at < DATE '1996-01-01'", "v_product_obs"), ("produk_semua", "riwayat", "true", "v_product_obs"), ("produk_semua", "produk", "true", "v_products"),
            ("semua", "riwayat", "true", "v_product_obs"), ("semua", "produk", "true", "v_products"), ("semua", "etalase", "true", "e"), ("semua", "toko", "true", "v_stores"), ("semua", "run", "true", "r"),
        ]
    )
    shelves = f"x AS ({SHELF_EVENTS}), e AS (SELECT DISTINCT id FROM x WHERE panen IS NULL)"
    return {
        "del1_retention": (q_del1, with_views(f"WITH {shelves}, r AS (SELECT DISTINCT run_id FROM v_product_obs), least_key AS (SELECT min(product_key) AS k FROM v_products) {del1}", "product_obs", "products", "stores")),
        "agg2_counters": (q_agg2, with_views(f"WITH {shelves} SELECT (SELECT count(*) FROM v_stores) AS toko, (SELECT count(*) FROM v_stores WHERE is_own = 1) AS toko_sendiri, (SELECT count(*) FROM v_products) AS produk, (SELECT count(*) FROM v_products WHERE is_own = 1) AS produk_sendiri, (SELECT count(*) FROM v_products WHERE is_own = 1 AND trunc(harga * 0.8) > 0) AS modal_terisi, (SELECT count(*) FROM v_price_obs) AS riwayat, (SELECT count(DISTINCT run_id) FROM v_price_obs) AS run, (SELECT count(*) FROM e) AS etalase", "price_obs", "products", "stores")),
    }
