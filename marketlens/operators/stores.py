"""Upserts of stores and shelves from a run's events, with a store's last status and a shelf's last harvest.

Each is one aggregation by key, combined before the shuffle, joined with the stored table.
"""

from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.sources.tables import table
from marketlens.sources.views import view, with_views

ERROR = 500  # characters kept of an error


def upsert_stores(current, events, now=X.AS_OF):
    """Stores (id, nama, is_own, aktif, created_at, last_ok_at, last_error) after events (id, seq, nama, waktu, galat).

    A known name is only replaced by another; is_own and aktif stay as stored, with 0 and 1 for new stores.
    A success sets its time and clears the error, a failure sets the error alone.
    """
    last = lambda c, where: F.max_by(c, F.when(where, F.col("seq")))
    ok = F.col("galat").isNull()
    new = events.groupBy("id").agg(
        last("nama", F.col("nama").isNotNull()).alias("n_nama"), last("waktu", ok).alias("n_ok"),
        F.max_by(F.substring(F.coalesce("galat", F.lit("")), 1, ERROR), "seq").alias("n_galat"),
    )
    x = current.join(new, "id", "full_outer")
    return x.select(
        "id", F.coalesce("n_nama", "nama").alias("nama"), F.coalesce("is_own", F.lit(0)).alias("is_own"), F.coalesce("aktif", F.lit(1)).alias("aktif"),
        F.coalesce("created_at", F.lit(now)).alias("created_at"), F.coalesce("n_ok", "last_ok_at").alias("last_ok_at"), F.coalesce("n_galat", "last_error").alias("last_error"),
    )


def upsert_shelves(events, now=X.AS_OF):
    """Shelves (id, nama, url, n_produk, terakhir_panen_at, created_at) after events (id, slug, seq, nama, url, n_produk, panen).

    Events without a harvest time register a shelf: blanks and nulls replace nothing; the slug is a shelf's
    first name. A harvest sets its time and the number of products, and only of a shelf that is registered.
    """
    plain = events.where("panen is null")
    first = plain.groupBy("id").agg(F.min("seq").alias("mulai"))
    known = events.join(first, "id").where("panen is null or seq > mulai")
    last = lambda c, where: F.max_by(c, F.when(where, F.col("seq")))
    given = lambda c: F.col("panen").isNull() & (F.coalesce(c, F.lit("")) != "")
    count = F.when(F.col("panen").isNotNull(), F.coalesce("n_produk", F.lit(0))).otherwise(F.col("n_produk"))
    x = known.groupBy("id").agg(
        F.coalesce(last("nama", given("nama")), F.max("slug")).alias("nama"), F.coalesce(last("url", given("url")), F.lit("")).alias("url"),
        F.coalesce(F.max_by(count, F.when(count.isNotNull(), F.col("seq"))), F.lit(0)).alias("n_produk"), last("panen", F.col("panen").isNotNull()).alias("terakhir_panen_at"),
    )
    return x.withColumn("created_at", F.lit(now))


STORE_EVENTS = """SELECT concat('st-', CASE WHEN l_linenumber = 7 THEN 'baru-' ELSE '' END, cast(l_suppkey AS STRING)) AS id, (cast(l_orderkey AS BIGINT) * 10 + l_linenumber) * 10000000 + l_partkey * 50 + cast(l_quantity AS BIGINT) AS seq,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('Toko ', cast(l_orderkey % 9 AS STRING)) END AS nama, cast(l_shipdate AS STRING) AS waktu,
  CASE WHEN l_returnflag = 'R' THEN concat('kode ', cast(l_partkey AS STRING)) END AS galat FROM lineitem"""
SHELF_EVENTS = """SELECT concat('st-', cast(l_suppkey AS STRING), ':rak-', cast(l_partkey % 50 AS STRING)) AS id, concat('rak-', cast(l_partkey % 50 AS STRING)) AS slug, (cast(l_orderkey AS BIGINT) * 10 + l_linenumber) * 10000000 + l_partkey * 50 + cast(l_quantity AS BIGINT) AS seq,
  CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE concat('Rak ', cast(l_orderkey % 9 AS STRING)) END AS nama, CASE WHEN l_linenumber % 2 = 0 THEN '/rak' END AS url,
  CASE WHEN l_linenumber % 4 <> 0 THEN cast(l_quantity AS BIGINT) END AS n_produk, CASE WHEN l_linenumber IN (4, 5) THEN cast(l_shipdate AS STRING) END AS panen FROM lineitem"""


def events(spark, d, sql):
    return spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=table(spark, d, "lineitem"))


def q_stores(spark, d):
    current = view(spark, d, "stores").select("id", "nama", "is_own", "aktif", F.lit("2023-01-01 00:00:00").alias("created_at"), F.lit(None).cast("string").alias("last_ok_at"), F.lit("").alias("last_error"))
    return upsert_stores(current, events(spark, d, STORE_EVENTS))


def q_shelves(spark, d):
    return upsert_shelves(events(spark, d, SHELF_EVENTS))


def build():
    return {
        "ups3_stores": (q_stores, with_views(f"""WITH e AS ({STORE_EVENTS}), n AS (SELECT id, arg_max(nama, seq) FILTER (WHERE nama IS NOT NULL) AS nama, arg_max(waktu, seq) FILTER (WHERE galat IS NULL) AS ok, arg_max(left(coalesce(galat, ''), {ERROR}), seq) AS galat FROM e GROUP BY 1)
SELECT coalesce(s.id, n.id) AS id, coalesce(n.nama, s.nama) AS nama, coalesce(is_own, 0) AS is_own, coalesce(aktif, 1) AS aktif, CASE WHEN s.id IS NULL THEN '{X.AS_OF}' ELSE '2023-01-01 00:00:00' END AS created_at, n.ok AS last_ok_at, coalesce(n.galat, '') AS last_error FROM v_stores s FULL JOIN n ON s.id = n.id""", "stores")),
        "ups3_shelves": (q_shelves, f"""WITH e AS ({SHELF_EVENTS}), f AS (SELECT id, min(seq) AS mulai FROM e WHERE panen IS NULL GROUP BY 1), k AS (SELECT e.* FROM e JOIN f USING (id) WHERE panen IS NULL OR seq > mulai), c AS (SELECT *, CASE WHEN panen IS NOT NULL THEN coalesce(n_produk, 0) ELSE n_produk END AS jumlah FROM k)
SELECT id, coalesce(arg_max(nama, seq) FILTER (WHERE panen IS NULL AND nama <> ''), max(slug)) AS nama, coalesce(arg_max(url, seq) FILTER (WHERE panen IS NULL AND url <> ''), '') AS url, coalesce(arg_max(jumlah, seq) FILTER (WHERE jumlah IS NOT NULL), 0)::BIGINT AS n_produk, arg_max(panen, seq) FILTER (WHERE panen IS NOT NULL) AS terakhir_panen_at, '{X.AS_OF}' AS created_at FROM c GROUP BY id"""),
    }
