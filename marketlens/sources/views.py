"""Views over the given tables that shape them as listings, stores, products and observations.

The SQL is portable: Spark builds the frames from it and the oracles use it unchanged.
"""

from marketlens.sources.tables import TABLES, table

VIEWS = {
    "listings": r"""
SELECT c_custkey AS seq,
  CASE WHEN c_custkey % 4 = 0 THEN concat('https://maps.example/place/0x', lower(hex(c_custkey % 900 + 256)), ':0x2f!3d-6.', cast(c_custkey % 90 + 10 AS STRING), '!4d106.', cast(c_custkey % 80 + 10 AS STRING))
       WHEN c_custkey % 4 = 1 THEN concat('https://maps.example/?cid=', cast(c_custkey - c_custkey % 8 + 1 AS STRING))
       ELSE concat('https://maps.example/p/', cast(c_custkey AS STRING)) END AS href,
  concat('Bisnis ', c_mktsegment, ' ', cast(c_custkey % 97 AS STRING)) AS nama_bisnis,
  CASE c_custkey % 8 WHEN 0 THEN 'Klinik Gigi' WHEN 1 THEN 'Warung Makan' WHEN 2 THEN 'Toko Baju'
    WHEN 3 THEN 'Bengkel Mobil' WHEN 4 THEN 'Kafe' WHEN 5 THEN 'Notaris' WHEN 6 THEN 'Konter Pulsa' END AS kategori,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('Jl. Contoh No. ', cast(c_custkey % 300 AS STRING)) END AS alamat,
  concat('Area ', cast(c_nationkey AS STRING)) AS area_pencarian,
  CASE c_custkey % 5 WHEN 1 THEN concat('(021) 788', lpad(cast(c_custkey % 10000 AS STRING), 4, '0'))
    WHEN 2 THEN concat('0812-', lpad(cast(c_custkey % 10000 AS STRING), 4, '0'), '-1234')
    WHEN 3 THEN concat('+62 813 ', lpad(cast(c_custkey % 10000 AS STRING), 4, '0'), ' 77')
    WHEN 4 THEN concat('857', lpad(cast(c_custkey % 100000 AS STRING), 7, '0')) END AS telepon,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(10 + (c_custkey * 7) % 41 AS DOUBLE) / cast(10 AS DOUBLE) END AS rating,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey * 13) % 400 END AS jumlah_ulasan,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '-' WHEN 2 THEN concat('https://instagram.com/u', cast(c_custkey AS STRING))
    WHEN 3 THEN concat('http://toko', cast(c_custkey AS STRING), '.blogspot.com') WHEN 4 THEN 'https://phoenixdental.com/a' ELSE concat('www.usaha', cast(c_custkey AS STRING), '.co.id') END AS website,
  CASE WHEN c_custkey % 6 IN (3, 4, 5) THEN CASE c_custkey % 7 WHEN 0 THEN 'mati' WHEN 1 THEN 'error' WHEN 2 THEN NULL ELSE 'aktif' END END AS web_status,
  CASE WHEN c_custkey % 6 = 2 THEN 'sosmed_saja' WHEN c_custkey % 6 = 3 THEN 'Blogspot' WHEN c_custkey % 6 > 3 THEN 'WordPress' ELSE '' END AS web_platform,
  CASE WHEN c_custkey % 6 > 2 THEN c_custkey % 3 > 0 END AS web_https,
  CASE WHEN c_custkey % 6 > 2 THEN c_custkey % 5 > 1 END AS web_mobile,
  CASE WHEN c_custkey % 6 > 2 THEN (c_custkey * 97) % 9000 END AS web_load_ms,
  CASE WHEN c_custkey % 6 > 2 THEN 2016 + c_custkey % 10 END AS web_tahun_update,
  CASE WHEN c_custkey % 6 > 2 THEN c_custkey % 4 = 0 END AS web_ada_pixel,
  CASE WHEN c_custkey % 6 > 2 THEN c_custkey % 7 = 0 END AS web_ada_toko,
  CASE WHEN c_custkey % 9 = 0 THEN concat('info', cast(c_custkey AS STRING), '@usaha.co.id') ELSE '' END AS email,
  CASE WHEN c_custkey % 10 = 0 THEN concat('https://instagram.com/u', cast(c_custkey AS STRING)) ELSE '' END AS instagram,
  '' AS facebook,
  CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_custkey % 3 > 0 END AS sudah_diklaim,
  CASE WHEN c_custkey % 29 = 0 THEN 'Tutup Permanen' WHEN c_custkey % 31 = 0 THEN 'Temporarily Closed' WHEN c_custkey % 37 = 0 THEN 'Tutup Sementara' ELSE '' END AS status_buka,
  CASE c_custkey % 4 WHEN 0 THEN 'RpRp' WHEN 1 THEN 'Rp' WHEN 2 THEN '$$' ELSE '' END AS rentang_harga,
  CASE WHEN c_custkey % 8 = 0 THEN 0 END AS jumlah_foto
FROM customer
""",
    "businesses": r"""
SELECT concat('cid:', cast(c_custkey AS STRING)) AS place_key,
  concat('Bisnis ', c_mktsegment, ' ', cast(c_custkey % 97 AS STRING)) AS nama_bisnis,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('Jl. Contoh No. ', cast(c_custkey % 300 AS STRING)) END AS alamat,
  concat('Area ', cast(c_nationkey AS STRING)) AS area_pencarian,
  CASE WHEN c_custkey % 3 = 0 THEN '' ELSE concat('0812', lpad(cast(c_custkey AS STRING), 7, '0')) END AS telepon,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE concat('https://wa.me/62812', lpad(cast(c_custkey AS STRING), 7, '0')) END AS whatsapp_link,
  CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('https://lama', cast(c_custkey AS STRING), '.id') END AS website,
  CASE WHEN c_custkey % 10 = 0 THEN NULL WHEN c_custkey % 9 = 0 THEN concat('kantor', cast(c_custkey AS STRING), '@usaha.co.id') ELSE '' END AS email,
  CASE c_custkey % 4 WHEN 1 THEN 'Klinik Gigi' WHEN 2 THEN 'Kafe' ELSE 'Toko Baju' END AS kategori,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE cast(10 + (c_custkey * 7) % 41 AS DOUBLE) / cast(10 AS DOUBLE) END AS rating,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE (c_custkey * 13) % 400 END AS jumlah_ulasan,
  concat('2023-', lpad(cast(1 + c_custkey % 12 AS STRING), 2, '0'), '-01 00:00:00') AS first_seen_at,
  CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE concat('2023-12-', lpad(cast(1 + c_custkey % 28 AS STRING), 2, '0'), ' 09:00:00') END AS last_checked_at,
  (c_custkey * 29) % 101 AS skor_pembeli,
  CASE WHEN (c_custkey * 29) % 101 >= 75 THEN 'PANAS' WHEN (c_custkey * 29) % 101 >= 55 THEN 'HANGAT' WHEN (c_custkey * 29) % 101 >= 35 THEN 'DINGIN' ELSE 'ARSIP' END AS tier,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'Website Company Profile' WHEN 2 THEN 'Redesign Mobile-First' WHEN 3 THEN 'Google Ads + Setup Tracking' ELSE '' END AS jasa_utama,
  CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Deal' WHEN 2 THEN 'Tidak Tertarik' WHEN 3 THEN 'Follow Up' ELSE 'Belum Dihubungi' END AS status_leads,
  CASE WHEN c_custkey % 4 = 0 THEN concat('2024-01-', lpad(cast(1 + c_custkey % 28 AS STRING), 2, '0')) END AS tanggal_follow_up,
  CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 23 = 0 THEN '2023-11-05' ELSE concat('2023-', lpad(cast(1 + c_custkey % 12 AS STRING), 2, '0'), '-15 08:30:00') END AS last_scraped_at,
  1 + c_custkey % 4 AS times_seen
FROM customer
""",
    "stores": r"""
SELECT concat('st-', cast(s_suppkey AS STRING)) AS id,
  CASE WHEN s_suppkey % 2 = 0 THEN 'tokopedia' ELSE 'shopee' END AS platform,
  s_name AS nama, CASE WHEN s_suppkey % 10 = 0 THEN 1 ELSE 0 END AS is_own,
  CASE WHEN s_suppkey % 9 = 0 THEN 0 ELSE 1 END AS aktif
FROM supplier
""",
    "products": r"""
SELECT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'tkp:' ELSE 'shp:' END, cast(l_suppkey AS STRING), ':', cast(l_partkey AS STRING)) AS product_key,
  concat('st-', cast(l_suppkey AS STRING)) AS store_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'tokopedia' ELSE 'shopee' END AS platform,
  CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS is_own,
  concat(CASE l_suppkey % 4 WHEN 0 THEN 'PROMO! ' WHEN 2 THEN 'READY STOCK ' WHEN 3 THEN 'ORIGINAL ' ELSE '' END,
    CASE l_partkey % 8 WHEN 0 THEN 'Intel Core i7-12700K Gen 12' WHEN 1 THEN 'Intel Core i5 12400F' WHEN 2 THEN 'MSI RTX 3060 Ti'
      WHEN 3 THEN 'RAM DDR 4 8 GB Corsair' WHEN 4 THEN 'RAM DDR4 16GB Corsair' WHEN 5 THEN 'SSD Sandisk 1TB' WHEN 6 THEN 'Processor Intel I7 12700KF'
      ELSE concat(p_name, ' ', replace(p_brand, '#', ' ')) END,
    CASE l_suppkey % 3 WHEN 0 THEN ' BOX GARANSI RESMI' WHEN 1 THEN ' Tray' ELSE '' END) AS nama_produk,
  CASE WHEN (l_partkey + l_suppkey) % 29 = 0 THEN 35000
       WHEN (l_partkey + l_suppkey) % 31 = 0 THEN 0
       ELSE CASE l_partkey % 8 WHEN 0 THEN 48000 WHEN 1 THEN 23000 WHEN 2 THEN 52000 WHEN 3 THEN 3500 WHEN 4 THEN 6500 WHEN 5 THEN 11000 WHEN 6 THEN 45000 ELSE 1500 END
            * (100 + (l_suppkey * 37 + l_partkey * 11) % 41 - 20) END AS harga,
  cast(sum(l_quantity) AS BIGINT) AS terjual,
  CASE WHEN (l_partkey + l_suppkey) % 23 = 0 THEN 'ai' ELSE 'api' END AS sumber
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_partkey, l_suppkey, p_name, p_brand
""",
    "sized_products": r"""
SELECT concat('shp:', cast(l_suppkey AS STRING), ':', cast(l_partkey AS STRING)) AS product_key,
  concat('st-', cast(l_suppkey AS STRING)) AS store_id, CASE WHEN l_suppkey % 10 = 0 THEN 1 ELSE 0 END AS is_own,
  concat(CASE l_suppkey % 5 WHEN 0 THEN 'READY ' WHEN 1 THEN 'PROMO ' ELSE '' END,
    CASE l_partkey % 20 WHEN 0 THEN 'Cube Gaming Nytrix 240' WHEN 1 THEN 'Cube Gaming Luminex 240 Black' WHEN 2 THEN 'Cube Gaming Blazeview AIO 240' WHEN 3 THEN 'Cube Gaming 240'
      WHEN 4 THEN 'Intel Core i7-12700K Gen 12' WHEN 5 THEN 'Intel Core i7 12700K Tray' WHEN 6 THEN 'Deepcool Castle 360' WHEN 7 THEN 'Deepcool Castle 360 Panel' WHEN 8 THEN 'Deepcool Castle 360'
      WHEN 9 THEN 'Rakitan Intel 12700K MSI RTX 3060 Ti' WHEN 10 THEN 'SSD Sandisk 1TB' WHEN 11 THEN 'Kipas Aurora 120' ELSE concat(p_name, ' ', replace(p_brand, '#', ' ')) END) AS nama_produk,
  CASE WHEN (l_partkey + l_suppkey) % 29 = 0 THEN 35000 WHEN (l_partkey + l_suppkey) % 31 = 0 THEN 0 WHEN (l_partkey + l_suppkey) % 37 = 0 THEN NULL
       ELSE CASE l_partkey % 20 WHEN 0 THEN 6150 WHEN 1 THEN 9000 WHEN 2 THEN 14000 WHEN 3 THEN 8000 WHEN 4 THEN 48000 WHEN 5 THEN 47000 WHEN 6 THEN 9000 WHEN 7 THEN 16000 WHEN 8 THEN 9500 WHEN 9 THEN 99000 ELSE 1500 END
            * (100 + (l_suppkey * 37 + l_partkey * 11) % 41 - 20) END AS harga
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY l_partkey, l_suppkey, p_name, p_brand
""",
    "places": r"""
SELECT CASE c_nationkey WHEN 0 THEN 'DKI Jakarta' WHEN 1 THEN 'DKI Jakarta' WHEN 2 THEN 'Jawa Barat' WHEN 3 THEN 'Jawa Barat' WHEN 4 THEN 'Jawa Barat' WHEN 5 THEN 'Jawa Barat' WHEN 6 THEN 'Kalimantan Selatan' WHEN 7 THEN 'Kalimantan Selatan' WHEN 8 THEN 'Kalimantan Timur' WHEN 9 THEN 'Jawa Timur' WHEN 10 THEN 'Jawa Timur' WHEN 11 THEN 'Jawa Timur' WHEN 12 THEN 'Jawa Tengah' WHEN 13 THEN 'Jawa Tengah' WHEN 14 THEN 'Jawa Tengah' WHEN 15 THEN 'DI Yogyakarta' WHEN 16 THEN 'Bali' WHEN 17 THEN 'Bali' WHEN 18 THEN 'Sumatera Utara' WHEN 19 THEN 'Sumatera Utara' WHEN 20 THEN 'Sumatera Selatan' WHEN 21 THEN 'Sulawesi Selatan' WHEN 22 THEN 'Sulawesi Utara' WHEN 23 THEN 'Maluku' WHEN 24 THEN 'Papua' END AS provinsi,
  CASE c_nationkey WHEN 0 THEN 'Jakarta Pusat' WHEN 1 THEN 'Jakarta Selatan' WHEN 2 THEN 'Bogor' WHEN 3 THEN 'Kabupaten Bogor' WHEN 4 THEN 'Banjar' WHEN 5 THEN 'Bandung' WHEN 6 THEN 'Banjar' WHEN 7 THEN 'Banjarmasin' WHEN 8 THEN 'Samarinda' WHEN 9 THEN 'Surabaya' WHEN 10 THEN 'Gresik' WHEN 11 THEN 'Batu' WHEN 12 THEN 'Semarang' WHEN 13 THEN 'Surakarta (Solo)' WHEN 14 THEN 'Klaten' WHEN 15 THEN 'Sleman' WHEN 16 THEN 'Denpasar' WHEN 17 THEN 'Badung' WHEN 18 THEN 'Medan' WHEN 19 THEN 'Karo' WHEN 20 THEN 'Palembang' WHEN 21 THEN 'Gowa' WHEN 22 THEN 'Manado' WHEN 23 THEN 'Ambon' WHEN 24 THEN 'Jayapura' END AS wilayah,
  CASE c_nationkey WHEN 0 THEN 'kota' WHEN 1 THEN 'kota' WHEN 2 THEN 'kota' WHEN 3 THEN 'kab' WHEN 4 THEN 'kota' WHEN 5 THEN 'kota' WHEN 6 THEN 'kab' WHEN 7 THEN 'kota' WHEN 8 THEN 'kota' WHEN 9 THEN 'kota' WHEN 10 THEN 'kab' WHEN 11 THEN 'kota' WHEN 12 THEN 'kota' WHEN 13 THEN 'kota' WHEN 14 THEN 'kab' WHEN 15 THEN 'kab' WHEN 16 THEN 'kota' WHEN 17 THEN 'kab' WHEN 18 THEN 'kota' WHEN 19 THEN 'kab' WHEN 20 THEN 'kota' WHEN 21 THEN 'kab' WHEN 22 THEN 'kota' WHEN 23 THEN 'kota' WHEN 24 THEN 'kab' END AS tipe,
  concat('Kecamatan ', cast(c_custkey % 400 AS STRING)) AS kecamatan
FROM customer
""",
    "price_obs": r"""
SELECT concat('p:', cast(l_partkey AS STRING)) AS product_key,
  l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS captured_at,
  concat('run-', cast(l_orderkey % 12 AS STRING)) AS run_id,
  concat('st-', cast(l_partkey % 20 AS STRING)) AS store_id,
  CASE l_linenumber % 3 WHEN 0 THEN 'api' WHEN 1 THEN 'dom_anchor' ELSE 'dom_selector' END AS sumber,
  CASE WHEN l_linenumber % 7 = 0 THEN 0 WHEN l_orderkey % 41 = 0 THEN NULL ELSE 100000 + 5000 * (l_orderkey % 3) END AS harga,
  cast(l_quantity AS BIGINT) % 2 AS terjual, l_orderkey % 50 AS stok
FROM lineitem
""",
    "product_obs": r"""
SELECT concat(CASE WHEN l_suppkey % 2 = 0 THEN 'tkp:' ELSE 'shp:' END, cast(l_suppkey AS STRING), ':', cast(l_partkey AS STRING), CASE WHEN l_linenumber = 7 THEN ':baru' ELSE '' END) AS product_key,
  l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS captured_at, concat('run-', cast(l_orderkey % 12 AS STRING)) AS run_id,
  CASE WHEN l_orderkey % 41 = 0 THEN NULL WHEN l_linenumber = 6 THEN 0 ELSE 100000 + 5000 * (l_orderkey % 3) END AS harga
FROM lineitem
""",
    "card_text": r"""
SELECT l_orderkey * 10 + l_linenumber AS seq,
  concat('Terlaris', chr(10), 'Produk Contoh Nomor ', cast(l_partkey AS STRING), chr(10),
    CASE WHEN l_linenumber % 6 = 0 THEN 'Hubungi penjual' ELSE concat('Rp', cast(10 + l_partkey % 900 AS STRING), '.000') END, chr(10),
    CASE WHEN l_orderkey % 4 = 0 THEN concat('Rp ', cast(1 + l_partkey % 9 AS STRING), '.500.000') ELSE '' END, chr(10),
    cast(3 + l_partkey % 2 AS STRING), ',', cast(l_partkey % 10 AS STRING), chr(10),
    CASE l_orderkey % 5 WHEN 0 THEN '1,2rb terjual' WHEN 1 THEN '1.200 terjual' WHEN 2 THEN concat(cast(l_partkey AS STRING), ' terjual') WHEN 3 THEN 'Terjual 50' ELSE '' END) AS teks,
  concat('https://www.toko.example/s', cast(l_suppkey AS STRING), '/p', cast(l_partkey AS STRING), '?t=', cast(l_orderkey AS STRING)) AS href,
  concat('s', cast(l_suppkey AS STRING)) AS username
FROM lineitem
""",
    "listing_cards": r"""
SELECT c_custkey AS seq,
  concat('Usaha ', cast(c_custkey AS STRING), chr(10),
    CASE c_custkey % 3 WHEN 0 THEN '4,6' WHEN 1 THEN concat('4,7(1.', lpad(cast(c_custkey % 1000 AS STRING), 3, '0'), ')') ELSE 'Belum ada ulasan' END, chr(10),
    'Bengkel Mobil · Jl. Contoh No. ', cast(c_custkey % 300 AS STRING), chr(10),
    CASE c_custkey % 4 WHEN 0 THEN 'Tutup · Buka Jum pukul 09.00 · 0813-1899-8477' WHEN 1 THEN '(021) 78880202' WHEN 2 THEN 'Tutup permanen' ELSE 'Buka 24 jam' END) AS teks
FROM customer
""",
}

def view(spark, sf_dir, name, spread=False):
    """The frame of a view; only the tables and columns it names are read.

    `spread` deals the tables' rows out first: a file of a few MB holds very many short rows and would be one task,
    however dear the work on each row.
    """
    sql = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in TABLES if f"FROM {t}" in sql or f"JOIN {t}" in sql}
    if spread:
        used = {t: rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))) for t, rows in used.items()}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **used)


def with_views(sql, *names):
    """Oracle SQL with the named views in front."""
    return "WITH RECURSIVE " + ",\n".join([*(f"v_{n} AS ({VIEWS[n]})" for n in names)]) + (",\n" if sql.lstrip().startswith("WITH ") else "\n") + (sql.lstrip()[5:] if sql.lstrip().startswith("WITH ") else sql)
