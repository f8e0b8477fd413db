"""Queries of keys, phone numbers and card texts."""

from pyspark.sql import functions as F

from marketlens.functions import parse as P
from marketlens.sources.tables import table
from marketlens.functions.frames import bound
from marketlens.sources.views import view, with_views

DIGITS = "regexp_replace(coalesce({c}, ''), '[^0-9]', '', 'g')"


def q_place_key(spark, d):
    v = view(spark, d, "listings")
    return v.select("seq", P.place_key(F.col("href"), F.col("nama_bisnis"), F.col("alamat"), F.col("telepon")).alias("place_key"))


PLACE_KEY_SQL = r"""
CASE WHEN regexp_extract(href, '(0x[0-9a-f]+:0x[0-9a-f]+)', 1, 'i') <> '' THEN concat('cid:', lower(regexp_extract(href, '(0x[0-9a-f]+:0x[0-9a-f]+)', 1, 'i')))
 WHEN regexp_extract(href, '[?&]cid=([0-9]+)', 1) <> '' THEN concat('cid:', regexp_extract(href, '[?&]cid=([0-9]+)', 1))
 WHEN length(regexp_replace(coalesce(telepon, ''), '[^0-9]', '', 'g')) >= 8 THEN concat('tel:', regexp_replace(regexp_replace(coalesce(telepon, ''), '[^0-9]', '', 'g'), '^0', '62'))
 WHEN nama_bisnis <> '' THEN concat('sig:', left(sha1(concat(regexp_replace(lower(nama_bisnis), '[^a-z0-9]', '', 'g'), '|', left(regexp_replace(lower(coalesce(alamat, '')), '[^a-z0-9]', '', 'g'), 30))), 16))
 ELSE '' END"""


def q_coordinates(spark, d):
    return view(spark, d, "listings").select("seq", P.coordinates(F.col("href")).alias("koordinat"))


def q_phones(spark, d):
    t = F.col("telepon")
    return view(spark, d, "listings").select("seq", P.phone_number(t).alias("nomor"), P.is_mobile(t).alias("wa"), P.chat_link(t).alias("tautan"), P.chat_link(t, F.concat(F.lit("Halo "), F.col("nama_bisnis"))).alias("tautan_pesan"))


PHONE = "CASE WHEN dg = '' THEN '' WHEN dg LIKE '0%' THEN concat('62', dg[2:]) WHEN dg LIKE '62%' THEN dg ELSE concat('62', dg) END"


def q_card_prices(spark, d):
    t = F.col("teks")
    x = bound(view(spark, d, "card_text"), ["seq"], t=t, ps=P.prices(t))
    x = bound(x, ["seq", "t", "ps"], harga=P.first_price(F.col("t"), F.col("ps")))
    return x.select("seq", F.array_join(F.col("ps").cast("array<string>"), ",").alias("semua"), "harga", P.money(F.col("harga")).alias("tampil"), P.sold(F.col("t")).alias("terjual"), P.product_name(F.col("t")).alias("nama"))


CARD_PRICES = r"""
p AS (SELECT *, list_filter(list_transform(regexp_extract_all(teks, 'Rp\s?[0-9][0-9.,]*'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')::BIGINT), lambda v: v BETWEEN 1000 AND 500000000) AS ps,
  list_filter(list_transform(string_split(teks, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT regexp_matches(x, 'Rp\s?[0-9]') AND NOT regexp_full_match(x, '[0-9.,%\s+\-|/]*')) AS ls FROM v_card_text),
h AS (SELECT *, CASE WHEN len(ps) > 0 THEN ps[1] WHEN length(regexp_replace(teks, '[^0-9]', '', 'g')) BETWEEN 4 AND 9 AND regexp_replace(teks, '[^0-9]', '', 'g')::BIGINT BETWEEN 1000 AND 500000000 THEN regexp_replace(teks, '[^0-9]', '', 'g')::BIGINT ELSE 0 END AS harga FROM p)"""


def q_product_cards(spark, d):
    """Cards assembled to product records; cards without price or name are dropped."""
    t = F.col("teks")
    x = bound(view(spark, d, "card_text"), ["seq", "href", "username"], t=t, ps=P.prices(t)).where(F.size("ps") > 0).withColumn("harga", F.get("ps", 0))
    x = bound(x, ["seq", "href", "username", "ps", "harga"], nama_produk=P.product_name(F.col("t")), terjual=P.sold(F.col("t")), r=F.regexp_extract("t", r"\b([1-5][.,][0-9])\b", 1)).where("nama_produk <> ''")
    x = x.withColumn("harga_coret", F.coalesce(F.array_max(F.filter(F.slice("ps", 2, 1000000), lambda h: h > F.col("harga"))), F.lit(0)))
    off = F.when(F.col("harga_coret") > 0, F.bround((F.col("harga_coret") - F.col("harga")) / F.col("harga_coret") * 100)).otherwise(0).cast("long")
    return x.select("seq", P.product_key(F.lit("tokopedia"), F.col("username"), F.col("href")).alias("product_key"), P.clean_url(F.col("href")).alias("url"), "nama_produk", "harga", "harga_coret", off.alias("diskon_persen"), P.number_or_zero(F.col("r")).alias("rating"), "terjual")


SOLD_AT = r"'([0-9][0-9.,]*)\s*(rb|ribu|k|jt|juta)?\s*(?:\+\s*)?terjual'"
SOLD = rf"""CASE WHEN regexp_extract(teks, {SOLD_AT}, 2, 'i') = 'rb' THEN (replace(regexp_extract(teks, {SOLD_AT}, 1, 'i'), ',', '.')::DOUBLE * 1000)::BIGINT
  WHEN regexp_extract(teks, {SOLD_AT}, 1, 'i') <> '' THEN regexp_replace(regexp_extract(teks, {SOLD_AT}, 1, 'i'), '[^0-9]', '', 'g')::BIGINT
  WHEN regexp_extract(teks, 'Terjual\s*([0-9]+)', 1) <> '' THEN regexp_extract(teks, 'Terjual\s*([0-9]+)', 1)::BIGINT ELSE 0 END"""


def q_listing_cards(spark, d):
    t = F.col("teks")
    rating, reviews = P.card_rating(t)
    return view(spark, d, "listing_cards").select("seq", rating.alias("rating"), reviews.alias("jumlah_ulasan"), P.card_phone(t).alias("telepon"), P.card_category(t).alias("kategori"), P.is_closed(t).alias("tutup"))


def q_contacts(spark, d):
    """First phone-like number and e-mail of each document."""
    t = F.coalesce("text", F.lit(""))
    phone = F.regexp_extract(t, r"((?:\+62|62|0)[0-9][0-9 .-]{7,14}[0-9])", 1)
    mail = F.regexp_extract(t, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})", 1)
    return table(spark, d, "documents").select("doc_id", phone.alias("telepon"), mail.alias("email"))


def q_page_urls(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", P.clean_url(u).alias("bersih"), P.product_key(F.lit("shopee"), F.lit(""), u).alias("kunci"), P.url_path(u).alias("jalur"))


def q_readers(spark, d):
    """Tolerant numbers, flags and times."""
    v = view(spark, d, "businesses")
    age = F.floor((F.unix_timestamp(F.lit("2024-01-15 00:00:00").cast("timestamp")) - F.unix_timestamp(P.timestamp(F.col("last_scraped_at")))) / 86400)
    return v.select("place_key", P.number_or_zero(F.col("rating")).alias("rating"), F.coalesce("jumlah_ulasan", F.lit(0)).cast("long").alias("ulasan"), P.timestamp(F.col("last_scraped_at")).cast("string").alias("waktu"), age.cast("long").alias("umur"))


def build():
    """name -> (query, oracle)."""
    return {
        "key1_place_key": (q_place_key, with_views(f"SELECT seq, {PLACE_KEY_SQL} AS place_key FROM v_listings", "listings")),
        "key4_coordinates": (q_coordinates, with_views(r"SELECT seq, CASE WHEN regexp_matches(href, '!3d(-?[0-9]+\.[0-9]+)!4d(-?[0-9]+\.[0-9]+)') THEN concat(regexp_extract(href, '!3d(-?[0-9]+\.[0-9]+)!4d', 1), ',', regexp_extract(href, '!4d(-?[0-9]+\.[0-9]+)', 1)) ELSE '' END AS koordinat FROM v_listings", "listings")),
        "phn1_3_phones": (q_phones, with_views(f"WITH x AS (SELECT *, {DIGITS.format(c='telepon')} AS dg FROM v_listings), y AS (SELECT *, {PHONE} AS nomor FROM x), z AS (SELECT *, nomor LIKE '628%' AND length(nomor) BETWEEN 10 AND 14 AS wa FROM y) SELECT seq, nomor, wa, CASE WHEN wa THEN concat('https://wa.me/', nomor) ELSE '' END AS tautan, CASE WHEN wa THEN concat('https://wa.me/', nomor, '?text=', replace(concat('Halo ', nama_bisnis), ' ', '%20')) ELSE '' END AS tautan_pesan FROM z", "listings")),
        "prs1_2_3_7_card_values": (q_card_prices, with_views(f"WITH {CARD_PRICES} SELECT seq, array_to_string(ps, ',') AS semua, harga, CASE WHEN harga = 0 THEN '-' ELSE concat('Rp ', replace(format('{{:,}}', harga), ',', '.')) END AS tampil, {SOLD} AS terjual, coalesce(list_reduce(list_prepend('', ls), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END), '')[1:200] AS nama FROM h", "card_text")),
        "prs8_product_cards": (q_product_cards, with_views(f"""WITH {CARD_PRICES}, c AS (SELECT *, coalesce(list_max(list_filter(ps[2:], lambda x: x > harga)), 0) AS coret, list_reduce(list_prepend('', ls), lambda a, x: CASE WHEN length(x) > length(a) THEN x ELSE a END)[1:200] AS nama FROM h WHERE len(ps) > 0)
SELECT seq, concat('tkp:', username, ':', left(sha1(concat('/', username, '/', regexp_extract(href, '/(p[0-9]+)[?]', 1))), 12)) AS product_key, regexp_replace(href, '[?].*$', '') AS url, nama AS nama_produk, harga, coret AS harga_coret,
 CASE WHEN coret > 0 THEN round_even((coret - harga)::DOUBLE / coret * 100, 0) ELSE 0 END::BIGINT AS diskon_persen, coalesce(try_cast(replace(regexp_extract(teks, '\\b([1-5][.,][0-9])\\b', 1), ',', '.') AS DOUBLE), 0) AS rating, {SOLD} AS terjual FROM c WHERE nama <> ''""", "card_text")),
        "prs4_5_6_listing_cards": (q_listing_cards, with_views(r"""SELECT seq, CASE seq % 3 WHEN 0 THEN 4.6::DOUBLE WHEN 1 THEN 4.7::DOUBLE END AS rating, CASE WHEN seq % 3 = 1 THEN regexp_replace(regexp_extract(teks, '\(([0-9.]+)\)', 1), '[^0-9]', '', 'g')::BIGINT END AS jumlah_ulasan,
 CASE seq % 4 WHEN 0 THEN '0813-1899-8477' WHEN 1 THEN '(021) 78880202' END AS telepon, 'Bengkel Mobil' AS kategori, contains(lower(teks), 'tutup permanen') AS tutup FROM v_listing_cards""", "listing_cards")),
        "prs10_contacts": (q_contacts, r"SELECT doc_id, regexp_extract(coalesce(text, ''), '((?:\+62|62|0)[0-9][0-9 .-]{7,14}[0-9])', 1) AS telepon, regexp_extract(coalesce(text, ''), '([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', 1) AS email FROM documents"),
        "key2_3_page_urls": (q_page_urls, r"WITH x AS (SELECT page_id, url, regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS jalur FROM pages) SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS bersih, concat('shp:-:', left(sha1(jalur), 12)) AS kunci, jalur FROM x"),
        "prs12_ded3_readers": (q_readers, with_views("SELECT place_key, coalesce(rating, 0)::DOUBLE AS rating, coalesce(jumlah_ulasan, 0)::BIGINT AS ulasan, strftime(try_cast(last_scraped_at AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS waktu, floor((epoch(TIMESTAMP '2024-01-15') - epoch(try_cast(last_scraped_at AS TIMESTAMP))) / 86400)::BIGINT AS umur FROM v_businesses", "businesses")),
    }
