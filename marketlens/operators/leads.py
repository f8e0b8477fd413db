"""Queries of lead signals, scores, filters and lists."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.functions import parse as P
from marketlens.functions import scoring as S
from marketlens.operators.keys import DIGITS, PHONE
from marketlens.sources.views import view, with_views

YEAR = 2024


def either(column, words):
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


def hosts(column, domains):
    return "(" + " OR ".join(f"{column} = '{d}' OR {column} LIKE '%.{d}'" for d in domains) + ")"


def listed(words):
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


SIGNALS = f"""
hst AS (SELECT *, lower(trim(coalesce(website, ''))) AS u FROM v_listings),
hs2 AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(CASE WHEN regexp_matches(u, '^https?://') THEN u ELSE concat('https://', u) END, '^https?://([^/?#]*)', 1), ':.*$', ''), '^www[.]', '') AS host, {DIGITS.format(c="telepon")} AS dg FROM hst),
sg0 AS (SELECT *, {PHONE} AS nomor, u <> '' AND u NOT IN ('-', 'n/a', 'none') AS ada, u <> '' AND u NOT IN ('-', 'n/a', 'none') AND {hosts("host", X.SOCIAL_HOSTS + X.MARKET_HOSTS)} AS sosial,
  coalesce(web_status IN ('mati', 'error'), false) AS mati, lower(coalesce(kategori, '')) AS kat, coalesce(rating, 0) AS rt, coalesce(jumlah_ulasan, 0) AS ul FROM hs2),
sg AS (SELECT *, ada AND coalesce(web_platform, '') NOT IN ('sosmed_saja', 'marketplace') AND NOT sosial AND NOT mati AS punya, coalesce(web_platform, '') IN ('sosmed_saja', 'marketplace') OR sosial AS sos,
  coalesce(web_platform, '') IN {listed(X.FREE_PLATFORMS)} AS gratis, nomor LIKE '628%' AND length(nomor) BETWEEN 10 AND 14 AS wa, coalesce(web_load_ms, 0) > 5000 AS lambat,
  coalesce(web_tahun_update <= {YEAR} - 3, false) AS basi, contains(lower(status_buka), 'permanen') OR contains(lower(status_buka), 'closed') AS tutup, instagram <> '' OR facebook <> '' AS akun FROM sg0)"""


def q_signals(spark, d):
    x = S.signals(view(spark, d, "listings"), YEAR)
    return x.select("seq", F.col("s_url").alias("ada"), F.col("s_web").alias("punya"), F.col("s_sosmed").alias("sos"), F.col("s_gratisan").alias("gratis"), F.col("s_basi").alias("basi"), F.col("s_wa").alias("wa"), F.col("s_tutup").alias("tutup"), F.coalesce(F.col("s_https").cast("string"), F.lit("?")).alias("https"))


def q_services(spark, d):
    return S.services(S.signals(view(spark, d, "listings"), YEAR)).select("seq", "jasa_utama", "jasa_pendukung")


SQL_RULES = [
    "tutup", "ada AND mati", "sos", "punya AND gratis", "NOT ada AND ul >= 20 AND rt >= 4.0", "NOT ada AND akun", "NOT ada", "punya AND NOT web_https", "punya AND NOT web_mobile", "punya AND lambat", "punya AND basi",
    f"punya AND NOT web_ada_toko AND {either('kat', X.RETAIL)}", "NOT sudah_diklaim", "rt <> 0 AND rt < 4.0 AND ul >= 30", "rt >= 4.0 AND ul > 0 AND ul < 10", "punya AND web_ada_pixel", "punya AND NOT web_ada_pixel", "ada AND coalesce(web_status, '') = ''",
]
FITS = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for (label, _), c in zip(S.RULES, SQL_RULES, strict=True)) + "], lambda x: x IS NOT NULL)"
UNIQUE = "list_filter(f, lambda x, i: list_position(f, x) = i)"
SERVICES = f"{SIGNALS}, ft AS (SELECT *, {FITS} AS f FROM sg), fu AS (SELECT *, {UNIQUE} AS g FROM ft)"


def q_scores(spark, d):
    x = S.score_leads(view(spark, d, "listings", spread=True), view(spark, d, "businesses"), YEAR)
    return x.select("seq", "cabang", "skor_butuh", "skor_mampu", "skor_hubungi", "skor_pembeli", "tier", "skor_popularitas", "jasa_utama")


def q_details(spark, d):
    """One row per lead and reason of its score, before limits and rounding."""
    x = S.score_details(S.score_leads(view(spark, d, "listings", spread=True), view(spark, d, "businesses"), YEAR))
    # the outer form: for the plain one the map is built again in a filter on its size; it is never empty
    return x.select("seq", F.explode_outer("rincian").alias("alasan", "poin"))


def pts(*pairs):
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in pairs)


SCORES = f"""{SERVICES},
cb AS (SELECT nama_bisnis, greatest(count(DISTINCT coalesce(alamat, place_key)), 1) AS cab FROM v_businesses WHERE length(trim(nama_bisnis)) >= 4 GROUP BY 1),
p0 AS (SELECT fu.*, coalesce(cab, 1) AS cabang FROM fu LEFT JOIN cb USING (nama_bisnis)),
p1 AS (SELECT *, least({pts(("NOT ada OR sos", 28), ("ada AND mati", 28), ("punya AND gratis", 12), ("NOT sudah_diklaim", 8), ("NOT web_https", 8), ("NOT web_mobile", 8), ("lambat", 6), ("basi", 6), ("NOT web_ada_pixel", 6), ("jumlah_foto = 0", 4))}, 40) AS b,
  greatest(0.0::DOUBLE, least(35.0::DOUBLE, least(15.0::DOUBLE, 5.0::DOUBLE * log10(ul + 1)) + {pts(("rt >= 4.0", 5), (either("kat", X.HIGH_VALUE), 10), (f"NOT {either('kat', X.HIGH_VALUE)} AND {either('kat', X.LOW_VALUE)}", -5), ("web_ada_pixel", 5), ("rentang_harga LIKE '%Rp%Rp%' OR contains(rentang_harga, '$$')", 5), ("cabang >= 2", 5))})) AS m,
  least({pts(("wa", 15), ("trim(coalesce(telepon, '')) <> ''", 5), ("email <> ''", 5), ("akun", 3))}, 25) AS h FROM p0),
p2 AS (SELECT *, CASE WHEN tutup THEN 0 ELSE round_even(b + m + h, 0)::BIGINT END AS skor FROM p1)"""
HIGH_SQL, LOW_SQL = either("kat", X.HIGH_VALUE), either("kat", X.LOW_VALUE)
WHEN = [
    "NOT ada OR sos", "ada AND mati", "punya AND gratis", "NOT sudah_diklaim", "NOT web_https", "NOT web_mobile", "lambat", "basi", "NOT web_ada_pixel", "jumlah_foto = 0",
    "rt >= 4.0", HIGH_SQL, f"NOT {HIGH_SQL} AND {LOW_SQL}", "web_ada_pixel", "rentang_harga LIKE '%Rp%Rp%' OR contains(rentang_harga, '$$')", "cabang >= 2",
    "wa", "trim(coalesce(telepon, '')) <> ''", "email <> ''", "akun",
]
DETAILS = " UNION ALL ".join(
    f"SELECT seq, replace('{reason}', '{{}}', cabang::VARCHAR) AS alasan, {n}::DOUBLE AS poin FROM p0 WHERE NOT tutup AND ({c})" for (reason, n), c in zip([x for part in X.SCORE_REASONS for x in part], WHEN, strict=True)
)
TIER = "CASE WHEN skor >= 75 THEN 'PANAS' WHEN skor >= 55 THEN 'HANGAT' WHEN skor >= 35 THEN 'DINGIN' ELSE 'ARSIP' END"


def q_message(spark, d):
    """Opening message and chat link of each lead."""
    x = S.services(S.signals(view(spark, d, "listings"), YEAR))
    text = F.replace(F.replace(F.lit("Halo {nama}, kami menawarkan {jasa}."), F.lit("{nama}"), F.coalesce("nama_bisnis", F.lit("Bapak/Ibu"))), F.lit("{jasa}"), F.col("jasa_utama"))
    return x.select("seq", text.alias("pesan"), (P.chat_link(F.col("telepon"), text) != "").alias("punya_tautan"))


def contact_reason(mode):
    """Why a lead's contacts don't do for a mode: wa (mobile number), telepon, email, apa_saja (any of four) or bebas (none needed); null: they do."""
    has = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    lacks = {
        "wa": (~P.is_mobile(F.col("telepon")), "bukan nomor HP/WhatsApp"), "telepon": (F.coalesce("telepon", F.lit("")) == "", "tidak ada nomor telepon"), "email": (~has("email"), "tidak ada email"),
        "apa_saja": (~((F.coalesce("telepon", F.lit("")) != "") | has("email") | has("instagram") | has("facebook")), "tidak ada kontak sama sekali"), "bebas": (F.lit(False), ""),
    }
    return F.when(*lacks[mode])


def first_reason(min_rating=None, min_reviews=None, contact="bebas", no_site=False, keep_closed=False):
    """The first reason a listing fails a filter, in fixed order; null passes. None or False switch a test off; unknown ratings and counts are 0."""
    tests = []
    if min_rating is not None:
        tests.append(F.when(F.coalesce("rating", F.lit(0.0)) < min_rating, f"rating < {min_rating}"))
    if min_reviews is not None:
        tests.append(F.when(F.coalesce("jumlah_ulasan", F.lit(0)) < min_reviews, f"ulasan < {min_reviews}"))
    tests.append(contact_reason(contact))
    if no_site:
        tests.append(F.when(P.has_site(F.col("website")), "sudah punya website"))
    if not keep_closed:
        tests.append(F.when(P.is_closed(F.col("status_buka")), "bisnis tutup"))
    return F.coalesce(*tests, F.lit(None).cast("string"))


MODES = ("wa", "telepon", "email", "apa_saja", "bebas")


def q_first_reason(spark, d):
    """First reason a listing fails, in fixed order; null passes."""
    return view(spark, d, "listings").select("seq", first_reason(3, 20, "wa", no_site=True).alias("alasan"))


def q_contact_modes(spark, d):
    """First reason of each listing under every contact mode, with thresholds of their own, closed businesses kept in the last one."""
    one = lambda m: F.struct(F.lit(m).alias("mode"), first_reason(1.5, None if m == "email" else 5, m, m == "apa_saja", m == "bebas").alias("alasan"))
    return view(spark, d, "listings").select("seq", F.inline(F.array(*map(one, MODES))))


REASON = f"CASE WHEN coalesce(rating, 0) < 3 THEN 'rating < 3' WHEN coalesce(jumlah_ulasan, 0) < 20 THEN 'ulasan < 20' WHEN NOT wa THEN 'bukan nomor HP/WhatsApp' WHEN ada THEN 'sudah punya website' WHEN {either('lower(status_buka)', X.CLOSED)} THEN 'bisnis tutup' END"


def q_prefilter(spark, d):
    """Only known bad facts drop a card."""
    v = view(spark, d, "listings")
    keep = (F.col("rating").isNull() | (F.col("rating") >= 3)) & (F.col("jumlah_ulasan").isNull() | (F.col("jumlah_ulasan") >= 20)) & (F.coalesce("telepon", F.lit("")).isin("") | P.is_mobile(F.col("telepon"))) & ~P.is_closed(F.col("status_buka"))
    return v.where(keep).select("seq", "nama_bisnis")


def q_quota(spark, d):
    """The first 20 cards per area that pass the pre-filter."""
    v = view(spark, d, "listings").where((F.col("rating").isNull() | (F.col("rating") >= 3)) & ~P.is_closed(F.col("status_buka")))
    return v.withColumn("n", F.row_number().over(Window.partitionBy("area_pencarian").orderBy("seq"))).where("n <= 20").select("area_pencarian", "seq", "n")


def q_reasons(spark, d):
    """Count per reason."""
    return q_first_reason(spark, d).where("alasan is not null").groupBy("alasan").agg(F.count("*").alias("n"))


def q_no_site(spark, d):
    v = view(spark, d, "listings").where(~P.has_site(F.col("website")))
    u = F.coalesce("jumlah_ulasan", F.lit(0))
    grade = F.when((P.number_or_zero(F.col("rating")) >= 4.0) & (u >= 50), "High").when((P.number_or_zero(F.col("rating")) >= 3.5) & (u >= 10), "Medium").otherwise("Low")
    return v.select("seq", "nama_bisnis", grade.alias("potensi"))


def q_search(spark, d):
    """Filtered lead page with the count of all matches."""
    b = view(spark, d, "businesses").where(F.col("tier").isin("PANAS", "HANGAT") & (F.coalesce("whatsapp_link", F.lit("")) != "") & (F.coalesce("skor_pembeli", F.lit(0)) >= 55))
    b = b.where(F.lower("nama_bisnis").contains("bisnis") | F.lower("alamat").contains("bisnis") | F.lower("kategori").contains("bisnis"))
    n = b.agg(F.count("*").alias("total"))
    page = b.orderBy(F.coalesce("skor_pembeli", F.lit(0)).desc(), "place_key").offset(5).limit(10)
    return page.select("place_key", "nama_bisnis", "skor_pembeli").join(F.broadcast(n))


def q_export(spark, d):
    return view(spark, d, "businesses").where("tier = 'PANAS'").orderBy(F.col("skor_pembeli").desc(), "place_key").limit(100_000).select("place_key", "nama_bisnis", "telepon", "skor_pembeli", "tier")


def q_dashboard(spark, d):
    """All lead counts in one scan: grouping sets for the breakdowns, conditional counts for the rest."""
    b = view(spark, d, "businesses")
    sets = b.groupingSets([["tier"], ["jasa_utama"], ["area_pencarian"], ["status_leads"]], "tier", "jasa_utama", "area_pencarian", "status_leads").agg(F.grouping_id().alias("g"), F.count("*").alias("n"))
    key = F.coalesce("tier", "jasa_utama", "area_pencarian", "status_leads")
    kind = F.when(F.col("g") == 7, "tier").when(F.col("g") == 11, "jasa").when(F.col("g") == 13, "area").otherwise("status")
    sets = sets.select(kind.alias("jenis"), key.alias("k"), "n").where("coalesce(k, '') <> ''")
    top = F.row_number().over(Window.partitionBy("jenis").orderBy(F.desc("n"), "k"))
    sets = sets.withColumn("r", top).where("jenis in ('tier', 'status') or (jenis = 'jasa' and r <= 12) or (jenis = 'area' and r <= 10)").drop("r")
    totals = {
        "total": F.lit(True), "belum_dihubungi": F.coalesce("status_leads", F.lit("Belum Dihubungi")) == "Belum Dihubungi", "punya_wa": F.coalesce("whatsapp_link", F.lit("")) != "",
        "follow_up": (F.col("tanggal_follow_up") <= X.AS_OF[:10]) & ~F.col("status_leads").isin("Deal", "Tidak Tertarik"), "baru_30_hari": F.col("first_seen_at") >= "2023-12-16 00:00:00",
    }
    one = b.agg(*(F.count_if(c).alias(k) for k, c in totals.items()))
    rest = one.select(F.inline(F.array(*(F.struct(F.lit("semua").alias("jenis"), F.lit(k).alias("k"), F.col(k).alias("n")) for k in totals))))
    return sets.unionByName(rest)


def q_branches(spark, d):
    return S.branches(view(spark, d, "businesses"))


def q_campaign(spark, d):
    """Counts by tier, service and area with empty ones named."""
    b = view(spark, d, "businesses")
    pair = F.inline(F.array(*(F.struct(F.lit(j).alias("jenis"), F.coalesce(F.col(c), F.lit("(kosong)")).alias("nilai")) for j, c in (("tier", "tier"), ("jasa", "jasa_utama"), ("area", "area_pencarian")))))
    return b.select(pair).groupBy("jenis", "nilai").agg(F.count("*").alias("n"))


def q_distinct(spark, d):
    return view(spark, d, "businesses").select("kategori").where("coalesce(kategori, '') <> ''").distinct()


def q_union(spark, d):
    """Leads from listings and stored businesses in one shape, with their origin."""
    a = view(spark, d, "listings").select(F.col("nama_bisnis").alias("nama"), "telepon", F.lit("listing").alias("asal"), "rating")
    b = view(spark, d, "businesses").select(F.col("nama_bisnis").alias("nama"), "telepon", F.lit("tersimpan").alias("asal"))
    return a.unionByName(b, allowMissingColumns=True).groupBy("asal").agg(F.count("*").alias("n"), F.count("rating").alias("n_rating"), F.count("telepon").alias("n_telepon"))


def build():
    L, B = "listings", "businesses"
    return {
        "sco1_signals": (q_signals, with_views(f"WITH {SIGNALS} SELECT seq, ada, punya, sos, gratis, basi, wa, tutup, coalesce(web_https::VARCHAR, '?') AS https FROM sg", L)),
        "sco2_services": (q_services, with_views(f"WITH {SERVICES} SELECT seq, coalesce(g[1], '{S.MANUAL}') AS jasa_utama, array_to_string(g[2:3], ' | ') AS jasa_pendukung FROM fu", L)),
        "sco3_details": (q_details, with_views(f"WITH {SCORES} {DETAILS} UNION ALL SELECT seq, concat('ukuran bisnis (', ul::BIGINT, ' ulasan)'), round_even(least(15.0::DOUBLE, 5.0::DOUBLE * log10(ul + 1)), 1) FROM p0 WHERE NOT tutup UNION ALL SELECT seq, 'tutup permanen', 0.0::DOUBLE FROM p0 WHERE tutup", L, B)),
        "sco3_6_scores": (q_scores, with_views(f"WITH {SCORES} SELECT seq, cabang, b::BIGINT AS skor_butuh, round_even(m, 0)::BIGINT AS skor_mampu, h::BIGINT AS skor_hubungi, skor AS skor_pembeli, {TIER} AS tier, CASE WHEN rt = 0 THEN 0 ELSE round_even(least(rt * log10(ul + 1), 10.0), 2) END::DOUBLE AS skor_popularitas, coalesce(g[1], '{S.MANUAL}') AS jasa_utama FROM p2", L, B)),
        "sco7_message": (q_message, with_views(f"WITH {SERVICES} SELECT seq, concat('Halo ', nama_bisnis, ', kami menawarkan ', coalesce(g[1], '{S.MANUAL}'), '.') AS pesan, wa AS punya_tautan FROM fu", L)),
        "flt1_prefilter": (q_prefilter, with_views(f"WITH {SIGNALS} SELECT seq, nama_bisnis FROM sg WHERE (rating IS NULL OR rating >= 3) AND (jumlah_ulasan IS NULL OR jumlah_ulasan >= 20) AND (coalesce(telepon, '') = '' OR wa) AND NOT {either('lower(status_buka)', X.CLOSED)}", L)),
        "flt2_first_reason": (q_first_reason, with_views(f"WITH {SIGNALS} SELECT seq, {REASON} AS alasan FROM sg", L)),
        "flt2_contact_modes": (q_contact_modes, with_views(f"WITH {SIGNALS} " + " UNION ALL ".join(f"""SELECT seq, '{m}' AS mode, CASE WHEN coalesce(rating, 0) < 1.5 THEN 'rating < 1.5' WHEN {'false' if m == 'email' else 'coalesce(jumlah_ulasan, 0) < 5'} THEN 'ulasan < 5' {t} {"WHEN ada THEN 'sudah punya website'" if m == 'apa_saja' else ''}
 {"" if m == 'bebas' else f"WHEN {either('lower(status_buka)', X.CLOSED)} THEN 'bisnis tutup'"} END AS alasan FROM sg""" for m, t in zip(MODES, (
            "WHEN NOT wa THEN 'bukan nomor HP/WhatsApp'", "WHEN telepon IS NULL OR telepon = '' THEN 'tidak ada nomor telepon'", "WHEN trim(coalesce(email, '')) = '' THEN 'tidak ada email'",
            "WHEN concat(telepon, trim(email), trim(instagram), trim(facebook)) = '' THEN 'tidak ada kontak sama sekali'", ""), strict=True)), L)),
        "flt4_no_site": (q_no_site, with_views(f"WITH {SIGNALS} SELECT seq, nama_bisnis, CASE WHEN rt >= 4.0 AND ul >= 50 THEN 'High' WHEN rt >= 3.5 AND ul >= 10 THEN 'Medium' ELSE 'Low' END AS potensi FROM sg WHERE NOT ada", L)),
        "win4_quota": (q_quota, with_views(f"SELECT area_pencarian, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY area_pencarian ORDER BY seq) AS n FROM v_listings WHERE (rating IS NULL OR rating >= 3) AND NOT {either('lower(status_buka)', X.CLOSED)}) WHERE n <= 20", L)),
        "agg5_reasons": (q_reasons, with_views(f"WITH {SIGNALS} SELECT {REASON} AS alasan, count(*) AS n FROM sg GROUP BY 1 HAVING alasan IS NOT NULL", L)),
        "qry1_lead_page": (q_search, with_views("WITH f AS (SELECT * FROM v_businesses WHERE tier IN ('PANAS', 'HANGAT') AND coalesce(whatsapp_link, '') <> '' AND coalesce(skor_pembeli, 0) >= 55 AND (nama_bisnis ILIKE '%bisnis%' OR alamat ILIKE '%bisnis%' OR kategori ILIKE '%bisnis%')) SELECT place_key, nama_bisnis, skor_pembeli, (SELECT count(*) FROM f) AS total FROM f ORDER BY coalesce(skor_pembeli, 0) DESC, place_key LIMIT 10 OFFSET 5", B)),
        "io9_export": (q_export, with_views("SELECT place_key, nama_bisnis, telepon, skor_pembeli, tier FROM v_businesses WHERE tier = 'PANAS' ORDER BY skor_pembeli DESC, place_key LIMIT 100000", B)),
        "agg1_dashboard": (q_dashboard, with_views("""WITH k AS (SELECT 'tier' AS jenis, tier AS k, count(*) AS n FROM v_businesses GROUP BY 2 UNION ALL SELECT 'jasa', jasa_utama, count(*) FROM v_businesses GROUP BY 2 UNION ALL SELECT 'area', area_pencarian, count(*) FROM v_businesses GROUP BY 2 UNION ALL SELECT 'status', status_leads, count(*) FROM v_businesses GROUP BY 2),
r AS (SELECT *, row_number() OVER (PARTITION BY jenis ORDER BY n DESC, k) AS r FROM k WHERE coalesce(k, '') <> '')
SELECT jenis, k, n FROM r WHERE jenis IN ('tier', 'status') OR (jenis = 'jasa' AND r <= 12) OR (jenis = 'area' AND r <= 10)
UNION ALL SELECT 'semua', 'total', count(*) FROM v_businesses UNION ALL SELECT 'semua', 'belum_dihubungi', count(*) FROM v_businesses WHERE status_leads IS NULL OR status_leads = 'Belum Dihubungi'
UNION ALL SELECT 'semua', 'punya_wa', count(*) FROM v_businesses WHERE coalesce(whatsapp_link, '') <> '' UNION ALL SELECT 'semua', 'follow_up', count(*) FROM v_businesses WHERE tanggal_follow_up <= '2024-01-15' AND status_leads NOT IN ('Deal', 'Tidak Tertarik')
UNION ALL SELECT 'semua', 'baru_30_hari', count(*) FROM v_businesses WHERE first_seen_at >= '2023-12-16 00:00:00'""", B)),
        "agg3_branches": (q_branches, with_views("SELECT nama_bisnis, greatest(count(DISTINCT coalesce(alamat, place_key)), 1) AS cabang FROM v_businesses WHERE length(trim(nama_bisnis)) >= 4 GROUP BY 1", B)),
        "agg6_campaign": (q_campaign, with_views("SELECT 'tier' AS jenis, coalesce(tier, '(kosong)') AS nilai, count(*) AS n FROM v_businesses GROUP BY 2 UNION ALL SELECT 'jasa', coalesce(jasa_utama, '(kosong)'), count(*) FROM v_businesses GROUP BY 2 UNION ALL SELECT 'area', coalesce(area_pencarian, '(kosong)'), count(*) FROM v_businesses GROUP BY 2", B)),
        "dst1_categories": (q_distinct, with_views("SELECT DISTINCT kategori FROM v_businesses WHERE coalesce(kategori, '') <> ''", B)),
        "set1_union": (q_union, with_views("SELECT 'listing' AS asal, count(*) AS n, count(rating) AS n_rating, count(telepon) AS n_telepon FROM v_listings UNION ALL SELECT 'tersimpan', count(*), 0, count(telepon) FROM v_businesses", L, B)),
    }
