"""Lead signals, service rules and buyer score as column expressions."""

import re

from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.functions import parse as P


def bare_host(url):
    """Lower-case host without port and www."""
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    h = F.regexp_extract(F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u)), r"^https?://([^/?#]*)", 1)
    return F.regexp_replace(F.trim(F.regexp_replace(h, ":.*$", ""), F.lit(".")), r"^www\.", "")


def host_in(host, domains):
    """Whether the host is one of the domains or below one; never a substring match. One expression, so the host is found once."""
    return host.rlike(r"(?:^|\.)(?:" + "|".join(re.escape(d) for d in domains) + r")\z")


def social_url(url):
    u = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    return (u != "") & ~u.isin(*X.NO_SITE) & host_in(bare_host(url), X.SOCIAL_HOSTS + X.MARKET_HOSTS)


def own_site(url, platform, status):
    """A site of its own that is alive."""
    return P.has_site(url) & ~F.coalesce(platform.isin("sosmed_saja", "marketplace"), F.lit(False)) & ~social_url(url) & ~F.coalesce(status.isin("mati", "error"), F.lit(False))


def signals(rows, year):
    """The rows with one column per signal; unknown flags stay null."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    platform = F.coalesce("web_platform", F.lit(""))
    url, status = text("website"), F.lower(F.coalesce("status_buka", F.lit("")))
    return rows.withColumns({
        "s_kategori": F.lower(F.coalesce("kategori", F.lit(""))), "s_rating": P.number_or_zero(F.col("rating")), "s_ulasan": F.coalesce(F.col("jumlah_ulasan"), F.lit(0)).cast("long"),
        "s_url": (url != "") & ~url.isin(*X.NO_SITE), "s_web": own_site(F.col("website"), F.col("web_platform"), F.col("web_status")), "s_belum_cek": F.coalesce("web_status", F.lit("")) == "",
        "s_mati": F.coalesce(F.col("web_status").isin("mati", "error"), F.lit(False)), "s_gratisan": platform.isin(*X.FREE_PLATFORMS), "s_sosmed": platform.isin("sosmed_saja", "marketplace") | social_url(F.col("website")),
        "s_https": P.tri(F.col("web_https")), "s_mobile": P.tri(F.col("web_mobile")), "s_pixel": P.tri(F.col("web_ada_pixel")), "s_toko": P.tri(F.col("web_ada_toko")), "s_diklaim": P.tri(F.col("sudah_diklaim")),
        "s_lambat": F.coalesce("web_load_ms", F.lit(0)) > 5000, "s_basi": F.coalesce((F.col("web_tahun_update") != 0) & (F.col("web_tahun_update") <= year - 3), F.lit(False)),
        "s_telepon": text("telepon") != "", "s_wa": P.is_mobile(F.col("telepon")), "s_email": text("email") != "", "s_akun": (text("instagram") != "") | (text("facebook") != ""),
        "s_tanpa_foto": F.coalesce(F.col("jumlah_foto") == 0, F.lit(False)), "s_harga": F.coalesce("rentang_harga", F.lit("")), "s_tutup": F.contains(status, F.lit("permanen")) | F.contains(status, F.lit("closed")),
    })


# Service rules in order of preference: label, then the condition on signals.
RULES = [
    ("Bisnis Tutup — Lewati", "s_tutup"),
    ("Website Baru (URGENT)", "s_url AND s_mati"),
    ("Landing Page + Iklan Sosmed", "s_sosmed"),
    ("Upgrade Website Profesional", "s_web AND s_gratisan"),
    ("Website Company Profile", "NOT s_url AND s_ulasan >= 20 AND s_rating >= 4.0"),
    ("Landing Page + Iklan Instagram", "NOT s_url AND s_akun"),
    ("Website Company Profile", "NOT s_url"),
    ("Redesign + Pasang SSL", "s_web AND NOT s_https"),
    ("Redesign Mobile-First", "s_web AND NOT s_mobile"),
    ("Optimasi Kecepatan Website", "s_web AND s_lambat"),
    ("Redesign (situs terbengkalai)", "s_web AND s_basi"),
    ("Toko Online / Sistem Order", "s_web AND NOT s_toko AND s_retail"),
    ("Optimasi Google Business Profile", "NOT s_diklaim"),
    ("Reputation Management + Ads", "s_rating <> 0 AND s_rating < 4.0 AND s_ulasan >= 30"),
    ("Optimasi Google Business Profile", "s_rating >= 4.0 AND s_ulasan > 0 AND s_ulasan < 10"),
    ("Scale-up Google & Meta Ads", "s_web AND s_pixel"),
    ("Google Ads + Setup Tracking", "s_web AND NOT s_pixel"),
    ("Perlu Cek Website Dulu", "s_url AND s_belum_cek"),
]
MANUAL = "Perlu Riset Manual"


def services(rows, rules=None):
    """jasa_utama (first rule that fits) and jasa_pendukung (up to two other services)."""
    rows = rows.withColumn("s_retail", P.contains_any(F.col("s_kategori"), X.RETAIL))
    fits = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(label)) for label, c in rules or RULES)))
    rows = rows.withColumn("_fits", F.array_distinct(fits))
    return rows.withColumn("jasa_utama", F.coalesce(F.get("_fits", 0), F.lit(MANUAL))).withColumn("jasa_pendukung", F.array_join(F.slice("_fits", 2, 2), " | ")).drop("_fits")


def _points(*pairs):
    return sum((F.when(F.coalesce(c, F.lit(False)), n).otherwise(0) for c, n in pairs), F.lit(0))


def score_parts():
    """Points of need, means and reach as (reason, condition, points); the points for reviews are apart."""
    c = F.col
    high, low = P.contains_any(c("s_kategori"), X.HIGH_VALUE), P.contains_any(c("s_kategori"), X.LOW_VALUE)
    several = (F.size(F.split(c("s_harga"), "Rp")) >= 3) | F.contains(c("s_harga"), F.lit("$$"))
    need = [~c("s_url") | c("s_sosmed"), c("s_url") & c("s_mati"), c("s_web") & c("s_gratisan"), ~c("s_diklaim"), ~c("s_https"), ~c("s_mobile"), c("s_lambat"), c("s_basi"), ~c("s_pixel"), c("s_tanpa_foto")]
    means = [c("s_rating") >= 4.0, high, ~high & low, c("s_pixel"), several, c("cabang") >= 2]
    reach = [c("s_wa"), c("s_telepon"), c("s_email"), c("s_akun")]
    return tuple([(reason, condition, n) for (reason, n), condition in zip(reasons, conditions, strict=True)] for reasons, conditions in zip(X.SCORE_REASONS, (need, means, reach), strict=True))


def score_details(rows):
    """rincian: a map from each reason that counts to its points, before limits and rounding; a closed place has one reason of no points."""
    named = {"punya {} lokasi": F.concat(F.lit("punya "), F.col("cabang").cast("string"), F.lit(" lokasi"))}
    one = lambda reason, points: F.struct(named.get(reason, F.lit(reason)).alias("alasan"), points.cast("double").alias("poin"))
    size = F.concat(F.lit("ukuran bisnis ("), F.col("s_ulasan").cast("string"), F.lit(" ulasan)"))
    reviews = F.struct(size.alias("alasan"), F.bround(review_points(), 1).alias("poin"))
    found = F.array(reviews, *(F.when(F.coalesce(condition, F.lit(False)), one(reason, F.lit(n))) for part in score_parts() for reason, condition, n in part))
    closed = F.array(one("tutup permanen", F.lit(0)))
    return rows.withColumn("rincian", F.map_from_entries(F.when(F.col("s_tutup"), closed).otherwise(F.filter(found, lambda x: x.isNotNull()))))


def review_points():
    return F.least(F.lit(15.0), F.lit(5.0) * F.log10(F.col("s_ulasan") + F.lit(1)))


def buyer_score(rows):
    """skor_butuh, skor_mampu, skor_hubungi, skor_pembeli, tier and skor_popularitas."""
    c = F.col
    need, means, reach = (_points(*((condition, n) for _, condition, n in part)) for part in score_parts())
    means = review_points() + means
    rows = rows.withColumn("b", F.least(need, F.lit(40))).withColumn("m", F.greatest(F.lit(0.0), F.least(means, F.lit(35.0)))).withColumn("h", F.least(reach, F.lit(25)))
    total = F.when(c("s_tutup"), 0).otherwise(F.bround(c("b") + c("m") + c("h"))).cast("long")
    popular = F.when(c("s_rating") == 0, 0.0).otherwise(F.bround(F.least(c("s_rating") * F.log10(c("s_ulasan") + F.lit(1)), F.lit(10.0)), 2))
    rows = rows.withColumn("skor_pembeli", total).withColumns({"skor_butuh": c("b").cast("long"), "skor_mampu": F.bround("m").cast("long"), "skor_hubungi": c("h").cast("long"), "skor_popularitas": popular})
    return rows.withColumn("tier", tier(c("skor_pembeli"))).drop("b", "m", "h")


def tier(score):
    return F.when(score >= 75, "PANAS").when(score >= 55, "HANGAT").when(score >= 35, "DINGIN").otherwise("ARSIP")


def branches(businesses):
    """nama_bisnis -> number of places with that name; two aggregations, so hot names are combined first."""
    named = businesses.where(F.length(F.trim("nama_bisnis")) >= 4).select("nama_bisnis", F.coalesce("alamat", "place_key").alias("tempat")).distinct()
    return named.groupBy("nama_bisnis").agg(F.greatest(F.count("*"), F.lit(1)).alias("cabang"))


def score_leads(rows, businesses, year):
    """All of the above attached to each lead."""
    rows = rows.join(branches(businesses), "nama_bisnis", "left").withColumn("cabang", F.coalesce("cabang", F.lit(1)))
    return buyer_score(services(signals(rows, year)))
