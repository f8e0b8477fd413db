"""Signals of captured web pages and of listings' sites; regular expressions only, one pass over the text."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.functions import parse as P
from marketlens.functions import scoring as S
from marketlens.operators.leads import SIGNALS, hosts
from marketlens.sources.tables import table
from marketlens.sources.views import view, with_views

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
RIGHTS = r"(?is)(?:©|&copy;|copyright).{0,40}"
VIEWPORT = "(?i)<meta[^>]+name=[\"']?viewport"
GENERATOR = "(?i)<meta[^>]+name=[\"']generator[\"'][^>]+content=[\"']([^\"']+)"
LIMIT = 200_000
CONTACT = "(?i)(kontak|contact|hubungi|about|tentang|profil)"

# Site builders in order: label, test on host, on the page's text or on its response headers.
BUILDERS = [
    ("Blogspot", "host LIKE '%blogspot.%'"), ("WordPress.com", "host LIKE '%.wordpress.com%'"), ("Google Sites", "host LIKE '%sites.google.com%'"), ("Wix (subdomain)", "host LIKE '%wixsite.com%'"),
    ("Weebly", "host LIKE '%weebly.com%'"), ("Webnode", "host LIKE '%webnode.%'"), ("Wix", "low LIKE '%wix.com%' OR hdr LIKE '%x-wix-%' OR low LIKE '%\\_wixcssimports%'"), ("Shopify", "low LIKE '%cdn.shopify.com%' OR hdr LIKE '%shopify%'"),
    ("Webflow", "host LIKE '%webflow.io%' OR low LIKE '%webflow.com%'"), ("Squarespace", "low LIKE '%squarespace%'"), ("WordPress", "low LIKE '%wp-content%' OR low LIKE '%wp-includes%' OR low LIKE '%wp-json%'"),
]


def emails(text):
    """Cleaned addresses in order, without junk, each once."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(EMAIL), F.lit(0)), lambda e: F.lower(F.rtrim(e, F.lit(".,;:"))))
    return F.array_distinct(F.filter(found, lambda e: (F.length(e) <= 80) & ~P.contains_any(e, X.JUNK_EMAIL)))


def latest_year(text, year):
    """The greatest year near a copyright mark, else in the last 800 characters."""
    near = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(RIGHTS), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit("20[0-9]{2}"), F.lit(0))))
    last = F.regexp_extract_all(F.substring(text, -800, 800), F.lit("20[0-9]{2}"), F.lit(0))
    years = F.transform(F.when(F.size(near) > 0, near).otherwise(last), lambda y: y.cast("int"))
    return F.array_max(F.filter(years, lambda y: y.between(2000, year + 1)))


def platform(rows):
    """Site builder by host, then text and response headers (a map, if the rows have `headers`), then generator tag."""
    sent = F.concat_ws(" ", F.transform(F.map_entries("headers"), lambda e: F.concat_ws(":", e["key"], e["value"]))) if "headers" in rows.columns else F.lit("")
    x = rows.withColumn("hdr", F.lower(sent)).withColumn("host", S.bare_host(F.col("url"))).withColumn("low", F.lower(F.substring("html", 1, LIMIT)))
    out = F.when(S.host_in(F.col("host"), X.SOCIAL_HOSTS), "sosmed_saja").when(S.host_in(F.col("host"), X.MARKET_HOSTS), "marketplace")
    for label, test in BUILDERS:
        out = out.when(F.expr(test.replace("\\_", "\\\\_")), label)
    tag = F.substring(F.trim(F.regexp_extract("html", GENERATOR, 1)), 1, 40)
    return x.withColumn("platform", out.when(tag != "", tag).otherwise("custom"))


def links(html):
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def q_signals(spark, d):
    p = platform(table(spark, d, "pages"))
    return p.select("page_id", "platform", P.contains_any(F.col("low"), X.PIXEL_MARKS).alias("pixel"), P.contains_any(F.col("low"), X.SHOP_MARKS).alias("toko"), F.col("html").rlike(VIEWPORT).alias("mobile"), latest_year(F.col("html"), 2026).alias("tahun"))


def q_emails(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.get(emails(F.col("text")), 0), F.lit("")).alias("email"), F.size(emails(F.col("text"))).alias("n"))


def q_accounts(spark, d):
    """First own social account in a page's links; share links and posts don't count."""
    own = F.filter(links(F.col("html")), lambda h: F.lower(h).rlike(r"(instagram|facebook|tiktok)\.com/") & ~F.lower(h).rlike(r"sharer|share\.php|/share\?|intent/|developers\.|/p/|reel|explore"))
    return table(spark, d, "pages").select("page_id", F.coalesce(F.regexp_replace(F.get(own, 0), r"[?].*$", ""), F.lit("")).alias("akun"), F.size(links(F.col("html"))).cast("long").alias("tautan"))


def q_hosts(spark, d):
    v = view(spark, d, "listings")
    return v.select("seq", S.bare_host(F.col("website")).alias("host"), S.social_url(F.col("website")).alias("sosial"), S.own_site(F.col("website"), F.col("web_platform"), F.col("web_status")).alias("efektif"), F.lower(F.coalesce("website", F.lit(""))).startswith("https://").alias("https"))


def status():
    """Status of a captured response by its code, as a function of the page id's last digit."""
    code = F.when(F.col("page_id") % 10 == 0, 503).when(F.col("page_id") % 10 == 1, 404).when(F.col("page_id") % 10 == 2, F.lit(None).cast("int")).otherwise(200)
    return F.when(code.isNull() | (code >= 500), "mati").when(code >= 400, "error").otherwise("aktif")


def q_status(spark, d):
    return table(spark, d, "pages").select("page_id", status().alias("web_status"), F.col("url").startswith("https://").alias("web_https"))


def q_contact_links(spark, d):
    """The first two links of each page that look like contact pages."""
    x = table(spark, d, "pages").select("page_id", F.posexplode(links(F.col("html"))).alias("pos", "href")).where(F.col("href").rlike(CONTACT))
    w = Window.partitionBy("page_id").orderBy("pos")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 2").select("page_id", "href", "n")


def page_emails(html):
    """Addresses of a page: those of mailto links first, then those in its text."""
    mailto = F.regexp_extract_all(html, F.lit("(?i)href=[\"']mailto:([^\"'?]*)"), F.lit(1))
    return emails(F.concat_ws(" ", F.array_join(mailto, " "), F.regexp_replace(html, "<[^>]*>", " ")))


def absolute(base, href):
    """A link of a page as a full URL without its fragment; other schemes stay as they are."""
    site, folder = F.regexp_extract(base, "^(https?://[^/?#]*)", 1), F.regexp_extract(base, "^(https?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    full = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), href)).when(href.startswith("/"), F.concat(site, href))
    return F.regexp_replace(full.otherwise(F.concat(F.regexp_replace(folder, "([^/])$", "$1/"), href)), "#.*$", "")


def contact_emails(pages):
    """Per page (page_id, url, html, web_status) its e-mail; an active one without takes that of its first two contact links on the same host."""
    own = F.get(page_emails(F.col("html")), 0)
    host = lambda u: F.lower(F.regexp_extract(u, "^https?://([^/?#]*)", 1))
    anchor = r'(?is)<a\b[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
    pairs = F.arrays_zip(*(F.regexp_extract_all("html", F.lit(anchor), F.lit(g)).alias(n) for g, n in ((1, "href"), (2, "teks"))))
    x = pages.where(own.isNull() & (F.col("web_status") == "aktif")).select("page_id", "url", F.posexplode(pairs).alias("pos", "a"))
    x = x.where(F.concat_ws(" ", "a.href", F.regexp_replace("a.teks", "<[^>]*>", " ")).rlike(CONTACT)).select("page_id", "url", "pos", absolute(F.col("url"), F.col("a.href")).alias("tujuan"))
    x = x.where(host(F.col("tujuan")) == host(F.col("url"))).withColumn("n", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).where("n <= 2")
    linked = pages.select(F.col("url").alias("tujuan"), "page_id", own.alias("mail")).where("mail is not null").groupBy("tujuan").agg(F.min_by("mail", "page_id").alias("mail"))
    second = x.join(linked, "tujuan").groupBy("page_id").agg(F.min_by("mail", "n").alias("kontak"))
    return pages.select("page_id", own.alias("mail")).join(second, "page_id", "left").select("page_id", F.coalesce("mail", "kontak", F.lit("")).alias("email"), (F.col("mail").isNull() & F.col("kontak").isNotNull()).alias("dari_kontak"))


def q_contact_emails(spark, d):
    return contact_emails(table(spark, d, "pages").withColumn("web_status", status()))


def q_attach(spark, d):
    """Listings with signals of their pages; an empty new value never replaces a known one."""
    p = table(spark, d, "pages").select((F.col("page_id") * 6 + 2).alias("seq"), F.lit("").alias("ig"), F.coalesce(F.get(emails(F.col("html")), 0), F.lit("")).alias("mail"), latest_year(F.col("html"), 2026).alias("tahun"))
    keep = lambda new, old: F.coalesce(F.nullif(F.col(new), F.lit("")), F.col(old)).alias(old)
    return view(spark, d, "listings").join(p, "seq", "left").select("seq", keep("mail", "email"), keep("ig", "instagram"), "tahun")


def q_blocked(spark, d):
    """Captured pages that show a block notice in title or first 3000 characters, or whose url leads to a check or a login."""
    low = F.lower(F.substring("html", 1, 3000))
    why = F.coalesce(*(F.when(F.contains(low, F.lit(w)), w) for w in X.BLOCK_TEXT), *(F.when(F.contains(F.lower("url"), F.lit(w)), w) for w in X.BLOCK_URL))
    return table(spark, d, "pages").select("page_id", why.alias("alasan"), F.length("html").cast("long").alias("n"))


def build():
    low = f"lower(left(html, {LIMIT}))"
    many = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
    chain = " ".join(f"WHEN {t.replace(chr(92) + '_', '_')} THEN '{n}'" for n, t in BUILDERS)
    host = r"regexp_replace(regexp_extract(lower(url), '^https?://([^/?#:]*)', 1), '^www[.]', '')"
    years = "list_max(list_filter(list_transform(CASE WHEN len(nr) > 0 THEN nr ELSE regexp_extract_all(right(html, 800), '20[0-9]{2}') END, lambda y: y::INTEGER), lambda y: y BETWEEN 2000 AND 2027))"
    near = r"flatten(list_transform(regexp_extract_all(html, '(?is)(?:©|&copy;|copyright).{0,40}'), lambda m: regexp_extract_all(m, '20[0-9]{2}')))"
    clean = lambda c: f"list_filter(list_transform(regexp_extract_all(coalesce({c}, ''), '{EMAIL}'), lambda e: lower(rtrim(e, '.,;:'))), lambda e: length(e) <= 80 AND NOT {many('e', X.JUNK_EMAIL)})"
    return {
        "web2_4_7_signals": (q_signals, f"""WITH h AS (SELECT *, {host} AS host, {low} AS low, '' AS hdr, {near} AS nr FROM pages)
SELECT page_id, CASE WHEN {hosts('host', X.SOCIAL_HOSTS)} THEN 'sosmed_saja' WHEN {hosts('host', X.MARKET_HOSTS)} THEN 'marketplace' {chain} ELSE 'custom' END AS platform, {many('low', X.PIXEL_MARKS)} AS pixel, {many('low', X.SHOP_MARKS)} AS toko, regexp_matches(html, '(?i)<meta[^>]+name=["'']?viewport') AS mobile, {years} AS tahun FROM h"""),
        "web5_emails": (q_emails, f"WITH c AS (SELECT doc_id, {clean('text')} AS e FROM documents) SELECT doc_id, coalesce(e[1], '') AS email, len(list_distinct(e))::INTEGER AS n FROM c"),
        "web6_accounts": (q_accounts, r"""WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ls FROM pages) SELECT page_id, coalesce(regexp_replace(list_filter(ls, lambda h: regexp_matches(lower(h), '(instagram|facebook|tiktok)\.com/') AND NOT regexp_matches(lower(h), 'sharer|share\.php|/share\?|intent/|developers\.|/p/|reel|explore'))[1], '[?].*$', ''), '') AS akun, len(ls) AS tautan FROM l"""),
        "web1_9_hosts": (q_hosts, with_views(f"WITH {SIGNALS} SELECT seq, host, sosial, punya AS efektif, u LIKE 'https://%' AS https FROM sg", "listings")),
        "web8_status": (q_status, "SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'mati' WHEN 2 THEN 'mati' WHEN 1 THEN 'error' ELSE 'aktif' END AS web_status, url LIKE 'https://%' AS web_https FROM pages"),
        "web10_contact_links": (q_contact_links, """WITH l AS (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS ls FROM pages), e AS (SELECT page_id, unnest(ls) AS href, generate_subscripts(ls, 1) AS pos FROM l) SELECT * FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n FROM e WHERE regexp_matches(href, '(?i)(kontak|contact|hubungi|about|tentang|profil)')) WHERE n <= 2"""),
        "web10_contact_emails": (q_contact_emails, None),
        "web11_attach": (q_attach, with_views(f"WITH h AS (SELECT *, {near} AS nr, {clean('html')} AS e FROM pages), p AS (SELECT page_id * 6 + 2 AS seq, coalesce(e[1], '') AS mail, {years} AS tahun FROM h) SELECT l.seq, coalesce(nullif(mail, ''), email) AS email, instagram, tahun FROM v_listings l LEFT JOIN p USING (seq)", "listings")),
        "prs14_blocked_pages": (q_blocked, "SELECT page_id, CASE " + " ".join([*(f"WHEN contains(lower(left(html, 3000)), '{w}') THEN '{w}'" for w in X.BLOCK_TEXT), *(f"WHEN contains(lower(url), '{w}') THEN '{w}'" for w in X.BLOCK_URL)]) + " END AS alasan, length(html) AS n FROM pages"),
    }


