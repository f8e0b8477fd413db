"""Two runs over captured cards: their change log, the table in buckets after them, and pages of it."""

import uuid

from pyspark.sql import functions as F

from marketlens.functions.frames import checkpoint_folder, kept
from marketlens.functions.ranks import numbered, page
from marketlens.operators import buckets, history, ledger
from marketlens.operators.ledger import CHANGES
from marketlens.sources.views import view, with_views

FIRST_RUN, SECOND_RUN = "2023-11-20 08:00:00", "2024-01-10 17:30:00"

SORTS = {
    "skor_pembeli": [("_urut", False), ("place_key", True)],
    "ulasan": [("_urut", False), ("place_key", True)],
    "rating": [("_urut", False), ("place_key", True)],
    "terbaru": [("first_seen_at", False), ("place_key", True)],
    "nama": [("nama_bisnis", True), ("place_key", True)],
}
COLUMN = {"skor_pembeli": "skor_pembeli", "ulasan": "jumlah_ulasan", "rating": "rating"}


def lead_filter(rows, tier=None, jasa_utama=None, area=None, status_leads=None, punya_wa=False, skor_min=None, skor_max=None, q=None):
    """Leads that meet all given filters; a text is looked for in name, address and category, A-Z in either case."""
    for c, v in (("tier", tier), ("jasa_utama", jasa_utama), ("area_pencarian", area), ("status_leads", status_leads)):
        rows = rows.where(F.col(c) == v) if v else rows
    score = F.coalesce("skor_pembeli", F.lit(0))
    rows = rows.where(F.coalesce("whatsapp_link", F.lit("")) != "") if punya_wa else rows
    rows = rows.where(score >= skor_min) if skor_min is not None else rows
    rows = rows.where(score <= skor_max) if skor_max is not None else rows
    if q:
        pattern = "%" + q.replace("\\", "\\\\") + "%"
        rows = rows.where(F.ilike("nama_bisnis", F.lit(pattern)) | F.ilike("alamat", F.lit(pattern)) | F.ilike("kategori", F.lit(pattern)))
    return rows


def lead_page(rows, urut="skor_pembeli", limit=50, last=None, **filters):
    """(page, last row's order values): the next leads behind `last`, in one of five orders; unknown orders are by score.

    The values are those to hand in for the following page; None ends it. All matches: lead_filter(...).count().
    """
    urut = urut if urut in SORTS else "skor_pembeli"
    found = lead_filter(rows, **filters)
    found = found.withColumn("_urut", F.coalesce(COLUMN[urut], F.lit(0))) if urut in COLUMN else found
    got = kept(page(found, SORTS[urut], limit, last))
    ends = got.orderBy(*(F.col(c).desc() if up else F.col(c).asc() for c, up in SORTS[urut])).select(*(c for c, _ in SORTS[urut])).first()
    return got.drop("_urut"), tuple(ends) if ends else None


def second_cards(cards):
    """The cards as a later run sees them: every third has another phone, every fifth no website."""
    phone = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("0819"), F.lpad(F.col("seq").cast("string"), 7, "0"))).otherwise(F.col("telepon"))
    return cards.withColumns({"telepon": phone, "website": F.when(F.col("seq") % 5 == 0, "-").otherwise(F.col("website"))})


def two_runs(spark, d):
    """(businesses after both runs, path of the log)."""
    at = f"{checkpoint_folder(spark)}/changes-{uuid.uuid4().hex}"
    cards, stored = kept(ledger.keyed_cards(spark, d)), view(spark, d, "businesses")
    for time, seen in ((FIRST_RUN, cards), (SECOND_RUN, second_cards(cards))):
        stored, changes = history.refreshed(stored, seen, time)
        history.appended(changes, time, at)
        stored = kept(stored)
    return stored, at


TIME = "yyyy-MM-dd HH:mm:ss"


def q_log(spark, d):
    """The change log of two runs."""
    log = history.log(spark, two_runs(spark, d)[1])
    return log.select("place_key", "field", "lama", "baru", F.date_format("changed_at", TIME).alias("changed_at"))


def q_checked(spark, d):
    """Contacts and checked time of every business after two runs."""
    return two_runs(spark, d)[0].select("place_key", "telepon", "website", "email", "last_checked_at")


def q_detail(spark, d):
    """Each business with its latest 20 changes by time, one text."""
    stored, at = two_runs(spark, d)
    x = history.detail(stored, history.log(spark, at))
    text = F.array_join(F.transform("riwayat", lambda r: F.concat(F.date_format(r["changed_at"], TIME), F.lit(" "), r["field"], F.lit(" "), r["baru"])), "; ")
    return x.select("place_key", "nama_bisnis", F.size("riwayat").cast("long").alias("n"), text.alias("riwayat"))


def q_latest(spark, d):
    """The latest 50 changes of all by time."""
    x = history.latest(history.log(spark, two_runs(spark, d)[1]), 50)
    return x.select(F.col("n").cast("long").alias("n"), "place_key", "field", "baru", F.date_format("changed_at", TIME).alias("changed_at"))


def q_changed(spark, d):
    """Businesses that changed in the 30 days before the time of the report."""
    return history.changed_in(history.log(spark, two_runs(spark, d)[1]))


def q_buckets(spark, d):
    """Businesses in buckets after an upsert of all cards: the same rows as the upsert of the whole table."""
    at = f"{checkpoint_folder(spark)}/businesses-{uuid.uuid4().hex}"
    buckets.create(view(spark, d, "businesses"), at, "place_key")
    cards = ledger.keyed_cards(spark, d).select("place_key", "seq", "nama_bisnis", "alamat", "telepon", "website", "rating", "jumlah_ulasan")
    buckets.upserted(spark, at, cards, "place_key", ["seq"], keep=ledger.USER_OWNED)
    out = buckets.read(spark, at)
    return out.select("place_key", "nama_bisnis", "alamat", "telepon", "website", "rating", F.col("jumlah_ulasan").cast("long").alias("jumlah_ulasan"), "status_leads", "last_scraped_at", "times_seen")


def q_ranked(spark, d):
    """All leads by score with their place, numbered without one task."""
    rows = view(spark, d, "businesses").select("place_key", F.coalesce("skor_pembeli", F.lit(0)).cast("long").alias("skor"))
    return numbered(rows, [F.desc("skor"), "place_key"])


def q_third_page(spark, d):
    """Third page of the leads with a chat link in the order of reviews, each page behind the last row of the one before."""
    rows, last = view(spark, d, "businesses"), None
    for _ in range(3):
        found, last = lead_page(rows, "ulasan", 20, last, punya_wa=True, skor_min=20, q="BISNIS")
    return found.select("place_key", F.col("jumlah_ulasan").cast("long").alias("jumlah_ulasan"))


LOG = f"""{CHANGES},
b1 AS (SELECT b.place_key, b.nama_bisnis, coalesce(t.baru, b.telepon) AS telepon, coalesce(w.baru, b.website) AS website, coalesce(e.baru, b.email) AS email,
  CASE WHEN f.place_key IS NULL THEN b.last_checked_at ELSE '{SECOND_RUN}' END AS last_checked_at
  FROM v_businesses b LEFT JOIN (SELECT * FROM cg WHERE field = 'telepon') t USING (place_key) LEFT JOIN (SELECT * FROM cg WHERE field = 'website') w USING (place_key) LEFT JOIN (SELECT * FROM cg WHERE field = 'email') e USING (place_key) LEFT JOIN fc f USING (place_key)),
f2 AS (SELECT place_key, CASE WHEN seq % 3 = 0 THEN concat('0819', lpad(cast(seq AS VARCHAR), 7, '0')) ELSE telepon END AS telepon, CASE WHEN seq % 5 = 0 THEN '-' ELSE website END AS website, email FROM fc),
c2 AS (SELECT b.place_key, 'telepon' AS field, trim(coalesce(b.telepon, '')) AS lama, trim(f.telepon) AS baru FROM f2 f JOIN b1 b USING (place_key)
  UNION ALL SELECT b.place_key, 'website', trim(coalesce(b.website, '')), trim(f.website) FROM f2 f JOIN b1 b USING (place_key)
  UNION ALL SELECT b.place_key, 'email', trim(coalesce(b.email, '')), trim(f.email) FROM f2 f JOIN b1 b USING (place_key)),
g2 AS (SELECT * FROM c2 WHERE baru IS NOT NULL AND baru NOT IN ('', '-', 'n/a') AND baru <> lama),
lg AS (SELECT *, '{FIRST_RUN}' AS changed_at FROM cg UNION ALL SELECT *, '{SECOND_RUN}' FROM g2)"""


def build():
    V = ("listings", "businesses")
    latest = "row_number() OVER ({} ORDER BY changed_at DESC, place_key, field, baru)"
    return {
        "cdc1_change_log": (q_log, with_views(f"WITH {LOG} SELECT place_key, field, lama, baru, changed_at FROM lg", *V)),
        "cdc1_checked_times": (q_checked, with_views(f"WITH {LOG} SELECT b.place_key, coalesce(t.baru, b.telepon) AS telepon, coalesce(w.baru, b.website) AS website, coalesce(e.baru, b.email) AS email, last_checked_at FROM b1 b LEFT JOIN (SELECT * FROM g2 WHERE field = 'telepon') t USING (place_key) LEFT JOIN (SELECT * FROM g2 WHERE field = 'website') w USING (place_key) LEFT JOIN (SELECT * FROM g2 WHERE field = 'email') e USING (place_key)", *V)),
        "qry2_latest_changes_by_time": (q_detail, with_views(f"WITH {LOG}, n AS (SELECT *, {latest.format('PARTITION BY place_key')} AS n FROM lg) SELECT b.place_key, b.nama_bisnis, count(n.n) AS n, coalesce(string_agg(concat(changed_at, ' ', field, ' ', baru), '; ' ORDER BY n.n) FILTER (WHERE n.n IS NOT NULL), '') AS riwayat FROM v_businesses b LEFT JOIN (SELECT * FROM n WHERE n <= 20) n USING (place_key) GROUP BY ALL", *V)),
        "win2_latest_changes_by_time": (q_latest, with_views(f"WITH {LOG}, n AS (SELECT *, {latest.format('')} AS n FROM lg) SELECT n, place_key, field, baru, changed_at FROM n WHERE n <= 50", *V)),
        "agg1_changed_in_30_days": (q_changed, with_views(f"WITH {LOG} SELECT count(DISTINCT place_key) AS n FROM lg WHERE changed_at >= '2023-12-16 00:00:00'", *V)),
        "ups1_bucket_upsert": (q_buckets, ledger.build()["ups1_cdc3_upsert"][1]),
        "qry1_ranked_leads": (q_ranked, with_views("SELECT place_key, coalesce(skor_pembeli, 0)::BIGINT AS skor, row_number() OVER (ORDER BY coalesce(skor_pembeli, 0) DESC, place_key) AS urut FROM v_businesses", "businesses")),
        "qry1_third_page": (q_third_page, with_views("SELECT place_key, jumlah_ulasan::BIGINT AS jumlah_ulasan FROM v_businesses WHERE coalesce(whatsapp_link, '') <> '' AND coalesce(skor_pembeli, 0) >= 20 AND (nama_bisnis ILIKE '%bisnis%' OR alamat ILIKE '%bisnis%' OR kategori ILIKE '%bisnis%') ORDER BY coalesce(jumlah_ulasan, 0) DESC, place_key LIMIT 20 OFFSET 40", "businesses")),
    }
