"""Queries read every row of their tables."""

from pyspark.sql import functions as F

from marketlens import registry
from marketlens.operators import pages
from marketlens.sources.tables import table
from marketlens.sources.views import view

DIR = "/root/testdata/sf0.01"
QUERIES = registry.queries()


def test_each_customer_is_a_business(spark):
    n = table(spark, DIR, "customer").count()
    assert n > 700
    b, cards = view(spark, DIR, "businesses"), view(spark, DIR, "listings")
    assert b.count() == b.select("place_key").distinct().count() == n
    assert cards.count() == n
    totals = {r.k: r.n for r in QUERIES["agg1_dashboard"](spark, DIR).where("jenis = 'semua'").collect()}
    assert totals["total"] == n
    met = QUERIES["ded2_joi1_admission"](spark, DIR).where("status <> 'BARU'")
    assert met.select("place_key").distinct().count() == (n + 7) // 8 > 175
    assert QUERIES["ups1_cdc3_upsert"](spark, DIR).where(F.col("status_leads").isNotNull()).count() == b.where("status_leads is not null").count()


def test_each_lineitem_is_a_card(spark):
    n = table(spark, DIR, "lineitem").count()
    values = QUERIES["prs1_2_3_7_card_values"](spark, DIR)
    assert values.count() == n
    cards = QUERIES["prs8_product_cards"](spark, DIR)
    assert cards.where("seq div 10 % 3 <> 0").count() > cards.where("seq div 10 % 3 = 0").count() > 0


def test_every_store_and_feed_row(spark):
    n = view(spark, DIR, "products").count()
    sheet = QUERIES["srt1_sheet_order"](spark, DIR)
    assert sheet.count() == n and sheet.select("store_id").distinct().count() == view(spark, DIR, "products").select("store_id").distinct().count() > 2
    keys = view(spark, DIR, "products").select("product_key").distinct()
    seen = QUERIES["ups2_products"](spark, DIR)
    assert seen.agg(F.sum("times_seen")).first()[0] == keys.count() + table(spark, DIR, "lineitem").count()
    assert seen.where("product_key like '%:baru' and is_own = 9").count() > 0
    before = view(spark, DIR, "businesses").agg(F.sum("times_seen")).first()[0]
    fed = QUERIES["st3_upsert_feed"](spark, DIR)
    assert fed.agg(F.sum("times_seen")).first()[0] == before + table(spark, DIR, "customer").count()


def test_contact_page_gives_the_missing_email(spark):
    a = lambda href, text="x": f'<a class="k" href="{href}">{text}</a>'
    mail = a("mailto:me@shop.id")
    rows = [
        (1, "https://a.id/", a("https://b.id/contact") + a("/contact#form") + a("/about"), "aktif"),
        (2, "https://a.id/contact", "<p>hi@a.id</p>", "aktif"),
        (3, "https://a.id/about", "late@a.id", "aktif"),
        (4, "https://b.id/contact", "x@b.id " + mail, "aktif"),
        (5, "https://a.id/en/home", a("/x") + a("/y", "<b>Hubungi</b> kami") + a("/about") + a("/contact"), "aktif"),
        (6, "https://a.id", a("contact"), "mati"),
        (7, "https://a.id", a("contact"), "aktif"),
    ]
    got = pages.contact_emails(spark.createDataFrame(rows, "page_id long, url string, html string, web_status string"))
    want = [(1, "hi@a.id", True), (2, "hi@a.id", False), (3, "late@a.id", False), (4, "me@shop.id", False), (5, "late@a.id", True), (6, "", False), (7, "hi@a.id", True)]
    assert sorted(map(tuple, got.collect())) == want
