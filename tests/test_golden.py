"""Worked examples of the parsing, title, scoring, price and matching rules, and invariants of the ledger."""

import pytest
from pyspark.sql import functions as F

from marketlens.functions import parse as P
from marketlens.functions import scoring as S
from marketlens.functions import titles as L
from marketlens.operators import ledger, matching, pages, pricing


def one(spark, column, **values):
    frame = spark.range(1)
    for k, v in values.items():
        frame = frame.withColumn(k, F.lit(v))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,want", [("Rp 6.500.000", [6500000]), ("Rp10.000 - Rp25.000", [10000, 25000]), ("Rp1", []), (None, [])])
def test_prices(spark, text, want):
    assert one(spark, P.prices(F.lit(text).cast("string"))) == want


@pytest.mark.parametrize("text,want", [("120 terjual", 120), ("1,2rb terjual", 1200), ("1.200 terjual", 1200), ("Terjual 50", 50), ("3 jt terjual", 3000000), ("", 0)])
def test_sold(spark, text, want):
    assert one(spark, P.sold(F.lit(text))) == want


@pytest.mark.parametrize("text,want", [("08123", "628123"), ("+628123", "628123"), ("8123", "628123"), ("(021) 788", "6221788"), ("", "")])
def test_phone(spark, text, want):
    assert one(spark, P.phone_number(F.lit(text))) == want


def test_money_and_ratings(spark):
    assert one(spark, P.money(F.lit(6500000))) == "Rp 6.500.000" and one(spark, P.money(F.lit(0))) == "-"
    for text, want in (("4,7(1.234)", (4.7, 1234)), ("5,0", (5.0, None)), ("x", (None, None))):
        assert tuple(one(spark, c) for c in P.card_rating(F.lit(text))) == want


def test_card_lines(spark):
    text = "Usaha\n4,7(12)\nBengkel Mobil · Jl. Raya Sawangan Blk. K No.kav.286\nTutup · Buka Jum pukul 09.00 · 0813-1899-8477"
    assert one(spark, P.card_phone(F.lit(text))) == "0813-1899-8477"
    assert one(spark, P.card_category(F.lit(text))) == "Bengkel Mobil"


def test_hosts(spark):
    assert not one(spark, S.social_url(F.lit("https://phoenixdental.com/a"))) and one(spark, S.social_url(F.lit("www.x.com")))
    assert one(spark, S.bare_host(F.lit("https://WWW.Example.com.:80/x"))) == "example.com"


def test_latest_year(spark):
    assert one(spark, pages.latest_year(F.lit("© 2001-2026 Toko"), 2026)) == 2026
    assert one(spark, pages.latest_year(F.lit("footer 2019"), 2026)) == 2019


def test_titles(spark):
    t = L.tokens(F.lit("PROMO! Intel Core i7-12700K Gen 12 DDR 4 8 GB"))
    assert one(spark, t) == ["promo", "intel", "i7", "12700k", "gen12", "ddr4", "8gb"]
    for token, want in (("8gb", ("gb", "8")), ("ddr4", ("ddr", "4")), ("i7", ("iseri", "7")), ("1tb", ("gb", "1000"))):
        assert tuple(one(spark, c) for c in L.spec_pair(F.lit(token))) == want
    for token, want in (("12700k", "127xx"), ("3060ti", "306x"), ("240", "24x")):
        assert one(spark, L.family(F.lit(token))) == want


@pytest.mark.parametrize("title,want", [
    ("\uff18\uff27\uff22", ["8gb"]), ("\U0001f525PROMO\U0001f525", ["promo"]), ("\u00bd kg \ufb01lter", ["1\u20442kg", "filter"]), ("caf\u00e9 \u216b", ["cafe\u0301", "xii"]),
    ("12 th Generation", ["gen12"]), ("gen 12th", ["gen12"]), ("Intel 7 gen 12", ["intel", "i7", "gen12"]), ("core i 7 8 gb", ["i7", "8gb"]), ("DDR 4 GB", ["ddr", "4gb"]), ("ddr4 gb", ["ddr4", "gb"]),
    ("RTX 3060 Ti", ["rtx", "3060ti"]), ("PC 3200 super", ["pc3200", "super"]), ("i 7 gb", ["i7", "gb"]), ("generasi 12", ["gen12"]), ("a " + "x" * 25 + " 5", ["5"]), (None, []), ("", []), ("?!", []),
])
def test_title_forms(spark, title, want):
    assert one(spark, L.tokens(F.lit(title).cast("string"))) == want


def test_title_words_by_sql(spark):
    """The pass over joints and the SQL's fold over words agree on mixed titles."""
    import random

    import duckdb
    import pandas as pd

    words, rng = "intel core i 7 8 12 gen 12th gb w ddr pcie usb generasi pc 3060 5600 ti super i7 ryzen 5 - | mm ram nvme".split(), random.Random(5)
    titles = {" ".join(w for i, w in enumerate(rng.choices(words, k=6)) if w != "12th" or i == 2) for _ in range(2000)}
    titles = pd.DataFrame({"t": sorted(t for t in titles if t.count("gen") < 2)})
    ours = {r["t"]: r["n"] for r in spark.createDataFrame(titles).select("t", L.tokens(F.col("t")).alias("n")).collect()}
    assert dict(duckdb.sql(f"SELECT t, {L.tokens_sql('t')} FROM titles").fetchall()) == ours


def test_trim_and_grid(spark):
    p = spark.createDataFrame([("a", h) for h in (35000, 4700000, 4750000, 4800000, 24500000)] + [("b", 10), ("b", 90000)], "g string, harga long")
    kept = pricing.trimmed(p, "g").where("dipakai").orderBy("g", "harga")
    assert [tuple(r) for r in kept.select("g", "harga").collect()] == [("a", 4700000), ("a", 4750000), ("a", 4800000), ("b", 10), ("b", 90000)]
    assert one(spark, pricing.rounded(F.lit(4737412))) == 4735000 and one(spark, pricing.rounded(F.lit(1234), "up")) == 1500
    assert one(spark, pricing.least_price(F.lit(1000), margin=0.5, fee=60.0)) == 0


def test_matching(spark):
    titles = ["Intel Core i7-12700K Gen 12", "Processor Intel I7 12700KF", "Intel Core i7 12700F Gen 12", "Intel Core i5 12400F", "RAM DDR4 16GB Corsair", "RAM DDR 4 8 GB Corsair", "SSD Sandisk 1TB", "SSD Sandisk 500GB"] * 3
    p = spark.createDataFrame([(f"p{i}", f"s{i % 3}", t, 1000 + i) for i, t in enumerate(titles)], "product_key string, store_id string, nama_produk string, harga long")
    rows = matching.search(spark, matching.QUERIES, p).collect()
    found = {q: {r["nama_produk"] for r in rows if r["query_id"] == q} for q in range(5)}
    assert found[0] == {titles[0], titles[1], titles[2]}
    assert found[1] == {"RAM DDR 4 8 GB Corsair"} and found[2] == {"SSD Sandisk 1TB"} and not found[4]


def test_title_similarity():
    assert matching.title_similarity(["ram", "8gb"], ["ram", "16gb"]) < 0.5 < matching.title_similarity(["kabel", "merah"], ["kabel", "merah"])


def test_upsert_twice(spark):
    now = spark.createDataFrame([("a", "x", "u", "2023", 1)], "place_key string, telepon string, status_leads string, last_scraped_at string, times_seen int")
    feed = spark.createDataFrame([("a", 1, None, "new"), ("b", 1, "1", None), ("b", 2, None, None), ("", 3, "9", None)], "place_key string, seq int, telepon string, status_leads string")
    once = ledger.upsert(now, feed, "place_key", ["seq"], keep=("status_leads",))
    twice = ledger.upsert(once, feed, "place_key", ["seq"], keep=("status_leads",))
    get = lambda df: {r["place_key"]: r for r in df.collect()}
    a, b = get(once), get(twice)
    assert set(a) == {"a", "b"} and a["a"]["telepon"] == "x" and a["a"]["status_leads"] == "u" and a["b"]["telepon"] == "1"
    assert all(a[k][c] == b[k][c] for k in a for c in ("telepon", "status_leads")) and b["b"]["times_seen"] == 4


def test_history_has_no_equal_neighbours(spark):
    o = spark.createDataFrame([("p", i, h, t) for i, (h, t) in enumerate([(1, 0), (1, 0), (0, 5), (1, 0), (2, 0), (2, None), (1, 1)])], "product_key string, seq int, harga long, terjual long")
    assert [(r["harga"], r["terjual"]) for r in ledger.price_history(o).orderBy("seq").collect()] == [(1, 0), (2, 0), (1, 1)]


def test_reasons_add_up_to_the_score(spark):
    from marketlens.functions import fixed as X
    from marketlens.operators.leads import YEAR
    from marketlens.sources.views import view

    d = "/root/testdata/sf0.001"
    rows = S.score_details(S.score_leads(view(spark, d, "listings"), view(spark, d, "businesses"), YEAR)).select("s_tutup", "skor_pembeli", "rincian").collect()
    need, _, reach = ({reason for reason, _ in part} for part in X.SCORE_REASONS)
    for closed, score, reasons in rows:
        part = lambda names: sum(v for k, v in reasons.items() if k in names)  # noqa: E731, B023
        means = part(set(reasons) - need - reach)
        want = min(40, part(need)) + max(0, min(35, means)) + min(25, part(reach))
        assert reasons == {"tutup permanen": 0.0} and score == 0 if closed else abs(score - want) <= 0.56
    assert len(rows) > 100
