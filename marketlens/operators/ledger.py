"""Deduplication, change capture, upserts and price history as DataFrame jobs.

A job never overwrites the path it reads: it returns the new state, which the caller writes to
a new path. Every observation order is total (time or sequence, then a key).
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.functions import parse as P
from marketlens.functions.ranks import numbered
from marketlens.operators.greedy import admitted
from marketlens.operators.keys import PLACE_KEY_SQL
from marketlens.sources.tables import table
from marketlens.sources.views import view, with_views

MONTH = 30.44
USER_OWNED = ("status_leads", "tanggal_follow_up")


def first_per_key(rows, key, order):
    """The first row of each key; rows without key are all kept."""
    blank = F.coalesce(F.col(key).cast("string"), F.lit("")) == ""
    w = Window.partitionBy(key).orderBy(*order)
    kept = rows.where(~blank).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return kept.unionByName(rows.where(blank))


def admission(cards, businesses, months=6, as_of=X.AS_OF):
    """BARU, LAMA_SEGAR or LAMA_KEDALUWARSA for every card."""
    stored = businesses.select("place_key", F.lit(True).alias("ada"), "last_scraped_at")
    limit = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(months * MONTH)} DAYS")
    seen = P.timestamp(F.col("last_scraped_at"))
    state = F.when(F.col("ada").isNull(), "BARU").when(seen.isNull() | (seen < limit), "LAMA_KEDALUWARSA").otherwise("LAMA_SEGAR")
    return cards.join(stored, "place_key", "left").withColumn("status", state).drop("ada", "last_scraped_at")


def keyed_cards(spark, d):
    v = view(spark, d, "listings")
    return v.withColumn("place_key", P.place_key(F.col("href"), F.col("nama_bisnis"), F.col("alamat"), F.col("telepon")))


def contact_changes(cards, businesses, fields=("telepon", "website", "email")):
    """(place_key, field, lama, baru): new non-blank values that differ from the stored ones."""
    new = first_per_key(cards.where("place_key <> ''"), "place_key", ["seq"]).select("place_key", *(F.col(f).alias(f"n_{f}") for f in fields))
    both = new.join(businesses.select("place_key", *fields), "place_key")
    rows = both.select("place_key", F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.trim(F.coalesce(f, F.lit(""))).alias("lama"), F.trim(F.col(f"n_{f}")).alias("baru")) for f in fields))))
    return rows.where("baru is not null and baru not in ('', '-', 'n/a') and baru <> lama")


def upsert(current, feed, key, order, keep=(), first=(), now=X.AS_OF):
    """The current table after a feed: nulls overwrite nothing, blanks do; kept columns stay as stored.

    Many observations of a key are folded first to the last non-null value of each column.
    """
    columns = [c for c in feed.columns if c != key and c in current.columns]
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    folded = feed.where(F.coalesce(F.col(key), F.lit("")) != "").select(key, *(F.last(c, ignorenulls=True).over(w).alias(c) for c in columns), F.count("*").over(w).alias("_seen"), F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("_n"))
    new = folded.where("_n = 1").select(key, *(F.col(c).alias(f"_{c}") for c in columns), "_seen")
    both = current.join(new, key, "full_outer")
    stored = lambda c: c in keep or c in first
    out = [F.col(c) if c not in columns else (F.coalesce(c, f"_{c}") if stored(c) else F.coalesce(f"_{c}", c)).alias(c) for c in current.columns if c not in (key, "times_seen", "last_scraped_at")]
    seen = (F.coalesce("times_seen", F.lit(0)) + F.coalesce("_seen", F.lit(0))).cast("long").alias("times_seen")
    return both.select(key, *out, F.when(F.col("_seen").isNotNull(), F.lit(now)).otherwise(F.col("last_scraped_at")).alias("last_scraped_at"), seen)


def price_history(observations):
    """Observations whose price or sold count differs from the last recorded one of the product."""
    valid = observations.where("coalesce(harga, 0) <> 0").withColumn("terjual", F.coalesce("terjual", F.lit(0)))
    w = Window.partitionBy("product_key").orderBy("seq", "harga", "terjual")
    before = F.lag(F.struct("harga", "terjual")).over(w)
    return valid.withColumn("_b", before).where("_b is null or _b.harga <> harga or _b.terjual <> terjual").drop("_b")


def q_ded1(spark, d):
    v = view(spark, d, "listings").withColumn("kunci", F.when(F.col("seq") % 10 == 0, "").otherwise(F.col("nama_bisnis")))
    return first_per_key(v.select("seq", "kunci"), "kunci", ["seq"])


def q_ded2(spark, d):
    return admission(keyed_cards(spark, d).select("seq", "place_key"), view(spark, d, "businesses"))


def q_ded3(spark, d):
    v = view(spark, d, "businesses")
    at = F.coalesce(P.timestamp(F.col("last_checked_at")), P.timestamp(F.col("last_scraped_at")))
    age = F.floor((F.unix_timestamp(F.lit(X.AS_OF).cast("timestamp")) - F.unix_timestamp(at)) / 86400)
    return v.select("place_key", age.cast("long").alias("umur"), F.coalesce(age >= 30, F.lit(True)).alias("perlu"))


def q_ded5(spark, d):
    e = table(spark, d, "events")
    return admitted(e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id"))


def q_cdc1(spark, d):
    return contact_changes(keyed_cards(spark, d), view(spark, d, "businesses"))


def q_cdc2(spark, d):
    """One text per business and whether the website changed."""
    c = q_cdc1(spark, d)
    one = F.array_sort(F.collect_list(F.struct("field", F.concat("field", F.lit(": "), "lama", F.lit(" → "), "baru").alias("t"))))
    return c.groupBy("place_key").agg(F.array_join(F.transform(one, lambda x: x["t"]), "; ").alias("perubahan"), F.bool_or(F.col("field") == "website").alias("situs_berubah"))


def q_ups1(spark, d):
    """Businesses after upserting the listings of a run; user columns stay."""
    cards = keyed_cards(spark, d).select("place_key", "seq", "nama_bisnis", "alamat", "telepon", "website", "rating", "jumlah_ulasan")
    out = upsert(view(spark, d, "businesses"), cards, "place_key", ["seq"], keep=USER_OWNED)
    return out.select("place_key", "nama_bisnis", "alamat", "telepon", "website", "rating", F.col("jumlah_ulasan").cast("long").alias("jumlah_ulasan"), "status_leads", "last_scraped_at", "times_seen")


def q_joi2(spark, d):
    """Cards with stored values where the run has none."""
    b = view(spark, d, "businesses").select("place_key", F.col("telepon").alias("t"), F.col("alamat").alias("a"), F.col("website").alias("w"))
    keep = lambda n, o: F.coalesce(F.nullif(F.col(n), F.lit("")), F.nullif(F.col(o), F.lit(""))).alias(n)
    return keyed_cards(spark, d).join(b, "place_key", "left").select("seq", "place_key", keep("telepon", "t"), keep("alamat", "a"), keep("website", "w"))


def q_snp1(spark, d):
    return price_history(view(spark, d, "price_obs")).select("product_key", "seq", "harga", "terjual")


def q_srp1(spark, d):
    """Per run and store, only rows of the best source that gave any."""
    v = view(spark, d, "price_obs")
    rank = F.when(F.col("sumber") == "api", 1).when(F.col("sumber") == "dom_anchor", 2).otherwise(3)
    best = v.withColumn("tingkat", rank)
    low = best.groupBy("run_id", "store_id").agg(F.min("tingkat").alias("tingkat"))
    return best.join(low, ["run_id", "store_id", "tingkat"]).groupBy("run_id", "store_id", "sumber").agg(F.count("*").alias("n"))


def q_win3(spark, d):
    v = view(spark, d, "price_obs")
    w = Window.partitionBy("product_key").orderBy(F.desc("captured_at"), F.desc("seq"))
    return v.withColumn("n", F.row_number().over(w)).where("n <= 60").select("product_key", "seq", "n")


def q_searches(spark, d):
    """Latest three runs per source and store, with their counters."""
    v = view(spark, d, "price_obs").groupBy("run_id", "store_id").agg(F.count("*").alias("ditemukan"), F.count_if(F.expr("coalesce(harga, 0) <> 0")).alias("baru"), F.max("seq").alias("terakhir"))
    w = Window.partitionBy("store_id").orderBy(F.desc("terakhir"), "run_id")
    return v.withColumn("n", F.row_number().over(w)).where("n <= 3")


def q_agg7(spark, d):
    """Rejected cards by reason."""
    v = view(spark, d, "card_text").select("username", "href", "seq", F.size(P.prices(F.col("teks"))).alias("n"), P.product_name(F.col("teks")).alias("nama"))
    v = v.withColumn("k", P.product_key(F.lit("tokopedia"), F.col("username"), F.col("href")))
    r = F.row_number().over(Window.partitionBy("username", "k").orderBy("seq"))
    return v.withColumn("r", r).groupBy("username").agg(F.count_if(F.expr("n = 0")).alias("tanpa_harga"), F.count_if(F.expr("n > 0 and nama = ''")).alias("tanpa_nama"), F.count_if(F.expr("r > 1")).alias("ganda"))


def q_joi4(spark, d):
    """Every store of a platform with its product count and whether it sells 12700K."""
    s, p = view(spark, d, "stores"), view(spark, d, "products")
    n = p.groupBy("store_id").agg(F.count("*").alias("n"), F.bool_or(F.lower("nama_produk").contains("12700k")).alias("jual"))
    return s.where("platform = 'tokopedia'").join(n, s.id == n.store_id, "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("jual", F.lit(False)).alias("jual"))


def q_joi5(spark, d):
    s, p = view(spark, d, "stores"), view(spark, d, "products")
    own = s.select(F.col("id").alias("store_id"), F.col("is_own").alias("milik"))
    return p.join(own, "store_id", "left").select("product_key", F.coalesce("milik", "is_own").cast("int").alias("is_own"))


def q_io1(spark, d):
    p = view(spark, d, "products").where(F.col("store_id").isin("st-1", "st-10", "st-20"))
    return p.orderBy("nama_produk", "product_key").limit(500).select("product_key", "store_id", "nama_produk", F.col("harga").cast("long").alias("harga"))


def q_io2(spark, d):
    """Active stores, own ones first, with their place."""
    rows = view(spark, d, "stores").where("aktif = 1").select("id", "platform", "nama", "is_own")
    return numbered(rows, [F.desc("is_own"), "platform", "nama", "id"]).select("id", "platform", "nama", "urut")


CARDS = f"cards AS (SELECT *, {PLACE_KEY_SQL} AS place_key FROM v_listings)"
FIRST = f"{CARDS}, fc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_key ORDER BY seq) AS rn FROM cards WHERE place_key <> '') WHERE rn = 1)"
CHANGES = f"""{FIRST}, ch AS (
SELECT b.place_key, 'telepon' AS field, trim(coalesce(b.telepon, '')) AS lama, trim(f.telepon) AS baru FROM fc f JOIN v_businesses b USING (place_key)
UNION ALL SELECT b.place_key, 'website', trim(coalesce(b.website, '')), trim(f.website) FROM fc f JOIN v_businesses b USING (place_key)
UNION ALL SELECT b.place_key, 'email', trim(coalesce(b.email, '')), trim(f.email) FROM fc f JOIN v_businesses b USING (place_key)),
cg AS (SELECT * FROM ch WHERE baru IS NOT NULL AND baru NOT IN ('', '-', 'n/a') AND baru <> lama)"""


def build():
    L, B, O, PR, S = "listings", "businesses", "price_obs", "products", "stores"  # noqa: E741
    last = lambda c: f"last({c} ORDER BY seq) FILTER (WHERE {c} IS NOT NULL)"
    return {
        "ded1_first_per_key": (q_ded1, with_views("WITH k AS (SELECT seq, CASE WHEN seq % 10 = 0 THEN '' ELSE nama_bisnis END AS kunci FROM v_listings) SELECT min(seq) AS seq, kunci FROM k WHERE kunci <> '' GROUP BY kunci UNION ALL SELECT seq, kunci FROM k WHERE kunci = ''", L)),
        "ded2_joi1_admission": (q_ded2, with_views(f"WITH {CARDS} SELECT seq, c.place_key, CASE WHEN b.place_key IS NULL THEN 'BARU' WHEN try_cast(last_scraped_at AS TIMESTAMP) IS NULL OR try_cast(last_scraped_at AS TIMESTAMP) < TIMESTAMP '2024-01-15' - INTERVAL 182 DAY THEN 'LAMA_KEDALUWARSA' ELSE 'LAMA_SEGAR' END AS status FROM cards c LEFT JOIN v_businesses b USING (place_key)", L, B)),
        "ded3_refresh_due": (q_ded3, with_views("WITH t AS (SELECT place_key, coalesce(try_cast(last_checked_at AS TIMESTAMP), try_cast(last_scraped_at AS TIMESTAMP)) AS a FROM v_businesses) SELECT place_key, floor((epoch(TIMESTAMP '2024-01-15') - epoch(a)) / 86400)::BIGINT AS umur, coalesce(floor((epoch(TIMESTAMP '2024-01-15') - epoch(a)) / 86400) >= 30, true) AS perlu FROM t", B)),
        "ded5_greedy_admission": (q_ded5, """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch(ts)::BIGINT AS t, row_number() OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT, event_id) AS r FROM events),
g AS (SELECT user_id, event_id, t, r, t AS a, true AS ok FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.t, o.r, CASE WHEN o.t - g.a > 604800 THEN o.t ELSE g.a END, o.t - g.a > 604800 FROM g JOIN o ON o.user_id = g.user_id AND o.r = g.r + 1)
SELECT user_id, event_id FROM g WHERE ok"""),
        "cdc1_contact_changes": (q_cdc1, with_views(f"WITH {CHANGES} SELECT * FROM cg", L, B)),
        "cdc2_change_text": (q_cdc2, with_views(f"WITH {CHANGES} SELECT place_key, string_agg(concat(field, ': ', lama, ' → ', baru), '; ' ORDER BY field) AS perubahan, bool_or(field = 'website') AS situs_berubah FROM cg GROUP BY 1", L, B)),
        "ups1_cdc3_upsert": (q_ups1, with_views(f"""WITH {CARDS}, f AS (SELECT place_key, {', '.join(f'{last(c)} AS {c}' for c in ('nama_bisnis', 'alamat', 'telepon', 'website', 'rating', 'jumlah_ulasan'))}, count(*) AS n FROM cards WHERE place_key <> '' GROUP BY 1)
SELECT coalesce(b.place_key, f.place_key) AS place_key, {', '.join(f'coalesce(f.{c}, b.{c}) AS {c}' for c in ('nama_bisnis', 'alamat', 'telepon', 'website', 'rating'))}, coalesce(f.jumlah_ulasan, b.jumlah_ulasan)::BIGINT AS jumlah_ulasan, b.status_leads,
 CASE WHEN f.n IS NOT NULL THEN '2024-01-15 00:00:00' ELSE b.last_scraped_at END AS last_scraped_at, (coalesce(b.times_seen, 0) + coalesce(f.n, 0))::BIGINT AS times_seen FROM v_businesses b FULL JOIN f ON b.place_key = f.place_key""", L, B)),
        "joi2_3_inherit": (q_joi2, with_views(f"WITH {CARDS} SELECT seq, c.place_key, coalesce(nullif(c.telepon, ''), nullif(b.telepon, '')) AS telepon, coalesce(nullif(c.alamat, ''), nullif(b.alamat, '')) AS alamat, coalesce(nullif(c.website, ''), nullif(b.website, '')) AS website FROM cards c LEFT JOIN v_businesses b USING (place_key)", L, B)),
        "snp1_price_history": (q_snp1, with_views("WITH v AS (SELECT *, coalesce(terjual, 0) AS tj, lag(harga) OVER w AS h0, lag(coalesce(terjual, 0)) OVER w AS t0 FROM v_price_obs WHERE coalesce(harga, 0) <> 0 WINDOW w AS (PARTITION BY product_key ORDER BY seq, harga, coalesce(terjual, 0))) SELECT product_key, seq, harga, tj AS terjual FROM v WHERE h0 IS NULL OR h0 <> harga OR t0 <> tj", O)),
        "srp1_best_source": (q_srp1, with_views("WITH t AS (SELECT *, CASE sumber WHEN 'api' THEN 1 WHEN 'dom_anchor' THEN 2 ELSE 3 END AS r FROM v_price_obs), m AS (SELECT *, min(r) OVER (PARTITION BY run_id, store_id) AS lo FROM t) SELECT run_id, store_id, sumber, count(*) AS n FROM m WHERE r = lo GROUP BY ALL", O)),
        "win3_last_prices": (q_win3, with_views("SELECT product_key, seq, n FROM (SELECT *, row_number() OVER (PARTITION BY product_key ORDER BY captured_at DESC, seq DESC) AS n FROM v_price_obs) WHERE n <= 60", O)),
        "win1_agg4_latest_runs": (q_searches, with_views("WITH g AS (SELECT run_id, store_id, count(*) AS ditemukan, count(*) FILTER (WHERE coalesce(harga, 0) <> 0) AS baru, max(seq) AS terakhir FROM v_price_obs GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY terakhir DESC, run_id) AS n FROM g) WHERE n <= 3", O)),
        "agg7_rejects": (q_agg7, with_views(r"WITH x AS (SELECT *, regexp_matches(teks, 'Rp\s?[0-9]') AS ada, regexp_extract(href, '/(p[0-9]+)[?]', 1) AS p FROM v_card_text), y AS (SELECT *, row_number() OVER (PARTITION BY username, p ORDER BY seq) AS r FROM x) SELECT username, count(*) FILTER (WHERE NOT ada) AS tanpa_harga, 0 AS tanpa_nama, count(*) FILTER (WHERE r > 1) AS ganda FROM y GROUP BY 1", "card_text")),
        "joi4_store_status": (q_joi4, with_views("SELECT id, coalesce(n, 0) AS n, coalesce(jual, false) AS jual FROM v_stores s LEFT JOIN (SELECT store_id, count(*) AS n, bool_or(lower(nama_produk) LIKE '%12700k%') AS jual FROM v_products GROUP BY 1) p ON p.store_id = s.id WHERE platform = 'tokopedia'", S, PR)),
        "joi5_own_flag": (q_joi5, with_views("SELECT product_key, coalesce(s.is_own, p.is_own)::INTEGER AS is_own FROM v_products p LEFT JOIN v_stores s ON s.id = p.store_id", S, PR)),
        "io1_products": (q_io1, with_views("SELECT product_key, store_id, nama_produk, harga::BIGINT AS harga FROM v_products WHERE store_id IN ('st-1', 'st-10', 'st-20') ORDER BY nama_produk, product_key LIMIT 500", PR)),
        "io2_stores": (q_io2, with_views("SELECT id, platform, nama, row_number() OVER (ORDER BY is_own DESC, platform, nama, id) AS urut FROM v_stores WHERE aktif = 1", S)),
    }
