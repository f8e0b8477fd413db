"""Captured records (shop JSON, model answers, profiles, shelves), their sinks, and the remaining joins and upserts."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.functions import parse as P
from marketlens.functions import titles as L
from marketlens.functions.frames import kept
from marketlens.operators import ledger, matching, pricing
from marketlens.operators import lexicon as LX
from marketlens.operators.keys import PLACE_KEY_SQL
from marketlens.operators.ledger import CHANGES
from marketlens.sources.tables import table
from marketlens.sources.views import view, with_views
from marketlens.streaming.jobs import folder

ITEM = "itemid long, shopid long, name string, price long, price_before_discount long, historical_sold long, sold long, item_rating struct<rating_star: double>"
SHOP = f"items array<struct<item_basic: struct<{ITEM.replace(' struct', ': struct').replace(' long', ': long').replace(' string', ': string')}>, item_card: struct<item_data: struct<{ITEM.replace(' struct', ': struct').replace(' long', ': long').replace(' string', ': string')}>>, {ITEM.replace(' struct', ': struct').replace(' long', ': long').replace(' string', ': string')}>>"
SCALE = 100_000
PSEUDO = ("sold", "preorder", "all-products", "all-etalase")

# Which words of a shelf or query name which category.
CATEGORY = {
    "processor": "processor prosesor cpu intel amd ryzen core i3 i5 i7 i9".split(), "memory": "ram memory memori ddr4 ddr5 sodimm".split(), "storage": "ssd hdd hardisk nvme sata".split(),
    "vga": "vga gpu rtx gtx geforce radeon".split(), "monitor": ["monitor"], "casing": ["casing", "case"],
}
BUNDLE = r"\b(rakitan|paket|bundling|bundle|komplit|simulator)\b"
SHELVES = ["PROCESSOR INTEL", "PROCESSOR AMD", "MEMORY PC AND LAPTOP", "SSD SATA", "VGA NVIDIA GEFORCE", "MONITOR", "CASING", "RAKITAN I7 GEN12", "- - VGA AMD", "MOTHERBOARD INTEL", "RAM DDR4", "KIPAS"]


def shop_items(json, shop_id):
    """Product records from shop JSON in three shapes; prices come in 1/100000 units."""
    x = F.explode(F.from_json(json, SHOP)["items"])
    return lambda rows: rows.select(shop_id.alias("shop"), x.alias("r")).select("shop", F.coalesce("r.item_basic", "r.item_card.item_data", F.struct(*(F.col(f"r.{n.split()[0]}") for n in ITEM.split(", ")))).alias("d")).where("d.itemid is not null").select(
        F.concat_ws(":", F.lit("shp"), F.coalesce("d.shopid", "shop").cast("string"), F.col("d.itemid").cast("string")).alias("product_key"), F.trim("d.name").alias("nama_produk"),
        F.floor(F.coalesce("d.price", F.lit(0)) / SCALE).cast("long").alias("harga"), F.when(F.floor(F.col("d.price_before_discount") / SCALE) > F.floor(F.col("d.price") / SCALE), F.floor(F.col("d.price_before_discount") / SCALE)).otherwise(0).cast("long").alias("harga_coret"),
        F.coalesce(F.nullif("d.historical_sold", F.lit(0)), F.col("d.sold"), F.lit(0)).alias("terjual"), F.bround(F.coalesce("d.item_rating.rating_star", F.lit(0.0)), 2).alias("rating"))


def answer_items(text, most=50):
    """Objects of a model's answer: fences stripped, first [ to last ], trailing commas dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?m)^```(?:json)?\s*", ""), r"```\s*$", "")
    array = F.regexp_replace(F.regexp_extract(bare, r"(?s)(\[.*\])", 1), r",\s*([}\]])", "$1")
    return F.slice(F.filter(F.from_json(array, "array<map<string,string>>"), lambda m: m.isNotNull()), 1, most)


def preferred(columns, first, hidden=("place_key",)):
    """Preferred columns, then the rest without hidden and underscored ones."""
    return [c for c in first if c in columns] + [c for c in columns if c not in first and c not in hidden and not c.startswith("_")]


def captured_shop_json(spark, d):
    """Shop answers made of stored products: one document per hundred products, with items in all three shapes."""
    p = table(spark, d, "part").join(table(spark, d, "lineitem").groupBy("l_partkey").agg(F.sum("l_quantity").cast("long").alias("sold")), F.col("p_partkey") == F.col("l_partkey"))
    item = F.struct(F.col("p_partkey").alias("itemid"), (F.col("p_partkey") % 50).alias("shopid"), F.concat(F.lit(" "), "p_name").alias("name"), ((F.col("p_partkey") % 900 + 10) * 1000 * SCALE + 7).alias("price"), ((F.col("p_partkey") % 7) * 200_000 * SCALE).cast("long").alias("price_before_discount"), F.when(F.col("p_partkey") % 2 == 0, F.col("sold")).alias("historical_sold"), F.col("sold").alias("sold"), F.struct((F.col("p_partkey") % 50 / 10.0).cast("double").alias("rating_star")).alias("item_rating"))
    shape = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.struct(item.alias("item_basic")))).when(F.col("p_partkey") % 3 == 1, F.to_json(F.struct(F.struct(item.alias("item_data")).alias("item_card")))).otherwise(F.to_json(item))
    return p.select(F.floor(F.col("p_partkey") / 100).alias("shop"), shape.alias("j")).groupBy("shop").agg(F.concat(F.lit('{"items": ['), F.array_join(F.collect_list("j"), ", "), F.lit("]}")).alias("json"))


def q_shop_json(spark, d):
    return shop_items(F.col("json"), F.col("shop"))(captured_shop_json(spark, d))


def q_text_price_json(spark, d):
    """The second marketplace's items: price as text, nested pictures and counters."""
    p = table(spark, d, "part")
    text = F.to_json(F.struct(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.struct(P.money(F.col("p_partkey") * 1000).alias("text_idr")).alias("price"), F.struct((F.col("p_partkey") % 9).alias("countReview")).alias("stats"), F.concat(F.lit("https://t.example/"), "p_partkey").alias("product_url")))
    x = p.select(F.from_json(text, "product_id long, name string, price struct<text_idr: string>, stats struct<countReview: long>, product_url string").alias("d"))
    return x.select(F.concat(F.lit("tkp:9:"), "d.product_id").alias("product_key"), F.trim("d.name").alias("nama_produk"), F.col("d.product_url").alias("url"), P.digits(F.col("d.price.text_idr")).try_cast("long").alias("harga"), F.col("d.stats.countReview").alias("jumlah_ulasan"))


def q_answers(spark, d):
    """Leads repaired from answers that were made of stored listings, some not JSON at all."""
    v = view(spark, d, "listings").where("telepon is not null").select(F.floor(F.col("seq") / 10).alias("jawaban"), "seq", "nama_bisnis", "telepon")
    one = F.concat(F.lit('{"nama": "'), "nama_bisnis", F.lit('", "telepon": "'), "telepon", F.lit('",}'))
    text = v.groupBy("jawaban").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", one.alias("j")))), lambda x: x["j"]), ",\n").alias("t"))
    text = text.select("jawaban", F.when(F.col("jawaban") % 5 == 0, "maaf, tidak ada data").otherwise(F.concat(F.lit("```json\nBerikut:\n["), "t", F.lit(",]\n```"))).alias("teks"))
    return text.select("jawaban", F.posexplode(answer_items(F.col("teks"))).alias("n", "m")).select("jawaban", "n", F.col("m")["nama"].alias("nama"), F.col("m")["telepon"].alias("telepon"))


def q_regions(spark, d):
    """A nested region library flattened to two levels with search text."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    lib = r.join(n, r.r_regionkey == n.n_regionkey).groupBy("r_name").agg(F.collect_list(F.struct(F.col("n_name").alias("n"), F.col("n_nationkey").alias("k"))).alias("wilayah"))
    flat = lib.select("r_name", F.explode("wilayah").alias("w")).select(F.col("r_name").alias("provinsi"), F.col("w.n").alias("wilayah"), F.col("w.k").alias("kode"))
    flat = flat.unionByName(lib.select(F.col("r_name").alias("provinsi"), F.lit(None).cast("string").alias("wilayah"), F.lit(None).cast("long").alias("kode")))
    return flat.withColumn("cari", F.lower(F.concat_ws(" ", "wilayah", "provinsi")))


def q_sink(spark, d):
    """Leads written in preferred column order by area and read back."""
    b = view(spark, d, "businesses")
    at = f"{folder(spark)}/leads"
    b.select(*preferred(b.columns, ["nama_bisnis", "telepon", "tier", "skor_pembeli"])).write.partitionBy("area_pencarian").parquet(at)
    return spark.read.parquet(at).groupBy("area_pencarian").agg(F.count("*").alias("n"), F.sum("skor_pembeli").alias("skor"))


def q_card_ingest(spark, d):
    """Captured cards with the first of each href and their parsed fields."""
    v = view(spark, d, "listings").select("seq", F.when(F.col("seq") % 3 == 0, F.col("href")).otherwise(F.concat(F.lit("h"), F.col("seq") % 500)).alias("href"), "nama_bisnis")
    return ledger.first_per_key(v, "href", ["seq"])


def q_profile_signals(spark, d):
    """Claimed, closed, photo and price-range signals from a listing's text."""
    v = view(spark, d, "listings")
    text = F.concat_ws("\n", "nama_bisnis", F.when(~F.col("sudah_diklaim"), "Klaim bisnis ini"), "status_buka", F.when(F.col("jumlah_foto") == 0, "Tambahkan foto"), "rentang_harga")
    low = F.lower(text)
    closed = F.coalesce(*(F.when(F.contains(low, F.lit(t)), F.initcap(F.lit(t))) for t in X.CLOSED), F.lit(""))
    price = F.regexp_extract(text, r"(?m)^((?:Rp){1,4}|\${1,4})$", 1)
    return v.select("seq", (~P.contains_any(low, ("klaim bisnis", "claim this business"))).alias("diklaim"), closed.alias("status"), P.contains_any(low, ("tambahkan foto", "add a photo")).alias("tanpa_foto"), price.alias("harga"))


def q_profiles(spark, d):
    """Name, role, company and place from profile titles and snippets."""
    c = table(spark, d, "customer")
    title = F.concat("c_name", F.when(F.col("c_custkey") % 3 > 0, " - Manager").otherwise(""), F.when(F.col("c_custkey") % 3 > 1, F.concat(F.lit(" - PT "), "c_mktsegment", F.lit(" - Jakarta"))).otherwise(""), F.lit(" | LinkedIn"))
    parts = F.filter(F.transform(F.split(F.regexp_replace(title, r"(?i)\s*\|\s*LinkedIn\s*$", ""), " - "), lambda x: F.trim(x)), lambda x: x != "")
    place = F.trim(F.get(F.split(F.concat(F.lit("Kota "), F.col("c_nationkey"), F.lit(", Indonesia · 500+")), "·"), 0))
    rest = F.array_join(F.slice(parts, 3, 100), " - ")
    return c.select("c_custkey", F.get(parts, 0).alias("nama"), F.coalesce(F.get(parts, 1), F.lit("-")).alias("jabatan"), F.when(rest == "", "-").otherwise(rest).alias("perusahaan"), F.when(F.length(place) < 60, place).otherwise("-").alias("lokasi"))


def q_shelves(spark, d):
    """Shelves per store from slugs; pseudo shelves go, leading dashes are stripped."""
    p = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("toko"), F.when(F.col("p_partkey") % 11 == 0, "sold").otherwise(F.lower(F.regexp_replace("p_type", " ", "-"))).alias("slug")).distinct().where(~F.col("slug").isin(*PSEUDO))
    return p.select("toko", "slug", F.regexp_replace(F.concat(F.lit("- - "), F.upper("slug")), r"^[-\s]+", "").alias("nama"), F.trim(F.regexp_replace("slug", "[-_/]+", " ")).alias("teks"))


def q_title_filter(spark, d):
    """Products whose title holds any keyword of two letters or more."""
    p = view(spark, d, "products")
    words = [w for w in "corsair 12700k x".split() if len(w) >= 2]
    return p.where(P.contains_any(F.lower("nama_produk"), words)).groupBy("platform").agg(F.count("*").alias("n"), F.count_if(F.lower("nama_produk").contains("corsair")).alias("corsair"))


def q_region_shortcuts(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    x = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    kind = F.when(F.col("r_name").isin("ASIA", "EUROPE"), "pulau besar").when(F.length("n_name") < 6, "kota").otherwise("lain")
    return x.select("n_name", "r_name", kind.alias("pintasan"))


def q_lead_detail(spark, d):
    """Each business with its latest changes in one row."""
    c = ledger.q_cdc1(spark, d)
    w = Window.partitionBy("place_key").orderBy("field")
    last = c.withColumn("n", F.row_number().over(w)).where("n <= 20").groupBy("place_key").agg(F.array_join(F.array_sort(F.collect_list("field")), ",").alias("kolom"), F.count("*").alias("n"))
    return view(spark, d, "businesses").select("place_key", "nama_bisnis").join(last, "place_key", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def q_latest_changes(spark, d):
    w = Window.orderBy("place_key", "field")
    return ledger.q_cdc1(spark, d).orderBy("place_key", "field").limit(50).withColumn("n", F.row_number().over(w)).select("place_key", "field", "n")


def q_saved_cost(spark, d):
    """Saved cost of our cheapest own product per variant."""
    g = pricing.groups(view(spark, d, "products")).where("is_own = 1 and harga > 0")
    cost = view(spark, d, "products").where("is_own = 1").select("product_key", "store_id", (F.col("harga") * F.lit(0.8)).cast("long").alias("modal")).groupBy("product_key").agg(F.max("modal").alias("modal"))
    first = g.groupBy("varian").agg(F.min_by("product_key", F.struct("harga", "product_key")).alias("product_key"))
    return first.join(cost, "product_key", "left").select("varian", "product_key", "modal")


def q_targets(spark, d):
    """Business types by areas; both are small lists of names."""
    v = view(spark, d, "listings")
    kinds = v.where("kategori is not null").select(F.col("kategori").alias("jenis")).distinct()
    return kinds.crossJoin(F.broadcast(v.select(F.col("area_pencarian").alias("area")).distinct())).withColumn("kueri", F.concat_ws(" ", "jenis", "area"))


def q_two_stage(spark, d):
    """Cards keyed by href first; those without a cid again with phone and name, then admitted."""
    v = view(spark, d, "listings")
    none = F.lit(None).cast("string")
    early = P.place_key(F.col("href"), none, none, none)
    rich = P.place_key(F.col("href"), F.col("nama_bisnis"), F.col("alamat"), F.col("telepon"))
    x = v.select("seq", F.when(early.startswith("cid:"), early).otherwise(rich).alias("place_key"))
    return ledger.admission(x, view(spark, d, "businesses")).groupBy("status").agg(F.count("*").alias("n"))


def q_ups_products(spark, d):
    """All products upserted from the prices of all observations; the own flag stays."""
    p = view(spark, d, "products").groupBy("product_key").agg(F.max("harga").alias("harga"), F.max("is_own").alias("is_own"))
    current = p.withColumn("times_seen", F.lit(1)).withColumn("last_scraped_at", F.lit("2023"))
    feed = view(spark, d, "product_obs").select("product_key", "seq", F.when(F.col("harga") > 0, F.col("harga")).cast("long").alias("harga"), F.lit(9).alias("is_own"))
    return ledger.upsert(current, feed, "product_key", ["seq", "harga"], keep=("is_own",)).select("product_key", "harga", "is_own", "times_seen")


def q_last_write(spark, d):
    """The last value written per platform and store."""
    v = view(spark, d, "price_obs").where("harga is not null")
    last = v.groupBy("store_id").agg(F.max_by(F.struct("harga", "seq"), F.struct("captured_at", "seq", "harga")).alias("x"))
    return last.select("store_id", "x.harga", "x.seq")


def q_crm_edits(spark, d):
    """Bulk edits of status and follow-up; only given fields change."""
    b = view(spark, d, "businesses")
    e = b.where("skor_pembeli > 60").select("place_key", F.lit("Follow Up").alias("s"), F.when(F.col("times_seen") > 2, "2024-02-01").alias("t"))
    return b.join(e, "place_key", "left").select("place_key", F.coalesce("s", "status_leads").alias("status_leads"), F.coalesce("t", "tanggal_follow_up").alias("tanggal_follow_up"))


def q_sheet_order(spark, d):
    return sheet_order(view(spark, d, "products"))


def sheet_order(products):
    """Rows of each store in sheet order: variant, then price, unpriced last."""
    g = pricing.groups(products)
    w = Window.partitionBy("store_id").orderBy("varian", F.when(F.col("harga") > 0, F.col("harga")).asc_nulls_last(), "product_key", "terjual", "nama_produk")
    return g.select("store_id", "product_key", "varian", F.row_number().over(w).alias("urut"))


def concept(tokens):
    """The category of the first known token."""
    pairs = F.create_map(*(F.lit(x) for k, ws in CATEGORY.items() for w in ws for x in (w, k)))
    return F.get(F.filter(F.transform(tokens, lambda t: pairs[t]), lambda c: c.isNotNull()), 0)


def q_shelf_scores(spark, d):
    """Top three shelves per query and store: shared tokens both ways, category, bundle and clash."""
    shelves = spark.createDataFrame([(i, s) for i, s in enumerate(SHELVES)], "etalase long, nama string").withColumn("et", L.tokens(F.col("nama")))
    stores = view(spark, d, "stores").where("aktif = 1").select(F.col("id").alias("store_id"), (F.expr("substring(id, 4)").cast("long") % 3).alias("m"))
    own = stores.join(shelves, F.col("etalase") % 3 == F.col("m"))
    q = matching.parsed_queries(spark, matching.QUERIES, LX.store_titles(view(spark, d, "products"))).select("query_id", F.col("tokens").alias("qt"), F.col("specs").alias("qs"))
    x = own.crossJoin(F.broadcast(q))
    shared = F.size(F.array_intersect("qt", "et"))
    head, asked = concept(F.col("et")), concept(F.col("qt"))
    score = 0.55 * shared / F.size("qt") + 0.20 * shared / F.size("et") + F.when(head == asked, 0.80).when(head.isNotNull() & asked.isNotNull(), -0.30).otherwise(0.0)
    score = score - F.when(F.array_join("et", " ").rlike(BUNDLE), 0.40).otherwise(0.0)
    x = x.withColumn("skor", F.bround(score, 3)).where("skor >= 0.30")
    w = Window.partitionBy("query_id", "store_id").orderBy(F.desc("skor"), "etalase")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 3").select("query_id", "store_id", "nama", "skor", "n")


def q_search_terms(spark, d):
    """In-store terms: exact models, longest first, else three strong tokens; then the raw text."""
    q = matching.parsed_queries(spark, matching.QUERIES, LX.store_titles(view(spark, d, "products")))
    strong = F.array_join(F.slice(F.filter("tokens", lambda t: L.kind(t).isin("model", "spek", "merek")), 1, 3), " ")
    longest = F.transform(F.array_sort(F.transform("models", lambda m: F.struct((-F.length(m)).alias("n"), m.alias("m")))), lambda x: x["m"])
    first = F.when(F.size("models") > 0, longest).otherwise(F.filter(F.array(strong), lambda s: s != ""))
    return q.select("query_id", F.array_join(F.array_union(first, F.array("teks")), " / ").alias("istilah"))


def q_freshness(spark, d):
    """Hours since the last observation of each store, and whether that is under twelve."""
    v = view(spark, d, "price_obs").groupBy("store_id").agg(F.max("captured_at").alias("t"))
    hours = (F.unix_timestamp(F.lit("1998-12-01 06:00:00").cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp"))) / 3600
    return v.select("store_id", hours.cast("long").alias("jam"), (hours < 12).alias("segar"))


def q_check(spark, d):
    """Price check end to end: variants of each query with market statistics and advice."""
    found = matching.search(spark, matching.QUERIES, view(spark, d, "products").where("harga > 0")).withColumn("varian", F.concat_ws("/", F.col("query_id").cast("string"), F.array_join(F.array_sort("models"), "|")))
    found = kept(found.select("varian", "product_key", "is_own", "sumber", "harga", "terjual"))  # the analysis reads it several times
    a = pricing.analysis(found, "varian")
    return a.select("varian", "n", "median", "keyakinan", "agresif", "seimbang", "premium", "posisi", "verdict")


def build():
    L_, B, O, PR, S = "listings", "businesses", "price_obs", "products", "stores"  # noqa: E741
    sold = "(SELECT l_partkey, sum(l_quantity)::BIGINT AS sold FROM lineitem GROUP BY 1)"
    return {
        "io3_cards": (q_card_ingest, with_views("WITH x AS (SELECT seq, CASE WHEN seq % 3 = 0 THEN href ELSE concat('h', seq % 500) END AS href, nama_bisnis FROM v_listings), r AS (SELECT *, row_number() OVER (PARTITION BY href ORDER BY seq) AS n FROM x) SELECT seq, href, nama_bisnis FROM r WHERE n = 1", L_)),
        "io4_shop_json": (q_shop_json, f"WITH p AS (SELECT *, (p_partkey % 900 + 10) * 1000 AS h, p_partkey % 7 * 200000 AS c FROM part JOIN {sold} ON p_partkey = l_partkey) SELECT concat('shp:', p_partkey % 50, ':', p_partkey) AS product_key, p_name AS nama_produk, h::BIGINT AS harga, (CASE WHEN c > h THEN c ELSE 0 END)::BIGINT AS harga_coret, sold AS terjual, round_even(p_partkey % 50 / 10.0::DOUBLE, 2) AS rating FROM p"),
        "io5_text_price_json": (q_text_price_json, "SELECT concat('tkp:9:', p_partkey) AS product_key, p_name AS nama_produk, concat('https://t.example/', p_partkey) AS url, coalesce(nullif(p_partkey * 1000, 0), NULL)::BIGINT AS harga, p_partkey % 9 AS jumlah_ulasan FROM part"),
        "io6_answers": (q_answers, with_views("WITH r AS (SELECT seq // 10 AS jawaban, seq, nama_bisnis AS nama, telepon, row_number() OVER (PARTITION BY seq // 10 ORDER BY seq) - 1 AS n FROM v_listings WHERE telepon IS NOT NULL) SELECT jawaban, n::INTEGER AS n, nama, telepon FROM r WHERE jawaban % 5 <> 0", L_)),
        "io7_regions": (q_regions, "SELECT r_name AS provinsi, n_name AS wilayah, n_nationkey AS kode, lower(concat(n_name, ' ', r_name)) AS cari FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, NULL, NULL, lower(r_name) FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)"),
        "io8_lead_sink": (q_sink, with_views("SELECT area_pencarian, count(*) AS n, sum(skor_pembeli)::BIGINT AS skor FROM v_businesses GROUP BY 1", B)),
        "prs9_profile_signals": (q_profile_signals, with_views("SELECT seq, coalesce(sudah_diklaim, true) AS diklaim, status_buka AS status, coalesce(jumlah_foto = 0, false) AS tanpa_foto, rentang_harga AS harga FROM v_listings", L_)),
        "prs11_profiles": (q_profiles, "SELECT c_custkey, c_name AS nama, CASE WHEN c_custkey % 3 > 0 THEN 'Manager' ELSE '-' END AS jabatan, CASE WHEN c_custkey % 3 > 1 THEN concat('PT ', c_mktsegment, ' - Jakarta') ELSE '-' END AS perusahaan, concat('Kota ', c_nationkey, ', Indonesia') AS lokasi FROM customer"),
        "prs13_shelves": (q_shelves, "WITH x AS (SELECT DISTINCT p_partkey % 50 AS toko, CASE WHEN p_partkey % 11 = 0 THEN 'sold' ELSE lower(replace(p_type, ' ', '-')) END AS slug FROM part) SELECT toko, slug, upper(slug) AS nama, replace(slug, '-', ' ') AS teks FROM x WHERE slug <> 'sold'"),
        "flt3_title_filter": (q_title_filter, with_views("SELECT platform, count(*) AS n, count(*) FILTER (WHERE lower(nama_produk) LIKE '%corsair%') AS corsair FROM v_products WHERE lower(nama_produk) LIKE '%corsair%' OR lower(nama_produk) LIKE '%12700k%' GROUP BY 1", PR)),
        "flt5_region_shortcuts": (q_region_shortcuts, "SELECT n_name, r_name, CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 'pulau besar' WHEN length(n_name) < 6 THEN 'kota' ELSE 'lain' END AS pintasan FROM nation JOIN region ON n_regionkey = r_regionkey"),
        "qry2_lead_detail": (q_lead_detail, with_views(f"WITH {CHANGES} SELECT b.place_key, b.nama_bisnis, string_agg(field, ',' ORDER BY field) AS kolom, count(field) AS n FROM v_businesses b LEFT JOIN cg USING (place_key) GROUP BY ALL", L_, B)),
        "win2_latest_changes": (q_latest_changes, with_views(f"WITH {CHANGES} SELECT place_key, field, row_number() OVER (ORDER BY place_key, field) AS n FROM cg ORDER BY place_key, field LIMIT 50", L_, B)),
        "joi7_saved_cost": (q_saved_cost, with_views(f"WITH {L.VARIANT_SQL}, c AS (SELECT product_key, max(trunc(harga * 0.8::DOUBLE))::BIGINT AS modal FROM v_products WHERE is_own = 1 GROUP BY 1), r AS (SELECT varian, product_key, row_number() OVER (PARTITION BY varian ORDER BY harga, product_key) AS n FROM vr WHERE is_own = 1 AND harga > 0) SELECT varian, r.product_key, modal FROM r LEFT JOIN c USING (product_key) WHERE n = 1", PR)),
        "joi9_targets": (q_targets, with_views("SELECT jenis, area, concat(jenis, ' ', area) AS kueri FROM (SELECT DISTINCT kategori AS jenis FROM v_listings WHERE kategori IS NOT NULL), (SELECT DISTINCT area_pencarian AS area FROM v_listings)", L_)),
        "ded4_two_stage_key": (q_two_stage, with_views(f"WITH c AS (SELECT {PLACE_KEY_SQL} AS place_key FROM v_listings) SELECT CASE WHEN b.place_key IS NULL THEN 'BARU' WHEN try_cast(last_scraped_at AS TIMESTAMP) IS NULL OR try_cast(last_scraped_at AS TIMESTAMP) < TIMESTAMP '2024-01-15' - INTERVAL 182 DAY THEN 'LAMA_KEDALUWARSA' ELSE 'LAMA_SEGAR' END AS status, count(*) AS n FROM c LEFT JOIN v_businesses b USING (place_key) GROUP BY 1", L_, B)),
        "ups2_products": (q_ups_products, with_views("WITH p AS (SELECT product_key, max(harga) AS harga, max(is_own) AS is_own FROM v_products GROUP BY 1), f AS (SELECT product_key, last(harga ORDER BY seq, harga) FILTER (WHERE harga > 0) AS harga, count(*) AS n FROM v_product_obs GROUP BY 1) SELECT coalesce(p.product_key, f.product_key) AS product_key, coalesce(f.harga, p.harga) AS harga, coalesce(p.is_own, 9) AS is_own, (CASE WHEN p.product_key IS NULL THEN 0 ELSE 1 END + coalesce(n, 0))::BIGINT AS times_seen FROM p FULL JOIN f ON p.product_key = f.product_key", PR, "product_obs")),
        "ups4_last_write": (q_last_write, with_views("SELECT store_id, harga, seq FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY captured_at DESC, seq DESC, harga DESC) AS n FROM v_price_obs WHERE harga IS NOT NULL) WHERE n = 1", O)),
        "ups5_crm_edits": (q_crm_edits, with_views("SELECT place_key, CASE WHEN skor_pembeli > 60 THEN 'Follow Up' ELSE status_leads END AS status_leads, CASE WHEN skor_pembeli > 60 AND times_seen > 2 THEN '2024-02-01' ELSE tanggal_follow_up END AS tanggal_follow_up FROM v_businesses", B)),
        "srt1_sheet_order": (q_sheet_order, with_views(f"WITH {L.VARIANT_SQL} SELECT store_id, product_key, varian, row_number() OVER (PARTITION BY store_id ORDER BY varian, CASE WHEN harga > 0 THEN harga END ASC NULLS LAST, product_key, terjual, nama_produk) AS urut FROM vr", PR)),
        "mat11_win5_shelf_scores": (q_shelf_scores, None),
        "mat12_search_terms": (q_search_terms, None),
        "mat13_freshness": (q_freshness, with_views("WITH t AS (SELECT store_id, max(captured_at) AS t FROM v_price_obs GROUP BY 1) SELECT store_id, trunc((epoch(TIMESTAMP '1998-12-01 06:00:00') - epoch(t::TIMESTAMP)) / 3600)::BIGINT AS jam, (epoch(TIMESTAMP '1998-12-01 06:00:00') - epoch(t::TIMESTAMP)) / 3600 < 12 AS segar FROM t", O)),
        "prc12_price_check": (q_check, None),
    }
