"""Market statistics, price bands and verdicts per group of comparable products."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.functions import parse as P
from marketlens.functions import titles as L
from marketlens.functions.frames import kept, small
from marketlens.functions.quantiles import percentiles
from marketlens.sources.views import view, with_views

FEE, FIXED = 8.0, 1250  # platform cut in percent and per order


def grid(price):
    return F.when(price < 100_000, 500).when(price < 1_000_000, 1_000).when(price < 10_000_000, 5_000).otherwise(10_000)


def rounded(price, how="near"):
    """On the usual price grid: to the nearest (half to even), down or up."""
    g = grid(price)
    step = {"near": F.bround(price / g), "down": F.floor(price / g), "up": F.ceil(price / g)}[how]
    return F.when(price <= 0, 0).otherwise(step * g).cast("long")


def net_cash(price, fee=FEE, fixed=FIXED):
    return (price * (F.lit(1.0) - F.lit(fee) / 100) - fixed).cast("long")


def most_cost(price, margin=0.0, fee=FEE, fixed=FIXED):
    return (net_cash(price, fee, fixed) - F.lit(margin) * price).cast("long")


def least_price(cost, margin=X.MARGIN, fee=FEE, fixed=FIXED):
    left = 1 - fee / 100 - margin
    return F.lit(0).cast("long") if left <= 0.01 else ((cost + fixed) / F.lit(left)).cast("long")


def trimmed(rows, group, price="harga", times=1):
    """Column dipakai: prices within 0.4 to 2.5 of the group's median; under three all are kept.

    The median comes from an aggregation joined back, so large groups are combined before the shuffle.
    `times`: the column with the number of rows that a row stands for.
    """
    times = F.lit(times) if times == 1 else F.col(times)
    mid = rows.groupBy(group).agg(F.floor(F.percentile(price, F.lit(0.5), times)).alias("_mid"), F.coalesce(F.sum(F.when(F.col(price).isNotNull(), times)), F.lit(0)).alias("_n"))
    ok = F.col(price).between(F.lit(0.4) * F.col("_mid"), F.lit(2.5) * F.col("_mid"))
    out = rows.join(mid, group).withColumn("_ok", ok)
    some = out.groupBy(group).agg(F.bool_or("_ok").alias("_any"))
    return out.join(some, group).withColumn("dipakai", (F.col("_n") < 3) | ~F.col("_any") | F.col("_ok")).drop("_mid", "_n", "_ok", "_any")


def statistics(rows, group):
    """n, outliers, min, quartiles, max, spread and confidence of rivals' prices by group.

    Equal prices of a group are counted first; only the counts are joined, so the rows of a large group never meet.
    """
    rivals = kept(rows.where("is_own = 0 and sumber <> 'ai' and harga > 0").groupBy(group, "harga").agg(F.count("*").alias("_c")))
    used = lambda c: F.when(F.col("dipakai"), F.col(c))
    q = lambda p: F.percentile(used("harga"), F.lit(p), F.col("_c")).cast("long")
    total = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("_c"))), F.lit(0))
    s = trimmed(rivals, group, times="_c").groupBy(group).agg(total(F.col("dipakai")).alias("n"), total(~F.col("dipakai")).alias("n_pencilan"), F.min(used("harga")).alias("min"), q(0.25).alias("p25"), q(0.5).alias("median"), q(0.75).alias("p75"), F.max(used("harga")).alias("maks"))
    s = s.withColumn("sebaran", F.when(F.col("p25") > 0, F.bround(F.col("p75") / F.col("p25"), 2)).otherwise(0.0))
    level = F.when(F.col("n") < 3, "LEMAH").when(F.col("sebaran") > X.WIDE, "SEBARAN LEBAR").otherwise("BAIK")
    return s.withColumn("keyakinan", level)


def groups(products):
    """Products with tokens and variant: the sorted model codes of the title, or its tokens. Equal titles are taken apart once."""
    x = products.select("nama_produk").distinct().withColumn("tokens", L.tokens(F.col("nama_produk")))
    model = F.array_sort(F.array_distinct(F.filter("tokens", lambda w: L.kind(w) == "model")))
    return products.join(small(x.withColumn("varian", F.when(F.size(model) > 0, F.array_join(model, "|")).otherwise(F.array_join("tokens", " ")))), "nama_produk")


def priced(products):
    """What the analysis reads of products, with their variant, computed once."""
    return kept(groups(products).select("varian", "product_key", "is_own", "sumber", "harga", "terjual"))


def analysis(products, group):
    """Statistics, three bands lifted to the cost floor, own position, rank and verdict by group."""
    stats = statistics(products, group)
    own = products.where("is_own = 1").groupBy(group).agg(F.max("harga").alias("kita"), F.max("terjual").alias("terjual_kita"))
    cost = (F.col("kita") * F.lit(0.8)).cast("long")
    x = stats.join(own, group, "left").withColumn("modal", cost).withColumn("lantai", F.when(F.col("modal") > 0, least_price(F.col("modal"))))
    rivals = products.where("is_own = 0")
    cheaper = rivals.join(own.select(group, "kita"), group).groupBy(group).agg(F.count_if((F.col("harga") > 0) & (F.col("harga") < F.col("kita"))).alias("lebih_murah"), F.percentile("terjual", F.lit(0.5)).alias("med_terjual"))
    x = x.join(cheaper, group, "left")
    lift = lambda c: F.when(F.col("lantai").isNotNull() & (c < F.col("lantai")), rounded(F.col("lantai"), "up")).otherwise(c)
    x = x.withColumn("agresif", lift(rounded(F.col("min") - grid(F.col("min")), "down"))).withColumn("seimbang", lift(rounded(F.col("median")))).withColumn("premium", lift(rounded(F.col("p75"))))
    k = F.col("kita")
    place = F.when(k <= F.col("min"), "TERMURAH").when(k <= F.col("p25"), "MURAH").when(k <= F.col("p75"), "WAJAR").otherwise("MAHAL")
    x = x.withColumn("posisi", F.when(k > 0, place))
    profit = net_cash(k) - F.col("modal")
    verdict = F.when(profit < 0, "RUGI").when(F.bround(profit / k * 100, 1) < X.MARGIN * 100, "MARGIN TIPIS").otherwise(F.col("posisi"))
    verdict = F.when((F.col("modal") > 0) & (F.col("median") < F.col("lantai")), "PASAR DI BAWAH MODAL").when(k > 0, verdict)
    x = x.withColumn("verdict", verdict).withColumn("peringkat", F.when(k > 0, F.concat(F.col("lebih_murah") + 1, F.lit(" dari "), F.col("n") + 1, F.lit(" termurah"))))
    return x.withColumn("bukan_harga", F.coalesce((F.col("posisi") == "TERMURAH") & (F.col("terjual_kita") < F.col("med_terjual")), F.lit(False)))


def q_stats(spark, d):
    x = statistics(view(spark, d, "products").withColumn("barang", F.element_at(F.split("product_key", ":"), -1)), "barang")
    return x.withColumn("seimbang", rounded(F.col("median"))).withColumn("bersih", net_cash(F.col("seimbang"))).withColumn("modal_maks", most_cost(F.col("seimbang")))


def q_trim(spark, d):
    p = view(spark, d, "products").withColumn("barang", F.element_at(F.split("product_key", ":"), -1)).where("harga > 0")
    return trimmed(p.select("product_key", "barang", "harga"), "barang").select("product_key", "harga", "dipakai")


def q_analysis(spark, d):
    x = analysis(priced(view(spark, d, "products")), "varian")
    return x.select("varian", "n", "n_pencilan", "min", "p25", "median", "p75", "maks", "sebaran", "keyakinan", "kita", "modal", "lantai", "agresif", "seimbang", "premium", "posisi", "peringkat", "verdict", "bukan_harga")


def q_bands(spark, d):
    """Three bands per product, with net cash, break-even cost, profit and margin."""
    x = analysis(priced(view(spark, d, "products")), "varian")
    rows = x.select("varian", "modal", F.inline(F.array(*(F.struct(F.lit(n).alias("nama"), F.col(n).alias("harga")) for n in ("agresif", "seimbang", "premium")))))
    h = F.col("harga")
    rows = rows.withColumn("uang_bersih", net_cash(h)).withColumn("potongan", (h * F.lit(FEE) / 100).cast("long")).withColumn("impas", most_cost(h)).withColumn("impas_margin", most_cost(h, X.MARGIN))
    return rows.withColumn("laba", F.col("uang_bersih") - F.col("modal")).withColumn("margin_persen", F.when(h > 0, F.bround(F.col("laba") / h * 100, 1))).drop("modal")


def q_sheet(spark, d):
    """Each harvested row with its variant's count, median, advice and gap, in sheet order."""
    g = priced(view(spark, d, "products"))
    s = small(statistics(g, "varian").select("varian", "n", "median"))
    x = g.join(s, "varian", "left").withColumn("saran", rounded(F.col("median"))).withColumn("selisih", F.col("harga") - F.col("median"))
    return x.select("product_key", "varian", "n", "median", "saran", F.col("selisih").cast("long").alias("selisih"))


def q_sentences(spark, d):
    x = q_stats(spark, d)
    return x.select("barang", F.concat(F.col("barang"), F.lit(": "), F.col("n"), F.lit(" harga pembanding, "), P.money(F.col("min")), F.lit(" – "), P.money(F.col("maks")), F.lit(", median "), P.money(F.col("median")), F.lit(".")).alias("kalimat"))


def q_scale(spark, d):
    """Upper-middle price of each run, and whether it is outside of what any product costs."""
    p = view(spark, d, "price_obs").where("harga > 0")
    s = p.groupBy("run_id").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY harga DESC)").alias("tengah"))
    return s.select("run_id", F.col("tengah").cast("long").alias("tengah"), (~F.col("tengah").between(*X.PLAUSIBLE)).alias("janggal"))


def fees(platforms, typed, defaults=X.FEES):
    """platforms with (persen, tetap): the fee that a user typed for the platform, else its default, else 0."""
    pick = lambda k: F.coalesce(*(F.when(F.col("platform") == p, F.lit(v[k])) for p, v in defaults.items()), F.lit(0))
    own = typed.select("platform", F.col("persen").alias("_persen"), F.col("tetap").alias("_tetap"))
    return platforms.join(own, "platform", "left").withColumn("persen", F.coalesce("_persen", pick(0)).cast("double")).withColumn("tetap", F.coalesce("_tetap", pick(1)).cast("int")).drop("_persen", "_tetap")


def q_fees(spark, d):
    """Fees of every store's platform; a third platform has only typed ones, a fourth none."""
    kind = F.expr("CASE WHEN id LIKE '%7' THEN 'lazada' WHEN id LIKE '%9' THEN 'bukalapak' ELSE platform END")
    s = view(spark, d, "stores").select("id", kind.alias("platform"))
    typed = spark.createDataFrame([("tokopedia", 7.25, None), ("lazada", 4.0, 1250)], "platform string, persen double, tetap int")
    return fees(s, typed)


GRID = "CASE WHEN {h} < 100000 THEN 500 WHEN {h} < 1000000 THEN 1000 WHEN {h} < 10000000 THEN 5000 ELSE 10000 END"


def near(h):
    return f"(CASE WHEN {h} <= 0 THEN 0 ELSE round_even({h}::DOUBLE / ({GRID.format(h=h)}), 0) * ({GRID.format(h=h)}) END)::BIGINT"


def side(h, fn):
    return f"(CASE WHEN {h} <= 0 THEN 0 ELSE {fn}({h}::DOUBLE / ({GRID.format(h=h)})) * ({GRID.format(h=h)}) END)::BIGINT"


def net(h):
    return f"trunc({h} * (1.0::DOUBLE - 8.0::DOUBLE / 100) - 1250)::BIGINT"


def stats_sql(source, key):
    """CTEs up to st: the statistics of rivals by key."""
    return f"""
rv AS (SELECT * FROM {source} WHERE is_own = 0 AND sumber <> 'ai' AND harga > 0),
md AS (SELECT *, floor(quantile_cont(harga, 0.5) OVER (PARTITION BY {key})) AS mid, count(*) OVER (PARTITION BY {key}) AS cn FROM rv),
ok AS (SELECT *, harga >= 0.4::DOUBLE * mid AND harga <= 2.5::DOUBLE * mid AS ok FROM md),
us AS (SELECT *, cn < 3 OR NOT bool_or(ok) OVER (PARTITION BY {key}) OR ok AS dipakai FROM ok),
st0 AS (SELECT {key}, count(*) FILTER (WHERE dipakai) AS n, count(*) FILTER (WHERE NOT dipakai) AS n_pencilan, min(harga) FILTER (WHERE dipakai) AS min, trunc(quantile_cont(harga, 0.25) FILTER (WHERE dipakai))::BIGINT AS p25,
  trunc(quantile_cont(harga, 0.5) FILTER (WHERE dipakai))::BIGINT AS median, trunc(quantile_cont(harga, 0.75) FILTER (WHERE dipakai))::BIGINT AS p75, max(harga) FILTER (WHERE dipakai) AS maks FROM us GROUP BY 1),
st1 AS (SELECT *, CASE WHEN p25 > 0 THEN round_even(p75::DOUBLE / p25, 2) ELSE 0 END::DOUBLE AS sebaran FROM st0),
st AS (SELECT *, CASE WHEN n < 3 THEN 'LEMAH' WHEN sebaran > 2.0 THEN 'SEBARAN LEBAR' ELSE 'BAIK' END AS keyakinan FROM st1)"""


def analysis_sql():
    lift = lambda c: f"CASE WHEN lantai IS NOT NULL AND {c} < lantai THEN {side('lantai', 'ceil')} ELSE {c} END"
    return f"""{L.VARIANT_SQL}, {stats_sql('vr', 'varian')},
ow AS (SELECT varian, max(harga) AS kita, max(terjual) AS terjual_kita FROM vr WHERE is_own = 1 GROUP BY 1),
ch AS (SELECT v.varian, count(*) FILTER (WHERE v.harga > 0 AND v.harga < o.kita) AS lebih_murah, quantile_cont(v.terjual, 0.5) AS med_terjual FROM vr v JOIN ow o USING (varian) WHERE is_own = 0 GROUP BY 1),
j0 AS (SELECT st.*, kita, terjual_kita, lebih_murah, med_terjual, trunc(kita * 0.8::DOUBLE)::BIGINT AS modal FROM st LEFT JOIN ow USING (varian) LEFT JOIN ch USING (varian)),
j1 AS (SELECT *, CASE WHEN modal > 0 THEN trunc((modal + 1250) / (1 - 8.0::DOUBLE / 100 - 0.05::DOUBLE))::BIGINT END AS lantai FROM j0),
j2 AS (SELECT *, min - ({GRID.format(h='min')}) AS lo FROM j1),
j3 AS (SELECT *, {side('lo', 'floor')} AS a0, {near('median')} AS s0, {near('p75')} AS q0 FROM j2),
j4 AS (SELECT *, {lift('a0')} AS agresif, {lift('s0')} AS seimbang, {lift('q0')} AS premium, CASE WHEN kita > 0 THEN CASE WHEN kita <= min THEN 'TERMURAH' WHEN kita <= p25 THEN 'MURAH' WHEN kita <= p75 THEN 'WAJAR' ELSE 'MAHAL' END END AS posisi FROM j3),
j5 AS (SELECT *, CASE WHEN kita > 0 THEN concat(lebih_murah + 1, ' dari ', n + 1, ' termurah') END AS peringkat,
  CASE WHEN modal > 0 AND median < lantai THEN 'PASAR DI BAWAH MODAL' WHEN kita > 0 THEN CASE WHEN {net('kita')} - modal < 0 THEN 'RUGI' WHEN round_even(({net('kita')} - modal)::DOUBLE / kita * 100, 1) < 5.0 THEN 'MARGIN TIPIS' ELSE posisi END END AS verdict,
  coalesce(posisi = 'TERMURAH' AND terjual_kita < med_terjual, false) AS bukan_harga FROM j4)"""


def q_percentiles(spark, d):
    """Exact quartiles of rivals' prices by variant; a variant with most of the rows is spread over tasks."""
    rivals = groups(view(spark, d, "products")).where("is_own = 0 and sumber <> 'ai' and harga > 0").select("varian", "harga")
    return percentiles(rivals, ["varian"], "harga", {"p25": 0.25, "median": 0.5, "p75": 0.75})


def build():
    PR = "products"
    item = "pb AS (SELECT *, split_part(product_key, ':', 3) AS barang FROM v_products)"
    base = f"{item}, {stats_sql('pb', 'barang')}, s2 AS (SELECT *, {near('median')} AS seimbang FROM st)"
    bands = " UNION ALL ".join(f"SELECT varian, modal, '{n}' AS nama, {n} AS harga FROM j5" for n in ("agresif", "seimbang", "premium"))
    tail = lambda h: f"concat('Rp ', replace(format('{{:,}}', {h}), ',', '.'))"
    return {
        "prc1_trim": (q_trim, with_views(f"WITH {item}, rv AS (SELECT * FROM pb WHERE harga > 0), md AS (SELECT *, floor(quantile_cont(harga, 0.5) OVER (PARTITION BY barang)) AS mid, count(*) OVER (PARTITION BY barang) AS cn FROM rv), ok AS (SELECT *, harga >= 0.4::DOUBLE * mid AND harga <= 2.5::DOUBLE * mid AS ok FROM md) SELECT product_key, harga, cn < 3 OR NOT bool_or(ok) OVER (PARTITION BY barang) OR ok AS dipakai FROM ok", PR)),
        "prc2_exact_percentiles": (q_percentiles, with_views(f"WITH {L.VARIANT_SQL} SELECT varian, quantile_cont(harga::DOUBLE, 0.25) AS p25, quantile_cont(harga::DOUBLE, 0.5) AS median, quantile_cont(harga::DOUBLE, 0.75) AS p75 FROM vr WHERE is_own = 0 AND sumber <> 'ai' AND harga > 0 GROUP BY 1", PR)),
        "prc2_5_market_statistics": (q_stats, with_views(f"WITH {base} SELECT *, {net('seimbang')} AS bersih, trunc({net('seimbang')} - 0.0::DOUBLE * seimbang)::BIGINT AS modal_maks FROM s2", PR)),
        "prc6_9_analysis": (q_analysis, with_views(f"WITH {analysis_sql()} SELECT varian, n, n_pencilan, min, p25, median, p75, maks, sebaran, keyakinan, kita, modal, lantai, agresif, seimbang, premium, posisi, peringkat, verdict, bukan_harga FROM j5", PR)),
        "prc6_bands": (q_bands, with_views(f"WITH {analysis_sql()}, bd AS ({bands}), b2 AS (SELECT *, {net('harga')} AS uang_bersih FROM bd) SELECT varian, nama, harga, uang_bersih, trunc(harga * 8.0::DOUBLE / 100)::BIGINT AS potongan, uang_bersih AS impas, trunc(uang_bersih - 0.05::DOUBLE * harga)::BIGINT AS impas_margin, uang_bersih - modal AS laba, CASE WHEN harga > 0 THEN round_even((uang_bersih - modal)::DOUBLE / harga * 100, 1) END AS margin_persen FROM b2", PR)),
        "prc10_sentences": (q_sentences, with_views(f"WITH {base} SELECT barang, concat(barang, ': ', n, ' harga pembanding, ', {tail('min')}, ' – ', {tail('maks')}, ', median ', {tail('median')}, '.') AS kalimat FROM s2", PR)),
        "prc11_sheet": (q_sheet, with_views(f"WITH {L.VARIANT_SQL}, {stats_sql('vr', 'varian')} SELECT product_key, vr.varian, n, median, {near('median')} AS saran, (harga - median)::BIGINT AS selisih FROM vr LEFT JOIN st USING (varian)", PR)),
        "agg8_scale_alert": (q_scale, with_views("WITH g AS (SELECT run_id, list_sort(list(harga)) AS h FROM v_price_obs WHERE harga > 0 GROUP BY 1) SELECT run_id, h[len(h) // 2 + 1]::BIGINT AS tengah, NOT (h[len(h) // 2 + 1] BETWEEN 100 AND 5000000000) AS janggal FROM g", "price_obs")),
        "joi6_fees": (q_fees, with_views("WITH k AS (SELECT id, CASE WHEN id LIKE '%7' THEN 'lazada' WHEN id LIKE '%9' THEN 'bukalapak' ELSE platform END AS platform FROM v_stores), f(platform, persen, tetap) AS (VALUES ('shopee', 8.0, 5000), ('tokopedia', 7.25, 5000), ('lazada', 4.0, 1250)) SELECT id, k.platform, coalesce(persen, 0)::DOUBLE AS persen, coalesce(tetap, 0)::INTEGER AS tetap FROM k LEFT JOIN f USING (platform)", "stores")),
    }
