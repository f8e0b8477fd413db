"""What a corpus of product titles teaches: token classes, document frequency, promotion words, aliases, store style."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import titles as L
from marketlens.functions.frames import each, kept
from marketlens.sources.views import view, with_views


def titled(products):
    """Products with the tokens of their titles; equal titles are taken apart once."""
    words = products.select("nama_produk").distinct().withColumn("tokens", L.tokens(F.col("nama_produk")))
    return products.join(words, "nama_produk")


def store_titles(products):
    """(store_id, nama_produk, jumlah, tokens): each title of a store with its number of products. All counts come from it."""
    return kept(titled(products.groupBy("store_id", "nama_produk").agg(F.count("*").alias("jumlah"))))


def each_title(titles):
    """The titles of all stores, each once, with the number of products."""
    return titles.groupBy("nama_produk", "tokens").agg(F.sum("jumlah").alias("jumlah"))


def document_frequency(titles):
    """token, df, idf over all titles with tokens."""
    titles = each_title(titles)
    n = titles.where(F.size("tokens") > 0).agg(F.sum("jumlah").alias("n_dok"))
    df = each(titles, ["jumlah"], F.array_distinct("tokens"), "token").groupBy("token").agg(F.sum("jumlah").alias("df"))
    return df.join(F.broadcast(n)).withColumn("idf", F.log(1 + (F.col("n_dok") + 1) / (F.col("df") + 1)))


def learned_promo(titles, share=0.35, stores=2):
    """Words in a large share of the titles of several stores; never with digits, brands, models or specifications."""
    total = titles.groupBy("store_id").agg(F.sum("jumlah").alias("total"))
    per = each(titles, ["store_id", "jumlah"], F.array_distinct("tokens"), "token").groupBy("store_id", "token").agg(F.sum("jumlah").alias("n"))
    much = per.join(total, "store_id").where(F.col("n") / F.col("total") >= share).groupBy("token").agg(F.count("*").alias("n_toko"))
    ok = ~F.col("token").rlike("[0-9]") & ~F.col("token").isin(*L.BRANDS) & ~L.kind(F.col("token")).isin("model", "spek")
    return much.where((F.col("n_toko") >= stores) & ok)


def aliases(titles):
    """(token, keluarga, n): digit-bearing tokens that aren't models, with the model families of their title."""
    titles = each_title(titles)
    models = F.filter("tokens", lambda w: L.kind(w) == "model")
    families = F.array_distinct(F.transform(models, lambda w: L.family(w)))
    others = F.array_distinct(F.filter("tokens", lambda w: w.rlike("[0-9]") & (L.kind(w) != "model")))
    x = each(titles.select("jumlah", families.alias("f"), others.alias("o")), ["f", "jumlah"], "o", "token")
    return each(x, ["token", "jumlah"], "f", "keluarga").groupBy("token", "keluarga").agg(F.sum("jumlah").alias("n"))


def q_tokens(spark, d):
    x = titled(view(spark, d, "products"))
    return x.select("product_key", F.array_join("tokens", " ").alias("token"), F.size("tokens").alias("n"))


def q_kinds(spark, d):
    x = each(each_title(store_titles(view(spark, d, "products"))), ["jumlah"], "tokens", "token").groupBy("token").agg(F.sum("jumlah").alias("n"))
    dim, value = L.spec_pair(F.col("token"))
    kind = L.kind(F.col("token"))
    return x.select("token", "n", kind.alias("kelas"), dim.alias("dimensi"), value.alias("nilai"), F.when(kind == "model", L.family(F.col("token"))).alias("keluarga"))


def q_idf(spark, d):
    return document_frequency(store_titles(view(spark, d, "products"))).select("token", "df", F.bround("idf", 6).alias("idf"))


def q_promo(spark, d):
    return learned_promo(store_titles(view(spark, d, "products"))).withColumn("benih", F.col("token").isin(*L.PROMO))


def q_aliases(spark, d):
    return aliases(store_titles(view(spark, d, "products"))).withColumn("cukup", F.col("n") >= 3)


def q_strong(spark, d):
    """The twelve strongest aliases with their four commonest families."""
    a = aliases(store_titles(view(spark, d, "products")))
    total = a.groupBy("token").agg(F.sum("n").alias("total"))
    top = total.orderBy(F.desc("total"), "token").limit(12)
    w = Window.partitionBy("token").orderBy(F.desc("n"), "keluarga")
    return a.join(F.broadcast(top), "token").withColumn("r", F.row_number().over(w)).where("r <= 4").select("token", "keluarga", "n", "total", "r")


def q_style(spark, d):
    """Writing style of each store and its sentence parts."""
    p = titled(view(spark, d, "products"))
    t = F.col("nama_produk")
    caps = (F.upper(t) == t) & t.rlike("[A-Za-z]")
    s = p.groupBy("store_id").agg(F.percentile(F.length(t), F.lit(0.5)).cast("long").alias("panjang"), F.percentile(F.size("tokens"), F.lit(0.5)).cast("long").alias("kata"), F.bround(F.avg(caps.cast("double")) * 100, 1).alias("kapital"), F.count_if(F.contains(t, F.lit("-"))).alias("strip"), F.count("*").alias("n"))
    return s.withColumn("gaya", F.when(F.col("kapital") >= 25, "banyak huruf besar").otherwise("biasa"))


def q_phrases(spark, d):
    """Token pairs that begin with a promotion word, per store: from each title of a store once, with its number of products."""
    p = store_titles(view(spark, d, "products"))
    pairs = F.filter(F.arrays_zip(F.col("tokens").alias("a"), F.slice("tokens", 2, 1000000).alias("b")), lambda x: x["a"].isin(*L.PROMO) & x["b"].isNotNull())
    x = each(p, ["store_id", "jumlah"], F.transform(pairs, lambda x: F.concat_ws(" ", x["a"], x["b"])), "frasa")
    return x.groupBy("store_id", "frasa").agg(F.sum("jumlah").alias("n"))


def q_effect(spark, d):
    """Median sold with and without each promotion word; both sides need three titles."""
    p = titled(view(spark, d, "products"))
    used = p.select("product_key", "terjual", F.array_distinct(F.filter("tokens", lambda w: w.isin(*L.PROMO))).alias("kata"))
    words = each(used.select(F.col("kata").alias("k")), [], "k", "kata").groupBy("kata").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kata").limit(20).select("kata")
    x = used.select("terjual", F.col("kata").alias("punya")).join(F.broadcast(words)).withColumn("ada", F.array_contains("punya", F.col("kata")))
    side = lambda c: F.percentile(F.when(c, F.col("terjual")), F.lit(0.5))
    g = x.groupBy("kata").agg(side(F.col("ada")).alias("dengan"), side(~F.col("ada")).alias("tanpa"), F.count_if("ada").alias("n_dengan"), F.count_if(~F.col("ada")).alias("n_tanpa"))
    g = g.where("n_dengan >= 3 and n_tanpa >= 3").withColumn("selisih", F.col("dengan") - F.col("tanpa"))
    return g.orderBy(F.desc("selisih"), "kata").limit(6)


def q_variants(spark, d):
    """Products per variant key with price range, stores and own flag."""
    from marketlens.operators.pricing import groups

    g = groups(view(spark, d, "products"))
    return g.groupBy("varian").agg(F.count("*").alias("n"), F.countDistinct("store_id").alias("toko"), F.min(F.when(F.col("harga") > 0, F.col("harga"))).alias("termurah"), F.max("harga").alias("termahal"), F.max("is_own").alias("milik"))


def build():
    PR = "products"
    tk = f"tk AS (SELECT *, {L.tokens_sql('nama_produk')} AS tokens FROM v_products)"
    ex = f"{tk}, ex AS (SELECT product_key, store_id, terjual, unnest(list_distinct(tokens)) AS token FROM tk), kd AS (SELECT *, {L.kind_sql('token')} AS kelas FROM ex)"
    fam = "CASE length(regexp_extract(token, '([0-9]{3,5})', 1)) WHEN 5 THEN concat(left(regexp_extract(token, '([0-9]{3,5})', 1), 3), 'xx') WHEN 4 THEN concat(left(regexp_extract(token, '([0-9]{3,5})', 1), 3), 'x') WHEN 3 THEN concat(left(regexp_extract(token, '([0-9]{3,5})', 1), 2), 'x') END"
    rn = "rk AS (SELECT *, row_number() OVER () AS rid FROM v_products), "
    al = f"{rn}tk AS (SELECT rid, {L.tokens_sql('nama_produk')} AS tokens FROM rk), ex AS (SELECT rid, unnest(list_distinct(tokens)) AS token FROM tk), kd AS (SELECT *, {L.kind_sql('token')} AS kelas FROM ex), fm AS (SELECT DISTINCT rid, {fam} AS keluarga FROM kd WHERE kelas = 'model'), al AS (SELECT token, keluarga, count(*) AS n FROM kd JOIN fm USING (rid) WHERE kelas <> 'model' AND regexp_matches(token, '[0-9]') GROUP BY ALL)"
    spec = rf"""CASE WHEN regexp_matches(token, '^[0-9]+(tb|mb)$') THEN 'gb' WHEN regexp_matches(token, '^[0-9]+({L.UNITS})$') THEN regexp_extract(token, '^[0-9]+({L.UNITS})$', 1) WHEN regexp_matches(token, '^({L.SERIES})[0-9]+$') THEN regexp_extract(token, '^({L.SERIES})([0-9]+)$', 1) WHEN regexp_matches(token, '^i[3579]$') THEN 'iseri' END AS dimensi,
 CASE WHEN regexp_matches(token, '^[0-9]+tb$') THEN (regexp_extract(token, '[0-9]+')::BIGINT * 1000)::VARCHAR WHEN regexp_matches(token, '^[0-9]+mb$') THEN (regexp_extract(token, '[0-9]+')::BIGINT // 1000)::VARCHAR WHEN regexp_matches(token, '^[0-9]+({L.UNITS})$') THEN regexp_extract(token, '[0-9]+') WHEN regexp_matches(token, '^({L.SERIES})[0-9]+$') THEN regexp_extract(token, '^({L.SERIES})([0-9]+)$', 2) WHEN regexp_matches(token, '^i[3579]$') THEN token[2:] END AS nilai"""
    words = "(" + ", ".join(f"'{v}'" for v in L.PROMO) + ")"
    return {
        "lex1_tokens": (q_tokens, with_views(f"WITH {tk} SELECT product_key, array_to_string(tokens, ' ') AS token, len(tokens)::INTEGER AS n FROM tk", PR)),
        "lex2_4_kinds": (q_kinds, with_views(f"WITH {tk}, u AS (SELECT unnest(tokens) AS token FROM tk), g AS (SELECT token, count(*) AS n FROM u GROUP BY 1), k AS (SELECT *, {L.kind_sql('token')} AS kelas FROM g) SELECT token, n, kelas, {spec}, CASE WHEN kelas = 'model' THEN {fam} END AS keluarga FROM k", PR)),
        "lex5_idf": (q_idf, with_views(f"WITH {ex}, nd AS (SELECT count(*) AS n FROM tk WHERE len(tokens) > 0) SELECT token, count(*) AS df, round_even(ln(1 + (max(n) + 1)::DOUBLE / (count(*) + 1)), 6) AS idf FROM ex, nd GROUP BY token", PR)),
        "lex6_promo": (q_promo, with_views(f"WITH {ex}, tt AS (SELECT store_id, count(*) AS total FROM tk GROUP BY 1), pr AS (SELECT store_id, token, kelas, count(*) AS n FROM kd GROUP BY ALL), mu AS (SELECT token, any_value(kelas) AS kelas, count(*) AS n_toko FROM pr JOIN tt USING (store_id) WHERE n::DOUBLE / total >= 0.35 GROUP BY 1) SELECT token, n_toko, token IN {words} AS benih FROM mu WHERE n_toko >= 2 AND NOT regexp_matches(token, '[0-9]') AND kelas NOT IN ('merek', 'model', 'spek')", PR)),
        "lex7_8_aliases": (q_aliases, with_views(f"WITH {al} SELECT token, keluarga, n, n >= 3 AS cukup FROM al", PR)),
        "lex9_strongest": (q_strong, with_views(f"WITH {al}, tp AS (SELECT token, sum(n)::BIGINT AS total FROM al GROUP BY 1 ORDER BY total DESC, token LIMIT 12) SELECT * FROM (SELECT token, keluarga, n, total, row_number() OVER (PARTITION BY token ORDER BY n DESC, keluarga) AS r FROM al JOIN tp USING (token)) WHERE r <= 4", PR)),
        "lex10_12_style": (q_style, with_views(f"WITH {tk}, s AS (SELECT store_id, trunc(quantile_cont(length(nama_produk), 0.5))::BIGINT AS panjang, trunc(quantile_cont(len(tokens), 0.5))::BIGINT AS kata, round_even(avg((upper(nama_produk) = nama_produk AND regexp_matches(nama_produk, '[A-Za-z]'))::INT::DOUBLE) * 100, 1) AS kapital, count(*) FILTER (WHERE contains(nama_produk, '-')) AS strip, count(*) AS n FROM tk GROUP BY 1) SELECT *, CASE WHEN kapital >= 25 THEN 'banyak huruf besar' ELSE 'biasa' END AS gaya FROM s", PR)),
        "lex10_phrases": (q_phrases, with_views(f"WITH {tk}, f AS (SELECT store_id, unnest(list_transform(range(1, len(tokens)), lambda i: concat(tokens[i], ' ', tokens[i + 1]))) AS frasa FROM tk WHERE len(tokens) > 1) SELECT store_id, frasa, count(*) AS n FROM f WHERE split_part(frasa, ' ', 1) IN {words} GROUP BY ALL", PR)),
        "lex11_effect": (q_effect, with_views(f"WITH {tk}, u AS (SELECT terjual, list_filter(list_distinct(tokens), lambda w: w IN {words}) AS punya FROM tk), c AS (SELECT kata, count(*) AS n FROM (SELECT unnest(punya) AS kata FROM u) GROUP BY 1 ORDER BY n DESC, kata LIMIT 20), x AS (SELECT kata, terjual, list_contains(punya, kata) AS ada FROM u, c), g AS (SELECT kata, quantile_cont(terjual, 0.5) FILTER (WHERE ada) AS dengan, quantile_cont(terjual, 0.5) FILTER (WHERE NOT ada) AS tanpa, count(*) FILTER (WHERE ada) AS n_dengan, count(*) FILTER (WHERE NOT ada) AS n_tanpa FROM x GROUP BY 1) SELECT *, dengan - tanpa AS selisih FROM g WHERE n_dengan >= 3 AND n_tanpa >= 3 ORDER BY selisih DESC, kata LIMIT 6", PR)),
        "mat6_10_variants": (q_variants, with_views(f"WITH {L.VARIANT_SQL} SELECT varian, count(*) AS n, count(DISTINCT store_id) AS toko, min(harga) FILTER (WHERE harga > 0) AS termurah, max(harga) AS termahal, max(is_own) AS milik FROM vr GROUP BY 1", PR)),
    }
