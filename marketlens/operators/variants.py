"""Variants of products: groups of one model code, split into product lines, with range of prices, stores and a label.

A number in a title may be a size and not a model (coolers of 240 mm), so a group whose prices lie far apart
is split by the rarest word of each title, but only if that gives two lines at least; else it stays whole.
Words are looked at once per distinct title, prices once per distinct price of a group, and only the marks of
both go back to the rows: by title, or by group and price, so a group that holds a large share of all rows is dealt out.
"""

from pyspark.sql import functions as F

from marketlens.functions import titles as L
from marketlens.functions.frames import each, kept, small
from marketlens.functions.ranks import numbered
from marketlens.operators import lexicon as LX
from marketlens.sources.views import view, with_views

APART = 1.6  # highest by lowest price, after the trim, from which a group may hold several lines
RARE = 0.12  # largest share of titles with a word that may name a line
WORD = r"^\p{L}{4,}$"
SERIES = r"^(i[0-9]|ryzen[0-9]|rtx|gtx|rx|ddr[0-9]|gen[0-9]+)$"
BUNDLE = " (paket/bundling)"


def grouped(products):
    """Products with tokens, model codes, variant, rare words (token, df) of their title and the rarest one; products are read once."""
    products = kept(products)
    return products.join(title_marks(products), "nama_produk")


def title_marks(products):
    """Per title: tokens, model codes, variant, rare words (token, df) and the rarest one."""
    titles = products.groupBy("nama_produk").agg(F.count("*").alias("jumlah")).withColumn("tokens", L.tokens(F.col("nama_produk")))
    models = F.array_sort(F.array_distinct(F.filter("tokens", lambda w: L.kind(w) == "model")))
    titles = kept(titles.withColumn("models", models).withColumn("varian", F.array_join(F.when(F.size("models") > 0, F.col("models")).otherwise(F.col("tokens")), "|")))
    return small(titles.drop("jumlah").join(rare_words(titles), "nama_produk", "left"))


def rare_words(titles, share=RARE):
    """Per title (nama_produk, tokens, jumlah): its rare words with their document frequency, and the rarest; equal ones: the last by letters."""
    df = LX.document_frequency(titles)
    rare = df.where((F.col("df") / F.col("n_dok") <= share) & F.col("token").rlike(WORD) & L.kind(F.col("token")).isin("umum", "merek")).select("token", "df")
    words = each(titles, ["nama_produk"], F.array_distinct("tokens"), "token").join(rare, "token")
    return words.groupBy("nama_produk").agg(F.collect_list(F.struct("token", "df")).alias("langka"), F.max_by("token", F.struct(-F.col("df"), "token")).alias("lini"))


def price_range(counted, keys):
    """Per group of (keys, harga, n): rows, and lowest and highest of the prices near the median (under three prices, or none near: of all)."""
    h = F.col("harga")
    mid = counted.groupBy(*keys).agg(F.sum("n").alias("baris"), F.sum(F.when(h > 0, F.col("n"))).alias("_n"), F.floor(F.percentile(F.when(h > 0, h), F.lit(0.5), F.col("n"))).alias("_mid"))
    near = F.when(h.between(F.lit(0.4) * F.col("_mid"), F.lit(2.5) * F.col("_mid")) | (F.col("_n") < 3), h)
    ends = counted.where(h > 0).join(mid, keys).groupBy(*keys).agg(F.coalesce(F.min(near), F.min(h)).alias("dari"), F.coalesce(F.max(near), F.max(h)).alias("sampai"))
    return mid.drop("_n", "_mid").join(ends, keys, "left")


def split_lines(rows, keys, least=APART):
    """The rows with kunci: their variant, with the line behind it where the group (keys, variant) falls into lines.

    rows hold what grouped() gives. Groups without a model code, of under three rows or without prices stay whole.
    """
    keys = [*keys, "varian"]
    counted = kept(rows.where(F.size("models") > 0).groupBy(*keys, "harga", "lini").agg(F.count("*").alias("n")))
    several = counted.groupBy(*keys).agg(F.min("lini").alias("a"), F.max("lini").alias("b")).where("a < b").select(*keys)
    wide = price_range(counted, keys).where((F.col("baris") >= 3) & (F.col("sampai") / F.col("dari") >= least))
    apart = small(wide.join(several, keys).select(*keys, F.lit("#").alias("_mark")))
    return rows.join(apart, keys, "left").withColumn("kunci", F.concat("varian", F.coalesce(F.concat("_mark", F.coalesce("lini", F.lit("lain"))), F.lit("")))).drop("_mark")


def summary(rows, keys):
    """Per group: products, stores, range of prices, outliers, best score, own flag and label; outliers count for nothing else."""
    h = F.col("harga")
    words = rows.select("nama_produk", "tokens", "langka").distinct()
    rows = rows.select(*keys, "harga", "store_id", "is_own", "nama_produk", *(c for c in ("skor",) if c in rows.columns))
    counted = kept(rows.groupBy(*keys, "harga").agg(F.count("*").alias("n")))
    ends = kept(price_range(counted, keys).select(*keys, "dari", "sampai"))
    far = small(counted.join(ends, keys).where((h > 0) & ~h.between(F.col("dari"), F.col("sampai"))).select(*keys, "harga", F.lit(False).alias("_ok")))
    rows = rows.join(far, [*keys, "harga"], "left").withColumn("_ok", F.coalesce("_ok", F.lit(True)))
    ok = lambda c: F.when(F.col("_ok"), F.col(c))
    best = [F.max("skor").alias("skor")] if "skor" in rows.columns else []
    t = kept(rows.where("_ok").groupBy(*keys, "nama_produk").agg(F.count("*").alias("_n")))
    out = rows.groupBy(*keys).agg(F.count_if("_ok").alias("n"), F.countDistinct(ok("store_id")).alias("toko"), F.count_if(~F.col("_ok")).alias("n_pencilan"), F.max(ok("is_own")).alias("milik"), *best)
    out = kept(out.join(ends, keys).join(t.groupBy(*keys).agg(F.min("nama_produk").alias("_nama")), keys, "left").select(
        *keys, "n", "toko", F.coalesce("dari", F.lit(0)).alias("termurah"), F.coalesce("sampai", F.lit(0)).alias("termahal"), "n_pencilan", "milik", "_nama", *(c for c in ("skor",) if best)))
    found = labels(t.join(words, "nama_produk"), out, keys)
    return out.join(found, keys, "left").withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.substring("_nama", 1, 48))).drop("_nama")


def labels(t, totals, keys):
    """Label of each group: top brand, top series, the rarest word that all its rows (two at least) share, top model, and a mark if models of several families meet.

    t: the titles of each group with their tokens, rare words and number of rows `_n`.
    """
    word = F.transform(F.array_distinct("tokens"), lambda w: F.struct(w.alias("t"), F.size(F.filter("tokens", lambda x: x == w)).alias("kali"), F.get(F.filter("langka", lambda x: x["token"] == w), 0)["df"].alias("df")))
    words = each(t, [*keys, "_n"], word, "w").groupBy(*keys, F.col("w.t").alias("t")).agg(F.sum(F.col("_n") * F.col("w.kali")).alias("kali"), F.sum("_n").alias("_n"), F.max("w.df").alias("df"))
    kind = L.kind(F.col("t"))
    words = words.withColumn("bagian", F.when(kind == "model", "model").when(F.col("t").rlike(SERIES), "seri").when(kind == "merek", "merek")).join(totals.select(*keys, F.col("n").alias("_all")), keys)
    shared = F.col("df").isNotNull() & (F.col("_n") == F.col("_all")) & (F.col("_all") > 1)
    top = [F.max_by("t", F.when(F.col("bagian") == b, F.struct("kali", "t"))).alias(b) for b in ("merek", "seri", "model")]
    fam = F.when(F.col("bagian") == "model", L.family(F.col("t")))
    x = words.groupBy(*keys).agg(*top, F.max_by("t", F.when(shared, F.struct(-F.col("df"), "t"))).alias("lini"), (F.min(fam) < F.max(fam)).alias("paket"))
    line = F.when(~F.initcap("lini").eqNullSafe(F.initcap("merek")), F.upper("lini"))
    label = F.concat_ws(" ", F.initcap("merek"), "seri", line, F.upper("model"))
    return x.select(*keys, F.concat(label, F.when(F.col("paket"), BUNDLE).otherwise("")).alias("label"))


def q_lines(spark, d):
    """Products by variant and line."""
    rows = split_lines(grouped(view(spark, d, "sized_products")), [])
    return rows.where(F.size("models") > 0).groupBy("varian", "kunci").agg(F.count("*").alias("n"))


def q_summary(spark, d):
    """Variants of all products after the split, those of most stores first."""
    rows = kept(split_lines(grouped(view(spark, d, "sized_products")), []))
    return numbered(summary(rows, ["kunci"]), [F.desc("toko"), "kunci"])


def build():
    ends = lambda source, key: f"""(SELECT {key}, baris, CASE WHEN m.c < 3 OR lo IS NULL THEN mn ELSE lo END AS dari, CASE WHEN m.c < 3 OR lo IS NULL THEN mx ELSE hi END AS sampai FROM
  (SELECT {key}, count(*) AS baris, count(*) FILTER (WHERE harga > 0) AS c, min(harga) FILTER (WHERE harga > 0) AS mn, max(harga) FILTER (WHERE harga > 0) AS mx FROM {source} GROUP BY 1) m
  LEFT JOIN (SELECT {key}, min(harga) AS lo, max(harga) AS hi FROM (SELECT {key}, harga, floor(quantile_cont(harga, 0.5) OVER (PARTITION BY {key})) AS mid FROM {source} WHERE harga > 0)
    WHERE harga >= 0.4::DOUBLE * mid AND harga <= 2.5::DOUBLE * mid GROUP BY 1) USING ({key}))"""  # noqa: E731
    kind, fam = L.kind_sql("token"), "left(regexp_extract(token, '[0-9]{3,5}'), CASE WHEN length(regexp_extract(token, '[0-9]{3,5}')) > 3 THEN 3 ELSE 2 END) || length(regexp_extract(token, '[0-9]{3,5}'))"
    variant = L.VARIANT_SQL.replace("v_products", "v_sized_products").replace("array_to_string(tokens, ' ')", "array_to_string(tokens, '|')")
    split = rf"""{variant},
nd AS (SELECT count(*) AS n_dok FROM vr WHERE len(tokens) > 0),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM vr) GROUP BY 1),
ra AS (SELECT token, df FROM df, nd WHERE df::DOUBLE / n_dok <= 0.12 AND regexp_matches(token, '^\p{{L}}{{4,}}$') AND ({kind}) IN ('umum', 'merek')),
rl AS (SELECT product_key, token FROM (SELECT product_key, token, row_number() OVER (PARTITION BY product_key ORDER BY df, token DESC) AS r FROM (SELECT product_key, unnest(list_distinct(tokens)) AS token FROM vr) JOIN ra USING (token)) WHERE r = 1),
ml AS (SELECT vr.*, rl.token AS lini FROM vr LEFT JOIN rl USING (product_key)), mm AS (SELECT * FROM ml WHERE len(models) > 0),
ap AS (SELECT varian FROM {ends('mm', 'varian')} JOIN (SELECT varian FROM mm GROUP BY 1 HAVING count(DISTINCT lini) >= 2) USING (varian) WHERE baris >= 3 AND sampai::DOUBLE / dari >= 1.6),
ky AS (SELECT ml.*, CASE WHEN ap.varian IS NULL THEN ml.varian ELSE concat(ml.varian, '#', coalesce(lini, 'lain')) END AS kunci FROM ml LEFT JOIN ap USING (varian))"""
    top = lambda part: f"pt{part} AS (SELECT kunci, arg_max(token, {{'c': c, 't': token}}) AS {part} FROM (SELECT kunci, token, count(*) AS c FROM tb WHERE bagian = '{part}' GROUP BY 1, 2) GROUP BY 1)"
    title = lambda c: f"upper({c}[1]) || {c}[2:]"
    return {
        "mat8_product_lines": (q_lines, with_views(f"WITH {split} SELECT varian, kunci, count(*) AS n FROM ky WHERE len(models) > 0 GROUP BY ALL", "sized_products")),
        "mat8_10_variants": (q_summary, with_views(f"""WITH {split},
rg AS (SELECT kunci, dari, sampai FROM {ends('ky', 'kunci')}),
kp AS (SELECT ky.*, dari, sampai, coalesce(harga <= 0 OR (harga >= dari AND harga <= sampai), true) AS ok FROM ky JOIN rg USING (kunci)),
sm AS (SELECT kunci, count(*) FILTER (WHERE ok) AS n, count(DISTINCT store_id) FILTER (WHERE ok) AS toko, coalesce(max(dari), 0)::BIGINT AS termurah, coalesce(max(sampai), 0)::BIGINT AS termahal, count(*) FILTER (WHERE NOT ok) AS n_pencilan, max(is_own) FILTER (WHERE ok) AS milik, min(nama_produk) FILTER (WHERE ok) AS nama FROM kp GROUP BY 1),
tb AS (SELECT kunci, product_key, token, CASE WHEN ({kind}) = 'model' THEN 'model' WHEN regexp_matches(token, '{SERIES}') THEN 'seri' WHEN ({kind}) = 'merek' THEN 'merek' END AS bagian FROM (SELECT kunci, product_key, unnest(tokens) AS token FROM kp WHERE ok)),
{top('merek')}, {top('seri')}, {top('model')},
cw AS (SELECT kunci, token AS lini FROM (SELECT kunci, token, row_number() OVER (PARTITION BY kunci ORDER BY df, token DESC) AS r FROM (SELECT kunci, token, count(DISTINCT product_key) AS k FROM tb GROUP BY 1, 2) JOIN ra USING (token) JOIN sm USING (kunci) WHERE k = n AND n > 1) WHERE r = 1),
fm AS (SELECT kunci, count(DISTINCT {fam}) > 1 AS paket FROM tb WHERE bagian = 'model' GROUP BY 1),
lb AS (SELECT sm.*, concat_ws(' ', {title('merek')}, seri, CASE WHEN lini IS DISTINCT FROM merek THEN upper(lini) END, upper(model)) AS l, paket FROM sm LEFT JOIN ptmerek USING (kunci) LEFT JOIN ptseri USING (kunci) LEFT JOIN ptmodel USING (kunci) LEFT JOIN cw USING (kunci) LEFT JOIN fm USING (kunci))
SELECT kunci, n, toko, termurah, termahal, n_pencilan, milik, CASE WHEN l = '' THEN nama[1:48] WHEN paket THEN concat(l, '{BUNDLE}') ELSE l END AS label, row_number() OVER (ORDER BY toko DESC, kunci) AS urut FROM lb""", "sized_products")),
    }
