"""Loose queries matched to product titles, and variants among the matches.

Queries are a small table. Candidates come from equi-joins of query tokens and families with
postings of the titles, never from pairing every query with every title; equal titles are scored once.
"""

import difflib

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions import titles as L
from marketlens.functions.frames import each, kept, small
from marketlens.operators import lexicon as LX
from marketlens.operators import variants
from marketlens.sources.views import view

QUERIES = ["intel 7 gen 12", "ram ddr4 8gb", "ssd sandisk 1tb", "rtx 3060 ti", "kulkas 2 pintu"]
WEIGHTS = {"model": 3.0, "spek": 2.0, "merek": 1.5, "umum": 1.0, "promo": 0.0}
LEAST, TOP, EVIDENCE, LEADER = 0.45, 200, 2, 0.72


def distinct_titles(titles):
    """One row per title with tokens, model codes, families and specifications."""
    t = LX.each_title(titles).where(F.size("tokens") > 0).select("nama_produk", "tokens")
    t = t.withColumn("models", F.array_distinct(F.filter("tokens", lambda w: L.kind(w) == "model")))
    return t.withColumn("families", F.array_distinct(F.transform("models", lambda w: L.family(w)))).withColumn("specs", specs("tokens"))


def specs(column):
    both = F.transform(column, lambda w: F.struct(L.spec_pair(w)[0].alias("d"), L.spec_pair(w)[1].alias("v")))
    return F.filter(both, lambda s: s["d"].isNotNull())


def parsed_queries(spark, texts, titles):
    """Queries with their tokens (class, weight, alias families, generation prefix) and the families meant, by the titles of all stores."""
    idf = LX.document_frequency(titles).select("token", "df", "idf", "n_dok")
    n = idf.agg(F.max("n_dok").alias("n_dok"))
    fam = LX.aliases(titles).where(F.col("n") >= EVIDENCE).groupBy("token").agg(F.collect_set("keluarga").alias("fam"))
    promo = LX.learned_promo(titles).select("token", F.lit(True).alias("promo"))
    q = spark.createDataFrame(list(enumerate(texts)), "query_id long, teks string").withColumn("tokens", L.tokens(F.col("teks")))
    rows = each(q, ["query_id"], F.array_distinct("tokens"), "token")
    rows = rows.join(idf.drop("n_dok"), "token", "left").join(fam, "token", "left").join(promo, "token", "left").join(F.broadcast(n))
    rows = rows.withColumn("kelas", L.kind(F.col("token"), F.col("token").isin(*L.PROMO) | F.coalesce("promo", F.lit(False))))
    weight = F.create_map(*(F.lit(x) for kv in WEIGHTS.items() for x in kv))[F.col("kelas")] * F.coalesce("idf", F.log(1 + (F.col("n_dok") + 1) / F.lit(1)))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("t", F.struct("token", "kelas", weight.alias("w"), (F.coalesce("df", F.lit(0)) > 0).alias("known"), F.coalesce("fam", none).alias("fam"), F.nullif(F.regexp_extract("token", "^gen([0-9]{1,2})$", 1), F.lit("")).alias("gen")))
    q = q.join(rows.groupBy("query_id").agg(F.array_sort(F.collect_list("t"), lambda a, b: F.when(a["token"] < b["token"], -1).otherwise(1)).alias("qt")), "query_id")
    q = q.withColumn("models", F.transform(F.filter("qt", lambda x: x["kelas"] == "model"), lambda x: x["token"])).withColumn("brands", F.transform(F.filter("qt", lambda x: x["kelas"] == "merek"), lambda x: x["token"]))
    q = q.withColumn("gens", F.array_compact(F.transform("qt", lambda x: x["gen"]))).withColumn("specs", specs("tokens"))
    direct = F.array_distinct(F.transform("models", lambda w: L.family(w)))
    sets = F.transform(F.filter("qt", lambda x: (F.size(x["fam"]) > 0) & (x["kelas"] != "model") & x["gen"].isNull()), lambda x: x["fam"])
    q = q.withColumn("sets", sets).withColumn("direct", direct)
    both = F.aggregate("sets", F.get("sets", 0), lambda a, x: F.array_intersect(a, x))
    meant = F.when(F.size("direct") > 0, F.col("direct")).when(F.size("sets") == 0, none).when(F.size(both) > 0, both).otherwise(F.array_distinct(F.flatten("sets")))
    q = q.withColumn("meant", meant)
    near = F.filter("meant", lambda f: F.exists("gens", lambda g: f.startswith(g)))
    return kept(q.withColumn("meant", F.when((F.size("gens") > 0) & (F.size(near) > 0), near).otherwise(F.col("meant"))))


def hit(x, tokens, families):
    """Whether a query token is in the title, literally, by generation prefix or by alias family."""
    by_gen = F.exists(families, lambda f: f.startswith(x["gen"]))
    return F.array_contains(tokens, x["token"]) | F.when(x["gen"].isNotNull(), by_gen).otherwise(F.arrays_overlap(x["fam"], families))


def matches(spark, texts, products):
    """(query_id, nama_produk, skor, models, tokens) of titles that pass the hard filters and the threshold."""
    every = LX.store_titles(products)
    titles = kept(distinct_titles(every))
    q = parsed_queries(spark, texts, every)
    weighted = q.select("query_id", F.explode(F.filter("qt", lambda x: x["w"] > 0)).alias("x"))
    keys = weighted.select("query_id", F.col("x.token").alias("key")).unionByName(weighted.select("query_id", F.explode("x.fam").alias("key"))).unionByName(weighted.where("x.gen is not null").select("query_id", F.concat(F.lit("gen:"), "x.gen").alias("key"))).distinct()
    prefixes = F.flatten(F.transform("families", lambda f: F.array(F.concat(F.lit("gen:"), F.substring(f, 1, 1)), F.concat(F.lit("gen:"), F.substring(f, 1, 2)))))
    postings = each(titles, ["nama_produk"], F.array_distinct(F.concat("tokens", "families", prefixes)), "key")
    pairs = postings.join(F.broadcast(keys), "key").select("query_id", "nama_produk").distinct()
    x = pairs.join(titles, "nama_produk").join(F.broadcast(q.select("query_id", "qt", "gens", "brands", "meant", F.col("models").alias("q_models"), F.col("specs").alias("q_specs"))), "query_id")
    some = lambda c: F.size(c) > 0
    keep = ~(some("meant") & some("families") & ~F.arrays_overlap("meant", "families"))
    keep &= ~(some("gens") & some("families") & ~F.exists("families", lambda f: F.exists("gens", lambda g: f.startswith(g))))
    keep &= ~(some("q_models") & some("models") & ~F.arrays_overlap("q_models", "models"))
    same = lambda a: F.filter("specs", lambda s: s["d"] == a["d"])
    clash = F.exists("q_specs", lambda a: (F.size(same(a)) > 0) & ~F.exists("specs", lambda s: F.exists("q_specs", lambda b: (b["d"] == a["d"]) & (s["d"] == a["d"]) & (s["v"] == b["v"]))))
    keep &= ~clash & (~some("brands") | F.arrays_overlap("brands", "tokens"))
    x = x.where(keep)
    core = F.when(F.exists("qt", lambda t: t["kelas"] != "promo"), F.filter("qt", lambda t: t["kelas"] != "promo")).otherwise(F.col("qt"))
    x = x.withColumn("here", F.filter(core, lambda t: t["known"] | hit(t, F.col("tokens"), F.col("families"))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, t: a + t["w"])
    means = F.exists("here", lambda t: t["kelas"].isin("model", "spek", "merek") | t["token"].rlike("^[a-z]{3,}$"))
    got = F.filter("here", lambda t: hit(t, F.col("tokens"), F.col("families")))
    x = x.withColumn("skor", F.when(means & (total("here") > 0), F.bround(total(got) / total("here"), 4)).otherwise(0.0))
    return x.where(F.col("skor") >= LEAST).select("query_id", "nama_produk", "skor", "models", "tokens")


def search(spark, texts, products):
    """The top products per query: score, then price, then key.

    Only products and scores are ranked; tokens and models come to the ranked ones.
    """
    titles = small(matches(spark, texts, products))
    w = Window.partitionBy("query_id").orderBy(F.desc("skor"), F.coalesce("harga", F.lit(0)), "product_key", "store_id")
    found = products.join(titles.select("query_id", "nama_produk", "skor"), "nama_produk")
    found = kept(found.withColumn("urut", F.row_number().over(w)).where(F.col("urut") <= TOP))
    return found.join(titles.drop("skor"), ["nama_produk", "query_id"])


def title_similarity(a, b):
    """Set overlap, sequence ratio and overlap of numbers; disjoint numbers are punished."""
    a, b = set(a), set(b)
    if not a or not b:
        return 0.0
    na, nb = ({t for t in s if any(c.isdigit() for c in t)} for s in (a, b))
    ratio = difflib.SequenceMatcher(None, " ".join(sorted(a)), " ".join(sorted(b))).ratio()
    value = 0.45 * len(a & b) / len(a | b) + 0.35 * ratio + 0.20 * (len(na & nb) / len(na | nb) if na | nb else 0.0)
    return round(value * 0.55 if na and nb and not na & nb else value, 4)


def leaders(rows):
    """Greedy leader clusters of a query's titles without model code, in order of score."""
    rows = rows.sort_values(["urut"])
    heads, out = [], []
    for tokens in rows["tokens"]:
        own = [t for t in tokens if t not in L.PROMO]
        near = next((i for i, h in enumerate(heads) if title_similarity(own, h) >= LEADER), None)
        if near is None:
            heads.append(own)
            near = len(heads) - 1
        out.append(near)
    return pd.DataFrame({"query_id": rows["query_id"], "product_key": rows["product_key"], "kelompok": out})


def q_search(spark, d):
    return search(spark, QUERIES, view(spark, d, "products")).select("query_id", "urut", "product_key", "nama_produk", "skor", F.array_join(F.array_sort("models"), "|").alias("varian"))


def q_queries(spark, d):
    q = parsed_queries(spark, QUERIES, LX.store_titles(view(spark, d, "products")))
    return q.select("query_id", "teks", F.array_join("tokens", " ").alias("token"), F.array_join(F.array_sort("meant"), ",").alias("keluarga"), F.array_join("gens", ",").alias("prefiks"))


def q_leaders(spark, d):
    found = search(spark, QUERIES, view(spark, d, "products")).where(F.size("models") == 0)
    return found.select("query_id", "urut", "product_key", "tokens").groupBy("query_id").applyInPandas(leaders, "query_id long, product_key string, kelompok int")


def q_labels(spark, d):
    """Variants of each query, split into product lines: label, range of prices, stores, best score, those of most stores first."""
    products = kept(view(spark, d, "products"))
    found = search(spark, QUERIES, products).where(F.size("models") > 0)
    found = found.join(variants.title_marks(products).drop("tokens", "models"), "nama_produk")
    found = kept(variants.split_lines(found, ["query_id"]))
    x = variants.summary(found.withColumn("harga", F.col("harga").cast("long")), ["query_id", "kunci"])
    w = Window.partitionBy("query_id").orderBy(F.desc("toko"), F.desc("skor"), "kunci")
    return x.withColumn("urut", F.row_number().over(w)).select("query_id", "urut", F.col("kunci").alias("varian"), "label", "n", "toko", "skor", "termurah", "termahal", "n_pencilan", "milik")


def build():
    return {"mat1_query_parse": (q_queries, None), "mat2_4_search": (q_search, None), "mat5_7_leaders": (q_leaders, None), "mat9_labels": (q_labels, None)}
