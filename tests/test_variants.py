"""Product lines, summary and labels against a plain reading of their rules, row by row."""

from collections import Counter, defaultdict
from statistics import median

from pyspark.sql import functions as F

from marketlens.functions import titles as L
from marketlens.operators import variants

TITLES = [
    ("Cube Gaming Nytrix 240", 600), ("Cube Gaming Nytrix 240 Black", 610), ("Cube Gaming Luminex 240", 900), ("Cube Gaming 240", 1200), ("Cube Gaming 240", 35), ("Cube Gaming Nytrix 240", None), ("Cube Gaming Nytrix 240", 0),
    ("Intel i7 12700K Box", 4700), ("Intel i7 12700K Tray", 4800), ("Intel i7 12700K", 35), ("Deepcool Castle 360", 600), ("Deepcool Castle 360 Argb", 1600), ("Deepcool Castle 360", 900), ("Paste 12400F", 10), ("Paste 12400F", 90_000),
    ("Asus 3060 Ti 12700K", 9900), ("kabel merah", 10), ("kabel merah", 20), ("", 5), ("Cube Gaming", None), ("Fan 1200 Zeta", None), ("Fan 1200 Yota", None), ("Fan 1200 Yota", None), *[("Deepcool Castle Cube Gaming", 7)] * 30,
]
KIND = "product_key string, store_id string, nama_produk string, harga long, is_own int"


def frame(spark):
    rows = [(f"p{i}", f"s{i % 4}", t, h, int(i % 9 == 0)) for i, (t, h) in enumerate(TITLES)]
    return spark.createDataFrame(rows + rows[:3], KIND)  # three rows stand twice


def trim(prices):
    if len(prices) < 3:
        return prices
    mid = int(median(prices))
    return [h for h in prices if 0.4 * mid <= h <= 2.5 * mid] or prices


def wanted(rows, words, kinds, families):
    """kunci -> (n, stores, lowest, highest, outliers, own, label), following the rules one group at a time."""
    df = Counter(t for r in rows for t in set(words[r.nama_produk]))
    n_doc = sum(1 for r in rows if words[r.nama_produk])
    rare = {t for t in df if t.isalpha() and len(t) >= 4 and kinds[t] in ("umum", "merek") and df[t] / n_doc <= 0.12}
    groups = defaultdict(list)
    for r in rows:
        models = sorted({t for t in words[r.nama_produk] if kinds[t] == "model"})
        groups["|".join(models or words[r.nama_produk]), bool(models)].append(r)
    split = defaultdict(list)
    for (name, coded), members in groups.items():
        line = [max((t for t in words[r.nama_produk] if t in rare), key=lambda t: (-df[t], t), default=None) for r in members]
        used = trim([r.harga for r in members if (r.harga or 0) > 0])
        apart = coded and len(members) >= 3 and used and max(used) / min(used) >= 1.6 and len(set(line) - {None}) >= 2
        for r, x in zip(members, line, strict=True):
            split[f"{name}#{x or 'lain'}" if apart else name].append(r)
    out = {}
    for name, members in split.items():
        prices = [r.harga for r in members if (r.harga or 0) > 0]
        used = trim(prices)
        clean = [r for r in members if not r.harga or r.harga in used]
        count = Counter(t for r in clean for t in words[r.nama_produk])
        top = lambda ok: max((t for t in count if ok(t)), key=lambda t: (count[t], t), default=None)  # noqa: E731, B023
        series = lambda t: kinds[t] != "model" and t in ("i7", "rtx")
        brand = top(lambda t: kinds[t] == "merek" and not series(t))
        shared = [t for t in rare if len(clean) > 1 and all(t in words[r.nama_produk] for r in clean)]
        shared = max(shared, key=lambda t: (-df[t], t), default=None)
        parts = [brand and brand.capitalize(), top(series), shared and shared != brand and shared.upper(), (top(lambda t: kinds[t] == "model") or "").upper()]
        label = " ".join(p for p in parts if p)
        label = label + variants.BUNDLE * (len({families[t] for t in count if kinds[t] == "model"}) > 1) if label else min(r.nama_produk for r in clean)[:48]
        out[name] = (len(clean), len({r.store_id for r in clean}), min(used, default=0), max(used, default=0), len(prices) - len(used), max(r.is_own for r in clean), label)
    return out


def test_lines_summary_and_labels(spark):
    rows = frame(spark)
    words = {r.nama_produk: r.w for r in rows.select("nama_produk", L.tokens(F.col("nama_produk")).alias("w")).distinct().collect()}
    tokens = spark.createDataFrame([(t,) for t in sorted({t for w in words.values() for t in w})], "t string").select("t", L.kind(F.col("t")).alias("k"), L.family(F.col("t")).alias("f")).collect()
    want = wanted(rows.collect(), words, {r.t: r.k for r in tokens}, {r.t: r.f for r in tokens})
    got = variants.summary(variants.split_lines(variants.grouped(rows), []), ["kunci"]).collect()
    assert {r.kunci: (r.n, r.toko, r.termurah, r.termahal, r.n_pencilan, r.milik, r.label) for r in got} == want and len(got) == len(want)
    assert {"240#nytrix", "240#luminex", "240#lain", "12700k", "360", "1200"} <= set(want)  # split; prices close; one line only; no prices
    assert want["12700k|3060ti"][-1].endswith(variants.BUNDLE)


def test_groups_within_queries_are_apart(spark):
    rows = variants.grouped(frame(spark))
    both = rows.withColumn("query_id", F.lit(1)).unionByName(rows.where("harga < 700 or harga is null").withColumn("query_id", F.lit(2)))
    got = variants.split_lines(both, ["query_id"]).where("varian = '240'").select("query_id", "kunci").distinct().collect()
    assert {r.kunci for r in got if r.query_id == 1} == {"240#nytrix", "240#black", "240#luminex", "240#lain"} and {r.kunci for r in got if r.query_id == 2} == {"240"}


def test_empty_and_clashing_columns(spark):
    none = frame(spark).limit(0)
    assert variants.summary(variants.split_lines(variants.grouped(none), []), ["kunci"]).count() == 0
    more = frame(spark).withColumn("n", F.lit(7)).withColumn("baris", F.lit(1)).withColumn("label", F.lit("x"))
    got = variants.summary(variants.split_lines(variants.grouped(more), []), ["kunci"])
    assert got.count() == len(variants.summary(variants.split_lines(variants.grouped(frame(spark)), []), ["kunci"]).collect())


def test_products_are_read_once(spark):
    from marketlens.sources.views import view

    rows = variants.split_lines(variants.grouped(view(spark, "/root/testdata/sf0.001", "sized_products")), [])
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("l_partkey") == 0  # what was read stands in a checkpoint
