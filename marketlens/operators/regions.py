"""Libraries of places and of search words, flattened from nested records, and shortcuts over them.

A library is a frame of nested rows as read from multi-line JSON. Shortcuts are a table of rules that is joined
to the places on a key of theirs (province, name, type, parent), so one more rule is one more row.
"""

from pyspark.sql import functions as F

from marketlens.functions import fixed as X
from marketlens.sources.views import view, with_views

PLACES = "nama string, wilayah array<struct<n: string, t: string, kec: array<struct<n: string>>>>"
WORDS = "nama string, keywords array<struct<k: string, alasan: string>>"
TYPES = {"kota": "Kota", "kab": "Kab.", "kec": "Kec."}


def flat_places(provinces):
    """One row per regency or city and one per district of nested provinces (nama, wilayah): kueri, label, provinsi, tipe, induk, cari.

    Provinces without regencies and regencies without districts give none of those rows. A type other than `kota` counts as regency in the label.
    """
    r = provinces.select(F.col("nama").alias("provinsi"), F.explode("wilayah").alias("w")).select("provinsi", F.col("w.n").alias("n"), F.col("w.t").alias("t"), F.col("w.kec").alias("kec"))
    none = F.lit(None).cast("string")
    label = lambda name, kind, above: F.concat(name, F.lit(" — "), kind, F.lit(", "), above)
    kind = F.when(F.col("t") == "kota", TYPES["kota"]).otherwise(TYPES["kab"])
    upper = r.select(F.col("n").alias("kueri"), label(F.col("n"), kind, F.col("provinsi")).alias("label"), "provinsi", F.col("t").alias("tipe"), none.alias("induk"), F.lower(F.concat_ws(" ", "n", "provinsi")).alias("cari"))
    d = r.select("provinsi", "n", F.explode("kec").alias("k")).select("provinsi", "n", F.col("k.n").alias("k"))
    lower = d.select(F.concat_ws(", ", "k", "n").alias("kueri"), label(F.col("k"), F.lit(TYPES["kec"]), F.col("n")).alias("label"), "provinsi", F.lit("kec").alias("tipe"), F.col("n").alias("induk"), F.lower(F.concat_ws(" ", "k", "n", "provinsi")).alias("cari"))
    return upper.unionByName(lower)


def flat_words(sectors):
    """One row per search word of nested sectors (nama, keywords): kueri, label, sektor, alasan ('' if none), cari."""
    k = sectors.select(F.col("nama").alias("sektor"), F.explode("keywords").alias("k")).select("sektor", F.col("k.k").alias("kueri"), F.coalesce("k.alasan", F.lit("")).alias("alasan"))
    return k.select("kueri", F.concat("kueri", F.lit(" — "), "sektor").alias("label"), "sektor", "alasan", F.lower(F.concat("kueri", F.lit(" "), "sektor", F.lit(" "), "alasan")).alias("cari"))


def rules(spark, islands=X.ISLANDS, metros=X.METROS, cities=X.CITIES):
    """Shortcuts as rows: kelompok, pintasan, on (which key of a place), nilai, guard (its province; null: any)."""
    rows = [("favorit", metros[0][0], "nama", n, metros[0][2]) for n in metros[0][1]] + [("favorit", "Kota besar", "nama", n, None) for n in cities] + [("favorit", "Semua kec. Jakarta", "induk", "Jakarta", None)]
    rows += [("Pulau", island, "provinsi", p, None) for island, provinces in islands.items() for p in provinces]
    rows += [("Metropolitan", name, "nama", n, guard) for name, members, guard in metros for n in members]
    rows += [("Tipe wilayah", f"Semua {word}", "tipe", t, None) for word, t in (("kota", "kota"), ("kabupaten", "kab"), ("kecamatan", "kec"))]
    return spark.createDataFrame(rows, "kelompok string, pintasan string, `on` string, nilai string, guard string")


def shortcuts(places, rule):
    """Places of each shortcut (kelompok, pintasan, kueri, provinsi, tipe): regencies by name, province and type, districts by type and the first word of their parent."""
    top = F.col("tipe") != "kec"
    key = lambda on, value, ok=True: F.when(ok, F.struct(F.lit(on).alias("on"), value.alias("nilai")))
    keys = F.array_compact(F.array(key("nama", F.col("kueri"), top), key("provinsi", F.col("provinsi"), top), key("tipe", F.col("tipe"), F.lit(True)), key("induk", F.split("induk", " ")[0], F.col("induk").isNotNull())))
    x = places.select("kueri", "provinsi", "tipe", F.inline(keys))
    x = x.join(F.broadcast(rule), ["on", "nilai"]).where(F.col("guard").isNull() | (F.col("guard") == F.col("provinsi")))  # one row per fixed rule
    return x.select("kelompok", "pintasan", "kueri", "provinsi", "tipe")


def place_library(spark, d):
    """The places of all customers as JSON documents, one per province, read back in the library's nested form."""
    p = view(spark, d, "places").distinct().groupBy("provinsi", "wilayah", "tipe").agg(F.array_sort(F.collect_list(F.struct(F.col("kecamatan").alias("n")))).alias("kec"))
    lib = p.groupBy("provinsi").agg(F.collect_list(F.struct(F.col("wilayah").alias("n"), F.col("tipe").alias("t"), "kec")).alias("wilayah"))
    return lib.select(F.from_json(F.to_json(F.struct(F.col("provinsi").alias("nama"), "wilayah")), PLACES).alias("x")).select("x.*")


def q_library(spark, d):
    return flat_places(place_library(spark, d))


def q_words(spark, d):
    """Search words of each market segment: the categories of its listings, with what is known of them as reason."""
    v = view(spark, d, "listings").where("kategori is not null").select(F.split("nama_bisnis", " ")[1].alias("s"), F.col("kategori").alias("k"), F.col("rentang_harga").alias("alasan"))
    k = v.groupBy("s", "k").agg(F.nullif(F.min("alasan"), F.lit("")).alias("alasan"))
    lib = k.groupBy("s").agg(F.collect_list(F.struct("k", "alasan")).alias("keywords"))
    nested = lib.select(F.from_json(F.to_json(F.struct(F.col("s").alias("nama"), "keywords")), WORDS).alias("x")).select("x.*")
    return flat_words(nested)


def q_shortcuts(spark, d):
    return shortcuts(flat_places(place_library(spark, d)), rules(spark))


def build():
    quoted = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
    flat = "pl AS (SELECT DISTINCT * FROM v_places), fl AS (SELECT DISTINCT wilayah AS kueri, provinsi, tipe, NULL::VARCHAR AS induk FROM pl UNION ALL SELECT concat(kecamatan, ', ', wilayah), provinsi, 'kec', wilayah FROM pl)"
    pick = lambda group, name, where: f"SELECT '{group}' AS kelompok, '{name}' AS pintasan, kueri, provinsi, tipe FROM fl WHERE {where}"
    metro = lambda m: f"tipe <> 'kec' AND kueri IN {quoted(m[1])}" + (f" AND provinsi = '{m[2]}'" if m[2] else "")
    parts = [pick("favorit", X.METROS[0][0], metro(X.METROS[0])), pick("favorit", "Kota besar", f"tipe <> 'kec' AND kueri IN {quoted(X.CITIES)}"), pick("favorit", "Semua kec. Jakarta", "tipe = 'kec' AND induk LIKE 'Jakarta%'")]
    parts += [pick("Pulau", n, f"tipe <> 'kec' AND provinsi IN {quoted(p)}") for n, p in X.ISLANDS.items()] + [pick("Metropolitan", m[0], metro(m)) for m in X.METROS]
    parts += [pick("Tipe wilayah", f"Semua {n}", f"tipe = '{t}'") for n, t in (("kota", "kota"), ("kabupaten", "kab"), ("kecamatan", "kec"))]
    return {
        "io7_place_library": (q_library, with_views("WITH pl AS (SELECT DISTINCT * FROM v_places) SELECT DISTINCT wilayah AS kueri, concat(wilayah, ' — ', CASE tipe WHEN 'kota' THEN 'Kota' ELSE 'Kab.' END, ', ', provinsi) AS label, provinsi, tipe, NULL::VARCHAR AS induk, lower(concat(wilayah, ' ', provinsi)) AS cari FROM pl UNION ALL SELECT concat(kecamatan, ', ', wilayah), concat(kecamatan, ' — Kec., ', wilayah), provinsi, 'kec', wilayah, lower(concat(kecamatan, ' ', wilayah, ' ', provinsi)) FROM pl", "places")),
        "io7_search_words": (q_words, with_views("WITH k AS (SELECT split_part(nama_bisnis, ' ', 2) AS sektor, kategori AS kueri, coalesce(min(rentang_harga), '') AS alasan FROM v_listings WHERE kategori IS NOT NULL GROUP BY ALL) SELECT kueri, concat(kueri, ' — ', sektor) AS label, sektor, alasan, lower(concat(kueri, ' ', sektor, ' ', alasan)) AS cari FROM k", "listings")),
        "flt5_place_shortcuts": (q_shortcuts, with_views(f"WITH {flat} " + " UNION ALL ".join(parts), "places")),
    }
