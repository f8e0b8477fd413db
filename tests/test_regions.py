"""Libraries of places and words from nested rows, and shortcuts where names are ambiguous."""

from pyspark.sql import functions as F

from marketlens.operators import regions

LIBRARY = [
    ("Jawa Barat", [("Banjar", "kota", [("Pataruman",)]), ("Kabupaten Bogor", "kab", None), ("Bogor", "kota", [])]),
    ("Kalimantan Selatan", [("Banjar", "kab", [("Martapura",), ("Astambul",)]), ("Banjarmasin", "kota", None)]),
    ("DKI Jakarta", [("Jakarta Pusat", "kota", [("Gambir",), ("Senen",)])]), ("Papua", []), ("Riau", None),
]


def places(spark):
    return regions.flat_places(spark.createDataFrame(LIBRARY, regions.PLACES))


def test_places(spark):
    rows = {r.kueri + "/" + r.provinsi: tuple(r) for r in places(spark).collect()}
    assert len(rows) == 11
    assert rows["Bogor/Jawa Barat"] == ("Bogor", "Bogor — Kota, Jawa Barat", "Jawa Barat", "kota", None, "bogor jawa barat")
    assert rows["Gambir, Jakarta Pusat/DKI Jakarta"] == ("Gambir, Jakarta Pusat", "Gambir — Kec., Jakarta Pusat", "DKI Jakarta", "kec", "Jakarta Pusat", "gambir jakarta pusat dki jakarta")


def test_shortcuts(spark):
    found = {}
    for r in regions.shortcuts(places(spark), regions.rules(spark)).collect():
        found.setdefault(r.pintasan, []).append((r.kueri, r.provinsi))
    assert found["Banjar Bakula"].count(("Banjar", "Kalimantan Selatan")) == 1 and ("Banjar", "Jawa Barat") not in found["Banjar Bakula"]
    assert sorted(x for x, _ in found["Jabodetabek"]) == ["Bogor", "Bogor", "Jakarta Pusat", "Jakarta Pusat", "Kabupaten Bogor", "Kabupaten Bogor"]  # a favourite and a metropolitan area
    assert sorted(x for x, _ in found["Semua kec. Jakarta"]) == ["Gambir, Jakarta Pusat", "Senen, Jakarta Pusat"]
    assert len(found["Jawa"]) == 4 and len(found["Semua kota"]) == 4 and len(found["Semua kabupaten"]) == 2 and len(found["Semua kecamatan"]) == 5
    assert "Papua" not in found and sorted(x for x, _ in found["Kota besar"]) == ["Banjarmasin", "Bogor", "Jakarta Pusat"]


def test_words(spark):
    lib = spark.createDataFrame([("Kesehatan", [("klinik gigi", "nilai tinggi"), ("apotek", None)]), ("Kosong", []), ("Tanpa", None)], regions.WORDS)
    rows = {tuple(r) for r in regions.flat_words(lib).collect()}
    assert rows == {("klinik gigi", "klinik gigi — Kesehatan", "Kesehatan", "nilai tinggi", "klinik gigi kesehatan nilai tinggi"), ("apotek", "apotek — Kesehatan", "Kesehatan", "", "apotek kesehatan ")}


def test_empty_and_extra_columns(spark):
    lib = spark.createDataFrame(LIBRARY, regions.PLACES).withColumn("kueri", F.lit("x")).withColumn("n", F.lit(1))
    assert regions.flat_places(lib).count() == 11 and regions.flat_places(lib.limit(0)).count() == 0
    assert regions.shortcuts(places(spark).limit(0), regions.rules(spark)).count() == 0
