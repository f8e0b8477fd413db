"""Greedy admission, distributed ranks, the change log, buckets and the stream of admissions, against plain forms."""

import datetime
import os
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.functions.ranks import after, numbered, page
from marketlens.operators import buckets, greedy, history, ledger, runs
from marketlens.streaming import jobs

EVENTS = "user_id long, ts timestamp, event_id long"
START = datetime.datetime(2024, 1, 1)


def folded(rows, days):
    """The rule, event by event."""
    out, last = set(), {}
    for u, t, i in sorted((r for r in set(rows) if r[1] is not None and r[2] is not None), key=lambda r: (int(r[1].timestamp()), r[2])):
        s = int(t.timestamp())
        if u not in last or s - last[u] > days * 86400:
            last[u] = s
            out.add((u, i))
    return out


def events(n, users, hours, seed=1):
    r = random.Random(seed)
    return [(1 if r.random() < 0.9 else r.choice(users), START + datetime.timedelta(seconds=r.randrange(hours * 3600)), k) for k in range(n)]


@pytest.mark.parametrize(("days", "hours"), [(7, 24 * 60), (1, 24 * 90), (400, 24 * 30)])
def test_greedy_admission(spark, days, hours):
    rows = events(1500, [2, 3, 4, None], hours)
    rows += [(5, START, 9001), (5, START, 9000), (5, START + datetime.timedelta(days=days), 9002), (5, START + datetime.timedelta(days=days, seconds=1), 9003)]  # exactly the span is too early
    rows += rows[:20] + [(6, None, 9004), (6, START, None), (7, START, 9005)]
    got = [(r.user_id, r.event_id) for r in greedy.admitted(spark.createDataFrame(rows, EVENTS).repartition(5), days).collect()]
    assert len(got) == len(set(got)) and set(got) == folded(rows, days)


def test_greedy_admission_of_nothing(spark):
    assert greedy.admitted(spark.createDataFrame([], EVENTS)).count() == 0


def test_greedy_plan_holds_no_list(spark):
    plan = greedy.jumps(spark.createDataFrame([(1, 5, 1)], "u long, t long, i long"), 604800)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "hashpartitioning(u" in plan


def test_numbered_equals_window(spark):
    rows = spark.range(3000).select("id", (F.col("id") * 7919 % 50).alias("a"), F.when(F.col("id") % 9 > 0, F.col("id") % 13).alias("b")).repartition(7)
    order = [F.desc("a"), F.asc_nulls_last("b"), "id"]
    got = numbered(rows, order, parts=6)
    want = rows.withColumn("urut", F.row_number().over(Window.orderBy(*order)).cast("long"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    plan = rows.repartitionByRange(6, *order).sortWithinPartitions(*order)._jdf.queryExecution().toString()
    assert "rangepartitioning" in plan and "SinglePartition" not in plan
    assert numbered(rows.limit(0), order).count() == 0
    assert [r.urut for r in numbered(spark.range(1), ["id"], parts=4).collect()] == [1]


def test_pages_cover_everything_once(spark):
    rows = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("a"))
    for up in (True, False):
        keys, last, got = [("a", up), ("id", True)], None, []
        while True:
            found = page(rows, keys, 7, last).collect()
            if not found:
                break
            got += [tuple(r) for r in found]
            last = (found[-1].a, found[-1].id)
        order = F.asc("a") if up else F.desc("a")
        assert got == [tuple(r) for r in rows.orderBy(order, "id").collect()]
    assert after(rows, [("id", True)], None).count() == 100


def test_lead_pages(spark):
    kind = "place_key string, nama_bisnis string, alamat string, kategori string, tier string, jasa_utama string, area_pencarian string, status_leads string, whatsapp_link string, skor_pembeli int, jumlah_ulasan int, rating double, first_seen_at string"
    rows = [(f"k{i}", f"Nama {i % 4}", None if i % 3 else "Jl. Melati", "Kafe", "PANAS" if i % 2 else None, None, f"A{i % 3}", None, "wa" if i % 5 else "", i % 7 or None, i % 6, i / 10, f"2024-01-{1 + i % 9:02d}") for i in range(40)]
    b = spark.createDataFrame(rows, kind)
    for urut in [*runs.SORTS, "lain"]:
        last, seen = None, []
        while True:
            found, last = runs.lead_page(b, urut, 9, last, punya_wa=True)
            if last is None:
                break
            seen += [r.place_key for r in found.collect()]
        assert len(seen) == len(set(seen)) == sum(i % 5 > 0 for i in range(40))
    n = lambda **f: runs.lead_filter(b, **f).count()
    assert (n(tier="PANAS"), n(area="A1"), n(q="melati"), n(q="KAFE"), n(skor_min=6), n(skor_max=0), n(status_leads="x")) == (20, 13, 14, 40, 5, 6, 0)


def test_change_log_by_day(spark, tmp_path):
    b = spark.createDataFrame([("a", "1", "w", None, "2020"), ("b", "2", "", "m", None), ("c", "3", "x", "", "2021")], "place_key string, telepon string, website string, email string, last_checked_at string")
    card = lambda rows: spark.createDataFrame(rows, "seq int, place_key string, telepon string, website string, email string")
    at = str(tmp_path / "log")
    one, changes = history.refreshed(b, card([(1, "a", "9", "-", "n/a"), (2, "a", "8", "z", ""), (3, "b", "2", "v", None), (4, "", "7", "7", "7")]), "2024-01-01 10:00:00")
    history.appended(changes, "2024-01-01 10:00:00", at)
    assert sorted(map(tuple, one.collect())) == [("a", "9", "w", None, "2024-01-01 10:00:00"), ("b", "2", "v", "m", "2024-01-01 10:00:00"), ("c", "3", "x", "", "2021")]
    two, changes = history.refreshed(one, card([(1, "a", "5", "", ""), (2, "c", " 3 ", "y", "q")]), "2024-02-01 10:00:00")
    history.appended(changes, "2024-02-01 10:00:00", at)
    log = history.log(spark, at)
    assert sorted((r.place_key, r.field, r.lama, r.baru, r.changed_at.month) for r in log.collect()) == [("a", "telepon", "1", "9", 1), ("a", "telepon", "9", "5", 2), ("b", "website", "", "v", 1), ("c", "email", "", "q", 2), ("c", "website", "x", "y", 2)]
    assert history.changed_in(log, "2024-02-02 00:00:00").first().n == 2 and history.changed_in(log, "2024-02-02 00:00:00", 40).first().n == 3
    plan = history.since(log, "2024-02-02 00:00:00", 30)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(hari" in plan
    assert [(r.n, r.place_key) for r in history.latest(log, 3).collect()] == [(1, "a"), (2, "c"), (3, "c")]
    detail = {r.place_key: [x.baru for x in r.riwayat] for r in history.detail(two, log, 1).collect()}
    assert detail == {"a": ["5"], "b": ["v"], "c": ["q"]}


def files(at):
    return {f"{d}/{f}" for d, _, names in os.walk(at) for f in names if f.endswith(".parquet")}


def test_feed_rewrites_only_its_buckets(spark, tmp_path):
    at = str(tmp_path / "table")
    rows = spark.range(500).select(F.concat(F.lit("k"), "id").alias("place_key"), F.lit("n").alias("nama_bisnis"), F.lit(1).alias("times_seen"), F.lit("2020").alias("last_scraped_at"), F.lit("x").alias("status_leads"), F.lit(None).cast("int").alias("skor_pembeli"))
    buckets.create(rows, at, "place_key", 16)
    before = files(f"{at}/data")
    feed = spark.createDataFrame([("k3", 1, "neu", "y"), ("k3", 2, None, "y"), ("k9999", 1, "da", "y"), ("", 1, "no", "y"), (None, 1, "no", "y")], "place_key string, seq int, nama_bisnis string, status_leads string")
    score = lambda r: r.withColumn("skor_pembeli", F.coalesce("skor_pembeli", F.length("nama_bisnis")))
    touched = buckets.upserted(spark, at, feed, "place_key", ["seq"], keep=("status_leads",), now="2024", buckets=16, score=score)
    assert 1 <= len(touched) <= 2
    new = files(f"{at}/data") - before
    assert before <= files(f"{at}/data") and len(new) == len(touched) and all(any(f"bucket={b}/" in f for b in touched) for f in new)
    want = score(ledger.upsert(rows, feed, "place_key", ["seq"], keep=("status_leads",), now="2024"))
    plain = lambda df: {r.place_key: (r.nama_bisnis, r.times_seen, r.last_scraped_at, r.status_leads) for r in df.collect()}
    got = buckets.read(spark, at)
    assert plain(got) == plain(want) and got.count() == 501
    assert got.where("place_key = 'k3'").first().skor_pembeli == 3  # computed at the write, for a row without one
    assert buckets.upserted(spark, at, feed.where("false"), "place_key", ["seq"], buckets=16) == []
    os.makedirs(f"{at}/manifest/v2")  # a write that ended half-way
    assert buckets.read(spark, at).count() == 501


def run(spark, at, days, **options):
    source = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    q = jobs.admissions(source, days, "1 day").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    jobs.finish(q)
    return q


def test_stream_of_admissions(spark, tmp_path):
    """Batches in time order, a restart, late rows, and state that ends with the memory."""
    rows, at = events(900, [2, 3, 4], 24 * 60, seed=4), str(tmp_path)
    rows.append((77, START, 5000))  # seen once, then never again
    rows.sort(key=lambda r: r[1])
    parts = [rows[i : i + 181] for i in range(0, len(rows), 181)]
    put = lambda k, part: spark.createDataFrame(part, EVENTS).coalesce(1).write.parquet(f"{at}/in/part={k}")
    for k, part in enumerate(parts[:3]):
        put(k, part)
    os.makedirs(f"{at}/in", exist_ok=True)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    run(spark, at, 7)
    for k, part in enumerate(parts[3:], 3):
        put(k, part)
    put(99, [(2, START + datetime.timedelta(hours=3), 6000), (88, START, 6001)])  # older than the watermark
    last = run(spark, at, 7)
    got = {(r.user_id, r.event_id) for r in spark.read.parquet(f"{at}/out").collect()}
    assert got == folded(rows, 7)
    held = last.lastProgress["stateOperators"][0]["numRowsTotal"]
    assert held <= 4  # user 77 has left the memory


@pytest.mark.parametrize("name", ["ded5_greedy_admission", "st2_admission"])
def test_admission_counts_seconds_as_its_sql(spark, tmp_path, name):
    """Times with fractions around the span: the SQL rounds to the nearest second, half to even."""
    import duckdb

    from marketlens import registry

    week, r = 604800, random.Random(3)
    micros = [(1, 400_000), (1, week * 10**6 + 600_000), (2, 600_000), (2, (week + 1) * 10**6 + 400_000), (3, 500_000), (3, week * 10**6 + 1_500_000), (4, 1_500_000), (4, (week + 2) * 10**6 + 500_000)]
    micros += [(u, k * (week + 1) * 500_000 + r.randrange(1_000_000)) for u in range(5, 25) for k in range(12)]
    rows = [(u, START + datetime.timedelta(microseconds=m), i) for i, (u, m) in enumerate(micros)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT user_id, ts::TIMESTAMP AS ts, event_id FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(registry.oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == want


def test_price_changes_over_batches(spark, tmp_path):
    """Batches carry the last recorded row of each product on; no product costs a Python call."""
    r = random.Random(5)
    rows = [(f"p{r.randrange(6)}", k, r.choice([None, 0, 10, 20]), r.choice([None, 0, 1])) for k in range(120)]
    kind = "product_key string, seq long, harga long, terjual long"
    for b in range(0, 120, 40):
        spark.createDataFrame(rows[b : b + 40], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(kind).parquet(f"{tmp_path}/in")
        jobs.finish(jobs.price_changes(stream, f"{tmp_path}/out"))
    last, want = {}, []
    for key, seq, price, sold in rows:
        if price and last.get(key) != (price, sold or 0):
            last[key] = (price, sold or 0)
            want.append((key, seq, price, sold or 0))
    got = jobs.changes(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert len(os.listdir(f"{tmp_path}/out")) == 3
