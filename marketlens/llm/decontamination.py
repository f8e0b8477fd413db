"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every run of W consecutive K-gram hashes keeps its least hash as a fingerprint. A span of
K + W - 1 = WINDOW equal words has an equal run, hence an equal fingerprint, so joining the
fingerprints of documents and items misses no shared window. Documents that share one are read
again, and their hits are extended: every window of WINDOW words (or a whole shorter item) is
compared word by word, and the hit words are the union of the windows found.

Fingerprints and comparison fold A-Z only: Unicode lower case of a capital sigma depends on letters
beyond the marks that break words here, so equal words would not stay equal.
Items of fewer words than WINDOW have one window, their whole sequence, and are looked up by hashes
of that many words. The benchmark's side of a join is broadcast only up to SMALL rows.

Null and empty texts have no words and no hits. Equal rows are judged once and returned each. Null
item ids and items without words hit nothing. Further columns are kept by remove() and ignored else.
"""

from pyspark.sql import functions as F

from marketlens.llm.common import checkpointed, each, row_keys, sized, table

WINDOW = 10
K = 5
W = WINDOW - K + 1
SMALL = 1_000_000  # rows of fingerprints (or document keys) that may be broadcast
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def folded():
    """The text with A-Z in lower case."""
    return F.translate("text", UPPER, UPPER.lower())


def word_array(text):
    """Words as they are written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAK), "")


def gram_hashes(words, size):
    """Hashes of all runs of `size` words, as an array; empty if there are fewer."""
    seed = F.lit(size)
    grams = F.transform(words, lambda x, i: F.xxhash64(seed, x, *(F.get(words, i + j) for j in range(1, size))))
    return F.slice(grams, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0)))


def winnowed(grams):
    """The least hash of each run of W hashes, each once."""
    runs = F.transform(grams, lambda x, i: F.least(x, *(F.get(grams, i + j) for j in range(1, W))))
    return F.array_distinct(F.slice(runs, F.lit(1), F.greatest(F.size(grams) - (W - 1), F.lit(0))))


def fingerprints(frame, short):
    """The frame with column fps: winnowed hashes, and hashes of the short lengths in use."""
    frame = frame.withColumn("grams", gram_hashes(F.col("words"), K))
    parts = [winnowed(F.col("grams")), *(gram_hashes(F.col("words"), m) for m in short)]
    return frame.withColumn("fps", F.concat(*parts)).drop("grams")


def window_texts(words, size):
    """(start, words joined by a space) of all runs of `size` words."""
    n = F.size(words) - size
    runs = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(i.alias("start"), F.lit(size).alias("size"), F.array_join(F.slice(words, i + 1, size), " ").alias("gram")))
    return F.when(n >= 0, runs).otherwise(F.array().cast("array<struct<start:int,size:int,gram:string>>"))


def item_windows(benchmark):
    """(gram, size, item_id) of every window of every item."""
    items = benchmark.where("item_id is not null").select("item_id", word_array(folded()).alias("words")).where(F.size("words") > 0)
    n = F.least(F.size("words"), F.lit(WINDOW))
    runs = F.transform(F.sequence(F.lit(0), F.size("words") - n), lambda i: F.array_join(F.slice("words", i + 1, n), " "))
    return each(items, ["item_id", n.alias("size")], runs, "gram").distinct()


def hits(docs, benchmark):
    """Per hit document text: keys, the windows hit (start, size) and the ids of their items.

    Only fingerprints that meet one of the benchmark's leave the first join, whichever way it runs; where
    the benchmark is too large to broadcast, a fingerprint that very many documents hold is one key
    of a shuffle join, which Spark splits.
    """
    windows = checkpointed(item_windows(benchmark))
    short = sorted(r["size"] for r in windows.where(F.col("size") < WINDOW).select("size").distinct().collect())
    items = benchmark.where("item_id is not null").select(word_array(folded()).alias("words")).where(F.size("words") > 0)
    long_ = fingerprints(items.where(F.size("words") >= WINDOW), [])
    found = each(long_, [], "fps", "fp")
    for m in short:
        found = found.unionByName(each(items.where(F.size("words") == m), [], gram_hashes(F.col("words"), m), "fp"))
    found, _ = sized(checkpointed(found.distinct()), SMALL)

    rows = row_keys(docs.select("doc_id", "text")).withColumn("words", word_array(folded()))
    rows = each(fingerprints(rows, short), ["__row_doc", "__row_text"], "fps", "fp")
    shared = rows.join(found, "fp").select("__row_doc", "__row_text").distinct()

    candidates, _ = sized(checkpointed(shared), SMALL)
    texts = row_keys(docs.select("doc_id", "text")).join(candidates, ["__row_doc", "__row_text"], "left_semi").dropDuplicates(["__row_doc", "__row_text"])
    texts = texts.select("__row_doc", "__row_text", word_array(folded()).alias("words"))
    runs = F.concat(*(window_texts(F.col("words"), m) for m in [*short, WINDOW]))
    runs = each(texts, ["__row_doc", "__row_text"], runs, "w").select("__row_doc", "__row_text", "w.*")
    side, _ = sized(windows, SMALL, "gram")
    met = runs.join(side, ["gram", "size"])
    spans = met.groupBy("__row_doc", "__row_text").agg(F.collect_set(F.struct("start", "size")).alias("windows"), F.collect_set(F.col("item_id").cast("string")).alias("items"))
    return checkpointed(spans)


def covered(windows):
    """How many words the union of windows (start, size) holds."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda a, w: F.struct(F.greatest(a["end"], w["start"] + w["size"]).alias("end"), (a["n"] + F.greatest(F.lit(0), w["start"] + w["size"] - F.greatest(a["end"], w["start"]))).alias("n"))
    return F.aggregate(F.array_sort(windows), start, step, lambda a: a["n"])


def judge(docs, benchmark):
    """doc_id, n_words, n_hit, items (ids as sorted strings) and contaminated, of every row."""
    found, _ = sized(hits(docs, benchmark).select("__row_doc", "__row_text", covered(F.col("windows")).alias("n_hit"), F.array_join(F.array_sort("items"), "\x00").alias("items")), SMALL // 10, "items")
    n_words = F.size(word_array(F.col("text"))).cast("long")
    rows = row_keys(docs.select("doc_id", "text")).select("doc_id", "__row_doc", "__row_text", n_words.alias("n_words")).join(found, ["__row_doc", "__row_text"], "left")
    items = F.when(F.col("items").isNull(), F.array().cast("array<string>")).otherwise(F.split("items", "\x00"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items")).withColumn("contaminated", F.col("n_hit") > 0)


def remove(docs, benchmark):
    """The documents without a shared window, with all their columns."""
    bad, _ = sized(hits(docs, benchmark).select("__row_doc", "__row_text"), SMALL)
    return row_keys(docs).join(bad, ["__row_doc", "__row_text"], "left_anti").select(*docs.columns)


def query(spark, sf_dir):
    """op8: words, hit words and the items hit of every document."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS g FROM b WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, m, unnest(CASE WHEN len(ws) >= m THEN list_transform(range(1, len(ws) - m + 2), lambda i: {'s': i, 'g': array_to_string(ws[i:i + m - 1], ' ')}) ELSE [] END) AS x FROM d, ms),
h AS (SELECT doc_id, dw.m AS m, x.s AS s, item_id FROM dw JOIN bw ON bw.m = dw.m AND bw.g = x.g),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
