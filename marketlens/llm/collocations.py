"""Phrase collocations by dynamic itemset counting.

The documents are dealt into SHARDS, which are scanned in turn, again and again. Words are counted from
the first scan on. A longer phrase becomes active once both phrases it is made of (without its last
and without its first word) have reached the threshold in what was scanned so far; it is counted
from the next scan on, while shorter and longer ones still go on, until each has seen every shard
once. A phrase that reaches the threshold in the whole corpus has parts that do, so none is missed.

In a scan tasks count the active phrases of their texts, counts are summed by phrase and merged with
those that are still open, which are written to the shared folder. Of each phrase the sum, its first
scan and the scan in which it reached the threshold are kept. Which phrases are active is told to the
tasks by a table of FILTER buckets at most: the earliest and the latest such scan among the phrases of
a bucket. Once it admits a phrase, which is never too late, it does so for a whole round at least. So a phrase is complete SHARDS
scans after its first one; below the threshold it is then forgotten, else set aside. What a bucket admits
once more later gives no larger count, and the largest one holds.

Words lie in pieces without punctuation, all counting is by language (words of two languages have different
hashes). A null text has no words, a null language is `und`, words of any length count. Repeated rows
count as often as they stand; ids and other columns are ignored. No words: no rows.
"""

import functools
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import checkpoint_folder, checkpointed, lean, table

LEAST = 10  # occurrences of a candidate
SHARE = 50  # percent of a phrase's occurrences that lie in a longer candidate which takes its place
TOP = 2000
SHARDS = 2
FILTER = 1 << 22
COMMON = 10_000  # phrases with more than one in so many words of the corpus are sent to every task
KEY = ["w1", "w2", "w3"]  # words of a phrase by their hashes; 0 behind the last one
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes
IS_BREAK = np.isin(np.arange(256), T.BREAKS)
LATE = 255  # in the filter, where no phrase of a bucket has reached the threshold; numbers of scans are below


def bucket(w1, w2):
    """Place of a word (w2: 0) or a pair in the filter; the same rule as bucket_of()."""
    return (w1 ^ (w2 >> T.U(7))) & T.U(FILTER - 1)


def bucket_of():
    return F.col("w1").bitwiseXOR(F.shiftrightunsigned("w2", 7)).bitwiseAND(F.lit(FILTER - 1))


def word_hashes(data, starts, ends):
    """64-bit hashes of words with A-Z lower-cased, eight bytes at a time; words of up to eight bytes and one size never share one."""
    padded = np.concatenate([LOWER[data], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    at, left = starts, ends - starts
    out, own = left.astype(T.U), np.arange(len(starts))
    while len(own):
        out[own] = T.mix(out[own] ^ (eight[at] & MASKS[np.minimum(left, 8)]))
        own, at, left = own[left > 8], at[left > 8] + 8, left[left > 8] - 8
    return out


def phrase_words(part):
    """Of a batch: bytes, word starts and ends, 64-bit hashes of word and language, text of each word, whether the next word follows in its piece."""
    data, offsets = T.utf8(part.column("text"))
    starts, ends, first = T.word_spans(data, offsets, "phrase")
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.cumsum(IS_BREAK[data], dtype=np.int32)
    follows = np.zeros(len(starts), bool)
    follows[:-1] = (owner[1:] == owner[:-1]) & (breaks[starts[1:]] == breaks[ends[:-1] - 1])
    names = part.column("lang").dictionary_encode()
    letters, at = T.utf8(names.dictionary)
    lang = word_hashes(letters, at[:-1], at[1:])
    own = T.mix(lang + T.U(0x9E3779B97F4A7C15))[names.indices.to_numpy(zero_copy_only=False)]  # apart from the hash of a word of the same letters
    return data, starts, ends, T.mix(word_hashes(data, starts, ends) ^ own[owner]), owner, follows


def active(reached_a, reached_b, scan):
    """Whether phrases may be active: begun (after both parts reached the threshold) and not yet through all shards."""
    return (np.maximum(reached_a[0], reached_b[0]) < scan) & (np.maximum(reached_a[1], reached_b[1]) >= max(0, scan - SHARDS))


def counted(columns):
    """Distinct rows of hashes: place of one of each, and how many there are."""
    if not len(columns[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    names = pa.array(functools.reduce(lambda h, c: h * T.U(0x9E3779B97F4A7C15) + c, columns)).dictionary_encode()
    where = names.indices.to_numpy()
    place = np.empty(len(names.dictionary), np.int64)
    place[where] = np.arange(len(where))
    return place, np.bincount(where)


def _words(batches):
    """Counts of the words of each run of texts."""
    for batch in batches:
        for part in T.slices(batch, "text", 4 * T.CHUNK):
            data, starts, ends, h, owner, _ = phrase_words(part)
            first, n = counted([h])
            text = data.tobytes()
            spelled = [text[a:b].lower().decode() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), part.column("lang").take(pa.array(owner[first])), pa.array(spelled, pa.string()), pa.array(n)], ["w1", "lang", "word", "n"])


def _phrases(scan, shared):
    """Counts of the active phrases of two and three words of each run of texts."""

    def work(batches):
        held = shared.value
        words, pairs = (laid_out(*x) for x in held)
        for batch in batches:
            for part in T.slices(batch, "text", 4 * T.CHUNK):
                _, _, _, h, _, follows = phrase_words(part)
                at = np.flatnonzero(follows)
                at, last = at[:0] if not len(held[0][0]) else at, len(h) - 2
                one = bucket(h, T.U(0))
                one = words[0][one], words[1][one]
                two = at[active([x[at] for x in one], [x[at + 1] for x in one], scan)]
                three = at[(at < last) & follows[np.minimum(at + 1, len(h) - 1)]] if len(held[1][0]) else at[:0]
                if len(three):  # a pair of active phrases follows another
                    two_at = np.zeros((2, len(h)), np.uint8)
                    two_at[0] = LATE
                    some = np.zeros(len(h), bool)
                    some[three] = some[three + 1] = True
                    some = np.flatnonzero(some)
                    place = bucket(h[some], h[some + 1])
                    two_at[0, some], two_at[1, some] = pairs[0][place], pairs[1][place]
                    three = three[active(two_at[:, three], two_at[:, three + 1], scan)]
                for place, size in ((two, 2), (three, 3)):
                    columns = [h[place + k] for k in range(size)]
                    first, n = counted(columns)
                    columns += [np.zeros(len(h), T.U)] * (3 - size)
                    yield pa.RecordBatch.from_arrays([*(pa.array(c[first].view(np.int64)) for c in columns), pa.array(n)], [*KEY, "n"])

    return lean(work)


def laid_out(place, lo, hi):
    """Both numbers of every bucket; LATE and 0 where it has none."""
    out = np.zeros((2, FILTER), np.uint8)
    out[0] = LATE
    out[0, place], out[1, place] = lo, hi
    return out


class Reached:
    """The filter of words or pairs as it grows: bounded by FILTER, whatever the corpus holds."""

    def __init__(self):
        self.scans, self.last = laid_out([], [], []), -1

    def add(self, rows, scan):
        """The buckets of phrases that reached the threshold in this scan."""
        place = rows.where(F.col("reached") == scan).select(bucket_of().alias("b")).distinct().toArrow().column("b").to_numpy()
        self.scans[0, place], self.scans[1, place] = np.minimum(self.scans[0, place], scan), scan
        self.last = scan if len(place) else self.last

    def sparse(self):
        place = np.flatnonzero(self.scans[0] != LATE).astype(np.int32)
        return place, self.scans[0, place], self.scans[1, place]


def dealt(docs, folder):
    """The texts with a language, in SHARDS folders of equal size; each scan reads one of them."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text is not null")
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(SHARDS)).cast("int")).write.partitionBy("shard").option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.schema("lang string, text string, shard int").parquet(folder)


def written(rows, folder):
    """The rows as a table in the shared folder."""
    rows.write.option("parquet.enable.dictionary", "false").parquet(folder)  # hashes hardly repeat
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def removed(spark, folder):
    """Delete a table that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def merged(new, old, keys, scan, folder, least=LEAST):
    """Counts of this scan added to those of open phrases; what is complete must have `least` to stay."""
    rows = new.select(*keys, "n", F.lit(scan).alias("since"), F.lit(None).cast("int").alias("reached"))
    if old is not None:
        rows = rows.unionByName(old.where(F.col("since") + SHARDS > scan))
    rows = rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("since").alias("since"), F.max("reached").alias("reached"))
    rows = rows.where((F.col("n") >= least) | (F.col("since") + SHARDS > scan + 1))  # complete below the threshold: forgotten
    return written(rows.withColumn("reached", F.coalesce("reached", F.when(F.col("n") >= LEAST, F.lit(scan)))), folder)


def phrase_counts(docs):
    """Words (w1, lang, word, n) and candidates (w1, w2, w3, n): phrases of two and three words with LEAST occurrences."""
    spark, folder = docs.sparkSession, f"{checkpoint_folder(docs.sparkSession)}/phrases-{uuid.uuid4().hex}"
    shards = dealt(docs, f"{folder}/shards")
    words = phrases = None
    filters, done, scan = [Reached(), Reached()], [], 0
    while scan < SHARDS or scan <= min(max(f.last for f in filters) + SHARDS, 3 * SHARDS - 1):  # three rounds complete all
        rows = shards.where(F.col("shard") == scan % SHARDS).select("lang", "text")
        sent, before = [f.sparse() for f in filters], words
        if scan < SHARDS:
            new = rows.mapInArrow(lean(_words), "w1 long, lang string, word string, n long")
            words = merged(new, words, ["w1", "lang", "word"], scan, f"{folder}/words-{scan}", 0)
            filters[0].add(words.withColumn("w2", F.lit(0).cast("long")), scan)
        if len(sent[0][0]):
            shared, old = spark.sparkContext.broadcast(sent), phrases
            phrases = merged(rows.mapInArrow(_phrases(scan, shared), "w1 long, w2 long, w3 long, n long"), old, KEY, scan, f"{folder}/{scan}")
            shared.destroy()
            filters[1].add(phrases.where("w3 = 0"), scan)
            done.append(written(phrases.where((F.col("n") >= LEAST) & (F.col("since") + SHARDS <= scan + 1)).select(*KEY, "n"), f"{folder}/done-{scan}"))
            if old is not None:
                removed(spark, f"{folder}/{scan - 1}")
        if before is not None and words is not before:
            removed(spark, f"{folder}/words-{scan - 1}")
        scan += 1
    none = spark.createDataFrame([], "w1 long, w2 long, w3 long, n long")
    if phrases is not None:  # what began late has seen all shards too, where it occurs
        done.append(phrases.where(F.col("n") >= LEAST).select(*KEY, "n"))
    return words, functools.reduce(lambda a, b: a.unionByName(b), done, none).groupBy(*KEY).agg(F.max("n").alias("n"))


def score_of(a, left, right):
    """floor(1000000 a a / (left right)); decimals of 38 digits hold the products of two counts."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def looked_up(rows, w1, w2, parts, most, name):
    """The rows with the count of a word or pair. Counts of at least `most` are sent to every task; what they
    answer is dealt by the whole row afterwards, so no frequent part gathers its phrases in one task.
    """
    parts = parts.select(F.xxhash64("w1", "w2").alias("__part"), F.col("n").alias("__n"))
    common = F.broadcast(parts.where(F.col("__n") >= most).withColumnsRenamed({"__part": "__common", "__n": "__known"}))
    rows = rows.withColumn("__key", F.xxhash64(w1, w2)).join(common, F.col("__key") == F.col("__common"), "left")
    rows = rows.withColumn("__key", F.when(F.col("__known").isNull(), F.col("__key")).otherwise(F.xxhash64(*KEY, "k", F.lit(name))))
    rows = rows.join(parts.where(F.col("__n") < most), F.col("__key") == F.col("__part"), "left")
    return rows.withColumn(name, F.coalesce("__known", "__n")).drop("__key", "__common", "__known", "__part", "__n")


def mined(docs, top=TOP):
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    words, phrases = phrase_counts(docs)
    totals = checkpointed(words.groupBy("lang").agg(F.sum("n").alias("n")))
    candidates = checkpointed(phrases.withColumnRenamed("n", "a"))
    number = candidates.count()
    most = max(LEAST, math.ceil((totals.agg(F.sum("n")).first()[0] or 0) / COMMON))  # at most COMMON words and COMMON pairs have so many
    zero = F.lit(0).cast("long")
    often = words.where(F.col("n") >= LEAST)
    parts = often.select("w1", zero.alias("w2"), "n").unionByName(candidates.where("w3 = 0").select("w1", "w2", F.col("a").alias("n")))
    cut = lambda k, l1, l2, r1, r2: F.struct(F.lit(k).alias("k"), l1.alias("l1"), l2.alias("l2"), r1.alias("r1"), r2.alias("r2"))
    w1, w2, w3 = map(F.col, KEY)
    cuts = candidates.select(*KEY, "a", F.inline(F.when(w3 == 0, F.array(cut(1, w1, zero, w2, zero))).otherwise(F.array(cut(1, w1, zero, w2, w3), cut(2, w1, w2, w3, zero)))))
    cuts = looked_up(looked_up(cuts, "l1", "l2", parts, most, "l"), "r1", "r2", parts, most, "r")
    cuts = cuts.select(*KEY, "a", F.struct(score_of(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    inside = candidates.where("w3 <> 0").select(F.inline(F.array(F.struct("w1", "w2"), F.struct(w2.alias("w1"), w3.alias("w2")))), F.col("a").alias("longer")).withColumn("w3", zero)
    both = cuts.unionByName(inside, allowMissingColumns=True).groupBy(*KEY).agg(F.max("a").alias("a"), F.min("cut").alias("cut"), F.max("longer").alias("longer"))
    left = both.where(F.col("a").isNotNull() & (F.col("longer").isNull() | (100 * F.col("longer") < SHARE * F.col("a")))).select(*KEY, "a", "cut.score", "cut.l", "cut.r")
    # the language of a phrase is that of its first word; a frequent one is told to every task
    named = often.select(F.col("w1").alias("__w"), F.col("lang").alias("__lang"), "n")
    common = F.broadcast(named.where(F.col("n") >= most).select("__w", "__lang"))
    left = left.join(common, w1 == F.col("__w"), "left").withColumn("__key", F.when(F.col("__w").isNull(), w1).otherwise(F.xxhash64(*KEY))).drop("__w")
    rest = named.where(F.col("n") < most).select("__w", F.col("__lang").alias("__own"))
    left = left.join(rest, F.col("__key") == F.col("__w"), "left").withColumn("lang", F.coalesce("__lang", "__own")).drop("__key", "__w", "__lang", "__own")
    # the first by score and count, with all ties, in two steps: no language goes through one task whole
    order = [F.desc("score"), F.desc("a")]
    salted = left.withColumn("salt", F.pmod(F.xxhash64(*KEY), F.lit(max(16, number // 50_000))))
    first = salted.withColumn("__r", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("__r") <= top)
    first = first.withColumn("__r", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("__r") <= top).drop("salt", "__r")
    first = checkpointed(first)
    spelled = first.select(*KEY, F.posexplode(F.array(*KEY)).alias("at", "w")).where("w <> 0").join(often.select(F.col("w1").alias("w"), "word"), "w")
    spelled = spelled.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    ranked = first.join(spelled, KEY).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir):
    """op13: the first phrases of each language of the documents."""
    return mined(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)),
grams AS (
  SELECT lang, p, count(*) AS f
  FROM (SELECT lang, unnest(list_concat(list_transform(range(1, len(w) + 1), lambda i: w[i:i]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS p FROM pieces)
  GROUP BY lang, p),
candidates AS (SELECT lang, p, f AS a FROM grams WHERE len(p) > 1 AND f >= 10),
cuts AS (
  SELECT c.lang, c.p, c.a, c.k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates) c
  JOIN grams l ON l.lang = c.lang AND l.p = c.p[1:c.k] JOIN grams r ON r.lang = c.lang AND r.p = c.p[c.k + 1:len(c.p)]),
lowest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS t FROM cuts) WHERE t = 1),
longer AS (SELECT lang, q, max(a) AS most FROM (SELECT lang, a, unnest([p[1:2], p[2:3]]) AS q FROM candidates WHERE len(p) = 3) GROUP BY lang, q),
ranked AS (
  SELECT o.lang, array_to_string(o.p, ' ') AS phrase, a, l, r, score, row_number() OVER (PARTITION BY o.lang ORDER BY score DESC, a DESC, array_to_string(o.p, ' ')) AS rank
  FROM lowest o LEFT JOIN longer g ON g.lang = o.lang AND g.q = o.p WHERE g.most IS NULL OR 100 * g.most < 50 * a)
SELECT x.lang, rank, phrase, a, l, r, CAST(t.n AS BIGINT) AS n, score
FROM ranked x JOIN (SELECT lang, sum(f) AS n FROM grams WHERE len(p) = 1 GROUP BY lang) t ON t.lang = x.lang WHERE rank <= 2000
"""
