"""Exact n-gram Jaccard join: size-banded tiles, hashed bitmaps, sorted-array intersection.

Two documents link when 100 * |A & B| >= 80 * |A | B| over their sets of five-word shingles.

* Equal sets form a class; one set stands for it from then on, so copies cost no pairs.
* Linked sets share one of the first n - ceil(0.8 n) + 1 shingles in any fixed order. Ours goes by
  the number of documents: shingles that meet in runs of texts are counted over all documents, and the
  KNOWN ones of most documents come last, so a line that many texts hold makes no tile where a
  text has enough words of its own. The order changes the
  cost, never the result. Sets that share such a shingle, within a band of sizes, make a tile. Most
  shingles meet in buckets; a frequent one may be in very many sets, so its pivot is a
  minimum that is combined before the shuffle and joined back.
* Hashed bitmaps bound each overlap from above (bits of A that B lacks are shingles that B
  lacks), and only the rest meets the exact intersection of sorted arrays. A bitmap has about
  twice as many bits as its set has shingles; of two lengths, the longer is folded.
* Most large tiles are groups of near copies: first, each member meets its tile's pivot alone,
  and links found there make components. Then only tiles with more than one component are
  compared in full, pairs inside a component excepted. Bitmaps alone name the members that may
  still link; only their arrays are fetched, and a tile yields a spanning forest. In a tile, the members outside
  its pivot's component ask, in runs of ASK, all members, in runs of TILE; each pair of
  runs is a task of its own, so a tile with few such members costs little more than its size.

Nulls and texts without words have no shingles and link with nothing; texts of fewer than five
words have one. Repeated rows with the same doc_id count as copies; a null doc_id stays alone.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import checkpointed, lean, lean_group, parts_for, row_keys, sized, table, text_bytes

WORDS = 5  # words in a shingle
PERCENT = 80  # least similarity
BITS = 2  # of a bitmap for each shingle, rounded up to a power of two
NEAR = 1_000_000  # keys (16 MB) up to which a list of them is broadcast
ASK, TILE = 64, 192  # members of a tile that ask, and that are asked, in one task
BUCKET = 64 << 20  # bytes of text whose first shingles meet in a bucket
OFTEN = 3  # different sets of a run of texts from which a shingle's count is kept
RUN = 1 << 21  # shingles (16 MB) in a run of texts
KNOWN = 1 << 18  # shingles (3 MB with their counts) that the order knows at most
STEPS = 8  # classes of counts from one power of two to the next
RARE = 1000  # a shingle of more than one in RARE documents is frequent
FREQUENT = 1 << 18  # ... and of more than a FREQUENT-th of all shingles, so there are fewer than that
U = np.uint64


def shingle_sets(column):
    """The sorted distinct shingle hashes of each text of a string column."""
    hashes, first, *_ = T.words(column, "space", lower=True)
    count = np.diff(first)
    wide = T.windows(hashes, WORDS)
    begin, n = T.window_docs(first, WORDS)
    at, owner = T.flat_positions(begin, n)
    value = wide[at]
    for size in range(1, WORDS):  # texts of fewer words: the whole sequence is one shingle
        short = np.flatnonzero(count == size)
        if len(short):
            value = np.concatenate([value, T.mix(T.windows(hashes, size)[first[short]] + U(size))])
            owner = np.concatenate([owner, short])
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    if len(value):
        keep = np.ones(len(value), bool)
        keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        value, owner = value[keep], owner[keep]
    bounds = np.searchsorted(owner, np.arange(len(count) + 1))
    return value, bounds


def segment_sums(values, bounds):
    """Sums of values over the segments that bounds cut; 0 for empty ones."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values, dtype=values.dtype)])
    return total[bounds[1:]] - total[bounds[:-1]]


def set_keys(value, bounds):
    """Two 64-bit values (as int64) that name a set."""
    return [segment_sums(T.mix(value ^ U(seed)), bounds).view(np.int64) for seed in (0x1234567, 0x89ABCDEF)]


def band(n):
    """The size band of a set of n; linked sets differ by one band at most."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / PERCENT) + 1e-9).astype(np.int16)


def prefix_length(n):
    """How many first shingles a set of n must show so that any link shares one."""
    return n - -(-n * PERCENT // 100) + 1


def bitmap(a):
    """The hashed bitmap of a set as 64-bit words; a power of two of them."""
    bits = np.zeros(max(64, 1 << int(BITS * len(a) - 1).bit_length()), bool)
    bits[(a ^ (a >> U(32))).astype(np.int64) & (len(bits) - 1)] = True
    return np.packbits(bits, bitorder="little").view(U)


def folded(bits, words):
    """A bitmap cut to a smaller power of two of words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def may_link(n, bits, other_n, other_bits):
    """Whether bit counts allow a link of one set with each of several of the same map length."""
    lacking = np.bitwise_count(bits & ~other_bits).sum(axis=-1)
    surplus = np.bitwise_count(other_bits & ~bits).sum(axis=-1)
    most = np.minimum(n - lacking.astype(np.int64), other_n - surplus.astype(np.int64))
    return 100 * most >= PERCENT * (n + other_n - most)


SETS = "doc_id long, row_text long, n_shingles long, key long, check long, bits binary, shingle long, times long"


def _sets(batches):
    """A row per document, and one per shingle that OFTEN different sets of a run of texts hold."""
    kinds = [pa.int64()] * 5 + [pa.binary()] + [pa.int64()] * 2
    names = [c.split()[0] for c in SETS.split(", ")]
    run, seen = [], np.zeros(0, np.int64)

    def counted():
        shingle, times = np.unique(np.concatenate(run), return_counts=True)
        often = times >= OFTEN
        n = int(often.sum())
        if n:
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, k) for k in kinds[:6]), pa.array(shingle[often].view(np.int64)), pa.array(times[often])], names)

    for batch in batches:
        for part in T.slices(batch, "text"):
            value, bounds = shingle_sets(part.column("text"))
            a, b = set_keys(value, bounds)
            maps = [bitmap(value[x:y]).tobytes() if y > x else None for x, y in zip(bounds, bounds[1:], strict=False)]
            none = pa.nulls(part.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_text"), pa.array(np.diff(bounds)), pa.array(a), pa.array(b), pa.array(maps, pa.binary()), none, none], names)
            new = np.zeros(len(a), bool)
            new[np.unique(a, return_index=True)[1]] = True
            new &= ~np.isin(a, seen)
            run.append(value[np.repeat(new, np.diff(bounds))])
            seen = np.concatenate([seen, a[new]])
            if sum(map(len, run)) >= RUN:
                yield from counted()
                run, seen = [], seen[:0]
    if run:
        yield from counted()


def document_sets(docs):
    """doc_id, the text's hash, n_shingles, name and bitmap of each document's set; and rows of shingle counts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_text"), "text")
    return rows.mapInArrow(lean(_sets), SETS)


def known_shingles(named):
    """Shingles of many documents in order, their counts, and the count from which one is frequent.

    Of all counted shingles those of most documents, KNOWN at most; the frequent ones are among them, as by their
    definition there are fewer than FREQUENT.
    """
    whole = named.agg(F.count("n_shingles").alias("docs"), F.sum("n_shingles").alias("shingles")).first()
    frequent = max(OFTEN, whole["docs"] / RARE, (whole["shingles"] or 0) / FREQUENT)
    found = checkpointed(named.where("shingle is not null").groupBy("shingle").agg(F.sum("times").alias("n")))
    step = F.floor(F.lit(STEPS) * F.log2("n"))
    least, total = frequent, 0
    for r in found.groupBy(step.alias("step")).agg(F.count("*").alias("shingles"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        total += r["shingles"]
        if total > KNOWN:
            break
        least = min(least, r["n"])
    rows = found.where(F.col("n") >= least).toArrow()
    value, times = rows["shingle"].to_numpy().view(U), rows["n"].to_numpy()
    order = np.argsort(value)
    return value[order], np.minimum(times[order], 2**31 - 1).astype(np.int32), frequent


def _prefixes(parts, known):
    """Rows (bucket, keys, sizes, hashes) with the first shingles of each set of a batch.

    Frequent shingles go to buckets of their own, dealt by set and not by shingle.
    """

    def emit(batches):
        common, documents, frequent = known.value
        for batch in batches:
            sets = []
            for part in T.slices(batch, "text"):
                value, bounds = shingle_sets(part.column("text"))
                key, _ = set_keys(value, bounds)
                n = np.diff(bounds)
                times = np.zeros(len(value), np.int32)
                if len(common) and len(value):
                    at = np.minimum(np.searchsorted(common, value), len(common) - 1)
                    times = np.where(common[at] == value, documents[at], times)
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((value, times, owner))  # owner keeps its place
                take, own = T.flat_positions(bounds[:-1], np.where(n > 0, prefix_length(n), 0))
                first = order[take]
                sets.append((key[own], n[own], value[first], times[first] >= frequent))
            if not sets:
                continue
            key, size, value, late = (np.concatenate(x) for x in zip(*sets, strict=True))
            bucket = (value % U(parts)).astype(np.int64)
            bucket[late] = parts + (T.mix(key[late].view(U)) % U(parts)).astype(np.int64)
            value = (value >> U(32)).astype(np.uint32)  # with the bucket, enough to name candidates
            size = band(size)
            order = np.lexsort((key, value, bucket))
            key, size, value, bucket = key[order], size[order], value[order], bucket[order]
            if not len(key):
                continue
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
            key, size, value, bucket = key[new], size[new], value[new], bucket[new]
            used, cuts = np.unique(bucket, return_index=True)
            cuts = np.append(cuts, len(bucket))
            cols = [[x[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for x in (key, size, value)]
            yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(c, pa.binary()) for c in cols)], ["bucket", "keys", "sizes", "hashes"])

    return lean(emit)


def _joined(column, kind):
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column]) if len(column) else np.zeros(0, kind)


def _tiles(parts):
    """Of a bucket: sets that share a first shingle, each with the smallest of them, its pivot.

    Of a bucket of frequent shingles: (shingle, key) rows, as their sets lie in many buckets.
    """

    def tiles(rows):
        key, size, value = _joined(rows["keys"], np.int64), _joined(rows["sizes"], np.int16), _joined(rows["hashes"], np.uint32)
        order = np.lexsort((key, value))
        key, size, value = key[order], size[order], value[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (value[1:] != value[:-1])
        key, size, value = key[new], size[new], value[new]
        if rows["bucket"][0].as_py() >= parts:
            return pa.table({"shingle": pa.array(value.astype(np.int64)), "tile": pa.nulls(len(key), pa.int64()), "key": key})
        start = np.ones(len(key), bool)
        start[1:] = value[1:] != value[:-1]
        begin = np.flatnonzero(start)
        count = np.diff(np.append(begin, len(key)))
        many = count > 1
        at, owner = T.flat_positions(begin[many], count[many])
        key, size = key[at], size[at]
        # sets of a link lie in the same band or in neighbouring ones, so a tile ends at a missing band
        order = np.lexsort((key, size, owner))
        key, size = key[order], size[order]
        brk = np.ones(len(key), bool)
        brk[1:] = (owner[1:] != owner[:-1]) | (size[1:] > size[:-1] + 1)
        begin = np.flatnonzero(brk)
        count = np.diff(np.append(begin, len(key)))
        keep = np.flatnonzero(count > 1)
        at, owner = T.flat_positions(begin[keep], count[keep])
        key = key[at]
        pivot = np.minimum.reduceat(key, np.cumsum(count[keep]) - count[keep])[owner] if len(keep) else key
        order = np.lexsort((key, pivot))
        key, pivot = key[order], pivot[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (pivot[1:] != pivot[:-1])
        return pa.table({"shingle": pa.nulls(int(new.sum()), pa.int64()), "tile": pivot[new], "key": key[new]})

    return lean_group(tiles)


def candidate_tiles(docs, named, total):
    """Rows (tile, key): a tile is named by its pivot and holds all sets that met it by a shingle.

    Two sets that share a first shingle met the same pivot there, so they share a tile. Frequent shingles
    are told apart by 32 bits; more sets in a tile than need be are only more work.
    """
    parts = parts_for(total, BUCKET)
    known = docs.sparkSession.sparkContext.broadcast(known_shingles(named))
    sent = docs.select("text").mapInArrow(_prefixes(parts, known), "bucket long, keys binary, sizes binary, hashes binary")
    met = checkpointed(sent.groupBy("bucket").applyInArrow(_tiles(parts), "shingle long, tile long, key long"))
    often = met.where("shingle is not null").select("shingle", "key")
    pivots, _ = sized(checkpointed(often.groupBy("shingle").agg(F.min("key").alias("tile"), F.max("key").alias("last")).where("tile <> last").drop("last")), NEAR)
    return met.where("tile is not null").select("tile", "key").unionByName(often.join(pivots, "shingle").select("tile", "key")).distinct()


def _set_arrays(batches):
    for batch in batches:
        for part in T.slices(batch, "text"):
            value, bounds = shingle_sets(part.column("text"))
            own = part.column("key").to_numpy() == set_keys(value, bounds)[0]  # a repeated doc_id may have other texts
            data = [value[bounds[i] : bounds[i + 1]].tobytes() for i in np.flatnonzero(own)]
            yield pa.RecordBatch.from_arrays([part.column("key").filter(pa.array(own)), pa.array(data, pa.binary())], ["key", "hashes"])


def linked(a, b):
    """Whether two sorted distinct arrays are similar enough, exactly."""
    if PERCENT * max(len(a), len(b)) > 100 * min(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _possible(batches):
    """Of pairs with sizes and bitmaps: the pairs that bit counts allow to link."""
    for batch in batches:
        n, m = batch.column("a_n").to_numpy(), batch.column("b_n").to_numpy()
        yes = np.zeros(len(n), bool)
        for i, (x, y) in enumerate(zip(batch.column("a_bits"), batch.column("b_bits"), strict=True)):
            if PERCENT * max(n[i], m[i]) <= 100 * min(n[i], m[i]):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                words = min(len(x), len(y))
                yes[i] = may_link(n[i], folded(x, words), m[i], folded(y, words))
        kept = batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))
        if kept.num_rows:
            yield kept


def _pivot_links(batches):
    for batch in batches:
        a, b = batch.column("a_hashes"), batch.column("b_hashes")
        yes = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(a, b, strict=True)]
        kept = batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))
        if kept.num_rows:
            yield kept


def _cross_pairs(rows):
    """The components of a run's members as small numbers, and an iterator over (i, all j that may link with the asking i)."""
    n, asks = rows["n"].to_numpy(), rows["asks"].to_numpy(zero_copy_only=False)
    label = np.unique(rows["component"].to_numpy(), return_inverse=True)[1]
    maps = [np.frombuffer(x.as_buffer(), U) for x in rows["bits"]]
    words = np.array([len(x) for x in maps])

    def pairs():
        at = {w: np.flatnonzero(~asks & (words == w)) for w in set(words[~asks].tolist())}
        flat = {(w, c): np.stack([folded(maps[k], c) for k in i]) for w, i in at.items() for c in (w, w // 2) if c}
        for i in np.flatnonzero(asks):
            for w in (words[i] // 2, words[i], 2 * words[i]):  # sizes of a link differ by a quarter at most
                if w in at:
                    common = min(w, words[i])
                    j = at[w]
                    ok = (label[j] != label[i]) & (PERCENT * np.maximum(n[j], n[i]) <= 100 * np.minimum(n[j], n[i]))
                    ok[ok] = may_link(n[i], folded(maps[i], common), n[j[ok]], flat[w, common][ok])
                    if ok.any():
                        yield i, j[ok]

    return label, pairs()


def _open_members(rows):
    """The members of two runs of a tile that may link across components."""
    _, pairs = _cross_pairs(rows)
    use = np.zeros(rows.num_rows, bool)
    for i, j in pairs:
        use[i] = use[j] = True
    return rows.filter(pa.array(use))


def _forest(rows):
    """Spanning links between the components of two runs of a tile."""
    label, pairs = _cross_pairs(rows)
    key, arrays = rows["key"].to_numpy(), [np.frombuffer(x.as_buffer(), U) for x in rows["hashes"]]
    a, b = [], []
    for i, near in pairs:
        for k in near:
            if label[k] != label[i] and linked(arrays[i], arrays[k]):
                a.append(key[i])
                b.append(key[k])
                label[label == label[k]] = label[i]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def runs_of_tiles(known):
    """Members (tile, key, component) of tiles of several components, once per pair of runs: (tile, asking, asked, asks)."""
    each_ = known.groupBy("tile", "component").agg(F.count("*").alias("n"), F.bool_or(F.col("tile") == F.col("key")).alias("own"))
    main = F.max(F.when(F.col("own"), F.col("component"))).alias("main")
    mixed = each_.groupBy("tile").agg(F.sum("n").alias("m"), F.sum(F.when(~F.col("own"), F.col("n"))).alias("r"), main).where("r > 0")
    mixed, _ = sized(checkpointed(mixed), NEAR)
    known = known.join(mixed, "tile").withColumn("rows", F.ceil(F.col("r") / ASK).cast("int")).withColumn("columns", F.ceil(F.col("m") / TILE).cast("int"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    run = lambda c, seed: F.pmod(F.xxhash64("key", F.lit(seed)), F.col(c)).cast("int")
    asked = known.select("tile", "key", "component", upto("rows").alias("asking"), run("columns", 1).alias("asked"), F.lit(False).alias("asks"))
    asking = known.where("component <> main").select("tile", "key", "component", run("rows", 2).alias("asking"), upto("columns").alias("asked"), F.lit(True).alias("asks"))
    return asked.unionByName(asking)


def components(edges):
    """(node, component): the smallest node that links reach, by alternating star steps.

    Each step sends neighbours to the smallest neighbour, first among larger nodes, then among
    smaller ones; edges shrink to stars in about log steps. Work is joins and minima, so a hub
    with very many neighbours is combined before the shuffle.
    """
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(small.where("u <> v").distinct())
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now


def set_arrays(docs, keys, classes):
    """(key, hashes) for the given set keys, read from one document of each; repeated rows repeat."""
    reps = keys.distinct().join(classes.select("key", F.col("rep").alias("doc_id")), "key")
    reps = checkpointed(reps.groupBy("key").agg(F.min("doc_id").alias("doc_id")))
    reps, _ = sized(reps, NEAR)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(reps, "doc_id")
    return texts.select("key", "text").mapInArrow(lean(_set_arrays), "key long, hashes binary")


def join(docs):
    """doc_id, row_text (hash of the text), n_shingles, component_id of every document."""
    every = checkpointed(document_sets(docs))
    named = every.where("n_shingles is not null")
    classes = named.where("n_shingles > 0 and doc_id is not null").groupBy("key", "check").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("bits").alias("bits"))
    classes = checkpointed(classes)
    tiles = checkpointed(candidate_tiles(docs, every, text_bytes(docs)))

    def side(x, *columns):
        return [F.col(c).alias(x if c == "key" else f"{x}_{c}") for c in ("key", *columns)]

    star = tiles.select(F.col("key").alias("a"), F.col("tile").alias("b")).where("a <> b")
    star = star.join(classes.select(side("a", "n", "bits")), "a").join(classes.select(side("b", "n", "bits")), "b").mapInArrow(lean(_possible), "a long, b long")
    star = checkpointed(star)
    arrays = checkpointed(set_arrays(docs, star.select(F.explode(F.array("a", "b")).alias("key")), classes))
    links = star.join(arrays.select(side("a", "hashes")), "a").join(arrays.select(side("b", "hashes")), "b").mapInArrow(lean(_pivot_links), "a long, b long")
    links = checkpointed(links)

    first = components(links)
    known = tiles.join(first.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    cut = runs_of_tiles(known).join(classes.select("key", "n", "bits"), "key").select("tile", "asking", "asked", "asks", "key", "component", "n", "bits")
    kind = "tile long, asking int, asked int, asks boolean, key long, component long, n long, bits binary"
    cut = checkpointed(cut.groupBy("tile", "asking", "asked").applyInArrow(lean_group(_open_members), kind))
    arrays = set_arrays(docs, cut.select("key"), classes)
    more = cut.join(arrays, "key").groupBy("tile", "asking", "asked").applyInArrow(lean_group(_forest), "a long, b long")
    final = components(links.unionByName(more)).withColumnRenamed("node", "key")

    lowest = classes.join(final, "key", "left").select("key", "check", "rep", F.coalesce("component", "key").alias("component"))
    best = lowest.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = lowest.join(best, "component").select("key", "check", "component_id")
    out = named.select("doc_id", "row_text", "n_shingles", "key", "check").join(found, ["key", "check"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "row_text", "n_shingles", own.alias("component_id"))


def keep_first(docs):
    """One document of each component, the one of smallest doc_id, with all columns.

    Documents without words or doc_id stay. Of rows that repeat both doc_id and text one stays.
    """
    linked_ = checkpointed(join(docs))
    gone = linked_.where("n_shingles > 0 and component_id <> doc_id").select(F.col("doc_id").alias("__row_doc"), F.col("row_text").alias("__row_text")).distinct()
    gone, _ = sized(checkpointed(gone), NEAR)
    kept = row_keys(docs).join(gone, ["__row_doc", "__row_text"], "left_anti")
    whole = linked_.where("n_shingles > 0 and doc_id is not null")
    if not whole.groupBy("doc_id", "row_text").count().where("count > 1").isEmpty():
        kept = kept.where("__row_doc <> -9223372036854775808").dropDuplicates(["__row_doc", "__row_text"]).unionByName(kept.where("__row_doc = -9223372036854775808"))
    return kept.select(*docs.columns)


def query(spark, sf_dir):
    """op10: every document with its set size and the smallest doc_id its links reach."""
    return join(table(spark, sf_dir, "documents")).drop("row_text")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
r AS (SELECT doc_id AS node, doc_id AS lab FROM n UNION SELECT e.y, r.lab FROM r JOIN e ON e.x = r.node WHERE r.lab < e.y),
m AS (SELECT node, min(lab) AS lab FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.lab, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.node = w.doc_id
"""
