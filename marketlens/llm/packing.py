"""Best-fit packing of token sequences, planned on the histogram of lengths.

Documents are tokenised, an end id is added, and those longer than SEQUENCE are cut into pieces.
Only the counts of piece lengths (SEQUENCE numbers at most) reach the driver, where best fit in
order of falling length runs over counts: equal bins move together, so the plan's size depends on
the number of lengths, not of documents. Each piece then takes a planned slot by its rank among
the pieces of its length. Ranks are counted within salted runs of (length, salt), with offsets
summed over salts, so a length that a third of all pieces share is spread over many tasks.

Text is tokenised as in bpe: a task asks the tokenizer's model only for distinct fragments of
distinct words. The file must be a byte-level BPE whose words end at white space. Null and empty
texts are one piece holding the end id.
Repeated rows are packed once each. Other columns are ignored.
"""

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from marketlens.llm import bpe
from marketlens.llm import tokens as T
from marketlens.llm.common import checkpointed, lean, table

SEQUENCE = 2048
END = 0
SALTS = 64  # runs of a length, at least
RUN = 100_000  # pieces that a run may hold on average


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(encoder, column):
    """Flat ids of all texts with END after each, and their bounds (n+1)."""
    ids, bounds = encoder.encode(column)
    return np.insert(ids, bounds[1:], END), bounds + np.arange(len(bounds))


def _pieces(path, keep_ids):
    def cut(batches):
        encoder = bpe.Encoder(path)
        for batch in batches:
            for part in T.slices(batch, "text", T.CHUNK // 4):
                ids, bounds = encode(encoder, part.column("text"))
                n = np.maximum(1, -(-np.diff(bounds) // SEQUENCE))
                piece, owner = T.flat_positions(np.zeros(len(n), np.int64), n)
                start = piece * SEQUENCE
                size = np.minimum(np.diff(bounds)[owner] - start, SEQUENCE)
                begin = bounds[owner] + start
                runs = [ids[a : a + k] for a, k in zip(begin.tolist(), size.tolist(), strict=True)]
                columns = [part.column("doc_id").take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array([zlib.crc32(r.astype("<u4").tobytes()) for r in runs], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([r.astype(np.int32) for r in runs], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return lean(cut)


def pieces(docs, tokenizer=None, keep_ids=False):
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of every row."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(tokenizer or default_tokenizer(), keep_ids), kind)


def plan(counts, capacity=SEQUENCE):
    """Slots by best fit over counts: rows (length, first rank, bins, first sequence, offset).

    Rank r of a length lies in the row with the greatest first rank up to r; with t = r - first
    rank, it goes to sequence first + t % bins, at offset + length * (t // bins).
    """
    groups = {}  # free space -> groups of equal bins: [bins, ((length, copies), ...)]
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r in groups if r >= length), default=None)
            if free is None:
                free, bins, items = capacity, left, ()
            else:
                bins, items = groups[free].pop()
                if not groups[free]:
                    del groups[free]
            copies = min(free // length, left)
            full = min(bins, left // copies)
            groups.setdefault(free - copies * length, []).append((full, (*items, (length, copies))))
            if bins > full and free < capacity:
                groups.setdefault(free, []).append((bins - full, items))
            left -= full * copies
    used, rows, sequence = dict.fromkeys(counts, 0), [], 0
    for free in sorted(groups):
        for bins, items in groups[free]:
            offset = 0
            for length, copies in items:
                rows.append((length, used[length], bins, sequence, offset))
                used[length] += bins * copies
                offset += length * copies
            sequence += bins
    return sorted(rows), sequence


def _place(shared):
    def place(batches):
        rows = shared.value
        key = rows[:, 0] * (1 << 40) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            r = rows[np.searchsorted(key, length * (1 << 40) + rank, "right") - 1]
            t = rank - r[:, 1]
            own = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*own, pa.array(r[:, 3] + t % r[:, 2]), pa.array(r[:, 4] + length * (t // r[:, 2]))], [*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    return lean(place)


def pack(cut):
    """The pieces with sequence_id and offset; cut is a frame of pieces()."""
    cut = checkpointed(cut.withColumn("__row", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    rows, _ = plan(counts)
    shared = cut.sparkSession.sparkContext.broadcast(np.array(rows, np.int64).reshape(-1, 5))
    # rows that repeat all columns are told apart by a number, so a third of equal rows still spreads over the salts
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "__row"), F.lit(max(SALTS, math.ceil(total / RUN)))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "__row")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(starts, ["length", "salt"])
    ranked = ranked.select(*(c for c in cut.columns if c != "__row"), (F.col("first") + F.col("own") - 1).alias("rank"))
    kinds = ", ".join(f"{n} {k}" for n, k in cut.dtypes if n != "__row")
    return ranked.mapInArrow(_place(shared), f"{kinds}, sequence_id long, offset long")


def query(spark, sf_dir):
    """op6: every piece of every document with its sequence and place."""
    return pack(pieces(table(spark, sf_dir, "documents")))
