"""Removal of repeated word runs, found by difference-cover anchors.

A window is WINDOW consecutive words of a document. A word goes if it lies in a window whose
word sequence also starts in a document with a smaller doc_id.

* Anchors are hashes of ANCHOR words, kept only where the position modulo PERIOD lies in COVER.
  COVER is a difference cover: for any two positions some shift under PERIOD brings both into it.
  WINDOW = ANCHOR + PERIOD - 1, so two equal windows share an anchor at the same place inside.
* An anchor found in one document only cannot lie in a repeated window. Around the others, full
  windows are hashed (the extension), and the smallest document of each window decides.
* Documents are dealt to blocks of about BLOCK bytes by doc_id and text, once; that shuffle serves all three
  passes. Blocks send each hash once, however many of their documents hold it, so a passage
  that very many documents share costs a value per block, never a pair of documents. Hashes
  meet in buckets of about BUCKET bytes of text; neither kind of group grows with the input. A block sends
  its values of a bucket as one row, so there are never more rows than values: at 100 TB about three values
  share a row, at 1 TB some three hundred.

Null texts and texts without words give 0 words and an empty text. Rows that repeat a doc_id are
judged alike and don't count against each other, whatever block they are in; rows equal in both share one.
Rows with a null doc_id lose nothing and make others lose nothing. Further columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import lean_group, lean_pair, parts_for, table, text_bytes

WINDOW = 13
PERIOD = 7
COVER = (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
BLOCK = 8 << 20  # bytes of text in a block
BUCKET = 64 << 20  # bytes of text whose anchors, or windows, meet in a bucket
U = np.uint64
NONE = np.iinfo(np.int64).max  # stands for a null doc_id


class Block:
    """Words, anchors and windows of the documents of a block."""

    def __init__(self, rows):
        ids = rows.column("doc_id")
        self.null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool) if isinstance(ids, pa.Array) else np.asarray(ids.combine_chunks().is_null().to_numpy(zero_copy_only=False), bool)
        self.doc = ids.fill_null(NONE).to_numpy().astype(np.int64)
        self.hashes, counts, self.parts = [], [], []
        anchors, windows = [], []
        base = 0
        for part in T.slices(rows, "text"):
            h, first, data, starts, ends = T.words(part.column("text"), "space")
            self.parts.append((data, starts, ends, first))
            begin, n = T.window_docs(first, WINDOW)
            at, _ = T.flat_positions(begin, n)
            wide = T.windows(h, WINDOW)
            windows.append((at + base, wide[at]))
            begin, n = T.window_docs(first, ANCHOR)
            n = np.where(np.diff(first) >= WINDOW, n, 0)
            at, owner = T.flat_positions(begin, n)
            at = at[np.isin((at - begin[owner]) % PERIOD, COVER)]
            anchors.append((at + base, T.windows(h, ANCHOR)[at]))
            counts.append(np.diff(first))
            base += len(h)
        join = lambda x, k, kind: np.concatenate([y[k] for y in x]) if x else np.zeros(0, kind)
        self.count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.first = np.concatenate([np.zeros(1, np.int64), np.cumsum(self.count)])
        self.owner = np.repeat(np.arange(len(self.count)), self.count)
        self.anchor_at, self.anchor = join(anchors, 0, np.int64), join(anchors, 1, U)
        self.window_at, self.window = join(windows, 0, np.int64), join(windows, 1, U)

    def doc_at(self, at):
        """The doc_id of the document that holds each word position."""
        return self.doc[self.owner[at]]


def grouped(bucket, value, doc):
    """Distinct (bucket, value) in order, each one's least and greatest doc, and the way back."""
    order = np.lexsort((value, bucket))
    b, v, d = bucket[order], value[order], doc[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (v[1:] != v[:-1])
    begin = np.flatnonzero(new)
    back = np.empty(len(b), np.int64)
    back[order] = np.cumsum(new) - 1
    least = np.minimum.reduceat(d, begin) if len(b) else d
    most = np.maximum.reduceat(d, begin) if len(b) else d
    return b[begin], v[begin], least, most, back


def anchor_table(block, buckets):
    """The block's distinct anchors; 32 bits within a bucket suffice, as windows are checked after."""
    bucket = (block.anchor % U(buckets)).astype(np.int64)
    value = (block.anchor >> U(32)).astype(np.uint32)
    return grouped(bucket, value, block.doc_at(block.anchor_at))


def window_table(block, shared, buckets):
    """The block's distinct windows around shared anchors, and the positions they start at."""
    at = block.anchor_at[shared]
    mark = np.zeros(len(block.owner) + 1, np.int64)
    np.add.at(mark, np.maximum(at - (PERIOD - 1), block.first[block.owner[at]]), 1)
    np.add.at(mark, at + 1, -1)
    near = np.cumsum(mark[:-1])[block.window_at] > 0
    at, value = block.window_at[near], block.window[near]
    return at, grouped((value % U(buckets)).astype(np.int64), value, block.doc_at(at))


def packed(number, bucket, *columns):
    """One row per bucket in use, with the bytes of each column's run."""
    used, cuts = np.unique(bucket, return_index=True)
    cuts = np.append(cuts, len(bucket))
    data = [pa.array([c[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()) for c in columns]
    return pa.table([pa.array(used.astype(np.int64)), pa.array(np.full(len(used), number, np.int64)), *data], names=["bucket", "block", *(f"c{i}" for i in range(len(columns)))])


def runs(column, kind):
    """All values of a column of packed bytes, and each row's number of them."""
    data = [np.frombuffer(x.as_buffer(), kind) for x in column]
    return np.concatenate(data) if data else np.zeros(0, kind), np.array([len(x) for x in data], np.int64)


def unpacked(flags, phase, n):
    """The bits of a phase, in order of bucket, cut to n."""
    rows = sorted((b, c, bits) for b, p, c, bits in zip(*(flags.column(k).to_pylist() for k in ("bucket", "phase", "n", "bits")), strict=True) if p == phase)
    out = [np.unpackbits(np.frombuffer(bits, np.uint8))[:c] for _, c, bits in rows]
    out = np.concatenate(out).astype(bool) if out else np.zeros(0, bool)
    if len(out) != n:
        raise ValueError(f"{len(out)} flags for {n} hashes of a block")
    return out


def flags_of(rows, hit, size, phase):
    at = np.concatenate([[0], np.cumsum(size)])
    bits = [np.packbits(hit[at[i] : at[i + 1]]).tobytes() for i in range(len(size))]
    return pa.table([rows["block"], rows["bucket"], pa.array(np.full(len(size), phase)), pa.array(size), pa.array(bits, pa.binary())], names=["block", "bucket", "phase", "n", "bits"])


FLAGS = "block long, bucket long, phase long, n long, bits binary"


def passes(buckets):
    """The three passes as functions over blocks."""

    def anchors(rows):
        bucket, value, least, most, _ = anchor_table(Block(rows), buckets)
        return packed(rows["block"][0].as_py(), bucket, value, np.where(most > least, 1, 0).astype(np.uint8))

    def shared(rows):
        value, size = runs(rows["c0"], np.uint32)
        many, _ = runs(rows["c1"], np.uint8)
        _, back, count = np.unique(value, return_inverse=True, return_counts=True)
        weight = np.bincount(back, many, len(count)) + count
        return flags_of(rows, weight[back] > 1, size, 1)

    def windows(rows, flags):
        if not rows.num_rows:
            return pa.table({k: pa.array([], t) for k, t in (("bucket", pa.int64()), ("block", pa.int64()), ("c0", pa.binary()), ("c1", pa.binary()))})
        block = Block(rows)
        *_, back = got = anchor_table(block, buckets)
        _, (bucket, value, least, *_) = window_table(block, unpacked(flags, 1, len(got[0]))[back], buckets)
        return packed(rows["block"][0].as_py(), bucket, value, least)

    def earlier(rows):
        value, size = runs(rows["c0"], U)
        least, _ = runs(rows["c1"], np.int64)
        _, back = np.unique(value, return_inverse=True)
        low = np.full(back.max() + 1 if len(back) else 0, NONE)
        np.minimum.at(low, back, least)
        return flags_of(rows, low[back] < least, size, 2)

    def kept(rows, flags):
        block = Block(rows)
        *_, back = got = anchor_table(block, buckets)
        at, (_, _, least, _, back) = window_table(block, unpacked(flags, 1, len(got[0]))[back], buckets)
        before = unpacked(flags, 2, len(least))
        gone = (before | False)[back] | (block.doc_at(at) > least[back])
        gone &= ~block.null[block.owner[at]]
        mark = np.zeros(len(block.owner) + WINDOW + 1, np.int64)
        np.add.at(mark, at[gone], 1)
        np.add.at(mark, at[gone] + WINDOW, -1)
        keep = np.cumsum(mark)[: len(block.owner)] == 0
        texts, w = [], 0
        for data, starts, ends, first in block.parts:
            k = keep[w : w + len(starts)]
            w += len(starts)
            s, size = starts[k], ends[k] - starts[k] + 1
            total = np.cumsum(size)
            flat, _ = T.flat_positions(s, size)
            padded = np.append(data, np.uint8(32))
            text = padded[np.minimum(flat, len(data))]
            text[total - 1] = 32
            cut = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(k)])[first]]
            text = text.tobytes()
            texts += [text[a : max(a, b - 1)].decode() for a, b in zip(cut, cut[1:], strict=False)]
        n = block.count
        left = np.concatenate([[0], np.cumsum(keep)])
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(n), "n_removed": pa.array(n - (left[block.first[1:]] - left[block.first[:-1]])), "kept_text": pa.array(texts, pa.string())})

    return lean_group(anchors), lean_group(shared), lean_pair(windows), lean_group(earlier), lean_pair(kept)


def remove_repeats(docs):
    """doc_id, n_words, n_removed and kept_text (kept words joined by a space) of each row."""
    total = text_bytes(docs)
    blocks = parts_for(total, BLOCK)
    anchors, shared, windows, earlier, kept = passes(parts_for(total, BUCKET))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("long"))
    send = "bucket long, block long, c0 binary, c1 binary"
    one = dealt.groupBy("block").applyInArrow(anchors, send).groupBy("bucket").applyInArrow(shared, FLAGS)
    wide = dealt.groupBy("block").cogroup(one.groupBy("block")).applyInArrow(windows, send)
    two = wide.groupBy("bucket").applyInArrow(earlier, FLAGS)
    return dealt.groupBy("block").cogroup(one.unionByName(two).groupBy("block")).applyInArrow(kept, "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark, sf_dir):
    """op3: words, removed words and the digest of the kept text of every document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 13 THEN [] ELSE list_transform(range(1, len(ws) - 11), lambda i: {'s': i, 'g': array_to_string(ws[i:i+12], ' ')}) END) AS x FROM w),
m AS (SELECT x.g AS g, min(doc_id) AS lo FROM g GROUP BY 1),
c AS (SELECT DISTINCT doc_id, unnest(range(x.s, x.s + 13)) AS p FROM g JOIN m ON m.g = x.g WHERE lo < doc_id),
gone AS (SELECT doc_id, list(p) AS ps FROM c GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda i: ps IS NULL OR NOT list_contains(ps, i)), lambda i: ws[i]), ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
