"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both token sequences write the same bytes (a space and the text). An interval of tokens is cut at an
end that both sequences have, looked for from its middle outwards by bisection, and both halves are
cut in the same way; an interval without such an end is a group. All intervals of a run of texts are
halved together, level by level, so the work of a level is a few vector operations.

Texts are cut at single spaces that follow other characters before they are tokenised: no token of
either vocabulary reaches over such a place, so each distinct fragment is tokenised once.

The first pass writes each text's counts, digest and its distinct id pairs to the shared folder.
Pair counts over the corpus are sums of what tasks found. The second pass looks counts up: those of
the most frequent pairs (at most HOT, found by a histogram of counts) travel as a table of bounded
size, all rarer pairs by a join on the pair, where no pair is frequent any more.

Null and empty texts, and texts that one of the tokenizers does not keep byte by byte, have no
tokens: zeros and an empty digest. Repeated rows count as often as they stand; other columns are ignored;
null ids stay null.
"""

import hashlib
import json
import os
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import checkpoint_folder, checkpointed, lean, table
from marketlens.llm.memory import Decimals, Memory, byte_level

HOT = 1 << 19  # pairs whose counts are sent to every task
STEPS = 8  # steps of the histogram of counts in each power of two
TOGETHER = 512  # fragments encoded as one text
#: White space beyond ASCII, in UTF-8: no cut after it, since the first tokenizer joins runs of white space.
SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf")
WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
COUNTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes array<long>, times array<long>"


def default_tokenizers():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers; remembers the ids of distinct fragments. Channels: ids A, ids B, 1 where both keep the bytes."""

    def __init__(self, paths):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(paths[0])
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=paths[1])
        with open(paths[0], encoding="utf-8") as f:
            rules = json.load(f)
        _, back = byte_level()
        bytes_a = {i: bytes(map(back.__getitem__, s)) for s, i in rules["model"]["vocab"].items()}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(max(bytes_a), max((t["id"] for t in rules["added_tokens"]), default=0)) + 1)]
        self.bytes_b = [self.piece(s) for s in map(self.b.id_to_piece, range(self.b.get_piece_size()))]
        self.size_a, self.size_b = np.array(list(map(len, self.bytes_a))), np.array(list(map(len, self.bytes_b)))
        # a space after another character lies inside no token of the second vocabulary either
        self.cuttable = not any(b" " in p.lstrip(b" ") for p in self.bytes_b) and rules["normalizer"] is None
        self.memory = Memory(3, 32 << 20)

    @staticmethod
    def piece(s):
        byte = re.fullmatch("<0x([0-9A-F]{2})>", s)
        return bytes([int(byte[1], 16)]) if byte else s.replace("▁", " ").encode()

    def encode_run(self, own):
        """(flat, sizes) a channel of fragments in a row: encoded as one text, since the cuts between them are certain."""
        whole, ends = b"".join(own), np.cumsum([len(x) for x in own])
        text = whole.decode()
        ids = self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.b.encode(text[1:])
        if all(b"".join(map(strings.__getitem__, x)) == whole for x, strings in zip(ids, (self.bytes_a, self.bytes_b), strict=True)):
            out = [np.array(x, np.int32) for x in ids]
            sums = [np.cumsum(size[x]) for x, size in zip(out, (self.size_a, self.size_b), strict=True)]
            at = [np.searchsorted(x, ends) for x in sums]
            if all((x[i] == ends).all() for x, i in zip(sums, at, strict=True)):
                return [*((x, np.diff(i + 1, prepend=0)) for x, i in zip(out, at, strict=True)), (np.ones(len(own), np.int32), np.ones(len(own), np.int64))]
        if len(own) > 1:
            half = len(own) // 2
            return [tuple(np.concatenate(x) for x in zip(*c, strict=True)) for c in zip(self.encode_run(own[:half]), self.encode_run(own[half:]), strict=True)]
        return [*((np.array(x, np.int32), np.array([len(x)])) for x in ids), (np.zeros(1, np.int32), np.ones(1, np.int64))]

    def encode_fragments(self, raw, starts, ends):
        """Row in the memory of each fragment; each begins with the added space or one that both tokenizers see."""
        names, first, back = np.unique(T.span_hashes(raw, starts, ends), return_index=True, return_inverse=True)

        def make(which):
            spans = zip(starts[first[which]].tolist(), ends[first[which]].tolist(), strict=True)
            own = [bytes(raw[x:y]) for x, y in spans]
            out, run = [None] * len(own), []
            for k, x in enumerate(own):
                run.append(k)
                if len(run) == TOGETHER or WHITE[x[-1]] or (x[-1] >= 0x80 and SPACES.search(x[-3:])) or k == len(own) - 1:  # what may join with a space after it ends a run
                    out[run[0]] = self.encode_run([own[i] for i in run])
                    run = []
            return [tuple(np.concatenate(x) for x in zip(*(r[c] for r in out if r is not None), strict=True)) for c in range(3)]

        return self.memory.find(names, make)[back]

    def encode(self, column):
        """Ids of A and of B, and the first token of each text in both (n+1 entries each)."""
        data, offsets = T.utf8(column)
        n = len(offsets) - 1
        bounds = offsets + np.arange(n + 1)
        raw = np.insert(data, offsets[:-1], 0x20)
        cut = np.zeros(len(raw) + 1, bool)
        if self.cuttable:
            cut[1:-1] = (raw[1:] == 0x20) & ~WHITE[raw[:-1]]
            for m in SPACES.finditer(raw.tobytes()):
                cut[m.end()] = False
        cut[bounds] = True
        at = np.flatnonzero(cut)
        owner = np.searchsorted(bounds, at[:-1], "right") - 1
        rows = self.encode_fragments(raw, at[:-1], at[1:])
        good = np.diff(offsets) > 0
        good[owner[self.memory.take(2, rows)[0] == 0]] = False
        rows, owner = rows[good[owner]], owner[good[owner]]
        out = []
        for c in (0, 1):
            ids, size = self.memory.take(c, rows)
            count = np.zeros(n, np.int64)
            np.add.at(count, owner, size)
            out += [ids, np.concatenate([[0], np.cumsum(count)])]
        return out


def shared_end(ends_a, ends_b, lo, hi):
    """For each interval of A tokens lo..hi: an A token before the last whose end B has too, and B's token; -1 where none.

    Looks from the middle outwards, at distances 0, 1, 2-3, 4-7 and so on, and takes the nearest of a step.
    """
    found_a, found_b = np.full(len(lo), -1), np.full(len(lo), -1)
    middle, open_, near = (lo + hi - 2) // 2, np.arange(len(lo)), 0
    while len(open_):
        far = max(1, 2 * near)
        for sign in (1, -1) if near else (1,):
            begin = middle[open_] + near if sign > 0 else middle[open_] - near
            left = hi[open_] - 1 - begin if sign > 0 else begin - lo[open_] + 1
            count = np.clip(left, 0, far - near)
            at, owner = T.flat_positions(np.zeros(len(open_), np.int64), count)
            token = begin[owner] + sign * at
            other = np.searchsorted(ends_b, ends_a[token])
            hit = np.flatnonzero(ends_b[np.minimum(other, len(ends_b) - 1)] == ends_a[token])
            who, first = np.unique(owner[hit], return_index=True)
            found_a[open_[who]], found_b[open_[who]] = token[hit[first]], other[hit[first]]
            open_ = open_[found_a[open_] < 0]
        near = far
        open_ = open_[(middle[open_] + near < hi[open_] - 1) | (middle[open_] - near >= lo[open_])]
    return found_a, found_b


def groups(ends_a, ends_b, first_a, first_b):
    """Leaf groups of all texts: first A token, end of A tokens, first B token, end of B tokens, in order."""
    lo_a, hi_a, lo_b, hi_b = first_a[:-1], first_a[1:], first_b[:-1], first_b[1:]
    full = hi_a > lo_a
    lo_a, hi_a, lo_b, hi_b = lo_a[full], hi_a[full], lo_b[full], hi_b[full]
    leaves = []
    while len(lo_a):
        cut_a, cut_b = np.full(len(lo_a), -1), np.full(len(lo_a), -1)
        several = np.flatnonzero((hi_a - lo_a > 1) & (hi_b - lo_b > 1))
        cut_a[several], cut_b[several] = shared_end(ends_a, ends_b, lo_a[several], hi_a[several])
        leaf = cut_a < 0
        leaves.append(np.stack([lo_a[leaf], hi_a[leaf], lo_b[leaf], hi_b[leaf]]))
        go = ~leaf
        mid_a, mid_b = cut_a[go] + 1, cut_b[go] + 1
        lo_a, hi_a, lo_b, hi_b = (np.stack(x, 1).ravel() for x in ((lo_a[go], mid_a), (mid_a, hi_a[go]), (lo_b[go], mid_b), (mid_b, hi_b[go])))
    if not leaves:
        return np.zeros((4, 0), np.int64)
    out = np.concatenate(leaves, axis=1)
    return out[:, np.argsort(out[0])]


def links(ends_a, ends_b, sizes_a):
    """A token and B token of each overlap, in order."""
    first = np.searchsorted(ends_b, ends_a - sizes_a, "right")
    last = np.searchsorted(ends_b, ends_a, "left")
    return T.flat_positions(first, last - first + 1)[::-1]


def written(ids_a, ids_b, leaf, decimals):
    """The groups `a1,a2|b1;a3|b2,b3;` as bytes, and where each group's run ends."""
    lo_a, hi_a, lo_b, hi_b = leaf
    after_a, after_b = np.full(len(ids_a), 44, np.uint8), np.full(len(ids_b), 44, np.uint8)
    after_a[hi_a - 1], after_b[hi_b - 1] = 124, 59
    order, after = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
    place_a = np.arange(len(ids_a)) + np.repeat(lo_b, hi_a - lo_a)
    place_b = np.arange(len(ids_b)) + np.repeat(hi_a, hi_b - lo_b)
    order[place_a], order[place_b], after[place_a], after[place_b] = ids_a, ids_b, after_a, after_b
    data, ends = decimals.write(order, after)
    return data.tobytes(), ends[hi_a + hi_b - 1]


def first_pass(docs, tokenizers):
    """Counts, digest and distinct id pairs of every row; a pair's code is id A * size of B + id B."""

    def work(batches):
        pair = Pair(tokenizers)
        decimals = Decimals(max(len(pair.bytes_a), len(pair.bytes_b)))
        for batch in batches:
            for part in T.slices(batch, "text", T.CHUNK // 2):
                ids_a, first_a, ids_b, first_b = pair.encode(part.column("text"))
                ends_a, ends_b = np.cumsum(pair.size_a[ids_a]), np.cumsum(pair.size_b[ids_b])
                leaf = groups(ends_a, ends_b, first_a, first_b)
                leaves = np.searchsorted(leaf[0], first_a)
                text, ends = written(ids_a, ids_b, leaf, decimals)
                ends = np.concatenate([[0], ends])[leaves].tolist()
                digest = [hashlib.sha256(text[a : b - 1]).hexdigest() if b > a else "" for a, b in zip(ends, ends[1:], strict=False)]
                token_a, token_b = links(ends_a, ends_b, pair.size_a[ids_a])
                owner = np.searchsorted(first_a, token_a, "right") - 1
                all_pairs = len(pair.bytes_a) * len(pair.bytes_b)
                code, times = np.unique(owner * all_pairs + ids_a[token_a].astype(np.int64) * len(pair.bytes_b) + ids_b[token_b], return_counts=True)
                bounds = pa.array(np.searchsorted(code // all_pairs, np.arange(len(first_a))), pa.int32())
                columns = [part.column("doc_id"), *(pa.array(x) for x in (np.diff(first_a), np.diff(first_b), np.diff(leaves), np.bincount(owner, minlength=len(first_a) - 1))), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (code % all_pairs, times))], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), COUNTS)


def lists(column):
    """Flat values and bounds of a list column."""
    bounds = np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds


def pair_counts(rows):
    """code and n of every pair over all rows; tasks sum their own first."""

    def work(batches):
        for batch in batches:
            codes, where = np.unique(lists(batch.column("codes"))[0], return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, where, lists(batch.column("times"))[0])
            yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), pa.array(n)], ["code", "n"])

    return rows.select("codes", "times").mapInArrow(lean(work), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def frequent(counts):
    """The counts from which on at most HOT pairs are, as a step of the histogram."""
    step = F.floor(F.log2("n") * STEPS).cast("int")
    total, least = 0, 1 << 30
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs")).collect(), reverse=True):
        total += r["pairs"]
        if total > HOT:
            break
        least = r["step"]
    return step >= least


def arrays(rows, *names):
    """Columns of a frame of bounded size, as arrays."""
    got = rows.select(*names).toArrow()
    return [got.column(n).to_numpy() for n in names]


def second_pass(rows, hot):
    """Sums over the frequent pairs of each row, and its other pairs with their times.

    hot: frequent codes in order, their counts, and whether the count is its B id's highest; broadcast.
    """

    def work(batches):
        codes, n, top = hot.value
        for batch in batches:
            code, bounds = lists(batch.column("codes"))
            times, _ = lists(batch.column("times"))
            at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            known = codes[at] == code if len(codes) else np.zeros(len(code), bool)
            sums = []
            for value in (n, top):
                each = np.zeros(len(code), np.int64)
                each[known] = value[at[known]] * times[known]
                sums.append(np.diff(np.concatenate([[0], np.cumsum(each)])[bounds]))
            left = pa.array(np.concatenate([[0], np.cumsum(~known)])[bounds], pa.int32())
            own = [batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sums[0]), pa.array(sums[1]), *(pa.ListArray.from_arrays(left, pa.array(x[~known], pa.int64())) for x in (code, times))], [*batch.schema.names[:7], "count_sum", "n_best", "codes", "times"])

    kind = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, count_sum long, n_best long, codes array<long>, times array<long>"
    return rows.select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times").mapInArrow(lean(work), kind)


def align(docs, tokenizers=None):
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    paths = tokenizers or default_tokenizers()
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/alignment-{uuid.uuid4().hex}"
    first_pass(docs, paths).withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(folder)
    rows = spark.read.parquet(folder)
    size_b = len(Pair(paths).bytes_b)
    counts = checkpointed(pair_counts(rows))
    b = F.pmod("code", F.lit(size_b))
    best_b, best_n = arrays(counts.groupBy(b.alias("b")).agg(F.max("n").alias("most")), "b", "most")  # one row for each id of B at most
    best = np.zeros(size_b, np.int64)
    best[best_b] = best_n
    is_hot = frequent(counts)
    codes, n = arrays(counts.where(is_hot), "code", "n")
    order = np.argsort(codes)
    codes, n = codes[order], n[order]
    hot = spark.sparkContext.broadcast((codes, n, (n == best[codes % size_b]).astype(np.int64)))
    looked = checkpointed(second_pass(rows, hot))
    tops = F.broadcast(spark.createDataFrame(pa.table({"b": np.arange(size_b), "most": best})))
    rare = counts.where(~is_hot).withColumn("b", b).join(tops, "b").select("code", "n", (F.col("n") == F.col("most")).cast("long").alias("top"))
    asked = looked.select("row", F.explode_outer(F.arrays_zip("codes", "times")).alias("p")).select("row", F.col("p.codes").alias("code"), F.col("p.times").alias("times")).where("code is not null")
    late = asked.join(rare, "code").groupBy("row").agg(F.sum(F.col("times") * F.col("n")).alias("late_sum"), F.sum(F.col("times") * F.col("top")).alias("late_best"))
    whole = looked.join(late, "row", "left")
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).alias(x)
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", plus("n_best", "late_best"), plus("count_sum", "late_sum"), "groups_sha256")


def query(spark, sf_dir):
    """op12: every document's alignment of the two vocabularies."""
    return align(table(spark, sf_dir, "documents"))
