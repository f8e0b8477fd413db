"""Encoding, alignment and collocations against the libraries and brute force, with odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marketlens.llm import alignment, bpe, collocations, packing
from marketlens.llm import tokens as T
from marketlens.llm.memory import Decimals, Memory, Written

ODD = [
    None, "", " ", " \n ", "a", "a  b   c", "x \n\n y\tz ", "end ", "tail\n", "tail   next", "nb  sp", "　wide　 x", "a▁b ▁c", "▁", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|> <|start",
    "<s> </s> <unk> <0x0A>", "Ünï cödé ÄÖÜ ß É é", "İstanbul ΣΑΣ ΟΔΟΣ.", "don't WE'LL '5s 'tis", "汉字かな漢字 한국어", "👩‍👩‍👧 🔥🔥 x", "\x00\x01 \x1c\x1d \x7f", "a" + "́" * 5, "x" * 5000, "12" * 700, "!?" * 300, "é" * 400,
    "word " * 4000, "İİ İ", "\u0085 x", "﻿bom", "Z" + "​" + "Z", "same text", "same text",
]
KIND = "doc_id long, text string, lang string, ids string, row string, codes string, n long"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if i == 3 else i, t, None, "extra", "extra", "extra", i) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_equals_library(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    t.no_padding(), t.no_truncation()
    want = []
    for i, text in enumerate(ODD):
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((None if i == 3 else i, len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))))
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=key) == sorted(want, key=key)
    encoded = bpe.encode(docs)
    got = {r.doc_id: r.ids for r in encoded.collect()}
    assert all(got[i] == t.encode(x or "", add_special_tokens=False).ids for i, x in enumerate(ODD) if i != 3)
    texts = {r.doc_id: r.text for r in bpe.decode(encoded).collect()}
    assert all(texts[i] == t.decode(got[i], skip_special_tokens=False) for i in got)
    assert bpe.round_trip(empty).count() == bpe.encode(empty).count() == bpe.decode(bpe.encode(empty)).count() == 0


def test_bpe_tables_equal_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_tokenizer())
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.query(spark, "/root/testdata/sf0.001").collect()}
    for r in rows.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))


def test_forced_boundaries():
    v = bpe.Vocabulary(bpe.default_tokenizer())
    inside = {(a, b) for s in v.ids for x in [s.removesuffix("</w>").encode("utf-8")] if s.isascii() for a, b in zip(x, x[1:], strict=False)}
    assert all(v.joined[a, b] for a, b in inside)
    assert not v.joined[ord("1")].any() and not v.joined[ord(" ")].any()  # digits stand alone, white space is in no token
    assert v.joined[ord("t"), ord("h")] and 0 < v.joined.sum() < 20_000


def test_bpe_small_runs_and_memory(monkeypatch):
    texts = pa.array(ODD[:-2] * 2)
    e, d = bpe.Encoder(bpe.default_tokenizer()), bpe.Decoder(bpe.default_tokenizer())
    ids, bounds = e.encode(texts)
    decimals = Decimals(d.most)
    wide = bpe.digests(ids, bounds, lambda x: decimals.write(x, 32)), bpe.digests(ids, bounds, d.write)
    monkeypatch.setattr(bpe, "RUN", 7)
    monkeypatch.setattr(bpe, "AT_ONCE", 3)
    e = bpe.Encoder(bpe.default_tokenizer())
    e.words.limit = e.fragments.limit = 100  # forgets at every turn
    parts = [e.encode(texts.slice(i, 5)) for i in range(0, len(texts), 5)]
    assert np.concatenate([p[0] for p in parts]).tolist() == ids.tolist()
    assert (bpe.digests(ids, bounds, lambda x: decimals.write(x, 32)), bpe.digests(ids, bounds, d.write)) == wide
    assert d.text(np.array([-1, 10**6, 0, 1])) == d.text(np.array([0, 1]))  # unknown ids are left out


def test_packing_gives_the_library_distinct_fragments_only(monkeypatch):
    import tokenizers

    class Counting:
        """A tokenizer, or its model, that counts the characters it is asked to encode."""

        asked = 0

        def __init__(self, real):
            object.__setattr__(self, "real", real)

        @staticmethod
        def from_file(path):
            return Counting(real.from_file(path))

        @staticmethod
        def from_str(text):
            return Counting(real.from_str(text))

        def __getattr__(self, name):
            got = getattr(self.real, name)
            if name == "model":
                return Counting(got)
            return self.counted(got) if name in ("encode", "encode_batch", "encode_batch_fast", "tokenize") else got

        def __setattr__(self, name, value):
            setattr(self.real, name, value)

        def counted(self, work):
            def run(texts, *a, **b):
                Counting.asked += sum(map(len, texts))
                return work(texts, *a, **b)

            return run

    real, parts = tokenizers.Tokenizer, [f"{a}{b}" for a in ("the", "ing", "blé", "qu", "straß") for b in ("er", "tion", "é", "ness")]
    words = [f"{a}{d}{b}" for a in parts for d in range(10) for b in parts]
    texts = [*ODD, " ".join(words), " ".join(words[::-1]), "word " * 5000]
    t = real.from_file(packing.default_tokenizer())
    want = [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    got = [[] for _ in texts]
    for out in packing._pieces(packing.default_tokenizer(), True)([batch]):
        for i, ids in zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist(), strict=True):
            got[i] += ids
    assert got == want
    assert 0 < Counting.asked < sum(map(len, words)) / 2


def test_memory_and_written():
    m, names = Memory(1), np.array([3, 5, 9], T.U)
    asked = []
    make = lambda w: asked.append(len(w)) or [(np.repeat(w, w + 1), w + 1)]
    rows = m.find(names, make)
    flat, size = m.take(0, rows[[2, 0, 2]])
    assert flat.tolist() == [2, 2, 2, 0, 2, 2, 2] and size.tolist() == [3, 1, 3]
    m.find(np.array([3, 4, 9], T.U), make)
    assert asked == [3, 1]
    data, ends = Written([b"a", b"", b"bcd"]).write(np.array([2, 1, 0]))
    assert bytes(data) == b"bcda" and ends.tolist() == [3, 3, 4]
    data, ends = Decimals(1001).write(np.array([0, 7, 10, 1000]), 44)
    assert bytes(data) == b"0,7,10,1000," and ends.tolist() == [2, 4, 7, 12]


def aligned(texts):
    """The contract, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_tokenizers()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=path_b)
    pair = alignment.Pair((path_a, path_b))
    rows, count = [], Counter()
    for text in texts:
        if not text:
            rows.append(None)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bx, by = [pair.bytes_a[i] for i in x], [pair.piece(b.id_to_piece(i)) for i in y]
        if not b"".join(bx) == b"".join(by) == (" " + text).encode():
            rows.append(None)
            continue
        ends = [np.cumsum([len(t) for t in s]).tolist() for s in (bx, by)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, i, j = [], 0, 0
        for c in common:
            p, q = ends[0].index(c) + 1, ends[1].index(c) + 1
            groups.append((x[i:p], y[j:q]))
            i, j = p, q
        found, begin, j = [], 0, 0
        for i, e in enumerate(ends[0]):
            while ends[1][j] <= begin:
                j += 1
            k = j
            while k < len(y) and (ends[1][k - 1] if k else 0) < e:
                found.append((x[i], y[k]))
                k += 1
            begin = e
        count.update(found)
        rows.append((x, y, groups, found))
    best = {}
    for (_, q), n in count.items():
        best[q] = max(best.get(q, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        x, y, groups, found = r
        digest = sha(";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups))
        out.append((len(x), len(y), len(groups), len(found), sum(count[p] == best[p[1]] for p in found), sum(count[p] for p in found), digest))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("hot", [alignment.HOT, 40, 0])
def test_alignment_equals_brute_force(docs, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT", hot)
    key = lambda r: (r[0] is None, r)
    want = sorted([(None if i == 3 else i, *r) for i, r in enumerate(aligned(ODD))], key=key)
    assert sorted(map(tuple, alignment.align(docs).select("doc_id", *COLUMNS).collect()), key=key) == want


def test_alignment_tables_equal_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in alignment.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == dict(zip([r.doc_id for r in rows], aligned([r.text for r in rows]), strict=True))


def test_alignment_without_rows(empty):
    got = alignment.align(empty)
    assert got.count() == 0 and set(COLUMNS) < set(got.columns)


def test_divide_and_conquer():
    rng = np.random.default_rng(5)
    for share in (0.02, 0.3, 0.9):
        first_a, first_b, ends_a, ends_b, want, base = [0], [0], [], [], [], 0
        for _ in range(30):
            n = int(rng.integers(0, 200))
            if n:
                a = sorted({n, *rng.choice(n, int(n * 0.5)).tolist()} - {0})
                b = sorted({n, *[x for x in a if rng.random() < share], *rng.choice(n, int(n * 0.3)).tolist()} - {0})
                i = j = 0
                for c in sorted(set(a) & set(b)):
                    p, q = a.index(c) + 1, b.index(c) + 1
                    want.append((len(ends_a) + i, len(ends_a) + p, len(ends_b) + j, len(ends_b) + q))
                    i, j = p, q
                ends_a += [base + x for x in a]
                ends_b += [base + x for x in b]
                base += n
            first_a.append(len(ends_a)), first_b.append(len(ends_b))
        got = alignment.groups(*map(np.array, (ends_a, ends_b, first_a, first_b)))
        assert list(map(tuple, got.T.tolist())) == want


LANGS = ["en", "de", None, "und"]


def phrase_rows():
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(30)] + ["Ünï", "the", "THE", "of", "en", "de"]
    texts = []
    for i in range(160):
        w = [vocabulary[k] for k in rng.zipf(1.3, int(rng.integers(1, 60))) % len(vocabulary)]
        for k in range(len(w)):
            w[k] += rng.choice(["", "", "", "", ",", ".", "\n", "\t", "  "])
        texts.append((i % 50, " ".join(w), LANGS[i % 4]))
    texts += [(1, "new york city hall", "en")] * 25 + [(2, "new york", "en")] * 30 + [(3, "a a a a a a a a a a a a", "de")] * 3
    texts += [(4, None, "en"), (None, "", "de"), (5, " . , ;", None), (6, "b" * 9000 + " c " * 3000, "long"), (7, "İ ẞ x İ ẞ", "en")]
    return texts


def mined(rows, least=10, share=50, top=2000):
    """The contract, phrase by phrase."""
    f = Counter()
    for _, text, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            f.update((lang or "und", tuple(w[i : i + k])) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    total = Counter()
    for (lang, p), n in f.items():
        total[lang] += n * (len(p) == 1)
    candidates = {x: n for x, n in f.items() if len(x[1]) > 1 and n >= least}
    out = {}
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and 100 * n >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), n in candidates.items()):
            continue
        score, k = min((1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top]))


RANKED = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


@pytest.mark.parametrize(("shards", "buckets", "common", "top"), [(2, 1 << 22, 10_000, 2000), (3, 16, 3, 7), (1, 1 << 10, 10_000, 3)])
def test_collocations_equal_brute_force(spark, monkeypatch, shards, buckets, common, top):
    for name, value in (("SHARDS", shards), ("FILTER", buckets), ("COMMON", common)):
        monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows()
    docs = spark.createDataFrame([(i, t, g, "x", "y", 0) for i, t, g in rows], "doc_id long, text string, lang string, word string, w1 string, n int").repartition(5)
    got = collocations.mined(docs, top)
    assert sorted(tuple(r[c] for c in RANKED) for r in got.collect()) == mined(rows, top=top)


def test_collocations_without_words(spark):
    kind = "doc_id long, text string, lang string"
    assert collocations.mined(spark.createDataFrame([], kind)).count() == 0
    assert collocations.mined(spark.createDataFrame([(1, None, None), (2, " .", "en")], kind)).count() == 0


def test_collocation_scores_are_exact(spark):
    """Products of counts beyond 64 bits."""
    a, b = 3_000_000_019, 3_000_000_037
    got = spark.range(1).select(collocations.score_of(F.lit(a), F.lit(b), F.lit(b + 2)).alias("s")).first()["s"]
    assert got == 1_000_000 * a * a // (b * (b + 2))


def test_collocations_oracle(spark):
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(collocations.ORACLE)
    order = list(want.columns)
    got = collocations.query(spark, "/root/testdata/sf0.001")
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(want.fetchall())
