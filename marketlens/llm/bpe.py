"""BPE encoding and decoding with forced boundaries.

A merge joins two neighbouring pieces into a token of the vocabulary, so no merge ever runs over a
pair of bytes that occurs inside no token. Such pairs are certain cuts: the fragments between them
are encoded independently, each distinct one once, and their ids are put one after the other.
White space is in no token; a text is first cut there, then normalised and split into the
tokenizer's own words, which are cut at the forced pairs. The last fragment of a word is encoded with
the end-of-word mark, the others without it. Special tokens inside texts are found before anything
else, as the library does.

Null and empty texts have no ids. Repeated rows are encoded once each; other columns are ignored;
null ids stay null. Texts of any length are encoded and written in runs of bounded size.
"""

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import lean, table
from marketlens.llm.memory import Decimals, Memory, Written, byte_level

RUN = 1 << 17  # tokens written at once
SIMPLE = 0x250  # characters below need no context: no combining marks
AT_ONCE = 1 << 13  # fragments whose ids are held as lists at once


def default_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Vocabulary:
    """The tokens of a BPE file: ids, bytes, special strings and the pairs of bytes inside tokens."""

    def __init__(self, path):
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        self.end, self.decoder = rules["model"]["end_of_word_suffix"] or "", rules["decoder"]
        self.special = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self.ids = rules["model"]["vocab"]
        self.strings = {i: s for s, i in [*self.ids.items(), *self.special.items()]}
        _, back = byte_level()
        self.joined = np.zeros((256, 256), bool)
        text = " ".join(s.removesuffix(self.end) for s in self.ids)  # no token holds a space
        b = np.fromiter(map((back | {" ": -1}).__getitem__, text), np.int16, len(text))
        inside = (b[:-1] >= 0) & (b[1:] >= 0)
        self.joined[b[:-1][inside], b[1:][inside]] = True


class Encoder:
    """Ids of texts. Remembers distinct white-space words, and below them distinct fragments."""

    def __init__(self, path):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        vocabulary = Vocabulary(path)
        self.marks, self.joined = vocabulary.special, vocabulary.joined
        del vocabulary  # its tables of all tokens are not needed any more
        whole = Tokenizer.from_file(path)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.parts = [Tokenizer.from_file(path).model, whole.model]  # the merges alone; the first without the end-of-word mark
        self.parts[0].end_of_word_suffix = None
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        chars, self.bytes = byte_level()
        self.chars = np.array([ord(chars[b]) for b in range(256)], np.uint32)
        self.words, self.fragments = Memory(1), Memory(1)
        self.kinds, self.written = self.simple_characters()

    def simple_characters(self):
        """Characters below SIMPLE that the tokenizer keeps or maps to one other, whatever stands beside them:
        their bytes and their kind, asked of the library. Kinds: 0 letter, 1 number, 2 other, 3 none of these.
        """
        kinds, written = np.full(SIMPLE, 3, np.int8), [b""] * SIMPLE
        for c in map(chr, range(SIMPLE)):
            one = self.split(c)
            if c in "'\0" or len(one) != 1 or len(one[0].decode()) != 1 or any(s.startswith(c) for s in self.marks):
                continue
            written[ord(c)] = one[0]
            kinds[ord(c)] = 0 if len(self.split("a" + c)) == 1 else 1 if len(self.split(c + c)) == 2 else 2
        return kinds, Written(written)

    def split(self, text):
        """The tokenizer's words of a text, as bytes."""
        if not text:
            return []
        pieces = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text) if self.normalizer else text)
        return [bytes(map(self.bytes.__getitem__, p)) for p, _ in pieces]

    def encode_fragments(self, raw, starts, ends, last):
        """Row in the memory of each fragment."""
        h = T.span_hashes(raw, starts, ends) ^ np.where(last, T.U(0x5DEECE66D), T.U(0))
        names, first, back = np.unique(h, return_index=True, return_inverse=True)

        def make(which):
            at, data = first[which], self.chars[raw].tobytes().decode("utf-32-le")
            flat, size = [], []
            for i in range(0, len(at), AT_ONCE):
                own = at[i : i + AT_ONCE]
                ids = [[t.id for t in self.parts[kind].tokenize(data[a:b])] for a, b, kind in zip(starts[own].tolist(), ends[own].tolist(), last[own].tolist(), strict=True)]
                size.append(np.fromiter(map(len, ids), np.int64, len(ids)))
                flat.append(np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(size[-1].sum())))
            return [(np.concatenate(flat), np.concatenate(size))]

        return self.fragments.find(names, make)[back]

    def encode_words(self, data, starts, ends):
        """Flat ids and sizes of white-space words, one at least."""
        raw = data[T.flat_positions(starts, ends - starts)[0]]
        joined = raw.tobytes().decode()
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        count = np.add.reduceat((raw & 0xC0) != 0x80, np.cumsum(ends - starts) - (ends - starts), dtype=np.int64)
        begin = np.cumsum(count) - count
        kind = self.kinds[np.minimum(codes, SIMPLE - 1)]
        kind[codes >= SIMPLE] = 3
        simple = np.maximum.reduceat(kind, begin) < 3
        own, pieces, special = [], [], []  # of each piece: its word, its bytes, the id of a special token or -1
        for k in np.flatnonzero(~simple).tolist():
            text = joined[begin[k] : begin[k] + count[k]]
            for part in self.special.split(text) if self.special else [text]:
                if part in self.marks:
                    own.append(k), pieces.append(b"\0"), special.append(self.marks[part])
                else:
                    for p in self.split(part):
                        own.append(k), pieces.append(p), special.append(-1)
        raw, bounds = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64)
        own, special = np.array(own, np.int64), np.array(special, np.int64)
        at, word = T.flat_positions(begin[simple], count[simple])
        if len(at):  # words of simple characters: a piece begins with a word, where the kind changes, and at each number
            kind, word = kind[at], np.flatnonzero(simple)[word]
            new = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 1) | (word[1:] != word[:-1])])
            data, ends = self.written.write(codes[at])
            ends = np.append(ends[np.flatnonzero(new)[1:] - 1], ends[-1])
            raw, bounds = np.concatenate([raw, data]), np.concatenate([bounds, bounds[-1] + ends])
            own, special = np.concatenate([own, word[new]]), np.concatenate([special, np.full(len(ends), -1)])
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(count), np.int64)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:-1] = ~self.joined[raw[:-1], raw[1:]]
        cut[bounds] = True
        at = np.flatnonzero(cut)
        starts, ends = at[:-1], at[1:]
        piece = np.searchsorted(bounds, starts, "right") - 1
        rows = self.encode_fragments(raw, starts, ends, ends == bounds[piece + 1])
        order = np.argsort(own[piece], kind="stable")  # back to the order of the words
        rows, piece = rows[order], piece[order]
        flat, size = self.fragments.take(0, rows)
        if (special >= 0).any():
            marked = special[piece]
            flat[(np.cumsum(size) - size)[marked >= 0]] = marked[marked >= 0]  # a zero byte is one token
        total = np.zeros(len(count), np.int64)
        np.add.at(total, own[piece], size)
        return flat, total

    def encode(self, column):
        """Flat ids of all texts and their bounds (n+1)."""
        h, first, data, starts, ends = T.words(column, "space")
        names, where, back = np.unique(h, return_index=True, return_inverse=True)
        rows = self.words.find(names, lambda which: [self.encode_words(data, starts[where[which]], ends[where[which]])])
        ids, size = self.words.take(0, rows[back])
        return ids, np.concatenate([[0], np.cumsum(size)])[first]


class Decoder:
    """Texts of ids: the tokens' strings joined by spaces, as a file without a decoder has it; unknown ids are left out."""

    def __init__(self, path):
        vocabulary = Vocabulary(path)
        if vocabulary.decoder:
            raise ValueError("a vocabulary with a decoder of its own")
        self.most = max(vocabulary.strings) + 1
        self.known = np.array([i in vocabulary.strings for i in range(self.most)])
        self.written = Written([(vocabulary.strings.get(i, "") + " ").encode() for i in range(self.most)])

    def select(self, ids):
        """Which ids are known."""
        good = (ids >= 0) & (ids < self.most)
        good[good] = self.known[ids[good]]
        return good

    def write(self, ids):
        return self.written.write(ids[self.select(ids)])

    def text(self, ids):
        runs = [bytes(self.write(ids[i : i + RUN])[0]) for i in range(0, len(ids), RUN)]
        return b"".join(runs)[:-1].decode()


def digests(ids, bounds, write):
    """SHA-256 of what write() gives for each text's ids, without the last byte; in runs of RUN tokens."""
    out, i, n = [], 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + RUN, "right")) - 1)
        if j > i + 1:
            data, ends = write(ids[bounds[i] : bounds[j]])
            data, ends = data.tobytes(), np.concatenate([[0], ends])[bounds[i : j + 1] - bounds[i]].tolist()
            out += [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
        else:
            h = hashlib.sha256()
            for k in range(int(bounds[i]), int(bounds[j]), RUN):
                data = write(ids[k : min(k + RUN, int(bounds[j]))])[0].tobytes()
                h.update(data if k + RUN < bounds[j] else data[:-1])
            out.append(h.hexdigest())
        i = j
    return out


def encode(docs, tokenizer=None):
    """doc_id and ids of every row."""
    path = tokenizer or default_tokenizer()

    def work(batches):
        encoder = Encoder(path)
        for batch in batches:
            for part in T.slices(batch, "text", T.CHUNK // 2):
                ids, bounds = encoder.encode(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(work), "doc_id long, ids array<int>")


def decode(rows, tokenizer=None):
    """doc_id and text of every row of encode(); a null list is an empty text."""
    path = tokenizer or default_tokenizer()

    def work(batches):
        decoder = Decoder(path)
        for batch in batches:
            texts = [decoder.text(np.array(x.as_py() or [], np.int64)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(lean(work), "doc_id long, text string")


def round_trip(docs, tokenizer=None):
    """doc_id, n_tokens and the digests of the ids and of the text decoded from them, of every row."""
    path = tokenizer or default_tokenizer()

    def work(batches):
        encoder, decoder = Encoder(path), Decoder(path)
        decimals = Decimals(decoder.most)
        for batch in batches:
            for part in T.slices(batch, "text", T.CHUNK // 2):
                ids, bounds = encoder.encode(part.column("text"))
                columns = [part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(digests(ids, bounds, lambda x: decimals.write(x, 32))), pa.array(digests(ids, bounds, decoder.write))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lean(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir):
    """op11: every document's ids and the text they decode to, as digests."""
    return round_trip(table(spark, sf_dir, "documents"))
