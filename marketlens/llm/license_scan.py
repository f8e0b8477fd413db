"""License scans by a positional index of rare licence words.

Templates are short licence notices with mandatory key phrases. The index holds, for every template,
postings (template, position) of all its words. How rare a licence word is (its IDF) comes from its
document frequency over all documents. Each file looks up its own words: of the licence words that
it holds, for each template that it may hold (no mandatory word is missing), the RARE words of
highest IDF, and the PHRASE words of highest IDF of every mandatory phrase. Their postings are
intersected by relative position (document position minus template position): a start is a
candidate where at least two looked-up words agree. It counts once all mandatory phrases stand there
word by word and SHARE of the template's IDF weight is in place. The four base phrases are templates that
are one mandatory phrase; where such a phrase stands, its looked-up words agree, so no place is missed.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Null and empty
texts have no words: counts of 0, null positions, empty labels, score 0. Repeated rows are scanned
alike. Other columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import lean, table

U = np.uint64

# Base phrases and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices of public licences: label, text, mandatory phrases (all are needed).
NOTICES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ["gnu general public license version 2"]),
    ("lgpl", "this library is free software you can redistribute it under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge", "this software and associated documentation files"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights cc0 1 0 universal", ["cc0 1 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("bsd", "released under the bsd 3 clause license", ["bsd 3 clause license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "this program is made available under the terms of the eclipse public license 2 0", ["eclipse public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("proprietary", "all rights reserved no part of this publication may be reproduced", ["all rights reserved"]),
]
RARE = 3  # words of highest IDF in a file that are looked up for a template
PHRASE = 2  # of each mandatory phrase
SHARE = 0.5  # least share of a notice's IDF weight that must stand in place


def word_hashes(text):
    h, *_ = T.words(pa.array([text]), "alnum", lower=True)
    return h


class Template:
    def __init__(self, label, text, mandatory, base=None):
        self.label, self.base, self.words = label, base, word_hashes(text)
        self.mandatory = [(self.find(word_hashes(p)), word_hashes(p)) for p in mandatory]

    def find(self, phrase):
        """Where a phrase begins in the template, which must hold it."""
        return next(i for i in range(len(self.words) - len(phrase) + 1) if (self.words[i : i + len(phrase)] == phrase).all())


def templates():
    """Base phrases as templates, then the notices."""
    return [Template(label, p, [p], base=i) for i, (p, label) in enumerate(BASE)] + [Template(*n) for n in NOTICES]


def licence_words(found):
    return np.unique(np.concatenate([t.words for t in found]))


def _frequencies(vocabulary):
    def count(batches):
        n, df = 0, np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for part in T.slices(batch, "text"):
                h, first, *_ = T.words(part.column("text"), "alnum", lower=True)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                hit = np.flatnonzero(vocabulary[at] == h)
                owner = np.searchsorted(first, hit, "right") - 1
                pair = np.unique(owner * len(vocabulary) + at[hit])
                df += np.bincount(pair % len(vocabulary), minlength=len(vocabulary))
                n += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(vocabulary.view(np.int64), 0)), pa.array(np.append(df, n)), pa.array(np.append(np.zeros(len(df), bool), True))], ["h", "df", "all"])

    return lean(count)


def rarity(docs, vocabulary):
    """ln((N + 1) / (df + 1)) of each licence word over all documents; as many values as words."""
    parts = docs.select("text").mapInArrow(_frequencies(vocabulary), "h long, df long, all boolean")
    rows = parts.groupBy("h", "all").agg(F.sum("df").alias("df")).collect()
    n = sum(r.df for r in rows if r["all"])
    df = {r.h: r.df for r in rows if not r["all"]}
    return np.array([np.log((n + 1) / (df.get(int(h), 0) + 1)) + 1e-6 for h in vocabulary.view(np.int64)])


class Index:
    """Postings of all words of the templates, and how rare the words are."""

    def __init__(self, found, vocabulary, idf):
        self.templates, self.vocabulary, self.idf = found, vocabulary, idf
        self.at = [np.searchsorted(vocabulary, x.words) for x in found]  # each position's word
        self.weights = [idf[v] for v in self.at]

    def looked_up(self, t, holds):
        """Whether each file looks up each distinct word of template t, and these words.

        holds: whether each file holds each word of the vocabulary.
        """
        x, at = self.templates[t], self.at[t]
        words = np.unique(at)
        words = words[np.lexsort((words, -self.idf[words]))]  # highest IDF first
        here = holds[:, words]
        take = here & (np.cumsum(here, axis=1) <= RARE)
        possible = np.ones(len(holds), bool)
        for begin, phrase in x.mandatory:
            inside = np.isin(words, at[begin : begin + len(phrase)])
            possible &= here[:, inside].all(axis=1)
            take |= inside & (np.cumsum(inside) <= PHRASE)
        return take & possible[:, None], words

    def candidates(self, h, first):
        """(template, document, start) where looked-up words of a file agree on the relative position."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        hit = np.flatnonzero(self.vocabulary[at] == h)
        word, owner = at[hit], np.searchsorted(first, hit, "right") - 1
        files, own = np.unique(owner, return_inverse=True)  # only files with licence words
        holds = np.zeros((len(files), len(self.vocabulary)), bool)
        holds[own, word] = True
        order = np.argsort(word, kind="stable")
        cuts = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        for t, x in enumerate(self.templates):
            take, words = self.looked_up(t, holds)
            if not take.any():
                continue
            start, doc, by = [], [], []
            for k in np.flatnonzero(take.any(axis=0)):
                places = order[cuts[words[k]] : cuts[words[k] + 1]]
                places = places[take[own[places], k]]
                for i in np.flatnonzero(self.at[t] == words[k]):
                    start.append(hit[places] - i)
                    doc.append(owner[places])
                    by.append(np.full(len(places), k))
            found = np.unique(np.stack([np.concatenate(doc), np.concatenate(start), np.concatenate(by)]), axis=1)
            place, agree = np.unique(found[:2], axis=1, return_counts=True)
            place = place[:, agree >= min(2, len(np.unique(x.words)))]
            if place.shape[1]:
                yield t, place

    def scan(self, h, first):
        """Base places (phrase, document, start) and verified notices (template, document, score)."""
        base, notices = [], []
        for t, (doc, start) in self.candidates(h, first):
            x, w = self.templates[t], self.weights[t]
            lo, hi = first[doc], first[doc + 1]
            where = start[:, None] + np.arange(len(x.words))
            inside = (where >= lo[:, None]) & (where < hi[:, None])
            same = inside & (h[np.clip(where, 0, max(len(h) - 1, 0))] == x.words)
            share = (same * w).sum(axis=1) / w.sum()
            ok = share >= SHARE
            for begin, phrase in x.mandatory:
                ok &= same[:, begin : begin + len(phrase)].all(axis=1)
            if x.base is not None:
                base.append((np.full(ok.sum(), x.base), doc[ok], start[ok] - lo[ok]))
            else:
                notices.append((np.full(ok.sum(), t), doc[ok], share[ok]))
        join = lambda x, k: np.concatenate([y[k] for y in x]) if x else np.zeros(0, np.int64)
        return [join(base, k) for k in range(3)], [join(notices, k) for k in range(3)]


FOUND = "doc_id long, n_words long, places array<struct<label string, start long>>, notices array<struct<label string, score double>>"


def _scan(shared):
    kinds = [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())])), pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64())]))]

    def scan(batches):
        index = shared.value
        for batch in batches:
            for part in T.slices(batch, "text"):
                h, first, *_ = T.words(part.column("text"), "alnum", lower=True)
                (p, pd, ps), (t, td, tw) = index.scan(h, first)
                places, notices = [[] for _ in range(part.num_rows)], [{} for _ in range(part.num_rows)]
                for a, b, c in sorted(zip(pd.tolist(), ps.tolist(), p.tolist(), strict=True)):
                    places[a].append({"label": BASE[c][1], "start": b})
                for a, b, c in zip(t.tolist(), td.tolist(), tw.tolist(), strict=True):
                    label = index.templates[a].label
                    notices[b][label] = max(c, notices[b].get(label, 0.0))
                notices = [[{"label": k, "score": float(v)} for k, v in sorted(x.items())] for x in notices]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(places, kinds[0]), pa.array(notices, kinds[1])], ["doc_id", "n_words", "places", "notices"])

    return lean(scan)


def scan_licenses(docs):
    """doc_id, n_words, places of base phrases (label, start) and verified notices (label, score)."""
    found = templates()
    vocabulary = licence_words(found)
    index = Index(found, vocabulary, rarity(docs, vocabulary))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(shared), FOUND)


def query(spark, sf_dir):
    """op2: base places, labels and score of every document."""
    x = scan_licenses(table(spark, sf_dir, "documents"))
    base, starts = F.col("places.label"), F.col("places.start")
    score = F.coalesce(F.array_max("notices.score"), F.lit(0.0))
    return x.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("notices.label"))), ",").alias("labels"),
        F.greatest(score, F.when(F.size("places") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
