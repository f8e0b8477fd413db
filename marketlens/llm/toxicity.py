"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Text is lower-cased, homoglyphs and digit substitutions are folded to Latin letters, and one
automaton finds all lexicon words and exception phrases. A match must stand alone as a word, or
begin one if the entry is a stem; one inside an exception phrase doesn't count. A document's evidence is the sum of its words'
weights (capped per word) and that sum per square root of its length in characters over six; a
logistic model turns both into a score.

Weights and the logistic model are learned from at most SAMPLE labelled rows (in hash order of their
ids), whatever the size of the input. Words join the lexicon one by one, the best explained share
of toxic rows first; rows that a word explains leave the count, so words that merely accompany it
in copies don't follow. Seed words start with a prior, and so do the coefficients: PRIOR counts like
PRIOR_ROWS rows, so few or no labels leave them near it.

Null and empty texts get the score of no evidence. Repeated rows score alike; rows without label
teach nothing. Other columns are ignored. Words of any length may be learned; texts are folded in
runs of SLICE bytes, a longer text alone.
"""

import re
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm import tokens as T
from marketlens.llm.common import checkpointed, each, held_out, labelled_sample, lean, table

SAMPLE = 8000  # labelled rows that teach, at most
LEAST = 3  # toxic rows that a learned word must explain
PRECISION = 0.6  # least share of toxic rows among the rows a learned word explains
SHORTEST = 3  # letters of a learned word; shorter ones say nothing alone
PRIOR = (-3.0, 1.0, 2.0)  # bias, and weights of evidence and density
PRIOR_ROWS = 30
SLICE = 1 << 18  # bytes of text that are Python strings at once
THRESHOLD = 0.3
STEM = "*"  # ends an entry that may be continued: a learned stem
STEMS = range(4, 9)  # lengths of stems that may be learned

# Seed words and exception phrases in which they are harmless.
SEEDS = "idiot moron scum worthless pathetic clown trash loser disgusting stupid dumb imbecile cretin jerk bastard vermin filth retard subhuman degenerate scumbag garbage dumbass asshole bitch slut whore idioten abschaum dummkopf arschloch trottel connard salope crétin ordure imbécil estúpido basura escoria".split()
EXCEPTIONS = ["trash can", "trash bin", "clown fish", "class clown", "trash bag", "garbage collection", "garbage collector", "garbage truck", "sore loser", "pond scum", "circus clown"]

# Letters and digits that stand for Latin letters.
HOMOGLYPHS = str.maketrans(
    "аеорсухіјѕԁһкмтвнοαερτιυκν013457",
    "aeopcyxijsdhkmtbhoaeptiukvoieast",
)
INNER = re.compile(r"(?<=\w)[@$!|](?=\w)")
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l"}
TWIN = re.compile(r"[^\W\d_]+")


def fold(text):
    """Lower case, homoglyphs and substituted digits and signs as Latin letters; same length."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals lower to two characters
        low = "".join(c if len(c) == 1 else c[0] for c in map(str.lower, text))
    low = INNER.sub(lambda m: SIGNS[m[0]], low)
    return low.translate(HOMOGLYPHS)


def is_letter(c):
    return c.isalnum()


class Lexicon:
    """Weighted words and exceptions in one automaton."""

    def __init__(self, weights, exceptions=tuple(EXCEPTIONS)):
        self.weights, self.exceptions = dict(weights), list(exceptions)
        self.automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "automaton": None}

    def build(self):
        self.automaton = ahocorasick.Automaton()
        for w in self.weights:
            self.automaton.add_word(fold(w.removesuffix(STEM)), (len(w.removesuffix(STEM)), w))
        for p in self.exceptions:
            self.automaton.add_word(fold(p), (len(p), None))
        self.automaton.make_automaton()
        return self

    def matches(self, text):
        """(start, end, word) of each lexicon word that stands alone outside exception phrases."""
        if self.automaton is None:
            self.build()
        if not len(self.automaton):
            return []
        low = fold(text)
        found, shields = [], []
        for last, (size, word) in self.automaton.iter(low):
            start, end = last - size + 1, last + 1
            if start and is_letter(low[start - 1]):
                continue
            if end < len(low) and is_letter(low[end]) and not (word or "").endswith(STEM):
                continue
            (found.append((start, end, word)) if word is not None else shields.append((start, end)))
        if shields:
            found = [x for x in found if not any(a <= x[0] and x[1] <= b for a, b in shields)]
        return found

    def evidence(self, text):
        """Summed weight, and summed weight per square root of the length in words."""
        if not text:
            return 0.0, 0.0
        count = Counter(w for _, _, w in self.matches(text))
        total = sum(self.weights[w] * min(n, 3) for w, n in count.items())
        return total, total / np.sqrt(1 + len(text) / 6)


def learn_weights(rows):
    """Greedy lexicon from (words, toxic) rows: word -> weight. Rows are few and bounded."""
    holds, toxic = defaultdict(set), {i for i, (_, y) in enumerate(rows) if y}
    for i, (words, _) in enumerate(rows):
        for w in words:
            holds[w].add(i)
    base = (len(toxic) + 1) / (len(rows) + 2)
    weight = lambda p, n: float(np.log((p + 0.5) / (n + 0.5)) - np.log(base / (1 - base)))
    seeds = {w: weight(len(holds[fold(w)] & toxic) + 3, len(holds[fold(w)] - toxic)) for w in SEEDS}
    lexicon = {w: v for w, v in seeds.items() if v > 0}
    left = set(range(len(rows))) - set().union(*(holds[fold(w)] for w in lexicon))
    pool = {w: d for w, d in holds.items() if len(d & toxic) >= LEAST and len(w.removesuffix(STEM)) >= SHORTEST}
    while pool:
        best, open_ = None, toxic & left
        pool = {w: d for w, d in pool.items() if len(d & open_) >= LEAST}
        for w in sorted(pool):
            d = pool[w] & left
            p = len(d & toxic)
            n = len(d) - p
            if p >= PRECISION * (p + n) and p > 3 * base * (p + n) and (best is None or p - 2 * n > best[0]):
                best = (p - 2 * n, w, p, n)
        if best is None:
            break
        lexicon[best[1]] = weight(best[2], best[3])
        left -= pool.pop(best[1])
    return lexicon


def fit_scores(features, toxic, rounds=2000):
    """Logistic coefficients (bias, total, density) by gradient descent from the prior, and back towards it."""
    x, y, prior = np.log1p(np.asarray(features, float).reshape(-1, 2)), np.asarray(toxic, float), np.array(PRIOR)
    if not len(y):
        return prior
    scale = np.maximum(np.append(1.0, x.max(axis=0)), 1e-9)
    z = np.column_stack([np.ones(len(x)), x]) / scale
    start = prior * scale
    c = start.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ c))
        c = c - 2.0 * (z.T @ (p - y) + PRIOR_ROWS * 0.02 * (c - start)) / (len(y) + PRIOR_ROWS)
        c[1:] = np.maximum(c[1:], 0)
    return c / scale


def entries(text):
    """Folded words of a text and their stems: what the lexicon may learn from it."""
    words = {w for w in TWIN.findall(fold(text)) if len(w) >= SHORTEST}
    return words | {w[:k] + STEM for w in words for k in STEMS if len(w) > k}


def _entries(shared=None):
    """(y, words) of sample rows: all entries, or those in a shared set."""

    def read(batches):
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                words = [sorted(entries(t) if shared is None else entries(t) & shared.value) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array(words, pa.list_(pa.string()))], ["y", "words"])

    return lean(read)


def learn(docs, labels):
    """The lexicon and score coefficients from a bounded sample of labelled rows."""
    context, kind = docs.sparkSession.sparkContext, "y int, words array<string>"
    sample = checkpointed(labelled_sample(docs, labels, "toxic", SAMPLE).groupBy("text").agg(F.max("y").alias("y")))
    counts = each(sample.mapInArrow(_entries(), kind), ["y"], "words", "w").groupBy("w").agg(F.sum("y").alias("p"), F.count("*").alias("n"))
    common = counts.where((F.col("p") >= LEAST) & (F.col("p") >= 0.4 * F.col("n"))).select("w").collect()
    known = context.broadcast(frozenset({r.w for r in common} | {fold(w) for w in SEEDS}))
    rows = sorted((tuple(r.words), r.y) for r in sample.mapInArrow(_entries(known), kind).collect())
    lexicon = Lexicon(learn_weights(rows) if rows else dict.fromkeys(SEEDS, 2.0))
    pairs = sample.mapInArrow(_measured(context.broadcast((lexicon, None)), _evidence), "y int, total double, density double").collect()
    pairs = sorted((r.total, r.density, r.y) for r in pairs)
    return lexicon, fit_scores([p[:2] for p in pairs], [p[2] for p in pairs])


def _measured(shared, finish):
    """A task that computes evidence of runs of rows and hands them to finish(rows, evidence, coefficients)."""

    def measure(batches):
        lexicon, c = shared.value
        lexicon.build()
        for batch in batches:
            for part in T.slices(batch, "text", SLICE):
                got = np.array([lexicon.evidence(t.as_py()) for t in part.column("text")], float).reshape(-1, 2)
                out = finish(part, got, c)
                if out.num_rows:
                    yield out

    return lean(measure)


def probability(evidence, c):
    return 1 / (1 + np.exp(-(c[0] + np.log1p(evidence) @ c[1:])))


def _evidence(part, got, _):
    return pa.RecordBatch.from_arrays([part.column("y"), pa.array(got[:, 0]), pa.array(got[:, 1])], ["y", "total", "density"])


def _score(part, got, c):
    return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(probability(got, c)), pa.array(got[:, 0])], ["doc_id", "score", "evidence"])


def score_toxicity(docs, model):
    """doc_id, score in 0 to 1, and the summed weight of matches, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured(shared, _score), "doc_id long, score double, evidence double")


def keep_clean(docs, model, threshold=THRESHOLD):
    """The rows whose score is below the threshold, with all columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_measured(shared, lambda part, got, c: part.filter(pa.array(probability(got, c) < threshold))), docs.schema)


def query(spark, sf_dir):
    """op1: held_out, score and prediction of every document."""
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
