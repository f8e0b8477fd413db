"""URL filters: rules first, then logistic regression on hashed character n-grams.

Host and path are hashed separately, as n-grams of NGRAMS characters with boundary marks. The
weights come from a small labelled URL table, a parameter whose default is below. Rules name a
host and a path prefix, fit the host and its subdomains, and the longest that fits decides.

A null url or one without :// has an empty host and path, which no rule fits and the model judges
by its bias (allowed). Repeated rows are judged alike; other columns are ignored.
"""

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.llm.common import table

NGRAMS = (3, 4, 5)
BUCKETS = 1 << 16
THRESHOLD = 0.5

# Rules as (verdict, host and path).
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]

# Words of the labelled URL table, unwanted ones by topic, and ordinary ones.
UNWANTED_TOPICS = {
    "gambling": "casino poker betting roulette jackpot slots lottery bingo wager blackjack bets win".split(),
    "pharmacy": "viagra cialis pharmacy pills steroids meds drugstore cheap weightloss".split(),
    "adult": "porn xxx sex escort nude adult erotic camgirls hentai".split(),
    "advertising": "adserver popunder adclick tracker banner ads track doubleclick clicks affiliate".split(),
    "fraud": "spam linkfarm backlinks phishing malware scam replica payday warez crack".split(),
}
BAIT = "free best online top bonus 24 hot vip x farm deals".split()
ORDINARY = """university library daily museum weather council wiki docs developer institute school research journal cooking gardening history science travel
guide music theatre tools hospital parliament railway bookshop maps archive recipes village chess football astronomy nature kitchen stories paper water
swimming orchestra teacher notes farm shop data hiking bridge building online press church energy forum people health studio family news""".split()
LANGUAGES = "en de fr es it nl pt pl sv ja".split()
SECTIONS = ["", "about", "news/2021", "docs/intro", "index.html", "contact", "blog/post", "category/items"]
BAD_SECTIONS = ["buy/pills", "casino/bonus", "adult/gallery", "click/redirect", "jackpot/spin", "porn/videos", "ads/banner", "offer/free"]
TOPS = ["example.com", "example.org", "example.net", "com", "org", "net"]


def labelled_urls(seed=3, size=300):
    """(host, path, unwanted) rows by rule: size unwanted hosts and three times as many ordinary ones, with paths of language, number and section.

    Plain paths are drawn alike for both kinds of hosts, so that what decides is the host or an unwanted section.
    """
    rng = random.Random(seed)
    syllables = [c + v for c in "b c d f g h k l m n p r s t v w z bl br ch cl dr fr gr pl pr sh sp st str th tr".split() for v in "aeiou"]
    plain = lambda: "/" + rng.choice([f"{rng.choice(LANGUAGES)}/{rng.randint(1, 999)}", f"{rng.choice(LANGUAGES)}/{rng.choice(SECTIONS)}", rng.choice(SECTIONS)])

    def unwanted():
        topic = list(UNWANTED_TOPICS.values())[rng.randrange(len(UNWANTED_TOPICS))]
        words = rng.choice([[rng.choice(topic), rng.choice(topic)], [rng.choice(BAIT), rng.choice(topic)], [rng.choice(topic), rng.choice(BAIT)], [rng.choice(topic)]])
        return rng.choice(("-", "-", "")).join(words)

    def ordinary():
        name = "".join(rng.choices(syllables, k=rng.randint(2, 4))) + rng.choice(("", "n", "s", "r", "th"))
        return rng.choice([rng.choice(("-", "")).join(rng.sample(ORDINARY, 2)), rng.choice(ORDINARY), name, name])

    rows = []
    for _ in range(size):
        for name, y in ((unwanted(), 1), (ordinary(), 0), (ordinary(), 0), (ordinary(), 0)):
            host = rng.choice(("", "www.", "m.", "blog.")) + f"{name}.{rng.choice(TOPS)}"
            rows += [(host, plain(), y), (host, plain(), y)]
            rows += [(host, f"/{rng.choice(BAD_SECTIONS)}", 1)] if y else []
    return rows


def ngrams(host, path):
    """Sorted distinct buckets of the n-grams of host and path."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in NGRAMS:
            for i in range(len(text) - n + 1):
                found.add(zlib.crc32(f"{kind}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS)
    return np.fromiter(sorted(found), np.int64, len(found))


def train(rows, epochs=60, rate=0.5, penalty=1e-4):
    """Weights per bucket and a bias, by stochastic gradient descent."""
    weights, bias = np.zeros(BUCKETS), -1.0
    data = [(ngrams(h, p), y) for h, p, y in rows]
    rng = np.random.default_rng(11)
    for epoch in range(epochs):
        step = rate / (1 + epoch)
        for i in rng.permutation(len(data)):
            x, y = data[i]
            g = 1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + bias))) - y
            weights[x] -= step * (g / np.sqrt(max(1, len(x))) + penalty * weights[x])
            bias -= 0.1 * step * g
    return weights, bias


def _judge(shared):
    def judge(batches):
        weights, bias = shared.value
        for batch in batches:
            scores = []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                x = ngrams(h, p)
                scores.append(1 / (1 + np.exp(-(weights[x].sum() / np.sqrt(max(1, len(x))) + bias))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, "score"])

    return judge


def split_urls(pages):
    """page_id, host and path of every row."""
    part = lambda i: F.coalesce(F.regexp_extract("url", r"(?s)^.*?://([^/?#]*)([^?#]*)", i), F.lit(""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return pages.select("page_id", F.translate(part(1), upper, upper.lower()).alias("host"), part(2).alias("path"))


def rule_column(rules):
    """The longest rule that fits host and path, or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(f"/{path}")
        out = F.when(fits, rule).otherwise(out)
    return out


def judge(pages, rules=RULES, labelled=None):
    """page_id, host, path, rule, score of the model, and verdict of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled or labelled_urls()))
    scored = split_urls(pages).mapInArrow(_judge(shared), f"page_id {dict(pages.dtypes)['page_id']}, host string, path string, score double")
    out = scored.withColumn("rule", rule_column(rules))
    verdict = F.when(F.col("score") >= THRESHOLD, "block").otherwise("allow")
    for v, rule in rules:
        verdict = F.when(F.col("rule") == rule, v).otherwise(verdict)
    return out.withColumn("verdict", verdict)


def query(spark, sf_dir):
    """op4: host, path, rule and verdict of every page."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "score")
