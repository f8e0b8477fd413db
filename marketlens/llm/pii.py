r"""Personal data by candidate gradient boosting, in DataFrame functions only.

Generators with high recall propose spans that may overlap: strict forms (e-mail, ip, card, phone)
and loose ones (spelled-out e-mail, colon ip, long digit runs with or without a valid check digit,
phone without country code, keys and tokens). Every candidate has format features (digits,
checksum, separators, shape) and context features (cue words and signs around it), as bits of one number.

Boosted trees of depth two learn from a labelled table of short phrases: values drawn by a seeded generator
in contexts in which they are personal or not; its candidates come from the same
generators. No feature says which form proposed a candidate or whether it passed a form's check. Other values in
other contexts, which the trees don't see, calibrate: a logistic curve per kind maps scores to probabilities, and
a kind's threshold is the score at which that is SURE. Tests hold both against a third set of values and contexts.
Strict candidates that pass their check stay whatever the trees say; loose ones above
their threshold are added where they overlap none of them and none added before. A long number in running text counts as an
account number unless its context says order, build, serial or the like.

A document is judged in its own row, in one pass: nothing is shuffled and texts don't move. Null and
empty texts have no spans. Repeated rows are judged alike and returned each. Other columns are kept
by redact(), whatever their names, and ignored else. Positions are code points, ends exclusive.
"""

import math
import random
import zlib

from pyspark.sql import functions as F

from marketlens.llm.common import table

KINDS = ("email", "ip", "card", "phone", "secret")

# Candidate forms. Guards keep every start linear in the text: inside a run that
# has just failed no new attempt begins, except where the last match ended.
STRICT = [
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    ("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
LOOSE = [
    ("email", r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[(]dot[\])]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++"),
    ("ip", r"(?i)(?<![0-9a-f:])(?:[0-9a-f]{1,4}+:){5,7}+[0-9a-f]{1,4}+(?![0-9a-f:])"),
    ("card", r"(?<![0-9./_-])[0-9]{4}([\x20./_-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9./_-])"),
    ("card", r"(?<![0-9A-Za-z])[0-9]{13,19}+(?![0-9A-Za-z])"),
    ("phone", r"(?<![0-9A-Za-z.+-])\(?0[0-9]{1,4}\)?[\x20./-][0-9]{3,4}[\x20./-]?[0-9]{3,5}(?![0-9A-Za-z.-])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?![A-Za-z0-9+/_-])"),
]
FORMS = [(k, False, p) for k, p in STRICT] + [(k, True, p) for k, p in LOOSE]
CUES = {
    "contact": r"(?i)(?:e-?mail|contact|write to|reach|mailto)[^\n]{0,12}$",
    "number": r"(?i)(?:tel|phone|call|mobile|fax|whatsapp)[^\n]{0,12}$",
    "pay": r"(?i)(?:card|visa|iban|account|payment|credit)[^\n]{0,12}$",
    "network": r"(?i)(?:\bip\b|ipv6|host|server|address|login from)[^\n]{0,12}$",
    "secret": r"(?i)(?:token|secret|passw(?:or)?d|pwd|api.?key|access.?key|private.?key|auth|credential|bearer)[^\n]{0,12}$",
    "code": r"(?i)(?:order|version|build|release|serial|isbn|commit|sha-?[0-9]*|md5|hash|checksum|digest|invoice|tracking|timestamp|fingerprint|file|path|\bid|\bno|#)[^\n]{0,8}$",
    "set": r"[=:]\x20?[\"']?$",
    "joined": r"[A-Za-z0-9=/_.#-]$",
}
BITS = 21
ROUNDS = 40
RATE = 0.3
SURE = 0.8
CONTEXT = 24
RUN = 256


def _hint(text, kind, loose):
    """A cheap test that a text can hold a form at all, by the form's own rule of case."""
    if kind == "email":
        return F.rlike(text, F.lit(r"(?i)[\[(\x20]at[\])\x20]")) if loose else F.contains(text, F.lit("@"))
    if kind == "phone" and not loose:
        return F.contains(text, F.lit("+"))
    return F.contains(text, F.lit(":")) if kind == "ip" and loose else F.col("digits")


def _appended(value, more=""):
    """SQL of a step that appends a value to a list kept in runs of RUN, so that long lists are not copied at every step."""
    return f"IF(size(a.run) < {RUN}, named_struct('run', array_append(a.run, {value}), 'runs', a.runs{more}), named_struct('run', array({value}), 'runs', array_append(a.runs, a.run){more}))"


def _empty(kind, more=""):
    return f"named_struct('run', CAST(array() AS array<{kind}>), 'runs', CAST(array() AS array<array<{kind}>>){more})"


WHOLE = "flatten(array_append(a.runs, a.run))"


def _starts(n):
    """SQL of the code point at which each match of form n starts: lengths of gaps and matches, added up."""
    step = _appended("a.at + x.gap", ", 'at', a.at + x.gap + x.n")
    return f"aggregate(transform(m{n}, (m, i) -> named_struct('gap', length(g{n}[i]), 'n', length(m))), {_empty('int', ', ' + repr('at') + ', 0')}, (a, x) -> {step}, a -> {WHOLE}) AS s{n}"


def _structs(n, kind, loose):
    # over the starts themselves: within a lambda, the optimizer would put in what they are made of, to be computed for every element
    return (
        f"transform(s{n}, (at, i) -> named_struct('kind', {KINDS.index(kind)}, 'loose', {str(loose).lower()}, 'start', at, 'value', m{n}[i], "
        f"'before', substring(g{n}[i], -{CONTEXT}, {CONTEXT}), 'after', substring(g{n}[i + 1], 1, 1)))"
    )


def candidates(docs):
    """Rows (row, text, found): all columns as a struct, and all generators' spans as an array."""
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct("*").alias("row"), F.col("text").alias("text")).withColumn("digits", F.rlike("text", F.lit("[0-9]")))
    rows = rows.select("row", "text", *(F.when(_hint(F.col("text"), kind, loose), F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"m{n}") for n, (kind, loose, p) in enumerate(FORMS)))
    rows = rows.select("*", *(F.when(F.size(f"m{n}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g{n}") for n, (*_, p) in enumerate(FORMS)))
    rows = rows.selectExpr("*", *map(_starts, range(len(FORMS))))
    return rows.selectExpr("row", "text", f"concat({', '.join(_structs(n, kind, loose) for n, (kind, loose, _) in enumerate(FORMS))}) AS found")


def _luhn(digits):
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _octets(value):
    plain = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(plain(p)) <= 3) & (F.substring(plain(p), 1, 3).cast("int") <= 255))


def with_features(rows):
    """found with passes (the strict form's own check) and bits (features as one number)."""
    clean = lambda s: F.regexp_replace(s["value"], "[^0-9]", "")
    rows = rows.withColumn("found", F.transform("found", lambda s: F.struct(s.alias("s"), clean(s).alias("digits"))))
    rows = rows.withColumn("found", F.transform("found", lambda x: F.struct(x["s"].alias("s"), F.length(x["digits"]).alias("n"), F.coalesce(F.when(F.length(x["digits"]).between(12, 19), _luhn(x["digits"])), F.lit(False)).alias("luhn"))))

    def judged(x):
        s, n = x["s"], x["n"]
        kind, value, before = s["kind"], s["value"], s["before"]
        passes = ~s["loose"] & F.when(kind == 0, True).when(kind == 1, _octets(value)).when(kind == 2, x["luhn"]).otherwise(n.between(9, 15))
        shape = F.when(kind == 0, F.rlike(value, F.lit(r"(?i)[\[(](?:at|dot)|\x20dot\x20|@"))).when(kind == 1, F.rlike(value, F.lit(r"(?i)[0-9a-f]{3}"))).when(kind == 4, (n >= 4) & F.rlike(value, F.lit("[A-Za-z]")) & ~F.rlike(value, F.lit("[-/_]")))
        bits = [
            *(kind == k for k in range(len(KINDS))),
            n >= 12, n.between(9, 15), x["luhn"], F.rlike(value, F.lit(r"[()\[\]]")), F.rlike(value, F.lit(r"[\x20-]")), F.rlike(value, F.lit(r"[./_]")),
            *(F.rlike(before, F.lit(p)) for p in CUES.values()),
            F.rlike(s["after"], F.lit("[A-Za-z0-9=/_-]")),
            F.coalesce(shape, F.lit(False)),
        ]
        number = sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))
        return F.struct(kind.alias("kind"), s["loose"].alias("loose"), s["start"].alias("start"), (s["start"] + F.length(value)).alias("end"), value.alias("value"), passes.alias("passes"), number.alias("bits"))

    return rows.withColumn("found", F.transform("found", judged))


# Contexts of the labelled table, by kind: those in which a value is personal, and others.
CONTEXTS = {
    "email": (["write to {} today", "e-mail: {}", "my contact is {}.", "{}", "and then {} sent it"], []),
    "ip": (["login from {}", "server {} is down", "address: {}", "and {} was seen"], ["fingerprint {}", "checksum {}"]),
    "card": (
        ["my card {}", "visa: {}", "account {} was charged", "and then {} of the", "payment by {}, thanks", "the {} in", "{}"],
        ["order {}", "build {}", "serial {}", "isbn {}", "tracking no. {}", "invoice #{}", "/files/{}/a", "x={}", "timestamp {}", "id {}", "checksum: {}"],
    ),
    "phone": (
        ["ring my mobile {}", "tel: {}", "phone {}", "mobile {}, please", "and then {} of the", "my fax is {}"],
        ["order {}", "version {}", "serial {}", "invoice #{}", "build {}", "isbn {}", "file {}", "id {}"],
    ),
    "secret": (
        ['api_key = "{}"', "api-key: {}", "password={}", 'client secret: "{}" of', "auth token: {}", "access key {}", "bearer {}", "the credential {} leaked"],
        ["commit {}", "sha1 {}", "md5: {}", "file /a/{}.txt", "checksum {}", "and then {} of the", "/path/{}", "the {} in", "hash = {}", "id={}"],
    ),
}
# Contexts of the phrases that calibrate.
OTHERS = {
    "email": (["reach me by {} please", "they gave {} here", "send it: {}"], []),
    "ip": (["host {} answered", "the ip {} again", "when {} came up"], ["digest {}", "sha {}"]),
    "card": (["credit no more {} now", "iban: {}", "then {} was", "use {}, please"], ["version {}", "commit {}", "file {}", "key={}", "hash: {}", "sha-256 {}"]),
    "phone": (["call {}", "whatsapp: {}", "so {} is", "telephone {}."], ["tracking {}", "hash {}", "release {}", "commit {}"]),
    "secret": (['secret = "{}"', "passwd: {}", "apikey={}", "credentials {}", "private key: {}"], ["digest {}", "build {}", "see {} for", "b={}", "/var/{}", "checksum: {}"]),
}


def made_values(seed):
    """Values by kind, drawn from their forms alone."""
    rng = random.Random(seed)
    some = lambda chars, n: "".join(rng.choices(chars, k=n))
    number, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    name = lambda: some(letters, rng.randint(3, 8))
    fill = lambda form: "".join(some(number, 1) if c == "d" else c for c in form)
    mixed = number + letters + letters.upper()
    return {
        "email": [f"{name()}{at}{name()}{dot}{rng.choice(('com', 'net', 'org'))}" for at, dot in ((" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "."), (" at ", " dot "))],
        "ip": [":".join(some("0123456789abcdef", 4) for _ in range(8)), f"fe80:0:0:0:{':'.join(some(number, 3) + some('abcdef', 1) for _ in range(4))}"],
        "card": [some("3456", 1) + some(number, n) for n in (12, 14, 15, 15, 15, 18)] + [some("3456", 1) + fill(f) for f in ("ddd dddd dddd dddd", "ddd-dddd-dddd-dddd", "ddd.dddd.dddd.dddd")],
        "phone": [fill(f) for f in ("(0dd) ddd-dddd", "0ddd-ddd-dddd", "0dd ddd dddd", "0dd/dddd dddd", "(0ddd) ddd dddd")],
        "secret": ["".join(some("0123456789abcdef", 1) for _ in range(n)) for n in (32, 40, 64)] + [some(mixed, n) for n in (24, 40)] + [f"{some(letters, 3)}{some(mixed, 33)}"],
    }


# Phrases whose candidates are none, whatever they look like.
HARMLESS = [
    "we meet at example.com again", "look at home.Then go", "sold at shop.net today", "open at 10.30 daily", "at 12:30:45:50:10:22 it ended", "fingerprint 43:51:43:a1:b5:fc:8b:b7", "mac 00:1b:44:11:3a:b7", "run 1:2:3:4:5:6",
    "some-very-long-hyphenated-name-of-2024", "under_scored_identifier_number_12", "path/to/some/file/of/2024/data", "a-b-c-d-e-f-g-h-i-j-k-l-m-n-1-2-3", "version 012.345.6789", "room 01/234/567", "figures 0.1234 5678 and", "score 012-345-678 in",
]


def labelled_phrases(seed=7, contexts=CONTEXTS):
    """(text, kind, marked value, personal) rows: made values in every context, and HARMLESS."""
    values = made_values(seed)
    rows = [(c.format(v), k, v, y) for k, (yes, no) in contexts.items() for v in values[k] for y, group in ((1, yes), (0, no)) for c in group]
    return rows + [(t, "", "", 0) for t in HARMLESS]


def labelled_counts(spark, phrases=None):
    """(bits, positives, negatives) of all candidates of labelled phrases."""
    phrases = phrases or labelled_phrases()
    frame = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(t for t, *_ in phrases)), "\n")).alias("i", "text"))
    rows = with_features(candidates(frame)).select("row.i", F.explode("found").alias("c")).select("i", "c.kind", "c.value", "c.bits")
    counts = {}
    for r in rows.collect():
        _, kind, value, y = phrases[r["i"]]
        count = counts.setdefault(r["bits"], [0, 0])
        count[0 if y and KINDS[r["kind"]] == kind and r["value"] in value else 1] += 1
    return sorted((b, p, n) for b, (p, n) in counts.items())


def boost(counts):
    """Trees [(bit, bit, four values)] from rows (bits, positives, negatives), by Newton steps."""
    total, positive = sum(p + n for _, p, n in counts), sum(p for _, p, _ in counts)
    bias = math.log((positive + 1) / (total - positive + 1))
    score, trees = {b: bias for b, _, _ in counts}, []
    for _ in range(ROUNDS if counts else 0):
        grad = {}
        for b, p, n in counts:
            y = 1 / (1 + math.exp(-score[b]))
            grad[b] = (p - (p + n) * y, (p + n) * max(1e-6, y * (1 - y)))
        best = None
        for i in range(BITS):
            for j in range(i + 1, BITS):
                leaf = [[0.0, 1.0] for _ in range(4)]
                for b, (g, h) in grad.items():
                    k = (b >> i & 1) * 2 + (b >> j & 1)
                    leaf[k][0] += g
                    leaf[k][1] += h
                gain = sum(g * g / h for g, h in leaf)
                if best is None or gain > best[0] + 1e-9:
                    best = (gain, i, j, [RATE * g / h for g, h in leaf])
        if best[0] < 1e-3:
            break
        trees.append(best[1:])
        for b in score:
            score[b] += best[3][(b >> best[1] & 1) * 2 + (b >> best[2] & 1)]
    return bias, trees


def score_of(bits, model):
    """The trees' score of a number of bits."""
    bias, trees = model
    return bias + sum(leaf[(bits >> i & 1) * 2 + (bits >> j & 1)] for i, j, leaf in trees)


def tree_sql(bits, model):
    """score_of() as SQL over the name of a number of bits; trees over the same two bits are added up."""
    bias, trees = model
    pairs = {}
    for i, j, leaf in trees:
        pairs[i, j] = [x + y for x, y in zip(pairs.get((i, j), [0.0] * 4), leaf, strict=True)]
    parts = [f"CASE ({bits} & {1 << i | 1 << j}) WHEN 0 THEN {v[0]!r}D WHEN {1 << j} THEN {v[1]!r}D WHEN {1 << i} THEN {v[2]!r}D ELSE {v[3]!r}D END" for (i, j), v in pairs.items()]
    return " + ".join([f"{bias!r}D", *parts])


def calibrate(counts, model):
    """Per kind, the score at which candidates the trees never saw are personal with probability SURE.

    The curve's slope and place start at one and zero and are drawn back to them, so a kind with few
    such candidates stays near the trees' own odds.
    """
    limits = []
    for k in range(len(KINDS)):
        rows = [(score_of(b, model), p, n) for b, p, n in counts if b >> k & 1]
        a, c, size = 1.0, 0.0, sum(p + n for _, p, n in rows) + 10
        for _ in range(500):
            g = [0.5 * (1 - a) * 10, 0.5 * -c * 10]
            for s, p, n in rows:
                e = p - (p + n) / (1 + math.exp(-(a * s + c)))
                g[0] += e * s
                g[1] += e
            a, c = max(0.1, a + 0.05 * g[0] / size), c + 0.05 * g[1] / size
        limits.append((math.log(SURE / (1 - SURE)) - c) / a)
    return limits


def learn(spark):
    """Trees and thresholds from the labelled table; it is fixed, so they are learned once."""
    if not _learned:
        model = boost(labelled_counts(spark))
        _learned.append((model, calibrate(labelled_counts(spark, labelled_phrases(8, OTHERS)), model)))
    return _learned[0]


_learned = []


def find(docs):
    """Rows (row, text, spans): spans are (start, kind, end, base) in order, of every row."""
    model, limits = learn(docs.sparkSession)
    limit = " ".join(f"WHEN {k} THEN {v!r}D" for k, v in enumerate(limits))
    kept = f"filter(found, s -> s.passes OR (s.loose AND {tree_sql('s.bits', model)} >= CASE s.kind {limit} END))"
    spans = F.expr(f"array_sort(transform({kept}, s -> named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'base', s.passes)))")
    return with_features(candidates(docs)).select("row", "text", spans.alias("found")).selectExpr("row", "text", _merged())


def _merged():
    """SQL over found: base spans, and added ones that overlap no base span and no added one proposed before.

    One sweep in order of starts: the last added span waits in case a base span begins inside it.
    """
    kind = "struct<start:int,kind:int,end:int,base:boolean>"
    nothing = f"CAST(NULL AS {kind})"
    added = _appended("a.last", ", 'last', s, 'busy', s.end")
    wait = "named_struct('run', a.run, 'runs', a.runs, 'last', s, 'busy', s.end)"
    base = f"named_struct('run', a.run, 'runs', a.runs, 'last', IF(a.last.end > s.start, {nothing}, a.last), 'busy', greatest(a.busy, s.end))"
    step = f"CASE WHEN s.base THEN {base} WHEN s.start < a.busy THEN a WHEN a.last IS NULL THEN {wait} ELSE {added} END"
    sweep = f"aggregate(found, {_empty(kind, f', {chr(39)}last{chr(39)}, {nothing}, {chr(39)}busy{chr(39)}, 0')}, (a, s) -> {step}, a -> concat({WHOLE}, filter(array(a.last), s -> s IS NOT NULL)))"
    return f"IF(exists(found, s -> NOT s.base), array_sort(concat(filter(found, s -> s.base), {sweep})), found) AS spans"


def redact(docs):
    """All columns, with each span of text replaced by its kind in brackets."""
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS)
    cut = "named_struct('after', a.at, 'start', s.start, 'kind', s.kind)"
    step = f"IF(s.start < a.at, a, {_appended(cut, ', ' + repr('at') + ', s.end')})"
    cuts = f"aggregate(spans, {_empty('struct<after:int,start:int,kind:int>', ', ' + repr('at') + ', 0')}, (a, s) -> {step}, a -> named_struct('cuts', {WHOLE}, 'at', a.at)) AS found"
    text = f"concat(array_join(transform(found.cuts, x -> concat(substring(text, x.after + 1, x.start - x.after), array({names})[x.kind])), ''), substring(text, found.at + 1))"
    rows = find(docs).selectExpr("row", "text", cuts).selectExpr("row", f"IF(size(found.cuts) > 0, {text}, text) AS text")
    return rows.select(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _of(kind):
    return lambda s: s["kind"] == kind


def joined(spans):
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir):
    """op7: base counts and digest, and all spans, of every document."""
    rows = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "spans").withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return rows.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))
