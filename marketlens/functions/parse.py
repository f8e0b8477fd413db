"""Row-wise keys, phone numbers and card texts as column expressions; no shuffle."""

from pyspark.sql import functions as F

from marketlens.functions.fixed import CLOSED, NO_SITE, PRICE_HIGH, PRICE_LOW

MONEY = r"(?i)Rp\s?[0-9][0-9.,]*"


def digits(c):
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")


def contains_any(text, words):
    """Whether the text holds any of the words; an expression per word, no regex."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def place_key(href, name, address, phone):
    """cid, phone, name and address signature or URL digest, the first that exists."""
    raw = F.coalesce(F.try_url_decode(F.replace(F.coalesce(href, F.lit("")), F.lit("+"), F.lit("%2B"))), F.coalesce(href, F.lit("")))
    hexa, cid, d = F.regexp_extract(raw, "(?i)(0x[0-9a-f]+:0x[0-9a-f]+)", 1), F.regexp_extract(raw, "[?&]cid=([0-9]+)", 1), digits(phone)
    plain = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")
    sig = F.substring(F.sha1(F.concat(plain(name), F.lit("|"), F.substring(plain(address), 1, 30))), 1, 16)
    return (
        F.when(hexa != "", F.concat(F.lit("cid:"), F.lower(hexa)))
        .when(cid != "", F.concat(F.lit("cid:"), cid))
        .when(F.length(d) >= 8, F.concat(F.lit("tel:"), F.regexp_replace(d, "^0", "62")))
        .when(plain(name) != "", F.concat(F.lit("sig:"), sig))
        .when(raw != "", F.concat(F.lit("url:"), F.substring(F.sha1(raw), 1, 16)))
        .otherwise("")
    )


def coordinates(href):
    lat, lng = (F.regexp_extract(href, r"!3d(-?[0-9]+\.[0-9]+)!4d(-?[0-9]+\.[0-9]+)", i) for i in (1, 2))
    return F.when(lat != "", F.concat_ws(",", lat, lng)).otherwise("")


def phone_number(c):
    """Digits with the country prefix."""
    d = digits(c)
    return F.when(d == "", "").when(d.startswith("0"), F.concat(F.lit("62"), F.substr(d, F.lit(2)))).when(d.startswith("62"), d).otherwise(F.concat(F.lit("62"), d))


def is_mobile(c):
    n = phone_number(c)
    return n.startswith("628") & F.length(n).between(10, 14)


def quoted(text):
    """Percent encoding that keeps / _ . - ~ and unreserved characters."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def chat_link(phone, text=None):
    link = F.concat(F.lit("https://wa.me/"), phone_number(phone))
    if text is not None:
        link = F.when(F.coalesce(text, F.lit("")) == "", link).otherwise(F.concat(link, F.lit("?text="), quoted(text)))
    return F.when(is_mobile(phone), link).otherwise("")


def prices(text):
    """All plausible amounts in reading order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(MONEY), F.lit(0))
    values = F.transform(found, lambda m: F.regexp_replace(m, "[^0-9]", "").try_cast("decimal(38,0)"))
    return F.transform(F.filter(values, lambda v: v.between(PRICE_LOW, PRICE_HIGH)), lambda v: v.cast("long"))


def first_price(text, found=None):
    """The first of the plausible amounts (of those given, if they were found before), else a bare number."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "[^0-9]", "")
    value = F.when((bare != "") & (F.length(F.regexp_replace(bare, "^0+", "")) <= 9), bare.cast("long"))
    return F.coalesce(F.get(prices(text) if found is None else found, 0), F.when(value.between(PRICE_LOW, PRICE_HIGH), value), F.lit(0))


def money(amount):
    a = F.coalesce(amount, F.lit(0)).cast("long")
    return F.when(a == 0, "-").otherwise(F.concat(F.lit("Rp "), F.translate(F.format_number(a, 0), ",", ".")))


def sold(text):
    """Sold count; with a suffix one mark before one or two last digits is decimal, else thousands."""
    t = F.coalesce(text, F.lit(""))
    a = r"(?i)([0-9][0-9.,]*)\s*(rb|ribu|k|jt|juta)?\s*(?:\+\s*)?terjual"
    b = r"(?i)terjual\s*([0-9][0-9.,]*)\s*(rb|ribu|k|jt|juta)?"
    one = lambda m: F.struct(F.when(m != "", m).otherwise(F.regexp_extract(t, b, 1)).alias("number"), F.lower(F.when(m != "", F.regexp_extract(t, a, 2)).otherwise(F.regexp_extract(t, b, 2))).alias("unit"))
    return let(F.regexp_extract(t, a, 1), lambda m: let(one(m), lambda x: _amount(x["number"], x["unit"])))


def let(value, use):
    """use(value), with the value computed once: an expression that is used in several places is else computed in each."""
    return F.get(F.transform(F.array(value), use), 0)


def _amount(number, unit):
    plain = F.coalesce(F.regexp_replace(number, "[^0-9]", "").try_cast("double"), F.lit(0.0))
    decimal = F.when(number.rlike(r"^[0-9]+[.,][0-9]{1,2}$"), F.replace(number, F.lit(","), F.lit(".")).try_cast("double")).otherwise(plain)
    return F.when(unit == "", plain).when(unit.isin("jt", "juta"), decimal * 1_000_000).otherwise(decimal * 1_000).cast("long")


def card_rating(text):
    """(rating, reviews); reviews stay null where the card shows a rating alone."""
    t = F.coalesce(text, F.lit(""))
    full, alone = r"([0-9]+[.,][0-9])\s*\(\s*([0-9.,]+)\s*\)", r"(?m)^\s*([0-9][.,][0-9])\s*$"
    both = F.regexp_extract(t, full, 1)
    one = F.regexp_extract(t, alone, 1)
    number = lambda c: F.replace(c, F.lit(","), F.lit(".")).try_cast("double")
    reviews = F.when(both != "", F.coalesce(F.regexp_replace(F.regexp_extract(t, full, 2), "[^0-9]", "").try_cast("long"), F.lit(0)))
    return number(F.when(both != "", both).when(one != "", one)), reviews


def lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def hours_line(line):
    return F.contains(line, F.lit("Buka")) | F.contains(line, F.lit("Tutup"))


def card_phone(text):
    """First phone in a line; on lines with opening hours only after the last middle dot."""
    part = lambda x: F.when(hours_line(x), F.element_at(F.split(x, "·"), -1)).otherwise(x)
    found = F.transform(lines(text), lambda x: F.trim(F.regexp_extract(part(x), r"((?:\+62|\(0[0-9]{2,4}\)|0)[0-9\s().-]{6,15}[0-9])", 1)))
    return F.get(F.filter(found, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 8), 0)


def card_category(text):
    ok = F.filter(lines(text), lambda x: F.contains(x, F.lit("·")) & ~hours_line(x))
    first = F.transform(ok, lambda x: F.trim(F.get(F.split(x, "·"), 0)))
    return F.get(F.filter(first, lambda x: (x != "") & ~x.rlike(r"(?i)^(jl\.?|jalan|gg\.?)\b")), 0)


def product_name(text):
    """The longest line without a price that isn't only digits and marks; the first of equals."""
    ok = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(MONEY) & ~x.rlike(r"^[0-9.,%\s+\-|/]*$"))
    best = F.aggregate(ok, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    return F.substring(best, 1, 200)


def is_closed(status):
    return contains_any(F.lower(F.coalesce(status, F.lit(""))), CLOSED)


def has_site(website):
    w = F.lower(F.trim(F.coalesce(website, F.lit(""))))
    return (w != "") & ~w.isin(*NO_SITE)


def url_path(url):
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "/+$", "")


def product_key(platform, username, url):
    digest = F.substring(F.sha1(url_path(url)), 1, 12)
    return F.concat_ws(":", F.when(platform == "tokopedia", "tkp").otherwise("shp"), F.when(F.coalesce(username, F.lit("")) == "", "-").otherwise(username), digest)


def clean_url(url):
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", "")


def timestamp(text):
    """Three tolerated forms; null otherwise."""
    t = text.cast("string")
    return F.coalesce(*(F.when(t.rlike(p), F.try_to_timestamp(t, F.lit(f))) for p, f in (
        (r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d$", "yyyy-MM-dd HH:mm:ss"), (r"^\d{4}-\d\d-\d\d \d\d:\d\d$", "yyyy-MM-dd HH:mm"), (r"^\d{4}-\d\d-\d\d$", "yyyy-MM-dd"))))


def tri(c):
    """True, false or unknown from flags in several spellings."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin("0", "false", "no", "tidak"), False).when(s.isin("1", "true", "yes", "ya"), True)


def number_or_zero(c):
    return F.coalesce(F.replace(c.cast("string"), F.lit(","), F.lit(".")).try_cast("double"), F.lit(0.0))
