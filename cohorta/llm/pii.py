"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Values that pass their check are permuted within their format by a keyed Feistel network: a value is cut in
two halves and each round adds a keyed hash of one half to the other, modulo what each place may hold, which
is a bijection on the values of that format. So equal values get equal pseudonyms in every document, different
values different ones, and only the key's holder can undo it. Where a format is no product of places (dates,
social security numbers) values are numbered, and the network is walked until it gives a number of the format.

Kinds, their checks and what stays:
  card     13 to 19 digits in one run, or in groups of four by blank or dash, that begin with 2 to 6 and obey
           Luhn's rule: the digits between the first and the last, which is set by the rule
  iban     mod-97 check and more than three digits: the digits after the check digits, which are set again
  ssn      ddd-dd-dddd of an area, group and serial that are given out: within those
  phone    +country and the usual separators, 8 to 15 digits: the digits after the country code, the first of
           which is not 0; North American ones (+1, or ten digits): area and exchange begin with 2 to 9
  ipv4     four octets of 0-255: permuted within 2**32
  date     valid yyyy-mm-dd, dd/mm/yyyy or dd.mm.yyyy: days are permuted within the same 400 years
  email    the local part and domain before the last dot: letters within their case, digits as digits
  secret   runs of 32 or more hex digits with a digit among them, as hex digits of their case; access key ids
           (AKIA or ASIA and 16 capitals or digits) after the prefix; what follows password, passwd, pwd, secret,
           token or api key and = or :, 8 characters or more with a digit among them

A text is cut at the matches of one pattern; what lies between is left byte for byte, and so are matches that
fail their check.

Edge cases: a null text stays null, an empty one empty, both count 0; ``n_pii`` counts the values that were
replaced; a column of that name in the input is replaced, all others stay, whatever their names; rows that
repeat are treated alike, an empty table stays empty; a text of any length is treated whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

ROUNDS = 6

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<![\d.])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d.])\d{13,19}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
DATE = r"(?<!\d)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?!\d)"
ASSIGNED = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[\"']?(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{8,}"
ACCESS = r"(?<![0-9A-Za-z])A[KS]IA[0-9A-Z]{16}(?![0-9A-Za-z])"
SECRET = r"(?<![0-9A-Za-z])(?:(?=[a-f]*\d)[0-9a-f]{32,}|(?=[A-F]*\d)[0-9A-F]{32,})(?![0-9A-Za-z])"
#: Every kind holds a digit or an at sign, or begins so: texts without those need no closer look.
HINT = "[0-9@]|A[KS]IA"
ANY = "|".join((EMAIL, ASSIGNED, ACCESS, SECRET, IBAN, DATE, CARD, SSN, PHONE, IPV4))

_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: What a place of a mask may hold; other marks of a mask stay.
PLACES = {"a": _LOW, "A": _UP, "0": _DIGITS, "1": _DIGITS[1:], "2": _DIGITS[2:], "h": _DIGITS + _LOW[:6], "H": _DIGITS + _UP[:6]}


def _hash(key: str, *parts: Column | str) -> Column:
    """15 hex digits of a keyed SHA-256, as a number below 2**60."""
    text = F.concat_ws("|", F.lit(key), *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel_digits(digits: Column, key: str, tag: str = "d", rounds: int = ROUNDS) -> Column:
    """A keyed bijection on digit strings of one length (1 to 34 digits), of that length."""

    def step(s: Column, i: Column, n: Column) -> Column:
        odd = (i % 2) == 1
        na = F.floor(n / 2).cast("int")
        width = F.when(odd, na).otherwise(n - na)
        half = F.when(odd, s["a"]).otherwise(s["b"])
        other = F.when(odd, s["b"]).otherwise(s["a"])
        modulus = F.pow(F.lit(10.0), width.cast("double")).cast("decimal(20,0)")
        value = F.coalesce(half.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
        sums = F.pmod(value + F.pmod(_hash(key, tag, n, i, other).cast("decimal(20,0)"), modulus), modulus)
        text = F.when(width > 0, F.lpad(sums.cast("decimal(20,0)").cast("string"), width, F.lit("0"))).otherwise(F.lit(""))
        return F.struct(F.when(odd, text).otherwise(s["a"]).alias("a"), F.when(odd, s["b"]).otherwise(text).alias("b"))

    def run(d: Column) -> Column:
        n = F.length(d)
        na = F.floor(n / 2).cast("int")
        state = F.struct(F.substr(d, F.lit(1), na).alias("a"), F.substr(d, na + 1, n - na).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), state, lambda s, i: step(s, i, n), lambda s: F.concat(s["a"], s["b"]))

    return _bound(digits, run)


def feistel_string(x: Column, mask: Column, key: str, tag: str, rounds: int = ROUNDS) -> Column:
    """A keyed bijection on the strings that fit ``mask``: each place of :data:`PLACES` holds one of its characters, others stay.

    The halves are the even and the odd places; 16 bits of a hash of the other half are added to each place of one.
    """
    places = F.create_map(*[F.lit(v) for kv in PLACES.items() for v in kv])

    def step(s: Column, r: Column, m: Column) -> Column:
        other = F.concat_ws("", F.filter(s, lambda c, i: i % 2 != r % 2))
        hashes = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 16).cast("int")), lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), k.cast("string"), F.concat_ws("", m), other), 256))

        def place(c: Column, i: Column, hashed: Column) -> Column:
            held = F.try_element_at(places, m[i])
            move = F.conv(F.substr(hashed[F.floor(i / 16).cast("int")], 4 * (i % 16) + 1, F.lit(4)), 16, 10).cast("int")
            at = F.pmod(F.position(c, held) - 1 + move, F.length(held))
            return F.when((i % 2 == r % 2) & held.isNotNull(), F.substr(held, at + 1, F.lit(1))).otherwise(c)

        return _bound(hashes, lambda h: F.transform(s, lambda c, i: place(c, i, h)))

    def run(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), v["x"], lambda s, r: step(s, r, v["m"]), lambda s: F.concat_ws("", s))

    chars = lambda c: F.filter(F.split(c, ""), lambda y: y != "")
    return _bound(F.struct(chars(x).alias("x"), chars(mask).alias("m")), run)


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is worked out once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mask(x: Column) -> Column:
    """Letters of either case and digits as places, the rest as it is not."""
    return F.regexp_replace(F.translate(x, _LOW + _UP + _DIGITS, "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", ".")


def feistel_long(value: Column, bits: int, key: str, tag: str, rounds: int = ROUNDS) -> Column:
    """A keyed bijection on the numbers below 2**bits (bits even)."""
    half = 1 << (bits // 2)
    start = lambda v: F.struct(F.floor(v / half).cast("long").alias("a"), F.pmod(v, F.lit(half)).cast("long").alias("b"))
    step = lambda s, i: F.struct(s["b"].alias("a"), F.pmod(s["a"] + _hash(key, tag, i, s["b"]), F.lit(half)).cast("long").alias("b"))
    return _bound(value, lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start(v), step, lambda s: s["a"] * half + s["b"]))


def feistel_string(x: Column, mask: Column, key: str, tag: str, rounds: int = ROUNDS) -> Column:
    """A keyed bijection on the strings that fit ``mask``: each place of :data:`PLACES` holds one of its characters, others stay.

    The halves are the even and the odd places; 16 bits of a hash of the other half are added to each place of one.
    """
    places = F.create_map(*[F.lit(v) for kv in PLACES.items() for v in kv])

    def step(s: Column, r: Column, m: Column) -> Column:
        other = F.concat_ws("", F.filter(s, lambda c, i: i % 2 != r % 2))
        hashes = F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / 16).cast("int")), lambda k: F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), r.cast("string"), k.cast("string"), F.concat_ws("", m), other), 256))

        def place(c: Column, i: Column, hashed: Column) -> Column:
            held = F.try_element_at(places, m[i])
            move = F.conv(F.substr(hashed[F.floor(i / 16).cast("int")], 4 * (i % 16) + 1, F.lit(4)), 16, 10).cast("int")
            at = F.pmod(F.position(c, held) - 1 + move, F.length(held))
            return F.when((i % 2 == r % 2) & held.isNotNull(), F.substr(held, at + 1, F.lit(1))).otherwise(c)

        return _bound(hashes, lambda h: F.transform(s, lambda c, i: place(c, i, h)))

    def run(v: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), v["x"], lambda s, r: step(s, r, v["m"]), lambda s: F.concat_ws("", s))

    chars = lambda c: F.filter(F.split(c, ""), lambda y: y != "")
    return _bound(F.struct(chars(x).alias("x"), chars(mask).alias("m")), run)


def _bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is worked out once however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _mask(x: Column) -> Column:
    """Letters of either case and digits as places, the rest as it is not."""
    return F.regexp_replace(F.translate(x, _LOW + _UP + _DIGITS, "a" * 26 + "A" * 26 + "0" * 10), "[^aA0]", ".")


def feistel_long(value: Column, bits: int, key: str, tag: str, rounds: int = ROUNDS) -> Column:
    """A keyed bijection on the numbers below 2**bits (bits even)."""
    half = 1 << (bits // 2)
    a, b = F.floor(value / half).cast("long"), F.pmod(value, F.lit(half)).cast("long")
    for i in range(rounds):
        a, b = b, F.pmod(a + _hash(key, tag, str(i), b), F.lit(half)).cast("long")
    return a * half + b


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a digit string, the last digit counting once."""
    turned = F.split(F.reverse(digits), "")
    each = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0)))


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column, new: Column) -> Column:
        digit = c.rlike(r"^\d$")
        return F.struct(F.concat(s["out"], F.when(digit, F.substr(new, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(digit, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return _bound(digits, lambda new: F.aggregate(F.split(shape, ""), start, lambda s, c: step(s, c, new), lambda s: s["out"]))


def card(x: Column, key: str) -> Column:
    def check(d: Column) -> Column:
        return F.concat(d, F.pmod(F.lit(10) - F.pmod(luhn_sum(F.concat(d, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string"))

    new = lambda d: _bound(F.concat(F.substring(d, 1, 1), feistel_digits(F.substr(d, F.lit(2), F.length(d) - 2), key, "card")), check)
    return _bound(_digits(x), lambda d: F.when((F.pmod(luhn_sum(d), F.lit(10)) == 0) & d.rlike("^[2-6]"), _bound(new(d), lambda n: _refill(x, n))).otherwise(x))


def _mod97(text: Column) -> Column:
    """A letter-and-digit string as a number (A is 10), modulo 97."""
    value = lambda c: F.when(c.rlike(r"^\d$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike(r"^\d$"), 10).otherwise(100) + value(c), F.lit(97)))


def iban(x: Column, key: str) -> Column:
    def changed(bare: Column) -> Column:
        country, rest = F.substring(bare, 1, 2), F.substr(bare, F.lit(5), F.length(bare) - 4)
        valid = (_mod97(F.concat(rest, F.substring(bare, 1, 4))) == 1) & (F.length(_digits(rest)) > 3)
        check = lambda n: F.lpad((F.lit(98) - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0")
        whole = lambda n: F.concat(country, _refill(F.regexp_replace(x, r"^[A-Z]{2}", ""), F.concat(check(n), _digits(n))))
        return F.when(valid, _bound(_refill(rest, feistel_digits(_digits(rest), key, "iban")), whole)).otherwise(x)

    return _bound(F.regexp_replace(x, " ", ""), changed)


def phone(x: Column, key: str) -> Column:
    def changed(v: Column) -> Column:
        code, rest, d = v["code"], v["rest"], v["d"]
        national = code.isin("", "+1") & ~rest.startswith("+")
        american = national & d.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")
        other = ~national & F.length(_digits(x)).between(8, 15) & d.rlike("^[1-9]")
        mask = F.when(american, F.lit("2002000000")).otherwise(F.concat(F.lit("1"), F.repeat(F.lit("0"), F.length(d) - 1)))
        return F.when(american | other, F.concat(code, _refill(rest, feistel_string(d, mask, key, "phone")))).otherwise(x)

    code = F.regexp_extract(x, r"^\+\d{1,3}(?=[ .\-(])", 0)
    rest = lambda c: F.substr(x, F.length(c) + 1, F.length(x))
    return _bound(code, lambda c: _bound(F.struct(c.alias("code"), rest(c).alias("rest"), _digits(rest(c)).alias("d")), changed))


#: Numbers of areas, groups and serials of a social security number that are given out.
_AREAS, _GROUPS, _SERIALS = 898, 99, 9999


def ssn(x: Column, key: str) -> Column:
    area, group, serial = (F.substring(x, at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * _GROUPS + group - 1) * _SERIALS + serial - 1

    def written(new: Column) -> Column:
        a = F.floor(new / (_GROUPS * _SERIALS)).cast("long")
        parts = (F.when(a >= 665, a + 2).otherwise(a + 1), F.pmod(F.floor(new / _SERIALS).cast("long"), F.lit(_GROUPS)) + 1, F.pmod(new, F.lit(_SERIALS)) + 1)
        return F.concat_ws("-", *[F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (3, 2, 4))])

    return F.when(valid, _bound(_walk(number, _AREAS * _GROUPS * _SERIALS, 30, key, "ssn"), written)).otherwise(x)


def _walk(value: Column, below: int, bits: int, key: str, tag: str) -> Column:
    """A keyed bijection on the numbers below ``below``: within 2**bits, until the number is below again (by 64 steps but for a chance of 1e-16)."""
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(feistel_long(value, bits, key, tag).alias("v")),
        lambda s, _: F.struct(F.when(s["v"] < below, s["v"]).otherwise(feistel_long(s["v"], bits, key, tag)).alias("v")),
        lambda s: s["v"],
    )
    return F.pmod(walk, F.lit(below))


def ipv4(x: Column, key: str) -> Column:
    octets = F.split(x, r"\.")
    value = reduce(lambda a, i: a * 256 + F.element_at(octets, i).cast("long"), (2, 3, 4), F.element_at(octets, 1).cast("long"))
    return _bound(feistel_long(value, 32, key, "ipv4"), lambda new: F.concat_ws(".", *[F.pmod(F.shiftright(new, 24 - 8 * i), F.lit(256)).cast("string") for i in range(4)]))


#: Days in 400 years of the Gregorian calendar: those years repeat exactly.
_ERA = 146_097


def date(x: Column, key: str) -> Column:
    iso, slash, first = x.rlike(r"^\d{4}-"), x.contains("/"), F.lit("1601-01-01").cast("date")
    fmt = lambda p: F.try_to_timestamp(x, F.lit(p)).cast("date")
    days = F.datediff(F.when(iso, fmt("yyyy-MM-dd")).when(slash, fmt("dd/MM/yyyy")).otherwise(fmt("dd.MM.yyyy")), first).cast("long")
    moved = lambda since: F.floor(since / _ERA) * _ERA + _walk(F.pmod(since, F.lit(_ERA)), _ERA, 18, key, "date")
    out = lambda new: F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(slash, F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return F.coalesce(_bound(days, lambda since: F.when(since.isNotNull(), _bound(F.date_add(first, moved(since).cast("int")), out))), x)


def email(x: Column, key: str) -> Column:
    last = F.concat(F.lit("."), F.substring_index(x, ".", -1))
    head = F.substr(x, F.lit(1), F.length(x) - F.length(last))
    return F.concat(feistel_string(head, _mask(head), key, "email"), last)


def secret(x: Column, key: str) -> Column:
    return feistel_string(x, F.repeat(F.when(x.rlike("[A-F]"), "H").otherwise("h"), F.length(x)), key, "secret")


def assigned(x: Column, key: str) -> Column:
    name = F.regexp_extract(x, r"^[A-Za-z_-]+[ \t]*[=:][ \t]*[\"']?", 0)
    value = F.substr(x, F.length(name) + 1, F.length(x))
    return F.concat(name, F.when(value.rlike(f"^{SECRET}$"), secret(value, key)).when(value.rlike(f"^{ACCESS}$"), access(value, key)).otherwise(feistel_string(value, _mask(value), key, "assigned")))


def access(x: Column, key: str) -> Column:
    rest = F.substring(x, 5, 16)
    return F.concat(F.substring(x, 1, 4), feistel_string(rest, _mask(rest), key, "access"))


def pseudonym(x: Column, key: str) -> Column:
    """The pseudonym of one match of :data:`ANY`, or the match where it fails its check."""
    full = lambda p: x.rlike(f"^(?:{p})$")
    bare = r"(?:\d{4}[ -]){3}\d{4}|\d{13,19}"
    return (
        F.when(x.contains("@"), email(x, key))
        .when(full(ASSIGNED), assigned(x, key))
        .when(full(ACCESS), access(x, key))
        .when(full(bare), card(x, key))
        .when(full(r"[0-9a-f]{32,}|[0-9A-F]{32,}"), secret(x, key))
        .when(x.rlike(r"^[A-Z]{2}\d{2}"), iban(x, key))
        .when(full(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"), date(x, key))
        .when(full(r"\d{3}-\d{2}-\d{4}"), ssn(x, key))
        .when(full(rf"{_OCTET}(?:\.{_OCTET}){{3}}"), ipv4(x, key))
        .otherwise(phone(x, key))
    )


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_pii") -> DataFrame:
    """``docs`` with the personal data of ``text_col`` replaced under ``key``, and how many values were, unless ``count_col`` is None."""
    hits, rest, new = (unused(docs, x) for x in ("hits", "rest", "new"))
    text = F.col(text_col).cast("string")
    hint = text.rlike(HINT)
    cut = docs.withColumns({hits: F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))), rest: F.when(hint, F.split(text, ANY, -1))})
    cut = cut.withColumn(new, F.transform(hits, lambda x: pseudonym(x, key)))
    joined = F.concat_ws("", F.zip_with(rest, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))))
    n = F.coalesce(F.size(F.filter(F.zip_with(hits, new, lambda a, b: a != b), lambda x: x)), F.lit(0))
    out = cut.withColumn(text_col, F.when(F.size(hits) > 0, joined).otherwise(text))
    out = out.withColumn(count_col, F.when(F.col(hits).isNull(), 0).otherwise(n)) if count_col else out
    return out.drop(hits, rest, new)
