"""Personal data replaced by pseudonyms of the same format, in DataFrame functions alone.

Validated numbers and dates are permuted within their format by a keyed Feistel
network over two parts of any two sizes: in turn each part is moved on by a keyed hash of
the other. That is one-to-one, so equal values get equal pseudonyms in all documents
and different ones different pseudonyms. Free-form values (mail names, secrets) get
keyed digests of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)"
#: A secret's name up to its value; the name may be quoted, as in JSON.
SECRET_OPEN = SECRET_NAME + r"[\"']?[ \t]*+[=:][ \t]*+"
AUTH_OPEN = r"(?i:authorization[\"']?[ \t]*+[=:][ \t]*+[\"']?(?:(?:bearer|basic|token)[ \t]++)?|bearer[ \t]++)"
QUOTED = r"\"(?:[^\"\\\n]|\\.)++\"|'(?:[^'\\\n]|\\.)++'"
HEX = "[0-9A-Fa-f]{1,4}"
#: What each kind looks like, tried in this order at each place of a text.
PATTERNS = {
    "private_key": r"-----BEGIN(?: [A-Z0-9]++)*? PRIVATE KEY-----(?:[^\-]|-(?!----))++(?:-----END(?: [A-Z0-9]++)*? PRIVATE KEY-----)?",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]++\.(?=[A-Za-z]{2}|[A-Za-z0-9\-]++\.))++[A-Za-z]{2,}+",
    "authorization": AUTH_OPEN + r"[^\s\"',;]{12,}+",
    "secret": SECRET_OPEN + "(?:" + QUOTED + r"|[\"']?[^\s\"',;]{6,}+|(?=[^\s\"',;]*\d)[^\s\"',;]{3,5}+)",
    "web_token": r"(?<![A-Za-z0-9_\-.])eyJ[A-Za-z0-9_\-]{8,}+\.[A-Za-z0-9_\-]{8,}+(?:\.[A-Za-z0-9_\-]++)?",
    "access_key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[A-Za-z0-9]{11,30}|(?: [A-Za-z0-9]{4}){2,7}(?: [A-Za-z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<!\d)(?:(?:19|20)\d\d-\d\d-\d\d|\d\d[./]\d\d[./](?:19|20)\d\d)(?!\d)",
    "ip": r"(?<![\d.])" + OCTET + r"(?:\." + OCTET + r"){3}(?!\d|\.\d)",
    "ip6": rf"(?<![A-Za-z0-9:.])(?=[0-9A-Fa-f:]*\d)(?:(?:{HEX}:){{7}}{HEX}|{HEX}(?::{HEX}){{0,6}}::(?:{HEX}(?::{HEX}){{0,6}})?)(?![A-Za-z0-9:])",
    "ssn": r"(?<!\d|\d-)(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?!\d|-\d)",
    "phone": r"(?<![\d+])(?:\+?1[ .\-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .\-])[2-9]\d\d[ .\-]\d{4}(?!\d)",
    "foreign_phone": r"(?<![\d+])\+[2-9]\d{0,2}(?:[ .\-]?\d{2,4}){2,4}(?!\d)",
    "plain_phone": r"(?<![\d+.,\-A-Za-z])[2-9]\d{9}(?![\dA-Za-z]|[.,\-]\d)",
    "card": r"(?<![\d])(?:\d{13,19}|\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
#: Any match has one of these; looking for them first spares most texts the full search.
NEEDED = r"[0-9@=:]|AKIA|eyJ|PRIVATE KEY|(?i:bearer)"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def keyed(key: str | Column, *parts: Column | str) -> Column:
    """A keyed digest in hex."""
    return F.sha2(F.concat_ws("|", key if isinstance(key, Column) else F.lit(key), *[
        p if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"), 256)


def feistel(left: Column, right: Column, a: Column | int, b: Column | int, key: str, tweak: Column | str) -> Column:
    """A struct (l, r): (left, right) of the a * b pairs, keyed-permuted."""
    a, b = (F.lit(x).cast("long") if isinstance(x, int) else x.cast("long") for x in (a, b))

    def moved(x: Column, by: Column, size: Column, i: Column) -> Column:
        step = F.conv(F.substring(keyed(key, tweak, i.cast("string"), by.cast("string")), 1, 14), 16, 10).cast("long")
        return F.pmod(x + F.pmod(step, size), size)

    def turn(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(at["l"], at["r"], a, i).alias("l"), at["r"].alias("r"))).otherwise(
            F.struct(at["l"].alias("l"), moved(at["r"], at["l"], b, i).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def let(value: Column, body) -> Column:
    """body(value), the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def padded(x: Column, width: Column | int) -> Column:
    return F.lpad(x.cast("string"), width, "0")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def permuted_digits(digits: Column, key: str, tweak: str) -> Column:
    """Of 2 to 36 digits, another number of as many digits."""
    n = F.length(digits)
    h = F.floor(n / 2).cast("int")
    pair = feistel(F.substring(digits, F.lit(1), h), F.substring(digits, h + 1, n), F.pow(F.lit(10), h), F.pow(F.lit(10), n - h),
                   key, F.concat(F.lit(tweak), n.cast("string")))
    return let(pair, lambda p: F.concat(padded(p["l"], h), padded(p["r"], n - h)))


def filled(text: Column, signs: Column, kind: str = "[0-9]") -> Column:
    """text with its digits, or signs of another kind, replaced in order; the rest of it stays."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def put(at: Column, c: Column) -> Column:
        found = c.rlike(f"^{kind}$")
        return F.struct((at["i"] + found.cast("int")).alias("i"), F.concat(
            at["out"], F.when(found, F.substring(signs, at["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(text, ""), start, put, lambda at: at["out"])


LETTERS, HEX_SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def permuted_signs(text: Column, signs: str, key: str, tweak: str) -> Column:
    """Of 2 to 32 of the given signs, as many others: a Feistel network that moves each sign of a half on by a digest of the other."""
    n = F.length(text)
    h = F.floor(n / 2).cast("int")

    def moved(x: Column, by: Column, i: Column) -> Column:
        def each(digest: Column) -> Column:
            step = lambda j: F.conv(F.substring(digest, j * 4 + 1, F.lit(4)), 16, 10).cast("int")
            return F.array_join(F.transform(F.split(x, ""), lambda c, j: F.substring(
                F.lit(signs), (F.instr(F.lit(signs), c) - 1 + step(j)) % len(signs) + 1, F.lit(1))), "")
        return let(keyed(key, tweak, n.cast("string"), i.cast("string"), by), each)

    def turn(at: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(moved(at["l"], at["r"], i).alias("l"), at["r"].alias("r"))).otherwise(
            F.struct(at["l"].alias("l"), moved(at["r"], at["l"], i).alias("r")))

    start = F.struct(F.substring(text, F.lit(1), h).alias("l"), F.substring(text, h + 1, n).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda at: F.concat(at["l"], at["r"]))


def permuted_letters(letters: Column, key: str, tweak: str) -> Column:
    """Of 2 to 32 letters A-Z, as many others."""
    return permuted_signs(letters, LETTERS, key, tweak)


def in_case_of(text: Column, made: Column) -> Column:
    """made with the letters small where those of text are; both are equally long."""
    return F.array_join(F.zip_with(F.split(text, ""), F.split(made, ""), lambda a, b: F.when(a.rlike("[a-z]"), F.lower(b)).otherwise(b)), "")


def luhn_sum(digits: Column) -> Column:
    def step(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step)


def mod97(text: Column) -> Column:
    """The remainder of letters (A is 10) and digits read as one number."""
    def step(at: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), at * 10 + F.ascii(c) - 48).otherwise(at * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(text, ""), F.lit(0), step)


def card(m: Column, key: str) -> Column:
    """Digits that pass the Luhn test get others that do; the first digit, which tells the issuer's kind, stays."""
    def new(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, "card"))
        whole = let(body, lambda x: F.concat(x, ((10 - luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d) % 10 == 0, filled(m, whole)).otherwise(m)
    return let(digits_of(m), new)


def iban(m: Column, key: str) -> Column:
    """A number with right check digits: all digits after those change, wherever they stand, and the letters too
    if they are more than the digits; then the check digits are made right. Small letters stay small."""
    def new(s: Column) -> Column:
        rest = F.substring(s, F.lit(5), F.length(s))
        letters = F.regexp_replace(rest, "[^A-Z]", "")
        numbers = let(digits_of(rest), lambda d: F.when(F.length(d) < 2, rest).otherwise(
            filled(rest, permuted_digits(d, key, "iban"))))
        body = F.when(F.length(letters) * 2 > F.length(rest), filled(
            numbers, permuted_letters(letters, key, "iban letters"), "[A-Z]")).otherwise(numbers)
        country = F.substring(s, 1, 2)
        check = let(body, lambda x: F.concat(
            country, padded(98 - mod97(F.concat(x, country, F.lit("00"))), 2), x))
        spaced = F.when(F.instr(m, " ") > 0, F.trim(F.regexp_replace(check, r"(.{4})", "$1 "))).otherwise(check)
        return F.when(mod97(F.concat(rest, F.substring(s, 1, 4))) == 1, in_case_of(m, spaced)).otherwise(m)
    return let(F.upper(F.regexp_replace(m, " ", "")), new)


def date(m: Column, key: str) -> Column:
    """A valid date of 1900 to 2099 gets another; 31 December of leap years move among themselves.

    With slashes the month is first, unless only the day can be."""
    def moved(text: Column, style: str) -> Column:
        def new(d: Column) -> Column:
            plain = let(feistel(F.year(d) - 1900, F.dayofyear(d) - 1, 200, 365, key, "date"), lambda p: F.date_add(
                F.make_date((p["l"] + 1900).cast("int"), F.lit(1), F.lit(1)), p["r"].cast("int")))
            k = F.floor((F.year(d) - 1904) / 4)
            leap = let(feistel(F.floor(k / 7), k % 7, 7, 7, key, "leap day"), lambda p: F.make_date(
                (1904 + 4 * (p["l"] * 7 + p["r"])).cast("int"), F.lit(12), F.lit(31)))
            return F.date_format(F.when(F.dayofyear(d) == 366, leap).otherwise(plain), style)
        read = F.to_date(F.try_to_timestamp(text, F.lit(style)))
        return let(read, lambda d: F.when(d.isNotNull(), new(d)))
    slashes = F.coalesce(moved(m, "MM/dd/yyyy"), moved(m, "dd/MM/yyyy"))
    return F.coalesce(F.when(m.contains("-"), moved(m, "yyyy-MM-dd")).when(m.contains("/"), slashes).otherwise(
        moved(m, "dd.MM.yyyy")), m)


def ip(m: Column, key: str) -> Column:
    """Any address of 32 bits gets another."""
    def new(o: Column) -> Column:
        octet = lambda i: o[i].cast("int")
        return let(feistel(octet(0) * 256 + octet(1), octet(2) * 256 + octet(3), 65536, 65536, key, "ip"), lambda p: F.concat_ws(
            ".", *[x.cast("long").cast("string") for x in (F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)]))
    return let(F.split(m, r"\."), new)


def ip6(m: Column, key: str) -> Column:
    """The hex digits of an address become others, as many in each group; equal writings, whatever their case, become equal."""
    digits = F.regexp_replace(F.lower(m), ":", "")
    return let(digits, lambda d: F.when(F.length(d) < 2, m).otherwise(filled(m, permuted_signs(d, HEX_SIGNS, key, "ip6"), "[0-9A-Fa-f]")))


def ssn(m: Column, key: str) -> Column:
    """Area 001-899 without 666, group 01-99, serial 0001-9999 get others of the same."""
    def new(d: Column) -> Column:
        area = F.substring(d, 1, 3).cast("int")
        pair = feistel(area - 1 - F.when(area > 666, 1).otherwise(0),
                       (F.substring(d, 4, 2).cast("int") - 1) * 9999 + F.substring(d, 6, 4).cast("int") - 1, 898, 99 * 9999, key, "ssn")
        return let(pair, lambda p: F.concat_ws("-", padded(p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0), 3),
                                               padded(F.floor(p["r"] / 9999) + 1, 2), padded(p["r"] % 9999 + 1, 4)))
    return let(digits_of(m), new)


def phone(m: Column, key: str) -> Column:
    """Area and exchange 200-999 and four digits get others; a leading 1 and the signs stay."""
    def new(d: Column) -> Column:
        ten = F.substring(d, F.length(d) - 9, F.lit(10))
        pair = feistel(F.substring(ten, 1, 3).cast("int") - 200,
                       (F.substring(ten, 4, 3).cast("int") - 200) * 10000 + F.substring(ten, 7, 4).cast("int"), 800, 8_000_000, key, "phone")
        return filled(m, let(pair, lambda p: F.concat(
            F.substring(d, F.lit(1), F.length(d) - 10), (p["l"] + 200).cast("string"), padded(p["r"] + 2_000_000, 7))))
    return let(digits_of(m), new)


def foreign_phone(m: Column, key: str) -> Column:
    """The first two digits, which begin the country's number, and the signs stay; all others change."""
    return let(digits_of(m), lambda d: filled(m, F.concat(
        F.substring(d, 1, 2), permuted_digits(F.substring(d, F.lit(3), F.length(d)), key, "foreign phone"))))


def plain_phone(m: Column, key: str) -> Column:
    """Ten digits in a row, from 2 up: the first one stays, the others change."""
    return F.concat(F.substring(m, 1, 1), permuted_digits(F.substring(m, 2, 9), key, "plain phone"))


def email(m: Column, key: str) -> Column:
    """The name becomes a keyed digest of the address in lower case; the domain stays."""
    return F.concat(F.lit("u"), F.substring(keyed(key, "email", F.lower(m)), 1, 16), F.lit("@"), F.substring_index(m, "@", -1))


def hidden(value: Column, key: str, tweak: str) -> Column:
    """A keyed digest of up to 64 signs, no longer than the value was."""
    return F.substring(keyed(key, tweak, value), F.lit(1), F.length(value))


def opened(m: Column, pattern: str, key: str, tweak: str) -> Column:
    """What stands before the value, that is the pattern and a quote, stays, and so does the quote that closes it; the value is hidden."""
    def new(name: Column) -> Column:
        rest = F.substring(m, F.length(name) + 1, F.length(m))
        quote = F.right(name, F.lit(1))
        closed = quote.isin("'", '"') & rest.endswith(quote)
        value = F.when(closed, F.substring(rest, F.lit(1), F.length(rest) - 1)).otherwise(rest)
        return F.concat(name, hidden(value, key, tweak), F.when(closed, quote).otherwise(F.lit("")))
    return let(F.regexp_extract(m, f"^(?:{pattern})[\"']?", 0), new)


def secret(m: Column, key: str) -> Column:
    """The value, of any length, goes; its name and quotes stay. A value in quotes goes up to the closing one."""
    return opened(m, SECRET_OPEN, key, "secret")


def authorization(m: Column, key: str) -> Column:
    """What follows the name of the header and of the scheme goes."""
    return opened(m, AUTH_OPEN, key, "authorization")


def web_token(m: Column, key: str) -> Column:
    """A JSON web token goes as a whole."""
    return hidden(m, key, "web token")


def private_key(m: Column, key: str) -> Column:
    """What stands between the lines that begin and end a private key goes; without an end, all that follows up to five hyphens."""
    edge = r"-----(?:BEGIN|END)(?: [A-Z0-9]++)*? PRIVATE KEY-----"
    end = F.regexp_extract(m, r"-----END(?: [A-Z0-9]++)*? PRIVATE KEY-----$", 0)
    body = F.regexp_replace(m, edge, "")
    return F.concat(F.regexp_extract(m, f"^{edge}", 0), F.lit("\n"), hidden(body, key, "private key"), F.lit("\n"), end)


def access_key(m: Column, key: str) -> Column:
    return F.concat(F.lit("AKIA"), F.upper(F.substring(keyed(key, "access key", m), 1, 16)))


MAKERS = {"private_key": private_key, "email": email, "authorization": authorization, "secret": secret, "web_token": web_token,
          "access_key": access_key, "iban": iban, "date": date, "ip": ip, "ip6": ip6, "ssn": ssn, "phone": phone,
          "foreign_phone": foreign_phone, "plain_phone": plain_phone, "card": card}


def pseudonym(m: Column, key: str) -> Column:
    """What stands for a match, by the first kind whose whole pattern it has."""
    out = F
    for kind, make in MAKERS.items():
        out = out.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), make(m, key))
    return out.otherwise(m)


def pseudonymized(docs: DataFrame, key: str | Column, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text column replaced, and `pii_found`, how many values were.

    Numbers that fail their test (Luhn, check digits, calendar, ranges) are left alone. Null
    texts stay null with nothing found, empty ones empty. Equal values become equal
    under one key. A column named pii_found is replaced. Each text is cut at its matches,
    and only texts with one are worked on. Repeated rows stay, texts of any length are taken whole, an empty table gives no rows.
    A key given as text is a literal of the plan, so explain and event logs show it; a column of docs, as
    from a table that only the job may read, does not."""
    text = F.col(f"`{text_col}`").cast("string")
    has = text.rlike(NEEDED) & text.rlike(ANY)
    free = next(n for n in (f"_pii{i}" for i in range(len(docs.columns) + 1)) if n not in docs.columns)
    cut = docs.withColumn(free, F.when(has, F.struct(
        F.split(text, ANY, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("old"))))
    old = F.col(free)["old"]
    made = cut.withColumn(free, F.when(F.col(free).isNotNull(), F.struct(
        F.col(free)["gaps"].alias("gaps"), old.alias("old"), F.transform(old, lambda m: pseudonym(m, key)).alias("new"))))
    gaps, old, new = (F.col(free)[k] for k in ("gaps", "old", "new"))
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.concat(new, F.array(F.lit(""))), lambda g, m: F.array(g, m))), "")
    changed = F.size(F.filter(F.zip_with(old, new, lambda a, b: a != b), lambda x: x)).cast("long")
    out = made.withColumns({
        text_col: F.when(F.col(free).isNull(), text).otherwise(joined),
        "pii_found": F.when(F.col(free).isNull(), F.lit(0)).otherwise(changed).cast("long")})
    return out.drop(free)
