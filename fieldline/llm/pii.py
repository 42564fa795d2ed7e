"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

E-mail addresses, phone numbers, payment cards, bank accounts, social security
numbers, IP addresses and dates are found by pattern, validated (check digits,
ranges, the calendar), and replaced by a keyed Feistel permutation of their own
format: a card becomes a card with a right check digit, a date a date, a number
keeps its punctuation. Within a format the mapping is one to one, so equal
values stay linked across documents and different ones stay apart, and without
the key nothing can be undone. Numbers that fail validation stay as they are.

A permutation may map a value to itself: once in 10**15 for a card, once in some
55,000 for a date. A date stays among the dates of its written form: the same
separators and order, digits padded or not as they were, years of the same
YEARS (1900 to 2049, and so on). Dates with slashes are read month first where
that is a date, else day first; those that read either way stay among
themselves, and so do those whose day is above 12, so that no reading changes.

Defined results: null texts stay null and count nothing; empty texts stay
empty; repeated rows get equal results; an empty table gives an empty result;
other columns are untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldline.llm.batches import free_name

ROUNDS = 8
# Dates are permuted within as many years, counted from FIRST_YEAR.
YEARS, FIRST_YEAR = 150, 1900
# Steps of a walk from date to date; one grid cell in thirty is no date, so a walk practically never needs more than a few.
WALK = 48
#: Public default for tests and examples; give your own key.
EXAMPLE_KEY = "example key, replace it"

KINDS = ["email", "iban", "date", "ssn", "ip", "phone", "card"]

# Formats, fixed by their public definitions.
EMAIL = r"[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
# Characters of an account number by country, from the IBAN registry.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{{groups}}}" + (f"[ ]?[A-Z0-9]{{{rest}}}" if rest else "")


# First with the length of its country, so that a word behind is left out; else of any length.
IBAN = "|".join(_iban_of(*item) for item in IBAN_SIZES.items()) + r"|[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?"
ISO_DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DAY_DATE = r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}"
# A time of day right behind an ISO date.
TIME_NEXT = r"(?=[Tt][0-2][0-9](?::|[0-5][0-9]|[Zz]|(?![\p{L}\p{N}])))"
SLASH_DATE = r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IP = r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"
PHONE = r"(?:\+?1[ .\-]?)?(?:\([0-9]{3}\)[ ]?|[0-9]{3}[ .\-])[0-9]{3}[ .\-][0-9]{4}|\+[1-9][0-9]{0,2}(?:[ .\-]?\(?[0-9]{2,4}\)?){2,5}"
CARD = r"[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5}|[0-9]{13,19}"
ANY = (
    r"(?<![\p{L}\p{N}._%+\-])" + EMAIL
    + r"|(?<![\p{L}\p{N}])" + ISO_DATE + TIME_NEXT
    + r"|(?<![\p{L}\p{N}])(?:" + "|".join((IBAN, ISO_DATE, DAY_DATE, SLASH_DATE, SSN, IP, PHONE, CARD)) + r")(?![\p{L}\p{N}])"
)


def _is(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _prf(key: str, tag: str | Column, turn: Column, value: Column) -> Column:
    """A keyed number below 2**60 of a round and a value."""
    text = F.concat_ws("|", F.lit(key), tag if isinstance(tag, Column) else F.lit(tag), turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).try_cast("long")


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str, tag: str | Column) -> Column:
    """A keyed permutation of pairs (left below left_size, right below right_size), as a struct of l and r."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (acc["l"] + _prf(key, tag, i, acc["r"])) % left_size).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise((acc["r"] + _prf(key, tag, i, acc["l"])) % right_size).alias("r"),
        )

    start = F.struct(left.try_cast("long").alias("l"), right.try_cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _joined(pair: Column, width_left: Column, width_right: Column) -> Column:
    padded = [F.lpad(pair[side].cast("string"), 19, "0") for side in ("l", "r")]
    return F.concat(F.right(padded[0], width_left), F.right(padded[1], width_right))


def _once(value: Column, function) -> Column:
    """``function`` of a value that is computed once."""
    return F.transform(F.array(value), function)[0]


def permuted_digits(digits: Column, key: str, tag: str) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    a = F.floor(F.length(digits) / 2).try_cast("int")
    b = F.length(digits) - a
    size = lambda n: F.pow(F.lit(10.0), n).try_cast("long")
    pair = feistel(F.left(digits, a), F.right(digits, b), size(a), size(b), key, tag)
    return _once(pair, lambda p: _joined(p, a, b))


def _redrawn(value: Column, digits: Column) -> Column:
    """``value`` with its digits replaced by ``digits`` in turn; punctuation stays."""
    seen = lambda i: F.length(_digits(F.left(value, i + 1)))
    return F.array_join(
        F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.substring(digits, seen(i), F.lit(1))).otherwise(c)), ""
    )


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; the last digit counts twice if ``doubled`` is 0, else the one before it."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda c, i: (c.try_cast("int") * F.when(i % 2 == doubled, 2).otherwise(1)))
    return F.aggregate(places, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x))


def _mod97(text: Column) -> Column:
    """The remainder of an account number (letters count 10 to 35)."""
    values = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda acc, x: (acc * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _date_of(value: Column) -> Column:
    """The date, or null if the calendar has none; slashes month first where possible."""
    part = lambda i, sep: F.split_part(value, F.lit(sep), F.lit(i)).try_cast("int")
    iso, dotted = (part(1, "-"), part(2, "-"), part(3, "-")), (part(3, "."), part(2, "."), part(1, "."))
    month, day = (part(3, "/"), part(1, "/"), part(2, "/")), (part(3, "/"), part(2, "/"), part(1, "/"))
    return (
        F.when(value.contains("-"), _made(*iso))
        .when(value.contains("."), _made(*dotted))
        .otherwise(F.coalesce(_made(*month), _made(*day)))
    )


def _valid(y: Column, m: Column, d: Column) -> Column:
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    return (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)


def _made(y: Column, m: Column, d: Column) -> Column:
    return F.when(_valid(y, m, d), F.make_date(y, m, d))


def kind_of(value: Column) -> Column:
    """The kind of a match that passes validation, else an empty string."""
    digits = _digits(value)
    plain = F.regexp_replace(value, " ", "")
    octets = F.split(value, r"\.")
    return (
        F.when(value.contains("@"), "email")
        .when(_is(value, IBAN) & (_mod97(F.concat(F.substring(plain, 5, 99), F.left(plain, F.lit(4)))) == 1), "iban")
        .when(_is(value, f"{ISO_DATE}|{DAY_DATE}|{SLASH_DATE}"), F.when(_date_of(value).isNotNull(), "date").otherwise(""))
        .when(_is(value, SSN), F.when(~value.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn").otherwise(""))
        .when(_is(value, IP), F.when(F.forall(octets, lambda o: o.try_cast("int") <= 255), "ip").otherwise(""))
        .when(_is(value, CARD) & F.length(digits).between(13, 19), F.when(luhn_sum(digits, 1) % 10 == 0, "card").otherwise(""))
        .when(_is(value, PHONE) & F.length(digits).between(7, 15), "phone")
        .otherwise("")
    )


def _email(value: Column, key: str) -> Column:
    """Letters and digits of the local part shift by keyed amounts of the other half; the domain stays."""
    local = F.substring_index(value, "@", 1)
    half = F.floor(F.length(local) / 2).try_cast("int")

    def shifted(own: Column, other: Column, i: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            code = F.ascii(c)
            by = _prf(key, "email", i * 1000 + k, F.array_join(other, ""))
            move = lambda base, size: F.char(F.lit(base) + (code - base + by % size) % size)
            return F.when(c.rlike("^[a-z]$"), move(97, 26)).when(c.rlike("^[A-Z]$"), move(65, 26)).when(c.rlike("^[0-9]$"), move(48, 10)).otherwise(c)

        return F.transform(own, one)

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, shifted(acc["l"], acc["r"], i)).otherwise(acc["l"]).alias("l"),
            F.when(even, acc["r"]).otherwise(shifted(acc["r"], acc["l"], i)).alias("r"),
        )

    letters = F.split(local, "")
    start = F.struct(F.slice(letters, F.lit(1), half).alias("l"), F.slice(letters, half + 1, F.length(local)).alias("r"))
    mixed = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda p: F.concat(F.array_join(p["l"], ""), F.array_join(p["r"], "")))
    return F.concat(mixed, F.lit("@"), F.substring_index(value, "@", -1))


def _date(value: Column, key: str) -> Column:
    """Another date of the same written form.

    Year and month on one side and the day on the other are permuted as a grid;
    where that leads to no date (30 February) the walk goes on from there, which
    keeps the mapping of dates one to one.
    """
    iso, dotted = value.contains("-"), value.contains(".")
    fields = F.split(value, "[-./]")
    first, second = F.when(iso, fields[1]).otherwise(fields[0]), F.when(iso, fields[2]).otherwise(fields[1])
    year = F.when(iso, fields[0]).otherwise(fields[2]).try_cast("int")
    a, b = first.try_cast("int"), second.try_cast("int")
    month_first = iso | (~dotted & _valid(year, a, b))

    def moved(f: Column) -> Column:
        month, day = F.when(f["mf"], f["a"]).otherwise(f["b"]), F.when(f["mf"], f["b"]).otherwise(f["a"])
        month_width, day_width = F.when(f["mf"], f["wa"]).otherwise(f["wb"]), F.when(f["mf"], f["wb"]).otherwise(f["wa"])
        late = f["slash"] & (day > 12)  # cannot be read as a month
        least = F.when(late, 13).otherwise(1)
        most = F.when(day_width == 1, 9).when(f["slash"] & ~late, 12).otherwise(31)
        months = F.when(month_width == 1, 9).otherwise(12)
        block = F.floor((f["y"] - FIRST_YEAR) / YEARS)
        start = block * YEARS + FIRST_YEAR
        form = F.concat_ws("/", F.lit("date"), f["form"], month_width.cast("string"), day_width.cast("string"), least.cast("string"), block.cast("string"))
        about = F.struct(start.alias("start"), months.alias("months"), least.alias("least"), (most - least + 1).alias("days"), form.alias("form"))

        def walked(g: Column) -> Column:
            year_of, month_of, day_of = (
                lambda p: (g["start"] + F.floor(p["l"] / g["months"])).try_cast("int"), lambda p: (p["l"] % g["months"] + 1).try_cast("int"), lambda p: (p["r"] + g["least"]).try_cast("int")
            )

            def step(acc: Column, _: Column) -> Column:
                pair = feistel(acc["l"], acc["r"], g["months"] * YEARS, g["days"], key, g["form"])
                landed = _once(pair, lambda p: F.struct(p["l"].alias("l"), p["r"].alias("r"), _valid(year_of(p), month_of(p), day_of(p)).alias("ok")))
                return F.when(acc["ok"], acc).otherwise(landed)

            begin = F.struct(
                ((f["y"] - g["start"]) * g["months"] + month - 1).try_cast("long").alias("l"), (day - g["least"]).try_cast("long").alias("r"), F.lit(False).alias("ok")
            )

            def written(p: Column) -> Column:
                m, d = F.lpad(month_of(p).cast("string"), month_width, "0"), F.lpad(day_of(p).cast("string"), day_width, "0")
                y = F.lpad(year_of(p).cast("string"), 4, "0")
                return (
                    F.when(f["form"] == "-", F.concat_ws("-", y, m, d))
                    .when(f["form"] == ".", F.concat_ws(".", d, m, y))
                    .when(f["mf"], F.concat_ws("/", m, d, y))
                    .otherwise(F.concat_ws("/", d, m, y))
                )

            return _once(F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), begin, step), written)

        return _once(about, walked)

    form = F.when(iso, "-").when(dotted, ".").when(month_first, "md").otherwise("dm")
    return _once(
        F.struct(
            year.alias("y"), a.alias("a"), b.alias("b"), F.length(first).alias("wa"), F.length(second).alias("wb"), month_first.alias("mf"),
            (~iso & ~dotted).alias("slash"), form.alias("form"),
        ),
        moved,
    )


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).try_cast("int") for i in (1, 2, 3))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    pair = feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")
    width = lambda x, n: F.lpad(x.try_cast("long").cast("string"), n, "0")
    return _once(
        pair,
        lambda p: F.concat_ws(
            "-", width(p["l"] + 1 + F.when(p["l"] >= 665, 1).otherwise(0), 3), width(F.floor(p["r"] / 9999) + 1, 2), width(p["r"] % 9999 + 1, 4)
        ),
    )


def _ip(value: Column, key: str) -> Column:
    octet = [F.split_part(value, F.lit("."), F.lit(i)).try_cast("long") for i in (1, 2, 3, 4)]
    pair = feistel(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536), F.lit(65536), key, "ip")
    part = lambda x: [F.floor(x / 256).cast("string"), (x % 256).cast("string")]
    return _once(pair, lambda p: F.concat_ws(".", *part(p["l"]), *part(p["r"])))


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last is the check digit."""
    digits = _digits(value)
    body = permuted_digits(F.left(digits, F.length(digits) - 1), key, "card")
    return _once(body, lambda b: _redrawn(value, F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string"))))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; the digits after it are permuted."""
    digits = _digits(value)
    n = F.when(F.length(digits) == 11, 10).otherwise(F.least(F.length(digits), F.greatest(F.length(digits) - 2, F.lit(7))))
    n = F.when(F.length(digits) == 10, 10).otherwise(n)
    return _redrawn(value, F.concat(F.left(digits, F.length(digits) - n), permuted_digits(F.right(digits, n), key, "phone")))


def _iban(value: Column, key: str) -> Column:
    """Country and letters stay, the account's digits are permuted, the two check digits are right again."""
    plain = F.regexp_replace(value, " ", "")
    account = F.substring(plain, 5, 99)
    fresh = _redrawn(account, permuted_digits(_digits(account), key, "iban"))
    return _once(
        fresh,
        lambda a: _redrawn(value, F.concat(F.lpad((98 - _mod97(F.concat(a, F.left(plain, F.lit(2)), F.lit("00")))).cast("string"), 2, "0"), _digits(a))),
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    return (
        F.when(kind == "email", _email(value, key))
        .when(kind == "iban", _iban(value, key))
        .when(kind == "date", _date(value, key))
        .when(kind == "ssn", _ssn(value, key))
        .when(kind == "ip", _ip(value, key))
        .when(kind == "phone", _phone(value, key))
        .when(kind == "card", _card(value, key))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, text: str = "text", key: str = EXAMPLE_KEY, counts: str = "pii") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and a struct column with the number of values of each kind.

    The column is named ``counts``, with underscores in front where ``docs`` has that name already.
    """
    counts = free_name(docs.columns, counts)
    found, kinds = (free_name([*docs.columns, counts], n) for n in ("_found", "_kinds"))
    source = F.col(text)
    some = F.coalesce(source.rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")
    marked = docs.withColumn(found, F.when(some, F.regexp_extract_all(source, F.lit(ANY), F.lit(0))).otherwise(none))
    marked = marked.withColumn(kinds, F.transform(found, kind_of))
    swapped = F.zip_with(found, kinds, lambda v, k: pseudonym(v, k, key))
    pieces = F.split(source, ANY, -1)
    rebuilt = F.concat(F.array_join(F.flatten(F.zip_with(F.slice(pieces, 1, F.size(found)), swapped, lambda a, b: F.array(a, b))), ""), F.element_at(pieces, -1))
    changed = F.exists(F.col(kinds), lambda k: k != "")
    numbers = F.struct(*[F.size(F.filter(F.col(kinds), F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in KINDS])
    return marked.withColumn(counts, numbers).withColumn(text, F.when(changed, rebuilt).otherwise(source)).drop(found, kinds)
