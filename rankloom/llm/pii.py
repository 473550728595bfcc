"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

A value that passes its format's checks is permuted under a key inside that
format by a Feistel network, so equal values get equal pseudonyms everywhere
and different ones stay different. Numbers and dates are numbered without gaps
and permuted over a product of two moduli; strings keep their classes of
characters. Other text stays as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rankloom.functions.vectors import let

#: Rounds of the network; even, so the halves end where they began.
ROUNDS = 8
#: Classes of characters that a string's pseudonym keeps, place by place.
ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def _short(sign: str) -> str:
    """Month and day without leading zeros, of which at least one has one digit."""
    return f"[1-9]{sign}(?:[1-9]|[12][0-9]|3[01]){sign}|1[0-2]{sign}[1-9]{sign}"


#: Formats in order of precedence. Lookarounds keep matches off longer words and numbers.
FORMATS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    "phone": r"(?<![A-Za-z0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])",
    "worldphone": r"(?<![A-Za-z0-9+])\+[1-9](?:[ .-]?[0-9]){9,14}(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])",
    "iso": r"(?<![A-Za-z0-9/-])(?:19|20)[0-9]{2}([-/])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?:(?=T[0-9]{2}:?[0-9]{2})|(?![A-Za-z0-9/-]))",
    "dotted": r"(?<![A-Za-z0-9.])(?:0[1-9]|[12][0-9]|3[01])\.(?:0[1-9]|1[0-2])\.(?:19|20)[0-9]{2}(?![A-Za-z0-9])",
    "monthfirst": r"(?<![A-Za-z0-9/-])(?:(?:0[1-9]|1[0-2])/(?:0[1-9]|[12][0-9]|3[01])/|(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])-)(?:19|20)[0-9]{2}(?![A-Za-z0-9/-])",
    "dayfirst": r"(?<![A-Za-z0-9/-])(?:(?:1[3-9]|2[0-9]|3[01])/(?:0[1-9]|1[0-2])/|(?:1[3-9]|2[0-9]|3[01])-(?:0[1-9]|1[0-2])-)(?:19|20)[0-9]{2}(?![A-Za-z0-9/-])",
    "shortmonth": rf"(?<![A-Za-z0-9/-])(?:{_short('/')}|{_short('-')})(?:19|20)[0-9]{{2}}(?![A-Za-z0-9/-])",
    "shortday": r"(?<![A-Za-z0-9/-])(?:(?:1[3-9]|2[0-9]|3[01])/[1-9]/|(?:1[3-9]|2[0-9]|3[01])-[1-9]-)(?:19|20)[0-9]{2}(?![A-Za-z0-9/-])",
    "dayword": rf"(?<![A-Za-z0-9.,/-])(?:[1-9]|[12][0-9]|3[01]) (?:{_MONTHS}) (?:19|20)[0-9]{{2}}(?![A-Za-z0-9])",
    "monthword": rf"(?<![A-Za-z0-9])(?:{_MONTHS}) (?:[1-9]|[12][0-9]|3[01]), (?:19|20)[0-9]{{2}}(?![A-Za-z0-9])",
    "ip": rf"(?<![A-Za-z0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![A-Za-z0-9]|\.[0-9])",
}
#: Of 1900 to 2099, all days count: 17 x 4297.
DAY_PARTS = (17, 4297)


#: Formats that only a check digit tells from their neighbours: runs that hold them, and all their lengths.
CHECKED = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,}+", [rf"[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{q}}}" + (rf" ?[A-Z0-9]{{{r}}}" if r else "") for q in range(7, 1, -1) for r in (3, 2, 1, 0)]),
    "card": (r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,}+", [rf"[0-9](?:[ -]?[0-9]){{{n - 1}}}" for n in range(19, 12, -1)]),
}
#: How card numbers are written: groups of four digits or more, of which the last may be shorter, with one separator.
GROUPED = r"^[0-9]{4,}(?:([ -])[0-9]{4,}(?:\1[0-9]{4,})*(?:\1[0-9]{1,3})?)?$"
#: Steps in which a day-first date is looked for; each fails with 0.4.
WALK = 64


def any_format() -> str:
    """One pattern for the formats without a check digit; the back-reference of iso is its only group."""
    return "|".join(v for k, v in FORMATS.items() if k not in CHECKED)


def checked_values(text: Column) -> Column:
    """The IBANs and card numbers of a text that pass their check, whatever digits
    stand beside them: all lengths are tried from each start of a group. Values of
    one group come first, then long before short. A card number holds no other
    format, and is grouped like one or stands alone, lest tables of numbers match.
    """

    def values(name: str) -> Column:
        run, sizes = CHECKED[name]
        # Matches of no width find spans that overlap.
        spans = lambda runs: F.flatten(F.array(*[F.regexp_extract_all(runs, F.lit(f"(?<![A-Za-z0-9])(?=({p})(?![A-Za-z0-9]))"), F.lit(1)) for p in sizes]))
        card = lambda m, runs: (m.rlike(GROUPED) | F.array_contains(runs, m)) & _card_fits(digits_of(m)) & ~m.rlike(any_format())
        fits = card if name == "card" else lambda m, _: _iban_fits(F.replace(m, F.lit(" "), F.lit("")))
        found = lambda runs: F.filter(F.array_distinct(spans(F.array_join(runs, "|"))), lambda m: fits(m, runs))
        return F.when(text.rlike(run), let(F.regexp_extract_all(text, F.lit(run), F.lit(0)), found)).otherwise(F.array().cast("array<string>"))

    return let(F.concat(values("iban"), values("card")), lambda v: F.concat(F.filter(v, lambda m: ~m.rlike("[ -]")), F.filter(v, lambda m: m.rlike("[ -]"))))


def format_with(values: Column) -> Column:
    """Pattern of all formats in a text with these checked values. E-mail addresses go first."""
    email, others = FORMATS["email"], any_format().removeprefix(FORMATS["email"] + "|")
    own = F.concat(F.lit(f"{email}|(?<![A-Za-z0-9])(?:"), F.array_join(values, "|"), F.lit(f")(?![A-Za-z0-9])|{others}"))
    return F.when(F.size(values) > 0, own).otherwise(any_format())


def keyed(key: str, tweak: str | Column, turn: Column, value: Column) -> Column:
    """Hex digest that plays the random function of a round."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    return F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), value), 256)


def _number(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def permute_number(value: Column, high: int | Column, low: int | Column, key: str, tweak: str | Column) -> Column:
    """Keyed permutation of 0 .. high * low - 1."""
    high, low = (F.lit(m).cast("long") if isinstance(m, int) else m for m in (high, low))
    value = value.cast("long")
    # The quotient of large longs is a double; it is rounded after the rest is taken off.
    start = F.struct(((value - F.pmod(value, low)) / low).cast("decimal(20,0)").cast("long").alias("x"), F.pmod(value, low).alias("y"), high.alias("m"), low.alias("n"))
    end = F.aggregate(
        F.array(*[F.lit(i) for i in range(ROUNDS)]),
        start,
        lambda s, i: F.struct(s["y"].alias("x"), F.pmod(s["x"] + F.pmod(_number(keyed(key, tweak, i, s["y"].cast("string"))), s["m"]), s["m"]).alias("y"), s["n"].alias("m"), s["m"].alias("n")),
    )
    return let(end, lambda e: e["x"] * e["n"] + e["y"])


def _shift(text: Column, digest: Column) -> Column:
    """Move each character along its class by what the digest says for its place."""

    def one(digest: Column, j: Column) -> Column:
        c = F.substr(text, j, F.lit(1))
        by = F.conv(F.substr(digest, F.pmod(j - 1, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        out = c
        for letters in reversed(ALPHABETS):
            at = F.call_function("locate", c, F.lit(letters))
            out = F.when(at > 0, F.substr(F.lit(letters), F.pmod(at - 1 + by, F.lit(len(letters))) + 1, F.lit(1))).otherwise(out)
        return out

    return F.when(F.length(text) == 0, "").otherwise(let(digest, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))), lambda j: one(d, j)), "")))


def permute_string(value: Column, key: str, tweak: str) -> Column:
    """Keyed permutation of the strings with the same classes of characters."""
    # Bound once: a lambda's body is evaluated for every entry.
    return let(value, lambda v: _permute_bound(v, key, tweak))


def _permute_bound(value: Column, key: str, tweak: str) -> Column:
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("x"), F.substr(value, half + 1, F.length(value)).alias("y"))
    end = F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), start, lambda s, i: F.struct(s["y"].alias("x"), _shift(s["x"], keyed(key, tweak, i, s["y"])).alias("y")))
    return let(end, lambda e: F.concat(e["x"], e["y"]))


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refill(shape: Column, digits: Column) -> Column:
    """Put digits in the places that ``shape`` has digits in."""
    return let(digits, lambda d: _refill_bound(shape, d))


def _refill_bound(shape: Column, digits: Column) -> Column:
    place = lambda j: F.length(digits_of(F.substr(shape, F.lit(1), j)))
    one = lambda j: F.when(F.substr(shape, j, F.lit(1)).rlike("[0-9]"), F.substr(digits, place(j), F.lit(1))).otherwise(F.substr(shape, j, F.lit(1)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), one), "")


def luhn_digit(payload: Column) -> Column:
    """Check digit of a card number's other digits."""
    return let(payload, _luhn_bound)


def _luhn_bound(payload: Column) -> Column:

    def add(s: Column, j: Column) -> Column:
        d = F.substr(payload, F.length(payload) - j + 1, F.lit(1)).cast("int") * F.when(F.pmod(j, F.lit(2)) == 1, 2).otherwise(1)
        return s + F.when(d > 9, d - 9).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), add)
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals, A as 10, read as one number."""
    return let(text, _mod97_bound)


def _mod97_bound(text: Column) -> Column:

    def add(r: Column, j: Column) -> Column:
        at = F.call_function("locate", F.substr(text, j, F.lit(1)), F.lit(ALPHABETS[0] + ALPHABETS[2])) - 1
        return F.pmod(r * F.when(at > 9, 100).otherwise(10) + at, F.lit(97)).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), add)


def _card_fits(number: Column) -> Column:
    n = F.length(number)
    return luhn_digit(F.substr(number, F.lit(1), n - 1)) == F.substr(number, n, F.lit(1)).cast("int")


def _iban_fits(plain: Column) -> Column:
    return mod97(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(4)))) == 1


def _card(m: Column, key: str) -> Column:
    number = digits_of(m)
    n = F.length(number)
    payload = F.substr(number, F.lit(1), n - 1)
    low = F.floor((n - 1) / 2).cast("int")
    power = lambda k: F.concat(F.lit("1"), F.repeat(F.lit("0"), k)).cast("long")
    new = F.lpad(permute_number(payload.cast("long"), power(n - 1 - low), power(low), key, F.concat(F.lit("card"), n.cast("string"))).cast("string"), n - 1, F.lit("0"))
    return F.when(_card_fits(number), refill(m, let(new, lambda p: F.concat(p, luhn_digit(p).cast("string")))))


def _iban(m: Column, key: str) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, account = F.substr(plain, F.lit(1), F.lit(2)), F.substr(plain, F.lit(5), F.length(plain))
    checked = lambda a: F.concat(country, F.lpad((98 - mod97(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a)
    shown = lambda j: F.length(F.replace(F.substr(m, F.lit(1), j), F.lit(" "), F.lit("")))
    spaced = let(
        let(permute_string(account, key, "iban"), checked),
        lambda whole: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda j: F.when(F.substr(m, j, F.lit(1)) == " ", " ").otherwise(F.substr(whole, shown(j), F.lit(1)))), ""),
    )
    return F.when(_iban_fits(plain), spaced)


def _phone(m: Column, key: str) -> Column:
    number = digits_of(m)
    ten = F.right(number, F.lit(10)).cast("long")
    new = F.lpad(permute_number(ten, 100_000, 100_000, key, "phone").cast("string"), 10, "0")
    return refill(m, F.concat(F.substr(number, F.lit(1), F.length(number) - 10), new))


def _worldphone(m: Column, key: str) -> Column:
    """The first three digits, which hold the country, stay; the others are permuted.
    Numbers of country code 1 fare as in the other notations of phone numbers."""
    number = digits_of(m)
    k = F.length(number) - 3
    low = F.floor(k / 2).cast("int")
    power = lambda n: F.concat(F.lit("1"), F.repeat(F.lit("0"), n)).cast("long")
    rest = F.substr(number, F.lit(4), k).cast("long")
    new = F.lpad(permute_number(rest, power(k - low), power(low), key, F.concat(F.lit("phone"), F.substr(number, F.lit(1), F.lit(3)), k.cast("string"))).cast("string"), k, F.lit("0"))
    american = number.startswith("1") & (F.length(number) == 11)
    return F.when(american, _phone(m, key)).otherwise(refill(m, F.concat(F.substr(number, F.lit(1), F.lit(3)), new)))


def _ssn(m: Column, key: str) -> Column:
    part = lambda a, k: F.substr(m, F.lit(a), F.lit(k)).cast("long")
    area = part(1, 3) - 1 - F.when(part(1, 3) > 666, 1).otherwise(0)

    def spelt(new: Column) -> Column:
        serial = F.pmod(new, F.lit(9999))
        rest = ((new - serial) / 9999).cast("long")
        group = F.pmod(rest, F.lit(99))
        first = ((rest - group) / 99).cast("long") + 1
        first = first + F.when(first >= 666, 1).otherwise(0)
        padded = lambda c, k: F.lpad(c.cast("string"), k, "0")
        return F.concat_ws("-", padded(first, 3), padded(group + 1, 2), padded(serial + 1, 4))

    return let(permute_number((area * 99 + part(5, 2) - 1) * 9999 + part(8, 4) - 1, 898 * 99, 9999, key, "ssn"), spelt)


def _date(m: Column, key: str, *patterns: str, late: bool = False) -> Column:
    """``late`` dates have a day above 12 and keep one, so that day-first and
    month-first pseudonyms cannot meet: the permutation is repeated until it gives one."""
    first = F.lit("1900-01-01").cast("date")
    read = [F.try_to_date(m, p) for p in patterns]
    moved = lambda n: permute_number(n, *DAY_PARTS, key, "date")
    shown = lambda n: F.date_add(first, n.cast("int"))
    start = F.date_diff(F.coalesce(*read), first).cast("long")
    walk = lambda: F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), moved(start), lambda n, _: F.when(F.dayofmonth(shown(n)) > 12, n).otherwise(moved(n)))
    return let(shown(walk() if late else moved(start)), lambda new: F.coalesce(*[F.when(r.isNotNull(), F.date_format(new, p)) for r, p in zip(read, patterns)]))


def _ip(m: Column, key: str) -> Column:
    value = F.aggregate(F.split(m, r"\."), F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    new = permute_number(value, 1 << 16, 1 << 16, key, "ip")
    return let(new, lambda v: F.concat_ws(".", *[F.shiftright(v, k).bitwiseAND(255).cast("string") for k in (24, 16, 8, 0)]))


def pseudonym(m: Column, key: str) -> Column:
    """Pseudonym of one match of any format; what fails its format's check stays."""
    whole = lambda name: m.rlike(f"^(?:{FORMATS[name]})$")
    at = F.call_function("locate", F.lit("@"), m)
    email = F.concat(permute_string(F.substr(m, F.lit(1), at - 1), key, "email"), F.substr(m, at, F.length(m)))
    new = (
        F.when(at > 0, email)
        .when(whole("iban"), _iban(m, key))
        .when(whole("card"), _card(m, key))
        .when(whole("phone"), _phone(m, key))
        .when(whole("worldphone"), _worldphone(m, key))
        .when(whole("ssn"), _ssn(m, key))
        .when(whole("iso"), _date(m, key, "yyyy-MM-dd", "yyyy/MM/dd"))
        .when(whole("dotted"), _date(m, key, "dd.MM.yyyy"))
        .when(whole("monthfirst"), _date(m, key, "MM/dd/yyyy", "MM-dd-yyyy"))
        .when(whole("dayfirst"), _date(m, key, "dd/MM/yyyy", "dd-MM-yyyy", late=True))
        .when(whole("shortmonth"), _date(m, key, "M/d/yyyy", "M-d-yyyy"))
        .when(whole("shortday"), _date(m, key, "d/M/yyyy", "d-M-yyyy", late=True))
        .when(whole("dayword"), _date(m, key, "d MMMM yyyy"))
        .when(whole("monthword"), _date(m, key, "MMMM d, yyyy"))
        .otherwise(_ip(m, key))
    )
    return F.coalesce(new, m)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", changed: str | None = None) -> DataFrame:
    """Replace personal values in a text column; every other column stays.

    A null text stays null, an empty one empty; rows are independent, so ties and
    repeated rows fare alike. ``changed`` names a column for the number of values
    replaced, which takes the place of an input column of that name. A permutation
    may leave single values as they are. Whoever holds the key can invert it.

    A date's pseudonym is a date in the same notation, equal days stay equal in all
    notations but day-first ones; without leading zeros, its length may change. Phone
    numbers after a plus sign keep their first three digits, and take in digits that
    follow them after one blank.
    """
    extra = [c for c in docs.columns if c != text and c != changed]
    held = "_held" + "_" * max(map(len, docs.columns))
    out = docs.select(F.struct(*extra).alias(held) if extra else F.lit(0).alias(held), text)
    out = out.withColumn("_checked", F.when(F.col(text).rlike("[0-9]"), checked_values(F.col(text))))
    out = out.withColumn("_format", F.coalesce(format_with(F.col("_checked")), F.lit(any_format())))
    has = F.col(text).rlike("[0-9@]") & ((F.size("_checked") > 0) | F.col(text).rlike(any_format()))
    matches = F.when(has, F.regexp_extract_all(F.col(text), F.col("_format"), F.lit(0)))
    out = out.withColumn("_matches", matches).withColumn("_new", F.transform("_matches", lambda m: pseudonym(m, key)))
    gaps = F.split(F.col(text), F.col("_format"), -1)
    pieces = F.zip_with(gaps, "_new", lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
    if changed:
        out = out.withColumn(changed, F.coalesce(F.size(F.filter(F.arrays_zip(F.col("_matches").alias("a"), F.col("_new").alias("b")), lambda p: p["a"] != p["b"])), F.lit(0)).cast("long"))
    replaced = F.when(F.col("_matches").isNull(), F.col(text)).otherwise(F.array_join(pieces, "")).alias(text)
    names = [c for c in docs.columns if c != changed] + ([changed] if changed else [])
    return out.select(*[replaced if c == text else F.col(c) if c == changed else F.col(held)[c].alias(c) for c in names])
