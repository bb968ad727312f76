"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Column expressions only.  A value is cut into symbols, each with its own radix
(a digit 10, a letter 26, an address byte 256, a date two symbols with radices
189 and 773, since 400 years have 189 * 773 days), and a keyed Feistel network
permutes the symbol strings: each round adds, symbol by symbol, digits of a
keyed hash of one half to the other half.  So a value goes to another valid
value of the same format, the same one wherever it stands, and whoever has the
key can go back.  Check digits are left out of the permutation and made anew.

Only validated values change: Luhn for card numbers, mod 97 for IBANs, range
rules for social security numbers, addresses and dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import named

ROUNDS = 8
DATE_RADIX = (189, 773)
FIRST_DAY = "1800-01-01"  # dates are permuted within 400 years from here

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9/-]|\.[0-9])"
SSN = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z+])(?:\+[1-9][0-9]{0,2}[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z+])\+[1-9][0-9]{0,2}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])"
#: In this order at each place of a text.
KINDS = {"email": EMAIL, "ipv4": IPV4, "iban": IBAN, "date": DATE, "ssn": SSN, "phone": PHONE, "card": CARD}
ANY = "|".join(KINDS.values())


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def feistel(symbols: Column, radix: Column, kind: str, key: str, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """Permutation of array<int> ``symbols`` (each under its ``radix``), as array<int>."""
    return let(F.struct(symbols.alias("s"), radix.alias("r")), lambda x: _rounds(x["s"], x["r"], kind, key, rounds, inverse))


def _rounds(symbols: Column, radix: Column, kind: str, key: str, rounds: int, inverse: bool) -> Column:
    half = F.floor(F.size(symbols) / 2).cast("int")
    parts = F.struct(F.slice(symbols, 1, half).alias("a"), F.slice(symbols, half + 1, F.size(symbols) - half).alias("b"))
    radii = F.struct(F.slice(radix, 1, half).alias("a"), F.slice(radix, half + 1, F.size(symbols) - half).alias("b"))

    def add(part: Column, size: Column, other: Column, k: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), F.array_join(other.cast("array<string>"), ",")).cast("binary"), 512)
        sign = -1 if inverse else 1

        def moved(h: Column) -> Column:
            shift = lambda i: F.conv(F.substr(h, (i % 21) * 6 + 1, F.lit(6)), 16, 10).cast("long")
            return F.transform(part, lambda x, i: F.pmod(x + sign * shift(i), F.get(size, i).cast("long")).cast("int"))

        return let(digest, moved)

    def step(state: Column, k: Column) -> Column:
        even = k % 2 == 0
        return F.struct(
            F.when(even, add(state["a"], radii["a"], state["b"], k)).otherwise(state["a"]).alias("a"),
            F.when(even, state["b"]).otherwise(add(state["b"], radii["b"], state["a"], k)).alias("b"),
        )

    order = F.sequence(F.lit(rounds - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(rounds - 1))
    return F.aggregate(order, parts, step, lambda s: F.concat(s["a"], s["b"]))


def _codes(core: Column) -> Column:
    return F.transform(F.filter(F.split(core, ""), lambda c: c != ""), lambda c: F.ascii(c))


def _base(c: Column) -> Column:
    return F.when(c.between(48, 57), 48).when(c.between(65, 90), 65).when(c.between(97, 122), 97).otherwise(c)


def _size(c: Column) -> Column:
    return F.when(c.between(48, 57), 10).when(c.between(65, 90) | c.between(97, 122), 26).otherwise(1)


def _text(core: Column, kind: str, key: str, inverse: bool, low: Callable[[Column, Column], Column] | None = None, size: Callable[[Column, Column], Column] | None = None) -> Column:
    """The core's characters permuted, each within its class; ``low`` and ``size`` override a position's first code and radix."""
    low = low or (lambda c, i: _base(c))
    size = size or (lambda c, i: _size(c))

    def permuted(codes: Column) -> Column:
        radix = F.transform(codes, size).cast("array<int>")
        new = feistel(F.transform(codes, lambda c, i: (c - low(c, i)).cast("int")), radix, kind, key, inverse=inverse)
        return F.array_join(F.zip_with(new, F.transform(codes, low), lambda v, b: F.chr(v + b)), "")

    return let(_codes(core), permuted)


def _dress(core: Column, like: Column) -> Column:
    """``core`` in the format of ``like``: its letters and digits in turn, everything else as it stands."""
    at = lambda i: F.length(F.regexp_replace(F.substr(like, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
    chars = F.filter(F.split(like, ""), lambda c: c != "")
    return let(core, lambda new: F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substr(new, at(i), F.lit(1))).otherwise(c)), ""))


def _luhn(digits: Column) -> Column:
    """Luhn sum mod 10 of a digit string, its last digit being the check digit."""
    n = F.length(digits)
    values = F.transform(_codes(digits), lambda c, i: F.when((n - i) % 2 == 0, (c - 48) * 2 - F.when(c > 52, 9).otherwise(0)).otherwise(c - 48))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def _mod97(core: Column) -> Column:
    """An IBAN's remainder: the first four characters behind the rest, letters as 10 to 35."""
    moved = F.concat(F.substr(core, F.lit(5), F.length(core)), F.substr(core, F.lit(1), F.lit(4)))
    return F.aggregate(_codes(moved), F.lit(0), lambda a, c: F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97))


def _card(m: Column, key: str, inverse: bool) -> Column:
    def change(core: Column) -> Column:
        body = _text(F.substr(core, F.lit(1), F.length(core) - 1), "card", key, inverse)
        whole = let(body, lambda new: F.concat(new, ((10 - _luhn(F.concat(new, F.lit("0")))) % 10).cast("string")))
        return F.when(_luhn(core) == 0, _dress(whole, m)).otherwise(m)

    return let(F.regexp_replace(m, "[^0-9]", ""), change)


def _iban(m: Column, key: str, inverse: bool) -> Column:
    def change(core: Column) -> Column:
        country = F.substr(core, F.lit(1), F.lit(2))
        checked = lambda new: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0"), new)
        whole = let(_text(F.substr(core, F.lit(5), F.length(core)), "iban", key, inverse), checked)
        return F.when(_mod97(core) == 1, _dress(whole, m)).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), change)


def _phone(m: Column, key: str, inverse: bool) -> Column:
    """The last ten digits of numbers with an area code, first digits of area and exchange 2 to 9; of others all after the first three."""
    core = F.regexp_replace(m, "[^0-9]", "")
    n, national = F.length(core), m.rlike(r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}$")
    skip = F.when(national, n - 10).otherwise(F.least(F.lit(3), n - 2))
    local = F.substr(core, skip + 1, n)
    lead = lambda i: national & i.isin(0, 3)
    new = _text(local, "phone", key, inverse, lambda c, i: F.when(lead(i), 50).otherwise(48), lambda c, i: F.when(lead(i), 8).otherwise(10))
    return _dress(F.concat(F.substr(core, F.lit(1), skip), new), m)


def _email(m: Column, key: str, inverse: bool) -> Column:
    local, host = F.substring_index(m, "@", 1), F.substr(m, F.locate("@", m), F.length(m))
    core = F.regexp_replace(local, "[^0-9A-Za-z]", "")
    return F.concat(_dress(_text(core, "email", key, inverse), local), host)


def _ipv4(m: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(m, "[.]"), lambda x: x.cast("int"))
    return F.array_join(feistel(parts, F.transform(parts, lambda x: F.lit(256)), "ipv4", key, inverse=inverse).cast("array<string>"), ".")


def _ssn(m: Column, key: str, inverse: bool) -> Column:
    area, group, serial = (F.substring_index(F.substring_index(m, "-", k), "-", -1).cast("int") for k in (1, 2, 3))
    parts = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    new = feistel(parts, F.array(*map(F.lit, (898, 99, 9999))), "ssn", key, inverse=inverse)
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return let(new, lambda x: F.concat_ws("-", pad(F.get(x, 0) + 1 + (F.get(x, 0) >= 665).cast("int"), 3), pad(F.get(x, 1) + 1, 2), pad(F.get(x, 2) + 1, 4)))


def _date(m: Column, key: str, inverse: bool) -> Column:
    """yyyy-MM-dd, dd/MM/yyyy (where that is no date: MM/dd/yyyy) or dd.MM.yyyy; other dates and years outside 1800 to 2199 stay."""
    day_first, month_first = F.try_to_date(m, "dd/MM/yyyy"), F.try_to_date(m, "MM/dd/yyyy")
    first = F.lit(FIRST_DAY).cast("date")
    style = F.when(m.contains("-"), "yyyy-MM-dd").when(m.contains("."), "dd.MM.yyyy").when(day_first.isNotNull(), "dd/MM/yyyy").otherwise("MM/dd/yyyy")
    day = F.coalesce(F.try_to_date(m, "yyyy-MM-dd"), day_first, month_first, F.try_to_date(m, "dd.MM.yyyy"))

    def change(n: Column) -> Column:
        parts = F.array(F.floor(n / DATE_RADIX[1]).cast("int"), (n % DATE_RADIX[1]).cast("int"))
        new = feistel(parts, F.array(*map(F.lit, DATE_RADIX)), "date", key, inverse=inverse)
        to = let(new, lambda x: F.date_add(first, F.get(x, 0) * DATE_RADIX[1] + F.get(x, 1)))
        shown = let(to, lambda d: F.when(style == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(style == "dd.MM.yyyy", F.date_format(d, "dd.MM.yyyy")).when(style == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "MM/dd/yyyy")))
        return F.when(n.between(0, DATE_RADIX[0] * DATE_RADIX[1] - 1), shown).otherwise(m)

    return let(F.datediff(day, first), change)


_MAKERS = {"email": _email, "ipv4": _ipv4, "iban": _iban, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str, *, inverse: bool = False) -> Column:
    """The pseudonym of a value that one of KINDS matches; ``inverse`` gives the value back."""
    out = F.when(value.isNull(), value)
    for kind, pattern in KINDS.items():
        out = out.when(value.rlike(f"^(?:{pattern})$"), _MAKERS[kind](value, key, inverse))
    return out.otherwise(value)


def pseudonymise(docs: DataFrame, key: str, *, text: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and their number as n_found (in place of a column of that name).

    Rows change one by one; null and empty texts and texts without values stay
    as they are, with n_found 0, and so do all other columns.
    """
    own = [c for c in docs.columns if c != "n_found"]
    # The row's own columns stand in a struct, so none is taken for a helper.
    body = F.col("body")
    rows = docs.select(F.struct(*named(own)).alias("row"), *named([text], ["body"]))
    rows = rows.withColumn("found", F.when(body.rlike("[0-9@]"), F.regexp_extract_all(body, F.lit(f"({ANY})"), 1)))
    new = F.transform("found", lambda v: pseudonym(v, key, inverse=inverse))
    rows = rows.withColumn("new", F.when(F.size("found") > 0, new))
    gaps = F.split(body, ANY, -1)
    filled = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("new", i), F.lit("")))), "")
    changed = F.coalesce(F.size(F.filter(F.zip_with("found", "new", lambda a, b: a != b), lambda x: x)), F.lit(0))
    text_ = F.when(F.col("new").isNotNull(), filled).otherwise(body)
    return rows.select(*((text_ if c == text else F.col("row")[c]).alias(c) for c in own), changed.cast("long").alias("n_found"))
