"""Format-preserving pseudonyms for personal data, in column expressions only.

Values are found by pattern, validated, and mapped by a keyed Feistel permutation of their own format: the positions of
a value (digits, letters, octets, day numbers) are cut into two halves, and in each round one half is shifted,
position by position and modulo the position's size, by a SHA-256 of the key, the kind, the round and the other half.
That is a bijection of the format, so equal values stay linked across documents and different ones stay apart, and the
holder of the key can undo it; nothing is stored or joined.

Kinds and their validation (what does not pass it stays as it is):
  card    13 to 19 digits with a Luhn check digit; all digits but the last are permuted, the check digit is made anew
  iban    ISO 13616 with its mod-97 check; the account part is permuted, the check digits are made anew
  ssn     area, group and serial in their valid ranges
  ip      four octets up to 255
  phone   after a plus sign, or ten digits grouped 3-3-4; the country code stays; North American numbers stay dialable
  date    calendar dates from 1900 to 2103 as Y-M-D, M/D/Y (D/M/Y where only that is a date) or D.M.Y
  email   the part before the @, letters to letters and digits to digits
  secret  access keys, and values assigned to a password, token, secret or key; hexadecimal values stay so

Defined results: a null text stays null and an empty one empty, both with 0 replaced; repeated rows change alike; the
whole text is searched, and matches never overlap.  Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigvane.llm.common import free_name

ROUNDS = 10
SIDE = 273  # dates: days since 1900-01-01 as two digits of this base
FIRST_DAY = "DATE'1900-01-01'"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "iban": r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": r"(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Tt]oken|[Ss]ecret|[Aa]pi[_-]?[Kk]ey|PASSWORD|TOKEN|SECRET|API_KEY)[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9+/_-]{6,}+",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d|[./-]\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:1[ .-])?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?![\d-]|\.\d)",
    "card": r"(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
}
# A match starts where no letter, digit or part of a longer number stands before it.
ANY = r"(?<![A-Za-z0-9_@%+-]|[0-9][./:]|[A-Za-z0-9]\.)(?=[A-Za-z0-9._%+(-])(?:" + "|".join(PATTERNS.values()) + ")"


def _int(column: Column) -> Column:
    return column.cast("int")


def _chars(text: Column) -> Column:
    """The characters of a non-empty text."""
    return F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.substring(text, i, F.lit(1)))


def _digits(text: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(text, "[^0-9]", "")), _int)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is made once."""
    return F.transform(F.array(value), body)[0]


def feistel(values: Column, sizes: Column, key: str, tweak: str | Column, inverse: bool = False) -> Column:
    """The keyed permutation of arrays whose i-th entry lies in 0 .. sizes[i] - 1, or its inverse."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def shifted(part: Column, by: Column, moduli: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), tweak, F.size(part).cast("string"), turn.cast("string"), F.array_join(F.transform(by, lambda v: v.cast("string")), ","))

        def shift(value: Column, i: Column, seed: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
            size = F.get(moduli, i).cast("long")
            return ((value - noise % size + size if inverse else value + noise % size) % size).cast("int")

        return _with(seed, lambda bound: F.transform(part, lambda value, i: shift(value, i, bound)))

    def permuted(halves: Column) -> Column:
        start = F.struct(halves["left"].alias("left"), halves["right"].alias("right"))

        def turn(state: Column, number: Column) -> Column:
            left, right = state["left"], state["right"]
            return F.when(
                number % 2 == 0, F.struct(shifted(left, right, halves["left_sizes"], number).alias("left"), right.alias("right"))
            ).otherwise(F.struct(left.alias("left"), shifted(right, left, halves["right_sizes"], number).alias("right")))

        return F.aggregate(turns, start, turn, lambda s: F.concat(s["left"], s["right"]))

    def halved(whole: Column) -> Column:
        n = F.size(whole["values"])
        half = F.floor(n / 2).cast("int")
        parts = [F.slice(whole[c], *span).alias(name) for name, c, span in (
            ("left", "values", (F.lit(1), half)), ("right", "values", (half + 1, n - half)), ("left_sizes", "sizes", (F.lit(1), half)), ("right_sizes", "sizes", (half + 1, n - half)),
        )]
        return _with(F.struct(*parts), permuted)

    return _with(F.struct(values.alias("values"), sizes.alias("sizes")), halved)


def _constant(values: Column, size: int) -> Column:
    return F.transform(values, lambda _: F.lit(size))


def _fill(template: Column, digits: Column) -> Column:
    """The template with its digits replaced, in order."""

    def character(c: Column, i: Column) -> Column:
        rank = F.length(F.regexp_replace(F.substring(template, F.lit(1), i + 1), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]"), F.get(digits, rank - 1).cast("string")).otherwise(c)

    return F.array_join(F.transform(_chars(template), character), "")


def permute_characters(text: Column, key: str, tweak: str | Column, inverse: bool = False) -> Column:
    """Letters to letters of their case and digits to digits; letters stay a to f where all letters are."""
    def base(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), 48).when(c.rlike("[a-z]"), 97).when(c.rlike("[A-Z]"), 65).otherwise(-1)

    def moved(bound: Column) -> Column:
        chars, letters = bound["chars"], bound["letters"]
        values = F.transform(chars, lambda c: F.when(base(c) < 0, 0).otherwise(F.ascii(c) - base(c)))
        sizes = F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).when(base(c) > 0, letters).otherwise(1))
        return F.array_join(F.zip_with(chars, feistel(values, sizes, key, tweak, inverse), lambda c, v: F.when(base(c) < 0, c).otherwise(F.char(base(c) + v))), "")

    letters = F.when(text.rlike("^[0-9a-f]+$") | text.rlike("^[0-9A-F]+$"), 6).otherwise(26)
    return _with(F.struct(_chars(text).alias("chars"), letters.alias("letters")), moved)


def luhn_sum(digits: Column, doubled_from_right: int) -> Column:
    """The Luhn sum; digits at places of this parity from the right (0: the last) count double."""
    n = F.size(digits)

    def term(d: Column, i: Column) -> Column:
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - 1 - i) % 2 == doubled_from_right, twice).otherwise(d)

    return F.aggregate(F.transform(digits, term), F.lit(0), lambda a, x: a + x)


def _card(text: Column, key: str, inverse: bool) -> Column:
    def changed(digits: Column) -> Column:
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        moved = feistel(body, _constant(body, 10), key, "card", inverse)
        filled = _with(moved, lambda m: _fill(text, F.concat(m, F.array(_int((10 - luhn_sum(m, 0) % 10) % 10)))))
        return F.when(F.size(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0), filled).otherwise(text)

    return _with(_digits(text), changed)


def _mod97(text: Column) -> Column:
    """The remainder of letters and digits read as an ISO 7064 number."""

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(text), F.lit(0), step)


def _iban(text: Column, key: str, inverse: bool) -> Column:
    def changed(plain: Column) -> Column:
        country, account = F.substring(plain, 1, 2), F.substring(plain, 5, 40)
        valid = F.length(plain).between(15, 34) & (_mod97(F.concat(account, F.substring(plain, 1, 4))) == 1)

        def spaced(moved: Column) -> Column:
            check = F.lpad((98 - _mod97(F.concat(moved, country, F.lit("00")))).cast("string"), 2, "0")
            whole = F.concat(country, check, moved)

            def character(c: Column, i: Column) -> Column:
                rank = F.length(F.replace(F.substring(text, F.lit(1), i + 1), F.lit(" "), F.lit("")))
                return F.when(c == " ", c).otherwise(F.substring(whole, rank, F.lit(1)))

            return F.array_join(F.transform(_chars(text), character), "")

        return F.when(valid, _with(_plain_letters(account, key, inverse), spaced)).otherwise(text)

    return _with(F.replace(text, F.lit(" "), F.lit("")), changed)


def _plain_letters(text: Column, key: str, inverse: bool) -> Column:
    """Upper-case letters and digits, each to its kind."""
    chars = _chars(text)
    base = lambda c: F.when(c.rlike("[0-9]"), 48).otherwise(65)
    moved = feistel(F.transform(chars, lambda c: F.ascii(c) - base(c)), F.transform(chars, lambda c: F.when(c.rlike("[0-9]"), 10).otherwise(26)), key, "iban", inverse)
    return F.array_join(F.zip_with(chars, moved, lambda c, v: F.char(base(c) + v)), "")


def _ssn(text: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(text, "-"), _int)
    area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1), F.lit([898, 99, 9999]), key, "ssn", inverse)

    def joined(m: Column) -> Column:
        first = F.get(m, F.lit(0))
        texts = [F.when(first >= 665, first + 2).otherwise(first + 1), F.get(m, F.lit(1)) + 1, F.get(m, F.lit(2)) + 1]
        return F.concat_ws("-", *[F.lpad(t.cast("string"), n, "0") for t, n in zip(texts, (3, 2, 4), strict=True)])

    return F.when(valid, _with(moved, joined)).otherwise(text)


def _ip(text: Column, key: str, inverse: bool) -> Column:
    def changed(octets: Column) -> Column:
        moved = feistel(octets, F.lit([256] * 4), key, "ip", inverse)
        return F.when(F.array_max(octets) <= 255, F.array_join(F.transform(moved, lambda v: v.cast("string")), ".")).otherwise(text)

    return _with(F.transform(F.split(text, r"\."), _int), changed)


def _phone(text: Column, key: str, inverse: bool) -> Column:
    """The last ten digits, or all but a country code of two where there are fewer than eleven after a plus sign."""

    def split(digits: Column) -> Column:
        n = F.size(digits)
        country = F.when(n > 10, n - 10).when(text.startswith("+"), 2).otherwise(0)
        parts = F.struct(F.slice(digits, F.lit(1), country).alias("country"), F.slice(digits, country + 1, n - country).alias("national"))
        return F.when(n.between(7, 15), _with(parts, kinds)).otherwise(text)

    def kinds(parts: Column) -> Column:
        national = parts["national"]
        dialable = (F.size(national) == 10) & (F.get(national, F.lit(0)) > 1) & (F.get(national, F.lit(3)) > 1)
        return F.when(dialable, changed(parts, "phone10", (0, 3))).otherwise(changed(parts, "phone", ()))

    def changed(parts: Column, tweak: str, limited: tuple[int, ...]) -> Column:
        """Digits at the limited places are 2 to 9."""
        values = F.transform(parts["national"], lambda d, i: F.when(i.isin(*limited), d - 2).otherwise(d) if limited else d)
        sizes = F.transform(parts["national"], lambda _, i: F.when(i.isin(*limited), 8).otherwise(10) if limited else F.lit(10))
        moved = F.transform(feistel(values, sizes, key, tweak, inverse), lambda v, i: F.when(i.isin(*limited), v + 2).otherwise(v) if limited else v)
        return _with(F.concat(parts["country"], moved), lambda whole: _fill(text, whole))

    return _with(_digits(text), split)


def _date(text: Column, key: str, inverse: bool) -> Column:
    mark = F.regexp_extract(text, "[-/.]", 0)

    def is_date(year: Column, month: Column, day: Column) -> Column:
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        days = F.when(month.isin(4, 6, 9, 11), 30).when(month != 2, 31).when(leap, 29).otherwise(28)
        return year.between(1900, 2103) & month.between(1, 12) & (day >= 1) & (day <= days)

    def moved(year: Column, month: Column, day: Column, order: str) -> Column:
        number = F.datediff(F.make_date(year, month, day), F.expr(FIRST_DAY))
        place = feistel(F.array(_int(F.floor(number / SIDE)), number % SIDE), F.lit([SIDE, SIDE]), key, "date", inverse)

        def written_as(m: Column) -> Column:
            date = F.date_add(F.expr(FIRST_DAY), F.get(m, F.lit(0)) * SIDE + F.get(m, F.lit(1)))
            wide = F.length(text) == 10
            short = {"y": F.year(date).cast("string"), "m": F.month(date).cast("string"), "d": F.day(date).cast("string")}
            texts = [short[o] if o == "y" else F.when(wide, F.lpad(short[o], 2, "0")).otherwise(short[o]) for o in order]
            return F.concat(texts[0], mark, texts[1], mark, texts[2])

        return _with(place, written_as)

    def read(parts: Column) -> Column:
        a, b, c = (F.get(parts, F.lit(i)) for i in range(3))
        return (
            F.when((mark == "-") & is_date(a, b, c), moved(a, b, c, "ymd"))
            .when((mark == "/") & is_date(c, a, b), moved(c, a, b, "mdy"))
            .when((mark != "-") & is_date(c, b, a), moved(c, b, a, "dmy"))
            .otherwise(text)
        )

    return _with(F.transform(F.split(text, "[-/.]"), _int), read)


def _email(text: Column, key: str, inverse: bool) -> Column:
    local, domain = F.substring_index(text, "@", 1), F.substring_index(text, "@", -1)
    return F.concat(permute_characters(local, key, F.concat(F.lit("email"), F.lower(domain)), inverse), F.lit("@"), domain)


def _secret(text: Column, key: str, inverse: bool) -> Column:
    value = F.regexp_extract(text, "[A-Za-z0-9+/_-]+$", 0)
    return F.concat(F.substring(text, F.lit(1), F.length(text) - F.length(value)), permute_characters(value, key, "secret", inverse))


def _access_key(text: Column, key: str, inverse: bool) -> Column:
    return F.concat(F.substring(text, 1, 4), permute_characters(F.substring(text, 5, 16), key, "access key", inverse))


KINDS = {"email": _email, "iban": _iban, "key": _access_key, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of a matched value (or, inversely, the value of a pseudonym); itself where it is not valid."""
    branch = F.when(F.lit(False), value)
    for kind, change in KINDS.items():
        branch = branch.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), change(value, key, inverse))
    return branch.otherwise(value)


def pseudonymize(docs: DataFrame, key: str, column: str = "text", inverse: bool = False) -> DataFrame:
    """``docs`` with the column's values replaced, and ``n_replaced`` (under a free name)."""
    text = F.col(column)
    gaps, changed, counter = (free_name(docs, c) for c in ("pii_gaps", "pii_changed", "n_replaced"))
    pattern = F.lit(ANY)
    possible = text.rlike("[0-9@=:]")
    matches = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(m, key, inverse).alias("new")))
    none = F.lit(None)
    found = docs.withColumn(gaps, F.when(possible, F.split(text, ANY, -1)).otherwise(none)).withColumn(changed, F.when(possible, matches).otherwise(none))
    joined = F.array_join(F.zip_with(F.col(gaps), F.col(changed), lambda gap, m: F.concat(gap, F.coalesce(m["new"], F.lit("")))), "")
    n = F.coalesce(F.size(F.filter(F.col(changed), lambda m: m["new"] != m["old"])), F.lit(0))
    return found.withColumn(counter, F.when(F.col(changed).isNull(), 0).otherwise(n).cast("long")).withColumn(column, F.when(F.col(gaps).isNull(), text).otherwise(joined)).drop(gaps, changed)
