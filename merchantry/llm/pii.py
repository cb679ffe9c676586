"""Format-preserving pseudonyms: personal numbers, dates and addresses permuted within their format by keyed Feistel rounds.

Built-in expressions only. A value's pseudonym depends on the value, its kind and the key alone,
so equal values stay equal across documents and different ones stay different; without the
key it can't be turned back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8  # even: the halves end where they began

# The forms that are looked for, in the order in which they are tried at one place.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_MARKED = r"\d[ .()-]{0,2}"
_FORMS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])",
    "iso_date": r"(?<![\w/-])\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}|(?![\w/-]))",
    "slash_date": r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])",
    "ssn": r"(?<![\w-])(?!000|666)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])",
    # +1 and ten digits, another country code with 8 to 15 digits in all, or ten digits.
    "phone": r"(?<![\w+])\+1[ .-]?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}(?![\w])"
             r"|(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?![\w])"
             rf"(?<={_MARKED * 7}\d)(?<!{_MARKED * 15}\d)"
             r"|(?<![\w(+-])\(?[2-9]\d{2}\)?[ .-][2-9]\d{2}[ .-]\d{4}(?![\w])",
}
# Lengths of IBANs by country; printed ones are cut by them, so that a group after them is not taken in.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
_PRINTED_IBAN = r"(?<![A-Za-z0-9])(?=[A-Z]{2}\d{2} [A-Z0-9]{4} )(?:" + "|".join(
    rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: [A-Z0-9]{{4}}){{{length // 4 - 1}}}" + (f" [A-Z0-9]{{{length % 4}}}" if length % 4 else "")
    for length, countries in _IBAN_LENGTHS.items()
) + r")(?![A-Za-z0-9])"
# A run of digit groups, in which card numbers are looked for; it ends where another form begins.
_GROUPS = r"\d++(?:-\d++)*+(?![\w-])"
_OTHERS = "|".join(f"(?:{form})" for form in _FORMS.values())
# With the numbers after it, which are a card's where the check fails.
_FORMS["printed_iban"] = rf"{_PRINTED_IBAN}(?: (?!{_OTHERS}|{_PRINTED_IBAN}){_GROUPS})*+"
_FORMS["card"] = rf"(?<![\w.,-])(?=\d(?:[ -]?\d){{12}}){_GROUPS}(?: (?!{_OTHERS}){_GROUPS})*+"
# How cards are mostly printed; these are taken before other groups that pass the check.
_USUAL, _USUAL_SIZES = "^(4-4-4-4|4-6-[45]|1[3-9])$", (4, 3, 1)
_OTHER_SIZES = (5, 4, 3, 2)
_PIECES = "array<struct<rest:string,kind:string,pseudonym:string>>"
PATTERN = "|".join(f"(?:{form})" for form in _FORMS.values())
# What every form needs; texts without it are left alone unread by the longer pattern.
_HINT = r"[0-9][^A-Za-z]?[0-9]|@"

_FIRST_DAY = "1800-01-01"
_DAYS = (189, 773)  # their product is the 146,097 days of 400 years


def _hash(key: str, *parts: Column) -> Column:
    """48 keyed bits as a long."""
    text = F.concat_ws("|", F.lit(key), *[part.cast("string") for part in parts], F.lit(key))
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("long")


def permuted_numbers(key: str, kind: str, x: Column, y: Column, x_size: int, y_size: int) -> Column:
    """A struct (x, y): the pair's place in a keyed permutation of all pairs below the two sizes."""
    start = F.struct(
        x.cast("long").alias("x"), y.cast("long").alias("y"), F.lit(x_size).cast("long").alias("mx"), F.lit(y_size).cast("long").alias("my")
    )
    # Each round turns one half by a hash of the other and swaps them.
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda held, r: F.struct(
            held.y.alias("x"), ((held.x + _hash(key, F.lit(kind), r, held.y) % held.mx) % held.mx).alias("y"),
            held.my.alias("mx"), held.mx.alias("my"),
        ),
    )


def _turned(key: str, kind: str, part: Column, r: Column, other: Column) -> Column:
    """Each letter and digit moved on within its class by a hash of the other half."""

    def moved(c: Column, i: Column) -> Column:
        step = _hash(key, F.lit(kind), r, i, other)

        def within(first: str, size: int) -> Column:
            return F.char((F.ascii(c) - ord(first) + step % size) % size + ord(first))

        return F.when(c.rlike("^[0-9]$"), within("0", 10)).when(c.rlike("^[a-z]$"), within("a", 26)).when(
            c.rlike("^[A-Z]$"), within("A", 26)).otherwise(c)

    return F.array_join(F.transform(F.split(part, ""), moved), "")


def permuted_text(key: str, kind: str, text: Column) -> Column:
    """The text's place in a keyed permutation of all texts of its form: digits, letters and cases stay where they are."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("x"), F.substr(text, half + 1).alias("y"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start,
        lambda held, r: F.struct(held.y.alias("x"), _turned(key, kind, held.x, r, held.y).alias("y")),
        lambda held: F.concat(held.x, held.y),
    )
    return done


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refilled(form: Column, digits: Column) -> Column:
    """`form` with its digits, in order, replaced by `digits`."""
    return F.aggregate(
        F.split(form, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("used")),
        lambda held, c: F.when(
            c.rlike("^[0-9]$"),
            F.struct(F.concat(held.out, F.substr(digits, held.used + 1, F.lit(1))).alias("out"), (held.used + 1).alias("used")),
        ).otherwise(F.struct(F.concat(held.out, c).alias("out"), held.used.alias("used"))),
        lambda held: held.out,
    )


def luhn_digit(digits: Column) -> Column:
    """The check digit that belongs after `digits`."""
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda held, i: held + F.when(
            i % 2 == 1,
            (2 * F.substr(digits, -i, F.lit(1)).cast("int")) % 10 + F.floor(2 * F.substr(digits, -i, F.lit(1)).cast("int") / 10).cast("int"),
        ).otherwise(F.substr(digits, -i, F.lit(1)).cast("int")),
    )
    return ((10 - total % 10) % 10).cast("string")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of an IBAN's characters, letters counting 10 to 35."""
    return F.aggregate(
        F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0).cast("long"),
        lambda held, c: F.when(c.rlike("^[0-9]$"), (held * 10 + F.ascii(c) - 48) % 97).otherwise((held * 100 + F.ascii(c) - 55) % 97),
    )


def _passes_luhn(digits: Column) -> Column:
    count = F.length(digits)
    return F.when(
        digits.rlike("^[0-9]{13,19}$"), luhn_digit(F.substr(digits, F.lit(1), count - 1)) == F.substr(digits, count, F.lit(1))
    ).otherwise(False)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _card_places(run: Column) -> Column:
    """Card numbers in a run of digit groups: array<struct<at, n>>, the first group and the number of groups.

    Groups printed as cards mostly are come first; then, from the left and longest first, up to
    five groups, or the whole run, that pass the check.
    """

    def sized(groups: Column) -> Column:
        count = F.size(groups)
        starts = F.sequence(F.lit(1), count)

        def passes(i: Column, n: Column) -> Column:
            return (i + n - 1 <= count) & (groups[i - 1] != "") & _passes_luhn(F.array_join(F.slice(groups, i, n), ""))

        def first(sizes: list[Column], fits: Callable[[Column], Column]) -> Column:
            return F.coalesce(F.get(F.filter(F.array(*sizes), fits), F.lit(0)), F.lit(0))

        def usual(i: Column) -> Column:
            return first([*map(F.lit, _USUAL_SIZES)], lambda n: F.array_join(
                F.transform(F.slice(groups, i, n), F.length), "-").rlike(_USUAL) & passes(i, n))

        def other(known: Column, i: Column) -> Column:
            sizes = [F.when(i == 1, count).otherwise(0), *map(F.lit, _OTHER_SIZES)]
            return F.when(known[i - 1] > 0, known[i - 1]).otherwise(first(
                sizes, lambda n: (n > 0) & ~F.exists(F.slice(known, i, n), lambda k: k > 0) & passes(i, n)))

        return _let(F.transform(starts, usual), lambda known: F.transform(starts, lambda i: other(known, i)))

    none = F.array().cast("array<struct<at:int,n:int>>")
    return _let(F.split(run, "[ -]"), lambda groups: _let(sized(groups), lambda sizes: F.aggregate(
        F.sequence(F.lit(1), F.size(sizes)), F.struct(F.lit(1).alias("free"), none.alias("places")),
        lambda held, i: F.when((i >= held.free) & (sizes[i - 1] > 0), F.struct(
            (i + sizes[i - 1]).alias("free"), F.concat(held.places, F.array(F.struct(i.alias("at"), sizes[i - 1].alias("n")))).alias("places"),
        )).otherwise(held),
        lambda held: held.places,
    )))


def _cards(key: str, run: Column) -> Column:
    """The run in pieces, array<struct<rest, kind, pseudonym>>: text, and the card after it; the last piece has none."""

    def pieces(groups: Column, marks: Column, places: Column) -> Column:
        follow = F.zip_with(groups, marks, lambda group, mark: F.concat(group, F.coalesce(mark, F.lit(""))))

        def piece(p: Column, j: Column) -> Column:
            before = F.get(places, j - 1)
            free = F.coalesce(before.at + before.n, F.lit(1))
            rest = F.concat(F.coalesce(F.get(marks, free - 2), F.lit("")), F.array_join(F.slice(follow, free, p.at - free), ""))
            card = F.concat(F.array_join(F.slice(follow, p.at, p.n - 1), ""), F.get(groups, p.at + p.n - 2))
            return F.struct(rest.alias("rest"), F.lit("card").alias("kind"), F.when(p.n > 0, _card(key, card)).alias("pseudonym"))

        end = F.struct((F.size(groups) + 1).alias("at"), F.lit(0).alias("n"))
        return F.transform(F.concat(places, F.array(end)), piece)

    marks = F.regexp_extract_all(run, F.lit("([ -])"), F.lit(1))
    return _let(_card_places(run), lambda places: pieces(F.split(run, "[ -]"), marks, places))


def _card(key: str, m: Column) -> Column:
    digits = _digits(m)
    count = F.length(digits)
    # The first digit names the kind of card and the last is the check digit.
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted_text(key, "card", F.substr(digits, F.lit(2), count - 2)))
    return _refilled(m, F.concat(body, luhn_digit(body)))


def _iban(key: str, m: Column) -> Column:
    country, body = F.substr(m, F.lit(1), F.lit(2)), F.substr(m, F.lit(5))
    fresh = permuted_text(key, "iban", body)
    check = F.lpad((98 - _mod97(F.concat(fresh, country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(body, country, F.substr(m, F.lit(3), F.lit(2)))) == 1
    return F.when(valid, F.concat(country, check, fresh))


def _printed_iban(key: str, m: Column) -> Column:
    """The pseudonym, in groups of four, of the IBAN at the beginning; null where it fails its check."""
    printed = F.regexp_extract(m, f"^({_PRINTED_IBAN})", 1)
    return F.regexp_replace(_iban(key, F.replace(printed, F.lit(" "), F.lit(""))), "(.{4})(?=.)", "$1 ")


def _ip(key: str, m: Column) -> Column:
    part = F.transform(F.split(m, r"\."), lambda octet: octet.cast("long"))
    done = permuted_numbers(key, "ip", part[0] * 256 + part[1], part[2] * 256 + part[3], 65536, 65536)
    return F.concat_ws(".", *[
        F.floor(half / 256).cast("string") if high else (half % 256).cast("string")
        for half in (done.x, done.y) for high in (True, False)
    ])


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (part.cast("int") for part in (F.substr(m, F.lit(1), F.lit(3)), F.substr(m, F.lit(5), F.lit(2)), F.substr(m, F.lit(8))))
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    done = permuted_numbers(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9999)
    fresh = F.floor(done.x / 99)
    fresh_area = F.when(fresh >= 665, fresh + 2).otherwise(fresh + 1)
    return F.when(area.between(1, 899) & (area != 666), F.concat_ws(
        "-", F.lpad(fresh_area.cast("string"), 3, "0"), F.lpad((done.x % 99 + 1).cast("string"), 2, "0"),
        F.lpad((done.y + 1).cast("string"), 4, "0")))


def _phone(key: str, m: Column) -> Column:
    digits = _digits(m)
    # A country code of +1 or none: area and exchange begin with 2 to 9. Others: all digits after the country code.
    ours = F.substr(digits, -F.least(F.length(digits), F.lit(10)))
    area, exchange, line = (part.cast("int") for part in (F.substr(ours, F.lit(1), F.lit(3)), F.substr(ours, F.lit(4), F.lit(3)), F.substr(ours, F.lit(7))))
    done = permuted_numbers(key, "phone", area - 200, (exchange - 200) * 10000 + line, 800, 8_000_000)
    fresh = F.concat(
        (done.x + 200).cast("string"), (F.floor(done.y / 10000) + 200).cast("string"), F.lpad((done.y % 10000).cast("string"), 4, "0"))
    american = (area >= 200) & (exchange >= 200) & (
        (~m.startswith("+") & (F.length(digits) == 10)) | (m.rlike(r"^\+1[^0-9]") & (F.length(digits) == 11)))
    # Without a mark after it, one digit counts as the country code.
    code = F.coalesce(*[F.nullif(F.regexp_extract(m, form, 1), F.lit("")) for form in (r"^\+(\d{1,3}?)(?=[^0-9]|\d{7,}$)", r"^\+(\d)")])
    rest = F.substr(digits, F.length(code) + 1)
    foreign = F.when(m.startswith("+") & F.length(digits).between(8, 15), _refilled(
        m, F.concat(code, permuted_text(key, "phone", rest))))
    return F.when(american, _refilled(m, F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), fresh))).otherwise(foreign)


def _date(key: str, day: Column, otherwise: Column, form: str) -> Column:
    number = F.date_diff(day, F.lit(_FIRST_DAY).cast("date"))
    done = permuted_numbers(key, "date", F.floor(number / _DAYS[1]), number % _DAYS[1], *_DAYS)
    fresh = F.date_add(F.lit(_FIRST_DAY).cast("date"), (done.x * _DAYS[1] + done.y).cast("int"))
    return F.when(number.between(0, _DAYS[0] * _DAYS[1] - 1), F.date_format(fresh, form)).otherwise(otherwise)


def _strict_day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def _slash_date(key: str, m: Column) -> Column:
    part = F.split(m, "/")
    padded = m.rlike(r"^0|/0")
    month_first, day_first = _strict_day(part[2], part[0], part[1]), _strict_day(part[2], part[1], part[0])
    out = _date(key, day_first, F.lit(None), "dd/MM/yyyy")
    out = F.when(month_first.isNotNull(), _date(key, month_first, F.lit(None), "MM/dd/yyyy")).otherwise(out)
    return F.when(padded | (F.length(m) == 10), out).otherwise(F.regexp_replace(F.regexp_replace(out, "^0", ""), "/0", "/"))


def _kind(m: Column) -> Column:
    def whole(name: str) -> Column:
        return m.rlike(f"^(?:{_FORMS[name]})$")

    out = F.when(m.contains("@"), "email")
    for name in ("ip", "iban", "iso_date", "slash_date", "ssn", "phone"):
        out = out.when(whole(name), name)
    return out.when(m.rlike("^[A-Z]"), "printed_iban").otherwise("card")


def _pseudonym(key: str, m: Column, kind: Column) -> Column:
    """The value's pseudonym; null where it fails the check of its kind, and for cards and printed IBANs."""
    local = F.regexp_extract(m, "^[^@]+", 0)
    iso = F.split(m, "-")
    return (
        F.when(kind == "email", F.concat(permuted_text(key, "email", local), F.regexp_extract(m, "@.*$", 0)))
        .when(kind == "ip", _ip(key, m)).when(kind == "iban", _iban(key, m))
        .when(kind == "iso_date", _date(key, _strict_day(iso[0], iso[1], iso[2]), F.lit(None), "yyyy-MM-dd"))
        .when(kind == "slash_date", _slash_date(key, m)).when(kind == "ssn", _ssn(key, m))
        .when(kind == "phone", _phone(key, m))
    )


def pseudonymised(df: DataFrame, key: str, text: str = "text", found: str = "pii") -> DataFrame:
    """`df` with personal data in `text` replaced, and column `found`: array<struct<kind, pseudonym>> in text order.

    Kinds: email (its local part is permuted), ip, iban, card (check digits are kept right),
    ssn, phone and dates of 1800 to 2199. Values that fail the check of their kind stay as they
    are. Cards are looked for at all digit groups of a run, so numbers beside them don't hide them. A pseudonym has the length and layout of its value, but for the zeros of dates like
    5/12/2020. Null texts stay null with a null `found`; empty texts and texts of any length are
    read whole; a column already named `found` is replaced; all other columns, repeated rows and
    an empty table pass as they are.
    """
    value = F.col(text)
    df = df.drop(*[found] * (found in df.columns))
    names = df.columns
    marked = F.when(value.rlike(_HINT), F.regexp_extract_all(value, F.lit(f"({PATTERN})"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__matches", F.when(value.isNotNull(), marked))
    each = F.transform("__matches", lambda m: F.struct(m.alias("value"), _kind(m).alias("kind")))
    df = df.withColumn("__kinds", each)

    def pieces(e: Column) -> Column:
        """What is kept and replaced, in order: array<struct<rest, kind, pseudonym>>."""

        def piece(rest: Column, pseudonym: Column) -> Column:
            kind = F.when(e.kind == "printed_iban", "iban").otherwise(e.kind)
            return F.struct(rest.alias("rest"), kind.alias("kind"), pseudonym.alias("pseudonym"))

        printed = e.kind == "printed_iban"
        own = F.when(printed, _printed_iban(key, e.value)).otherwise(_pseudonym(key, e.value, e.kind))

        def around(own: Column) -> Column:
            # Where a printed IBAN fails its check, a card may follow its first group.
            after = F.when(printed & own.isNull(), F.lit(5)).when(printed, F.length(own)).otherwise(F.lit(0))
            run = F.substr(e.value, after + 1)
            kept = F.when(printed & own.isNull(), F.substr(e.value, F.lit(1), F.lit(5))).otherwise(F.lit(""))
            head = F.when(e.kind == "card", F.array().cast(_PIECES)).otherwise(F.array(piece(kept, own)).cast(_PIECES))
            return F.when(((e.kind == "card") | printed) & (run != ""), F.concat(head, _cards(key, run).cast(_PIECES))).otherwise(head)

        return _let(own, around)

    done = F.transform("__kinds", lambda e: F.struct(e.value.alias("value"), pieces(e).alias("pieces")))
    # Written out, so that the pseudonyms are worked out once for both columns below.
    df = df.withColumn("__done", F.when(F.size("__matches") > 0, done))
    parts = F.split(value, PATTERN, -1)
    woven = F.concat(
        F.array_join(F.zip_with(
            F.slice(parts, F.lit(1), F.size("__done")), F.col("__done"),
            lambda part, e: F.concat(part, F.when(F.exists(e.pieces, lambda p: p.pseudonym.isNotNull()), F.array_join(
                F.transform(e.pieces, lambda p: F.concat(p.rest, F.coalesce(p.pseudonym, F.lit("")))), "")).otherwise(e.value))), ""),
        F.element_at(parts, -1),
    )
    listed = F.flatten(F.transform("__done", lambda e: F.transform(
        F.filter(e.pieces, lambda p: p.pseudonym.isNotNull()), lambda p: F.struct(p.kind, p.pseudonym))))
    none = F.array().cast("array<struct<kind:string,pseudonym:string>>")
    return df.select(
        *[(F.when(F.size("__done") > 0, woven).otherwise(value)).alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.when(value.isNotNull(), F.coalesce(listed, none)).alias(found),
    )
