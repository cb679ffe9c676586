import datetime
import hashlib
import itertools
import re

import pytest
from fixtures import awkward_texts, by_id, documents
from pyspark.sql import functions as F

from merchantry.llm import pii

KEY = "k1"


def hashed(*parts):
    return int(hashlib.sha256("|".join([KEY, *map(str, parts), KEY]).encode()).hexdigest()[:12], 16)


def numbers(kind, x, y, mx, my):
    for r in range(1, pii.ROUNDS + 1):
        x, y, mx, my = y, (x + hashed(kind, r, y) % mx) % mx, my, mx
    return x, y


def text_of(kind, text):
    half = len(text) // 2
    x, y = text[:half], text[half:]

    def moved(c, i, r, other):
        for first, size in (("0", 10), ("a", 26), ("A", 26)):
            if re.match({"0": "[0-9]", "a": "[a-z]", "A": "[A-Z]"}[first], c):
                return chr((ord(c) - ord(first) + hashed(kind, r, i, other) % size) % size + ord(first))
        return c

    for r in range(1, pii.ROUNDS + 1):
        x, y = y, "".join(moved(c, i, r, y) for i, c in enumerate(x))
    return x + y


def luhn(digits):
    total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
    return str(-total % 10)


def out_of(spark, *texts, key=KEY):
    rows = by_id(pii.pseudonymised(documents(spark, list(texts)), key))
    return [rows[i] for i in range(len(texts))]


def test_each_kind_against_plain_python(spark):
    rows = out_of(
        spark, "to bob.Smith21@mail0.example.com!", "card 4562298812442145.", "at 78.181.149.139 and 1.2.3.4", "+1 (935) 555-6637",
        "born 1980-02-29", "1/2/2003 31/12/1999 12/31/1999", "ssn 667-45-6789", "4562 2988 1244 2145", "GB82WEST12345698765432",
    )
    local = "bob.Smith21"
    assert rows[0]["text"] == f"to {text_of('email', local)}@mail0.example.com!"
    body = "4" + text_of("card", "56229881244214")
    assert rows[1]["text"] == f"card {body}{luhn(body)}."
    assert rows[7]["text"].replace(" ", "") == body + luhn(body) and re.fullmatch(r"(\d{4} ){3}\d{4}", rows[7]["text"])

    def ip(a, b, c, d):
        x, y = numbers("ip", a * 256 + b, c * 256 + d, 65536, 65536)
        return f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"

    assert rows[2]["text"] == f"at {ip(78, 181, 149, 139)} and {ip(1, 2, 3, 4)}"
    x, y = numbers("phone", 735, 355 * 10000 + 6637, 800, 8_000_000)
    assert rows[3]["text"] == f"+1 ({x + 200}) {y // 10000 + 200}-{y % 10000:04d}"

    def day(*date):
        n = (datetime.date(*date) - datetime.date(1800, 1, 1)).days
        x, y = numbers("date", n // 773, n % 773, 189, 773)
        return datetime.date(1800, 1, 1) + datetime.timedelta(x * 773 + y)

    assert rows[4]["text"] == f"born {day(1980, 2, 29):%Y-%m-%d}"
    one = day(2003, 1, 2)
    assert rows[5]["text"] == f"{one.month}/{one.day}/{one.year} {day(1999, 12, 31):%d/%m/%Y} {day(1999, 12, 31):%m/%d/%Y}"
    x, y = numbers("ssn", 665 * 99 + 44, 6788, 898 * 99, 9999)
    assert rows[6]["text"] == f"ssn {x // 99 + (2 if x // 99 >= 665 else 1):03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    iban = rows[8]["text"]
    moved = iban[4:] + iban[:4]
    assert re.fullmatch(r"GB\d{2}[A-Z]{4}\d{14}", iban) and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert [r["pii"][0]["kind"] for r in rows] == ["email", "card", "ip", "phone", "iso_date", "slash_date", "ssn", "card", "iban"]


def test_values_that_fail_their_check_stay(spark):
    texts = [
        "4562298812442146", "999.1.1.1", "1.2.3.4.5", "2020-13-45", "1492-01-01", "000-12-3456", "GB82WEST12345698765433",
        "v1.2", "12345", "99/99/2020", "a@b", "12345678901234567890123",
    ]
    for text, row in zip(texts, out_of(spark, *texts)):
        assert row["text"] == text and row["pii"] == [], text


def test_numbers_beside_a_value_do_not_hide_it(spark):
    card, phone, foreign = "4111 1111 1111 1111", "+1 415 555 2671", "+44 20 7946 0958"
    amex, lone = "3782 822463 10005", "4111111111111111"
    around = [
        (card, "Card {} 12/25"), (card, "Card {} 123"), (card, "{} 12 25 123"), (card, "12 {}"), (card, "7 1234 {}, 5678"), (card, "Card {} 12a"),
        (lone, "Order 12 {}."), (lone, "12-{} 99"), (amex, "{} 1234"), (amex, "9999 {}"), ("4111-1111-1111-1111", "12 {} 345"),
        (phone, "{} 12 times"), ("+14155552671", "{} 12"), (phone, "{} 4111 1111 1111 1112"), ("415 555 2671", "1234 {}"),
        (foreign, "{} 4111 1111 1111 1112"), ("2020-01-02", "12 34 567 {}"), ("123-45-6789", "12 345 {}"), ("10.0.0.1", "1234 5678 9012 3 {}"),
        ("12/31/1999", "1234 5678 9012 3 {}"), ("12@x.org", "1234 5678 9012 3 {}"),
    ]
    alone = out_of(spark, *[value for value, _ in around])
    for (value, form), one, row in zip(around, alone, out_of(spark, *[form.format(value) for value, form in around])):
        assert one["pii"] and one["text"] != value, value
        assert row["text"] == form.format(one["text"]) and row["pii"] == one["pii"], (form, row)
    two = out_of(spark, f"{card} {lone} 12 {card}", f"+442079460958 12 {card}", "1 2 3 4 " * 5_000)
    assert [p["kind"] for p in two[0]["pii"]] == ["card"] * 3 and len({p["pseudonym"].replace(" ", "") for p in two[0]["pii"]}) == 1
    assert [p["kind"] for p in two[1]["pii"]] == ["phone", "card"] and "2079460958" not in two[1]["text"]
    assert two[2]["text"] == "1 2 3 4 " * 5_000


def test_printed_ibans_and_timestamps(spark):
    card, date = "4111 1111 1111 1111", "2020-01-02"
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "ES9121000418450200051332", "NO9386011117947"]
    alone = [r["text"] for r in out_of(spark, *ibans, card, date)]
    printed = [" ".join(iban[i:i + 4] for i in range(0, len(iban), 4)) for iban in [*ibans, *alone[:4]]]
    assert all(a != b for a, b in zip(ibans, alone))
    rows = out_of(
        spark, *[f"to {p} 2024 IS" for p in printed[:4]], f"{printed[3]} {card}", f"BE12 {card}", f"DE12 {card} 25", f"at {date}T10:00:00Z",
        "DE88 3704 0044 0532 0130 00", f"{date}Tx")
    for i in range(4):
        assert rows[i]["text"] == f"to {printed[4 + i]} 2024 IS" and [p["kind"] for p in rows[i]["pii"]] == ["iban"]
    assert rows[4]["text"] == f"{printed[7]} {alone[4]}" and [p["kind"] for p in rows[4]["pii"]] == ["iban", "card"]
    assert rows[5]["text"] == f"BE12 {alone[4]}" and rows[6]["text"] == f"DE12 {alone[4]} 25"
    assert [p["kind"] for p in rows[5]["pii"] + rows[6]["pii"]] == ["card", "card"]
    assert rows[7]["text"] == f"at {alone[5]}T10:00:00Z" and rows[9]["text"] == f"{date}Tx"
    assert "DE88" in rows[8]["text"]


def test_equal_values_stay_linked_and_keys_differ(spark):
    rows = out_of(spark, "x 4562298812442145 y", "4562298812442145", "+44 20 7946 0958")
    assert rows[0]["pii"] == rows[1]["pii"]
    other = out_of(spark, "x 4562298812442145 y", key="k2")
    assert other[0]["pii"] != rows[0]["pii"]
    assert re.fullmatch(r"\+44 \d{2} \d{4} \d{4}", rows[2]["text"])


@pytest.mark.parametrize("sizes", [(7, 11), (1, 5), (30, 2)])
def test_numbers_are_permuted(spark, sizes):
    pairs = list(itertools.product(range(sizes[0]), range(sizes[1])))
    df = spark.createDataFrame(pairs, "x long, y long")
    out = df.select("x", "y", pii.permuted_numbers(KEY, "t", F.col("x"), F.col("y"), *sizes).alias("p")).collect()
    assert sorted((r["p"]["x"], r["p"]["y"]) for r in out) == pairs
    assert all((r["p"]["x"], r["p"]["y"]) == numbers("t", r["x"], r["y"], *sizes) for r in out)


def test_texts_are_permuted(spark):
    texts = ["".join(t) for t in itertools.product("0123456789", "0123456789", "-", "abcdefghijklmnopqrstuvwxyz")]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = [r["p"] for r in df.select(pii.permuted_text(KEY, "t", F.col("t")).alias("p")).collect()]
    assert sorted(out) == sorted(texts)


def test_awkward_texts_and_columns(spark):
    texts = awkward_texts() + ["1.2.3.4", "a 1.2.3.4", "1.2.3.4 " * 3000, "9" * 20_000, "a." * 20_000 + "@", "x@" + "a." * 5_000 + "com"]
    rows = by_id(pii.pseudonymised(documents(spark, texts).selectExpr("*", "'old' AS pii"), KEY))
    for i, text in enumerate(texts[:-6]):
        assert rows[i]["text"] == text
        assert rows[i]["pii"] == (None if text is None else [])
    assert rows[len(texts) - 4]["pii"][0] == rows[len(texts) - 6]["pii"][0] and len(rows[len(texts) - 4]["pii"]) == 3000
    assert pii.pseudonymised(documents(spark, []), KEY).count() == 0
    assert pii.pseudonymised(documents(spark, ["x"]), KEY).columns == ["doc_id", "text", "lang", "source", "n_chars", "pii"]
