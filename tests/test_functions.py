import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from stammwerk.functions import convert, masking, names, validators


@pytest.fixture(scope="module")
def checks(spark):
    validators.register(spark)
    return lambda text: spark.sql(f"SELECT {text} AS r").collect()[0].r


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("iban_reason('DE89 3704-0044 0532 0130 00')", ""), ("iban_reason('DE88370400440532013000')", "check digits"), ("iban_reason('XX88370400440532013000')", "country"), ("iban_reason('DE8937040044053201300')", "length"), ("iban_reason('D')", "structure"), ("iban_reason(NULL)", "missing"),
        ("iban_country('at611904300234573201')", "AT"), ("iban_bank_identifier('DE89370400440532013000')", "37040044"), ("iban_bank_identifier('GB29NWBK60161331926819')", None), ("bic_reason('DEUTDEFF500')", ""), ("bic_reason('DEUTDEFF5')", "length"), ("bic_reason('1EUTDEFF')", "structure"), ("bic_reason('')", "missing"),
        ("vat_id_reason('DE', 'DE136695976')", ""), ("vat_id_reason('DE', '136695977')", "check digit"), ("vat_id_reason('DE', 'ATU12345678')", ""), ("vat_id_reason('NL', 'NL004495445B01')", ""), ("vat_id_reason('IT', 'IT00743110157')", ""), ("vat_id_reason('IT', 'IT00743110158')", "check digit"), ("vat_id_reason(NULL, '12')", "no country"), ("vat_id_reason('US', '12')", "no pattern for country"), ("vat_id_reason('GR', '123456789')", ""), ("vat_id_reason('DE', NULL)", "missing"), ("vat_id_country('GB999999999')", "XI"), ("vat_id_country('123')", None),
        ("postal_code_reason('DE', '1234')", "structure"), ("postal_code_reason('nl', ' 1234 ab ')", ""), ("postal_code_reason('ZZ', '?')", ""), ("postal_code_reason(NULL, '1')", "no country"), ("postal_code_reason('DE', ' ')", "missing"), ("postal_code_known('PL')", True), ("postal_code_known(NULL)", False),
        ("is_po_box('Post-fach 12')", True), ("is_po_box('Hauptstr. 1')", False), ("is_po_box(NULL)", False), ("has_digit('a1')", True), ("has_digit('')", False), ("is_placeholder_text('n/a')", True), ("is_placeholder_text('----')", True), ("is_placeholder_text('0')", False), ("is_placeholder_text('Meier')", False), ("is_placeholder_text(NULL)", False),
        ("gtin_reason('4006381333931')", ""), ("gtin_reason('400638133393-1')", ""), ("gtin_reason('4006381333930')", "check digit"), ("gtin_reason('40x')", "not digits"), ("gtin_reason('40')", "length"),
    ],
)
def test_validators(checks, text, expected):
    assert checks(text) == expected


def test_strict_words(spark):
    validators.register(spark, strict_tokens=True)
    assert spark.sql("SELECT is_po_box('Kampsfeld 3') a, is_po_box('PSF 12') b, is_po_box('P.O. Box 1') c, is_placeholder_text('Ωμέγα') d").collect()[0] == (False, True, True, False)
    validators.register(spark)
    assert spark.sql("SELECT is_po_box('Kampsfeld 3') a").collect()[0].a is True


def test_conversions(spark):
    def one(f, *values):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        return [r[0] for r in df.select(f(F.col("v"))).collect()]

    assert one(lambda c: convert.conv_text(c), " a ", "  ", None, "") == ["a", None, None, None]
    assert one(lambda c: convert.conv_alpha(c, 6), "4711", "ABC", "1234567", "", None, "12\n") == ["004711", "ABC", "1234567", None, None, "12\n"]
    assert one(convert.conv_date, "20240115", "15.1.2024", "2024-01-15", "2024/1/15", "15/1/2024", "00000000", "99991231", "20240230", "2024115", "x", None) == [date(2024, 1, 15)] * 5 + [None, date(9999, 12, 31), None, None, None, None]
    assert one(convert.conv_time, "143025", "14:30:25", "246000", None) == ["14:30:25", "14:30:25", None, None]
    assert one(lambda c: convert.conv_amount(c, True), "1.234,56-", "-1,5", "+ 12", "12d", "", None, ",") == [-1234.56, -1.5, 12.0, None, None, None, None]
    assert one(lambda c: convert.conv_amount(c, False), "1,234.56", "1.5-", "k.A.") == [1234.56, -1.5, None]
    df = spark.createDataFrame([("1.234,5", "1,234.5"), ("2,0", "3.1"), (None, "")], "a string, b string")
    assert tuple(convert.comma_votes(df, ["a", "b"]).collect()[0]) == (True, False)
    typed = spark.createDataFrame([(1.0, 2.5, True, date(2024, 1, 2), 3), (None, None, None, None, None)], "a double, b double, c boolean, d date, e int")
    assert [tuple(r) for r in convert.typed_to_text(typed).collect()] == [("1", "2.5", "X", "20240102", "3"), (None,) * 5]


def test_names(spark):
    df = spark.createDataFrame([("Müller und Sohn G.m.b.H.",), ("GmbH & Co. KG",), ("",), (None,), ("Société Ñandú S.A.",)], "v string")
    assert [r[0] for r in df.select(names.norm_name(F.col("v"))).collect()] == ["MUELLER SOHN", "GMBH CO KG", "", "", "SOCIETE NANDU"]
    streets = spark.createDataFrame([("Hauptstr. 1",), ("Haupt Str 1",), ("Hauptstraße 1",), (None,)], "v string")
    assert len({r[0] for r in streets.select(names.norm_street(F.col("v"))).collect()}) == 2
    keys = names.block_keys(F.col("n"), F.col("l"), F.col("p"), F.col("o"))
    row = spark.createDataFrame([("Beta Alpha AG", "de", "12 345", "Köln"), ("", None, None, None)], "n string, l string, p string, o string").select(*(c.alias(k) for k, c in keys.items())).collect()
    assert row[0].asDict() == {"country_postcode": "DE|12345", "postcode": "12345", "name_prefix": "BETA", "name_sorted": "ALPBET", "country_city": "DE|KOELN"} and row[1].country_postcode is None and row[1].postcode is None


def test_token_sort_ratio():
    def slow(a, b):
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        return table[-1][-1]

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(0, 90))) for _ in range(2))
        assert names._common_length(a, b) == slow(a, b)
    assert names.token_sort_ratio("B A", "A B") == 100 and names.token_sort_ratio("", "A") == 0 and names.token_sort_ratio(None, None) == 0


def test_masking(spark, checks):
    df = spark.createDataFrame([("DE136695976", "DE89370400440532013000", "Meier", "12345", "", None)], "v string, i string, n string, p string, e string, z string")
    out = df.select(*(masking.mask(F.col(c), m, "salt").alias(c) for c, m in (("v", "vat"), ("i", "iban"), ("n", "person"), ("p", "postcode"), ("e", "company"), ("z", "street")))).collect()[0]
    assert checks(f"vat_id_reason('DE', '{out.v}')") == "" and checks(f"iban_reason('{out.i}')") == "" and out.v != "DE136695976"
    assert out.n.startswith("Person ") and out.p.isdigit() and len(out.p) == 5 and out.e == "" and out.z is None
    assert df.select(masking.mask(F.col("n"), "person", "salt")).collect() == df.select(masking.mask(F.col("n"), "person", "salt")).collect()
    assert df.select(masking.redact(F.lit("a@b.de IBAN DE89370400440532013000, 123456789012"))).collect()[0][0] == "<e-mail> IBAN <iban>, <number>"


def test_digest_is_hmac(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("M\u00fcller",), ("",), (None,)], "v string")
    for key in ("pepper", "k" * 100):
        got = [r[0] for r in df.select(masking.digest(F.col("v"), key)).collect()]
        assert got == [hmac.new(key.encode(), v.encode(), hashlib.sha256).hexdigest() for v in ("M\u00fcller", "")] + [None]
