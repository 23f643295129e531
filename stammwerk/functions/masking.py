"""Deterministic pseudonyms and redaction. A pseudonym comes from HMAC-SHA256 of the value under the project's key, built from two SQL digests."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that redaction replaces, in order (fixed values).
REDACTIONS = [("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", "<iban>"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<e-mail>"), (r"\b[A-Z]{2}[0-9]{8,12}\b", "<vat>"), ("[0-9]{9,}", "<number>")]


def redact(c: Column) -> Column:
    for pattern, name in REDACTIONS:
        c = F.regexp_replace(c, pattern, name)
    return c


def digest(c: Column, salt: str) -> Column:
    """HMAC-SHA256 (RFC 2104) of a text under a key, in hex."""
    key = salt.encode("utf-8")
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(k ^ pad for k in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(c, "UTF-8")), 256))), 256)


def _number(c: Column, salt: str, bits: int = 15) -> Column:
    """A whole number from the digest: its first hex digits."""
    return F.conv(F.substring(digest(c, salt), 1, bits), 16, 10).cast("bigint")


def _code(c: Column, salt: str, length: int = 8) -> Column:
    return F.upper(F.substring(digest(c, salt), 1, length))


def shape_preserving(c: Column, salt: str) -> Column:
    """Every digit becomes a digit and every letter a letter, by position and digest; other characters stay."""
    places = F.sequence(F.lit(1), F.length(c))

    def one(i: Column, hashed: Column) -> Column:
        ch = F.substring(c, i, F.lit(1))
        n = F.conv(F.substring(hashed, F.pmod(i - 1, F.lit(62)) + 1, F.lit(3)), 16, 10).cast("int")
        return F.when(ch.rlike("[0-9]"), F.substring(F.lit("0123456789"), n % 10 + 1, F.lit(1))).when(ch.rlike("[A-Z]"), F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), n % 26 + 1, F.lit(1))).when(ch.rlike("[a-z]"), F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), n % 26 + 1, F.lit(1))).otherwise(ch)

    masked = F.transform(F.array(digest(c, salt)), lambda hashed: F.array_join(F.transform(places, lambda i: one(i, hashed)), ""))  # one digest a value
    return F.when(c == "", c).otherwise(masked[0])


def _mod97_check(bban: Column, country: Column) -> Column:
    text = F.concat(bban, country, F.lit("00"))
    values = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.substring(text, i, F.lit(1))) - 1)
    rest = F.aggregate(values, F.lit(0), lambda r, d: F.when(d < 10, (r * 10 + d) % 97).otherwise((r * 100 + d) % 97))
    return F.lpad((F.lit(98) - rest).cast("string"), 2, "0")


def mask(c: Column, method: str, salt: str) -> Column:
    """Null stays null, blank stays blank. Methods: company, person, street, city, postcode, phone, email, tax, vat, account, iban, generic."""
    value = F.trim(c)
    seven = F.lpad(F.pmod(_number(value, salt), F.lit(10_000_000)).cast("string"), 7, "0")
    if method == "vat":  # German numbers get a right check digit again, all others keep their shape
        eight = F.lpad(F.pmod(_number(value, salt), F.lit(100_000_000)).cast("string"), 8, "0")
        product = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.substring(eight, i, F.lit(1)).cast("int")), F.lit(10), lambda p, d: F.when((d + p) % 10 == 0, F.lit(20)).otherwise(2 * ((d + p) % 10)) % 11)
        masked = F.when(F.startswith(value, F.lit("DE")), F.concat(F.lit("DE"), eight, ((F.lit(11) - product) % 10).cast("string"))).otherwise(F.concat(F.substring(value, 1, 2), shape_preserving(F.substr(value, F.lit(3)), salt)))
    elif method == "iban":  # the bank key is masked as it would be alone, and the check digits are right
        compact = F.upper(F.regexp_replace(value, r"[\s-]", ""))
        country, bank, account = F.substring(compact, 1, 2), F.substring(compact, 5, 8), F.substr(compact, F.lit(13))
        bban = F.concat(shape_preserving(bank, salt), shape_preserving(account, salt))
        masked = F.concat(country, _mod97_check(bban, country), bban)
    elif method in ("postcode", "phone", "tax", "account"):
        masked = shape_preserving(value, salt)
    else:
        pattern = {"company": "Company ", "person": "Person ", "street": "Street ", "city": "City ", "generic": "X"}.get(method)
        masked = F.concat(F.lit("user"), seven, F.lit("@example.com")) if method == "email" else F.concat(F.lit(pattern), _code(value, salt))
    return F.when(value == "", c).otherwise(masked)
