"""Check digits of identifiers: each scheme once over Python strings (Arrow passes), the numeric ones also as Columns."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, letters and tables that the identifiers' issuers define.
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
ACN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 1)
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
MEDICARE_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9)
PESEL_WEIGHTS = (1, 3, 7, 9, 1, 3, 7, 9, 1, 3)
RRN_WEIGHTS = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
NHS_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2)
NRIC_WEIGHTS = (2, 7, 6, 5, 4, 3, 2)
NRIC_LETTERS = {"S": "JZIHGFEDCBA", "T": "JZIHGFEDCBA", "F": "XWUTRQPNMLK", "G": "XWUTRQPNMLK", "M": "KLJNPQRTUWX"}
NRIC_OFFSET = {"S": 0, "F": 0, "T": 4, "G": 4, "M": 3}
NIF_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"
HETU_CHECK = "0123456789ABCDEFHJKLMNPRSTUVWXY"
FISCAL_ODD = dict(zip("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)))
VERHOEFF_P = ((0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7), (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8))
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
MBI_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ") - frozenset("SLOIBZ")


def _verhoeff_d(a: int, b: int) -> int:
    """The product of the dihedral group of ten elements."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def digits(s: str, n: int) -> list[int] | None:
    return [int(c) for c in s] if len(s) == n and s.isascii() and s.isdigit() else None


def _weighted(s: str, weights: tuple[int, ...]) -> int:
    return sum(int(c) * w for c, w in zip(s, weights))


def luhn(s: str) -> bool:
    if not (s.isascii() and s.isdigit()):
        return False
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def iban(s: str) -> bool:
    return 5 <= len(s) <= 34 and all(c in FISCAL_ODD for c in s) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def isin(s: str) -> bool:
    return len(s) == 12 and all(c in FISCAL_ODD for c in s) and luhn("".join(str(int(c, 36)) for c in s))


def base58check(s: str) -> bool:
    n = 0
    for c in s:
        at = BASE58.find(c)
        if at < 0:
            return False
        n = n * 58 + at
    raw = b"\0" * (len(s) - len(s.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return len(raw) >= 5 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def au_abn(s: str) -> bool:
    return bool(d := digits(s, 11)) and (sum(x * w for x, w in zip(d, ABN_WEIGHTS)) - ABN_WEIGHTS[0]) % 89 == 0


def au_acn(s: str) -> bool:
    return digits(s, 9) is not None and -_weighted(s, ACN_WEIGHTS) % 10 == int(s[8])


def au_tfn(s: str) -> bool:
    return digits(s, 9) is not None and _weighted(s, TFN_WEIGHTS) % 11 == 0


def au_medicare(s: str) -> bool:
    s = s[:10]
    return digits(s, 10) is not None and "2" <= s[0] <= "6" and _weighted(s, MEDICARE_WEIGHTS) % 10 == int(s[8])


def in_pan(s: str) -> bool:
    return len(s) == 10 and s.isascii() and s[:5].isalpha() and s[:5].isupper() and s[5:9].isdigit() and s[9].isalpha() and s[9].isupper()


def in_aadhaar(s: str) -> bool:
    if digits(s, 12) is None or s[0] in "01":
        return False
    return reduce(lambda c, x: _verhoeff_d(c, VERHOEFF_P[x[0] % 8][int(x[1])]), enumerate(reversed(s)), 0) == 0


def it_fiscal_code(s: str) -> bool:
    if len(s) != 16 or any(c not in FISCAL_ODD for c in s) or not s[15].isalpha():
        return False
    even = lambda c: int(c) if c.isdigit() else ord(c) - 65
    return sum(even(c) if i % 2 else FISCAL_ODD[c] for i, c in enumerate(s[:15])) % 26 == ord(s[15]) - 65


def it_vat(s: str) -> bool:
    return digits(s, 11) is not None and luhn(s)


def it_driver_license(s: str) -> bool:
    return not (len(s) == 10 and all(c in "0123456789ABCDEF" for c in s))


def es_nif(s: str) -> bool:
    return len(s) == 9 and digits(s[:8], 8) is not None and s[8] == NIF_LETTERS[int(s[:8]) % 23]


def es_nie(s: str) -> bool:
    return len(s) == 9 and s[0] in "XYZ" and es_nif(str("XYZ".index(s[0])) + s[1:])


def pl_pesel(s: str) -> bool:
    return digits(s, 11) is not None and -_weighted(s, PESEL_WEIGHTS) % 10 == int(s[10])


def sg_nric(s: str) -> bool:
    if len(s) != 9 or s[0] not in NRIC_LETTERS or digits(s[1:8], 7) is None:
        return False
    return s[8] == NRIC_LETTERS[s[0]][(_weighted(s[1:8], NRIC_WEIGHTS) + NRIC_OFFSET[s[0]]) % 11]


def fi_hetu(s: str) -> bool:
    return len(s) == 11 and digits(s[:6], 6) is not None and s[6] in "+-ABCDEFUVWXY" and digits(s[7:10], 3) is not None and s[10] == HETU_CHECK[int(s[:6] + s[7:10]) % 31]


def kr_rrn(s: str) -> bool:
    return digits(s, 13) is not None and (11 - _weighted(s, RRN_WEIGHTS) % 11) % 10 == int(s[12])


def de_steuer_id(s: str) -> bool:
    if digits(s, 11) is None:
        return False
    counts = [s[:10].count(c) for c in set(s[:10])]
    if max(counts) >= 4 or sum(n >= 2 for n in counts) != 1:
        return False
    product = reduce(lambda p, c: 2 * ((int(c) + p) % 10 or 10) % 11, s[:10], 10)
    return (11 - product) % 10 == int(s[10])


def uk_nhs(s: str) -> bool:
    if digits(s, 10) is None:
        return False
    check = -_weighted(s, NHS_WEIGHTS) % 11
    return check == int(s[9])


def uk_nino(s: str) -> bool:
    return len(s) == 9 and s[0] not in "DFIQUV" and s[1] not in "DFIOQUV" and s[:2] not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ")


def us_npi(s: str) -> bool:
    return digits(s, 10) is not None and luhn("80840" + s)


def us_dea(s: str) -> bool:
    if len(s) != 9 or not ("A" <= s[0] <= "Z") or not ("A" <= s[1] <= "Z" or s[1] == "9") or digits(s[2:], 7) is None:
        return False
    return _weighted(s[2:8], (1, 2, 1, 2, 1, 2)) % 10 == int(s[8])


def us_mbi(s: str) -> bool:
    kinds = "NLXNLXNLLNN"
    ok = {"N": lambda c: c in "0123456789", "L": lambda c: c in MBI_LETTERS, "X": lambda c: c in "0123456789" or c in MBI_LETTERS}
    return len(s) == 11 and s[0] != "0" and all(ok[k](c) for k, c in zip(kinds, s))


def us_ssn(s: str) -> bool:
    return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"


def us_itin(s: str) -> bool:
    n = int(s[3:5])
    return 70 <= n <= 99 and n not in (89, 93)


# -- Columns ---------------------------------------------------------------------------------------------------------


def weighted_sum(s: Column, weights: tuple[int, ...], start: int = 1) -> Column:
    """Sum of digits times weights, unrolled: stays in generated code."""
    return reduce(lambda a, b: a + b, [F.substring(s, start + i, 1).cast("int") * w for i, w in enumerate(weights)])


def _is_digits(s: Column, n: int) -> Column:
    return s.rlike(f"^[0-9]{{{n}}}\\z")


def luhn_col(s: Column) -> Column:
    return F.call_function("luhn_check", s)


def au_abn_col(s: Column) -> Column:
    return _is_digits(s, 11) & ((weighted_sum(s, ABN_WEIGHTS) - ABN_WEIGHTS[0]) % 89 == 0)


def au_acn_col(s: Column) -> Column:
    return _is_digits(s, 9) & ((10 - weighted_sum(s, ACN_WEIGHTS) % 10) % 10 == F.substring(s, 9, 1).cast("int"))


def au_tfn_col(s: Column) -> Column:
    return _is_digits(s, 9) & (weighted_sum(s, TFN_WEIGHTS) % 11 == 0)


def pl_pesel_col(s: Column) -> Column:
    return _is_digits(s, 11) & ((10 - weighted_sum(s, PESEL_WEIGHTS) % 10) % 10 == F.substring(s, 11, 1).cast("int"))


def uk_nhs_col(s: Column) -> Column:
    return _is_digits(s, 10) & ((11 - weighted_sum(s, NHS_WEIGHTS) % 11) % 11 == F.substring(s, 10, 1).cast("int"))


def us_npi_col(s: Column) -> Column:
    return _is_digits(s, 10) & F.call_function("luhn_check", F.concat(F.lit("80840"), s))


def kr_rrn_col(s: Column) -> Column:
    return _is_digits(s, 13) & ((11 - weighted_sum(s, RRN_WEIGHTS) % 11) % 10 == F.substring(s, 13, 1).cast("int"))


def es_nif_col(s: Column) -> Column:
    return s.rlike(r"^[0-9]{8}[A-Z]\z") & (F.substring(s, 9, 1) == F.substring(F.lit(NIF_LETTERS), (F.substring(s, 1, 8).cast("int") % 23 + 1), F.lit(1)))


def iban_col(s: Column) -> Column:
    """MOD 97 over the rearranged text, folded three base-36 digits at a time: no big numbers."""
    moved = F.concat(F.substring(s, 5, 30), F.substring(s, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    fold = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).when(c.rlike("[0-9]"), (a * 10 + value(c)) % 97).otherwise((a * 100 + value(c)) % 97))
    return s.rlike(r"^[A-Z0-9]{5,34}\z") & (fold == 1)
