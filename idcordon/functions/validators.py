"""Identifier checks as SQL predicates: null in, null out; else true or false."""

from __future__ import annotations

from idcordon.functions.sql import array, choose, let, lit, pattern
from idcordon.functions.text import ascii_digits, drop_chars, strip

# Letters of a tax number that tell the kind of its holder.
PAN_STATUS = "PCHFATBLJG"

# State and territory codes of driving licences.
LICENCE_STATES = (
    "AN", "AP", "AR", "AS", "BR", "CH", "CG", "DD", "DL", "DN",
    "GA", "GJ", "HP", "HR", "JH", "JK", "KA", "KL", "LA", "LD",
    "MH", "ML", "MN", "MP", "MZ", "NL", "OD", "OR", "PB", "PY",
    "RJ", "SK", "TN", "TR", "TS", "UK", "UP", "WB",
)

# State codes 01-38, 97 and 99 of a goods-and-services tax number.
GSTIN_FORMAT = (
    rf"\A(?:0[1-9]|[12][0-9]|3[0-8]|97|99)[A-Z]{{3}}[{PAN_STATUS}][A-Z][0-9]{{4}}[A-Z]"
    r"[1-9A-Z]Z[0-9A-Z]\z"
)
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _dihedral(a: int, b: int) -> int:
    """Product in the symmetry group of the pentagon: 0-4 rotations, 5-9 reflections."""
    turn = (a % 5 + b) % 5 if a < 5 else (a % 5 - b) % 5
    return turn if (a < 5) == (b < 5) else turn + 5


def _permutations() -> list[list[int]]:
    """The eight powers of the digit permutation of Verhoeff's scheme."""
    base = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    rows = [list(range(10))]
    while len(rows) < 8:
        rows.append([base[d] for d in rows[-1]])
    return rows


PRODUCT = [_dihedral(a, b) for a in range(10) for b in range(10)]
PERMUTE = [d for row in _permutations() for d in row]
INVERSE = [next(b for b in range(10) if _dihedral(a, b) == 0) for a in range(10)]

# Quotient plus remainder by 36 of a digit times 1, then of a digit times 2.
_WEIGHED = [d * f // 36 + d * f % 36 for f in (1, 2) for d in range(36)]


def _verhoeff(digits: str, length: int, shift: int) -> str:
    """Fold ``length`` ASCII digits from the right; position counts from ``shift``."""
    digit = f"ascii(substring({digits}, {length} - i, 1)) - 48"
    permuted = f"get({array(PERMUTE)}, (i + {shift}) % 8 * 10 + {digit})"
    return (
        f"aggregate(sequence(0, {length - 1}), 0, "
        f"(c, i) -> get({array(PRODUCT)}, c * 10 + {permuted}))"
    )


def _checked(prepared: str, var: str, shape: str, test: str) -> str:
    """``test`` for values of the right shape, false for others, null for null."""
    return let(
        prepared,
        var,
        choose((f"{var} IS NULL", "NULL"), (f"rlike({var}, {pattern(shape)})", test), otherwise="false"),
    )


def aadhaar(value: str) -> str:
    digits = ascii_digits(drop_chars(value, "-"))
    return _checked(digits, "d", r"\A[2-9][0-9]{11}\z", f"{_verhoeff('d', 12, 0)} = 0")


def aadhaar_check_digit(value: str) -> str:
    """The twelfth digit for eleven digits; null for anything else."""
    digits = ascii_digits(drop_chars(value, "-"))
    made = f"cast(get({array(INVERSE)}, {_verhoeff('d', 11, 1)}) AS string)"
    return let(digits, "d", choose((rf"rlike(d, r'\A[0-9]{{11}}\z')", made)))


def card(value: str) -> str:
    digits = ascii_digits(drop_chars(value, "-"))
    return _checked(digits, "d", r"\A[0-9]{13,19}\z", "luhn_check(d)")


def gstin(value: str) -> str:
    place = f"i % 2 * 36 + instr('{BASE36}', substring(g, i + 1, 1)) - 1"
    total = f"aggregate(sequence(0, 13), 0, (t, i) -> t + get({array(_WEIGHED)}, {place}))"
    expected = f"substring('{BASE36}', (36 - {total} % 36) % 36 + 1, 1)"
    return _checked(
        f"upper({strip(value)})", "g", GSTIN_FORMAT, f"substring(g, 15, 1) = {expected}"
    )


def _shaped(prepared: str, shape: str) -> str:
    return f"rlike({prepared}, {pattern(shape)})"


def pan(value: str) -> str:
    return _shaped(f"upper({strip(value)})", rf"(?U)\A[A-Z]{{3}}[{PAN_STATUS}][A-Z]\d{{4}}[A-Z]\z")


def ifsc(value: str) -> str:
    return _shaped(f"upper({strip(value)})", r"\A[A-Z]{4}0[A-Z0-9]{6}\z")


def upi(value: str) -> str:
    # Every known handle is three to thirty letters, so the letters rule covers them.
    return _shaped(f"lower({strip(value)})", r"\A[a-z0-9._-]{2,64}@[a-z]{3,30}\z")


def phone(value: str) -> str:
    local = choose(
        ("startswith(d, '91') AND length(d) = 12", "substring(d, 3)"),
        ("startswith(d, '0') AND length(d) = 11", "substring(d, 2)"),
        otherwise="d",
    )
    # Ten digits that are not all the same.
    return let(
        drop_chars(value, "()+-"), "d", _shaped(local, r"(?U)\A(?!(.)\1{9}\z)[6-9]\d{9}\z")
    )


def driving_licence(value: str) -> str:
    # Fifteen characters with a year are a special case of two letters and 13 digits.
    return _shaped(
        f"upper({drop_chars(value, '-')})", rf"(?U)\A(?:{'|'.join(LICENCE_STATES)})\d{{13,14}}\z"
    )


def passport(value: str) -> str:
    return _shaped(f"upper({drop_chars(value, '')})", r"(?U)\A[A-PR-WY][1-9]\d{6}\z")


def cin(value: str) -> str:
    return _shaped(
        f"upper({strip(value)})", r"(?U)\A[LU]\d{5}[A-Z]{2}(?:19|20)\d{2}[A-Z]{3}\d{6}\z"
    )


def pin_code(value: str) -> str:
    return _shaped(drop_chars(value, ""), r"(?U)\A(?!0)\d{6}\z")


def account(value: str) -> str:
    return rf"length(regexp_replace({value}, r'(?U)\D', '')) BETWEEN 9 AND 18"


RULES = {
    "aadhaar": aadhaar,
    "card": card,
    "gstin": gstin,
    "pan": pan,
    "ifsc": ifsc,
    "upi": upi,
    "phone": phone,
    "driving_licence": driving_licence,
    "passport": passport,
    "cin": cin,
    "pin_code": pin_code,
    "account": account,
}

# Entity names accepted by the mixed-table check, and the rule of each.
NAMED_RULES = {
    "AADHAAR": "aadhaar",
    "PAN": "pan",
    "CARD": "card",
    "GSTIN": "gstin",
    "IFSC": "ifsc",
    "UPI": "upi",
    "PHONE": "phone",
    "DL": "driving_licence",
    "PASSPORT": "passport",
    "CIN": "cin",
    "PIN": "pin_code",
}


def by_name(entity: str, value: str) -> str:
    """``valid``, ``invalid``, ``missing`` (null value) or ``unknown`` (no such entity)."""
    verdict = choose(
        *[(f"upper({entity}) = {lit(n)}", RULES[r](value)) for n, r in NAMED_RULES.items()]
    )
    known = ", ".join(lit(n) for n in NAMED_RULES)
    return choose(
        (f"upper({entity}) NOT IN ({known}) OR {entity} IS NULL", "'unknown'"),
        (f"{value} IS NULL", "'missing'"),
        (verdict, "'valid'"),
        otherwise="'invalid'",
    )
