"""Keyed permutations within a format: a Feistel network over the integers below any size, and number formats on it.

What is permuted is the bare number (its digits and capital letters), never the way it is written: equal numbers get
equal pseudonyms in any layout, and each is written in the layout it had. A number that is valid by a rule known here
(check digits, ranges, a date of birth) becomes another valid one, an invalid one another invalid one. The map is one
to one, and its inverse needs the key.
"""

from __future__ import annotations

import re
from datetime import date
from functools import lru_cache
from hashlib import blake2b

ROUNDS = 8
DAY_ONE = date(1920, 1, 1).toordinal()
DAYS = date(2020, 1, 1).toordinal() - DAY_ONE
#: The letters that check the number of an identity card, by its remainder.
CHECK_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def _round(key: bytes, tweak: str, i: int, half: int, bits: int) -> int:
    digest = blake2b(f"{tweak}|{i}|{half}".encode(), key=key, digest_size=(bits + 7) // 8 if bits > 64 else 8).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def _network(key: bytes, tweak: str, x: int, bits: int, inverse: bool) -> int:
    low, high = bits // 2, bits - bits // 2
    # halves of different width swap roles each round; the order is reversed for the inverse
    for i in reversed(range(ROUNDS)) if inverse else range(ROUNDS):
        if i % 2:
            a, b = x >> low, x & ((1 << low) - 1)
            x = (a << low) | (b ^ _round(key, tweak, i, a, low))
        else:
            a, b = x >> low, x & ((1 << low) - 1)
            x = ((a ^ _round(key, tweak, i, b, high)) << low) | b
    return x


def permute(key: bytes, tweak: str, x: int, size: int, inverse: bool = False) -> int:
    """A permutation of ``range(size)``: walk the network's cycle until it is back in range."""
    if size < 2:
        return x
    bits = max(2, (size - 1).bit_length())
    while True:
        x = _network(key, tweak, x, bits, inverse)
        if x < size:
            return x


def _unpack(number: str) -> tuple[int, int]:
    """A number of digits and capital letters as an integer, and how many numbers have its pattern."""
    x, size = 0, 1
    for c in number:
        base = 10 if c.isdigit() else 26
        x, size = x * base + (ord(c) - 48 if c.isdigit() else ord(c) - 65), size * base
    return x, size


def _pack(x: int, pattern: str) -> str:
    out = []
    for c in reversed(pattern):
        x, r = divmod(x, 10 if c == "0" else 26)
        out.append(chr(48 + r) if c == "0" else chr(65 + r))
    return "".join(reversed(out))


def pattern_of(number: str) -> str:
    return re.sub("[A-Z]", "A", re.sub("[0-9]", "0", number))


def _whole(key: bytes, tweak: str, number: str, inverse: bool) -> str:
    pattern = pattern_of(number)
    x, size = _unpack(number)
    return _pack(permute(key, f"{tweak}|{pattern}", x, size, inverse), pattern)


# --- rules: each gives the check of a payload, or says whether a payload can be valid
def _luhn(payload: str) -> str:
    total = sum(d - 9 if d > 9 else d for i, c in enumerate(reversed(payload)) for d in [int(c) * (2 - i % 2)])
    return str(-total % 10)


def _mod_11_10(payload: str) -> str:
    p = 10
    for c in payload:
        s = (int(c) + p) % 10 or 10
        p = s * 2 % 11
    return str((11 - p) % 10)


def _letter_23(payload: str) -> str:
    return CHECK_LETTERS[int(payload) % 23]


def _key_97(payload: str) -> str:
    return f"{97 - int(payload) % 97:02d}"


#: Pattern of a number whose check follows from its payload: length of the payload and the rule.
CHECKED = {"00000000A": (8, _letter_23), "00000000000": (10, _mod_11_10), "000000000000000": (13, _key_97), "0000000000000000": (15, _luhn)}


def _parted(number: str) -> bool:
    """Three parts of 3, 2 and 4 digits in their valid ranges."""
    return number[:3] not in ("000", "666") and number[0] != "9" and number[3:5] != "00" and number[5:] != "0000"


def _day(number: str) -> tuple[str, int] | None:
    """The notation of six digits that are a date, year or day first, and the date's number."""
    for notation, (yy, mm, dd) in (("ymd", (number[:2], number[2:4], number[4:6])), ("dmy", (number[4:6], number[2:4], number[:2]))):
        try:
            day = date(1900 + int(yy) if int(yy) >= 20 else 2000 + int(yy), int(mm), int(dd)).toordinal() - DAY_ONE
        except ValueError:
            continue
        if 0 <= day < DAYS:
            return notation, day
    return None


def _walk(key: bytes, tweak: str, number: str, inverse: bool, same) -> str:
    """Permute until the result is of the class that ``same`` stands for: one to one within the class."""
    while True:
        number = _whole(key, tweak, number, inverse)
        if same(number):
            return number


def _dated(key: bytes, tweak: str, number: str, inverse: bool) -> str:
    """Six digits of a date and four of a serial, whose last may check all others."""
    notation, day = _day(number)
    head = number[:6]
    if notation == "ymd":
        d = date.fromordinal(DAY_ONE + permute(key, tweak + "|day", day, DAYS, inverse))
        head = f"{d:%y%m%d}"
    else:
        # a day-first date must not read as a year-first one afterwards
        while True:
            d = date.fromordinal(DAY_ONE + permute(key, tweak + "|day-first", day, DAYS, inverse))
            head, day = f"{d:%d%m%y}", d.toordinal() - DAY_ONE
            if (_day(head) or ("",))[0] == "dmy":
                break
    if notation == "ymd" and _luhn(number[:9]) == number[9]:
        serial = f"{permute(key, tweak + '|serial', int(number[6:9]), 1000, inverse):03d}"
        return head + serial + _luhn(head + serial)
    serial, last = number[6:9], int(number[9])
    if notation != "ymd":
        return head + f"{permute(key, tweak + '|long-serial', int(serial) * 10 + last, 10_000, inverse):04d}"
    # nine last digits of ten don't check: they are counted without the one that does
    x = permute(key, tweak + "|unchecked-serial", int(serial) * 9 + last - (last > int(_luhn(number[:9]))), 9000, inverse)
    serial, last = f"{x // 9:03d}", x % 9
    return f"{head}{serial}{last + (last >= int(_luhn(head + serial)))}"


@lru_cache(maxsize=50_000)
def number_pseudonym(key: bytes, kind: str, number: str, inverse: bool = False) -> str:
    """The pseudonym of a bare number of digits and capital letters."""
    tweak, pattern = kind, pattern_of(number)
    if kind == "id":
        if pattern in CHECKED:
            n, check = CHECKED[pattern]
            if check(number[:n]) == number[n:]:
                payload = _whole(key, tweak + "|payload", number[:n], inverse)
                return payload + check(payload)
            return _walk(key, tweak, number, inverse, lambda x: check(x[:n]) != x[n:])
        if pattern == "A0000000A" and number[0] in "XYZ":
            front = lambda x: str("XYZ".index(x[0])) + x[1:8]
            if _letter_23(front(number)) == number[8]:
                p = permute(key, tweak + "|foreign", int(front(number)), 30_000_000, inverse)
                return f"{'XYZ'[p // 10_000_000]}{p % 10_000_000:07d}{CHECK_LETTERS[p % 23]}"
            return _walk(key, tweak, number, inverse, lambda x: x[0] not in "XYZ" or _letter_23(front(x)) != x[8]) if number[0] in "XYZ" else number
        if pattern == "000000000":
            valid = _parted(number)
            return _walk(key, tweak, number, inverse, lambda x: _parted(x) == valid)
        if pattern == "0000000000":
            if _day(number):
                return _dated(key, tweak, number, inverse)
            return _walk(key, tweak, number, inverse, lambda x: _day(x) is None)
    return _whole(key, tweak, number, inverse)


def pseudonym(key: bytes, kind: str, written: str, keep: int = 0, inverse: bool = False) -> str:
    """``written`` with its number, from the digit behind the first ``keep`` ones on, permuted; all else stays."""
    places = [i for i, c in enumerate(written) if "0" <= c <= "9" or "A" <= c <= "Z"]
    digits = 0
    while keep and places and digits < keep:
        digits += written[places[0]].isdigit()
        places.pop(0)
    if not places:
        return written
    out = list(written)
    for i, c in zip(places, number_pseudonym(key, kind, "".join(written[i] for i in places), inverse)):
        out[i] = c
    return "".join(out)


@lru_cache(maxsize=50_000)
def token(key: bytes, kind: str, value: str) -> str:
    """A keyed name of 128 bits of a value without a format of its own."""
    return blake2b(f"{kind}|{value}".encode(), key=key, digest_size=16).hexdigest()
