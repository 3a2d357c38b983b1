"""Places whose form gives them away: e-mail addresses, phone numbers, identity numbers and street addresses.

Every pattern is anchored where its first word or digit stands and reads on by its grammar, so blanks, line breaks and
quote marks between its parts may be of any length. What stands before an anchor is reached by stepping back over
such runs (``skip_back``), never by a window of fixed width.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

#: All of these are possessive, so that runs of blanks of any length are read once.
BREAK = r"\r?\n(?:[ \t]*+[>|])*+[ \t]*+"
#: Optional and required blanks; at most one line break, with quote marks.
B0 = rf"[ \t\xa0]*+(?:{BREAK})?+"
B1 = rf"(?:[ \t\xa0]++(?:{BREAK})?+|{BREAK})"
BLANKS = " \t\xa0>|\r\n"

Place = tuple[int, int, str, str]

# --- e-mail addresses
HOST = re.compile(r"@[A-Za-z0-9][\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,}(?![\w-])")
BACK_LOCAL = re.compile(r"[\w.+%-]*[A-Za-z0-9_]")
HINT = re.compile(r"[\[({][ \t]*(?:at|AT|At)[ \t]*[\])}]|\sAT\s")
DOT = rf"(?:\.|{B0}[\[({{](?i:dot)[\])}}]{B0})"
DISGUISED = re.compile(
    rf"(?<![\w.+-])([\w+-]+(?:{DOT}[\w+-]+)*)(?:{B0}[\[({{][ \t]*(?i:at)[ \t]*[\])}}]{B0}|{B1}AT{B1})([A-Za-z0-9][\w-]*(?:{DOT}[\w-]+)+)"
)
DOTS = re.compile(rf"{B0}[\[({{](?i:dot)[\])}}]{B0}")

# --- phone numbers
S = rf"(?:[ .\xa0/-]|{B1})"
#: Layouts that need no count of digits: national ones without trunk zero, and international ones of one country.
PHONE = re.compile(
    rf"(?:(?:\+|00)\d{{1,3}}{S}?(?:\(0\){S}?\d{{2}}/\d{{6}}|\d{{2}}{S}\d{{3}}{S}\d{{4}}|\d{{3}}{S}\d{{2}}{S}\d{{3}}|\d{{3}}{S}\d{{3}}{S}\d{{4}}|\d(?:[ .\xa0-]\d{{2}}){{4}}|\d{S}\d{{2}}{S}\d{{2}}{S}\d{{2}}|\(\d{{3}}\){S}?\d{{3}}{S}\d{{4}}|\d{{7,12}})"
    rf"|(?:1{S})?\(\d{{3}}\){S}?\d{{3}}{S}\d{{4}}|\d{{3}}-\d{{3}}-\d{{4}}|\d{{3}}\.\d{{3}}\.\d{{4}}|\d{{3}}{B1}\d{{7}}"
    rf"|1([-.\xa0 ])[2-9]\d{{2}}\1\d{{3}}\1\d{{4}}|[2-9]\d{{2}}[ \xa0][2-9]\d{{2}}[ \xa0]\d{{4}})(?![\w])(?![-./]\d)"
)
#: Layouts whose digits are counted by the numbering plan: groups behind a country code or a trunk zero, alike in their separators.
GROUPED = re.compile(
    rf"(?:\+|00)\d++(?:{S}?\(\d{{1,4}}\){S}?\d++)?(?:{S}\d++)*+|\(0\d{{1,4}}\){B0}\d++(?:{B1}\d++|-\d++)*+"
    rf"|0\d++(?:(?:{B1}\d++)++|(?:\.\d++)++|(?:-\d++)++|/\d++(?:{B1}\d++)*+)"
)
PHONE_START = re.compile(r"(?<![\w+])(?<!\d[.,/-])[+(\d]")
CUED = re.compile(rf"\d++(?:{S}\d++)*+")
DIGITS = re.compile(rf"[+(\d](?:[\d()./\xa0 -]|{BREAK}(?=[(\d]))*")
RUN = re.compile(r"\d+")
PART_WORDS = re.compile(r"(?:part|serial|model|item|order|article|build|version)\s+(?:numbers?|nos?\.?)(?:[\s>|]+(?:is|are|was))?\Z", re.I)
PART_AFTER = re.compile(r"[\s>|]*(?:rev|ver|version|build)\b", re.I)
PHONE_WORDS = ("tel", "phone", "telephone", "fax", "mobile", "mobil", "cell", "handy", "telefon", "telefono", "teléfono", "téléphone", "móvil", "portable")
#: Fixed values of the public numbering plan: country codes of two digits (1 and 7 have one digit, all others three).
TWO_DIGIT_COUNTRIES = (
    20, 27, 30, 31, 32, 33, 34, 36, 39, 40, 41, 43, 44, 45, 46, 47, 48, 49, 51, 52, 53, 54, 55, 56, 57, 58,
    60, 61, 62, 63, 64, 65, 66, 81, 82, 84, 86, 90, 91, 92, 93, 94, 95, 98,
)
#: Digits behind the country code, where the plan has one length or two; elsewhere 7 to 12.
NATIONAL_LENGTHS = {1: (10, 10), 7: (10, 10), 31: (9, 9), 33: (9, 9), 34: (9, 9), 41: (9, 9), 44: (9, 10), 45: (8, 8), 47: (8, 8), 48: (9, 9), 52: (10, 10), 55: (10, 11), 61: (9, 9), 81: (9, 10), 86: (10, 11), 91: (10, 10)}
ANY_LENGTH, TRUNK_LENGTH = (7, 12), (9, 11)

# --- identity numbers, announced by the words before them
NUMBER_WORD = rf"(?:{B0}-?(?:no\b\.?|numbers?\b|nr\b\.?|nummer\b|num\b\.?|núm\b\.?|n[°ºo]\.?))?"
CUE = (
    rf"passport{NUMBER_WORD}|identity{B1}card{NUMBER_WORD}|national{B1}id(?:entity)?{NUMBER_WORD}|id{B1}card{NUMBER_WORD}|tax{B1}(?:number|id|no\.?)|social{B1}security{NUMBER_WORD}|ssn"
    rf"|national{B1}insurance{NUMBER_WORD}|reisepass{NUMBER_WORD}|personalausweis{NUMBER_WORD}|steuer-?id{NUMBER_WORD}|steuernummer|sozialversicherungsnummer"
    rf"|passeport{NUMBER_WORD}|carte{B1}(?:nationale{B1})?d['’]identité{NUMBER_WORD}|numéro{B1}fiscal|(?:n[°º]|numéro){B1}de{B1}sécurité{B1}sociale"
    rf"|pasaporte{NUMBER_WORD}|(?:documento|carné){B1}(?:nacional{B1})?de{B1}identidad{NUMBER_WORD}|dni|nif|nie|número{B1}fiscal|número{B1}de{B1}(?:la{B1})?seguridad{B1}social"
)
VALUE = (
    rf"\d{{6}}-{B0}\d{{4}}|\d{{2}}{S}\d{{3}}{S}\d{{3}}{S}\d{{3}}|\d{{3}}-{B0}\d{{2}}-{B0}\d{{4}}|\d{{3}}{S}\d{{2}}{S}\d{{4}}|[A-Z]{S}\d{{4}}{S}\d{{4}}"
    rf"|[A-Z]{{1,3}}\d{{6,9}}|\d{{8}}(?:[-/]|{B1})?[A-Z]|\d{{7,12}}"
    rf"|[12]{S}?\d{{2}}{S}?\d{{2}}{S}?\d[\dAB]{S}?\d{{3}}{S}?\d{{3}}(?:{S}?\d{{2}})?|[XYZ]-?\d{{7}}-?[A-Z]|[A-Z]{{2}}{S}?\d{{2}}{S}?\d{{2}}{S}?\d{{2}}{S}?[A-D]"
    rf"|\d{{2}}{S}?\d{{6}}{S}?[A-Z]{S}?\d{{3}}|(?=(?:[A-Z]*\d){{4}})[A-Z][A-Z0-9]{{7,9}}"
)
IDENTITY = re.compile(rf"(?i:{CUE}){B0}[:,.]?{B0}(?i:(?:it{B1})?(?:is|ist|lautet|est|es)\b)?{B0}:?{B0}({VALUE})(?![A-Za-z0-9])")
#: The words that announcements begin with; "id" is met from its "card".
CUE_STEMS = (
    "passport", "identity", "national", "tax", "social", "ssn", "reisepass", "personalausweis", "steuer", "sozialversicherungsnummer", "passeport", "carte", "numéro", "n°", "nº",
    "pasaporte", "documento", "carné", "dni", "nif", "nie", "número",
)

# --- street addresses: fixed values, the words for streets
WORD = r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*"
CAP = rf"(?=[^\W\d_a-zß-öø-ÿ]){WORD}"
HOUSE = r"\d{1,4}[A-Za-z]?"
JOIN = rf"(?:{B0},{B0}|{B1}[-–]{B1}|{B1})"
TOWN = rf"{CAP}(?:[ -]{CAP})?"
EN_TYPE = r"(?i:street|st|road|rd|lane|ln|avenue|ave|close|row|terrace|drive|dr|court|ct|square|crescent|way|boulevard|blvd)"
FR_TYPE = r"(?i:rue|avenue|av\.?|boulevard|bd\.?|impasse|quai|place|chemin|allée|cours|route|square)"
ES_TYPE = r"(?i:calle|c/|avenida|avda\.?|plaza|paseo|camino|ronda|travesía)"
DE_TYPE = r"(?i:stra(?:ß|ss)e|str\.|gasse|platz|weg|allee|ring|ufer|damm)"
#: Postcodes behind a town: digits (with a state and an extension), or letters and digits in two parts.
POSTCODE = rf"(?:(?:[A-Z]{{2}}[ \xa0])?\d{{4,5}}(?!\d)(?:-\d{{4}}(?!\d))?|[A-Z]{{1,2}}\d[A-Z\d]?{B1}\d[A-Z]{{2}}\b|[A-Z]\d[A-Z]{B1}\d[A-Z]\d\b)"
AFTER = rf"(?:{JOIN}\d{{4,5}}[ \t\xa0]{CAP}(?:-{CAP})?|{JOIN}\d{{4,5}}{B1}{CAP})?"
NUMBERED = re.compile(
    rf"\d(?<![\w/.,-]\d)\d{{0,3}}[A-Za-z]?(?:"
    rf"{B1}(?:{CAP}{B1}){{1,3}}?{EN_TYPE}\b(?:\.?{JOIN}{TOWN}(?:,{B0}|{B1}){POSTCODE})?"
    rf"|{B0},?{B0}{FR_TYPE}{B1}(?:(?i:de|du|des|la|le|les|d['’])[ \t\xa0])*{CAP}{AFTER}"
    rf")(?![\w])"
)
NAMED = re.compile(
    rf"(?<![\w/.,-])(?:{ES_TYPE}{B0}(?:(?i:de|del|la|el|los|las)[ \t\xa0])*{CAP}(?:{B0},{B0}|{B1}n[º°o.]{B0}|{B1}){HOUSE}(?!\d){AFTER}"
    rf"|{CAP}{DE_TYPE}{B1}{HOUSE}(?![\d.]\d){AFTER}"
    rf"|{CAP}{B1}(?i:stra(?:ß|ss)e|platz|weg|allee|ring){B1}{HOUSE}(?![\d.]\d){AFTER}"
    rf")(?![\w])"
)
STREETS_FIRST = ("calle", "c/", "avenida", "avda", "plaza", "paseo", "camino", "ronda", "travesía")
STREETS_LAST = ("straße", "strasse", "str.", "gasse", "platz", "weg", "allee", "ring", "ufer", "damm")


def flat(value: str) -> str:
    """Without line breaks and quote marks."""
    return re.sub(BREAK, " ", value)


def plain(value: str) -> str:
    """Lower case, every run of other characters than letters and digits one blank, none at the ends."""
    return " ".join(re.findall(r"[^\W_]+", flat(value).lower()))


def lowered(text: str) -> str:
    """Lower case of the same length."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def skip_back(text: str, at: int, least: int = 0, chars: str = BLANKS) -> int:
    """The end of what stands before ``at``, without the ``chars`` between; ``least`` if there is nothing else."""
    size = 64
    while at > least:
        chunk = text[max(least, at - size) : at]
        kept = chunk.rstrip(chars)
        if kept:
            return at - len(chunk) + len(kept)
        at -= len(chunk)
        size *= 4
    return least


def match_back(pattern: re.Pattern, text: str, at: int, least: int = 0) -> int:
    """Length of the match of ``pattern`` on the reversed text before ``at``, 0 if none; the text read grows with the match."""
    size = 64
    while True:
        first = max(least, at - size)
        m = pattern.match(text[first:at][::-1])
        n = m.end() if m else 0
        # a match that comes near the end of what was read may go on
        if first == least or n + 2 < size:
            return n
        size *= 4


def _all_of(low: str, stems: Iterable[str]) -> list[int]:
    out = []
    for stem in stems:
        i = low.find(stem)
        while i >= 0:
            out.append(i)
            i = low.find(stem, i + 1)
    return out


def emails(text: str) -> Iterator[Place]:
    for m in HOST.finditer(text):
        n = match_back(BACK_LOCAL, text, m.start())
        if n:
            yield m.start() - n, m.end(), "email", text[m.start() - n : m.end()].lower()
    if HINT.search(text):
        for m in DISGUISED.finditer(text):
            yield m.start(), m.end(), "email", f"{DOTS.sub('.', m[1])}@{DOTS.sub('.', m[2])}".lower()


def country_code(digits: str) -> int:
    """Number of leading digits that are the country code."""
    return 1 if digits[:1] in ("1", "7") else 2 if digits[:2].isdigit() and int(digits[:2]) in TWO_DIGIT_COUNTRIES else 3


def _grouped(text: str, at: int) -> int:
    """The end of a number that starts at ``at`` with a country code or a trunk zero: the longest run of groups that the plan allows, 0 if none."""
    m = GROUPED.match(text, at)
    if not m:
        return 0
    out, digits, abroad = 0, "", m[0][0] == "+" or m[0].startswith("00")
    for run in RUN.finditer(text, at, m.end()):
        digits += run[0]
        if len(digits) > 20:
            break
        if text[run.end() : run.end() + 1] == ")":
            continue
        if abroad:
            n = len(digits) - 2 * (m[0][0] == "0")
            own = digits[2:] if m[0][0] == "0" else digits
            code = country_code(own)
            low, high = NATIONAL_LENGTHS.get(int(own[:code] or 0), ANY_LENGTH)
            fits = low <= n - code - ("(0)" in text[at : run.end()]) <= high
        else:
            fits = TRUNK_LENGTH[0] <= len(digits) <= TRUNK_LENGTH[1]
        if fits and not _goes_on(text, run.end()):
            out = run.end()
    return out


def _goes_on(text: str, at: int) -> bool:
    after = text[at : at + 2]
    return after[:1].isalnum() or after[:1] == "_" or (after[:1] in ("-", ".", "/", ":") and after[1:].isdigit())


def _cued(text: str, at: int) -> int:
    """The end of a number right behind a word for a phone, 0 if there is none."""
    stop = skip_back(text, at, 0, BLANKS + ":.")
    n = 0
    while n < 12 and stop - n > 0 and text[stop - n - 1].isalpha():
        n += 1
    if text[stop - n : stop].lower() not in PHONE_WORDS:
        return 0
    m = CUED.match(text, at)
    return m.end() if m and 8 <= sum(map(str.isdigit, m[0])) <= 15 and not _goes_on(text, m.end()) else 0


def _is_part(text: str, start: int, end: int) -> bool:
    if PART_AFTER.match(text, end):
        return True
    words, at = [], skip_back(text, start, 0, BLANKS + ":")
    for _ in range(3):
        n = 0
        while n < 12 and at - n > 0 and (text[at - n - 1].isalpha() or text[at - n - 1] == "."):
            n += 1
        if not n:
            break
        words.insert(0, text[at - n : at])
        at = skip_back(text, at - n)
    return bool(PART_WORDS.search(" ".join(words)))


def phones(text: str) -> Iterator[Place]:
    done = 0
    for c in DIGITS.finditer(text):
        if c.end() - c.start() < 7 or sum(map(str.isdigit, c[0])) < 7:
            continue
        for at in PHONE_START.finditer(text, max(done, c.start()), c.end()):
            start = at.start()
            if start < done:
                continue
            m = PHONE.match(text, start)
            end = m.end() if m else _grouped(text, start) or (text[start].isdigit() and _cued(text, start))
            if not end:
                continue
            done = end
            if text[start + 3 : start + 4] == "." and _is_part(text, start, end):
                continue
            yield start, end, "phone", re.sub(r"\D", "", text[start:end])


def identities(text: str, low: str) -> Iterator[Place]:
    starts = _all_of(low, CUE_STEMS)
    for i in _all_of(low, ("card",)):
        j = skip_back(low, i)
        if j < i and low[max(0, j - 2) : j] == "id":
            starts.append(j - 2)
    done = 0
    for i in sorted(starts):
        if i < done or i and (low[i - 1].isalnum()):
            continue
        m = IDENTITY.match(text, i)
        if m:
            done = m.end()
            yield m.start(1), m.end(1), "id", re.sub(r"[^A-Z0-9]", "", m[1])


def _word_starts(text: str, at: int, walked: set[int]) -> Iterator[int]:
    """Where a street's name may begin in the word that ends at ``at``: its capitals that aren't inside of a run of letters.

    ``walked`` holds where earlier walks began; what lies before them was given then.
    """
    i = at
    while i > 0 and i not in walked and (text[i - 1].isalpha() or text[i - 1] in "'’-"):
        i -= 1
        if text[i].isupper() and not (i and (text[i - 1].isalnum() or text[i - 1] in "_/.,-")):
            yield i
    walked.add(at)


def addresses(text: str, low: str) -> Iterator[Place]:
    """Those that begin with their house number, then those that begin with their street."""
    for m in NUMBERED.finditer(text):
        yield m.start(), m.end(), "address", plain(m[0])
    starts = _all_of(low, STREETS_FIRST)
    walked: set[int] = set()
    for i in sorted(_all_of(low, STREETS_LAST)):
        starts += _word_starts(text, i + 1, walked)
        j = skip_back(text, i)
        if j < i:
            starts += _word_starts(text, j, walked)
    done = 0
    for i in sorted(set(starts)):
        m = NAMED.match(text, i) if i >= done else None
        if m:
            done = m.end()
            yield m.start(), m.end(), "address", plain(m[0])
