"""Names of people by a lexicon that is learned from the address headers of all documents.

Given names known beforehand make family names, these make given names, and so on until nothing new comes. Tasks hold
the lexicon as a Bloom filter, sized by it up to a fixed bound; what a filter lets pass is checked exactly later, so
its false answers cost time and change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.llm.grammar import B0, B1, match_back, plain, skip_back
from strandweave.operators.graph import components
from strandweave.session import materialize

TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*")
GAP = re.compile(B1)
#: The word after a family name and a comma.
COMMA = re.compile(rf"{B0},{B0}({TOKEN.pattern})(\.?)")
PARTICLES = r"(?:[Dd]e|DE|[Vv]on|[Vv]an|[Dd]el|[Dd]i|[Dd]a|[Dd]u|[Ll]a|[Ll]e)"
NAME_J = r"[\p{L}](?:[\p{L}]|['’\-](?=\p{L}))+"
LISTED = rf"(?m)(?:^[A-Za-z-]+:\s*|[,;]\s*|^\s+)\"?({NAME_J}\s(?:{PARTICLES}\s)?{NAME_J}|(?:{PARTICLES}\s)?{NAME_J},\s{NAME_J})\"?\s*<[^<>@\s]+@"

#: Hash functions of the Bloom filter, bits for each entry, and the least and most bits: 128 KB to 16 MB. A larger lexicon only gives more to check.
HASHES, BITS_EACH, LEAST_BITS, MOST_BITS = 3, 24, 1 << 20, 1 << 27
#: Rounds that follow the names step by step; what still grows then is settled by connected components, in a logarithmic number of rounds.
STEPS = 4


def bits_of(key: str, size: int) -> list[int]:
    data = key.encode()
    a, b = crc32(data), crc32(b"~" + data) | 1
    return [(a + i * b) % size for i in range(HASHES)]


class Filter:
    """What the lexicon may hold. Answers are kept, up to a bound; ``flags`` says of a word whether it may be a family name (1) or the end of one (2)."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")
        self.size = len(self.bits)
        self.known: dict[str, bool] = {}
        self.flags: dict[str, int] = {}

    def __contains__(self, key: str) -> bool:
        hit = self.known.get(key)
        if hit is None:
            if len(self.known) > 100_000:
                self.known.clear()
            hit = self.known[key] = all(self.bits[i] for i in bits_of(key, self.size))
        return hit

    def flag(self, word: str) -> int:
        if len(self.flags) > 200_000:
            self.flags.clear()
        key = word.replace("’", "'")
        flag = self.flags[word] = 0 if len(word) < 2 else (("f:" + key) in self) + 2 * (("p:" + key) in self)
        return flag


# --- places
#: What may be a name: where its family name's last word starts, rank of the form (a double family name first), rank of the
#: reading (9 for none), where the form starts, start and end of the name, its value, given (null for an initial) and family name.
Candidate = tuple[int, int, int, int, int, int, str, "str | None", str]


def _before(text: str, at: int) -> tuple[str, bool, int] | None:
    """The word before a position with blanks between, whether it has a dot, and where it starts."""
    stop = skip_back(text, at)
    dot = stop > 0 and text[stop - 1] == "."
    if not (GAP.fullmatch(text, stop, at) or (dot and stop == at)):
        return None
    stop -= dot
    n = match_back(TOKEN, text, stop)
    return (text[stop - n : stop], dot, stop - n) if n else None


def _whole(low: str, start: int, end: int) -> bool:
    """A token of its own, and not a part of an address or a path."""
    left, right = low[start - 1 : start], low[end : end + 2]
    return not (left.isalnum() or left in ("'", "’", "_", "-", "@", "/") and left) and not (right[:1].isalnum() or right[:1] in ("_", "@") and right[:1] or right[:1] in ("'", "’") and right[1:].isalpha())


def _apart(text: str, at: int) -> bool:
    return at == 0 or not (text[at - 1].isalnum() or text[at - 1] in ".'’_-@")


def _readings(text: str, at: int, last: int, before: tuple[str, bool, int] | None, lexicon: Filter) -> Iterator[tuple[int, int, int, str | None]]:
    """Rank, start, end and given name of each way to read a family name that stands from ``at`` to ``last``."""
    if before and not before[1]:
        given = before[0].lower().replace("’", "'")
        if len(given) > 1 and "g:" + given in lexicon and _apart(text, before[2]):
            yield 1, before[2], last, given
    after = COMMA.match(text, last)
    if after:
        turned = after[1].lower().replace("’", "'")
        if len(turned) > 1 and "g:" + turned in lexicon:
            yield 2, at, after.end(1), turned
    if before and len(before[0]) == 1 and before[0].isupper() and _apart(text, before[2]):
        yield 3, before[2], last, None
    if after and len(after[1]) == 1 and after[1].isupper() and after[2]:
        yield 4, at, after.end(1), None


def candidates(text: str, low: str, lexicon: Filter) -> Iterator[list[Candidate]]:
    """In order of place, all forms and readings of each word that may end a family name."""
    hits = []
    for w in set(TOKEN.findall(low)):
        flag = lexicon.flags.get(w)
        if flag is None:
            flag = lexicon.flag(w)
        if flag:
            i = low.find(w)
            while i >= 0:
                hits.append((i, i + len(w), flag))
                i = low.find(w, i + 1)
    for first, last, flag in sorted(hits):
        if not _whole(low, first, last):
            continue
        family = low[first:last].replace("’", "'")
        before = _before(text, first)
        out: list[Candidate] = []
        if flag & 2 and before and not before[1]:
            double = f"{before[0].lower()} {family}"
            if "f:" + double in lexicon:
                at = before[2]
                read = [(first, 0, k, at, s, e, plain(text[s:e]), g, double) for k, s, e, g in _readings(text, at, last, _before(text, at), lexicon)]
                out += read or [(first, 0, 9, at, at, at, "", None, double)]
        if flag & 1:
            out += [(first, 1, k, first, s, e, plain(text[s:e]), g, family) for k, s, e, g in _readings(text, first, last, before, lexicon)]
        if out:
            yield out


def resolve(hits: Iterable[list[Candidate]]) -> Iterator[Candidate]:
    """From the left, the first form of each word that doesn't reach into a name before it, in its first reading that doesn't."""
    used = 0
    for hit in hits:
        if hit[0][0] < used:
            continue
        forms = [c for c in hit if c[3] >= used]
        for c in forms:
            if c[1] != forms[0][1]:
                break
            if c[2] < 9 and c[4] >= used:
                used = c[5]
                yield c
                break


# --- lexicon
def listed_names(documents: DataFrame) -> DataFrame:
    """``given, family`` of the people in address headers, in lower case."""
    head = F.get(F.split("text", r"\r?\n[ \t]*\r?\n", 2), F.lit(0))
    shown = documents.select(F.explode(F.regexp_extract_all(head, F.lit(LISTED), F.lit(1))).alias("n")).select(F.lower(F.regexp_replace(F.regexp_replace("n", "’", "'"), r"\s+", " ")).alias("n"))
    turned = F.split("n", ", ")
    straight = F.split("n", " ", 2)
    pick = F.when(F.size(turned) == 2, F.struct(F.get(turned, F.lit(1)).alias("given"), F.get(turned, F.lit(0)).alias("family"))).otherwise(
        F.struct(F.get(straight, F.lit(0)).alias("given"), F.get(straight, F.lit(1)).alias("family"))
    )
    return shown.distinct().select(pick.alias("x")).select("x.*").filter("given IS NOT NULL AND family IS NOT NULL").distinct()


def learn(pairs: DataFrame, known: DataFrame, steps: int = STEPS) -> tuple[DataFrame, DataFrame]:
    """``given`` and ``family``: all names that a chain of ``pairs`` (``given, family``) connects with a known given name."""
    given, size = materialize(known, "given"), -1
    for _ in range(steps):
        family = pairs.join(given, "given", "left_semi").select("family").distinct()
        reached = pairs.join(family, "family", "left_semi").select("given")
        given = materialize(given.unionByName(reached).distinct(), "given")
        before, size = size, given.count()
        if size == before:
            break
    else:
        sides = pairs.select(F.concat(F.lit("g:"), "given").alias("src"), F.concat(F.lit("f:"), "family").alias("dst"))
        parts = materialize(components(sides), "name-components")
        sown = parts.join(given.select(F.concat(F.lit("g:"), "given").alias("node")), "node", "left_semi").select("component").distinct()
        reached = parts.join(sown, "component", "left_semi").filter("node LIKE 'g:%'").select(F.expr("substr(node, 3)").alias("given"))
        given = materialize(given.unionByName(reached).distinct(), "given")
    return given, materialize(pairs.join(given, "given", "left_semi").select("family").distinct(), "family")


def lexicon(documents: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``given`` and ``family`` tables of all documents."""
    sown = known.filter("given IS NOT NULL").select(F.lower(F.trim("given")).alias("given")).distinct()
    return learn(materialize(listed_names(documents), "listed-names"), sown)


def _bit_columns(key: Column, size: int) -> Column:
    a, b = F.crc32(F.encode(key, "UTF-8")), F.crc32(F.concat(F.encode(F.lit("~"), "UTF-8"), F.encode(key, "UTF-8"))).bitwiseOR(F.lit(1))
    return F.array(*[(a + F.lit(i) * b) % size for i in range(HASHES)])


def bloom_bits(given: DataFrame, family: DataFrame) -> bytes:
    """The filter's bits. What reaches the driver is a word of 32 bits at a time, 16 MB of bits at most."""
    n = given.count() + 2 * family.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    keys = (
        given.select(F.concat(F.lit("g:"), "given").alias("k"))
        .unionByName(family.select(F.concat(F.lit("f:"), "family").alias("k")))
        .unionByName(family.filter("family LIKE '% %'").select(F.concat(F.lit("p:"), F.substring_index("family", " ", -1)).alias("k")))
    )
    at = keys.select(F.explode(_bit_columns(F.col("k"), size)).alias("at"))
    words = at.groupBy((F.col("at") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 32 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(size // 32, "<u4")
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype("<u4")
    return bits.tobytes()


def wrong_keys(keys: DataFrame, given: DataFrame, family: DataFrame) -> DataFrame:
    """Those of ``keys`` (``given, family``; a null given name is an initial) that only the filter let pass."""
    a = keys.join(family, "family", "left_anti").select("given", "family")
    b = keys.filter("given IS NOT NULL").join(given, "given", "left_anti").select("given", "family")
    return a.unionByName(b).distinct()
