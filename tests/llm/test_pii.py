import random

import pytest

pytest.importorskip("strandweave.llm.queries")

from strandweave.llm import feistel, grammar, names, pii  # noqa: E402


def phones(text):
    return [v for *_, v in grammar.phones(text)]


#: Layouts that the test tables do not have.
HELD_OUT = [
    "555 234 4567", "020 7946 0958", "+81 3 1234 5678", "06 12 34 56 78", "+61 2 9876 5432", "1-800-555-0199", "0171/5551234", "01 42 68 53 00", "+44 20 7946 0958", "+442079460958",
    "(020) 7946 0958", "030-1234-5678", "+49 171 5551234", "0044 20 7946 0958", "+39 06 6982 1234", "+86 138 0013 8000", "+33 (0)1 42 68 53 00", "+1 415 555 0132", "01.42.68.53.00", "+91 98765 43210",
    "+46 8 123 456 78", "+353 1 234 5678", "(0)30 1234567", "089 / 1234567",
]


def test_held_out_phones():
    found = [w for w in HELD_OUT if any(v.endswith("".join(c for c in w if c.isdigit())[-7:]) for v in phones(f"Please ring\n> {w}, thank you.")) ]
    assert len(found) >= 0.9 * len(HELD_OUT), sorted(set(HELD_OUT) - set(found))
    assert phones("Tel.: 5552344567") == ["5552344567"]


def test_no_phones():
    for text in ("on 03.11.2024 09:30", "Counts were 12 268 597 in", "from 203.0.113.122 on", "run 2024-8895, build", "Date: 1712968939", "part number is\n>   \n 180.180.7074, see", "2025-04-19T08:32:49Z", "2 345 678 901 12"):
        assert phones(text) == []


def test_no_window():
    gap = " " * 500 + "\n" + "> " * 300
    local = "a" * 300
    assert [v for *_, v in grammar.emails(f"x {local}@b.test")] == [f"{local}@b.test"]
    assert phones(f"+999 34{gap}764{gap}0569 ok") == ["999347640569"]
    assert phones(f"The part number is{gap}180.180.7074 now") == [] and phones(f"x 180.180.7074{' ' * 300}rev 3") == []
    for text, value in ((f"passport{gap}no., it is{gap}66 422 813 040.", "66422813040"), (f"numéro{gap}de{gap}sécurité{gap}sociale{gap}123456789", "123456789"), (f"ID{gap}card{gap}no AB9025218", "AB9025218")):
        assert [v for *_, v in grammar.identities(text, grammar.lowered(text))] == [value]
    for text, value in ((f"Calle{gap}Vastowmere nº{gap}68,{gap}69951{gap}Toltierra", "calle vastowmere nº 68"), (f"Lange{gap}Straße{gap}5, x", "lange straße 5"), (f"in {'Ab-' * 90}Hauptstraße 12 x", ("ab " * 90) + "hauptstraße 12")):
        assert [v for *_, v in grammar.addresses(text, grammar.lowered(text))][0].startswith(value)
    assert [v for *_, v in grammar.addresses("at 12 Baker Street, London NW1 6XE now", "at 12 baker street, london nw1 6xe now")] == ["12 baker street london nw1 6xe"]


def test_long_runs_are_read_once():
    for text in ("passport" + " " * 200_000 + "x", "1" * 300_000, "+" + "1 " * 100_000, "platz" * 40_000, "A-" * 100_000 + "weg", "@" * 100_000, ("a" * 50 + ".") * 4000 + "@"):
        low = grammar.lowered(text)
        list(grammar.emails(text)), list(grammar.phones(text)), list(grammar.identities(text, low)), list(grammar.addresses(text, low))


# --- names
def message(*people):
    return "To: " + ",\n ".join(f"{n} <a@b.test>" for n in people) + "\nSubject: x\n\n" + "\n".join(f"Dear {n}, hello." for n in people)


def test_chains_of_any_length(spark):
    chain = ["Ana Alpha", "Bert Alpha", "Bert Beta", "Carl Beta", "Carl Gamma", "Dora Gamma", "Dora Delta", "Zed Zulu"]
    docs = spark.createDataFrame([(i, message(n)) for i, n in enumerate(chain)], "doc_id bigint, text string")
    known = spark.createDataFrame([("Ana",)], "given string")
    want = {n.lower() for n in chain} - {"zed zulu"}
    assert {r["pii_value"] for r in pii.find(docs, known).filter("kind = 'name'").collect()} == want
    long = [(f"g{i // 2}", f"f{(i + 1) // 2}") for i in range(60)]
    pairs = spark.createDataFrame([*long, ("other", "people")], "given string, family string")
    given, family = names.learn(pairs, spark.createDataFrame([("g0",)], "given string"))
    assert {r[0] for r in given.collect()} == {g for g, _ in long} and {r[0] for r in family.collect()} == {f for _, f in long}


class Saturated(names.Filter):
    """A filter that lets all pass."""

    def __contains__(self, key):
        return True


@pytest.mark.parametrize("lie", ["f:maria", "f:x hello", "p:smith", "g:dear"])
def test_false_answers_of_the_filter_change_nothing(spark, monkeypatch, lie):
    """Maria is no family name; a filter that says so must not swallow the name behind it."""
    text = "To: Maria Smith <a@b.test>,\n Anna Jones <c@d.test>\nSubject: x\n\nAnna Maria Smith, Dear Smith, Smith, A. and Anna Jones."
    docs = spark.createDataFrame([(1, text), (1, text), (2, "no one"), (None, text)], "doc_id bigint, text string")
    known = spark.createDataFrame([("Anna",), ("Maria",)], "given string")
    want = sorted(map(tuple, pii.find(docs, known).fillna(-1).collect()))
    told = sorted(map(tuple, pii.redact(docs, known, b"k").fillna(-1).collect()))
    plain_bits = names.bloom_bits

    def lying(given, family):
        import numpy as np

        bits = np.frombuffer(plain_bits(given, family), np.uint8).copy()
        for i in names.bits_of(lie, len(bits) * 8):
            bits[i // 8] |= 1 << (i % 8)
        return bits.tobytes()

    monkeypatch.setattr(pii.people, "bloom_bits", lying)
    assert sorted(map(tuple, pii.find(docs, known).fillna(-1).collect())) == want
    assert sorted(map(tuple, pii.redact(docs, known, b"k").fillna(-1).collect())) == told
    assert (1, "name", "maria smith") in want


def test_a_filter_without_information(spark, monkeypatch):
    text = message("Maria Smith", "Anna Jones") + "\nSee Plan Nine and Anna Maria Smith."
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    known = spark.createDataFrame([("Anna",), ("Maria",)], "given string")
    want = sorted(map(tuple, pii.find(docs, known).collect()))
    monkeypatch.setattr(pii.people, "bloom_bits", lambda g, f: b"\xff" * 1024)
    assert sorted(map(tuple, pii.find(docs, known).collect())) == want


# --- pseudonyms
def digits(s):
    return "".join(c for c in s if c.isalnum())


def test_equal_numbers_in_all_layouts():
    us = ["555-123-4567", "555.123.4567", "(555) 123-4567", "555 123 4567", "555\n> 123\n> 4567", "5551234567"]
    hide = lambda w: pii._placeholder(b"k", "phone", digits(pii.grammar.flat(w).replace(">", "")), w)[7:-1]
    assert len({digits(hide(w)) for w in us}) == 1
    abroad = ["+1 555 123 4567", "+1-555-123-4567", "1-555-123-4567", "001 555 123 4567"]
    assert {digits(hide(w))[-10:] for w in abroad} == {digits(hide(us[0]))}
    uk = ["+44 20 7946 0000", "+442079460000", "+44 (20) 7946-0000", "0044 20 7946 0000"]
    assert len({digits(hide(w)).removeprefix("00") for w in uk}) == 1 and hide(uk[0]).startswith("+44 ")
    ids = ["AB9025218", "AB 9025218", "AB-90 25 218"]
    assert len({digits(feistel.pseudonym(b"k", "id", w)) for w in ids}) == 1


def valid(kind, n):
    return {"letter": lambda: n[8] == feistel.CHECK_LETTERS[int(n[:8]) % 23], "mod": lambda: feistel._mod_11_10(n[:10]) == n[10], "luhn": lambda: feistel._luhn(n[:9]) == n[9]}[kind]()


def test_valid_numbers_stay_valid_and_invert():
    rng = random.Random(4)
    for kind, make in (
        ("letter", lambda p: f"{p % 10**8:08d}" + feistel.CHECK_LETTERS[p % 10**8 % 23]),
        ("mod", lambda p: f"{p % 10**10:010d}" + feistel._mod_11_10(f"{p % 10**10:010d}")),
        ("luhn", lambda p: (h := f"8602{p % 28 + 1:02d}{p % 1000:03d}") + feistel._luhn(h)),
    ):
        good = [make(rng.randrange(10**12)) for _ in range(60)]
        bad = [g for n in good if not valid(kind, g := n[:-1] + ("A" if n[-1].isalpha() and n[-1] != "A" else str((int(n[-1]) + 3) % 10) if n[-1].isdigit() else "B"))]
        for n in good + bad:
            p = feistel.number_pseudonym(b"k", "id", n)
            assert valid(kind, p) == valid(kind, n) and feistel.number_pseudonym(b"k", "id", p, inverse=True) == n
        assert len({feistel.number_pseudonym(b"k", "id", n) for n in {*good, *bad}}) == len({*good, *bad})
    for n in ("123456789", "000456789", "666010001", "X1234567L", "X1234567A", "8602301234", "3002861234", "9999999999", "123456789012345"):
        p = feistel.number_pseudonym(b"k", "id", n)
        assert feistel.number_pseudonym(b"k", "id", p, inverse=True) == n and feistel.pattern_of(p) == feistel.pattern_of(n)
        assert feistel._parted(p) == feistel._parted(n) or len(n) != 9
    for n in ("860230", "300286", "010203"):
        p = feistel.number_pseudonym(b"k", "id", n + "4321")
        assert (feistel._day(p) or [None])[0] == (feistel._day(n) or [None])[0]


def test_small_formats_are_permuted_one_to_one():
    image = {feistel.number_pseudonym(b"k", "phone", f"{i:03d}") for i in range(1000)}
    assert len(image) == 1000 and len(feistel.token(b"k", "name", "x")) == 32
