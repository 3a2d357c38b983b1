"""Personal information inside e-mails: where it stands, what it says, and texts with typed placeholders.

Places are found in what a reader sees of a message (see ``mail``), so quoted-printable, HTML and quoted replies count
and cases broken over lines are one. Names come from a lexicon that is learned from the address headers of all
documents (see ``names``). Texts are read once with a Bloom filter of it; the distinct names that came out are checked
exactly, and only documents with a name that the filter passed wrongly are read again, with all their candidates
joined with the lexicon. Numbers get format-preserving Feistel pseudonyms, other values keyed tokens, so equal values
stay linked across documents in whatever layout they stand.

Defined results: null or empty texts have no places and stay as they are; texts without headers are bodies; very long
texts are read whole; a value found several times in a document counts once; repeated rows change nothing in what is
found and each keep their redacted text; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.llm import feistel, grammar
from strandweave.llm import names as people
from strandweave.llm.mail import visible
from strandweave.session import materialize

#: A side with no more rows than this is broadcast: ids of 16 bytes, so 2 MB.
FEW = 100_000


def _masked(text: str, spans: list) -> str:
    if not spans:
        return text
    out, at = [], 0
    for start, end, *_ in sorted(spans, key=lambda x: x[:2]):
        if end > at:
            start = max(start, at)
            out += [text[at:start], "\x00" * (end - start)]
            at = end
    return "".join([*out, text[at:]])


def _without_names(text: str) -> tuple[list[grammar.Place], str]:
    """Places other than names, and the text without them; later kinds don't reach into earlier ones."""
    found = list(grammar.emails(text))
    rest = _masked(text, found)
    low = grammar.lowered(rest)
    for kind in (grammar.identities, grammar.phones, grammar.addresses):
        new = list(kind(rest) if kind is grammar.phones else kind(rest, low))
        if new:
            found += new
            rest = _masked(rest, new)
    return found, rest


def places(text: str, lexicon: people.Filter) -> list[tuple[int, int, str, str, str | None, str | None]]:
    """``start, end, kind, value, given, family`` in a visible text."""
    found, rest = _without_names(text)
    named = people.resolve(people.candidates(rest, grammar.lowered(rest), lexicon))
    return [(*x, None, None) for x in found] + [(s, e, "name", value, given, family) for *_, s, e, value, given, family in named]


def _finder(bits: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = people.Filter(bits)
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    rows += [(i, *x) for x in dict.fromkeys(p[2:] for p in places(visible(text).text, lexicon))]
            columns = zip(*rows) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 4))], ["doc_id", "kind", "pii_value", "given", "family"])

    return run


# --- documents with a name that only the filter knows
CANDIDATES = "doc_id bigint, digest bigint, first int, form int, reading int, at int, start int, stop int, value string, given string, family string"
SPANS = "doc_id bigint, digest bigint, start int, stop int, kind string, pii_value string"


def _candidate_finder(bits: bytes) -> Callable:
    types = (*[pa.int64()] * 2, *[pa.int32()] * 6, *[pa.string()] * 3)
    names_ = [c.split()[0] for c in CANDIDATES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = people.Filter(bits)
        for batch in batches:
            rows = []
            for i, digest, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if text:
                    rest = _without_names(visible(text).text)[1]
                    rows += [(i, digest, *c) for hit in people.candidates(rest, grammar.lowered(rest), lexicon) for c in hit]
            columns = zip(*rows) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names_)

    return run


def _resolver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by document, word, form and reading; what is held is one document's candidates."""
    at, hits = None, []

    def close() -> list[tuple]:
        return [(*at, c[4], c[5], "name", c[6]) for c in people.resolve(hits)]

    for batch in batches:
        rows = []
        for doc, digest, *c in zip(*[x.to_pylist() for x in batch.columns]):
            if (doc, digest) != at:
                if at is not None:
                    rows += close()
                at, hits = (doc, digest), []
            if hits and hits[-1][0][0] == c[0]:
                hits[-1].append(tuple(c))
            else:
                hits.append([tuple(c)])
        yield _span_batch(rows)
    if at is not None:
        yield _span_batch(close())


def _span_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (*[pa.int64()] * 2, *[pa.int32()] * 2, *[pa.string()] * 2)
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in SPANS.split(", ")])


def exact_names(texts: DataFrame, bits: bytes, given: DataFrame, family: DataFrame) -> DataFrame:
    """Spans of names in ``texts`` (``doc_id, digest, text``): all candidates meet the lexicon before they are resolved."""
    found = texts.dropDuplicates(["doc_id", "digest"]).mapInArrow(_candidate_finder(bits), CANDIDATES).join(family, "family", "left_semi")
    initials, named = found.filter("given IS NULL"), found.filter("given IS NOT NULL").join(given, "given", "left_semi")
    order = [c.split()[0] for c in CANDIDATES.split(", ")]
    held = initials.select(*order).unionByName(named.select(*order))
    return held.repartition("doc_id", "digest").sortWithinPartitions(*order[:5]).mapInArrow(_resolver, SPANS)


def _by_ids(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """``df`` with or without the documents in ``ids``, a null id being one too; ``ids`` is broadcast if its checked size allows it."""
    right = ids.select(*[F.col(c).alias(f"_{c}") for c in ids.columns])
    right = F.broadcast(right) if ids.count() <= FEW else right
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ids.columns]
    return df.join(right, same, how)


def find(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, kind, pii_value`` of every place, each once a document."""
    given, family = people.lexicon(documents, known)
    bits = people.bloom_bits(given, family)
    shape = "doc_id bigint, kind string, pii_value string, given string, family string"
    found = materialize(documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(_finder(bits), shape), "places")
    wrong = materialize(people.wrong_keys(found.filter("kind = 'name'").select("given", "family").distinct(), given, family), "wrong-names")
    if wrong.isEmpty():
        return found.select("doc_id", "kind", "pii_value").distinct()
    same = (F.col("a.family") == F.col("b.family")) & F.col("a.given").eqNullSafe(F.col("b.given"))
    doubtful = materialize(found.filter("kind = 'name'").alias("a").join(wrong.alias("b"), same, "left_semi").select("doc_id").distinct(), "doubtful")
    sure = _by_ids(found, doubtful, "left_anti").unionByName(_by_ids(found.filter("kind <> 'name'"), doubtful, "left_semi"))
    again = _by_ids(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text"), doubtful, "left_semi")
    return sure.select("doc_id", "kind", "pii_value").unionByName(exact_names(again, bits, given, family).select("doc_id", "kind", "pii_value")).distinct()


# --- redaction
def _placeholder(key: bytes, kind: str, value: str, written: str) -> str:
    flat = " ".join(grammar.flat(written).split())
    if kind == "id":
        return f"[ID {feistel.pseudonym(key, kind, flat)}]"
    if kind == "phone":
        # the country code stays; national numbers are permuted whole, with it or without
        front = 1 if flat[0] == "+" else 2 if flat.startswith("00") else 0
        keep = (front == 2) * 2 + grammar.country_code(re.sub(r"\D", "", flat)[(front == 2) * 2 :]) if front else int(value[0] == "1" and len(value) == 11)
        return f"[PHONE {feistel.pseudonym(key, kind, flat, keep)}]"
    return f"[{kind.upper()} {feistel.token(key, kind, value)}]"


def _spliced(text: str, spans: list[tuple[int, int, str, str, str]], key: bytes) -> tuple[str, int]:
    """The text with its ``first, stop, kind, value, written`` replaced, and their number."""
    parts, at, n = [], 0, 0
    for first, stop, kind, value, written in sorted(spans, key=lambda p: p[:2]):
        if first >= at:
            parts += [text[at:first], _placeholder(key, kind, value, written)]
            at, n = stop, n + 1
    return "".join([*parts, text[at:]]), n


REDACTED = "doc_id bigint, digest bigint, text string, n_places int, given array<string>, family array<string>"


def _redacted_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string()))
    columns = zip(*rows) if rows else [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in REDACTED.split(", ")])


def _redactor(bits: bytes, key: bytes) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = people.Filter(bits)
        for batch in batches:
            rows = []
            for i, digest, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                n, used = 0, []
                if text:
                    view = visible(text)
                    found = places(view.text, lexicon)
                    used = list(dict.fromkeys(p[4:] for p in found if p[2] == "name"))
                    text, n = _spliced(text, [(*view.raw_span(s, e), kind, value, view.text[s:e]) for s, e, kind, value, _, _ in found], key)
                rows.append((i, digest, text, n, [g for g, _ in used], [f for _, f in used]))
            yield _redacted_batch(rows)

    return run


def _exact_redactor(key: bytes) -> Callable:
    """As above, with the spans of names given by the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, digest, text, named in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                view = visible(text)
                found = _without_names(view.text)[0] + [(p["start"], p["stop"], "name", p["pii_value"]) for p in named or []]
                rows.append((i, digest, *_spliced(text, [(*view.raw_span(s, e), kind, value, view.text[s:e]) for s, e, kind, value in found], key), [], []))
            yield _redacted_batch(rows)

    return run


def redact(documents: DataFrame, known: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text, n_places``: every place replaced by its kind and a pseudonym, all else as it was. No text is shuffled but those with a doubtful name."""
    given, family = people.lexicon(documents, known)
    bits = people.bloom_bits(given, family)
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("digest"), "text")
    done = materialize(texts.mapInArrow(_redactor(bits, key), REDACTED), "redacted")
    used = done.select(F.explode(F.arrays_zip("given", "family")).alias("k")).select("k.*").distinct()
    wrong = materialize(people.wrong_keys(used, given, family), "wrong-names")
    if wrong.isEmpty():
        return done.select("doc_id", "text", "n_places")
    ids = ["doc_id", "digest"]
    same = (F.col("a.family") == F.col("b.family")) & F.col("a.given").eqNullSafe(F.col("b.given"))
    keyed = done.select(*ids, F.explode(F.arrays_zip("given", "family")).alias("k")).select(*ids, "k.*")
    doubtful = materialize(keyed.alias("a").join(wrong.alias("b"), same, "left_semi").select(*ids).distinct(), "doubtful")
    again = _by_ids(texts, doubtful, "left_semi")
    spans = exact_names(again, bits, given, family).groupBy(*ids).agg(F.collect_list(F.struct("start", "stop", "pii_value")).alias("named"))
    other = spans.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), "named")
    anew = again.join(other, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select(*ids, "text", "named").mapInArrow(_exact_redactor(key), REDACTED)
    return _by_ids(done, doubtful, "left_anti").unionByName(anew).select("doc_id", "text", "n_places")
