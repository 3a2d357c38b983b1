"""Token counts by a public tokenizer.

Defined results: a null text has 0 tokens, as has an empty one; special-token strings in a text are ordinary text;
very long texts are counted whole.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Default place of the rank file; its pre-tokenisation pattern is the vocabulary's published one.
VOCABULARY = os.environ.get("STRANDWEAVE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def source_key(source: Column) -> Column:
    """Without letter case and outer blanks, with ``-`` equal to ``_``."""
    return F.lower(F.translate(F.trim(source), "-", "_"))


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens``; source as ``source_key`` writes it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode_ordinary
        for batch in batches:
            n = [len(encode(x)) if x else 0 for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), source_key(F.col("source")).alias("source"), "text").mapInArrow(run, "doc_id bigint, source string, tokens bigint")
