"""Numbers of tokens of whole texts, by a public byte-level BPE vocabulary.

Texts with very long runs overflow the tokenizer's own matcher; they are cut by the same pattern with a matcher
that has no recursion, and each unit is encoded for itself, which gives the same tokens. Null has no tokens, and
neither has "".
"""

from __future__ import annotations

import base64
import re
from functools import cache

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG_RUN = re.compile(r"\s{1000}|\S{100000}")


class Counter:
    def __init__(self, vocabulary: str):
        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.units = regex.compile(PATTERN)

    def of(self, text: str) -> int:
        if _LONG_RUN.search(text) is None:
            return len(self.encoding.encode_ordinary(text))
        encode = self.encoding._encode_single_piece
        return sum(len(encode(m.group().encode("utf-8", "replace"))) for m in self.units.finditer(text))


@cache
def counter(vocabulary: str = VOCABULARY) -> Counter:
    """One for each Python worker."""
    return Counter(vocabulary)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    @F.arrow_udf("long")
    def count(batch: pa.Array) -> pa.Array:
        known = counter(vocabulary)
        return pa.array([0 if t is None else known.of(t) for t in (x.as_py() for x in batch)], pa.int64())

    return count(text)
