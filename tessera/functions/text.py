"""Tokenizers, BM25 vectors and inverse document frequency."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small list of our own; pass any other.
ENGLISH_STOPWORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "with")
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ", "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUY")
_ALNUM = r"\p{IsAlphabetic}\p{N}"


@dataclass(frozen=True)
class Tokenizer:
    """kind: word, whitespace or prefix. Steps in this order: fold, lower, stopwords, stem, length."""

    kind: str = "word"
    lowercase: bool = True
    ascii_folding: bool = False
    stopwords: tuple[str, ...] = ()
    stemmer: object = None
    min_len: int | None = None
    max_len: int | None = None
    extra: dict = field(default_factory=dict, hash=False, compare=False)

    def __post_init__(self):
        if self.kind not in ("word", "whitespace", "prefix"):
            raise ValueError(f"no tokenizer of this name: {self.kind}")

    def plain(self, text: Column) -> Column:
        """The text as its tokens are spelled, before they are split."""
        text = F.translate(text, *_ACCENTS) if self.ascii_folding else text
        return F.lower(text) if self.lowercase else text

    def may_hold(self, text: Column, query: list[str]) -> Column:
        """False only for texts that hold no token of the query: a substring test before any splitting."""
        if self.stemmer is not None or not query:
            return F.lit(bool(query))
        return reduce(lambda a, b: a | b, [F.contains(self.plain(text), F.lit(w)) for w in query])

    def _words(self, text: Column, stopwords: bool = True) -> Column:
        text = self.plain(text)
        words = F.split(text, r"\s+" if self.kind == "whitespace" else f"[^{_ALNUM}]+")
        words = F.filter(words, lambda w: w != "")
        if self.stopwords and stopwords:
            stop = F.array(*[F.lit(w.lower() if self.lowercase else w) for w in self.stopwords])
            words = F.filter(words, lambda w: ~F.array_contains(stop, w))
        if self.stemmer is not None:  # any function of a word; Arrow batches
            stem = self.stemmer
            words = F.pandas_udf(lambda s: s.map(lambda ws: None if ws is None else [stem(w) for w in ws]), "array<string>")(words)
        return words

    def document(self, text: Column) -> Column:
        """The tokens of a text, in order."""
        words = self._words(text)
        low, high = self.min_len, self.max_len
        if self.kind != "prefix":
            if low is not None:
                words = F.filter(words, lambda w: F.length(w) >= low)
            return words if high is None else F.filter(words, lambda w: F.length(w) <= high)
        low = low or 1

        def prefixes(w: Column) -> Column:
            top = F.length(w) if high is None else F.least(F.length(w), F.lit(high))
            return F.when(top >= low, F.transform(F.sequence(F.lit(low), top), lambda n: F.substring(w, F.lit(1), n))).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(words, prefixes))

    def query(self, text: str) -> list[str]:
        """The tokens of a literal query; for prefixes the longest of each word, stopwords kept."""
        text = text.translate(str.maketrans(*_ACCENTS)) if self.ascii_folding else text
        text = text.lower() if self.lowercase else text
        words = text.split() if self.kind == "whitespace" else re.findall(r"[^\W_]+", text)
        if self.kind != "prefix":
            stop = {w.lower() if self.lowercase else w for w in self.stopwords}
            words = [w for w in words if w not in stop]
        words = [self.stemmer(w) for w in words] if self.stemmer else words
        if self.kind == "prefix":
            words = [w[: self.max_len] if self.max_len else w for w in words]
        return [w for w in words if len(w) >= (self.min_len or 0) and (self.kind == "prefix" or len(w) <= (self.max_len or len(w)))]


# matching of token arrays


def has_all(tokens: Column, query: list[str]) -> Column:
    if not query:
        return F.lit(False)
    return F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(query))), tokens)) == 0


def has_any(tokens: Column, query: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, query))) if query else F.lit(False)


def has_phrase(tokens: Column, query: list[str]) -> Column:
    """Adjacent, in order. Tokens hold no blank, so the joined text decides."""
    if not query:
        return F.lit(False)
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(" " + " ".join(query) + " "))


# sparse text vectors


def idf(n, df) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_weight(tf: Column, length: Column, k: float = 1.2, b: float = 0.75, avg_len: float = 256.0) -> Column:
    return tf * (k + 1) / (tf + k * (1 - b + b * length / avg_len))


def bm25_terms(docs: DataFrame, id_col: str, text: str, tokenizer: Tokenizer = Tokenizer(), **params) -> DataFrame:
    """Exploded document vectors: id, token, weight. One shuffle on (id, token)."""
    tokens = docs.select(F.col(id_col), tokenizer.document(F.col(text)).alias("tokens"))
    rows = tokens.select(id_col, F.size("tokens").alias("length"), F.explode("tokens").alias("token"))
    counted = rows.groupBy(id_col, "length", "token").agg(F.count("*").alias("tf"))
    return counted.select(id_col, "token", bm25_weight(F.col("tf"), F.col("length"), **params).alias("weight"))


def bm25_search(docs: DataFrame, id_col: str, text: str, query: str, tokenizer: Tokenizer = Tokenizer(), use_idf: bool = True, **params) -> DataFrame:
    """id and score of the documents that share a token with the query. Each token of the query is a
    literal and its count a column of the document's own row: no row is shuffled, and the terms of a score
    are added in the query's order, however the documents are dealt out. With idf, one sum over the
    documents gives all frequencies, as a scalar subquery. Rows that repeat an id are scored each."""
    wanted = list(dict.fromkeys(tokenizer.query(query)))
    if not wanted:
        return docs.select(F.col(id_col).alias("id"), F.lit(0.0).alias("score")).where("false")
    body = F.col(text)

    def count_of(word: str) -> Column:
        return F.size(F.filter("hits", lambda t: t == word))

    def counted(rows: DataFrame, *keep: Column) -> DataFrame:
        rows = rows.where(tokenizer.may_hold(body, wanted)).select(*keep, tokenizer.document(body).alias("tokens"))
        hits = rows.select(*[k for k in rows.columns if k != "tokens"], F.size("tokens").alias("length"), F.filter("tokens", lambda t: t.isin(wanted)).alias("hits")).where(F.size("hits") > 0)
        return hits.withColumns({f"tf{i}": count_of(w) for i, w in enumerate(wanted)})

    parts = [bm25_weight(F.col(f"tf{i}"), F.col("length"), **params) for i in range(len(wanted))]
    rows = counted(docs, F.col(id_col).alias("id"))
    if use_idf:
        holds = [F.count(F.when(F.col(f"tf{i}") > 0, 1)) for i in range(len(wanted))]
        held = counted(docs).agg(F.array(*holds).alias("df")).select("df").scalar()
        n = docs.agg(F.count("*").alias("n")).scalar()
        rows = rows.withColumns({"df": held, "total": n})
        parts = [p * idf(F.col("total"), F.col("df")[i]) for i, p in enumerate(parts)]
    parts = [F.when(F.col(f"tf{i}") > 0, p).otherwise(0.0) for i, p in enumerate(parts)]
    return rows.select("id", reduce(lambda a, b: a + b, parts).alias("score"))


def murmur3_32(data: bytes, seed: int = 0) -> int:
    """The public 32-bit hash, for token ids that agree with other systems."""
    mask, h = 0xFFFFFFFF, seed
    turn = lambda x, r: ((x << r) | (x >> (32 - r))) & mask
    for i in range(0, len(data) - len(data) % 4, 4):
        h = (turn(h ^ turn(int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask, 13) * 5 + 0xE6546B64) & mask
    if tail := data[len(data) - len(data) % 4 :]:
        h ^= turn(int.from_bytes(tail, "little") * 0xCC9E2D51 & mask, 15) * 0x1B873593 & mask
    h ^= len(data)
    h = (h ^ (h >> 16)) * 0x85EBCA6B & mask
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & mask
    return h ^ (h >> 16)


def token_id(token: Column) -> Column:
    """|murmur3| of a token as a signed 32-bit number, by Arrow batches."""

    @F.pandas_udf("long")
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else abs(h - (1 << 32) if (h := murmur3_32(t.encode())) >> 31 else h))

    return ids(token)
