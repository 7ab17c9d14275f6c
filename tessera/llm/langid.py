"""Operator 8, language ID by compression.

A text is coded with zstandard once per language, each time with that language's raw-content
dictionary; the language with the smallest code wins, and a narrow margin rejects the document.

The dictionaries come from a bounded sample of labelled rows (parameters of `fit`): per language the
`sample_docs` distinct texts with the smallest hash, `sample_chars` characters of each, together
`dict_bytes` at most. Passages that two sampled texts share are left out, and so is a sampled text that
the dictionaries of the other half of the sample give to another language. Everything is predicted from
whole texts, in blocks of `BLOCK` bytes so that a long text's own history does not drown the dictionary.

Defined cases: null text, no letter, or no labelled row at all: `und`, score 0, rejected. Equal
costs: the language that sorts first, and rejected. Repeated rows: a row each, equal results. Columns
of the input other than those named are passed over, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, small_batches

BLOCK = 16384
SAMPLE_DOCS = 200
#: Shares of a language's texts that are ranked apart before its best are ranked together.
SHARES = 16
SAMPLE_CHARS = 2048
DICT_BYTES = 65536
#: Words of a passage that two sampled texts may not share.
SHARED_WORDS = 4
#: Code lengths nearer than these to the second best are no evidence: bytes, and share of the best.
MIN_MARGIN_BYTES = 1
MIN_MARGIN_SHARE = 0.004
UNDETERMINED = "und"

#: Digits, signs and controls of ASCII count as spaces.
_TABLE = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SPACES = re.compile(rb" {2,}")
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return _ASCII_LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text)))


def normalise(text: str) -> bytes:
    return _SPACES.sub(b" ", text.lower().encode("utf-8", "surrogatepass").translate(_TABLE))


def held_out(doc_id: str = "doc_id"):
    """The fold that is never learned from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text="text", lang="lang", sample_docs=SAMPLE_DOCS, sample_chars=SAMPLE_CHARS, dict_bytes=DICT_BYTES) -> dict[str, bytes]:
    """language -> dictionary. docs holds only rows that may be learned from.

    Only (language, hash) pairs are ranked, first in SHARES shares by hash and then the best of these
    together, so that no task ranks more than SHARES * sample_docs keys of a language however many rows and
    map tasks there are; then the chosen texts are fetched by a broadcast of at most languages * sample_docs keys.
    """
    rows = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(text, F.lit(8)).alias("h"), F.col(text).alias("text"))
    keys = rows.select("lang", "h").distinct()
    best = keys.withColumn("share", F.expr(f"pmod(h, {SHARES})"))
    for by in (["lang", "share"], ["lang"]):
        best = best.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("r") <= sample_docs).drop("r")
    best = best.drop("share")
    chosen = rows.join(F.broadcast(best), ["lang", "h"]).groupBy("lang", "h").agg(F.min(F.substring("text", 1, sample_chars)).alias("text"))
    sample: dict[str, list[list[bytes]]] = {}
    for r in sorted(chosen.collect(), key=lambda r: (r["lang"], r["h"])):
        sample.setdefault(r["lang"], []).append(normalise(r["text"]).split())
    return dictionaries_of(sample, dict_bytes)


def dictionaries_of(sample: dict[str, list[list[bytes]]], dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """sample: language -> texts as lists of words."""
    n = SHARED_WORDS
    seen = Counter(s for texts in sample.values() for w in texts for s in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})

    def own(words: list[bytes]) -> list[bytes]:
        shared = {j for i in range(len(words) - n + 1) if seen[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}
        return [w for i, w in enumerate(words) if i not in shared]

    texts = {k: [w for w in map(own, v) if w] for k, v in sample.items()}
    join = lambda v: (b" " + b" ".join(w for words in v for w in words) + b" ")[-dict_bytes:]
    kept: dict[str, list[list[bytes]]] = {k: [] for k in texts}
    for half in (0, 1):
        model = Classifier({k: join(v[1 - half :: 2]) for k, v in texts.items()})
        for i, k in enumerate(model.langs):
            for words in texts[k][half::2]:
                costs = model.costs_of(b" ".join(words))
                if costs[i] == min(costs):
                    kept[k].append(words)
    return {k: join(kept[k] or v) for k, v in texts.items() if v}


class Classifier:
    """Code lengths of texts under each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        self.coders = []
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_GREEDY, min_match=4, search_log=3, hash_log=15, chain_log=15, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
        for k in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.coders.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def costs_of(self, data: bytes) -> list[int]:
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.coders]

    def costs(self, text: str) -> list[int]:
        return self.costs_of(normalise(text))

    def predict(self, text: str | None) -> tuple[str, float, bool, int, int]:
        """language, score, rejected, bytes of the best and of the second best code."""
        if text is None or not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0, True, 0, 0
        costs = self.costs(text)
        order = sorted(range(len(costs)), key=lambda i: (costs[i], i))
        best = costs[order[0]]
        score = 1.0 / sum(math.pow(2.0, max(-1000, best - costs[i])) for i in order)
        if len(order) == 1:
            return self.langs[order[0]], score, False, best, best
        second = costs[order[1]]
        narrow = second - best < max(MIN_MARGIN_BYTES, MIN_MARGIN_SHARE * best)
        return self.langs[order[0]], score, narrow, best, second


def classify(docs: DataFrame, dictionaries: dict[str, bytes], text="text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (default: all) with lang_pred, score, rejected, best_bytes, second_bytes.

    An input column with one of these names is replaced.
    """
    added = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()), ("best_bytes", pa.int64()), ("second_bytes", pa.int64())])
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added.names]
    ddl = added_ddl = "lang_pred string, score double, rejected boolean, best_bytes long, second_bytes long"
    if kept:
        ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.select(*[f"`{c}`" for c in kept]).schema) + ", " + added_ddl
    small_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(blob.value)
        for batch in batches:
            out = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            columns = [pa.array([x[i] for x in out], f.type) for i, f in enumerate(added)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(kept))] + columns, names=[*kept, *added.names])

    return docs.select(*[f"`{c}`" for c in kept], F.col(text).cast("string").alias("__text")).mapInArrow(run, ddl)


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("doc_id").isNotNull() & ~held_out())


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = classify(docs.select("doc_id", "text"), fit(learnable(docs)), keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected", "best_bytes", "second_bytes")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without those that language ID rejects, columns unchanged."""
    names = ["__" + str(i) for i in range(len(docs.columns))]  # whatever the columns are called
    found = classify(docs.toDF(*names), fit(learnable(docs)), text=names[docs.columns.index("text")])
    return found.where(~F.col("rejected")).select(*names).toDF(*docs.columns)
