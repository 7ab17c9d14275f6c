"""The pipeline's stages against plain versions, and its handling of odd rows."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import tokens
from tests.llm.test_operators import base_spans, plain_components

SF = "/root/testdata/sf0.001"


def test_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs
    before = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    first = {r["doc_id"]: r["text"] for r in kept["language_id"].collect()}
    assert len(first) >= 0.97 * len(before)
    groups = plain_components(sorted(first.items()), 5, 80, 100)
    assert {r["doc_id"] for r in kept["near_duplicates"].collect()} == {c for _, _, c in groups}
    for r in kept["pii"].collect():
        assert (r["text"] == first[r["doc_id"]]) or base_spans(first[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    sizes = Counter()
    for r in kept["packing"].collect():
        sizes[r["doc_id"]] += r["length"]
    plain = tokens.counter().encoding  # the tokenizer itself, on whole texts
    assert sizes == Counter({r["doc_id"]: len(plain.encode_ordinary(r["text"])) for r in kept["pii"].collect()})


def test_odd_rows(spark):
    rows = [(1, "a b c d e f", None, None, None), (1, "a b c d e f", None, None, None), (None, "z z z", "en", "s", 1), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (4, "A B c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("component_id", F.lit(1)).withColumn("__0", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SF)
            n = out.count()
            assert n == 0 or df is docs
            if name == "near_duplicates" and df is docs:
                assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in out.collect()) == [-1, 1, 2, 3]
            if name != "packing":
                assert out.columns == docs.columns


def test_copies_go_by_row(spark):
    """Rows with a shared or no id: copies go, other texts stay."""
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red green blue cyan pink grey")
    rows = [(1, a), (1, b), (2, a), (None, a), (None, c), (None, c), (3, b), (3, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    out = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, SF)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(1, a), (1, b), (None, c)])


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
