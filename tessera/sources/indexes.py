"""Stored postings of sparse vectors and of text: Parquet sorted by term inside buckets of terms, so that a
query reads the row groups of its terms only, and filters on them reach the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import Tokenizer


def _write(postings: DataFrame, term: str, path: str, buckets: int) -> None:
    """A bucket is a directory. Rows are spread by (term, salt), so that a very frequent term is no single task;
    `salt` follows the id."""
    salted = postings.withColumn("bucket", F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")).withColumn("__salt", F.pmod(F.xxhash64("id"), F.lit(16)))
    spread = salted.repartition(F.col("bucket"), F.col("__salt")).drop("__salt")
    spread.sortWithinPartitions("bucket", term, "id").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _of_terms(spark: SparkSession, path: str, term: str, terms: list, buckets: int, kind: str) -> DataFrame:
    """The postings of the terms; the buckets are computed as literals and prune directories."""
    rows = spark.read.parquet(path)
    if not terms:
        return rows.where(F.lit(False))
    numbers = spark.createDataFrame([(t,) for t in terms], f"t {kind}").select(F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")).distinct().collect()  # terms of one query
    return rows.where(F.col("bucket").isin([n[0] for n in numbers]) & F.col(term).isin(terms))


def write_sparse(df: DataFrame, id_col: str, v: str, path: str, buckets: int = 64) -> None:
    """Postings (dim, id, weight) of a struct of indices and values."""
    pairs = F.arrays_zip(F.col(f"{v}.indices").alias("dim"), F.col(f"{v}.values").alias("weight"))
    _write(df.select(F.col(id_col).alias("id"), F.inline(pairs)).select(F.col("dim").cast("long").alias("dim"), "id", "weight"), "dim", path, buckets)


def search_sparse(spark: SparkSession, path: str, query: dict[int, float], buckets: int = 64) -> DataFrame:
    """(id, score) of the points that share a dimension with the query. The terms of a score are added in the
    order of their dimensions, so that it does not depend on the shuffle."""
    rows = _of_terms(spark, path, "dim", [int(d) for d in query], buckets, "long")
    weights = F.create_map(*[F.lit(x) for d, w in sorted(query.items()) for x in (int(d), float(w))]) if query else F.create_map().cast("map<bigint,double>")
    part = F.col("weight").cast("double") * F.element_at(weights, F.col("dim"))
    parts = rows.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dim", part.alias("p")))).alias("ps"))  # as many as the query has terms
    return parts.select("id", F.aggregate("ps", F.lit(0.0), lambda t, x: t + x["p"]).alias("score"))


def write_text(df: DataFrame, id_col: str, text: Column, tokenizer: Tokenizer, path: str, buckets: int = 64) -> None:
    """Postings (token, id, places, length): the places of each token in a text, and its number of tokens."""
    tokens = df.select(F.col(id_col).alias("id"), tokenizer.document(text).alias("tokens"))
    each = tokens.select("id", F.size("tokens").alias("length"), F.posexplode("tokens").alias("place", "token"))
    rows = each.groupBy("id", "token").agg(F.sort_array(F.collect_list("place")).alias("places"), F.max("length").alias("length"))
    _write(rows.select("token", "id", "places", "length"), "token", path, buckets)


def _back(by: int):
    return lambda place: place - by


def match_text(spark: SparkSession, path: str, tokens: list[str], mode: str = "all", buckets: int = 64) -> DataFrame:
    """Ids of the texts with all of the tokens, with any of them, or with the tokens as a phrase."""
    wanted = list(dict.fromkeys(tokens))
    rows = _of_terms(spark, path, "token", wanted, buckets, "string")
    if mode == "any":
        return rows.select("id").distinct()
    found = rows.groupBy("id").agg(F.count("*").alias("n"), F.map_from_entries(F.collect_list(F.struct("token", "places"))).alias("at"))
    found = found.where(F.col("n") == len(wanted))
    if mode == "phrase":
        starts = F.element_at("at", F.lit(tokens[0])) if tokens else F.array().cast("array<int>")
        for i, t in enumerate(tokens[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.element_at("at", F.lit(t)), _back(i)))
        found = found.where(F.size(starts) > 0)
    return found.select("id")
