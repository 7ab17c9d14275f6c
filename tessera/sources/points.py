"""Points from rows, columnar batches, files and bulk imports, as canonical DataFrames."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def point_id(x) -> str:
    """An id as text: a number, or a UUID in its usual spelling, whatever way it was written."""
    if isinstance(x, int) or str(x).isdigit():
        if not 0 <= int(x) < 1 << 63:
            raise ValueError(f"id {x} does not fit a long")
        return str(int(x))
    return str(uuid.UUID(str(x)))


def canonical_id(x: Column) -> Column:
    """point_id for a column: hex digits of a UUID in lower case with hyphens; numbers as they are."""
    digits = F.regexp_replace(F.lower(x), r"^urn:uuid:|[{}-]", "")
    parts = F.regexp_replace(digits, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(x.rlike(r"^[0-9]{1,19}$"), x.cast("long").cast("string")).when(digits.rlike(r"^[0-9a-f]{32}$"), parts).otherwise(F.raise_error(F.concat(F.lit("neither a number nor a UUID: "), x)))


def from_rows(spark: SparkSession, points: list[dict], vectors: list[str] = ("",)) -> DataFrame:
    """id, payload (VARIANT) and vector_<name> columns from a list of points; ids are long if all are numbers,
    else text."""
    ids = [point_id(p["id"]) for p in points]
    numbers = all(i.isdigit() for i in ids)
    rows = []
    for p, i in zip(points, ids, strict=True):
        v = p.get("vector") or {}
        v = v if isinstance(v, dict) else {"": v}
        rows.append((int(i) if numbers else i, json.dumps(p.get("payload") or {}), *[[float(x) for x in v[n]] if v.get(n) is not None else None for n in vectors]))
    schema = T.StructType([T.StructField("id", T.LongType() if numbers else T.StringType()), T.StructField("payload", T.StringType()), *[T.StructField(f"vector_{n}", T.ArrayType(T.FloatType())) for n in vectors]])
    return spark.createDataFrame(rows, schema).withColumn("payload", F.parse_json("payload"))


def from_columns(batches: DataFrame, ids: str, vectors: str, payloads: str) -> DataFrame:
    """Rows of parallel arrays to one row for each point; arrays of different length are an error."""
    same = (F.size(ids) == F.size(vectors)) & (F.size(ids) == F.size(payloads))
    checked = batches.withColumn("__ok", F.when(same, True).otherwise(F.raise_error(F.lit("arrays of different length")).cast("boolean"))).where("__ok")
    zipped = F.arrays_zip(F.col(ids).alias("id"), F.col(vectors).alias("vector"), F.col(payloads).alias("payload"))
    return checked.select(F.inline(zipped))


def import_shards(spark: SparkSession, manifest: dict, assignment: str, vectors: str) -> DataFrame:
    """Bulk import: a JSON-lines assignment (id, shard) joined with a Parquet file of vectors (id, vector).
    The manifest's counts, width and shard numbers must hold."""
    placed = spark.read.schema("id long, shard int").json(assignment)
    rows = placed.join(spark.read.parquet(vectors), "id")
    seen = rows.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("low"), F.max(F.size("vector")).alias("high"), F.min("shard").alias("first"), F.max("shard").alias("last"), F.countDistinct("shard").alias("shards")).first()
    if seen["n"] != manifest["points"] or not seen["low"] == seen["high"] == manifest["dim"] or seen["first"] != 0 or seen["last"] + 1 != manifest["shards"] or seen["shards"] != manifest["shards"]:
        raise ValueError(f"the files do not fit the manifest: {seen.asDict()}")
    return rows


def by_shard(points: DataFrame, path: str, shard: str = "shard") -> None:
    """Parquet, a directory for each shard, so that a shard predicate prunes files."""
    points.repartition(shard).write.mode("overwrite").partitionBy(shard).parquet(path)
