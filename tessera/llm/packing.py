"""Operator 9, best-fit packing with several permitted sequence lengths.

Best fit looks only at lengths, so the plan is made on the histogram of piece lengths, which has as many
entries as the largest capacity however large the corpus: the driver repeatedly takes the longest length
left, and for each permitted capacity that can hold it fills a bin with the best-fitting (longest that
fits) lengths left. The capacity with the least cost for each packed unit is opened, the bin is downsized
to the smallest permitted capacity that holds its contents, and the pattern is repeated as often as the
histogram allows. Documents then find their place by their rank among the pieces of equal length.

cost(capacity) = capacity + BIN_COST: padding is paid for, and every bin costs a little.

`pack` takes any length; the query and the pipeline's stage pack tokens of a public vocabulary (tokens.py), so
`start`, `length`, `offset` and `capacity` count tokens there.

A document longer than the largest capacity is cut into full pieces and a rest; nothing is truncated or
dropped. Defined cases: null or empty texts make one piece of length 0, which takes no room: it lies in
bin -1 with capacity 0; repeated rows and ids are packed row by row; an empty table has no bins; columns
beside those named are passed over.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import read, work_table
from tessera.llm.tokens import token_count

#: In tokens.
CAPACITIES = (2048, 4096, 8192, 16384)
BIN_COST = 16
#: Pieces of one length that are numbered in one task.
RANKED = 50_000


class _Left:
    """The lengths left, with the longest one up to a limit in logarithmic time."""

    def __init__(self, counts: dict[int, int]):
        self.count = dict(counts)
        self.lengths = sorted(k for k, v in counts.items() if v)

    def longest(self, limit: int, taken: dict[int, int]) -> int | None:
        i = bisect_right(self.lengths, limit) - 1
        while i >= 0 and self.count[self.lengths[i]] == taken.get(self.lengths[i], 0):
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def take(self, contents: dict[int, int], times: int) -> None:
        for k, v in contents.items():
            self.count[k] -= v * times
            if not self.count[k]:
                del self.lengths[bisect_left(self.lengths, k)]


def plan(counts: dict[int, int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> list[tuple[int, int, list[int]]]:
    """counts: length (1 to the largest capacity) -> pieces. Returns (capacity, bins, lengths in each bin)."""
    capacities = sorted(capacities)
    left, out = _Left(counts), []
    while left.lengths:
        first = left.lengths[-1]
        best = None
        for capacity in capacities[bisect_left(capacities, first) :]:
            taken, room = {first: 1}, capacity - first
            while room and (k := left.longest(room, taken)) is not None:
                n = min(left.count[k] - taken.get(k, 0), room // k)
                taken[k] = taken.get(k, 0) + n
                room -= k * n
            filled = capacity - room
            final = capacities[bisect_left(capacities, filled)]
            cost = (final + bin_cost) / filled
            if best is None or cost < best[0]:
                best = (cost, final, taken)
        _, final, taken = best
        times = min(left.count[k] // v for k, v in taken.items())
        left.take(taken, times)
        out.append((final, times, [k for k in sorted(taken, reverse=True) for _ in range(taken[k])]))
    return out


def segments(planned: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, int, int, int]]:
    """For each length the runs of ranks that go to one pattern: (length, from rank, to rank, first bin,
    pieces of this length in each bin, offset of the first of them, capacity)."""
    rank: dict[int, int] = {}
    out, first_bin = [], 0
    for capacity, bins, lengths in planned:
        offset, i = 0, 0
        while i < len(lengths):
            k = lengths[i]
            each = bisect_right([-x for x in lengths], -k) - i
            begin = rank.get(k, 0)
            rank[k] = begin + each * bins
            out.append((k, begin, rank[k], first_bin, each, offset, capacity))
            offset += k * each
            i += each
        first_bin += bins
    return out


_SEGMENT = T.StructType([T.StructField(n, T.LongType(), False) for n in ("length", "begin", "end", "first_bin", "each", "at", "capacity")])


def pack(docs: DataFrame, length: Column, keep: list[str], order: list[Column], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST) -> DataFrame:
    """keep (of docs), piece (from 0), start and length of the piece in its document, bin, capacity of the
    bin, and offset of the piece in it. order: columns that tell the rows of docs apart."""
    spark, most = docs.sparkSession, max(capacities)
    size = F.coalesce(length.cast("long"), F.lit(0))
    names = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], size.alias("size"), F.xxhash64(*order).alias("key"))
    rows = rows.select(*names, "key", "size", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.expr(f"cast((size - 1) div {most} as int)")))).alias("piece"))
    rows = rows.withColumn("start", F.col("piece").cast("long") * most).withColumn("length", F.least(F.lit(most), F.col("size") - F.col("start"))).drop("size")
    rows = work_table(rows, "pieces")
    counts = {r["length"]: r["n"] for r in rows.where("length > 0").groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length
    runs = segments(plan(counts, capacities, bin_cost))

    # the rank among equal lengths: salted by as many keys as the length's count asks for
    salts = spark.createDataFrame([(k, -(-v // RANKED)) for k, v in counts.items()], "length long, salts long")
    salted = rows.where("length > 0").join(F.broadcast(salts), "length").withColumn("salt", F.expr("pmod(xxhash64(key, piece), salts)"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("key", "piece")) - 1
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = salted.withColumn("inside", inside).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("inside"))

    # the plan has two entries for each length and pattern at most, and no more patterns than lengths
    table = spark.createDataFrame(runs, _SEGMENT).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("begin", "end", "first_bin", "each", "at", "capacity"))).alias("runs"))
    placed = ranked.join(F.broadcast(table), "length").withColumn("run", F.expr("filter(runs, r -> r.begin <= rank and rank < r.end)[0]"))
    nth = F.col("rank") - F.col("run.begin")
    placed = placed.select(*names, "piece", "start", "length", (F.col("run.first_bin") + F.floor(nth / F.col("run.each"))).cast("long").alias("bin"), F.col("run.capacity").alias("capacity"), (F.col("run.at") + (nth % F.col("run.each")) * F.col("length")).alias("offset"))
    none = rows.where("length = 0").select(*names, "piece", "start", "length", F.lit(-1).cast("long").alias("bin"), F.lit(0).cast("long").alias("capacity"), F.lit(0).cast("long").alias("offset"))
    out = placed.unionByName(none)
    return out.toDF(*keep, *out.columns[len(keep) :])


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pack(docs, token_count(F.col("text")), ["doc_id"], [F.col("doc_id"), F.col("text")])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each piece of each document lies in the packed sequences."""
    return pack(docs, token_count(F.col("text")), ["doc_id"], [F.col("doc_id"), F.col("text")])
