"""Operator 7, n-gram Jaccard join: an exact similarity join of word-shingle sets in the metric space of
Jaccard distances, d = 1 - J, and the connected groups of its links.

1. Documents with equal sets become one class, a point of the space.
2. Pivots. Points that share no shingle are at distance 1, so a point has a place only among pivots with
   which it shares some. The pivots of a point are found by the shingles of its window: its first
   n - ceil(J n) + 1 in one order of all shingles (rare ones first). Two linked points share the first
   shingle that both have, and it lies in the windows of both; of all points with this shingle in their
   window, the one with the fewest shingles before it is the pivot. So every point is copied to the regions
   of all pivots whose ball its partners may reach, and two linked points meet in one region.
3. A point's distance to its pivots is bounded from below by bit sketches, and computed exactly where the
   bound leaves a link open. Points within the threshold are linked with the pivot; a region whose points
   are by now one connected group is done, and no pair of such a group is ever compared.
4. A region of more than REGION points is a metric space of its own and is split: SPLIT points outside the
   pivot's group become pivots of Voronoi regions; a point goes to its nearest pivot q and, as a point of
   the border, to every q' with d(x, q') - d(x, q) <= 2 threshold: by the triangle inequality a link has
   one end in its own region and the other in that region or in its border. Regions split again, until they
   are small or one group. Points that are all about as far from each other do not split (their copies
   would outnumber them); such a region is compared as it is.
5. In a region, points outside the pivot's group are compared with the points of other groups: only if
   distances to the pivot differ by no more than the threshold (triangle inequality), and if sizes, places
   in the windows and sketches allow a link; then exactly.

No link between different groups is lost, so the groups are exact; any order of shingles, pivots and sizes
give the same result. A hot set is one class; a shingle of many documents is last in the order, and a hot
region is read by sums and by joins that can be split only.

Defined cases: null text counts as empty; an empty set links with nothing and is its own component; a
null doc_id takes part in links, but its component is the least doc_id that is not null, else null;
repeated rows are equal sets; rows that share a doc_id but differ in text are separate. Columns beside
those named are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import read, small_batches, work_table
from tessera.llm.components import components
from tessera.llm.shingles import fingerprint, mix, sets_of

#: Shingles seen this often in the summaries are ranked last, the most frequent HOT_MOST of them at most
#: (8 MB). Any such list gives exact results; it only moves work away from pivots that many documents share.
HOT_LEAST, HOT_MOST, HOT_PART = 64, 1 << 20, 3
SUMMARY = 1 << 21
#: How often shingles in more than REGION windows are added to that list, and the windows taken anew.
REORDER = 2
#: Bits of a sketch, and of the second one of sets with more than SKETCH shingles.
SKETCH, WIDE = 1024, 8192
#: Points of a region that are compared without splitting it, pivots of a split, and splits within splits.
REGION, SPLIT, LEVELS = 1024, 8, 6


def frequent_shingles(docs: DataFrame, text: str, k: int) -> np.ndarray:
    """The most frequent shingles, rarest first, by summaries that each task makes of all its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def summary() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= HOT_PART
            return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["s", "c"])

        for batch in batches:
            for s in sets_of(batch.column(0), k):
                held.append(s)
                size += len(s)
                if size >= SUMMARY:
                    yield summary()
                    held, size = [], 0
        if held:
            yield summary()

    found = docs.select(F.col(text).alias("t")).mapInArrow(run, "s long, c long")
    top = found.groupBy("s").agg(F.sum("c").alias("c")).where(F.col("c") >= HOT_LEAST).orderBy(F.desc("c"), "s").limit(HOT_MOST)
    return top.toArrow().column("s").to_numpy().astype(np.int64)[::-1].view(np.uint64)


def ranked(hot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles by value, and the rank of each."""
    order = np.argsort(hot)
    return hot[order], order


def prefix_of(s: np.ndarray, hot: tuple[np.ndarray, np.ndarray], num: int, den: int) -> tuple[np.ndarray, int]:
    """The window of a set in the order of all shingles, and how many of it are not hot."""
    p, (values, rank) = window(len(s), num, den), hot
    if not len(values):
        return s[:p], min(p, len(s))
    at = np.minimum(np.searchsorted(values, s), len(values) - 1)
    is_hot = values[at] == s
    cold = s[~is_hot]
    if len(cold) >= p:
        return cold[:p], p
    last = s[is_hot][np.argsort(rank[at[is_hot]])]
    return np.concatenate([cold, last[: p - len(cold)]]), len(cold)


def window(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def sketch_of(s: np.ndarray, bits: int = SKETCH) -> np.ndarray:
    """For each bit the parity of the shingles that hit it: bits in which two sketches differ are no more
    than shingles in which the sets differ (an odd sketch), and do not fill up as the sets grow."""
    hits = np.bincount((mix(s, 3) % np.uint64(bits)).astype(np.int64), minlength=bits)
    return np.packbits((hits & 1).astype(bool)).view(np.int64)


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, num: int, den: int, hot: np.ndarray) -> DataFrame:
    """doc_id, key (of the row), n, fp1, fp2, prefix, cold (of the prefix), sketch, wide; a row for each
    row of docs."""
    blob = docs.sparkSession.sparkContext.broadcast(ranked(hot))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = 0, []
            for i, s in enumerate(sets_of(batch.column(2), k)):
                p, cold = prefix_of(s, blob.value, num, den) if len(s) else (s, 0)
                rows.append((len(s), *fingerprint(s), p.view(np.int64), cold, sketch_of(s), sketch_of(s, WIDE) if len(s) > SKETCH else None))
                if len(rows) >= 2000 or i + 1 == batch.num_rows:
                    n, fp1, fp2, prefix, cold, sketch, wide = zip(*rows, strict=True)
                    ends = np.cumsum([0, *map(len, prefix)])
                    columns = {
                        "doc_id": batch.column(0).slice(at, len(rows)), "key": batch.column(1).slice(at, len(rows)),
                        "n": pa.array(n, pa.int64()), "fp1": pa.array(fp1, pa.int64()), "fp2": pa.array(fp2, pa.int64()),
                        "prefix": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix))), "cold": pa.array(cold, pa.int32()),
                        "sketch": pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * (SKETCH // 64), pa.int32()), pa.array(np.concatenate(sketch))), "wide": pa.array(wide, pa.list_(pa.int64())),
                    }
                    yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
                    at, rows = i + 1, []

    return keyed(docs, doc_id, text).mapInArrow(run, "doc_id long, key long, n long, fp1 long, fp2 long, prefix array<long>, cold int, sketch array<long>, wide array<long>")


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, key (of the id and the text) and text."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t"))
    return rows.select("doc_id", F.xxhash64("doc_id", "t").alias("key"), "t")


def full_sets(docs: DataFrame, doc_id: str, text: str, k: int, wanted: DataFrame) -> DataFrame:
    """node, s: the whole sets of the rows in wanted (key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for i, s in enumerate(sets_of(batch.column(0), k)):
                held.append(s)
                size += len(s)
                if size >= 1 << 19 or i + 1 == batch.num_rows:
                    ends = np.cumsum([0, *map(len, held)])
                    yield pa.RecordBatch.from_arrays([pa.array([fingerprint(x)[0] for x in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).view(np.int64)))], names=["node", "s"])
                    held, size = [], 0

    return keyed(docs, doc_id, text).join(wanted, "key", "left_semi").select("t").mapInArrow(run, "node long, s array<long>")


def _apart(a: str, b: str, wide: bool = True):
    """A lower bound of the number of shingles in which two sets differ: by their sketches and sizes."""
    bits = reduce(add, [F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(SKETCH // 64)])
    if not wide:
        return F.greatest(bits.cast("long"), F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")))
    more = F.expr(f"case when {a}.wide is not null and {b}.wide is not null then aggregate(zip_with({a}.wide, {b}.wide, (p, q) -> bit_count(p ^ q)), 0, (t, v) -> t + v) else 0 end")
    return F.greatest(bits.cast("long"), more.cast("long"), F.abs(F.col(f"{a}.n") - F.col(f"{b}.n")))


def _distance(apart, total):
    """Jaccard distance of sets with `total` shingles together that differ in `apart`."""
    return 2.0 * apart / (total + apart)


class _Space:
    """The points of a join and what measures them."""

    def __init__(self, docs: DataFrame, sig: DataFrame, doc_id: str, text: str, k: int, num: int, den: int):
        self.source, self.num, self.den = (docs, doc_id, text, k), num, den
        self.threshold = 1.0 - num / den + 1e-9
        firsts = [F.first(c).alias(c) for c in ("prefix", "cold", "sketch", "wide")]
        self.classes = work_table(sig.where("n > 0").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.min("key").alias("key"), *firsts), "classes")
        least = -(-num // (den - num))  # smaller sets are linked with equal ones only
        self.nodes = self.classes.where(f"n >= {least}").withColumnRenamed("fp1", "node")
        self.side = self.nodes.select("node", F.struct("n", "sketch", "wide").alias("x"))
        self.linked = f"common * {den} >= (total - common) * {num}"

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with total, the sizes together, and apart, see _apart()."""
        pairs = pairs.join(self.side.toDF("a", "x"), "a").join(self.side.toDF("b", "y"), "b")
        return pairs.select("a", "b", (F.col("x.n") + F.col("y.n")).alias("total"), _apart("x", "y").alias("apart"))

    def measured(self, pairs: DataFrame) -> DataFrame:
        """pairs (a, b, total) with common, the number of shingles in both sets."""
        docs, doc_id, text, k = self.source
        ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = work_table(self.nodes.select("node", "key").join(ends, "node", "left_semi"), "ends")
        sets = full_sets(docs, doc_id, text, k, wanted.select("key")).join(wanted, "node", "left_semi").dropDuplicates(["node"])
        sets = work_table(sets.select("node", "s"), "sets")
        return pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")).cast("long")).drop("sa", "sb")

    def open(self, total: str = "total"):
        """Whether sets that differ in `apart` shingles may be linked."""
        return F.col("apart") * (self.den + self.num) <= F.col(total) * (self.den - self.num)


def windows(space: _Space) -> tuple[DataFrame, DataFrame]:
    """cells (cell, node, pos, cold) of the windows, and the pivot of each that two points share, with size."""
    cells = space.nodes.select("node", "cold", F.posexplode("prefix").alias("pos", "cell")).select("cell", "node", "pos", (F.col("pos") < F.col("cold")).alias("cold"))
    firsts = cells.groupBy("cell").agg(F.count("*").alias("size"), F.max("cold").alias("cold"), F.min(F.struct("pos", "node")).alias("first"))
    return cells, work_table(firsts.where("size > 1").select("cell", "size", "cold", F.col("first.node").alias("pivot")), "pivots")


def _mixed(level: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of level in regions of several groups, with g, out (of the pivot's group) and size."""
    found = groups.select("node", F.col("component").alias("g"))
    level = level.drop("g", "out", "size").join(found, "node", "left").join(found.toDF("pivot", "h"), "pivot", "left")
    level = level.withColumn("g", F.coalesce("g", "node")).withColumn("out", F.col("g") != F.coalesce("h", "pivot")).drop("h")
    sizes = level.groupBy("region").agg(F.count("*").alias("size"), F.max("out").alias("some"), F.min("g").alias("g0"), F.max("g").alias("g1"))
    return level.join(sizes.where("some and g0 < g1").select("region", "size"), "region")


def _split(space: _Space, large: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links with the new pivots, the Voronoi regions, and the rows of regions that do not split."""
    drawn = [F.min(F.struct(F.xxhash64("node", F.lit(j)).alias("at"), "node"))["node"] for j in range(SPLIT)]
    pivots = work_table(large.where("out").groupBy("region").agg(F.array_distinct(F.array(*drawn)).alias("q")), "split")
    spread = work_table(large.drop("g", "out", "home").join(pivots, "region").withColumn("drawn", F.array_contains("q", F.col("node"))).withColumn("q", F.explode("q")), "spread")
    pairs = spread.select(F.col("node").alias("a"), F.col("q").alias("b")).where("a != b").distinct()
    near = work_table(space.measured(space.bounded(pairs)), "measured")
    d = near.select(F.col("a").alias("node"), F.col("b").alias("q"), _distance(F.col("total") - 2 * F.col("common"), F.col("total")).alias("d"))
    own = Window.partitionBy("region", "node")
    at = spread.where("not drawn").join(d, ["node", "q"]).withColumn("least", F.min(F.struct("d", "q")).over(own))
    at = work_table(at.where(f"d - least.d <= {2 * space.threshold}"), "voronoi")
    # a region whose points go to nearly all pivots is left whole
    tight = at.groupBy("region").agg(F.count("*").alias("copies"), F.first("size").alias("size")).where("copies > 2 * size").select("region")
    parts = at.join(tight, "region", "left_anti").select(F.xxhash64("region", "q").alias("region"), "node", F.col("q").alias("pivot"), "pos", F.col("d").alias("lo"), F.col("d").alias("hi"), (F.col("q") == F.col("least.q")).alias("home"))
    whole = large.join(tight, "region", "left_semi").select("region", "node", "pivot", "pos", "lo", "hi", "home")
    return near.where(space.linked).select("a", "b"), parts, whole


def _compared(space: _Space, members: DataFrame) -> DataFrame:
    """Pairs (a, b) of members of one region and different groups that may be linked."""
    num, den, eps = space.num, space.den, space.threshold
    here = members.join(space.side.select("node", F.struct("x.n", "x.sketch").alias("x")), "node")
    here = work_table(here.select("region", "node", "pos", "g", "out", "lo", "hi", "home", "x"), "mixed")
    p = here.where("out").alias("p")
    q = here.select("region", *[F.col(c).alias(c + "2") for c in ("node", "pos", "g", "out", "lo", "hi", "home")], F.col("x").alias("y"))
    # shingles in common: none before the first that both have, which is where the windows say or later
    fits = F.expr(
        f"g != g2 and (not out2 or node < node2) and (home or home2) and lo - hi2 <= {eps} and lo2 - hi <= {eps} "
        f"and least(x.n, y.n) * {den} >= greatest(x.n, y.n) * {num} and least(x.n - pos, y.n - pos2) * {den + num} >= (x.n + y.n) * {num}"
    )
    near = _apart("x", "y", wide=False) * (den + num) <= (F.col("x.n") + F.col("y.n")) * (den - num)
    return p.join(q, (p["region"] == q["region"]) & fits & near).select(F.least("node", "node2").alias("a"), F.greatest("node", "node2").alias("b")).distinct()


def links(space: _Space, cells: DataFrame, pivots: DataFrame) -> DataFrame:
    """components (node, component) of the linked points; see the top."""
    regions = work_table(cells.join(pivots.select("cell", "pivot"), "cell").groupBy("pivot", "node").agg(F.min("pos").alias("pos")).where("pivot != node"), "regions")
    star = work_table(space.bounded(regions.select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "star")
    exact = work_table(space.measured(star.where(space.open()).drop("apart")), "exact")
    groups = work_table(components(exact.where(space.linked).select("a", "b")), "groups")

    far = star.where(~space.open()).select("a", "b", _distance(F.col("apart"), F.col("total")).alias("lo"), F.lit(1.0).alias("hi"))
    d = _distance(F.col("total") - 2 * F.col("common"), F.col("total"))
    known = exact.select("a", "b", d.alias("lo"), d.alias("hi")).unionByName(far).toDF("node", "pivot", "lo", "hi")
    level = regions.join(known, ["node", "pivot"]).select(F.col("pivot").alias("region"), "node", "pivot", "pos", "lo", "hi", F.lit(True).alias("home"))
    as_edges = lambda groups: groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
    done = []
    for depth in range(LEVELS + 1):
        level = work_table(_mixed(level, groups), f"level-{depth}")
        small = f"size <= {REGION}" if depth < LEVELS else "true"
        done.append(level.where(small).drop("g", "out", "size"))
        large = level.where(f"not ({small})")
        if large.isEmpty():
            break
        edges, level, whole = _split(space, large)
        done.append(whole)
        groups = work_table(components(as_edges(groups).unionByName(edges)), "groups")
    pairs = _compared(space, _mixed(reduce(DataFrame.unionByName, done), groups))
    more = work_table(space.bounded(pairs).where(space.open()), "pairs")
    if not more.isEmpty():
        groups = components(as_edges(groups).unionByName(space.measured(more).where(space.linked).select("a", "b")))
    return groups


def labelled(docs: DataFrame, k: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (of the row), n (size of the set), label (of the group; null if the set is empty) and
    component_id for each row of docs."""
    small_batches(docs.sparkSession)
    hot = frequent_shingles(docs, text, k)
    for again in range(REORDER + 1):
        sig = work_table(signatures(docs, doc_id, text, k, num, den, hot), "signatures")
        space = _Space(docs, sig, doc_id, text, k, num, den)
        cells, pivots = windows(space)
        # shingles that the summaries missed, and that more windows hold than a region should, are hot too
        missed = pivots.where(f"cold and size > {REGION}").orderBy("size", "cell").select("cell").limit(max(0, HOT_MOST - len(hot)))
        found = missed.toArrow().column("cell").to_numpy().astype(np.int64).view(np.uint64) if again < REORDER else ()
        if not len(found):
            break
        hot = np.concatenate([found, hot])
    groups = links(space, cells, pivots).select(F.col("node").alias("fp1"), F.col("component").alias("label"))
    classes = work_table(space.classes.select("fp1", "fp2", "rep").join(groups, "fp1", "left"), "labels")
    least = work_table(classes.where("label is not null").groupBy("label").agg(F.min("rep").alias("least")), "least")
    classes = classes.join(least, "label", "left").select("fp1", "fp2", F.coalesce("label", "fp1").alias("label"), F.coalesce("least", "rep").alias("component_id"))
    return sig.select("doc_id", "key", "n", "fp1", "fp2").join(classes, ["fp1", "fp2"], "left").select("doc_id", "key", "n", "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs: documents whose sets of k-word shingles have
    a Jaccard similarity of num / den or more are linked."""
    return labelled(docs, k, num, den, doc_id, text).select(F.col("doc_id").alias(doc_id), F.col("n").alias("n_shingles"), "component_id")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group stays, that of the least doc_id, null last (of several such
    rows, the one whose text hash and row come first). Groups: shingles of five words, similarity 0.8.
    Rows are told apart by id and text. Documents without words are in no group and stay, repeated rows of
    them too."""
    rows = labelled(docs, k=5, num=80, den=100).where("n > 0")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))["key"].alias("__key")).select("__key")
    text = F.col("text").cast("string")
    filled = F.coalesce(text, F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    once = Window.partitionBy("__key").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    whole = docs.where(filled).withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), text))
    whole = whole.withColumn("__row", F.row_number().over(once)).where("__row = 1").join(first, "__key", "left_semi")
    return docs.where(~filled).unionByName(whole.drop("__row", "__key"))
