"""Operator 2, SentencePiece encoding and decoding with sampled segmentations: Gumbel top-k without
replacement, by a perturbed A-star search over the lattice of pieces.

The vocabulary is a given .model file (its path is a parameter). A text is prepared as the model says
(spaces as U+2581, one of them in front). The lattice has an arc for each piece of the vocabulary that
matches, and for a character outside it one arc of its UTF-8 bytes' pieces. The model's scores are ranks,
-r; by Zipf's law an arc weighs (r + 2) ** -alpha, a byte 1 / 32,000 ** alpha. A segmentation's probability is its
weight's share of all segmentations', with exact sums from the right (the heuristic of the search).

The search: a node is a set of segmentations (a path so far, and arcs excluded at its end) with its log
probability and the largest Gumbel-perturbed log probability of its members. The best node is taken, its best member
is drawn by the exact conditional probabilities, and the rest of the set is split where it leaves that
path, with Gumbel values truncated by the node's. The k nodes taken first are a sample of k distinct
segmentations without replacement, in the order of their perturbed values. With the (k + 1)-th value t, a
segmentation's inclusion score is 1 - exp(-exp(log p - t)); its logarithm is returned (0 where fewer than
k + 1 exist: all are included). All random numbers are hashes of the row's key, the seed and the place in
the search, so results do not depend on batches, partitions or repeated tasks.

No piece crosses from a character to a following space, or a line break, so all words of a batch share lattices. Decoding
is the model's own. Defined cases: a null or empty text has one segmentation, of no pieces (SentencePiece
puts no space in front of nothing); a null key is a key of its own; repeated rows give equal samples; an
empty table gives no rows; columns beside those named are passed over. U+2581 in a text decodes as a space.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import read
from tessera.llm.shingles import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SAMPLES, ALPHA, SEED = 2, 1.0, 0
#: Characters of the texts that are searched together (or one text), and arcs of the lattices kept for the next.
CHUNK, KEPT = 1 << 18, 6 << 20
_BASE, _SPREAD = np.uint64(0x9E3779B97F4A7C13), np.uint64(0xD6E8FEB86659FD93)


def _uniform(key: np.ndarray, *places) -> np.ndarray:
    """In (0, 1), by a hash of a key and numbers."""
    x = key
    for p in places:
        x = mix(x ^ mix(np.asarray(p, np.uint64), 7), 5)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Vocabulary:
    def __init__(self, model: str = MODEL, alpha: float = ALPHA):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        n = self.model.get_piece_size()
        normal = [i for i in range(n) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_unused(i))]
        texts = [self.model.id_to_piece(i) for i in normal]
        weight = [-alpha * math.log(min(-self.model.get_score(i), n) + 2) for i in normal]
        self.longest = max(map(len, texts))
        if any("\n" in t for t in texts):
            raise ValueError("a piece crosses a line break")
        # every beginning of a piece, and which of them are pieces
        table = {h: (-1, -np.inf) for t in texts for h in self._hashes(t)}
        table |= {self._hashes(t)[-1]: (i, w) for t, i, w in zip(texts, normal, weight, strict=True)}
        if len(table) != len({t[:n] for t in texts for n in range(1, len(t) + 1)}):
            raise ValueError("two beginnings have the same hash")
        self.hashes = np.array(sorted(table), np.uint64)
        self.ids = np.array([table[int(h)][0] for h in self.hashes], np.int32)
        self.weights = np.array([table[int(h)][1] for h in self.hashes])
        # where the search for a hash begins; the next slots follow, and -1 ends it
        bits = len(self.hashes).bit_length() + 2
        self.to_slot = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + len(self.hashes), -1, np.int32)
        for i, slot in enumerate(self._slot(self.hashes).tolist()):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = i
        self.byte_weight = -alpha * math.log(n)
        self.bytes = [self.model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * _SPREAD) >> self.to_slot).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of the beginnings with these hashes, -1 for none."""
        slot = self._slot(h)
        i = self.slots[slot]
        on = np.flatnonzero((i >= 0) & (self.hashes[i] != h))
        while len(on):
            slot[on] += 1
            x = self.slots[slot[on]]
            i[on] = x
            on = on[(x >= 0) & (self.hashes[x] != h[on])]
        return i

    @staticmethod
    def _hashes(piece: str) -> list[int]:
        out, h = [], 0
        for c in piece:
            h = (h * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            out.append(h)
        return out

    def prepare(self, text: str) -> str:
        return "▁" + text.replace(" ", "▁") if text else ""

    def decode(self, ids: Sequence[int]) -> str:
        return self.model.decode(ids if isinstance(ids, np.ndarray) else list(ids))


@cache
def vocabulary_of(model: str = MODEL, alpha: float = ALPHA) -> Vocabulary:
    """One for each Python worker."""
    return Vocabulary(model, alpha)


class Lattices:
    """The lattices of units, one after another, as their arcs in the order of places and lengths. A place is
    known by its first arc, a unit by that of its first place. Units of earlier calls are kept until they take
    KEPT arcs."""

    # cdf and log_p: within the place. arc_id: a piece, or -1 - c for the bytes of character c. goes: the place
    # behind it, -1 for the unit's end. rank: the number in its place
    FIELDS = (("cdf", np.float32), ("log_p", np.float64), ("arc_id", np.int32), ("goes", np.int64), ("rank", np.uint16))

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}  # unit as UTF-32 -> its first place
        self.used = 0  # the arrays have room for more
        for name, kind in self.FIELDS:
            setattr(self, name, np.zeros(1, kind))

    def _put(self, new: list[np.ndarray]) -> None:
        """Writes arcs behind the others, and leaves one more behind them."""
        n = self.used + len(new[0])
        for (name, kind), values in zip(self.FIELDS, new, strict=True):
            old = getattr(self, name)
            if n + 1 > len(old):
                whole = np.zeros(max(len(old) * 2, n + 1), kind)
                whole[: self.used] = old[: self.used]
                setattr(self, name, whole)
            getattr(self, name)[self.used : n] = values
        self.used = n

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The first places of all units, and where each text's begin among them."""
        if self.used > KEPT:
            self.clear()
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum(np.array([len(t) for t in texts], np.int64))])
        if not len(codes):
            return np.empty(0, np.int64), begins
        # a unit begins with a text, with a line break and behind it, and with a run of spaces
        is_line, is_space = codes == 10, codes == 0x2581
        cut = is_line.copy()
        cut[begins[:-1][begins[1:] > begins[:-1]]] = True
        cut[1:] |= is_line[:-1]
        cut[1:] |= is_space[1:] & ~is_space[:-1]
        at = np.append(np.flatnonzero(cut), len(codes))
        kinds = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(codes)]).dictionary_encode()
        _, ends, data = kinds.dictionary.buffers()
        data = data.to_pybytes()
        units = [data[a:b] for a, b in itertools.pairwise(np.frombuffer(ends, np.int64, len(kinds.dictionary) + 1).tolist())]
        known = self.index.get
        of = np.array([known(u, -1) for u in units], np.int64)
        if len(gaps := np.flatnonzero(of < 0)):
            of[gaps] = self._extend([units[i] for i in gaps.tolist()])
        return of[kinds.indices.to_numpy()], np.searchsorted(at, begins)

    def _extend(self, units: list[bytes]) -> np.ndarray:
        """Adds units, and returns their first places."""
        v = self.v
        lengths = np.array([len(u) for u in units], np.int64) >> 2
        ends = np.cumsum(lengths)
        codes = np.frombuffer(b"".join(units), np.uint32).astype(np.uint64)
        n = len(codes)
        rest = np.repeat(ends, lengths) - np.arange(n)
        count, found = np.zeros(n, np.uint16), []
        live, h = np.arange(n), np.zeros(n, np.uint64)
        for k in range(v.longest):  # only beginnings of pieces go on
            if k:
                more = np.flatnonzero(rest[live] > k)
                live, h = live[more], h[more]
            if not len(live):
                break
            h = h * _BASE + (codes[live + k] + np.uint64(1))
            i = v.find(h)
            hit = np.flatnonzero(i >= 0)
            live, h, i = live[hit], h[hit], i[hit]
            is_piece = np.flatnonzero(v.ids[i] >= 0)
            place, i = live[is_piece], i[is_piece]
            found.append((place, k + 1, count[place], v.ids[i], v.weights[i]))
            count[place] += 1
            if not k:
                alone = np.flatnonzero(count == 0)  # by bytes
                c = codes[alone].astype(np.int64)
                size = np.select([c < 0x80, c < 0x800, c < 0x10000], [1, 2, 3], 4)
                found.append((alone, 1, count[alone], -1 - c, v.byte_weight * size))
                count[alone] = 1
        first = np.append(np.cumsum(count, dtype=np.int64) - count, 0)
        total_arcs = int(count.sum(dtype=np.int64))
        arc_id, weight, length = np.empty(total_arcs, np.int32), np.empty(total_arcs), np.empty(total_arcs, np.uint16)
        for place, size, rank, ids, weights in found:
            at = first[place] + rank
            arc_id[at], weight[at], length[at] = ids, weights, size
        # from the ends of the units on: exact sums, and each place's cumulated probabilities
        places = np.argsort(rest.astype(np.uint16) if rest.max() < 1 << 16 else rest, kind="stable")
        bounds = np.searchsorted(rest[places], np.arange(1, int(rest.max()) + 2))
        counts = count[places].astype(np.int64)
        starts = np.append(0, np.cumsum(counts))
        ranks = np.arange(total_arcs) - np.repeat(starts[:-1], counts)
        by = np.repeat(first[places], counts) + ranks
        end = np.repeat(places, counts) + length[by]
        last = length[by] == np.repeat(rest[places], counts)
        end[last] = n
        total, w, e, mass = np.zeros(n + 1), weight[by], np.empty(total_arcs), np.empty(n)
        for p, q in itertools.pairwise(bounds.tolist()):
            a, b = starts[p], starts[q]
            segments, times = starts[p:q] - a, counts[p:q]
            x = w[a:b]
            x += total[end[a:b]]
            top = np.maximum.reduceat(x, segments)
            y = np.exp(x - np.repeat(top, times), out=e[a:b])
            m = np.add.reduceat(y, segments)
            mass[p:q] = m
            total[places[p:q]] = top + np.log(m)
        w -= np.repeat(total[places], counts)
        ranks = np.append(ranks, 0)
        on, r = np.flatnonzero(ranks == 1), 1
        while len(on):
            e[on] += e[on - 1]
            on, r = on + 1, r + 1
            on = on[ranks[on] == r]
        e /= np.repeat(mass, counts)
        e[starts[1:] - 1] = 1.0
        cdf, log_p, goes, rank = np.empty(total_arcs, np.float32), np.empty(total_arcs), np.empty(total_arcs, np.int64), np.empty(total_arcs, np.uint16)
        cdf[by], log_p[by], rank[by] = e, w, ranks[:-1]
        goes[by] = np.where(last, -1, first[end] + self.used)
        begins = first[ends - lengths] + self.used
        self.index.update(zip(units, begins.tolist(), strict=True))
        self._put([cdf, log_p, arc_id, goes, rank])
        return begins

    def arcs(self, place: int) -> np.ndarray:
        """The log probabilities of the arcs of one place."""
        n = int((self.rank[place + 1 : place + 1 + self.v.longest] == 0).argmax()) + 1
        return self.log_p[place : place + n]

    def walk(self, start: np.ndarray, key: np.ndarray, unit: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
        """Paths from the places `start` (-1: none) to their units' ends: how many arcs each has, and the arcs.
        key: mixed already."""
        row = np.flatnonzero(start >= 0)
        arc, count, steps = start[row], np.zeros(len(start), np.int64), []
        number = mix(np.arange(int(unit.max(initial=0)) + 1, dtype=np.uint64), salt)
        base = mix(key[row] ^ number[unit[row]], 13)
        while len(row):
            u = _uniform(base, len(steps))
            on = np.flatnonzero(self.cdf[arc] < u)
            if len(on):
                at, limit = arc[on], u[on]
                while True:
                    at += 1
                    more = self.cdf[at] < limit
                    if not more.any():
                        arc[on] = at
                        break
                    stays = ~more
                    arc[on[stays]] = at[stays]
                    on, at, limit = on[more], at[more], limit[more]
            count[row] += 1
            steps.append((row, arc))
            arc = self.goes[arc]
            live = np.flatnonzero(arc >= 0)
            row, arc, base = row[live], arc[live], base[live]
        first = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int64)
        for step, (row, arc) in enumerate(steps):
            out[first[row] + step] = arc
        return count, out

    def ids(self, arc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of arcs, and for each arc and the end where its ids begin."""
        out = self.arc_id[arc]
        times = np.ones(len(out), np.int64)
        alone = np.flatnonzero(out < 0)
        kinds, which = np.unique(-1 - out[alone], return_inverse=True)
        spelled = [[self.v.bytes[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in kinds.tolist()]
        times[alone] = np.array([len(x) for x in spelled], np.int64)[which]
        begins = np.append(0, np.cumsum(times))
        if len(alone):
            out = np.repeat(out, times)
            for j in range(4):
                has = times[alone] > j
                out[begins[alone[has]] + j] = np.array([x[j] if j < len(x) else -1 for x in spelled], np.int32)[which[has]]
        return out, begins


class _Search:
    """The search over one text's segmentations; its walks are made together with those of other texts. A path
    has each arc's unit, its arcs, and the log probability before each arc and at the end."""

    __slots__ = ("done", "heap", "paths", "units")

    def __init__(self, units: np.ndarray, root: float):
        self.units = units
        self.heap: list[tuple] = [(-root, 0, -1, 0, ())]
        self.paths: list[tuple] = []
        self.done: list[tuple[float, float]] = []


def sample(vocabulary: Vocabulary, texts: list[str | None], keys: Sequence[int], k: int = SAMPLES, seed: int = SEED, lattices: Lattices | None = None) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to k samples (ids, log probability, perturbed log probability, log inclusion score)."""
    lattices = lattices or Lattices(vocabulary)
    places, cut = lattices.add([vocabulary.prepare(t or "") for t in texts])
    seeds = mix(np.array([x & 0xFFFFFFFFFFFFFFFF for x in keys], np.uint64), seed + 17)
    roots = -np.log(-np.log(_uniform(seeds, 1 << 40)))
    searches = [_Search(places[a:b], g) for (a, b), g in zip(itertools.pairwise(cut.tolist()), roots.tolist(), strict=True)]
    for turn in range(k):
        todo, start, begins = [], [], []
        draws = _uniform(seeds, turn, 1 << 41)
        for n, s in enumerate(searches):
            if not s.heap or not len(s.units):
                continue
            value, _, parent, j, excluded = heapq.heappop(s.heap)
            if parent < 0:
                head, begin, places = None, 0, s.units
            else:
                unit_of, arcs, _ = s.paths[parent]
                begin, arc = int(unit_of[j]), int(arcs[j])
                first = arc - int(lattices.rank[arc])
                share = np.exp(lattices.arcs(first))
                share[list(excluded)] = 0.0
                u = float(draws[n]) * share.sum()
                new = min(int((np.cumsum(share) < u).sum()), len(share) - 1)
                while not share[new]:
                    new -= 1
                share[new] = 0.0
                head = (parent, j, first + new, (*excluded, new), share.sum())
                places = s.units[begin:].copy()
                places[0] = lattices.goes[first + new]
            todo.append((n, value, head))
            start.append(places)
            begins.append(begin)
        if not todo:
            break
        owner = np.array([len(x) for x in start])
        first = np.cumsum(owner) - owner
        unit = np.arange(int(owner.sum())) + np.repeat(np.array(begins) - first, owner)
        own = seeds[[x[0] for x in todo]]
        count, arc = lattices.walk(np.concatenate(start), np.repeat(mix(own, 11), owner), unit, turn + 1)
        unit_at = np.repeat(unit.astype(np.int32), count)
        cut = np.append(0, np.cumsum(count))[np.append(first, len(unit))]
        log_p = lattices.log_p[arc]
        before, shift, split = np.empty(len(arc)), [], []
        for (n, value, head), a, b in zip(todo, *(x.tolist() for x in (cut[:-1], cut[1:])), strict=True):
            s = searches[n]
            if head is None:
                sums = np.zeros(b - a + 1)
                np.cumsum(log_p[a:b], out=sums[1:])
                path = (unit_at[a:b], arc[a:b], sums)
                before[a:b] = sums[:-1]
                shift.append(-a)
            else:
                parent, j, new, _, left = head
                old = s.paths[parent]
                sums = np.concatenate([old[2][j : j + 1], lattices.log_p[new : new + 1], log_p[a:b]])
                np.cumsum(sums, out=sums)
                before[a:b] = sums[1:-1]
                path = (np.concatenate([old[0][: j + 1], unit_at[a:b]]), np.concatenate([old[1][:j], [new], arc[a:b]]), np.concatenate([old[2][:j], sums]))
                shift.append(j + 1 - a)
                split.append((j, float(path[2][j]), left))
            s.paths.append(path)
            s.done.append((float(path[2][-1]), -value))

        def perturbed(key: np.ndarray, steps: np.ndarray, mass: np.ndarray, value: np.ndarray, turn: int = turn) -> np.ndarray:
            e = -np.log(_uniform(key, turn, 1 << 42, steps))
            return mass - np.log(np.exp(np.minimum(mass + value, 700.0)) + e)

        # what leaves the paths at each step, from the nodes' own steps on
        other = -np.expm1(log_p)
        at = np.flatnonzero(other > 1e-13)
        inside = np.searchsorted(at, cut)
        times = np.diff(inside)
        values = np.array([x[1] for x in todo])
        step = at + np.repeat(np.array(shift), times)
        gumbel = perturbed(np.repeat(own, times), step, before[at] + np.log(other[at]), np.repeat(values, times))
        places_at = arc[at]
        out_at = lattices.rank[places_at]
        for (n, _, head), a, b in zip(todo, *(x.tolist() for x in (inside[:-1], inside[1:])), strict=True):
            s, g, most = searches[n], gumbel[a:b], k - turn
            last = len(s.paths) - 1
            best = range(b - a) if b - a <= most else [int(g.argmax())] if most == 1 else np.argpartition(g, -most)[-most:].tolist()
            for x in best:
                heapq.heappush(s.heap, (-float(g[x]), last + 1, last, int(step[a + x]), (int(out_at[a + x]),)))
        if split:
            mine = [i for i, x in enumerate(todo) if x[2] is not None]
            j, sums, left = (np.array(x) for x in zip(*split, strict=True))
            some = np.flatnonzero(left > 1e-13)
            mine = np.array(mine)[some]
            g = perturbed(own[mine], j[some], sums[some] + np.log(left[some]), values[mine])
            for i, x in zip(mine.tolist(), g.tolist(), strict=True):
                n, _, (_, j, _, gone, _) = todo[i]
                s = searches[n]
                heapq.heappush(s.heap, (-x, len(s.paths), len(s.paths) - 1, j, gone))
    paths = [p[1] for s in searches for p in s.paths]
    ids, begins = lattices.ids(np.concatenate([np.empty(0, np.int64), *paths]))
    cut = begins[np.cumsum([0, *map(len, paths)])].tolist()
    result, done = [], 0
    for s in searches:
        if not len(s.units):
            result.append([(np.empty(0, np.int32), 0.0, 0.0, 0.0)])
            continue
        limit = -s.heap[0][0] if s.heap else -math.inf
        out = []
        for log_p, value in s.done:
            x = log_p - limit
            q = 0.0 if x > 5 else math.log(-math.expm1(-math.exp(x))) if x > -30 else x
            out.append((ids[cut[done] : cut[done + 1]], log_p, value, q))
            done += 1
        result.append(out)
    return result


def _chunks(texts: list[str | None], keys: list[int]) -> Iterator[tuple[list, list]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK):
            size += len(texts[j] or "")
            j += 1
        yield texts[i:j], keys[i:j]
        i = j


def _keyed(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.xxhash64(F.col(key), F.lit(2)).alias("h"), F.col(text).cast("string").alias("t"))


def encode(df: DataFrame, key: str, text: str, k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED, model: str = MODEL) -> DataFrame:
    """key, sample (from 1), ids, log_prob, perturbed, log_inclusion: k rows for each row, or as many as
    there are segmentations."""
    rows = _keyed(df, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of(model, alpha)
        lattices = Lattices(vocabulary)
        for batch in batches:
            at = 0
            for texts, keys in _chunks(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                found = sample(vocabulary, texts, keys, k, seed, lattices)
                flat = [(at + i, n, *x) for i, xs in enumerate(found) for n, x in enumerate(xs, 1)]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in flat], pa.int32())), *[pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64()), 1)]], names=["key", "sample", "ids", "log_prob", "perturbed", "log_inclusion"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, sample int, ids array<int>, log_prob double, perturbed double, log_inclusion double").withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str = "ids", model: str = MODEL) -> DataFrame:
    """df with the column decoded, the text of its ids (null for null)."""

    @F.pandas_udf("string")
    def text(column):
        own = sentencepiece.SentencePieceProcessor(model_file=model)
        return column.map(lambda x: None if x is None else own.decode([int(i) for i in x]))

    return df.withColumn("decoded", text(ids))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each sample of each document: the digest of its ids, and whether they decode to the text."""
    rows = _keyed(read(spark, sf_dir, "documents"), "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_of()
        lattices = Lattices(vocabulary)
        for batch in batches:
            at = 0
            for texts, keys in _chunks(batch.column(2).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for i, (text, found) in enumerate(zip(texts, sample(vocabulary, texts, keys, lattices=lattices), strict=True)):
                    for n, (ids, log_p, value, inclusion) in enumerate(found, 1):
                        digest = hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest()
                        out.append((at + i, n, len(ids), digest, vocabulary.decode(ids) == (text or ""), log_p, value, inclusion))
                at += len(texts)
                types = (pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([x[0] for x in out], pa.int32())), *[pa.array([x[i] for x in out], t) for i, t in enumerate(types, 1)]], names=["doc_id", "sample", "n_pieces", "ids_sha256", "decodes", "log_prob", "perturbed", "log_inclusion"])

    return rows.mapInArrow(run, "doc_id long, sample int, n_pieces long, ids_sha256 string, decodes boolean, log_prob double, perturbed double, log_inclusion double")
