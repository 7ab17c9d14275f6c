"""A catalog of collections on shared storage: configuration, aliases, declared fields, shard keys,
snapshots and request limits. All files go through Hadoop's file systems, so any store that Spark reads works.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import Tokenizer
from tessera.plans.collection import Collection, Vector
from tessera.sources.files import replace_file

FIELD_TYPES = ("keyword", "integer", "float", "geo", "text", "bool", "datetime", "uuid")


@dataclass
class StrictMode:
    """Limits on requests; None: no limit."""

    max_query_limit: int | None = None
    max_timeout: int | None = None
    search_max_ef: int | None = None
    max_conditions: int | None = None
    unindexed_filtering: bool = True
    max_batch: int | None = None
    max_upsert: int | None = None
    read_rate: int | None = None
    write_rate: int | None = None

    def check_batch(self, requests: list[dict], indexed: set[str] = frozenset()) -> None:
        if self.max_batch is not None and len(requests) > self.max_batch:
            raise ValueError(f"more than {self.max_batch} requests at once")
        for r in requests:
            self.check(r, indexed)

    def check_update(self, kind: str, body: dict) -> None:
        """Points of an upsert, in row or columnar form."""
        many = len(body.get("points") or (body.get("batch") or {}).get("ids") or ())
        if self.max_upsert is not None and kind == "upsert" and many > self.max_upsert:
            raise ValueError(f"more than {self.max_upsert} points in an upsert")

    def check(self, request: dict, indexed: set[str] = frozenset()) -> None:
        limit = request.get("limit", 10)
        if self.max_query_limit is not None and (limit is None or limit > self.max_query_limit):
            raise ValueError(f"limit is above {self.max_query_limit}")
        if self.max_timeout is not None and request.get("timeout", 0) > self.max_timeout:
            raise ValueError(f"timeout is above {self.max_timeout}")
        if self.search_max_ef is not None and (request.get("params") or {}).get("hnsw_ef", 0) > self.search_max_ef:
            raise ValueError(f"ef is above {self.search_max_ef}")
        keys = list(conditions(request.get("filter")))
        if self.max_conditions is not None and len(keys) > self.max_conditions:
            raise ValueError(f"more than {self.max_conditions} conditions")
        if not self.unindexed_filtering and (bad := {k for k in keys if k is not None} - set(indexed)):
            raise ValueError(f"no index on {sorted(bad)}")
        for p in request.get("prefetch") or []:
            self.check(p, indexed)


class Rate:
    """A bucket of `per_minute` tokens that fills evenly; a request takes what it costs or is refused."""

    def __init__(self, per_minute: int, clock=time.monotonic):
        self.per_minute, self.clock, self.left, self.at = per_minute, clock, float(per_minute), clock()

    def take(self, cost: int = 1) -> None:
        now = self.clock()
        self.left = min(float(self.per_minute), self.left + (now - self.at) * self.per_minute / 60)
        self.at = now
        if cost > self.left:
            raise RuntimeError(f"more than {self.per_minute} requests a minute")
        self.left -= cost


def conditions(spec):
    """The key, or None, of each condition in a filter."""
    for clause in ("must", "should", "must_not"):
        found = (spec or {}).get(clause) or []
        for c in found if isinstance(found, list) else [found]:
            if set(c) & {"must", "should", "must_not", "min_should"}:
                yield from conditions(c)
            elif "nested" in c:
                yield from conditions(c["nested"]["filter"])
            else:
                yield c.get("key")
    for c in ((spec or {}).get("min_should") or {}).get("conditions", []):
        yield c.get("key")


@dataclass
class Config:
    id: str
    vectors: dict[str, dict] = field(default_factory=dict)
    payload: str | None = None
    fields: dict[str, dict] = field(default_factory=dict)
    shard: str | None = None
    shard_keys: list = field(default_factory=list)
    read_only: bool = False
    strict: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)


class Catalog:
    """A directory: <collection>/config.json and <collection>/data-<version>/, and aliases.json."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._rates: dict[tuple[str, str], Rate] = {}

    def _take(self, name: str, kind: str, per_minute: int | None, cost: int = 1) -> None:
        if per_minute is not None:
            rate = self._rates.get((name, kind))
            if rate is None or rate.per_minute != per_minute:
                rate = self._rates[name, kind] = Rate(per_minute)
            rate.take(cost)

    def _at(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _read(self, name: str, default=None):
        p, fs = self._at(name)
        return json.loads(self.spark.read.text(p.toString(), wholetext=True).first()[0]) if fs.exists(p) else default

    def _write(self, name: str, value) -> None:
        replace_file(self.spark, f"{self.path}/{name}", json.dumps(value))

    def _name(self, name: str) -> str:
        return (self._read("aliases.json", {}) or {}).get(name, name)

    def _config(self, name: str) -> dict:
        found = self._read(f"{self._name(name)}/config.json")
        if found is None:
            raise KeyError(f"no collection {name}")
        return found

    def create(self, name: str, points: DataFrame, config: Config) -> None:
        if self._read(f"{name}/config.json") is not None:
            raise ValueError(f"collection {name} exists")
        self._store(name, points, asdict(config))

    def _store(self, name: str, points: DataFrame, config: dict) -> None:
        version = f"data-{uuid.uuid4().hex}"
        writer = points.write
        if config["shard"]:
            writer = points.repartition(config["shard"]).write.partitionBy(config["shard"])
        writer.parquet(f"{self.path}/{name}/{version}")
        self._write(f"{name}/config.json", {**config, "version": version})

    def replace(self, name: str, points: DataFrame) -> None:
        """A new version of the points; readers of the old one are not disturbed."""
        config = self._config(name)
        if config["read_only"]:
            raise PermissionError(f"{name} is routed by a static policy and takes no writes")
        self._take(self._name(name), "write", self.strict(name).write_rate)
        self._store(self._name(name), points, config)

    def drop(self, name: str) -> None:
        p, fs = self._at(self._name(name))
        fs.delete(p, True)
        self._write("aliases.json", {a: c for a, c in (self._read("aliases.json", {}) or {}).items() if c != self._name(name)})

    def names(self) -> list[str]:
        root, fs = self._at("")
        return sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(self._at(f"{s.getPath().getName()}/config.json")[0]))

    def open(self, name: str) -> Collection:
        c = self._config(name)
        tokenizers = {k: Tokenizer(**{x: tuple(y) if isinstance(y, list) else y for x, y in (f.get("params") or {}).items()}) for k, f in c["fields"].items() if f["type"] == "text"}
        points = self.spark.read.parquet(f"{self.path}/{self._name(name)}/{c['version']}")
        return Collection(points, c["id"], {n: Vector(**v) for n, v in c["vectors"].items()}, c["payload"], tokenizers, frozenset(c["fields"]), c["shard"])

    def strict(self, name: str) -> StrictMode:
        return StrictMode(**self._config(name)["strict"])

    def query(self, name: str, request: dict) -> DataFrame:
        strict = self.strict(name)
        strict.check(request, set(self._config(name)["fields"]))
        self._take(self._name(name), "read", strict.read_rate)
        return self.open(name).query(request)

    def query_batch(self, name: str, requests: list[dict]) -> DataFrame:
        strict = self.strict(name)
        strict.check_batch(requests, set(self._config(name)["fields"]))
        self._take(self._name(name), "read", strict.read_rate, len(requests))
        return self.open(name).query_batch(requests)

    def aliases(self, actions: list[dict]) -> None:
        """create, rename and delete, all or nothing."""
        now = self._read("aliases.json", {}) or {}
        for a in actions:
            ((kind, arg),) = a.items()
            if kind == "create":
                self._config(arg["collection"])
                now[arg["alias"]] = arg["collection"]
            elif kind == "rename":
                now[arg["new"]] = now.pop(arg["old"])
            elif kind == "delete":
                now.pop(arg["alias"])
            else:
                raise ValueError(f"no alias action {kind}")
        self._write("aliases.json", now)

    def declare(self, name: str, path: str, kind: str, **params) -> None:
        """A typed field: allows strict-mode filters on it, and makes text match by tokens."""
        if kind not in FIELD_TYPES:
            raise ValueError(f"no field type {kind}")
        c = self._config(name)
        c["fields"][path] = {"type": kind, "params": params}
        self._write(f"{self._name(name)}/config.json", c)

    def undeclare(self, name: str, path: str) -> None:
        c = self._config(name)
        c["fields"].pop(path, None)
        self._write(f"{self._name(name)}/config.json", c)

    def create_shard_key(self, name: str, key) -> None:
        c = self._config(name)
        if key in c["shard_keys"]:
            raise ValueError(f"shard key {key} exists")
        c["shard_keys"].append(key)
        self._write(f"{self._name(name)}/config.json", c)

    def drop_shard_key(self, name: str, key) -> None:
        """The key and all of its points."""
        c = self._config(name)
        c["shard_keys"].remove(key)
        points = self.open(name).points.where(~F.col(c["shard"]).eqNullSafe(F.lit(key)))
        self._store(self._name(name), points, c)

    def reshard(self, name: str, shards: int) -> None:
        from tessera.operators.routing import hash_shard

        c = self._config(name)
        c["shard"] = c["shard"] or "_shard"
        c["shard_keys"] = list(range(shards))
        points = self.open(name).points.drop(c["shard"]).withColumn(c["shard"], hash_shard(F.col(c["id"]), shards))
        self._store(self._name(name), points, c)

    def snapshot(self, name: str) -> str:
        """A copy of the points and their configuration under snapshots/; returns its name."""
        c, key = self._config(name), uuid.uuid4().hex
        self.open(name).points.write.parquet(f"{self.path}/snapshots/{key}/data")
        self._write(f"snapshots/{key}/config.json", c)
        return key

    def restore(self, key: str, name: str) -> None:
        c = self._read(f"snapshots/{key}/config.json")
        self._store(name, self.spark.read.parquet(f"{self.path}/snapshots/{key}/data"), c)

    def manifest(self, name: str) -> dict[str, int]:
        """The data files of the current version and their sizes."""
        c = self._config(name)
        root, fs = self._at(f"{self._name(name)}/{c['version']}")
        files, out = fs.listFiles(root, True), {}
        base = fs.makeQualified(root).toUri().getPath()
        while files.hasNext():
            f = files.next()
            out[f"{c['version']}{f.getPath().toUri().getPath().removeprefix(base)}"] = f.getLen()
        return out

    def partial_snapshot(self, name: str, have: dict[str, int]) -> dict[str, list[str]]:
        """What a holder of the files in `have` must fetch and may drop to hold the current version."""
        now = self.manifest(name)
        return {"fetch": sorted(f for f, n in now.items() if have.get(f) != n), "drop": sorted(f for f in have if f not in now)}

    def compact(self, name: str, rows_per_file: int = 1_000_000) -> None:
        """Rewrites small files."""
        points = self.open(name).points
        self._store(self._name(name), points.repartition(max(1, -(-points.count() // rows_per_file))), self._config(name))
