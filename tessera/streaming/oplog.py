"""Changes of a collection: an ordered log of operations over a versioned state table.

State: id (a long, or text for UUIDs), version, payload (JSON text), one column for each named vector.
Operations are rows (op_num, kind, body); `apply_op` composes one as DataFrame changes on the state, `replay` a
batch of them in order. In `replay_log` the points of plain upserts stay in Spark: a run of upserts without
another operation in between is one join with the newest row of each id; other operations, which name ids, a
filter or a payload, come to the driver. `OpLog` runs a file stream through foreachBatch: each batch makes a new directory of state and then swaps
a pointer file, so that readers and repeated batches see whole versions only. An operation older than or
equal to a point's version does nothing, so replays change nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.predicates import Context, compile_filter
from tessera.sources.files import replace_file
from tessera.sources.points import canonical_id, point_id
from tessera.streaming.payloads import delete_json, merge_json

LOG_SCHEMA = "op_num long, kind string, body string"


def state_schema(vectors: list[str], id_type: str = "long") -> T.StructType:
    fields = [T.StructField("id", T.StringType() if id_type == "string" else T.LongType()), T.StructField("version", T.LongType()), T.StructField("payload", T.StringType())]
    return T.StructType(fields + [T.StructField(f"vector_{v}", T.ArrayType(T.FloatType())) for v in vectors])


def _vectors(state: DataFrame) -> list[str]:
    return [c for c in state.columns if c.startswith("vector_")]


def _matches(state: DataFrame, spec: dict | None) -> Column:
    variant = F.parse_json(F.coalesce("payload", F.lit("{}")))
    vectors = {c.removeprefix("vector_"): F.col(c) for c in _vectors(state)}
    return F.coalesce(compile_filter(spec, Context(T.StructType(), F.col("id"), variant=variant, vectors=vectors)), F.lit(False))


def _target(state: DataFrame, body: dict, op_num: int) -> Column:
    """The points that an operation changes: by ids or by filter, and older than it."""
    where = F.col("id").isin([_id_of(state)(i) for i in body["ids"]]) if "ids" in body else _matches(state, body.get("filter"))
    return where & (F.col("version") <= op_num if body.get("_again") else F.col("version") < op_num)


def latest(rows: DataFrame, key: str = "id", version: str = "version") -> DataFrame:
    """The row with the largest version of each key, by a grouped maximum (combined in the map tasks)."""
    rest = [c for c in rows.columns if c not in (key, version)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("r"), F.max(version).alias(version))
    return best.select(*[F.col(c) if c in (key, version) else F.col(f"r.{c}").alias(c) for c in rows.columns])


def _id_of(state: DataFrame):
    """Ids as the state has them; a UUID in any spelling is the same id."""
    return point_id if isinstance(state.schema["id"].dataType, T.StringType) else int


def _incoming(state: DataFrame, body: dict, op_num: int) -> DataFrame:
    """Points of an upsert; of equal ids the last one counts. Row form, or the columnar form."""
    points = body.get("points")
    if points is None:
        b = body["batch"]
        payloads = b.get("payloads") or [None] * len(b["ids"])
        vectors = b["vectors"]
        each = [{n: v[i] for n, v in vectors.items()} if isinstance(vectors, dict) else vectors[i] for i in range(len(b["ids"]))]
        points = [{"id": i, "vector": v, "payload": p} for i, v, p in zip(b["ids"], each, payloads, strict=True)]
    rows = {}
    own = _id_of(state)
    for p in points:
        v = p.get("vector") or {}
        v = v if isinstance(v, dict) else {"": v}
        rows[own(p["id"])] = (own(p["id"]), op_num, json.dumps(p.get("payload") or {}), *[[float(x) for x in v[n]] if n in v else None for n in (c.removeprefix("vector_") for c in _vectors(state))])
    return state.sparkSession.createDataFrame(list(rows.values()), state.schema)


def upsert(state: DataFrame, new: DataFrame, mode: str = "upsert", spec: dict | None = None, again: bool = False) -> DataFrame:
    """Whole points are replaced. mode: upsert, insert_only, update_only. spec: existing points that fail it
    are left alone. One full join on id."""
    old = state.select(F.col("id").alias("__id"), F.struct(*state.columns).alias("o"), _matches(state, spec).alias("__ok") if spec else F.lit(True).alias("__ok"))
    both = old.join(new.select("id", F.struct(*new.columns).alias("n")), F.col("__id") == F.col("id"), "full")
    exists, given = F.col("o").isNotNull(), F.col("n").isNotNull()
    newer = F.col("n.version") >= F.col("o.version") if again else F.col("n.version") > F.col("o.version")
    take = given & ((~exists & F.lit(mode != "update_only")) | (exists & newer & F.col("__ok") & F.lit(mode != "insert_only")))
    return both.select(F.when(F.coalesce(take, F.lit(False)), F.col("n")).otherwise(F.col("o")).alias("r")).where("r is not null").select("r.*")


def _change(state: DataFrame, hit: Column, op_num: int, **columns: Column) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    changed = {c: F.when(F.col("__hit"), v).otherwise(F.col(c)) for c, v in columns.items()}
    return state.withColumn("__hit", hit).withColumns({**changed, "version": F.when(F.col("__hit"), F.lit(op_num)).otherwise(F.col("version"))}).select(*state.columns)


#: Operations that report ids which no point has.
NEED_POINTS = ("update_vectors", "delete_vectors", "set_payload", "overwrite_payload", "delete_payload", "clear_payload")


def missing(state: DataFrame, kind: str, body: dict) -> list:
    """The ids that an operation names and no point has; one scan of the id column."""
    if kind not in NEED_POINTS or body.get("update_filter"):
        return []
    named = body.get("ids") if "ids" in body else [p["id"] for p in body.get("points") or []]
    named = dict.fromkeys(map(_id_of(state), named or []))
    found = {r["id"] for r in state.where(F.col("id").isin(list(named))).select("id").collect()} if named else set()  # ids of one request
    return [i for i in named if i not in found]


def apply_op(state: DataFrame, op_num: int, kind: str, body: dict, strict: bool = False) -> DataFrame:
    """strict: an operation that names absent points is an error, as for a request; a log is replayed without."""
    if strict and (absent := missing(state, kind, body)):
        raise KeyError(f"no points {absent}")
    if kind == "upsert":
        return upsert(state, _incoming(state, body, op_num), body.get("mode", "upsert"), body.get("update_filter"), bool(body.get("_again")))
    if kind == "sync":
        new = _incoming(state, body, op_num)
        low, high = (_id_of(state)(body[k]) for k in ("from", "to"))
        keep = [_id_of(state)(p["id"]) for p in body["points"]]
        gone = F.col("id").between(low, high) & ~(F.col("id").isin(keep) if keep else F.lit(False))
        left = state.where(~(gone & (F.col("version") < op_num)))
        same = left.select("id", *[F.col(c).alias("__" + c) for c in left.columns if c not in ("id", "version")])
        joined = new.join(same, "id", "left")
        json_of = lambda c: F.to_json(F.parse_json(c))  # noqa: E731  without the spelling of the text
        equal = [json_of("payload").eqNullSafe(json_of("__payload")), *[F.col(c).eqNullSafe(F.col("__" + c)) for c in _vectors(left)]]
        every = equal[0]
        for e in equal[1:]:
            every = every & e
        return upsert(left, joined.where(~every).select(*new.columns))
    hit = _target(state, body, op_num)
    if kind == "delete":
        return state.where(~F.coalesce(hit, F.lit(False)))
    if kind == "update_vectors":
        new = {p["id"]: p["vector"] if isinstance(p["vector"], dict) else {"": p["vector"]} for p in body["points"]}
        rows = _incoming(state, {"points": [{"id": i, "vector": v} for i, v in new.items()]}, op_num).drop("payload", "version")
        vs = _vectors(state)
        joined = state.join(rows.select("id", F.struct(*vs).alias("n")), "id", "left")
        ok = F.col("n").isNotNull() & (F.col("version") <= op_num if body.get("_again") else F.col("version") < op_num)
        if body.get("update_filter"):
            ok = ok & _matches(state, body["update_filter"])
        return joined.select(*[F.when(ok, F.coalesce(F.col(f"n.{c}"), F.col(c))).otherwise(F.col(c)).alias(c) if c in vs else F.when(ok, F.lit(op_num)).otherwise(F.col("version")).alias(c) if c == "version" else F.col(c) for c in state.columns])
    if kind == "delete_vectors":
        return _change(state, hit, op_num, **{f"vector_{n}": F.lit(None).cast("array<float>") for n in body["vectors"]})
    if kind == "set_payload":
        return _change(state, hit, op_num, payload=merge_json(F.col("payload"), F.lit(json.dumps(body["payload"])), body.get("key")))
    if kind == "overwrite_payload":
        return _change(state, hit, op_num, payload=F.lit(json.dumps(body["payload"])))
    if kind == "delete_payload":
        return _change(state, hit, op_num, payload=delete_json(F.col("payload"), body["keys"]))
    if kind == "clear_payload":
        return _change(state, hit, op_num, payload=F.lit("{}"))
    if kind == "batch":
        for one in body["operations"]:
            state = apply_op(state, op_num, one["kind"], {**one["body"], "_again": True})  # one number for all of them
        return state
    raise ValueError(f"no operation of this kind: {kind}")


def replay(state: DataFrame, ops: list[tuple[int, str, dict]], cut: int = 16) -> DataFrame:
    """Operations in the order of their numbers; the lineage is cut in the checkpoint folder now and then."""
    for n, (op_num, kind, body) in enumerate(sorted(ops, key=lambda o: o[0]), 1):
        state = apply_op(state, op_num, kind, body)
        if n % cut == 0 and state.sparkSession.sparkContext.getCheckpointDir():
            state = state.checkpoint()
    return state


_POINTS = "points array<struct<id: string, payload: string, vector: string>>"


def _plain(body: Column) -> Column:
    """Upserts in row form without a mode or a condition."""
    rest = F.coalesce(F.get_json_object(body, "$.mode"), F.lit("upsert")) == "upsert"
    return rest & F.get_json_object(body, "$.points").isNotNull() & F.get_json_object(body, "$.update_filter").isNull()


def _newest_points(state: DataFrame, ops: DataFrame) -> DataFrame:
    """The last row of each id in plain upserts, as rows of the state."""
    each = ops.select("op_num", F.posexplode(F.from_json("body", _POINTS)["points"]).alias("at", "p"))
    vector = F.col("p.vector")
    dense = F.from_json(vector, "array<float>")
    by_name = F.from_json(vector, "map<string,array<float>>")
    columns = {c: F.when(F.startswith(F.ltrim(vector), F.lit("[")), dense if c == "vector_" else F.lit(None).cast("array<float>")).otherwise(F.try_element_at(by_name, F.lit(c.removeprefix("vector_")))) for c in _vectors(state)}
    own = canonical_id(F.col("p.id")) if isinstance(state.schema["id"].dataType, T.StringType) else F.col("p.id").cast("long")
    rows = each.select(own.alias("id"), F.struct("op_num", "at").alias("__at"), F.col("op_num").alias("version"), F.coalesce("p.payload", F.lit("{}")).alias("payload"), *[v.alias(c) for c, v in columns.items()])
    return latest(rows, version="__at").select(*state.columns)


def replay_log(state: DataFrame, log: DataFrame, cut: int = 16) -> DataFrame:
    """The rows of a log in their order. Only what is no plain upsert is collected: as many requests as one
    micro-batch holds, without their points where these are many."""
    log = log.withColumn("__plain", (F.col("kind") == "upsert") & _plain(F.col("body")))
    others = [(r["op_num"], r["kind"], json.loads(r["body"])) for r in log.where("not __plain").orderBy("op_num").collect()]
    upserts = log.where("__plain")
    starts = F.array(*[F.lit(o[0]).cast("long") for o in others]) if others else F.array().cast("array<long>")
    upserts = upserts.withColumn("__run", F.size(F.filter(starts, lambda x: x < F.col("op_num"))))
    runs = {r[0] for r in upserts.select("__run").distinct().collect()}  # one more than `others` at most
    done = 0
    for n in range(len(others) + 1):
        if n in runs:
            state, done = upsert(state, _newest_points(state, upserts.where(F.col("__run") == n))), done + 1
        if n < len(others):
            state, done = apply_op(state, *others[n]), done + 1
        if done >= cut and state.sparkSession.sparkContext.getCheckpointDir():
            state, done = state.checkpoint(), 0
    return state


def pending(ops: DataFrame, after: int) -> DataFrame:
    """The log from an operation on."""
    return ops.where(F.col("op_num") > after).orderBy("op_num")


def newest_ops(ops: DataFrame, peer: str = "peer", clock: str = "clock", tick: str = "tick") -> DataFrame:
    """Of repeated deliveries each (peer, clock, tick) once."""
    first = F.row_number().over(Window.partitionBy(peer, clock, tick).orderBy("op_num"))
    return ops.withColumn("__n", first).where("__n = 1").drop("__n")


class OpLog:
    """A state directory: version-<uuid>/ (Parquet) and the pointer file CURRENT."""

    def __init__(self, spark: SparkSession, path: str, vectors: list[str], id_type: str = "long"):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), state_schema(vectors, id_type)

    def _fs(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def current(self) -> tuple[str | None, int]:
        path, fs = self._fs("CURRENT")
        if not fs.exists(path):
            return None, -1
        line = json.loads(self.spark.read.text(path.toString(), wholetext=True).first()[0])
        return line["version"], line["op_num"]

    def state(self) -> DataFrame:
        version, _ = self.current()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def apply(self, batch: DataFrame) -> None:
        """Applies what is new in a batch of log rows, then moves the pointer."""
        _, done = self.current()
        new = batch.where(F.col("op_num") > done)
        last = new.agg(F.max("op_num")).first()[0]
        if last is None:
            return
        version = f"version-{uuid.uuid4().hex}"
        replay_log(self.state(), new).write.parquet(f"{self.path}/{version}")
        replace_file(self.spark, f"{self.path}/CURRENT", json.dumps({"version": version, "op_num": last}))

    def stream(self, log_dir: str, checkpoint: str, **trigger):
        """A streaming query over JSON log files: batches strictly one after the other."""
        source = self.spark.readStream.schema(LOG_SCHEMA).json(log_dir)
        return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: self.apply(df)).trigger(**(trigger or {"availableNow": True})).start()
