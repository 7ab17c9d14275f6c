"""Operator 6, media columns: payloads in archives of images, read back by a Spark data source.

`store` writes each payload as a lossless 8-bit greyscale PNG, 64 samples wide, into ZIP archives (members
stored, so that an archive's own directory gives each member's byte offset). A task writes archives of its
own under a name that no other attempt uses and reports them only when they are closed; a manifest lists
the reported ones, so lost executors and repeated attempts leave no trace in the result.

The data source `media_archive` plans byte ranges over the archives in a folder: the driver only lists
files and sizes. A reader opens its archive's directory, takes the members that begin in its range, and
streams them as Arrow batches. Each member is read on its own at its offset, and again up to `retries`
times with the file opened anew, when the read or its checksum fails; a member that keeps failing becomes a row
with its error, so that one bad member costs one row and not the scan.

Archives are written and read through pyarrow's file systems (local, HDFS, S3, GCS), in the shared folder
of the cluster. Defined cases: a null text is an empty payload, padded to 64 zero bytes; an empty table
gives an empty archive folder and no rows; ids may be null or repeated, each row is a member of its own.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tessera.llm.common import read, work_path

WIDTH = 64
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 16 << 20, 4 << 20
RETRIES = 3
MANIFEST = "manifest.json"
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, member string, media binary, attempts int, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(data: bytes) -> bytes:
    """A PNG of the bytes, padded with 0 to a positive multiple of WIDTH; their number is kept in a text chunk."""
    rows = max(1, -(-len(data) // WIDTH))
    samples = np.zeros((rows, WIDTH + 1), np.uint8)  # each row begins with its filter, none
    samples[:, 1:] = np.frombuffer(data.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)
    return b"".join([
        _SIGNATURE,
        _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)),
        _chunk(b"tEXt", b"Length\0" + str(len(data)).encode()),
        _chunk(b"IDAT", zlib.compress(samples.tobytes(), 2)),
        _chunk(b"IEND", b""),
    ])


def decode(media: bytes) -> tuple[np.ndarray, int]:
    """The samples (rows, WIDTH) of a PNG of encode(), and the number of bytes before padding."""
    if media[:8] != _SIGNATURE:
        raise ValueError("no PNG")
    at, parts, rows, length = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        data = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError(f"damaged {kind.decode()} chunk")
        if kind == b"IHDR":
            rows = struct.unpack(">II", data[:8])[1]
        elif kind == b"tEXt":
            length = int(data.partition(b"\0")[2])
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + n
    samples = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(rows, WIDTH + 1)
    return samples[:, 1:], length


def feature(samples: np.ndarray) -> str:
    """Size, mean, deviation, entropy and mean step between neighbouring samples."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n, values = samples.size, np.arange(256)
    mean = int((counts * values).sum()) / n
    variance = int((counts * values**2).sum()) / n - mean**2
    p = counts[counts > 0] / n
    step = int(np.abs(np.diff(samples.astype(np.int16), axis=1)).sum()) / n
    return f"{WIDTH}x{len(samples)};mean={mean:.4f};std={max(variance, 0) ** 0.5:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};step={step:.4f}"


def _files(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri.removeprefix("file:")
    return pafs.FileSystem.from_uri(uri)


def store(rows: DataFrame, key: str, text: str, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes one PNG for each row into archives in `folder`; a member's name ends with its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _files(folder)
        context, done, out, archive, written, n = TaskContext.get(), [], None, None, 0, 0

        def close() -> None:
            nonlocal archive
            if archive is not None:
                archive.close()
                out.close()
                done.append((name, fs.get_file_info(f"{base}/{name}").size))
                archive = None

        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                if archive is None:
                    name = f"{context.partitionId():06d}-{uuid.uuid4().hex}.zip"
                    out = fs.open_output_stream(f"{base}/{name}")
                    archive, written = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED), 0
                media = encode((t.as_py() or "").encode("utf-8", "surrogatepass"))
                archive.writestr(zipfile.ZipInfo(f"{n:09d}_{k.as_py()}.png"), media)
                n, written = n + 1, written + len(media)
                if written >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["name", "bytes"])

    fs, base = _files(folder)
    fs.create_dir(base, recursive=True)
    found = rows.select(F.col(key).cast("string"), F.col(text).cast("string")).mapInArrow(run, "name string, bytes long").collect()  # a row for each archive
    with fs.open_output_stream(f"{base}/{MANIFEST}") as f:
        f.write(json.dumps(sorted([r["name"], r["bytes"]] for r in found)).encode())


class ByteRange(InputPartition):
    def __init__(self, path: str, begin: int, end: int):
        self.path, self.begin, self.end = path, begin, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.retries = int(options.get("retries", RETRIES))

    def partitions(self) -> list[ByteRange]:
        fs, base = _files(self.folder)
        try:
            with fs.open_input_stream(f"{base}/{MANIFEST}") as f:
                files = json.loads(f.read())
        except FileNotFoundError:  # a folder of archives from elsewhere
            files = sorted([i.base_name, i.size] for i in fs.get_file_info(pafs.FileSelector(base)) if i.base_name.endswith(".zip"))
        ranges = [ByteRange(name, at, at + self.range_bytes) for name, size in files for at in range(0, size, self.range_bytes)]
        return ranges or [ByteRange("", 0, 0)]

    def _member(self, fs: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, int, str | None]:
        """The member at its own offset; opened anew for each attempt."""
        error = None
        for attempt in range(1, self.retries + 2):
            try:
                with fs.open_input_file(path) as f:
                    f.seek(info.header_offset)
                    head = f.read(30)
                    if head[:4] != b"PK\3\4":
                        raise zipfile.BadZipFile("no member here")
                    name, extra = struct.unpack("<HH", head[26:30])
                    f.seek(info.header_offset + 30 + name + extra)
                    data = f.read(info.compress_size)
                if info.compress_type == zipfile.ZIP_DEFLATED:
                    data = zlib.decompress(data, -15)
                if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                    raise zipfile.BadZipFile("wrong checksum")
                return data, attempt, None
            except (OSError, zipfile.BadZipFile, zlib.error, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
        return None, self.retries + 1, error

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, base = _files(self.folder)
        path = f"{base}/{partition.path}"
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
            members = [i for i in archive.infolist() if partition.begin <= i.header_offset < partition.end]
        rows, size = [], 0
        for info in members:
            data, attempts, error = self._member(fs, path, info)
            rows.append((partition.path, info.header_offset, info.filename, data, attempts, error))
            size += len(data or b"")
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["archive", "offset", "member", "media", "attempts", "error"])


class MediaArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): one row for each member of the archives there."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def members(spark: SparkSession, folder: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").options(**options).load(folder)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work_path(spark, "media")
    store(read(spark, sf_dir, "documents"), "doc_id", "text", folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, media, error in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if error is not None:
                    raise OSError(f"{name}: {error}")
                samples, n = decode(media)
                payload, key = samples.tobytes(), name.partition("_")[2].removesuffix(".png")
                out.append((int(key) if key != "None" else None, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples)))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    return members(spark, folder).select("member", "media", "error").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
