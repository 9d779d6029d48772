"""Media columns: payloads in archives, read by a data source that plans byte ranges over the archives' directories.

A payload becomes an 8-bit grey PNG, 64 samples a line, and a member of a ZIP archive (stored, as PNG is compressed). The
data source ``archive_members`` lists archives on the driver, by size alone, and cuts them into byte ranges. A task
reads its archive's directory, takes the members whose headers begin in its range, reads each by its offset from the same stream, and
yields batches of bounded size through Arrow. A member that fails to read or whose checksum is wrong is fetched again
on its own, from a newly opened file; only when that fails repeatedly does the task fail, so none is dropped.

Defined results: a null or empty text is 64 zero bytes; equal texts have equal payloads, media and features; repeated
rows are members each; a null id is kept as null; an empty table writes no archive and reads none.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import narrow, released, scratch, staged
from .store import at, write_whole

LINE = 64
#: Bytes after which an archive is closed, of a range, and of a batch.
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 4

_PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + bytes(LINE - len(raw) % LINE if len(raw) % LINE or not raw else 0)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(samples: bytes) -> bytes:
    """Lossless 8-bit grey PNG of whole lines; each line has filter 0."""
    lines = np.frombuffer(samples, np.uint8).reshape(-1, LINE)
    body = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    return _PNG + _chunk(b"IHDR", struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(body, 6)) + _chunk(b"IEND", b"")


def samples(media: bytes) -> bytes:
    """The payload of a PNG that ``png`` has made; raises ValueError for anything else."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    place, parts, height = 8, [], 0
    while place < len(media):
        n, kind = struct.unpack_from(">I4s", media, place)
        body = media[place + 8 : place + 8 + n]
        if struct.unpack_from(">I", media, place + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            height = struct.unpack_from(">I", body, 4)[0]
        elif kind == b"IDAT":
            parts.append(body)
        place += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, LINE + 1)
    if lines[:, 0].any():
        raise ValueError("filtered lines")
    return lines[:, 1:].tobytes()


def feature(raw: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit hash: which of 64 equal stretches exceed the mean."""
    x = np.frombuffer(raw, np.uint8)
    counts = np.bincount(x, minlength=256)
    n = len(x)
    values = np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    spread = math.sqrt(max(0, n * squares - total * total)) / n
    p = counts[counts > 0] / n
    edges = [n * i // 64 for i in range(65)]
    sums = np.add.reduceat(x.astype(np.int64), edges[:-1])
    bits = 0
    for i in range(64):
        bits = bits << 1 | (int(sums[i]) * n > total * (edges[i + 1] - edges[i]))
    return f"{total / n:.4f}:{spread:.4f}:{-float((p * np.log2(p)).sum()) + 0.0:.4f}:{bits:016x}"


_ARCHIVES = "uri string, members long, n_bytes long"


def _writer(folder: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        pid, seg, count, held = TaskContext.get().partitionId(), 0, 0, io.BytesIO()
        archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)

        def close():
            archive.close()
            uri = f"{folder}/archive-{pid:06d}-{seg:06d}.zip"
            size = write_whole(uri, lambda s: s.write(held.getbuffer()))
            return pa.RecordBatch.from_pydict({"uri": [uri], "members": pa.array([count], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = text.as_py()
                info = zipfile.ZipInfo(f"{count:08d}-{'null' if doc is None else doc}.png")
                info.comment = str(len(raw.encode("utf-8", "surrogatepass"))).encode()
                archive.writestr(info, png(payload(raw)))
                count += 1
                if held.tell() >= limit:
                    yield close()
                    seg, count, held = seg + 1, 0, io.BytesIO()
                    archive = zipfile.ZipFile(held, "w", zipfile.ZIP_STORED)
        if count:
            yield close()

    return run


def write_archives(docs: DataFrame, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, DataFrame]:
    """The folder of the archives, and a row for each: uri, members, n_bytes."""
    folder = folder or scratch(docs.sparkSession, "media")
    made = narrow(docs, id_col, text_col).mapInArrow(_writer(folder, archive_bytes), _ARCHIVES)
    return folder, staged(made, "archives")


class _Range(InputPartition):
    def __init__(self, uri: str, lo: int, hi: int):
        self.uri, self.lo, self.hi = uri, lo, hi


class MemberError(OSError):
    """A member could not be read whole in ATTEMPTS tries."""


def read_member(f, offset: int, size: int, crc: int) -> bytes:
    """A stored member's bytes by its header's offset; raises OSError where they are short or damaged."""
    f.seek(offset)
    head = f.read(30)
    if len(head) < 30:
        raise OSError("short")
    f.seek(offset + 30 + sum(struct.unpack_from("<HH", head, 26)))
    body = f.read(size)
    if len(body) != size or zlib.crc32(body) != crc:
        raise OSError("short or damaged")
    return body


def fetch(uri: str, offset: int, size: int, crc: int, attempts: int = ATTEMPTS, opener=None) -> bytes:
    """A member from a newly opened file, with tries of its own."""
    for k in range(attempts):
        try:
            system, path = at(uri)
            with (opener or system.open_input_file)(path) as f:
                return read_member(f, offset, size, crc)
        except OSError as e:
            why = e
        time.sleep(0.05 * 2**k if k + 1 < attempts else 0)
    raise MemberError(f"{uri} at {offset}: {why}")


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))

    def partitions(self):
        system, path = at(self.folder)
        scheme = self.folder.removesuffix(path.lstrip("/")) if "://" in self.folder else "file:///"
        files = sorted((f.path, f.size) for f in system.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.path.endswith(".zip"))
        found = [_Range(scheme + p.lstrip("/"), lo, min(lo + self.range_bytes, n)) for p, n in files for lo in range(0, n, self.range_bytes)]
        return found or [_Range("", 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        system, path = at(partition.uri)
        with system.open_input_file(path) as f:
            with zipfile.ZipFile(f) as archive:
                members = sorted((m for m in archive.infolist() if partition.lo <= m.header_offset < partition.hi), key=lambda m: m.header_offset)
            rows, held = [], 0
            for m in members:
                where = m.header_offset, m.compress_size, m.CRC
                try:
                    body = read_member(f, *where)
                except OSError:
                    body = fetch(partition.uri, *where)
                doc = m.filename[9:-4]
                rows.append((None if doc == "null" else int(doc), int(m.comment), partition.uri, m.header_offset, body))
                held += m.compress_size
                if held >= self.batch_bytes:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


_MEMBERS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _MEMBERS.types, strict=True)], schema=_MEMBERS)


class ArchiveMembers(DataSource):
    """``spark.read.format("archive_members").load(folder)``; options rangeBytes, batchBytes."""

    @classmethod
    def name(cls) -> str:
        return "archive_members"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, uri string, offset long, media binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_archives(spark: SparkSession, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveMembers)
    return spark.read.format("archive_members").option("rangeBytes", range_bytes).load(folder)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    released()
    for batch in batches:
        rows = []
        for media in batch["media"]:
            form = media.as_py()
            raw = samples(form)
            rows.append((len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-LINE:]), len(form), hashlib.sha256(form).hexdigest(), feature(raw)))
        n, sha, tail, m, msha, feat = zip(*rows, strict=True) if rows else [()] * 6
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "payload_bytes": pa.array(n, pa.int64()), "payload_sha256": pa.array(sha, pa.string()), "tail_crc32": pa.array(tail, pa.int64()), "media_bytes": pa.array(m, pa.int64()), "media_sha256": pa.array(msha, pa.string()), "feature": pa.array(feat, pa.string())})


def media_features(members: DataFrame) -> DataFrame:
    """Digests and features of what the archives hold, one row a member."""
    return members.select("doc_id", "n_bytes", "media").mapInArrow(_features, _FEATURES)
