"""Token ids in files of directly addressable codes.

An id's bits are cut into chunks, low bits first. Level 0 holds the first chunk of every id, level 1 the second chunk
of those that have one, and so on. A bitmap on each level marks the codes that continue, and a rank directory (ones
before each 512 bits) leads to the place of the continuation, so any token is read with a few bit operations and no
block is decoded. A file's chunk widths are found by dynamic programming: least bits, where an id that has to look up another
level is charged LEVEL_BITS for the time that takes (so files are some per cent above the least size).

Files are read back by the same access, over the positions of a stretch of documents at once: each level's codes are
addressed through the bitmap and directory of the level before, for the positions asked for alone.

File: magic, counts (documents, tokens, levels), document ids, document starts, then per level its number of
codes, its width, packed codes, bitmap, directory. Numbers are little-endian; bits are packed high first.

Defined results: a null or empty text is only the end id; ids ascend over files and within them, null ids first;
repeated document ids follow each other in any order; an empty table gives no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kernel_slices, narrow, scratch, staged
from .store import read_whole, write_whole
from .tokens import encoder

MAGIC = b"QDAC1\0\0\0"
RANK_BITS = 512
#: What another level may cost in bits an id that has to look it up, for the time that takes.
LEVEL_BITS = 1.0
#: Tokens that are read at once (a longer document goes alone).
RANGE_TOKENS = 1 << 18
#: Tokens after which a file ends, at the end of a kernel's documents.
FILE_TOKENS = 2_000_000
_NULL = -(1 << 63)


def _pack(codes: np.ndarray, width: int) -> bytes:
    """Eight codes make a word of 8 * width bits, of which the low ``width`` bytes are kept."""
    n = len(codes)
    lanes = np.zeros(-(-n // 8) * 8, np.uint64)
    lanes[:n] = codes
    lanes = lanes.reshape(-1, 8)
    words = np.zeros(len(lanes), np.uint64)
    for j in range(8):
        words |= lanes[:, j] << np.uint64(width * (7 - j))
    return words.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].tobytes()[: (n * width + 7) // 8]


def _unpack(raw: np.ndarray, width: int, n: int) -> np.ndarray:
    padded = np.zeros((-(-n // 8), width), np.uint8)
    padded.reshape(-1)[: len(raw)] = raw
    buffer = np.zeros((len(padded), 8), np.uint8)
    buffer[:, 8 - width :] = padded
    words = buffer.view(">u8").ravel().astype(np.uint64)
    out = np.empty((len(words), 8), np.uint32)
    for j in range(8):
        out[:, j] = (words >> np.uint64(width * (7 - j))) & np.uint64((1 << width) - 1)
    return out.ravel()[:n]


def _longer(ids: np.ndarray, top: int) -> list[int]:
    """How many ids have more than b bits, for b from 0 to ``top``."""
    if top <= 20:
        below = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=1 << top))))
        return [len(ids)] + [len(ids) - int(below[1 << b]) for b in range(1, top + 1)]
    return [len(ids)] + [int((ids >= np.uint64(1 << b)).sum()) for b in range(1, top + 1)]


def widths(ids: np.ndarray) -> list[int]:
    """Chunk widths, of a byte at most, of least total bits: each code of a level costs its width and, before the last level, a mark and LEVEL_BITS."""
    top = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    longer = _longer(ids, top)
    best: dict[int, tuple[float, list[int]]] = {top: (0, [])}
    for b in range(top - 1, -1, -1):
        best[b] = min(((longer[b] * (w + (1 + 32 / RANK_BITS + LEVEL_BITS) * (b + w < top)) + best[b + w][0], [w, *best[b + w][1]]) for w in range(1, min(8, top - b) + 1)), key=lambda x: x[0])
    return best[0][1]


def encode(doc_ids: list[int | None], ids: np.ndarray, counts: np.ndarray) -> bytes:
    """A file of documents: their ids one after another, and how many each has."""
    ids = ids.astype(np.uint32)
    ws = widths(ids)
    out = [MAGIC, struct.pack("<QQQ", len(doc_ids), len(ids), len(ws)), np.array([_NULL if d is None else d for d in doc_ids], "<i8").tobytes(), np.concatenate(([0], np.cumsum(counts))).astype("<u8").tobytes()]
    rest = ids
    for k, w in enumerate(ws):
        more = (rest >> w) > 0
        marks = np.packbits(more).tobytes() if k + 1 < len(ws) else b""
        directory = np.concatenate(([0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64))))[:-1].astype("<u4").tobytes() if marks else b""
        codes = _pack(rest & np.uint32((1 << w) - 1), w)
        out += [struct.pack("<QQQQQ", len(rest), w, len(codes), len(marks), len(directory)), codes, marks, directory]
        rest = rest[more] >> w
    return b"".join(out)


class DacFile:
    """One file's bytes, with random access to any token and to any document's ids."""

    def __init__(self, raw: bytes):
        if raw[:8] != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        buf = np.frombuffer(raw, np.uint8)
        n_docs, self.n_tokens, n_levels = struct.unpack_from("<QQQ", raw, 8)
        at = 32
        self.doc_ids = [None if x == _NULL else x for x in np.frombuffer(raw, "<i8", n_docs, at).tolist()]
        at += 8 * n_docs
        self.starts = np.frombuffer(raw, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            n, w, n_codes, n_marks, n_dir = struct.unpack_from("<QQQQQ", raw, at)
            at += 40
            codes, marks = buf[at : at + n_codes], buf[at + n_codes : at + n_codes + n_marks]
            directory = np.frombuffer(raw, "<u4", n_dir // 4, at + n_codes + n_marks)
            self.levels.append((n, w, codes, marks, directory))
            at += n_codes + n_marks + n_dir

    def token(self, i: int) -> int:
        """The i-th id, from the bits that belong to it and the directory alone."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for _, w, codes, marks, directory in self.levels:
            lo = i * w
            word = int.from_bytes(codes[lo // 8 : (lo + w + 7) // 8].tobytes(), "big")
            value |= (word >> (-(lo + w) % 8) & ((1 << w) - 1)) << shift
            shift += w
            if not len(marks) or not marks[i // 8] >> (7 - i % 8) & 1:
                break
            block = i // RANK_BITS
            before = int.from_bytes(marks[block * RANK_BITS // 8 : i // 8 + 1].tobytes(), "big") >> (8 - i % 8)
            i = int(directory[block]) + before.bit_count()
        return value

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions lo to hi - 1, by each one's own place on every level."""
        if not 0 <= lo <= hi <= self.n_tokens:
            raise IndexError((lo, hi))
        out = np.zeros(hi - lo, np.uint32)
        whose, places, shift = slice(None), np.arange(lo, hi), 0
        for n, w, codes, marks, directory in self.levels:
            if not len(places):
                break
            first, last = int(places.min()), int(places.max()) + 1
            if first < 0 or last > n:
                raise ValueError("damaged directory")
            a, b = first // RANK_BITS, -(-last // RANK_BITS)  # blocks of codes that hold the places
            begin = a * RANK_BITS
            end = min(b * RANK_BITS, n)
            value = _unpack(codes[begin * w // 8 : (end * w + 7) // 8], w, end - begin)[places - begin]
            out[whose] |= value << np.uint32(shift)
            shift += w
            if not len(marks):
                break
            bits = np.unpackbits(marks[begin // 8 : (end + 7) // 8], count=end - begin)
            within = np.cumsum(bits, dtype=np.int32)  # ones up to and with each place of these blocks
            starts = np.concatenate(([0], within))[np.arange(0, end - begin, RANK_BITS)]
            go = bits[places - begin].astype(bool)
            whose = np.flatnonzero(go) if isinstance(whose, slice) else whose[go]
            places = places[go] - begin
            places = directory[a:b].astype(np.int64)[places // RANK_BITS] + within[places] - 1 - starts[places // RANK_BITS]
        return out

    def documents(self, most: int = RANGE_TOKENS) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(document id, its first token's place in the file, its ids), read by stretches of about ``most`` tokens."""
        k = 0
        while k < len(self.doc_ids):
            end = max(k + 1, int(np.searchsorted(self.starts, self.starts[k] + most, side="right")) - 1)
            lo = int(self.starts[k])
            ids = self.tokens(lo, int(self.starts[end]))
            for j in range(k, end):
                yield self.doc_ids[j], int(self.starts[j]), ids[self.starts[j] - lo : self.starts[j + 1] - lo]
            k = end


def _writer(folder: str, path: str, pieces: str, end_id: int, file_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seg = encoder(path, pieces), TaskContext.get().partitionId(), 0
        names, parts, counts, held = [], [], [], 0

        def close():
            nonlocal seg, names, parts, counts, held
            uri = f"{folder}/part-{pid:06d}-{seg:06d}.dac"
            body = encode(names, np.concatenate(parts), np.concatenate(counts))
            size = write_whole(uri, lambda s: s.write(body))
            row = pa.RecordBatch.from_pydict({"pid": [pid], "seg": [seg], "uri": [uri], "n_docs": [len(names)], "n_tokens": [held], "n_bytes": [size]}, schema=_MANIFEST)
            seg, names, parts, counts, held = seg + 1, [], [], [], 0
            return row

        for batch in batches:
            texts, ids = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for lo, hi in kernel_slices(texts):
                flat, many = enc.encode_flat(texts[lo:hi], end_id)
                names += ids[lo:hi]
                parts.append(flat)
                counts.append(many)
                held += len(flat)
                if held >= file_tokens:
                    yield close()
        if names:
            yield close()

    return run


_MANIFEST = pa.schema([("pid", pa.int32()), ("seg", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())])


def write(docs: DataFrame, tokenizer: str, pieces: str = "spaces", end_id: int = 2, folder: str | None = None, file_tokens: int = FILE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files and return their manifest: pid, seg, uri, n_docs, n_tokens, n_bytes, first (tokens in all files before it)."""
    folder = folder or scratch(docs.sparkSession, "tokens")
    # rows of one id may fall in several ranges
    ordered = narrow(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id()).repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id").drop("at")
    manifest = staged(ordered.mapInArrow(_writer(folder, tokenizer, pieces, end_id, file_tokens), "pid int, seg int, uri string, n_docs long, n_tokens long, n_bytes long"), "manifest")
    per_part = manifest.groupBy("pid").agg(F.sum("n_tokens").alias("t"))  # a row for each partition of the write
    before = per_part.select("pid", (F.sum("t").over(Window.orderBy("pid")) - F.col("t")).alias("earlier"))
    within = F.sum("n_tokens").over(Window.partitionBy("pid").orderBy("seg")) - F.col("n_tokens")
    return manifest.withColumn("within", within).join(before, "pid").select(*manifest.columns, (F.col("earlier") + F.col("within")).alias("first"))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, first in zip(batch["uri"].to_pylist(), batch["first"].to_pylist(), strict=True):
            rows = [(d, first + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for d, at, ids in DacFile(read_whole(uri)).documents()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(manifest: DataFrame) -> DataFrame:
    """From the files alone: doc_id, start, n_tokens, ids_crc32."""
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("uri", "first").repartition(tasks).mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")
