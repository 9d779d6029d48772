"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Normalisation lower-cases A-Z and keeps words of 0-9, a-z and everything beyond ASCII. It works on UTF-8 bytes
and maps each byte to one byte, so every offset found in the normalised text is an offset in the original one.
The automaton's alphabet is the items' words: a window of 13 words is a path of 13 nodes, and a document is
scanned once, word by word, whatever the number of windows.

Defined results: a null or empty text has no words and no hits; an item without words has no window; an item with
fewer words than a window is one window; repeated item ids count once; a null item id is named "null"; repeated
document rows give one row each; a null document id stays null; an empty benchmark gives no hits; a benchmark of more than BENCHMARK_BYTES
is an error, not cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, extended, narrow, workspace

WINDOW = 13
#: UTF-8 bytes of distinct items held by one automaton (about 3 nodes a byte). Where a benchmark has more, a task
#: holds BUFFER_CHARS characters of documents and applies one automaton after another to them: documents are read once,
#: and the hits are those of one automaton.
AUTOMATON_BYTES = 4_000_000
BUFFER_CHARS = 64_000_000
#: UTF-8 bytes of distinct items beyond which the operator refuses to broadcast them.
BENCHMARK_BYTES = 256_000_000

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


def word_offsets(text: str) -> np.ndarray:
    """Start and end (exclusive) of each word, in code points of the original text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)
    inside = np.concatenate(([0], (raw != 0x20).astype(np.int8), [0]))
    edge = np.diff(inside)
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8) & 0xC0) != 0x80)))
    return np.stack([chars[np.flatnonzero(edge == 1)], chars[np.flatnonzero(edge == -1)]], axis=1)


class Matcher:
    """One automaton over the windows of (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ws = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            for i in range(max(1, len(ws) - window + 1) if ws else 0):
                owners.setdefault(tuple(ws[i : i + window]), set()).add(item)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for path, names in owners.items():
            self.automaton.add_word(path, (len(path), tuple(sorted(names))))
        self.empty = not owners
        if owners:
            self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, [start, end) word ranges of the occurrences, items that occur."""
        ws = words(text)
        if self.empty or not ws:
            return len(ws), [], set()
        get = self.ids.get
        path = tuple([get(w, 0) for w in ws])
        ranges, names = [], set()
        for end, (n, who) in self.automaton.iter(path):
            ranges.append((end + 1 - n, end + 1))
            names.update(who)
        return len(ws), ranges, names


def _matcher(shared: Broadcast, block: int, window: int) -> Matcher:
    value = shared.value  # one object in a worker, as long as the workspace holds it
    return workspace(("matcher", id(value), block, window), lambda: (Matcher(value[block], window), value))[0]


def _hit(n: int, ranges: list[tuple[int, int]], before: bytes | None) -> bytes | None:
    """A bit for each of ``n`` words, set in the ranges and where ``before`` has it."""
    if not ranges:
        return before
    steps = np.zeros(n + 1, np.int32)
    spans = np.array(ranges)
    np.add.at(steps, spans[:, 0], 1)
    np.add.at(steps, spans[:, 1], -1)
    bits = np.cumsum(steps[:-1]) > 0
    if before:
        bits |= np.unpackbits(np.frombuffer(before, np.uint8), count=n).astype(bool)
    return np.packbits(bits).tobytes()


def _scanner(shared: Broadcast, window: int, blocks: int, columns):
    def found(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = [b["text"].to_pylist() for b in batches]
        rows = [[[0, None, set()] for _ in t] for t in texts]  # words, hit, items
        for k in range(blocks):
            matcher = _matcher(shared, k, window)
            for some, out in zip(texts, rows, strict=True):
                for text, row in zip(some, out, strict=True):
                    row[0], ranges, names = matcher.scan(text)
                    row[1] = _hit(row[0], ranges, row[1])
                    row[2] |= names
        for batch, out in zip(batches, rows, strict=True):
            yield carried(batch, {"doc_id": batch["doc_id"], **columns(batch, out)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if blocks == 1 or size >= BUFFER_CHARS:
                yield from found(held)
                held, size = [], 0
        if held:
            yield from found(held)

    return run


def _with_hits(batch: pa.RecordBatch, rows: list) -> dict[str, pa.Array]:
    return {"text": batch["text"], "n_words": pa.array([r[0] for r in rows], pa.int64()), "hit": pa.array([r[1] for r in rows], pa.binary()), "items": pa.array([sorted(r[2]) for r in rows], pa.list_(pa.string()))}


def _with_digest(batch: pa.RecordBatch, rows: list) -> dict[str, pa.Array]:
    hits = [int.from_bytes(h, "big").bit_count() if h else 0 for _, h, _ in rows]
    digests = [hashlib.sha256(",".join(sorted(names)).encode()).hexdigest() for _, _, names in rows]
    verdict = [h > 0 and 20 * h >= r[0] for h, r in zip(hits, rows, strict=True)]
    return {"n_words": pa.array([r[0] for r in rows], pa.int64()), "n_hit": pa.array(hits, pa.int64()), "n_items": pa.array([len(r[2]) for r in rows], pa.int64()), "items_sha256": pa.array(digests, pa.string()), "contaminated": pa.array(verdict, pa.bool_())}


def _scanned(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_col: str, item_text_col: str, carry: bool, columns, schema: str) -> DataFrame:
    items = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("item") + F.octet_length("text"))).first()[0] or 0
    if total > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {total} bytes; at most {BENCHMARK_BYTES} are broadcast")
    blocks, size = [[]], 0
    for r in items.collect():
        if size and size + len(r.text) > AUTOMATON_BYTES:
            blocks.append([])
            size = 0
        blocks[-1].append((r.item, r.text))
        size += len(r.text)
    given = narrow(docs, id_col, text_col, carry)
    return given.mapInArrow(_scanner(docs.sparkSession.sparkContext.broadcast(blocks), window, len(blocks), columns), extended(given, schema))


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, text, n_words, hit (a bit for each word; null: none is hit), items (the sorted ids of
    those that occur). ``carry`` adds ``row``, the whole row of ``docs``."""
    return _scanned(docs, items, window, id_col, text_col, item_col, item_text_col, carry, _with_hits, "doc_id long, text string, n_words long, hit binary, items array<string>")


def summary(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per document with the counts, the digest of the items, and the verdict (at least one word in 20 hit)."""
    return _scanned(docs, items, window, id_col, text_col, item_col, item_text_col, carry, _with_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def hit_spans(text: str, hit: bytes | None) -> list[tuple[int, int]]:
    """Runs of hit words as [start, end) code points of the original text."""
    at = word_offsets(text or "")
    if not hit or not len(at):
        return []
    edge = np.diff(np.concatenate(([0], np.unpackbits(np.frombuffer(hit, np.uint8), count=len(at)).astype(np.int8), [0])))
    return [(int(at[a, 0]), int(at[b - 1, 1])) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
