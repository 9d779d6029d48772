"""Substring deduplication: compressed FM-indexes per shard, and matching statistics of the documents streamed against them.

Candidates. A window of 50 words belongs to its anchor: the 25 consecutive words with the smallest hash in it (the last
such). Equal windows have equal anchors, so a window recurs only where its anchor does. Consecutive windows with
one anchor form a region. Only regions whose anchor lies in two documents go on; copies of a region (by a 128-bit digest
of their words) are one, with their smallest document; in all other documents that have it, the whole region goes.

Search. Regions are dealt to shards by anchor, so that a shard holds about SHARD_WORDS words. A shard's index is the
Burrows-Wheeler transform of its regions in a wavelet matrix, a bit vector for each bit of a word's number with a rank
directory, and the regions' documents with sampled minimums; its size is below that of the texts. Every region is
streamed against it: backward search from an end gives the matching statistic there, the length of the longest stretch
that ends there and that a smaller document has, too. Stretches of at least a window are reported as intervals; ends that
an interval already settles are not searched. An anchor with one region only has nothing to be searched for.

An anchor with more than HOT_REGIONS different regions (a passage that very many documents share, each with other words
around it) is split into its windows, which are grouped by their words: the smallest document of a group has them first.

Removal. A document loses each word inside a window that a smaller document has, as judged on the
input. Every step is keyed by anchor, window or document; copies are added up before they are shuffled.

Hashes of 64 bits choose anchors and shards only; a collision adds candidates and changes no result.

Defined results: a null or empty text has no words; texts of fewer words than a window lose nothing; copies in documents of
equal id do not remove each other; rows with a null id lose nothing and remove nothing; repeated rows give
a row each; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, staged, workspace

WINDOW = 50
ANCHOR = 25
SHARD_WORDS = 100_000
#: Different regions of an anchor from which on its windows are looked at one by one.
HOT_REGIONS = 1_024
#: Region texts that a worker holds before it hands them on.
CUT_ROWS = 4_096

_B = 0x9E3779B97F4A7C15
_BI = pow(_B, -1, 1 << 64)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 2 * len(_pow), 1 << 12)
        for name, base in (("_pow", _B), ("_inv", _BI)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            globals()[name] = np.multiply.accumulate(x)
    return _pow[:n], _inv[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of any stretch of a text's words."""

    def __init__(self, words: list[bytes]):
        self.n = len(words)
        h = np.fromiter(map(workspace("words", _Hashes).__getitem__, words), np.uint64, self.n)
        p, self.inv = _powers(self.n + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * p[: self.n], dtype=np.uint64)])

    def stretch(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inv[start])


def regions(words: list[bytes], window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (anchor's hash, first window, last window); windows are numbered by their first word."""
    n = len(words)
    if n < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    roll = Rolling(words)
    at = np.arange(n - anchor + 1)
    value, place = roll.stretch(at, at + anchor), at
    grams = value
    span, want = 1, window - anchor + 1
    while span < want:
        step = min(span, want - span)
        a, b = value[:-step], value[step:]
        right = b <= a
        place = np.where(right, place[step:], place[:-step])
        value = np.where(right, b, a)
        span += step
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    return grams[place[first]], first, last


def contents(words: list[bytes], first: np.ndarray, end: np.ndarray) -> list[bytes]:
    """A digest of the words first to end - 1 of each stretch."""
    joined = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], stops))
    return [xxhash.xxh3_128_digest(joined[a:b]) for a, b in zip(starts[first].tolist(), (stops[end - 1] - 1).tolist(), strict=True)]


# ---- the index -------------------------------------------------------------------------------------------------

#: Rows between sampled minimums.
SAMPLE = 32


class WaveletMatrix:
    """Bit vectors of the symbols' bits, highest first, each stably sorted by the bits before; ones are counted before each
    64 bits, by 16-bit numbers within blocks of 2 ** 16 bits."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels = []
        n = len(symbols)
        for shift in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(np.uint8)
            words = np.zeros(n // 64 + 1, np.uint64)
            packed = np.packbits(bit, bitorder="little")
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1]
            block = before[:: 1 << 10].astype(np.int64)
            within = (before - np.repeat(block, 1 << 10)[: len(before)]).astype(np.uint16)
            zeros = n - int(bit.sum())
            self.levels.append((shift, zeros, words, within, block))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place on the last level of the symbol's occurrences before ``at``: a rank, but for a constant of the symbol."""
        for shift, zeros, words, within, block in self.levels:
            word = at >> 6
            low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = block[at >> 16] + within[word] + np.bitwise_count(words[word] & low)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def nbytes(self) -> int:
        return sum(x.nbytes for _, _, *parts in self.levels for x in parts)


class FMIndex:
    """Of word sequences, each with an owner; tells which stretches of a sequence a smaller owner has."""

    def __init__(self, texts: list[list[bytes]], owners: np.ndarray):
        number: dict[bytes, int] = {}
        parts = []
        for words in texts:
            parts += [number.setdefault(w, len(number) + 1) for w in words]
            parts.append(0)
        text = np.array(parts, np.int32)
        sizes = np.array([len(w) + 1 for w in texts], np.int64)
        order = _suffixes(text, int(sizes.max(initial=1)))
        self.owners, rank = np.unique(owners, return_inverse=True)
        small = np.uint16 if len(self.owners) < 1 << 16 else np.int32
        self.rows = np.repeat(rank, sizes)[order].astype(small)  # whose each suffix is
        self.samples = [np.minimum.reduceat(self.rows, np.arange(0, len(text), SAMPLE))]  # minimums over 1, 2, 4 ... samples
        while (step := 1 << (len(self.samples) - 1)) * 2 <= len(self.samples[0]):
            self.samples.append(np.minimum(self.samples[-1][:-step], self.samples[-1][step:]))
        self.matrix = WaveletMatrix(text[order - 1], len(number))
        first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(number) + 1))))[:-1]  # rows of suffixes with a smaller word
        self.shift = (first - self.matrix.place(np.arange(len(number) + 1), np.zeros(len(number) + 1, np.int64))).astype(np.int32)
        self.n = len(text)
        self.streams, self.starts = text, np.cumsum(sizes) - sizes

    def nbytes(self) -> int:
        """Of the index, without the texts that are streamed."""
        return self.matrix.nbytes() + self.rows.nbytes + sum(x.nbytes for x in self.samples) + self.shift.nbytes

    def smallest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner's rank over rows lo to hi - 1 (not empty): from samples between, from rows at the ends."""
        a, b = -(-lo // SAMPLE), hi // SAMPLE
        inner = a < b
        out = np.full(len(lo), len(self.owners), np.int64)
        for begin, end in ((lo, np.where(inner, a * SAMPLE, hi)), (np.where(inner, b * SAMPLE, hi), hi)):
            size = end - begin
            some = np.flatnonzero(size)
            if len(some):
                edge = np.cumsum(size[some]) - size[some]
                rows = np.repeat(begin[some] - edge, size[some]) + np.arange(int(size[some].sum()))
                out[some] = np.minimum(out[some], np.minimum.reduceat(self.rows[rows], edge))
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level[inner]):
            at = np.flatnonzero(inner & (level == k))
            t = self.samples[k]
            out[at] = np.minimum(out[at], np.minimum(t[a[at]], t[b[at] - (1 << int(k))]))
        return out

    def reach(self, who: np.ndarray, end: np.ndarray, own: np.ndarray, least: int) -> np.ndarray:
        """Where the longest stretch begins that ends at ``end`` and that others have, too (from ``least`` words on: a
        smaller owner than ``own``): words are taken from right to left, all sequences together."""
        size = np.zeros(len(who), np.int64)
        live, at, low, high = np.arange(len(who)), self.starts[who] + end, np.zeros(len(who), np.int64), np.full(len(who), self.n)
        for step in range(1, int(end.max(initial=0)) + 1):
            inside = step <= end[live]
            live, low, high = live[inside], low[inside], high[inside]
            c = self.streams[at[live] - step]
            both = self.matrix.place(np.concatenate([c, c]), np.concatenate([low, high]))
            low, high = both[: len(c)] + self.shift[c], both[len(c) :] + self.shift[c]
            go = high - low > 1
            if step >= least:
                far = np.flatnonzero(go)
                go[far] = self.smallest(low[far], high[far]) < own[live[far]]
            live, low, high = live[go], low[go], high[go]
            if not len(live):
                break
            size[live] = step
        return end - size

    def matches(self, lengths: np.ndarray, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, start, end): stretches of at least ``least`` words that a smaller owner has, too, so that each window
        of ``least`` words that a smaller owner has lies in one. ``own``: the sequences' owners' ranks.

        Where the longest stretch to an end begins, its matching statistic, never falls as the end moves right. So ends between two
        with one beginning are settled by the right one, and others are halved until none is left.
        """
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def reached(who: np.ndarray, end: np.ndarray) -> np.ndarray:
            start = self.reach(who, end, own[who], least)
            hit = end - start >= least
            found.append((who[hit], start[hit], end[hit]))
            return start

        who = np.flatnonzero(lengths >= least)
        e1, e2 = np.full(len(who), least), lengths[who].astype(np.int64)
        s1, s2 = reached(who, e1), reached(who, e2)
        while True:
            open_ = (e2 - e1 > 1) & (s1 < s2) & (e2 - 1 - s1 >= least)
            who, e1, s1, e2, s2 = (x[open_] for x in (who, e1, s1, e2, s2))
            if not len(who):
                return tuple(np.concatenate(x) for x in zip(*found, strict=True))
            mid = (e1 + e2) // 2
            start = reached(who, mid)
            who, e1, s1, e2, s2 = (np.concatenate(x) for x in ((who, who), (e1, mid), (s1, start), (mid, e2), (start, s2)))


def _suffixes(text: np.ndarray, longest: int) -> np.ndarray:
    """Suffixes in the order of at least their first ``longest`` words, by doubling."""
    n, rank, span = len(text), text.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while span <= longest:
        key = rank * (n + 1)
        key[: n - span] += rank[span:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        span *= 2
        if fresh[-1] == n - 1:
            break
    return order


# ---- the operator ----------------------------------------------------------------------------------------------

_SCAN = "doc_id long, same long, n_words long, words_sha256 string, fp array<long>, content array<binary>, more array<int>, firsts array<array<int>>"


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _scan(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, rows = [], [], []
            for text in batch["text"]:
                words = text.as_py().encode("utf-8", "surrogatepass").split()
                n.append(len(words))
                sha.append(_digest(words))
                fp, first, last = regions(words, window, anchor)
                own: dict[bytes, list] = {}  # a region that a document repeats is one row with all its places
                for key, content, a, b in zip(fp.view(np.int64).tolist(), contents(words, first, last + window) if len(first) else (), first.tolist(), last.tolist(), strict=True):
                    own.setdefault(content, [key, b - a, []])[2].append(a)
                rows.append(own)
            column = lambda k, t: pa.array([[r[k] for r in own.values()] for own in rows], pa.list_(t))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), column(0, pa.int64()), pa.array(map(list, rows), pa.list_(pa.binary())), column(1, pa.int32()), column(2, pa.list_(pa.int32()))], names=["doc_id", "same", "n_words", "words_sha256", "fp", "content", "more", "firsts"])

    return run


_TEXTS = "key long, fp long, content binary, idx int, owner long, text binary"


def _cut(window: int):
    """Region texts of documents; regions of hot anchors as one row a window (idx from 0; -1: a whole region)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary())

        def made(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "fp", "content", "idx", "owner", "text"])

        for batch in batches:
            rows = []
            for doc, text, found in zip(batch["doc_id"], batch["text"], batch["found"], strict=True):
                doc, words = doc.as_py(), text.as_py().encode("utf-8", "surrogatepass").split()
                for r in found.as_py():
                    if len(rows) >= CUT_ROWS:
                        yield made(rows)
                        rows = []
                    a, b = r["first"], r["last"]
                    if not r["hot"]:
                        rows.append((r["fp"], r["fp"], r["content"], -1, doc, b" ".join(words[a : b + window])))
                        continue
                    for i in range(a, b + 1):
                        part = b" ".join(words[i : i + window])
                        rows.append((xxhash.xxh64_intdigest(part) - (1 << 63), r["fp"], r["content"], i - a, doc, part))
            yield made(rows)

    return run


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = "fp long, content binary, owner long, spans array<struct<a:int,b:int>>"


def _search(window: int):
    """The stretches of each region that a smaller document has, too."""

    def run(table: pa.Table) -> pa.Table:
        texts = [t.split() for t in table["text"].to_pylist()]
        index = FMIndex(texts, owners := table["owner"].to_numpy())
        own = np.searchsorted(index.owners, owners)
        spans: list[list[dict[str, int]]] = [[] for _ in texts]
        for k, a, b in zip(*(x.tolist() for x in index.matches(np.array([*map(len, texts)]), own, window)), strict=True):
            spans[k].append({"a": a, "b": b})
        return pa.table({"fp": table["fp"], "content": table["content"], "owner": table["owner"], "spans": pa.array(spans, _SPANS)})

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, sha, kept_texts = [], [], []
        for text, spans in zip(batch["text"], batch["spans"], strict=True):
            words = text.as_py().encode("utf-8", "surrogatepass").split()
            gone = np.zeros(len(words) + 1, np.int32)
            for s in spans.as_py():
                gone[s["a"]] += 1
                gone[s["b"]] -= 1
            kept = [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]
            removed.append(len(words) - len(kept))
            sha.append(_digest(kept))
            kept_texts.append(b" ".join(kept).decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(kept_texts, pa.string())], names=["doc_id", "same", "n_removed", "kept_sha256", "kept"])


def _split(single: DataFrame, window: int) -> DataFrame:
    """``_FOUND`` for regions given as windows: a window's smallest document is that of the group of equal words."""
    least = single.groupBy("key", "text").agg(F.min("owner").alias("least"))
    hit = single.join(least, ["key", "text"]).select("fp", "content", "owner", F.when(F.col("least") < F.col("owner"), F.struct(F.col("idx").alias("a"), (F.col("idx") + window).alias("b"))).alias("span"))
    return hit.groupBy("fp", "content", "owner").agg(F.collect_list("span").alias("spans"))  # a region's own windows


def repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_words: int = SHARD_WORDS, hot: int = HOT_REGIONS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, tuple[DataFrame, ...]]:
    """A row for each document (doc_id, same, n_words, words_sha256), and a row for each that loses words: doc_id, same (hash
    of its text), spans (stretches of removed words a to b - 1), text; and the staged tables that the latter are read from."""
    texts = narrow(docs, id_col, text_col).withColumn("same", F.xxhash64("text"))
    scanned = staged(texts.select("doc_id", "same", "text").mapInArrow(_scan(window, anchor), _SCAN), "scan")
    anchors = scanned.where("doc_id is not null").select("doc_id", "same", F.inline(F.arrays_zip("fp", "content", "more", "firsts")))
    shared = staged(anchors.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("fp"), "shared")
    hits = staged(anchors.join(shared, "fp", "left_semi"), "hits", frees=(shared,))
    distinct = hits.groupBy("fp", "content").agg(F.min(F.struct("doc_id", "same", F.col("firsts")[0].alias("first"), "more")).alias("rep"))
    distinct = staged(distinct.select("fp", "content", "rep.doc_id", "rep.same", "rep.first", (F.col("rep.first") + F.col("rep.more")).alias("last")), "regions")
    many = staged(distinct.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp", (F.col("n") > hot).alias("hot")), "many")
    marked = staged(distinct.join(many, "fp").select("doc_id", "same", "fp", "content", "first", "last", "hot"), "marked", frees=(many,))
    words = marked.agg(F.sum(F.col("last") - F.col("first") + window)).first()[0] or 0
    found = marked.groupBy("doc_id", "same").agg(F.collect_list(F.struct("fp", "content", "first", "last", "hot")).alias("found"))  # a document's own regions
    wanted = hits.select("doc_id", "same").distinct().join(found, ["doc_id", "same"], "left")
    candidates = staged(texts.join(wanted, ["doc_id", "same"]).dropDuplicates(["doc_id", "same"]), "candidates", frees=(marked,))
    cut = staged(candidates.where("found is not null").select("doc_id", "text", "found").mapInArrow(_cut(window), _TEXTS), "cut")
    shards = max(1, -(-words // shard_words))
    whole = cut.where("idx < 0").select("fp", "content", "owner", "text").withColumn("shard", F.pmod(F.xxhash64("fp"), F.lit(shards)))
    searched = whole.groupBy("shard").applyInArrow(_search(window), _FOUND)
    none = F.array().cast("array<struct<a:int,b:int>>")
    known = searched.unionByName(_split(cut.where("idx >= 0"), window)).where(F.size("spans") > 0)
    known = distinct.select("fp", "content", F.col("doc_id").alias("owner")).join(known.drop("owner"), ["fp", "content"], "left").withColumn("spans", F.coalesce("spans", none))
    known = staged(known, "found", frees=(cut, distinct))
    # a document after a region's smallest one loses the whole region
    losing = hits.join(known, ["fp", "content"]).where((F.col("doc_id") > F.col("owner")) | (F.size("spans") > 0))
    every = F.array(F.struct(F.lit(0).alias("a"), (F.col("more") + window).alias("b")))
    placed = losing.select("doc_id", "same", F.explode("firsts").alias("first"), F.when(F.col("doc_id") > F.col("owner"), every).otherwise(F.col("spans")).alias("spans"))
    ranges = placed.select("doc_id", "same", "first", F.inline("spans")).select("doc_id", "same", F.struct((F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")).alias("span"))
    spans = ranges.groupBy("doc_id", "same").agg(F.array_sort(F.collect_list("span")).alias("spans"))  # a document's own stretches
    return scanned.select("doc_id", "same", "n_words", "words_sha256"), candidates.select("doc_id", "same", "text").join(spans, ["doc_id", "same"]), (hits, known, candidates)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by a space; null where nothing goes)."""
    scanned, losing, used = repeats(docs, **options)
    changed = losing.select("doc_id", "same", "text", "spans").mapInArrow(_remove, "doc_id long, same long, n_removed long, kept_sha256 string, kept string")
    changed = staged(changed, "changed", frees=used)
    return scanned.join(changed, ["doc_id", "same"], "left").select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "words_sha256").alias("kept_sha256"), "kept")
