"""Best-fit packing of token sequences by linear grouping.

Documents longer than a sequence are cut into full pieces; what is left is packed. The plan is made on the histogram
of lengths alone, which has no more rows than a sequence has tokens:

1. Large lengths (over an eighth of a sequence) are sorted and cut into at most GROUPS groups of equal cardinality; within a
   group all count as its largest.
2. Over these few sizes, configurations (which sizes share a sequence) are optimised: the linear programme of fewest
   sequences is solved by column generation, where a new configuration is the best filling under the sizes' prices.
3. Real lengths take the places: each place the longest that its rounded size allows, the last one the longest that fits the
   room left; where more fits, it is added. So what rounding had left over gathers in the last sequences.
4. Small lengths, longest first, go best-fit into the room left, then into new sequences.

Each decision is for a run of sequences with equal contents, so the plan stays small, and every piece finds its
place from its length and its rank among the pieces of that length. Nothing about a document reaches the driver.

Defined results: a null or empty text is only the end id; equal lengths are interchangeable, ranked by the order
in which partitions read them; repeated rows are packed each; an empty table gives no piece.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kernel_slices, narrow, staged
from .tokens import encoder

CAPACITY = 2048
GROUPS = 24
#: Lengths up to this part of a sequence are small.
SMALL_PART = 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, nth long"


def _cutter(path: str, pieces: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, pid, seen = encoder(path, pieces), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            texts, names = batch["text"].to_pylist(), batch["doc_id"].to_pylist()
            for lo, hi in kernel_slices(texts):
                flat, counts = enc.encode_flat(texts[lo:hi], end_id)
                flat, at, rows = flat.astype("<u4"), 0, []
                for name, n in zip(names[lo:hi], counts.tolist(), strict=True):
                    for k, start in enumerate(range(0, n, capacity)):
                        part = flat[at + start : at + min(n, start + capacity)]
                        rows.append((name, k, start, len(part), zlib.crc32(part), pid, seen[len(part)]))
                        seen[len(part)] += 1
                    at += n
                doc, k, start, n, crc, p, nth = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(k, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "pid": pa.array(p, pa.int32()), "nth": pa.array(nth, pa.int64())})

    return run


def _groups(large: list[tuple[int, int]], groups: int) -> tuple[list[int], list[int]]:
    """(length, count) descending to rounded sizes, at most ``groups``, and how many pieces count as each."""
    total = sum(c for _, c in large)
    each = -(-total // groups) or 1
    sizes, counts, room = [], [], 0
    for length, count in large:
        while count:
            if not room:
                room = each
                if not sizes or sizes[-1] != length:  # else this group rounds to the last one's size
                    sizes.append(length)
                    counts.append(0)
            take = min(room, count)
            counts[-1] += take
            count, room = count - take, room - take
    return sizes, counts


def _best_filling(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of sizes within the capacity, and its price: dynamic programming by number of pieces."""
    layers, picks = [np.zeros(capacity + 1)], []
    for _ in range(capacity // int(sizes.min())):
        last = layers[-1]
        new, pick = last.copy(), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes.tolist()):
            value = last[: capacity + 1 - s] + prices[i]
            better = value > new[s:] + 1e-12
            new[s:][better], pick[s:][better] = value[better], i
        if not (pick >= 0).any():
            break
        layers.append(new)
        picks.append(pick)
    use, room = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if pick[room] >= 0:
            use[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(layers[-1][capacity]), use


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations (sizes, descending) of an optimal solution of the linear programme, with the whole part of how often
    each is used; what is missing for whole numbers is at most a configuration a size."""
    m = len(sizes)
    if not m:
        return []
    size, need = np.array(sizes), np.array(counts, float)
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    for _ in range(40 * m):
        x = inverse @ need
        value, new = _best_filling(size, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        columns[:, out] = new
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    uses = np.floor(inverse @ need + 1e-6)
    found = [([s for s, k in zip(sizes, columns[:, j].astype(int).tolist(), strict=True) for _ in range(k)], int(n)) for j, n in enumerate(uses) if n > 0]
    return sorted(found, reverse=True)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces a sequence, first sequence, offset), sorted, and the number of sequences.

    The piece of rank r goes to sequence first + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length.
    """
    small_to = capacity // SMALL_PART
    large = sorted(((n, c) for n, c in histogram.items() if n > small_to and c), reverse=True)
    runs: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # tokens left: runs of (first sequence, sequences, used)
    next_seq = 0
    left, rank = dict(large), dict.fromkeys((n for n, _ in large), 0)
    alive = sorted(left)  # lengths of which some are left

    def longest(most: int, chosen: Counter) -> int:
        k = bisect.bisect_right(alive, most) - 1
        while k >= 0 and left[alive[k]] <= chosen[alive[k]]:
            k -= 1
        return alive[k] if k >= 0 else 0

    todo = configurations(*_groups(large, groups), capacity)[::-1]
    while alive:
        places, times = todo.pop() if todo else ([alive[-1]], left[alive[-1]])
        while times and alive:
            chosen, free = Counter(), capacity
            for place in [*places[:-1], capacity, *[capacity] * SMALL_PART]:
                if length := longest(min(place, free), chosen):
                    chosen[length] += 1
                    free -= length
            n = min(times, *(left[length] // k for length, k in chosen.items()))
            used = 0
            for length, k in chosen.items():
                runs.append((length, rank[length], k, next_seq, used))
                used += k * length
                rank[length] += k * n
                left[length] -= k * n
                if not left[length]:
                    alive.pop(bisect.bisect_left(alive, length))
            room[free].append((next_seq, n, used))
            next_seq, times = next_seq + n, times - n
    open_rooms = sorted(r for r in room if r)
    for length in range(small_to, 0, -1):
        left, rank = histogram.get(length, 0), 0
        while left:
            k = bisect.bisect_left(open_rooms, length)
            if k == len(open_rooms):
                each = capacity // length
                first, n, used, r = next_seq, max(1, left // each), 0, capacity
                next_seq += n
            else:
                r = open_rooms[k]
                first, n, used = room[r].pop()
                if not room[r]:
                    open_rooms.pop(k)
            each = min(r // length, left)
            filled = min(n, left // each)
            runs.append((length, rank, each, first, used))
            left, rank = left - each * filled, rank + each * filled
            for size, run in ((r - each * length, (first, filled, used + each * length)), (r, (first + filled, n - filled, used))):
                if size and run[1]:
                    if not room[size]:
                        bisect.insort(open_rooms, size)
                    room[size].append(run)
    return sorted(runs), next_seq


def _placer(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(zero_copy_only=False), batch["rank"].to_numpy(zero_copy_only=False)
            k = np.searchsorted(table["key"], (length << 48) | rank, side="right") - 1
            ahead = rank - table["rank"][k]
            seq = table["first"][k] + ahead // table["each"][k]
            offset = table["offset"][k] + ahead % table["each"][k] * length
            yield pa.RecordBatch.from_arrays([batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, pieces: str = "words", end_id: int = 0, capacity: int = CAPACITY, groups: int = GROUPS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; a row for each piece."""
    cut = staged(narrow(docs, id_col, text_col).mapInArrow(_cutter(tokenizer, pieces, end_id, capacity), _PIECES), "pieces")
    counts = cut.groupBy("length", "pid").agg(F.count("*").alias("n"))
    earlier = counts.select("length", "pid", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("earlier"))
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity, groups)
    cols = np.array(runs, np.int64).reshape(-1, 5)
    table = {"key": (cols[:, 0] << 48) | cols[:, 1], "rank": cols[:, 1], "each": cols[:, 2], "first": cols[:, 3], "offset": cols[:, 4]}
    ranked = cut.join(earlier, ["length", "pid"]).withColumn("rank", F.col("earlier") + F.col("nth"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_placer(table), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
