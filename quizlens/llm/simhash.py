"""SimHash near-duplicates: fingerprints in Python workers, links by sharded BK-trees, classes by star contraction.

Two fingerprints of 64 bits that differ in at most r bits agree on at least b - r of b bit blocks (pigeonhole),
so each choice of b - r blocks routes a fingerprint to a shard, and any pair within the radius meets in one of
them. A shard's distinct fingerprints form a BK-tree (children keyed by Hamming distance to the parent); each one
is looked up before it is inserted, following only edges within the radius. The trees together grow with the
corpus, so they are not broadcast whole: a shard's tree is built where the shuffle has put its queries. b grows with the
number of fingerprints only to keep shards small; any b gives the same links.

A shard reports each fingerprint with its shard's class representative, not all pairs, so the output is linear.
A shard beyond SHARD_LIMIT fingerprints is dealt into chunks; every pair of chunks is a task of its own.

Defined results: null and empty texts have no shingle and fingerprint zero, linked like any other; fewer words
than a shingle make one shingle of all words; repeated rows give one row each; a null id never becomes a
component's name unless its component has no other id; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, narrow, released, staged

SHINGLE_WORDS = 4
RADIUS = 4
SEED = 42
#: Fingerprints in one tree; larger shards are searched as pairs of chunks.
SHARD_LIMIT = 4096
#: Fingerprints that a shard should hold on average, for choosing the number of blocks.
SHARD_AIM = 64
_U64 = (1 << 64) - 1


def fingerprint(text: str, k: int = SHINGLE_WORDS) -> int:
    """Bit i is set where more than half of the shingles' XXH64 (repeats included) have it; 0 without words."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six ASCII spaces matter
    if not ws:
        return 0
    joined = b" ".join(ws)
    digest = xxhash.xxh64_digest
    if len(ws) <= k:
        hashes = digest(joined, SEED)
        n = 1
    else:
        ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1)
        starts = (ends - np.fromiter(map(len, ws), np.int64, len(ws)) - 1).tolist()
        stops = (ends[k - 1 :] - 1).tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=False)])
        n = len(stops)
    raw = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, 8192):
        ones += np.unpackbits(raw[lo : lo + 8192], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            prints = np.array([fingerprint(t, k) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "fp": pa.array(prints.view(np.int64), pa.int64())})

    return run


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, fp long (the 64 bits as a signed number)."""
    return narrow(docs, id_col, text_col).mapInArrow(_fingerprints(shingle_words), "doc_id long, fp long")


class BKTree:
    """Nodes are distinct 64-bit codes; a node's children are keyed by their Hamming distance to it."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, code: int) -> int:
        at = 0
        if not self.codes:
            self.codes.append(code)
            self.children.append({})
            return 0
        while True:
            d = (self.codes[at] ^ code).bit_count()
            if d == 0:
                return at
            below = self.children[at].get(d)
            if below is None:
                self.children[at][d] = new = len(self.codes)
                self.codes.append(code)
                self.children.append({})
                return new
            at = below

    def within(self, code: int, radius: int) -> Iterator[int]:
        stack = [0] if self.codes else []
        codes, children = self.codes, self.children
        while stack:
            at = stack.pop()
            d = (codes[at] ^ code).bit_count()
            if d <= radius:
                yield at
            for edge, below in children[at].items():
                if d - radius <= edge <= d + radius:
                    stack.append(below)


def _classes(tree_codes: list[int], query_codes: list[int], radius: int, same: bool) -> dict[int, int]:
    """Each linked code with the smallest code of its class, linking queries with the tree's codes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    tree = BKTree()
    if not same:
        for c in tree_codes:
            tree.insert(c)
    for q in query_codes:
        for at in tree.within(q, radius):
            a, b = root(q), root(tree.codes[at])
            if a != b:
                parent[max(a, b)] = min(a, b)
        if same:
            tree.insert(q)
    return {c: r for c in {*tree_codes, *query_codes} if (r := root(c)) != c}


def _link(radius: int):
    """Rows come sorted by shard; a shard's rows are consecutive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tree, queries = None, [], []

        out_a, out_b = [], []

        def settle():
            links = _classes([x & _U64 for x in tree], [x & _U64 for x in queries], radius, not tree)
            out_a.extend(links.keys())
            out_b.extend(links.values())

        def batch_out():
            made = pa.RecordBatch.from_pydict({"a": pa.array(np.array(out_a, np.uint64).view(np.int64)), "b": pa.array(np.array(out_b, np.uint64).view(np.int64))})
            out_a.clear()
            out_b.clear()
            return made

        for batch in batches:
            for shard, side, fp in zip(batch["shard"].to_pylist(), batch["side"].to_pylist(), batch["fp"].to_pylist(), strict=True):
                if shard != key:
                    if len(tree) + len(queries) > 1:
                        settle()
                    key, tree, queries = shard, [], []
                (tree if side == 0 else queries).append(fp)
            if out_a:
                yield batch_out()
        if len(tree) + len(queries) > 1:
            settle()
        if out_a:
            yield batch_out()

    return run


def _choice(n: int, radius: int) -> tuple[int, list[tuple[int, ...]]]:
    """Number of blocks and the choices of agreeing blocks; the smallest number whose keys spread n fingerprints."""
    for blocks in range(radius + 1, radius + 5):
        if n / 2 ** (64 * (blocks - radius) // blocks) <= SHARD_AIM:
            break
    return blocks, list(combinations(range(blocks), blocks - radius))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _pairs_of_chunks(rows: DataFrame, chunks: str, sides: list[str]) -> DataFrame:
    """``rows`` with side and (i, j) for each task they belong to; see ``_dealt``."""
    task = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    mine, none = F.col("mine"), F.array().cast("array<struct<i:int,j:int,side:int>>")
    queries = F.transform(F.sequence(F.lit(0), mine), lambda i: task(i, mine, 1))
    trees = F.when(mine + 1 < F.col(chunks), F.transform(F.sequence(mine + 1, F.col(chunks) - 1), lambda j: task(mine, j, 0))).otherwise(none)
    return rows.select(*sides, F.inline(F.concat(queries, trees)))


def _dealt(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Rows of ``nodes`` (with ``fp``) for each shard they belong to: those that agree in one of the masks.

    A shard beyond SHARD_LIMIT rows is dealt into chunks. A row of chunk c is a tree's code (side 0) in the tasks
    (c, j) for j > c and a query (side 1) in (i, c) for i <= c; (c, c) has queries only, and they are its tree.
    """
    keyed = nodes.select("*", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("t", "k"))
    sizes = keyed.groupBy("t", "k").count().where("count > 1")
    keyed = keyed.join(sizes, ["t", "k"]).withColumn("chunks", F.ceil(F.col("count") / F.lit(SHARD_LIMIT)).cast("int"))
    keyed = keyed.withColumn("mine", F.pmod(F.xxhash64(*nodes.columns, "t"), F.col("chunks")).cast("int"))
    dealt = _pairs_of_chunks(keyed, "chunks", [*nodes.columns, "t", "k"]).select(*nodes.columns, "side", F.xxhash64("t", "k", "i", "j").alias("shard"))
    return dealt.repartition("shard").sortWithinPartitions("shard")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints ``fp`` to (a, b): a linked with b < a (unsigned); the links' classes are those of all pairs within the radius."""
    blocks, choices = _choice(prints.count(), radius)
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in c) for c in choices]
    return _dealt(prints.select("fp"), masks).mapInArrow(_link(radius), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of any numbers to (node, comp): the smallest node reachable. Alternating large and small stars.

    Each round is a join and two aggregations with map-side minimums, written to the shared folder; the number of
    rounds grows with the logarithm of the largest component.
    """
    edges = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = staged(large.where("a <> b").distinct(), "stars")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = staged(small.where("a <> b").distinct(), "stars", frees=(edges, large))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp"))


def near_duplicates(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links of at most ``radius`` differing bits."""
    prints = staged(fingerprints(docs, shingle_words, id_col, text_col), "simhash")
    names = staged(prints.groupBy("fp").agg(F.min("doc_id").alias("own")), "names")
    linked = staged(links(names.select("fp"), radius), "pairs")
    # classes are found over fingerprints; a class then takes its smallest document
    comp = components(linked)
    free(linked)
    member = comp.withColumnRenamed("node", "fp")
    member = member.unionByName(member.select(F.col("comp").alias("fp"), "comp").distinct())
    member = member.join(names, "fp")
    smallest = member.groupBy("comp").agg(F.min("own").alias("component_id"))
    moved = member.join(smallest, "comp").select("fp", "component_id")
    named = staged(names.join(moved, "fp", "left").select("fp", F.coalesce("component_id", "own").alias("component_id")), "classes", frees=(names,))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


# ---- groups of similar texts -----------------------------------------------------------------------------------
# The classes of near_duplicates come first: each is a candidate group, whose texts are compared on whole sets of shingles, as
# a fingerprint may be that of a run which different texts share. Copies may also lie beyond the radius. Texts that agree in a
# band of minima over their distinct shingles may be similar, whatever the kind of edit and however often a line is repeated.
# Texts joined by such bands, directly or over others, form a candidate group, too; it is compared unless the classes have
# made one class of it already. A group's pivot is the text that shares bands with most others, as an original does with its
# copies. All are compared with the pivot; those that are similar are linked and need no comparison with each other. What is
# left is compared among itself, and with the linked ones as far as their distances from the pivot allow (1 - similarity is a
# metric). So a hot group of copies of one text takes work in proportion to its size, no text has only some partners, and the
# classes do not depend on any order.

SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Bands of MinHash minima; texts that share a part s of their shingles agree in a band with probability
#: 1 - (1 - s ** BAND_MINIMA) ** BANDS: 0.9998 at 0.8, 0.36 at 0.5.
BANDS, BAND_MINIMA = 28, 6
#: Shingles in one comparison; larger groups are compared as pairs of chunks.
COMPARE_LIMIT = 1_000_000


def shingle_hashes(text: str, k: int = SIMILAR_WORDS) -> np.ndarray:
    """Sorted hashes of the distinct k-word shingles; blank texts have one, of no word."""
    ws = text.encode("utf-8", "surrogatepass").lower().split()
    hashes = {xxhash.xxh64_digest(b" ".join(ws[i : i + k]), SEED) for i in range(max(1, len(ws) - k + 1))}
    return np.sort(np.frombuffer(b"".join(hashes), np.int64))


_MIX = np.array([xxhash.xxh64_intdigest(str(i).encode(), 9) | 1 for i in range(BANDS * BAND_MINIMA)], np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: texts of equal key agree in all its minima."""
    low = np.full(len(_MIX), _U64, np.uint64)
    for lo in range(0, len(hashes), 512):
        x = hashes[lo : lo + 512].view(np.uint64) * _MIX[:, None]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(low, x.min(axis=1), out=low)
    keys = np.zeros(BANDS, np.uint64)
    for part in low.reshape(BANDS, BAND_MINIMA).T:
        keys = (keys ^ part) * np.uint64(0xBF58476D1CE4E5B9)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


def _banded(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            keys = [band_keys(shingle_hashes(t.as_py(), k)) for t in batch["text"]]
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64), pa.int64())
            offsets = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["same"], pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "same", "keys"])

    return run


def _shingled(k: int):
    """Each text's set of shingles and its size, in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        released()
        for batch in batches:
            sets = [shingle_hashes(t.as_py(), k) for t in batch["text"]]
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(map(len, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=[*names, "n", "shingles"])

    return run


def similar_classes(held: list[np.ndarray], asked: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """A class number for each of ``held`` and then of ``asked``, all of whose sets are compared with all of ``held``
    (None: ``held`` with each other). How many shingles two sets share is counted exactly, on an inverted index."""
    n = len(held)
    sizes = np.array([*map(len, held)], np.int64)
    flat = np.concatenate(held)
    order = np.argsort(flat, kind="stable")
    owner = np.repeat(np.arange(n), sizes)[order]
    known, starts = np.unique(flat[order], return_index=True)
    starts = np.append(starts, len(flat))
    label = np.arange(n + len(asked or ()))
    for i, x in enumerate(asked if asked is not None else held, n if asked is not None else 0):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        at = at[known[at] == x]
        many = starts[at + 1] - starts[at]
        if not len(at):
            continue
        places = np.repeat(starts[at] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        shared = np.bincount(owner[places], minlength=n)
        for j in np.unique(label[:n][shared >= similarity * (len(x) + sizes - shared)]):
            if j != label[i]:
                label[label == max(j, label[i])] = min(j, label[i])
    return label


def _compare(similarity: float):
    """Rows come sorted by shard; each row with the smallest row of its class in the shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, ([], []), ([], [])
        out: list[tuple[int, int]] = []

        def settle() -> None:
            every = [*names[0], *names[1]]
            if len(every) > 1:
                label = similar_classes(sets[0], sets[1], similarity) if sets[0] else similar_classes(sets[1], None, similarity)
                least: dict[int, int] = {}
                for name, c in zip(every, label.tolist(), strict=True):
                    least[c] = min(name, least.get(c, name))
                out.extend((name, least[c]) for name, c in zip(every, label.tolist(), strict=True) if name != least[c])

        for batch in batches:
            for shard, side, same, shingles in zip(*(batch[c].to_pylist() for c in ("shard", "side", "same", "shingles")), strict=True):
                if shard != key:
                    settle()
                    key, names, sets = shard, ([], []), ([], [])
                names[side].append(same)
                sets[side].append(np.frombuffer(shingles, np.int64))
            if out:
                yield _edges(out)
                out.clear()
        settle()
        if out:
            yield _edges(out)

    return run


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _whole(comp: DataFrame) -> DataFrame:
    """``components`` with a row for each smallest node, too."""
    return comp.unionByName(comp.select(F.col("comp").alias("node"), "comp").distinct())


def _to_pivot(similarity: float):
    """Each row's similarity with its group's pivot, as its role: "near", or "far" or "beyond" (too far for any near one)."""
    reach = 1 - 2 * (1 - similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = []
            for mine, other in zip(batch["shingles"], batch["pivot_shingles"], strict=True):
                x, y = np.frombuffer(mine.as_py(), np.int64), np.frombuffer(other.as_py(), np.int64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - shared
                roles.append("near" if shared >= similarity * total else "far" if shared >= reach * total else "beyond")
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("same", "comp", "pivot", "n", "shingles")), pa.array(roles, pa.string())], names=["same", "comp", "pivot", "n", "shingles", "role"])

    return run


def _across(rows: DataFrame) -> DataFrame:
    """``rows`` (with role, mine, and the numbers of chunks) for each task of far ones with near ones."""
    far = F.col("role") == "far"
    tasks = F.transform(F.sequence(F.lit(0), F.when(far, F.col("near_chunks")).otherwise(F.col("far_chunks")) - 1), lambda k: F.struct(F.when(far, F.col("mine")).otherwise(k).alias("i"), F.when(far, k).otherwise(F.col("mine")).alias("j"), far.cast("int").alias("side")))
    return rows.where("near_chunks > 0 and far_chunks > 0 and role <> 'beyond'").select("comp", "same", "shingles", F.inline(tasks))


def _led(member: DataFrame, comp: str, pivot: str) -> DataFrame:
    """doc_id, same, and the candidate group and its pivot, named ``comp`` and ``pivot``, of texts with a score each."""
    best = member.groupBy("comp").agg(F.max(F.struct("score", "same")).alias("best")).select("comp", F.col("best.same").alias(pivot))
    return member.join(best, "comp").select("doc_id", "same", F.col("comp").alias(comp), pivot)


def _checked(sets: DataFrame, similarity: float, frees: tuple[DataFrame, ...] = ()) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(a, b): texts (by ``same``) and another of their class, by comparisons in their candidate groups (``comp``); and the
    staged tables that these rows are read from."""
    lead = staged(sets.where("same = pivot").select("comp", F.col("shingles").alias("pivot_shingles")), "pivots")
    told = sets.join(lead, "comp").mapInArrow(_to_pivot(similarity), "same long, comp long, pivot long, n long, shingles binary, role string")
    told = staged(told, "roles", frees=(lead, *frees))
    size = lambda role: F.ceil(F.sum(F.when(role, F.col("n")).otherwise(0)) / F.lit(COMPARE_LIMIT)).cast("int")
    is_near, is_far = F.col("role") == "near", F.col("role") == "far"
    sizes = staged(told.groupBy("comp").agg(size(is_near).alias("near_chunks"), size(is_far).alias("far_chunks"), size(~is_near).alias("rest_chunks")).where("rest_chunks > 0"), "sizes")
    open_ = told.join(sizes, "comp")
    chunk = lambda n: F.pmod(F.xxhash64("same"), F.greatest(F.col(n), F.lit(1))).cast("int")
    rest = _pairs_of_chunks(open_.where(~is_near).withColumn("mine", chunk("rest_chunks")), "rest_chunks", ["comp", "same", "shingles"])
    across = _across(open_.withColumn("mine", F.when(is_far, chunk("far_chunks")).otherwise(chunk("near_chunks"))))
    dealt = rest.withColumn("kind", F.lit(0)).unionByName(across.withColumn("kind", F.lit(1)))
    dealt = dealt.select("same", "shingles", "side", F.xxhash64("comp", "kind", "i", "j").alias("shard"))
    compared = dealt.repartition("shard").sortWithinPartitions("shard", "side", "same").mapInArrow(_compare(similarity), "a long, b long")
    return told.where(is_near & (F.col("same") != F.col("pivot"))).select(F.col("same").alias("a"), F.col("pivot").alias("b")).unionByName(compared), (told, sizes)


def similar_links(texts: DataFrame, nodes: DataFrame, k: int, similarity: float, alike: DataFrame | None = None) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """(a, b): texts (by ``same``) and another of their class; and the staged tables that these rows are read from.
    ``nodes``: doc_id, same, keys. ``alike``: same, comp: candidate groups that are compared before those of bands."""
    if alike is None:
        alike = nodes.select("same", F.col("same").alias("comp")).where("false")
    # a key of two bands is chance, and only adds a comparison
    bands = nodes.select("same", F.explode("keys").alias("k"))
    low = bands.groupBy("k").agg(F.min("same").alias("low"), F.count("*").alias("n")).where("n > 1")
    shared = staged(bands.join(low, "k").select("same", "low", "n"), "shared")
    banded = _whole(components(shared.where("same <> low").select(F.col("same").alias("a"), F.col("low").alias("b")))).withColumnRenamed("node", "same")
    named, score = nodes.select("doc_id", "same"), shared.groupBy("same").agg(F.sum("n").alias("score"))
    alike = alike.join(alike.groupBy("comp").count().where("count > 1").select("comp"), "comp")
    alike = alike.join(named, "same").join(score, "same", "left").fillna(0, "score")
    member = _led(banded.join(named, "same").join(score, "same"), "comp", "pivot").join(_led(alike, "near", "near_pivot"), ["doc_id", "same"], "full")
    member = staged(member, "members", frees=(shared,))
    found = texts.join(member, ["doc_id", "same"]).dropDuplicates(["same"]).select("same", "comp", "pivot", "near", "near_pivot", "text")
    sets = staged(found.mapInArrow(_shingled(k), "same long, comp long, pivot long, near long, near_pivot long, n long, shingles binary"), "shingles")
    first = sets.where("near is not null").select("same", F.col("near").alias("comp"), F.col("near_pivot").alias("pivot"), "n", "shingles")
    first, used = _checked(first, similarity)
    known = components(first)
    free(*used)
    own = member.where("comp is not null").join(_whole(known).select(F.col("node").alias("same"), F.col("comp").alias("known")), "same", "left")
    own = own.select("comp", F.coalesce("known", "same").alias("known"))
    several = staged(own.groupBy("comp").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo <> hi").select("comp"), "several", frees=(member,))
    more, used = _checked(sets.join(several, "comp").select("same", "comp", "pivot", "n", "shingles"), similarity, frees=(sets, several))
    return known.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more), used


def similar_groups(docs: DataFrame, shingle_words: int = SIMILAR_WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, same (hash of the text), keep: true for one row of each group of similar texts, the smallest id's. Groups are
    found by ``near_duplicates``, and by bands what lies beyond its radius; whole sets of shingles decide.

    Rows of equal text are one group whatever their ids; rows without an id join no others. Ties of one id go to
    the smaller ``same``; rows equal in both are for the caller to drop.
    """
    texts = narrow(docs, id_col, text_col).withColumn("same", F.xxhash64("text"))
    made = staged(texts.select("doc_id", "same", "text").mapInArrow(_banded(shingle_words), "doc_id long, same long, keys array<long>"), "bands")
    first = made.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id")).alias("first"), F.first("keys").alias("keys"))
    first = staged(first.select("same", "first.doc_id", "keys"), "firsts")
    near = near_duplicates(texts, id_col="same").select(F.col("doc_id").alias("same"), F.col("component_id").alias("comp")).distinct()
    links, used = similar_links(texts, first.where("doc_id is not null"), shingle_words, similarity, near)
    comp = components(links)
    free(*used)
    member = _whole(comp).withColumnRenamed("node", "same").join(first.select("same", "doc_id"), "same")
    best = member.groupBy("comp").agg(F.min(F.struct("doc_id", "same")).alias("best"))
    lost = member.join(best, "comp").where("same <> best.same").select("same", F.lit(True).alias("moved"))
    kept = staged(first.select("same", F.col("doc_id").alias("first_id")).join(lost, "same", "left").select("same", "first_id", F.col("moved").isNull().alias("stays")), "kept", frees=(first,))
    return made.select("doc_id", "same").join(kept, "same").select("doc_id", "same", (F.col("stays") & F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("keep"))
