"""SimHash classes, similar groups and substring removal against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from helpers import clashing, corpus, frame, prose, vocabulary
from pyspark.sql import functions as F

from quizlens.llm import simhash, substring


def brute_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = [w for w in lowered.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, prints, radius):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [least.get(root(i)) for i in range(len(rows))]


@pytest.mark.parametrize("limit", [4096, 3])
def test_classes_equal_all_pairs(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)
    rng, words = random.Random(7), vocabulary()
    rows = corpus()
    base = prose(rng, words, 400).split(" ")
    for i in range(40):  # a chain of near copies
        base[rng.randrange(400)] = rng.choice(words)
        rows.append((5000 - i, " ".join(base)))
    got = simhash.near_duplicates(clashing(spark, rows)).collect()
    prints = [brute_fingerprint(t) for _, t in rows]
    want = list(zip([d for d, _ in rows], prints, brute_components(rows, prints, 4), strict=True))
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(c != d for d, _, c in want) > 30


def test_no_documents(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.similar_groups(frame(spark, [])).count() == 0


def test_staged_tables_go_when_nothing_reads_them(spark):
    import os

    from quizlens.llm import common

    root = common.scratch(spark, "x").rpartition("/")[0].removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    before = set(os.listdir(root))
    got = simhash.near_duplicates(frame(spark, corpus()))
    left = sorted(n.split("-")[0] for n in set(os.listdir(root)) - before)
    assert left == ["classes", "simhash", "stars"] and got.count() > 0  # the last round of stars alone
    before = set(os.listdir(root))
    got = substring.deduplicate(frame(spark, corpus()))
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"scan", "changed"} and got.count() > 0


def test_trees_find_all_within_the_radius():
    rng = random.Random(1)
    codes = [rng.getrandbits(64) for _ in range(50)]
    codes += [c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in codes for _ in range(4)]
    tree = simhash.BKTree()
    for c in codes:
        tree.insert(c)
    for c in codes[:60]:
        for radius in (0, 2, 4, 9):
            assert {tree.codes[i] for i in tree.within(c, radius)} == {x for x in codes if (x ^ c).bit_count() <= radius}


@pytest.mark.parametrize("blocks", [5, 6, 8])
def test_blocks_lose_no_pair(blocks):
    from itertools import combinations

    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in c) for c in combinations(range(blocks), blocks - 4)]
    rng = random.Random(3)
    for _ in range(500):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), 4):
            y ^= 1 << b
        assert any(x & m == y & m for m in masks)


def test_components_of_a_long_path_and_a_star(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 300)] + [(500, i) for i in range(501, 560)] + [(900, 900)]
    rng.shuffle(edges)
    got = {r.node: r.comp for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 301)} | {i: 500 for i in range(501, 560)}


def shingles(text):
    ws = (text or "").lower().split()
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_similar_groups_keep_one_of_each_and_all_others(spark):
    rng, words = random.Random(11), vocabulary(3000)
    rows, near = [], []
    for i in range(60):
        tokens = prose(rng, words, 300).split(" ")
        rows.append((i, " ".join(tokens)))
        for k in range(2):
            copy = list(tokens)
            for _ in range(rng.choice([1, 3, 5, 30])):
                copy[rng.randrange(300)] = "other"
            rows.append((1000 + 2 * i + k, " ".join(copy)))
    rows += [(5000, rows[0][1]), (5001, None), (5002, ""), (None, rows[3][1]), (None, None), rows[7], rows[7]]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] | sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    got = simhash.similar_groups(clashing(spark, rows)).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id for r in got if r.keep}
    assert sum(a in kept and b in kept for a, b in near) <= 0.03 * len(near)
    linked = {x for p in near for x in p}
    assert all(d in kept for d in sets if d not in linked and d not in (5002,))
    assert not (5001 in kept and 5002 in kept) and 0 in kept and 5000 not in kept


def kept_ids(spark, rows):
    return {r.doc_id for r in simhash.similar_groups(frame(spark, rows)).collect() if r.keep}


@pytest.mark.parametrize("limit", [1_000_000, 60_000])
def test_one_of_a_thousand_edited_copies_stays(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "COMPARE_LIMIT", limit)
    rng, words = random.Random(31), vocabulary(3000)
    tokens = prose(rng, words, 300).split(" ")
    rows = [(500, " ".join(tokens))]  # the original's id is among those of its copies
    for i in [*range(500), *range(501, 1001)]:
        copy = list(tokens)
        for at in rng.sample(range(300), 5):
            copy[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(copy)))
    sets = [shingles(t) for _, t in rows]
    reached, rest = [sets[0]], sets[1:]  # brute force: all are one class of links of at least 0.8
    while reached and rest:
        x = reached.pop()
        near = [s for s in rest if len(x & s) >= 0.8 * len(x | s)]
        reached += near
        rest = [s for s in rest if len(x & s) < 0.8 * len(x | s)]
    others = [(2000 + i, prose(rng, words, 200)) for i in range(20)]
    kept = kept_ids(spark, rows + others)
    assert not rest and {d for d in kept if d < 2000} == {0} and len(kept) == 21


def test_copies_of_one_text_are_compared_with_it_alone(spark):
    """A hot group's comparisons grow as its size, not as its square."""
    rng, words = random.Random(35), vocabulary(3000)
    tokens = prose(rng, words, 200).split(" ")
    rows = []
    for i in range(400):
        copy = list(tokens)
        for at in rng.sample(range(200), i % 3):
            copy[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(copy)))
    assert kept_ids(spark, rows) == {0}
    docs = frame(spark, rows).withColumn("same", F.xxhash64("text"))
    keys = docs.select("doc_id", "same", "text").mapInArrow(simhash._banded(5), "doc_id long, same long, keys array<long>").dropDuplicates(["same"])
    links = simhash.similar_links(docs, keys, 5, 0.8)[0].collect()
    distinct = len({t for _, t in rows})
    assert len(links) == distinct - 1 and len({r.b for r in links}) == 1


def test_copies_in_one_class_are_not_compared_again(spark):
    """Bands only lead to comparisons where the classes of fingerprints have left something open."""
    rng, words = random.Random(37), vocabulary(3000)
    base = [prose(rng, words, 300) for _ in range(6)]
    rows = [(10 * i + k, t + f" more{k}" * (k > 0)) for i, t in enumerate(base) for k in range(4)]
    rows += [(100, base[0] + " " + prose(rng, words, 60))]
    docs = frame(spark, rows).withColumn("same", F.xxhash64("text"))
    keys = docs.select("doc_id", "same", "text").mapInArrow(simhash._banded(5), "doc_id long, same long, keys array<long>")
    alike = docs.select("same", F.floor(F.col("doc_id") / 10).alias("comp"))
    own = {r.same: r.doc_id for r in docs.collect()}
    links, (told, _) = simhash.similar_links(docs, keys, 5, 0.8, alike)
    assert {own[r.same] for r in told.collect()} == {0, 1, 2, 3, 100}  # only that group was compared by bands
    assert {own[x] // 10 for r in links.collect() for x in (r.a, r.b)} == {0, 1, 2, 3, 4, 5, 10}
    assert kept_ids(spark, rows) == {0, 10, 20, 30, 40, 50}


def test_chains_of_similar_texts_are_one_group(spark):
    """Each is similar to the next; the ends are not similar to any pivot."""
    rng, words = random.Random(36), vocabulary(3000)
    tokens = prose(rng, words, 300).split(" ")
    rows = []
    for i in range(30):
        rows.append((i, " ".join(tokens)))
        for at in rng.sample(range(300), 4):
            tokens[at] = f"edit{i}x{at}"
    sets = [shingles(t) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets, sets[1:], strict=False)) and len(sets[0] & sets[-1]) < 0.3 * len(sets[0])
    assert kept_ids(spark, rows) == {0}


def test_added_passages_and_repeated_lines_are_found(spark):
    rng, words = random.Random(32), vocabulary(3000)
    rows = []
    for i in range(60):
        text = prose(rng, words, rng.randint(200, 400))
        n = len(text.split())
        line = prose(rng, words, 8)
        copies = [text + " " + prose(rng, words, round(n * 0.22)), prose(rng, words, round(n * 0.14)) + " " + text]
        copies += [text + "\n" + line] if i % 2 else []
        copies += [text + ("\n" + line) * 25] if i % 2 else [" ".join(text.split()[round(n * 0.17) :])]
        assert all(len(shingles(c) & shingles(text)) >= 0.8 * len(shingles(c) | shingles(text)) for c in copies)
        rows += [(10 * i + k, c) for k, c in enumerate([text, *copies])]
    assert kept_ids(spark, rows) == {10 * i for i in range(60)}


def test_different_texts_with_long_runs_stay(spark):
    rng, words = random.Random(33), vocabulary(3000)
    rows = [(i, f"{prose(rng, words, 60)} {sign * 200} {prose(rng, words, 40)}") for i, sign in enumerate(["- ", "| ", "0 ", "no "] * 15)]
    rows += [(100 + i, t.replace(" ", " \n")) for i, t in rows[:5]]  # the same words: these go
    assert kept_ids(spark, rows) == set(range(60))


# ---- substring removal -----------------------------------------------------------------------------------------


def brute_removal(rows, window=50):
    words = [[w for w in (t or "").encode().split()] for _, t in rows]
    first = {}
    for (d, _), ws in zip(rows, words, strict=True):
        for k in range(len(ws) - window + 1):
            key = tuple(ws[k : k + window])
            if d is not None:
                first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), ws in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(ws) - window + 1):
            if d is not None and first[tuple(ws[k : k + window])] < d:
                gone |= set(range(k, k + window))
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


# anchors of one word are those of many texts that share nothing else, as if their hashes collided
@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"shard_words": 300}, {"hot": 2, "shard_words": 500}, {"anchor": 1}, {"anchor": 1, "hot": 3}])
def test_removal_equals_brute_force(spark, options):
    rng, words = random.Random(13), vocabulary()
    rows = corpus()
    common = prose(rng, words, 60)
    rows += [(7000 + i, prose(rng, words, rng.randint(0, 40)) + " " + common + " " + prose(rng, words, rng.randint(0, 40))) for i in range(25)]
    got = substring.deduplicate(clashing(spark, rows), **options).collect()
    want = brute_removal(rows)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert sum(w[2] > 0 for w in want) > 25


def test_removal_of_no_documents(spark):
    assert substring.deduplicate(frame(spark, [])).count() == 0


@pytest.mark.parametrize("least", [3, 5, 8])
def test_matches_are_those_of_smaller_owners(least):
    rng = random.Random(least)
    for _ in range(12):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 40))] for _ in range(30)]
        owners = np.array([rng.randrange(12) for _ in texts])
        index = substring.FMIndex(texts, owners)
        found = index.matches(np.array([*map(len, texts)]), np.searchsorted(index.owners, owners), least)
        covered = [set() for _ in texts]
        for k, a, b in zip(*(x.tolist() for x in found), strict=True):
            assert b - a >= least and any(o < owners[k] and any(u[j : j + b - a] == texts[k][a:b] for j in range(len(u))) for o, u in zip(owners, texts, strict=True))
            covered[k] |= set(range(a, b))
        for k, t in enumerate(texts):
            earlier = {tuple(u[j : j + least]) for o, u in zip(owners, texts, strict=True) if o < owners[k] for j in range(len(u) - least + 1)}
            assert covered[k] == {x for s in range(len(t) - least + 1) if tuple(t[s : s + least]) in earlier for x in range(s, s + least)}


def test_the_index_is_smaller_than_its_texts():
    rng, words = random.Random(6), vocabulary(20_000)
    texts = [prose(rng, words, 75).encode().split() for _ in range(1_300)]
    index = substring.FMIndex(texts, np.arange(len(texts)))
    size = sum(len(b" ".join(t)) for t in texts)
    assert index.nbytes() < size
    assert 10 * sum(x.nbytes for *_, within, block in index.matrix.levels for x in (within, block)) < size


def test_wavelet_matrix_ranks():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 300, 70_000)
    matrix = substring.WaveletMatrix(symbols, 300)
    zero = matrix.place(np.arange(301), np.zeros(301, np.int64))
    for at in (0, 1, 63, 64, 65, 500, 65_535, 65_536, 65_537, 70_000):
        ranks = matrix.place(np.arange(301), np.full(301, at)) - zero
        assert ranks.tolist() == np.bincount(symbols[:at], minlength=301).tolist()
