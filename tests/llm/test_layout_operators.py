"""Shards, token files, packing and media against brute force and exact round trips."""

import hashlib
import random
import re
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from helpers import clashing, corpus, frame, prose, vocabulary
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quizlens.llm import dac, media, packing, shards
from quizlens.llm.tokens import Encoder


# ---- shards ----------------------------------------------------------------------------------------------------


def brute_shards(rows, n, overhead=16):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    size = lambda t: len(t.encode()) + overhead
    total = [size(t) * len(ds) for t, ds in groups.items()]

    def fill(order, cap):
        used, at = 1, 0
        for x in order:
            if x > cap:
                return None
            if at + x > cap:
                used, at = used + 1, 0
            at += x
        return used

    return groups, total, fill


@pytest.mark.parametrize(("n", "bins"), [(5, 7), (40, 20_000), (3, 50)])
def test_shards_are_minimax_and_gapless(spark, n, bins):
    rows = [r for r in corpus() if r[0] is not None]
    got = shards.shard(clashing(spark, rows), n, bins=bins).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == sorted((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows)
    place = {(r.doc_id, r.text_crc32): r.shard for r in got}
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    order = sorted(groups.items(), key=lambda g: min(g[1]))
    sizes = [(len(t.encode()) + 16) * len(ds) for t, ds in order]
    where = [{place[d, zlib.crc32(t.encode())] for d in ds} for t, ds in order]
    assert all(len(w) == 1 for w in where)  # groups stay together
    flat = [w.pop() for w in where]
    assert flat == sorted(flat) and 0 <= flat[0] and flat[-1] < n  # contiguous
    loads = np.bincount(flat, sizes, n)

    def needs(cap):
        used, at = 1, 0
        for x in sizes:
            if x > cap:
                return n + 1
            used, at = (used + 1, x) if at + x > cap else (used, at + x)
        return used

    cap = int(loads.max())
    assert needs(cap) <= n < needs(cap - 1)
    for s in range(n):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_shards_of_odd_tables(spark):
    assert shards.shard(frame(spark, [])).count() == 0
    got = shards.shard(frame(spark, [(None, None), (None, ""), (5, "x"), (5, "x")]), 2).collect()
    assert len(got) == 4 and len({r.shard for r in got if r.size == 16}) == 1


def test_shard_plan_is_native(spark):
    plan = shards.shard(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- token files -----------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**31), max_size=40), max_size=8))
def test_codes_are_read_back_whole_and_one_by_one(docs):
    flat = [x for d in docs for x in d]
    file = dac.DacFile(dac.encode([None if i == 1 else i for i in range(len(docs))], np.array(flat, np.uint32), np.array([*map(len, docs)], np.int64)))
    assert file.tokens(0, len(flat)).tolist() == flat
    assert [file.token(i) for i in range(len(flat))] == flat
    for a, b in ((0, len(flat) // 2), (len(flat) // 3, len(flat))):
        assert file.tokens(a, b).tolist() == flat[a:b]
    for most in (1, 10, 1000):
        assert [(d, x.tolist()) for d, _, x in file.documents(most)] == [(None if i == 1 else i, d) for i, d in enumerate(docs)]
    with pytest.raises(IndexError):
        file.token(len(flat))


def test_random_access_over_many_rank_blocks():
    ids = np.random.default_rng(3).zipf(1.2, 20_000).clip(0, 50_000).astype(np.uint32)
    file = dac.DacFile(dac.encode([0], ids, np.array([len(ids)])))
    assert len(file.levels) > 1
    for i in np.random.default_rng(4).integers(0, len(ids), 500):
        i = int(i)
        assert file.token(i) == ids[i] and file.tokens(i, min(i + 700, len(ids))).tolist() == ids[i : i + 700].tolist()


def test_reading_goes_through_the_directories():
    ids = np.random.default_rng(3).integers(0, 50_000, 20_000).astype(np.uint32)
    raw = bytearray(dac.encode([*range(20)], ids, np.full(20, 1000)))
    _, _, codes, marks, directory = dac.DacFile(bytes(raw)).levels[0]
    at = bytes(raw).index(bytes(directory.tobytes()))
    raw[at + 4 * 10] ^= 1  # the count before block 10
    damaged = dac.DacFile(bytes(raw))
    got = np.concatenate([x for _, _, x in damaged.documents()])
    block = slice(10 * dac.RANK_BITS, 11 * dac.RANK_BITS)
    assert (got[block] != ids[block]).any() and (np.delete(got, np.r_[block]) == np.delete(ids, np.r_[block])).all()


def whole(name, texts):
    t = Tokenizer.from_file(str(public_tokenizers.path(name)))
    return [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


ODD = ["", " ", "\n", "a\n\n b  c\n\n\nd \n e", "x\ty  z", "don't stop's I'LL 12 3,4", "é́ <|endoftext|> <|startoftext|>", "hi <|endoftext|>", "<|startoftext|>x<|endoftext|>\n<|ENDOFTEXT|>", "  lead", "trail  ", "a \n", "ñ ́x", "Σίσυφος ΟΔΟΣ ß İ", "a b c", "\x1c\x85", "the*** of%%% x.y,z!", "日本 語1２", "word'word", "A" * 2000, "!" * 99 + "\n" * 9, "÷×÷ a÷b", "\r\n a\r\n"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n.,'!aAéß1$\t *"), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_encoders_give_the_librarys_ids(texts):
    texts = texts + [" ".join(texts), "\n".join(texts)]
    for name, pieces in (("byte_bpe_50k.json", "spaces"), ("word_bpe_49k.json", "words")):
        if name not in ENCODERS:
            ENCODERS[name], TOKENIZERS[name] = Encoder(str(public_tokenizers.path(name)), pieces), Tokenizer.from_file(str(public_tokenizers.path(name)))
        enc, ref = ENCODERS[name], TOKENIZERS[name]
        assert [x.tolist() for x in enc.encode(texts)] == [e.ids for e in ref.encode_batch(texts, add_special_tokens=False)]


ENCODERS, TOKENIZERS = {}, {}


def test_pieces_that_recur_outlast_those_that_do_not(monkeypatch):
    from quizlens.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    enc = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")), "spaces")
    rng = random.Random(3)
    for i in range(20):
        texts = [f"often seen {prose(rng, vocabulary(), 20)} word{i}x"] * 2 + ["often", "seen"]
        assert [x.tolist() for x in enc.encode(texts)] == whole("byte_bpe_50k.json", texts)
    assert len(enc.slot) < 150


#: What tiles cuts, as a pattern.
TILE = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+(?=[ \n.,!?%&$#*|]|\Z)| ?[.,!?%&$#*|]+(?=[ \n]|\Z)| ?[^ \n]+|[ \n]+(?![^ \n])|[ \n]")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n.,'!aAéÿ×÷ß1$*Ā"), st.characters(exclude_categories=["Cs"])), max_size=20), max_size=5))
def test_pieces_tile_the_texts(texts):
    from quizlens.llm.tokens import tiles

    for some in (texts, ODD, [*texts, "", *ODD, ""]):
        pieces, many = tiles(some)
        assert pieces.to_pylist() == [p for t in some for p in TILE.findall(t)] and many.tolist() == [len(TILE.findall(t)) for t in some]


class Counted:
    """Something of the library, with its calls counted."""

    def __init__(self, inner, calls):
        self.inner, self.calls = inner, calls

    def __getattr__(self, name):
        def call(*args, **more):
            self.calls[name] += 1
            return getattr(self.inner, name)(*args, **more)

        return call


def test_new_words_go_to_the_library_many_at_a_time():
    enc, rng, calls = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")), "spaces"), random.Random(9), Counter()
    for name in ("tokenizer", "model", "bare"):
        if hasattr(enc, name):
            setattr(enc, name, Counted(getattr(enc, name), calls))
    words = ["".join(rng.choices("abcdefghijklmnoprstuvwzéüßA", k=rng.randint(1, 14))) for _ in range(5000)]
    texts = [" ".join(words[k : k + 50]) for k in range(0, len(words), 50)]
    assert [x.tolist() for x in enc.encode(texts)] == whole("byte_bpe_50k.json", texts)
    assert sum(calls.values()) < 5000 / 20  # the first word of each text has no space before it


@pytest.mark.parametrize("limit", [dac.FILE_TOKENS, 500])
def test_token_files_hold_every_document_in_order(spark, limit):
    rows = corpus() + [(10_000 + i, t) for i, t in enumerate(ODD)]
    manifest = dac.write(clashing(spark, rows), str(public_tokenizers.path("byte_bpe_50k.json")), file_tokens=limit)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in dac.read_digests(manifest).collect()), key=lambda r: r[0])
    ids = whole("byte_bpe_50k.json", [t or "" for _, t in rows])
    digest = lambda x: zlib.crc32(np.array([*x, 2], "<u4").tobytes())
    assert [g[1] for g in got] == sorted((d for d, _ in rows), key=lambda d: (d is not None, d))  # null ids first
    assert sorted((g[1:] for g in got), key=repr) == sorted(((d, len(x) + 1, digest(x)) for (d, _), x in zip(rows, ids, strict=True)), key=repr)
    at = 0
    for start, _, n, _ in got:
        assert start == at
        at += n
    assert dac.read_digests(dac.write(frame(spark, []), str(public_tokenizers.path("byte_bpe_50k.json")))).count() == 0


# ---- packing ---------------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 9), max_size=20), st.integers(1, 70))
def test_plans_place_every_piece_without_gaps(histogram, groups):
    runs, n = packing.plan(histogram, 64, groups)
    places = {}
    for k, (length, rank, each, first, offset) in enumerate(runs):
        last = runs[k + 1][1] if k + 1 < len(runs) and runs[k + 1][0] == length else histogram[length]
        for r in range(rank, last):
            places.setdefault(first + (r - rank) // each, []).append((offset + (r - rank) % each * length, length))
    assert sum(map(len, places.values())) == sum(histogram.values()) and sorted(places) == list(range(n))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(2)
    for mean in (4, 6, 7):
        lengths = np.minimum(rng.lognormal(mean, 1.1, 60_000).astype(int) + 1, 2048)
        runs, n = packing.plan({int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True), strict=True)})
        best_fit = 0
        rooms = np.zeros(2049, int)
        for x in sorted(lengths.tolist(), reverse=True):
            fits = np.flatnonzero(rooms[x:])
            room = x + fits[0] if len(fits) else 2048
            best_fit += not len(fits)
            rooms[room] -= bool(len(fits))
            rooms[room - x] += 1
        halves = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert halves <= n <= min(1.001 * halves + 2, best_fit * 1.001 + 2)
        assert len(runs) < 40_000


def test_few_sizes_are_optimised_whatever_the_table():
    rng = random.Random(4)
    for pieces in (3, 40, 900, 20_000):
        large = sorted(Counter(rng.randint(257, 2048) for _ in range(pieces)).items(), reverse=True)
        sizes, counts = packing._groups(large, packing.GROUPS)
        assert len(sizes) <= packing.GROUPS and sum(counts) == pieces
        if pieces == 20_000:  # groups of equal cardinality, but for lengths that fill several
            assert len(sizes) == packing.GROUPS and max(counts) - min(counts) <= max(Counter(dict(large)).values())
        assert all(sum(c) <= 2048 for c, _ in packing.configurations(sizes, counts, 2048))
    # a hundred pairs of both sizes, and the rest two by two
    assert sum(n for _, n in packing.configurations([1300, 700], [100, 200], 2048)) == 150


def test_configurations_reach_the_bound_of_exhaustive_search():
    import itertools

    rng = random.Random(9)
    for _ in range(20):
        sizes = sorted(rng.sample(range(20, 100), 4), reverse=True)
        counts = [rng.randint(30, 60) for _ in sizes]
        found = packing.configurations(sizes, counts, 128)
        for c, _ in found:
            assert sum(c) <= 128
        # no price vector that makes every configuration cost at most 1 sells the pieces for more
        every = [u for u in itertools.product(range(7), repeat=4) if 0 < sum(a * s for a, s in zip(u, sizes, strict=True)) <= 128]
        used = Counter()
        for c, n in found:
            for s in c:
                used[s] += n
        assert all(used[s] <= k + max(Counter(c)[s] for c, _ in found) for s, k in zip(sizes, counts, strict=True))
        best = sum(n for _, n in found)
        for _ in range(200):
            price = np.array([rng.random() for _ in sizes])
            price /= max(np.dot(price, u) for u in every)
            assert best + len(sizes) >= np.dot(price, counts) - 1e-6


def test_packing_keeps_all_tokens(spark):
    rows = corpus() + [(10_000 + i, t) for i, t in enumerate(ODD)]
    got = packing.pack(clashing(spark, rows), str(public_tokenizers.path("word_bpe_49k.json")), capacity=256).collect()
    ids = whole("word_bpe_49k.json", [t or "" for _, t in rows])
    want = []
    for (d, _), x in zip(rows, ids, strict=True):
        x = [*x, 0]
        want += [(d, k, s, len(x[s : s + 256]), zlib.crc32(np.array(x[s : s + 256], "<u4").tobytes())) for k, s in enumerate(range(0, len(x), 256))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= -(-sum(r.length for r in got) // 256) * 1.1 + 2
    assert packing.pack(frame(spark, []), str(public_tokenizers.path("word_bpe_49k.json"))).count() == 0


# ---- media -----------------------------------------------------------------------------------------------------


def test_media_come_back_byte_for_byte(spark):
    rows = corpus()
    folder, archives = media.write_archives(clashing(spark, rows), archive_bytes=20_000)
    assert archives.count() > 4
    members = media.read_archives(spark, folder, range_bytes=3_000)
    assert members.rdd.getNumPartitions() > archives.count()
    got = sorted(((r.doc_id, r.n_bytes, media.samples(bytes(r.media))) for r in members.collect()), key=repr)
    want = sorted(((d, len((t or "").encode()), media.payload(t or "")) for d, t in rows), key=repr)
    assert got == want and all(len(p) % 64 == 0 and len(p) > 0 for _, _, p in want)
    made = media.media_features(members).collect()
    texts = {d: t for d, t in rows}
    for r in made:
        if r.doc_id is not None:
            p = media.payload(texts[r.doc_id] or "")
            assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    by = {}
    for r in made:
        by.setdefault(r.payload_sha256, set()).add((r.media_sha256, r.media_bytes, r.feature))
    assert all(len(v) == 1 for v in by.values())
    empty, none = media.write_archives(frame(spark, []))
    assert none.count() == 0 and media.media_features(media.read_archives(spark, empty)).count() == 0


def test_members_are_retried_on_their_own(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("one.png", b"one" * 100)
        z.writestr("two.png", b"two" * 100)
    info = zipfile.ZipFile(path).infolist()[1]
    opened = []

    def flaky(name):
        opened.append(name)
        f = open(name, "rb")
        if len(opened) == 1:
            raise OSError("lost")
        if len(opened) == 2:
            f.read = lambda n=-1, r=f.read: r(n)[: max(0, n // 2)]
        return f

    assert media.fetch(f"file://{path}", info.header_offset, info.compress_size, info.CRC, opener=flaky) == b"two" * 100
    assert len(opened) == 3
    with pytest.raises(media.MemberError):
        media.fetch(f"file://{path}", info.header_offset, info.compress_size, info.CRC ^ 1, attempts=2)


def test_a_range_reads_its_members_from_one_stream(tmp_path, monkeypatch):
    from pyarrow import fs

    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        for i in range(20):
            info = zipfile.ZipInfo(f"{i:08d}-{i}.png")
            info.comment = b"7"
            z.writestr(info, f"member {i}".encode() * 50)
    opened = []

    class Counting(fs.LocalFileSystem):
        def open_input_file(self, name):
            opened.append(name)
            return super().open_input_file(name)

    monkeypatch.setattr(media, "at", lambda uri: (Counting(), str(path)))
    reader = media._Reader({"path": str(tmp_path)})
    rows = [r for b in reader.read(media._Range(f"file://{path}", 0, path.stat().st_size)) for r in b.to_pylist()]
    assert [r["media"] for r in rows] == [f"member {i}".encode() * 50 for i in range(20)] and len(opened) == 1


def test_damaged_media_are_refused():
    form = media.png(media.payload("text"))
    assert media.samples(form) == media.payload("text")
    with pytest.raises(ValueError, match="checksum"):
        media.samples(form[:40] + bytes([form[40] ^ 1]) + form[41:])
    with pytest.raises(ValueError, match="PNG"):
        media.samples(b"nothing")
    assert struct.unpack(">II", form[16:24]) == (64, 1)


def test_shared_words():
    assert len(vocabulary()) == 400 and prose(random.Random(1), ["a"], 3) == "a a a"
