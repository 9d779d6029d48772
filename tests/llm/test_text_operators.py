"""Decontamination, personal data, toxicity and licenses against brute force and held-out cases."""

import hashlib
import random
import re
import zlib

import pytest
from helpers import clashing, corpus, frame, prose, vocabulary
from pyspark.sql import functions as F

from quizlens.llm import decontaminate, licenses, pii, toxicity


# ---- decontamination -------------------------------------------------------------------------------------------


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute_decontaminate(text, items):
    ws = plain_words(text)
    hit, names = set(), set()
    for name, body in items:
        item = plain_words(body)
        n = min(13, len(item))
        for i in range(len(item) - n + 1 if item else 0):
            for k in range(len(ws) - n + 1):
                if ws[k : k + n] == item[i : i + n]:
                    hit |= set(range(k, k + n))
                    names.add(str(name))
    ids = sorted(names)
    return len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws)


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination_equals_brute_force(spark, monkeypatch, blocks):
    rng, words = random.Random(4), vocabulary()
    items = [(i, prose(rng, words, rng.choice([0, 1, 5, 13, 14, 30])) + ".") for i in range(12)] + [(3, "Extra ITEM, short"), (40, None), (41, "")]
    rows = corpus() + [(900 + i, prose(rng, words, 20) + " — " + (t or "").upper().replace(" ", ", ") + "!! " + prose(rng, words, 30)) for i, t in items]
    total = sum(len(t or "") for _, t in items)
    monkeypatch.setattr(decontaminate, "AUTOMATON_BYTES", total if blocks == 1 else total // blocks)
    items += items[:3]  # repeated rows count once
    for make in (frame, clashing):
        got = decontaminate.summary(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
        want = sorted(((d, *brute_decontaminate(t, items)) for d, t in rows), key=repr)
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == want


def test_hits_map_to_the_original_text(spark):
    text = "Ünder  The, OLD\n(oak)  tree."
    found = decontaminate.scan(frame(spark, [(1, text)]), spark.createDataFrame([(7, "the old oak")], "item_id long, text string")).collect()[0]
    (a, b), = decontaminate.hit_spans(text, found.hit)
    assert text[a:b] == "The, OLD\n(oak"
    assert decontaminate.scan(frame(spark, []), spark.createDataFrame([], "item_id long, text string")).count() == 0


# ---- personal data ---------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            if kind == "card":
                doubled = [int(c) * 2 if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(d - 9 if d > 9 else d for d in doubled) % 10:
                    continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(spark):
    rng = random.Random(6)
    bits = ["a.b@c.d.e", "x@y", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (743) 555-3824", "+12", "é", "+1.2.3.4.5.6.7.8.9", "007", "..", "-", "a@b.c_d@e.f", "0001.02.3.004"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", ", "]) for _ in range(rng.randint(0, 12)))) for i in range(150)] + corpus()
    found = pii.find(clashing(spark, rows)).collect()
    assert sorted(((r.doc_id, r.text, [tuple(s) for s in r.base]) for r in found), key=repr) == sorted(((d, t or "", brute_base(t)) for d, t in rows), key=repr)
    for r in found:
        for s in r.added:
            assert 0 <= s.start < s.end <= len(r.text) and all(s.end <= b.start or s.start >= b.end for b in r.base)
    summed = pii.summary(frame(spark, rows[:40])).collect()
    for r, (_, t) in zip(sorted(summed, key=lambda r: r.doc_id), sorted(rows[:40]), strict=True):
        base = brute_base(t)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x[0] for x in base) for k in PATTERNS)
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in base}


def recall(field, documents):
    """Share of the hidden spans found, and wrong additions, over (text, base, all spans)."""
    found = hidden = false = 0
    for text, base, spans in documents:
        added = pii.added_spans(field, [text], [base])[0]
        rest = [s for s in spans if s not in base]
        hidden += len(rest)
        found += sum(any(k == kind and a < y and b > x for kind, x, y in added) for k, a, b in rest)
        false += sum(not any(a < y and b > x for _, x, y in spans) for _, a, b in added)
    return found / hidden, false / hidden


def test_the_field_finds_other_mentions_and_leaves_the_rest(field):
    found, false = recall(field, pii.examples(150, seed=123))
    assert found >= 0.93 and false <= 0.02
    text = "Call +1 (743) 555-3824 today; at night 555-3824. Room 555-38."
    base, added = pii.spans_of(field, [text])
    assert [text[a:b] for _, a, b in added[0]] == ["555-3824"]
    assert pii.masked(text, base[0] + added[0]) == "Call [PHONE] today; at night [PHONE]. Room 555-38."
    assert pii.spans_of(field, ["plain words only", "", "order 12345 of 2024"]) == ([[], [], []], [[], [], []])


@pytest.fixture(scope="module")
def field():
    return pii.train()


#: Written for the tests, not by the generator that the field is trained on: text, and what must be added.
DISGUISED = [
    ("Please write to maria.k77 [at] post3 [dot] example [dot] org before noon.", [("email", "maria.k77 [at] post3 [dot] example [dot] org")]),
    ("Her address was tom.88 at web2 dot example dot net, he said.", [("email", "tom.88 at web2 dot example dot net")]),
    ("Ring (415) 555-0199 after six.", [("phone", "(415) 555-0199")]),
    ("His number: four one five five five five zero one nine nine, he said twice.", [("phone", "four one five five five five zero one nine nine")]),
    ("Reach +1 (415) 555-0199 or, from here, 555-0199 in the evening.", [("phone", "555-0199")]),
    ("The machine 10.20.30.40 failed. Later 10-20-30-40 came back.", [("ip", "10-20-30-40")]),
    ("Ping 192 dot 168 dot 44 dot 7 first.", [("ip", "192 dot 168 dot 44 dot 7")]),
    ("Pay with 4111.1111.1111.1111 or in cash.", [("card", "4111.1111.1111.1111")]),
    ("Groups 4111 / 1111 / 1111 / 1111 were on the slip.", [("card", "4111 / 1111 / 1111 / 1111")]),
    ('set password = "h7Gk29sLq0Zx81Bv" and restart', [("secret", 'h7Gk29sLq0Zx81Bv')]),
    ("api_key: 9f8e7d6c5b4a39281706f5e4d3c2b1a0 was leaked", [("secret", "9f8e7d6c5b4a39281706f5e4d3c2b1a0")]),
]
CLEAN = [
    "On 2024-03-17 at 10:45 the 250 members met in room 12.",
    "Version 2.14.3 replaced 2.13.9; see section 4.1.2.",
    "The commit da39a3ee5e6b4b0d3255bfef95601890afd80709 is old.",
    "Seven of nine people came at two, and four left at five.",
    "Totals: 12 | 450 | 33 | 8 and 17 | 220 | 41 | 9.",
    "They met at the dot on the map, mail in hand, and called two friends.",
    "ISBN 9783161484100 costs 25.99, order 4512 1199.",
]


def test_disguised_mentions_that_no_template_wrote_are_found(field):
    found = 0
    for text, wanted in DISGUISED:
        _, (added,) = pii.spans_of(field, [text])
        got = [(k, text[a:b]) for k, a, b in added]
        found += all(any(k == x and (t in y or y in t) for x, y in got) for k, t in wanted)
        assert all(any(k == x for x, _ in wanted) for k, _ in got), (text, got)
    assert found >= len(DISGUISED) - 1
    assert pii.spans_of(field, CLEAN)[1] == [[]] * len(CLEAN)


def test_far_plain_words_do_not_change_the_field(field):
    """Nodes beside the telling words alone give the marginals of all words."""
    import numpy as np

    text = "so she said " * 30 + "call (743) 555-3824 " + "and then it went " * 40 + "555-3824 " + "on and on " * 30
    near, whole = pii.Graph(field.reach), pii.Graph()
    for graph in (near, whole):
        graph.add(0, text, [])
    assert len(near.spans) < 60 < len(whole.spans)
    of = lambda g: {s: p for s, p in zip(g.spans, field.marginals(g), strict=True)}
    a, b = of(near), of(whole)
    assert all(np.abs(a[s] - b[s]).max() < 5e-3 for s in a)
    assert all(b[s].argmax() == 0 for s in b if s not in a)


def test_long_unbroken_runs_take_time_in_proportion(field):
    import time

    for piece in ("A", "7", "a.b@", "x@y ", "1.2.", "a-", "+"):
        took = []
        for n in (100_000, 800_000):
            text = piece * (n // len(piece))
            begin = time.process_time()
            pii.base_spans(text)
            took.append(time.process_time() - begin)
        assert took[1] < 1 or took[1] < 16 * took[0] + 0.1, (piece, took)
    assert brute_base("a.b@" * 300 + "c.d " + "1.2." * 100 + "@x.y") == pii.base_spans("a.b@" * 300 + "c.d " + "1.2." * 100 + "@x.y")


def test_a_hundred_mentions_get_the_label_of_the_observed_one(field):
    for where in (0, 50, 100):
        parts = [f"they wrote 555-3824 again {'so ' * (i % 3)}and left" for i in range(100)]
        parts.insert(where, "call +1 (743) 555-3824 first")
        text = " ".join(parts)
        (base,), (added,) = pii.spans_of(field, [text])
        wanted = [m.span() for m in re.finditer("wrote (555-3824)", text)]
        assert [k for k, _, _ in base] == ["phone"]
        assert [(k, a, b) for k, a, b in added] == [("phone", a + 6, b) for a, b in wanted]


def test_message_passing_follows_exact_marginals_on_a_tree(field):
    import itertools

    import numpy as np

    graph = pii.Graph()
    graph.add(0, "x (743) 555-3824 and 4111 item-9", [])
    graph.skip.clear()
    n, k = len(graph.spans), len(pii.LABELS)
    own = graph.matrix() @ field.unary
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        w = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(field.chain[labels[a], labels[b]] for a, b in graph.chain))
        for i, x in enumerate(labels):
            total[i, x] += w
    assert np.allclose(field.marginals(graph, 60), total / total.sum(axis=1, keepdims=True), atol=1e-6)


# ---- toxicity --------------------------------------------------------------------------------------------------

FOUL = ["blasted", "rotten", "wretch"]


@pytest.fixture(scope="module")
def toxic(spark):
    rng, words = random.Random(5), vocabulary()
    rows, labels = [], []
    for i in range(500):
        y = int(rng.random() < 0.3)
        tokens = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        for _ in range(3 * y):
            tokens.insert(rng.randrange(len(tokens)), rng.choice(FOUL))
        rows.append((i, " ".join(tokens)))
        labels.append((i, 1, y))
    return rows, labels


def test_toxicity_is_learned_and_disguises_are_seen_through(spark, toxic):
    rows, labels = toxic
    rng, words = random.Random(9), vocabulary()
    clean = prose(rng, words, 20)
    planted = {2000: clean + " r0tten wr3tch bl4sted", 2001: clean + " r o t t e n and w-r-e-t-c-h", 2002: clean + " rotttten wretch blasssted", 2003: clean, 2004: "", 2005: None}
    extra = [(None, 1, 1), (7, None, None), (7, 1, dict((a, c) for a, _, c in labels)[7])]
    docs = clashing(spark, rows + list(planted.items()) + [rows[0], (None, "text")])
    got = toxicity.score(docs, spark.createDataFrame(labels + extra, "doc_id long, quality long, toxic long")).collect()
    score = {r.doc_id: r.score for r in got}
    assert len(got) == 508 and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((score[i] >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)
    assert score[2000] >= 0.5 and score[2001] >= 0.5 and score[2002] >= 0.5
    assert score[2003] < 0.5 and score[2004] == score[2005] < 0.5


def test_decoding_finds_the_best_of_all_readings():
    import itertools

    import numpy as np

    rng = np.random.default_rng(8)
    n = len(toxicity.ALPHABET)
    grams = rng.choice(n**3, 4_000, replace=False)
    model = toxicity.CharModel(np.sort(grams), rng.integers(1, 50, 4_000))
    for text in ("w0rd", "a.b c", "heeello", "1 2", "sh!t", "@aa", "x--y", "c00l zz", "r.o.t", "é8"):
        best = (-1e18, "")
        for reading in itertools.product(*model.lattice(text)):
            total, key, out = 0.0, 0, []
            for symbols, cost in reading:
                total += cost
                for s in symbols:
                    if s == 0 and key % n == 0:
                        continue
                    total += model.logp[key * n + s]
                    key = key % n * n + s
                    out.append(toxicity.ALPHABET[s])
            best = max(best, (total, "".join(out).strip()))
        assert model.decode(text) == best[1], text


def test_stretched_words_of_other_alphabets_keep_their_letters():
    import numpy as np

    restorer = toxicity.Restorer(toxicity.CharModel(np.array([1]), np.array([1])))
    assert {"плохоооой", "плохой"} <= set(restorer.token("плохоооой"))


def test_repeated_rows_teach_once(spark, toxic):
    rows, labels = toxic
    rows, labels = rows[:150], labels[:150]
    ddl = "doc_id long, quality long, toxic long"
    a, b = ({r.doc_id: r.score for r in toxicity.score(frame(spark, rows[:60]), spark.createDataFrame(labels, ddl), corpus=frame(spark, c), train_rows=100).collect()} for c in (rows, rows))
    assert a == b
    many = frame(spark, rows + rows[:20] * 30)
    known = spark.createDataFrame(labels, ddl)
    plain = toxicity.character_counts(frame(spark, rows))
    assert plain.count() > 0 and toxicity.score(many, known).select("doc_id", "score").distinct().count() == 150


def test_held_out_labels_and_other_columns_do_not_change_scores(spark, toxic):
    rows, labels = toxic
    rows, labels = rows[:200], labels[:200]
    flipped = [(i, q, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, q, y in labels]
    ddl = "doc_id long, quality long, toxic long"
    a, b = ({r.doc_id: r.score for r in toxicity.score(frame(spark, rows), spark.createDataFrame(x, ddl)).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_or_documents(spark):
    ddl = "doc_id long, quality long, toxic long"
    assert toxicity.score(frame(spark, []), spark.createDataFrame([], ddl)).count() == 0
    got = toxicity.score(frame(spark, [(1, "a"), (2, None)]), spark.createDataFrame([], ddl)).collect()
    assert len({r.score for r in got}) == 1


def test_character_counts_are_those_of_all_texts(spark):
    rows = [(1, "ab"), (2, "AB"), (3, None), (4, "a  b")]
    got = {r.gram: r.n for r in toxicity.character_counts(frame(spark, rows)).collect()}
    code, n = toxicity._CODE, len(toxicity.ALPHABET)
    assert got[(code[" "] * n + code["a"]) * n + code["b"]] == 2
    assert sum(got.values()) > 0


# ---- licenses --------------------------------------------------------------------------------------------------


def test_licenses_are_found_in_whole_and_in_part(spark):
    rng, words = random.Random(3), vocabulary()
    mit = dict(licenses._TEXTS)["MIT"]
    edited = mit.replace("without limitation", "with no limitation").replace("Software", "Program", 2).upper()
    rows = [
        (1, prose(rng, words, 50) + "\n" + mit + "\n" + prose(rng, words, 50)),
        (2, "  /* " + "\n * ".join(re.findall(r".{1,60}(?: |$)", edited)) + " */"),
        (3, "Released under the MIT License. " * 2),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "the software is provided to any person who may use the rights and the license"),
        (6, None),
        (7, ""),
        (8, "é " * 40 + "This work is licensed under the GNU General Public License, version 3." + prose(rng, words, 3000)),
        (9, " ".join(mit.split()[: len(mit.split()) // 3])),
    ]
    got = {r.doc_id: r for r in licenses.scan(clashing(spark, rows)).collect()}
    text = dict(rows)
    names = {i: [m.license for m in r.matches] for i, r in got.items()}
    assert names == {1: ["MIT"], 2: ["MIT"], 3: ["MIT", "MIT"], 4: ["CC-BY-NC-4.0"], 5: [], 6: [], 7: [], 8: ["GPL-3.0-only"], 9: []}
    m = got[1].matches[0]
    assert m.matched == m.words and text[1][m.start : m.end] == mit.rstrip(".")
    assert 0.9 <= got[2].matches[0].matched / got[2].matches[0].words < 1
    m = got[8].matches[0]
    assert text[8][m.start : m.end] == "This work is licensed under the GNU General Public License, version 3"
    assert licenses.summary(licenses.scan(frame(spark, []))).count() == 0
    row = licenses.summary(licenses.scan(frame(spark, rows))).where(F.col("doc_id") == 4).collect()[0]
    assert (row.n_matches, row.best_license, row.best_coverage) == (1, "CC-BY-NC-4.0", 1.0)


def test_winnowing_keeps_its_guarantee():
    import numpy as np

    index = licenses.Index(licenses.TEMPLATES)
    rng = random.Random(2)
    for k, ids in enumerate(index.texts):
        shared = index.gram + index.winnow - 1
        if len(ids) < shared:
            continue
        at = rng.randrange(len(ids) - shared + 1)
        text = np.concatenate([np.zeros(5, np.int64), ids[at : at + shared], np.zeros(5, np.int64)])
        mine, _ = index.fingerprints(text)
        assert set(mine.tolist()) & set(index.fingerprints(ids)[0].tolist()), k


def common(a, b):
    """Length of the longest common subsequence."""
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, best[j] = best[j], max(best[j], best[j - 1], before + (x == y))
    return best[-1]


@pytest.mark.parametrize("name", ["MIT", "BSD-3-Clause", "ISC", "Zlib", "AGPL-3.0-or-later", "LGPL-2.1-or-later"])
def test_edited_licenses_match_as_a_whole_alignment_does(name):
    index = licenses.Index(licenses.TEMPLATES)
    rng, words = random.Random(name), [f"zz{i}" for i in range(50)]
    text = dict(licenses._TEXTS)[name].split()
    middle = len(text) // 2
    edits = {
        "whole": text,
        "forty words put in": text[:middle] + [rng.choice(words) for _ in range(40)] + text[middle:],
        "each eighth word left out": [w for i, w in enumerate(text) if i % 8 != 7],
        "each eighth word replaced": [w if i % 8 != 7 else "zz" for i, w in enumerate(text)],
        "each sixth word doubled": [x for i, w in enumerate(text) for x in ([w, w] if i % 6 == 5 else [w])],
        "first words left out": text[len(text) // 10 :],
        "twice": text + ["zz"] * 30 + text,
    }
    for what, edited in edits.items():
        around = [rng.choice(words) for _ in range(60)]
        full = licenses.words(" ".join(around[:30] + edited + around[30:]))
        want = common(licenses.words(" ".join(text)), full)
        total = len(licenses.words(" ".join(text)))
        found = [m for m in index.matches(" ".join(around[:30] + edited + around[30:])) if m[0] == name]
        assert want >= 0.8 * total and found and max(m[1] for m in found) == want, (what, want, total, found)
        assert len(found) == (2 if what == "twice" else 1), what


def test_repeated_rows_and_repeated_phrases_of_licenses(spark):
    rows = [(1, "Licensed under CC BY 4.0."), (1, "Licensed under CC BY 4.0."), (None, "Released under the MIT License."), (2, "of the Software " * 20_000)]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((repr(r.doc_id), [m.license for m in r.matches]) for r in got) == [("1", ["CC-BY-4.0"])] * 2 + [("2", []), ("None", ["MIT"])]
