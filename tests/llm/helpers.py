"""Small tables with every awkward case, and words to make texts of."""

import random

DDL = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "doc_id long, text string, row string, score double, fp long, same long, hit binary, items string, kept string, size long, shard int, n_words long, lang string, source string, n_chars long"


def frame(spark, rows):
    """rows: (doc_id, text)."""
    return spark.createDataFrame([(d, t, None if d is None else "en", "s", None if t is None else len(t)) for d, t in rows], DDL)


def clashing(spark, rows):
    """The same with columns whose names operators use themselves, all null."""
    return spark.createDataFrame([(d, t, *[None] * 13) for d, t in rows], CLASHING)


def vocabulary(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(["ka", "lo", "mi", "te", "ru", "né", "so"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus(seed=2, n=60):
    """Texts with exact copies, near copies, shared passages, nulls, blanks, one very long text and repeated rows."""
    rng, words = random.Random(seed), vocabulary()
    passage = prose(rng, words, 70)
    base = [prose(rng, words, rng.randint(1, 260)) for _ in range(n)]
    rows = list(enumerate(base))
    k = n
    for i in range(0, n, 6):
        rows.append((k, base[i]))
        tokens = base[i].split(" ")
        tokens[rng.randrange(len(tokens))] = "changed"
        rows.append((k + 1, " ".join(tokens)))
        rows.append((k + 2, prose(rng, words, 30) + "\n" + passage + "  " + prose(rng, words, 20)))
        k += 3
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, prose(rng, words, 9000)), (k + 4, "one"), (None, base[1]), (None, None)]
    rows += [rows[3], rows[3], (k + 5, "é" * 3000 + " " + "x" * 5000), (k + 6, "For " * 300), (k + 7, "For " * 310)]
    rng.shuffle(rows)
    return rows
