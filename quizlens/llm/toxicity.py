"""Toxicity of texts whose words may be disguised, by noisy-channel decoding before scoring.

A character trigram model is counted over all documents. A token that mixes letters with digits or signs, or
repeats a letter three times, and a stretch of single letters set apart, become lattices: a sign may stand for
letters, for nothing or for a space; a run of a letter may be one, two or all of it; a gap may be a space or
nothing. Viterbi decoding finds the likeliest reading under the character model and the channel's costs. The restored
words (whole, and their beginnings) are the features of a logistic regression. The score never sees labels,
languages, sources or ids.

The regression is fitted on at most TRAIN_ROWS different labelled texts (a documented bound for the classifier alone), those
with the smallest hash of their id among the rows that may be learned from, and keeps FEATURES of their features at most, those
that speak most for class 1; character counts cover all documents.

Defined results: a null or empty text has no feature and gets the intercept's score; labels that are null are not
learned from; an id with several labels counts as toxic if one is; without two classes every score is the share of
class 1; repeated rows get a row each, with equal scores for equal texts; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, extended, free, narrow, staged, workspace

TRAIN_ROWS = 12_000
#: Weighted features kept by the classifier.
FEATURES = 20_000
REMEMBERED = 150_000
#: Logit from which on a single feature decides.
EVIDENT = math.log(0.9 / 0.1)

#: Space, a-z, and the lower-case letters of Latin-1; everything else is a space to the character model.
ALPHABET = " " + "".join(map(chr, range(97, 123))) + "ß" + "".join(chr(c) for c in range(0xE0, 0x100) if c != 0xF7)
_SIZE = len(ALPHABET)
_CODE = {c: i for i, c in enumerate(ALPHABET)}
_TABLE = np.zeros(0x110000, np.int64)
for _c, _i in _CODE.items():
    _TABLE[ord(_c)] = _i

#: What a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
GAPS = ".-_*~'\"/\\,:;#%&^=<>[]{})? \t\n"
#: Channel log probabilities.
AS_SIGN, AS_NOTHING, AS_SPACE, ONCE, TWICE, ALL = -0.7, -2.5, -3.0, -0.3, -1.2, -4.0

_PLAIN = re.compile(r"[^\W\d_]+").fullmatch
_LETTERS = re.compile(r"[^\W\d_]+").findall
_TRIPLE = re.compile(r"([^\W\d_])\1\1").search
_RUN = re.compile(r"([^\W\d_])\1\1+").sub
_MIXED = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+€£][^\w\s]*[^\W\d_]|\d[^\W_]*[^\W\d_]|[^\W\d_]\d|(?<!\w)[@$!|€£][^\W\d_]|[^\W\d_](?:[.\-_*~/\\]{1,2}[^\W\d_]){2,}").search
_SPACED = re.compile(r"(?<!\S)[^\s](?:[ \t]{1,3}[^\s]){3,}(?!\S)")


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_SIZE**3, np.int64)
    for batch in batches:
        for text in batch["text"]:
            raw = text.as_py().lower()
            if raw:
                x = _TABLE[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)]
                x = np.concatenate(([0, 0], x, [0]))
                x = x[np.concatenate(([True, True], (x[2:] != 0) | (x[1:-1] != 0)))]  # runs of spaces are one
                counts += np.bincount((x[:-2] * _SIZE + x[1:-1]) * _SIZE + x[2:], minlength=_SIZE**3)
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["gram", "n"])


def character_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """gram, n: trigram counts over all texts; at most len(ALPHABET) ** 3 rows, each task adding up its own first."""
    return narrow(docs, id_col, text_col).select("text").mapInArrow(_trigrams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated trigram log probabilities."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        c3 = np.zeros(_SIZE**3)
        c3[grams] = counts
        c3 = c3.reshape(_SIZE, _SIZE, _SIZE)
        c2, c1 = c3.sum(axis=0), c3.sum(axis=(0, 1))
        p1 = (c1 + 0.5) / (c1.sum() + 0.5 * _SIZE)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        p3 = (c3 + 10 * p2) / (c3.sum(axis=2, keepdims=True) + 10)
        self.logp = np.log(p3).astype(np.float32).ravel().tolist()

    @staticmethod
    def lattice(text: str) -> list[list[tuple[tuple[int, ...], float]]]:
        """For each run of a sign: what it may stand for (symbols of the alphabet) at which cost. Ends with a space."""
        lattice: list[list[tuple[tuple[int, ...], float]]] = []
        at = 0
        while at < len(text):
            c, run = text[at], 1
            while at + run < len(text) and text[at + run] == c:
                run += 1
            if c in _CODE and c != " ":
                k = _CODE[c]
                lattice.append([((k,), 0.0)] if run == 1 else [((k,), ONCE - 3.5), ((k, k), 0.0)] if run == 2 else [((k,), ONCE), ((k, k), TWICE), ((k,) * run, ALL)])
            elif c.isspace():
                lattice.append([((0,), -0.7), ((), -0.7)])
            elif c in SIGNS:
                meant = [((_CODE[m],), AS_SIGN) for m in SIGNS[c]]
                lattice.append([*meant, ((), AS_NOTHING), ((0,), AS_SPACE)])
            else:
                lattice.append([((), -0.3), ((0,), -1.2)])
            at += run
        lattice.append([((0,), 0.0)])
        return lattice

    def decode(self, text: str) -> str:
        """The likeliest reading of a disguised stretch of lower-case text."""
        states: dict[int, tuple[float, tuple]] = {0: (0.0, ())}  # the last two symbols to score and what was read
        logp = self.logp
        for options in self.lattice(text):
            new: dict[int, tuple[float, tuple]] = {}
            for key, (score, path) in states.items():
                for symbols, cost in options:
                    total, k, p = score + cost, key, path
                    for s in symbols:
                        if s == 0 and k % _SIZE == 0:
                            continue
                        total += logp[k * _SIZE + s]
                        k = k % _SIZE * _SIZE + s
                        p = (p, s)
                    if k not in new or total > new[k][0]:
                        new[k] = (total, p)
            states = new
        path, out = max(states.values(), key=lambda x: x[0])[1], []
        while path:
            path, s = path
            out.append(ALPHABET[s])
        return "".join(reversed(out)).strip()


class Restorer:
    """Words of texts, disguised ones restored; remembers tokens."""

    def __init__(self, model: CharModel):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}  # features by token

    def token(self, token: str) -> tuple[str, ...]:
        if _PLAIN(token):
            # the decoder knows its alphabet only; a stretched word of other letters counts as it stands, with its runs cut
            return (token,) if not _TRIPLE(token) else (token, _RUN(r"\1", token), *self.model.decode(token).split())
        if _MIXED(token) or _TRIPLE(token):
            return (*_LETTERS(token), *self.model.decode(token).split())
        return tuple(_LETTERS(token))

    def found(self, text: str, wanted: dict[int, float] | None = None) -> set[int]:
        """Features of the restored words (a disguised token also counts as it stands): all, or those wanted, which must
        be the same in each call."""
        text = text.lower()
        out: set[int] = set()
        known = self.known
        for token in set(text.split()):
            ids = known.get(token)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                ids = known[token] = tuple(self._features(self.token(token), wanted))
            if ids:
                out.update(ids)
        for m in _SPACED.finditer(text):
            out.update(self._features(self.model.decode(m[0]).split(), wanted))
        return out

    @staticmethod
    def _features(words, wanted: dict[int, float] | None) -> list[int]:
        return [f for w in words for f in features(w) if wanted is None or f in wanted]

    def text(self, text: str) -> str:
        """The whole text, lower-cased, with disguised stretches restored and all else as it stands."""

        def spaced(m: re.Match) -> str:
            return self.model.decode(m[0])

        def token(m: re.Match) -> str:
            return self.model.decode(m[0]) if _MIXED(m[0]) or _TRIPLE(m[0]) else m[0]

        return re.sub(r"\S+", token, _SPACED.sub(spaced, text.lower()))


_WHOLE = zlib.crc32(b"w")
_BEGIN = [(k, zlib.crc32(b"p%d" % k)) for k in range(3, 7)]


def features(word: str) -> list[int]:
    """Hashed features of a word: itself and its first 3 to 6 letters."""
    raw = word.encode("utf-8", "surrogatepass")
    n = len(word)
    if len(raw) == n:
        return [zlib.crc32(raw, _WHOLE), *[zlib.crc32(raw[:k], seed) for k, seed in _BEGIN if k <= n]]
    return [zlib.crc32(raw, _WHOLE), *[zlib.crc32(word[:k].encode("utf-8", "surrogatepass"), seed) for k, seed in _BEGIN if k <= n]]


def _here(shared: Broadcast, make):
    value = shared.value  # one object in a worker, as long as the workspace holds it
    return workspace(("toxicity", id(value)), lambda: (make(value), value))[0]


def _restorer(grams: tuple[np.ndarray, np.ndarray]) -> Restorer:
    return Restorer(CharModel(*grams))


def _vectors(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = _here(shared, _restorer)
        for batch in batches:
            out = [np.array(sorted(restorer.found(t.as_py())), np.uint32).tobytes() for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(out, pa.binary())], names=["label", "ids"])

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(gradient, size: int, rounds: int, start: np.ndarray | None = None) -> np.ndarray:
    w = np.zeros(size) if start is None else start.astype(float)
    m, v = np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g**2
        w = w - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def _floor(n1: np.ndarray, n: np.ndarray, share: float) -> np.ndarray:
    """A cautious share of class 1 among n documents with a feature, n1 of them of class 1, as a logit."""
    p = (n1 + 2 * share) / (n + 2)
    low = np.clip(p - 3.5 * np.sqrt(p * (1 - p) / (n + 2)), 1e-3, 1 - 1e-3)
    return np.log(low / (1 - low))


class Classifier:
    """Weights by feature, cautious logits by feature, and the second stage's three coefficients."""

    def __init__(self, weights: dict[int, float], logits: dict[int, float], first: float, stage: tuple[float, float, float]):
        self.weights, self.logits, self.first, self.stage = weights, logits, first, stage

    def score(self, found: list[int]) -> float:
        """``found``: the features that have a weight, sorted."""
        linear = self.first + sum(self.weights[f] for f in found)
        best = max([_LEAST, *(self.logits[f] for f in found)])
        x = self.stage[0] + self.stage[1] * max(-30.0, min(30.0, linear)) + self.stage[2] * best
        if best > EVIDENT:  # nearly all documents with this feature are of class 1
            x = max(x, best)
        return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


_LEAST = math.log(1e-3 / (1 - 1e-3))


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """feature, n1, n: rows of class 1 and all rows that have it, added up for a batch."""
    for batch in batches:
        rows = [np.frombuffer(x, np.uint32) for x in batch["ids"].to_pylist()]
        ids, where = np.unique(np.concatenate(rows) if rows else np.zeros(0, np.uint32), return_inverse=True)
        ones = np.repeat(batch["label"].to_numpy(zero_copy_only=False), [len(r) for r in rows])
        n1 = np.bincount(where, ones, len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(n1), pa.array(np.bincount(where, minlength=len(ids)))], names=["feature", "n1", "n"])


def telling_features(vectors: DataFrame, share: float, keep: int = FEATURES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features that speak for class 1, at most ``keep`` of them by strength, sorted; how many rows of class 1 and of all have each."""
    counts = vectors.mapInArrow(_feature_counts, "feature long, n1 long, n long").groupBy("feature").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n")).where("n1 >= 2 and n >= 4")
    z = (F.col("n1") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1e-9)
    top = counts.withColumn("z", z).where("z > 2").orderBy(F.desc("z"), "feature").limit(keep).toArrow().sort_by("feature")
    return tuple(top[c].to_numpy() for c in ("feature", "n1", "n"))


def _kept(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            rows = [x[np.isin(x, wanted)].tobytes() for x in (np.frombuffer(r, np.uint32) for r in batch["ids"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(rows, pa.binary())], names=["label", "ids"])

    return run


def fit(labels: np.ndarray, rows: list[np.ndarray], ids: np.ndarray, n1: np.ndarray, n: np.ndarray, rounds: int = 150) -> Classifier:
    """Logistic regression with an L2 penalty on the features ``ids`` (sorted; n1 rows of class 1 and n rows have them), then a
    second one on its result and on the strongest single feature, which lets one telling word in a long text count. A document's
    own label is left out of the strength of its features. ``rows`` hold features of ``ids`` only."""
    share = float(labels.mean()) if len(labels) else 0.0
    prior = math.log((share * len(labels) + 0.5) / ((1 - share) * len(labels) + 0.5))
    if not len(labels) or share in (0.0, 1.0):
        return Classifier({}, {}, prior, (0.0, 1.0, 0.0))
    y, k = labels.astype(np.float64), len(ids)
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r) for r in rows])
    mine = np.searchsorted(ids, np.concatenate(rows).astype(np.int64)).astype(np.int32)

    def first(wb: np.ndarray) -> np.ndarray:
        err = _sigmoid(np.bincount(of, wb[mine], len(rows)) + wb[k]) - y
        return np.append(np.bincount(mine, err[of], k) / len(rows) + 1e-4 * wb[:k], err.mean())

    wb = _adam(first, k + 1, rounds, np.append(np.zeros(k), prior))
    linear = np.clip(np.bincount(of, wb[mine], len(rows)) + wb[k], -30, 30)
    best = np.full(len(rows), _LEAST)
    np.maximum.at(best, of, _floor(n1[mine] - y[of], n[mine] - 1, share))
    x = np.stack([np.ones(len(rows)), linear, best], axis=1)
    stage = _adam(lambda c: x.T @ (_sigmoid(x @ c) - y) / len(rows) + np.array([0, 1e-3, 1e-3]) * c, 3, 600, np.array([prior, 0.1, 0.1]))
    return Classifier(dict(zip(ids.tolist(), wb[:k].tolist(), strict=True)), dict(zip(ids.tolist(), _floor(n1, n, share).tolist(), strict=True)), float(wb[k]), tuple(stage.tolist()))


def _scorer(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, model = shared.value
        restorer = _here(shared, lambda x: _restorer(x[0]))
        for batch in batches:
            scores = [model.score(sorted(restorer.found(text.as_py(), model.weights))) for text in batch["text"]]
            yield carried(batch, {"doc_id": batch["doc_id"], "score": pa.array(scores, pa.float64())})

    return run


def learnable(doc_id) -> F.Column:
    """Whether labels of this id may be learned from."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) != 0


def score(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", carry: bool = False) -> DataFrame:
    """doc_id, score for each row of ``docs``. ``corpus``: the texts of labels and of character counts, if not ``docs``;
    ``carry`` adds ``row``, the whole row of ``docs``."""
    spark = docs.sparkSession
    corpus = narrow(docs if corpus is None else corpus, id_col, text_col)
    grams = character_counts(corpus).orderBy("gram").toPandas()  # at most len(ALPHABET) ** 3 rows
    arrays = (grams["gram"].to_numpy(np.int64), grams["n"].to_numpy(np.int64))
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null")
    known = known.where(learnable(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    known = staged(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labels")  # at most train_rows rows of two numbers
    shared = spark.sparkContext.broadcast(arrays)
    keyed = corpus.withColumn("same", F.xxhash64("text"))
    once = keyed.select("doc_id", "same").join(F.broadcast(known), "doc_id").distinct()  # repeated rows teach once
    once = staged(once.orderBy(F.xxhash64("doc_id"), "doc_id", "same").limit(train_rows), "texts", frees=(known,))
    taught = keyed.join(F.broadcast(once), ["doc_id", "same"]).dropDuplicates(["doc_id", "same"])
    vectors = staged(taught.select("label", "text").mapInArrow(_vectors(shared), "label int, ids binary"), "vectors", frees=(once,))
    total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("ones")).first()
    ids, n1, n = telling_features(vectors, total["ones"] / max(1, total["n"]))
    rows = vectors.mapInArrow(_kept(spark.sparkContext.broadcast(ids.astype(np.uint32))), "label int, ids binary").toArrow()  # at most train_rows rows of telling features
    free(vectors)
    found = sorted(zip(rows["ids"].to_pylist(), rows["label"].to_pylist(), strict=True))  # the order of tasks does not matter
    model = fit(np.array([y for _, y in found], np.int64), [np.frombuffer(r, np.uint32) for r, _ in found], ids, n1, n)
    ready = spark.sparkContext.broadcast((arrays, model))
    given = narrow(docs, id_col, text_col, carry)
    return given.mapInArrow(_scorer(ready), extended(given, "doc_id long, score double"))
