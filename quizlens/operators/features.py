"""Surface statistics of texts, each computed where the text is: no statistic of a row is shuffled.

Lengths of words and sentences are native array expressions. Characters, rare words and tags are counted in one
Arrow kernel that reads each text once (``feature_table`` takes all five features from it). A repeated or null key
changes nothing, as no row meets another. Entropy by exploded characters (``plan="explode"``) is there for comparison.

Taggers are plugged in as factories: ``tagger()`` is called once in a worker and gives a function from a text to its tags. A
factory that cannot build one gives NaN divergences, not an error.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import EPSILON, RARE_ZIPF
from ..functions.text import has_text, sentences, words

NAN = float("nan")
Tagger = Callable[[str], list[str]]

#: Tags by the shape of a token, first match wins; a stand-in for a tagger where none is installed.
SHAPES = (("NUM", r"^[0-9]+([.,][0-9]+)*[.,]?$"), ("PUNCT", r"^[^A-Za-z0-9À-ÿ]+$"), ("CAP", r"^[A-ZÀ-Þ]"), ("LOW", r"^[a-zß-ÿ]+$"))
OTHER_SHAPE = "MIX"
TAGS = tuple(t for t, _ in SHAPES) + (OTHER_SHAPE,)
#: Tokens whose tag a worker remembers.
REMEMBERED = 200_000
#: Words of an ordered corpus that a reference distribution is taken from.
REFERENCE_WORDS = 200_000


def shape_tagger(split: Callable[[str], list[str]] = str.split) -> Tagger:
    """Tags by SHAPES of the tokens that ``split`` gives."""
    patterns = [(t, re.compile(p).search) for t, p in SHAPES]
    known: dict[str, str] = {}

    def tag(text: str) -> list[str]:
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for token in split(text):
            if (found := known.get(token)) is None:
                found = known[token] = next((t for t, matches in patterns if matches(token)), OTHER_SHAPE)
            out.append(found)
        return out

    return tag


def _built(tagger: Callable[[], Tagger] | None) -> Tagger | None:
    try:
        return tagger() if tagger else None
    except Exception as e:  # a tagger that is not installed, or lacks its data
        print(f"no tagger: {e!r}")
        return None


def tokens(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    return df.select(*keep, F.explode(words(F.col(text))).alias("token"))


# ---- lengths ---------------------------------------------------------------------------------------------------


def length_stats(text: Column, of: str = "words") -> Column:
    """Struct n, mean, var of the lengths of a text's words or sentences; from whole sums, so exact in any order."""
    parts = F.coalesce((words if of == "words" else sentences)(text), F.array().cast("array<string>"))
    zero = F.struct(F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("q"))
    longs = F.transform(parts, lambda x: F.length(x).cast("long"))
    sums = F.aggregate(longs, zero, lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["q"] + x * x).alias("q")))
    n = F.size(parts).cast("long")
    return F.transform(F.array(sums), lambda z: F.struct(n.alias("n"), F.when(n > 0, z["s"] / n).alias("mean"), F.when(n > 0, (n * z["q"] - z["s"] * z["s"]) / (n * n)).alias("var")))[0]


def burstiness(df: DataFrame, key: str, of: str = "words", text: str = "text") -> DataFrame:
    """key, burstiness: variance over mean of lengths; 0 for fewer than two."""
    x = df.select(key, length_stats(F.col(text), of).alias("x"))
    return x.select(key, F.when((F.col("x.n") < 2) | (F.col("x.mean") == 0), 0.0).otherwise(F.col("x.var") / F.col("x.mean")).alias("burstiness"))


# ---- the kernel ------------------------------------------------------------------------------------------------


def _burst(parts: list[str]) -> float:
    n = len(parts)
    lengths = np.fromiter(map(len, parts), np.int64, n)
    s, q = int(lengths.sum()), int((lengths * lengths).sum())
    return ((n * q - s * s) / (n * n)) / (s / n) if n > 1 and s else 0.0


def _entropy(text: str) -> float:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(codes) if codes.max() < 65536 else np.unique(codes, return_counts=True)[1]
    p = counts[counts > 0] / len(codes)
    return 0.0 - float((p * np.log2(p)).sum())


def _divergence(tags: list[str], reference: dict[str, float]) -> float:
    """Over the tags that either has; one that lacks a tag has EPSILON of it."""
    n, out = len(tags), 0.0
    counts = Counter(tags)
    for t in sorted({*counts, *reference}):
        p = counts[t] / n if t in counts else EPSILON
        out += p * math.log((p + EPSILON) / (reference.get(t, EPSILON) + EPSILON))
    return out


def _kernel(wanted: tuple[str, ...], common=None, reference: dict[str, float] | None = None, tagger: Callable[[], Tagger] | None = None):
    """A Pandas function from texts to a struct of the wanted features; null stands for NaN."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = common.value if common is not None else frozenset()
        tag = _built(tagger)
        for texts in batches:
            out = {f: np.full(len(texts), np.nan) for f in wanted}
            for i, text in enumerate(texts):
                text = text or ""
                parts = text.split() if "rare_token_rate" in out or "word_len_burstiness" in out else []
                if "rare_token_rate" in out and parts:
                    out["rare_token_rate"][i] = 1 - sum(w in known for w in map(str.lower, parts)) / len(parts)
                if "word_len_burstiness" in out:
                    out["word_len_burstiness"][i] = _burst(parts)
                if "sent_len_burstiness" in out:
                    out["sent_len_burstiness"][i] = _burst([s for x in text.split(".") if (s := x.strip())])
                if "char_entropy" in out and text:
                    out["char_entropy"][i] = _entropy(text)
                if "pos_kl_div" in out and tag and (tags := tag(text)):
                    out["pos_kl_div"][i] = _divergence(tags, reference)
            yield pd.DataFrame(out)

    return F.pandas_udf(run, ", ".join(f"{f} double" for f in wanted))


FEATURES = ("rare_token_rate", "word_len_burstiness", "sent_len_burstiness", "char_entropy", "pos_kl_div")


def with_features(df: DataFrame, wanted: tuple[str, ...] = FEATURES, lexicon: DataFrame | None = None, reference: dict[str, float] | None = None, tagger: Callable[[], Tagger] = shape_tagger, text: str = "text") -> DataFrame:
    """``df`` with the wanted features of its texts as columns; NaN where a feature is not defined."""
    common = df.sparkSession.sparkContext.broadcast(common_tokens(lexicon)) if lexicon is not None else None
    made = _kernel(wanted, common, reference or {}, tagger if "pos_kl_div" in wanted else None)
    found = df.withColumn("_found", made(F.col(text)))
    return found.withColumns({f: F.coalesce(F.col("_found")[f], F.lit(NAN)) for f in wanted}).drop("_found")


def character_entropy(df: DataFrame, key: str, text: str = "text", plan: str = "kernel") -> DataFrame:
    """key, char_entropy in bits; NaN for a null or empty text. The exploded plan needs keys without repeats and nulls."""
    if plan == "kernel":
        return with_features(df.select(key, text), ("char_entropy",), text=text).select(key, "char_entropy")
    counts = df.select(key, F.explode(F.split(text, "")).alias("ch")).where("ch <> ''").groupBy(key, "ch").agg(F.count("*").alias("c"))
    # -sum(p log p) = log n - sum(c log c) / n, so one more aggregation is enough
    of = counts.groupBy(key).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s")).select(key, (F.log2("n") - F.col("s") / F.col("n")).alias("char_entropy"))
    return df.select(key).join(of, key, "left").select(key, F.coalesce("char_entropy", F.lit(NAN)).alias("char_entropy"))


# ---- words of a corpus ------------------------------------------------------------------------------------------


def token_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """token (lower case), n."""
    return tokens(df, text=text).groupBy(F.lower("token").alias("token")).agg(F.count("*").alias("n"))


def zipf(counts: DataFrame, total: int) -> DataFrame:
    """token, n, zipf: the logarithm of occurrences in a billion tokens."""
    return counts.select("token", "n", (F.log10(F.col("n") / F.lit(float(max(1, total)))) + 9).alias("zipf"))


def lexicon(df: DataFrame, text: str = "text") -> DataFrame:
    """``zipf`` of a corpus's own words. Their number is summed up row by row, so words are shuffled once."""
    total = df.agg(F.sum(F.size(words(F.col(text))).cast("long"))).first()[0] or 0
    return zipf(token_counts(df, text), total)


def common_tokens(lexicon: DataFrame, at_least: float = RARE_ZIPF) -> frozenset[str]:
    """Tokens that are not rare. Each has at least 10^(at_least - 9) of all tokens, so there are at most 10^(9 - at_least), and
    together they are at most that many times as long as a token of the corpus is on average."""
    return frozenset(r["token"] for r in lexicon.where(F.col("zipf") >= at_least).select("token").toLocalIterator())


def rare_rate(df: DataFrame, lexicon: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, rare_token_rate: share of tokens that the lexicon does not hold or holds as rare; NaN without tokens."""
    return with_features(df.select(key, text), ("rare_token_rate",), lexicon, text=text).select(key, "rare_token_rate")


def prefix(df: DataFrame, order: str, most: int = REFERENCE_WORDS, text: str = "text") -> DataFrame:
    """``df``'s rows in the order of ``order`` (without repeats) up to ``most`` words, the last text cut there and joined by spaces.

    At most ``most`` rows have a word each, so only so many pairs of numbers are put in order.
    """
    from pyspark.sql import Window

    sized = df.where(has_text(F.col(text))).select(order, F.size(words(F.col(text))).cast("long").alias("_n")).orderBy(order).limit(most)
    sums = sized.withColumn("_before", F.sum("_n").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    last = sums.where(F.col("_before") < most).agg(F.max_by(F.struct(order, "_before"), order).alias("x")).first()["x"]
    if last is None:
        return df.limit(0)
    cut = F.array_join(F.slice(words(F.col(text)), 1, int(most - last["_before"])), " ")
    return df.where(F.col(order) <= F.lit(last[order])).withColumn(text, F.when(F.col(order) == F.lit(last[order]), cut).otherwise(F.col(text)))


def tag_counts(df: DataFrame, text: str = "text", tagger: Callable[[], Tagger] = shape_tagger) -> DataFrame:
    """tag, n over all texts; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, counts = _built(tagger), Counter()
        for batch in batches:
            for x in batch["text"].to_pylist() if tag else ():
                counts.update(tag(x or ""))
        yield pa.RecordBatch.from_pydict({"tag": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    return df.select(F.col(text).alias("text")).mapInArrow(run, "tag string, n long").groupBy("tag").agg(F.sum("n").alias("n"))


def tag_shares(df: DataFrame, text: str = "text", tagger: Callable[[], Tagger] = shape_tagger) -> dict[str, float]:
    """Share of each tag among all; tags without tokens are absent. As many numbers as the tagger has tags reach the driver."""
    rows = tag_counts(df, text, tagger).collect()
    total = sum(r["n"] for r in rows)
    return {r["tag"]: r["n"] / total for r in rows}


def tag_divergence(df: DataFrame, reference: dict[str, float], key: str, text: str = "text", tagger: Callable[[], Tagger] = shape_tagger) -> DataFrame:
    """key, pos_kl_div; NaN without tokens or without a tagger."""
    return with_features(df.select(key, text), ("pos_kl_div",), reference=reference, tagger=tagger, text=text).select(key, "pos_kl_div")
