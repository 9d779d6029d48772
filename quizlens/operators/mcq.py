"""Multiple-choice examples: permuted options, prompts, and the paired variants of a test.

Two permutations. Native: options in order of the MD5 of (item, variant, place), the same in any engine. Parity: the
shuffles of Python's generator seeded by the item, bit for bit, three in a row for the three variants.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..fixed import LETTERS, MAX_OPTIONS, QUESTION_FOOTER, QUESTION_HEADER, SEED, VARIANTS
from ..functions.answers import letter
from ..functions.identity import stable_hash
from ..functions.text import has_text
from .options import valid_distractors, with_gold


def order_by_hash(item: Column, variant: Column, options: Column) -> Column:
    """Places of the options in the order in which they are shown."""
    tickets = F.transform(options, lambda o, i: F.struct(F.md5(F.concat_ws(":", item, variant, i.cast("string"))).alias("h"), i.cast("int").alias("i")))
    return F.transform(F.array_sort(tickets), lambda t: t["i"])


def shown(options: Column, order: Column) -> Column:
    return F.transform(order, lambda i: F.get(options, i))


def correct_letter(order: Column) -> Column:
    """Letter of the option that was first before the permutation: the right one."""
    return letter((F.array_position(order, F.lit(0)) - 1).cast("int"))


def prompt(options: Column) -> Column:
    lines = F.transform(options, lambda o, i: F.concat(letter(i.cast("int")), F.lit(". "), o))
    return F.concat(F.lit(QUESTION_HEADER), F.array_join(lines, "\n"), F.lit(QUESTION_FOOTER))


def trainable(items: DataFrame) -> DataFrame:
    """Items with a right option that is not blank and at least one usable other."""
    rows = with_gold(items).withColumn("distractors", valid_distractors())
    return rows.where(has_text(F.col("gold")) & (F.size("distractors") > 0))


def examples(items: DataFrame, *keep: str, variant: str = "train", most: int = MAX_OPTIONS) -> DataFrame:
    """Training examples: prompt, correct_letter and the kept columns."""
    rows = trainable(items).withColumn("shown_from", F.slice(F.concat(F.array("gold"), "distractors"), 1, most))
    rows = rows.withColumn("ord", order_by_hash(F.col("item_id"), F.lit(variant), F.col("shown_from")))
    return rows.select(*keep, prompt(shown(F.col("shown_from"), F.col("ord"))).alias("prompt"), correct_letter(F.col("ord")).alias("correct_letter"))


def latest(neutral: DataFrame, key: str = "item_id", seq: str = "item_no") -> DataFrame:
    """The last row of each id in order of loading."""
    rest = [c for c in neutral.columns if c != key]
    return neutral.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def paired(raw: DataFrame, neutral: DataFrame, most: int = MAX_OPTIONS) -> DataFrame:
    """item_no, item_id, domain and the options (right one first) of each variant, of items that both sides can use.

    ``raw`` rows may repeat an id, each is kept; of ``neutral`` rows the last of an id counts. The adversarial variant
    is the neutral one with one raw distractor in second place.
    """
    n = latest(with_gold(neutral).select("item_id", "item_no", F.col("gold").alias("ng"), valid_distractors().alias("nd"))).drop("item_no")
    r = with_gold(raw).select("item_no", "item_id", F.coalesce("domain", F.lit("unknown")).alias("domain"), F.col("gold").alias("rg"), valid_distractors().alias("rd"))
    both = r.join(n, "item_id").where((F.col("rg") != "") & (F.col("ng") != "") & (F.size("rd") > 0) & (F.size("nd") > 0))
    first = lambda g, d, k: F.concat(F.array(g), F.slice(d, 1, k))
    injected = F.concat(F.array("ng", F.get("rd", F.lit(0))), F.slice("nd", 1, most - 2))
    return both.select("item_no", "item_id", "domain", first("rg", "rd", most - 1).alias(VARIANTS[0]), first("ng", "nd", most - 1).alias(VARIANTS[1]), injected.alias(VARIANTS[2]))


def variants(pairs: DataFrame, permute=order_by_hash) -> DataFrame:
    """Three rows an item: variant, prompt, correct_letter; generated in place, without a union of three scans."""
    rows = pairs.select("item_no", "item_id", "domain", F.inline(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("opts")) for v in VARIANTS])))
    rows = rows.withColumn("ord", permute(F.col("item_id"), F.col("variant"), F.col("opts")))
    return rows.select("item_no", "item_id", "domain", "variant", prompt(shown(F.col("opts"), F.col("ord"))).alias("prompt"), correct_letter(F.col("ord")).alias("correct_letter"))


def shuffles(seed: int, *sizes: int) -> list[list[int]]:
    """Successive shuffles of 0 .. size-1 by one generator."""
    rng, out = random.Random(seed), []
    for n in sizes:
        order = list(range(n))
        rng.shuffle(order)
        out.append(order)
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def _parity(seed: pd.Series, a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([sum(shuffles(int(s), *map(int, n)), []) for s, *n in zip(seed, a, b, c, strict=True)])


def parity_orders(pairs: DataFrame) -> DataFrame:
    """item_no, item_id, variant, ord: the order in which Python's generator, seeded by the item, shows each variant."""
    seed = F.pmod(stable_hash(F.col("item_id")), F.lit(2**31))
    sizes = [F.size(v) for v in VARIANTS]
    rows = pairs.withColumn("orders", _parity(seed, *sizes))
    starts = [F.lit(1), sizes[0] + 1, sizes[0] + sizes[1] + 1]
    parts = [F.struct(F.lit(v).alias("variant"), F.slice("orders", a, n).alias("ord")) for v, a, n in zip(VARIANTS, starts, sizes, strict=True)]
    return rows.select("item_no", "item_id", F.inline(F.array(*parts)))


def serial_permutation(rows: DataFrame, position: str, options: str, seed: int = SEED) -> DataFrame:
    """``rows`` with ``ord`` and ``correct_letter`` as one generator gives them row after row in the order of ``position``.

    Inherently serial, so a single task has a position and a number of each row, and nothing else; meant for samples.
    """
    sizes = rows.select(F.col(position).alias("p"), F.size(options).alias("n")).coalesce(1).sortWithinPartitions("p")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = random.Random(seed)
        for part in parts:
            orders = []
            for n in part["n"].tolist():
                order = list(range(n))
                rng.shuffle(order)
                orders.append(order)
            yield pd.DataFrame({"p": part["p"], "ord": orders})

    made = sizes.mapInPandas(run, "p long, ord array<int>").withColumnRenamed("p", position)
    return rows.join(made, position).withColumn("correct_letter", correct_letter(F.col("ord")))


def serial_orders(sizes: list[int], seed: int = SEED) -> list[tuple[list[int], str]]:
    """(order, correct letter) of items in sequence by a single generator, for a list in the driver."""
    rng, out = random.Random(seed), []
    for n in sizes:
        order = list(range(n))
        rng.shuffle(order)
        out.append((order, LETTERS[order.index(0)]))
    return out
