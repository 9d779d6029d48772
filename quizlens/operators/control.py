"""Control sets: styles, resumable and deduplicated transforms of options, packing into batches.

A transform is a function from texts to texts (a model call in production). It sees each distinct text of a domain
once; results go back to every place by a join. Batches bound (number of texts) x (longest text) by a token budget; a
batch that fails is halved until single texts, and a text that fails alone stays as it is and is marked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import DEFAULT_STYLE, ITEM_CHUNK, MAX_INPUT_TOKENS, MAX_NEW_TOKENS, MAX_SEQS, STYLE_OF_DOMAIN, TEMPLATES, TOKEN_BUDGET
from ..functions.text import has_text, words
from .options import reassembled
from .positions import chunked


def style(domain: Column) -> Column:
    pairs = [F.lit(x) for pair in STYLE_OF_DOMAIN.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), domain), F.lit(DEFAULT_STYLE))


def prompt(domain: Column, text: Column) -> Column:
    out = F.when(style(domain) == "code", F.replace(F.lit(TEMPLATES["code"]), F.lit("{text}"), text))
    return out.otherwise(F.replace(F.lit(TEMPLATES["prose"]), F.lit("{text}"), text))


#: How a chat model's tokenizer wraps a user's message: what stands before and behind it.
CHAT = ("<|im_start|>user\n", "<|im_end|>\n<|im_start|>assistant\n")


def chat(prompt: Column, wrap: tuple[str, str] = CHAT) -> Column:
    """A prompt as a chat model is asked; ``wrap`` is the model's own."""
    return F.concat(F.lit(wrap[0]), prompt, F.lit(wrap[1]))


Tokenizer = tuple[Callable[[str], list], Callable[[list], str]]


def token_length(c: Column, most: int = MAX_INPUT_TOKENS, tokenizer: Callable[[], Tokenizer] | None = None) -> Column:
    """Tokens of a text as cut for a model: white-space tokens, where no tokenizer is plugged in.

    ``tokenizer()`` is called once in a worker and gives the functions that encode and decode.
    """
    if tokenizer is None:
        return F.least(F.size(words(c)), F.lit(most))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, _ = tokenizer()
        for texts in batches:
            yield texts.map(lambda t: None if t is None else min(most, len(encode(t)))).astype("Int32")

    return F.pandas_udf(run, "int")(c)


def truncated(c: Column, most: int = MAX_INPUT_TOKENS, tokenizer: Callable[[], Tokenizer] | None = None) -> Column:
    """A text cut to its first tokens; white-space tokens are joined by a space. Shorter texts stay as they are."""
    if tokenizer is None:
        return F.when(F.size(words(c)) > most, F.array_join(F.slice(words(c), 1, most), " ")).otherwise(c)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode, decode = tokenizer()
        for texts in batches:
            yield texts.map(lambda t: t if t is None or len(ids := encode(t)) <= most else decode(ids[:most]))

    return F.pandas_udf(run, "string")(c)


def decode_budget(longest: Column, most: int = MAX_NEW_TOKENS) -> Column:
    return F.least(F.lit(most), F.ceil(longest * F.lit(1.6)) + 32).cast("int")


def pending(items: DataFrame, done: DataFrame, key: str = "item_id") -> DataFrame:
    """Items whose id the sink does not hold yet."""
    return items.join(done.select(key).where(F.col(key) != "").distinct(), key, "left_anti")


def writable(items: DataFrame) -> DataFrame:
    """Rows that a control set takes: with options and with an answer, valid or not."""
    return items.where((F.size("options") > 0) & (F.col("answer") != ""))


def usable_options(items: DataFrame, *keep: str) -> DataFrame:
    return items.select(*keep, F.posexplode("options").alias("place", "text")).where(has_text(F.col("text")))


def first_uses(options: DataFrame, *order: str) -> DataFrame:
    """Each distinct text of a domain with its first use in order; the partial step keeps one row a text and partition."""
    found = options.groupBy("domain", "text").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("uses"))
    return found.select("domain", "text", "uses", "first.*")


def batches(texts: DataFrame, *group: str, length: str = "length", tie: str = "text", budget: int = TOKEN_BUDGET, cap: int = MAX_SEQS) -> DataFrame:
    """``group``, batch, and the texts' structs in order of length; a group is a chunk's texts, so its size is bounded.

    A batch ends before the text that would make its size times its longest text exceed the budget, or
    its size exceed the cap. A single text over the budget is a batch.
    """
    packed = texts.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col(length).cast("int").alias("length"), F.col(tie).alias("tie")))).alias("sorted"))
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # lengths ascend, so the text at hand is the longest so far
        full = (acc["n"] > 0) & (((acc["n"] + 1) * x["length"] > budget) | (acc["n"] + 1 > cap))
        batch = acc["batch"] + full.cast("int")
        return F.struct(batch.alias("batch"), F.when(full, 1).otherwise(acc["n"] + 1).alias("n"), F.concat(acc["out"], F.array(batch)).alias("out"))

    numbers = F.aggregate("sorted", zero, step, lambda acc: acc["out"])
    return packed.select(*group, F.inline(F.arrays_zip(F.col("sorted").alias("item"), numbers.alias("batch")))).select(*group, "batch", F.col("item.length").alias("length"), F.col("item.tie").alias(tie))


def run_batch(transform: Callable[[list[str]], list[str]], texts: list[str]) -> list[tuple[str, bool]]:
    """(result, kept as it was) of each text; a failing batch is tried in halves."""
    try:
        return [(r, False) for r in transform(texts)]
    except MemoryError:
        if len(texts) == 1:
            return [(texts[0], True)]
        half = max(1, len(texts) // 2)
        return run_batch(transform, texts[:half]) + run_batch(transform, texts[half:])


def transformed(distinct: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], budget: int = TOKEN_BUDGET, cap: int = MAX_SEQS, tokenizer: Callable[[], Tokenizer] | None = None) -> DataFrame:
    """domain, text, new_text, fallback. ``make`` builds the transform once a task; batches follow the packing rule."""

    def kernel(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        transform = make()
        for part in parts:
            part = part.sort_values(["length", "text"], kind="stable")
            new, lo, n = [], 0, part["length"].tolist()
            for hi in range(1, len(n) + 1):
                if hi == len(n) or (hi - lo + 1) * n[hi] > budget or hi - lo + 1 > cap:
                    new += run_batch(transform, part["text"].tolist()[lo:hi])
                    lo = hi
            yield pd.DataFrame({"domain": part["domain"].to_numpy(), "text": part["text"].to_numpy(), "new_text": [x for x, _ in new], "fallback": [x for _, x in new]})

    return distinct.select("domain", "text", token_length(F.col("text"), tokenizer=tokenizer).alias("length")).mapInPandas(kernel, "domain string, text string, new_text string, fallback boolean")


def text_key(text: Column) -> Column:
    """A digest that stands for a text in joins, so that whole texts are shuffled once only."""
    return F.unhex(F.sha2(text, 256))


def remembered(distinct: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], memo: str) -> DataFrame:
    """``transformed`` with a memory across runs: Parquet in the folder ``memo``, to which results of new texts are added."""
    spark = distinct.sparkSession
    schema = "domain string, text string, new_text string, fallback boolean"
    path = spark._jvm.org.apache.hadoop.fs.Path(memo)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    keyed = distinct.withColumn("key", text_key(F.col("text")))
    if there:
        old = spark.read.schema(schema).parquet(memo).select("domain", text_key(F.col("text")).alias("key"))
        keyed = keyed.join(old, ["domain", "key"], "left_anti")
    transformed(keyed, make).write.mode("append").parquet(memo)
    return spark.read.schema(schema).parquet(memo)


def control_set(items: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]], key: str = "item_no", dedup: bool = True, memo: str | None = None) -> DataFrame:
    """Items with all usable options transformed: distinct texts, one call each, joined back and put in their places.

    Without ``dedup`` a text is transformed once for each chunk that uses it, as a transform that samples may give
    other results there; ``items`` then have a column ``chunk``. ``memo``: see ``remembered``.
    """
    by = ["domain", "key"] if dedup else ["domain", "chunk", "key"]
    options = usable_options(items, key, *by[:-1]).withColumn("key", text_key(F.col("text")))
    distinct = options.select(*by, "text").dropDuplicates(by)
    if memo is not None:
        new = remembered(distinct.select("domain", "text").dropDuplicates(), make, memo).select("domain", text_key(F.col("text")).alias("key"), "new_text").dropDuplicates(["domain", "key"])
        by = ["domain", "key"]
    elif dedup:
        new = transformed(distinct, make).select("domain", text_key(F.col("text")).alias("key"), "new_text")
    else:  # the chunk travels as part of the group
        group = F.to_json(F.struct("domain", "chunk"))
        new = transformed(distinct.select(group.alias("domain"), "text"), make).select(F.from_json("domain", "domain string, chunk long").alias("g"), text_key(F.col("text")).alias("key"), "new_text").select("g.*", "key", "new_text")
    placed = options.drop("text").join(new, by).select(key, "place", "new_text")
    return writable(reassembled(items, placed, key))


def with_chunks(items: DataFrame, size: int = ITEM_CHUNK) -> DataFrame:
    return chunked(items, "domain", "item_id", "item_no", size)
