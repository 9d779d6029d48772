"""One query for each family of operators, over whole tables; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..fixed import DOMAINS
from ..functions import answers, identity, text, verdicts
from ..operators import classify, control, diagnostics, evaluate, features, mcq, options, report, sampling, training
from ..operators.positions import numbered
from ..sources.files import fingerprints
from .items import completions, items, neutral, pairs, split_items, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SAMPLE = 50
SEPARATOR = "\x01"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _six(c: Column | str) -> Column:
    """Six decimals, by operations that every engine does alike; NaN and null stay."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), c).otherwise(F.floor(c * 1e6 + 0.5) / F.lit(1e6))


def _joined(c: Column | str) -> Column:
    return F.md5(F.array_join(c, SEPARATOR))


@query
def item_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_items(spark, sf_dir).select("item_no", "item_id", "domain", identity.stable_hash(F.col("item_id")).alias("stable_hash"), F.col("bucket").cast("long").alias("bucket"), "is_test")


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = split_items(spark, sf_dir)
    return rows.groupingSets([[F.col("domain"), F.col("is_test")], [F.col("is_test")]], F.col("domain"), F.col("is_test")).agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("n_ids"))


ANSWER_CASES = [("letter", "B", 4), ("spaced", " b)", 4), ("empty", "", 4), ("blank", "   ", 4), ("beyond", "Z", 4), ("missing", None, 4), ("no options", "A", 0), ("nbsp", " c", 4), ("last", "D", 4), ("over", "E", 4), ("digit", "1", 4)]


@query
def answer_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([(n, a, ["x"] * k) for n, a, k in ANSWER_CASES], "case_id string, answer string, options array<string>")
    rows = items(spark, sf_dir).select(F.col("item_no").cast("string").alias("case_id"), "answer", "options").unionByName(cases)
    at = answers.answer_index(F.col("answer"), F.col("options"))
    return rows.select("case_id", F.size("options").cast("long").alias("n_options"), at.cast("long").alias("answer_at"), at.isNotNull().alias("valid"))


@query
def gold_distractors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = options.with_gold(items(spark, sf_dir))
    usable = options.valid_distractors()
    return rows.select("item_no", F.md5("gold").alias("gold_md5"), text.has_text(F.col("gold")).alias("gold_has_text"), F.when(F.col("distractors").isNotNull(), F.size(usable)).cast("long").alias("n_distractors"), _joined(usable).alias("distractors_md5"))


@query
def options_exploded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = options.exploded(items(spark, sf_dir), "item_no", "item_id", "domain")
    return rows.select("item_no", "item_id", "domain", F.col("option_idx").cast("long").alias("option_idx"), F.col("label").cast("long").alias("label"), "text")


@query
def options_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir)
    new = control.usable_options(rows, "item_no").select("item_no", "place", F.lower("text").alias("new_text"))
    return options.reassembled(rows, new, "item_no").select("item_no", F.size("options").cast("long").alias("n_options"), _joined("options").alias("options_md5"))


@query
def word_sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), *[features.length_stats(F.col("text"), of).alias(p) for p, of in (("words", "words"), ("sents", "sentences"))])
    of = lambda p: [F.col(f"{p}.n").alias(f"n_{p}"), _six(F.col(f"{p}.mean")).alias(f"{p}_mean"), _six(F.col(f"{p}.var")).alias(f"{p}_var")]
    return rows.select("doc_id", "n_chars", *of("words"), *of("sents"))


@query
def word_len_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.burstiness(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", _six("burstiness").alias("word_len_burstiness"))


@query
def sent_len_burstiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.burstiness(table(spark, sf_dir, "documents"), "doc_id", "sentences").select("doc_id", _six("burstiness").alias("sent_len_burstiness"))


@query
def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.character_entropy(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", _six("char_entropy").alias("char_entropy"))


@query
def corpus_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.lexicon(table(spark, sf_dir, "documents")).select("token", "n", _six("zipf").alias("zipf"))


@query
def rare_token_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return features.rare_rate(docs, features.lexicon(docs), "doc_id").select("doc_id", _six("rare_token_rate").alias("rare_token_rate"))


@query
def shape_tag_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = features.tag_shares(table(spark, sf_dir, "benchmark"))
    return features.tag_divergence(table(spark, sf_dir, "documents"), reference, "doc_id").select("doc_id", _six("pos_kl_div").alias("pos_kl_div"))


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain (language), label (quality) and the features of labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label"))
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.col("lang").alias("domain"), "text").join(labels, "doc_id")
    made = features.with_features(rows, lexicon=features.lexicon(docs), reference=features.tag_shares(table(spark, sf_dir, "benchmark")))
    return made.select("doc_id", "domain", "label", *[_six(f).alias(f) for f in features.FEATURES])


@query
def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).withColumn("label", F.col("label").cast("long"))


@query
def option_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's feature rows: each usable option with its five features."""
    rows = options.exploded(items(spark, sf_dir), "item_no", "item_id", "domain")
    made = features.with_features(rows, lexicon=features.lexicon(table(spark, sf_dir, "documents")), reference=features.tag_shares(table(spark, sf_dir, "benchmark")))
    return made.select("item_no", "item_id", "domain", F.col("option_idx").cast("long").alias("option_idx"), F.col("label").cast("long").alias("label"), F.md5("text").alias("text_md5"), *[_six(f).alias(f) for f in features.FEATURES])


@query
def reference_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the first words of an ordered corpus."""
    return features.tag_counts(features.prefix(table(spark, sf_dir, "documents"), "doc_id"))


@query
def linguistic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.linguistic_tokens(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n_tokens"), _joined(found).alias("tokens_md5"))


@query
def text_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text")).alias("preview"))


@query
def label_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = options.exploded(items(spark, sf_dir), "domain")
    return rows.groupingSets([[F.col("domain"), F.col("label")], [F.col("label")]], F.col("domain"), F.col("label")).agg(F.count("*").alias("n")).withColumn("label", F.col("label").cast("long"))


@query
def keyed_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.keyed(items(spark, sf_dir).select("item_no", "item_id", "domain"), "domain", SAMPLE, "item_id", "item_no").withColumn("draw", F.col("draw").cast("long"))


@query
def matched_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of one size and seed from the raw and the transformed items: equal pools give equal ids."""
    rows = items(spark, sf_dir)
    drawn = [sampling.keyed(arm.select("item_no", "item_id", "domain"), "domain", SAMPLE, "item_id", "item_no").select("domain", "item_no", "item_id", F.lit(n).alias("arm")) for n, arm in ((1, rows), (2, neutral(rows)))]
    sides = drawn[0].unionByName(drawn[1]).groupBy("domain", "item_no", "item_id").agg(F.sum("arm").alias("arms"))
    return sides.groupBy("domain").agg(F.count_if(F.col("arms") == 3).alias("both"), F.count_if(F.col("arms") < 3).alias("one"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items in the order of their ids within a domain."""
    return numbered(items(spark, sf_dir), "domain", "item_id", "item_no")


@query
def parity_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that Python's generator draws from sorted items, in their own order again."""
    return sampling.resorted(_placed(spark, sf_dir).select("item_no", "item_id", "domain", "position"), "domain", "position", SAMPLE)


@query
def parity_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows in the order drawn, where a domain has more than the cap."""
    return sampling.capped(_placed(spark, sf_dir).select("item_no", "item_id", "domain", "position"), "domain", "position", SAMPLE)


@query
def serial_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options of a sample as one generator shuffles them row after row, domain after domain."""
    rows = sampling.capped(numbered(mcq.trainable(items(spark, sf_dir)), "domain", "item_id", "item_no"), "domain", "position", SAMPLE)
    rank = F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("domain")) - 1
    rows = rows.select("item_no", "domain", (rank * SAMPLE + F.col("place")).alias("seq"), F.slice(F.concat(F.array("gold"), "distractors"), 1, 4).alias("opts"))
    made = mcq.serial_permutation(rows, "seq", "opts")
    return made.select("item_no", "domain", "seq", F.array_join(F.transform("ord", lambda i: i.cast("string")), ",").alias("ord"), "correct_letter")


@query
def training_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effective batches and checkpoint steps for a grid of settings."""
    grid = spark.range(1, 9).select(F.col("id").alias("per_device")).crossJoin(F.broadcast(spark.range(1, 601, 57).select(F.col("id").alias("steps"))))
    return grid.select("per_device", "steps", training.effective_batch(F.col("per_device"), F.lit(4).cast("long")).alias("batch"), training.save_steps(F.col("steps")).alias("save_steps"))


@query
def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = control.with_chunks(items(spark, sf_dir).select("item_no", "item_id", "domain")).groupBy("domain", "chunk").agg(F.count("*").alias("n_items"))
    by = Window.partitionBy("domain")
    done = F.sum("n_items").over(by.orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("domain", "chunk", "n_items", done.alias("done"), _six(text.whole_percent(done, F.sum("n_items").over(by))).alias("percent"))


@query
def option_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.trainable(items(spark, sf_dir)).withColumn("opts", F.slice(F.concat(F.array("gold"), "distractors"), 1, 4))
    order = mcq.order_by_hash(F.col("item_id"), F.lit("train"), F.col("opts"))
    return rows.select("item_no", F.array_join(F.transform(order, lambda i: i.cast("string")), ",").alias("ord"), mcq.correct_letter(order).alias("correct_letter"))


@query
def mcq_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = items(spark, sf_dir).where(~identity.is_test(F.col("item_id")))
    return mcq.examples(evaluate.require_rows(rows, "training items"), "item_no", "item_id")


@query
def paired_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcq.variants(pairs(spark, sf_dir))


@query
def letter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.first_letter(F.col("text")).alias("letter"))


@query
def reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.chr((F.lit(65) + F.pmod("conv_id", F.lit(4))).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.reward(F.col("text"), gold).alias("reward"))


@query
def reward_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reward as a trainer's SQL calls it."""
    answers.register(spark)
    rows = table(spark, sf_dir, "conversations").withColumn("gold", F.chr((F.lit(65) + F.pmod("conv_id", F.lit(4))).cast("int")))
    return rows.selectExpr("conv_id", "turn", "reward(text, gold) AS reward")


def _accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    evaluate.require_all(**{"test items": pairs(spark, sf_dir)})
    return evaluate.accuracy(completions(spark, sf_dir))


@query
def console_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports while it goes: rows by split, label balance, accuracies; name and value."""
    split = split_items(spark, sf_dir).groupBy(F.when(F.col("is_test"), "test items").otherwise("training items").alias("name")).agg(F.count("*").cast("double").alias("value"))
    balance = options.exploded(items(spark, sf_dir), "domain").groupBy(F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" "), "domain").alias("name")).agg(F.count("*").cast("double").alias("value"))
    accuracy = _accuracy(spark, sf_dir).select(F.concat_ws(" ", F.lit("accuracy"), "grp", "variant", F.coalesce("domain", F.lit("overall"))).alias("name"), _six("accuracy").alias("value"))
    return split.unionByName(balance).unionByName(accuracy)


@query
def empty_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains that would be warned about, of the audit's and one that does not exist."""
    missing = evaluate.empty_domains(items(spark, sf_dir), (*DOMAINS, "law"))
    return spark.createDataFrame([(d,) for d in missing], "domain string")


@query
def prompt_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.variants(pairs(spark, sf_dir))
    return rows.select("item_no", "variant", diagnostics.prompt_preview(F.col("prompt")).alias("preview"))


@query
def accuracy_by_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accuracy(spark, sf_dir).withColumn("accuracy", _six("accuracy"))


@query
def exploitation_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.gaps(_accuracy(spark, sf_dir)).withColumn("gap", _six("gap"))


AUROC_CASES = [("high", 0.75), ("middle", 0.60), ("below", 0.5999), ("published", 0.562), ("nan", float("nan")), ("missing", None)]


@query
def verdicts_by_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame(AUROC_CASES, "name string, value double").select("name", verdicts.separability(F.col("value")).alias("verdict"))
    gap = evaluate.gaps(_accuracy(spark, sf_dir))
    side = lambda g: F.max(F.when(F.col("grp") == g, F.col("gap")))
    rows = gap.groupBy(F.coalesce("domain", F.lit("overall")).alias("name")).agg(side("treatment").alias("t"), side("control").alias("c"))
    return cases.unionByName(rows.select(F.concat(F.lit("gap "), "name").alias("name"), verdicts.exploitation(_six("t"), _six("c")).alias("verdict")))


def _by_feature(rows: DataFrame) -> DataFrame:
    """Rows once for their domain and once for all, a score a feature."""
    scores = F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("score")) for f in features.FEATURES]))
    return rows.select(F.explode(F.array(F.lit("overall"), "domain")).alias("split"), "label", *features.FEATURES).select("split", "label", scores)


@query
def auroc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.auroc(_by_feature(_features(spark, sf_dir)), "split", "feature").withColumn("auroc", _six("auroc"))


@query
def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.table(_accuracy(spark, sf_dir))
    return rows.select("grp", "domain", *[_six(c).alias(c) for c in ("original", "neutralized", "adversarial", "gap")])


@query
def chart_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = report.chart(evaluate.gaps(_accuracy(spark, sf_dir)))
    return rows.select("domain", _six("treatment").alias("treatment"), _six("control").alias("control"))


@query
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _accuracy(spark, sf_dir).select("grp", F.coalesce("domain", F.lit("")).alias("place"), "variant", F.concat_ws("|", "grp", F.coalesce("domain", F.lit("overall")), "variant", F.col("n_correct").cast("string"), F.col("n").cast("string")).alias("line"))
    return report.lines(rows, "line", "grp", "place", "variant")


@query
def dedup_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    opts = control.usable_options(items(spark, sf_dir), "item_no", "domain").withColumn("key", control.text_key(F.col("text")))
    new = opts.select("domain", "key", "text").dropDuplicates(["domain", "key"]).select("domain", "key", F.lower("text").alias("new_text"))
    return opts.drop("text").join(new, ["domain", "key"]).select("item_no", F.col("place").cast("long").alias("place"), "domain", F.md5("new_text").alias("new_md5"))


@query
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sink holds the items of even number."""
    rows = items(spark, sf_dir).select("item_no", "item_id", "domain")
    done = rows.where(F.pmod("item_no", F.lit(2)) == 0)
    return control.pending(rows, done)


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """domain, chunk, batch, length, text of distinct prompts, each in the chunk that first uses it."""
    rows = control.with_chunks(items(spark, sf_dir).select("item_no", "item_id", "domain", "options"))
    first = control.first_uses(control.usable_options(rows, "domain", "chunk", "position"), "chunk", "position", "place")
    sized = first.select("domain", "chunk", F.md5("text").alias("text"), control.token_length(control.prompt(F.col("domain"), F.col("text"))).alias("length"))
    return control.batches(sized, "domain", "chunk")


@query
def greedy_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir).select("domain", "chunk", F.col("batch").cast("long").alias("batch"), F.col("text").alias("text_md5"), F.col("length").cast("long").alias("length"))


@query
def decode_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = _packed(spark, sf_dir).groupBy("domain", "chunk", "batch").agg(F.count("*").alias("n_seqs"), F.max("length").alias("longest"))
    return per.select("domain", "chunk", F.col("batch").cast("long").alias("batch"), "n_seqs", F.col("longest").cast("long").alias("longest"), control.decode_budget(F.col("longest")).cast("long").alias("budget"))


@query
def control_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = control.writable(neutral(items(spark, sf_dir)))
    first = F.get("options", F.lit(0))
    return rows.select("item_no", "item_id", "domain", control.style(F.col("domain")).alias("style"), F.md5("question").alias("question_md5"), _joined("options").alias("options_md5"), F.md5(control.prompt(F.col("domain"), first)).alias("prompt_md5"), "answer")


@query
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of distinct options as a chat model is asked, cut to its input."""
    opts = control.usable_options(items(spark, sf_dir), "item_no", "domain")
    asked = control.chat(control.prompt(F.col("domain"), F.col("text")))
    return opts.select("item_no", F.col("place").cast("long").alias("place"), F.md5(asked).alias("chat_md5"), F.md5(control.truncated(F.col("text"), 64)).alias("cut_md5"), control.token_length(F.col("text"), 64).cast("long").alias("length"))


@query
def completion_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    per = diagnostics.profile(rows, "role")
    return per.join(diagnostics.first_characters(rows, "role").withColumnRenamed("n", "n_first"), "role", "left")


@query
def policy_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = diagnostics.side_by_side(completions(spark, sf_dir), "item_no", "item_id", "variant")
    return diagnostics.agreement(sides, "variant").select("variant", "same", "n", "identical_outputs")


FILE_CASES = [("treatment", "a.bin", "11"), ("treatment", "b.bin", "22"), ("control", "a.bin", "11"), ("control", "b.bin", "33")]


@query
def file_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagnostics.same_files(spark.createDataFrame(FILE_CASES, "grp string, file string, md5 string"))


@query
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "k long")
    return table(spark, sf_dir, "events").select("event_id", props["k"].alias("k"), F.to_json(F.struct(props["k"].alias("k"), "event_type")).alias("out"))


@query
def parity_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mcq.parity_orders(pairs(spark, sf_dir))
    return rows.select("item_no", "item_id", "variant", F.array_join(F.transform("ord", lambda i: i.cast("string")), ",").alias("ord"))


def _trained(model: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = classify.model_scores(_features(spark, sf_dir), features.FEATURES, "doc_id", "label", model, ("domain",))
        scored = scored.select(F.explode(F.array(F.lit("overall"), "domain")).alias("split"), "label", "score")
        return classify.auroc(scored, "split")

    return run


QUERIES["gbt_auroc"] = _trained("gbt")
QUERIES["logreg_auroc"] = _trained("logreg")


@query
def file_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark, sf_dir, "*.parquet")


