"""Every query runs over whole tables and gives the rows of its SQL."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quizlens.plans.catalogue import QUERIES
from quizlens.plans.sql import SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no shared tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["item_identity", "options_exploded", "exploitation_gap", "word_len_burstiness", "sent_len_burstiness", "word_sentence_stats"])
def test_native_queries_have_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan


def test_columns_are_pruned_at_the_scan(spark):
    plan = QUERIES["letter_parse"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<conv_id:bigint,turn:bigint,text:string>" in plan


@pytest.mark.parametrize("name", ["word_sentence_stats", "word_len_burstiness", "sent_len_burstiness", "char_entropy", "shape_tag_kl", "rare_token_rate"])
def test_statistics_of_a_row_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_parity_samples_and_permutations_are_those_of_python(spark):
    import hashlib
    import random

    from quizlens.fixed import DOMAINS
    from quizlens.operators import mcq
    from quizlens.plans.catalogue import SAMPLE
    from quizlens.plans.items import items

    rows = {}
    for r in items(spark, SF).collect():
        rows.setdefault(r.domain, []).append(r)
    sampled, capped = {}, {}
    for d, have in rows.items():
        have.sort(key=lambda r: (r.item_id, r.item_no))
        drawn = random.Random(42).sample(have, SAMPLE) if len(have) > SAMPLE else have
        capped[d] = [r.item_no for r in drawn]
        sampled[d] = [r.item_no for r in sorted(drawn, key=lambda r: (r.item_id, r.item_no))]
    by = lambda name, order: {d: [r.item_no for r in sorted(QUERIES[name](spark, SF).where(F.col("domain") == d).collect(), key=lambda r: r[order])] for d in rows}
    assert by("parity_sample", "place") == sampled and by("parity_capped", "place") == capped
    got = sorted(QUERIES["serial_permutation"](spark, SF).collect(), key=lambda r: r.seq)
    assert [DOMAINS.index(r.domain) for r in got] == sorted(DOMAINS.index(r.domain) for r in got)
    orders = mcq.serial_orders([len(r.ord.split(",")) for r in got])
    assert [([int(x) for x in r.ord.split(",")], r.correct_letter) for r in got] == orders
    made = {(r.item_no, r.variant): r.ord for r in QUERIES["parity_permutation"](spark, SF).collect()}
    for (item, _), _ in list(made.items())[:30]:
        sizes = [len(made[item, v].split(",")) for v in ("original", "neutralized", "adversarial")]
        ident = next(r.item_id for d in rows.values() for r in d if r.item_no == item)
        rng = random.Random(int(hashlib.md5(ident.encode()).hexdigest()[:8], 16) % 2**31)
        for v, n in zip(("original", "neutralized", "adversarial"), sizes, strict=True):
            order = list(range(n))
            rng.shuffle(order)
            assert made[item, v] == ",".join(map(str, order))


def test_fingerprints_are_those_of_the_files(spark):
    import hashlib

    got = {r.file: (r.md5, r.size_bytes) for r in QUERIES["file_fingerprints"](spark, SF).collect()}
    assert got == {n: (hashlib.md5(b := open(f"{SF}/{n}", "rb").read()).hexdigest(), len(b)) for n in os.listdir(SF)}


@pytest.mark.parametrize("name", ["gbt_auroc", "logreg_auroc"])
def test_classifiers_score_rows_they_have_not_seen(spark, name):
    import zlib

    labels = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = sum(zlib.crc32(str(d).encode()) % 5 == 0 for d in labels)
    got = {r.split: (r.auroc, r.n_samples) for r in QUERIES[name](spark, SF).collect()}
    assert got["overall"][1] == held and (math.isnan(got["overall"][0]) or 0 <= got["overall"][0] <= 1)


def test_test_and_training_items_are_disjoint(spark):
    rows = QUERIES["item_identity"](spark, SF)
    assert rows.where("is_test").select("item_id").intersect(rows.where("not is_test").select("item_id")).count() == 0
