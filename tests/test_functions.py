"""Scalar functions on edge tables, against plain Python."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quizlens.functions import answers, identity, text, verdicts

TEXTS = ["", " ", "a😀é", "x y\x1cz", "3.14", "no stop", "One. Two. ", "　wide ", "tab\tnew\nline", "..", "été. ÉTÉ"]


def rows(spark, values, *columns, kind="string"):
    return [tuple(r) for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(*columns).collect()]


def test_words_and_sentences_follow_python(spark):
    got = rows(spark, TEXTS, text.words(F.col("x")), text.sentences(F.col("x")), text.has_text(F.col("x")), text.strip(F.col("x")))
    for value, (words, sentences, has, strip) in zip(TEXTS, got, strict=True):
        assert words == value.split()
        assert sentences == [s.strip() for s in value.split(".") if s.strip()]
        assert has == bool(value.strip())
        assert strip == value.strip()


def test_null_has_no_text(spark):
    assert rows(spark, [None], text.has_text(F.col("x"))) == [(False,)]


def test_preview(spark):
    assert [r[0] for r in rows(spark, ["a" * 80, "b" * 81], text.preview(F.col("x")))] == ["a" * 80, "b" * 80 + "..."]


def test_identity_follows_md5(spark):
    def first32(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:8], 16)

    for q, (item, h, b, t) in zip(["q", "", "ü"], rows(spark, ["q", "", "ü"], identity.item_id(F.col("x")), identity.stable_hash(F.col("x")), identity.bucket(F.col("x")), identity.is_test(F.col("x"))), strict=True):
        assert item == hashlib.md5(q.encode()).hexdigest()
        assert h == first32(q) and b == h % 1000 and t == (b < 200)
    assert rows(spark, [None], identity.item_id(F.col("x"))) == [(hashlib.md5(b"").hexdigest(),)]
    assert rows(spark, ["q"], identity.item_id(F.col("x"), F.lit("given")), identity.item_id(F.col("x"), F.lit(""))) == [("given", hashlib.md5(b"q").hexdigest())]
    assert identity.threshold(0.29) == int(0.29 * 1000)


@pytest.mark.parametrize(("answer", "n", "want"), [("B", 4, 1), (" b)", 4, 1), ("", 4, None), ("   ", 4, None), ("Z", 4, None), (None, 4, None), ("A", 0, None), ("\xa0d", 4, 3), ("1", 4, None)])
def test_answer_index(spark, answer, n, want):
    options = F.array_repeat(F.lit("o"), n)
    assert rows(spark, [answer], answers.answer_index(F.col("x"), options)) == [(want,)]


def test_letters_and_rewards(spark):
    said = ["B", " c.", "Answer: B", "<think>", "the Earth", "0000", "", None]
    letters = [r[0] for r in rows(spark, said, answers.first_letter(F.col("x")))]
    assert letters == ["B", "C", "A", "H", "H", None, None, None]
    strict = [r[0] for r in rows(spark, said, answers.strict_letter(F.col("x")))]
    assert strict == ["B", "C", "B", None, None, None, None, None]
    assert [r[0] for r in rows(spark, said, answers.reward(F.col("x"), F.lit("H")))] == [0.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0]


def test_verdicts_treat_nan_as_nothing(spark):
    values = [0.75, 0.6, 0.59, math.nan, None]
    assert [r[0] for r in rows(spark, values, verdicts.separability(F.col("x")), kind="double")] == ["strong", "moderate", "none", "none", "none"]
    assert [r[0] for r in rows(spark, [0.0512, 0.01, 0.0, -0.1, math.nan], verdicts.exploitation(F.col("x"), F.lit(0.0)), kind="double")] == ["confirmed", "weak", "none", "none", "none"]
