"""Letters: from an answer to an option's place, and from a completion to a prediction and a reward."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import strip


def answer_index(answer: Column, options: Column) -> Column:
    """Place of the answer's first letter among the options, null where there is none.

    Null, empty and blank answers, empty option lists and letters beyond the options give null.
    """
    place = F.ascii(F.upper(strip(answer.cast("string")))) - 65
    return F.when((F.size(options) > 0) & (answer != "") & (place >= 0) & (place < F.size(options)), place)


def letter(place: Column) -> Column:
    return F.chr(F.lit(65) + place)


def first_letter(completion: Column) -> Column:
    """The first of A-H or a-h anywhere in the text, as a capital; null without one."""
    return F.upper(F.regexp_substr(completion.cast("string"), F.lit("[A-Ha-h]")))


def strict_letter(completion: Column) -> Column:
    """A letter that stands alone at the start or after "answer"; null for anything else. Not what the audit scores by."""
    found = F.regexp_extract(strip(completion.cast("string")), r"(?i)^(?:answer\s*[:=]?\s*)?\(?([A-H])\)?(?:[.):\s]|$)", 1)
    return F.upper(F.nullif(found, F.lit("")))


def reward(completion: Column, correct: Column) -> Column:
    return F.when(first_letter(completion).eqNullSafe(correct) & correct.isNotNull(), 1.0).otherwise(0.0)


def register(spark: SparkSession, name: str = "reward") -> None:
    """The reward as a function of SQL, (completion, correct letter) to 0.0 or 1.0."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(completion STRING, correct STRING) RETURNS DOUBLE RETURN CASE WHEN correct IS NOT NULL AND upper(regexp_substr(completion, '[A-Ha-h]')) <=> correct THEN 1.0D ELSE 0.0D END")
