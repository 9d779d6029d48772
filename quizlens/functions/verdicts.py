"""Verdicts by fixed thresholds; NaN and null count as nothing found."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import CONFIRMED_GAP, MODERATE_AUROC, STRONG_AUROC, WEAK_GAP


def _known(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)


def separability(auroc: Column) -> Column:
    return F.when(_known(auroc) & (auroc >= STRONG_AUROC), "strong").when(_known(auroc) & (auroc >= MODERATE_AUROC), "moderate").otherwise("none")


def exploitation(treatment: Column, control: Column) -> Column:
    diff = treatment - control
    return F.when(_known(diff) & (diff > CONFIRMED_GAP), "confirmed").when(_known(diff) & (diff > WEAK_GAP), "weak").otherwise("none")
