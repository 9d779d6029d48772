"""Numbers that a trainer is configured by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import MIN_SAVE_STEPS


def effective_batch(per_device: Column, accumulation: Column) -> Column:
    """Examples between two updates of a device's weights."""
    return per_device * accumulation


def save_steps(steps: Column) -> Column:
    """Steps between two checkpoints: a quarter of all, but not too few."""
    return F.greatest(F.lit(MIN_SAVE_STEPS).cast("long"), F.floor(steps / 4).cast("long"))
