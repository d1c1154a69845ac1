"""Forward returns and the labels derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.nullsafe import col, ratio
from ..functions.scalars import argmax, clamp, logistic
from .ordered import Ctx, Layer

# Width of soft labels, cap of returns as a target, thresholds and horizons of a move, names of labels.
TAU = 0.02
CAP = 0.30
THRESHOLDS = {("corn", True): 0.015}
THRESHOLD = 0.025
HORIZON = {False: 7, True: 1}
SOFT_CLASSES = ["target_mc_down", "target_mc_flat", "target_mc_up"]
LABEL_COLUMNS = ["target", "target_binary", "target_soft", "target_reg", *SOFT_CLASSES, "target_multiclass", "return_future"]


def threshold(crop: str, weekly: bool) -> float:
    return THRESHOLDS.get((crop, weekly), THRESHOLD)


def horizon(weekly: bool) -> int:
    return HORIZON[weekly]


def forward_return(c: str, rows: int, out: str = "return_future") -> Layer:
    def layer(ctx: Ctx) -> dict[str, Column]:
        return {out: ratio(F.lead(c, rows).over(ctx.w), c) - 1}

    return layer


def binary(r: str | Column, theta) -> Column:
    """1.0 above theta, null when the return is unknown."""
    return (col(r) > theta).cast("double")


def soft(r: str | Column, theta) -> Column:
    return logistic((col(r) - theta) / TAU)


def capped(r: str | Column) -> Column:
    return clamp(r, -CAP, CAP)


def three_way(r: str | Column, theta) -> tuple[Column, Column, Column]:
    """Unnormalised (down, flat, up) scores."""
    r = col(r)
    down = logistic((-theta - r) / TAU)
    up = logistic((r - theta) / TAU)
    return down, F.greatest(1 - down - up, F.lit(0.0)), up


def all_labels(r: str, theta) -> dict[str, Column]:
    """Every label column of an integrated table; all null where the return is unknown."""
    known = F.col(r).isNotNull()
    down, flat, up = three_way(r, theta)
    total = down + flat + up
    return {
        "target_binary": binary(r, theta),
        "target_soft": soft(r, theta),
        "target_reg": capped(r),
        "target": binary(r, theta),
        "target_mc_down": F.when(known, down / total),
        "target_mc_flat": F.when(known, flat / total),
        "target_mc_up": F.when(known, up / total),
        "target_multiclass": F.when(known, argmax([down, flat, up]).cast("double")),
    }
