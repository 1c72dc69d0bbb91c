"""Scalar rules on measures and probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .fixed import EDGE_SMALL_UM, MIN_DIAMETER_UM, UM_PER_PX, ZONES


def px_to_um(length: Column, scale: float = UM_PER_PX) -> Column:
    return length * scale


def px2_to_um2(area: Column, scale: float = UM_PER_PX) -> Column:
    return area * (scale * scale)


def zone_of_bin(bin_index: Column, n_bins: Column) -> Column:
    q = (bin_index + 0.5) / n_bins
    rule = F.when(n_bins <= 0, ZONES[0][1])
    for bound, name in ZONES[:-1]:
        rule = rule.when(q <= bound, name)
    return rule.otherwise(ZONES[-1][1])


def cv(col: Column) -> Column:
    """Aggregate: population deviation over mean, 0 for fewer than two values or mean 0."""
    return F.when((F.count(col) < 2) | (F.avg(col) == 0), 0.0).otherwise(F.stddev_pop(col) / F.avg(col))


def softmax(logits: Column) -> Column:
    """Softmax of an array, shifted by its maximum."""
    exps = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    return F.transform(exps, lambda v: v / F.aggregate(exps, F.lit(0.0), lambda acc, e: acc + e))


def argmax(p: Column) -> Column:
    """Index of the largest element, the lowest on ties."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def argmax4(p0: Column, p1: Column, p2: Column, p3: Column) -> Column:
    best = F.greatest(p0, p1, p2, p3)
    return F.when(p0 == best, 0).when(p1 == best, 1).when(p2 == best, 2).otherwise(3)


def quantise(p: Column) -> Column:
    """Probability to 0-255, halves to even."""
    return F.least(F.greatest(F.rint(p * 255), F.lit(0.0)), F.lit(255.0)).cast("int")


def keep_component(eq_diam: Column, mean_prob: Column, edge: Column, tau: Column, d: Column,
                   min_diam: float = MIN_DIAMETER_UM) -> Column:
    return (eq_diam >= min_diam) & (mean_prob >= tau) & ~((edge < d) & (eq_diam < EDGE_SMALL_UM))


def is_complete(touches_edge: Column) -> Column:
    return ~F.coalesce(touches_edge.cast("boolean"), F.lit(False))


def is_plausible(coagulation_area_um2: Column, coagulation_width_um: Column) -> Column:
    """The rule in force: area at least 25 square micrometres and width at least 1."""
    return (coagulation_area_um2 >= 25) & (coagulation_width_um >= 1.0)


def difference_code(gt: Column, pred: Column) -> Column:
    """0 agree; false positives override misses of a lower class, as drawn in class order."""
    return (
        F.when(gt == pred, "agree")
        .when(pred > gt, F.concat(F.lit("fp_"), pred.cast("string")))
        .otherwise(F.concat(F.lit("fn_"), gt.cast("string")))
    )


def overlap_code(gt_is: Column, pred_is: Column) -> Column:
    return F.when(gt_is & pred_is, "both").when(gt_is, "gt_only").when(pred_is, "pred_only").otherwise("none")


def relative_difference(gt: Column, pred: Column) -> Column:
    return F.when(gt > 0, (pred - gt) / gt * 100).otherwise(0.0)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Lentz evaluation of the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def two_sided_p(t: float, dof: float) -> float:
    """Two-sided tail of Student's t."""
    if t is None or dof is None or math.isnan(t) or dof <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    a, b, x = dof / 2.0, 0.5, dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@pandas_udf(DoubleType())
def t_test_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """One value per summary row; Spark has no t distribution."""
    return pd.Series([two_sided_p(a, b) for a, b in zip(t, dof)])
