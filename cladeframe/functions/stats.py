"""Statistical functions: Student's t as an Arrow UDF, the rest as column expressions and windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray, steps: int = 300) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b) by its continued fraction, elementwise."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    gamma = np.vectorize(math.lgamma, otypes=[float])
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    inside = (y > 0) & (y < 1)
    z = np.where(inside, y, 0.5)
    front = np.exp(gamma(p + q) - gamma(p) - gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    tiny = 1e-300
    c, d = np.ones_like(z), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, steps):
        for n in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + n * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + n / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(inside, front * h, np.where(y <= 0, 0.0, 1.0))
    return np.where(swap, 1 - out, out)


@F.pandas_udf(DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of Student's t; null where t or df is null."""
    ok = t.notna() & df.notna()
    out = pd.Series(np.nan, index=t.index)
    if ok.any():
        d, x = df[ok].to_numpy(float), t[ok].to_numpy(float)
        out[ok] = incomplete_beta(d / 2, np.full_like(d, 0.5), d / (d + x * x))
    return out.astype("float64").where(ok, None)


def average_rank(value: str, by: list[str]) -> Column:
    """Ranks from 1 with ties at their mean, within ``by``; nulls are ranked apart and give null."""
    part = W.partitionBy(*by, F.col(value).isNull())
    same = W.partitionBy(*by, F.col(value).isNull(), value)
    return F.when(F.col(value).isNotNull(), F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2)


def adjust(rows: DataFrame, p: str, by: list[str], ties: list[str]) -> DataFrame:
    """Adds ``p_bh``, ``p_by``, ``p_holm``, ``p_bonferroni`` and ``n_tests`` within ``by``; rows with a null p stay null and do not count."""
    has = F.col(p).isNotNull()
    part = W.partitionBy(*by, has)
    up = part.orderBy(p, *ties)
    rows = rows.withColumn("n_tests", F.sum(F.when(has, 1).otherwise(0)).over(W.partitionBy(*by)).cast("bigint"))
    rows = rows.withColumn("__k", F.row_number().over(up))
    n, k, x = F.col("n_tests"), F.col("__k"), F.col(p)
    down = part.orderBy(F.desc(p), *[F.desc(c) for c in ties]).rowsBetween(W.unboundedPreceding, 0)
    forward = up.rowsBetween(W.unboundedPreceding, 0)
    one = F.lit(1.0)
    rows = rows.withColumn("__by", F.sum(1 / k).over(part))
    for name, expression in (
        ("p_bh", F.least(one, F.min(x * n / k).over(down))), ("p_by", F.least(one, F.min(x * n * F.col("__by") / k).over(down))),
        ("p_holm", F.least(one, F.max(x * (n - k + 1)).over(forward))), ("p_bonferroni", F.least(one, x * n)),
    ):
        rows = rows.withColumn(name, F.when(has, expression))
    return rows.drop("__k", "__by")


def auc(rows: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Area under the ROC curve by ranks with average ties; null where a group has one class only."""
    ranked = rows.where(F.col(score).isNotNull() & F.col(label).isNotNull()).withColumn("__r", average_rank(score, by))
    y = F.col(label) == 1
    out = ranked.groupBy(*by).agg(F.count_if(y).alias("n1"), F.count_if(~y).alias("n0"), F.sum(F.when(y, F.col("__r"))).alias("r"))
    return out.select(*by, F.col("n0").cast("bigint").alias("n0"), F.col("n1").cast("bigint").alias("n1"), F.try_divide(F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n0") * F.col("n1")).alias("auc"))
