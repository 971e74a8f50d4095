"""Retrieval metrics, paired statistics and the regression gate."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ir_metrics(ranked: DataFrame, qrels: DataFrame, query_id: str, doc: str, k: int) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) at k for every judged query.

    ``qrels``: (query_id, doc, grade); grades above zero are relevant.  Gain
    is 2^grade - 1 over log2(rank + 1); the ideal takes the best k grades.
    Queries without results score zero; without relevant documents recall and
    ndcg are zero.
    """
    judged = qrels.where("grade > 0")
    order = Window.partitionBy(query_id).orderBy(F.desc("grade"), doc)
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    ideal = judged.withColumn("_r", F.row_number().over(order)).groupBy(query_id).agg(F.count("*").alias("_n"), F.sum(F.when(F.col("_r") <= k, gain(F.col("grade"), F.col("_r")))).alias("_ideal"))
    hits = ranked.where(F.col("rank") <= k).join(judged, [query_id, doc])
    scored = hits.groupBy(query_id).agg(F.count("*").alias("_h"), F.min("rank").alias("_first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("_dcg"))
    rows = qrels.select(query_id).distinct().join(ideal, query_id, "left").join(scored, query_id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.select(query_id, zero(F.col("_h") / F.col("_n")).alias("recall"), zero(F.col("_h") / F.lit(float(k))).alias("precision"), zero(1 / F.col("_first")).alias("mrr"), zero(F.col("_dcg") / F.col("_ideal")).alias("ndcg"))


def paired_t(pairs: DataFrame, group: list[str], base: str, candidate: str) -> DataFrame:
    """(group, n, mean_delta, t, df): statistic of the paired differences candidate - base.

    With fewer than two pairs or no variance t is null and the sign of the
    mean decides.  Rows with a null on either side are left out.
    """
    rows = pairs.where(F.col(base).isNotNull() & F.col(candidate).isNotNull()).withColumn("_d", F.col(candidate).cast("double") - F.col(base).cast("double"))
    stats = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), F.stddev_samp("_d").alias("_s"))
    t = F.when((F.col("n") > 1) & (F.col("_s") > 1e-12), F.col("mean_delta") / (F.col("_s") / F.sqrt("n")))
    return stats.select(*group, "n", "mean_delta", t.alias("t"), (F.col("n") - 1).alias("df"))


def _beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(300):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def student_tail(t: float, df: float) -> float:
    """P(T >= t)."""
    half = 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    return half if t >= 0 else 1 - half


def one_sided_p(t: Column, df: Column, mean: Column) -> Column:
    """p of "the candidate is worse": P(T <= t); one row for each test, so few rows reach Python."""

    @F.pandas_udf("double")
    def tail(t: pd.Series, df: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series([student_tail(-a, b) if pd.notna(a) else (0.0 if m < 0 else 1.0) for a, b, m in zip(t, df, mean, strict=True)])

    return tail(t, df.cast("double"), mean)


def holm(tests: DataFrame, family: list[str], p: str, key: str) -> DataFrame:
    """Step-down adjusted p: running maximum of (m - i + 1) * p in order of p, at most one."""
    order = Window.partitionBy(*family).orderBy(p, key)
    scaled = F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(order) + 1) * F.col(p))
    return tests.withColumn("_s", scaled).withColumn("adjusted", F.max("_s").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def gate(value: Column, base: Column, adjusted: Column, floor: float, tolerance: float = 0.02, alpha: float = 0.05) -> Column:
    """Verdict: below the floor, a significant drop beyond the tolerance, or pass."""
    return F.when(value < floor, "below_floor").when((base - value > tolerance) & (adjusted < alpha), "regressed").otherwise("pass")
