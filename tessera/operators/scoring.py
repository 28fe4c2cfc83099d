"""Scores of labellers against a reference: everything follows from one table of cell counts.

``cells`` is a partial aggregation of at most |models| x |classes|^2 rows, so later steps are small
whatever the number of scored rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.values import safe_divide
from tessera.schemas import CLASSES


def cells(df: DataFrame, by: list[str], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(by, gold, pred, n)."""
    return df.groupBy(*by, F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def accuracy(counts: DataFrame, by: list[str]) -> DataFrame:
    right = F.sum(F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0))
    return counts.groupBy(*by).agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy"))


def confusion(counts: DataFrame, by: list[str], domain: tuple[str, ...] = CLASSES) -> DataFrame:
    """Every cell of the domain, 0 where there is none."""
    spark = counts.sparkSession
    grid = spark.createDataFrame([(g, p) for g in domain for p in domain], "gold string, pred string")
    full = counts.select(*by).distinct().join(F.broadcast(grid))
    return full.join(counts, [*by, "gold", "pred"], "left").select(*by, "gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def row_share(counts: DataFrame, by: list[str], domain: tuple[str, ...] = CLASSES) -> DataFrame:
    """Cells as shares of their gold class, 0 for a class without rows."""
    cell = confusion(counts, by, domain)
    total = cell.groupBy(*by, "gold").agg(F.sum("n").alias("total"))
    return cell.join(total, [*by, "gold"]).select(*by, "gold", "pred", safe_divide(F.col("n"), F.col("total")).alias("share"))


def by_class(counts: DataFrame, by: list[str], domain: tuple[str, ...] = CLASSES) -> DataFrame:
    """Precision, recall and F1 (0 on 0/0) with support of every class of the domain."""
    cell = confusion(counts, by, domain)
    sides = cell.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("class"), F.when(F.col("gold") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called")), F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called")))).alias("s")).select(*by, "s.*")
    sums = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("called"))
    precision, recall = safe_divide(F.col("tp"), F.col("called")), safe_divide(F.col("tp"), F.col("support"))
    f1 = safe_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return sums.select(*by, "class", "support", precision.alias("precision"), recall.alias("recall")).withColumn("f1", f1)


def macro_f1(counts: DataFrame, by: list[str], domain: tuple[str, ...] = CLASSES) -> DataFrame:
    """Mean F1 of classes that the reference has."""
    return by_class(counts, by, domain).where("support > 0").groupBy(*by).agg(F.avg("f1").alias("macro_f1"))


def balanced_accuracy(counts: DataFrame, by: list[str], domain: tuple[str, ...] = CLASSES) -> DataFrame:
    return by_class(counts, by, domain).where("support > 0").groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def kappa(counts: DataFrame, by: list[str]) -> DataFrame:
    """Cohen's kappa, 0 where chance agreement is complete."""
    margins = counts.select(*by, F.explode(F.array(F.struct(F.col("gold").alias("c"), F.col("n").alias("g"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("g"), F.col("n").alias("p")))).alias("m")).select(*by, "m.*")
    expected = margins.groupBy(*by, "c").agg(F.sum("g").alias("g"), F.sum("p").alias("p")).groupBy(*by).agg(F.sum(F.col("g") * F.col("p")).alias("gp"), F.sum("g").alias("total"))
    observed = accuracy(counts, by).select(*by, "accuracy")
    pe = F.col("gp") / (F.col("total").cast("double") * F.col("total"))
    return observed.join(expected, by).select(*by, F.when(pe == 1, 0.0).otherwise((F.col("accuracy") - pe) / (1 - pe)).alias("kappa"))


def disagreements(df: DataFrame, columns: dict[str, int], gold: str = "gold", pred: str = "pred") -> DataFrame:
    """Rows whose labels differ, with texts cut to a width."""
    cut = {c: F.substring(F.coalesce(F.col(c).cast("string"), F.lit("")), 1, n) for c, n in columns.items()}
    return df.where(~F.col(gold).eqNullSafe(F.col(pred))).withColumns(cut)


def metric_bootstrap(counts: DataFrame, by: list[str], metric: "str | Callable", replicates: int, seed: int) -> DataFrame:
    """Percentile interval (95 %) of a metric over resampled rows.

    ``metric``: ``accuracy``, ``kappa``, ``macro_f1``, or a function of (draws, gold, pred): a matrix of row counts, a
    line a replicate and a column a cell, and the labels of the cells; it gives one number a replicate.

    A resample of rows is a multinomial draw over their cells, so replicates cost the cells only,
    whatever the number of rows.  Replicates of fewer than two reference classes are left out.
    """
    import numpy as np
    import pandas as pd

    key = [counts.schema[b] for b in by]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["gold", "pred"])
        gold, pred, n = pdf["gold"].to_numpy(), pdf["pred"].to_numpy(), pdf["n"].to_numpy()
        draws = np.random.default_rng(seed).multinomial(n.sum(), n / n.sum(), size=replicates)
        classes = sorted(set(gold) | set(pred))
        tp = np.stack([draws[:, (gold == c) & (pred == c)].sum(axis=1) for c in classes], axis=1)
        support = np.stack([draws[:, gold == c].sum(axis=1) for c in classes], axis=1)
        called = np.stack([draws[:, pred == c].sum(axis=1) for c in classes], axis=1)
        total = draws.sum(axis=1)
        if callable(metric):
            values = np.asarray(metric(draws, gold, pred), float)
        elif metric == "accuracy":
            values = tp.sum(axis=1) / total
        elif metric == "kappa":
            pe = (support * called).sum(axis=1) / total**2.0
            values = np.where(pe == 1, 0.0, (tp.sum(axis=1) / total - pe) / np.where(pe == 1, 1, 1 - pe))
        else:
            f1 = np.where(support + called > 0, 2 * tp / np.maximum(support + called, 1), 0)
            seen = support > 0
            values = (f1 * seen).sum(axis=1) / np.maximum(seen.sum(axis=1), 1)
        values = values[(support > 0).sum(axis=1) > 1]
        low, high = np.percentile(values, [2.5, 97.5]) if len(values) else (np.nan, np.nan)
        return pd.DataFrame([[*pdf[by].iloc[0], float(low), float(high), len(values)]], columns=[*by, "low", "high", "replicates"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in key), "low double, high double, replicates long"])
    return counts.groupBy(*by).applyInPandas(run, schema)


def agreement_funnel(df: DataFrame, labels: list[str], known: tuple[str, ...]) -> DataFrame:
    """One row: covered by all labellers, known by all, of one opinion, disagreeing, and rates.

    ``MISSING`` marks a labeller that did not run, ``UNKNOWN`` one that abstained; both keep apart.
    """
    covered = ~F.exists(F.array(*labels), lambda x: x == "MISSING")
    all_known = F.forall(F.array(*labels), lambda x: x.isin(*known))
    agree = all_known & (F.size(F.array_distinct(F.array(*labels))) == 1)
    out = df.agg(F.count("*").alias("n"), F.count_if(covered).alias("covered"), F.count_if(covered & all_known).alias("known"), F.count_if(covered & agree).alias("agree"))
    rate = lambda a, b: F.round(safe_divide(F.col(a), F.col(b)), 4)
    return out.withColumns({"disagree": F.col("known") - F.col("agree"), "agree_of_known": rate("agree", "known"), "agree_of_covered": rate("agree", "covered")})


def retention(stages: DataFrame, order: str, n: str) -> DataFrame:
    """Each stage's share of the first and of the one before, in percent."""
    from pyspark.sql import window as W

    w = W.Window.orderBy(order)
    first = F.first(n).over(w.rowsBetween(W.Window.unboundedPreceding, 0))
    return stages.withColumns({"of_first": F.round(100 * F.col(n) / first, 4), "of_previous": F.round(100 * F.col(n) / F.lag(n).over(w), 4)})


def designation(low_a: Column, high_a: Column, mean_a: Column, low_b: Column, high_b: Column, mean_b: Column) -> Column:
    """Robustness of an effect over two subsets."""
    same = F.signum(mean_a) == F.signum(mean_b)
    clear = ((low_a > 0) | (high_a < 0)) & ((low_b > 0) | (high_b < 0))
    return F.when(same & clear, "robust").when(same, "same_direction_interval_changes").otherwise("label-sensitive")
