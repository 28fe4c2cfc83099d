"""Summaries, tests, posterior statistics and chain diagnostics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from tessera.operators.quantiles import exact_quantiles
from tessera.operators.verbs import join_groups


def trimmed_mean(df: DataFrame, keys: list[str], columns: list[str], trim: float = 0.2) -> DataFrame:
    """Mean without the lowest and highest ``floor(trim * n)`` values of each column, by key, nulls aside.

    Equal values of a key are counted before they are ranked, so a hot key costs its distinct values,
    and the rows that a rank range keeps are found by overlap of ranges.
    """
    long = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot(keys, columns, "variable", "value").where(F.col("value").isNotNull())
    counted = long.groupBy(*keys, "variable", "value").agg(F.count("*").alias("__m"))
    w = W.Window.partitionBy(*keys, "variable").orderBy("value")
    ranked = counted.withColumns({"__upto": F.sum("__m").over(w.rowsBetween(W.Window.unboundedPreceding, 0)), "__n": F.sum("__m").over(W.Window.partitionBy(*keys, "variable"))})
    cut = F.floor(F.lit(trim) * F.col("__n"))
    kept = F.greatest(F.lit(0), F.least(F.col("__upto"), F.col("__n") - cut) - F.greatest(F.col("__upto") - F.col("__m"), cut))
    sums = ranked.groupBy(*keys, "variable").agg(F.sum(kept * F.col("value")).alias("__s"), F.sum(kept).alias("__k"))
    return sums.select(*keys, "variable", F.when(F.col("__k") > 0, F.col("__s") / F.col("__k")).alias("value"))


def standardise(df: DataFrame, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """z-scores with the n-1 deviation; moments are aggregated and joined back, no group is one task.

    A null key is a group like any other.
    """
    moments = df.groupBy(*by).agg(F.avg(value).alias("__mean"), F.stddev_samp(value).alias("__sd"))
    joined = join_groups(df, moments, by) if by else df.join(F.broadcast(moments))  # one row
    return joined.withColumn(out, (F.col(value) - F.col("__mean")) / F.col("__sd")).drop("__mean", "__sd")


def band_summary(df: DataFrame, band: str, flags: list[str], value: str) -> DataFrame:
    """n, sums and percentages of 0/1 flags, and the median of a value, by band."""
    sums = df.groupBy(band).agg(F.count("*").alias("n"), *(F.sum(f).alias(f"n_{f}") for f in flags), *((100 * F.avg(f)).alias(f"pct_{f}") for f in flags))
    return join_groups(sums, exact_quantiles(df, [band], value, [0.5]), [band]).withColumn("median", F.col("q")[0]).drop("q")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic and degrees of freedom of a contingency table, one row."""
    cell = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("o"))
    rows, cols = cell.groupBy("a").agg(F.sum("o").alias("ra")), cell.groupBy("b").agg(F.sum("o").alias("cb"))
    total = cell.agg(F.sum("o").alias("t"))
    grid = rows.join(F.broadcast(cols)).join(F.broadcast(total)).join(cell, ["a", "b"], "left")  # one row a cell
    expected = F.col("ra") * F.col("cb") / F.col("t")
    gap = F.coalesce("o", F.lit(0)) - expected
    return grid.agg(F.sum(gap * gap / expected).alias("statistic"), ((F.countDistinct("a") - 1) * (F.countDistinct("b") - 1)).alias("df"))


def chi_square_tail(statistic: str = "statistic", df: str = "df") -> Column:
    """Upper tail of the chi-square distribution: the regularised incomplete gamma function."""
    import math

    @F.pandas_udf(T.DoubleType())
    def tail(x: pd.Series, k: pd.Series) -> pd.Series:
        def one(x: float, k: float) -> float:
            if x <= 0:
                return 1.0
            a, z = k / 2, x / 2
            if z < a + 1:  # series of the lower part
                term = total = 1 / a
                n = a
                while abs(term) > abs(total) * 1e-16:
                    n += 1
                    term *= z / n
                    total += term
                return 1 - total * math.exp(-z + a * math.log(z) - math.lgamma(a))
            tiny = 1e-300  # continued fraction of the upper part
            b = z + 1 - a
            c, d = 1 / tiny, 1 / b
            h = d
            for i in range(1, 10_000):
                an = -i * (i - a)
                b += 2
                d = 1 / (an * d + b or tiny)
                c = b + an / c or tiny
                h *= d * c
                if abs(d * c - 1) < 1e-15:
                    break
            return h * math.exp(-z + a * math.log(z) - math.lgamma(a))

        return pd.Series([one(float(p), float(q)) for p, q in zip(x, k, strict=True)])

    return tail(F.col(statistic).cast("double"), F.col(df).cast("double"))


def bh(df: DataFrame, p: str, family: list[str], out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values within each family of tests; null p-values stay null."""
    tested = W.Window.partitionBy(*family)
    rank = F.row_number().over(tested.orderBy(F.col(p).asc_nulls_last()))
    ranked = df.withColumns({"__rank": rank, "__n": F.count(p).over(tested)})
    raw = F.col(p) * F.col("__n") / F.col("__rank")
    w = tested.orderBy(F.col("__rank").desc()).rowsBetween(W.Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min(raw).over(w)))).drop("__rank", "__n")


def posterior_quantile(draws: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Mean, 2.5 and 97.5 % quantiles (linear), two-sided tail, and whether the interval excludes 0."""
    above, below = F.avg((F.col(value) > 0).cast("int")), F.avg((F.col(value) < 0).cast("int"))
    means = draws.groupBy(*by).agg(F.avg(value).alias("post_mean"), (2 * F.least(above, below)).alias("pMCMC"))
    out = join_groups(means, exact_quantiles(draws, by, value, [0.025, 0.975]), by)
    lower, upper = F.col("q")[0], F.col("q")[1]
    return out.select(*by, "post_mean", lower.alias("lower95"), upper.alias("upper95"), "pMCMC", ((lower > 0) | (upper < 0)).alias("significant"))


def posterior_hpd(draws: DataFrame, by: list[str], value: str = "value", mass: float = 0.95) -> DataFrame:
    """Mean, narrowest interval of the mass (first of equals) and the floored two-sided tail."""
    from tessera.functions.text import pmcmc_floor

    w = W.Window.partitionBy(*by).orderBy(value)
    ranked = draws.withColumns({"__rank": F.row_number().over(w), "__n": F.count("*").over(W.Window.partitionBy(*by))})
    gap = F.greatest(F.lit(1), F.least(F.col("__n") - 1, F.round(F.lit(mass) * F.col("__n")).cast("long")))
    ends = ranked.select(*by, F.col(value).alias("lower"), F.col("__rank").alias("__r"), gap.alias("__gap"))
    tops = ranked.select(*by, F.col(value).alias("upper"), (F.col("__rank") - gap).alias("__r"))
    width = F.struct((F.col("upper") - F.col("lower")).alias("w"), "__r", "lower", "upper")
    best = ends.join(tops, [*by, "__r"]).groupBy(*by).agg(F.min(width).alias("__b"))
    positive = F.avg((F.col(value) > 0).cast("int"))
    means = draws.groupBy(*by).agg(F.avg(value).alias("mean"), pmcmc_floor(positive, F.count("*")).alias("pMCMC"))
    return means.join(best, by).select(*by, "mean", F.col("__b.lower").alias("lower"), F.col("__b.upper").alias("upper"), "pMCMC")


def psrf(draws: DataFrame, by: list[str], chain: str = "chain", value: str = "value", iteration: str | None = None, second_half: bool = False) -> DataFrame:
    """Potential scale reduction (point estimate with the degrees-of-freedom correction) per parameter.

    ``second_half`` leaves out the first half of each chain, as automatic burn-in does.
    """
    used = draws
    if second_half and iteration:
        last = draws.groupBy(*by, chain).agg(((F.max(iteration) + F.min(iteration)) / 2).alias("__mid"))
        used = draws.join(last, [*by, chain]).where(F.col(iteration) > F.col("__mid"))
    per = used.groupBy(*by, chain).agg(F.count("*").alias("__n"), F.avg(value).alias("__m"), F.var_samp(value).alias("__v"))
    # With m chains of n draws: W, B, their variances and the t correction.
    agg = per.groupBy(*by).agg(F.count("*").alias("__k"), F.avg("__n").alias("__n"), F.avg("__v").alias("__w"), F.var_samp("__m").alias("__vm"), F.var_samp("__v").alias("__vv"), F.covar_samp("__v", F.col("__m") * F.col("__m")).alias("__c2"), F.covar_samp("__v", "__m").alias("__c1"), F.avg("__m").alias("__mu"))
    b = F.col("__n") * F.col("__vm")
    v = (F.col("__n") - 1) / F.col("__n") * F.col("__w") + (1 + 1 / F.col("__k")) * F.col("__vm")
    var_w = F.col("__vv") / F.col("__k")
    var_b = 2 * b * b / (F.col("__k") - 1)
    cov_wb = F.col("__n") / F.col("__k") * (F.col("__c2") - 2 * F.col("__mu") * F.col("__c1"))
    share = (1 + 1 / F.col("__k")) / F.col("__n")
    var_v = ((F.col("__n") - 1) / F.col("__n")) ** 2 * var_w + share**2 * var_b + 2 * (F.col("__n") - 1) / F.col("__n") * share * cov_wb
    dof = 2 * v * v / var_v
    point = F.sqrt((dof + 3) / (dof + 1) * v / F.col("__w"))
    return agg.select(*by, F.col("__k").cast("int").alias("chains"), point.alias("psrf"))


#: Draws of a chain that are multiplied with each other in one array.
CHUNK = 4096


def mpsrf(draws: DataFrame, by: list[str], parameter: str, chain: str = "chain", iteration: str = "iter", value: str = "value") -> DataFrame:
    """Multivariate scale reduction of each model: largest eigenvalue over all its parameters.

    Iterations without a value of every parameter are left out, and longer chains cut to the shortest.  Scatter
    matrices are sums over iterations, made in part before any shuffle, so a long chain is many tasks;
    only a model's matrices meet in one.
    """
    import numpy as np

    from tessera.operators.ordered import row_number_within

    cells = draws.groupBy(*by, chain, iteration, parameter).agg(F.avg(value).alias("__x")).where(F.col("__x").isNotNull())
    sizes = cells.groupBy(*by).agg(F.countDistinct(parameter).alias("__p"))
    rows = cells.groupBy(*by, chain, iteration).agg(F.sort_array(F.collect_list(F.struct(F.col(parameter).alias("k"), F.col("__x").alias("x")))).alias("__v"))  # a model's parameters
    whole = join_groups(rows, sizes, by).where(F.size("__v") == F.col("__p")).withColumn("__v", F.transform("__v", lambda e: e["x"]))
    placed = row_number_within(whole, [*by, chain], [iteration], "__place")
    least = whole.groupBy(*by, chain).agg(F.count("*").alias("__n")).groupBy(*by).agg(F.min("__n").alias("__n"))
    used = join_groups(placed, least, by).where(F.col("__place") <= F.col("__n"))
    means = used.select(*by, chain, F.posexplode("__v").alias("__a", "__x")).groupBy(*by, chain, "__a").agg(F.avg("__x").alias("__y")).groupBy(*by, chain).agg(F.transform(F.sort_array(F.collect_list(F.struct("__a", "__y"))), lambda e: e["__y"]).alias("__m"))
    centred = join_groups(used, means, [*by, chain]).withColumn("__c", F.zip_with("__v", "__m", lambda x, m: x - m))
    products = centred.select(*by, chain, F.posexplode(F.flatten(F.transform("__c", lambda x: F.transform("__c", lambda y: x * y)))).alias("__ab", "__xy"))
    scatter = products.groupBy(*by, chain, "__ab").agg(F.sum("__xy").alias("__s")).groupBy(*by, chain).agg(F.transform(F.sort_array(F.collect_list(F.struct("__ab", "__s"))), lambda e: e["__s"]).alias("__s"))
    known = join_groups(join_groups(scatter, means, [*by, chain]), least, by)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, n, out = len(pdf), int(pdf["__n"].iloc[0]), float("nan")
        if m > 1 and n > 1:
            p = len(pdf["__m"].iloc[0])
            w = np.mean([np.array(s).reshape(p, p) / (n - 1) for s in pdf["__s"]], axis=0)
            b = np.atleast_2d(np.cov(np.array(pdf["__m"].tolist()), rowvar=False))
            top = float(np.linalg.eigvals(np.linalg.solve(w, b)).real.max())
            out = float(np.sqrt((1 - 1 / n) + (1 + 1 / m) * top))
        return pd.DataFrame([[*pdf[by].iloc[0], out]], columns=[*by, "mpsrf"])

    kinds = ", ".join(f"{c} {draws.schema[c].dataType.simpleString()}" for c in by)
    return known.groupBy(*by).applyInPandas(run, f"{kinds}, mpsrf double")  # a row a chain


def lagged_products(draws: DataFrame, by: list[str], iteration: str, value: str) -> DataFrame:
    """(by, __n, __products): for each chain the sums of centred x(i) x(i + k), k = 0, 1, ... up to 10 log10(n).

    A chain is cut into chunks of ``CHUNK`` draws, each with the first draws of the next as its edge.
    """
    from tessera.operators.ordered import row_number_within

    known = draws.where(F.col(value).isNotNull())
    moments = known.groupBy(*by).agg(F.count("*").alias("__n"), F.avg(value).alias("__mean"))
    lags = moments.withColumn("__lags", F.least(F.col("__n") - 1, F.floor(10 * F.log10("__n"))).cast("int"))
    placed = join_groups(row_number_within(known.select(*by, iteration, value), by, [iteration], "__place"), lags, by)
    at = F.col("__place") - 1
    own = F.floor(at / CHUNK)
    chunks = F.when((at % CHUNK < F.col("__lags")) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))
    one = placed.select(*by, "__n", "__lags", F.explode(chunks).alias("__chunk"), F.struct(at.alias("i"), (F.col(value) - F.col("__mean")).alias("x")).alias("__d"))
    held = one.groupBy(*by, "__n", "__lags", "__chunk").agg(F.sort_array(F.collect_list("__d")).alias("__d"))  # CHUNK and an edge
    x = F.transform("__d", lambda e: e["x"])
    cut = held.select(*by, "__n", "__lags", x.alias("__x"), F.least(F.size("__d"), F.lit(CHUNK)).alias("__core"))

    def product(k):
        many = F.least(F.col("__core"), F.size("__x") - k)
        return F.when(many > 0, F.aggregate(F.zip_with(F.slice("__x", F.lit(1), many), F.slice("__x", k + 1, many), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)).otherwise(0.0)

    each = cut.select(*by, "__n", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("__lags")), product)).alias("__lag", "__s"))
    sums = each.groupBy(*by, "__n", "__lag").agg(F.sum("__s").alias("__s"))
    return sums.groupBy(*by, "__n").agg(F.transform(F.sort_array(F.collect_list(F.struct("__lag", "__s"))), lambda e: e["__s"]).alias("__products"))


@F.pandas_udf(T.DoubleType())
def _chain_size(n: pd.Series, products: pd.Series) -> pd.Series:
    """Effective size of a chain from its lagged products: the spectrum at 0 of an autoregression, order by AIC."""
    import numpy as np

    def one(n: int, products) -> float:
        acov = np.array(products, float) / n
        if n < 3 or acov[0] <= 0:
            return 0.0
        best, coefficients, error = (n * np.log(acov[0]), np.zeros(0), acov[0]), np.zeros(0), acov[0]
        for k in range(1, len(acov)):  # Levinson-Durbin
            reflection = (acov[k] - coefficients @ acov[1:k][::-1]) / error
            coefficients = np.append(coefficients - reflection * coefficients[::-1], reflection)
            error *= 1 - reflection**2
            if error <= 0:
                break
            aic = n * np.log(error) + 2 * k
            if aic < best[0]:
                best = (aic, coefficients, error)
        _, phi, noise = best
        noise *= n / (n - (len(phi) + 1))
        return float(n * (acov[0] * n / (n - 1)) / (noise / (1 - phi.sum()) ** 2))

    return pd.Series([one(int(a), b) for a, b in zip(n, products, strict=True)], dtype=float)


def effective_size(draws: DataFrame, by: list[str], chain: str = "chain", iteration: str = "iter", value: str = "value") -> DataFrame:
    """Effective sample size summed over chains; chains of any length, from their lagged products."""
    per = lagged_products(draws, [*by, chain], iteration, value)
    return per.withColumn("__e", _chain_size(F.col("__n"), F.col("__products"))).groupBy(*by).agg(F.sum("__e").alias("ess"))


def converged(diagnostics: DataFrame, columns: list[str], threshold: float = 1.01) -> DataFrame:
    test = F.lit(True)
    for c in columns:
        test = test & (F.col(c) < threshold)
    return diagnostics.withColumn("converged", F.coalesce(test, F.lit(False)))


def thin(df: DataFrame, by: list[str], order: str, most: int = 1000) -> DataFrame:
    """At most ``most`` rows of each key, evenly spaced in order, the first and the last among them."""
    w = W.Window.partitionBy(*by)
    ranked = df.withColumns({"__i": F.row_number().over(w.orderBy(order)), "__n": F.count("*").over(w)})
    k = F.least(F.lit(most), F.col("__n"))
    # row i is kept if it is the rounded place of one of the k points
    step = (F.col("__n") - 1) / F.greatest(k - 1, F.lit(1))
    near = F.round((F.col("__i") - 1) / F.greatest(step, F.lit(1e-9)))
    hit = F.exists(F.array(near - 1, near, near + 1), lambda j: (j >= 0) & (j < k) & (F.rint(1 + j * step) == F.col("__i")))
    return ranked.where((F.col("__n") <= most) | hit).drop("__i", "__n")


def concordance(df: DataFrame, key: list[str], side: str, reference: str, value: str) -> DataFrame:
    """Each other side against the reference: pairs, correlation and largest deviation."""
    ref = df.where(F.col(side) == reference).select(*key, F.col(value).alias("x"))
    other = df.where(F.col(side) != reference).select(*key, side, F.col(value).alias("y"))
    return other.join(ref, key).groupBy(side).agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_deviation"))


def top_abs(df: DataFrame, by: str, value: str, tie: str, n: int = 10) -> DataFrame:
    w = W.Window.partitionBy(by).orderBy(F.abs(F.col(value)).desc(), tie)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def stacked_position(df: DataFrame, by: str, order: str, share: str, out: str = "position") -> DataFrame:
    """Middle of each part of a stack: the running sum less half of the part."""
    w = W.Window.partitionBy(by).orderBy(order).rowsBetween(W.Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(share).over(w) - F.col(share) / 2)


def despread(values: Column, gap: float) -> Column:
    """A sorted array of positions moved up so that neighbours are a gap apart."""
    sorted_values = F.array_sort(values)
    empty = F.array().cast("array<double>")
    return F.aggregate(sorted_values, empty, lambda acc, x: F.concat(acc, F.array(F.when(F.size(acc) > 0, F.greatest(x, F.element_at(acc, -1) + gap)).otherwise(x))))


def flow_offsets(df: DataFrame, left: str, right: str, n: str = "n") -> DataFrame:
    """Ribbons between two stacks of classes: where each starts on either side."""
    a = W.Window.orderBy(left, right).rowsBetween(W.Window.unboundedPreceding, -1)
    b = W.Window.orderBy(right, left).rowsBetween(W.Window.unboundedPreceding, -1)
    return df.withColumns({"left_start": F.coalesce(F.sum(n).over(a), F.lit(0)), "right_start": F.coalesce(F.sum(n).over(b), F.lit(0))})


def five_numbers(df: DataFrame, by: list[str], value: str) -> DataFrame:
    names = ("minimum", "lower_quartile", "median", "upper_quartile", "maximum")
    counts = df.groupBy(*by).agg(F.count(value).alias("n"))
    out = join_groups(counts, exact_quantiles(df, by, value, [0.0, 0.25, 0.5, 0.75, 1.0]), by)
    return out.select(*by, "n", *(F.col("q")[k].alias(name) for k, name in enumerate(names)))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    bin_no = F.least(F.lit(bins), F.width_bucket(F.col(value).cast("double"), F.lit(low), F.lit(high), F.lit(bins)))
    return df.where(F.col(value).isNotNull()).groupBy(*by, bin_no.cast("int").alias("bin")).agg(F.count("*").alias("n"))
