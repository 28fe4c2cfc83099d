"""Principal components, a threshold mixed model, classifiers with cross-validation and importance."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="__raw").transform(df.dropna(subset=columns))


class Components:
    """Principal components of centred and scaled columns; the largest loading of each is positive."""

    def __init__(self, df: DataFrame, columns: list[str], k: int = 10) -> None:
        self.columns, self.k = columns, min(k, len(columns))
        rows = _vectors(df, columns)
        self.scaler = StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True).fit(rows)
        self.model = PCA(k=self.k, inputCol="__scaled", outputCol="__pcs").fit(self.scaler.transform(rows))
        loadings = self.model.pc.toArray()
        self.sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(self.k)])
        self.loadings = loadings * self.sign

    def loading_table(self, spark) -> DataFrame:
        rows = [(c, *map(float, self.loadings[i])) for i, c in enumerate(self.columns)]
        return spark.createDataFrame(rows, ", ".join(["variable string", *(f"PC{j + 1} double" for j in range(self.k))]))

    def variance_table(self, spark) -> DataFrame:
        return spark.createDataFrame([(f"PC{j + 1}", float(v)) for j, v in enumerate(self.model.explainedVariance)], "component string, share double")

    def scores(self, df: DataFrame) -> DataFrame:
        rows = self.model.transform(self.scaler.transform(_vectors(df, self.columns)))
        out = rows.withColumn("__a", vector_to_array("__pcs"))
        return out.withColumns({f"PC{j + 1}": F.col("__a")[j] * float(self.sign[j]) for j in range(self.k)}).drop("__raw", "__scaled", "__pcs", "__a")


def task_manifest(spark, variants: list[tuple[str, str]], targets: list[tuple[str, str]], seeds: list[int]) -> DataFrame:
    """Every (variant, target, chain) as a numbered task: a grid of parameters, not of data."""
    rows = [(v, p, c, r, k + 1, s) for v, p in variants for c, r in targets for k, s in enumerate(seeds)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "task_id int, variant string, dataset_path string, color_label string, response_col string, chain int, seed int")


_ERF = np.vectorize(math.erf)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse normal distribution function by bisection and Newton steps on the error function."""
    x = np.clip(4.91 * (p**0.14 - (1 - p) ** 0.14), -8, 8)  # Tukey's lambda approximation
    for _ in range(4):
        density = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
        x = np.clip(x - (_normal_cdf(x) - p) / np.maximum(density, 1e-300), x - 1, x + 1)
    return x


@dataclass
class ChainState:
    """Where a chain stands: its parameters, its iteration and its generator."""

    beta: list[float]
    intercepts: list[float]
    variance: float
    iteration: int
    generator: dict

    @classmethod
    def first(cls, effects: int, groups: int, seed: int) -> "ChainState":
        return cls([0.0] * effects, [0.0] * groups, 1.0, 0, np.random.default_rng(seed).bit_generator.state)

    def said(self) -> str:
        return json.dumps(self.__dict__)

    @classmethod
    def read(cls, said: str) -> "ChainState":
        return cls(**json.loads(said))


def gibbs(y: np.ndarray, X: np.ndarray, group: np.ndarray, iterations: int, burnin: int, thin: int, seed: int, prior_v: float = 1.0, prior_nu: float = 0.002, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Draws of fixed effects and group variance of a chain from its beginning to its end."""
    start = ChainState.first(X.shape[1], int(group.max()) + 1, seed)
    return gibbs_segment(y, X, group, start, iterations, burnin, thin, prior_v, prior_nu, counts)[:2]


#: Rows whose latent normals are held at once.
LATENT_ROWS = 1 << 16


def _latent_sums(draw: np.random.Generator, mean: np.ndarray, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of the latent normals of rows that are alike; a row of the arguments stands for the rows up to its end."""
    edge = _normal_cdf(-mean)
    low, high = np.where(y == 1, edge, 0.0), np.where(y == 1, 1.0, edge)
    out = np.zeros(len(mean))
    total = int(ends[-1]) if len(ends) else 0
    for start in range(0, total, LATENT_ROWS):
        stop = min(start + LATENT_ROWS, total)
        first, last = np.searchsorted(ends, [start, stop - 1], side="right")
        some = slice(first, last + 1)
        many = np.diff(np.minimum(ends[some], stop), prepend=start)
        bottom, width = np.repeat(low[some], many), np.repeat(high[some] - low[some], many)
        latent = np.repeat(mean[some], many) + _normal_quantile(np.clip(bottom + width * draw.random(stop - start), 1e-12, 1 - 1e-12))
        out[some] += np.bincount(np.repeat(np.arange(last + 1 - first), many), weights=latent, minlength=last + 1 - first)
    return out


def gibbs_segment(y: np.ndarray, X: np.ndarray, group: np.ndarray, state: ChainState, iterations: int, burnin: int, thin: int, prior_v: float = 1.0, prior_nu: float = 0.002, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, ChainState]:
    """The next ``iterations`` of a binary threshold model with a random intercept, and where they end.

    Latent normals of residual variance 1 are drawn by inverse distribution function, fixed effects
    under a flat prior, intercepts given the variance, the variance under a scaled inverse chi-square.
    ``counts``: rows that each row stands for; every one has its own latent normal, but only their sum is kept.
    """
    draw = np.random.default_rng()
    draw.bit_generator.state = state.generator
    n, p = X.shape
    q = len(state.intercepts)
    counts = np.ones(n, np.int64) if counts is None else counts
    ends, sizes = np.cumsum(counts), np.bincount(group, weights=counts, minlength=q)
    precision = X.T @ (X * counts[:, None]) + 1e-8 * np.eye(p)
    half = np.linalg.cholesky(np.linalg.inv(precision))
    beta, u, variance = np.array(state.beta), np.array(state.intercepts), state.variance
    kept_b, kept_v = [], []
    for it in range(state.iteration, state.iteration + iterations):
        latent = _latent_sums(draw, X @ beta + u[group], y, ends)
        beta = np.linalg.solve(precision, X.T @ (latent - counts * u[group])) + half @ draw.normal(size=p)
        shrink = 1 / (sizes + 1 / variance)
        u = shrink * np.bincount(group, weights=latent - counts * (X @ beta), minlength=q) + np.sqrt(shrink) * draw.normal(size=q)
        variance = float((prior_nu * prior_v + u @ u) / draw.chisquare(prior_nu + q))
        if it >= burnin and (it - burnin) % thin == 0:
            kept_b.append(beta)
            kept_v.append(variance)
    ended = ChainState(beta.tolist(), u.tolist(), variance, state.iteration + iterations, draw.bit_generator.state)
    return np.array(kept_b).reshape(-1, p), np.array(kept_v), ended


def _alike(manifest: DataFrame, data: DataFrame, variant: str, response: Callable[[str], str], effects: list[str], group: str) -> DataFrame:
    """Every task with its data: a row, with its number ``__rows``, for rows that no model of the manifest tells apart."""
    responses = sorted({response(r.response_col) for r in manifest.select("response_col").distinct().collect()})  # a few names
    cells = data.groupBy(*dict.fromkeys([variant, group, *effects, *responses])).agg(F.count("*").alias("__rows"))
    # By number, as few bytes would be put in one partition, and so all chains in one task.
    return manifest.join(cells, variant).repartition(4 * manifest.count(), "task_id")


def _arrays(pdf: pd.DataFrame, response: str, effects: list[str], group: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Response, effects, groups and numbers of rows of a task, in an order that only the values decide."""
    pdf = pdf.sort_values([group, *effects, response])
    X = np.column_stack([np.ones(len(pdf)), *(pdf[e].to_numpy(float) for e in effects)])
    return pdf[response].to_numpy(int), X, pd.factorize(pdf[group], sort=True)[0], pdf["__rows"].to_numpy(np.int64)


_SEGMENT = "task_id int, variant string, color string, chain int, effect string, iter int, value double, state string"


def _complete(spark, path: str) -> bool:
    """Whether a job has written this folder to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def run_segments(manifest: DataFrame, data: DataFrame, variant: str, response: Callable[[str], str], effects: list[str], group: str, folder: str, iterations: int, burnin: int, thin: int, segment: int = 1000, until: float | None = None, most: int | None = None) -> DataFrame:
    """Draws as ``fit_chains`` gives them, made in segments that survive a killed run.

    A segment is a job: it continues every chain from the states that the segment before it wrote, and
    writes draws and states in one folder below ``folder`` (shared storage), complete with its mark of success.
    Called again, complete segments are read and the chains go on behind them with the same numbers.
    ``until``: between segments chains end early once every effect's scale reduction is below it;
    ``most``: segments to run in this call.  ``segment`` and ``thin`` must stay as they were.
    """
    from tessera.operators.stats import psrf

    spark = manifest.sparkSession
    place = lambda k: f"{folder.rstrip('/')}/segment={k:06}"
    done = 0
    while _complete(spark, place(done)):
        done += 1
    ran, total = 0, -(-iterations // segment)
    draws = lambda: spark.read.parquet(*(place(k) for k in range(done))).where("state IS NULL").select("task_id", "variant", "color", "chain", "effect", "iter", "value")

    def settled() -> bool:
        if until is None or not done:
            return False
        worst = psrf(draws(), ["variant", "color", "effect"], iteration="iter", second_half=True).agg(F.max("psrf")).first()[0]
        return worst is not None and worst < until

    while done < total and (most is None or ran < most) and not settled():
        states = spark.read.parquet(place(done - 1)).where("state IS NOT NULL").select("task_id", "state") if done else manifest.select("task_id", F.lit(None).cast("string").alias("state"))
        steps = min(segment, iterations - done * segment)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            first = pdf.iloc[0]
            y, X, groups, counts = _arrays(pdf, response(first["response_col"]), effects, group)
            start = ChainState.read(first["state"]) if first["state"] else ChainState.first(X.shape[1], int(groups.max()) + 1, int(first["seed"]))
            betas, variances, ended = gibbs_segment(y, X, groups, start, steps, burnin, thin, counts=counts)  # noqa: B023  written before the next turn
            names = ["(Intercept)", *effects, f"var_{group}"]
            before = max(0, -(-(start.iteration - burnin) // thin))
            long = pd.DataFrame(np.column_stack([betas, variances]), columns=names).assign(iter=np.arange(before + 1, before + 1 + len(variances))).melt("iter", var_name="effect", value_name="value")
            long = pd.concat([long.assign(state=None), pd.DataFrame({"iter": [0], "effect": [""], "value": [0.0], "state": [ended.said()]})])
            return long.assign(task_id=int(first["task_id"]), variant=first[variant], color=first["color_label"], chain=int(first["chain"]))[[c.split()[0] for c in _SEGMENT.split(", ")]]

        _alike(manifest, data, variant, response, effects, group).join(states, "task_id").groupBy("task_id").applyInPandas(run, _SEGMENT).write.mode("overwrite").parquet(place(done))
        done, ran = done + 1, ran + 1
    return draws()


def fit_chains(manifest: DataFrame, data: DataFrame, variant: str, response: Callable[[str], str], effects: list[str], group: str, iterations: int, burnin: int, thin: int) -> DataFrame:
    """Draws (task_id, variant, color, chain, effect, iter, value) of every task of a manifest.

    One task is one chain.  Rows of equal group, effects and responses are sent to it once, with their number, so
    memory follows the distinct ones (all rows, if a covariate is continuous) and latents are drawn a piece at a time.
    """
    joined = _alike(manifest, data, variant, response, effects, group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        y, X, groups, counts = _arrays(pdf, response(first["response_col"]), effects, group)
        betas, variances = gibbs(y, X, groups, iterations, burnin, thin, int(first["seed"]), counts=counts)
        names = ["(Intercept)", *effects, f"var_{group}"]
        values = np.column_stack([betas, variances])
        long = pd.DataFrame(values, columns=names).assign(iter=np.arange(1, len(values) + 1)).melt("iter", var_name="effect", value_name="value")
        return long.assign(task_id=int(first["task_id"]), variant=first[variant], color=first["color_label"], chain=int(first["chain"]))[["task_id", "variant", "color", "chain", "effect", "iter", "value"]]

    return joined.groupBy("task_id").applyInPandas(run, "task_id int, variant string, color string, chain int, effect string, iter int, value double")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Folds that spread each class evenly: rows of a class are dealt in hash order."""
    w = W.Window.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return df.withColumn("fold", F.pmod(F.row_number().over(w) - 1, F.lit(k)).cast("int"))


def grouped_folds(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """Folds that keep groups whole: groups of one leading class are dealt by size, back and forth."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("__n"))
    lead = counts.groupBy(group).agg(F.sum("__n").alias("__size"), F.min(F.struct((-F.col("__n")).alias("n"), F.col(label).alias("l"))).alias("__lead"))
    at = F.row_number().over(W.Window.partitionBy(F.col("__lead.l")).orderBy(F.desc("__size"), group)) - 1
    place = F.pmod(at, F.lit(2 * k))
    fold = F.when(place < k, place).otherwise(2 * k - 1 - place).cast("int")
    return df.join(lead.select(group, fold.alias("fold")), group)


#: Group vectors that one task balances.
BALANCED = 20_000


def balance(vectors: list[tuple[float, ...]], k: int, totals: np.ndarray | None = None, held: np.ndarray | None = None) -> list[int]:
    """A fold for each class-count vector, one after the other: where the squared shares of its classes grow
    least, then the fold of fewest rows, then the first.

    ``totals`` are those of all vectors, ``held`` is what the folds hold of those before, where these are some of them.
    """
    totals = np.sum(np.array(vectors), axis=0) if totals is None else totals
    weight = 1 / np.maximum(totals, 1) ** 2
    held = np.zeros((k, len(totals))) if held is None else held.copy()
    rows, out = held.sum(axis=1), []
    for v in np.array(vectors):
        cost = np.round((held * (v * weight)[None]).sum(axis=1), 12)
        fold = int(np.lexsort((np.arange(k), rows, cost))[0])
        held[fold] += v
        rows[fold] += v.sum()
        out.append(fold)
    return out


def stratified_group_folds(df: DataFrame, group: str, label: str, k: int = 5, balanced: int | None = None) -> DataFrame:
    """Folds that keep groups whole and spread every class evenly.

    Groups of equal class counts are interchangeable: of m such, k * (m div k) are dealt round by the order
    of their names.  The rest, fewer than k of each kind, are balanced greedily as whole vectors,
    largest group first, then by name (``balance``).  Ranges of that order, of about ``BALANCED`` groups, follow one
    another, and what the folds hold of each class, k numbers, goes on to the next.  A null group is one group; a null
    class is a class.
    """
    from tessera.operators.ordered import in_ranges, row_number_within
    from tessera.operators.verbs import join_groups

    most = balanced or BALANCED
    kind = df.schema[group].dataType.simpleString()
    counts = df.groupBy(group, F.col(label).cast("string").alias("__class")).agg(F.count("*").alias("__n"))
    vectors = counts.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("__class", "__n"))).alias("__v"), F.sum("__n").alias("__size"))  # a group's classes
    kinds = vectors.groupBy("__v").agg(F.count("*").alias("__m"))
    numbered = row_number_within(vectors, ["__v"], [group], "__k").join(kinds, "__v").withColumn("__k", F.col("__k") - 1)
    even = F.col("__k") < F.col("__m") - F.col("__m") % k
    dealt = numbered.where(even).select(group, (F.col("__k") % k).cast("int").alias("fold"))
    level = numbered.where(~even).select(F.col(group).alias("__item"), "__v", "__size").persist()

    parts = max(1, -(-level.count() // most))
    placed = in_ranges(level, ["-__size", "__item"], parts, "__part").persist()
    per_class = lambda rows, *by: rows.select(*by, F.explode("__v").alias("c")).groupBy(*by, F.col("c.__class").alias("class")).agg(F.sum("c.__n").alias("n")).collect()
    found = {r["class"]: float(r.n) for r in per_class(level)}
    classes = sorted(found, key=lambda c: (c is not None, c or ""))
    totals, held = np.array([found[c] for c in classes]), np.zeros((k, len(classes)))

    def balancing(held: np.ndarray) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.assign(__null=pdf["__item"].isna()).sort_values(["__size", "__null", "__item"], ascending=[False, True, True], kind="stable")
            vectors = [{x["__class"]: x["__n"] for x in v} for v in pdf["__v"]]
            return pd.DataFrame({"__item": pdf["__item"], "fold": balance([tuple(float(v.get(c, 0)) for c in classes) for v in vectors], k, totals, held)})

        return run

    steps: list[DataFrame] = []
    for part in range(parts):
        own = placed.where(F.col("__part") == part)
        steps.append(own.groupBy("__part").applyInPandas(balancing(held), f"__item {kind}, fold int").persist())
        if part < parts - 1:
            held = held.copy()
            for r in per_class(join_groups(own, steps[-1], ["__item"]), "fold"):
                held[r.fold, classes.index(r["class"])] += r.n
    every = reduce(DataFrame.unionByName, (x.withColumnRenamed("__item", group) for x in steps), dealt)
    return join_groups(df, every, [group])


def fold_deviation(df: DataFrame, label: str, fold: str = "fold", k: int = 5) -> DataFrame:
    """(class, n, least, most): rows of each class, and its fewest and most in one of k folds."""
    counts = df.groupBy(label, fold).agg(F.count("*").alias("m"))
    return counts.groupBy(label).agg(F.sum("m").alias("n"), F.when(F.count("*") < k, F.lit(0)).otherwise(F.min("m")).alias("least"), F.max("m").alias("most"))


def group_prior(df: DataFrame, group: str, label: str, fold: str, ingest: str) -> DataFrame:
    """Out-of-fold prediction: the group's commonest class in the other folds, else the commonest of all.

    Equal counts prefer the class met first.
    """
    counts = df.groupBy(fold, group, label).agg(F.count("*").alias("n"), F.min(ingest).alias("first"))
    folds = df.select(F.col(fold).alias("held")).distinct()
    others = counts.join(F.broadcast(folds), F.col(fold) != F.col("held"))  # as many rows as counts times folds less one
    best = lambda by: others.groupBy("held", *by, label).agg(F.sum("n").alias("n"), F.min("first").alias("first")).groupBy("held", *by).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", F.col(label).alias("l"))).alias("b")).select("held", *by, F.col("b.l").alias("__" + "_".join(["best", *by])))
    own = best([group]).select("held", F.col(group).alias("__group"), F.col(f"__best_{group}").alias("__own"))
    every = best([]).withColumnRenamed("__best", "__every")
    out = df.join(own, (F.col(fold) == F.col("held")) & (F.col(group) == F.col("__group")), "left").select(*df.columns, "__own")
    return out.join(F.broadcast(every), F.col(fold) == F.col("held"), "left").withColumn("pred", F.coalesce("__own", "__every")).drop("__own", "__every", "held")


def majority(df: DataFrame, label: str, fold: str) -> DataFrame:
    """Out-of-fold prediction by the commonest class of the other folds."""
    counts = df.groupBy(fold, label).agg(F.count("*").alias("n"))
    folds = df.select(F.col(fold).alias("held")).distinct()
    best = counts.join(F.broadcast(folds), F.col(fold) != F.col("held")).groupBy("held", label).agg(F.sum("n").alias("n")).groupBy("held").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(label).alias("l"))).alias("b"))
    return df.join(F.broadcast(best), F.col(fold) == F.col("held"), "left").withColumn("pred", F.col("b.l")).drop("held", "b")


def _learner(name: str, n: int, trees: int, seed: int):
    if name == "logistic":
        return LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / max(n, 1), elasticNetParam=0.0, maxIter=100)
    return RandomForestClassifier(featuresCol="__x", labelCol="__y", numTrees=trees, minInstancesPerNode=3, maxDepth=12, seed=seed)


def _fitted(train: DataFrame, features: list[str], label: str, name: str, trees: int, seed: int):
    """Scaler and model fitted on one training part, as a function that adds ``pred``."""
    index = StringIndexer(inputCol=label, outputCol="__y", stringOrderType="alphabetAsc").fit(train)
    rows = index.transform(_vectors(train, features))
    scaler = StandardScaler(inputCol="__raw", outputCol="__x", withMean=True, withStd=True).fit(rows)
    model = _learner(name, train.count(), trees, seed).fit(scaler.transform(rows))
    names = F.array(*map(F.lit, index.labels))
    return lambda part: model.transform(scaler.transform(_vectors(part, features))).withColumn("pred", F.get(names, F.col("prediction").cast("int"))).drop("__raw", "__x", "rawPrediction", "probability", "prediction")


def cross_validate(df: DataFrame, features: list[str], label: str, fold: str, name: str, k: int = 5, trees: int = 500, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of ``logistic`` or ``forest``; folds are fitted one after the other."""
    out = None
    for f in range(k):
        part = _fitted(df.where(F.col(fold) != f), features, label, name, trees, seed)(df.where(F.col(fold) == f))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(df: DataFrame, features: list[str], label: str, key: str, name: str = "forest", repeats: int = 50, trees: int = 100, seed: int = 42, bucket: int = 10_000) -> DataFrame:
    """Fall of macro-F1 when one feature's values are shuffled among rows, mean and deviation.

    Rows are dealt to buckets by hash and shuffled within them by a second hash order, so a shuffle is
    two windows over bounded buckets and a join, whatever the number of rows.
    """
    from tessera.operators.scoring import cells, macro_f1

    classes = tuple(sorted(r[0] for r in df.select(label).distinct().collect()))
    predict = _fitted(df, features, label, name, trees, seed)
    buckets = max(1, -(-df.count() // bucket))
    score = lambda d, by: macro_f1(cells(predict(d), by, gold=label), by, classes)
    base = score(df.withColumn("__one", F.lit(1)), ["__one"]).select(F.col("macro_f1").alias("base"))
    reps = df.sparkSession.range(repeats).select(F.col("id").cast("int").alias("rep"))
    rows = df.select(key, label, *features).join(F.broadcast(reps)).withColumn("__b", F.pmod(F.xxhash64(F.lit(seed), "rep", key), F.lit(buckets)))
    out = None
    for f in features:
        w = W.Window.partitionBy("rep", "__b")
        placed = rows.withColumns({"__to": F.row_number().over(w.orderBy(F.xxhash64(F.lit(f), F.lit(1), "rep", key), key)), "__from": F.row_number().over(w.orderBy(F.xxhash64(F.lit(f), F.lit(2), "rep", key), key))})
        values = placed.select("rep", "__b", F.col("__from").alias("__to"), F.col(f).alias("__v"))
        shuffled = placed.join(values, ["rep", "__b", "__to"]).withColumn(f, F.col("__v")).drop("__v", "__to", "__from", "__b")
        drop = score(shuffled, ["rep"]).join(F.broadcast(base)).agg(F.avg(F.col("base") - F.col("macro_f1")).alias("importance_mean"), F.stddev_pop(F.col("base") - F.col("macro_f1")).alias("importance_std")).withColumn("variable", F.lit(f))
        out = drop if out is None else out.unionByName(drop)
    return out.select("variable", "importance_mean", "importance_std")
